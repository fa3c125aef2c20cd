"""Candidate-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import html as H
from shelfspark.functions import urls as U
from shelfspark.functions.text import HTML_ENTITIES
from shelfspark.operators import matching as K
from shelfspark.operators import paging as PG
from shelfspark.plans.registry import query
from shelfspark.plans.registry_queries import norm_sql
from shelfspark.plans.views import VIEWS

_CODE = "'AB' || cast(10000 + p_partkey AS string) || 'C'"
VIEWS["shop_pages_v"] = f"""
    SELECT p_partkey AS product_id, cast(floor(p_partkey / 2) AS bigint) AS group_id, p_partkey % 8 AS variant,
           {_CODE} AS mpn, lpad(cast(p_partkey AS string), 6, '0') AS model, p_brand AS manufacturer,
           p_name || ' deluxe edition' AS name, 'Oven plates' AS category,
           cast(p_retailprice AS decimal(12,2)) AS own_price, p_partkey % 3 <> 1 AS valid_url,
           CASE WHEN p_partkey % 3 = 0 THEN 'marketplace' ELSE 'shop' END AS source_type, 'shop' AS source_name,
           'https://www.shop.example.com/p/' || CASE WHEN p_partkey % 8 = 4 THEN lower({_CODE})
               ELSE 'item/' || cast(p_partkey AS string) END AS requested_url,
           '<html><head><script>var x = "<p>";</script>' || CASE p_partkey % 8
             WHEN 0 THEN '<script type="application/ld+json">{{{{"@graph":[{{{{"@type":"Product","name":"A &amp; B","brand":{{{{"name":"' || p_brand || '"}}}},"mpn":"' || {_CODE} || '","offers":{{{{"price":"950.00"}}}}}}}}]}}}}</script><title>Shop page</title><link rel="canonical" href="https://www.shop.example.com/p/' || cast(p_partkey AS string) || '">'
             WHEN 1 THEN '<title>' || p_brand || ' ' || p_name || ' deluxe  edition ' || {_CODE} || '</title>'
             WHEN 2 THEN '<title>Offer</title><meta name="description" content="Part ' || {_CODE} || ' by maker">'
             WHEN 5 THEN '<title>' || p_name || ' deluxe edition</title>'
             WHEN 6 THEN '<title>Just a moment</title>'
             WHEN 7 THEN '<title>' || p_brand || ' ' || {_CODE} || ' + ZX99881Y set</title>'
             ELSE '<title>Offer</title>' END || '</head><body><!-- note --><h1>Page</h1>' || CASE p_partkey % 8
             WHEN 3 THEN '<p>' || p_brand || ' code ' || {_CODE} || ' costs <b>1.234,50 €</b></p>'
             WHEN 4 THEN '<p>by ' || p_brand || '</p>' ELSE '' END || '</body></html>' AS html
    FROM {{part}}"""
VIEWS["search_hits_v"] = """
    SELECT product_id, query_no, seller_id,
           row_number() OVER (PARTITION BY product_id, query_no ORDER BY offer_key) AS rank,
           CASE seller_id % 6
             WHEN 0 THEN 'https://market-a.example.com/s/' || cast(seller_id AS string) || '/x?utm_source=1'
             WHEN 1 THEN 'https://market-a.example.com/s/' || cast(seller_id AS string) || '/reviews'
             WHEN 2 THEN 'https://Shop.example.com/p/' || cast(product_id AS string) || '#a'
             WHEN 3 THEN 'https://other.example.com/p/1' WHEN 4 THEN 'not a url'
             ELSE 'https://www.shop.example.com/promo/p/' || cast(product_id AS string) END AS url,
           CASE seller_id % 4 WHEN 0 THEN name WHEN 1 THEN 'WMB' || cast(1000 + product_id AS string) || ' washer'
             WHEN 2 THEN 'washer ' || cast(10 + product_id % 80 AS string) || ' kg' ELSE 'steel drum' END AS title,
           CASE WHEN seller_id % 5 = 0 THEN 'Washer by ' || brand || ' MPN-' || cast(product_id AS string) ELSE 'big sale' END AS description
    FROM (SELECT o.product_id, o.seller_id, o.offer_key, o.attempt AS query_no, p.name, p.brand
          FROM {offers_v} o JOIN {resolver_products_v} p ON p.product_id = o.product_id)"""
VIEWS["resolver_products_v"] = """
    SELECT p_partkey AS product_id, lpad(cast(p_partkey AS string), 6, '0') AS model,
           CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'MPN-' || cast(p_partkey AS string) END AS mpn,
           CASE WHEN p_partkey % 6 = 0 THEN '52' || lpad(cast(p_partkey AS string), 8, '0') ELSE '' END AS barcode,
           p_brand AS brand, p_type AS category,
           'WMB' || cast(1000 + p_partkey AS string) || '-X' || cast(10 + p_partkey % 80 AS string) || ' ' || p_name AS name
    FROM {part}"""
VIEWS["cand_flags_v"] = """
    SELECT *, provider || ' ' || model AS query, seller_no % 3 = 0 AS mpn_found, seller_no % 4 = 0 AS model_found,
           CASE WHEN seller_no % 6 = 0 THEN 'body' ELSE 'title' END AS mpn_source,
           CASE WHEN seller_no % 8 = 0 THEN 'body' ELSE 'title' END AS model_source,
           CASE WHEN seller_no % 11 = 0 THEN 'blocked_or_captcha' ELSE '' END AS error_code,
           seller_no % 5 <> 0 AS category_compatible, seller_no % 7 = 3 AS title_only,
           CASE WHEN source_name = 'shop' THEN 'shop' ELSE 'marketplace' END AS source_type
    FROM (SELECT *, cast(round(confidence * 100) AS bigint) AS seller_no FROM {candidates_v})"""
VIEWS["batch_rows_v"] = """
    SELECT o_orderkey AS row_id, o_custkey AS batch_id,
           CASE o_orderkey % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'manually_selected' WHEN 2 THEN 'needs_review'
             WHEN 3 THEN 'no_usable_source' WHEN 4 THEN 'skipped'
             WHEN 5 THEN CASE WHEN o_custkey % 7 = 0 THEN 'resolution_failed' ELSE 'auto_selected' END
             WHEN 6 THEN CASE WHEN o_custkey % 11 = 0 THEN 'resolving_source' ELSE 'auto_selected' END
             ELSE 'auto_selected' END AS status,
           CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'https://shop.example.com/p/' || cast(o_orderkey AS string) END AS selected_url,
           cast(floor(o_totalprice) AS bigint) % 101 AS confidence
    FROM {orders}"""
VIEWS["responses_v"] = """
    SELECT page_id AS response_id, page_id % 6 AS capture_id,
           url || CASE page_id % 7 WHEN 0 THEN '/filter_products.json' WHEN 1 THEN '/analytics.js' WHEN 2 THEN '/shops_details'
             WHEN 3 THEN '/service_filtered_offerings' WHEN 4 THEN '/placements/offers' ELSE '' END AS url,
           CASE page_id % 5 WHEN 0 THEN '{{"final_price": 12, "shop": "x", "stock": 1, "delivery": "2d"}}'
             WHEN 1 THEN '{{"a": {{"starRatings": [1, 2]}}}}' WHEN 2 THEN '{{"product_cards": []}}' ELSE html END AS body,
           CASE WHEN page_id % 4 = 0 THEN 'application/JSON' ELSE 'text/html' END AS content_type,
           CASE WHEN page_id % 9 = 0 THEN 403 WHEN page_id % 9 = 1 THEN NULL ELSE 200 END AS status,
           page_id % 3 = 0 AS after_trigger
    FROM {pages}"""
VIEWS["market_pages_v"] = """
    SELECT p_partkey AS product_id,
           '<div class="x prices__group big" data-id="7" data-price="' || cast(cast(round(p_retailprice * 100) AS bigint) AS string) || '"><span class="merchant">Shop ' || p_brand || '</span><a href="/to/' || cast(p_partkey AS string) || '">go</a>'
           || '<div class="prices__product" data-shipping-cost="' || cast(p_size % 4 * 100 AS string) || '"' || CASE WHEN p_size % 3 = 0 THEN ' data-in-stock' ELSE '' END || '>a</div>'
           || '<div class="prices__product" data-price="12,5" data-total-price="1500"><i data-status="soon">b</i></div></div>'
           || '<div class="prices__group" data-price="' || CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE '4999' END || '"><span class="merchant">Other</span></div>' AS html
    FROM {part}"""
VIEWS["market_texts_v"] = """
    SELECT p_partkey AS product_id,
           'Offers' || chr(10) || '| Shop | Price | Shipping | Total |' || chr(10) || '|---|---|---|---|' || chr(10)
           || '| [S' || cast(p_size AS string) || '](https://s.example.com/' || cast(p_partkey AS string) || ') | ' || cast(p_size AS string) || ',50 € | 2,00 € | ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '99,90 €' END || ' |' || chr(10)
           || 'text' || chr(10) || '| a | 5 |' || chr(10)
           || '1. Corner ' || p_name || ' ' || cast(p_size AS string) || '.25 € shipping 3,10' || chr(10) || 'no price here' AS body
    FROM {part}"""
VIEWS["search_payloads_v"] = """
    SELECT p_partkey AS product_id,
           '{{"web":{{"results":[{{"url":" ","title":"none"}},{{"url":"https://a.example.com/' || cast(p_partkey AS string) || '","title":"<b>' || p_name || '</b> &amp; more","description":"d","extra_snippets":["s1","s2"]}},'
           || '{{"url":"https://b.example.com/","title":"T","snippet":"' || p_type || '"}}]}}}}' AS payload
    FROM {part}"""


def _sources(v):
    """Source rules are configuration: a handful of literal rows."""
    return v.spark.createDataFrame(
        [
            ("market_a", 90, ["market-a.example.com"], "/s/[0-9]+", "/s/[0-9]+/reviews", 2),
            ("shop", 60, ["www.shop.example.com"], "/p/", "", 1),
        ],
        "source_name string, weight int, domains array<string>, allow string, block string, max_candidates int",
    )


# -------------------------------------------------------------------- evidence
def clean_sql(x: str) -> str:
    """DuckDB text: entities decoded, blanks collapsed."""
    for mark, plain in HTML_ENTITIES.items():
        plain = "''" if plain == "'" else plain
        x = f"replace({x}, '{mark}', '{plain}')"
    return f"trim(regexp_replace({x}, '[\\s\u00a0]+', ' ', 'g'))"


_VISIBLE = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), "
    "'(?s)<!--.*?-->|<![^>]*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
)


@query(
    "FN48_page_parts",
    f"""SELECT page_id, {clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
               '' AS description, '' AS canonical, length({clean_sql(_VISIBLE)}) AS text_length FROM pages""",
)
def _(v):
    html = F.col("html")
    return v.pages.select(
        "page_id", H.page_title(html).alias("title"), H.meta_description(html).alias("description"),
        H.canonical_link(html).alias("canonical"),
        F.length(H.visible_text(html)).cast("bigint").alias("text_length"),
    )


_EVIDENCE = """SELECT product_id, variant NOT IN (5, 6) AS mpn_found,
      CASE variant WHEN 0 THEN 'jsonld' WHEN 1 THEN 'title' WHEN 2 THEN 'meta' WHEN 3 THEN 'body' WHEN 4 THEN 'url' WHEN 7 THEN 'title' ELSE '' END AS mpn_source,
      variant IN (0, 1, 3, 4, 7) AS brand_found, CASE variant WHEN 0 THEN 950.0 WHEN 3 THEN 1234.5 END::double AS candidate_price,
      CASE variant WHEN 0 THEN abs(950 - own_price) <= own_price * 0.4 WHEN 3 THEN abs(1234.5 - own_price) <= own_price * 0.4 END AS price_compatible,
      variant = 6 AS blocked, variant = 5 AS title_only, false AS model_found, false AS category_compatible FROM shop_pages_v"""


@query("D9_page_evidence", _EVIDENCE)
def _(v):
    return K.page_evidence(v.shop_pages_v).select(
        "product_id", "mpn_found", "mpn_source", "brand_found", "candidate_price", "price_compatible", "blocked",
        "title_only", "model_found", "category_compatible",
    )


@query(
    "D10_search_evidence",
    """SELECT product_id, variant IN (1, 3, 4, 7) AS mpn_found,
          CASE variant WHEN 1 THEN 'title' WHEN 3 THEN 'body' WHEN 4 THEN 'url' WHEN 7 THEN 'title' ELSE '' END AS mpn_source,
          variant IN (1, 7) AS brand_found, 'provider_search_result' AS evidence_source FROM shop_pages_v""",
)
def _(v):
    hits = v.shop_pages_v.select(
        "product_id", "mpn", "model", "manufacturer", "name", "category", "own_price", F.col("requested_url").alias("url"),
        F.when(F.col("variant").isin(1, 7), F.concat_ws(" ", "manufacturer", "mpn")).otherwise("Offer").alias("title"),
        F.when(F.col("variant") == 3, F.concat(F.lit("code "), "mpn")).otherwise("").alias("description"),
        F.array().cast("array<string>").alias("extra_snippets"),
    )
    return K.search_result_evidence(hits).select(
        "product_id", "mpn_found", "mpn_source", "brand_found", "evidence_source"
    )


@query(
    "D11_composite_mismatch",
    """SELECT product_id, variant = 7 AS is_mismatch, CASE WHEN variant = 7 THEN 'candidate_contains_expected_identifier_with_extra_identifier' ELSE '' END AS reason,
          CASE WHEN variant = 7 THEN 'expected_identifier_joined_with_extra_identifier|set' ELSE '' END AS markers,
          CASE WHEN variant = 7 THEN 'ZX99881Y' ELSE '' END AS extra_identifiers FROM shop_pages_v""",
)
def _(v):
    title, body = H.page_title(F.col("html")), H.visible_text(F.col("html"))
    found = K.composite_mismatch(F.col("mpn"), F.col("name"), F.lit(False), F.array(title, "requested_url", body))
    return v.shop_pages_v.withColumn("c", found).select(
        "product_id", "c.is_mismatch", "c.reason", "c.markers", "c.extra_identifiers"
    )


_SCORES = """b AS (SELECT *, source_type = 'marketplace' AS m,
        CASE variant WHEN 6 THEN CASE WHEN valid_url THEN 'blocked_product_url' ELSE 'blocked_or_captcha' END
             WHEN 7 THEN 'composite_product_mismatch' WHEN 2 THEN 'manual_review_required' WHEN 5 THEN 'manual_review_required' ELSE 'exact_mpn_and_brand' END AS match_method
      FROM shop_pages_v),
     s AS (SELECT *, CASE variant WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN CASE WHEN m THEN 0.62 ELSE 1.0 END
             WHEN 4 THEN CASE WHEN m THEN 0.8 ELSE 1.0 END WHEN 5 THEN 0.5 WHEN 6 THEN CASE WHEN valid_url THEN 0.8 ELSE 0.0 END ELSE 0.0 END::double AS confidence FROM b),
     c AS (SELECT *, count(*) FILTER (confidence >= 0.5) OVER (PARTITION BY group_id) AS competing_candidates FROM s)"""


@query(
    "D12_match_score",
    "WITH " + _SCORES + """SELECT product_id, confidence, match_method, competing_candidates,
        CASE WHEN match_method = 'blocked_or_captcha' THEN 'error' WHEN variant = 7 THEN 'not_found'
             WHEN match_method = 'exact_mpn_and_brand' AND confidence > 0.9 AND competing_candidates <= 1 THEN 'matched' ELSE 'needs_review' END AS match_status FROM c""",
)
def _(v):
    return K.score_candidates(K.page_evidence(v.shop_pages_v), ["group_id"]).select(
        "product_id", "confidence", "match_method", "competing_candidates", "match_status"
    )


@query(
    "W14_competing_candidates",
    "WITH " + _SCORES + "SELECT DISTINCT group_id, competing_candidates FROM c",
)
def _(v):
    return K.score_candidates(K.page_evidence(v.shop_pages_v), ["group_id"]).select(
        "group_id", "competing_candidates"
    ).distinct()


@query("FN34_name_similarity")
def _(v):
    pages = v.shop_pages_v.withColumn("title", H.page_title(F.col("html")))
    return K.name_similarity(pages, "name", "title").select("product_id", "title_similarity", "title_similarity_tokens")


@query(
    "FN30_product_codes",
    """SELECT product_id, CASE variant WHEN 1 THEN mpn WHEN 7 THEN mpn || '|ZX99881Y' ELSE '' END AS codes FROM shop_pages_v""",
)
def _(v):
    return v.shop_pages_v.select("product_id", K.product_codes(H.page_title(F.col("html"))).alias("codes"))


@query(
    "FN31_identifier_variants",
    """SELECT product_id, 'A' || product_id || '/B' || product_id || '-EU|A' || product_id || '-EU/B' || product_id || '-EU' AS variants FROM catalog_v""",
)
def _(v):
    code = F.concat(F.lit("A"), "product_id", F.lit("/B"), "product_id", F.lit("-EU"))
    return v.catalog_v.select("product_id", K.identifier_variants(code, F.lit(True)).alias("variants"))


@query(
    "FN32_identifier_search",
    """SELECT page_id, regexp_matches(html, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') AS found FROM pages""",
)
def _(v):
    return v.pages.select("page_id", (K.identifier_fragment(F.lit("the"), F.col("html")) != "").alias("found"))


# ---------------------------------------------------------------------- results
_STATE = f"""n AS (SELECT *, CASE WHEN seller_id % 6 <> 4 THEN {norm_sql('url')} END AS normalized FROM search_hits_v),
     k AS (SELECT *, CASE seller_id % 6 WHEN 0 THEN 'market_a' WHEN 1 THEN 'market_a' WHEN 2 THEN 'shop' WHEN 5 THEN 'shop' END AS source_name,
             CASE WHEN seller_id % 6 IN (0, 2) THEN normalized END AS product_url FROM n),
     g AS (SELECT product_id, query_no, source_name, product_url, coalesce(product_url, normalized, url) AS page,
             CASE WHEN normalized IS NULL THEN 'invalid_url' WHEN source_name IS NULL THEN 'unknown_host' WHEN product_url IS NULL THEN 'no_product_url' ELSE 'kept' END AS st,
             min(rank) AS rank, count(*) AS copies FROM k GROUP BY ALL),
     c AS (SELECT *, row_number() OVER (PARTITION BY product_id, query_no, source_name, st ORDER BY rank, page) AS q FROM g),
     s AS (SELECT * EXCLUDE (st, q), CASE WHEN st = 'kept' AND q > CASE source_name WHEN 'market_a' THEN 2 ELSE 1 END THEN 'over_source_limit' ELSE st END AS state FROM c)"""


def _hits(v):
    return v.search_hits_v.withColumn("extra_snippets", F.array().cast("array<string>"))


def _filtered(v):
    return K.filter_search_results(v.search_hits_v.select("product_id", "query_no", "rank", "url"), _sources(v))


@query("D40_search_result_filter", "WITH " + _STATE + "SELECT product_id, query_no::bigint AS query_no, rank, page, copies, state FROM s")
def _(v):
    return _filtered(v).select("product_id", "query_no", "rank", "page", "copies", "state")


@query(
    "D40_first_per_source",
    "WITH " + _STATE + """SELECT product_id, source_name, arg_min(product_url, (query_no, rank)) AS product_url FROM s WHERE state = 'kept' GROUP BY 1, 2""",
)
def _(v):
    return K.first_per_source(_filtered(v)).select("product_id", "source_name", "product_url")


@query(
    "F9_product_url_shape",
    """SELECT product_id, query_no::bigint AS query_no, rank, seller_id % 6 IN (0, 2) AS is_product FROM search_hits_v WHERE seller_id % 6 NOT IN (3, 4)""",
)
def _(v):
    known = K.classify_hosts(v.search_hits_v, _sources(v)).where("source_name IS NOT NULL")
    return known.select(
        "product_id", "query_no", "rank",
        U.is_product_url(F.col("url"), F.col("source_domain"), F.col("allow"), F.col("block")).alias("is_product"),
    )


@query(
    "IO19_search_results",
    """SELECT p_partkey AS product_id, 1::bigint AS rank, 'https://a.example.com/' || p_partkey AS url, p_name || ' & more' AS title, 'd' AS description, 's1|s2' AS extra_snippets FROM part
       UNION ALL SELECT p_partkey, 2, 'https://b.example.com/', 'T', p_type, '' FROM part""",
)
def _(v):
    return K.search_results(v.search_payloads_v)


_RESOLVE = """r AS (SELECT h.*, CASE WHEN seller_id % 6 IN (0, 1) THEN 90 ELSE 60 END AS weight,
          CASE WHEN seller_id % 6 IN (0, 1) THEN 'market_a' ELSE 'shop' END AS source_name,
          CASE seller_id % 6 WHEN 0 THEN 'https://market-a.example.com/s/' || seller_id || '/x' WHEN 1 THEN 'https://market-a.example.com/s/' || seller_id || '/reviews'
            WHEN 2 THEN 'https://shop.example.com/p/' || product_id ELSE 'https://www.shop.example.com/promo/p/' || product_id END AS product_url
        FROM search_hits_v h WHERE seller_id % 6 NOT IN (3, 4)),
     o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY product_id, product_url ORDER BY query_no, rank) = 1),
     y AS (SELECT o.*, p.name, p.mpn, p.barcode, p.model, p.brand, product_url || ' ' || title || ' ' || description || ' ' AS hay FROM o JOIN resolver_products_v p USING (product_id)),
     z AS (SELECT *, regexp_replace(lower(hay), '[^0-9a-z]+', '', 'g') AS ah, list_distinct(list_filter(regexp_extract_all(lower(hay), '\\w+'), lambda w: len(w) >= 3)) AS h3,
             list_distinct(list_filter(regexp_extract_all(lower(hay), '\\w+'), lambda w: len(w) >= 2)) AS h2,
             list_distinct(list_filter(regexp_extract_all(lower(name), '\\w+'), lambda w: len(w) >= 3)) AS n3,
             list_distinct(list_filter(regexp_extract_all(lower(title), '\\w+'), lambda w: len(w) >= 3)) AS t3,
             list_distinct(list_filter(regexp_extract_all(lower(description), '\\w+'), lambda w: len(w) >= 3)) AS d3,
             'wmb' || (1000 + product_id) AS c1, cast(10 + product_id % 80 AS varchar) AS c2 FROM y),
     i AS (SELECT *, CASE WHEN contains(ah, c1 || 'x' || c2) THEN 24.0 ELSE least(CASE WHEN contains(ah, c1) THEN 10.0 ELSE 0.0 END + CASE WHEN list_contains(h2, c2) THEN 4.0 ELSE 0.0 END
               + CASE WHEN contains(ah, c1) AND list_contains(h2, c2) THEN 4.0 ELSE 0.0 END, 22.0) END::double AS points,
             CASE WHEN (mpn <> '' AND contains(ah, regexp_replace(lower(mpn), '[^0-9a-z]+', '', 'g'))) OR (barcode <> '' AND contains(ah, barcode)) THEN 20.0 ELSE 0.0 END::double AS ip,
             CASE WHEN contains(ah, model) THEN 5.0 ELSE 0.0 END::double AS mp, CASE WHEN contains(ah, regexp_replace(lower(brand), '[^0-9a-z]+', '', 'g')) THEN 8.0 ELSE 0.0 END::double AS bp FROM z),
     sc AS (SELECT *, least(100, cast(round_even(least(40.0::double, weight * 0.4::double) + least(ip + mp + points, 35.0::double) + bp
               + len(list_intersect(n3, h3))::double / len(n3) * 12.0::double + 8.0::double
               + (len(list_intersect(n3, t3))::double / len(n3) * 4.0::double + len(list_intersect(n3, d3))::double / len(n3) * 3.0::double)
               + greatest(0.0::double, 6.0::double - least(rank, 6)), 0) AS bigint)) AS confidence FROM i),
     g AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, rank, product_url) AS suggestion_rank FROM sc WHERE confidence >= 55)"""


@query(
    "D13_resolver_score",
    "WITH " + _RESOLVE + "SELECT product_id, product_url, confidence FROM sc",
)
def _(v):
    known = K.classify_hosts(_hits(v), _sources(v)).where("source_name IS NOT NULL").withColumn(
        "product_url", U.without_query(F.col("url"))
    )
    once = K.first_row(known, ["product_id", "product_url"], [F.col("query_no"), F.col("rank")])
    return K.resolver_score(once.join(v.resolver_products_v, "product_id")).select(
        "product_id", "product_url", "confidence"
    )


def _resolved(v):
    return K.resolve_sources(v.resolver_products_v, _hits(v), _sources(v), minimum=90, suggestion=55)


@query(
    "W8_top_suggestions",
    "WITH " + _RESOLVE + "SELECT product_id, suggestion_rank, product_url, confidence FROM g WHERE suggestion_rank <= 5",
)
def _(v):
    ranked, _state = _resolved(v)
    return ranked.select("product_id", "suggestion_rank", "product_url", "confidence")


@query(
    "D14_batch_resolution",
    "WITH " + _RESOLVE + """SELECT p.product_id, CASE WHEN confidence >= 90 THEN 'auto_selected' WHEN confidence IS NOT NULL THEN 'needs_review' ELSE 'no_usable_source' END AS status,
        CASE WHEN confidence >= 90 THEN product_url END AS selected_url, CASE WHEN confidence >= 90 THEN source_name END AS selected_source,
        CASE WHEN confidence >= 90 THEN confidence END AS confidence
        FROM resolver_products_v p LEFT JOIN g ON g.product_id = p.product_id AND suggestion_rank = 1""",
)
def _(v):
    return _resolved(v)[1]


@query(
    "FN36_name_overlap",
    "WITH " + _RESOLVE + "SELECT product_id, product_url, len(list_intersect(n3, h3))::double / len(n3) AS overlap, points FROM i",
)
def _(v):
    known = K.classify_hosts(_hits(v), _sources(v)).where("source_name IS NOT NULL").withColumn(
        "product_url", U.without_query(F.col("url"))
    )
    once = K.first_row(known, ["product_id", "product_url"], [F.col("query_no"), F.col("rank")])
    hay = F.concat_ws(" ", "product_url", "title", "description", F.lit(""))
    return once.join(v.resolver_products_v, "product_id").select(
        "product_id", "product_url", K.name_overlap(F.col("name"), hay).alias("overlap"),
        K.name_identifier_points(F.col("name"), hay).alias("points"),
    )


@query(
    "FN6_product_queries",
    """WITH q AS (SELECT product_id, list_distinct([]) AS x, CASE WHEN mpn <> '' THEN ['"' || mpn || '" ' || brand || ' ' || name] ELSE [] END
          || CASE WHEN barcode <> '' THEN ['"' || barcode || '" ' || brand || ' ' || name] ELSE [] END || [brand || ' ' || name || ' ' || category, name] AS qs FROM resolver_products_v)
       SELECT product_id, i - 1 AS query_no, qs[i] AS query FROM (SELECT product_id, qs, unnest(generate_series(1, len(qs))) AS i FROM q)""",
)
def _(v):
    return K.product_queries(v.resolver_products_v)


@query(
    "FN6_scoped_queries",
    """SELECT product_id, 0::bigint AS query_no, brand || ' ' || name || ' site:market-a.example.com' AS query FROM resolver_products_v
       UNION ALL SELECT product_id, 1, brand || ' ' || name || ' site:shop.example.com' FROM resolver_products_v""",
)
def _(v):
    return K.scoped_queries(v.resolver_products_v, ["market-a.example.com", "shop.example.com"])


@query(
    "FN7_template_queries",
    """WITH q AS (SELECT product_id, list_filter([CASE WHEN mpn <> '' THEN brand || ' ' || mpn END, CASE WHEN barcode <> '' THEN barcode END, name || ' buy'], lambda x: x IS NOT NULL)[1:2] AS qs FROM resolver_products_v)
       SELECT product_id, i - 1 AS query_no, qs[i] AS query FROM (SELECT product_id, qs, unnest(generate_series(1, len(qs))) AS i FROM q)""",
)
def _(v):
    return K.template_queries(v.resolver_products_v, ["{brand} {mpn}", "{barcode}", "{name} buy", "plain"], 2)


# -------------------------------------------------------------------- responses
_POINTS = """p AS (SELECT *, lower(url) AS u, json_valid(body) AS j FROM responses_v),
     r AS (SELECT response_id, capture_id, unnest([
       CASE WHEN j OR contains(lower(content_type), 'json') THEN {'p': 3, 'n': 'json'} END,
       CASE WHEN regexp_matches(body, '(?i)(price|amount|final_price|current_price|τιμ|€|eur)') THEN {'p': 3, 'n': 'price fields'} END,
       CASE WHEN regexp_matches(body, '(?i)(seller|shop|store|merchant|καταστημα|κατάστημα|πωλητ)') THEN {'p': 3, 'n': 'seller/shop fields'} END,
       CASE WHEN regexp_matches(body, '(?i)(availability|available|stock|διαθεσιμ|απόθεμα|αποθεμα)') THEN {'p': 2, 'n': 'availability fields'} END,
       CASE WHEN regexp_matches(body, '(?i)(shipping|delivery|courier|pickup|παραδοση|παράδοση|μεταφορ)') THEN {'p': 2, 'n': 'shipping fields'} END,
       CASE WHEN after_trigger THEN {'p': 2, 'n': 'after trigger'} END,
       CASE WHEN regexp_matches(u, '(product|offer|shop|seller|sku)') THEN {'p': 1, 'n': 'product/offers endpoint'} END,
       CASE WHEN contains(u, 'service_filtered_offerings') THEN {'p': 4, 'n': 'offerings endpoint'} END,
       CASE WHEN contains(u, 'filter_products') THEN {'p': 4, 'n': 'filter products endpoint'} END,
       CASE WHEN status >= 400 THEN {'p': -2, 'n': 'error status'} END,
       CASE WHEN regexp_matches(body, '(?i)(just a moment|cloudflare|cf-chl|challenge-platform)') THEN {'p': -4, 'n': 'blocked/challenge payload'} END,
       CASE WHEN length(body) < 80 THEN {'p': -3, 'n': 'tiny payload'} END,
       CASE WHEN regexp_matches(u, '(analytics|gtm|collect|hotjar|facebook|doubleclick|beacon|zendesk|zdassets|sentry|maps[.]googleapis[.]com)') THEN {'p': -5, 'n': 'analytics endpoint'} END,
       CASE WHEN regexp_matches(u, '(placements|cross_sell|sponsored)') THEN {'p': -4, 'n': 'promotion endpoint'} END,
       CASE WHEN regexp_matches(u, '[.](css|js|png|jpg|jpeg|gif|svg|webp|woff|woff2|ico)$') THEN {'p': -5, 'n': 'static asset'} END]) AS x FROM p),
     sc AS (SELECT p.response_id, p.capture_id, coalesce(sum(x.p), 0)::bigint AS score FROM p LEFT JOIN r ON r.response_id = p.response_id AND x IS NOT NULL GROUP BY 1, 2)"""


@query("D15_response_score", "WITH " + _POINTS + "SELECT response_id, score FROM sc")
def _(v):
    return K.score_responses(v.responses_v).select("response_id", "score")


@query(
    "W16_response_rank",
    "WITH " + _POINTS + "SELECT capture_id, response_id, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, response_id) AS rank FROM sc",
)
def _(v):
    return K.rank_responses(K.score_responses(v.responses_v), ["capture_id"], "response_id").select(
        "capture_id", "response_id", "rank"
    )


@query(
    "D16_endpoint_class",
    """WITH p AS (SELECT *, lower(url) AS u, lower(body) AS b, json_valid(body) AS j FROM responses_v)
       SELECT response_id, CASE WHEN regexp_matches(b, 'captcha|cloudflare|cf-chl|just a moment|challenge|blocked|access denied|are you human') OR regexp_matches(u, 'captcha|cloudflare|challenge|blocked') THEN 'BLOCKED_OR_CHALLENGE'
          WHEN contains(u, 'filter_products') THEN 'PRIMARY_CANDIDATE_PRODUCT_OFFERS' WHEN contains(u, 'shops_details') THEN 'SECONDARY_CANDIDATE_SHOP_DETAILS'
          WHEN response_id % 5 = 2 THEN 'PRIMARY_CANDIDATE_PRODUCT_OFFERS' WHEN NOT j THEN 'NON_JSON_XHR'
          WHEN response_id % 5 = 0 THEN 'POSSIBLE_PRODUCT_OR_OFFER_DATA' WHEN response_id % 5 = 1 THEN 'POSSIBLE_REVIEWS_OR_RATING_DATA' ELSE 'OTHER_JSON' END AS endpoint_class FROM p""",
)
def _(v):
    return v.responses_v.select("response_id", K.endpoint_class(F.col("url"), F.col("body")).alias("endpoint_class"))


@query(
    "D18_html_offers",
    """SELECT p_partkey AS product_id, 7::bigint AS offer_rank, 1::bigint AS product_index, 'Shop ' || p_brand AS seller_name, p_retailprice AS price,
              (p_size % 4)::double AS shipping, round(p_retailprice + p_size % 4, 2) AS landed_price, 'computed' AS landed_source,
              CASE WHEN p_size % 3 = 0 THEN 'in_stock' END AS availability FROM part
       UNION ALL SELECT p_partkey, 7, 2, 'Shop ' || p_brand, 12.5, NULL, 15.0, 'explicit', 'soon' FROM part
       UNION ALL SELECT p_partkey, 2, 0, 'Other', 49.99, NULL, NULL, 'missing', NULL FROM part WHERE p_partkey % 4 <> 0""",
)
def _(v):
    return K.html_offers(v.market_pages_v).select(
        "product_id", "offer_rank", "product_index", "seller_name", "price", "shipping", "landed_price", "landed_source",
        "availability",
    )


@query(
    "D19_table_offers",
    """SELECT p_partkey AS product_id, 3::bigint AS line_no, 'S' || p_size AS seller_name, 'https://s.example.com/' || p_partkey AS seller_url, (p_size + 0.5)::double AS price, 2.0::double AS shipping,
              CASE WHEN p_size % 2 = 0 THEN p_size + 2.5 ELSE 99.9 END::double AS landed_price, CASE WHEN p_size % 2 = 0 THEN 'computed' ELSE 'explicit' END AS landed_source FROM part""",
)
def _(v):
    return K.table_offers(v.market_texts_v, "body", "product_id")


@query(
    "D19_line_offers",
    """SELECT p_partkey AS product_id, 6::bigint AS line_no, 'Corner ' || p_name AS seller_name, (p_size + 0.25)::double AS price, 3.1::double AS shipping,
              round(p_size + 3.35, 2)::double AS landed_price, 'computed' AS landed_source FROM part""",
)
def _(v):
    return K.line_offers(v.market_texts_v, "body", "product_id")


# ------------------------------------------------------------ candidates and runs
@query(
    "F6_candidate_filter",
    """SELECT candidate_id FROM candidates_v WHERE status = 'needs_review' AND contains(lower(source_name), 'arket') AND contains(lower(model), '00')
       AND confidence >= 0.3 AND confidence <= 0.75""",
)
def _(v):
    wanted = K.candidate_predicates("needs_review", " ARKET ", None, "00", None, 0.3, 0.75)
    out = v.candidates_v
    for p in wanted:
        out = out.where(p)
    return out.select("candidate_id")


@query(
    "F7_created_range",
    "SELECT candidate_id FROM candidates_v WHERE created_at >= DATE '1997-02-03' AND created_at < DATE '1999-11-05'",
)
def _(v):
    return K.created_between(v.candidates_v, "1997-02-03", "1999-11-04").select("candidate_id")


@query(
    "F8_keep_candidate",
    """SELECT candidate_id FROM candidates_v WHERE match_status = 'error' OR (match_status = 'not_found' AND candidate_url = '') OR confidence >= 0.8""",
)
def _(v):
    return K.keep_candidates(v.candidates_v).select("candidate_id")


@query(
    "S7_candidate_page",
    "SELECT candidate_id, strftime(created_at, '%Y-%m-%d') AS day FROM candidates_v ORDER BY created_at DESC, candidate_id DESC LIMIT 50 OFFSET 100",
)
def _(v):
    return K.candidate_page(v.candidates_v, 50, 100).select(
        "candidate_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")
    )


@query(
    "S7_candidates_deep",
    "SELECT candidate_id, strftime(created_at, '%Y-%m-%d') AS day FROM candidates_v ORDER BY created_at DESC, candidate_id DESC LIMIT 50 OFFSET 15000",
)
def _(v):
    """Candidates from place 15,000 on, newest first; only the ranges that hold them are read."""
    listed = PG.PagedResult(v.candidates_v.select("candidate_id", "created_at"), [F.desc("created_at"), F.desc("candidate_id")])
    return listed.slice(15_000, 50).select("candidate_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    "A16_run_summary",
    "SELECT source_name, count(*) AS candidates, " + ", ".join(
        f"count(*) FILTER (match_status = '{s}') AS {s}" for s in ("matched", "needs_review", "not_found", "error", "skipped")
    ) + " FROM candidates_v GROUP BY ROLLUP (source_name)",
)
def _(v):
    return K.run_summary(v.candidates_v)


@query(
    "A17_provider_summary",
    """WITH f AS (SELECT provider, arg_min(query, candidate_id) AS query, count(*) FILTER (candidate_url <> '') AS kept FROM cand_flags_v GROUP BY 1),
       s AS (SELECT provider, source_name, count(*) AS n FROM cand_flags_v WHERE candidate_url <> '' GROUP BY 1, 2)
       SELECT provider, query, kept, CASE WHEN kept > 0 THEN 'found_candidates' ELSE 'no_results' END AS status, source_name, n FROM f LEFT JOIN s USING (provider)""",
)
def _(v):
    return K.provider_summary(v.cand_flags_v)


_KINDS = """k AS (SELECT source_name, unnest(list_filter([
      CASE WHEN match_status IN ('needs_review', 'not_found') AND NOT mpn_found AND NOT model_found THEN 'missing_identifier_evidence' END,
      CASE WHEN error_code = 'blocked_or_captcha' THEN 'blocked_or_captcha' END, CASE WHEN NOT category_compatible AND confidence >= 0.5 THEN 'category_mismatch' END,
      CASE WHEN title_only THEN 'title_only_review' END,
      CASE WHEN source_type = 'marketplace' AND ((mpn_found AND mpn_source = 'body') OR (model_found AND model_source = 'body')) THEN 'body_only_marketplace_identifier' END], lambda x: x IS NOT NULL)) AS kind FROM cand_flags_v)"""


@query(
    "A18_rule_suggestions",
    "WITH " + _KINDS + "SELECT CASE WHEN kind <> 'missing_identifier_evidence' THEN source_name END AS source_name, kind, count(*) AS count FROM k GROUP BY 1, 2",
)
def _(v):
    return K.rule_suggestions(v.cand_flags_v)


@query(
    "A19_run_analysis",
    """SELECT 'by_status' AS kind, NULL::varchar AS source_name, match_status AS value, count(*) AS count FROM candidates_v GROUP BY 3
       UNION ALL SELECT 'by_source', source_name, match_status, count(*) FROM candidates_v GROUP BY 2, 3
       UNION ALL SELECT 'errors', source_name, match_method, count(*) FROM candidates_v WHERE match_status = 'error' GROUP BY 2, 3""",
)
def _(v):
    return K.run_analysis(v.candidates_v)


@query(
    "A19_recommendations",
    """SELECT 'title_only_review' AS type, NULL::varchar AS source_name, count(*) AS count FROM cand_flags_v WHERE title_only
       UNION ALL SELECT 'missing_identifiers', NULL, count(*) FROM cand_flags_v WHERE match_status IN ('needs_review', 'not_found') AND NOT mpn_found AND NOT model_found
       UNION ALL SELECT 'not_found', NULL, count(*) FROM cand_flags_v WHERE match_status = 'not_found'
       UNION ALL SELECT 'blocked_or_captcha', source_name, count(*) FROM cand_flags_v WHERE match_status = 'error' AND error_code = 'blocked_or_captcha' GROUP BY 2""",
)
def _(v):
    c = v.cand_flags_v
    # The method of a failed candidate is its error code when it has one.
    coded = c.withColumn(
        "match_method", F.when(F.col("error_code") != "", F.col("error_code")).otherwise(F.col("match_method"))
    )
    missing = F.col("match_status").isin("needs_review", "not_found") & ~F.col("mpn_found") & ~F.col("model_found")
    return K.recommendations(K.run_analysis(coded), F.col("title_only"), missing, c)


@query(
    "A20_candidate_history",
    "SELECT product_id, run_id, count(*) AS candidates, " + ", ".join(f"count(*) FILTER (match_status = '{s}') AS {s}" for s in K.STATUS_ORDER)
    + ", strftime(max(created_at), '%Y-%m-%d') AS latest_created_at FROM candidates_v WHERE product_id IS NOT NULL GROUP BY 1, 2",
)
def _(v):
    return K.candidate_history(v.candidates_v.withColumn("status", F.col("match_status"))).withColumn(
        "latest_created_at", F.date_format("latest_created_at", "yyyy-MM-dd")
    )


@query(
    "W13_candidate_order",
    """SELECT c.candidate_id, CASE match_status WHEN 'needs_review' THEN 1 WHEN 'not_found' THEN 4 WHEN 'error' THEN 5 ELSE 6 END::bigint AS status_rank
       FROM candidates_v c""",
)
def _(v):
    runs = v.offers_v.groupBy("run_id").agg(F.min("captured_at").alias("created_at"))
    rows = v.candidates_v.withColumn("status", F.col("match_status"))
    return K.ordered_history(rows, runs).select("candidate_id", "status_rank")


@query(
    "A21_batch_counts",
    "SELECT batch_id, count(*) AS total_rows, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in K.BATCH_STATES)
    + """, CASE WHEN batch_id % 13 = 0 THEN 'failed' WHEN count(*) FILTER (status = 'resolving_source') > 0 OR (batch_id % 5 = 0 AND count(*) FILTER (status = 'pending') > 0) THEN 'resolving'
           WHEN count(*) FILTER (status = 'resolution_failed') > 0 THEN 'partially_resolved' WHEN count(*) FILTER (status = 'pending') > 0 THEN 'uploaded' ELSE 'resolved' END AS batch_status
       FROM batch_rows_v GROUP BY batch_id""",
)
def _(v):
    batches = v.customer.select(
        F.col("c_custkey").alias("batch_id"),
        F.when(F.col("c_custkey") % 13 == 0, "failed").when(F.col("c_custkey") % 5 == 0, "resolving").otherwise("uploaded").alias("status"),
    )
    return K.batch_counts(v.batch_rows_v, batches)


@query(
    "F13_ready_to_enqueue",
    "SELECT row_id FROM batch_rows_v WHERE selected_url <> '' AND (status = 'manually_selected' OR (status = 'auto_selected' AND confidence >= 85))",
)
def _(v):
    return K.ready_to_enqueue(v.batch_rows_v).select("row_id")
