"""Source-URL registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import urls as U
from shelfspark.operators import registry as R
from shelfspark.plans.registry import query
from shelfspark.plans.views import VIEWS


def norm_sql(u: str, strip: bool = False) -> str:
    """DuckDB text of the URL normal form (plain query values only)."""
    path = f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    if strip:
        path = f"regexp_replace({path}, '/+$', '')"
    tracking = "^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|msclkid)(=|$)"
    q = (
        f"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), "
        f"lambda p: p <> '' AND NOT regexp_matches(lower(p), '{tracking}')), '&')"
    )
    return (
        f"(lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || "
        f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)) || {path} || "
        f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END)"
    )


VIEWS["evidence_v"] = """
    SELECT offer_key AS evidence_id, product_id, seller_id,
           CASE WHEN seller_id % 8 = 1 THEN '' WHEN seller_id % 8 = 2 THEN ' '
                WHEN seller_id % 8 = 3 THEN '000001;000002'
                ELSE lpad(cast(product_id AS string), 6, '0') END AS model,
           CASE WHEN seller_id % 16 = 2 THEN '' ELSE 'MPN-' || cast(product_id AS string) END AS mpn,
           CASE WHEN seller_id % 29 = 0 THEN 'ftp://x.example.com/' WHEN seller_id % 31 = 0 THEN 'no url'
                WHEN availability = 'F' THEN 'HTTPS://Shop' || cast(seller_id AS string) || '.Example.com/p/'
                     || cast(product_id AS string) || '?utm_source=feed#top'
                ELSE 'https://shop' || cast(seller_id AS string) || '.example.com/p/' || cast(product_id AS string) END AS url,
           'shop' AS source_name, price, captured_at AS observed_at,
           -(year(captured_at) * 400 + month(captured_at) * 31 + day(captured_at)) AS neg_day,
           CASE WHEN attempt = 1 THEN 'observations' ELSE 'artifacts' END AS feed
    FROM {offers_v}"""
VIEWS["existing_urls_v"] = """
    SELECT l_partkey * 100000 + l_suppkey AS url_id, l_partkey AS product_id,
           'https://shop' || cast(l_suppkey AS string) || '.example.com' || CASE min(l_returnflag) WHEN 'A' THEN '/p/' ELSE '/moved/' END
               || cast(l_partkey AS string) AS url_normalized,
           'https://shop' || cast(l_suppkey AS string) || '.example.com' || CASE min(l_returnflag) WHEN 'A' THEN '/p/' ELSE '/moved/' END
               || cast(l_partkey AS string) AS url,
           'shop' AS source_name, 'shop' || cast(l_suppkey AS string) || '.example.com' AS source_domain,
           CASE (l_partkey + l_suppkey) % 6 WHEN 0 THEN 'broken' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'disabled'
                WHEN 3 THEN 'redirected' ELSE 'active' END AS status,
           CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'imported' ELSE 'discovered' END AS url_type,
           'import' AS provenance, CASE l_suppkey % 4 WHEN 0 THEN 'manual' ELSE 'imported' END AS trust_level,
           min(l_shipdate) AS last_seen_at,
           CASE WHEN l_suppkey % 2 = 0 THEN min(l_shipdate) ELSE NULL END AS last_success_at,
           CASE WHEN l_suppkey % 5 = 0 THEN 'HTTP 500' ELSE NULL END AS last_error,
           CASE WHEN l_suppkey % 7 = 0 THEN 'Imported' ELSE NULL END AS notes,
           l_suppkey % 4 AS failure_count, max(l_shipdate) AS updated_at
    FROM {lineitem} GROUP BY l_partkey, l_suppkey"""
VIEWS["imported_urls_v"] = """
    SELECT l_partkey AS product_id,
           'https://shop' || cast(l_suppkey AS string) || '.example.com/p/' || cast(l_partkey AS string) AS url_normalized,
           'https://shop' || cast(l_suppkey AS string) || '.example.com/p/' || cast(l_partkey AS string) || CASE WHEN l_suppkey % 9 = 0 THEN '#top' ELSE '' END AS url,
           'shop' AS source_name, 'shop' || cast(l_suppkey AS string) || '.example.com' AS source_domain,
           CASE l_suppkey % 3 WHEN 0 THEN 'needs_review' ELSE 'active' END AS status,
           'imported' AS url_type, 'import' AS provenance, 'imported' AS trust_level,
           max(l_shipdate) AS last_seen_at,
           CASE WHEN l_suppkey % 4 <> 3 THEN max(l_shipdate) ELSE NULL END AS last_success_at,
           CASE WHEN l_suppkey % 10 = 0 THEN 'HTTP 500' ELSE NULL END AS last_error, 'Imported' AS notes
    FROM {lineitem} GROUP BY l_partkey, l_suppkey HAVING min(l_linestatus) = 'F'"""
VIEWS["capture_sources_v"] = """
    SELECT l_partkey * 100000 + l_suppkey AS source_id, l_partkey AS product_id, l_suppkey % 6 AS vendor_id,
           'https://shop' || cast(l_suppkey AS string) || '.example.com/p/' || cast(l_partkey AS string)
               || CASE WHEN l_suppkey % 3 = 0 THEN '/' ELSE '' END AS url,
           l_suppkey % 5 <> 0 AS active, max(l_shipdate) AS last_seen_at,
           CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE max(l_shipdate) END AS last_success_at,
           CASE l_suppkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'success' ELSE NULL END AS last_fetch_status,
           CASE l_suppkey % 4 WHEN 1 THEN l_suppkey % 3 WHEN 2 THEN 0 ELSE l_suppkey % 2 END AS consecutive_failures,
           cast(0.5 AS double) AS confidence,
           CASE l_suppkey % 8 WHEN 1 THEN 'firecrawl_timeout' WHEN 2 THEN 'http_error' WHEN 3 THEN 'firecrawl_x' ELSE NULL END AS last_error_code,
           CASE l_suppkey % 9 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS response_status,
           CASE l_suppkey % 11 WHEN 1 THEN 'Captcha page' WHEN 2 THEN 'rate limited' ELSE '' END AS last_error_message,
           CASE l_suppkey % 10 WHEN 1 THEN 'skroutz_firecrawl' ELSE 'direct' END AS strategy,
           CASE WHEN l_suppkey % 12 = 1 THEN 'NO_OFFER_OBSERVATIONS_PARSED' WHEN l_suppkey % 12 = 2 THEN 'Firecrawl_Blocked' ELSE '' END AS flag,
           max(l_shipdate) AS updated_at
    FROM {lineitem} GROUP BY l_partkey, l_suppkey"""
VIEWS["vendors_v"] = """
    SELECT DISTINCT s_suppkey % 6 AS vendor_id,
           CASE s_suppkey % 6 WHEN 1 THEN 'skroutz' WHEN 2 THEN 'bestprice' WHEN 5 THEN NULL ELSE 'shop' END AS vendor
    FROM {supplier}"""
VIEWS["tasks_v"] = """
    SELECT offer_key AS task_id, 'run-' || split_part(offer_key, '-', 1) AS run_id, product_id,
           CASE seller_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'Running' ELSE 'failed' END AS task_status
    FROM {offers_v}"""
VIEWS["candidates_v"] = """
    SELECT offer_key AS candidate_id, run_id, 'main' AS catalog_source,
           lpad(cast(product_id AS string), 6, '0') AS model,
           CASE WHEN product_id % 41 = 0 THEN NULL ELSE product_id END AS product_id,
           CASE WHEN seller_id % 2 = 0 THEN 'market_a' ELSE 'shop' END AS source_name,
           CASE WHEN seller_id % 6 = 0 THEN '' ELSE 'https://shop' || cast(seller_id AS string) || '.example.com/p/' || cast(product_id AS string) END AS candidate_url,
           CASE WHEN seller_id % 4 = 0 THEN 'https://shop' || cast(seller_id AS string) || '.example.com/c/' || cast(product_id AS string)
                WHEN seller_id % 17 = 0 THEN 'bad url' ELSE '' END AS canonical_url,
           CASE seller_id % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'not_found' WHEN 2 THEN 'error' ELSE 'matched' END AS match_status,
           CASE seller_id % 3 WHEN 0 THEN 'exact_mpn_and_brand' ELSE 'mpn_or_model' END AS match_method,
           cast(seller_id % 101 AS double) / 100 AS confidence,
           CASE WHEN seller_id % 7 = 0 THEN 'browser' ELSE 'search' END AS provider,
           'needs_review' AS status, captured_at AS created_at, price
    FROM {offers_v}"""
VIEWS["handoffs_v"] = """
    SELECT p_partkey AS doc_id,
           '{{"schema_version":"v1"'
           || CASE WHEN p_partkey % 4 = 0 THEN ',"catalog_product_id":' || cast(p_partkey AS string) ELSE '' END
           || ',"product":{{"model":"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lpad(cast(p_partkey AS string), 6, '0') END
           || '","mpn":"MPN-' || cast(p_partkey + CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS string) || '"}},"sources":['
           || '{{"url":"https://www.skroutz.gr/s/' || cast(p_partkey AS string) || '?utm_source=x","confidence":"0.9' || cast(p_size % 10 AS string)
           || '","price_evidence":{{"price":"1.' || cast(100 + p_size AS string) || ',50 €","confidence":"0.5"}},"raw_html":"<p>"}},'
           || '{{"url":"https://www.skroutz.gr/s/' || cast(p_partkey AS string) || '","confidence":"0.2"}},'
           || '{{"url":"https://bestprice.gr/item/' || cast(p_partkey AS string) || '/x.html","confidence":"0.4","evidence":{{"match":"'
           || CASE WHEN p_size % 2 = 0 THEN 'Exact model' ELSE 'name' END || '"}}}},'
           || '{{"url":"https://other.example.com/' || cast(p_size AS string) || '"}}]}}' AS payload
    FROM {part}"""

TS = "yyyy-MM-dd"


def day(name: str):
    return F.date_format(name, TS).alias(name)


# ------------------------------------------------------------------- URL forms
@query(
    "FN16_normalize_url",
    f"""SELECT page_id, {norm_sql('url')} AS registry_form, {norm_sql('url', True)} AS capture_form FROM pages""",
)
def _(v):
    return v.pages.select(
        "page_id", U.normalize_url(F.col("url")).alias("registry_form"),
        U.canonical_url(F.col("url")).alias("capture_form"),
    )


@query(
    "FN17_url_hash",
    f"SELECT page_id, sha256({norm_sql('url', True)}) AS url_hash FROM pages",
)
def _(v):
    return v.pages.select("page_id", U.canonical_url_hash(F.col("url")).alias("url_hash"))


@query(
    "FN18_url_host",
    """SELECT doc_id, host, CASE WHEN regexp_matches(host, '^(www[.])?skroutz[.]gr$') THEN 'skroutz'
              WHEN regexp_matches(host, '^(www[.])?bestprice[.]gr$') THEN 'bestprice' ELSE 'unknown' END AS source_name
       FROM (SELECT doc_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM
             (SELECT doc_id, unnest(regexp_extract_all(payload, '"url":"([^"]*)"', 1)) AS url FROM handoffs_v))""",
)
def _(v):
    urls = R.explode_handoffs(v.handoffs_v)
    return urls.select(
        "doc_id", U.url_host(F.col("url")).alias("host"), U.source_name(F.col("url")).alias("source_name")
    )


@query(
    "FN49_redirect_path",
    """SELECT page_id, CASE WHEN trim(p, '/') = '' THEN '' ELSE '/' || trim(p, '/') END AS path
       FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""",
)
def _(v):
    return v.pages.select("page_id", U.redirect_path(F.col("url")).alias("path"))


# ----------------------------------------------------------- identity and import
_RESOLVED = """m AS (SELECT model, min(product_id) AS id FROM catalog_v WHERE active AND model <> '' GROUP BY 1),
     n AS (SELECT mpn, count(*) AS hits, min(product_id) AS id FROM catalog_v WHERE active AND mpn <> '' GROUP BY 1),
     e AS (SELECT v.*, CASE WHEN m.id IS NOT NULL THEN 'model' WHEN hits = 1 THEN 'mpn' WHEN hits > 1 THEN 'ambiguous_mpn'
              WHEN trim(v.model) = '' AND v.mpn = '' THEN 'missing_identity' ELSE 'unresolved' END AS match_type,
              CASE WHEN m.id IS NOT NULL THEN m.id WHEN hits = 1 THEN n.id END AS resolved_id
           FROM evidence_v v LEFT JOIN m ON m.model = CASE WHEN contains(v.model, ';') THEN NULL ELSE nullif(trim(v.model), '') END
           LEFT JOIN n ON n.mpn = nullif(v.mpn, ''))"""


@query("J2_evidence_to_catalog", "WITH " + _RESOLVED + "SELECT evidence_id, match_type, resolved_id FROM e")
def _(v):
    return R.resolve_for_import(v.evidence_v, v.catalog_v).select("evidence_id", "match_type", "resolved_id")


def _evidence(v):
    # The same URLs are seen day after day: parsed once each, before anything is joined to them.
    rows = R.resolve_for_import(R.with_url_forms(v.evidence_v, repeated=True), v.catalog_v)
    weak = (F.col("feed") == "artifacts") & (F.col("match_type") != "model")
    return rows.withColumns({
        "status": F.when(weak, "needs_review").otherwise("active"),
        "url_type": F.lit("imported"), "provenance": F.lit("import"), "trust_level": F.lit("imported"),
        "last_seen_at": F.col("observed_at"), "last_success_at": F.col("observed_at"),
        "last_error": F.lit(None).cast("string"), "notes": F.lit("Imported"),
    })


_REPORT = _RESOLVED + f""", f AS (SELECT *, CASE WHEN regexp_matches(lower(url), '^https?://') THEN {norm_sql('url')} END AS url_normalized,
          CASE WHEN feed = 'artifacts' AND match_type <> 'model' THEN 'needs_review' ELSE 'active' END AS status FROM e),
     g AS (SELECT *, CASE WHEN match_type = 'ambiguous_mpn' THEN 'ambiguous_identity' WHEN resolved_id IS NULL THEN 'unresolved_identity'
              WHEN url_normalized IS NULL THEN 'invalid_url' END AS skip FROM f),
     h AS (SELECT *, row_number() OVER (PARTITION BY skip IS NULL, resolved_id, url_normalized ORDER BY neg_day, evidence_id) AS k FROM g),
     r AS (SELECT h.evidence_id, h.status, h.resolved_id, h.url_normalized,
             CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN k > 1 THEN 'duplicate' WHEN o.url IS NULL THEN 'created'
                  WHEN o.url <> h.url OR (o.url_type <> 'manual' AND (o.url_type <> 'imported' OR o.trust_level <> 'imported'))
                    OR (o.status = 'broken' AND h.status = 'active') OR (o.status = 'needs_review' AND h.status = 'active')
                    OR o.last_seen_at < h.observed_at OR o.last_success_at IS NULL OR o.last_success_at < h.observed_at
                    OR o.notes IS DISTINCT FROM 'Imported' THEN 'updated' ELSE 'duplicate' END AS action,
             CASE WHEN skip IS NOT NULL THEN skip WHEN k > 1 THEN 'duplicate_candidate' END AS reason0
           FROM h LEFT JOIN existing_urls_v o ON skip IS NULL AND o.product_id = h.resolved_id AND o.url_normalized = h.url_normalized),
     rep AS (SELECT evidence_id, status, action, coalesce(reason0, CASE WHEN action = 'duplicate' THEN 'already_exists' END) AS reason FROM r)"""


@query("SO5_import_duplicates", "WITH " + _REPORT + "SELECT evidence_id, action, reason FROM rep")
def _(v):
    return R.import_report(_evidence(v), v.existing_urls_v, ["neg_day", "evidence_id"]).select(
        "evidence_id", "action", "reason"
    )


@query("SO1_union_feeds", "SELECT feed, count(*) AS n, sum(neg_day)::bigint AS check_sum FROM evidence_v GROUP BY feed")
def _(v):
    feeds = {f: v.evidence_v.where(F.col("feed") == f).drop("feed") for f in ("observations", "artifacts")}
    return R.union_feeds(feeds).groupBy("feed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("neg_day").alias("check_sum")
    )


@query(
    "A22_import_counters",
    "WITH " + _REPORT + """SELECT count(*) FILTER (action <> 'skipped') AS candidates_found,
         cast(0 AS bigint) AS imported_count, cast(0 AS bigint) AS updated_count,
         count(*) FILTER (action = 'created') AS would_import_count, count(*) FILTER (action = 'updated') AS would_update_count,
         count(*) FILTER (action = 'duplicate') AS duplicate_count, count(*) FILTER (action = 'skipped') AS skipped_count,
         count(*) FILTER ((action IN ('created', 'updated') OR reason = 'already_exists') AND status = 'active') AS active_count,
         count(*) FILTER ((action IN ('created', 'updated') OR reason = 'already_exists') AND status = 'needs_review') AS needs_review_count,
         count(*) FILTER (reason = 'invalid_url') AS invalid_url_count,
         count(*) FILTER (reason = 'unresolved_identity') AS unresolved_identity_count,
         count(*) FILTER (reason = 'ambiguous_identity') AS ambiguous_identity_count FROM rep""",
)
def _(v):
    report = R.import_report(_evidence(v), v.existing_urls_v, ["neg_day", "evidence_id"])
    return R.import_counters(report, apply=False)


@query(
    "U3_imported_url_merge",
    """WITH j AS (SELECT coalesce(o.product_id, n.product_id) AS product_id, coalesce(o.url_normalized, n.url_normalized) AS url_normalized,
          o.url IS NULL AS no_old, n.url IS NULL AS no_new, o.url AS ou, n.url AS nu, o.url_type AS ot, o.trust_level AS ol, o.status AS os, n.status AS ns,
          o.last_seen_at AS oa, n.last_seen_at AS na, o.last_success_at AS ob, n.last_success_at AS nb, o.last_error AS oe, n.last_error AS ne,
          o.notes AS onn, n.notes AS nn FROM existing_urls_v o FULL OUTER JOIN imported_urls_v n
          ON n.product_id = o.product_id AND n.url_normalized = o.url_normalized),
       s AS (SELECT *, CASE WHEN os = 'disabled' THEN os WHEN os = 'broken' AND ns = 'active' AND nb IS NOT NULL THEN 'active'
            WHEN os = 'needs_review' AND ns = 'active' THEN 'active' WHEN os NOT IN ('active', 'broken', 'redirected') THEN ns ELSE os END AS st FROM j),
       c AS (SELECT *, CASE WHEN no_old OR no_new THEN '' ELSE concat_ws('|', CASE WHEN ou <> nu THEN 'url' END,
            CASE WHEN ot <> 'manual' AND ot <> 'imported' THEN 'url_type' END, CASE WHEN ot <> 'manual' AND ol <> 'imported' THEN 'trust_level' END,
            CASE WHEN st <> os THEN 'status' END, CASE WHEN na > oa THEN 'last_seen_at' END,
            CASE WHEN nb > ob OR (ob IS NULL AND nb IS NOT NULL) THEN 'last_success_at' END,
            CASE WHEN ne IS NOT NULL AND oe IS DISTINCT FROM ne THEN 'last_error' END, CASE WHEN onn IS DISTINCT FROM nn THEN 'notes' END) END AS changed FROM s)
       SELECT product_id, url_normalized, CASE WHEN no_old THEN 'created' WHEN no_new THEN 'unchanged' WHEN changed <> '' THEN 'updated' ELSE 'duplicate' END AS action,
              changed AS changed_fields, CASE WHEN no_old THEN ns WHEN no_new THEN os ELSE st END AS status,
              strftime(greatest(oa, na), '%Y-%m-%d') AS last_seen_at FROM c""",
)
def _(v):
    return R.merge_imported_urls(v.existing_urls_v, v.imported_urls_v).select(
        "product_id", "url_normalized", "action", "changed_fields", "status", day("last_seen_at")
    )


@query(
    "U4_manual_url_merge",
    """SELECT coalesce(o.product_id, n.product_id) AS product_id, coalesce(o.url_normalized, n.url_normalized) AS url_normalized,
          coalesce(o.status, 'active') AS status, CASE WHEN o.url IS NULL THEN 'created' WHEN n.url IS NULL THEN 'unchanged' ELSE 'updated' END AS action,
          coalesce(n.url, o.url) AS url, CASE WHEN n.url IS NULL THEN o.url_type ELSE 'manual' END AS url_type,
          coalesce(n.notes, o.notes) AS notes
       FROM existing_urls_v o FULL OUTER JOIN imported_urls_v n ON n.product_id = o.product_id AND n.url_normalized = o.url_normalized""",
)
def _(v):
    manual = v.imported_urls_v.withColumns({"url_type": F.lit("manual"), "trust_level": F.lit("manual")})
    return R.merge_manual_urls(v.existing_urls_v, manual).drop("source_name", "trust_level")


@query(
    "U5_url_check",
    """WITH c AS (SELECT url_id, CASE failure_count WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'inconclusive' END AS r, notes FROM existing_urls_v)
       SELECT o.url_id, CASE WHEN r = 'success' AND status <> 'disabled' THEN 'active' WHEN r = 'failed' THEN 'broken' ELSE status END AS status,
              CASE WHEN r = 'success' THEN 0 WHEN r = 'failed' THEN failure_count + 1 ELSE failure_count END AS failure_count,
              CASE WHEN r IN ('failed', 'inconclusive') THEN 'URL returned HTTP ' || r END AS last_error
       FROM existing_urls_v o JOIN c USING (url_id)""",
)
def _(v):
    result = F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("inconclusive"), F.lit(None)), (F.col("failure_count") + 1).cast("int"))
    checks = v.existing_urls_v.select(
        "url_id", result.alias("result"), F.concat(F.lit(" URL returned  HTTP "), result).alias("message")
    )
    return R.apply_url_checks(v.existing_urls_v, checks).select("url_id", "status", "failure_count", "last_error")


# ---------------------------------------------------------------------- health
_HEALTH = """o AS (SELECT *, max(CASE WHEN fetch_status = 'success' THEN captured_at END) OVER (PARTITION BY source_id) AS ok FROM captures_v),
     h AS (SELECT source_id, arg_max(fetch_status, captured_at) AS last_fetch_status, arg_max(coalesce(error_code, ''), captured_at) AS code,
             max(captured_at) FILTER (fetch_status = 'success') AS s, max(captured_at) FILTER (fetch_status <> 'success') AS f,
             count(*) FILTER (fetch_status <> 'success' AND (ok IS NULL OR captured_at > ok)) AS consecutive_failures FROM o GROUP BY 1)"""


@query(
    "U6_source_health",
    "WITH " + _HEALTH + """SELECT source_id, last_fetch_status, CASE WHEN last_fetch_status <> 'success' THEN nullif(code, '') END AS last_error_code,
        strftime(s, '%Y-%m-%d') AS last_success_at, strftime(f, '%Y-%m-%d') AS last_error_at, consecutive_failures FROM h""",
)
def _(v):
    return R.source_health(v.captures_v).select(
        "source_id", "last_fetch_status", "last_error_code", day("last_success_at"), day("last_error_at"), "consecutive_failures"
    )


@query(
    "U7_escalate_urls",
    "WITH " + _HEALTH + """, x AS (SELECT u.url_id, u.status, u.failure_count, u.status = 'active' AND coalesce(consecutive_failures >= 2, false)
            AND last_fetch_status <> 'success' AS due, consecutive_failures
          FROM existing_urls_v u LEFT JOIN h ON h.source_id = u.product_id)
       SELECT url_id, CASE WHEN due THEN 'needs_review' ELSE status END AS status,
              CASE WHEN due THEN greatest(failure_count, consecutive_failures) ELSE failure_count END AS failure_count,
              coalesce(due, false) AS escalated FROM x""",
)
def _(v):
    health = R.source_health(v.captures_v).withColumn(
        "health_reason", F.when(F.col("last_fetch_status") != "success", "firecrawl_blocked")
    )
    urls = v.existing_urls_v.withColumn("source_id", F.col("product_id"))
    return R.escalate_urls(urls, health).select("url_id", "status", "failure_count", "escalated")


_REASON = """CASE WHEN coalesce(vendor, '') <> '' AND vendor <> 'skroutz' AND strategy <> 'skroutz_firecrawl' THEN NULL
     WHEN flag = 'Firecrawl_Blocked' THEN 'firecrawl_blocked'
     WHEN NOT (strategy = 'skroutz_firecrawl' OR coalesce(last_error_code, '') LIKE 'firecrawl%') AND coalesce(vendor, '') <> 'skroutz' THEN NULL
     WHEN last_error_code = 'firecrawl_timeout' THEN 'firecrawl_timeout'
     WHEN flag = 'NO_OFFER_OBSERVATIONS_PARSED' THEN 'firecrawl_no_offers'
     WHEN response_status = 429 OR last_error_message = 'rate limited' THEN 'firecrawl_rate_limited'
     WHEN response_status = 403 OR last_error_message = 'Captcha page' THEN 'firecrawl_blocked'
     WHEN response_status >= 400 THEN 'firecrawl_http_error'
     WHEN strategy = 'skroutz_firecrawl' OR last_error_code LIKE 'firecrawl%' THEN 'firecrawl_unknown_error' END"""


def _health_items(v):
    sources = v.capture_sources_v.withColumn("flags", F.array("flag"))
    products = v.catalog_v.select("product_id", "model")
    return R.health_items(sources, products, v.vendors_v)


@query(
    "J11_source_health_items",
    f"""SELECT source_id, model, vendor, CASE WHEN NOT s.active THEN 'disabled' WHEN last_fetch_status = 'failed' OR consecutive_failures > 0 THEN 'failing'
            WHEN last_fetch_status = 'success' THEN 'healthy' ELSE 'unknown' END AS health, {_REASON} AS health_reason
       FROM capture_sources_v s JOIN catalog_v c USING (product_id) LEFT JOIN vendors_v USING (vendor_id)""",
)
def _(v):
    return _health_items(v).select("source_id", "model", "vendor", "health", "health_reason")


@query(
    "D17_health_reason",
    f"SELECT {_REASON} AS health_reason, count(*) AS sources FROM capture_sources_v LEFT JOIN vendors_v USING (vendor_id) GROUP BY 1",
)
def _(v):
    return _health_items(v).groupBy("health_reason").agg(F.count(F.lit(1)).alias("sources"))


@query(
    "J11_health_page",
    f"""SELECT source_id FROM (SELECT *, {_REASON} AS health_reason FROM capture_sources_v LEFT JOIN vendors_v USING (vendor_id))
        WHERE health_reason = 'firecrawl_rate_limited' ORDER BY updated_at DESC, source_id DESC LIMIT 100 OFFSET 10""",
)
def _(v):
    return R.health_page(_health_items(v), 100, 10, "firecrawl_rate_limited").select("source_id")


@query(
    "F10_due_sources",
    """SELECT source_id FROM capture_sources_v WHERE active AND (last_success_at IS NULL OR last_success_at < TIMESTAMP '1999-12-30 18:00:00')
       ORDER BY last_success_at ASC NULLS FIRST, source_id LIMIT 50""",
)
def _(v):
    now = F.lit("1999-12-31 00:00:00").cast("timestamp_ntz")
    return R.due_sources(v.capture_sources_v, now, 360, 50).select("source_id")


# -------------------------------------------------------------------- coverage
@query(
    "A5_url_status_counts",
    "SELECT product_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.URL_STATUSES)
    + " FROM existing_urls_v GROUP BY product_id",
)
def _(v):
    return R.url_status_counts(v.existing_urls_v)


@query(
    "A6_registry_summary",
    """WITH a AS (SELECT product_id FROM catalog_v WHERE active), u AS (SELECT * FROM existing_urls_v SEMI JOIN a USING (product_id)),
       t AS (SELECT count(*) AS source_url_count, count(DISTINCT product_id) FILTER (status = 'active') AS with_active,
                    strftime(max(updated_at), '%Y-%m-%d') AS updated_at, (SELECT count(*) FROM a) AS catalog_product_count FROM u)
       SELECT *, catalog_product_count - with_active AS without_active, round_even(with_active * 100.0::double / catalog_product_count, 2) AS coverage_percent FROM t""",
)
def _(v):
    return R.registry_summary(v.catalog_v, v.existing_urls_v).withColumn("updated_at", F.date_format("updated_at", TS))


@query(
    "A6_registry_breakdown",
    """WITH u AS (SELECT e.* FROM existing_urls_v e JOIN catalog_v c ON c.product_id = e.product_id AND c.active)
       SELECT 'status' AS dimension, status AS value, count(*) AS urls FROM u GROUP BY status
       UNION ALL SELECT 'source_name', source_name, count(*) FROM u GROUP BY source_name
       UNION ALL SELECT 'url_type', url_type, count(*) FROM u GROUP BY url_type""",
)
def _(v):
    return R.registry_breakdown(v.catalog_v, v.existing_urls_v)


@query(
    "A7_status_by_source",
    "SELECT source_name, count(*) AS source_url_count, " + ", ".join(f"count(*) FILTER (u.status = '{s}') AS {s}" for s in R.URL_STATUSES)
    + " FROM urls_v u JOIN catalog_v c ON c.product_id = u.product_id AND c.active GROUP BY source_name",
)
def _(v):
    return R.status_by_source(v.catalog_v, v.urls_v)


@query(
    "A7_missing_url_products",
    """SELECT product_id, model, 'missing_active_source_url' AS reason FROM catalog_v c WHERE active AND NOT EXISTS
       (SELECT 1 FROM existing_urls_v u WHERE u.product_id = c.product_id AND u.status = 'active')""",
)
def _(v):
    return R.missing_url_products(v.catalog_v, v.existing_urls_v).select("product_id", "model", "reason")


@query(
    "A7_health_counts",
    """SELECT CASE WHEN NOT active THEN 'disabled' WHEN last_fetch_status = 'failed' OR consecutive_failures > 0 THEN 'failing'
            WHEN last_fetch_status = 'success' THEN 'healthy' ELSE 'unknown' END AS health, count(*) AS sources FROM capture_sources_v GROUP BY 1""",
)
def _(v):
    state = R.health_state(F.col("active"), F.col("last_fetch_status"), F.col("consecutive_failures"))
    return v.capture_sources_v.groupBy(state.alias("health")).agg(F.count(F.lit(1)).alias("sources"))


@query(
    "A36_capture_run_counters",
    """SELECT strftime(captured_at, '%Y-%m-%d') AS run_id, count(*) AS selected, count(*) FILTER (fetch_status = 'success') AS succeeded,
          count(*) FILTER (fetch_status = 'failed') AS failed, count(*) FILTER (fetch_status = 'skipped') AS skipped FROM captures_v GROUP BY 1""",
)
def _(v):
    return R.capture_run_counters(v.captures_v.withColumn("run_id", F.date_format("captured_at", TS)))


# -------------------------------------------------------------- links and tasks
_LATEST = """SELECT product_id, run_id, task_id, coalesce(nullif(task_status, ''), r.status) AS status,
       lower(task_status) IN ('queued', 'running') OR r.status IN ('queued', 'running') AS running
     FROM tasks_v t JOIN runs_v r USING (run_id)
     QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, r.id DESC, task_id DESC) = 1"""


@query("W4_latest_task", _LATEST)
def _(v):
    return R.latest_task(v.tasks_v, v.runs_v)


@query(
    "J12_tasks_with_runs",
    """SELECT r.status, t.task_status, count(*) AS tasks FROM tasks_v t JOIN runs_v r USING (run_id) GROUP BY 1, 2""",
)
def _(v):
    return v.tasks_v.join(v.runs_v.select("run_id", "status"), "run_id").groupBy("status", "task_status").agg(
        F.count(F.lit(1)).alias("tasks")
    )


@query(
    "W12_latest_snapshot",
    """SELECT source_id, max(attempt_id) AS snapshot_id FROM (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY
         CASE WHEN fetch_status = 'skipped' THEN NULL ELSE captured_at END DESC NULLS LAST) AS k FROM captures_v) WHERE k = 1 GROUP BY 1""",
)
def _(v):
    return R.latest_snapshot(_snapshots(v)).select("source_id", "snapshot_id")


def _snapshots(v):
    return v.captures_v.select(
        "source_id", F.col("attempt_id").alias("snapshot_id"), "fetch_status",
        F.when(F.col("fetch_status") != "skipped", F.col("captured_at")).alias("captured_at"),
    )


@query(
    "J31_pairs_without_url",
    """SELECT DISTINCT product_id, source_name FROM candidates_v c WHERE product_id IS NOT NULL AND NOT EXISTS
       (SELECT 1 FROM urls_v u WHERE u.product_id = c.product_id AND u.source_name = c.source_name AND u.status = 'active')""",
)
def _(v):
    pairs = v.candidates_v.where("product_id IS NOT NULL").select("product_id", "source_name").distinct()
    return R.without_active_pair(pairs, v.urls_v)


@query(
    "J28_product_detail",
    f"""WITH s AS (SELECT product_id, sha256({norm_sql('url', True)}) AS h, min(source_id) AS source_id FROM sources_v GROUP BY 1, 2),
          k AS (SELECT source_id, max(attempt_id) AS snapshot_id FROM (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY
             CASE WHEN fetch_status = 'skipped' THEN NULL ELSE captured_at END DESC NULLS LAST) AS r FROM captures_v) WHERE r = 1 GROUP BY 1)
       SELECT c.product_id, c.model, u.url_id, u.status, s.source_id, k.snapshot_id
       FROM catalog_v c JOIN urls_v u ON u.product_id = c.product_id
       LEFT JOIN s ON s.product_id = u.product_id AND s.h = sha256({norm_sql('u.url', True)}) LEFT JOIN k ON k.source_id = s.source_id""",
)
def _(v):
    products = v.catalog_v.select("product_id", "model")
    return R.product_detail(products, v.urls_v, v.sources_v, _snapshots(v)).select(
        "product_id", "model", "url_id", "status", "source_id", "snapshot_id"
    )


@query(
    "J13_sources_from_urls",
    """WITH u AS (SELECT product_id, url_normalized AS k, status, trust_level, last_seen_at, failure_count FROM existing_urls_v),
       s AS (SELECT source_id, product_id, regexp_replace(url, '/$', '') AS k, active, last_seen_at, consecutive_failures, confidence FROM capture_sources_v)
       SELECT source_id, coalesce(s.product_id, u.product_id) AS product_id, coalesce(s.k, u.k) AS url,
              CASE WHEN u.k IS NULL THEN s.active ELSE u.status = 'active' END AS active,
              strftime(greatest(s.last_seen_at, u.last_seen_at), '%Y-%m-%d') AS last_seen_at,
              greatest(coalesce(consecutive_failures, 0), coalesce(failure_count, 0)) AS consecutive_failures,
              coalesce(CASE WHEN trust_level = 'manual' THEN 1.0 WHEN u.status = 'active' THEN 0.8 END::double, confidence) AS confidence,
              CASE WHEN s.k IS NULL THEN 'created' WHEN u.k IS NULL THEN 'unchanged' ELSE 'updated' END AS action
       FROM s FULL OUTER JOIN u ON u.product_id = s.product_id AND u.k = s.k WHERE s.k IS NOT NULL OR u.status = 'active'""",
)
def _(v):
    return R.sources_from_urls(v.existing_urls_v, v.capture_sources_v).drop("url_hash").withColumn(
        "last_seen_at", F.date_format("last_seen_at", TS)
    )


@query(
    "J13_urls_from_sources",
    """WITH s AS (SELECT product_id, regexp_replace(url, '/$', '') AS k, active, last_seen_at, consecutive_failures FROM capture_sources_v)
       SELECT url_id, coalesce(u.product_id, s.product_id) AS product_id, coalesce(u.url_normalized, s.k) AS url_normalized,
              CASE WHEN s.k IS NULL THEN u.status WHEN NOT s.active THEN 'disabled'
                   WHEN u.status IN ('disabled', 'needs_review', 'broken', 'redirected') THEN u.status ELSE 'active' END AS status,
              CASE WHEN u.url_type = 'manual' OR s.k IS NULL THEN u.url_type ELSE 'imported' END AS url_type,
              greatest(coalesce(failure_count, 0), coalesce(consecutive_failures, 0)) AS failure_count,
              CASE WHEN u.url IS NULL THEN 'created' WHEN s.k IS NULL THEN 'unchanged' ELSE 'updated' END AS action
       FROM existing_urls_v u FULL OUTER JOIN s ON s.product_id = u.product_id AND s.k = u.url_normalized""",
)
def _(v):
    return R.urls_from_sources(v.capture_sources_v, v.existing_urls_v).drop("last_seen_at")


@query(
    "U15_reuse_sources",
    """WITH r AS (SELECT DISTINCT product_id, url_normalized AS u FROM existing_urls_v)
       SELECT r.product_id, sha256(r.u) AS url_hash, r.u AS canonical_url, source_id, source_id IS NULL AS created
       FROM r LEFT JOIN capture_sources_v s ON s.product_id = r.product_id AND regexp_replace(s.url, '/$', '') = r.u""",
)
def _(v):
    return R.reuse_or_create_sources(v.existing_urls_v.select("product_id", "url"), v.capture_sources_v)


@query(
    "J14_eligible_sources",
    """SELECT url_id FROM existing_urls_v u JOIN catalog_v c ON c.product_id = u.product_id AND c.active WHERE u.status = 'active'
       AND NOT EXISTS (SELECT 1 FROM capture_sources_v s WHERE NOT s.active AND s.product_id = u.product_id AND regexp_replace(s.url, '/$', '') = u.url_normalized)""",
)
def _(v):
    return R.eligible_sources(v.existing_urls_v, v.catalog_v, v.capture_sources_v).select("url_id")


VIEWS["incoming_snapshots_v"] = """
    SELECT event_id AS snapshot_id, user_id AS source_id, 'capture/' || event_type AS artifact_ref,
           cast(floor(value / 10) AS bigint) AS digest_no, event_type, ts AS captured_at FROM {events}"""


@query(
    "U13_new_snapshots",
    """SELECT source_id, artifact_ref, sha256(cast(digest_no AS varchar)) AS digest, min(snapshot_id) AS snapshot_id FROM incoming_snapshots_v i
       WHERE NOT EXISTS (SELECT 1 FROM captures_v c WHERE c.source_id = i.source_id AND c.fetch_status = 'success'
            AND 'capture/view' = i.artifact_ref AND floor(c.value / 10) = i.digest_no) GROUP BY 1, 2, 3""",
)
def _(v):
    digest = lambda c: F.sha2(c.cast("string"), 256).alias("digest")
    incoming = v.incoming_snapshots_v.select("snapshot_id", "source_id", "artifact_ref", digest(F.col("digest_no")))
    stored = v.captures_v.where("fetch_status = 'success'").select(
        "source_id", F.lit("capture/view").alias("artifact_ref"), digest(F.floor(F.col("value") / 10))
    )
    return R.new_snapshots(incoming, stored)


# --------------------------------------------------------- candidates and review
@query(
    "F12_auto_apply_gate",
    f"""WITH s AS (SELECT *, coalesce(nullif(canonical_url, ''), nullif(candidate_url, '')) AS u FROM candidates_v
             WHERE match_status = 'matched' AND match_method = 'exact_mpn_and_brand' AND confidence > 0.9),
          m AS (SELECT product_id, source_name, arg_min(url, url_id) AS mu FROM urls_v WHERE url_type = 'manual' GROUP BY 1, 2)
       SELECT candidate_id, CASE WHEN provider = 'browser' THEN 'provider_auto_apply_disabled:browser'
            WHEN s.product_id IS NULL THEN 'catalog_product_id_missing' WHEN u IS NULL THEN 'candidate_url_missing'
            WHEN u = 'bad url' THEN 'invalid_url:unsupported_scheme'
            WHEN mu IS NOT NULL AND {norm_sql('mu')} <> {norm_sql('u')} THEN 'manual_source_url_exists' END AS reason
       FROM s LEFT JOIN m ON m.product_id = s.product_id AND m.source_name = s.source_name""",
)
def _(v):
    return R.auto_apply_gate(v.candidates_v, v.urls_v, ["browser"]).select("candidate_id", "reason")


VIEWS["decisions_v"] = """
    SELECT candidate_id, row_no AS seq,
           CASE row_no % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'replace_url' WHEN 2 THEN 'reject' ELSE 'maybe' END AS decision,
           CASE WHEN row_no % 3 = 0 THEN 'https://Fixed.example.com/p/' || cast(row_no AS string) || '?gclid=1' ELSE ' ' END AS reviewed_url
    FROM (SELECT candidate_id, cast(round(price * 100) AS bigint) AS row_no FROM {candidates_v} WHERE match_status = 'needs_review')"""


@query(
    "U8_candidate_review",
    """WITH d AS (SELECT candidate_id, arg_max(decision, seq) AS decision, nullif(trim(arg_max(reviewed_url, seq)), '') AS ru FROM decisions_v GROUP BY 1),
       x AS (SELECT c.candidate_id, c.product_id, decision, ru, CASE WHEN decision = 'accept' THEN coalesce(ru, nullif(candidate_url, '')) WHEN decision = 'replace_url' THEN ru END AS pu
             FROM candidates_v c LEFT JOIN d USING (candidate_id)),
       y AS (SELECT *, CASE WHEN decision NOT IN ('accept', 'reject', 'replace_url') THEN 'invalid decision'
             WHEN decision = 'replace_url' AND ru IS NULL THEN 'reviewed_url is required'
             WHEN decision IN ('accept', 'replace_url') AND product_id IS NULL THEN 'catalog_product_id is required'
             WHEN decision IN ('accept', 'replace_url') AND pu IS NULL THEN 'candidate_url is required' END AS review_error FROM x)
       SELECT candidate_id, review_error, CASE WHEN review_error IS NULL THEN regexp_replace(replace(pu, 'Fixed', 'fixed'), '[?]gclid=1$', '') END AS promoted_url,
              CASE WHEN decision IS NULL OR review_error IS NOT NULL THEN 'needs_review' WHEN decision = 'reject' THEN 'rejected' ELSE 'accepted' END AS status FROM y""",
)
def _(v):
    return R.apply_reviews(v.candidates_v, v.decisions_v).select(
        "candidate_id", "review_error", "promoted_url", "status"
    )


@query(
    "J26_existing_candidate",
    """WITH k AS (SELECT *, CASE WHEN candidate_url <> '' THEN 'u:' || candidate_url WHEN canonical_url <> '' THEN 'c:' || canonical_url
              ELSE 's:|' || match_status || '|' || match_method END AS key FROM candidates_v),
       s AS (SELECT run_id, model, source_name, unnest(['u:' || candidate_url, 'c:' || canonical_url, 's:|' || match_status || '|' || match_method]) AS key, candidate_id
             FROM candidates_v WHERE match_status <> 'error'),
       l AS (SELECT run_id, model, source_name, key, min(candidate_id) AS id FROM s GROUP BY 1, 2, 3, 4)
       SELECT candidate_id, l.id AS existing_id FROM k LEFT JOIN l USING (run_id, model, source_name, key)""",
)
def _(v):
    stored = v.candidates_v.where("match_status <> 'error'")
    return R.find_existing_candidates(v.candidates_v, stored).select("candidate_id", "existing_id")


@query(
    "J27_transfer_product",
    """WITH m AS (SELECT model, arg_min(product_id, (CASE WHEN active THEN 0 ELSE 1 END, product_id)) AS id FROM catalog_v GROUP BY 1)
       SELECT candidate_id, coalesce(m.id, p.product_id) AS resolved_id FROM candidates_v c LEFT JOIN m ON m.model = c.model
       LEFT JOIN catalog_v p ON p.product_id = c.product_id""",
)
def _(v):
    rows = v.candidates_v.withColumnRenamed("product_id", "catalog_product_id")
    return R.resolve_transfer_product(rows, v.catalog_v).select("candidate_id", "resolved_id")


# --------------------------------------------------------------------- handoffs
_HANDOFF = f"""j AS (SELECT doc_id, payload::json AS p FROM handoffs_v),
     s AS (SELECT doc_id, i - 1 AS source_index, p->'sources'->(i - 1)::int AS s, try_cast(p->>'catalog_product_id' AS bigint) AS pid,
              nullif(p->'product'->>'model', '') AS model, p->'product'->>'mpn' AS mpn FROM j, generate_series(1, 4) t(i)),
     x AS (SELECT s.*, s->>'url' AS url, try_cast(s->>'confidence' AS double) AS conf, s->'evidence'->>'match' AS ev,
              try_cast(replace(replace(replace(s->'price_evidence'->>'price', ' €', ''), '.', ''), ',', '.') AS decimal(20,6)) AS price, s->>'raw_html' AS html FROM s),
     m AS (SELECT model, min(product_id) AS id FROM catalog_v WHERE active AND model <> '' GROUP BY 1),
     n AS (SELECT mpn, count(*) AS hits, min(product_id) AS id FROM catalog_v WHERE active AND mpn <> '' GROUP BY 1),
     r AS (SELECT x.*, CASE WHEN pid IS NOT NULL AND NOT coalesce(c.active, false) THEN 'missing_catalog_product_id'
              WHEN pid IS NOT NULL AND (x.model <> c.model OR (c.mpn <> '' AND x.mpn <> c.mpn)) THEN 'ambiguous_catalog_product_id'
              WHEN pid IS NOT NULL THEN 'catalog_product_id' WHEN m.id IS NOT NULL THEN 'model' WHEN hits = 1 THEN 'mpn'
              WHEN hits > 1 THEN 'ambiguous_mpn' ELSE 'unresolved' END AS match_type, m.id AS mid, n.id AS nid
           FROM x LEFT JOIN catalog_v c ON c.product_id = pid LEFT JOIN m ON pid IS NULL AND m.model = x.model LEFT JOIN n ON pid IS NULL AND n.mpn = x.mpn),
     h AS (SELECT *, CASE match_type WHEN 'catalog_product_id' THEN pid WHEN 'model' THEN mid WHEN 'mpn' THEN nid END AS resolved_id,
              CASE WHEN match_type IN ('catalog_product_id', 'model') AND (conf >= 0.85 OR ev = 'Exact model') THEN 'active' ELSE 'needs_review' END AS status,
              {norm_sql('url')} AS url_normalized FROM r)"""


def _handoffs(v):
    return R.handoff_rows(R.explode_handoffs(v.handoffs_v), v.catalog_v)


@query("J3_handoff_to_catalog", "WITH " + _HANDOFF + "SELECT doc_id, source_index, match_type, resolved_id FROM h")
def _(v):
    return _handoffs(v).select("doc_id", "source_index", "match_type", "resolved_id")


@query(
    "IO10_handoff_sources",
    "WITH " + _HANDOFF + "SELECT doc_id, source_index, url, conf AS confidence, cast(price AS double) AS price FROM h",
)
def _(v):
    return R.explode_handoffs(v.handoffs_v).select("doc_id", "source_index", "url", "confidence", "price")


@query(
    "D38_handoff_import",
    "WITH " + _HANDOFF + """SELECT doc_id, source_index, status, CASE WHEN match_type IN ('ambiguous_mpn') THEN 'skipped' WHEN resolved_id IS NULL THEN 'skipped'
          WHEN contains(url, 'other.example') THEN 'skipped' WHEN source_index = 1 THEN 'duplicate' ELSE 'created' END AS action,
        concat_ws('|', CASE WHEN conf < 0.85 THEN 'SOURCE_CONFIDENCE_LOW' END, CASE WHEN price IS NOT NULL THEN 'PRICE_CONFIDENCE_LOW' END,
                  CASE WHEN coalesce(html, '') = '' THEN 'RAW_HTML_MISSING' END) AS quality_flags
        FROM (SELECT h.* REPLACE (CASE WHEN source_index = 1 AND count(*) OVER (PARTITION BY resolved_id, url_normalized) > 1 THEN 1 ELSE source_index END AS source_index) FROM h)""",
)
def _(v):
    return _handoff_report(v).select("doc_id", "source_index", "status", "action", "quality_flags")


def _handoff_report(v):
    rows = _handoffs(v).withColumns({
        "source_name": U.source_name(F.col("url")), "url_type": F.lit("imported"), "provenance": F.lit("import"),
        "trust_level": F.when(F.col("status") == "active", "high_confidence").otherwise("imported"),
        "last_seen_at": F.lit(None).cast("timestamp_ntz"), "last_success_at": F.lit(None).cast("timestamp_ntz"),
        "last_error": F.lit(None).cast("string"), "notes": F.lit("handoff"),
    })
    ambiguous = F.col("match_type").isin("ambiguous_mpn")
    rows = rows.withColumn("match_type", F.when(ambiguous, "ambiguous_mpn").otherwise(F.col("match_type")))
    return R.import_report(rows, v.existing_urls_v, ["doc_id", "source_index"])


@query(
    "A23_handoff_counters",
    "WITH " + _HANDOFF + """, a AS (SELECT *, CASE WHEN resolved_id IS NULL OR contains(url, 'other.example') THEN 'skipped' WHEN source_index = 1 THEN 'duplicate' ELSE 'created' END AS action FROM h)
        SELECT count(*) FILTER (action <> 'skipped') AS candidates_found, count(*) FILTER (action = 'created') AS would_import_count,
               count(*) FILTER (action = 'duplicate') AS duplicate_count, count(*) FILTER (action = 'skipped') AS skipped_count,
               count(*) FILTER (action = 'created' AND status = 'active') AS active_count,
               count(*) FILTER (action = 'created' AND status = 'active' AND price IS NOT NULL) AS would_import_snapshot_count FROM a""",
)
def _(v):
    return R.handoff_counters(_handoff_report(v)).select(
        "candidates_found", "would_import_count", "duplicate_count", "skipped_count", "active_count",
        "would_import_snapshot_count",
    )


# --------------------------------------------------------------------- cleaning
VIEWS["raw_headers_v"] = """
    SELECT event_id, '{{"a":{{"Session-Id":' || cast(user_id AS string) || ',"k":[{{"csrfToken":1,"v":"' || event_type || '"}},2]}},"props":' || replace(props, ' ', '') || '}}' AS payload,
           event_type FROM {events}"""


@query(
    "P17_sanitize_json",
    """SELECT event_id, '{"a":{"k":[{"v":"' || event_type || '"},2]},"props":' || replace(props, ' ', '') || '}' AS payload FROM events""",
)
def _(v):
    return v.raw_headers_v.select("event_id", R.sanitize_json(F.col("payload")).alias("payload"))


@query(
    "P17_sanitize_headers",
    "SELECT event_id, 'accept' AS names, event_type AS accept FROM events",
)
def _(v):
    headers = F.create_map(
        F.lit("accept"), F.col("event_type"), F.lit(" Cookie "), F.lit("x"), F.lit("X-CSRF-Token"), F.lit("y"), F.lit(" "), F.lit("z")
    )
    clean = R.sanitize_headers(headers)
    return v.events.select(
        "event_id", F.array_join(F.map_keys(clean), "|").alias("names"), clean["accept"].alias("accept")
    )


