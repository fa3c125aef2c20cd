"""Repricing and price-monitoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.functions import money as M
from shelfspark.operators import listings as L
from shelfspark.operators import monitoring as O
from shelfspark.operators import paging as PG
from shelfspark.operators import pricing as P
from shelfspark.operators.catalog import CatalogFilter, filter_catalog
from shelfspark.plans.registry import query
from shelfspark.plans.views import VIEWS

# ------------------------------------------------------------------ extra views
VIEWS["enriched_v"] = """
    SELECT p_partkey AS row_no,
           CASE WHEN p_partkey % 71 = 0 THEN ' ' ELSE lpad(cast(p_partkey AS string), 6, '0') END AS model,
           CASE WHEN p_partkey % 67 = 0 THEN '' ELSE 'MPN-' || cast(p_partkey AS string) END AS mpn,
           CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN '178,99'
                WHEN p_partkey % 29 = 0 THEN '1e3' WHEN p_partkey % 31 = 0 THEN '-5.00'
                WHEN p_partkey % 37 = 0 THEN 'NaN' ELSE ' ' || cast(p_retailprice AS string) END AS price,
           CASE WHEN p_size % 7 = 0 THEN '' ELSE cast(p_retailprice - p_size AS string) END AS observed_price,
           CASE WHEN p_size % 5 = 0 THEN 'not_found' ELSE 'matched' END AS match_status
    FROM {part}"""
VIEWS["observation_file_v"] = """
    SELECT l_orderkey AS row_no,
           CASE WHEN l_linenumber = 1 THEN '' ELSE lpad(cast(l_partkey AS string), 6, '0') END AS `Product-Model`,
           CASE WHEN l_linenumber < 3 AND l_returnflag = 'A' THEN '' ELSE 'MPN-' || cast(l_partkey AS string) END AS `MPN`,
           CASE WHEN l_returnflag = 'R' THEN ' Market A ' WHEN l_returnflag = 'N' THEN '' ELSE 'other' END AS source,
           CASE WHEN l_linestatus = 'F' THEN cast(cast(l_quantity AS int) AS string) || ',50 €' ELSE '' END AS `market_a price`,
           CASE WHEN l_linenumber = 5 THEN 'n/a'
                ELSE cast(cast(l_quantity AS int) + 3 AS string) || '.25' END AS competitor_price,
           CASE WHEN l_linenumber = 6 THEN '' ELSE cast(cast(l_quantity AS int) + 4 AS string) END AS price,
           'Supplier#' || cast(l_suppkey AS string) AS shop, '' AS url, ' ' AS currency,
           CASE WHEN l_linenumber = 7 THEN 'soon' ELSE '1998-01-02 03:04:05' END AS observed_at
    FROM {lineitem}"""
VIEWS["snapshots_v"] = """
    SELECT DISTINCT o.run_id, o.run_id || '/' || cast(o.product_id AS string) AS snapshot_id,
           nullif(c.model, '') AS model, nullif(c.mpn, '') AS mpn,
           CASE WHEN o.product_id % 38 = 0 THEN NULL ELSE cast(950.5 AS decimal(12,2)) END AS own_price
    FROM {offers_v} o JOIN {catalog_v} c ON c.product_id = o.product_id"""
VIEWS["snapshot_offers_v"] = """
    SELECT offer_key AS offer_id, run_id || '/' || cast(attempt AS string) AS snapshot_id, product_id,
           seller_id % 3 AS source_id, seller_id % 2 AS vendor_id, store AS seller_name, price,
           CASE WHEN product_id % 4 = 0 AND seller_id % 3 <> 1 THEN seller_id % 5 ELSE NULL END AS raw_rank
    FROM {offers_v}"""
VIEWS["snapshot_obs_v"] = """
    SELECT snapshot_id || '/' || cast(product_id AS string) AS observation_id,
           CASE WHEN product_id % 13 = 0 THEN NULL ELSE snapshot_id END AS snapshot_id, product_id,
           CASE WHEN product_id % 2 = 0 THEN NULL ELSE min(source_id) END AS source_id,
           CASE WHEN product_id % 3 = 0 THEN NULL ELSE min(vendor_id) END AS vendor_id
    FROM {snapshot_offers_v} GROUP BY snapshot_id, product_id"""
VIEWS["raw_payloads_v"] = """
    SELECT offer_key, product_id, run_id, store, price, url, availability,
           CASE WHEN product_id % 5 = 0
                THEN '{{"offers":[{{"shopName":"' || store || '","finalPrice":"' || replace(cast(price AS string), '.', ',') || ' €","href":"' || url || '","shipping":"2.5"}},{{"shop":"none","price":"0"}}]}}'
                WHEN product_id % 5 = 1
                THEN '{{"store_2":"' || store || '","price_2":"' || cast(price AS string) || '","link_2":"' || url || '","n":1}}'
                WHEN product_id % 5 = 2
                THEN '[{{"merchant":"' || store || '","amount":' || cast(price AS string) || ',"path":"' || url || '"}}]'
                WHEN product_id % 5 = 3
                THEN '{{"data":{{"cards":[{{"title":"' || store || '","value":"' || cast(price AS string) || '","link":"' || url || '"}}]}}}}'
                ELSE '{{"offers":[' END AS raw_observation
    FROM {offers_v}"""
VIEWS["rules_v"] = """
    SELECT p_partkey AS rule_id,
           CASE WHEN p_partkey % 33 = 5 THEN 'other' ELSE 'competitor_below_own_price' END AS rule_type,
           CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE NULL END AS product_id,
           CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'main' END AS catalog_source,
           CASE WHEN p_partkey % 3 = 1 THEN lpad(cast(p_partkey AS string), 6, '0')
                WHEN p_partkey % 6 = 0 THEN '000001' ELSE NULL END AS model,
           CASE WHEN p_partkey % 3 = 2 THEN 'MPN-' || cast(p_partkey AS string) ELSE NULL END AS mpn,
           CASE WHEN p_size % 2 = 0 THEN cast(p_size * 12 AS decimal(12,2)) WHEN p_size = 7 THEN cast(-1 AS decimal(12,2)) ELSE NULL END AS threshold_amount,
           CASE WHEN p_size % 3 = 0 THEN cast(p_size AS decimal(12,4)) ELSE NULL END AS threshold_percent,
           p_partkey % 20 <> 0 AS active
    FROM {part}"""
VIEWS["alert_obs_v"] = """
    SELECT observation_id, run_id, created_at, catalog_source, source, model, mpn,
           CASE WHEN match_status = 'matched' THEN product_id ELSE NULL END AS product_id,
           competitor_name, competitor_price, own_price
    FROM {observations_v}"""
VIEWS["old_events_v"] = """
    SELECT DISTINCT 'alert_rule:' || cast(o.product_id AS string) || '|run:' || o.run_id || '|product:'
           || cast(o.product_id AS string) || '|source:market_a' AS dedupe_key, o.run_id AS run_id
    FROM {offers_v} o WHERE o.availability = 'F'"""
VIEWS["actions_v"] = """
    SELECT CASE WHEN p_partkey % 61 = 0 THEN lpad(cast(p_partkey + 1 AS string), 6, '0')
                WHEN p_partkey % 73 = 0 THEN '' WHEN p_partkey % 79 = 0 THEN 'X' || p_name
                ELSE lpad(cast(p_partkey AS string), 6, '0') END AS model,
           CASE p_size % 6 WHEN 0 THEN 'ignore' WHEN 1 THEN 'match_price' WHEN 2 THEN ''
                WHEN 3 THEN 'double' ELSE 'undercut' END AS selected_action,
           CASE WHEN p_size % 12 = 4 THEN NULL ELSE cast(p_size - 10 AS decimal(12,2)) + cast(0.05 AS decimal(12,2)) END AS undercut_amount,
           p_partkey AS seq
    FROM {part}"""
VIEWS["sources_v"] = """
    SELECT page_id AS source_id, cast(floor(page_id / 2) AS bigint) AS product_id,
           CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://cap.example.com/p/' || cast(page_id AS string) END AS url,
           CASE page_id % 3 WHEN 0 THEN 'market_a' WHEN 1 THEN 'market_b' ELSE 'shop' END AS source_name,
           page_id % 6 <> 0 AS active
    FROM {pages}"""

# --------------------------------------------------------------------- reprice
RULES = {
    "offset": {"rule_family": "fixed_offset", "offset": "-1.01", "rounding_mode": "keep_2dp"},
    "discount": {"rule_family": "percentage_discount", "discount_percent": "7.5", "rounding_mode": "keep_2dp"},
    "floor": {"rule_family": "fixed_offset_with_floor", "offset": "-500", "floor": "450.25", "rounding_mode": "floor"},
    "formula": {"rule_family": "formula_with_rounding", "formula": "(observed_price * 0.97) - 0.5",
                "rounding_mode": "minus_one_if_decimal_79_99"},
    "clamp": {"rule_family": "fixed_offset", "offset": "-1500", "rounding_mode": "ceil"},
}
POSITION = {"rule_family": "bestprice_store_positioning", "own_store": " supplier#3 ",
            "target_gap": "0.10", "min_gap": "0.05", "max_gap": "25", "rounding_mode": "nearest"}

_DEDUPED = """d AS (SELECT * FROM (SELECT product_id, store, price, url, offer_key,
                row_number() OVER (PARTITION BY product_id, lower(store), price,
                    CASE WHEN store = '' THEN lower(url) ELSE '' END
                    ORDER BY store <> '' AND url = '', offer_key, url) AS k
              FROM offers_v WHERE price > 0) WHERE k = 1),
     r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, lower(store), url) AS rank FROM d),
     w AS (SELECT product_id, max(store) FILTER (rank = 1) AS best_store, max(price) FILTER (rank = 1) AS best_price,
                  max(url) FILTER (rank = 1) AS best_url, max(store) FILTER (rank = 2) AS next_store,
                  max(price) FILTER (rank = 2) AS next_price, max(url) FILTER (rank = 2) AS next_url,
                  count(*) AS captured_listings_count FROM r GROUP BY product_id)"""


def _best_next(v):
    return L.best_and_next(v.offers_v, ["product_id"], ["offer_key"])


@query(
    "D1_reprice",
    "WITH " + _DEDUPED + """, c AS (SELECT *, cast(best_price * 100 AS bigint) AS b,
            cast(next_price * 100 AS bigint) AS n FROM w),
       t AS (SELECT *, CASE WHEN lower(best_store) <> 'supplier#3' THEN b - 10 WHEN n IS NULL THEN b
                WHEN n - b BETWEEN 5 AND 2500 THEN b ELSE n - 10 END AS target FROM c)
       SELECT product_id, best_store, cast(best_price AS double) AS best_price, next_store,
              cast(next_price AS double) AS next_price, captured_listings_count,
              cast((greatest(target, 0) + 50) // 100 AS varchar) AS new_price FROM t""",
)
def _(v):
    rows = _best_next(v)
    price = P.new_price(
        POSITION, "best_price", best_store=F.col("best_store"), best_price=F.col("best_price"),
        next_price=F.col("next_price"),
    )
    return rows.select(
        "product_id", "best_store", "best_price", "next_store", "next_price",
        "captured_listings_count", price.alias("new_price"),
    )


@query(
    "D2_store_positioning",
    "WITH " + _DEDUPED + """, c AS (SELECT product_id, best_store, cast(best_price * 100 AS bigint) AS b,
            cast(next_price * 100 AS bigint) AS n FROM w)
       SELECT product_id, lower(best_store) = 'supplier#3' AS leads,
              CASE WHEN lower(best_store) <> 'supplier#3' THEN b - 10 WHEN n IS NULL THEN b
                   WHEN n - b BETWEEN 5 AND 2500 THEN b ELSE n - 10 END AS target_cents FROM c""",
)
def _(v):
    target = P.raw_price(
        POSITION, "best_price", best_store=F.col("best_store"), best_price=F.col("best_price"),
        next_price=F.col("next_price"),
    )
    return _best_next(v).select(
        "product_id", (F.lower("best_store") == "supplier#3").alias("leads"),
        (target * 100).cast("bigint").alias("target_cents"),
    )


@query(
    "D1_rule_families",
    """WITH c AS (SELECT offer_key, cast(price * 100 AS bigint) AS c FROM offers_v),
       x AS (SELECT *, greatest(c - 101, 0) AS a, greatest(c * 925, 0) AS n,
                    greatest(c * 97 - 5000, 0) AS f, greatest(c - 150000, 0) AS e FROM c),
       y AS (SELECT *, n // 1000 + CASE WHEN n % 1000 > 500 OR (n % 1000 = 500 AND (n // 1000) % 2 = 1)
                    THEN 1 ELSE 0 END AS d FROM x)
       SELECT offer_key, printf('%d.%02d', a // 100, a % 100) AS p_offset,
              printf('%d.%02d', d // 100, d % 100) AS p_discount,
              cast(greatest(c - 50000, 45025) // 100 AS varchar) AS p_floor,
              cast(f // 10000 + CASE WHEN f % 10000 BETWEEN 7900 AND 9900 THEN 0
                   WHEN f % 10000 >= 5000 THEN 1 ELSE 0 END AS varchar) AS p_formula,
              cast((e + 99) // 100 AS varchar) AS p_clamp FROM y""",
)
def _(v):
    return v.offers_v.select(
        "offer_key", *[P.new_price(rule, "price").alias(f"p_{n}") for n, rule in RULES.items()]
    )


@query(
    "P3_input_validation",
    """SELECT row_no, CASE WHEN trim(model) = '' THEN 'missing required row value: model'
                WHEN trim(mpn) = '' THEN 'missing required row value: mpn'
                WHEN trim(price) = '' THEN 'missing required row value: price'
                WHEN NOT regexp_matches(trim(price), '^[0-9]+[.]?[0-9]*$') THEN 'invalid input price format'
                ELSE '' END AS error_reason,
              CASE WHEN trim(model) <> '' AND trim(mpn) <> '' AND regexp_matches(trim(price), '^[0-9]+[.]?[0-9]*$')
                   THEN cast(trim(price) AS double) END AS parsed_price FROM enriched_v""",
)
def _(v):
    return P.validate_input_rows(v.enriched_v).select("row_no", "error_reason", "parsed_price")


_USABLE = """match_status = 'matched' AND regexp_matches(trim(price), '^[0-9]+[.]?[0-9]*$')
             AND observed_price <> ''"""


@query(
    "P4_enriched_validation",
    f"SELECT row_no, {_USABLE} AS is_usable FROM enriched_v",
)
def _(v):
    return P.validate_enriched_rows(v.enriched_v).select("row_no", "is_usable")


@query(
    "A13_pricing_summary",
    f"""SELECT count(*) AS total_rows, count(*) FILTER ({_USABLE}) AS priced_rows,
               count(*) FILTER (NOT ({_USABLE})) AS blank_new_price_rows FROM enriched_v""",
)
def _(v):
    return P.pricing_summary(P.validate_enriched_rows(v.enriched_v))


@query(
    "IO14_priced_rows",
    f"""WITH p AS (SELECT *, {_USABLE} AS ok, cast(round(try_cast(observed_price AS double) * 100) AS bigint) - 50 AS c FROM enriched_v)
        SELECT model, mpn, CASE WHEN ok THEN cast((greatest(c, 0) + 50) // 100 AS varchar) ELSE price END AS price,
               CASE WHEN ok THEN cast((greatest(c, 0) + 50) // 100 AS varchar) ELSE '' END AS new_price FROM p""",
)
def _(v):
    rule = {"rule_family": "fixed_offset", "offset": "-0.5", "rounding_mode": "nearest"}
    priced = P.price_enriched_rows(P.validate_enriched_rows(v.enriched_v), rule)
    return priced.select("model", "mpn", F.col("output_price").alias("price"), "new_price")


# -------------------------------------------------------------------- listings
@query(
    "W1_ranked_listings",
    "WITH " + _DEDUPED + "SELECT product_id, rank, store, cast(price AS double) AS price, url FROM r",
)
def _(v):
    return L.rank_listings(
        v.offers_v.select("product_id", "store", "price", "url", "offer_key"), ["product_id"], ["offer_key"]
    ).select("product_id", "rank", "store", "price", "url")


@query(
    "W6_next_store",
    "WITH " + _DEDUPED + """SELECT product_id, next_store, cast(next_price AS double) AS next_price,
        cast(next_price - best_price AS double) AS gap FROM w""",
)
def _(v):
    return _best_next(v).select(
        "product_id", "next_store", "next_price", (F.col("next_price") - F.col("best_price")).alias("gap")
    )


@query(
    "S6_top_listings",
    "WITH " + _DEDUPED + """SELECT r.product_id, rank, store, cast(price AS double) AS price,
        captured_listings_count < 3 AS listings_incomplete FROM r JOIN w USING (product_id) WHERE rank <= 3""",
)
def _(v):
    top = L.top_listings(v.offers_v, ["product_id"], ["offer_key"], 3)
    flags = _best_next(v).select("product_id", "listings_incomplete")
    return top.join(flags, "product_id").select("product_id", "rank", "store", "price", "listings_incomplete")


@query(
    "W5_offer_rank",
    """WITH o AS (SELECT *, max(CASE WHEN raw_rank > 0 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY snapshot_id, product_id) AS h FROM snapshot_offers_v WHERE price > 0)
       SELECT snapshot_id, product_id, offer_id, row_number() OVER (PARTITION BY snapshot_id, product_id
            ORDER BY CASE WHEN h = 1 THEN CASE WHEN raw_rank > 0 THEN raw_rank ELSE 1000000 END ELSE 0 END,
                     price, lower(seller_name), offer_id) AS rank FROM o""",
)
def _(v):
    return L.rank_offers(v.snapshot_offers_v, ["snapshot_id", "product_id"], ["offer_id"]).select(
        "snapshot_id", "product_id", "offer_id", "rank"
    )


@query(
    "J8_offers_to_observations",
    """WITH listed AS (SELECT observation_id FROM snapshot_obs_v WHERE source_id = 2),
       j AS (SELECT b.observation_id, o.offer_id, o.price, o.seller_name, o.raw_rank
             FROM snapshot_obs_v b JOIN snapshot_offers_v o
               ON o.snapshot_id = b.snapshot_id AND o.product_id = b.product_id
              AND (b.source_id IS NULL OR b.source_id = o.source_id)
              AND (b.vendor_id IS NULL OR b.vendor_id = o.vendor_id)
             WHERE b.observation_id NOT IN (SELECT observation_id FROM listed) AND o.price > 0),
       h AS (SELECT *, max(CASE WHEN raw_rank > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY observation_id) AS h FROM j)
       SELECT observation_id, offer_id, row_number() OVER (PARTITION BY observation_id
            ORDER BY CASE WHEN h = 1 THEN CASE WHEN raw_rank > 0 THEN raw_rank ELSE 1000000 END ELSE 0 END,
                     price, lower(seller_name), offer_id) AS rank FROM h""",
)
def _(v):
    listed = v.snapshot_obs_v.where("source_id = 2")
    return L.attach_offers(v.snapshot_obs_v, v.snapshot_offers_v, listed).select(
        "observation_id", "offer_id", "rank"
    )


@query(
    "FN47_raw_listings",
    """SELECT offer_key, product_id, store, cast(price AS double) AS price, url,
              CASE WHEN product_id % 5 = 0 THEN cast(price + 2.5 AS double) END AS landed_price,
              CASE WHEN product_id % 5 = 0 THEN 'computed' ELSE 'missing' END AS landed_source
       FROM raw_payloads_v WHERE product_id % 5 <> 4 AND price > 0""",
)
def _(v):
    return L.raw_listings(v.raw_payloads_v.drop("store", "price", "url")).select(
        "offer_key", "product_id", "store", "price", "url",
        F.col("landed.price").alias("landed_price"), F.col("landed.source").alias("landed_source"),
    )


@query(
    "D4_listing_evidence",
    """WITH t AS (
         SELECT product_id, run_id, store, price, url, 0 AS tier FROM offers_v WHERE availability = 'F' AND shipping IS NULL
         UNION ALL SELECT product_id, run_id, store, price, url, 1 FROM offers_v WHERE shipping IS NOT NULL
         UNION ALL SELECT product_id, run_id, store, price, url, 2 FROM raw_payloads_v WHERE product_id % 5 <> 4 AND price > 0 AND url <> ''
         UNION ALL SELECT product_id, run_id, store, price, url, 3 FROM offers_v)
       SELECT product_id, run_id, store, cast(price AS double) AS price, url, cast(tier AS bigint) AS tier FROM t
       QUALIFY tier = min(tier) OVER (PARTITION BY product_id, run_id)""",
)
def _(v):
    cols = ["product_id", "run_id", "store", "price", "url"]
    offers = v.offers_v
    raw = L.raw_listings(v.raw_payloads_v.drop("store", "price", "url")).where("url <> ''")
    tiers = [
        offers.where("availability = 'F' AND shipping IS NULL").select(*cols),
        offers.where("shipping IS NOT NULL").select(*cols),
        raw.select(*cols),
        offers.select(*cols),
    ]
    return L.lowest_tier(tiers, ["product_id", "run_id"]).withColumn("tier", F.col("tier").cast("bigint"))


@query(
    "P10_landed_price",
    """SELECT offer_key, CASE WHEN availability = 'F' AND price > 2000 THEN cast(price AS double)
                WHEN shipping IS NOT NULL THEN cast(price + shipping AS double) END AS landed_price,
              CASE WHEN availability = 'F' AND price > 2000 THEN 'explicit'
                   WHEN shipping IS NOT NULL THEN 'computed' ELSE 'missing' END AS landed_source FROM offers_v""",
)
def _(v):
    explicit = F.when((F.col("availability") == "F") & (F.col("price") > 2000), F.col("price"))
    landed = M.landed_price(F.col("price"), F.col("shipping"), explicit)
    return v.offers_v.select(
        "offer_key", landed["price"].alias("landed_price"), landed["source"].alias("landed_source")
    )


@query(
    "P9_primary_observation",
    """SELECT product_id, cast(price AS double) AS price, 'EUR' AS currency, availability,
              cast(shipping AS double) AS shipping_cost, store AS seller_name,
              'offer_observation_primary_bridge' AS persistence_source FROM offers_v""",
)
def _(v):
    return O.primary_observation(v.offers_v)


# ---------------------------------------------------------------- observations
@query(
    "P5_observation_projection",
    """WITH b AS (SELECT row_no, `Product-Model` AS m, "MPN" AS n, shop, observed_at, url,
              CASE WHEN trim(source) = '' THEN 'market_b' ELSE lower(trim(source)) END AS source,
              CASE WHEN lower(trim(source)) = 'market a' THEN "market_a price" ELSE competitor_price END AS ct,
              price AS ot FROM observation_file_v),
       p AS (SELECT *, try_cast(replace(replace(replace(ct, '€', ''), ' ', ''), ',', '.') AS decimal(12,2)) AS cp,
              try_cast(ot AS decimal(12,2)) AS op FROM b)
       SELECT row_no, source, nullif(m, '') AS model, nullif(n, '') AS mpn, shop AS competitor_name,
              cast(cp AS double) AS competitor_price, 'EUR' AS currency, cast(op AS double) AS own_price,
              cast(op - cp AS double) AS price_delta,
              round(cast((op - cp) * 100 AS double) / cast(op AS double), 4) AS price_delta_percent,
              CASE WHEN observed_at = 'soon' THEN '2024-01-01 00:00:00' ELSE observed_at END AS observed_at,
              concat_ws('|', CASE WHEN m = '' AND n = '' THEN 'missing model and MPN' END,
                  CASE WHEN (m <> '' OR n <> '') AND ct <> '' AND cp IS NULL THEN 'malformed competitor_price' END)
                AS warnings FROM p""".replace("`Product-Model`", '"Product-Model"'),
)
def _(v):
    default = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = O.project_observations(v.observation_file_v, "run-1", "main", "market_b", default)
    return rows.select(
        "row_no", "source", "model", "mpn", "competitor_name", "competitor_price", "currency",
        "own_price", "price_delta", "price_delta_percent",
        F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), "warnings",
    )


@query(
    "P6_own_price_backfill",
    """WITH o AS (SELECT observation_id, run_id, model, mpn, competitor_price,
                 CASE WHEN match_status = 'matched' THEN product_id END AS product_id FROM observations_v),
       m AS (SELECT run_id, model, arg_min(own_price, snapshot_id) FILTER (own_price IS NOT NULL) AS x,
                    min(snapshot_id) AS s FROM snapshots_v WHERE model IS NOT NULL GROUP BY 1, 2),
       m1 AS (SELECT m.run_id, m.model, s.own_price FROM m JOIN snapshots_v s ON s.snapshot_id = m.s),
       n1 AS (SELECT n.run_id, n.mpn, s.own_price FROM (SELECT run_id, mpn, min(snapshot_id) AS s
              FROM snapshots_v WHERE mpn IS NOT NULL GROUP BY 1, 2) n JOIN snapshots_v s ON s.snapshot_id = n.s),
       j AS (SELECT o.*, coalesce(c.price, m1.own_price, n1.own_price) AS op FROM o
             LEFT JOIN catalog_v c ON c.product_id = o.product_id
             LEFT JOIN m1 ON m1.run_id = o.run_id AND m1.model = o.model
             LEFT JOIN n1 ON n1.run_id = o.run_id AND n1.mpn = o.mpn)
       SELECT observation_id, cast(op AS double) AS own_price, cast(op - competitor_price AS double) AS price_delta FROM j""",
)
def _(v):
    obs = v.observations_v.select(
        "observation_id", "run_id", "model", "mpn", "competitor_price",
        F.when(F.col("match_status") == "matched", F.col("product_id")).alias("product_id"),
        F.lit(None).cast("decimal(12,2)").alias("own_price"),
        F.lit(None).cast("decimal(12,2)").alias("price_delta"),
        F.lit(None).cast("decimal(12,4)").alias("price_delta_percent"),
    )
    products = v.catalog_v.select("product_id", F.col("price").alias("current_price"))
    return O.backfill_own_price(obs, products, v.snapshots_v).select(
        "observation_id", "own_price", "price_delta"
    )


@query(
    "P7_fill_blank_fields",
    """WITH f AS (SELECT trim(model) AS model, trim(mpn) AS mpn, name, manufacturer, row_no FROM product_file_v),
       a AS (SELECT model, arg_max(name, row_no) AS name, arg_max(manufacturer, row_no) AS manufacturer FROM f WHERE model <> '' GROUP BY 1),
       b AS (SELECT mpn, arg_max(name, row_no) AS name, arg_max(manufacturer, row_no) AS manufacturer FROM f WHERE mpn <> '' GROUP BY 1)
       SELECT c.product_id, CASE WHEN trim(c.name) = '' AND trim(CASE WHEN a.model IS NOT NULL THEN a.name ELSE b.name END) <> ''
                   THEN CASE WHEN a.model IS NOT NULL THEN a.name ELSE b.name END ELSE c.name END AS name,
              CASE WHEN trim(c.manufacturer) = '' AND trim(CASE WHEN a.model IS NOT NULL THEN a.manufacturer ELSE b.manufacturer END) <> ''
                   THEN CASE WHEN a.model IS NOT NULL THEN a.manufacturer ELSE b.manufacturer END ELSE c.manufacturer END AS manufacturer
       FROM catalog_raw_v c LEFT JOIN a ON a.model = trim(c.model) LEFT JOIN b ON b.mpn = trim(c.mpn)""",
)
def _(v):
    run_input = v.product_file_v.withColumn("manufacturer", F.concat("manufacturer", F.lit("")))
    return O.fill_blank_fields(v.catalog_raw_v, run_input, ["name", "manufacturer"], "row_no").select(
        "product_id", "name", "manufacturer"
    )


@query(
    "P8_timestamp_provenance",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'manual' WHEN event_type = 'view' THEN 'parsed_at'
                WHEN event_type = 'click' THEN 'fetched_at' WHEN value > 50 THEN 'imported_at' ELSE 'created_at' END AS source,
              CASE WHEN event_type IN ('view', 'click') THEN 'exact' ELSE 'derived' END AS quality FROM events""",
)
def _(v):
    kind = F.col("event_type")
    made = O.timestamp_provenance(
        F.when(kind == "signup", "manual"), F.when(kind == "signup", "derived"),
        parsed_at=F.when(kind == "view", F.col("ts")), fetched_at=F.when(kind == "click", F.col("ts")),
        imported_at=F.when(F.col("value") > 50, F.col("ts")),
    )
    return v.events.select("event_id", made["source"].alias("source"), made["quality"].alias("quality"))


@query(
    "J1_observation_to_product",
    """WITH a AS (SELECT model, min(product_id) AS id FROM stored_products_v WHERE model IS NOT NULL GROUP BY 1),
            b AS (SELECT mpn, min(product_id) AS id FROM stored_products_v WHERE mpn IS NOT NULL GROUP BY 1)
       SELECT o.observation_id, coalesce(a.id, b.id) AS matched_product_id,
              CASE WHEN a.id IS NOT NULL THEN 'model' WHEN b.id IS NOT NULL THEN 'mpn' END AS matched_by
       FROM observations_v o LEFT JOIN a ON a.model = o.model LEFT JOIN b ON b.mpn = o.mpn""",
)
def _(v):
    products = v.stored_products_v.withColumn("catalog_source", F.lit("main"))
    return O.match_observations(v.observations_v, products).select(
        "observation_id", "matched_product_id", "matched_by"
    )


@query(
    "F5_observation_filter",
    """SELECT observation_id FROM observations_v WHERE source = 'market_a' AND catalog_source = 'main'
       AND match_status = 'matched'""",
)
def _(v):
    wanted = O.observation_predicates(source="market_a", catalog_source="main", include_unmatched=False)
    return O.filter_all(v.observations_v, wanted).select("observation_id")


@query(
    "W2_best_observation",
    """SELECT mpn, observation_id, cast(competitor_price AS double) AS competitor_price FROM observations_v
       WHERE mpn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mpn ORDER BY
         coalesce(competitor_price, 0) <= 0, CASE WHEN competitor_price > 0 THEN competitor_price END NULLS FIRST, observation_id) = 1""",
)
def _(v):
    return O.best_observation(v.observations_v, "mpn", "observation_id").select(
        "mpn", "observation_id", "competitor_price"
    )


@query(
    "W3_latest_attempt",
    """SELECT observation_id FROM observations_v o
       WHERE created_at = (SELECT max(created_at) FROM observations_v x WHERE x.run_id = o.run_id)""",
)
def _(v):
    return O.latest_attempt(v.observations_v).select("observation_id")


@query(
    "A9_attempt_counts",
    """WITH m AS (SELECT run_id, max(created_at) AS created_at FROM observations_v GROUP BY 1)
       SELECT run_id, count(*) FILTER (match_status = 'matched') AS matched,
              count(*) FILTER (match_status = 'unmatched') AS unmatched
       FROM observations_v SEMI JOIN m USING (run_id, created_at) GROUP BY run_id""",
)
def _(v):
    return O.attempt_counts(v.observations_v)


@query(
    "A10_refetch_counts",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id, product_id, seller_id ORDER BY attempt DESC, observation_id) = 1 AS newest
                  FROM (SELECT *, split_part(observation_id, '/', 4) AS seller_id FROM observations_v)),
       b AS (SELECT run_id, max(attempt) AS last, count(*) AS n FROM o WHERE NOT newest GROUP BY 1),
       i AS (SELECT run_id, count(*) AS c, count(*) FILTER (match_status = 'matched') AS m,
                    count(*) FILTER (match_status = 'unmatched') AS u FROM o WHERE newest GROUP BY 1)
       SELECT i.run_id, c AS observation_count, m AS matched, u AS unmatched,
              coalesce(n, 0) AS replaced_observation_count, coalesce(n, 0) > 0 AS was_refetch,
              cast(coalesce(last, 0) + 1 AS bigint) AS fetch_attempt
       FROM i LEFT JOIN b USING (run_id)""",
)
def _(v):
    # The newest attempt per run, product and seller is the incoming one; it replaces the others.
    seller = F.element_at(F.split("observation_id", "/"), 4)
    newest = Window.partitionBy("run_id", "product_id", seller).orderBy(F.desc("attempt"), "observation_id")
    obs = v.observations_v.withColumn("n", F.row_number().over(newest))
    return O.refetch_counts(obs.where("n > 1").drop("n"), obs.where("n = 1").drop("n"))


@query(
    "S3_newest_observations",
    "SELECT observation_id, created_at FROM observations_v ORDER BY created_at DESC, observation_id DESC LIMIT 100 OFFSET 20",
)
def _(v):
    return O.newest_first(v.observations_v, 100, 20).select("observation_id", "created_at")


@query(
    "S3_observations_deep",
    "SELECT observation_id, created_at FROM observations_v ORDER BY created_at DESC, observation_id DESC LIMIT 100 OFFSET 20000",
)
def _(v):
    """Observations from place 20,000 on, newest first; only the ranges that hold them are read."""
    listed = PG.PagedResult(v.observations_v.select("observation_id", "created_at"), [F.desc("created_at"), F.desc("observation_id")])
    return listed.slice(20_000, 100)


@query(
    "S4_price_history",
    """SELECT observation_id, created_at, cast(competitor_price AS double) AS competitor_price FROM observations_v
       WHERE model = '000007' ORDER BY created_at DESC, observation_id DESC LIMIT 1000""",
)
def _(v):
    return O.price_history(v.observations_v, model="000007").select(
        "observation_id", "created_at", "competitor_price"
    )


@query(
    "S5_listings_of_run",
    """SELECT offer_id AS listing_id, cast(price AS double) AS price FROM snapshot_offers_v
       WHERE snapshot_id = '1998-05/2' ORDER BY price NULLS LAST, coalesce(raw_rank, 0), offer_id LIMIT 5000""",
)
def _(v):
    listings = v.snapshot_offers_v.select(
        F.concat_ws("/", "snapshot_id", F.col("product_id").cast("string")).alias("observation_id"),
        F.col("offer_id").alias("listing_id"), "price", F.coalesce("raw_rank", F.lit(0)).alias("rank"),
    )
    known = v.snapshot_obs_v.select("observation_id").where("startswith(observation_id, '1998-05/2/')")
    return O.listings_of(listings, known).select("listing_id", "price")


@query(
    "J7_input_to_observation",
    """WITH o AS (SELECT *, coalesce(competitor_price, 0) <= 0 AS bad FROM observations_v),
       a AS (SELECT * FROM o WHERE model IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY bad, CASE WHEN NOT bad THEN competitor_price END NULLS FIRST, observation_id) = 1),
       b AS (SELECT * FROM o WHERE mpn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mpn ORDER BY bad, CASE WHEN NOT bad THEN competitor_price END NULLS FIRST, observation_id) = 1)
       SELECT c.product_id, coalesce(a.observation_id, b.observation_id) AS observation_id,
              CASE WHEN a.observation_id IS NOT NULL THEN 'model' WHEN b.observation_id IS NOT NULL THEN 'mpn' END AS matched_by
       FROM catalog_v c LEFT JOIN a ON a.model = c.model LEFT JOIN b ON b.mpn = nullif(c.mpn, '')""",
)
def _(v):
    run_input = v.catalog_v.select("product_id", "model", "mpn")
    return O.observations_for_input(run_input, v.observations_v, "observation_id").select(
        "product_id", "observation_id", "matched_by"
    )


# ---------------------------------------------------------------------- review
def _review(v):
    rows = v.catalog_v.select(
        "product_id", "model", "mpn", F.col("price").alias("current_price")
    ).join(_best_next(v), "product_id", "left")
    return O.review_rows(rows)


_REVIEW = _DEDUPED + """, v AS (SELECT c.product_id, c.model, c.price AS cur, c.is_atomic_model, w.*,
        coalesce(c.price > 0, false) AS own_ok, coalesce(best_price > 0, false) AS comp_ok,
        coalesce(abs(c.price - best_price) <= 0.05 AND next_price IS NOT NULL, false) AS nb
      FROM catalog_v c LEFT JOIN w ON w.product_id = c.product_id),
     x AS (SELECT product_id, model, cur, best_price AS competitor_price, is_atomic_model, own_ok, comp_ok,
        CASE WHEN own_ok AND comp_ok THEN cur - CASE WHEN nb THEN next_price ELSE best_price END END AS delta,
        CASE WHEN own_ok AND comp_ok THEN CASE WHEN nb THEN 'next_store' ELSE 'best_competitor' END END AS delta_basis,
        CASE WHEN NOT comp_ok OR cur IS NULL OR cur <= best_price THEN 'ignore' ELSE 'match_price' END AS recommended_action,
        CASE WHEN comp_ok THEN 'review_required' ELSE 'not_exportable' END AS status FROM v)"""


@query(
    "D3_review_rows",
    "WITH " + _REVIEW + """SELECT product_id, cast(competitor_price AS double) AS competitor_price,
        cast(delta AS double) AS price_delta, round(cast(delta * 100 AS double) / cast(cur AS double), 4) AS price_delta_percent,
        delta_basis, recommended_action, status,
        concat_ws('|', CASE WHEN NOT is_atomic_model THEN 'composite_or_invalid_model' END,
            CASE WHEN NOT own_ok THEN 'missing_or_invalid_current_price' END,
            CASE WHEN NOT comp_ok THEN 'missing_or_invalid_competitor_price' END) AS warnings FROM x""",
)
def _(v):
    return _review(v).select(
        "product_id", "competitor_price", "price_delta", "price_delta_percent", "delta_basis",
        "recommended_action", "status", "warnings",
    )


_CHECKED = _REVIEW + """, n AS (SELECT model, count(*) AS times FROM actions_v GROUP BY 1),
     k AS (SELECT a.*, x.competitor_price AS p, x.model IS NOT NULL AS known, times FROM actions_v a
           JOIN n USING (model) LEFT JOIN x ON x.model = a.model),
     ch AS (SELECT *, CASE WHEN model = '' THEN 'model is required' WHEN selected_action = '' THEN 'selected_action is required'
          WHEN selected_action NOT IN ('match_price', 'undercut', 'ignore') THEN 'unsupported action'
          WHEN selected_action = 'undercut' AND undercut_amount IS NULL THEN 'undercut_amount is required'
          WHEN selected_action = 'undercut' AND undercut_amount <= 0 THEN 'undercut_amount must be positive'
          WHEN times > 1 THEN 'duplicate action' WHEN NOT known THEN 'unknown model'
          WHEN NOT regexp_matches(model, '^[0-9]{6}$') THEN 'non-atomic model'
          WHEN selected_action <> 'ignore' AND NOT coalesce(p > 0, false) THEN 'no valid competitor price'
          WHEN selected_action = 'undercut' AND NOT coalesce(p - undercut_amount > 0, false) THEN 'target price not positive'
          END AS reject_reason FROM k),
     ap AS (SELECT x.*, c.selected_action, CASE c.selected_action WHEN 'match_price' THEN x.competitor_price
                 WHEN 'undercut' THEN x.competitor_price - c.undercut_amount END AS target_price,
                 CASE WHEN c.selected_action = 'ignore' THEN 'ignored' WHEN c.selected_action IS NOT NULL THEN 'exportable'
                      ELSE x.status END AS new_status
            FROM x LEFT JOIN ch c ON c.model = x.model AND c.reject_reason IS NULL)"""


@query("J17_action_check", "WITH " + _CHECKED + "SELECT seq, model, selected_action, reject_reason FROM ch")
def _(v):
    return O.check_actions(v.actions_v, _review(v)).select("seq", "model", "selected_action", "reject_reason")


def _applied(v):
    rows = _review(v)
    return O.apply_actions(rows, O.check_actions(v.actions_v, rows))


@query(
    "D5_apply_actions",
    "WITH " + _CHECKED + """SELECT product_id, selected_action, cast(target_price AS double) AS target_price,
        new_status AS status FROM ap""",
)
def _(v):
    return _applied(v).select("product_id", "selected_action", "target_price", "status")


@query(
    "D6_recommended_actions",
    "WITH " + _REVIEW + """SELECT model,
        CASE WHEN status <> 'not_exportable' OR recommended_action = 'ignore' THEN recommended_action ELSE '' END AS selected_action,
        CASE WHEN recommended_action = 'ignore' THEN 'manual ignore from price review' ELSE '' END AS reason FROM x""",
)
def _(v):
    return O.recommended_actions(_review(v))


@query(
    "A11_review_totals",
    "WITH " + _CHECKED + """SELECT count(*) AS total, count(*) FILTER (new_status = 'review_required') AS review_required,
        count(*) FILTER (new_status = 'not_exportable') AS not_exportable,
        count(*) FILTER (new_status = 'exportable') AS exportable,
        count(*) FILTER (new_status = 'ignored') AS ignored FROM ap""",
)
def _(v):
    return O.review_totals(_applied(v))


@query(
    "F11_export_gate",
    "WITH " + _CHECKED + """SELECT model, cast(target_price AS varchar) AS price FROM ap
        WHERE selected_action IN ('match_price', 'undercut') AND is_atomic_model AND target_price > 0
          AND model NOT IN (SELECT model FROM ignored_raw_v)""",
)
def _(v):
    return O.export_rows(_applied(v), v.ignored_raw_v)


# ---------------------------------------------------------------------- alerts
_RAISED = """b AS (SELECT *, own_price - competitor_price AS delta,
        round(cast((own_price - competitor_price) * 100 AS double) / cast(own_price AS double), 4) AS dp
      FROM alert_obs_v WHERE competitor_price < own_price),
     q AS (SELECT * FROM rules_v WHERE active AND rule_type = 'competitor_below_own_price'),
     p AS (SELECT b.*, rule_id, threshold_amount, threshold_percent FROM b JOIN q ON q.product_id = b.product_id
       UNION ALL SELECT b.*, rule_id, threshold_amount, threshold_percent FROM b JOIN q ON q.product_id IS NULL AND q.model IS NOT NULL
            AND q.catalog_source = b.catalog_source AND q.model = b.model
       UNION ALL SELECT b.*, rule_id, threshold_amount, threshold_percent FROM b JOIN q ON q.product_id IS NULL AND q.model IS NULL
            AND q.catalog_source = b.catalog_source AND q.mpn = b.mpn),
     a AS (SELECT *, 'alert_rule:' || rule_id || '|run:' || run_id || '|' ||
             CASE WHEN product_id IS NOT NULL THEN 'product:' || product_id
                  WHEN model IS NOT NULL THEN 'catalog_model:' || catalog_source || ':' || model
                  WHEN mpn IS NOT NULL THEN 'catalog_mpn:' || catalog_source || ':' || mpn
                  ELSE 'observation:' || observation_id END || '|source:' || source AS dedupe_key
           FROM p WHERE (threshold_amount IS NULL OR delta >= threshold_amount)
                    AND (threshold_percent IS NULL OR dp >= threshold_percent))"""


@query(
    "J9_rules_to_observations",
    "WITH " + _RAISED + "SELECT rule_id, observation_id FROM p",
)
def _(v):
    below = v.alert_obs_v.where("competitor_price < own_price")
    active = v.rules_v.where("active AND rule_type = 'competitor_below_own_price'")
    return O.alert_pairs(below, active).select("rule_id", "observation_id")


@query(
    "D7_alerts",
    "WITH " + _RAISED + """SELECT rule_id, observation_id, dedupe_key, cast(delta AS double) AS delta,
        'Competitor price is below own price for ' || coalesce(model, mpn, 'product ' || product_id) || ': own EUR '
        || cast(own_price AS varchar) || ' vs competitor EUR ' || cast(competitor_price AS varchar) || '.' AS message FROM a""",
)
def _(v):
    return O.alert_rows(v.alert_obs_v, v.rules_v).select(
        "rule_id", "observation_id", "dedupe_key", "delta", "message"
    )


@query(
    "U10_new_alert_events",
    "WITH " + _RAISED + """SELECT dedupe_key, min(observation_id) AS observation_id, 'open' AS status FROM a
        WHERE dedupe_key NOT IN (SELECT dedupe_key FROM old_events_v) GROUP BY dedupe_key""",
)
def _(v):
    return O.new_alert_events(v.alert_obs_v, v.rules_v, v.old_events_v).select(
        "dedupe_key", "observation_id", "status"
    )


@query(
    "D7_alert_evaluation",
    "WITH " + _RAISED + """, e AS (SELECT DISTINCT dedupe_key FROM a WHERE dedupe_key NOT IN (SELECT dedupe_key FROM old_events_v))
        SELECT (SELECT count(*) FROM rules_v WHERE active) AS evaluated_rule_count,
               (SELECT count(*) FROM rules_v WHERE active AND rule_type = 'other') AS unsupported_rule_count,
               (SELECT count(*) FROM e) AS created_event_count,
               (SELECT count(*) FROM a) - (SELECT count(*) FROM e) AS duplicate_event_count""",
)
def _(v):
    return O.alert_evaluation(v.alert_obs_v, v.rules_v, v.old_events_v)


@query(
    "U10_event_status",
    """WITH q AS (SELECT dedupe_key, arg_max(status, seq) AS status FROM (
          SELECT dedupe_key, 'acknowledged' AS status, 1 AS seq FROM old_events_v WHERE run_id < '1998-01'
          UNION ALL SELECT dedupe_key, 'resolved', 2 FROM old_events_v WHERE run_id < '1996-06') GROUP BY 1)
       SELECT e.dedupe_key, coalesce(q.status, 'open') AS status FROM old_events_v e LEFT JOIN q USING (dedupe_key)""",
)
def _(v):
    old = v.old_events_v
    ask = lambda until, status, seq: old.where(F.col("run_id") < until).select(
        "dedupe_key", F.lit(status).alias("status"), F.lit(seq).alias("seq")
    )
    requests = ask("1998-01", "acknowledged", 1).unionByName(ask("1996-06", "resolved", 2))
    return O.set_event_status(old.withColumn("status", F.lit("open")), requests).drop("run_id")


@query(
    "F14_alert_rule_check",
    """SELECT rule_id, CASE WHEN rule_type <> 'competitor_below_own_price' THEN 'unsupported rule_type'
          WHEN product_id IS NULL AND NOT (coalesce(catalog_source, '') <> '' AND (coalesce(model, '') <> '' OR coalesce(mpn, '') <> '')) THEN 'rule target missing'
          WHEN threshold_amount <= 0 THEN 'threshold_amount must be positive' END AS reject_reason
       FROM rules_v WHERE active""",
)
def _(v):
    return O.validate_alert_rules(v.rules_v.where("active")).select("rule_id", "reject_reason")


# ------------------------------------------------------------------- selection
def _reasons(v):
    excluded = v.stored_products_v.where("NOT active AND manufacturer = 'Brand#7'").select("model").where("model IS NOT NULL")
    return O.skip_reasons(v.catalog_v.where("active"), v.ignored_raw_v, excluded)


_REASONS = """e AS (SELECT DISTINCT model FROM stored_products_v WHERE NOT active AND manufacturer = 'Brand#7' AND model IS NOT NULL),
     s AS (SELECT product_id, model, concat_ws('|', CASE WHEN model IN (SELECT model FROM e) THEN 'explicitly_excluded' END,
            CASE WHEN model IN (SELECT model FROM ignored_raw_v) THEN 'ignored' END,
            CASE WHEN NOT is_atomic_model THEN 'non_atomic_model' END,
            CASE WHEN status IS DISTINCT FROM 1 THEN 'inactive' END, CASE WHEN mpn = '' THEN 'missing_mpn' END,
            CASE WHEN NOT coalesce(price > 0, false) THEN 'missing_or_invalid_price' END) AS reasons
          FROM catalog_v WHERE active)"""
_COVERAGE = """u AS (SELECT product_id, count(*) FILTER (status = 'active') AS a, count(*) FILTER (status = 'needs_review') AS n,
            count(*) FILTER (status = 'broken') AS b, count(*) FILTER (status = 'disabled') AS d FROM urls_v GROUP BY 1),
     x AS (SELECT product_id, count(DISTINCT url) AS x FROM sources_v o WHERE active AND NOT EXISTS
            (SELECT 1 FROM urls_v q WHERE q.product_id = o.product_id AND q.url = o.url AND q.status = 'active') GROUP BY 1),
     cv AS (SELECT s.product_id, coalesce(a, 0) + coalesce(x, 0) AS active_urls, coalesce(n, 0) AS needs_review_urls,
            coalesce(b, 0) AS broken_urls, coalesce(d, 0) AS disabled_urls, cast(0 AS bigint) AS redirected_urls,
            coalesce(a, 0) + coalesce(x, 0) > 0 AS has_active_url
          FROM s LEFT JOIN u ON u.product_id = s.product_id LEFT JOIN x ON x.product_id = s.product_id WHERE reasons = '')"""


@query("F4_skip_reasons", "WITH " + _REASONS + "SELECT product_id, reasons FROM s")
def _(v):
    return _reasons(v).select("product_id", "reasons")


@query(
    "F3_monitoring_filter",
    """SELECT product_id FROM catalog_v WHERE active AND manufacturer = 'Brand#3' AND mpn <> ''
       AND (market_a_status = 1 AND market_b_status = 1)""",
)
def _(v):
    f = CatalogFilter(manufacturer="Brand#3", has_mpn=True, market="both")
    return filter_catalog(v.catalog_v.where("active"), f).select("product_id")


@query(
    "A12_skipped_by_reason",
    "WITH " + _REASONS + """SELECT reason, count(*) AS products FROM
        (SELECT unnest(string_split(reasons, '|')) AS reason FROM s WHERE reasons <> '') GROUP BY 1""",
)
def _(v):
    return O.skipped_by_reason(_reasons(v))


def _coverage(v):
    selected = _reasons(v).where(F.size("reasons") == 0).select("product_id")
    return O.product_url_coverage(selected, v.urls_v, v.sources_v)


@query("J10_url_coverage", "WITH " + _REASONS + "," + _COVERAGE + "SELECT * FROM cv")
def _(v):
    return _coverage(v)


@query(
    "A8_coverage_totals",
    "WITH " + _REASONS + "," + _COVERAGE + """SELECT count(*) AS selected_count, count(*) FILTER (has_active_url) AS with_active,
        count(*) FILTER (NOT has_active_url) AS without_active, cast(sum(active_urls) AS bigint) AS active_urls,
        cast(sum(needs_review_urls) AS bigint) AS needs_review_urls, cast(sum(broken_urls) AS bigint) AS broken_urls,
        cast(sum(disabled_urls) AS bigint) AS disabled_urls, cast(sum(redirected_urls) AS bigint) AS redirected_urls,
        round_even(count(*) FILTER (has_active_url) * 100.0::double / count(*), 2) AS coverage_percent FROM cv""",
)
def _(v):
    return O.coverage_totals(_coverage(v))


@query(
    "D8_selection_gate",
    "WITH " + _REASONS + "," + _COVERAGE + """SELECT s.product_id, CASE WHEN reasons <> '' THEN reasons
        WHEN has_active_url THEN '' ELSE 'missing_active_source_url' END AS reasons,
        reasons = '' AND has_active_url AS selected FROM s LEFT JOIN cv ON cv.product_id = s.product_id""".replace(
        "reasons = '' AND has_active_url AS", "coalesce(reasons = '' AND has_active_url, false) AS"
    ),
)
def _(v):
    return O.coverage_gate(_reasons(v), _coverage(v)).select("product_id", "reasons", "selected")


# ------------------------------------------------------------------ run tables
@query(
    "U11_missing_snapshots",
    """WITH n AS (SELECT run_id, offer_key, catalog_source, CASE WHEN model <> '' THEN 'model:' || model
                    WHEN mpn <> '' THEN 'mpn:' || mpn END AS identity
                  FROM offers_v JOIN (SELECT product_id, catalog_source, CASE WHEN product_id % 9 = 0 THEN '' ELSE model END AS model, mpn FROM catalog_v) USING (product_id)),
       old AS (SELECT DISTINCT run_id FROM snapshots_v WHERE run_id < '1997-01')
       SELECT run_id, identity, min(offer_key) AS offer_key FROM n
       WHERE identity IS NOT NULL AND run_id NOT IN (SELECT run_id FROM old) GROUP BY run_id, catalog_source, identity""",
)
def _(v):
    catalog = v.catalog_v.select(
        "product_id", "catalog_source", "mpn",
        F.when(F.col("product_id") % 9 == 0, "").otherwise(F.col("model")).alias("model"),
    )
    rows = v.offers_v.select("run_id", "offer_key", "product_id").join(catalog, "product_id")
    old = v.snapshots_v.where("run_id < '1997-01'")
    return O.add_missing_snapshots(rows, old, "offer_key").select("run_id", "identity", "offer_key")


@query(
    "A35_run_persistence_counts",
    """WITH o AS (SELECT run_id, count(*) AS observations, count(*) FILTER (match_status = 'matched') AS matched,
              count(*) FILTER (match_status = 'unmatched') AS unmatched FROM observations_v GROUP BY 1),
       e AS (SELECT run_id, count(*) AS n FROM old_events_v GROUP BY 1)
       SELECT run_id, observations, matched, unmatched, coalesce(n, 0) AS alert_events FROM o LEFT JOIN e USING (run_id)""",
)
def _(v):
    return O.persistence_counts(v.observations_v, v.old_events_v)


_NOW = "2024-01-20 00:00:00"


@query(
    "A24_job_backlog",
    f"""SELECT job_type, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running,
              count(*) FILTER (status = 'running' AND heartbeat_at <= TIMESTAMP '{_NOW}' - to_minutes(CASE job_type
                  WHEN 'click' THEN 14400 WHEN 'view' THEN 5 ELSE 60 END)) AS stale,
              strftime(min(heartbeat_at) FILTER (status = 'queued'), '%Y-%m-%d %H:%M:%S') AS oldest_queued
       FROM jobs_v GROUP BY job_type""",
)
def _(v):
    now = F.lit(_NOW).cast("timestamp_ntz")
    backlog = O.job_backlog(v.jobs_v, now, {"click": 14400, "view": 5})
    return backlog.withColumn("oldest_queued", F.date_format("oldest_queued", "yyyy-MM-dd HH:mm:ss"))


@query(
    "FN46_age_text",
    """WITH s AS (SELECT event_id, cast(floor(value * 5000) AS bigint) AS s FROM events)
       SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h'
              WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
              WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS age FROM s""",
)
def _(v):
    return v.events.select("event_id", O.age_text(F.floor(F.col("value") * 5000)).alias("age"))
