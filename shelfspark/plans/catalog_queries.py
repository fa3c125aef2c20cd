"""Catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import catalog as C
from shelfspark.operators import paging as PG
from shelfspark.plans.registry import query
from shelfspark.plans.views import VIEWS, spark_view

VIEWS["ignored_raw_v"] = """
    SELECT s_suppkey AS seq,
           lpad(cast(cast(floor(s_suppkey / 2) AS bigint) * 9 AS string), 6, '0') AS model,
           s_name AS name, 'slow mover ' || cast(s_nationkey AS string) AS reason
    FROM {supplier}"""
# The catalog as stored before the import: some models are outdated.
VIEWS["stored_catalog_v"] = """
    SELECT CASE WHEN product_id % 23 = 0 THEN 'OLD' || model ELSE model END AS model,
           mpn, name || ' (old)' AS name, price, product_id % 59 <> 0 AS active
    FROM {catalog_raw_v}"""
# The import file: some models are blank, some name the next product's model.
VIEWS["import_file_v"] = """
    SELECT product_id AS row_no,
           CASE WHEN product_id % 101 = 0 THEN ' '
                WHEN product_id % 97 = 0 OR product_id % 97 = 96
                THEN 'M' || cast(cast(floor((product_id + 1) / 97) AS bigint) AS string)
                WHEN product_id % 89 = 0 THEN lpad(cast(product_id - 1 AS string), 6, '0')
                ELSE model END AS model,
           mpn, name, price
    FROM {catalog_raw_v}"""
VIEWS["stored_products_v"] = """
    SELECT product_id, CASE WHEN product_id % 9 = 0 THEN NULL ELSE trim(model) END AS model,
           nullif(trim(mpn), '') AS mpn, name || ' (old)' AS name, manufacturer,
           product_id % 8 <> 0 AS active
    FROM {catalog_raw_v}"""
VIEWS["product_file_v"] = """
    SELECT product_id AS row_no,
           CASE WHEN product_id % 9 = 0 OR product_id % 14 = 0 THEN ''
                WHEN product_id % 25 = 0 THEN 'NEW' || cast(product_id AS string)
                ELSE trim(model) END AS model,
           trim(mpn) AS mpn, name, manufacturer
    FROM {catalog_raw_v}"""


@spark_view("catalog_v")
def _catalog(v):
    return C.type_catalog(v.catalog_raw_v).select(
        "product_id", F.lit("main").alias("catalog_source"), "model", "mpn", "name", "category",
        "raw_category", "family", "category_name", "sub_category", "category_levels",
        "manufacturer", "price", "quantity", "status", "market_a_status", "market_b_status",
        "is_atomic_model", "automation_eligible", "warnings",
        (F.col("product_id") % 59 != 0).alias("active"),
    )


def _active(v):
    return v.catalog_v.where("active")


@query(
    "P1_catalog_row_typing",
    """SELECT product_id, model, mpn, name, family, category_name, sub_category,
              CASE WHEN category = '' THEN '' WHEN NOT contains(category, '///') THEN family
                   ELSE family || '|' || category_name || '|' || sub_category END AS category_levels,
              cast(price AS double) AS price, cast(quantity AS bigint) AS quantity,
              cast(status AS bigint) AS status, is_atomic_model, automation_eligible,
              concat_ws('|', CASE WHEN NOT is_atomic_model THEN 'composite_or_invalid_model' END,
                        CASE WHEN mpn = '' THEN 'missing_mpn' END) AS warnings
       FROM catalog_v""",
)
def _(v):
    return v.catalog_v.select(
        "product_id", "model", "mpn", "name", "family", "category_name", "sub_category",
        "category_levels", "price", "quantity", "status", "is_atomic_model",
        "automation_eligible", "warnings",
    )


@query(
    "P2_atomic_model",
    """SELECT regexp_matches(trim(model), '^[0-9]{6}$') AS atomic, count(*) AS products
       FROM catalog_raw_v GROUP BY 1""",
)
def _(v):
    return v.catalog_raw_v.groupBy(C.is_atomic_model(F.col("model")).alias("atomic")).agg(
        F.count(F.lit(1)).alias("products")
    )


@query(
    "F1_catalog_filter",
    """SELECT product_id, model, name FROM catalog_v
       WHERE active AND (contains(lower(model), 'ring') OR contains(lower(mpn), 'ring')
             OR contains(lower(name), 'ring') OR contains(lower(manufacturer), 'ring'))
         AND (market_a_status = 1) AND mpn <> '' AND status = 1 AND quantity > 0 AND is_atomic_model
         AND model NOT IN (SELECT trim(model) FROM ignored_raw_v)""",
)
def _(v):
    f = C.CatalogFilter(
        q=" RING ", market="a", has_mpn=True, has_quantity=True, atomic_only=True, ignored="exclude"
    )
    return C.filter_catalog(_active(v), f, v.urls_v, v.ignored_raw_v).select("product_id", "model", "name")


@query(
    "F1_facet_filter",
    """SELECT product_id, family, manufacturer FROM catalog_v
       WHERE active AND family = 'PROMO' AND automation_eligible
         AND model NOT IN (SELECT trim(model) FROM ignored_raw_v)
         AND product_id IN (SELECT product_id FROM urls_v WHERE status = 'active')""",
)
def _(v):
    f = C.CatalogFilter(family="PROMO", automation_eligible_only=True, has_source_url=True)
    return C.filter_catalog(_active(v), f, v.urls_v, v.ignored_raw_v).select(
        "product_id", "family", "manufacturer"
    )


@query(
    "F2_market_predicate",
    """SELECT kind, count(*) AS products FROM (
         SELECT unnest(list_filter([
             CASE WHEN market_a_status = 1 THEN 'a' END,
             CASE WHEN market_b_status = 1 THEN 'b' END,
             CASE WHEN market_a_status = 1 AND market_b_status = 1 THEN 'both' END,
             CASE WHEN coalesce(market_a_status, 0) <> 1 AND coalesce(market_b_status, 0) <> 1
                  THEN 'none' END], lambda x: x IS NOT NULL)) AS kind FROM catalog_v) GROUP BY kind""",
)
def _(v):
    kinds = C.labels(*[(C.market_predicate(k), k) for k in ("a", "b", "both", "none")])
    return v.catalog_v.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("products")
    )


@query(
    "F15_selection_blocker",
    """WITH n AS (SELECT product_id, count(*) FILTER (status = 'active') AS a,
                         count(*) FILTER (status = 'needs_review') AS r FROM urls_v GROUP BY 1)
       SELECT c.product_id, c.model,
              CASE WHEN NOT automation_eligible AND NOT is_atomic_model THEN 'Composite'
                   WHEN NOT automation_eligible AND mpn = '' THEN 'Missing MPN'
                   WHEN c.model IN (SELECT model FROM ignored_raw_v) THEN 'Ignored'
                   WHEN coalesce(a, 0) > 0 THEN NULL
                   WHEN coalesce(r, 0) > 0 THEN 'Source URL review'
                   ELSE 'Missing source URL' END AS blocker,
              concat_ws('|', CASE WHEN status <> 1 THEN 'Disabled' END,
                        CASE WHEN NOT coalesce(price > 0, false) THEN 'Zero price' END)
                AS warning_badges
       FROM catalog_v c LEFT JOIN n ON n.product_id = c.product_id""",
)
def _(v):
    counts = v.urls_v.groupBy("product_id").agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
    )
    return C.selection_state(v.catalog_v, counts, v.ignored_raw_v)


@query(
    "J4_products_with_active_url",
    """SELECT product_id, model FROM catalog_v c WHERE active AND EXISTS
         (SELECT 1 FROM urls_v u WHERE u.product_id = c.product_id AND u.status = 'active')""",
)
def _(v):
    return C.with_active_url(_active(v), v.urls_v, True).select("product_id", "model")


@query(
    "J4_products_without_active_url",
    """SELECT product_id, model FROM catalog_v c WHERE active AND NOT EXISTS
         (SELECT 1 FROM urls_v u WHERE u.product_id = c.product_id AND u.status = 'active'
          AND lower(u.source_name) = 'shop')""",
)
def _(v):
    return C.with_active_url(_active(v), v.urls_v, False, "Shop").select("product_id", "model")


@query(
    "J5_ignored_only",
    """SELECT product_id, model FROM catalog_v WHERE active
       AND model IN (SELECT model FROM ignored_raw_v)""",
)
def _(v):
    return C.filter_catalog(
        _active(v), C.CatalogFilter(ignored="only"), ignored=v.ignored_raw_v
    ).select("product_id", "model")


@query(
    "J6_exclude_models",
    """SELECT product_id, model FROM catalog_raw_v
       WHERE trim(model) = '' OR trim(model) NOT IN (SELECT trim(model) FROM ignored_raw_v)""",
)
def _(v):
    return C.exclude_models(v.catalog_raw_v, v.ignored_raw_v).select("product_id", "model")


@query(
    "J29_warehouse_lookup",
    """WITH w AS (SELECT trim(model) AS model, count(*) AS hits, min(trim(name)) AS name
                  FROM import_file_v GROUP BY 1)
       SELECT c.product_id, c.model,
              CASE WHEN hits IS NULL THEN 'not_found' WHEN hits > 1 THEN 'duplicate'
                   WHEN w.name = '' THEN 'empty_name' ELSE 'found' END AS state,
              CASE WHEN hits = 1 AND w.name <> '' THEN w.name END AS warehouse_name
       FROM catalog_v c LEFT JOIN w ON w.model = c.model""",
)
def _(v):
    return C.lookup_by_model(v.catalog_v.select("product_id", "model"), v.import_file_v)


@query(
    "A1_catalog_summary",
    """SELECT count(*) AS total_products,
              count(*) FILTER (status = 1) AS active_products,
              count(*) FILTER (is_atomic_model) AS atomic_products,
              count(*) FILTER (NOT is_atomic_model) AS composite_or_invalid_models,
              count(*) FILTER (market_a_status = 1) AS market_a_products,
              count(*) FILTER (market_b_status = 1) AS market_b_products,
              count(*) FILTER (mpn = '') AS missing_mpn,
              count(DISTINCT nullif(category, '')) AS category_count,
              count(DISTINCT nullif(family, '')) AS family_count,
              count(DISTINCT nullif(category_name, '')) AS category_name_count,
              count(DISTINCT nullif(sub_category, '')) AS sub_category_count,
              count(DISTINCT nullif(manufacturer, '')) AS manufacturer_count
       FROM catalog_v WHERE active""",
)
def _(v):
    return C.catalog_summary(_active(v))


@query(
    "A2_brand_facets",
    """SELECT manufacturer, count(*) AS count FROM catalog_v
       WHERE active AND manufacturer <> '' GROUP BY 1""",
)
def _(v):
    return C.facet_counts(_active(v), "manufacturer")


@query(
    "A3_category_facets",
    """SELECT category, count(*) AS count, arg_min(family, product_id) AS family,
              arg_min(category_name, product_id) AS category_name,
              arg_min(sub_category, product_id) AS sub_category
       FROM catalog_v WHERE active AND category <> '' GROUP BY category""",
)
def _(v):
    return C.category_facets(_active(v)).drop("raw_category", "category_levels")


@query(
    "A4_category_hierarchy",
    """WITH r AS (SELECT family, category_name, sub_category, raw_category, count(*) AS count,
                         grouping(family, category_name, sub_category, raw_category) AS g
                  FROM catalog_v WHERE active AND family <> ''
                  GROUP BY ROLLUP (family, category_name, sub_category, raw_category))
       SELECT CASE g WHEN 7 THEN 'family' WHEN 3 THEN 'category' WHEN 1 THEN 'sub_category'
                     ELSE 'raw_category' END AS level,
              family, category_name, sub_category, raw_category, count
       FROM r WHERE g < 15 AND (g <> 0 OR raw_category <> '')""",
)
def _(v):
    return C.category_hierarchy(_active(v))


@query(
    "A15_active_count",
    """SELECT count(*) AS active_products, max(run_id) AS latest_import
       FROM catalog_v c JOIN (SELECT product_id, max(run_id) AS run_id FROM offers_v GROUP BY 1) o
         ON o.product_id = c.product_id WHERE active""",
)
def _(v):
    seen = v.offers_v.groupBy("product_id").agg(F.max("run_id").alias("run_id"))
    return C.active_count_and_import(v.catalog_v.join(seen, "product_id"), "run_id")


_PAGE_SQL = "SELECT product_id, name, cast(price AS double) AS price FROM catalog_v WHERE active "


@query("S1_catalog_sort_asc", _PAGE_SQL + "ORDER BY lower(name) ASC NULLS LAST, product_id LIMIT 50")
def _(v):
    return C.catalog_page(_active(v), 1, 50, "name").select("product_id", "name", "price")


@query("S1_catalog_sort_desc", _PAGE_SQL + "ORDER BY price DESC NULLS FIRST, product_id LIMIT 120")
def _(v):
    return C.catalog_page(_active(v), 1, 120, "price", descending=True).select(
        "product_id", "name", "price"
    )


@query(
    "S2_catalog_page",
    _PAGE_SQL + "AND mpn <> '' ORDER BY price ASC NULLS LAST, product_id LIMIT 25 OFFSET 50",
)
def _(v):
    filtered = C.filter_catalog(_active(v), C.CatalogFilter(has_mpn=True))
    return C.catalog_page(filtered, 3, 25, "price").select("product_id", "name", "price")


@query(
    "S2_catalog_deep_page",
    _PAGE_SQL + "ORDER BY price ASC NULLS LAST, product_id LIMIT 25 OFFSET 1000",
)
def _(v):
    """Page 41, of which only the ranges that hold it are read."""
    active = _active(v).select("product_id", "name", "price")
    return PG.PagedResult(active, C.catalog_order("price")).page(41, 25)


@query(
    "S1_last_page_desc",
    _PAGE_SQL + "ORDER BY lower(name) DESC NULLS FIRST, product_id LIMIT 30 OFFSET greatest(0, (SELECT count(*) FROM catalog_v WHERE active) - 30)",
)
def _(v):
    """The end of the list by name, descending."""
    listed = PG.PagedResult(_active(v).select("product_id", "name", "price"), C.catalog_order("name", descending=True))
    return listed.slice(max(0, listed.total - 30), 30)


@query(
    "S2_catalog_page_totals",
    """SELECT count(*) AS total, count(*) FILTER (mpn <> '' AND market_b_status = 1)
         AS filtered_total FROM catalog_v WHERE active""",
)
def _(v):
    return C.page_totals(_active(v), C.CatalogFilter(has_mpn=True, market="b"))


_MERGE_SQL = """WITH f AS (SELECT trim(model) AS model, count(*) AS file_rows,
                         arg_max(name, row_no) AS name, arg_max(price, row_no) AS price
                  FROM import_file_v WHERE trim(model) <> '' GROUP BY 1),
       m AS (SELECT coalesce(s.model, f.model) AS model,
                CASE WHEN f.model IS NOT NULL AND s.model IS NOT NULL THEN 'updated'
                     WHEN f.model IS NOT NULL AND file_rows > 1 THEN 'quarantined'
                     WHEN f.model IS NOT NULL THEN 'inserted'
                     WHEN s.active THEN 'inactivated' ELSE 'unchanged' END AS action,
                coalesce(file_rows, 0) AS file_rows,
                coalesce(f.name, s.name) AS name, coalesce(f.price, s.price) AS price
             FROM stored_catalog_v s FULL OUTER JOIN f ON f.model = s.model)
"""


def _merged(v):
    return C.merge_catalog(v.stored_catalog_v, v.import_file_v)


@query(
    "U1_catalog_merge",
    _MERGE_SQL + """SELECT model, action, file_rows, name, price,
       action IN ('updated', 'inserted') AS active FROM m""",
)
def _(v):
    return _merged(v).drop("mpn")


@query(
    "A14_ingest_result",
    _MERGE_SQL + """SELECT cast(sum(file_rows) AS bigint) AS imported,
        cast(sum(file_rows) FILTER (action = 'inserted') AS bigint) AS inserted,
        cast(sum(file_rows) FILTER (action = 'updated') AS bigint) AS updated,
        cast(coalesce(sum(file_rows) FILTER (action = 'quarantined'), 0) AS bigint) AS quarantined,
        count(*) FILTER (action = 'inactivated') AS inactive_or_missing,
        (SELECT count(*) FROM import_file_v WHERE trim(model) = '') AS skipped_invalid FROM m""",
)
def _(v):
    return C.ingest_result(_merged(v), v.import_file_v)


@query(
    "SO3_models_missing_from_file",
    """SELECT model FROM stored_catalog_v WHERE active
       EXCEPT ALL (SELECT s.model FROM stored_catalog_v s
                   WHERE active AND model IN (SELECT trim(model) FROM import_file_v))""",
)
def _(v):
    return C.missing_models(v.stored_catalog_v, v.import_file_v).select("model")


@query(
    "U2_product_upsert",
    """WITH inc AS (SELECT nullif(model, '') AS model, nullif(mpn, '') AS mpn, row_no, name,
                           manufacturer FROM product_file_v WHERE model <> '' OR mpn <> ''),
       one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY
                   CASE WHEN model IS NOT NULL THEN 'model:' || model ELSE 'mpn:' || mpn END
                   ORDER BY row_no DESC) AS rn FROM inc) WHERE rn = 1),
       aimed AS (SELECT one.*, CASE WHEN one.model IS NOT NULL
                   THEN (SELECT min(product_id) FROM stored_products_v s WHERE s.model = one.model)
                   ELSE (SELECT min(product_id) FROM stored_products_v s WHERE s.mpn = one.mpn)
                   END AS target FROM one),
       hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY row_no DESC)
                   AS r2 FROM aimed WHERE target IS NOT NULL) WHERE r2 = 1)
       SELECT s.product_id, coalesce(h.model, s.model) AS model, coalesce(h.mpn, s.mpn) AS mpn,
              CASE WHEN h.target IS NULL THEN s.name ELSE h.name END AS name,
              CASE WHEN h.target IS NULL THEN s.manufacturer ELSE h.manufacturer END AS manufacturer,
              h.target IS NOT NULL OR s.active AS active,
              CASE WHEN h.target IS NULL THEN 'unchanged' ELSE 'updated' END AS action
       FROM stored_products_v s LEFT JOIN hits h ON h.target = s.product_id
       UNION ALL
       SELECT NULL, model, mpn, name, manufacturer, true, 'inserted' FROM aimed WHERE target IS NULL""",
)
def _(v):
    return C.upsert_products(v.stored_products_v, v.product_file_v)


@query(
    "U9_ignore_upsert",
    """WITH old AS (SELECT model, arg_max(name, seq) AS name, arg_max(reason, seq) AS reason
                    FROM ignored_raw_v GROUP BY model),
       new AS (SELECT model, name, 'manual ignore' AS reason FROM catalog_v
               WHERE status <> 1 AND is_atomic_model)
       SELECT model, name, reason FROM new UNION ALL
       SELECT model, name, reason FROM old WHERE model NOT IN (SELECT model FROM new)""",
)
def _(v):
    old = C.last_per_model(v.ignored_raw_v, "seq").drop("seq")
    new = v.catalog_v.where("status <> 1 AND is_atomic_model").select(
        "model", "name", F.lit("manual ignore").alias("reason")
    )
    return C.upsert_by_model(old, new)


@query(
    "U14_purge_excluded",
    """WITH x AS (SELECT DISTINCT trim(model) AS model FROM ignored_raw_v)
       SELECT 'catalog' AS table_name, count(*) AS n FROM catalog_v SEMI JOIN x USING (model)
       UNION ALL SELECT 'source_urls', count(*) FROM urls_v JOIN catalog_v USING (product_id)
         SEMI JOIN x USING (model)
       UNION ALL SELECT 'products', count(*) FROM (SELECT model FROM stored_products_v
         WHERE active) SEMI JOIN x USING (model)""",
)
def _(v):
    urls = v.urls_v.join(v.catalog_v.select("product_id", "model"), "product_id")
    _, report = C.purge_models(
        {"catalog": v.catalog_v, "source_urls": urls}, v.stored_products_v, v.ignored_raw_v
    )
    return report


@query(
    "SO6_requested_models",
    """WITH req AS (SELECT seq AS position, trim(model) AS model FROM ignored_raw_v)
       SELECT model, min(position) AS position, any_value(product_id) AS product_id
       FROM req JOIN catalog_v USING (model) GROUP BY model""",
)
def _(v):
    requested = v.ignored_raw_v.select(F.col("seq").alias("position"), "model")
    return C.model_batch_order(requested, v.catalog_v, ["product_id"])


@query(
    "IO9_ignore_list",
    """SELECT model, max(seq) AS seq, arg_max(name, seq) AS name, arg_max(reason, seq) AS reason
       FROM ignored_raw_v GROUP BY model""",
)
def _(v):
    return C.last_per_model(v.ignored_raw_v, "seq")
