"""Change-planning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfspark.operators import changes as X
from shelfspark.operators import snapshots as SN
from shelfspark.operators.skew import multiset_hash
from shelfspark.plans.registry import query
from shelfspark.plans.views import VIEWS
from shelfspark.session import shared_dir

# What a candidate run proposes for the exported catalog.
VIEWS["proposed_v"] = """
    SELECT CASE WHEN k % 37 = 0 THEN 'N' || model ELSE model END AS model, k,
           CASE k % 9 WHEN 1 THEN name || ' new' ELSE '  ' || name END AS name, category || CASE k % 9 WHEN 2 THEN '///X' ELSE '' END AS category,
           CASE k % 9 WHEN 3 THEN NULL ELSE meta_title END AS meta_title, CASE WHEN k % 4 = 0 THEN 'KX' || cast(1000 + k AS string) WHEN k % 4 = 1 THEN 'ZZ1' ELSE mpn END AS mpn,
           CASE k % 9 WHEN 5 THEN '1.00' ELSE price END AS price, CASE k % 9 WHEN 6 THEN 'Other#1' WHEN 7 THEN 'Brand#3' ELSE manufacturer END AS manufacturer,
           CASE k % 9 WHEN 8 THEN seo_keyword || '-2' ELSE seo_keyword END AS seo_keyword,
           'https://shop.example.com/' || seo_keyword || CASE k % 9 WHEN 8 THEN '-2/' ELSE '/' END AS canonical_url, mpn_status
    FROM (SELECT *, cast(model AS int) AS k FROM {export_v})"""
VIEWS["approvals_v"] = """
    SELECT CASE WHEN k % 23 = 0 THEN 'bad' ELSE model END AS model, CASE WHEN k % 29 = 0 THEN 'snap-0' ELSE 'snap-1' END AS snapshot_id,
           'run-1' AS run_id, split('name~category~manufacturer' || CASE WHEN k % 5 = 0 THEN '~name' WHEN k % 7 = 0 THEN '~color' WHEN k % 11 = 0 THEN '~price' ELSE '' END, '~') AS approved_fields
    FROM (SELECT *, cast(model AS int) AS k FROM {export_v})"""

_FIELDS = ["name", "category", "meta_title", "mpn", "price", "manufacturer", "description"]


def _current(v):
    return v.export_v.select("model", "name", "category", "meta_title", "mpn", "price", "manufacturer")


def _plan(v):
    return X.field_plan(_current(v), v.proposed_v.drop("k", "seo_keyword", "canonical_url"), _FIELDS)


_PLAN = """j AS (SELECT c.model, p.k, p.mpn_status, unnest(['name', 'category', 'meta_title', 'mpn', 'price', 'manufacturer', 'description']) AS field,
        unnest([c.name, c.category, c.meta_title, c.mpn, c.price, c.manufacturer, NULL]) AS o, unnest([p.name, p.category, p.meta_title, p.mpn, p.price, p.manufacturer, NULL]) AS n
      FROM export_v c JOIN proposed_v p ON p.model = c.model),
     q AS (SELECT *, trim(o) = trim(n) AS eq FROM j),
     l AS (SELECT *, CASE WHEN n IS NULL OR o IS NULL THEN 'unavailable' WHEN eq THEN 'unchanged' WHEN field = 'price' THEN 'blocked'
          WHEN field = 'mpn' AND ((o <> '' AND n <> '') OR (n <> '' AND mpn_status <> 'verified')) THEN 'blocked'
          WHEN field IN ('name', 'meta_title') THEN 'safe_content_update' ELSE 'review_required' END AS classification FROM q)"""


@query(
    "D31_field_plan",
    "WITH " + _PLAN + """SELECT model, field, classification, CASE WHEN n IS NULL THEN 'candidate_field_unavailable' WHEN o IS NULL THEN 'published_field_unavailable_in_snapshot' WHEN eq THEN 'values_match'
        WHEN field = 'price' THEN 'price_changes_are_outside_seo_migration_scope' WHEN field = 'mpn' AND o <> '' AND n <> '' THEN 'identifier_conflict_existing_mpn_differs'
        WHEN field = 'mpn' AND n <> '' AND mpn_status <> 'verified' THEN 'identifier_provenance_not_verified' WHEN field = 'mpn' THEN 'identifier_addition_requires_review'
        WHEN field = 'category' THEN 'taxonomy_change_requires_operator_review' WHEN field = 'manufacturer' THEN 'change_requires_operator_review' ELSE 'content_candidate_differs_and_is_approval_eligible' END AS reason,
        CASE WHEN classification IN ('safe_content_update', 'review_required') THEN 'approved_fields:' || field ELSE 'none' END AS approval_requirement,
        sha256(coalesce(o, chr(0))) AS current_hash FROM l""",
)
def _(v):
    return _plan(v).select("model", "field", "classification", "reason", "approval_requirement", "current_hash")


@query("A28_plan_totals", "WITH " + _PLAN + "SELECT classification, count(*) AS fields FROM l GROUP BY 1")
def _(v):
    return X.plan_totals(_plan(v))


@query(
    "J16_plan_sides",
    """SELECT model, 'missing_candidate' AS side FROM export_v WHERE model NOT IN (SELECT model FROM proposed_v)
       UNION ALL SELECT model, 'candidate_only' FROM proposed_v WHERE model NOT IN (SELECT model FROM export_v)""",
)
def _(v):
    return X.plan_sides(v.export_v, v.proposed_v)


@query(
    "D32_redirects",
    """SELECT c.model, '/p/' || c.model::int AS old_path, '/' || p.seo_keyword AS new_path, 301::bigint AS status_code
       FROM export_v c JOIN proposed_v p ON p.model = c.model""",
)
def _(v):
    current = v.export_v.withColumn("canonical_url", F.col("product_url"))
    return X.redirect_candidates(current, v.proposed_v)


@query(
    "D32_image_candidates",
    """SELECT model, 1::bigint AS position, 'main' AS role, image AS current_path, CASE WHEN model::int % 3 = 0 THEN image ELSE 'new/' || model || '-1.jpg' END AS candidate_path,
          CASE WHEN model::int % 3 = 0 THEN 'unchanged' ELSE 'review_required' END AS classification FROM export_v
       UNION ALL SELECT model, 2, 'gallery', CASE WHEN model::int % 2 = 0 THEN 'b.jpg' ELSE '' END, 'new/' || model || '-2.jpg', 'review_required' FROM export_v""",
)
def _(v):
    k = F.col("model").cast("int")
    current = v.export_v.select("model", F.when(k % 2 == 0, F.array("image", F.lit("b.jpg"))).otherwise(F.array("image")).alias("gallery"))
    new = lambda n: F.concat(F.lit("new/"), "model", F.lit(f"-{n}.jpg"))
    candidate = v.export_v.select("model", F.array(F.when(k % 3 == 0, F.col("image")).otherwise(new(1)), new(2)).alias("gallery"))
    return X.image_candidates(current, candidate)


@query(
    "D32_rollback_rows",
    "WITH " + _PLAN + "SELECT model, field, n AS expected_value, o AS restore_value FROM l WHERE classification IN ('safe_content_update', 'review_required')",
)
def _(v):
    return X.rollback_rows(_plan(v)).drop("restore_hash")


@query(
    "D33_approval_check",
    """WITH r AS (SELECT a.*, unnest(approved_fields) AS field FROM approvals_v a), m AS (SELECT model, count(*) AS t FROM approvals_v GROUP BY 1), f AS (SELECT model, field, count(*) AS u FROM r GROUP BY 1, 2)
       SELECT r.model, r.field, CASE WHEN snapshot_id <> 'snap-1' THEN 'snapshot_mismatch' WHEN r.model = 'bad' THEN 'model_not_six_digits' WHEN t > 1 THEN 'duplicate_model'
          WHEN r.field = 'color' THEN 'unknown_field' WHEN u > 1 THEN 'duplicate_field' END AS error FROM r JOIN m ON m.model = r.model JOIN f ON f.model = r.model AND f.field = r.field""",
)
def _(v):
    return X.approval_errors(v.approvals_v, "snap-1", "run-1")


_PATCH = _PLAN + """, q2 AS (SELECT DISTINCT model, unnest(approved_fields) AS field FROM approvals_v),
     pt AS (SELECT q2.model, q2.field, l.n AS candidate_value, CASE WHEN l.classification IS NULL THEN 'absent_from_plan'
          WHEN l.classification NOT IN ('safe_content_update', 'review_required') THEN 'not_writable:' || l.classification
          WHEN q2.field = 'category' AND trim(l.n) NOT IN (SELECT category FROM export_v) THEN 'value_not_in_catalog'
          WHEN q2.field = 'manufacturer' AND trim(l.n) NOT IN (SELECT manufacturer FROM export_v) THEN 'value_not_in_catalog' END AS refused
        FROM q2 LEFT JOIN l ON l.model = q2.model AND l.field = q2.field)"""


@query("D34_approved_patch", "WITH " + _PATCH + "SELECT * FROM pt")
def _(v):
    return X.approved_patch(_plan(v), v.approvals_v, v.export_v)


@query("J25_plan_to_approvals", "WITH " + _PATCH + "SELECT field, count(*) FILTER (refused IS NULL) AS accepted, count(*) FILTER (refused IS NOT NULL) AS refused FROM pt GROUP BY 1")
def _(v):
    patch = X.approved_patch(_plan(v), v.approvals_v, v.export_v)
    return patch.groupBy("field").agg(
        F.count_if(F.col("refused").isNull()).alias("accepted"), F.count_if(F.col("refused").isNotNull()).alias("refused")
    )


@query(
    "D42_rollback_check",
    "WITH " + _PLAN + """, r AS (SELECT model, k, field, n, o FROM l WHERE classification IN ('safe_content_update', 'review_required')),
       c AS (SELECT r.*, CASE k % 5 WHEN 0 THEN o WHEN 1 THEN 'manual' ELSE n END AS now FROM r)
       SELECT model, field, CASE WHEN k % 7 = 0 THEN 'missing' WHEN now = n THEN 'restore' WHEN now = o THEN 'noop' ELSE 'mismatch' END AS action FROM c""",
)
def _(v):
    p = v.proposed_v
    both = _current(v).join(v.export_v.select("model", "status"), "model").join(p.select("model", "k", *[F.col(f).alias(f"p_{f}") for f in _FIELDS[:-1]]), "model").where("status <> '0'")
    now = lambda f: F.when(F.col("k") % 5 == 0, F.col(f)).when(F.col("k") % 5 == 1, "manual").otherwise(F.col(f"p_{f}")).alias(f)
    return X.rollback_check(X.rollback_rows(_plan(v)), both.select("model", *[now(f) for f in _FIELDS[:-1]]))


# ------------------------------------------------------------------ monitoring
def _context(v):
    k = F.col("model").cast("int")
    return v.export_v.select(
        "model", (k % 2 == 0).alias("approved_slug"), F.lit(False).alias("approved_images"),
        F.when(k % 6 != 0, F.lit(80)).alias("score_before"), (F.lit(80) - k % 3 + 1).alias("score_after"), (k % 4).alias("blocking_failures"),
        F.when(k % 7 == 0, "1.0").otherwise(F.col("price")).alias("offer_price"), F.lit("in_stock").alias("offer_availability"),
        F.lit("").alias("catalog_availability"), (k % 8 != 0).alias("has_structured_data"), F.lit(1).alias("duplicates_before"),
        (k % 3).alias("duplicates_after"), F.when(k % 5 != 0, k % 2).alias("live_failed"), F.lit(0).alias("live_not_run"), F.lit(True).alias("rollback_ready"),
    )


def _findings(v):
    k = F.col("model").cast("int")
    cols = ["model", "name", "mpn", "price", "seo_keyword", "image"]
    before = v.export_v.select(*cols)
    after = v.export_v.withColumns({
        "name": F.when(k % 9 == 1, "changed").otherwise(F.col("name")),
        "seo_keyword": F.when(k % 9 < 2, "moved").otherwise(F.col("seo_keyword")),
        "image": F.when(k % 11 == 0, "new.jpg").otherwise(F.col("image")),
    }).where("status <> '0'").select(*cols)
    expected = v.export_v.withColumn("seo_keyword", F.when(k % 9 == 0, "moved").when(k % 9 == 1, "moved").otherwise(F.col("seo_keyword"))).select(*cols)
    return X.monitoring_findings(before, after, expected, _context(v))


_FINDINGS = """e AS (SELECT *, model::int AS k, status <> '0' AS has FROM export_v),
     f AS (SELECT model, unnest([
       {'f': 'seo_health.blocking_failures', 's': CASE WHEN k % 4 = 0 THEN 'pass' ELSE 'fail' END, 'b': true},
       {'f': 'seo_health.score_regression', 's': CASE WHEN k % 6 = 0 THEN 'not_run' WHEN k % 3 = 2 THEN 'warn' ELSE 'pass' END, 'b': false},
       {'f': 'rollout.unapproved_field_change', 's': CASE WHEN NOT has THEN 'not_run' WHEN k % 9 = 1 THEN 'fail' ELSE 'pass' END, 'b': true},
       {'f': 'rollout.unexpected_slug_change', 's': CASE WHEN NOT has THEN 'not_run' WHEN k % 9 < 2 AND k % 2 = 1 THEN 'fail' ELSE 'pass' END, 'b': true},
       {'f': 'rollout.image_path_regression', 's': CASE WHEN NOT has THEN 'not_run' WHEN k % 11 = 0 THEN 'fail' ELSE 'pass' END, 'b': true},
       {'f': 'identifiers.missing', 's': CASE WHEN NOT has THEN 'not_run' WHEN mpn = '' THEN 'fail' ELSE 'warn' END, 'b': false},
       {'f': 'structured_data.price_schema_mismatch', 's': CASE WHEN NOT has OR k % 8 = 0 THEN 'not_run' WHEN k % 7 = 0 OR price = '' THEN 'fail' ELSE 'pass' END, 'b': false},
       {'f': 'structured_data.artifact_availability', 's': CASE WHEN k % 8 = 0 THEN 'fail' ELSE 'pass' END, 'b': false},
       {'f': 'content.duplicate_increase', 's': CASE WHEN k % 3 = 2 THEN 'warn' ELSE 'pass' END, 'b': false},
       {'f': 'rollout.live_validation', 's': CASE WHEN k % 5 = 0 THEN 'not_run' WHEN k % 2 = 1 THEN 'fail' ELSE 'pass' END, 'b': false},
       {'f': 'rollout.rollback_available', 's': 'pass', 'b': true}]) AS x FROM e)"""


@query("D35_monitoring_findings", "WITH " + _FINDINGS + "SELECT model, x.f AS finding, x.s AS status, x.b AND x.s = 'fail' AS blocking FROM f")
def _(v):
    return _findings(v)


@query(
    "A30_monitoring_report",
    "WITH " + _FINDINGS + """SELECT model, count(*) AS findings, count(*) FILTER (x.s = 'pass') AS pass, count(*) FILTER (x.s = 'warn') AS warn, count(*) FILTER (x.s = 'fail') AS fail,
        0::bigint AS not_applicable, count(*) FILTER (x.s = 'not_run') AS not_run, count(*) FILTER (x.b AND x.s = 'fail') AS blocking,
        CASE WHEN count(*) FILTER (x.s = 'fail') > 0 THEN 'fail' ELSE 'warn' END AS state FROM f GROUP BY 1""",
)
def _(v):
    return X.monitoring_report(_findings(v))


@query(
    "A29_score_changes",
    """WITH s AS (SELECT l_partkey AS model, sum(l_linenumber)::bigint AS b, sum(l_quantity)::bigint AS a, count(*) FILTER (l_returnflag = 'A') AS bl FROM lineitem GROUP BY 1)
       SELECT count(*) AS products, round(avg(b), 2) AS mean_before, round(avg(a), 2) AS mean_after, count(*) FILTER (a < b) AS regressions, sum(bl)::bigint AS blocking_failures FROM s""",
)
def _(v):
    g = v.lineitem.groupBy(F.col("l_partkey").alias("model")).agg(
        F.sum("l_linenumber").alias("before"), F.sum("l_quantity").cast("bigint").alias("after"),
        F.count_if(F.col("l_returnflag") == "A").alias("blocking_failures"),
    )
    return X.score_changes(
        g.select("model", F.col("before").alias("score")), g.select("model", F.col("after").alias("score"), "blocking_failures")
    )


VIEWS["live_pages_v"] = """
    SELECT model, CASE WHEN k % 12 = 0 THEN 404 ELSE 200 END AS status_code, product_url || CASE WHEN k % 5 = 0 THEN '/?utm_source=x' WHEN k % 7 = 0 THEN '/moved' ELSE '' END AS final_url,
           '<title>' || CASE WHEN k % 3 = 0 THEN 'Other' ELSE ' ' || meta_title END || '</title><link rel="canonical" href="' || product_url || CASE WHEN k % 4 = 0 THEN '-x' ELSE '/' END
           || '"><meta content="' || meta_description || '" name="description"><h1> <b>' || name || '</b></h1><img src="' || CASE WHEN k % 6 = 0 THEN 'none.jpg' ELSE image END
           || '"><script type="application/ld+json">[{{"@type":"Product","mpn":"' || lower(mpn) || '","offers":[{{"price":"' || CASE WHEN k % 9 = 0 THEN '1' ELSE price END || '"}}]}}]</script>' AS html
    FROM (SELECT *, cast(model AS int) AS k FROM {export_v})"""


@query(
    "D36_page_checks",
    """WITH e AS (SELECT *, model::int AS k FROM export_v), c AS (SELECT model, unnest([
       {'f': 'live.http_success', 's': CASE WHEN k % 12 = 0 THEN 'fail' ELSE 'pass' END}, {'f': 'live.final_url', 's': CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'fail' ELSE 'pass' END},
       {'f': 'live.canonical_url', 's': CASE WHEN k % 4 = 0 THEN 'fail' ELSE 'pass' END}, {'f': 'live.title', 's': CASE WHEN k % 3 = 0 THEN 'fail' ELSE 'pass' END},
       {'f': 'live.meta_description', 's': 'pass'}, {'f': 'live.visible_h1', 's': 'pass'}, {'f': 'live.main_image', 's': CASE WHEN k % 6 = 0 THEN 'fail' ELSE 'pass' END},
       {'f': 'live.price', 's': CASE WHEN price = '' THEN 'not_run' WHEN k % 9 = 0 THEN 'fail' ELSE 'pass' END}, {'f': 'live.mpn', 's': CASE WHEN mpn = '' THEN 'not_run' ELSE 'pass' END}]) AS x FROM e)
       SELECT model, x.f AS "check", x.s AS status FROM c""",
)
def _(v):
    expected = v.export_v.select(
        "model", "product_url", F.lit("").alias("canonical_url"), "meta_title", "meta_description", F.col("name").alias("h1"), "image", "price", "mpn"
    )
    return X.page_checks(v.live_pages_v, expected)


# ------------------------------------------------------------------- snapshots
@query(
    "A37_content_hash",
    """WITH d AS (SELECT sha256(p_partkey || chr(31) || p_name || chr(31) || p_brand || chr(31) || p_type) AS h FROM part),
       s AS (SELECT count(*) AS n, """ + ", ".join(
        f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint::hugeint) AS s{i}" for i in range(4)
    ) + """ FROM d) SELECT n AS row_count, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS content_hash FROM s""",
)
def _(v):
    return multiset_hash(v.part, ["p_partkey", "p_name", "p_brand", "p_type"])


@query(
    "D37_snapshot",
    "SELECT model, sha256(model || chr(31) || category || chr(31) || manufacturer || chr(31) || name) AS row_hash FROM export_v",
)
def _(v):
    return X.build_snapshot(v.export_v.select("model", "name", "manufacturer", "category")).select("model", "row_hash")


@query(
    "D37_verify_snapshot",
    """SELECT coalesce(a.model, b.model) AS model, CASE WHEN b.model IS NULL THEN 'added' WHEN a.model IS NULL THEN 'removed' WHEN a.name = b.name AND a.manufacturer = b.manufacturer THEN 'same' ELSE 'changed' END AS state
       FROM export_after_v a FULL OUTER JOIN export_v b ON b.model = a.model""",
)
def _(v):
    stored = X.build_snapshot(v.export_v.select("model", "name", "manufacturer"))
    return X.verify_snapshot(v.export_after_v.select("model", "name", "manufacturer"), stored)


@query(
    "D37_verify_stored_snapshot",
    """SELECT coalesce(a.model, b.model) AS model, CASE WHEN b.model IS NULL THEN 'added' WHEN a.model IS NULL THEN 'removed' WHEN a.name = b.name AND a.manufacturer = b.manufacturer THEN 'same' ELSE 'changed' END AS state
       FROM export_after_v a FULL OUTER JOIN export_v b ON b.model = a.model""",
)
def _(v):
    """The stored snapshot, of which only the leaves that differ are read."""
    path = f"{shared_dir(v.spark)}/shelfspark-snapshot-{uuid.uuid4().hex}"
    SN.store_snapshot(v.export_v.select("model", "name", "manufacturer"), path)
    return SN.verify_stored(v.export_after_v.select("model", "name", "manufacturer"), path)


@query(
    "A37_stored_root",
    "SELECT count(*) AS row_count FROM export_v",
)
def _(v):
    path = f"{shared_dir(v.spark)}/shelfspark-snapshot-{uuid.uuid4().hex}"
    SN.store_snapshot(v.export_v.select("model", "name", "manufacturer"), path)
    return SN.stored_root(v.spark, path).select("row_count")


@query(
    "D37_field_inventory",
    "SELECT 'mpn' AS field, count(*) FILTER (mpn <> '') AS filled, count(*) AS rows FROM export_v UNION ALL SELECT 'price', count(*) FILTER (price <> ''), count(*) FROM export_v",
)
def _(v):
    return X.field_inventory(v.export_v.select("model", "mpn", "price"))


@query(
    "W17_canary",
    """WITH k AS (SELECT model, status, model::int AS k FROM export_v),
       c AS (SELECT model, status = '1' AS act, (status = '1')::int + 2 * (status = '0')::int + 4 * (k % 3 = 0)::int + 8 * (k % 3 <> 0)::int + 16 * (k % 5 = 0)::int
                + 32 * (k % 5 <> 0)::int + 64 * (k % 17 = 0)::int + 128 * (k % 17 <> 0)::int AS mask FROM k),
       s1 AS (SELECT 1 AS place, model, mask AS seen, [model] AS done FROM c ORDER BY bit_count(mask) DESC, act DESC, model LIMIT 1),
       s2 AS (SELECT 2 AS place, c.model, seen | c.mask AS seen, list_append(done, c.model) AS done FROM c, s1 WHERE NOT list_contains(done, c.model)
             ORDER BY bit_count(c.mask & ~seen) DESC, act DESC, c.model LIMIT 1),
       s3 AS (SELECT 3 AS place, c.model, seen | c.mask AS seen, list_append(done, c.model) AS done FROM c, s2 WHERE NOT list_contains(done, c.model)
             ORDER BY bit_count(c.mask & ~seen) DESC, act DESC, c.model LIMIT 1),
       s4 AS (SELECT 4 AS place, c.model, seen | c.mask AS seen, list_append(done, c.model) AS done FROM c, s3 WHERE NOT list_contains(done, c.model)
             ORDER BY bit_count(c.mask & ~seen) DESC, act DESC, c.model LIMIT 1),
       s5 AS (SELECT 5 AS place, c.model, seen | c.mask AS seen, list_append(done, c.model) AS done FROM c, s4 WHERE NOT list_contains(done, c.model)
             ORDER BY bit_count(c.mask & ~seen) DESC, act DESC, c.model LIMIT 1)
       SELECT place::bigint AS place, model FROM (SELECT place, model FROM s1 UNION ALL SELECT place, model FROM s2 UNION ALL SELECT place, model FROM s3
           UNION ALL SELECT place, model FROM s4 UNION ALL SELECT place, model FROM s5)""",
)
def _(v):
    k = F.col("model").cast("int")
    flags = {
        "active": F.col("status") == "1", "inactive": F.col("status") == "0", "series": k % 3 == 0, "no_series": k % 3 != 0,
        "legacy_image": k % 5 == 0, "descriptive_image": k % 5 != 0, "with_gtin": k % 17 == 0, "without_gtin": k % 17 != 0,
    }
    return X.propose_canary(v.export_v.withColumns(flags), 5)
