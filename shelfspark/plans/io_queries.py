"""Source, sink and streaming queries: tables derived from the data go to files and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfspark.operators import catalog as C
from shelfspark.operators import changes as X
from shelfspark.operators import monitoring as O
from shelfspark.operators import registry as R
from shelfspark.plans import change_queries, monitoring_queries
from shelfspark.plans.monitoring_queries import _CHECKED, _RAISED
from shelfspark.plans.registry import query
from shelfspark.plans.registry_queries import _HEALTH
from shelfspark.plans.views import Views
from shelfspark.session import shared_dir
from shelfspark.sources import readers as RD
from shelfspark.sources import sinks as SK
from shelfspark.sources import tables as TB
from shelfspark.streaming import jobs as J
from shelfspark.streaming import keyed as K


def fresh_dir(v: Views, name: str) -> str:
    """A folder of its own for one run, where all executors can reach it."""
    return f"{shared_dir(v.spark)}/shelfspark-{name}-{uuid.uuid4().hex}"


def _stored_csv(v, df, name: str, sep: str = ",") -> str:
    path = fresh_dir(v, name)
    df.write.option("header", True).option("escape", '"').option("sep", sep).option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "IO1_catalog_csv",
    """SELECT model, mpn, name, family, cast(price AS double) AS price, cast(quantity AS bigint) AS quantity, is_atomic_model FROM catalog_v""",
)
def _(v):
    raw = v.catalog_raw_v.withColumnsRenamed({"market_a_status": "bestprice_status", "market_b_status": " skroutz_status "}).drop("product_id")
    rows = RD.read_catalog_csv(v.spark, _stored_csv(v, raw, "catalog"))
    return C.type_catalog(rows).select("model", "mpn", "name", "family", "price", "quantity", "is_atomic_model")


@query("IO2_input_csv", "SELECT model, mpn, price, match_status AS note FROM enriched_v")
def _(v):
    rows = v.enriched_v.select(F.col("model").alias("Model"), F.col("mpn").alias("MPN"), "price", F.col("match_status").alias("note"))
    return RD.load_csv(v.spark, _stored_csv(v, rows, "input", ";"), ["model", "mpn", "price"]).select("model", "mpn", "price", "note")


@query("IO3_header_resolution", "SELECT model, mpn, price FROM enriched_v")
def _(v):
    rows = v.enriched_v.select(F.col("price").alias("PRICE"), F.col("model").alias("Model"), "mpn")
    return RD.resolve_headers(rows, ["model", "mpn", "price"]).select("model", "mpn", "price")


@query("IO4_source_contract", "SELECT 'bestprice' AS contract, count(*) AS rows FROM enriched_v")
def _(v):
    rows = v.enriched_v.withColumns({c: F.lit("") for c in RD.CONTRACTS["bestprice"] if c not in v.enriched_v.columns})
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("contract", F.lit(RD.detect_contract(rows.columns)))


@query(
    "IO5_observation_aliases",
    """SELECT row_no, nullif("Product-Model", '') AS model, shop AS competitor_name FROM observation_file_v""",
)
def _(v):
    path = _stored_csv(v, v.observation_file_v, "observations")
    rows = O.project_observations(RD.read_text_csv(v.spark, path), "r", "main", "market_b", F.lit("2024-01-01").cast("timestamp"))
    return rows.select(F.col("row_no").cast("bigint").alias("row_no"), "model", "competitor_name")


@query(
    "IO6_full_export",
    """SELECT model, CASE WHEN right(model, 1) <> '1' THEN name END AS name, seo_keyword, category AS kind, CASE WHEN right(model, 1) = '1' THEN 'conflicting aliases for name' END AS error FROM export_v""",
)
def _(v):
    rows = v.export_v.select(
        F.col("model").alias("SKU"), F.col("name").alias("Product Name"), F.when(F.substring("model", -1, 1) == "1", "other").otherwise("").alias("name"),
        F.col("seo_keyword").alias("SEO Keyword"), F.concat(F.lit(" "), "category").alias("filter_group:Kind"),
    )
    out = RD.read_export(RD.read_text_csv(v.spark, _stored_csv(v, rows, "export")))
    return out.select("model", F.when(F.col("error").isNull(), F.col("name")).alias("name"),
                      "seo_keyword", F.col("filters")["filter_group:Kind"].alias("kind"), "error")


@query(
    "IO7_candidate_files",
    """SELECT model, name, CASE WHEN NOT regexp_matches(model, '^[0-9]{6}$') THEN 'model is not six digits' END AS error FROM proposed_v""",
)
def _(v):
    folder = fresh_dir(v, "candidates")
    rows = v.proposed_v.select("model", "name")
    for side, part in (("a", rows.where("model < '000900'")), ("b/c", rows.where("model >= '000900'"))):
        part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(f"{folder}/{side}")
    return RD.read_candidates(v.spark, folder).select("model", "name", "error")


@query(
    "IO8_batch_csv",
    """SELECT trim(model) AS model, brand, trim(name) AS name, CASE WHEN trim(model) = '' THEN 'empty_model' WHEN trim(name) = '' THEN 'empty_name' END AS error FROM batch_file_v""",
)
def _(v):
    rows = v.batch_file_v.select(F.col("model").alias("MODEL"), F.col("brand").alias("Brand"), "name")
    return RD.read_batch_csv(v.spark, _stored_csv(v, rows, "batch"))


@query("IO9_exclusion_list", "SELECT DISTINCT trim(model) AS model FROM ignored_raw_v")
def _(v):
    path = fresh_dir(v, "excluded")
    v.ignored_raw_v.select("model").write.text(path)
    return RD.read_model_list(v.spark, path)


@query("IO11_registry_transfer", "SELECT url_id, url_normalized, status FROM existing_urls_v")
def _(v):
    folder = fresh_dir(v, "transfer")
    SK.write_transfer({"source_urls": v.existing_urls_v, "runs": v.runs_v, "candidates": v.candidates_v}, folder)
    return RD.read_transfer(v.spark, folder)["source_urls"].select("url_id", "url_normalized", "status")


@query("IO12_stored_table", "SELECT run_id, count(*) AS observations FROM observations_v GROUP BY run_id")
def _(v):
    path = fresh_dir(v, "table")
    SK.write_table(v.observations_v, path, ["run_id"])
    return RD.read_table(v.spark, path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("observations"))


@query(
    "IO12_url_checks_stored",
    """WITH c AS (SELECT url_id, CASE failure_count WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'inconclusive' END AS r FROM existing_urls_v)
       SELECT o.url_id, CASE WHEN r = 'success' AND status <> 'disabled' THEN 'active' WHEN r = 'failed' THEN 'broken' ELSE status END AS status,
              CASE WHEN r = 'success' THEN 0 WHEN r = 'failed' THEN failure_count + 1 ELSE failure_count END AS failure_count,
              CASE WHEN r IN ('failed', 'inconclusive') THEN 'HTTP ' || r END AS last_error
       FROM existing_urls_v o JOIN c USING (url_id)""",
)
def _(v):
    """The registry as a stored table, checked by one merge that is called twice."""
    urls = v.existing_urls_v.select("url_id", "status", "failure_count", F.lit(None).cast("string").alias("last_error"))
    table = TB.KeyedTable.create(urls, fresh_dir(v, "urls"), ["url_id"], parts=16)
    result = F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("inconclusive"), F.lit(None)), (F.col("failure_count") + 1).cast("int"))
    checks = v.existing_urls_v.select("url_id", result.alias("result"), F.concat(F.lit("HTTP "), result).alias("message"))
    for _ in range(2):
        table.merge("checks", checks, R.apply_url_checks)
    return table.read()


@query(
    "IO12_imported_urls_stored",
    """SELECT coalesce(o.product_id, n.product_id) AS product_id, coalesce(o.url_normalized, n.url_normalized) AS url_normalized,
          CASE WHEN o.url IS NULL THEN n.status WHEN n.url IS NULL OR o.status = 'disabled' THEN o.status
               WHEN o.status = 'broken' AND n.status = 'active' AND n.last_success_at IS NOT NULL THEN 'active'
               WHEN o.status = 'needs_review' AND n.status = 'active' THEN 'active'
               WHEN o.status NOT IN ('active', 'broken', 'redirected') THEN n.status ELSE o.status END AS status,
          strftime(greatest(o.last_seen_at, n.last_seen_at), '%Y-%m-%d') AS last_seen_at
       FROM existing_urls_v o FULL OUTER JOIN imported_urls_v n ON n.product_id = o.product_id AND n.url_normalized = o.url_normalized""",
)
def _(v):
    """The registry as a stored table after an import, whose second run changes nothing."""
    fields = ["product_id", "url_normalized", *R.MERGE_FIELDS]
    kept = dict.fromkeys(fields)  # a key may be a merged field too
    table = TB.KeyedTable.create(v.existing_urls_v.select(*kept), fresh_dir(v, "urls"), ["product_id", "url_normalized"], parts=16)
    for run in ("import", "the same import again"):
        table.merge(run, v.imported_urls_v.select(*kept), R.merge_imported_urls)
    return table.read().select("product_id", "url_normalized", "status", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen_at"))


@query(
    "IO12_ignored_models_stored",
    """WITH old AS (SELECT model, arg_max(name, seq) AS name, arg_max(reason, seq) AS reason FROM ignored_raw_v GROUP BY model),
       new AS (SELECT model, name, 'manual ignore' AS reason FROM catalog_v WHERE status <> 1 AND is_atomic_model)
       SELECT model, name, reason FROM new UNION ALL SELECT model, name, reason FROM old WHERE model NOT IN (SELECT model FROM new)""",
)
def _(v):
    """The ignore list as a stored table after an upsert."""
    old = C.last_per_model(v.ignored_raw_v, "seq").select("model", "name", "reason")
    table = TB.KeyedTable.create(old, fresh_dir(v, "ignored"), ["model"], parts=16)
    new = v.catalog_v.where("status <> 1 AND is_atomic_model").select("model", "name", F.lit("manual ignore").alias("reason"))
    table.merge("manual", new, C.upsert_by_model)
    return table.read()


@query(
    "IO13_price_update_csv",
    "WITH " + _CHECKED + """SELECT model, cast(target_price AS varchar) AS price FROM ap
        WHERE selected_action IN ('match_price', 'undercut') AND is_atomic_model AND target_price > 0 AND model NOT IN (SELECT model FROM ignored_raw_v)""",
)
def _(v):
    path = fresh_dir(v, "prices")
    SK.write_price_update(monitoring_queries._applied(v), v.ignored_raw_v, path)
    return RD.read_text_csv(v.spark, path)


@query("IO14_review_csv", "WITH " + _CHECKED + "SELECT model, new_status AS status, CASE WHEN is_atomic_model THEN '' ELSE 'composite_or_invalid_model' END AS w FROM ap")
def _(v):
    path = fresh_dir(v, "review")
    SK.write_review(monitoring_queries._applied(v), path)
    rows = RD.read_text_csv(v.spark, path)
    return rows.select("model", "status", F.regexp_extract("warnings", "^composite_or_invalid_model", 0).alias("w"))


@query(
    "IO15_product_csv",
    """SELECT model, name, '' AS mpn2, CASE WHEN right(model, 1) < '5' THEN 'Even' ELSE '' END AS kind FROM export_v""",
)
def _(v):
    filters = v.export_v.select(
        "model", F.lit("Kind").alias("group_name"), F.when(F.substring("model", 6, 1) < "5", "Even").otherwise("").alias("value")
    )
    rows = SK.product_csv_rows(v.export_v, filters, ["model", "name", "mpn2"], ["Kind", "Unused"])
    return rows.withColumnRenamed("filter_group:Kind", "kind")


@query(
    "IO16_plan_artifacts",
    "WITH " + change_queries._PLAN + "SELECT model, field FROM l WHERE classification = 'blocked'",
)
def _(v):
    folder = fresh_dir(v, "plan")
    plan = change_queries._plan(v)
    SK.write_plan_artifacts(plan, X.plan_totals(plan), folder)
    return RD.read_text_csv(v.spark, f"{folder}/blocked").select("model", "field")


@query("IO17_preview", "SELECT least(20, count(*))::bigint AS shown, count(*) AS rows FROM catalog_raw_v")
def _(v):
    head, total = RD.preview(v.catalog_raw_v, 20)
    return head.agg(F.count(F.lit(1)).alias("shown")).withColumn("rows", F.lit(total).cast("bigint"))


@query(
    "IO18_filtered_catalog",
    """SELECT count(*) AS input_rows, count(*) FILTER (trim(model) NOT IN (SELECT model FROM ignored_raw_v)) AS output_rows,
          count(*) FILTER (trim(model) IN (SELECT model FROM ignored_raw_v)) AS removed_rows FROM catalog_raw_v""",
)
def _(v):
    return SK.write_filtered_catalog(v.catalog_raw_v, v.ignored_raw_v, fresh_dir(v, "filtered"))


# ------------------------------------------------------------------- streaming
def _file_stream(v, table: str):
    """A driver table as a stream of files."""
    reader = v.spark.readStream.schema(getattr(v, table).schema).option("pathGlobFilter", f"{table}.parquet")
    return reader.parquet(v.sf_dir)


@query(
    "ST1_alert_stream",
    "WITH " + _RAISED.replace("FROM alert_obs_v", "FROM stream_obs_v") + "SELECT DISTINCT dedupe_key FROM a",
)
def _(v):
    out = fresh_dir(v, "alerts")
    lines = _file_stream(v, "lineitem")
    offers = v.spark.sql(monitoring_queries.VIEWS["offers_v"], lineitem=lines)
    obs = offers.join(v.catalog_v.select("product_id", "catalog_source", "model", "mpn", F.col("price").alias("own_price")), "product_id").select(
        F.col("offer_key").alias("observation_id"), "run_id", "catalog_source",
        F.when(F.col("seller_id") % 2 == 0, "market_a").otherwise("market_b").alias("source"), "model",
        F.nullif("mpn", F.lit("")).alias("mpn"), "product_id", F.col("price").alias("competitor_price"), "own_price", "captured_at",
    )
    events = J.alert_events(obs, v.rules_v, "captured_at").select("dedupe_key")
    run = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    run.awaitTermination()
    return v.spark.read.parquet(out)


@query(
    "ST2_health_stream",
    "WITH " + _HEALTH + "SELECT source_id, last_fetch_status, consecutive_failures FROM h",
)
def _(v):
    folder = fresh_dir(v, "health")
    attempts = v.spark.sql(monitoring_queries.VIEWS["captures_v"], events=_file_stream(v, "events"))
    run = K.run_keyed(K.health_stream(attempts), folder, folder + "-cp", idle_batches=False)
    run.awaitTermination()
    return K.health_now(v.spark, folder + "-cp").select("source_id", "last_fetch_status", "consecutive_failures")


@query("ST3_snapshot_stream", "SELECT DISTINCT source_id, artifact_ref, digest_no::varchar AS digest FROM incoming_snapshots_v")
def _(v):
    out = fresh_dir(v, "snapshots")
    rows = v.spark.sql(monitoring_queries.VIEWS["incoming_snapshots_v"], events=_file_stream(v, "events"))
    fresh = J.new_snapshot_stream(rows.withColumn("digest", F.col("digest_no").cast("string")), "captured_at").select("source_id", "artifact_ref", "digest")
    run = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    run.awaitTermination()
    return v.spark.read.parquet(out)


@query(
    "ST4_stale_job_stream",
    """WITH j AS (SELECT user_id AS job_id, job_type, arg_max(status, heartbeat_at) AS status, max(heartbeat_at) AS hb FROM jobs_v GROUP BY 1, 2)
       SELECT job_id, job_type FROM j WHERE status = 'running' AND hb <= (SELECT max(hb) FROM j) - to_minutes(CASE job_type WHEN 'click' THEN 600 ELSE 60 END)""",
)
def _(v):
    folder = fresh_dir(v, "jobs")
    rows = v.spark.sql(monitoring_queries.VIEWS["jobs_v"], events=_file_stream(v, "events"))
    jobs = rows.withColumn("job_id", F.col("user_id"))
    run = K.run_keyed(K.stale_job_stream(jobs, {"click": 600}), folder, folder + "-cp", idle_batches=True)
    run.awaitTermination()
    return K.stale_jobs_now(v.spark, folder + "-cp").select("job_id", "job_type")


monitoring_queries.VIEWS["stream_obs_v"] = """
    SELECT o.offer_key AS observation_id, o.run_id, c.catalog_source, CASE WHEN o.seller_id % 2 = 0 THEN 'market_a' ELSE 'market_b' END AS source,
           c.model, nullif(c.mpn, '') AS mpn, o.product_id, o.price AS competitor_price, c.price AS own_price
    FROM {offers_v} o JOIN {catalog_v} c ON c.product_id = o.product_id"""

