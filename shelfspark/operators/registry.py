"""Source-URL registry: identity resolution, import, merge rules, coverage and health."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.money import lenient_decimal, share_percent
from shelfspark.functions.text import collapse_spaces, trim_text
from shelfspark.functions.urls import (
    canonical_url, canonical_url_hash, normalize_url, source_name, url_forms,
)
from shelfspark.operators.catalog import URL_STATUSES, labels
from shelfspark.operators.skew import first_row, last_row
from shelfspark.session import written

URL_TYPES = ["manual", "imported", "discovered"]
# Trust levels whose URLs are captured with full confidence.
CAPTURE_TRUST_LEVELS = ["manual", "high_confidence", "reviewed"]
ACTIVE_CONFIDENCE = 0.85

# Names of capture health reasons, in their order of precedence (fixed values).
HEALTH_REASONS = [
    "firecrawl_api_key_missing", "firecrawl_timeout", "firecrawl_rate_limited",
    "firecrawl_blocked", "firecrawl_http_error", "firecrawl_parse_failed",
    "firecrawl_no_offers", "firecrawl_unknown_error",
]
REVIEW_HEALTH_REASONS = ["firecrawl_blocked", "firecrawl_parse_failed"]

# Names that mark a header or a JSON key as sensitive (fixed values).
SENSITIVE_HEADERS = [
    "authorization", "cookie", "set-cookie", "x-csrf-token", "x-xsrf-token", "csrf-token",
    "x-requested-with", "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform",
]
SENSITIVE_KEY_MARKERS = [
    "token", "cookie", "session", "csrf", "authorization", "password", "fingerprint",
]


# -------------------------------------------------------- identity resolution
def _blank_null(name: str) -> Column:
    return F.nullif(trim_text(F.col(name)), F.lit(""))


def _by_mpn(catalog: DataFrame) -> DataFrame:
    known = catalog.where("active AND mpn <> ''")
    return known.groupBy(F.col("mpn").alias("_mpn")).agg(
        F.count(F.lit(1)).alias("_hits"), F.min("product_id").alias("_by_mpn")
    )


def _by_model(catalog: DataFrame) -> DataFrame:
    known = catalog.where("active AND model <> ''")
    return known.groupBy(F.col("model").alias("_model")).agg(F.min("product_id").alias("_by_model"))


def resolve_for_import(evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog product of each evidence row by model, else by an MPN that only one product has.

    A model that lists several (``;``, ``|`` or a line break) is not looked up.
    """
    model, mpn = _blank_null("model"), _blank_null("mpn")
    single = F.when(~model.rlike("[;|\\n]"), model)
    joined = evidence.join(_by_model(catalog), single == F.col("_model"), "left").join(
        _by_mpn(catalog), mpn == F.col("_mpn"), "left"
    )
    kind = (
        F.when(F.col("_by_model").isNotNull(), "model")
        .when(F.col("_hits") == 1, "mpn")
        .when(F.col("_hits") > 1, "ambiguous_mpn")
        .when(model.isNull() & mpn.isNull(), "missing_identity")
        .otherwise("unresolved")
    )
    return joined.withColumns(
        {
            "match_type": kind,
            "resolved_id": F.when(kind == "model", F.col("_by_model")).when(kind == "mpn", F.col("_by_mpn")),
            "identity_confidence": F.when(kind.isin("model", "mpn"), "strong").otherwise("none"),
        }
    ).drop("_model", "_by_model", "_mpn", "_hits", "_by_mpn")


def resolve_for_handoff(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """As above for handoffs: a given id must fit, a model is exact, a unique MPN is weak."""
    c = catalog.select(
        F.col("product_id").alias("_id"), F.col("model").alias("_cm"), F.col("mpn").alias("_cn"),
        F.col("active").alias("_ca"), F.col("catalog_source").alias("_cs"),
    )
    model, mpn = _blank_null("model"), _blank_null("mpn")
    given = F.col("catalog_product_id").isNotNull()
    joined = (
        rows.join(c, F.col("catalog_product_id") == F.col("_id"), "left")
        .join(_by_model(catalog), F.when(~given, model) == F.col("_model"), "left")
        .join(_by_mpn(catalog), F.when(~given, mpn) == F.col("_mpn"), "left")
    )
    clash = (
        (F.col("_cs") != F.col("catalog_source"))
        | (model.isNotNull() & (model != F.col("_cm")))
        | (mpn.isNotNull() & (F.col("_cn") != "") & (mpn != F.col("_cn")))
    )
    kind = (
        F.when(given & ~F.coalesce("_ca", F.lit(False)), "missing_catalog_product_id")
        .when(given & F.coalesce(clash, F.lit(False)), "ambiguous_catalog_product_id")
        .when(given, "catalog_product_id")
        .when(F.col("_by_model").isNotNull(), "model")
        .when(F.col("_hits") == 1, "mpn")
        .when(F.col("_hits") > 1, "ambiguous_mpn")
        .when(model.isNull() & mpn.isNull(), "missing_identity")
        .otherwise("unresolved")
    )
    resolved = (
        F.when(kind == "catalog_product_id", F.col("_id"))
        .when(kind == "model", F.col("_by_model"))
        .when(kind == "mpn", F.col("_by_mpn"))
    )
    return joined.withColumns(
        {
            "match_type": kind,
            "resolved_id": resolved,
            "identity_confidence": F.when(kind.isin("catalog_product_id", "model"), "exact")
            .when(kind == "mpn", "weak")
            .otherwise("none"),
        }
    ).drop("_id", "_cm", "_cn", "_ca", "_cs", "_model", "_by_model", "_mpn", "_hits", "_by_mpn")


def resolve_transfer_product(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Product of a transferred row: by source and model (active first), else by id."""
    ranked = first_row(
        catalog, ["catalog_source", "model"], [~F.col("active"), F.col("product_id")], ["product_id"]
    ).select("catalog_source", "model", F.col("product_id").alias("_by_model"))
    ids = catalog.select(F.col("product_id").alias("_id"), F.col("catalog_source").alias("_cs"))
    joined = rows.join(ranked, ["catalog_source", "model"], "left").join(
        ids, F.col("catalog_product_id") == F.col("_id"), "left"
    )
    same = (F.col("catalog_source") == "") | (F.col("catalog_source") == F.col("_cs"))
    return joined.withColumn(
        "resolved_id", F.coalesce("_by_model", F.when(same, F.col("_id")))
    ).drop("_by_model", "_id", "_cs")


def find_existing_candidates(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored candidate a transferred one stands for.

    It is looked up by its URL, else its canonical URL, else by status and method, within
    the same run, source, model and source name. Each stored row is offered under all
    three keys, so one equality join serves every tier.
    """
    scope = ["run_id", "catalog_source", "model", "source_name"]
    by_url = F.concat(F.lit("u:"), "candidate_url")
    by_canonical = F.concat(F.lit("c:"), "canonical_url")
    by_state = F.concat_ws("|", F.lit("s:"), "match_status", "match_method")
    offered = stored.select(
        *scope, F.explode(F.array(by_url, by_canonical, by_state)).alias("_key"), "candidate_id"
    )
    least = offered.groupBy(*scope, "_key").agg(F.min("candidate_id").alias("existing_id"))
    key = (
        F.when(F.coalesce("candidate_url", F.lit("")) != "", by_url)
        .when(F.coalesce("canonical_url", F.lit("")) != "", by_canonical)
        .otherwise(by_state)
    )
    return incoming.withColumn("_key", key).join(least, [*scope, "_key"], "left").drop("_key")


# --------------------------------------------------------------------- import
def with_url_forms(rows: DataFrame, url: str = "url", repeated: bool = False) -> DataFrame:
    """``rows`` with url_error, url_normalized and source_domain.

    Of feeds in which the same URLs come again and again (``repeated``), each distinct URL is
    parsed once and its forms are a table that the rows meet; otherwise rows are not shuffled.
    """
    def parsed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_forms", url_forms(F.col(url))).select(
            *frame.columns, F.col("_forms.error").alias("url_error"), F.col("_forms.normalized").alias("url_normalized"),
            F.col("_forms.host").alias("source_domain"))

    if not repeated:
        return parsed(rows)
    forms = parsed(rows.select(url).distinct()).withColumnRenamed(url, "_parsed")
    return rows.join(forms, F.col(url).eqNullSafe(F.col("_parsed")), "left").drop("_parsed")


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """Evidence of several feeds as one frame; a column a feed lacks is NULL."""
    out = None
    for name, part in feeds.items():
        tagged = part.withColumn("feed", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def import_report(evidence: DataFrame, existing: DataFrame, order: Sequence[str]) -> DataFrame:
    """What one import does with every evidence row: action and reason.

    ``evidence`` is resolved and carries the URL forms; of equal (product, normalized
    URL) pairs the first by ``order`` is used, later ones are duplicates.
    """
    reason = (
        F.when(F.col("match_type") == "ambiguous_mpn", "ambiguous_identity")
        .when(F.col("resolved_id").isNull(), "unresolved_identity")
        .when(F.col("url_error").isNotNull(), "invalid_url")
    )
    # Worked out once: the first of each pair and the report both come from it.
    judged = written(evidence.withColumn("skip", reason))
    keys = ["resolved_id", "url_normalized"]
    usable = judged.where(F.col("skip").isNull())
    firsts = usable.groupBy(*keys).agg(F.min(F.struct(*order)).alias("least"))
    # Skipped rows meet nothing below: their join key is made NULL.
    stored = existing.select(
        F.col("product_id").alias("resolved_id"), "url_normalized", F.struct(*MERGE_FIELDS).alias("old")
    )
    targets = firsts.join(stored, keys, "left").select(
        F.col("resolved_id").alias("_id"), F.col("url_normalized").alias("_url"), "least", "old"
    )
    met = judged.join(
        targets,
        (F.when(F.col("skip").isNull(), F.col("resolved_id")) == F.col("_id"))
        & (F.col("url_normalized") == F.col("_url")),
        "left",
    )
    new = F.struct(*MERGE_FIELDS)
    action = (
        F.when(F.col("skip").isNotNull(), "skipped")
        .when(F.struct(*order) != F.col("least"), "duplicate")
        .when(F.col("old").isNull(), "created")
        .when(F.size(changed_fields(F.col("old"), new)) > 0, "updated")
        .otherwise("duplicate")
    )
    why = F.when(F.struct(*order) != F.col("least"), "duplicate_candidate").when(
        F.col("action") == "duplicate", "already_exists"
    )
    return (
        met.withColumn("action", action)
        .withColumn("reason", F.coalesce("skip", why))
        .drop("skip", "_id", "_url", "least", "old")
    )


def import_counters(report: DataFrame, apply: bool = True) -> DataFrame:
    """Counters of an import; a preview reports what it would import and update."""
    n = lambda cond: F.count_if(cond)
    action, reason = F.col("action"), F.col("reason")
    used = action.isin("created", "updated") | (reason == "already_exists")
    counts = report.agg(
        n(action != "skipped").alias("candidates_found"),
        n(action == "created").alias("imported_count"),
        n(action == "updated").alias("updated_count"),
        n(action == "duplicate").alias("duplicate_count"),
        n(action == "skipped").alias("skipped_count"),
        n(used & (F.col("status") == "active")).alias("active_count"),
        n(used & (F.col("status") == "needs_review")).alias("needs_review_count"),
        n(reason == "invalid_url").alias("invalid_url_count"),
        n(reason == "unresolved_identity").alias("unresolved_identity_count"),
        n(reason == "ambiguous_identity").alias("ambiguous_identity_count"),
    )
    if apply:
        return counts.withColumns(
            {"would_import_count": F.lit(0).cast("bigint"), "would_update_count": F.lit(0).cast("bigint")}
        )
    return counts.withColumns(
        {
            "would_import_count": F.col("imported_count"),
            "would_update_count": F.col("updated_count"),
            "imported_count": F.lit(0).cast("bigint"),
            "updated_count": F.lit(0).cast("bigint"),
        }
    )


# ---------------------------------------------------------------- merge rules
MERGE_FIELDS = [
    "source_name", "source_domain", "url", "url_type", "provenance", "trust_level", "status",
    "last_seen_at", "last_success_at", "last_error", "notes",
]


def _merged_fields(old: Column, new: Column) -> dict[str, Column]:
    """Field values after an imported URL meets a stored one.

    The origin of a manual URL is kept. A disabled URL stays disabled, a broken one needs
    a success to come back, and timestamps only move forward.
    """
    manual = old["url_type"] == "manual"
    active = new["status"] == "active"
    status = (
        F.when(old["status"] == "disabled", old["status"])
        .when((old["status"] == "broken") & active & new["last_success_at"].isNotNull(), "active")
        .when((old["status"] == "needs_review") & active, "active")
        .when(~old["status"].isin("active", "broken", "redirected"), new["status"])
        .otherwise(old["status"])
    )
    out = {c: new[c] for c in ("source_name", "source_domain", "url")}
    out |= {
        c: F.when(manual, old[c]).otherwise(new[c]) for c in ("url_type", "provenance", "trust_level")
    }
    out["status"] = status
    out |= {c: F.greatest(old[c], new[c]) for c in ("last_seen_at", "last_success_at")}
    out |= {c: F.coalesce(new[c], old[c]) for c in ("last_error", "notes")}
    return out


def changed_fields(old: Column, new: Column) -> Column:
    """Names of the stored fields an imported URL changes, in field order."""
    return labels(
        *[(~value.eqNullSafe(old[name]), name) for name, value in _merged_fields(old, new).items()]
    )


def merge_imported_urls(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after an import, one row per (product, normalized URL)."""
    keys = ["product_id", "url_normalized"]
    old = existing.select(*keys, F.struct(*MERGE_FIELDS).alias("old"))
    new = incoming.select(*keys, F.struct(*MERGE_FIELDS).alias("new"))
    both = old.join(new, keys, "full_outer")
    o, n = F.col("old"), F.col("new")
    changes = F.when(o.isNotNull() & n.isNotNull(), changed_fields(o, n)).otherwise(
        F.array().cast("array<string>")
    )
    action = (
        F.when(o.isNull(), "created")
        .when(n.isNull(), "unchanged")
        .when(F.size(changes) > 0, "updated")
        .otherwise("duplicate")
    )
    values = [
        F.when(o.isNull(), n[c]).when(n.isNull(), o[c]).otherwise(v).alias(c)
        for c, v in _merged_fields(o, n).items()
    ]
    return both.select(*keys, action.alias("action"), changes.alias("changed_fields"), *values)


def merge_manual_urls(existing: DataFrame, manual: DataFrame) -> DataFrame:
    """Registry after manual entries: descriptive fields replaced, a known status kept."""
    keys = ["product_id", "url_normalized"]
    carried = ["source_name", "url", "url_type", "trust_level", "notes"]
    old = existing.select(*keys, "status", F.struct(*carried).alias("old"))
    new = manual.select(*keys, F.struct(*carried).alias("new"))
    both = old.join(new, keys, "full_outer")
    o, n = F.col("old"), F.col("new")
    return both.select(
        *keys,
        F.coalesce("status", F.lit("active")).alias("status"),
        F.when(F.col("status").isNull(), "created").when(n.isNull(), "unchanged").otherwise("updated").alias("action"),
        *[F.when(n.isNull(), o[c]).otherwise(n[c]).alias(c) for c in carried if c != "notes"],
        F.when(n.isNull(), o["notes"]).otherwise(F.coalesce(n["notes"], o["notes"])).alias("notes"),
    )


def apply_url_checks(urls: DataFrame, checks: DataFrame) -> DataFrame:
    """Registry after reachability checks: success heals, failure breaks, else only a note."""
    joined = urls.join(checks.select("url_id", "result", "message"), "url_id", "left")
    result = F.col("result")
    status = (
        F.when((result == "success") & (F.col("status") != "disabled"), "active")
        .when(result == "failed", "broken")
        .otherwise(F.col("status"))
    )
    failures = (
        F.when(result == "success", 0)
        .when(result == "failed", F.coalesce("failure_count", F.lit(0)) + 1)
        .otherwise(F.col("failure_count"))
    )
    message = F.when(result.isin("failed", "inconclusive"), short_text(F.col("message")))
    return joined.withColumns(
        {"status": status, "failure_count": failures, "last_error": message}
    ).drop("message")


def short_text(text: Column, limit: int = 500) -> Column:
    clean = collapse_spaces(F.coalesce(text, F.lit("")))
    cut = F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


# --------------------------------------------------------------------- health
def source_health(attempts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Health per source after its attempts: last states and failures since the last success.

    Built from aggregates over (time, id), so a source with very many attempts stays
    spread over all tasks.
    """
    order = F.struct("captured_at", "attempt_id")
    ok = F.col("fetch_status") == "success"
    state = attempts.groupBy("source_id").agg(
        F.max_by(F.struct("fetch_status", "error_code"), order).alias("_latest"),
        F.max(F.when(ok, order)).alias("_ok"),
        F.max(F.when(ok, F.col("captured_at"))).alias("last_success_at"),
        F.max(F.when(~ok, F.col("captured_at"))).alias("last_error_at"),
    )
    since = (
        attempts.where(~ok)
        .join(state.select("source_id", "_ok"), "source_id")
        .where(F.col("_ok").isNull() | (order > F.col("_ok")))
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("_since"))
    )
    joined = state.join(since, "source_id", "left")
    before = F.lit(0)
    if prior is not None:
        joined = joined.join(
            prior.select("source_id", F.col("consecutive_failures").alias("_prior")), "source_id", "left"
        )
        before = F.when(F.col("_ok").isNull(), F.coalesce("_prior", F.lit(0))).otherwise(0)
    healthy = F.col("_latest.fetch_status") == "success"
    return joined.select(
        "source_id",
        F.col("_latest.fetch_status").alias("last_fetch_status"),
        F.when(~healthy, F.col("_latest.error_code")).alias("last_error_code"),
        "last_success_at",
        "last_error_at",
        (before + F.coalesce("_since", F.lit(0))).alias("consecutive_failures"),
    )


def health_state(active: Column, last_status: Column, failures: Column) -> Column:
    return (
        F.when(~active, "disabled")
        .when((last_status == "failed") | (F.coalesce(failures, F.lit(0)) > 0), "failing")
        .when(last_status == "success", "healthy")
        .otherwise("unknown")
    )


def health_reason(
    vendor: Column, strategy: Column, code: Column, status: Column, flags: Column, message: Column
) -> Column:
    """Why captures of the browser-rendered marketplace fail; NULL for other vendors."""
    norm = lambda c: F.lower(trim_text(c))
    v, s, c, m = norm(vendor), norm(strategy), norm(code), norm(message)
    marks = F.transform(F.coalesce(flags, F.array().cast("array<string>")), norm)
    rendered = (
        (s == "skroutz_firecrawl")
        | F.startswith(c, F.lit("firecrawl_"))
        | F.exists(marks, lambda f: F.startswith(f, F.lit("firecrawl_")))
    )
    named = F.coalesce(*[F.when(F.array_contains(marks, r), r) for r in HEALTH_REASONS])
    return (
        F.when((v != "") & (v != "skroutz") & (s != "skroutz_firecrawl"), F.lit(None).cast("string"))
        .when(named.isNotNull(), named)
        .when(~rendered & (v != "skroutz"), F.lit(None).cast("string"))
        .when(c.isin("firecrawl_api_key_missing", "firecrawl_timeout", "firecrawl_parse_failed"), c)
        .when(F.array_contains(marks, "no_offer_observations_parsed"), "firecrawl_no_offers")
        .when((status == 429) | m.rlike("rate_limit|rate limited"), "firecrawl_rate_limited")
        .when(status.isin(401, 403, 423) | m.rlike("blocked|captcha|challenge|forbidden"), "firecrawl_blocked")
        .when((status >= 400) | (c == "firecrawl_api_failed"), "firecrawl_http_error")
        .when(rendered, "firecrawl_unknown_error")
    )


def escalate_urls(urls: DataFrame, health: DataFrame, threshold: int = 2) -> DataFrame:
    """Active URLs move to review after repeated blocked or unreadable captures."""
    joined = urls.join(
        health.select("source_id", "health_reason", "consecutive_failures"), "source_id", "left"
    )
    due = (
        (F.col("status") == "active")
        & F.col("health_reason").isin(REVIEW_HEALTH_REASONS)
        & (F.col("consecutive_failures") >= threshold)
    )
    due = F.coalesce(due, F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(due, "needs_review").otherwise(F.col("status")),
            "failure_count": F.when(
                due, F.greatest("failure_count", "consecutive_failures")
            ).otherwise(F.col("failure_count")),
            "escalated": due,
        }
    ).drop("health_reason", "consecutive_failures")


def health_items(sources: DataFrame, products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Sources with their product and vendor, health state and health reason."""
    joined = sources.join(products, "product_id").join(vendors, "vendor_id", "left")
    return joined.withColumns(
        {
            "health": health_state(F.col("active"), F.col("last_fetch_status"), F.col("consecutive_failures")),
            "health_reason": health_reason(
                F.col("vendor"), F.col("strategy"), F.col("last_error_code"), F.col("response_status"),
                F.col("flags"), F.col("last_error_message"),
            ),
        }
    )


def health_page(items: DataFrame, limit: int, offset: int = 0, reason: str | None = None) -> DataFrame:
    """One page of health items, newest first. The reason filter comes before the page cut."""
    if reason:
        items = items.where(F.col("health_reason") == reason)
    return items.orderBy(F.desc("updated_at"), F.desc("source_id")).offset(offset).limit(limit)


def due_sources(sources: DataFrame, now: Column, minutes: int, limit: int) -> DataFrame:
    """Active sources never captured, or last captured too long ago; the oldest first."""
    late = F.col("last_success_at").isNull() | (
        F.col("last_success_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    )
    return sources.where(F.col("active") & late).orderBy(
        F.asc_nulls_first("last_success_at"), "source_id"
    ).limit(limit)


# ------------------------------------------------------------------- coverage
def url_status_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy("product_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in URL_STATUSES]
    )


def registry_summary(products: DataFrame, urls: DataFrame) -> DataFrame:
    """Totals, coverage percent and newest update over the active catalog."""
    active = products.where("active").select("product_id")
    mine = urls.join(active, "product_id", "left_semi")
    per_product = mine.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(F.col("status") == "active").alias("live"),
        F.max("updated_at").alias("updated_at"),
    )
    totals = per_product.agg(
        F.coalesce(F.sum("urls"), F.lit(0)).alias("source_url_count"),
        F.count_if(F.col("live") > 0).alias("with_active"),
        F.max("updated_at").alias("updated_at"),
    ).withColumn("catalog_product_count", active.agg(F.count(F.lit(1))).scalar())
    return totals.withColumns(
        {
            "without_active": F.greatest(F.col("catalog_product_count") - F.col("with_active"), F.lit(0)),
            "coverage_percent": share_percent(F.col("with_active"), F.col("catalog_product_count")),
        }
    )


def registry_breakdown(products: DataFrame, urls: DataFrame) -> DataFrame:
    """URL counts of the active catalog by status, by source name and by type."""
    mine = urls.join(products.where("active").select("product_id"), "product_id", "left_semi")
    dims = ["status", "source_name", "url_type"]
    cells = mine.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    sets = cells.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.sum("n").alias("urls"), F.grouping_id().alias("gid")
    )
    dim = F.when(F.col("gid") == 3, "status").when(F.col("gid") == 5, "source_name").otherwise("url_type")
    return sets.select(dim.alias("dimension"), F.coalesce(*dims).alias("value"), "urls")


def status_by_source(products: DataFrame, urls: DataFrame) -> DataFrame:
    mine = urls.join(products.where("active").select("product_id"), "product_id", "left_semi")
    return mine.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("source_url_count"),
        *[F.count_if(F.col("status") == s).alias(s) for s in URL_STATUSES],
    )


def missing_url_products(products: DataFrame, urls: DataFrame) -> DataFrame:
    live = urls.where(F.col("status") == "active").select("product_id")
    return products.where("active").join(live, "product_id", "left_anti").withColumn(
        "reason", F.lit("missing_active_source_url")
    )


def capture_run_counters(items: DataFrame) -> DataFrame:
    return items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(F.col("fetch_status") == "success").alias("succeeded"),
        F.count_if(F.col("fetch_status") == "failed").alias("failed"),
        F.count_if(F.col("fetch_status") == "skipped").alias("skipped"),
    )


# ------------------------------------------------- tasks, snapshots and links
def latest_task(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest discovery task per product, by run time, run id and task id."""
    joined = tasks.join(
        runs.select("run_id", F.col("created_at").alias("_at"), F.col("id").alias("_run"),
                    F.col("status").alias("_run_status")),
        "run_id",
    )
    last = last_row(joined, ["product_id"], [F.col("_at"), F.col("_run"), F.col("task_id")])
    state = F.coalesce(F.nullif("task_status", F.lit("")), "_run_status")
    running = F.lower("task_status").isin("queued", "running") | F.lower("_run_status").isin("queued", "running")
    return last.select(
        "product_id", "run_id", "task_id", state.alias("status"),
        F.coalesce(running, F.lit(False)).alias("running"),
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per source; a missing capture time counts as oldest."""
    return last_row(snapshots, ["source_id"], [F.col("captured_at"), F.col("snapshot_id")])


def without_active_pair(pairs: DataFrame, urls: DataFrame) -> DataFrame:
    """(product, source) pairs that still need a URL."""
    live = urls.where(F.col("status") == "active").select("product_id", "source_name")
    return pairs.join(live, ["product_id", "source_name"], "left_anti")


def product_detail(products: DataFrame, urls: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every registered URL of a product with its capture source and latest snapshot."""
    u = urls.withColumn("url_hash", canonical_url_hash(F.col("url")))
    s = first_row(
        sources.withColumn("url_hash", canonical_url_hash(F.col("url"))),
        ["product_id", "url_hash"], [F.col("source_id")], ["source_id", "active"],
    ).withColumnRenamed("active", "source_active")
    snap = latest_snapshot(snapshots).select(
        "source_id", "snapshot_id", "captured_at", "fetch_status"
    )
    return (
        products.join(u, "product_id")
        .join(s, ["product_id", "url_hash"], "left")
        .join(snap, "source_id", "left")
    )


def sources_from_urls(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """Capture sources after accepted URLs were mirrored into them.

    Only an active URL makes a new source. A known source follows the URL's state; seen
    and success times move forward and the higher failure count stays.
    """
    keys = ["product_id", "url_hash"]
    newest = last_row(
        urls.withColumn("url_hash", canonical_url_hash(F.col("url"))), keys,
        [F.col("updated_at"), F.col("url_id")],
    )
    u = newest.select(
        *keys, F.lit(True).alias("_u"), F.col("status").alias("_status"), F.col("trust_level").alias("_trust"),
        canonical_url(F.col("url")).alias("_url"), F.col("last_seen_at").alias("_seen"),
        F.col("failure_count").alias("_failures"),
    )
    s = sources.withColumn("url_hash", canonical_url_hash(F.col("url"))).withColumn("_s", F.lit(True))
    both = s.join(u, keys, "full_outer")
    live = F.col("_status") == "active"
    confidence = F.when(F.col("_trust").isin(CAPTURE_TRUST_LEVELS), 1.0).when(live, 0.8)
    out = both.where(F.col("_s").isNotNull() | live)
    return out.select(
        "source_id", *keys,
        F.coalesce("_url", canonical_url(F.col("url"))).alias("url"),
        F.when(F.col("_u").isNull(), F.col("active")).otherwise(live).alias("active"),
        F.greatest("last_seen_at", "_seen").alias("last_seen_at"),
        F.greatest(F.coalesce("consecutive_failures", F.lit(0)), F.coalesce("_failures", F.lit(0))).alias("consecutive_failures"),
        F.coalesce(confidence, "confidence").alias("confidence"),
        F.when(F.col("_s").isNull(), "created").when(F.col("_u").isNull(), "unchanged").otherwise("updated").alias("action"),
    )


def urls_from_sources(sources: DataFrame, urls: DataFrame) -> DataFrame:
    """Registry after capture sources were mirrored into it.

    A stopped source disables its URL; a running one makes a URL active unless it was
    disabled, is broken, redirected or under review.
    """
    keys = ["product_id", "url_normalized"]
    newest = last_row(
        sources.withColumn("url_normalized", normalize_url(canonical_url(F.col("url")))), keys,
        [F.col("source_id")],
    )
    s = newest.select(
        *keys, F.lit(True).alias("_s"), F.col("active").alias("_active"),
        F.col("last_seen_at").alias("_seen"), F.col("consecutive_failures").alias("_failures"),
    )
    u = urls.withColumn("url_normalized", normalize_url(F.col("url"))).withColumn("_u", F.lit(True))
    both = u.join(s, keys, "full_outer")
    keep = F.col("status").isin("disabled", "needs_review", "broken", "redirected")
    status = (
        F.when(F.col("_s").isNull(), F.col("status"))
        .when(~F.col("_active"), "disabled")
        .when(keep, F.col("status"))
        .otherwise("active")
    )
    return both.select(
        "url_id", *keys, status.alias("status"),
        F.when((F.col("url_type") == "manual") | F.col("_s").isNull(), F.col("url_type")).otherwise("imported").alias("url_type"),
        F.greatest("last_seen_at", "_seen").alias("last_seen_at"),
        F.greatest(F.coalesce("failure_count", F.lit(0)), F.coalesce("_failures", F.lit(0))).alias("failure_count"),
        F.when(F.col("_u").isNull(), "created").when(F.col("_s").isNull(), "unchanged").otherwise("updated").alias("action"),
    )


def reuse_or_create_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested (product, URL) pairs with the source they reuse; NULL means a new one."""
    keys = ["product_id", "url_hash"]
    asked = first_row(
        requests.withColumn("url_hash", canonical_url_hash(F.col("url"))).where("url_hash IS NOT NULL"),
        keys, [F.col("url")], ["url"],
    )
    known = sources.withColumn("url_hash", canonical_url_hash(F.col("url"))).groupBy(*keys).agg(
        F.min("source_id").alias("source_id")
    )
    return asked.join(known, keys, "left").select(
        *keys, canonical_url(F.col("url")).alias("canonical_url"), "source_id",
        F.col("source_id").isNull().alias("created"),
    )


def eligible_sources(urls: DataFrame, products: DataFrame, sources: DataFrame) -> DataFrame:
    """Active URLs of active products, without those whose capture source was stopped."""
    stopped = sources.where("NOT active").select(
        "product_id", canonical_url_hash(F.col("url")).alias("url_hash")
    )
    return (
        urls.where(F.col("status") == "active")
        .join(products.where("active").select("product_id"), "product_id", "left_semi")
        .withColumn("url_hash", canonical_url_hash(F.col("url")))
        .join(stopped, ["product_id", "url_hash"], "left_anti")
    )


def new_snapshots(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots not stored yet under (source, artifact, digest); repeats in the batch count once."""
    keys = ["source_id", "artifact_ref", "digest"]
    return first_row(incoming, keys, [F.col("snapshot_id")]).join(
        stored.select(*keys), keys, "left_anti"
    )


# ------------------------------------------------------ review and auto-apply
def auto_apply_gate(
    candidates: DataFrame, urls: DataFrame, disabled_providers: Sequence[str] = ()
) -> DataFrame:
    """Candidates sure enough to be stored, with the reason one is still refused."""
    sure = candidates.where(
        (F.col("match_status") == "matched")
        & (F.col("match_method") == "exact_mpn_and_brand")
        & (F.col("confidence") > 0.90)
    )
    chosen = with_url_forms(
        sure.withColumn("_url", F.coalesce(F.nullif("canonical_url", F.lit("")), F.nullif("candidate_url", F.lit("")))),
        "_url",
    )
    manual = first_row(
        urls.where("url_type = 'manual'"), ["product_id", "source_name"], [F.col("url_id")], ["url"]
    ).select("product_id", "source_name", normalize_url(F.col("url")).alias("_manual"))
    joined = chosen.join(manual, ["product_id", "source_name"], "left")
    reason = (
        F.when(F.col("provider").isin(list(disabled_providers)),
               F.concat(F.lit("provider_auto_apply_disabled:"), "provider"))
        .when(F.col("product_id").isNull(), "catalog_product_id_missing")
        .when(F.col("_url").isNull(), "candidate_url_missing")
        .when(F.col("url_error").isNotNull(), F.concat(F.lit("invalid_url:"), "url_error"))
        .when(F.col("_manual").isNotNull() & (F.col("_manual") != F.col("url_normalized")), "manual_source_url_exists")
    )
    return joined.withColumn("reason", reason).drop("_url", "_manual", "url_error", "source_domain")


def apply_reviews(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after operator decisions, with the URL to promote and any refusal."""
    last = last_row(decisions, ["candidate_id"], [F.col("seq")])
    joined = candidates.join(
        last.select("candidate_id", "decision", F.nullif(trim_text(F.col("reviewed_url")), F.lit("")).alias("_url")),
        "candidate_id", "left",
    )
    decision = F.col("decision")
    promote = F.when(decision == "accept", F.coalesce("_url", F.nullif("candidate_url", F.lit("")))).when(
        decision == "replace_url", F.col("_url")
    )
    accepts = decision.isin("accept", "replace_url")
    error = (
        F.when(~decision.isin("accept", "reject", "replace_url"), "invalid decision")
        .when((decision == "replace_url") & F.col("_url").isNull(), "reviewed_url is required")
        .when(accepts & F.col("product_id").isNull(), "catalog_product_id is required")
        .when(accepts & promote.isNull(), "candidate_url is required")
    )
    ok = decision.isNotNull() & error.isNull()
    return joined.withColumns(
        {
            "review_error": error,
            "promoted_url": F.when(ok, normalize_url(promote)),
            "status": F.when(ok & accepts, "accepted").when(ok, "rejected").otherwise(F.col("status")),
        }
    ).drop("_url")


# -------------------------------------------------------------------- handoff
HANDOFF_SCHEMA = (
    "schema_version string, catalog_source string, catalog_product_id bigint, "
    "product struct<model:string,mpn:string>, "
    "sources array<struct<url:string,source_name:string,confidence:string,"
    "evidence:map<string,string>,price_evidence:struct<price:string,currency:string,"
    "confidence:string,observed_at:string>,raw_html:string>>"
)


def explode_handoffs(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per source URL of a handoff document."""
    parsed = docs.withColumn("_h", F.from_json(F.col(payload), HANDOFF_SCHEMA))
    rows = parsed.select("*", F.posexplode("_h.sources").alias("source_index", "_s")).where(
        trim_text(F.col("_s.url")) != ""
    )
    return rows.select(
        *[c for c in docs.columns if c != payload],
        "source_index",
        F.coalesce(F.nullif(F.trim("_h.catalog_source"), F.lit("")), F.lit("main")).alias("catalog_source"),
        F.col("_h.catalog_product_id").alias("catalog_product_id"),
        F.col("_h.product.model").alias("model"),
        F.col("_h.product.mpn").alias("mpn"),
        trim_text(F.col("_s.url")).alias("url"),
        F.col("_s.source_name").alias("source_name"),
        handoff_decimal(F.col("_s.confidence")).alias("confidence"),
        F.col("_s.evidence").alias("evidence"),
        handoff_decimal(F.col("_s.price_evidence.price")).alias("price"),
        handoff_decimal(F.col("_s.price_evidence.confidence")).alias("price_confidence"),
        F.col("_s.raw_html").alias("raw_html"),
    )


def handoff_decimal(col: Column) -> Column:
    """Money text; with both separators present the dots group thousands."""
    both = F.contains(col, F.lit(",")) & F.contains(col, F.lit("."))
    return lenient_decimal(F.when(both, F.replace(col, F.lit("."), F.lit(""))).otherwise(col))


def handoff_rows(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved handoff sources with the status their URL gets and its quality flags."""
    rows = with_url_forms(resolve_for_handoff(sources, catalog))
    values = F.lower(F.array_join(F.map_values(F.coalesce("evidence", F.create_map().cast("map<string,string>"))), " "))
    exact = F.col("match_type").isin("catalog_product_id", "model")
    sure = (F.col("confidence") >= ACTIVE_CONFIDENCE) | values.rlike("exact|confirmed|high_confidence|strong")
    status = F.when(exact & F.coalesce(sure, F.lit(False)), "active").otherwise("needs_review")
    supported = source_name(F.col("url")) != "unknown"
    return rows.withColumns(
        {
            "url_error": F.coalesce("url_error", F.when(~supported, "unsupported_host")),
            "status": status,
            "quality_flags": labels(
                (F.col("confidence") < ACTIVE_CONFIDENCE, "SOURCE_CONFIDENCE_LOW"),
                (F.col("price_confidence") < ACTIVE_CONFIDENCE, "PRICE_CONFIDENCE_LOW"),
                (F.coalesce("raw_html", F.lit("")) == "", "RAW_HTML_MISSING"),
            ),
        }
    )


def handoff_counters(report: DataFrame, apply: bool = False) -> DataFrame:
    """Import counters plus the first captures that come with a price."""
    fresh = F.col("action").isin("created", "updated") | (F.col("reason") == "already_exists")
    capture = fresh & (F.col("status") == "active") & F.col("price").isNotNull()
    name = "snapshot_count" if apply else "would_import_snapshot_count"
    extra = report.agg(F.count_if(capture).alias(name))
    return import_counters(report, apply).withColumn(name, extra.scalar())


# ------------------------------------------------------------------- cleaning
def sanitize_headers(headers: Column) -> Column:
    """Header map without blank and without sensitive names."""
    return F.map_filter(
        headers, lambda k, _v: (F.trim(k) != "") & ~F.lower(F.trim(k)).isin(SENSITIVE_HEADERS)
    )


def _harmless(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """Members of one JSON object without the sensitive ones; the parser calls it at every depth."""
    return {k: v for k, v in pairs if not any(mark in k.strip().lower() for mark in SENSITIVE_KEY_MARKERS)}


@F.pandas_udf(T.StringType())
def _sanitize_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def clean(text):
        try:
            return json.dumps(json.loads(text, object_pairs_hook=_harmless), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    for texts in batches:
        yield texts.map(clean, na_action="ignore")


def sanitize_json(payload: Column) -> Column:
    """JSON text without sensitive keys at any depth; texts without such words skip Python."""
    dirty = F.lower(payload).rlike("|".join(SENSITIVE_KEY_MARKERS))
    return F.coalesce(_sanitize_texts(F.when(dirty, payload)), payload)
