"""Catalog: row typing, filters, facets, paging, merge with soft delete."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.categories import deepest_levels, level
from shelfspark.functions.money import MONEY, lenient_double, lenient_int, usable
from shelfspark.functions.text import fold_case, trim_text
from shelfspark.operators.skew import first_row

URL_STATUSES = ["active", "needs_review", "broken", "disabled", "redirected"]


# ----------------------------------------------------------------- row typing
def is_atomic_model(model: Column) -> Column:
    """A single sellable product: exactly six digits."""
    return trim_text(model).rlike("^[0-9]{6}$")


def labels(*conditions: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    found = F.array(*[F.when(cond, F.lit(name)) for cond, name in conditions])
    return F.filter(found, lambda x: x.isNotNull())


def type_catalog(raw: DataFrame) -> DataFrame:
    """Catalog text rows to typed rows; nothing is rejected, doubts become warnings."""
    levels = deepest_levels(F.col("category"))
    texts = {c: trim_text(F.col(c)) for c in ("model", "mpn", "name", "category", "manufacturer")}
    typed = raw.withColumns(
        {
            **texts,
            "raw_category": texts["category"],
            "category_levels": levels,
            "price": lenient_double(F.col("price")).cast(MONEY),
            **{
                c: lenient_int(F.col(c))
                for c in ("quantity", "status", "market_a_status", "market_b_status")
            },
        }
    )
    atomic, has_mpn = is_atomic_model(F.col("model")), F.col("mpn") != ""
    return typed.withColumns(
        {
            "family": level(F.col("category_levels"), 1),
            "category_name": level(F.col("category_levels"), 2),
            "sub_category": level(F.col("category_levels"), 3),
            "is_atomic_model": atomic,
            "automation_eligible": atomic & has_mpn,
            "warnings": labels((~atomic, "composite_or_invalid_model"), (~has_mpn, "missing_mpn")),
        }
    )


# -------------------------------------------------------------------- filters
def market_predicate(kind: str) -> Column:
    """Listed on market ``a``, on ``b``, on ``both`` or on ``none`` of them."""
    a = F.col("market_a_status").eqNullSafe(1)
    b = F.col("market_b_status").eqNullSafe(1)
    return {"a": a, "b": b, "both": a & b, "none": ~a & ~b}[kind]


@dataclass(frozen=True)
class CatalogFilter:
    """Browse filter; a field left at its default does not filter."""

    q: str | None = None
    category: str | None = None
    family: str | None = None
    category_name: str | None = None
    sub_category: str | None = None
    manufacturer: str | None = None
    market: str | None = None
    has_mpn: bool | None = None
    has_quantity: bool | None = None
    atomic_only: bool = False
    automation_eligible_only: bool = False
    has_source_url: bool | None = None
    source_name: str | None = None
    ignored: str | None = None  # "exclude" or "only"


def catalog_predicates(f: CatalogFilter) -> list[Column]:
    """The filter's conditions on the product row itself."""
    out: list[Column] = []
    if f.q and f.q.strip():
        needle = f.q.strip()
        hits = [
            F.contains(fold_case(F.col(c)), fold_case(F.lit(needle)))
            for c in ("model", "mpn", "name", "manufacturer")
        ]
        out.append(hits[0] | hits[1] | hits[2] | hits[3])
    for name in ("category", "family", "category_name", "sub_category", "manufacturer"):
        value = (getattr(f, name) or "").strip()
        if value:
            out.append(F.col(name) == value)
    if f.market:
        out.append(market_predicate(f.market))
    if f.has_mpn is not None:
        out.append(F.col("mpn") != "" if f.has_mpn else F.col("mpn") == "")
    if f.has_quantity:
        out += [F.col("status") == 1, F.col("quantity") > 0]
    if f.atomic_only:
        out.append(F.col("is_atomic_model"))
    if f.automation_eligible_only:
        out.append(F.col("automation_eligible"))
    return out


def with_active_url(products: DataFrame, urls: DataFrame, present: bool, source: str | None = None) -> DataFrame:
    """Products that have, or lack, an active source URL."""
    active = urls.where(F.col("status") == "active")
    if source and source.strip().lower() != "all":
        active = active.where(F.lower("source_name") == source.strip().lower())
    how = "left_semi" if present else "left_anti"
    return products.join(active.select("product_id"), "product_id", how)


def filter_catalog(
    products: DataFrame,
    f: CatalogFilter,
    urls: DataFrame | None = None,
    ignored: DataFrame | None = None,
) -> DataFrame:
    out = products
    for cond in catalog_predicates(f):
        out = out.where(cond)
    if f.has_source_url is not None:
        out = with_active_url(out, urls, f.has_source_url, f.source_name)
    if ignored is not None and (f.ignored == "exclude" or f.automation_eligible_only):
        out = out.join(ignored.select("model"), "model", "left_anti")
    if f.ignored == "only":
        out = out.join(ignored.select("model"), "model", "left_semi")
    return out


def exclude_models(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose trimmed model is on the list are removed; blank models stay."""
    listed = excluded.select(trim_text(F.col("model")).alias("_model")).where(F.col("_model") != "")
    return rows.join(listed, trim_text(rows["model"]) == F.col("_model"), "left_anti")


# --------------------------------------------------------------- sort and page
SORT_TEXT = ("model", "name", "manufacturer", "category")
SORT_NUMBER = ("price", "quantity")


def catalog_order(sort_by: str | None, descending: bool = False) -> list[Column]:
    """Missing values come last when ascending and first when descending; id settles ties."""
    if sort_by is None:
        return [F.col("product_id").asc()]
    if sort_by not in SORT_TEXT + SORT_NUMBER:
        raise ValueError(f"cannot sort by {sort_by}")
    key = F.lower(sort_by) if sort_by in SORT_TEXT else F.col(sort_by)
    return [key.desc_nulls_first() if descending else key.asc_nulls_last(), F.col("product_id").asc()]


def catalog_page(
    filtered: DataFrame, page: int, size: int, sort_by: str | None = None, descending: bool = False
) -> DataFrame:
    return filtered.orderBy(*catalog_order(sort_by, descending)).offset((page - 1) * size).limit(size)


def page_totals(products: DataFrame, f: CatalogFilter) -> DataFrame:
    """Row counts before and after the row-level filter, in one pass."""
    keep = F.lit(True)
    for cond in catalog_predicates(f):
        keep = keep & F.coalesce(cond, F.lit(False))
    return products.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("filtered_total")
    )


# --------------------------------------------------------------------- facets
def catalog_summary(products: DataFrame) -> DataFrame:
    """Conditional and distinct counts of the catalog.

    Rows are first reduced to one per facet combination, so the distinct counts expand
    only that small set.
    """
    dims = ["category", "family", "category_name", "sub_category", "manufacturer"]
    flags = {
        "total_products": F.lit(True),
        "active_products": F.col("status").eqNullSafe(1),
        "atomic_products": F.col("is_atomic_model"),
        "composite_or_invalid_models": ~F.col("is_atomic_model"),
        "market_a_products": F.col("market_a_status").eqNullSafe(1),
        "market_b_products": F.col("market_b_status").eqNullSafe(1),
        "missing_mpn": F.col("mpn") == "",
    }
    combos = products.groupBy(*dims).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return combos.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags],
        *[
            F.count_distinct(F.nullif(F.col(d), F.lit(""))).alias(f"{d}_count")
            for d in dims
        ],
    )


def facet_counts(products: DataFrame, column: str) -> DataFrame:
    return (
        products.where(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    )


def category_facets(products: DataFrame) -> DataFrame:
    """Products per category text with the parsed levels of its first product."""
    parsed = F.struct("raw_category", "family", "category_name", "sub_category", "category_levels")
    return (
        products.where(F.col("category") != "")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("count"), F.min_by(parsed, "product_id").alias("p"))
        .select("category", "count", "p.*")
    )


def category_hierarchy(products: DataFrame) -> DataFrame:
    """Counts at family, category, sub-category and raw-category level, one row per node."""
    dims = ["family", "category_name", "sub_category", "raw_category"]
    leaves = (
        products.where(F.col("family") != "").groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    )
    nodes = leaves.rollup(*dims).agg(F.sum("n").alias("count"), F.grouping_id().alias("gid"))
    names = {7: "family", 3: "category", 1: "sub_category", 0: "raw_category"}
    depth = F.when(F.col("gid") == 7, names[7])
    for gid in (3, 1, 0):
        depth = depth.when(F.col("gid") == gid, names[gid])
    return (
        nodes.where(F.col("gid") < 15)
        .where((F.col("gid") != 0) | (F.col("raw_category") != ""))
        .select(depth.alias("level"), *dims, "count")
    )


# ----------------------------------------------------------- selection badges
def selection_state(products: DataFrame, url_counts: DataFrame, ignored: DataFrame) -> DataFrame:
    """First reason a product cannot be selected, and its warning badges."""
    listed = ignored.select("model").distinct().withColumn("_ignored", F.lit(True))
    joined = products.join(
        url_counts.select(
            "product_id", F.col("active").alias("_active"), F.col("needs_review").alias("_review")
        ),
        "product_id",
        "left",
    ).join(listed, "model", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    blocker = (
        F.when(~F.col("automation_eligible") & ~F.col("is_atomic_model"), "Composite")
        .when(~F.col("automation_eligible") & (F.col("mpn") == ""), "Missing MPN")
        .when(~F.col("automation_eligible"), "Automation blocked")
        .when(F.col("_ignored"), "Ignored")
        .when(count("_active") > 0, F.lit(None).cast("string"))
        .when(count("_review") > 0, "Source URL review")
        .otherwise("Missing source URL")
    )
    badges = labels(
        (F.coalesce(F.col("status") != 1, F.lit(False)), "Disabled"),
        (~usable(F.col("price")), "Zero price"),
    )
    return joined.select(
        "product_id", "model", blocker.alias("blocker"), badges.alias("warning_badges")
    )


def lookup_by_model(requested: DataFrame, warehouse: DataFrame) -> DataFrame:
    """State of each requested model in a warehouse file: found, missing, repeated or unnamed."""
    rows = (
        warehouse.select(trim_text(F.col("model")).alias("model"), trim_text(F.col("name")).alias("name"))
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("hits"), F.min("name").alias("name"))
    )
    state = (
        F.when(F.col("hits").isNull(), "not_found")
        .when(F.col("hits") > 1, "duplicate")
        .when(F.col("name") == "", "empty_name")
        .otherwise("found")
    )
    return requested.join(rows, "model", "left").select(
        *requested.columns,
        state.alias("state"),
        F.when(state == "found", F.col("name")).alias("warehouse_name"),
    )


# ---------------------------------------------------------------------- merge
def merge_catalog(existing: DataFrame, incoming: DataFrame, seq: str = "row_no") -> DataFrame:
    """New state of the catalog after one import file, one row per model.

    ``action``: inserted, updated, inactivated, unchanged (was inactive already) or
    quarantined (a new model that the file names more than once). The last row of a
    repeated known model wins. ``file_rows`` counts the rows of the file behind it.
    """
    values = [c for c in existing.columns if c not in ("model", "active")]
    latest = (
        incoming.withColumn("model", trim_text(F.col("model")))
        .where(F.col("model") != "")
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("file_rows"),
            F.max_by(F.struct(*values), F.col(seq)).alias("new"),
        )
    )
    old = existing.select(
        "model", F.struct(*values).alias("old"), F.col("active").alias("was_active")
    )
    both = old.join(latest, "model", "full_outer")
    known, named = F.col("was_active").isNotNull(), F.col("file_rows").isNotNull()
    action = (
        F.when(named & known, "updated")
        .when(named & (F.col("file_rows") > 1), "quarantined")
        .when(named, "inserted")
        .when(F.col("was_active"), "inactivated")
        .otherwise("unchanged")
    )
    merged = both.select(
        "model",
        action.alias("action"),
        F.coalesce("file_rows", F.lit(0)).alias("file_rows"),
        (named & (action != "quarantined")).alias("active"),
        F.coalesce("new", "old").alias("v"),
    )
    return merged.select("model", "action", "file_rows", "active", *[f"v.{c}" for c in values])


def ingest_result(merged: DataFrame, incoming: DataFrame) -> DataFrame:
    """Import counters; every file row of a known model counts as one update."""
    skipped = incoming.agg(F.count_if(trim_text(F.col("model")) == "").alias("skipped_invalid"))

    def rows(action: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("action") == action, F.col("file_rows"))), F.lit(0))

    counts = merged.agg(
        F.coalesce(F.sum("file_rows"), F.lit(0)).alias("imported"),
        rows("inserted").alias("inserted"),
        rows("updated").alias("updated"),
        rows("quarantined").alias("quarantined"),
        F.count_if(F.col("action") == "inactivated").alias("inactive_or_missing"),
    )
    return counts.withColumn("skipped_invalid", skipped.scalar())


def missing_models(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Active models the new file no longer names."""
    named = incoming.select(trim_text(F.col("model")).alias("model")).where(F.col("model") != "")
    return existing.where("active").join(named, "model", "left_anti")


def upsert_products(existing: DataFrame, incoming: DataFrame, seq: str = "row_no") -> DataFrame:
    """Products after an upsert keyed by model, or by MPN for rows without a model."""
    blank_to_null = lambda c: F.nullif(trim_text(F.col(c)), F.lit(""))
    carried = [c for c in existing.columns if c not in ("product_id", "model", "mpn", "active")]
    inc = incoming.select(
        blank_to_null("model").alias("model"),
        blank_to_null("mpn").alias("mpn"),
        F.col(seq).alias("_seq"),
        *carried,
    ).where(F.col("model").isNotNull() | F.col("mpn").isNotNull())
    by_model = existing.where(F.col("model").isNotNull()).groupBy("model").agg(
        F.min("product_id").alias("_by_model")
    )
    by_mpn = existing.where(F.col("mpn").isNotNull()).groupBy("mpn").agg(
        F.min("product_id").alias("_by_mpn")
    )
    # One row per identity before any lookup: the last row of the file wins.
    identity = F.when(F.col("model").isNotNull(), F.concat(F.lit("model:"), "model")).otherwise(
        F.concat(F.lit("mpn:"), "mpn")
    )
    last = first_row(inc.withColumn("_id", identity), ["_id"], [-F.col("_seq")])
    target = F.when(F.col("model").isNotNull(), F.col("_by_model")).otherwise(F.col("_by_mpn"))
    aimed = (
        last.join(by_model, "model", "left").join(by_mpn, "mpn", "left").withColumn("_target", target)
    )
    fields = F.struct("model", "mpn", *carried)
    hits = (
        aimed.where(F.col("_target").isNotNull())
        .groupBy(F.col("_target").alias("product_id"))
        .agg(F.max_by(fields, "_seq").alias("n"))
    )
    kept = existing.join(hits, "product_id", "left").select(
        "product_id",
        F.coalesce("n.model", "model").alias("model"),
        F.coalesce("n.mpn", "mpn").alias("mpn"),
        *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in carried],
        (F.col("n").isNotNull() | F.col("active")).alias("active"),
        F.when(F.col("n").isNotNull(), "updated").otherwise("unchanged").alias("action"),
    )
    new = aimed.where(F.col("_target").isNull()).select(
        F.lit(None).cast("bigint").alias("product_id"),
        "model",
        "mpn",
        *carried,
        F.lit(True).alias("active"),
        F.lit("inserted").alias("action"),
    )
    return kept.unionByName(new)


def last_per_model(rows: DataFrame, seq: str) -> DataFrame:
    """Ignore list as stored: blank models dropped, the last row of a model wins."""
    clean = rows.withColumn("model", trim_text(F.col("model"))).where(F.col("model") != "")
    return first_row(clean, ["model"], [-F.col(seq)])


def upsert_by_model(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` replace rows of the same model, the others are kept."""
    kept = existing.join(updates.select("model"), "model", "left_anti")
    return kept.unionByName(updates.select(*existing.columns))


def purge_models(
    tables: dict[str, DataFrame], products: DataFrame, excluded: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the excluded models, and how many rows each one lost.

    Products are kept but switched off; they appear in the counts when they were active.
    """
    listed = excluded.select(trim_text(F.col("model")).alias("model")).where("model <> ''").distinct()
    left = {n: t.join(listed, "model", "left_anti") for n, t in tables.items()}
    flag = listed.withColumn("_off", F.lit(True))
    left["products"] = (
        products.join(flag, "model", "left")
        .withColumn("active", F.col("active") & F.col("_off").isNull())
        .drop("_off")
    )
    counts = [
        t.join(listed, "model", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(n).alias("table_name"), "n"
        )
        for n, t in tables.items()
    ]
    counts.append(
        products.where("active").join(listed, "model", "left_semi")
        .agg(F.count(F.lit(1)).alias("n")).select(F.lit("products").alias("table_name"), "n")
    )
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    return left, report


def active_count_and_import(products: DataFrame, imported_at: str) -> DataFrame:
    active = products.where("active")
    return active.agg(
        F.count(F.lit(1)).alias("active_products"), F.max(imported_at).alias("latest_import")
    )


def model_batch_order(requested: DataFrame, products: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products named by a list of models, each once, in the order of the list."""
    first = (
        requested.select(F.col("position"), trim_text(F.col("model")).alias("model"))
        .where("model <> ''")
        .groupBy("model")
        .agg(F.min("position").alias("position"))
    )
    return first.join(products.select("model", *columns), "model").orderBy("position")
