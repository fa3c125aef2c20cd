"""Writers with fixed column order. A sink never overwrites the folder it reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.catalog import exclude_models
from shelfspark.operators.monitoring import export_rows

RUN_INPUT_COLUMNS = ["model", "mpn", "name", "price"]
REVIEW_COLUMNS = [
    "model", "mpn", "name", "source", "current_price", "competitor_price", "competitor_store", "competitor_url",
    "price_delta", "price_delta_percent", "recommended_action", "selected_action", "undercut_amount",
    "target_price", "status", "warnings",
]
PRICE_ONLY_COLUMNS = ["model", "mpn", "price"]


def _flat(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in order as text; a missing column is empty, lists are joined by ``;``."""
    kinds = dict(df.dtypes)

    def text(name: str):
        if name not in kinds:
            return F.lit("").alias(name)
        col = F.col(f"`{name}`")
        if kinds[name].startswith("array"):
            col = F.array_join(col.cast("array<string>"), ";")
        return F.coalesce(col.cast("string"), F.lit("")).alias(name)

    return df.select(*[text(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], compression: str = "none") -> None:
    _flat(df, columns).write.mode("errorifexists").option("compression", compression).option("header", True).option("quoteAll", False).option(
        "escape", '"'
    ).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_price_update(reviewed: DataFrame, ignored: DataFrame, path: str) -> None:
    """Price file for the shop: model and two-decimal price of the rows that may go out."""
    write_csv(export_rows(reviewed, ignored), path, ["model", "price"])


def write_review(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, REVIEW_COLUMNS)


def write_run_input(products: DataFrame, path: str) -> None:
    write_csv(products, path, RUN_INPUT_COLUMNS)


def write_price_only(priced: DataFrame, path: str) -> None:
    write_csv(priced.withColumn("price", F.col("output_price")), path, PRICE_ONLY_COLUMNS)


def product_csv_rows(products: DataFrame, filters: DataFrame, template: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Template columns in order, then one ``filter_group:*`` column per group that has a value.

    ``filters``: ``model, group_name, value``; the groups are configuration.
    """
    wide = filters.groupBy("model").pivot("group_name", list(groups)).agg(F.first("value"))
    used = wide.agg(*[F.count_if(F.coalesce(F.col(f"`{g}`"), F.lit("")) != "").alias(g) for g in groups]).first()
    kept = [g for g in groups if used[g]]
    named = wide.select("model", *[F.col(f"`{g}`").alias(f"filter_group:{g}") for g in kept])
    joined = products.join(named, "model", "left")
    return _flat(joined, [*template, *[f"filter_group:{g}" for g in kept]])


def write_plan_artifacts(plan: DataFrame, totals: DataFrame, folder: str) -> None:
    """Plan rows, blocked rows and a summary, each in its own folder, as gzip files: a plan has a row per model and field."""
    columns = ["model", "field", "current_value", "candidate_value", "classification", "reason", "approval_requirement"]
    write_csv(plan, f"{folder}/products", columns, "gzip")
    write_csv(plan.where("classification = 'blocked'"), f"{folder}/blocked", columns, "gzip")
    totals.write.mode("errorifexists").json(f"{folder}/summary")


def write_filtered_catalog(catalog: DataFrame, excluded: DataFrame, path: str) -> DataFrame:
    """Catalog without the excluded models, and the row counts before and after."""
    kept = exclude_models(catalog, excluded)
    write_csv(kept, path, catalog.columns)
    before = catalog.agg(F.count(F.lit(1)).alias("input_rows"))
    after = kept.agg(F.count(F.lit(1)))
    return before.withColumn("output_rows", after.scalar()).withColumn(
        "removed_rows", F.col("input_rows") - F.col("output_rows")
    )


def write_transfer(entities: dict[str, DataFrame], folder: str) -> None:
    """Registry URLs, runs and candidates as JSON lines in gzip files, one folder per entity."""
    for name, df in entities.items():
        df.write.mode("errorifexists").option("compression", "gzip").json(f"{folder}/{name}")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
