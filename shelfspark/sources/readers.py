"""Readers for catalog, input, observation and candidate files. Cells are always read as text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import trim_text

# ---------------------------------------------------------------- fixed values
CATALOG_COLUMNS = [
    "model", "mpn", "name", "category", "manufacturer", "price", "quantity", "status",
    "bestprice_status", "skroutz_status",
]
MARKET_COLUMNS = {"bestprice_status": "market_a_status", "skroutz_status": "market_b_status"}
COMMON_ENRICHED = [
    "model", "mpn", "price", "match_status", "observed_at", "error_reason", "price_relation",
    "price_delta", "matched_mpn",
]
CONTRACTS = {
    "skroutz": [*COMMON_ENRICHED, "skroutz_price", "skroutz_url"],
    "bestprice": [*COMMON_ENRICHED, "bestprice_price", "bestprice_url"],
}
# Logical fields of a full catalog export and the headers they come under.
EXPORT_ALIASES = {
    "model": ["model", "internal_model", "internal_product_code", "product_code", "sku"],
    "product_id": ["product_id", "opencart_product_id", "catalog_product_id", "id"],
    "status": ["status", "product_status"],
    "active": ["active", "is_active", "enabled"],
    "name": ["name", "product_name"],
    "description": ["description", "product_description"],
    "meta_title": ["meta_title", "meta_title_1", "metadata_title"],
    "meta_description": ["meta_description", "meta_description_1", "metadata_description"],
    "meta_keywords": ["meta_keywords", "meta_keyword", "meta_keywords_1", "metadata_keywords"],
    "seo_keyword": ["seo_keyword", "seo_url_keyword", "keyword", "slug"],
    "canonical_url": ["canonical_url", "canonical_product_url", "product_url", "store_product_url", "url"],
    "mpn": ["mpn", "manufacturer_part_number"],
    "ean": ["ean", "ean_code", "ean13"],
    "upc": ["upc", "upc_code"],
    "main_image": ["main_image", "image", "image_path", "main_image_path"],
    "additional_images": ["additional_images", "additional_image", "additional_image_paths", "gallery_images"],
    "category": ["category", "categories", "category_path"],
    "manufacturer": ["manufacturer", "manufacturer_name", "brand"],
    "related_products": ["related_products", "related_product", "related_models"],
    "price": ["price"],
    "quantity": ["quantity"],
    "stock_status": ["stock_status"],
}


class SourceError(ValueError):
    """A file does not have the shape its contract asks for."""


# --------------------------------------------------------------------- reading
def read_text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header; every cell is text, a missing cell is empty, headers are trimmed."""
    df = (
        spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
        .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return df.select(*[F.coalesce(F.col(f"`{old}`"), F.lit("")).alias(new) for old, new in zip(df.columns, names)])


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """``;`` or ``,`` by the header line; only the first line of the file is looked at."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return ";" if line.count(";") >= line.count(",") and ";" in line else ","


def load_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with detected delimiter; required columns renamed to their canonical names."""
    df = read_text_csv(spark, path, detect_delimiter(spark, path))
    return resolve_headers(df, required)


def resolve_headers(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns under any letter case; missing or doubled ones are an error."""
    found: dict[str, str] = {}
    for name in required:
        hits = [c for c in df.columns if c.casefold() == name.casefold()]
        if not hits:
            raise SourceError(f"missing required column: {name}")
        if len(hits) > 1:
            raise SourceError(f"multiple columns matched required field '{name}': {', '.join(hits)}")
        found[hits[0]] = name
    return df.select(*[F.col(f"`{c}`").alias(found.get(c, c)) for c in df.columns])


def detect_contract(columns: Sequence[str]) -> str:
    """Marketplace whose enriched-file contract the columns fulfil; exactly one must fit."""
    have = set(columns)
    fits = [name for name, need in CONTRACTS.items() if set(need) <= have]
    if len(fits) == 1:
        return fits[0]
    if fits:
        raise SourceError("enriched CSV matches multiple source contracts")
    gaps = "; ".join(f"{n}: missing {', '.join(c for c in need if c not in have)}" for n, need in CONTRACTS.items())
    raise SourceError(f"input file does not match a supported enriched contract ({gaps})")


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog export with its required columns and the raw row as a map."""
    df = read_text_csv(spark, path)
    missing = [c for c in CATALOG_COLUMNS if c not in df.columns]
    if missing:
        raise SourceError(f"catalog file missing required columns: {', '.join(missing)}")
    raw = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    return df.withColumn("raw_row", raw).withColumnsRenamed(MARKET_COLUMNS)


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """Batch upload of model, brand and name, with the reason a row spoils the file."""
    df = load_csv(spark, path, ["model", "brand", "name"])
    clean = df.select(*[trim_text(F.col(c)).alias(c) for c in ("model", "brand", "name")])
    return clean.withColumn(
        "error", F.when(F.col("model") == "", "empty_model").when(F.col("name") == "", "empty_name")
    )


def require_clean(rows: DataFrame, error: str = "error") -> DataFrame:
    """The rows without their error column; a single bad row rejects the whole file."""
    worst = rows.where(F.col(error).isNotNull()).select(error).limit(1).collect()
    if worst:
        raise SourceError(worst[0][0])
    return rows.drop(error)


def read_model_list(spark: SparkSession, path: str) -> DataFrame:
    """Exclusion list: a ``model`` column, or one bare column without a header."""
    df = read_text_csv(spark, path)
    named = [c for c in df.columns if c.casefold() == "model"]
    if named:
        rows = df.select(trim_text(F.col(f"`{named[0]}`")).alias("model"))
    elif len(df.columns) == 1:
        rows = spark.read.text(path).select(trim_text(F.regexp_replace("value", "^﻿", "")).alias("model"))
    else:
        raise SourceError("exclusion file needs a model header or a single column")
    return rows.where("model <> ''").distinct()


def read_export(df: DataFrame) -> DataFrame:
    """Full catalog export under its logical field names.

    A field may come under several headers; different non-empty values for one field and
    repeated models are marked in ``error``. ``filter_group:*`` columns become a map.
    """
    norm = lambda name: re.sub(r"[^a-z0-9]+", "_", name.strip().casefold()).strip("_")
    by_norm: dict[str, str] = {}
    for c in df.columns:
        if norm(c) in by_norm:
            raise SourceError(f"source export contains duplicate header: {c}")
        by_norm[norm(c)] = c
    fields: dict[str, Column] = {}
    conflict = F.lit(None).cast("string")
    for field, aliases in EXPORT_ALIASES.items():
        cols = [trim_text(F.col(f"`{by_norm[a]}`")) for a in aliases if a in by_norm]
        if not cols:
            continue
        filled = F.array_distinct(F.filter(F.array(*cols), lambda x: x != ""))
        fields[field] = F.coalesce(F.get(filled, F.lit(0)), F.lit(""))
        conflict = F.when(F.size(filled) > 1, F.lit(f"conflicting aliases for {field}")).otherwise(conflict)
    if "model" not in fields:
        raise SourceError("source export is missing a model column")
    groups = sorted(c for n, c in by_norm.items() if n.startswith("filter_group_"))
    filters = F.map_from_arrays(
        F.array(*[F.lit(c) for c in groups]), F.array(*[trim_text(F.col(f"`{c}`")) for c in groups])
    ) if groups else F.lit(None).cast("map<string,string>")
    rows = df.select(*[c.alias(n) for n, c in fields.items()], filters.alias("filters"), conflict.alias("_conflict"))
    times = rows.groupBy("model").agg(F.count(F.lit(1)).alias("_times"))
    error = (
        F.when(F.col("model") == "", "no model").when(F.col("_conflict").isNotNull(), F.col("_conflict"))
        .when(F.col("_times") > 1, "duplicate model")
    )
    return rows.join(times, "model").withColumn("error", error).drop("_conflict", "_times")


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows of all CSV files below a folder, with their file and any error."""
    df = (
        spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .option("multiLine", True).option("escape", '"').csv(folder)
    )
    rows = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in df.columns],
                     F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("model", trim_text(F.col("model")))
    times = rows.groupBy("model").agg(F.count(F.lit(1)).alias("_times"))
    error = F.when(~F.col("model").rlike("^[0-9]{6}$"), "model is not six digits").when(F.col("_times") > 1, "duplicate model")
    return rows.join(times, "model").withColumn("error", error).drop("_times")


def preview(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """First rows of a file and how many there are."""
    return df.limit(n), df.count()


def read_table(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """A stored table: Parquet from a path, or JDBC when connection options are given."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


def read_transfer(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Entities of a registry transfer as written by ``write_transfer``."""
    return {name: spark.read.json(f"{folder}/{name}") for name in ("source_urls", "runs", "candidates")}
