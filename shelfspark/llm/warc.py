"""Resolution of not-modified revisit records against the latest earlier full response.

Records are matched by the canonical form of their address: an as-of join takes, for each
revisit, the latest response of that address that is not later. The revisit is resolved if
its validator agrees: the entity tag if both have one, else the modification time, else the
payload digest. A resolved record takes the response's headers, updated by those headers of
the revisit that a not-modified answer may change.

The as-of join is a range partition by (address, time) and two small steps: the latest
response inside the partition, and for partitions that start in the middle of an address
the last response of an earlier partition. One address with a third of all records spans
many partitions; only one row per address and partition is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import saved

# Header fields that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that only track the visitor.
TRACKING = "utm_[^&]*|ref|gclid|fbclid"


def canonical(url: Column) -> Column:
    """Address without scheme, www., default port, fragment, tracking parameters and last slash.

    The host is lower-cased. A null or blank address has no canonical form.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www\\.", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.concat(F.lit("&"), F.regexp_replace(F.regexp_replace(rest, "^[^?]*", ""), "^\\?", ""))
    query = F.regexp_replace(F.regexp_replace(query, f"&({TRACKING})(=[^&]*)?(?=&|$)", ""), "^&+", "")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.trim(url) != "", whole)


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every revisit with the response it stands for.

    ``records``: record_id (long), kind ('response' or 'revisit'), url, at (timestamp), etag,
    last_modified, digest (strings) and headers (map of lower-case names to texts).
    Result: record_id, url_key, at, status ('resolved', 'changed' where the validators
    disagree, 'unmatched' without an earlier response), refers_to (the response's id if
    resolved), lag_seconds, and headers (merged if resolved, else the revisit's own).

    At equal times responses come before revisits, the larger id counts as later. Records
    without address or time match nothing: revisits among them are unmatched. Records of
    other kinds are ignored. Repeated rows are resolved each. Missing headers count as none.
    """
    none = F.create_map().cast("map<string,string>")
    kept = records.where("kind IN ('response', 'revisit')").select(
        F.col("record_id").cast("bigint").alias("record_id"), (F.col("kind") == "revisit").alias("revisit"),
        canonical(F.col("url").cast("string")).alias("url_key"), F.col("at").cast("timestamp").alias("at"),
        "etag", "last_modified", "digest", F.coalesce("headers", none).alias("headers"))
    known = kept.where("url_key IS NOT NULL AND at IS NOT NULL")
    lost = kept.where("revisit AND (url_key IS NULL OR at IS NULL)")
    order = ["url_key", "at", "revisit", "record_id"]
    dealt = known.repartitionByRange(partitions, *order) if partitions else known.repartitionByRange(*order)
    # Written once, so that a partition's number means the same rows in every later step.
    ranged = saved(dealt.withColumn("part", F.spark_partition_id()))
    response = F.struct("at", "record_id", "etag", "last_modified", "digest", "headers")
    mine = F.when(~F.col("revisit"), response)
    here = Window.partitionBy("part", "url_key").orderBy("at", "revisit", "record_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("inside", F.last(mine, ignorenulls=True).over(here)).where("revisit")
    # Last response of an address per partition, for the partitions after it.
    lasts = ranged.where("NOT revisit").groupBy("url_key", "part").agg(
        F.max_by(response, F.struct("at", "record_id")).alias("last"))
    spans = ranged.groupBy("url_key", "part").agg(F.count("*").alias("n")).drop("n")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(lasts, ["url_key", "part"], "left").withColumn(
        "before", F.last("last", ignorenulls=True).over(earlier)).where("before IS NOT NULL").select("url_key", "part", "before")
    joined = seen.join(carried, ["url_key", "part"], "left").withColumn("target", F.coalesce("inside", "before"))
    agrees = F.coalesce(
        F.col("etag") == F.col("target.etag"), F.col("last_modified") == F.col("target.last_modified"),
        F.col("digest") == F.col("target.digest"), F.lit(False))
    judged = joined.withColumn(
        "status", F.when(F.col("target").isNull(), "unmatched").when(agrees, "resolved").otherwise("changed"))
    resolved = F.col("status") == "resolved"
    update = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    base = F.map_filter("target.headers", lambda k, _: ~F.array_contains(F.map_keys(F.col("update")), k))
    out = judged.withColumn("update", update).select(
        "record_id", "url_key", "at", "status", F.when(resolved, F.col("target.record_id")).alias("refers_to"),
        F.when(resolved, F.unix_timestamp("at") - F.unix_timestamp("target.at")).alias("lag_seconds"),
        F.when(resolved, F.map_concat(base, "update")).otherwise(F.col("headers")).alias("headers"))
    return out.unionByName(lost.select(
        "record_id", "url_key", "at", F.lit("unmatched").alias("status"), F.lit(None).cast("bigint").alias("refers_to"),
        F.lit(None).cast("bigint").alias("lag_seconds"), "headers"))


def header_text(headers: Column) -> Column:
    """Headers as sorted lines, for results that hold no maps."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
