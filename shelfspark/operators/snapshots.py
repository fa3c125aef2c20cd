"""Stored catalog snapshots with a tree of hashes, so that a check reads only what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.changes import build_snapshot
from shelfspark.operators.skew import multiset_hash

LEAF = "_leaf"
LEAVES, FAN = 256, 16
ROWS = f"model string, row_hash string, {LEAF} int"


def _with_leaf(rows: DataFrame, leaves: int) -> DataFrame:
    return rows.withColumn(LEAF, F.pmod(F.xxhash64("model"), F.lit(leaves)).cast("int"))


def _nodes(hashed: DataFrame, fan: int) -> DataFrame:
    """(level, node, row_count, content_hash): the leaves, their parents, and the root, each from the level below."""
    leaves = multiset_hash(hashed, ["row_hash"], [LEAF]).select(F.lit(0).alias("level"), F.col(LEAF).alias("node"), "row_count", "content_hash")

    def above(below: DataFrame, level: int, node) -> DataFrame:
        # A digest of the children's names and digests; the row count is theirs.
        kids = below.withColumn("parent", node).withColumn("name", F.concat_ws(":", "node", "content_hash"))
        own = multiset_hash(kids, ["name"], ["parent"]).select("parent", "content_hash")
        sums = kids.groupBy("parent").agg(F.sum("row_count").alias("row_count"))
        return own.join(sums, "parent").select(F.lit(level).alias("level"), F.col("parent").alias("node"), "row_count", "content_hash")

    middle = above(leaves, 1, F.floor(F.col("node") / fan).cast("int"))
    return leaves.unionByName(middle).unionByName(above(middle, 2, F.lit(0)))


def store_snapshot(products: DataFrame, path: str, leaves: int = LEAVES, fan: int = FAN) -> None:
    """Write the catalog's row hashes by leaf, and the tree over them."""
    hashed = _with_leaf(build_snapshot(products).select("model", "row_hash"), leaves)
    hashed.repartition(LEAF).write.mode("errorifexists").partitionBy(LEAF).parquet(f"{path}/rows")
    stored = products.sparkSession.read.schema(ROWS).parquet(f"{path}/rows")
    _nodes(stored, fan).withColumn("leaves", F.lit(leaves)).withColumn("fan", F.lit(fan)).coalesce(1).write.parquet(f"{path}/tree")


def stored_root(spark: SparkSession, path: str) -> DataFrame:
    """Row count and content hash of a stored snapshot; no rows for an empty one."""
    return spark.read.parquet(f"{path}/tree").where("level = 2").select("row_count", "content_hash")


def differing_leaves(products: DataFrame, path: str) -> list[int]:
    """Leaves whose rows are not those of the stored snapshot, found from the root down."""
    tree = products.sparkSession.read.parquet(f"{path}/tree")
    layout = tree.select("leaves", "fan").first()
    leaves, fan = (layout.leaves, layout.fan) if layout else (LEAVES, FAN)
    now = _nodes(_with_leaf(build_snapshot(products).select("model", "row_hash"), leaves), fan)
    both = now.select("level", "node", F.col("content_hash").alias("now")).join(
        tree.select("level", "node", F.col("content_hash").alias("then")), ["level", "node"], "full_outer")
    # At most as many rows as the tree has nodes.
    changed = {(r.level, r.node) for r in both.where("NOT (now <=> then)").collect()}
    if (2, 0) not in changed:
        return []
    return sorted(leaf for level, leaf in changed if level == 0 and (1, leaf // fan) in changed)


def verify_stored(products: DataFrame, path: str) -> DataFrame:
    """Models as same, changed, added or removed against the stored snapshot.

    Rows of a model count as one bag, so a change in any of several rows of a model is seen.
    Only leaves whose hashes differ are read and joined; the models of all others are the same.
    """
    spark = products.sparkSession
    layout = spark.read.parquet(f"{path}/tree").select("leaves").first()
    leaves = layout.leaves if layout else LEAVES
    open_leaves = differing_leaves(products, path)
    here = _with_leaf(build_snapshot(products).select("model", "row_hash"), leaves)
    inside = F.col(LEAF).isin(open_leaves) if open_leaves else F.lit(False)
    same = here.where(~inside).select("model").distinct().withColumn("state", F.lit("same"))
    bag = lambda rows, name: multiset_hash(rows, ["row_hash"], ["model"]).select("model", F.col("content_hash").alias(name))
    now = bag(here.where(inside), "now")
    then = bag(spark.read.schema(ROWS).parquet(f"{path}/rows").where(inside), "then")
    state = (
        F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.col("now") == F.col("then"), "same").otherwise("changed")
    )
    return same.unionByName(now.join(then, "model", "full_outer").select("model", state.alias("state")))
