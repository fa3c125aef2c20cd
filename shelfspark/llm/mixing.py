"""Mixing of sources to target weights: tempered shares, realised as block permutations.

A source with the share p of all tokens gets the weight p^a / sum(p^a). The exponent a
between 0 (all sources alike) and 1 (as they are) is bisected to meet a target: the
smallest entropy wanted, or the largest number of repetitions allowed. The sources' token
sums are the only thing gathered, and each look at them decides several halvings at once:
one aggregate gives all interior points, and one row comes to the driver.

The mix is a sequence of blocks. A source's documents are permuted by a hash, epoch after
epoch, and dealt to the blocks in that order so that each block holds the weight's share
of its tokens; inside a block all documents are permuted by another hash.

Everything is DataFrame code. Running sums within a source go through hash buckets of
about ``bucket_rows`` rows: sums per bucket first, then inside the bucket, so a source
with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import saved

LEVELS = 5  # halvings decided by one look at the sources
LOOKS = 8


@dataclass(frozen=True)
class Target:
    """Exactly one goal: entropy as a part of the largest possible, or times a source may repeat."""

    entropy: float | None = None
    repetition: float | None = None


def blanks(text: Column) -> Column:
    """Tokens of a text as its blanks plus one, at least 1 so that empty texts take a place."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def exponent(sources: DataFrame, target: Target, budget: int | None = None) -> float:
    """Largest exponent (entropy) or smallest one (repetition) that meets the target.

    ``sources`` has one row per source with its ``tokens``. If no exponent meets the target,
    the nearest end of 0..1 is the answer; no sources give 1.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("low"),
                        F.max("tokens").alias("high")).first()
    if not total.n:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total.t)))
    x_low, x_high = math.log(total.low / total.t), math.log(total.high / total.t)

    def meets(a: float, z: float, s: float) -> bool:
        """Whether the exponent is still on the wanted side."""
        if target.entropy is not None:
            return math.log(z) - a * s / z >= target.entropy * math.log(total.n) - 1e-12
        size = budget / total.t if budget else z * math.exp((1 - a) * x_high)
        return size * math.exp((a - 1) * x_low) / z <= target.repetition + 1e-12

    low, high = 0.0, 1.0
    for _ in range(LOOKS):
        points = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
        sums = sources.agg(*[F.sum(F.exp(share * a)) for a in points], *[F.sum(share * F.exp(share * a)) for a in points]).first()
        at = len(points)
        inside = [meets(a, sums[i], sums[at + i]) for i, a in enumerate(points)]
        # Entropy falls with the exponent, so does the number of repetitions.
        if target.entropy is not None:
            step = sum(1 for ok in inside if ok)
        else:
            step = sum(1 for ok in inside if not ok)
        edges = [low, *points, high]
        low, high = edges[step], edges[step + 1]
    return low if target.entropy is not None else high


def weights(docs: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """name, docs, tokens, weight and quota (tokens in the mix), one row per source name.

    Without a ``budget`` the mix is as small as it can be with every document in it once.
    """
    sources = saved(docs.groupBy("name").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    a = exponent(sources, target, budget)
    sums = sources.agg(F.sum("tokens").alias("t")).first()
    tempered = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(sums.t or 1))))
    z = sources.agg(F.sum(tempered)).first()[0] or 1.0
    weighed = sources.withColumn("weight", tempered / F.lit(z))
    size = float(budget) if budget else weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    return weighed.withColumn("quota", F.greatest(F.ceil(F.col("weight") * F.lit(size) - F.lit(1e-6)), F.lit(1)).cast("bigint"))


def _key(seed: str, *columns: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def mix(
    docs: DataFrame, target: Target, budget: int | None = None, block: int = 262_144, bucket_rows: int = 4096,
    whole: bool = False,
) -> DataFrame:
    """Rows of the mix: doc_id, source, tokens, epoch, block, position; with ``whole`` also the ``row`` itself.

    Order by block and position to read the mix. A document appears once per epoch of its
    source; the last epoch stops where the source's quota of tokens is reached. A null
    source is a source of its own; documents without text count one token; repeated rows
    and null ids are rows like others; an empty table gives an empty mix.
    """
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        blanks(F.col("text").cast("string")).alias("tokens"),
        # One name per source, a null one included, so that plain equality joins meet it.
        F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("name"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []),
    )
    carried = ["row"] if whole else []
    plan = saved(weights(own, target, budget))
    size = plan.agg(F.sum("quota")).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    sources = plan.select(
        "name", "quota", F.col("tokens").alias("all_tokens"),
        F.ceil(F.col("docs") / bucket_rows).alias("buckets"),
    )
    rows = (own.join(sources, "name")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("all_tokens")).cast("int"))))
            .withColumn("key", _key("order", "epoch", "doc_id", "tokens"))
            .withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.col("buckets") / F.lit(2.0**32))))
    group = ["name", "epoch", "bucket"]
    narrow = rows.select(*group, "tokens").groupBy(*group).agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("name", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(narrow.select(
        *group, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy(*group).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
              .join(offsets, group)
              .withColumn("start", F.col("epoch") * F.col("all_tokens") + F.col("offset") + F.col("ahead"))
              .where("start < quota")
              # Whole numbers only, so that every engine puts a document into the same block.
              .withColumn("block", F.expr(f"(cast(start AS decimal(38,0)) * {blocks}) div quota").cast("bigint")))
    shuffled = Window.partitionBy("block").orderBy("shuffle", "key")
    return (placed.withColumn("shuffle", _key("block", "epoch", "doc_id", "tokens"))
            .withColumn("position", F.row_number().over(shuffled).cast("bigint"))
            .select("doc_id", "source", "tokens", F.col("epoch").cast("bigint").alias("epoch"), "block", "position",
                    *carried))
