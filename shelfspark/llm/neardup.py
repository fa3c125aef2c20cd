"""Near-duplicate documents by one-permutation MinHash, banded buckets and star edges.

A document's shingles are hashed once; the hash range is cut into bins and the smallest
value of each bin is the signature. An empty bin borrows from the first filled bin in an
order of its own that is the same for all documents (optimal densification). ``rows`` bins
make a band, and documents with an equal band share a bucket.

A bucket never yields all its pairs: it yields a star, edges from one centre to the other
members. The centre is the member that shares buckets with most others, as the text that
many copies were made from does. Every edge is measured on the full shingle sets, and the
links' components are found. Two members x and y of one centre c that are still in different
components can only be linked

* if they share a shingle that c does not have, among the first few such shingles of both
  (the usual prefix of a similarity join, here of the sets less c), or
* if what they share with c is enough by itself, which the measured sizes tell.

So the members meet again in buckets of such shingles, and pairs of the second kind are
compared directly. Copies of one text differ in rare shingles, so these buckets are small
however many copies there are. In them members of the smaller components are centres in
turn, at most ``FAN`` per bucket and round, until one component is left or every member was
a centre. No candidate pair of different components stays unchecked.
Documents with equal sets meet by a digest of the set first, so copies cost one row each.

Hot buckets and centres: minima are aggregated before the shuffle, and the joins are plain
equality joins of two exchanges, which the adaptive skew join can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import mix64, saved, small_batches

_MEMO: dict[bytes, int] = {}
_MEMO_WORDS = 500_000
FAN = 32
_SIGNED = "digest array<bigint>, bands array<bigint>"


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a bounded memo per Python worker spares repeated words."""
    if len(_MEMO) > _MEMO_WORDS:
        _MEMO.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        value = _MEMO.get(word)
        if value is None:
            value = _MEMO[word] = xxhash.xxh3_64_intdigest(word)
        out[i] = value
    return out


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs of other than space and U+0009 to U+000D, A-Z lower-cased. A text of
    fewer words has its whole sequence as the one shingle, an empty text none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, dtype=np.uint64)
    hashed = word_hashes(parts)
    width = min(words, len(parts))
    count = len(parts) - width + 1
    value = np.full(count, width, dtype=np.uint64)
    for at in range(width):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashed[at: at + count])
    return np.unique(value)


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled one."""
    return np.stack([np.random.default_rng(1_000 + b).permutation(bins) for b in range(bins)])


@lru_cache(maxsize=4)
def _weights(bands: int, rows: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, size=(bands, rows), dtype=np.uint64) | np.uint64(1)


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """Minimum per bin of sorted distinct hashes, empty bins densified."""
    bin_of = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(bin_of, return_index=True)
    out = np.zeros(bins, dtype=np.uint64)
    out[filled] = values[first]
    if len(filled) < bins:
        mask = np.zeros(bins, dtype=bool)
        mask[filled] = True
        empty = np.flatnonzero(~mask)
        orders = _orders(bins)[empty]
        out[empty] = out[orders[np.arange(len(empty)), mask[orders].argmax(axis=1)]]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    weights = _weights(bands, rows)
    cells = mix64(signature(values, bands * rows))
    sums = (cells.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)
    return mix64(sums + np.arange(bands, dtype=np.uint64))


def _sign(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and band keys of every document."""
    fields = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
        ("digest", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                values = shingles(text, words)
                sizes.append(len(values))
                if len(values):
                    whole = xxhash.xxh3_128_digest(values.tobytes())
                    digests.append(np.frombuffer(whole, dtype=np.int64))
                    keys.append(band_keys(values, bands, rows).view(np.int64))
                else:
                    digests.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, fields.field(2).type),
                 pa.array(keys, fields.field(3).type)], schema=fields)

    return docs.mapInArrow(run, f"doc_id bigint, n_shingles bigint, {_SIGNED}")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its whole shingle set."""
    fields = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, fields.field(1).type)], schema=fields)

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it reaches, for every node of ``links`` (src, dst).

    Each round takes the smallest label among the neighbours and then that label's own
    label, so long chains shrink by powers; every round is a written table.
    """
    both = links.select("src", "dst").union(links.select("dst", "src")).where("src <> dst")
    labels = saved(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
                   .select("node", F.least("node", "low").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("dst"), "label"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near")))
        own = labels.select(F.col("node").alias("near"), F.col("label").alias("next"))
        step = saved(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("near"))
                     .join(own, "near").select("node", "was", F.least("near", "next").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def outside(one: np.ndarray, two: np.ndarray, percent: int) -> tuple[int, np.ndarray, int]:
    """Common elements of two sorted sets, the first elements of ``one`` outside ``two``, and how many suffice.

    A set that is linked with ``one`` and shares anything with it outside ``two`` shares one of
    these: it needs at least ceil(percent * size) elements of ``one``, of which ``two`` has only
    the common ones. A set that is not smaller than ``one`` needs more of them, and shares one
    of the elements up to the third value.
    """
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    inside = two[at] == one
    common = int(inside.sum())
    rest = one[~inside]

    def prefix(least: int) -> int:
        return max(0, len(rest) - max(1, least - common) + 1)

    short = prefix(-(-2 * percent * len(one) // (100 + percent)))
    return common, rest[: prefix(-(-percent * len(one) // 100))], short


def _measured(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (src, dst) with the sets' sizes, their common elements and src's elements outside dst."""
    fields = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("n_src", pa.int64()), ("n_dst", pa.int64()),
                        ("common", pa.int64()), ("outside", pa.list_(pa.int64())), ("short", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, sizes = [], []
            for i in range(batch.num_rows):
                one, two = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (2, 3))
                found.append(outside(one, two, percent))
                sizes.append((len(one), len(two)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64()),
                pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].view(np.int64) for f in found], fields.field(5).type),
                pa.array([f[2] for f in found], pa.int64()),
            ], schema=fields)

    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"{name}_set"))
    pairs = edges.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_set", "dst_set")
    return pairs.mapInArrow(run, "src bigint, dst bigint, n_src bigint, n_dst bigint, common bigint, outside array<bigint>, short bigint")


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n_src") + F.col("n_dst") - F.col("common"))


def _stars(members: DataFrame) -> DataFrame:
    """Edges (src, dst) from the members (bucket, doc_id, n) of each bucket to its centre.

    The centre is the member with the largest sum of its buckets' sizes, n being a bucket's size.
    """
    weighed = saved(members.join(members.groupBy("doc_id").agg(F.sum("n").alias("weight")), "doc_id").select(
        "bucket", "doc_id", "weight"))
    centres = saved(weighed.groupBy("bucket").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("dst")))
    return weighed.join(centres, "bucket").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()


def _mixed(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Measured edges with src's component, of centres whose members are in several components."""
    tagged = measured.join(labels.select(F.col("node").alias("src"), "label"), "src", "left").withColumn(
        "label", F.coalesce("label", "src"))
    several = tagged.groupBy("dst").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return saved(tagged.join(several.select("dst"), "dst"))


def _again(mixed: DataFrame) -> DataFrame:
    """Buckets of shingles outside the centre, where members of several components meet.

    bucket, doc_id, its set's size n, what it has in common with the centre, and whether the
    shingle is one that it shares with linked sets that are not smaller.
    """
    rows = mixed.select(
        "dst", F.col("src").alias("doc_id"), "label", F.col("n_src").alias("n"), "common", "short",
        F.posexplode("outside").alias("at", "shingle"),
    ).select(F.xxhash64("dst", "shingle").alias("bucket"), "doc_id", "label", "n", "common", (F.col("at") < F.col("short")).alias("early"))
    several = rows.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return saved(rows.join(several.select("bucket"), "bucket").select("bucket", "doc_id", "n", "common", "early"))


def _next_centres(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with several components, with their labels, and their next centres.

    Members of a bucket's most frequent component need not be centres while others are left.
    """
    tagged = members.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select(
        "bucket", "doc_id", "n", "common", "early", F.coalesce("label", "doc_id").alias("label"))
    main = tagged.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    kept = saved(tagged.join(main.select("bucket", "main"), "bucket"))
    order = Window.partitionBy("bucket").orderBy("doc_id")
    centres = kept.where("label <> main").withColumn("place", F.row_number().over(order)).where(F.col("place") <= FAN)
    return kept.drop("main"), saved(centres.select("bucket", "doc_id", "label", "n", "common", "early"))


def _fans(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Edges from each bucket's centres to the members of other components that may be linked here."""
    c = centres.select(F.col("bucket").alias("c_bucket"), F.col("doc_id").alias("dst"), F.col("label").alias("c_label"),
                       F.col("n").alias("c_n"), F.col("common").alias("c_common"), F.col("early").alias("c_early"))
    # Of two linked sets the smaller one shares an early shingle, both do if they are of one size.
    smaller = F.when(F.col("n") < F.col("c_n"), F.col("early")).when(F.col("n") > F.col("c_n"), F.col("c_early")).otherwise(
        F.col("early") & F.col("c_early"))
    # No more can be shared than both share with the bucket's first centre and have outside it.
    most = F.least("common", "c_common") + F.least(F.col("n") - F.col("common"), F.col("c_n") - F.col("c_common"))
    enough = (100 + percent) * most >= percent * (F.col("n") + F.col("c_n"))
    met = members.join(c, (F.col("bucket") == F.col("c_bucket")) & (F.col("label") != F.col("c_label")) & smaller & enough)
    return met.select(F.greatest("doc_id", "dst").alias("src"), F.least("doc_id", "dst").alias("dst")).distinct()


def _direct(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of one centre that may be linked by what they share with it alone."""
    side = lambda p: mixed.select("dst", *[F.col(c).alias(f"{p}_{c}") for c in ("src", "label", "n_src", "common")])
    # At least one of the two is not linked with the centre itself, else both were in its component.
    one = side("a").join(mixed.where(~_linked(percent)).select("dst", F.col("src").alias("a_src")), ["dst", "a_src"], "left_semi")
    enough = (100 + percent) * F.least("a_common", "b_common") >= percent * (F.col("a_n_src") + F.col("b_n_src"))
    # One that is not linked needs smaller partners than the centre, of at least percent of its size.
    return one.join(side("b"), "dst").where(enough & (F.col("a_label") != F.col("b_label"))).select(
        F.greatest("a_src", "b_src").alias("src"), F.least("a_src", "b_src").alias("dst")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 44, rows: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * |intersection| >= percent * |union| of their
    distinct word shingles; component_id is the smallest doc_id a document reaches and
    ``kept`` marks that one. Documents without words have no shingles and no links.
    Rows with a null doc_id cannot be named in a link and are left alone: null component,
    kept. Several rows of one doc_id are one document, of their smallest text, and give one
    row. Other columns are ignored; an empty table gives an empty one. ``rows`` bins per band
    are as many as leave an equal band a chance of 0.27 at the threshold, so that all of
    ``bands`` miss such a link with a probability of about 1e-6.
    """
    rows = rows or max(1, round(math.log(0.27) / math.log(percent / 100))) if percent < 100 else rows or 8
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = _repeated(docs)
    if not repeated.isEmpty():
        again = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(again)
    signed = saved(_sign(texts, words, bands, rows))
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A set's first document stands for all that have the same set.
    low = saved(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    buckets = saved(named.select("doc_id", "bands").join(low.select("doc_id"), "doc_id").select(
        "doc_id", F.explode("bands").alias("bucket")))
    shared = saved(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = saved(buckets.join(shared, "bucket"))
    # All whole sets that are ever compared come from one shuffle of the texts, at any size.
    wanted = members.select("doc_id").distinct()
    sets = saved(_sets(texts.join(wanted.hint("merge"), "doc_id", "left_semi"), words))
    measured = saved(_measured(_stars(members), sets, percent))
    links = [measured.where(_linked(percent)).select("src", "dst")]
    labels = components(links[0])
    mixed = _mixed(measured, labels)
    members, edges = _again(mixed), _direct(mixed, percent)
    while True:
        members, centres = _next_centres(members, labels)
        edges = saved(edges.unionByName(_fans(members, centres, percent)).distinct())
        if not edges.isEmpty():
            found = saved(_measured(edges, sets, percent).where(_linked(percent)).select("src", "dst"))
            if not found.isEmpty():
                links.append(found)
                labels = components(reduce(DataFrame.union, links))
        # A round without edges only used up its centres; later ones may still have links.
        if centres.isEmpty():
            break
        members = members.drop("label").join(centres.select("bucket", "doc_id"), ["bucket", "doc_id"], "left_anti")
        edges = edges.limit(0)
    # Copies follow their set's first document.
    own = saved(low.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select(
        "digest", F.coalesce("label", "doc_id").alias("label")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return signed.select("doc_id", "n_shingles", "digest").join(own, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _repeated(docs: DataFrame) -> DataFrame:
    """Ids that several rows have."""
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    return saved(ids.agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents of which no smaller near-duplicate exists, with all their columns.

    Rows without doc_id stay. Of several rows of one doc_id the one of the smallest text stays.
    """
    gone = saved(near_duplicates(docs, words, percent).where("NOT kept").select("doc_id"))
    repeated = _repeated(docs)
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti")
    once = docs.join(gone.union(repeated), "doc_id", "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = (docs.join(repeated, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").groupBy("doc_id")
             .agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("row")).select("row.*"))
    return once.unionByName(again)
