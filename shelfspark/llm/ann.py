"""Approximate nearest neighbours by a forest of sorted hash prefixes.

Each tree writes a vector as a string of bits, the signs of projections on random
directions, and keeps the strings sorted. A query descends each tree to the longest prefix
it shares with any vector and then ascends in all trees at once, one bit at a time, until
the subtrees of its prefixes hold enough vectors; all of these are candidates, compared by
their exact inner product.

In Spark a tree's sorted array is cut into leaves by the first ``bits`` bits. The numbers
of vectors below every prefix are counted once; from them each query gets the length of
its prefix, and is sent to the leaves below it. A leaf is split into pieces of bounded size,
each of which is compared with its queries as matrices and hands on the best ``k`` per
query, so pairs are never listed. How many candidates are enough is found on a bounded
sample of queries, whose true neighbours a full comparison in blocks gives.

Equal vectors are one entry that remembers its smallest ids: at most k + 1 of them can be
among the k nearest of any query, the query's own id set aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import saved

PIECE = 4096  # vectors compared at a time
DRAWS = 4  # each draw of the vectors has so many times those of the one before


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors of finite components that are not all zero, in double precision."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """One entry per distinct vector: entry (a number), v, low (its smallest id) and its k + 1 smallest ids."""
    # The rank cuts each task's rows before the shuffle, so copies of one vector stay few.
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("entry"), "v", F.element_at("ids", 1).alias("low"), "ids")


def directions(width: int, trees: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trees * bits, width))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def _codes(frame: DataFrame, width: int, trees: int, bits: int) -> DataFrame:
    """``frame`` with the array of each vector's codes, one per tree; v is its last column."""
    names = [*frame.columns, "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = directions(width, trees, bits)
        powers = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            signs = (_matrix(batch.column(batch.num_columns - 1), width) @ planes.T > 0).reshape(batch.num_rows, trees, bits)
            codes = (signs * powers).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=names)

    kinds = ", ".join(f"{name} {kind}" for name, kind in frame.dtypes)
    return frame.mapInArrow(run, f"{kinds}, codes array<bigint>")


def _best(
    scores: np.ndarray, q: np.ndarray, data: np.ndarray, low: np.ndarray, k: int, least: float, rounding: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact products of the k nearest, ``least`` or more; ``scores``, off by at most ``rounding``, only sorts out the far ones."""
    at = np.flatnonzero(scores >= least - 2 * rounding)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge - 2 * rounding]
    exact = (data[at] * q).sum(axis=1)
    at, exact = at[exact >= least], exact[exact >= least]
    order = np.lexsort((low[at], -exact))[:k]
    return at[order], exact[order]


def _search(work: DataFrame, k: int, bits: int, width: int) -> DataFrame:
    """Best entries of every query per piece: query_id, entry, low, score.

    ``work``: piece, kind (0 entry, 1 query), id, low, v, code, length, least. A piece's entries
    come first, sorted by their codes; a query looks at those that share ``length`` bits with
    it, and entries below its ``least`` product are not listed.
    """
    names = ["query_id", "entry", "low", "score"]

    def matched(entries: list, asked: list) -> Iterator[pa.RecordBatch]:
        ids, low, data, codes = (np.concatenate([e[i] for e in entries]) for i in range(4))
        order = np.argsort(codes, kind="stable")
        ids, low, data, codes = ids[order], low[order], data[order], codes[order]
        query, _, block, code, length, least = (np.concatenate([a[i] for a in asked]) for i in range(6))
        longest = np.sqrt((data * data).sum(axis=1).max())
        rounding = 1e-12 * width * np.sqrt((block * block).sum(axis=1)) * longest
        start = np.searchsorted(codes, code >> (bits - length) << (bits - length))
        stop = np.searchsorted(codes, ((code >> (bits - length)) + 1) << (bits - length))
        for at in range(0, len(query), 256):
            out: list[list] = [[], [], [], []]
            scores = block[at: at + 256] @ data.T
            for i in range(at, min(at + 256, len(query))):
                a, b = start[i], stop[i]
                if b > a:
                    near, exact = _best(scores[i - at, a:b], block[i], data[a:b], low[a:b], k, least[i], rounding[i])
                    out[0].append(np.full(len(near), query[i]))
                    for part, values in zip(out[1:], (ids[a:b][near], low[a:b][near], exact)):
                        part.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, entries, asked, waiting = None, [], [], 0
        for batch in batches:
            pieces = np.array(batch.column(0).to_pylist(), dtype=object)
            edges = np.flatnonzero(pieces[1:] != pieces[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(pieces)]):
                if b <= a:
                    continue
                if pieces[a] != where:
                    if entries and asked:
                        yield from matched(entries, asked)
                    where, entries, asked, waiting = pieces[a], [], [], 0
                part = batch.slice(a, b - a)
                kind, ids, low = (np.asarray(part.column(i)) for i in range(1, 4))
                data = _matrix(part.column(4), width)
                code, length = np.asarray(part.column(5)), np.asarray(part.column(6))
                own, other = kind == 0, kind == 1
                if own.any():
                    entries.append((ids[own], low[own], data[own], code[own]))
                if other.any():
                    asked.append((ids[other], low[other], data[other], code[other], length[other], np.asarray(part.column(7))[other]))
                    waiting += int(other.sum())
                    if waiting >= PIECE and entries:
                        yield from matched(entries, asked)
                        asked, waiting = [], 0
        if entries and asked:
            yield from matched(entries, asked)

    dealt = work.repartition("piece").sortWithinPartitions("piece", "kind")
    return dealt.select("piece", "kind", "id", "low", "v", "code", "length", "least").mapInArrow(
        run, "query_id bigint, entry bigint, low bigint, score double")


def _ranked(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows per query among the entries found for it."""
    each = found.groupBy("query_id", "entry", "low").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "low")
    # Every entry ahead gives at least one row ahead, but for the query's own.
    few = each.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    rows = (few.join(entries.select("entry", "ids"), "entry")
            .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _item(piece, kind: int, name: str, low: str, code="0L", length="0L", least="'-Infinity'") -> list:
    return [piece.alias("piece"), F.lit(kind).alias("kind"), F.col(name).alias("id"), F.col(low).alias("low"), "v",
            F.expr(f"cast({code} AS bigint)").alias("code"), F.expr(f"cast({length} AS bigint)").alias("length"),
            F.expr(f"cast({least} AS double)").alias("least")]


def _full(entries: DataFrame, queries: DataFrame, rows: int) -> DataFrame:
    """Work of the full comparison: entries in pieces of about PIECE, each with all queries."""
    n = max(1, math.ceil(rows / PIECE))
    own = entries.select(*_item(F.pmod(F.xxhash64("entry"), F.lit(n)).cast("string"), 0, "entry", "low"))
    part = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return own.unionByName(part.select(*_item(F.col("part").cast("string"), 1, "query_id", "query_id")))


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The true k nearest rows of a bounded number of ``queries`` (query_id, v), by blocks.

    Unusable vectors, repeated rows, ties and copies count as in ``neighbours``; without vectors
    there are no rows.
    """
    entries = saved(_entries(_usable(vectors), k))
    first = entries.first()
    work = _full(entries, queries, entries.count())
    return _ranked(_search(work, k + 1, 0, len(first.v) if first else 1), entries, k)


def neighbours(
    vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 8, leaf: int = 64, recall: float = 0.95,
    sample: int = 200,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides.

    Nearest is the largest inner product in double precision, ties go to the smaller id. A
    query is not its own candidate, its copies are. Vectors that are null, all zero or hold
    null or non-finite components take no part, nor do those of another width than most.
    Repeated rows count once; an id with several vectors is as near as its nearest one.
    Fewer candidates than k are all returned; an empty table gives no rows.
    """
    usable = saved(_usable(vectors))
    widths = usable.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = widths.w
    usable = usable.where(F.size("v") == width)
    entries = saved(_entries(usable, k))
    rows = entries.count()
    bits = max(1, math.ceil(math.log2(max(2, rows / leaf))))
    coded = saved(_codes(entries.select("entry", "low", "v"), width, trees, bits))
    asking = usable.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    queries = saved(_codes(asking, width, trees, bits))
    # Vectors below every prefix: the leaves' numbers, added up bit by bit.
    leaves = saved(coded.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", "code").agg(F.count("*").alias("n")))
    lengths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("length")
    prefix = F.expr(f"shiftright(code, {bits} - length)").alias("prefix")
    below = leaves.select("tree", "n", "code", lengths).groupBy("tree", "length", prefix).agg(F.sum("n").alias("n"))
    asked = queries.select("query_id", F.posexplode("codes").alias("tree", "code")).select("query_id", "tree", "code", lengths)
    reach = saved(asked.select("query_id", "tree", "length", prefix).join(below, ["tree", "length", "prefix"]).groupBy(
        "query_id", "length").agg(F.sum("n").alias("n")))
    enough = _enough(queries, coded, entries, reach, k, bits, recall, sample, rows, width)
    # The longest prefixes, alike in all trees, that together hold enough. If they hold as many
    # as there are, one tree's root holds them all.
    depth = reach.where(F.col("n") >= enough).groupBy("query_id").agg(F.max(F.struct("length", "n")).alias("best")).select(
        "query_id", F.when(F.col("best.n") < rows, F.col("best.length")).alias("length"))
    chosen = saved(queries.join(depth, "query_id", "left").select(
        "query_id", "v", F.coalesce("length", F.lit(0)).alias("length"), F.posexplode("codes").alias("tree", "code")).where(
        "length > 0 OR tree = 0"))
    # Trees that no query looks into are left out.
    used = chosen.select("tree").distinct()
    placed = saved(coded.select("entry", "low", "v", F.posexplode("codes").alias("tree", "code")).join(used, "tree", "left_semi")
                   .withColumn("draw", F.pmod(F.xxhash64("entry", F.lit("draw")), F.lit(DRAWS ** 16))))

    def found(part: DataFrame, asking: DataFrame, share: float) -> DataFrame:
        # Neighbouring leaves make a cell of about PIECE vectors; a cell of many more is several pieces.
        level = max(0, bits - max(0, int(math.log2(PIECE / leaf / share))))
        cell = F.expr(f"shiftright(code, {bits - level})")
        celled = part.withColumn("cell", cell)
        sizes = saved(celled.groupBy("tree", "cell").agg(F.ceil(F.count("*") / PIECE).alias("parts")))
        piece = F.concat_ws("-", "tree", "cell", "part")
        own = (celled.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")))
               .select(*_item(piece, 0, "entry", "low", "code")))
        # A prefix shorter than the cells' covers several of them.
        high, wide = f"shiftright(code, {bits} - least(length, {level}))", f"({level} - least(length, {level}))"
        cells = F.expr(f"sequence(shiftleft({high}, {wide}), shiftleft({high} + 1, {wide}) - 1)")
        sent = (asking.withColumn("cell", F.explode(cells)).join(sizes, ["tree", "cell"])
                .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
                .select(*_item(piece, 1, "query_id", "query_id", "code", "length", "least")))
        return _search(own.unionByName(sent), k + 1, bits, width)

    # Ever larger draws of the vectors, each DRAWS times the one before: what a draw has at rank
    # k + 1 is a bound for the next, so each lists some DRAWS * k entries a query, not k a piece.
    bound = F.expr("double('-Infinity')").alias("least")
    asking = chosen.withColumn("least", bound)
    for power in reversed(range(1, 1 + math.ceil(math.log(max(1, rows / PIECE), DRAWS)))):
        drawn = found(placed.where(F.pmod("draw", F.lit(DRAWS ** power)) == 0), asking, DRAWS ** -power)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = saved(drawn.groupBy("query_id", "entry").agg(F.max("score").alias("score"))
                      .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
                      .groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") > k).drop("n"))
        asking = chosen.join(least, "query_id", "left").withColumn("least", F.coalesce("least", bound))
    return _ranked(found(placed, asking, 1.0), entries, k)


def _enough(
    queries: DataFrame, coded: DataFrame, entries: DataFrame, reach: DataFrame, k: int, bits: int, recall: float,
    sample: int, rows: int, width: int,
) -> int:
    """Fewest vectors below a query's prefixes that give the wanted mean recall on a sample."""
    picked = saved(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    truth = _ranked(_search(_full(entries, picked, rows), k + 1, 0, width), entries, k)
    # A true neighbour is found at the longest prefix it shares with the query in any tree.
    home = entries.select("entry", F.explode("ids").alias("vec_id"))
    known = truth.select("query_id", "vec_id").join(home, "vec_id").join(
        coded.select("entry", F.col("codes").alias("theirs")), "entry").join(
        picked.select("query_id", "codes"), "query_id")
    gap = F.zip_with("codes", "theirs", lambda a, b: a.bitwiseXOR(b))
    differing = F.transform(gap, lambda x: F.when(x == 0, 0).otherwise(F.floor(F.log2(x.cast("double"))) + 1))
    shared = F.lit(bits) - F.array_min(differing)
    depth = {}
    for r in known.select("query_id", shared.cast("int").alias("s")).collect():  # sample * k rows
        depth.setdefault(r.query_id, []).append(r.s)
    counts = {}
    for r in reach.join(picked.select("query_id"), "query_id", "left_semi").collect():  # sample * bits rows
        counts.setdefault(r.query_id, {})[r.length] = r.n
    if not depth:
        return rows
    for wanted in sorted({n for q in depth for n in counts.get(q, {}).values()}):
        found = []
        for q, shared_bits in depth.items():
            length = max((l for l, n in counts.get(q, {}).items() if n >= wanted), default=0)
            found.append(sum(s >= length for s in shared_bits) / len(shared_bits))
        if sum(found) / len(found) >= recall:
            return int(wanted)
    return int(max(n for q in counts for n in counts[q].values()))
