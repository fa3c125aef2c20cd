"""Phrase collocations by SON partitioning.

The partitions of the corpus are dealt to ``shards`` shards. A phrase that occurs ``support``
times in a language occurs in at least one shard at least ``support`` times that shard's
share of the language's words, so each shard is mined completely at its own, proportionally
lowered support, level by level: words, pairs of locally frequent words, then three and four
words all of whose pairs are locally frequent. The union of what is frequent in any shard
holds every phrase sought. Its parts are in the union too, so a candidate's occurrences were
counted in every shard, and its exact count is the sum over all shards.

The number of shards is fixed, so the lowered support stays above one at any size; a shard is
as many partitions as the corpus asks for, mined by one grouping of all shards at once, and
each task adds up its own phrases before they are shuffled.

What is locally frequent goes to the next level as a Bloom filter of bounded size. A false
positive lets a phrase be counted that need not be, and the support then drops it; nothing
frequent is ever lost, however full the filter is.

Phrases are counted under a 64-bit name and a 32-bit check. A last pass writes out the text
of every frequent phrase in one partition that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.arrays import byte_slices, pair, raw, row_of, signed, word_names, words
from shelfspark.llm.common import Scratch, mix64, small_batches

_U = np.uint64
SHARDS = 4
LONGEST = 4
# Bits of a filter: 12 for each phrase, as a power of two between these bounds.
LEAST_BITS, MOST_BITS = 1 << 17, 1 << 28
_SLOT = 1 << 16  # bits of one piece of a filter
_CHECK = _U(0xD6E8FEB86659FD93)
_HELD = 1 << 19  # phrases a task holds before it hands them on
_SLICE = 1 << 20  # bytes of text a task looks at in one go

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = _BREAK.copy()
_BLANK[[0x20, 0x09]] = True


class _Words:
    """Words of a batch: names, bytes, text, and whether the next one is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, starts = raw(batch.column("text"))
        self.data = _LOWER[data]
        self.first, self.end = words(self.data, starts, _BLANK)
        self.row = row_of(starts, self.first)
        # Word and the next one are neighbours if they are of one text and no break lies between them.
        breaks = np.cumsum(_BREAK[self.data], dtype=np.int32)[self.first] if len(self.first) else self.first
        self.joined = np.zeros(len(self.row), dtype=bool)
        self.joined[:-1] = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        self.lang = batch.column("lang_key").to_numpy()[self.row]
        self.name = pair(word_names(self.data, self.first, self.end), self.lang.view(_U))

    def phrases(self, filters: list["Bloom | None"], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, place of the first word, name) for phrases whose shorter parts pass their filters."""
        at, name = np.arange(len(self.name)), self.name
        for size in range(1, upto + 1):
            yield size, at, name
            if size == upto:
                return
            # The first and the last ``size`` words of a longer phrase must pass.
            if filters[size - 1] is not None:
                good = filters[size - 1].has(name)
                at, name = at[good], name[good]
            passed = np.zeros(len(self.name) + 1, dtype=bool)
            passed[at] = True
            last = at + size - 1
            more = self.joined[last] & passed[np.minimum(at + 1, len(self.name))]
            at, name = at[more], pair(name[more], self.name[last[more] + 1])

    def checks(self, at: np.ndarray, size: int) -> np.ndarray:
        """32 bits of the phrases' words that their names do not follow from."""
        with np.errstate(over="ignore"):
            total = np.zeros(len(at), dtype=_U)
            for i in range(size):
                total = total * _CHECK + (self.name[at + i] >> _U(7))
        return (total >> _U(32)).astype(np.uint32).view(np.int32)

    def texts(self, at: np.ndarray, size: int) -> list[bytes]:
        """The phrases' words joined by blanks."""
        whole = self.data.tobytes()
        words = [[whole[a:b] for a, b in zip(self.first[at + i].tolist(), self.end[at + i].tolist())] for i in range(size)]
        return [b" ".join(phrase) for phrase in zip(*words)]


class Bloom:
    """Two probes into one array of bits."""

    def __init__(self, bits: int, pieces: dict[int, bytes]):
        self.mask = bits - 1
        self.bits = np.zeros(bits // 8, dtype=np.uint8)
        for slot, piece in pieces.items():
            self.bits[slot * _SLOT // 8 : (slot + 1) * _SLOT // 8] = np.frombuffer(piece, dtype=np.uint8)

    def has(self, names: np.ndarray) -> np.ndarray:
        one, two = probes(names, self.mask)
        return ((self.bits[one >> 3] >> (one & 7).astype(np.uint8)) & (self.bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1) == 1


def probes(names: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(names)
    return (mixed & _U(mask)).astype(np.int64), ((mixed >> _U(32)) & _U(mask)).astype(np.int64)


def _filter(names: DataFrame) -> Bloom:
    """Bloom filter of the saved ``name`` column; the driver holds its bits, at most MOST_BITS."""
    bits = LEAST_BITS
    count = names.count()
    while bits < MOST_BITS and bits < 12 * count:
        bits *= 2

    def spread(batches):
        for batch in batches:
            found = np.unique(np.concatenate(probes(batch.column("name").to_numpy().view(_U), bits - 1)))
            yield pa.record_batch({"slot": pa.array((found // _SLOT).astype(np.int32)), "bit": pa.array((found % _SLOT).astype(np.int32))})

    def filled(batches):
        held = {}
        for batch in batches:
            slots, offsets = batch.column("slot").to_numpy(), batch.column("bit").to_numpy()
            for slot in np.unique(slots):
                held.setdefault(int(slot), np.zeros(_SLOT, dtype=bool))[offsets[slots == slot]] = True
        yield pa.record_batch({
            "slot": pa.array(list(held), type=pa.int32()),
            "piece": pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], type=pa.binary())})

    pieces = (
        names.mapInArrow(spread, "slot int, bit int").repartition("slot").mapInArrow(filled, "slot int, piece binary").collect()
    )
    return Bloom(bits, {r["slot"]: r["piece"] for r in pieces})


def _counted(texts: DataFrame, shards: int, filters: list[Bloom], sizes: tuple[int, ...]) -> DataFrame:
    """(lang_key, name, check, shard, part, n) of the phrases of ``sizes`` words, added up task by task."""
    shared = [texts.sparkSession.sparkContext.broadcast(f) for f in filters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = [b.value for b in shared] + [None] * LONGEST
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            name, check, lang, n = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(name)
            name = name[order]
            fresh = np.ones(len(name), dtype=bool)
            fresh[1:] = name[1:] != name[:-1]
            at = np.flatnonzero(fresh)
            return name[at], check[order[at]], lang[order[at]], np.add.reduceat(n[order], at) if len(at) else n

        def handed(name, check, lang, n):
            same = lambda value: pa.array(np.full(len(name), value, dtype=np.int32))
            return pa.record_batch({
                "lang_key": pa.array(lang), "name": signed(name), "check": pa.array(check), "shard": same(part % shards),
                "part": same(part), "n": pa.array(n)})

        for batch in byte_slices(batches, "text", _SLICE):
            found = _Words(batch)
            for size, at, name in found.phrases(own, max(sizes)):
                if size in sizes:
                    once, where, n = np.unique(name, return_index=True, return_counts=True)
                    at = at[where]
                    held.append((once, found.checks(at, size), found.lang[at], n.astype(np.int64)))
            if sum(len(h[0]) for h in held) > _HELD:
                held = [merged()]
                if len(held[0][0]) > _HELD // 2:
                    yield from small_batches([handed(*held.pop())], 1 << 16)
        if held:
            yield from small_batches([handed(*merged())], 1 << 16)

    return texts.mapInArrow(run, "lang_key bigint, name bigint, check int, shard int, part int, n bigint")


def _candidates(counted: DataFrame, totals: DataFrame, support: int) -> DataFrame:
    """(lang_key, name, check, n, part) of what reaches its shard's lowered support in any shard, counted over all shards.

    The lowered supports add up to ``support``, so a phrase below all of them is below it also
    where a later pass deals the texts to shards in another way. Rows are dealt by name once
    for both sums; a name has at most as many rows as there are tasks.
    """
    key = ["lang_key", "name", "check"]
    local = counted.repartition("name").groupBy(*key, "shard").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    reached = F.col("n").cast("decimal(20)") * F.col("lang_words") >= F.col("shard_words").cast("decimal(20)") * support
    return (
        local.join(totals, ["lang_key", "shard"], "left")
        .groupBy(*key).agg(F.sum("n").alias("n"), F.min("part").alias("part"), F.max(F.coalesce(reached, F.lit(True))).alias("reached"))
        .where("reached").drop("reached")
    )


def _written_out(texts: DataFrame, filters: list[Bloom], often: Bloom, anywhere: bool) -> DataFrame:
    """(lang_key, name, check, phrase) of the phrases in ``often``: names with their partition, or names alone."""
    shared = texts.sparkSession.sparkContext.broadcast([often, *filters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _U(TaskContext.get().partitionId())
        wanted, *inner = shared.value
        known: set[int] = set()
        for batch in byte_slices(batches, "text", _SLICE):
            found = _Words(batch)
            out: list[tuple] = []
            for size, at, name in found.phrases([*inner, None, None], LONGEST):
                good = wanted.has(name if anywhere else pair(name, np.full(len(name), part)))
                once, where = np.unique(name[good], return_index=True)
                new = np.array([key not in known for key in once.tolist()], dtype=bool)
                known.update(once.tolist())
                place = at[good][where[new]]
                out.append((found.lang[place], once[new], found.checks(place, size), found.texts(place, size)))
            if len(known) > _HELD:
                known.clear()
            lang, name, check, text = zip(*out)
            yield pa.record_batch({
                "lang_key": pa.array(np.concatenate(lang)), "name": signed(np.concatenate(name)),
                "check": pa.array(np.concatenate(check)),
                "phrase": pa.array([t for part in text for t in part], type=pa.binary()).cast(pa.string())})

    return texts.mapInArrow(run, "lang_key bigint, name bigint, check int, phrase string")


def phrase_counts(docs: DataFrame, support: int = 30, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words with their exact counts, ``support`` at least, and the words of each language."""
    scratch = Scratch(docs.sparkSession)
    lang = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    texts = lang.select("text", F.xxhash64("lang").alias("lang_key"))
    single = scratch.save("words", _counted(texts, shards, [], (1,)))
    by_shard = single.groupBy("lang_key", "shard").agg(F.sum("n").alias("shard_words"))
    by_lang = by_shard.groupBy("lang_key").agg(F.sum("shard_words").alias("lang_words"))
    totals = scratch.save("totals", by_shard.join(by_lang, "lang_key"))
    filters, tables = [], []
    for level, sizes in enumerate(((1,), (2,), (3, 4))):
        counted = single if sizes == (1,) else _counted(texts, shards, filters, sizes)
        tables.append(scratch.save(f"level{level}", _candidates(counted, totals, support)))
        if len(filters) < 2:
            filters.append(_filter(tables[-1].select("name")))
    scratch.drop("words")
    often = scratch.save("often", reduce(DataFrame.unionByName, tables).where(F.col("n") >= support))
    scratch.drop("level0", "level1", "level2")

    key = ["lang_key", "name", "check"]
    places = often.mapInArrow(_placed, "name bigint")
    phrases = scratch.save("phrases", _written_out(texts, filters, _filter(places), anywhere=False).join(often.select(*key), key, "left_semi"))
    lost = often.join(phrases, key, "left_anti")
    if not lost.isEmpty():  # a scan that is dealt to partitions in another way than before
        phrases = phrases.unionByName(_written_out(texts, filters, _filter(lost.select("name")), anywhere=True))
    names = lang.groupBy(F.xxhash64("lang").alias("lang_key")).agg(F.min("lang").alias("lang"))
    counts = scratch.save(
        "counts", often.join(phrases.groupBy(*key).agg(F.min("phrase").alias("phrase")), key).join(names, "lang_key")
        .select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"))
    scratch.drop("often", "phrases")
    return counts, totals.select("lang_key", "lang_words").distinct().join(names, "lang_key").select("lang", "lang_words")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names together with their partition."""
    for batch in batches:
        name, part = (batch.column(c).to_numpy() for c in ("name", "part"))
        yield pa.record_batch({"name": signed(pair(name.view(_U), part.astype(_U)))})


def collocations(docs: DataFrame, support: int = 30, percent: int = 80, most: int | None = 2000, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the strongest phrases of each language.

    Texts are lower-cased in A-Z and cut into pieces at ``. , ; : ! ?`` and line breaks, pieces
    into words at blanks and tabs. ``a`` counts a phrase of two to four words, overlaps
    included; phrases with fewer than ``support`` go. ``score`` is the smallest of
    floor(2000000 a / (l + r)) over all cuts into a first part, counted ``l``, and a rest,
    counted ``r``; the shortest first part of equal ones. A phrase goes if a longer one that
    contains it has at least ``percent`` of its count. Each language's first ``most`` stay
    (all, if None) by score and a, descending, then phrase. A null language is ``und``; null
    and empty texts have no words; repeated rows count each; ids are not looked at; an empty
    table gives no rows.
    """
    counts, totals = phrase_counts(docs, support, shards)
    parts = F.split("phrase", " ")
    cuts = (
        counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", parts.alias("parts"))
        .select("lang", "phrase", "a", "parts", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("parts", 1, F.col("k")), " ").alias("head"),
                F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    cut = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("CAST(a AS DECIMAL(20)) * 2000000 DIV (CAST(l AS DECIMAL(20)) + r)").cast("bigint")
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("best"))

    # Largest count of a longer phrase around each candidate.
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1),
                                 lambda at: F.array_join(F.slice("parts", at, size), " "))))
    around = (
        counts.where("words > 2").select("lang", "n", "words", parts.alias("parts"))
        .select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    )
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (F.col("longer").cast("decimal(20)") * 100 < F.col("best.a").cast("decimal(20)") * percent))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("best.a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "best.a", "best.l", "best.r",
        F.col("lang_words").alias("n"), "best.score")
