"""Language-model scores by a class-based bigram model with exchange clustering.

P(word | last word) = P(class | last class) * P(word | class). Words are clustered through
units of bounded number: a frequent word is a unit of its own, every other word, unseen
ones included, belongs to the unit of its ending and shape. The exchange moves each unit
to the class that raises the likelihood of the training tokens most, half of the units in
turn, until few move; moves are judged in parallel against the class counts of the last
round. The counts of a unit's neighbouring classes and the words' counts come from all
training documents.

What is gathered: the count of every distinct word (shuffled), the bigram counts of the
bounded units (shuffled), and from those the tables of the model, whose size the number of
units bounds. Word counts are not bounded and never leave the executors: a document's
words meet them in an equality join; only the units' own counts are shared with all tasks.

Words go by 64-bit names; two words of a corpus of n share one with a chance near n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrays import byte_slices, pair, raw, row_of, signed, word_names, words
from shelfspark.llm.common import Scratch, fold, saved, small_batches

_U = np.uint64
END = b"\n"  # no word holds it
HELD = 1 << 19  # distinct words or pairs a task gathers before it hands them on
SLICE = 1 << 20  # bytes of text looked at in one go

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Signs that are no part of a word's ending.
_OUTER = np.zeros(256, dtype=bool)
_OUTER[list(b".,;:!?*#$%&|\"'()[]-")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
OTHER, LAST = 0, 1  # units of words without any other unit, and of a document's end


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, blanks being space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Tokens:
    """Words of some texts: bytes, text and name of each."""

    def __init__(self, column: pa.Array):
        data, starts = raw(column)
        self.rows, self.data = len(starts) - 1, _LOWER[data]
        self.first, self.end = words(self.data, starts, _BLANK)
        self.row = row_of(starts, self.first)
        self.name = word_names(self.data, self.first, self.end)

    def endings(self, at: np.ndarray) -> np.ndarray:
        """Names of the words' shapes: last two bytes within outer signs, kind of the rest, and whether there are outer signs."""
        first, end = self.first[at].copy(), self.end[at].copy()
        if not len(at):
            return np.zeros(0, dtype=_U)
        for edge, place, step in ((end, -1, -1), (first, 0, 1)):
            left = np.arange(len(at))
            while len(left):
                left = left[(first[left] < end[left])]
                left = left[_OUTER[self.data[edge[left] + place]]]
                edge[left] += step
        size = end - first
        kinds = np.zeros(len(at), dtype=_U)
        full = np.flatnonzero(size > 0)
        if len(full):
            # Flags of the bytes from the first of a core up to its end, by sums over the whole text.
            for value, flags in ((1, _LETTER), (2, _DIGIT)):
                upto = np.concatenate([[0], np.cumsum(flags[self.data], dtype=np.int32)])
                kinds[full[upto[end[full]] - upto[first[full]] == size[full]]] = value
            high = np.concatenate([[0], np.cumsum(self.data > 127, dtype=np.int32)])
            kinds[full[high[end[full]] > high[first[full]]]] = 3
        byte = lambda back: np.where(size >= back, self.data[np.maximum(end - back, 0)], 0).astype(_U)
        outer = (size != self.end[at] - self.first[at]).astype(_U)
        return pair(byte(1) << _U(8) | byte(2), kinds << _U(1) | outer) | _U(1)


@dataclass
class Model:
    """Units of the words, their classes, and the tables of class transitions and emissions."""

    names: np.ndarray  # sorted names of the words that are units, and their units
    units: np.ndarray
    ending_names: np.ndarray  # the same of endings
    ending_units: np.ndarray
    known: np.ndarray  # tokens of each unit that is one word; 0 else
    classes: np.ndarray  # class of each unit
    step: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 of each class's denominator
    tokens: int
    distinct: int

    def of(self, tokens: _Tokens) -> np.ndarray:
        """Units of all words."""
        out = _looked_up(self.names, self.units, tokens.name, -1)
        rare = np.flatnonzero(out < 0)
        _, first, back = np.unique(tokens.name[rare], return_index=True, return_inverse=True)
        shapes = _looked_up(self.ending_names, self.ending_units, tokens.endings(rare[first]), OTHER)
        out[rare] = shapes[back]
        return out

    def unit(self, word: bytes) -> int:
        return LAST if word == END else int(self.of(_Tokens(pa.array([word], pa.binary())))[0])


def _looked_up(names: np.ndarray, values: np.ndarray, wanted: np.ndarray, none: int) -> np.ndarray:
    if not len(names):
        return np.full(len(wanted), none, dtype=np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, values[at], none)


def _sequence(units: np.ndarray, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts one after the other with one end before them and one after each, and the text of each but the first."""
    counts = np.bincount(tokens.row, minlength=tokens.rows)
    out = np.full(len(units) + tokens.rows + 1, LAST, dtype=np.int64)
    out[1 + np.arange(len(units)) + tokens.row] = units
    return out, np.repeat(np.arange(tokens.rows), counts + 1)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Key, carried value and sum of the last column per key."""
    key, value, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    return key[at], value[order[at]], np.add.reduceat(n[order], at) if len(at) else n


def word_counts(docs: DataFrame) -> DataFrame:
    """word and ending (names) and tokens n of all distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def handed(word, ending, n):
            return pa.record_batch({"word": signed(word), "ending": signed(ending), "n": pa.array(n)})

        for batch in byte_slices(batches, "text", SLICE):
            tokens = _Tokens(batch.column("text"))
            once, at, n = np.unique(tokens.name, return_index=True, return_counts=True)
            held.append((once, tokens.endings(at), n.astype(np.int64)))
            if sum(len(h[0]) for h in held) > HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from small_batches([handed(*held.pop())], 1 << 16)
        if held:
            yield from small_batches([handed(*_summed(held))], 1 << 16)

    parts = docs.select("text").mapInArrow(run, "word bigint, ending bigint, n bigint")
    return parts.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _unit_pairs(docs: DataFrame, model: Model) -> DataFrame:
    """left, right and n: neighbouring units over all texts; a document starts and stops at the end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = len(model.known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def handed(key, _, n):
            return pa.record_batch({"left": pa.array((key // size).astype(np.int32)), "right": pa.array((key % size).astype(np.int32)), "n": pa.array(n)})

        for batch in byte_slices(batches, "text", SLICE):
            tokens = _Tokens(batch.column("text"))
            at, _ = _sequence(shared.value.of(tokens), tokens)
            once, n = np.unique(at[:-1] * size + at[1:], return_counts=True)
            held.append((once, once, n.astype(np.int64)))
            if sum(len(h[0]) for h in held) > HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from small_batches([handed(*held.pop())], 1 << 16)
        if held:
            yield from small_batches([handed(*_summed(held))], 1 << 16)

    parts = docs.select("text").mapInArrow(run, "left int, right int, n bigint")
    return parts.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _listed(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, unit and tokens of all entries of two list columns, the first one being ``column``."""
    others, n = batch.column(column), batch.column(column + 1)
    rows = np.repeat(np.arange(batch.num_rows), np.asarray(others.value_lengths()))
    return rows, np.asarray(others.flatten()), np.asarray(n.flatten())


def _neighbours(pairs: DataFrame) -> DataFrame:
    """unit, after, after_n, before, before_n: the units to the right and left of every unit, and their tokens.

    One row per unit, with lists that the number of units bounds. A task puts its pairs into
    lists first, so the shuffle groups few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def handed():
            left, right, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for side, unit, other in ((0, left, right), (1, right, left)):
                order = np.argsort(unit, kind="stable")
                at = np.flatnonzero(np.diff(unit[order], prepend=-1))
                ends = pa.array(np.append(at, len(unit)).astype(np.int32))
                yield pa.record_batch({
                    "unit": pa.array(unit[order[at]]), "side": pa.array(np.full(len(at), side, dtype=np.int32)),
                    "other": pa.ListArray.from_arrays(ends, pa.array(other[order])),
                    "n": pa.ListArray.from_arrays(ends, pa.array(n[order]))})

        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(3)])
            if sum(len(h[0]) for h in held) > HELD:
                yield from handed()
        if held:
            yield from handed()

    parts = pairs.select("left", "right", "n").mapInArrow(run, "unit int, side int, other array<int>, n array<bigint>")
    # Lists of one group are collected row by row, so units and tokens keep one order.
    of = lambda side, name: F.flatten(F.collect_list(F.when(F.col("side") == side, F.col(name))))
    return parts.groupBy("unit").agg(
        of(0, "other").alias("after"), of(0, "n").alias("after_n"), of(1, "other").alias("before"), of(1, "n").alias("before_n"))


def _table(near: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class after class over all training tokens."""
    shared = near.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = shared.value, np.zeros(classes * classes)
        for batch in batches:
            rows, others, n = _listed(batch, 1)
            sums += np.bincount(now[np.asarray(batch.column(0))][rows] * classes + now[others], weights=n, minlength=len(sums))
        cell = np.flatnonzero(sums)
        yield pa.record_batch({
            "last": pa.array((cell // classes).astype(np.int32)), "class": pa.array((cell % classes).astype(np.int32)),
            "n": pa.array(sums[cell].astype(np.int64))})

    parts = near.select("unit", "after", "after_n").mapInArrow(run, "last int, class int, n bigint")
    out = np.zeros((classes, classes))
    for r in parts.groupBy("last", "class").agg(F.sum("n").alias("n")).collect():  # at most classes * classes rows
        out[r["last"], r["class"]] = r.n
    return out


def best_classes(units: np.ndarray, near: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of the largest likelihood for each unit, all others staying where they are.

    ``near`` holds each unit's counts as units by side by class; class 0 takes no unit.
    """
    out = np.empty(len(units), dtype=np.int64)
    whole, at = _gain(np.maximum(table, 0)), np.arange(len(table))
    for i, unit in enumerate(units):
        after, before, own = near[i, 0], near[i, 1], of[unit]
        rest = table.copy()
        rest[own] -= after
        rest[:, own] -= before
        rest = np.maximum(rest, 0)
        # Without the unit only its class's row and column change.
        flat = whole.copy()
        flat[own], flat[:, own] = _gain(rest[own]), _gain(rest[:, own])
        gain = (_gain(rest + after) - flat).sum(axis=1) + (_gain(rest + before[:, None]) - flat).sum(axis=0)
        # The class's own cell grows by both sides at once.
        inner = rest[at, at]
        gain += _gain(inner + after + before) + _gain(inner) - _gain(inner + after) - _gain(inner + before)
        row, col = rest.sum(axis=1) + before, rest.sum(axis=0) + after
        gain -= _gain(row + after.sum()) - _gain(row) + _gain(col + before.sum()) - _gain(col)
        gain[0] = -np.inf
        choice = int(np.argmax(gain))
        out[i] = choice if gain[choice] > gain[own] + 1e-9 else own
    return out


def exchange(
    pairs: DataFrame, size: int, classes: int, rounds: int, rare: float = 0.002,
) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units and the class transition counts, by rounds of the exchange.

    Each unit's neighbours are brought together once; per round Spark sums them by class
    and finds, unit by unit, the class of the best gain, without a shuffle of them. The
    driver holds one class per unit and the square table of classes.
    The document's end has class 0 alone. Units of even and odd numbers take turns, so that
    neighbours do not swap forever; when both turns move less than a share of ``rare`` of
    the units, or after ``rounds`` turns, it ends.
    """
    of = 1 + np.arange(size) % (classes - 1)
    of[LAST] = 0
    scratch, last = Scratch(pairs.sparkSession), size
    near = scratch.save("near", _neighbours(pairs))
    table = _table(near, of, classes)
    for turn in range(rounds):
        shared = pairs.sparkSession.sparkContext.broadcast((of.copy(), table))

        def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, base = shared.value
            for batch in batches:
                units = np.asarray(batch.column(0))
                sums = np.empty((len(units), 2, classes))
                for side in range(2):
                    rows, others, n = _listed(batch, 1 + 2 * side)
                    sums[:, side] = np.bincount(rows * classes + now[others], weights=n, minlength=len(units) * classes).reshape(-1, classes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(best_classes(units, sums, now, base), pa.int32())], names=["unit", "choice"])

        own = near.where((F.col("unit") % 2 == turn % 2) & (F.col("unit") != LAST))
        before = of.copy()
        for r in own.mapInArrow(choose, "unit int, choice int").collect():  # one row per unit, a bounded number
            of[r.unit] = r.choice
        table = _table(near, of, classes)
        moved = int((of != before).sum())
        if moved + last < rare * size:
            break
        last = moved
    scratch.drop("near")
    return of, table


def fit(
    docs: DataFrame, units: int = 16_384, endings: int = 2_048, classes: int = 48, rounds: int = 12, folds: int = 5,
    held_out: int = 1,
) -> tuple[Model, DataFrame]:
    """Model and word counts, learnt from the documents outside the held-out fold.

    ``units`` most frequent words are units of their own, ``endings`` most frequent endings
    stand for the others, and one unit for what has neither. Counts cover all training rows.
    """
    train = docs.where(fold(F.col("doc_id"), folds) != held_out).select(F.col("text").cast("string").alias("text"))
    counts = saved(word_counts(train))
    ends = train.count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(total.n or 0) + ends, int(total.v) + (ends > 0)
    order = [F.desc("n"), F.col("word")]
    top = counts.orderBy(*order).limit(units).select("word", "n").collect()
    least = (-top[-1].n, top[-1].word) if len(top) == units else None
    rare = counts.where("false") if least is None else counts.where((F.col("n") < -least[0]) | ((F.col("n") == -least[0]) & (F.col("word") > least[1])))
    shapes = rare.groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(endings).select("ending").collect()

    def sorted_units(names, first):
        names = np.array(names, dtype=np.int64).view(_U)
        by = np.argsort(names)
        return names[by], first + by

    known = np.zeros(2 + len(top) + len(shapes), dtype=np.int64)
    known[LAST] = ends
    known[2 : 2 + len(top)] = [r.n for r in top]
    model = Model(
        *sorted_units([r.word for r in top], 2), *sorted_units([r.ending for r in shapes], 2 + len(top)), known,
        np.zeros(len(known), dtype=np.int64), np.zeros((classes, classes)), np.zeros(classes), tokens, distinct)
    pairs = saved(_unit_pairs(train, model))
    model.classes, table = exchange(pairs, len(known), classes, rounds)
    # Tokens and distinct words per class; a class keeps half a count for all its unseen words.
    sizes = np.zeros((2, classes))
    sizes[:, 0] = ends, ends > 0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            word, ending, n = (np.asarray(batch.column(i)) for i in range(3))
            unit = _looked_up(m.names, m.units, word.view(_U), -1)
            unit = np.where(unit < 0, _looked_up(m.ending_names, m.ending_units, ending.view(_U), OTHER), unit)
            now = m.classes[unit]
            sums = np.bincount(now, weights=n, minlength=classes).astype(np.int64)
            yield pa.record_batch({
                "class": pa.array(np.arange(classes, dtype=np.int32)), "n": pa.array(sums),
                "v": pa.array(np.bincount(now, minlength=classes).astype(np.int64))})

    for r in counts.mapInArrow(by_class, "class int, n bigint, v bigint").groupBy("class").agg(
            F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sizes[:, r["class"]] += r.n, r.v
    # Transitions: interpolation with the classes' own shares, so no step has probability 0.
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * classes)
    model.step = np.log10((table + 8 * share) / (table.sum(axis=1, keepdims=True) + 8))
    model.emit = np.log10(sizes[0] + 0.5 * (sizes[1] + 1))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text.

    Null and empty texts are one end. Every row gives a row, repeated rows and null ids
    too; other columns are ignored; without training tokens n_known is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_known = np.log10(m.known + 0.5)
        for batch in byte_slices(batches, "text", SLICE):
            tokens = _Tokens(batch.column("text"))
            units, row = _sequence(m.of(tokens), tokens)
            c, at = m.classes[units], units[1:]
            summed = lambda values: np.bincount(row, weights=values, minlength=tokens.rows)
            # Words that are no unit of their own count as unseen until the join below.
            single = m.known[at] > 0
            word = at != LAST
            rest = np.flatnonzero(~single[word])
            rows = tokens.row[rest]
            once, first, n = np.unique(pair(tokens.name[rest], rows.astype(_U)), return_index=True, return_counts=True)
            by = np.argsort(rows[first], kind="stable")
            lists = np.searchsorted(rows[first][by], np.arange(tokens.rows + 1)).astype(np.int32)
            listed = lambda values: pa.ListArray.from_arrays(pa.array(lists), values)
            yield pa.record_batch({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.bincount(row, minlength=tokens.rows).astype(np.int64)),
                "n_known": pa.array(summed(single).astype(np.int64)), "logs": pa.array(summed(log_known[at])),
                "path": pa.array(summed(m.step[c[:-1], c[1:]] - m.emit[c[1:]])),
                "word": listed(signed(tokens.name[rest][first][by])), "n": listed(pa.array(n[by].astype(np.int32)))})

    schema = ("row bigint, doc_id bigint, n_tokens bigint, n_known bigint, logs double, path double, "
              "word array<bigint>, n array<int>")
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = saved(numbered.mapInArrow(run, schema))
    # The rare words of all documents meet the counts; a word's rows are few by then.
    asked = parts.select("row", F.explode(F.arrays_zip("word", "n")).alias("x")).select("row", "x.word", "x.n")
    half = math.log10(0.5)
    looked = asked.join(counts.select("word", F.col("n").alias("known")), "word").groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.col("known") + 0.5) - half)).alias("more"), F.sum("n").alias("found"))
    all_logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    base = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    return parts.join(looked, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * base).alias("base_score"), (all_logs + F.col("path")).alias("score"))
