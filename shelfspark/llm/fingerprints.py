"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases, the phrases into phrases of phrases, and so on. Where
to cut is decided by deterministic coin tossing: a symbol's label is the lowest bit in which
it differs from its left neighbour together with that bit; a few rounds leave labels below
six, and their local maxima start the phrases. Runs of one symbol are a phrase each. A cut
depends on a few neighbours only, so equal substrings are cut alike inside, wherever they
stand, and a phrase's name is a hash of what it holds. The fingerprint is the bottom sketch
of the names at one level: the smallest ones, as hexadecimal text. The likeness of two
fingerprints estimates the share of common phrases and is exact for short documents.

Edited texts borrow from the next document in the order of ids. Documents are dealt to
ranges of ids, whose bounds come from approximate quantiles; the first document of a range
is also sent to the range before it. So neighbours meet in one shuffle of the texts, and a
task reads its ranges as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import mix64, small_batches

LEVEL = 3  # phrases of about 14 bytes
SKETCH = 64
_CHUNK = 1 << 18
_MARGIN = 8  # a cut looks at five symbols to the left and one to the right
_NONE = -(1 << 63)
_LAST_BIT = np.array([(v & -v).bit_length() - 1 if v else 0 for v in range(256)], dtype=np.uint8)


@lru_cache(maxsize=1)
def _byte_names() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _toss(labels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One round: lowest differing bit and its value, for labels of one byte."""
    at = _LAST_BIT[labels ^ before]
    return (at << np.uint8(1)) | ((labels >> at) & np.uint8(1))


def _first_toss(names: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The same for names of 64 bits."""
    apart = names ^ before
    low = apart & (~apart + np.uint64(1))
    at = np.where(apart == 0, 0, np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint64)
    return ((at << np.uint64(1)) | ((names >> at) & np.uint64(1))).astype(np.uint8)


def _shift(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[0] = 0
    out[1:] = x[:-1]
    return out


def _cuts(symbols: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Flags of phrase starts; ``border`` flags the starts of texts."""
    size = len(symbols)
    same = np.zeros(size + 1, dtype=bool)  # equal to the left neighbour, inside one text
    same[1:size] = (symbols[1:] == symbols[:-1]) & ~border[1:]
    # The left context of a stretch's first symbol is a fixed value, not the text before it.
    fresh = border | same[:size] | np.concatenate([[False], same[: size - 1]])
    before = _shift(symbols)
    before[border] = 0
    labels = _first_toss(symbols, before) if symbols.dtype == np.uint64 else _toss(symbols, before)
    for _ in range(3):
        before = _shift(labels)
        before[fresh] = 0
        labels = _toss(labels, before)
    after = np.empty_like(labels)
    after[:-1] = labels[1:]
    after[-1] = 0
    peak = (labels > _shift(labels)) & (labels >= after)
    in_run = same[:size]
    run_start = same[1: size + 1] & ~in_run
    run_end = ~in_run & np.concatenate([[False], in_run[:-1]])
    near = fresh | same[1: size + 1]  # next to a run the run decides
    return border | run_start | run_end | (peak & ~in_run & ~near)


def _parse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and the texts' first phrases."""
    size = len(symbols)
    border = np.zeros(size, dtype=bool)
    border[starts] = True
    cuts = np.empty(size, dtype=bool)
    for at in range(0, size, _CHUNK):
        low, high = max(0, at - _MARGIN), min(size, at + _CHUNK + _MARGIN)
        end = min(size, at + _CHUNK)
        cuts[at:end] = _cuts(symbols[low:high], border[low:high])[at - low: end - low]
    first = np.flatnonzero(cuts)
    lengths = np.diff(first, append=size)
    names = np.empty(len(first), dtype=np.uint64)
    step = _CHUNK // 4
    for a in range(0, len(first), step):
        part, width = first[a: a + step], lengths[a: a + step]
        low, high = part[0], part[-1] + width[-1]
        place = np.arange(low, high) - np.repeat(part, width)
        content = _byte_names()[symbols[low:high]] if symbols.dtype == np.uint8 else mix64(symbols[low:high])
        weight = mix64(np.arange(1, int(width.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        sums = np.add.reduceat(content * weight[place], part - low)
        names[a: a + step] = mix64(sums + width.astype(np.uint64))
    return names, np.searchsorted(first, starts)


def sketches(texts: list[str], level: int = LEVEL, size: int = SKETCH) -> list[np.ndarray]:
    """Sorted smallest distinct 32-bit names of each text's phrases at ``level``."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = [np.empty(0, dtype=np.uint32)] * len(texts)
    filled = [i for i, d in enumerate(data) if d]
    if not filled:
        return out
    symbols = np.frombuffer(b"".join([data[i] for i in filled]), dtype=np.uint8)
    starts = np.cumsum([0] + [len(data[i]) for i in filled[:-1]])
    for _ in range(level):
        symbols, starts = _parse(symbols, starts)
    short = (mix64(symbols) >> np.uint64(32)).astype(np.uint32)
    for i, part in zip(filled, np.split(short, starts[1:])):
        out[i] = np.unique(part)[:size]
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of common names among the smallest ones of both; 1 for equal sketches."""
    both = np.unique(np.concatenate([a, b]))[:size]
    if not len(both):
        return 1.0
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def fingerprints(docs: DataFrame, level: int = LEVEL, size: int = SKETCH) -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty, which has ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            found = [as_text(s) for s in sketches([t or "" for t in batch.column(1).to_pylist()], level, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, fingerprint string")


def _ranges(ids: DataFrame, rows: int, most: int) -> tuple[np.ndarray, dict[int, int]]:
    """Lower bounds of the id ranges, and for each range's largest id the range above it.

    Ranges are numbered from the smallest ids; at most ``most`` of them, so both are small.
    """
    found = ids.agg(F.count("*")).first()[0]
    if not found:
        return np.empty(0, dtype=np.int64), {}
    count = max(1, min(most, found // rows))
    points = [i / count for i in range(1, count)]
    bounds = ids.agg(F.percentile_approx("doc_id", points, 100 * count)).first()[0] if points else []
    bounds = np.unique(np.array([_NONE, *bounds], dtype=np.int64))
    tops = {r.range: r.top for r in ids.groupBy(_number(bounds)("doc_id").alias("range")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # The document after a range's smallest id is the largest id of the range below.
    return bounds, {tops[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}


def _number(bounds: np.ndarray):
    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right") - 1)

    return number


def with_next(
    docs: DataFrame, level: int = LEVEL, size: int = SKETCH, range_rows: int = 1024, ranges: int = 16_384,
) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text replaces the last n_chars // 2 code points by the first as many (or
    all) of the next document in descending doc_id; after the last comes the first. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty, and two empty texts are alike. Rows of one doc_id follow each
    other by their texts; null ids come last. One row is its own next; no rows give none.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE)).alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, guests = _ranges(own.select("doc_id"), range_rows, ranges)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.to_numpy(), side="right") - 1
        return pd.Series([[a, guests[i]] if i in guests else [a] for a, i in zip(at.tolist(), ids.tolist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row waits for its successor; a guest only lends its text.
        waiting: tuple | None = None
        for batch in small_batches(batches, 128):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            found = sketches([r[3] for r in rows], level, size)
            done, edited = [], []
            for (where, guest, doc_id, text), sketch in zip(rows, found):
                if waiting and waiting[0] == where:
                    _, last_id, last, last_sketch = waiting
                    cut = len(last) // 2
                    done.append((last_id, len(last), last_sketch, sketch))
                    edited.append(last[: len(last) - cut] + text[:cut])
                waiting = None if guest else (where, doc_id, text, sketch)
            if done:
                changed = sketches(edited, level, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if d[0] == _NONE else d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([as_text(d[2]) for d in done], pa.string()),
                    pa.array([as_text(c) for c in changed], pa.string()),
                    pa.array([likeness(d[2], c, size) for d, c in zip(done, changed)], pa.float64()),
                    pa.array([likeness(d[2], d[3], size) for d in done], pa.float64()),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    dealt = own.select("doc_id", "text", F.posexplode(places("doc_id")).alias("guest", "range"))
    # Ids fall from row to row; the guest of a range is its successor and comes last.
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")
    return ordered.select("range", "guest", "doc_id", "text").mapInArrow(run, schema)
