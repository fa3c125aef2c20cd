"""Periodic runs of words by catching squares with dyadic blocks.

The words of a text are appended from left to right. Whenever ``2**t`` words from a multiple
of ``2**t`` on are complete, that block becomes a *catcher* for periods ``q`` from
``2**(t+1)`` up to, not including, ``2**(t+2)``: words appended later are held against it, and
an occurrence of the block ``q`` words behind it is where a square of period ``q`` may lie. A
square of such a period matches itself at ``q`` consecutive words, so it holds a whole
aligned block of half that size, and no square slips past the catchers. From the catch the
comparison of suffixes and prefixes ``q`` apart is carried on to both sides; if at least ``q``
words agree, the square is reported, and squares of one period that overlap are one run.

Catchers of one size advance together: the appended words of a whole batch of texts are
compared by array operations, with a word of its own after every text, so that nothing
matches across texts. A block only occurs again where its halves do, so only those places
go on to the next size. A block meets at most as many places as its own period allows,
hence n words make O(n log n) catches at worst. Periods below 8 are compared word by word.

Words are compared by 64-bit names, and long stretches by sums of names; the runs that come
out are then held against the names word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfspark.llm.arrays import byte_slices, pair, raw, row_of, word_names, words
from shelfspark.llm.common import mix64

_U = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SMALL = 8  # periods below are compared directly
_BASE = 0x9E3779B97F4A7C15
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    steps = np.diff(padded)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


class _Sums:
    """Sums of names under powers of a base, for comparing stretches that lie a period apart."""

    def __init__(self, x: np.ndarray):
        n = len(x) + 1
        self.powers = np.ones(n, dtype=_U)
        filled = 1
        with np.errstate(over="ignore"):
            while filled < n:  # powers by doubling
                more = min(filled, n - filled)
                self.powers[filled : filled + more] = self.powers[:more] * _U(pow(_BASE, filled, 1 << 64))
                filled += more
            self.upto = np.concatenate([[_U(0)], np.cumsum(x * self.powers[:-1], dtype=_U)])
        self.n = len(x)

    def equal(self, at: np.ndarray, period: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            here = (self.upto[at + size] - self.upto[at]) * self.powers[period]
            return here == self.upto[at + period + size] - self.upto[at + period]

    def ahead(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on equal those a period later."""
        low, high = np.zeros(len(at), dtype=np.int64), self.n - at - period
        while len(at) and (low < high).any():
            size = (low + high + 1) // 2
            same = self.equal(at, period, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low

    def behind(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before ``at`` equal those a period later."""
        low, high = np.zeros(len(at), dtype=np.int64), at.copy()
        while len(at) and (low < high).any():
            size = (low + high + 1) // 2
            same = self.equal(at - size, period, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low


def _catches(x: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, period) of every catch, one block size after the other; names of 4 words first."""
    size = SMALL // 2
    n = len(x)
    if n < 2 * size or longest < 2 * SMALL:
        return
    name = pair(x[:-1], x[1:])
    name = pair(name[:-2], name[2:])
    alive = np.arange(len(name))
    while len(alive) and 4 * size <= longest:
        order = np.lexsort((alive, name[alive]))
        place = alive[order]
        value = name[place]
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = value[1:] != value[:-1]
        group = np.cumsum(fresh) - 1
        often = np.bincount(group)[group] > 1
        place, group = place[often], group[often]
        # One ordered key per occurrence: the string, then the place.
        key = group * (n + 1) + place
        blocks = place % size == 0
        at, base = place[blocks], group[blocks] * (n + 1)
        low = np.searchsorted(key, base + np.minimum(at + 2 * size, n))
        counts = np.searchsorted(key, base + np.minimum(at + 4 * size, n)) - low
        from_ = np.repeat(at, counts)
        hit = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        yield from_, place[hit] - from_
        # The next size is only repeated where both halves are.
        live = np.zeros(n + 1, dtype=bool)
        live[place] = True
        alive = np.sort(place)
        alive = alive[alive + size < n]
        alive = alive[live[alive + size]]
        longer = np.zeros_like(name)
        longer[alive] = pair(name[alive], name[alive + size])
        name = longer
        size *= 2


def find_runs(x: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least ``least`` names and two periods.

    ``longest`` bounds the length of a run. Ordered by start, then period.
    """
    found = []
    for period in range(1, min(SMALL, longest // 2 + 1, len(x))):
        start, end = _stretches(x[:-period] == x[period:])
        kept = end - start >= max(period, least - period)
        found.append((start[kept], end[kept] + period, np.full(kept.sum(), period)))
    sums = None
    for at, period in _catches(x, longest):
        if not len(at):
            continue
        sums = sums or _Sums(x)
        start = at - sums.behind(at, period)
        end = at + sums.ahead(at, period)
        square = (end - start >= period) & (end - start + period >= least)
        squares = np.unique(np.stack([start[square], end[square] + period[square], period[square]]), axis=1)
        found.append(tuple(squares))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, end, period = (np.concatenate(c).astype(np.int64) for c in zip(*found))
    # A multiple of the smallest period gives the same stretch: the smallest one counts.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    for s, e, q in zip(start, end, period):
        if not np.array_equal(x[s : e - q], x[s + q : e]):
            raise ArithmeticError("two stretches of words have one sum")
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 1 << 22):
            data, starts = raw(batch.column("text"))
            first, end = words(data, starts, BLANK)
            row = row_of(starts, first)
            rows = batch.num_rows
            # A name of its own after every text; word i of text r is at i + r.
            counts = np.bincount(row, minlength=rows)
            before = np.concatenate([[0], np.cumsum(counts)])
            x = mix64(np.arange(len(first) + rows, dtype=_U) + _U(1 << 50))
            x[np.arange(len(first)) + row] = word_names(data, first, end)
            s, e, q = find_runs(x, least, int(counts.max(initial=0)))
            opening = before[:-1] + np.arange(rows)
            text = np.searchsorted(opening, s, side="right") - 1
            entries = pa.StructArray.from_arrays(
                [pa.array(s - opening[text]), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(text, np.arange(rows + 1)).astype(np.int32)), entries)
            # Words kept: not in any run after its first period.
            steps = np.zeros(len(x) + 1, dtype=np.int64)
            np.add.at(steps, s + q, 1)
            np.add.at(steps, e, -1)
            kept = (np.cumsum(steps)[:-1] == 0)[np.arange(len(first)) + row]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)), "runs": runs,
                "collapsed": _joined(data, first[kept], end[kept], row[kept], rows)})

    return run


def _joined(data, first, end, row, rows) -> pa.Array:
    """The words of each text joined by one blank."""
    # Every word is copied with one blank before it, unless it is its text's first.
    opens = np.ones(len(first), dtype=np.int64)
    opens[1:] = row[1:] != row[:-1]
    sizes = end - first + 1 - opens
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    place = np.arange(total) - np.repeat(upto - sizes, sizes) - np.repeat(1 - opens, sizes)
    out = np.full(total, 0x20, dtype=np.uint8)
    letters = place >= 0
    out[letters] = data[(place + np.repeat(first, sizes))[letters]]
    ends = np.concatenate([[0], upto])[np.searchsorted(row, np.arange(rows + 1))]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), rows, [None, pa.py_buffer(np.ascontiguousarray(ends.astype(np.int64))), pa.py_buffer(out)],
    ).cast(pa.large_string()).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    A word is a longest stretch without blanks, tabs and line breaks. ``runs`` are all
    stretches of at least ``least`` words and two of their smallest period that no
    neighbouring word extends, by start, then period; ``collapsed`` joins the words that no
    run has after its first period. Null and empty texts have no words and no runs. Each row
    gets its own result, also of a repeated or null id; an empty table gives no rows; other
    columns are not looked at. No rows are shuffled: a text is one record of one task.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _found(least), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
