"""Packing of tokenized documents into fixed windows by the sum-of-squares rule.

A window of ``size`` tokens that holds h tokens has level h. A document that fits into
level h moves one window from h to h + length; the rule takes the level that leaves the
smallest sum of squared counts of partially filled windows, so no level piles up and
every later length finds a fitting gap. An array holds the number of windows per level.

Each task packs its own partition in one streaming pass, without a shuffle. Every document
is placed by the rule. A task holds at most ``held_ids`` ids of unfinished windows: beyond
that, the windows of the level that holds most of them are poured together into whole
sequences, as all unfinished windows are at the task's end. What then remains below one
window is cut into sequences whose lengths are powers of two, which need no padding.
Nothing is dropped: every id of every document lies in exactly one piece.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import small_batches

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
# Sequences one task may number; the partition's number stands above these bits.
_TASK_BITS = 40
# Letters below this code point are split alike by both tokenizer libraries.
_PLAIN = re.compile("[^\u0000-ɏ]")


class Tokens:
    """Token ids of texts, as the tokenizer file gives them.

    ``ranks`` names the same vocabulary as a rank list: Latin text without special tokens
    goes through the faster library that reads it, all other text through the file itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        if self.fast and not _PLAIN.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def tokens(path: str, ranks: str | None) -> Tokens:
    """One tokenizer per Python worker."""
    return Tokens(path, ranks)


class Packer:
    """Online packing of one task's documents; yields finished pieces."""

    def __init__(self, size: int = 2048, held_ids: int = 1 << 23, first_id: int = 0):
        # One window of every level always has room.
        self.size, self.limit, self.next_id = size, max(held_ids, size * size), first_id
        self.held = 0
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.at_level: dict[int, list[tuple[int, list]]] = defaultdict(list)

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _level(self, length: int) -> int:
        """Level that leaves the smallest sum of squares; the fullest one on a tie."""
        top = self.size - length
        now = self.count[: top + 1]
        change = 2 * (self.count[length:] - now) + 2
        change[top] -= 1  # a full window is no longer counted
        change[now == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.count[length] + 1  # a new window leaves no level
        return int(top - np.argmin(change[::-1]))

    def _put(self, level: int, piece: tuple) -> list[tuple]:
        """Add a piece to a window of the level; the window's pieces, once it is full."""
        if level:
            window, held = self.at_level[level].pop()
            self.count[level] -= 1
        else:
            window, held = self._new(), []
        held.append(piece)
        filled = level + len(piece[2])
        self.held += len(piece[2])
        if filled == self.size:
            self.held -= self.size
            return self._emit(window, held)
        self.at_level[filled].append((window, held))
        self.count[filled] += 1
        return self._close_level() if self.held > self.limit else []

    def _close_level(self) -> list[tuple]:
        """Pour the windows of the level that holds most ids together; less than one window is left and stays open."""
        level = int(np.argmax(self.count * np.arange(self.size + 1)))
        windows = self.at_level.pop(level)
        self.count[level] = 0
        whole = len(windows) * level // self.size
        out, left = self._poured(windows, [self.size] * whole)
        self.held -= whole * self.size
        if left:
            filled = sum(len(p[2]) for p in left)
            self.at_level[filled].append((self._new(), left))
            self.count[filled] += 1
        return out

    def _poured(self, windows: list, lengths: list[int]) -> tuple[list[tuple], list[tuple]]:
        """The windows' pieces in sequences of the given lengths, cut where one ends, and the pieces that are left."""
        out, held, room = [], [], 0
        lengths = lengths[::-1]
        for doc_id, start, ids, total in (p for _, pieces in windows for p in pieces):
            while len(ids) and (room or lengths):
                room = room or lengths.pop()
                cut = min(room, len(ids))
                held.append((doc_id, start, ids[:cut], total))
                start, ids, room = start + cut, ids[cut:], room - cut
                if not room:
                    out += self._emit(self._new(), held)
                    held = []
            if len(ids):
                held.append((doc_id, start, ids, total))
        return out, held

    @staticmethod
    def _emit(window: int, held: list) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, total in held:
            out.append((doc_id, start, len(ids), ids.tobytes(), total, window, offset))
            offset += len(ids)
        return out

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        total, at, out = len(ids), 0, []
        while total - at >= self.size:
            out += self._emit(self._new(), [(doc_id, at, ids[at: at + self.size], total)])
            at += self.size
        if at < total:
            rest = ids[at:].copy() if at else ids  # a long document's other ids are not held
            out += self._put(self._level(total - at), (doc_id, at, rest, total))
        return out

    def finish(self) -> list[tuple]:
        """Pour the unfinished windows together; the rest becomes power-of-two sequences."""
        windows = [w for level in sorted(self.at_level, reverse=True) for w in self.at_level[level]]
        rest = self.held % self.size
        lengths = [self.size] * (self.held // self.size)
        lengths += [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
        out, _ = self._poured(windows, lengths)
        self.at_level.clear()
        self.count[:] = 0
        self.held = 0
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW
    )


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end_id: int = 1,
    held_ids: int = 1 << 23,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``size`` tokens.

    A document is its text's token ids and then ``end_id``; a null text counts as empty.
    Columns: doc_id, start and length of the piece in its document, its ids (little-endian
    unsigned 32-bit), the document's tokens, sequence_id and the piece's offset there.
    A sequence shorter than ``size`` has a power of two as its length. Repeated rows are
    packed each; a null doc_id stays null; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        packer = Packer(size, held_ids, (task.partitionId() if task else 0) << _TASK_BITS)
        encode = tokens(tokenizer, ranks).ids
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) if text else []
                ids.append(end_id)
                rows += packer.add(doc_id, np.array(ids, dtype="<u4"))
            if rows:
                yield _batch(rows)
        if rows := packer.finish():
            yield _batch(rows)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
