"""Token counts of texts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton over the vocabulary finds all pieces that end at a position;
dynamic programming carries the best score of each prefix and its number of pieces. Ties
go as in the tokenizer library: candidates of one end are compared in the order of their
starts and replace only on a greater score, so the longest of equally good last pieces
wins; a character no piece covers alone scores the vocabulary's lowest score less ten.
Uncovered characters count as their UTF-8 bytes where the vocabulary has all byte pieces,
else a run of them is one unknown token.

No piece crosses from a non-blank to a blank mark or into a character that no piece
contains, so the text falls into independent units there. Repeated units are looked up in
a memo of bounded size per Python worker; long units go through the same program.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import small_batches

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
_MEMO_UNITS = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentence-piece model file, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Unigram:
    """Count-only Viterbi over (piece, score) pairs; ids of ``skipped`` are not matched."""

    def __init__(self, vocabulary: list[tuple[str, float]], memo: int = _MEMO_UNITS):
        names = {piece for piece, _ in vocabulary}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores[piece] = score  # of a repeated piece the last counts
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.scores = scores
        crossing = any(BLANK in piece.lstrip(BLANK) for piece in scores)
        covered = {c for piece in scores for c in piece}
        # Units end before a blank mark and around line ends, if no piece reaches across.
        if crossing:
            self.units = re.compile("(?s).+")
        elif "\n" in covered:
            self.units = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        else:
            self.units = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+")
        self.memo: dict[str, tuple[int, int, float]] = {}
        self.memo_size = memo

    def best(self, unit: str) -> tuple[int, int, float]:
        """Pieces, byte pieces among them, and score of the best segmentation of ``unit``."""
        size = len(unit)
        score = [0.0] + [None] * size
        count = [0] * (size + 1)
        raw = [0] * (size + 1)
        last_unknown = [False] * (size + 1)
        hits = self.automaton.iter(unit)
        hit = next(hits, None)
        for end in range(1, size + 1):
            best, start_of, alone = None, end - 1, False
            while hit is not None and hit[0] == end - 1:
                length, value = hit[1]
                alone = alone or length == 1
                before = score[end - length] + value
                if best is None or before > best:  # matches come longest first
                    best, start_of = before, end - length
                hit = next(hits, None)
            unknown = False
            if not alone:
                before = score[end - 1] + self.unknown
                if best is None or before > best:
                    best, start_of, unknown = before, end - 1, True
            score[end] = best
            count[end], raw[end] = count[start_of], raw[start_of]
            if not unknown:
                count[end] += 1
            elif self.bytes_known:
                width = len(unit[end - 1].encode("utf-8", "surrogatepass"))
                count[end] += width
                raw[end] += width
            elif not last_unknown[start_of]:
                count[end] += 1
            last_unknown[end] = unknown
        return count[size], raw[size], score[size]

    def count(self, text: str | None) -> tuple[int, int, float]:
        """Tokens, byte tokens among them, and score of a whole text; an empty text has none."""
        if not text:
            return 0, 0, 0.0
        marked = BLANK + text.replace(" ", BLANK)
        tokens, raw, score = 0, 0, 0.0
        memo = self.memo
        if len(memo) > self.memo_size:
            memo.clear()
        if not self.bytes_known:  # a run of unknown characters may pass from unit to unit
            return self.best(marked)
        for unit in self.units.findall(marked):
            known = memo.get(unit)
            if known is None:
                known = self.best(unit)
                if len(unit) <= 64:
                    memo[unit] = known
            tokens += known[0]
            raw += known[1]
            score += known[2]
        return tokens, raw, score


@lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    """One automaton and memo per Python worker."""
    return Unigram(read_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, score of every whole text of ``docs``.

    Null and empty texts have no tokens and score 0. Every row gives a row, repeated rows
    and null ids too; other columns are ignored. The sum of scores is exact where scores
    are whole numbers below 2^53, as in merge-rank vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model(vocabulary).count
        for batch in small_batches(batches):
            rows = [counter(t) for t in batch.column(1).to_pylist()]
            tokens, raw, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(raw, pa.int64()), pa.array(scores, pa.float64())],
                names=["doc_id", "n_tokens", "n_byte_tokens", "score"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, score double")
