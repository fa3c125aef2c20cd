"""Quality classifier by compression: which of two dictionaries serves a text better.

One zstandard dictionary is trained on pieces of good labelled texts, one on pieces of bad
ones. A text is compressed with both, piece by piece; the difference of the compressed
sizes over the raw size is its only feature, and a logistic curve fitted on labelled rows
turns it into a score between 0 and 1.

The fit uses a bounded sample of labelled rows: per class at most ``sample`` documents
with the smallest id hashes, and of each the ``pieces`` pieces that follow a hashed offset.
The curve is fitted across halves of the sample. Scoring reads whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import fold, small_batches

PIECE = 1024  # bytes compressed at a time


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text, and the curve; None without both classes."""

    bad: bytes | None
    good: bytes | None
    slope: float
    shift: float


def _pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    return [data[i: i + size] for i in range(0, len(data), size)]


class Scorer:
    def __init__(self, model: Model, level: int = 3):
        self.model = model
        self.pair = []
        if model.bad is not None:
            for content in (model.bad, model.good):
                known = zstandard.ZstdCompressionDict(content)
                known.precompute_compress(level=level)
                self.pair.append(zstandard.ZstdCompressor(
                    level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def feature(self, text: str | None) -> float:
        """Compressed size with the bad dictionary less that with the good one, over the raw size."""
        return self.feature_of((text or "").encode("utf-8", "surrogatepass"))

    def feature_of(self, data: bytes) -> float:
        if not data or not self.pair:
            return 0.0
        bad, good = self.pair
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in _pieces(data)) / len(data)

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.feature(text) + self.model.shift
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _dictionary(samples: list[bytes], size: int) -> bytes | None:
    """Trained dictionary; of few or uniform samples the raw text itself."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic fit by Newton steps with a little shrinkage; ``share`` of all rows are good."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta * [1, 0]
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, pieces: int = 4, size: int = 114_688,
    folds: int = 3, held_out: int = 1,
) -> Model:
    """Model learnt from labelled rows outside the held-out fold.

    Rows with null text, quality or doc_id teach nothing. A doc_id with both labels counts
    once per label. With one class only, or none, every text scores 0.5.
    """
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    marked = marked.where(fold(F.col("doc_id"), folds) != held_out)
    counts = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    # The sampling comes before the texts: at most 2 * sample ids meet the documents.
    chosen = marked.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(
        marked.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    width = PIECE * pieces
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - width + 1, F.lit(1))).cast("int") + 1
    taken = docs.where("text IS NOT NULL AND text <> ''").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "quality", F.substring(F.col("text"), start, F.lit(width)).alias("text"))
    rows = sorted((r.doc_id, r.quality, r.text) for r in taken.limit(4 * sample).collect())
    by_class: dict[int, list[bytes]] = {0: [], 1: []}
    for _, quality, text in rows:
        by_class[quality].append(text.encode("utf-8", "surrogatepass"))
    if not by_class[0] or not by_class[1]:
        return Model(None, None, 0.0, 0.0)

    def dictionaries(texts: dict[int, list[bytes]]) -> Model:
        bad, good = (_dictionary([p for b in texts[q] for p in _pieces(b)], size) for q in (0, 1))
        return Model(bad, good, 0.0, 0.0)

    # The curve is fitted on texts that the dictionaries of the other half have not seen.
    test = []
    for half in (0, 1):
        seen = {q: texts[half::2] or texts for q, texts in by_class.items()}
        scorer = Scorer(dictionaries(seen))
        test += [(scorer.feature_of(b), q) for q, texts in by_class.items() for b in (texts[1 - half::2] or texts)]
    share = counts[1] / (counts[0] + counts[1])
    slope, shift = _curve(np.array([x for x, _ in test]), np.array([q for _, q in test]), share)
    model = dictionaries(by_class)
    return Model(model.bad, model.good, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of every whole text; null counts as empty.

    Every row gives a row, repeated rows and null ids too; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small_batches(batches):
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model predicts as good, with all their columns.

    Null and empty texts have the score of an empty text; a model without labels keeps all rows;
    repeated rows and null ids are judged by their text; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        scorer = Scorer(shared.value)
        return texts.map(lambda t: scorer.score(t if isinstance(t, str) else None) >= 0.5)

    return docs.where(good(F.col("text").cast("string")))
