"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word's bytes from both ends, labels every position with language
probabilities, and a document's probabilities are the mean over all its positions. Words
are runs of other than ASCII blanks; runs over ``LONGEST`` bytes are read in pieces of that
length. A word is read alone, so its labels are the same wherever it stands: each distinct
word of a batch is run once, and a memo of bounded size per Python worker keeps the result.

Training is backpropagation through time in numpy on a bounded sample: per language the
``sample`` documents with the smallest id hashes, and of each a window of ``window``
characters at a hashed offset. Prediction reads whole texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import fold, small_batches

LONGEST = 24
SAMPLE_PARTS = 64
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MEMO_BYTES = 48 << 20


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8 bytes, long ones in pieces."""
    parts = text.encode("utf-8", "surrogatepass").split()
    if any(len(p) > LONGEST for p in parts):
        parts = [p[i: i + LONGEST] for p in parts for i in range(0, len(p), LONGEST)]
    return parts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Parameters: per direction input table, recurrence and bias; then the output layer."""

    languages: list[str]
    hidden: int = 16
    seed: int = 5
    params: dict[str, np.ndarray] = field(default_factory=dict)
    # Tells networks apart in Python workers that serve several of them.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.params:
            return
        rng, h, k = np.random.default_rng(self.seed), self.hidden, max(1, len(self.languages))
        for way in "fb":
            self.params[f"in_{way}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.params[f"rec_{way}"] = (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.params["out"] = (rng.normal(0, 1, (2 * h, k)) / np.sqrt(2 * h)).astype(np.float32)
        self.params["bias"] = np.zeros(k, dtype=np.float32)

    def _run(self, way: str, data: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; ``data`` is words by positions of equal length."""
        h = self.hidden
        table, rec = self.params[f"in_{way}"], self.params[f"rec_{way}"]
        state = np.zeros((len(data), h), dtype=np.float32)
        out = np.empty((data.shape[1], len(data), h), dtype=np.float32)
        steps = range(data.shape[1]) if way == "f" else range(data.shape[1] - 1, -1, -1)
        for t in steps:
            x, u = table[data[:, t]], state @ rec
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + reset * u[:, 2 * h:])
            if keep is not None:
                keep.append((t, state, update, reset, new, u[:, 2 * h:]))
            state = new + update * (state - new)
            out[t] = state
        return out

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        z = states @ self.params["out"] + self.params["bias"]
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=-1, keepdims=True)

    def label(self, words: list[bytes]) -> np.ndarray:
        """Sum over the positions of the language probabilities, one row per word."""
        out = np.zeros((len(words), max(1, len(self.languages))), dtype=np.float32)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for part in np.array_split(at, max(1, len(at) // 4096)):
                data = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8).reshape(len(part), size)
                states = np.concatenate([self._run("f", data, None), self._run("b", data, None)], axis=2)
                out[part] = self._probabilities(states).sum(axis=0)
        return out

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        h, (count, length) = self.hidden, data.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(w, data, kept[w]) for w in "fb"], axis=2)
        p = self._probabilities(states)
        rows = np.arange(count)
        loss = -np.log(np.maximum(p[:, rows, target], 1e-9)).mean()
        p[:, rows, target] -= 1
        p /= count * length
        grads = {
            "out": states.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]),
            "bias": p.sum(axis=(0, 1)),
        }
        outer = p @ self.params["out"].T
        for n, way in enumerate("fb"):
            rec = self.params[f"rec_{way}"]
            d_rec, d_in = np.zeros_like(rec), np.zeros_like(self.params[f"in_{way}"])
            back = np.zeros((count, h), dtype=np.float32)
            for t, before, update, reset, new, inner in reversed(kept[way]):
                d = outer[t][:, n * h: (n + 1) * h] + back
                d_new = d * (1 - update) * (1 - new * new)
                d_update = d * (before - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                d_u = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
                d_x = np.concatenate([d_update, d_reset, d_new], axis=1)
                d_rec += before.T @ d_u
                order = np.argsort(data[:, t], kind="stable")
                letters, first = np.unique(data[order, t], return_index=True)
                d_in[letters] += np.add.reduceat(d_x[order], first, axis=0)
                back = d * update + d_u @ rec.T
            grads[f"rec_{way}"], grads[f"in_{way}"] = d_rec, d_in
        return float(loss), grads

    def train(self, words: list[bytes], target: np.ndarray, steps: int, batch: int = 512, rate: float = 0.01) -> None:
        """Adam on batches of words of one length, lengths in proportion to their bytes."""
        rng = np.random.default_rng(self.seed)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        lengths = sorted(by_length)
        weight = np.array([n * len(by_length[n]) for n in lengths], dtype=float)
        weight /= weight.sum()
        data = {n: np.frombuffer(b"".join([words[i] for i in by_length[n]]), dtype=np.uint8).reshape(-1, n) for n in lengths}
        goal = {n: target[by_length[n]] for n in lengths}
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        for step in range(1, steps + 1):
            n = int(rng.choice(lengths, p=weight))
            pick = rng.integers(0, len(data[n]), size=batch)
            _, grads = self.gradients(data[n][pick], goal[n][pick])
            now = rate * (1 - step / (steps + 1)) + 1e-4
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.params[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


class Reader:
    """Pooled document probabilities, with a memo of words of bounded size."""

    def __init__(self, network: Network):
        self.network = network
        self.limit = _MEMO_BYTES // (4 * max(1, len(network.languages)) + 100)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.network.languages))), dtype=np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.known) > self.limit:
            self.clear()
        if not self.network.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        known = self.known
        split = [words_of(t) if t and _LETTER.search(t) else [] for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if new:
            start = len(known)
            if start + len(new) > len(self.rows):
                self.rows = np.resize(self.rows, (2 * (start + len(new)), self.rows.shape[1]))
            self.rows[start: start + len(new)] = self.network.label(new)
            known.update(zip(new, range(start, start + len(new))))
        out = []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            pooled = self.rows[at].sum(axis=0, dtype=np.float64)
            pooled /= pooled.sum()
            best = int(pooled.argmax())
            out.append((self.network.languages[best], min(1.0, float(pooled[best]))))
        return out


def fit(
    docs: DataFrame, sample: int = 500, window: int = 1500, most: int = 20_000, steps: int = 1500,
    hidden: int = 16, folds: int = 3, held_out: int = 1,
) -> Network:
    """Network learnt from text and non-null lang outside the held-out fold.

    At most ``sample`` documents per language and ``most`` in all. Without such documents
    the network knows no language and every prediction is ``und``.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(
        fold(F.col("doc_id"), folds) != held_out)
    # Ids first, their texts after: the smallest hashes of every language, cut in each of its parts before the parts meet.
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    for by in (["lang", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SAMPLE_PARTS))], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("n") <= sample)
    ids = ids.orderBy("n", "lang").limit(most).select("doc_id", "lang", "n")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    # At most ``most`` ids; rows of one id and language take turns from the lowest n.
    once = ids.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("copies"))
    found = rows.join(F.broadcast(once), ["doc_id", "lang"]).select(
        "doc_id", "lang", "copies", F.substring(F.col("text"), start, F.lit(window)).alias("text"))
    taken = (found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "lang").orderBy("text")))
             .where(F.col("n") <= F.col("copies")).collect())
    languages = sorted({r.lang for r in taken if r.lang != UNKNOWN})
    at = {lang: i for i, lang in enumerate(languages)}
    words, target = [], []
    for r in sorted(taken, key=lambda r: (r.lang, r.doc_id, r.text)):
        if r.lang in at and _LETTER.search(r.text):
            own = words_of(r.text)
            words += own
            target += [at[r.lang]] * len(own)
    network = Network(languages if words else [], hidden=hidden)
    if words:
        network.train(words, np.array(target), steps)
    return network


_READERS: dict[str, Reader] = {}


def _reader(key: str, shared) -> Reader:
    """The worker's reader of a broadcast network, kept while the worker serves it."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(shared.value)
    return _READERS[key]


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; ``und`` and 0 without any letter.

    Every row gives a row, repeated rows and null ids too; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # parameters of fixed size
    key = network.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, shared)
        for batch in small_batches(batches):
            found = reader.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network, least: float = 0.0) -> DataFrame:
    """Rows whose text has a language and a score of at least ``least``, with all their columns.

    A network that knows no language only tells texts without letters apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    key = network.key

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        reader, out = _reader(key, shared), []
        for at in range(0, len(texts), 256):
            part = [t if isinstance(t, str) else None for t in texts.iloc[at: at + 256]]
            if reader.network.languages:
                out += [lang != UNKNOWN and score >= least for lang, score in reader.predict(part)]
            else:
                out += [bool(t and _LETTER.search(t)) for t in part]
        return pd.Series(out, dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
