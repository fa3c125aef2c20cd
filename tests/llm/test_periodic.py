"""Runs of words against all periods tried one by one."""

import hashlib
import random
import zlib

import pyarrow as pa
from shelfspark.llm import periodic, queries
from shelfspark.llm.periodic import periodic_runs

from . import helpers as H


def brute(words, least=12):
    runs = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                runs.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        kind = rng.random()
        if kind < 0.4:
            piece = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
            words += [piece[i % len(piece)] for i in range(rng.randint(1, 150))]
        else:
            words += [rng.choice("ab" if kind < 0.7 else "0123456789") for _ in range(rng.randint(0, 70))]
    return words


def test_random_words():
    """Nested and overlapping runs, squares of squares, many texts in one batch."""
    rng = random.Random(7)
    docs = [made(rng) for _ in range(500)] + [["w"] * 3000, (["a"] * 40 + ["b"]) * 50, ["a", "b"] * 6, ["a", "b"] * 5 + ["a"]]
    batch = pa.record_batch({"doc_id": pa.array(range(len(docs))), "text": pa.array([" \n".join(d) for d in docs])})
    rows = [r for b in periodic._found(12)(iter([batch])) for r in b.to_pylist()]
    for words, row in zip(docs, rows, strict=True):
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
        assert row["collapsed"] == left(words, want) and row["n_words"] == len(words)


def test_long_periods():
    words = [str(i % 777) for i in range(50_000)]
    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([" ".join(words)])})
    (row,) = next(iter(periodic._found(12)(iter([batch])))).to_pylist()
    assert [tuple(r.values()) for r in row["runs"]] == [(0, 50_000, 777)]


def test_odd_documents(spark):
    docs = H.odd(spark)
    want = sorted(((r.doc_id, brute((r.text or "").split()), left((r.text or "").split(), brute((r.text or "").split())))
                   if r.doc_id != 5 else (5, [(0, 20_000, 1)], "wort")
                   for r in docs.collect()), key=repr)
    for frame in (docs, H.clashing(docs)):
        got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame).collect()), key=repr)
        assert got == want
    assert periodic_runs(docs.where("false")).collect() == []


def test_query(spark):
    """The whole table: tenth of the documents looped, digests built from plain Python."""
    want = []
    for r in spark.read.parquet(f"{H.SMALL}/documents.parquet").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((
            r.doc_id, len(runs), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left(words, runs).encode()).hexdigest()))
    got = queries.op12_periodic_runs(spark, H.SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
