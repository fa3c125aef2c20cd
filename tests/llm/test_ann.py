import numpy as np

from shelfspark.llm import ann

from . import helpers as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    """True neighbours by comparing everything, in double precision."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-float((x * v).sum()), i) for i, v in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_real_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want, got = brute(rows), as_dict(ann.neighbours(vectors, leaf=16))
    assert set(want) == set(got)
    found = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert found / sum(len(v) for v in want.values()) >= 0.9
    exact = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda n: (-n[1], n[0]))
        for i, s in near:
            assert s == (exact[q] * exact[i]).sum()


def test_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE", 32)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, size=6)) for i in range(200)]
    rows = [(i, [1, 0, 1, 0, 0, 0] if i % 3 == 0 else v) for i, v in rows]  # copies and ties
    vectors = frame(spark, rows)
    asked = ann._usable(vectors).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert as_dict(ann.exact_neighbours(vectors, asked)) == brute(rows)


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 2.0, 0.0] if i % 3 else [float(i % 5), 1.0, 1.0]) for i in range(300)]
    got, want = as_dict(ann.neighbours(frame(spark, rows), recall=1.0)), brute(rows)
    assert got == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (20, [0, 0]), (40, None), (60, [None, 1]), (80, [nan, 1]), (100, [inf, 1]), (1, [2, 1]), (2, [1, 1]),
            (2, [1, 1]), (None, [1, 1]), (120, [1, 2, 3]), (-20, [3, 3])]
    got = as_dict(ann.neighbours(H.clashing(frame(spark, rows)).drop("label")))
    assert got == {0: [(-20, 9.0), (1, 4.0), (2, 3.0)], -20: [(0, 9.0), (1, 9.0), (2, 6.0)]}
    assert ann.neighbours(frame(spark, rows).limit(0)).count() == 0
    assert ann.neighbours(frame(spark, [(0, [1, 1])])).count() == 0


def test_draws_lose_nothing_and_bound_the_lists(spark, monkeypatch):
    """Pieces far smaller than the table, so that several draws come before the search; copies, ties and long vectors."""
    monkeypatch.setattr(ann, "PIECE", 16)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * (1e8 if i % 7 == 0 else 1)).astype(np.float32)) for i in range(700)]
    rows = [(i, [1.0, 0, 0, 0, 0] if i % 5 == 0 else v) for i, v in rows]
    lists = []
    whole = ann._search
    monkeypatch.setattr(ann, "_search", lambda *a: lists.append(whole(*a)) or lists[-1])
    got = as_dict(ann.neighbours(frame(spark, rows), k=5, recall=1.0))
    assert got == brute(rows, k=5)
    assert len(lists) >= 4 and lists[-1].count() < 35 * 6 * 16  # not 6 for each of the 44 pieces
