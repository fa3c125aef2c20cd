import hashlib
import math

import pytest
from pyspark.sql import functions as F

from shelfspark.llm.mixing import Target, blanks, exponent, mix

from . import helpers as H


def tokens(text):
    return (text or "").count(" ") + 1


def md5(*parts):
    return hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def brute(docs, a, budget, block):
    """The mix by sorting each source's documents in plain Python."""
    sums = {}
    for _, text, source in docs:
        sums[source] = sums.get(source, 0) + tokens(text)
    total = sum(sums.values())
    z = sum((t / total) ** a for t in sums.values())
    weight = {s: (t / total) ** a / z for s, t in sums.items()}
    size = budget or max(t / weight[s] for s, t in sums.items())
    quota = {s: max(1, math.ceil(weight[s] * size - 1e-6)) for s in sums}
    blocks = max(1, math.ceil(sum(quota.values()) / block))
    out = []
    for s in sums:
        start = 0
        for epoch in range((quota[s] - 1) // sums[s] + 1):
            own = sorted((md5("order", epoch, i, tokens(t)), i, tokens(t)) for i, t, source in docs if source == s)
            for key, i, n in own:
                if start < quota[s]:
                    out.append([start * blocks // quota[s], md5("block", epoch, i, n), key, i, s, n, epoch])
                start += n
    out.sort(key=lambda r: r[:3])
    seen, rows = {}, []
    for b, _, _, i, s, n, epoch in out:
        seen[b] = seen.get(b, 0) + 1
        rows.append((i, s, n, epoch, b, seen[b]))
    return rows


def corpus():
    docs = []
    for i in range(900):
        source = "hot" if i % 3 else f"s{i % 7}"
        docs.append((i, "w " * (i % 23), source))
    return docs


@pytest.mark.parametrize("budget", [None, 3000, 20_000])
def test_matches_plain_python(spark, budget):
    docs = corpus()
    frame = H.table(spark, [(i, t, "en", s) for i, t, s in docs])
    target = Target(repetition=2.0)
    named = frame.withColumn("tokens", blanks(F.col("text"))).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    a = exponent(named, target, budget)
    got = mix(frame, target, budget, block=500, bucket_rows=16)
    assert H.rows(got) == sorted(brute(docs, a, budget, 500), key=repr)


def test_without_budget_nothing_is_left_out(spark):
    docs = corpus()
    frame = H.table(spark, [(i, t, "en", s) for i, t, s in docs])
    got = mix(frame, Target(repetition=2.0), block=500, bucket_rows=16).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in docs}
    assert max(r.epoch for r in got) <= 1


def shares(spark, tokens_of):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(tokens_of)], "source string, tokens bigint")


def entropy(tokens_of, a):
    p = [(t / sum(tokens_of)) ** a for t in tokens_of]
    return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)


def test_exponent_meets_its_target(spark):
    tokens_of = [1000, 300, 50, 5]
    a = exponent(shares(spark, tokens_of), Target(entropy=0.8))
    assert entropy(tokens_of, a) == pytest.approx(0.8 * math.log(4), abs=1e-6)
    assert exponent(shares(spark, tokens_of), Target(entropy=0.1)) > 0.999
    a = exponent(shares(spark, tokens_of), Target(repetition=3.0))
    assert (1000 / 5) ** (1 - a) == pytest.approx(3.0, abs=1e-6)
    a = exponent(shares(spark, tokens_of), Target(repetition=2.0), budget=1355)
    p = [(t / 1355) ** a for t in tokens_of]
    assert max(x / sum(p) * 1355 / t for x, t in zip(p, tokens_of)) == pytest.approx(2.0, abs=1e-6)
    assert exponent(shares(spark, []), Target(entropy=0.5)) == 1.0


def test_blocks_hold_the_weights(spark):
    docs = [(i, "w " * 9, "en", "a" if i % 4 else "b") for i in range(4000)]
    got = mix(H.table(spark, docs), Target(entropy=1.0), budget=40_000, block=4000, bucket_rows=100).collect()
    for block in range(10):
        inside = [r for r in got if r.block == block]
        assert sorted(r.position for r in inside) == list(range(1, len(inside) + 1))
        share = sum(r.tokens for r in inside if r.source == "a") / sum(r.tokens for r in inside)
        assert share == pytest.approx(0.5, abs=0.02)


def test_odd_documents(spark):
    docs = H.clashing(H.odd(spark))
    got = mix(docs, Target(repetition=2.0), whole=True)
    assert sum(1 for r in got.collect() if r.epoch == 0) == docs.count()
    assert got.select("row.*").columns == docs.columns
    assert mix(docs.limit(0), Target(entropy=0.9)).count() == 0
    assert mix(docs.where("false"), Target(repetition=2.0), budget=100).count() == 0
