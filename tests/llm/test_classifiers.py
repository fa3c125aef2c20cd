import zlib

import numpy as np
import pytest

from shelfspark.llm import langid, quality
from shelfspark.llm.common import fold, fold_of

from . import helpers as H

SF = "/root/testdata/sf0.01"


def area(scores, marks):
    """Chance that a good text scores above a bad one."""
    good = [s for s, m in zip(scores, marks) if m]
    bad = [s for s, m in zip(scores, marks) if not m]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_fold_is_crc32_of_the_id(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, 17, 123456789, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", fold(F.col("doc_id"), 5).alias("f"))
    assert {r.doc_id: r.f for r in frame.collect()} == {i: fold_of(i, 5) for i in ids}
    assert fold_of(17, 3) == zlib.crc32(b"17") % 3


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [r for r in labels.collect() if fold_of(r.doc_id, 3) == 1]
    assert area([found[r.doc_id].score for r in held], [r.quality for r in held]) > 0.99
    good, bad = ([found[r.doc_id].predicted for r in held if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_quality_learns_nothing_from_held_out_rows(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_quality_of_odd_documents(spark):
    docs = H.odd(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, none)
    found = quality.score(H.clashing(docs), model).collect()
    assert len(found) == docs.count() and {r.score for r in found} == {0.5}
    strange = spark.createDataFrame([(1, None), (None, 1), (5, 7), (5, 0), (3, 1), (99, 0)], "doc_id bigint, quality int")
    quality.fit(docs, strange)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id bigint, quality int")
    texts = H.table(spark, [(i, ("fine words here " if i % 2 else "###!!! @@ ") * 30) for i in range(60)])
    model = quality.fit(texts, labels)
    found = {r.doc_id: r.predicted for r in quality.score(texts, model).collect()}
    assert found == {i: i % 2 for i in range(60)}
    kept = quality.keep_good(H.clashing(texts), model)
    assert kept.columns == H.clashing(texts).columns and kept.count() == 30
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_dictionaries_hold_the_whole_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    texts = H.table(spark, [(i, f"only{i}here") for i in range(12)])
    model = quality.fit(texts, labels, folds=1, held_out=1)
    for i in range(12):
        assert f"only{i}here".encode() in (model.bad, model.good)[i % 2]


def test_compressed_size_difference_is_the_feature():
    model = quality.Model(b"bad bad words " * 50, b"good fine text " * 50, 1.0, 0.0)
    scorer = quality.Scorer(model)
    assert scorer.feature("good fine text good fine text") > 0 > scorer.feature("bad bad words bad bad words")
    assert scorer.feature("") == scorer.feature(None) == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    data, target = rng.integers(97, 100, size=(4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.gradients(data, target)
    for name, value in net.params.items():
        used = [i for i in np.ndindex(value.shape) if abs(grads[name][i]) > 1e-3][:6]
        for at in used:
            kept, sides = value[at], []
            for step in (1e-2, -1e-2):
                value[at] = kept + step
                sides.append(net.gradients(data, target)[0])
            value[at] = kept
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=0.1, abs=2e-3), (name, at)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, steps=500)).collect()}
    held = [r for r in docs.collect() if fold_of(r.doc_id, 3) == 1 and len(r.text) > 200]
    right = [found[r.doc_id].lang_pred == r.lang for r in held]
    assert sum(right) / len(right) > 0.97


def test_a_word_is_labelled_alike_in_any_batch():
    net = langid.Network(["a", "b"], hidden=4)
    words = [b"x", b"word", b"words", b"word" * 6, b"y"]
    together = net.label(words)
    for i, word in enumerate(words):
        assert net.label([word])[0] == pytest.approx(together[i], rel=1e-5)
    assert together.sum(axis=1) == pytest.approx([len(w) for w in words], rel=1e-5)
    assert b"".join(langid.words_of("a" * 100)) == b"a" * 100


def test_languages_of_odd_documents(spark):
    docs = H.odd(spark)
    network = langid.fit(docs, steps=5)
    found = {r.doc_id: r for r in langid.predict(H.clashing(docs), network).collect()}
    for i in (2, 3, 4):
        assert found[i].lang_pred == "und" and found[i].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[1].lang_pred in network.languages
    kept = langid.keep_known(H.clashing(docs), network)
    assert kept.columns == H.clashing(docs).columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert {r.doc_id for r in langid.keep_known(docs, empty).collect()} >= {1, 5, 6, 8}
    assert langid.predict(docs.limit(0), network).count() == 0


def test_two_networks_in_one_session_keep_apart(spark):
    """Workers are used again; each network still answers for itself, also where its address is taken again."""
    def data(one, two):
        return H.table(spark, [(i, " ".join(w * 3 for w in words), lang) for i in range(60)
                               for lang, words in [((one, ["abba", "acab", "baca"]), (two, ["xyzz", "zyxy", "yzxz"]))[i % 2]]])

    frames = {("xx", "yy"): data("xx", "yy"), ("pp", "qq"): data("pp", "qq")}
    for _ in range(3):
        for names, docs in frames.items():
            found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs, steps=60)).collect()}
            assert found == {i: names[i % 2] for i in range(60)}
            kept = langid.keep_known(docs, langid.fit(docs, steps=60), 0.4)
            assert kept.count() == 60


def test_language_sample_is_the_smallest_hashes_of_each_language(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, words, target, steps: seen.extend(words))
    docs = H.table(spark, [(i, f"w{i}x", "en" if i % 3 else "de") for i in range(900)])
    langid.fit(docs, sample=7)
    rows = docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    want = [r.doc_id for lang in ("en", "de") for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)[:7]]
    assert sorted(seen) == sorted(f"w{i}x".encode() for i in want)
