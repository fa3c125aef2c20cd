"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from shelfspark.llm import collocations as C

from . import helpers as H


def brute(docs, support, percent, most):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = {}
    often = {p: n for p, n in counts.items() if n >= support and len(p) > 2}
    for (lang, *words), a in often.items():
        def inside(longer):
            return any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))

        if any(lang == p[0] and len(p) - 1 > len(words) and inside(list(p[1:])) and 100 * n >= percent * a for p, n in often.items()):
            continue
        score, _, l, r = min(
            (2_000_000 * a // (counts[lang, *words[:k]] + counts[lang, *words[k:]]), k, counts[lang, *words[:k]], counts[lang, *words[k:]])
            for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, totals[lang], -s)
        for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1))


@pytest.mark.parametrize("shards,most", [(8, 2000), (3, 5), (1, None)])
def test_random_texts(spark, shards, most):
    rng = random.Random(shards)
    docs = []
    for _ in range(300):
        words = [rng.choice(["The", "the", "new", "york", "times", "é", "x\x1cy", "of", "und"]) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", "\x0b"])
                 for _ in range(rng.randint(0, 40))]
        docs.append((rng.choice(["en", "en", "en", "de", None]), "".join(words) or None))
    df = spark.createDataFrame([(lang, t, i) for i, (lang, t) in enumerate(docs)], "lang string, text string, doc_id int").repartition(11)
    got = C.collocations(df, support=12, most=most, shards=shards)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 12, 80, most)


def test_full_filters_lose_nothing(spark, monkeypatch):
    """Filters far too small let everything through, and the counts stay exact."""
    monkeypatch.setattr(C, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(C, "MOST_BITS", 1 << 16)
    rng = random.Random(2)
    docs = [("en", " ".join(f"w{int(rng.expovariate(1 / 300))}" for _ in range(400)) + " in other words") for _ in range(120)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == brute(docs, 30, 80, 2000)


def test_hot_phrase_in_one_partition(spark):
    """A phrase that only one shard holds is found."""
    docs = [("en", "as a matter of fact")] * 40 + [("en", f"w{i} v{i}") for i in range(2000)]
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == brute(docs, 30, 80, 2000)


def test_odd_documents(spark):
    docs = H.odd(spark)
    want = brute([(r.lang, r.text) for r in docs.collect()], 30, 80, 2000)
    for frame in (docs, H.clashing(docs).withColumn("phrase", docs.text).withColumn("n", docs.doc_id)):
        assert sorted(tuple(r) for r in C.collocations(frame).collect()) == want
    assert C.collocations(docs.where("false")).collect() == []
