import math
from collections import Counter

import numpy as np
import pytest

from shelfspark.llm import brown as B
from shelfspark.llm.common import fold_of

from . import helpers as H

SF = H.SMALL


def base(docs):
    """Contract's base scores in plain Python."""
    counts = Counter()
    for i, text in docs:
        if fold_of(i, 5) != 1:
            counts.update([*B.words_of(text), B.END])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in docs:
        words = [*B.words_of(text), B.END]
        logs = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[i] = (len(words), sum(counts[w] > 0 for w in words), n, logs)
    return out, counts


def class_score(words, model, counts):
    """The model's score token by token."""
    out, last = 0.0, model.classes[B.LAST]
    for w in [*words, B.END]:
        c = model.classes[model.unit(w)]
        out += model.step[last, c] + math.log10(counts[w] + 0.5) - model.emit[c]
        last = c
    return out


def test_scores_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, counts = B.fit(docs, units=300, endings=60, classes=8, rounds=4)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want, exact = base(plain)
    got = {r.doc_id: r for r in B.score(docs, model, counts).collect()}
    for i, text in plain:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3]
        assert r.base_score == pytest.approx(want[i][3], rel=1e-9)
        assert r.score == pytest.approx(class_score(B.words_of(text), model, exact), rel=1e-9)
    held = [i for i, _ in plain if fold_of(i, 5) == 1]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_probabilities_add_up(spark):
    docs = H.table(spark, [(i, f"a b c{i % 4} d. e{i % 9}") for i in range(60)])
    model, counts = B.fit(docs, units=6, endings=3, classes=4, rounds=3)
    assert (10**model.step).sum(axis=1) == pytest.approx(np.ones(4))
    texts = [(i, f"a b c{i % 4} d. e{i % 9}") for i in range(60)]
    _, exact = base(texts)
    assert sorted(n for w, n in exact.items() if w != B.END) == sorted(r.n for r in counts.collect())
    for c in range(4):
        inside = [n for w, n in exact.items() if model.classes[model.unit(w)] == c]
        assert (sum(inside) + 0.5 * len(inside) + 0.5) / 10**model.emit[c] == pytest.approx(1.0)


def likelihood(table):
    """Of the class sequence, up to what does not depend on the classes."""
    gain = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return gain(table) - gain(table.sum(axis=0)) - gain(table.sum(axis=1))


def test_best_class_is_the_best_of_all_moves():
    rng = np.random.default_rng(1)
    size, classes = 12, 4
    pairs = rng.integers(0, 6, size=(size, size)).astype(float)
    np.fill_diagonal(pairs, 0)
    of = rng.integers(1, classes, size=size)

    def table(of):
        out = np.zeros((classes, classes))
        for a in range(size):
            for b in range(size):
                out[of[a], of[b]] += pairs[a, b]
        return out

    for unit in range(size):
        near = np.zeros((1, 2, classes))
        for other in range(size):
            near[0, 0, of[other]] += pairs[unit, other]
            near[0, 1, of[other]] += pairs[other, unit]
        got = B.best_classes(np.array([unit]), near, of, table(of))[0]
        scores = []
        for c in range(1, classes):
            moved = of.copy()
            moved[unit] = c
            scores.append(likelihood(table(moved)))
        assert scores[got - 1] == pytest.approx(max(scores))


def test_exchange_raises_the_likelihood(spark):
    docs = H.table(spark, [(i, "der die das " * 5 if i % 2 else "the of and " * 5) for i in range(40)])
    scores = []
    for rounds in (0, 6):
        model, counts = B.fit(docs, units=10, endings=2, classes=4, rounds=rounds)
        scores.append(sum(r.score for r in B.score(docs, model, counts).collect()))
    assert scores[1] > scores[0]


def test_rounds_share_one_table_of_neighbours(spark, monkeypatch):
    """Neighbours are shuffled once, not in every round; classes and counts are those of plain sums."""
    rng = np.random.default_rng(3)
    size, classes, rounds = 30, 5, 6
    counts = rng.integers(0, 9, size=(size, size)) * (rng.random((size, size)) < 0.4)
    pairs = spark.createDataFrame(
        [(a, b, int(counts[a, b])) for a in range(size) for b in range(size) if counts[a, b]], "left int, right int, n bigint").repartition(3)
    written = []
    save = B.Scratch.save
    monkeypatch.setattr(B.Scratch, "save", lambda self, name, df: written.append(name) or save(self, name, df))
    monkeypatch.setattr(B, "HELD", 20)
    of, table = B.exchange(pairs, size, classes, rounds, rare=0)
    assert written == ["near"]

    def by_class(of):
        out = np.zeros((classes, classes))
        np.add.at(out, (of[:, None], of[None, :]), counts)
        return out

    want = 1 + np.arange(size) % (classes - 1)
    want[B.LAST] = 0
    for turn in range(rounds):
        units = np.array([u for u in range(size) if u % 2 == turn % 2 and u != B.LAST])
        near = np.zeros((len(units), 2, classes))
        for i, u in enumerate(units):
            np.add.at(near[i, 0], want, counts[u])
            np.add.at(near[i, 1], want, counts[:, u])
        moved = B.best_classes(units, near, want, by_class(want))
        want[units] = moved
    assert of.tolist() == want.tolist() and table.tolist() == by_class(want).tolist()


def test_odd_documents(spark):
    docs = H.odd(spark)
    model, counts = B.fit(docs, units=4, endings=2, classes=4, rounds=1)
    got = B.score(H.clashing(docs), model, counts).collect()
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want, exact = base(plain)
    assert len(got) == len(plain)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])
    assert next(r for r in got if r.doc_id == 2).n_tokens == 1
    empty, none = B.fit(docs.limit(0), units=4, endings=2, classes=4, rounds=1)
    assert {(r.n_known, r.train_tokens) for r in B.score(docs, empty, none).collect()} == {(0, 0)}
    assert B.score(docs.limit(0), model, counts).count() == 0


def test_endings_of_words():
    """Shapes of rare words: outer signs, letters, digits, other bytes, very short and empty cores."""
    import pyarrow as pa

    cases = ["walking", "talking,", "(singing)", "123", "45", "a-b", "ünder", "--", "x", "yx", "...q", "ing", "12ing", "baking."]
    tokens = B._Tokens(pa.array([" ".join(cases)]))
    shape = dict(zip(cases, tokens.endings(np.arange(len(cases))).tolist()))

    def plain(word):
        core = word.strip(".,;:!?*#$%&|\"'()[]-").encode()
        kind = "u" if core and max(core) > 127 else "a" if core.isalpha() else "d" if core.isdigit() else "x"
        return core[-2:], kind, core != word.encode()

    for a in cases:
        for b in cases:
            assert (shape[a] == shape[b]) == (plain(a) == plain(b)), (a, b)
