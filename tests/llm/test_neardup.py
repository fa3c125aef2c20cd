import random

import numpy as np

from shelfspark.llm import neardup as N

from . import helpers as H


def brute(docs, words, percent):
    """Components by comparing every pair of word-shingle sets."""
    sets = {}
    for i, text in docs:
        parts = (text or "").encode().lower().split()
        width = min(words, len(parts))
        sets[i] = {tuple(parts[a: a + width]) for a in range(len(parts) - width + 1)} if parts else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=0):
    """Groups of copies and near copies, chains, short texts and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (1, 1, 2, 5, 40):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        texts += [" ".join(base)] * 2
        for _ in range(size):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    chain = rng.choices(vocabulary, k=60)
    for step in range(12):  # each text resembles the one before, the ends do not
        chain = chain[2:] + rng.choices(vocabulary, k=2)
        texts.append(" ".join(chain))
    texts += ["a b c", "A B C", "a b", "a  b", "a b c d", "", " ", "a b c d e f g h", "a b c d e f g h i"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_all_pairs(spark):
    docs = corpus()
    for words, percent in ((3, 85), (5, 80)):
        found = N.near_duplicates(H.table(spark, docs), words, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, words, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_short_bands_make_mixed_buckets(spark):
    docs = corpus(1)
    found = N.near_duplicates(H.table(spark, docs), 3, 85, bands=60, rows=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, 3, 85)


def test_copies_too_far_from_their_original(spark):
    # Edits, deletions and copies of copies around one text, most pairs near the threshold.
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(80)], []
    for _ in range(150):
        text = list(rng.choice([base, *[t for t in texts[-5:]]]))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            if rng.random() < 0.4:
                del text[at]
            else:
                text[at] = f"x{rng.randrange(60)}"
        texts.append(text)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for percent in (85, 70):
        found = N.near_duplicates(H.table(spark, docs), 3, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, 3, percent)


def test_centres_without_edges_do_not_end_the_rounds(spark):
    # One bucket; more than FAN members of low id share the linked pair's only early shingle, too late to count.
    pool = sorted((f"w{i}" for i in range(8000)), key=lambda w: int(N.shingles(w, 1)[0]))
    at = 2000
    below, above, shared = iter(pool[1:at]), iter(pool[at + 1:]), pool[at]
    take = lambda words, n: [next(words) for _ in range(n)]
    base = [pool[0], *take(above, 29)]
    texts = [base + take(above, 70)]
    texts += [base + take(below, 15) + [shared] + take(above, 54) for _ in range(N.FAN + 8)]
    tail = take(above, 58)
    texts += [base + take(below, 11) + [shared] + tail for _ in range(2)]
    docs = [(i, " ".join(words)) for i, words in enumerate(texts)]
    found = N.near_duplicates(H.table(spark, docs), 1, 80, bands=1, rows=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, 1, 80)
    assert [r.doc_id for r in found if not r.kept] == [len(docs) - 1]


def test_a_linked_set_shares_an_outside_element():
    rng = np.random.default_rng(3)
    for _ in range(500):
        one, two, three = (np.unique(rng.integers(0, 60, size=rng.integers(20, 60))).astype(np.uint64) for _ in "abc")
        three = np.unique(np.concatenate([one[: rng.integers(1, len(one) + 1)], three[:3]]))
        percent, both = 80, len(np.intersect1d(one, three))
        if 100 * both < percent * len(np.union1d(one, three)):
            continue
        (a, x, i), (b, y, j) = N.outside(one, two, percent), N.outside(three, two, percent)
        if (100 + percent) * min(a, b) >= percent * (len(one) + len(three)):
            continue  # what they share with the centre may be enough
        assert len(np.intersect1d(x[:i] if len(one) <= len(three) else x, y[:j] if len(three) <= len(one) else y))


def test_odd_documents(spark):
    docs = H.odd(spark)
    found = {r.doc_id: r for r in N.near_duplicates(H.clashing(docs)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert found[6].component_id == 1 and not found[6].kept and found[1].kept
    assert found[2].n_shingles == found[3].n_shingles == found[4].n_shingles == 0
    assert found[None].component_id is None and found[None].kept
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_keep_first_keeps_columns(spark):
    docs = H.clashing(H.odd(spark))
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8]


def test_signature_bins_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(0)
    for size in (20, 200, 2000):
        agree = []
        for _ in range(40):
            shared = rng.integers(0, 2**63, size=size * 9 // 10, dtype=np.uint64)
            one, two = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, size=size // 20, dtype=np.uint64)])) for _ in "ab")
            agree.append((N.signature(one << np.uint64(1), 352) == N.signature(two << np.uint64(1), 352)).mean())
        assert abs(np.mean(agree) - 0.9) < 0.03
