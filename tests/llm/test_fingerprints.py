import hashlib
import random

import numpy as np
import pytest

from shelfspark.llm import fingerprints as P

from . import helpers as H


def brute(docs):
    """n_chars and the hash of the edited text, by sorting all documents."""
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = []
    for n, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, after))
    return out


def as_numbers(text):
    return np.array([int(text[i: i + 8], 16) for i in range(0, len(text), 8)], dtype=np.uint32)


@pytest.mark.parametrize("rows", [3, 50, 10_000])
def test_against_all_documents_in_order(spark, rows):
    docs = spark.read.parquet(f"{H.SMALL}/documents.parquet")
    got = {r.doc_id: r for r in P.with_next(docs, range_rows=rows).collect()}
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(plain)
    assert len(got) == len(plain)
    for i, n, digest, edited, after in brute(plain):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        own, other, following = P.sketches([texts[i], edited, after])
        assert (r.fingerprint, r.edited_fingerprint) == (P.as_text(own), P.as_text(other))
        assert r.near_edited == P.likeness(as_numbers(r.fingerprint), as_numbers(r.edited_fingerprint))
        assert r.near_next == P.likeness(own, following)


def test_odd_documents(spark):
    docs = H.odd(spark)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i, n, d) for i, n, d, _, _ in brute(plain)), key=repr)
    for rows in (1, 100):
        got = P.with_next(H.clashing(docs), range_rows=rows)
        assert H.rows(got.select("doc_id", "n_chars", "edited_sha256")) == want
        assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got.collect())
    assert P.with_next(docs.limit(0)).count() == 0
    alone = P.with_next(H.table(spark, [(4, "abcdef")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    prints = {r.doc_id: r.fingerprint for r in P.fingerprints(docs).collect()}
    assert prints[1] == prints[6] and prints[2] == prints[3] == ""


def test_equal_substrings_share_their_phrases():
    rng = random.Random(0)
    middle = "".join(rng.choices("abcdefgh ", k=4000))
    one, two = ("".join(rng.choices("abcdefgh ", k=n)) for n in (37, 1501))
    a, b = (set(P.sketches([t], size=10_000)[0].tolist()) for t in (one + middle, two + middle))
    own = set(P.sketches([middle], size=10_000)[0].tolist())
    assert len(a & own) > 0.97 * len(own) and len(b & own) > 0.97 * len(own)


def test_likeness_is_near_the_share_of_phrases():
    rng = random.Random(2)
    for share in (0.3, 0.6, 0.9):
        text = "".join(rng.choices("abcdefgh ", k=20_000))
        other = text[: int(20_000 * share)] + "".join(rng.choices("abcdefgh ", k=int(20_000 * (1 - share))))
        a, b = P.sketches([text, other])
        assert P.likeness(a, b) == pytest.approx(share / (2 - share), abs=0.2)


def test_parse_does_not_depend_on_batches(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 3000))) for _ in range(20)] + ["a" * 5000, "ab" * 3000, "x"]
    alone = [P.sketches([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in P.sketches(texts)] == alone
    monkeypatch.setattr(P, "_CHUNK", 64)
    assert [s.tolist() for s in P.sketches(texts)] == alone
