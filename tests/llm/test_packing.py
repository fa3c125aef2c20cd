import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfspark.llm.packing import Packer, Tokens, pack

from . import helpers as H


def check(pieces, docs, size=2048):
    """Every id in one piece, sequences gapless, short ones powers of two."""
    exact = Tokenizer.from_file(H.BPE)
    want = sorted(((i, tuple(exact.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in docs), key=repr)
    by_sequence, by_doc = {}, {}
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", p.ids)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    got = []
    for (doc_id, total), parts in by_doc.items():
        copies = []  # repeated rows are packed each, and may be cut differently
        for start, ids in sorted(parts):
            copy = next((c for c in copies if len(c) == start), None)
            if copy is None:
                assert start == 0
                copies.append(list(ids))
            else:
                copy += ids
        assert all(len(c) == total for c in copies)
        got += [(doc_id, tuple(c)) for c in copies]
    assert sorted(got, key=repr) == want


def test_odd_documents(spark):
    docs = H.odd(spark)
    check(pack(docs, H.BPE, H.RANKS).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_real_documents(spark):
    docs = spark.read.parquet(f"{H.SMALL}/documents.parquet")
    check(pack(docs, H.BPE, H.RANKS).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_extra_columns(spark):
    docs = H.odd(spark)
    assert pack(docs.limit(0), H.BPE).count() == 0
    assert pack(H.clashing(docs), H.BPE).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def brute_level(count, size, length):
    def total(after):
        return sum(v * v for v in after[1:size])

    best = None
    for level in range(size - length, -1, -1):
        if level and not count[level]:
            continue
        after = list(count)
        if level:
            after[level] -= 1
        after[level + length] += 1
        now = total(after)
        if best is None or now < best[0]:
            best = (now, level)
    return best[1]


@pytest.mark.parametrize("seed", range(3))
def test_level_is_the_least_sum_of_squares(seed):
    rng, size = random.Random(seed), 32
    packer = Packer(size)
    for i in range(400):
        length = rng.randint(1, size - 1)
        assert packer._level(length) == brute_level(list(packer.count), size, length)
        packer.add(i, np.arange(length, dtype="<u4"))


@pytest.mark.parametrize("lengths", [[17], [17, 19, 23], [3, 17], [1, 2, 30]])
def test_bounded_ids_keep_every_id_and_the_rule(lengths):
    """Windows that nothing fits into are poured together; every document is still placed by the rule."""
    size, packer, out, rng = 32, Packer(32, held_ids=0), [], random.Random(2)
    docs = [rng.choice(lengths) for _ in range(3000)]
    for i, length in enumerate(docs):
        level = brute_level(list(packer.count), size, length)
        assert packer._level(length) == level
        out += packer.add(i, np.full(length, i, dtype="<u4"))
        assert packer.held <= size * size and packer.held == sum(n * h for h, n in enumerate(packer.count.tolist()))
    out += packer.finish()
    got = {}
    for doc, start, length, ids, total, *_ in sorted(out):
        assert start == got.get(doc, 0) and set(struct.unpack(f"<{length}I", ids)) == {doc}
        got[doc] = start + length
    assert got == dict(enumerate(docs))
    windows = {}
    for p in out:
        windows.setdefault(p[5], []).append((p[6], p[2]))
    for spans in windows.values():
        assert sum(n for _, n in spans) == max(a + n for a, n in spans)
    assert sum(1 for v in windows.values() if sum(n for _, n in v) < size) <= 5


def test_fast_library_gives_the_same_ids():
    tokens, exact = Tokens(H.BPE, H.RANKS), Tokenizer.from_file(H.BPE)
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x250)]
    for _ in range(2000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 12)))
        assert tokens.ids(text) == exact.encode(text, add_special_tokens=False).ids, ascii(text)
    for c in letters:
        for text in (c, f"a{c}b", f"1{c} {c}'s", f" {c}\n{c}"):
            assert tokens.ids(text) == exact.encode(text, add_special_tokens=False).ids, ascii(text)
