import random

import pytest
from tokenizers import Tokenizer, decoders, models, normalizers

from shelfspark.llm.tokencount import Unigram, model, read_vocabulary, token_counts

from . import helpers as H


def library(vocabulary, byte_fallback=True):
    """The same vocabulary in the tokenizer library, with the blank mark before and between words."""
    tok = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    tok.decoder = decoders.ByteFallback()
    return tok


def test_same_counts_as_the_library(spark):
    tok = library(read_vocabulary(H.PIECES))
    docs = spark.read.parquet(f"{H.SMALL}/documents.parquet").unionByName(H.odd(spark))
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and "<|" not in r.text and len(r.text) < 50_000}
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, H.PIECES).collect()}
    for doc_id, text in texts.items():
        if 1 <= (doc_id or 0) <= 8:
            continue  # ids that both tables have
        assert got[doc_id] == len(tok.encode(text, add_special_tokens=False).ids), doc_id


@pytest.mark.parametrize("seed", range(4))
def test_ties_on_small_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {"<unk>": 0.0}
    for _ in range(40):
        pieces["".join(rng.choices("ab▁c", k=rng.randint(1, 4)))] = float(-rng.randint(1, 4))
    vocabulary = list(pieces.items())
    mine, tok = Unigram(vocabulary), library(vocabulary, byte_fallback=False)
    for _ in range(300):
        text = "".join(rng.choices("abc d", k=rng.randint(1, 14)))
        assert mine.count(text)[0] == len(tok.encode(text, add_special_tokens=False).ids), text


def test_units_split_where_the_whole_text_does():
    mine = model(H.PIECES)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("the of in  \n\né😀12,", k=rng.randint(1, 60)))
        whole = mine.best("▁" + text.replace(" ", "▁"))
        assert mine.count(text) == pytest.approx(whole)


def test_odd_documents(spark):
    docs = H.odd(spark)
    found = token_counts(H.clashing(docs), H.PIECES).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].n_tokens == by_id[3].n_tokens == 0 and by_id[2].score == 0
    assert by_id[7].n_byte_tokens > 0 and by_id[5].n_tokens >= 20_000
    assert token_counts(docs.limit(0), H.PIECES).count() == 0
