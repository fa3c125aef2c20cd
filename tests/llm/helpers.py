"""Small documents tables with everything that may come up."""

import public_tokenizers
from pyspark.sql import functions as F

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    """(doc_id, text[, lang, source]) rows as documents."""
    full = [(*r, *(("en", "s") [len(r) - 2:])) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], SCHEMA)


def odd(spark):
    """Null ids, texts and sources, empty and blank texts, a very long one, repeated rows."""
    return table(spark, [
        (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "en", None),
        (5, "wort " * 20_000, "de", "b"), (6, "one two three four five six", "en", "a"),
        (7, "😀 ﷽ <|endoftext|> ￿", None, "c"), (7, "😀 ﷽ <|endoftext|> ￿", None, "c"), (None, "a null id", "en", "a"),
        (8, "x", "es", "d"),
    ])


def clashing(docs):
    """The same rows with columns that operators use themselves."""
    extra = ["tokens", "bucket", "block", "position", "label", "score", "sequence_id", "key", "row", "name", "src", "count"]
    out = docs
    for name in extra:
        out = out.withColumn(name, F.lit(-1))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
