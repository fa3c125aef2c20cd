"""The operators' queries: against DuckDB where SQL can say them, contracts where not; then the pipeline."""

import functools
import struct
import zlib

import duckdb
import pytest

import corpus_pipeline
from shelfspark.llm import brown, langid, packing, queries
from tools.check import norm

from . import helpers as H

COLUMNS = {
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_quality": "doc_id held_out score predicted",
    "op5_brown": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_language": "doc_id held_out lang_pred score",
    "op7_neighbours": "query_id rank vec_id score",
    "op10_token_counts": "doc_id n_tokens n_byte_tokens score",
}


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    """Held-out accuracy is tested elsewhere; here a little training is enough."""
    monkeypatch.setattr(langid, "fit", functools.partial(langid.fit, steps=150))
    monkeypatch.setattr(brown, "fit", functools.partial(brown.fit, units=500, endings=50, classes=8, rounds=2))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{H.SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, H.SMALL)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_table(spark, name):
    df = queries.queries()[name](spark, H.SMALL)
    assert df.columns == COLUMNS[name].split()
    key = "query_id" if name == "op7_neighbours" else "doc_id"
    source = "embeddings" if name == "op7_neighbours" else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{H.SMALL}/{source}.parquet").select(
        "vec_id" if name == "op7_neighbours" else "doc_id").collect()}
    if name == "op7_neighbours":
        ids = {i for i in ids if i % 20 == 0}
    assert {r[key] for r in df.select(key).collect()} == ids


def test_packing_digests(spark):
    tokens = packing.Tokens(H.BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{H.SMALL}/documents.parquet").collect()}
    for r in queries.op2_packing(spark, H.SMALL).collect():
        ids = (tokens.ids(texts[r.doc_id]) + [1])[r.start: r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{H.SMALL}/documents.parquet")
    total, step = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, H.SMALL)
        assert step.dtypes == docs.dtypes, name
        step = step.cache()
        if name in ("language", "quality"):
            assert 0.7 * total < step.count() <= total
    pieces = corpus_pipeline.STAGES[-1][1](spark, step, H.SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in step.select("doc_id").collect()}


def test_run_chains_the_stages(spark, monkeypatch):
    def less(spark, docs, sf_dir):
        assert sf_dir == H.SMALL
        return docs.where("doc_id % 2 = 0")

    def last(spark, docs, sf_dir):
        return docs.select((docs.doc_id + 1).alias("next"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("less", less), ("last", last)])
    found = {r.next for r in corpus_pipeline.run(spark, H.SMALL).collect()}
    assert found == {r.doc_id + 1 for r in spark.read.parquet(f"{H.SMALL}/documents.parquet").collect() if r.doc_id % 2 == 0}


def test_stages_on_odd_documents(spark):
    labels = f"{H.SMALL}"
    docs = H.clashing(H.odd(spark))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, labels)
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
            out.count()
