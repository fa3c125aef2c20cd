"""Registered queries of the operators, one per operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import (
    ann, brown, collocations, fingerprints, langid, mixing, neardup, packing, periodic, quality, repeats, tokencount, warc,
)
from shelfspark.llm.common import fold, table

# Production parameters of the mix: a source may repeat at most twice, no document is left out.
MIX_REPETITION = 2.0
MIX_BLOCK = 262_144


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempered mix of all documents: epoch, block and position of every document."""
    target = mixing.Target(repetition=MIX_REPETITION)
    return mixing.mix(table(spark, sf_dir, "documents"), target, block=MIX_BLOCK)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents into windows of 2048 tokens."""
    pieces = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locally consistent fingerprints of all texts and of their edited texts."""
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression scores of all documents, learnt outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted"
    )


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based bigram scores of all documents, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model, counts = brown.fit(docs)
    return brown.score(docs, model, counts).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of all pages: a full response each, and a later check that found it unchanged.

    The check spells the address differently; every seventh page's entity tag has changed
    by then, every fifth answer has none, every eleventh check comes before the response.
    """
    p = F.col("page_id")
    digest = F.md5("html")
    at = F.lit(1_700_000_000).cast("bigint") + p * 60
    later = at + F.when(p % 11 == 0, -3600).otherwise(86_400)
    etag = F.when(p % 5 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"')))
    full = pages.select(
        (2 * p).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), F.timestamp_seconds(at).alias("at"),
        etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("content-length"), F.length("html").cast("string"), F.lit("content-type"), F.lit("text/html"),
                     F.lit("date"), at.cast("string")).alias("headers"))
    check = pages.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), F.timestamp_seconds(later).alias("at"),
        F.when(p % 7 == 0, F.lit('"new"')).otherwise(etag).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        digest.alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"),
                     F.lit("expires"), F.lit("never")).alias("headers"))
    return full.unionByName(check)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified checks of all pages resolved against the latest earlier response."""
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "url_key", F.unix_timestamp("at").alias("at"), "status", "refers_to", "lag_seconds",
        warc.header_text(F.col("headers")).alias("headers"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 50-byte strings that an earlier one has."""
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def looped(docs: DataFrame) -> DataFrame:
    """The documents, every tenth (by the crc32 of its id) with the words from one place on repeating a few of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = docs.where(h % 10 == 0).select("doc_id", "text", h.alias("h"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    words = words.withColumn("n", F.greatest(F.size("w"), F.lit(1))).withColumn("g", F.floor(F.col("h") / 10))
    words = words.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    words = words.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.flatten(F.array_repeat(F.expr("slice(w, a + 1, p)"), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.expr("slice(w, 1, a)"), F.slice(turns, 1, F.col("n") - F.col("a"))), " ")
    return docs.where(h % 10 != 0).select("doc_id", "text").unionByName(words.select("doc_id", made.alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, a tenth of which are made periodic, and the texts without the repetitions."""
    found = periodic.periodic_runs(looped(table(spark, sf_dir, "documents")), least=12)
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS by_length, r.start, r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", F.expr("-best.by_length").alias("length"), "best.period",
        F.expr("-1000 * best.by_length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), support=30, percent=80, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_brown": op5_brown,
    "op6_language": op6_language,
    "op7_neighbours": op7_neighbours,
    "op8_near_dedup": op8_near_dedup,
    "op9_revisits": op9_revisits,
    "op10_token_counts": op10_token_counts,
    "op11_repeats": op11_repeats,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

# The exponent in closed form: the rarest source repeats twice, the most frequent once.
_MIX = f"""
WITH d AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS name,
           length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS tokens
    FROM documents),
s AS (SELECT name, cast(sum(tokens) AS BIGINT) AS t FROM d GROUP BY name),
e AS (SELECT max(t) AS top,
             CASE WHEN max(t) > {MIX_REPETITION} * min(t) THEN 1 - ln({MIX_REPETITION}) / ln(max(t) / min(t)) ELSE 0 END AS a
      FROM s),
q AS (SELECT name, t, greatest(1, cast(ceil(pow(t, a) * pow(top, 1 - a) - 1e-6) AS BIGINT)) AS quota FROM s, e),
b AS (SELECT greatest(1, cast(ceil(sum(quota) / {MIX_BLOCK}) AS BIGINT)) AS blocks FROM q),
r AS (SELECT d.*, t, quota, unnest(range(0, (quota - 1) // t + 1)) AS epoch FROM d JOIN q USING (name)),
k AS (SELECT *, epoch || '|' || coalesce(cast(doc_id AS VARCHAR), '') || '|' || tokens AS named FROM r),
c AS (SELECT *, epoch * t + sum(tokens) OVER (PARTITION BY name, epoch ORDER BY md5('order|' || named)
                                              ROWS UNBOUNDED PRECEDING) - tokens AS start FROM k),
p AS (SELECT *, cast(cast(start AS HUGEINT) * blocks // quota AS BIGINT) AS block FROM c, b WHERE start < quota)
SELECT doc_id, source, cast(tokens AS BIGINT) AS tokens, cast(epoch AS BIGINT) AS epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('block|' || named), md5('order|' || named)) AS position
FROM p"""

_NEAR = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
g AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
    SELECT a, b
    FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * common >= 85 * (na.n + nb.n - common)),
r AS (
    SELECT doc_id, doc_id AS reached FROM documents
    UNION
    SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, min(reached) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

_REVISITS = """
WITH u AS (
    SELECT page_id, md5(html) AS digest, length(html) AS size, 1700000000 + page_id * 60 AS seen,
           regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
    FROM pages),
h AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '') AS host,
           regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
                       lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^&]*|ref|gclid|fbclid)(=.*)?')) AS params
    FROM u),
c AS (
    SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
           CASE WHEN page_id % 5 <> 0 THEN '"' || substr(digest, 1, 12) || '"' END AS etag
    FROM h),
v AS (
    SELECT *, seen + CASE WHEN page_id % 11 = 0 THEN -3600 ELSE 86400 END AS later,
           CASE WHEN page_id % 7 = 0 THEN '"new"' ELSE etag END AS new_etag
    FROM c),
j AS (
    SELECT v.*, r.page_id AS to_page, r.seen AS to_seen, r.size AS to_size, coalesce(v.new_etag = r.etag, v.digest = r.digest) AS agrees,
           row_number() OVER (PARTITION BY v.page_id ORDER BY r.seen DESC NULLS LAST, r.page_id DESC) AS n
    FROM v LEFT JOIN c r ON r.url_key = v.url_key AND r.seen <= v.later)
SELECT 2 * page_id + 1 AS record_id, url_key, later AS "at",
       CASE WHEN to_page IS NULL THEN 'unmatched' WHEN agrees THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN agrees THEN 2 * to_page END AS refers_to, CASE WHEN agrees THEN later - to_seen END AS lag_seconds,
       'content-length: ' || CASE WHEN agrees THEN cast(to_size AS VARCHAR) || chr(10) || 'content-type: text/html' ELSE '0' END
           || chr(10) || 'date: ' || later || chr(10) || 'expires: never' AS headers
FROM j WHERE n = 1"""

_REPEATS = """
WITH b AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS p FROM b)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
d AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 AS goes_on FROM w JOIN f USING (s) WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM d),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, span),
k AS (
    SELECT b.doc_id, coalesce(a, n) AS a, coalesce(z, n) AS z, span,
           substring(h, 2 * coalesce(lag(z) OVER o, 0) + 1, 2 * (coalesce(a, n) - coalesce(lag(z) OVER o, 0))) AS before,
           CASE WHEN lead(z) OVER o IS NULL THEN substring(h, 2 * coalesce(z, n) + 1) ELSE '' END AS tail, n
    FROM b LEFT JOIN s ON s.doc_id = b.doc_id WINDOW o AS (PARTITION BY b.doc_id ORDER BY a))
SELECT doc_id, any_value(n)::BIGINT AS n_bytes, sum(z - a)::BIGINT AS n_removed, count(span) AS n_spans,
       sha256(unhex(string_agg(before || tail, '' ORDER BY a))) AS kept_sha256
FROM k GROUP BY doc_id"""

_COLLOCATIONS = """
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (
    SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) AS s(k) WHERE len(words) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase),
often AS MATERIALIZED (SELECT * FROM f WHERE a >= 30),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM often WHERE k > 1),
t AS MATERIALIZED (
    SELECT lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') AS head, array_to_string(words[cut + 1 :], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
cuts AS (
    SELECT t.lang, t.phrase, t.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * t.a // (x.a + y.a))::BIGINT AS score
    FROM t JOIN often x ON x.lang = t.lang AND x.phrase = head JOIN often y ON y.lang = t.lang AND y.phrase = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
    SELECT lang, a, array_to_string(words[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, a, words, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS s(m) WHERE m < k)),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY lang, phrase),
kept AS (
    SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase)
    WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000"""

# The other operators train models, tokenize or approximate: tested against brute force.
ORACLES: dict[str, str] = {"op1_mixing": _MIX, "op8_near_dedup": _NEAR, "op9_revisits": _REVISITS,
                           "op11_repeats": _REPEATS, "op13_collocations": _COLLOCATIONS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
