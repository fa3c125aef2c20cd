"""Text, money and time queries over documents and catalog names."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import copy as Y
from shelfspark.functions import money as M
from shelfspark.functions import text as S
from shelfspark.functions.timefn import parse_timestamp
from shelfspark.operators.matching import name_queries
from shelfspark.plans.attribute_queries import mk
from shelfspark.plans.registry import query
from shelfspark.plans.views import VIEWS

VIEWS["names_v"] = """
    SELECT p_partkey AS product_id, CASE p_partkey % 6 WHEN 0 THEN '  Ψυγείο ' || p_name || ' Λευκό  ΚΑΛΟΣ ' WHEN 1 THEN p_name || ' & Größe, ' || cast(p_size AS string)
             WHEN 2 THEN 'Kokkino ' || p_name || ' me 12x30 abcd1' WHEN 3 THEN 'Watts ' || p_name || '&nbsp;50w' WHEN 4 THEN p_name || ' airclean 12345 hx1' ELSE p_name END AS name,
           p_brand AS brand, p_size AS size, CASE p_size % 5 WHEN 0 THEN '-' WHEN 1 THEN ' — ' WHEN 2 THEN '' ELSE p_name END AS spec
    FROM {part}"""
VIEWS["prices_v"] = """
    SELECT p_partkey AS product_id, p_size AS n, CASE p_size % 8 WHEN 0 THEN cast(p_size AS string) || ',50 €' WHEN 1 THEN '1.' || cast(100 + p_size AS string) || ',00'
             WHEN 2 THEN cast(p_size AS string) || '.99' WHEN 3 THEN '+5' WHEN 4 THEN 'EUR ' || cast(p_size AS string) WHEN 5 THEN '' WHEN 6 THEN '1e2' ELSE '-' || cast(p_size AS string) END AS price
    FROM {part}"""

_TR = "replace(replace(replace(translate({x}, 'αβγδεζηικλμνξοπρσςτυφω', 'avgdeziiklmnxoprsstyfo'), 'θ', 'th'), 'χ', 'ch'), 'ψ', 'ps')"


def key_sql(x: str) -> str:
    """DuckDB text of the product text key."""
    low = f"replace(lower(strip_accents(trim(regexp_replace({x}, '\\s+', ' ', 'g')))), 'ß', 'ss')"
    return f"trim(regexp_replace({_TR.format(x=low)}, '[^a-z0-9_]+', ' ', 'g'))"


_TOKENS = f"""t AS (SELECT product_id, name, list_filter(list_transform(list_filter(string_split({key_sql('name')}, ' '), lambda w: w <> ''),
        lambda w: CASE w WHEN 'kokkino' THEN 'red' WHEN 'leyko' THEN 'white' ELSE w END), lambda w: len(w) >= 2 AND NOT list_contains(['me', 'se', 'kai'], w)) AS tokens FROM names_v)"""


@query("FN1_collapse_spaces", "SELECT product_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS collapsed, trim(regexp_replace(replace(name, '&nbsp;', ' '), '\\s+', ' ', 'g')) AS normalized FROM names_v")
def _(v):
    return v.names_v.select(
        "product_id", S.collapse_spaces(F.col("name")).alias("collapsed"), S.normalize_spaces(F.col("name")).alias("normalized")
    )


@query("FN2_mpn_key", "SELECT product_id, replace(replace(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), 'ς', 'σ'), 'ß', 'ss') AS key FROM names_v")
def _(v):
    return v.names_v.select("product_id", S.mpn_key(F.col("name")).alias("key"))


@query("FN3_product_text_key", f"SELECT product_id, {key_sql('name')} AS key FROM names_v")
def _(v):
    return v.names_v.select("product_id", S.product_text_key(F.col("name")).alias("key"))


@query("FN4_product_tokens", "WITH " + _TOKENS + "SELECT product_id, array_to_string(tokens, '|') AS tokens FROM t")
def _(v):
    return v.names_v.select("product_id", S.product_tokens(F.col("name")).alias("tokens"))


@query(
    "FN5_search_queries",
    "WITH " + _TOKENS + """, b AS (SELECT product_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS raw, list_filter(tokens, lambda w: w <> 'airclean' AND NOT regexp_matches(w, '^([0-9]{5,}|[0-9]+(x[0-9]+)+|[0-9]+(w|v|l|lt))$')) AS broad FROM t),
       q AS (SELECT product_id, raw, 'P ' || array_to_string(list_filter(broad, lambda w: w = 'hx1' OR NOT regexp_matches(w, '^[a-z]{4,}[0-9]+[a-z0-9]*$')), ' ') AS c, 'P ' || array_to_string(broad, ' ') AS w FROM b),
       a AS (SELECT product_id, CASE WHEN c = w THEN [raw, c] ELSE [raw, c, w] END AS qs FROM q)
       SELECT product_id, i - 1 AS query_no, qs[i] AS query FROM (SELECT product_id, qs, unnest(generate_series(1, len(qs))) AS i FROM a)""",
)
def _(v):
    return name_queries(v.names_v, "P")


@query("FN25_match_key", f"SELECT product_id, {mk('brand')} AS key, lower(strip_accents('Ψυγείο')) AS greek FROM names_v")
def _(v):
    return v.names_v.select("product_id", S.match_key(F.col("brand")).alias("key"), S.match_key(F.lit(" Ψυγείο!")).alias("greek"))


@query("FN25_label_equivalence", "SELECT product_id, size % 2 = 0 AS same FROM names_v")
def _(v):
    other = F.when(F.col("size") % 2 == 0, F.concat(F.upper("brand"), F.lit(": 5 X 6"))).otherwise("none")
    return v.names_v.select("product_id", S.labels_equivalent(F.concat("brand", F.lit(" 5 6")), other).alias("same"))


@query("FN28_null_dashes", "SELECT product_id, CASE WHEN trim(spec) NOT IN ('', '-', '—') THEN spec END AS spec FROM names_v")
def _(v):
    return v.names_v.select("product_id", S.null_dashes(F.col("spec")).alias("spec"))


@query("FN29_breadcrumbs", "SELECT product_id, 'Home|' || brand || '|Home' AS crumbs FROM names_v")
def _(v):
    crumbs = F.array(F.lit("Home"), F.lit(" "), F.lit("Home "), "brand", F.lit("Home"))
    return v.names_v.select("product_id", S.clean_breadcrumbs(crumbs).alias("crumbs"))


_SLUG = "trim(regexp_replace(" + _TR.format(x="replace(regexp_replace(lower(strip_accents(trim(replace(name, '&nbsp;', ' ')))), '([0-9])[.,]([0-9])', '\\1\\2', 'g'), 'ου', 'ou')") + ", '[^a-z0-9]+', '-', 'g'), '-')"


@query("FN21_seo_slug", f"SELECT product_id, {_SLUG} AS slug, CASE WHEN regexp_matches({_SLUG}, '[0-9]') THEN {_SLUG} ELSE {_SLUG} || '-abc' END AS keyword FROM names_v")
def _(v):
    return v.names_v.select(
        "product_id", S.seo_slug(F.col("name")).alias("slug"), S.seo_keyword(F.col("name"), F.lit("abc")).alias("keyword")
    )


@query("FN22_keyword_from_parts", f"SELECT product_id, {mk('brand')} AS b, CASE WHEN size % 2 = 0 THEN 'one-' || repeat('x', 90) ELSE 'one-two' END AS keyword, true AS valid FROM names_v")
def _(v):
    parts = F.array(F.lit("One"), F.lit(" one"), F.when(F.col("size") % 2 == 0, F.repeat(F.lit("x"), 90)).otherwise("two"), F.when(F.col("size") % 2 == 0, "extra tail"))
    key = S.seo_keyword_from_parts(F.filter(parts, lambda p: p.isNotNull()))
    return v.names_v.select("product_id", S.match_key(F.col("brand")).alias("b"), key.alias("keyword"), S.valid_seo_keyword(key).alias("valid"))


@query(
    "FN23_meta_title",
    """SELECT product_id, brand || CASE WHEN size % 2 = 0 THEN ' keep' ELSE '' END || ' M' || size || ' | Shop' AS title, 'pass' AS status FROM names_v""",
)
def _(v):
    s = lambda value, required, priority: F.struct(value.alias("value"), F.lit(required).alias("required"), F.lit(priority).alias("priority"))
    filler = F.when(F.col("size") % 2 == 0, F.lit("keep")).otherwise(F.repeat(F.lit("y"), 70))
    parts = F.array(s(F.col("brand"), True, 0), s(filler, False, 1), s(F.repeat(F.lit("z"), 60), False, 2), s(F.concat(F.lit("M"), "size"), True, 0), s(F.upper("brand"), False, 3))
    title = S.meta_title(parts, " | Shop")
    return v.names_v.select("product_id", title.alias("title"), S.meta_title_status(title).alias("status"))


@query("FN24_meta_keywords", "SELECT product_id, brand || '|M' || size || '|ψυγείο|gears' AS keywords FROM names_v")
def _(v):
    values = F.array(F.lit("ψυγείο"), F.lit("ψυγεία"), F.lit("gears"), F.lit("gear"), F.lower("brand"))
    return v.names_v.select("product_id", S.meta_keywords(values, F.col("brand"), F.concat(F.lit("M"), "size")).alias("keywords"))


@query(
    "FN26_mojibake_repair",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Ψυγείο ' || lang WHEN 1 THEN 'αβγ ' || lang WHEN 2 THEN 'Γάλα ' || lang WHEN 3 THEN 'Ξ± ' || lang ELSE lang END AS repaired
       FROM documents""",
)
def _(v):
    # What a wrong code page makes of Greek words, clean Greek, and a single damaged letter.
    shown = {0: "Ξ¨Ο…Ξ³ΞµΞ―ΞΏ ", 1: "Ξ±Ξ²Ξ³ ", 2: "Γάλα ", 3: "Ξ± "}
    kind = F.col("doc_id") % 5
    text = F.concat(F.coalesce(*[F.when(kind == k, t) for k, t in shown.items()], F.lit("")), "lang")
    return v.documents.select("doc_id", Y.repair_mojibake(text).alias("repaired"))


# Endings that carry an encoding fault or look like one; the oracle knows them by number only.
_ENDINGS = ["", " Γάλα φρέσκο", " ΜΑΓΕΙΡΙΚΗ ΓΩΝΙΑ Γ", " Γƒx", " Γ‚ ", " Γ\u008f.", " ΓΆβ‚¬™", " \ufffd", " ???", " Γƒ"]


@query(
    "FN27_text_issues",
    """SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 10 = 7 THEN 'replacement_character' END, CASE WHEN doc_id % 10 = 5 THEN 'c1_control_character' END,
          CASE WHEN doc_id % 10 IN (3, 4, 5, 6) THEN 'mojibake_pattern' END,
          CASE WHEN (doc_id % 10 = 8 OR contains(text, '???')) AND NOT contains(text, 'http') THEN 'question_mark_run' END) AS issues FROM documents""",
)
def _(v):
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return v.documents.select("doc_id", S.text_issues(F.concat("text", ending)).alias("issues"))


@query("FN20_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(v):
    return v.documents.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))


@query(
    "FN41_label_value_pairs",
    "SELECT product_id, 'Color' AS label, 'red' AS value FROM names_v UNION ALL SELECT product_id, 'Weight', size || ' kg' FROM names_v",
)
def _(v):
    text = F.concat(F.lit("Color: red. Model: X. Weight: "), "size", F.lit(" kg; COLOR: Red. 12: 5. Note: -"))
    rows = v.names_v.select("product_id", F.explode(Y.label_value_pairs(text)).alias("p"))
    return rows.select("product_id", "p.label", "p.value")


_METRICS = r"""t AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&euro;', '€'), '&amp;', '&'),
             '(?i)(?:https?://|www[.])\S+', ' ', 'g'), '[\s ]+', ' ', 'g')) AS t FROM documents),
       w AS (SELECT doc_id, text, t, list_filter(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda x: regexp_matches(x, '\p{L}')) AS w, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS l FROM t)"""


@query("FN42_text_metrics", "WITH " + _METRICS + "SELECT doc_id, len(w) AS words, l AS letters, length(t) AS chars FROM w")
def _(v):
    m = v.documents.select("doc_id", Y.text_counts(F.col("text")).alias("m"))
    return m.select("doc_id", "m.words", "m.letters", "m.chars")


@query(
    "FN42_section_class",
    "WITH " + _METRICS + r""", r AS (SELECT *, string_split(lower(trim(regexp_replace(text, '[\s ]+', ' ', 'g'))), ' ') AS raw FROM w),
       f AS (SELECT *, len(list_filter(range(1, greatest(1, len(raw) - 2)), lambda i: regexp_full_match(raw[i], '\p{L}{2,}') AND raw[i] = raw[i + 1] AND raw[i] = raw[i + 2] AND raw[i] = raw[i + 3])) > 0 AS again FROM r),
       q AS (SELECT *, CASE WHEN text = '' OR len(w) < 6 OR l < 30 THEN 'missing_empty_after_clean'
              WHEN round(l / length(t), 4) < 0.55 OR round(len(list_distinct(list_transform(w, lambda x: lower(strip_accents(x))))) / len(w), 4) < 0.45 OR again THEN 'weak_noisy_body'
              WHEN len(w) >= 25 AND l >= 120 THEN 'usable_clean' ELSE 'weak_short_body' END AS reason FROM f)
       SELECT doc_id, split_part(reason, '_', 1) AS quality, reason FROM q""",
)
def _(v):
    body = S.normalize_spaces(F.col("text"))
    rows = v.documents.withColumn("m", Y.text_metrics(F.col("text")))
    made = Y.section_class(F.col("lang"), body, F.lit(""), F.lit(""), F.col("m"))
    return rows.select("doc_id", made["quality"].alias("quality"), made["reason"].alias("reason"))


@query(
    "FN43_phrase_count",
    r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+'), lambda w: w = 'the')) AS uses FROM documents",
)
def _(v):
    return v.documents.select("doc_id", Y.phrase_count(F.col("text"), F.lit("The")).alias("uses"))


@query(
    "FN43_copy_lint",
    """SELECT product_id, CASE WHEN size % 2 = 0 THEN 'authoring_duplicate_prose_subject|authoring_duplicate_category|authoring_duplicate_identifier_phrase' ELSE '' END AS flags FROM names_v""",
)
def _(v):
    odd = F.concat(F.lit("The gadget is a big box. Code m1 here."))
    even = F.concat(F.lit("The gadget box and the Gadget box: m1 or M1. Fine."))
    text = F.when(F.col("size") % 2 == 0, even).otherwise(odd)
    return v.names_v.select("product_id", Y.lint_flags(text, F.lit("gadget"), F.lit("box"), F.array(F.lit("m1"), F.lit(""))).alias("flags"))


@query(
    "FN43_repeated_phrases",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(strip_accents(text || CASE WHEN doc_id % 4 = 0 THEN ' Copper kettle stands near copper KETTLE' ELSE '' END)), 'ß', 'ss'),
                                                     '[\p{L}\p{N}]+') AS w FROM documents),
            p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t),
            g AS (SELECT doc_id, i, n, w[i : i + n - 1] AS run FROM p, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE i + n - 1 <= len(w)),
            k AS (SELECT doc_id, i, n, array_to_string(run, ' ') AS phrase FROM g
                  WHERE len(list_distinct(list_filter(run, lambda x: x NOT IN ('with', 'that', 'this') AND (length(x) > 3 OR regexp_matches(x, '[0-9]'))))) >= 2),
            f AS (SELECT *, min(i) OVER (PARTITION BY doc_id, phrase) AS first FROM k),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i, phrase DESC) AS place FROM f WHERE i > first AND i - first <= 10)
       SELECT doc_id, phrase FROM r WHERE place = 1""",
)
def _(v):
    ending = F.when(F.col("doc_id") % 4 == 0, " Copper kettle stands near copper KETTLE").otherwise("")
    return Y.repeated_phrases(v.documents.withColumn("text", F.concat("text", ending)), "doc_id", "text", ["with", "that", "this"])


@query(
    "FN51_copy_validation",
    r"""WITH w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '&nbsp;', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s ]+'), lambda x: x <> '')) AS n FROM documents)
       SELECT doc_id, n < 60 OR n > 180 AS bad_count FROM w""",
)
def _(v):
    errors = Y.intro_errors(F.col("text"))
    return v.documents.select("doc_id", F.array_contains(errors, "intro_text_word_count_invalid").alias("bad_count"))


@query("FN44_unsupported_numbers", "SELECT product_id, CASE WHEN size = 12 THEN '' ELSE size::varchar END AS numbers FROM names_v")
def _(v):
    from shelfspark.operators.quality import unsupported_numbers

    text = F.concat(F.lit("It has "), "size", F.lit(" parts, 12 in all, 2,5 kg"))
    return v.names_v.select("product_id", unsupported_numbers(text, F.lit("12 and 2.5")).alias("numbers"))


# ----------------------------------------------------------------------- money
@query(
    "FN8_greek_money",
    """SELECT product_id, CASE n % 8 WHEN 0 THEN n + 0.5 WHEN 1 THEN 1100 + n WHEN 4 THEN n END::double AS amount FROM prices_v""",
)
def _(v):
    return v.prices_v.select("product_id", M.greek_money(F.col("price")).alias("amount"))


@query("FN9_dot_decimal", "SELECT product_id, CASE n % 8 WHEN 2 THEN n + 0.99 END::double AS amount FROM prices_v WHERE n % 8 <> 1 UNION ALL SELECT product_id, NULL FROM prices_v WHERE n % 8 = 1")
def _(v):
    return v.prices_v.select("product_id", M.dot_decimal(F.col("price")).alias("amount"))


@query(
    "FN10_lenient_decimal",
    "SELECT product_id, CASE n % 8 WHEN 0 THEN n + 0.5 WHEN 2 THEN n + 0.99 WHEN 3 THEN 5 WHEN 4 THEN n WHEN 6 THEN 100 WHEN 7 THEN -n END::double AS amount FROM prices_v",
)
def _(v):
    return v.prices_v.select("product_id", M.lenient_decimal(F.col("price")).alias("amount"))


@query(
    "FN11_last_euro_price",
    "SELECT product_id, CASE n % 8 WHEN 0 THEN n + 0.5 WHEN 1 THEN 1100 + n WHEN 2 THEN n + 0.99 WHEN 3 THEN 5 WHEN 4 THEN n WHEN 5 THEN 12 WHEN 6 THEN 2 ELSE n END::double AS amount FROM prices_v",
)
def _(v):
    return v.prices_v.select("product_id", M.last_euro_price(F.concat(F.lit("was 12 now "), "price")).alias("amount"))


@query(
    "FN12_lenient_number",
    """SELECT product_id, try_cast(replace(price, ',', '.') AS double) AS number, cast(trunc(try_cast(replace(price, ',', '.') AS double)) AS bigint) AS whole FROM prices_v""",
)
def _(v):
    return v.prices_v.select("product_id", M.lenient_double(F.col("price")).alias("number"), M.lenient_int(F.col("price")).alias("whole"))


@query("FN50_money_text", "SELECT p_partkey AS product_id, printf('%.2f', p_retailprice) AS money, p_size || '.13' AS half_up, p_size || '.12' AS half_even FROM part")
def _(v):
    half = (F.col("p_size").cast(M.WIDE) + F.lit("0.125").cast(M.WIDE))
    return v.part.select(
        F.col("p_partkey").alias("product_id"), M.money_text(F.col("p_retailprice")).alias("money"), M.money_text(half).alias("half_up"),
        F.bround(half, 2).cast(M.MONEY).cast("string").alias("half_even"),
    )


@query(
    "FN45_timestamp_parse",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events""",
)
def _(v):
    text = (
        F.when(F.col("event_type") == "view", "soon").when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return v.events.select("event_id", F.date_format(parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))
