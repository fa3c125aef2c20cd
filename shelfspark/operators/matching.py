"""Candidate matching: page evidence, composite check, scores, run summaries, offers."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import html as H
from shelfspark.functions.common import bind, empty_texts
from shelfspark.functions.money import MONEY, WIDE, greek_money, landed_price, lenient_decimal, usable
from shelfspark.functions.text import (
    collapse_spaces, fold_case, product_text_key, product_tokens, search_queries,
    trim_text, words,
)
from shelfspark.functions.urls import (
    is_product_url, looks_like_product_path, normalize_url, page_rejection, url_host, url_path,
    without_query,
)
from shelfspark.operators.catalog import labels
from shelfspark.operators.skew import exact_rank, first_row, top_rows

# ---------------------------------------------------------------- fixed values
COMPOSITE_PHRASES = [
    "me esties", "me epagogikes", "me epagogikes esties", "me keramikes", "me keramikes esties",
    "foyrnos me esties", "fournos me esties", "mazi me",
]
BUNDLE_WORDS = ["set", "kit", "bundle", "combo", "syndyasmos", "paketo", "package"]
CONNECTOR_WORDS = ["kai", "and", "with", "me", "mazi"]
CODE_PATTERN = (
    "(?<![A-Za-z0-9])(?=[A-Za-z0-9]{5,})(?:[A-Za-z]*[0-9]){2,}[A-Za-z0-9]*(?![A-Za-z0-9])"
)
STATUS_ORDER = ["accepted", "needs_review", "pending", "rejected", "not_found", "error"]
KEEP_CONFIDENCE = 0.80

ANALYTICS_MARKERS = [
    "analytics", "gtm", "collect", "hotjar", "facebook", "doubleclick", "beacon", "zendesk",
    "zdassets", "sentry", "maps.googleapis.com",
]
PROMOTION_MARKERS = ["placements", "featured_cross_sell", "cross_sell", "sponsored"]
STATIC_EXTENSIONS = [
    ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".woff", ".woff2", ".ico",
]
OFFER_KEYS = ["price", "offer", "shop", "seller", "availability", "stock", "shipping", "merchant"]
REVIEW_KEYS = ["review", "rating", "ratings", "stars", "score"]
RECOMMENDATION_KEYS = ["recommend", "recommendation", "similar", "related"]
BLOCKED_WORDS = [
    "captcha", "cloudflare", "cf-chl", "just a moment", "challenge", "blocked", "access denied",
    "are you human",
]
LANDED_ATTRIBUTES = [
    "data-landed-price", "data-landedprice", "data-total-price", "data-totalprice",
    "data-final-total", "data-finaltotal", "data-final-price-with-shipping",
    "data-price-with-shipping", "data-total-with-shipping",
]


# ------------------------------------------------------------------ similarity
@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching characters in order, 0 to 1 (Ratcliff/Obershelp)."""
    for left, right in pairs:
        yield pd.Series(
            [
                None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()
                for a, b in zip(left, right)
            ],
            dtype="float64",
        )


def token_match(name: Column, title: Column) -> Column:
    """Tokens of a product name found in a title, and their share."""
    return bind(
        F.struct(product_tokens(name).alias("q"), product_tokens(title).alias("t")),
        lambda p: bind(
            F.filter(p["q"], lambda w: F.array_contains(p["t"], w)),
            lambda hit: F.struct(
                hit.alias("matched"),
                F.when(F.size(p["q"]) > 0, F.size(hit) / F.size(p["q"])).otherwise(F.lit(0.0)).alias("ratio"),
            ),
        ),
    )


def name_similarity(rows: DataFrame, name: str, title: str, out: str = "title_similarity") -> DataFrame:
    """0.75 token share + 0.25 sequence ratio; 0 below two shared tokens or on weak overlap.

    Only rows with two shared tokens reach Python.
    """
    key = lambda c: product_text_key(F.coalesce(F.col(c), F.lit("")))
    matched = rows.withColumn(
        "_m", token_match(F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(title), F.lit("")))
    )
    enough = F.size("_m.matched") >= 2
    ratio = sequence_ratio(F.when(enough, key(name)), F.when(enough, key(title)))
    scored = matched.withColumn("_r", ratio)
    weak = (F.col("_m.ratio") < 0.35) & (F.col("_r") < 0.55)
    score = F.bround(0.75 * F.col("_m.ratio") + 0.25 * F.col("_r"), 4)
    return scored.withColumns(
        {
            out: F.when(enough & ~weak, score).otherwise(F.lit(0.0)),
            f"{out}_tokens": F.when(enough & ~weak, F.col("_m.matched")).otherwise(empty_texts()),
        }
    ).drop("_m", "_r")


# ----------------------------------------------------------------- identifiers
def product_codes(text: Column) -> Column:
    """Product codes in a text: five or more characters, two digits and a letter at least."""
    def of_part(part: Column) -> Column:
        hyphens = F.filter(F.split(part, "-"), lambda h: h != "")
        short_pair = (F.size(hyphens) == 2) & F.forall(hyphens, lambda h: F.length(h) <= 4)
        joined = (
            F.when(short_pair, F.array(F.array_join(hyphens, "")))
            .when(F.size(hyphens) > 2, hyphens)
            .otherwise(empty_texts())
        )
        return F.concat(F.regexp_extract_all(part, F.lit(CODE_PATTERN), F.lit(0)), joined)

    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9][A-Za-z0-9_/-]*"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(raw, lambda r: F.split(r, "[/_]"))), lambda p: p != "")
    codes = F.transform(
        F.flatten(F.transform(parts, of_part)),
        lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")),
    )
    fits = lambda c: (F.length(c) >= 5) & c.rlike("[0-9].*[0-9]") & c.rlike("[A-Z]")
    return F.array_distinct(F.filter(codes, fits))


def split_unit_mpn(mpn: Column) -> Column:
    """``A/B-SUF`` read as ``A-SUF/B-SUF``; empty for any other form."""
    pattern = "^([A-Za-z0-9]+)/([A-Za-z0-9]+)-([A-Za-z0-9][A-Za-z0-9-]*)$"
    clean = collapse_spaces(F.coalesce(mpn, F.lit("")))
    return F.when(clean.rlike(pattern), F.regexp_replace(clean, pattern, "$1-$3/$2-$3")).otherwise("")


def identifier_variants(identifier: Column, is_air_conditioner: Column) -> Column:
    raw = collapse_spaces(F.coalesce(identifier, F.lit("")))
    other = F.when(is_air_conditioner, split_unit_mpn(raw)).otherwise("")
    return F.filter(
        F.array(raw, F.when(F.lower(other) != F.lower(raw), other).otherwise("")), lambda v: v != ""
    )


def identifier_fragment(identifier: Column, haystack: Column) -> Column:
    """Where an identifier stands in a text: bounded match first, else its bare letters and digits."""
    needle = collapse_spaces(F.coalesce(identifier, F.lit("")))
    escaped = F.regexp_replace(needle, "([^A-Za-z0-9 ])", "\\\\$1")
    body = F.replace(escaped, F.lit(" "), F.lit("\\s+"))
    pattern = F.concat(F.lit("(?iu)(?<![A-Za-z0-9])"), body, F.lit("(?![A-Za-z0-9])"))
    bare = lambda c: F.regexp_replace(fold_case(c), "(?U)[^\\p{L}\\p{N}]", "")
    loose = (
        (F.length(bare(needle)) >= 4) & needle.rlike("[0-9]") & F.contains(bare(haystack), bare(needle))
    )
    found = F.regexp_substr(haystack, pattern)
    return F.when(needle == "", "").otherwise(
        F.coalesce(found, F.when(loose, needle), F.lit(""))
    )


def first_evidence(variants: Column, haystacks: dict[str, Column]) -> Column:
    """Struct of the first (source, variant) in which an identifier is found."""
    def searched(source: str, haystack: Column) -> Column:
        return F.transform(
            variants,
            lambda v: F.struct(
                identifier_fragment(v, haystack).alias("fragment"),
                F.lit(source).alias("source"),
                v.alias("variant"),
            ),
        )

    hits = F.flatten(F.array(*[searched(s, h) for s, h in haystacks.items()]))
    return F.get(F.filter(hits, lambda h: h["fragment"] != ""), F.lit(0))


def url_words(*urls: Column) -> Column:
    """Words of hosts and paths, with and without their separators."""
    parts = []
    for url in urls:
        path = F.coalesce(F.try_url_decode(url_path(url)), url_path(url))
        parts += [F.replace(url_host(url), F.lit("."), F.lit(" ")), F.translate(path, "/-_", "   "), path]
    return collapse_spaces(F.concat_ws(" ", *parts))


def price_compatible(own: Column, candidate: Column) -> Column:
    """Is a seen price within 40 % of our own? NULL when either is unusable."""
    near = F.abs(candidate - own) <= own * F.lit(Decimal("0.40"))
    return F.when(usable(own) & usable(candidate), near)


def decimal_in_text(text: Column) -> Column:
    clean = collapse_spaces(text)
    return F.coalesce(greek_money(clean), lenient_decimal(clean))


# --------------------------------------------------------------- page evidence
def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence that a page shows a product, one row per page and product.

    Expects ``requested_url, html, mpn, model, manufacturer, name, category, own_price``;
    ``title`` and ``body_text`` replace what the page says (search results have no page).
    The whole visible text is searched.
    """
    for extra in ("title", "body_text"):
        if extra not in pages.columns:
            pages = pages.withColumn(extra, F.lit(""))
    for extra, value in (("evidence_source", "fetched_page"), ("is_air_conditioner", False)):
        if extra not in pages.columns:
            pages = pages.withColumn(extra, F.lit(value))
    read = pages.withColumns(
        {
            "title": F.when(H.clean_text(F.col("title")) != "", H.clean_text(F.col("title"))).otherwise(
                H.page_title(F.col("html"))
            ),
            "_meta": H.meta_description(F.col("html")),
            "_body": F.when(H.clean_text(F.col("body_text")) != "", H.clean_text(F.col("body_text"))).otherwise(
                H.visible_text(F.col("html"))
            ),
            "_items": H.product_items(H.jsonld_items(F.col("html"))),
            "canonical_url": F.coalesce(
                F.nullif(H.canonical_link(F.col("html")), F.lit("")), F.col("requested_url")
            ),
        }
    ).withColumns(
        {
            "_jsonld": H.jsonld_text(F.col("_items")),
            "_url": url_words(F.col("requested_url"), F.col("canonical_url")),
            "_rejected": page_rejection(F.col("requested_url"), F.col("canonical_url"), F.col("title")),
        }
    )
    stacks = {
        "jsonld": F.col("_jsonld"), "title": F.col("title"), "meta": F.col("_meta"),
        "body": F.col("_body"), "url": F.col("_url"),
    }
    variants = identifier_variants(
        F.coalesce(F.nullif(trim_text(F.col("mpn")), F.lit("")), F.col("model")), F.col("is_air_conditioner")
    )
    ids = read.withColumns(
        {
            "_mpn": F.when(trim_text(F.col("mpn")) != "", first_evidence(variants, stacks)),
            "_model": first_evidence(
                F.filter(F.array(trim_text(F.col("model"))), lambda m: m != ""), stacks
            ),
        }
    )
    plain = F.concat_ws("\n", "title", "_meta", "_body", "_jsonld")
    from_url = (F.col("_mpn.source") == "url") | (
        (trim_text(F.col("mpn")) == "") & (F.col("_model.source") == "url")
    )
    haystack = F.when(F.coalesce(from_url, F.lit(False)), F.concat_ws("\n", plain, F.col("_url"))).otherwise(plain)
    brand = H.clean_text(F.col("manufacturer"))
    brand_pattern = F.concat(
        F.lit("(?iuU)(?<!\\w)"), F.regexp_replace(brand, "([^\\p{L}\\p{N} ])", "\\\\$1"), F.lit("(?!\\w)")
    )
    price_text = F.coalesce(
        H.jsonld_price(F.col("_items")),
        F.nullif(F.regexp_extract(F.col("_body"), H.PRICE_IN_TEXT, 1), F.lit("")),
    )
    wanted = F.filter(
        product_tokens(F.concat_ws(" ", "category", F.array_join(
            F.transform("_items", lambda m: H.variant_text(m, "category")), " "))),
        lambda t: F.length(t) >= 4,
    )
    seen = product_tokens(F.concat_ws("\n", plain, F.col("_url")))
    category_hits = bind(
        F.struct(wanted.alias("w"), seen.alias("s")),
        lambda p: bind(
            F.filter(p["w"], lambda t: F.array_contains(p["s"], t)),
            lambda hit: (F.size(hit) >= 2) | ((F.size(hit) >= 1) & (F.size(p["w"]) <= 2)),
        ),
    )
    ok = F.col("_rejected") == ""
    out = ids.withColumns(
        {
            "candidate_price": decimal_in_text(price_text).cast(MONEY),
            "mpn_found": ok & F.col("_mpn").isNotNull(),
            "mpn_source": F.when(ok, F.coalesce("_mpn.source", F.lit(""))).otherwise(""),
            "mpn_fragment": F.when(ok, F.coalesce("_mpn.fragment", F.lit(""))).otherwise(""),
            "model_found": ok & F.col("_model").isNotNull(),
            "model_source": F.when(ok, F.coalesce("_model.source", F.lit(""))).otherwise(""),
            "brand_found": ok & (brand != "") & F.coalesce(F.regexp(haystack, brand_pattern), F.lit(False)),
            "category_compatible": ok & category_hits,
            "blocked": ok & F.concat_ws("\n", "title", "_body").rlike(H.BLOCKED_PAGE),
            "error_code": F.when(ok, "").otherwise("not_public_product_page"),
        }
    ).withColumn("price_compatible", F.when(ok, price_compatible(F.col("own_price"), F.col("candidate_price"))))
    compared = name_similarity(out, "name", "title")
    return compared.withColumn(
        "title_only", (F.col("title_similarity") >= 0.5) & ~F.col("mpn_found") & ~F.col("model_found")
    ).withColumn("evidence_text", plain)


def search_result_evidence(results: DataFrame) -> DataFrame:
    """Evidence from title, description and snippets of a search result only."""
    snippet = F.concat_ws(" ", "description", F.array_join("extra_snippets", " "))
    rows = results.withColumns(
        {
            "html": F.lit(""), "body_text": snippet, "requested_url": F.col("url"),
            "evidence_source": F.lit("provider_search_result"),
        }
    )
    return page_evidence(rows)


# -------------------------------------------------------------- composite check
def _phrases(text_key: Column) -> Column:
    padded = F.concat(F.lit(" "), text_key, F.lit(" "))
    found = labels(*[(F.contains(padded, F.lit(f" {p} ")), p) for p in COMPOSITE_PHRASES])
    # A phrase inside a longer found phrase does not count on its own.
    return F.filter(
        found,
        lambda p: ~F.exists(found, lambda q: (q != p) & F.contains(
            F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))),
    )


def _bundle_words(text_key: Column) -> Column:
    return F.array_intersect(F.array(*[F.lit(w) for w in BUNDLE_WORDS]), words(text_key))


def _connected(raw: Column, text_key: Column, left: Column, right: Column) -> Column:
    """Do two codes stand next to ``+`` or ``&``, or within six words around a connector?"""
    plus = F.concat(F.lit("(?i)\\b"), left, F.lit("\\b\\s*[+&]\\s*\\b"), right, F.lit("\\b"))
    link = "(?:" + "|".join(CONNECTOR_WORDS) + ")"
    gaps = [
        F.concat(
            F.lit(" "), F.lower(left), F.lit(f" (?:\\S+ ){{{a}}}{link} (?:\\S+ ){{0,{4 - a}}}"),
            F.lower(right), F.lit(" "),
        )
        for a in range(5)
    ]
    padded = F.concat(F.lit(" "), text_key, F.lit(" "))
    return F.regexp(raw, plus) | F.regexp(padded, F.concat_ws("|", *gaps))


def composite_mismatch(mpn: Column, name: Column, mpn_found: Column, texts: Column) -> Column:
    """Does a page sell our code together with another one, or as a set?

    ``texts`` are the title, addresses, structured data and visible text of the page.
    """
    product_text = F.concat_ws(" ", mpn, name)
    expected = F.array_distinct(F.concat(product_codes(mpn), product_codes(name)))
    page = F.array_join(texts, " ")

    def judge(p: Column) -> Column:
        extra = F.array_except(p["found"], p["expected"])
        known = mpn_found | F.arrays_overlap(p["expected"], p["found"])
        joined = F.exists(
            p["expected"],
            lambda e: F.exists(
                extra,
                lambda x: F.exists(
                    p["texts"],
                    lambda t: _connected(t["raw"], t["key"], e, x) | _connected(t["raw"], t["key"], x, e),
                ),
            ),
        )
        phrases = _phrases(p["key"])
        markers = F.concat(
            phrases,
            F.when(joined, F.array(F.lit("expected_identifier_joined_with_extra_identifier"))).otherwise(empty_texts()),
            F.when(F.size(extra) > 0, _bundle_words(p["key"])).otherwise(empty_texts()),
        )
        own = (
            (F.size(_phrases(p["own_key"])) > 0)
            | (F.size(_bundle_words(p["own_key"])) > 0)
            | (F.size(p["expected"]) >= 2)
        )
        hit = (F.size(p["expected"]) > 0) & known & (F.size(markers) > 0) & ~own
        reason = (
            F.when(F.size(phrases) > 0, "candidate_contains_composite_phrase")
            .when(joined, "candidate_contains_expected_identifier_with_extra_identifier")
            .otherwise("candidate_contains_bundle_marker_with_extra_identifier")
        )
        return F.struct(
            hit.alias("is_mismatch"),
            F.when(hit, reason).otherwise("").alias("reason"),
            F.when(hit, F.array_distinct(markers)).otherwise(empty_texts()).alias("markers"),
            F.when(hit, extra).otherwise(empty_texts()).alias("extra_identifiers"),
        )

    facts = F.struct(
        expected.alias("expected"),
        product_codes(page).alias("found"),
        product_text_key(page).alias("key"),
        product_text_key(product_text).alias("own_key"),
        F.transform(texts, lambda t: F.struct(t.alias("raw"), product_text_key(t).alias("key"))).alias("texts"),
    )
    return bind(facts, judge)


# ----------------------------------------------------------------- match score
def score_candidates(evidence: DataFrame, group: Sequence[str] = ("product_id", "source_name")) -> DataFrame:
    """Confidence, match status and method of every page; rivals within a group demote.

    Expects the columns of ``page_evidence`` and ``source_type``, ``valid_url``.
    """
    composite = composite_mismatch(
        F.col("mpn"), F.col("name"), F.col("mpn_found"),
        F.filter(F.array("title", "canonical_url", "requested_url", "evidence_text"), lambda t: t != ""),
    )
    found = lambda c: F.col(c)
    provider = F.col("evidence_source") == "provider_search_result"
    market = F.col("source_type") == "marketplace"
    both = found("mpn_found") & found("brand_found")
    base = (
        F.when(both, 1.0)
        .when(found("mpn_found"), 0.85)
        .when(found("model_found"), 0.60)
        .when(
            (F.col("title_similarity") >= 0.5) | found("brand_found") | found("category_compatible"),
            F.greatest(F.lit(0.50), F.least(F.lit(0.75), F.col("title_similarity"))),
        )
        .otherwise(0.0)
    )
    source = F.col("mpn_source")
    body_only = market & found("mpn_found") & (source == "body") & ~provider
    capped = F.least(
        base,
        F.when(body_only, 0.60).otherwise(1.0),
        F.when(market & found("mpn_found") & (source == "meta"), 0.88).otherwise(1.0),
        F.when(market & found("mpn_found") & (source == "url"), 0.80).otherwise(1.0),
        F.when(provider, 0.80).otherwise(1.0),
    )
    priced = (
        F.when(F.col("price_compatible") & (capped > 0), F.least(F.lit(1.0), capped + 0.02))
        .when(~F.col("price_compatible"), F.greatest(F.lit(0.0), capped - 0.10))
        .otherwise(capped)
    )
    final = F.bround(F.when(F.col("title_only"), F.least(priced, F.lit(0.50))).otherwise(priced), 4)
    error = F.col("error_code")
    held = error.isin("blocked_or_captcha", "http_403") | ((error == "") & F.col("blocked"))
    case = (
        F.when(error.isin("inaccessible", "timeout") & F.col("valid_url") & both, "url_identifier_and_brand_inaccessible")
        .when(held & F.col("valid_url"), "blocked_product_url")
        .when(error != "", error)
        .when(F.col("blocked"), "blocked_or_captcha")
        .when(F.col("_c.is_mismatch"), "composite_product_mismatch")
        .when(both, "exact_mpn_and_brand")
        .otherwise("manual_review_required")
    )
    regular = F.col("match_method").isin("exact_mpn_and_brand", "manual_review_required")
    scored = (
        evidence.withColumn("_c", composite)
        .withColumn("match_method", case)
        .withColumns(
            {
                "confidence": F.when(
                    F.col("match_method").isin("url_identifier_and_brand_inaccessible", "blocked_product_url"), 0.80
                ).when(regular, final).otherwise(0.0),
                "composite_reason": F.col("_c.reason"),
            }
        )
        .drop("_c")
    )
    failed = ~regular & ~F.col("match_method").isin(
        "url_identifier_and_brand_inaccessible", "blocked_product_url", "composite_product_mismatch"
    )
    plausible = (F.col("confidence") >= 0.50) & ~failed
    rivals = scored.groupBy(*group).agg(F.count_if(plausible).alias("competing_candidates"))
    counted = scored.join(rivals, list(group))
    crowded = (F.col("competing_candidates") > 1) & (F.col("confidence") >= 0.50)
    status = (
        F.when(failed, "error")
        .when(F.col("match_method") == "composite_product_mismatch", "not_found")
        .when(
            (F.col("match_method") == "exact_mpn_and_brand") & (F.col("confidence") > 0.90)
            & ~crowded & ~F.col("title_only"),
            "matched",
        )
        .otherwise("needs_review")
    )
    return counted.withColumn("match_status", status)


def keep_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates worth storing: errors, known misses, composite pages and confident ones."""
    state, kind = F.col("match_status"), F.col("match_method")
    has_url = F.coalesce(F.col("candidate_url"), F.lit("")) != ""
    return candidates.where(
        (state == "error") | (F.col("status") == "error")
        | ((kind == "composite_product_mismatch") & has_url)
        | (((state == "not_found") | (F.col("status") == "not_found")) & ~has_url)
        | (F.col("confidence") >= KEEP_CONFIDENCE)
    )


# ------------------------------------------------------------- candidate lists
def candidate_predicates(
    status=None, source_name=None, run_id=None, model=None, product_id=None,
    min_confidence=None, max_confidence=None,
) -> list[Column]:
    out = []
    if status and status.lower() != "all":
        out.append(F.col("status") == status)
    for name, value in (("source_name", source_name), ("model", model)):
        if value and value.strip():
            out.append(F.contains(F.lower(name), F.lit(value.strip().lower())))
    if run_id:
        out.append(F.col("run_id") == run_id)
    if product_id is not None:
        out.append(F.col("product_id") == product_id)
    if min_confidence is not None:
        out.append(F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        out.append(F.col("confidence") <= max_confidence)
    return out


def created_between(candidates: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Candidates created from the first day to the end of the last day."""
    out = candidates
    if first:
        out = out.where(F.col("created_at") >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1))
    return out


def candidate_page(candidates: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return candidates.orderBy(F.desc("created_at"), F.desc("candidate_id")).offset(offset).limit(limit)


def candidate_history(candidates: DataFrame) -> DataFrame:
    """Candidates per product and run: count by status and the newest one."""
    return candidates.where(F.col("product_id").isNotNull()).groupBy("product_id", "run_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_ORDER],
        F.max("created_at").alias("latest_created_at"),
    )


def ordered_history(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates with runs newest first and, inside a run, by status rank, time and id."""
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")), F.lit(0)) - 1,
        F.lit(len(STATUS_ORDER)),
    )
    newest = candidates.groupBy("run_id").agg(F.max("created_at").alias("_latest"))
    joined = candidates.join(newest, "run_id").join(
        runs.select("run_id", F.col("created_at").alias("_run_at")), "run_id", "left"
    )
    return joined.withColumn("status_rank", rank).orderBy(
        F.coalesce("_run_at", "_latest").desc(), F.col("_latest").desc(), F.col("run_id").desc(),
        "status_rank", "created_at", "candidate_id",
    )


# --------------------------------------------------------------- run summaries
def run_summary(candidates: DataFrame) -> DataFrame:
    """Candidates by match status, in total (source NULL) and per source."""
    cells = candidates.groupBy("source_name", "match_status").agg(F.count(F.lit(1)).alias("n"))
    return cells.rollup("source_name").agg(
        F.sum("n").alias("candidates"),
        *[
            F.coalesce(F.sum(F.when(F.col("match_status") == s, F.col("n"))), F.lit(0)).alias(s)
            for s in ("matched", "needs_review", "not_found", "error", "skipped")
        ],
    )


def provider_summary(candidates: DataFrame) -> DataFrame:
    """Per provider: first query, and kept candidates per source."""
    first = candidates.groupBy("provider").agg(
        F.min_by("query", "candidate_id").alias("query"),
        F.count_if(F.col("candidate_url") != "").alias("kept"),
    )
    per_source = (
        candidates.where("candidate_url <> ''")
        .groupBy("provider", "source_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    status = F.when(F.col("kept") > 0, "found_candidates").otherwise("no_results")
    return first.withColumn("status", status).join(per_source, "provider", "left")


def rule_suggestions(candidates: DataFrame) -> DataFrame:
    """Counters that call for a rule change, one row each, zero counters left out."""
    unknown = F.col("match_status").isin("needs_review", "not_found") & ~F.col("mpn_found") & ~F.col("model_found")
    body_only = (F.col("source_type") == "marketplace") & (
        (F.col("mpn_found") & (F.col("mpn_source") == "body"))
        | (F.col("model_found") & (F.col("model_source") == "body"))
    )
    kinds = {
        "missing_identifier_evidence": unknown,
        "blocked_or_captcha": F.col("error_code") == "blocked_or_captcha",
        "category_mismatch": ~F.col("category_compatible") & (F.col("confidence") >= 0.5),
        "title_only_review": F.col("title_only"),
        "body_only_marketplace_identifier": body_only,
    }
    hits = candidates.select("source_name", F.explode(labels(*[(c, k) for k, c in kinds.items()])).alias("kind"))
    per_source = hits.groupBy("source_name", "kind").agg(F.count(F.lit(1)).alias("count"))
    overall = F.col("kind") == "missing_identifier_evidence"
    return per_source.groupBy(
        F.when(~overall, F.col("source_name")).alias("source_name"), "kind"
    ).agg(F.sum("count").alias("count"))


def run_analysis(candidates: DataFrame) -> DataFrame:
    """Findings after a run: status totals, status per source, errors per source and method."""
    base = candidates.groupBy("source_name", "match_status", "match_method").agg(F.count(F.lit(1)).alias("n"))
    part = lambda df, kind, group, value: df.select(
        F.lit(kind).alias("kind"), group.alias("source_name"), value.alias("value"), "n"
    )
    whole = part(base, "by_status", F.lit(None).cast("string"), F.col("match_status"))
    source = part(base, "by_source", F.col("source_name"), F.col("match_status"))
    errors = part(base.where("match_status = 'error'"), "errors", F.col("source_name"), F.col("match_method"))
    return (
        whole.unionByName(source).unionByName(errors)
        .groupBy("kind", "source_name", "value").agg(F.sum("n").alias("count"))
    )


def recommendations(analysis: DataFrame, title_only: Column, missing: Column, candidates: DataFrame) -> DataFrame:
    """Advice rows from the analysis and two counters of the candidates."""
    counts = candidates.agg(
        F.count_if(title_only).alias("title_only_review"), F.count_if(missing).alias("missing_identifiers")
    )
    flat = counts.unpivot([], ["title_only_review", "missing_identifiers"], "type", "count").select(
        "type", F.lit(None).cast("string").alias("source_name"), "count"
    )
    blocked = analysis.where("kind = 'errors' AND value = 'blocked_or_captcha'").select(
        F.lit("blocked_or_captcha").alias("type"), "source_name", "count"
    )
    lost = analysis.where("kind = 'by_status' AND value = 'not_found'").select(
        F.lit("not_found").alias("type"), F.lit(None).cast("string").alias("source_name"), "count"
    )
    return flat.unionByName(blocked).unionByName(lost).where("count > 0")


# -------------------------------------------------------------- search results
SEARCH_SCHEMA = (
    "web struct<results:array<struct<url:string,title:string,description:string,snippet:string,"
    "extra_snippets:array<string>>>>"
)


def search_results(payloads: DataFrame, column: str = "payload", max_results: int = 10) -> DataFrame:
    """Ranked result rows of a web-search answer; results without a URL take no rank."""
    parsed = F.from_json(F.col(column), SEARCH_SCHEMA)["web"]["results"]
    named = F.filter(parsed, lambda r: trim_text(r["url"]) != "")
    rows = payloads.select("*", F.posexplode(F.slice(named, 1, max_results)).alias("_pos", "_r"))
    return rows.select(
        *[c for c in payloads.columns if c != column],
        (F.col("_pos") + 1).alias("rank"),
        trim_text(F.col("_r.url")).alias("url"),
        H.clean_text(H.strip_tags(F.col("_r.title"))).alias("title"),
        H.clean_text(H.strip_tags(F.coalesce("_r.description", "_r.snippet"))).alias("description"),
        F.coalesce("_r.extra_snippets", empty_texts()).alias("extra_snippets"),
    )


def classify_hosts(rows: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Rows with the rule row of the source their host belongs to (NULL for other hosts)."""
    bare = F.regexp_replace(url_host(F.col(url)), "^www[.]", "")
    keyed = sources.select(
        F.explode(F.transform("domains", lambda d: F.regexp_replace(F.lower(d), "^www[.]", ""))).alias("_domain"),
        "source_name", "weight", F.get("domains", F.lit(0)).alias("source_domain"), "allow", "block", "max_candidates",
    )
    return rows.withColumn("_host", bare).join(
        keyed, F.col("_host") == F.col("_domain"), "left"
    ).drop("_host", "_domain")


def filter_search_results(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct result pages of a query with what becomes of them.

    ``results`` has ``product_id, query_no, rank, url``. Copies of a page collapse into
    its best rank (``copies`` tells how many). The number kept per source is limited by
    the source's own setting.
    """
    known = classify_hosts(
        results.withColumn("normalized", normalize_url(F.col("url"))), sources, "normalized"
    )
    fits = is_product_url(F.col("normalized"), url_host(F.col("normalized")), F.col("allow"), F.col("block"))
    shaped = known.select(
        "product_id", "query_no", "rank", "url", "normalized", "source_name", "max_candidates",
        F.when(fits, without_query(F.col("normalized"))).alias("product_url"),
    )
    state = (
        F.when(F.col("normalized").isNull(), "invalid_url")
        .when(F.col("source_name").isNull(), "unknown_host")
        .when(F.col("product_url").isNull(), "no_product_url")
        .otherwise("kept")
    )
    pages = (
        shaped.withColumns({"state": state, "page": F.coalesce("product_url", "normalized", "url")})
        .groupBy("product_id", "query_no", "source_name", "max_candidates", "product_url", "page", "state")
        .agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("copies"))
    )
    # A query answers with one short result page, so its groups here stay small.
    place = F.row_number().over(
        Window.partitionBy("product_id", "query_no", "source_name", "state").orderBy("rank", "page")
    )
    over = (F.col("state") == "kept") & (F.col("_place") > F.col("max_candidates"))
    return (
        pages.withColumn("_place", place)
        .withColumn("state", F.when(over, "over_source_limit").otherwise(F.col("state")))
        .drop("_place", "max_candidates")
    )


def first_per_source(filtered: DataFrame) -> DataFrame:
    """First kept result of every source over all queries of a product."""
    kept = filtered.where("state = 'kept'").select("product_id", "source_name", "query_no", "rank", "product_url")
    return first_row(kept, ["product_id", "source_name"], [F.col("query_no"), F.col("rank")])


# ------------------------------------------------------------------ resolution
def _alnum(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^0-9a-z]+", "")


def _word_set(col: Column, shortest: int) -> Column:
    found = F.regexp_extract_all(fold_case(F.coalesce(col, F.lit(""))), F.lit("(?U)\\w+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= shortest))


def _share_of(names: Column, found: Column) -> Column:
    return F.when(F.size(names) > 0, F.size(F.array_intersect(names, found)) / F.size(names)).otherwise(F.lit(0.0))


def name_overlap(name: Column, text: Column) -> Column:
    """Share of the name's words found in a text."""
    return bind(_word_set(name, 3), lambda n: _share_of(n, _word_set(text, 3)))


def name_identifier_points(name: Column, haystack: Column) -> Column:
    """Points for the code a product name starts with: whole, or in parts."""
    return _identifier_points(name, _alnum(haystack), _word_set(haystack, 2))


def _identifier_points(name: Column, flat: Column, found: Column) -> Column:
    """The same over a text that was flattened and cut into words before."""
    lead = F.regexp_extract(F.coalesce(name, F.lit("")), "^\\s*([0-9a-zA-Z]+(?:[-/][0-9a-zA-Z]+)*)", 1)

    def points(p: Column) -> Column:
        chunks = F.filter(F.transform(F.split(p["lead"], "[^0-9a-zA-Z]+"), _alnum), lambda c: c != "")

        def of_chunk(c: Column) -> Column:
            capacity = F.regexp_extract(c, "(?:^|[^0-9])([0-9]{2})(?:[^0-9]|$)", 1)
            mixed = c.rlike("[a-z]") & c.rlike("[0-9]")
            return (
                F.when(mixed & (F.length(c) >= 4) & F.contains(p["hay"], c), 10.0)
                .when((capacity != "") & F.array_contains(p["words"], capacity), 4.0)
                .when(c.rlike("^[a-z]{4,}$") & F.array_contains(p["words"], c), 6.0)
                .otherwise(0.0)
            )

        def total(scores: Column) -> Column:
            hits = F.size(F.filter(scores, lambda s: s > 0))
            added = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) + F.when(hits >= 2, 4.0).otherwise(0.0)
            limit = F.when(p["key"].rlike("(wfc|wfib)$"), 7.0).otherwise(22.0)
            return F.least(added, limit)

        usable_key = p["key"].rlike("[a-z]") & p["key"].rlike("[0-9]")
        return (
            F.when(~usable_key, 0.0)
            .when(F.contains(p["hay"], p["key"]), 24.0)
            .otherwise(bind(F.transform(chunks, of_chunk), total))
        )

    return bind(
        F.struct(
            lead.alias("lead"), _alnum(lead).alias("key"), flat.alias("hay"), found.alias("words"),
        ),
        points,
    )


def resolver_score(rows: DataFrame) -> DataFrame:
    """Score 0 to 100 of a search result as the source of a product.

    Expects ``weight, product_url, title, description, extra_snippets, rank`` of the
    result and ``model, mpn, barcode, brand, name`` of the product.
    """
    hay = F.concat_ws(" ", "product_url", "title", "description", F.array_join("extra_snippets", " "))
    # Every text of a row is flattened and cut into words once.
    read = rows.withColumn("_hay", hay).withColumns({
        "_flat": _alnum(F.col("_hay")), "_words": _word_set(F.col("_hay"), 2), "_name": _word_set(F.col("name"), 3),
        "_title": _word_set(F.col("title"), 3), "_text": _word_set(F.col("description"), 3),
        **{f"_{c}": _alnum(F.col(c)) for c in ("mpn", "barcode", "model", "brand")},
    })
    inside = lambda c: (F.col(f"_{c}") != "") & F.contains("_flat", F.col(f"_{c}"))
    share = lambda found: _share_of(F.col("_name"), found)
    identity = F.least(
        F.when(inside("mpn") | inside("barcode"), 20.0).otherwise(0.0)
        + F.when(inside("model"), 5.0).otherwise(0.0)
        + _identifier_points(F.col("name"), F.col("_flat"), F.col("_words")),
        F.lit(35.0),
    )
    score = (
        F.least(F.lit(40.0), F.greatest(F.lit(0.0), F.col("weight") * F.lit(0.4)))
        + identity
        + F.when(inside("brand"), 8.0).otherwise(0.0)
        + share(F.filter("_words", lambda t: F.length(t) >= 3)) * 12.0
        + 8.0
        + (share(F.col("_title")) * 4.0 + share(F.col("_text")) * 3.0)
        + F.when(F.col("rank") > 0, F.greatest(F.lit(0.0), 6.0 - F.least("rank", F.lit(6)))).otherwise(0.0)
    )
    return read.withColumn("confidence", F.least(F.lit(100), F.bround(score, 0).cast("int"))).select(*rows.columns, "confidence")


def resolve_sources(
    products: DataFrame, results: DataFrame, sources: DataFrame,
    minimum: int = 80, suggestion: int = 50, max_suggestions: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Suggestions per product, and the state each product ends in.

    ``results`` has ``product_id, query_no, rank, url, title, description, extra_snippets``.
    """
    known = classify_hosts(results, sources).where("source_name IS NOT NULL")
    shaped = known.withColumn("product_url", without_query(F.col("url"))).where(
        (F.col("product_url") != "")
        & looks_like_product_path(url_path(F.col("url")))
        & F.regexp(F.col("product_url"), F.concat(F.lit("(?i)"), F.col("allow")))
    )
    once = first_row(shaped, ["product_id", "product_url"], [F.col("query_no"), F.col("rank")])
    scored = resolver_score(once.join(products, "product_id")).where(F.col("confidence") >= suggestion)
    order = [F.desc("confidence"), F.coalesce("rank", F.lit(9999)), F.col("product_url")]
    ranked = top_rows(scored, ["product_id"], order, max_suggestions, "suggestion_rank")
    best = ranked.where("suggestion_rank = 1").select(
        "product_id", F.col("product_url").alias("best_url"), "confidence", "source_name"
    )
    sure = F.col("confidence") >= minimum
    state = products.select("product_id").join(best, "product_id", "left").select(
        "product_id",
        F.when(sure, "auto_selected").when(F.col("confidence").isNotNull(), "needs_review")
        .otherwise("no_usable_source").alias("status"),
        F.when(sure, F.col("best_url")).alias("selected_url"),
        F.when(sure, F.col("source_name")).alias("selected_source"),
        F.when(sure, F.col("confidence")).alias("confidence"),
    )
    return ranked, state


def ready_to_enqueue(rows: DataFrame, threshold: int = 85) -> DataFrame:
    chosen = F.coalesce(F.col("selected_url"), F.lit("")) != ""
    sure = (F.col("status") == "auto_selected") & (F.coalesce("confidence", F.lit(0)) >= threshold)
    return rows.where(chosen & ((F.col("status") == "manually_selected") | sure))


BATCH_STATES = [
    "pending", "auto_selected", "manually_selected", "needs_review", "no_usable_source",
    "resolution_failed", "skipped",
]


def batch_counts(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Row counts by state and the batch state they lead to."""
    counts = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in BATCH_STATES],
        F.count_if(F.col("status") == "resolving_source").alias("_resolving"),
    )
    joined = counts.join(batches.select("batch_id", F.col("status").alias("_old")), "batch_id")
    state = (
        F.when(F.col("_old") == "failed", "failed")
        .when((F.col("_resolving") > 0) | ((F.col("_old") == "resolving") & (F.col("pending_count") > 0)), "resolving")
        .when(F.col("resolution_failed_count") > 0, "partially_resolved")
        .when(F.col("pending_count") > 0, "uploaded")
        .otherwise("resolved")
    )
    return joined.withColumn("batch_status", state).drop("_old", "_resolving")


# --------------------------------------------------------------------- queries
def product_queries(products: DataFrame) -> DataFrame:
    """Search texts of a product: by MPN, by barcode, by brand, name and category, by name."""
    text = lambda c: collapse_spaces(F.coalesce(F.col(c), F.lit("")))
    quoted = lambda c: F.when(
        text(c) != "", F.concat_ws(" ", F.concat(F.lit('"'), text(c), F.lit('"')), text("brand"), text("name"))
    ).otherwise("")
    raw = F.array(
        quoted("mpn"), quoted("barcode"), F.concat_ws(" ", text("brand"), text("name"), text("category")), text("name")
    )
    clean = F.array_distinct(F.filter(F.transform(raw, collapse_spaces), lambda q: q != ""))
    return products.select("product_id", F.posexplode(clean).alias("query_no", "query"))


def scoped_queries(products: DataFrame, domains: Sequence[str]) -> DataFrame:
    """One query per source, limited to its site; the list of sources is configuration."""
    text = lambda c: collapse_spaces(F.coalesce(F.col(c), F.lit("")))
    who = collapse_spaces(F.concat_ws(" ", text("brand"), text("name")))
    sites = F.array(*[F.lit(d) for d in domains])
    made = F.array_distinct(
        F.transform(sites, lambda d: collapse_spaces(F.concat(who, F.lit(" site:"), d)))
    )
    return products.select("product_id", F.posexplode(made).alias("query_no", "query"))


def template_queries(products: DataFrame, templates: Sequence[str], limit: int) -> DataFrame:
    """Queries from templates such as ``{brand} {mpn}``; one that needs an empty field is left out."""
    import re

    text = lambda c: collapse_spaces(F.coalesce(F.col(c), F.lit("")))
    made = []
    for template in templates:
        pieces = re.split(r"\{(\w+)\}", template)
        names = pieces[1::2]
        if not names:
            continue
        filled = F.concat(*[text(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
        ok = text(names[0]) != ""
        for n in names[1:]:
            ok = ok & (text(n) != "")
        made.append(F.when(ok, filled))
    kept = F.slice(F.array_distinct(F.filter(F.array(*made), lambda q: q.isNotNull())), 1, limit)
    return products.select("product_id", F.posexplode(kept).alias("query_no", "query"))


def name_queries(products: DataFrame, prefix: str) -> DataFrame:
    return products.select(
        "product_id", F.posexplode(search_queries(F.col("name"), prefix)).alias("query_no", "query")
    )


# ----------------------------------------------------------- captured responses
def score_responses(responses: DataFrame) -> DataFrame:
    """Signed points telling how likely a response holds offers, with the reasons."""
    url, body = F.lower("url"), F.coalesce(F.col("body"), F.lit(""))
    has = lambda names: url.rlike("|".join(n.replace(".", "[.]") for n in names))
    static = url.rlike("(" + "|".join(e.replace(".", "[.]") for e in STATIC_EXTENSIONS) + ")$")
    json = F.lower(F.coalesce("content_type", F.lit(""))).contains("json") | F.try_parse_json(body).isNotNull()
    rules = [
        (json, 3, "json"),
        (body.rlike("(?iu)(price|amount|final_price|current_price|τιμ|€|eur)"), 3, "price fields"),
        (body.rlike("(?iu)(seller|shop|store|merchant|καταστημα|κατάστημα|πωλητ)"), 3, "seller/shop fields"),
        (body.rlike("(?iu)(availability|available|stock|διαθεσιμ|απόθεμα|αποθεμα)"), 2, "availability fields"),
        (body.rlike("(?iu)(shipping|delivery|courier|pickup|παραδοση|παράδοση|μεταφορ)"), 2, "shipping fields"),
        (F.col("after_trigger"), 2, "after trigger"),
        (url.rlike("(product|offer|shop|seller|sku)"), 1, "product/offers endpoint"),
        (F.contains(url, F.lit("service_filtered_offerings")), 4, "offerings endpoint"),
        (F.contains(url, F.lit("filter_products")), 4, "filter products endpoint"),
        (F.col("status") >= 400, -2, "error status"),
        (body.rlike("(?i)(just a moment|cloudflare|cf-chl|challenge-platform)"), -4, "blocked/challenge payload"),
        (F.length(body) < 80, -3, "tiny payload"),
        (has(ANALYTICS_MARKERS), -5, "analytics endpoint"),
        (has(PROMOTION_MARKERS), -4, "promotion endpoint"),
        (static, -5, "static asset"),
    ]
    total = F.lit(0)
    for cond, points, _ in rules:
        total = total + F.when(cond, points).otherwise(0)
    reasons = labels(*[(c, f"{p:+d} {name}") for c, p, name in rules])
    return responses.withColumns({"score": total, "reasons": reasons})


def rank_responses(scored: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Responses of a capture numbered by score, the earlier one first among equals."""
    return exact_rank(scored.withColumn("_down", -F.col("score")), keys, ["_down", seq]).drop("_down")


def endpoint_class(url: Column, body: Column) -> Column:
    """Kind of data an endpoint delivers, from its address and the key names of its payload."""
    low, text = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    parsed = F.try_parse_json(body)
    keys = lambda names: text.rlike('"[^"]*(' + "|".join(names) + ')[^"]*"\\s*:')
    cards = F.try_variant_get(parsed, "$.product_cards", "array<variant>").isNotNull()
    blocked = "|".join(BLOCKED_WORDS)
    return (
        F.when(text.rlike(blocked) | low.rlike(blocked), "BLOCKED_OR_CHALLENGE")
        .when(F.contains(low, F.lit("filter_products")), "PRIMARY_CANDIDATE_PRODUCT_OFFERS")
        .when(F.contains(low, F.lit("shops_details")), "SECONDARY_CANDIDATE_SHOP_DETAILS")
        .when(cards, "PRIMARY_CANDIDATE_PRODUCT_OFFERS")
        .when(parsed.isNull(), "NON_JSON_XHR")
        .when(keys(OFFER_KEYS), "POSSIBLE_PRODUCT_OR_OFFER_DATA")
        .when(keys(REVIEW_KEYS), "POSSIBLE_REVIEWS_OR_RATING_DATA")
        .when(keys(RECOMMENDATION_KEYS), "POSSIBLE_RECOMMENDATIONS")
        .otherwise("OTHER_JSON")
    )


# ------------------------------------------------------------- offers in pages
def _cents(text: Column) -> Column:
    """Price attribute: whole numbers are cents, others are amounts; only positive values."""
    amount = F.when(
        text.rlike("[.,]"), F.replace(text, F.lit(","), F.lit(".")).try_cast(WIDE)
    ).otherwise(text.try_cast(WIDE) / 100)
    return F.when(amount > 0, F.round(amount, 2).cast(MONEY))


def html_offers(pages: DataFrame, html: str = "html") -> DataFrame:
    """Seller offers of a marketplace page: groups per seller, products per group."""
    def cut(text: Column, css: str) -> Column:
        """Pieces of the text that start with a tag of the class."""
        mark = f"(?i)(?=<[^>]*\\bclass=[\"'][^\"']*{css}[^\"']*[\"'])"
        # The leading blank keeps a tag at the very start from being the first piece.
        pieces = F.split(F.concat(F.lit(" "), text), mark)
        return F.slice(pieces, F.lit(2), F.size(pieces))

    keep = [c for c in pages.columns if c != html]
    groups = pages.select(*keep, F.posexplode(cut(F.col(html), "prices__group")).alias("_g", "_group"))
    tag = F.regexp_extract(F.col("_group"), "(?s)^<[^>]*>", 0)
    rows = groups.select(
        *keep,
        F.coalesce(H.attribute(tag, "data-id").try_cast("int"), F.col("_g") + 1).alias("offer_rank"),
        _cents(H.attribute(tag, "data-price")).alias("_group_price"),
        H.clean_text(F.regexp_extract("_group", "(?is)class=[\"'][^\"']*merchant[^\"']*[\"'][^>]*>(.*?)<", 1)).alias("seller_name"),
        F.regexp_extract("_group", "(?i)href=[\"']([^\"']*/to/[^\"']+)[\"']", 1).alias("seller_url"),
        F.posexplode_outer(cut(F.col("_group"), "prices__product")).alias("_p", "_product"),
    )
    ptag = F.regexp_extract(F.coalesce("_product", F.lit("")), "(?s)^<[^>]*>", 0)
    shipping_text = H.attribute(ptag, "data-shipping-cost")
    priced = rows.withColumns(
        {
            "price": F.coalesce(_cents(H.attribute(ptag, "data-price")), "_group_price"),
            "shipping": F.when(shipping_text == "0", F.lit(0).cast(MONEY)).otherwise(_cents(shipping_text)),
            "_explicit": F.coalesce(*[_cents(H.attribute(ptag, a)) for a in LANDED_ATTRIBUTES]),
            "availability": F.when(ptag.rlike("(?i)data-in-stock"), "in_stock").otherwise(
                F.nullif(F.regexp_extract(F.coalesce("_product", F.lit("")), "(?i)data-status=[\"']([^\"']+)[\"']", 1), F.lit(""))
            ),
            "product_index": F.coalesce(F.col("_p") + 1, F.lit(0)),
        }
    )
    landed = landed_price(F.col("price"), F.col("shipping"), F.col("_explicit"))
    return (
        priced.withColumn("_l", landed)
        .withColumns({"landed_price": F.col("_l.price"), "landed_source": F.col("_l.source")})
        .where(F.col("price").isNotNull())
        .drop("_group_price", "_p", "_product", "_explicit", "_l")
    )


def _first_decimal(text: Column) -> Column:
    found = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), "[0-9]+(?:[.,][0-9]{1,2})?", 0)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast(WIDE).cast(MONEY)


def _column_of(header: Column, names: Sequence[str]) -> Column:
    hits = F.transform(header, lambda h, i: F.when(h.rlike("|".join(names)), i))
    return F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0))


def table_offers(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Offers in Markdown tables: the nearest header above a row names its columns.

    Lines of one document are looked at together; a document is one input row, so these
    windows stay as small as a document.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\\r?\\n")).alias("line_no", "line"))
    cells = F.transform(
        F.split(F.regexp_replace(F.trim("line"), "^\\||\\|$", ""), "\\|"), lambda c: H.clean_text(H.strip_tags(c))
    )
    in_table = F.contains("line", F.lit("|"))
    rule = F.trim("line").rlike("^[-:| ]+$")
    split = lines.withColumn("cells", cells).withColumn(
        "_has_price", F.exists("cells", lambda c: _first_decimal(c).isNotNull())
    )
    header = F.when(
        in_table & ~rule & ~F.col("_has_price"),
        F.transform("cells", lambda c: F.regexp_replace(product_text_key(c), " ", "_")),
    )
    stop = ~in_table & (F.trim("line") != "")
    so_far = Window.partitionBy(key).orderBy("line_no")
    blocks = split.withColumn("_block", F.sum(stop.cast("int")).over(so_far)).withColumn("_h", header)
    in_block = Window.partitionBy(key, "_block").orderBy("line_no")
    rows = blocks.withColumn("_header", F.last("_h", ignorenulls=True).over(in_block)).where(
        in_table & F.col("_has_price") & (F.contains("line", F.lit("€")) | F.col("_header").isNotNull())
    )
    h = F.coalesce("_header", empty_texts())
    first_priced = F.get(
        F.filter(F.transform("cells", lambda c, i: F.when(_first_decimal(c).isNotNull(), i)), lambda x: x.isNotNull()),
        F.lit(0),
    )
    picked = rows.withColumns(
        {
            "_seller": F.get("cells", F.coalesce(_column_of(h, ["store", "shop", "seller", "merchant", "katastima", "politis"]), F.lit(0))),
            "price": _first_decimal(F.get("cells", F.coalesce(F.nullif(_column_of(h, ["item_price", "price", "timi"]), F.lit(0)), first_priced))),
            "shipping": _first_decimal(F.get("cells", _column_of(h, ["shipping", "metaforika", "apostoli"]))),
            "_landed": _first_decimal(F.get("cells", _column_of(h, ["landed", "total", "final", "synolo", "teliki"]))),
        }
    ).where(F.col("price").isNotNull())
    landed = landed_price(F.col("price"), F.col("shipping"), F.col("_landed"))
    link = "\\[([^\\]]+)\\]\\(([^)]+)\\)"
    return picked.withColumn("_l", landed).select(
        key, "line_no",
        F.coalesce(F.nullif(F.regexp_extract("_seller", link, 1), F.lit("")), F.col("_seller")).alias("seller_name"),
        F.nullif(F.regexp_extract("_seller", link, 2), F.lit("")).alias("seller_url"),
        "price", "shipping", F.col("_l.price").alias("landed_price"), F.col("_l.source").alias("landed_source"),
    )


def line_offers(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Offers in plain lines such as ``1. Shop name 12,50 € shipping 2,00``."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\\r?\\n")).alias("line_no", "_line"))
    clean = lines.withColumn("line", H.clean_text(H.strip_tags(F.col("_line")))).where(F.contains("line", F.lit("€")))
    pattern = "(?i)^(?:[0-9]+[).]\\s*)?([A-Za-zΑ-Ωα-ω0-9][^€|]{1,80}?)\\s+([0-9]+(?:[.,][0-9]{1,2})?)\\s*€(.*)$"
    after = "(?iu)(?:shipping|μεταφορικά|μεταφορικα|αποστολή|αποστολη)[^0-9]{0,20}([0-9]+(?:[.,][0-9]{1,2})?)"
    rows = clean.where(F.col("line").rlike(pattern)).select(
        key, "line_no",
        F.trim(F.regexp_extract("line", pattern, 1)).alias("seller_name"),
        _first_decimal(F.regexp_extract("line", pattern, 2)).alias("price"),
        _first_decimal(F.regexp_extract(F.regexp_extract("line", pattern, 3), after, 1)).alias("shipping"),
    )
    landed = landed_price(F.col("price"), F.col("shipping"), F.lit(None).cast(MONEY))
    return rows.where("price IS NOT NULL").withColumn("_l", landed).select(
        "*", F.col("_l.price").alias("landed_price"), F.col("_l.source").alias("landed_source")
    ).drop("_l")


