"""Text columns: spacing, accents, match keys, slugs, tokens, issue flags, metrics."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.common import bind

# ---------------------------------------------------------------- fixed values
# Greek letters and their Latin spelling, one letter each.
GREEK_ONE = "αβγδεζηικλμνξοπρσςτυφω"
LATIN_ONE = "avgdeziiklmnxoprsstyfo"
# Greek letters spelled with two Latin letters.
GREEK_TWO = {"θ": "th", "χ": "ch", "ψ": "ps"}

STOP_WORDS = [
    "miele", "skoupa", "skoypa", "ilektriki", "me", "xoris", "sakoula", "kai", "cheiros",
    "xeiros", "stick", "epanafortizomeni", "asyrmati", "se", "bestprice", "gr",
]
TOKEN_SYNONYMS = {
    "kokkini": "red", "kokkino": "red",
    "mple": "blue", "ble": "blue",
    "leyki": "white", "leyko": "white", "lefki": "white", "lefko": "white",
    "mayri": "black", "mayro": "black", "mavri": "black", "mavro": "black",
    "gkri": "grey",
}
SEARCH_NOISE_TOKENS = ["airclean"]
VARIANT_CODE_EXCEPTIONS = ["m1", "l1", "s1", "hx1", "hx2", "cx1"]

DASH_VALUES = ["", "-", "—", "–", "β€“", "β€”", "β’"]
SINGULAR_ENDINGS = ["ους", "ες", "οι", "ια", "ος", "ας", "ης", "α", "ο", "η", "ς", "s"]
HTML_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&euro;": "€", "&amp;": "&",
}
# Characters that count as blank at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Blanks to collapse, no-break ones included: a lone plain blank is left alone.
SPACES = "(?U)[^\\S ]\\s*| \\s+"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every Latin or Greek letter that decomposes to one letter plus marks."""
    marked, plain = [], []
    blocks = [(0x00C0, 0x0250), (0x0370, 0x0400), (0x1E00, 0x2000)]
    for first, last in blocks:
        for code in range(first, last):
            letter = chr(code)
            base = "".join(
                c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c)
            )
            if len(base) == 1 and base != letter:
                marked.append(letter)
                plain.append(base)
    return "".join(marked), "".join(plain)


def _all(col: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


# -------------------------------------------------------------------- spacing
def trim_text(col: Column) -> Column:
    """Trimmed text; NULL reads as empty."""
    return F.trim(F.coalesce(col, F.lit("")), F.lit(BLANKS))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACES, " "))


def unescape_html(col: Column) -> Column:
    """Entities decoded; a text without ``&`` is left as it is."""
    return bind(col, lambda t: F.when(F.contains(t, F.lit("&")), _all(t, HTML_ENTITIES.items())).otherwise(t))


def normalize_spaces(col: Column) -> Column:
    """Entities decoded, runs of blanks collapsed, no-break blanks included."""
    return collapse_spaces(unescape_html(F.coalesce(col, F.lit(""))))


def fold_case(col: Column) -> Column:
    """Lower case without the final-sigma and sharp-s exceptions."""
    return _all(F.lower(col), [("ς", "σ"), ("ß", "ss")])


def strip_accents(col: Column) -> Column:
    marked, plain = _accent_table()
    return F.regexp_replace(F.translate(col, marked, plain), "\\p{Mn}+", "")


def greek_to_latin(col: Column) -> Column:
    return _all(F.translate(col, GREEK_ONE, LATIN_ONE), GREEK_TWO.items())


# ----------------------------------------------------------------- match keys
def mpn_key(col: Column) -> Column:
    return fold_case(collapse_spaces(col))


def product_text_key(col: Column) -> Column:
    text = greek_to_latin(fold_case(strip_accents(collapse_spaces(col))))
    return collapse_spaces(F.regexp_replace(text, "(?U)[^\\w]+", " "))


def match_key(col: Column) -> Column:
    """Comparison form of labels and names: accents gone, Greek kept, symbols to blanks."""
    text = F.lower(strip_accents(normalize_spaces(col)))
    text = F.replace(text, F.lit("&"), F.lit(" και "))
    text = F.regexp_replace(text, "(?U)\\bwatts\\b", "watt")
    text = F.regexp_replace(text, "[^a-z0-9\\u0370-\\u03ff\\u1f00-\\u1fff\\s]+", " ")
    return collapse_spaces(text)


def words(col: Column) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.filter(F.split(col, " "), lambda w: w != "")


def product_tokens(col: Column) -> Column:
    synonyms = F.create_map(*[F.lit(x) for pair in TOKEN_SYNONYMS.items() for x in pair])
    mapped = F.transform(
        words(product_text_key(col)), lambda t: F.coalesce(F.try_element_at(synonyms, t), t)
    )
    return F.filter(mapped, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def search_queries(col: Column, prefix: str) -> Column:
    """Raw name, then the name without noise and variant codes, then without noise only."""
    tokens = product_tokens(col)
    noise = "^([0-9]{5,}|[0-9]+(x[0-9]+)+|[0-9]+([.][0-9]+)?(w|v|l|lt))$"
    broad = F.filter(tokens, lambda t: ~t.isin(SEARCH_NOISE_TOKENS) & ~t.rlike(noise))
    concise = F.filter(
        broad,
        lambda t: t.isin(VARIANT_CODE_EXCEPTIONS) | ~t.rlike("^[a-z]{4,}[0-9]+[a-z0-9]*$"),
    )

    def phrase(parts: Column) -> Column:
        joined = F.concat(F.lit(prefix + " "), F.array_join(parts, " "))
        return F.when(F.size(parts) > 0, joined).otherwise(F.lit(""))

    raw = collapse_spaces(col)
    return F.filter(F.array_distinct(F.array(raw, phrase(concise), phrase(broad))), lambda q: q != "")


def label_key(col: Column) -> Column:
    return match_key(col)


def compact_dimension_key(key: Column) -> Column:
    return collapse_spaces(F.regexp_replace(key, "(?U)\\b[χx]\\b", " "))


def labels_equivalent(left: Column, right: Column) -> Column:
    """Same key, or same key once a lone ``x`` between numbers is dropped."""
    a, b = label_key(left), label_key(right)
    same = (a == b) | (compact_dimension_key(a) == compact_dimension_key(b))
    return (a != "") & (b != "") & same


def null_dashes(col: Column) -> Column:
    text = normalize_spaces(col)
    return F.when(~text.isin(DASH_VALUES), text)


def clean_breadcrumbs(items: Column) -> Column:
    """Blank crumbs dropped, then each crumb equal to the one before it."""
    clean = F.filter(F.transform(items, normalize_spaces), lambda c: c != "")
    return F.filter(
        clean, lambda c, i: (i == 0) | (F.coalesce(F.get(clean, i - 1), F.lit("")) != c)
    )


# ---------------------------------------------------------------------- slugs
def seo_slug(col: Column) -> Column:
    text = F.lower(strip_accents(normalize_spaces(col)))
    text = F.replace(text, F.lit("ου"), F.lit("ou"))
    text = F.regexp_replace(text, "(?<=\\d)[.,](?=\\d)", "")
    text = F.regexp_replace(greek_to_latin(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(text, "^-+|-+$", "")


def seo_keyword(name: Column, model: Column) -> Column:
    slug = seo_slug(name)
    bare = ~F.contains(slug, model) & ~slug.rlike("[0-9]")
    return (
        F.when((F.coalesce(name, F.lit("")) == "") | (F.coalesce(model, F.lit("")) == ""), "")
        .when(slug == "", "")
        .when(bare, F.concat(slug, F.lit("-"), model))
        .otherwise(slug)
    )


def seo_keyword_from_parts(parts: Column, max_length: int = 96) -> Column:
    """Distinct slug parts joined by dashes, last parts dropped until the text fits."""
    tokens = F.array_distinct(F.filter(F.transform(parts, seo_slug), lambda t: t != ""))
    prefixes = F.transform(
        tokens, lambda _t, i: F.array_join(F.slice(tokens, 1, i + 1), "-")
    )
    return F.coalesce(
        F.element_at(
            F.concat(F.array(F.lit("")), F.filter(prefixes, lambda p: F.length(p) <= max_length)),
            -1,
        ),
        F.lit(""),
    )


def valid_seo_keyword(col: Column) -> Column:
    return normalize_spaces(col).rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def meta_title(parts: Column, suffix: str = "", max_chars: int = 65) -> Column:
    """Title from ``array<struct<value, required, priority>>`` kept in its order.

    Optional parts go one by one, highest priority number first, until the title with
    its suffix fits. Required parts always stay. Repeated values count once.
    """
    clean = F.filter(
        F.transform(
            parts,
            lambda p: bind(
                normalize_spaces(p["value"]),
                lambda v: F.struct(
                    v.alias("value"), fold_case(v).alias("key"), p["required"].alias("required"),
                    p["priority"].alias("priority"),
                ),
            ),
        ),
        lambda p: p["value"] != "",
    )

    def once(found: Column) -> Column:
        keys = F.transform(found, lambda p: p["key"])
        return F.filter(found, lambda p, i: F.array_position(keys, p["key"]) == i + 1)

    def with_removal(kept: Column) -> Column:
        optional = F.filter(kept, lambda p: ~p["required"])
        # Order of removal: larger priority number first, earlier part first among equals.
        removal = F.array_sort(
            F.transform(optional, lambda p, i: F.struct(-p["priority"], i.alias("i"), p["key"].alias("key")))
        )
        return F.struct(kept.alias("parts"), F.transform(removal, lambda r: r["key"]).alias("removal"))

    def titles(x: Column) -> Column:
        def without(dropped: Column) -> Column:
            gone = F.slice(x["removal"], F.lit(1), dropped)
            left = F.filter(x["parts"], lambda p: ~F.array_contains(gone, p["key"]))
            return F.array_join(F.transform(left, lambda p: p["value"]), " ")

        return F.transform(F.sequence(F.lit(0), F.size(x["removal"])), without)

    def choose(steps: Column) -> Column:
        fitting = F.filter(steps, lambda t: F.length(t) + len(suffix) <= max_chars)
        return F.coalesce(F.get(fitting, F.lit(0)), F.element_at(steps, -1))

    steps = bind(bind(bind(clean, once), with_removal), titles)
    return bind(
        bind(steps, choose), lambda best: F.when(best != "", F.concat(best, F.lit(suffix))).otherwise(F.lit(""))
    )


def meta_title_status(title: Column) -> Column:
    length = F.length(normalize_spaces(title))
    return F.when(length <= 65, "pass").when(length <= 75, "warn").otherwise("fail")


def singular_stem(token: Column) -> Column:
    n = F.length(token)
    stem = (
        F.when(n <= 3, token)
        .when((F.endswith(token, F.lit("εια")) | F.endswith(token, F.lit("ειο"))) & (n > 5),
              F.substring(token, F.lit(1), n - 1))
    )
    for ending in SINGULAR_ENDINGS:
        k = len(ending)
        stem = stem.when(
            F.endswith(token, F.lit(ending)) & (n > k + 2), F.substring(token, F.lit(1), n - k)
        )
    return stem.otherwise(token)


def keyword_key(col: Column) -> Column:
    return F.array_join(F.transform(words(match_key(col)), singular_stem), " ")


def meta_keywords(values: Column, brand: Column, mpn: Column) -> Column:
    """Brand, MPN, then the given keywords; later ones with the same stems are dropped."""
    ordered = F.filter(
        F.transform(F.concat(F.array(brand, mpn), values), normalize_spaces), lambda k: k != ""
    )
    keys = F.transform(ordered, keyword_key)
    return F.filter(ordered, lambda k, i: F.array_position(keys, keyword_key(k)) == i + 1)


# ---------------------------------------------------------------- text health
# How Windows-1253 shows the bytes that lead twice-encoded text. C3 is shown as
# a capital gamma; what follows it is one of the bytes 82, 83, 8E, 8F, or the bytes of a
# quotation mark that was encoded twice. A gamma before any other character is plain Greek.
DOUBLE_LEAD = "Γ"
DOUBLE_NEXT = ["‚", "ƒ", "\\u008e", "\\u008f", "Άβ‚¬"]


def text_issues(col: Column) -> Column:
    """Names of the encoding faults found in a text, in fixed order."""
    doubled = f"{DOUBLE_LEAD}(?:{'|'.join(DOUBLE_NEXT)})[^\\n]"
    flags = F.array(
        F.when(F.contains(col, F.lit("�")), "replacement_character"),
        F.when(col.rlike("[\\u0080-\\u009f]"), "c1_control_character"),
        F.when(col.rlike(doubled), "mojibake_pattern"),
        F.when(col.rlike("\\?{3,}") & ~F.contains(col, F.lit("http")), "question_mark_run"),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def word_list(col: Column) -> Column:
    """Lower-case words made of Latin or Greek letters and digits."""
    return F.regexp_extract_all(
        F.lower(col), F.lit("[0-9a-zA-Z\\u00c0-\\u024f\\u0370-\\u03ff\\u1f00-\\u1fff]+"), F.lit(0)
    )


def word_jaccard(left: Column, right: Column) -> Column:
    a, b = F.array_distinct(left), F.array_distinct(right)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def numbers_in(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
