"""URL normal forms, hashes, hosts and shape rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.common import bind
from shelfspark.functions.text import trim_text

# Query parameters that only track a visit.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid",
]

# Shops a URL host belongs to, with and without "www.".
SOURCE_DOMAINS = {
    "electronet.gr": "electronet", "www.electronet.gr": "electronet",
    "skroutz.gr": "skroutz", "www.skroutz.gr": "skroutz",
    "bestprice.gr": "bestprice", "www.bestprice.gr": "bestprice",
    "public.gr": "public", "www.public.gr": "public",
    "kotsovolos.gr": "kotsovolos", "www.kotsovolos.gr": "kotsovolos",
    "plaisio.gr": "plaisio", "www.plaisio.gr": "plaisio",
}

def _with_parts(url: Column, use) -> Column:
    """``use(p)`` over scheme, host, port, path and query of a URL text."""

    def cut(text: Column) -> Column:
        plain = F.substring_index(text, "#", 1)
        head = F.substring_index(plain, "?", 1)
        scheme = F.substring_index(head, "://", 1)
        return F.struct(
            text.alias("text"), F.lower(scheme).alias("scheme"),
            F.substr(head, F.length(scheme) + 4).alias("rest"),
            F.substr(plain, F.length(head) + 2).alias("query"),
        )

    def split_rest(p: Column) -> Column:
        authority = F.substring_index(p["rest"], "/", 1)
        return F.struct(
            p["text"].alias("text"), p["scheme"].alias("scheme"), p["query"].alias("query"),
            F.lower(F.substring_index(authority, "@", -1)).alias("place"),
            F.substr(p["rest"], F.length(authority) + 1).alias("path"),
        )

    def split_port(p: Column) -> Column:
        has_port = F.contains(p["place"], F.lit(":")) & ~F.endswith(p["place"], F.lit("]"))
        port = F.when(has_port, F.substring_index(p["place"], ":", -1)).otherwise("")
        host = F.when(has_port, F.regexp_replace(p["place"], ":[^:]*$", "")).otherwise(p["place"])
        return F.struct(
            p["text"].alias("text"), p["scheme"].alias("scheme"), p["path"].alias("path"),
            p["query"].alias("query"), host.alias("host"), port.alias("port"),
        )

    whole = bind(trim_text(url), lambda t: bind(cut(t), lambda p: bind(split_rest(p), split_port)))
    return bind(whole, use)


def url_host(url: Column) -> Column:
    return _with_parts(url, lambda p: p["host"])


def url_path(url: Column) -> Column:
    return _with_parts(url, lambda p: p["path"])


def _error(p: Column) -> Column:
    return (
        F.when(p["text"] == "", "url_required")
        .when(~p["scheme"].isin("http", "https"), "unsupported_scheme")
        .when(p["host"] == "", "missing_host")
        .when(p["host"].rlike("\\s"), "malformed_host")
        .when((p["port"] != "") & ~p["port"].rlike("^[0-9]{1,5}$"), "invalid_port")
    )


def url_error(url: Column) -> Column:
    """Why a URL is refused; NULL when it is usable."""
    return _with_parts(url, _error)


def url_forms(url: Column) -> Column:
    """Struct of error, host and registry form, worked out together."""
    return _with_parts(
        url,
        lambda p: F.struct(
            _error(p).alias("error"), p["host"].alias("host"), _rebuild(p, p["path"]).alias("normalized")
        ),
    )


def _encode(text: Column) -> Column:
    """Form encoding that leaves ``~`` as it is and encodes ``*``."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _clean_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^[^=]*", 0)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(F.trim(p["k"])).isin(TRACKING_PARAMS))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def _rebuild(p: Column, path: Column) -> Column:
    query = F.when(p["query"] != "", _clean_query(p["query"])).otherwise("")
    port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"].try_cast("int").cast("string")))
    whole = F.concat(
        p["scheme"], F.lit("://"), p["host"], F.coalesce(port, F.lit("")), path,
        bind(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")),
    )
    return F.when(_error(p).isNull(), whole)


def normalize_url(url: Column) -> Column:
    """Registry form: lower scheme and host, no fragment, no tracking; path untouched."""
    return _with_parts(url, lambda p: _rebuild(p, p["path"]))


def canonical_url(url: Column) -> Column:
    """Capture form: as ``normalize_url`` and without trailing slashes."""
    return _with_parts(url, lambda p: _rebuild(p, F.regexp_replace(p["path"], "/+$", "")))


def canonical_url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def source_name(url: Column) -> Column:
    """Shop a URL belongs to, ``unknown`` for any other host."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_DOMAINS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, url_host(url)), F.lit("unknown"))


# ------------------------------------------------------------- shape rules
def redirect_path(url_or_slug: Column) -> Column:
    """Path part of a URL, or the slug with one leading slash; empty for no value."""
    text = trim_text(url_or_slug)
    path = F.when(text.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url_path(text)).otherwise(text)
    clean = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(clean != "", F.concat(F.lit("/"), clean)).otherwise(F.lit(""))


REVIEW_TITLE = "(?iu)(\\breview\\b|Αξιολόγησε|Αξιολογήστε)"
NON_PRODUCT_WORDS = "(?i)(collection|promo|campaign|banner)"
# Path parts of pages that list, sell or explain, but show no single product.
NON_PRODUCT_PATHS = [
    "/search", "/category", "/categories", "/cat/", "/cart", "/checkout", "/account",
    "/login", "/blog", "/compare", "/wishlist", "/discussion",
]


def without_query(url: Column) -> Column:
    """Lower scheme and host plus path; empty for a text that is no URL."""
    plain = _with_parts(
        url,
        lambda p: F.concat(
            p["scheme"], F.lit("://"), p["host"],
            F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""), p["path"],
        ),
    )
    return F.when(url_host(url) != "", plain).otherwise("")


def url_rejection(url: Column) -> Column:
    """Why a URL is no product page by its words; empty when nothing speaks against it."""
    path = F.regexp_replace(F.coalesce(F.try_url_decode(url_path(url)), url_path(url)), "/+$", "")
    words = F.coalesce(F.try_url_decode(url), url)
    return (
        F.when(F.lower(path).rlike("(/|^)review$"), "url_ends_with_review")
        .when(words.rlike(NON_PRODUCT_WORDS), "url_contains_non_product_marker")
        .otherwise("")
    )


def page_rejection(candidate: Column, canonical: Column, title: Column) -> Column:
    by_candidate, by_canonical = url_rejection(candidate), url_rejection(canonical)
    return (
        F.when(by_candidate != "", F.concat(F.lit("candidate_"), by_candidate))
        .when(by_canonical != "", F.concat(F.lit("canonical_"), by_canonical))
        .when(title.rlike(REVIEW_TITLE), "title_contains_review_marker")
        .otherwise("")
    )


def is_product_url(url: Column, domain: Column, allow: Column, block: Column) -> Column:
    """Does a URL have the shape of a product page of its source?

    ``allow`` and ``block`` are the source's patterns joined by ``|``; an empty block
    pattern blocks nothing.
    """
    host, plain = url_host(url), without_query(url)
    same_host = (host == F.lower(domain)) | (host == F.regexp_replace(F.lower(domain), "^www[.]", ""))
    blocked = (block != "") & F.regexp(plain, F.concat(F.lit("(?i)"), block))
    allowed = F.regexp(plain, F.concat(F.lit("(?i)"), allow))
    return same_host & (url_rejection(url) == "") & ~blocked & allowed


def looks_like_product_path(path: Column) -> Column:
    low = F.lower(F.trim(path))
    listed = F.lit(False)
    for part in NON_PRODUCT_PATHS:
        listed = listed | F.contains(low, F.lit(part))
    return ~low.isin("", "/") & ~listed
