"""Seller listings under a product: dedupe, rank, best and next store, fallback tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.common import bind
from shelfspark.functions.money import MONEY, landed_price, lenient_decimal, usable
from shelfspark.functions.text import fold_case
from shelfspark.operators.skew import exact_rank, first_row, top_rows

# Field names that captured payloads use for the parts of a listing (fixed values).
STORE_ALIASES = [
    "store", "store_name", "shop", "shop_name", "seller", "seller_name", "merchant",
    "merchant_name", "name", "title", "display_name",
]
PRICE_ALIASES = [
    "price", "final_price", "sale_price", "competitor_price", "price_found",
    "best_store_price", "amount", "value", "price_with_vat",
]
URL_ALIASES = [
    "url", "product_url", "shop_url", "seller_url", "store_url", "href", "link", "path",
    "web_uri", "relative_url",
]
SHIPPING_ALIASES = ["shipping_cost", "shipping", "delivery_cost", "shipping_price"]
LANDED_ALIASES = [
    "landed_price", "total_price", "final_total", "price_with_shipping", "total_with_shipping",
]
LISTING_COLLECTIONS = [
    "offers", "shops", "stores", "listings", "product_cards", "results", "items", "cards",
]


def _keyed(listings: DataFrame) -> DataFrame:
    """Priced listings with the key that makes two of them the same."""
    return listings.where(usable(F.col("price"))).withColumns(
        {
            "_store": fold_case(F.col("store")),
            "_price": F.round("price", 2),
            "_url": F.when(F.col("store") == "", fold_case(F.col("url"))).otherwise(F.lit("")),
        }
    )


def dedupe_listings(listings: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One listing per store and price, the one with a URL first; blank stores per price and URL."""
    no_url = (F.col("store") != "") & (F.col("url") == "")
    order = [no_url, *[F.col(c) for c in seq]]
    return first_row(_keyed(listings), [*keys, "_store", "_price", "_url"], order).drop("_price", "_url")


def rank_listings(listings: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Deduplicated listings numbered by price, store and URL within each product."""
    unique = dedupe_listings(listings, keys, seq)
    return exact_rank(unique, keys, ["price", "_store", "url"]).drop("_store")


def top_listings(listings: DataFrame, keys: Sequence[str], seq: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` ranked listings per product, without numbering the rest."""
    unique = dedupe_listings(listings, keys, seq)
    return top_rows(unique, keys, [F.col(c) for c in ("price", "_store", "url")], n).drop("_store")


def best_and_next(listings: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Best and next store per product, the top three, and how many listings there are."""
    needed = listings.select(*keys, "store", "price", "url", *seq)
    # The count needs the distinct keys only, not the rows behind them.
    counts = (
        _keyed(needed).select(*keys, "_store", "_price", "_url").distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("captured_listings_count"))
    )
    top = top_listings(needed, keys, seq, 3)

    def pick(column: str, rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    wide = top.groupBy(*keys).agg(
        *[
            pick(c, r).alias(f"{name}_{c}")
            for r, name in ((1, "best"), (2, "next"), (3, "third"))
            for c in ("store", "price", "url")
        ]
    )
    return wide.join(counts, list(keys)).withColumn(
        "listings_incomplete", F.col("captured_listings_count") < 3
    )


def rank_offers(offers: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Offers of a snapshot numbered by their own rank when any has one, else by price."""
    priced = offers.where(usable(F.col("price")))
    ranked_groups = priced.groupBy(*keys).agg(
        F.coalesce(F.max(F.col("raw_rank") > 0), F.lit(False)).alias("_has_rank")
    )
    given = F.when(F.col("raw_rank") > 0, F.col("raw_rank")).otherwise(F.lit(1_000_000))
    prepared = priced.join(ranked_groups, list(keys)).withColumns(
        {
            "_given": F.when(F.col("_has_rank"), given).otherwise(F.lit(0)),
            "_seller": fold_case(F.coalesce(F.col("seller_name"), F.lit(""))),
        }
    )
    order = ["_given", "price", "_seller", *tie]
    return exact_rank(prepared, keys, order).drop("_given", "_seller", "_has_rank")


def attach_offers(observations: DataFrame, offers: DataFrame, listed: DataFrame) -> DataFrame:
    """Offers that become listings of observations which have none yet.

    Offers meet observations on snapshot and product; source and vendor must agree only
    when the observation names them.
    """
    todo = observations.where(F.col("snapshot_id").isNotNull()).join(
        listed.select("observation_id").distinct(), "observation_id", "left_anti"
    )
    o = offers.select(
        "snapshot_id", "product_id", "offer_id", "seller_name", "price", "raw_rank",
        F.col("source_id").alias("_offer_source"), F.col("vendor_id").alias("_offer_vendor"),
    )
    agrees = (F.col("source_id").isNull() | (F.col("source_id") == F.col("_offer_source"))) & (
        F.col("vendor_id").isNull() | (F.col("vendor_id") == F.col("_offer_vendor"))
    )
    joined = todo.join(o, ["snapshot_id", "product_id"]).where(agrees)
    return rank_offers(joined.drop("_offer_source", "_offer_vendor"), ["observation_id"], ["offer_id"])


# ------------------------------------------------------------- raw payloads
def _key_map(item: Column) -> Column:
    """Field names reduced to lower-case letters and digits; the first of equal names stays."""
    entries = F.transform(
        F.map_entries(item),
        lambda e: F.struct(
            F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("key"), e["value"].alias("value")
        ),
    )
    # Bound, or the names of all fields would be reduced again for every field.
    return bind(entries, lambda es: bind(F.transform(es, lambda e: e["key"]), lambda names: F.map_from_entries(
        F.filter(es, lambda e, i: F.array_position(names, e["key"]) == i + 1))))


def _first_alias(fields: Column, aliases: Sequence[str]) -> Column:
    tried = [
        F.nullif(F.trim(F.try_element_at(fields, F.lit(a.replace("_", "")))), F.lit(""))
        for a in aliases
    ]
    return F.coalesce(*tried, F.lit(""))


def raw_listings(observations: DataFrame, raw: str = "raw_observation") -> DataFrame:
    """Listings named inside a captured JSON payload, one row each.

    Looks at the payload itself, at every collection of listings it holds, one level
    further down as well, and at numbered fields such as ``store_2`` / ``price_2``.
    """
    # A payload is read once and a listing's field names are reduced once; the listings without a
    # usable price go before they become rows.
    listed = bind(F.try_parse_json(F.col(raw)), lambda v: F.filter(
        F.transform(_named_items(v), lambda item, no: bind(_key_map(item), lambda f: _listing(f, no))),
        lambda found: usable(found["price"]),
    ))
    found = observations.select("*", F.explode(listed).alias("_l"))
    return found.withColumns({c: F.col(f"_l.{c}") for c in ("store", "price", "url", "listing_no", "landed")}).drop("_l")


def _named_items(v: Column) -> Column:
    """All objects of a payload that may be a listing, as maps of their fields."""
    kind = "array<map<string,string>>"
    none = F.array().cast(kind)
    top = F.try_variant_get(v, "$", "map<string,variant>")
    nested = F.transform(
        F.coalesce(F.map_values(top), F.array()),
        lambda child: F.flatten(F.array(*[F.coalesce(F.try_variant_get(child, f"$.{k}", kind), none) for k in LISTING_COLLECTIONS])),
    )
    collected = [F.try_variant_get(v, f"$.{k}", kind) for k in LISTING_COLLECTIONS]
    more = [F.coalesce(c, none) for c in (F.try_variant_get(v, "$", kind), *collected, F.flatten(nested))]
    return bind(F.try_variant_get(v, "$", "map<string,string>"), lambda own: F.concat(
        F.filter(F.concat(F.array(own), *more), lambda m: m.isNotNull()), numbered_fields(own)))


def _listing(fields: Column, no: Column) -> Column:
    """Store, price, address and landed price under the reduced names of one listing."""
    money = lambda aliases: lenient_decimal(_first_alias(fields, aliases))
    return bind(money(PRICE_ALIASES).cast(MONEY), lambda price: F.struct(
        _first_alias(fields, STORE_ALIASES).alias("store"), price.alias("price"), _first_alias(fields, URL_ALIASES).alias("url"),
        no.alias("listing_no"),
        bind(F.struct(money(SHIPPING_ALIASES).alias("s"), money(LANDED_ALIASES).alias("l")), lambda m: landed_price(price, m["s"], m["l"])).alias("landed"),
    ))


def numbered_fields(flat: Column) -> Column:
    """``store_1, price_1, url_1, store_2 ...`` of a flat payload's fields as one map per number."""
    key = lambda e: F.lower(e["key"])
    role = lambda e: (
        F.when(key(e).rlike("store|shop|merchant|seller") & ~key(e).rlike("price|url|link|href"), "store")
        .when(key(e).rlike("price|amount"), "price")
        .when(key(e).rlike("url|link|href"), "url")
    )
    number = lambda e: F.regexp_extract(e["key"], "(?:^|_)([0-9]+)(?:_|$)", 1)
    named = F.transform(F.map_entries(flat), lambda e: F.struct(number(e).alias("no"), e["key"].alias("key"), e["value"].alias("value")))
    numbered = F.transform(F.filter(named, lambda e: e["no"] != ""), lambda e: F.struct(e["no"].alias("no"), role(e).alias("role"), e["value"].alias("value")))
    entries = F.coalesce(numbered, F.array().cast("array<struct<no:string,role:string,value:string>>"))

    def one(mine: Column) -> Column:
        last = lambda r: F.coalesce(F.try_element_at(F.filter(mine, lambda e: e["role"] == r), F.lit(-1))["value"], F.lit(""))
        return F.create_map(F.lit("store"), last("store"), F.lit("price"), last("price"), F.lit("url"), last("url"))

    return bind(entries, lambda es: F.transform(
        F.array_distinct(F.transform(es, lambda e: e["no"])), lambda n: one(F.filter(es, lambda e: e["no"] == n))))


def lowest_tier(tiers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the first source that has any row for a product; later sources are dropped."""
    union = None
    for i, part in enumerate(tiers):
        tagged = part.withColumn("tier", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    # One pass: a group is what all sources say of one product. A row without its key belongs to none.
    lowest = F.min("tier").over(Window.partitionBy(*keys))
    kept = union.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    return kept.withColumn("_lowest", lowest).where("tier = _lowest").select(*keys, "tier", *[c for c in union.columns if c not in (*keys, "tier")])
