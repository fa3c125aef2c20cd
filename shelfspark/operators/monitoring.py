"""Price monitoring: observations, review rows, actions, alerts, selection, run health."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.money import (
    MONEY, WIDE, lenient_decimal, money_text, percent, share_percent, usable,
)
from shelfspark.functions.text import trim_text
from shelfspark.functions.timefn import parse_timestamp
from shelfspark.operators.catalog import URL_STATUSES, is_atomic_model, labels
from shelfspark.operators.skew import first_row

PRICE_TOLERANCE = 0.05

# Column names that observation files use (fixed values, first present column counts).
MODEL_COLUMNS = ["model", "sku", "product_model"]
MPN_COLUMNS = ["mpn", "manufacturer_part_number", "matched_mpn"]
COMPETITOR_PRICE_SUFFIXES = ["_price", "_best_store_price", "_next_store_price"]
COMPETITOR_PRICE_COLUMNS = [
    "competitor_price", "fetched_price", "source_price", "marketplace_price", "best_price",
    "observed_price", "price_found", "target_price", "bestprice_price",
    "bestprice_best_store_price", "bestprice_next_store_price", "skroutz_price", "price",
]
OWN_PRICE_COLUMNS = [
    "own_price", "our_price", "current_price", "internal_price", "input_price",
    "original_price", "catalog_price",
]
SELLER_COLUMNS = [
    "seller", "store", "competitor", "shop", "competitor_name", "competitor_store",
    "marketplace", "bestprice_best_store", "bestprice_next_store",
]
URL_COLUMNS_BEFORE_SOURCE = ["url", "product_url", "source_url", "marketplace_url"]
URL_COLUMNS_AFTER_SOURCE = ["competitor_url", "skroutz_url", "bestprice_url"]


# ----------------------------------------------------------- file projection
def normalize_column(name: str) -> str:
    text = re.sub(r"[\s-]", "_", name.strip().casefold())
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "_", text)).strip("_")


def project_observations(
    rows: DataFrame, run_id: str, catalog_source: str, source: str, default_observed_at: Column
) -> DataFrame:
    """Observation file rows to typed observations.

    The first column present under one of the known names is used, even where it is
    empty. Rows without model and MPN keep only a warning. Positive delta means that
    our own price is the higher one.
    """
    names: dict[str, str] = {}
    for column in rows.columns:
        names.setdefault(normalize_column(column), column)

    def first_name(aliases: Sequence[str]) -> str | None:
        return next((a for a in aliases if a in names), None)

    def text(aliases: Sequence[str]) -> Column:
        found = first_name(aliases)
        return trim_text(F.col(f"`{names[found]}`")) if found else F.lit("")

    row_source = text(["source", "marketplace"])
    resolved = F.lower(F.when(row_source != "", row_source).otherwise(F.lit(source)))
    key = F.regexp_replace(F.regexp_replace(resolved, "[^0-9a-z]+", "_"), "^_+|_+$", "")

    # Columns named after the row's own source come before the common names.
    competitor, by_source = None, []
    for suffix in COMPETITOR_PRICE_SUFFIXES:
        by_source += [
            (key == n.removesuffix(suffix), n) for n in names if n.endswith(suffix) and n != suffix
        ]
    common = first_name(COMPETITOR_PRICE_COLUMNS)
    competitor = F.col(f"`{names[common]}`") if common else F.lit("")
    uses_price = F.lit(common == "price")
    for cond, name in reversed(by_source):
        competitor = F.when(cond, F.col(f"`{names[name]}`")).otherwise(competitor)
        uses_price = F.when(cond, F.lit(False)).otherwise(uses_price)
    own_name = first_name(OWN_PRICE_COLUMNS)
    own = trim_text(F.col(f"`{names[own_name]}`")) if own_name else F.lit("")
    if own_name is None and "price" in names:
        own = F.when(~uses_price, trim_text(F.col(f"`{names['price']}`"))).otherwise(F.lit(""))
    url = text([*URL_COLUMNS_BEFORE_SOURCE])
    if first_name(URL_COLUMNS_BEFORE_SOURCE) is None:
        url = text(URL_COLUMNS_AFTER_SOURCE)
        for n in names:
            if n.endswith("_url"):
                url = F.when(key == n.removesuffix("_url"), trim_text(F.col(f"`{names[n]}`"))).otherwise(url)

    competitor_text = trim_text(competitor)
    competitor_price, own_price = lenient_decimal(competitor), lenient_decimal(own)
    blank = lambda c: F.nullif(c, F.lit(""))
    model, mpn = text(MODEL_COLUMNS), text(MPN_COLUMNS)
    given_delta = lenient_decimal(text(["price_delta", "delta"]))
    given_percent = lenient_decimal(text(["price_delta_percent", "delta_percent"]))
    skipped = (model == "") & (mpn == "")
    currency = text(["currency"])
    typed = rows.select(
        *[c for c in rows.columns if normalize_column(c) in ("row_no",)],
        F.lit(run_id).alias("run_id"),
        F.lit(catalog_source).alias("catalog_source"),
        resolved.alias("source"),
        blank(model).alias("model"),
        blank(mpn).alias("mpn"),
        blank(text(["name", "product_name", "title"])).alias("product_name"),
        blank(text(SELLER_COLUMNS)).alias("competitor_name"),
        competitor_price.cast(MONEY).alias("competitor_price"),
        F.when(currency != "", currency).otherwise("EUR").alias("currency"),
        blank(text(["availability", "stock_status", "status"])).alias("availability"),
        blank(url).alias("product_url"),
        own_price.cast(MONEY).alias("own_price"),
        F.coalesce(given_delta, own_price - competitor_price).cast(MONEY).alias("price_delta"),
        given_percent.alias("_percent"),
        F.coalesce(
            parse_timestamp(text(["observed_at", "created_at", "timestamp"])), default_observed_at
        ).alias("observed_at"),
        labels(
            (skipped, "missing model and MPN"),
            (~skipped & (competitor_text != "") & competitor_price.isNull(), "malformed competitor_price"),
            (~skipped & (own != "") & own_price.isNull(), "malformed own_price"),
        ).alias("warnings"),
    )
    return typed.withColumn(
        "price_delta_percent",
        F.coalesce(F.col("_percent"), percent(F.col("price_delta"), F.col("own_price"))).cast("decimal(12,4)"),
    ).drop("_percent")


def with_delta(observations: DataFrame) -> DataFrame:
    """Fill a missing delta and delta percent from the own and competitor price."""
    delta = F.coalesce(F.col("price_delta"), F.col("own_price") - F.col("competitor_price"))
    filled = observations.withColumn("price_delta", delta.cast(MONEY))
    return filled.withColumn(
        "price_delta_percent",
        F.coalesce(F.col("price_delta_percent"), percent(F.col("price_delta"), F.col("own_price"))),
    )


def backfill_own_price(observations: DataFrame, products: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Own price from the matched product, else from the run's snapshot by model, then MPN."""
    by_id = products.select("product_id", F.col("current_price").alias("_p"))

    def snapshot(key: str, name: str) -> DataFrame:
        known = snapshots.where(F.col(key).isNotNull())
        picked = first_row(known, ["run_id", key], [F.col("snapshot_id")], ["own_price"])
        return picked.select("run_id", key, F.col("own_price").alias(name))

    joined = (
        observations.join(by_id, "product_id", "left")
        .join(snapshot("model", "_m"), ["run_id", "model"], "left")
        .join(snapshot("mpn", "_n"), ["run_id", "mpn"], "left")
    )
    return with_delta(
        joined.withColumn("own_price", F.coalesce("own_price", "_p", "_m", "_n")).drop("_p", "_m", "_n")
    )


def fill_blank_fields(rows: DataFrame, run_input: DataFrame, fields: Sequence[str], seq: str) -> DataFrame:
    """Blank fields taken from the run input row of the same model, else of the same MPN."""

    def keyed(key: str, tag: str) -> DataFrame:
        named = run_input.withColumn("_k", trim_text(F.col(key))).where(F.col("_k") != "")
        return first_row(named, ["_k"], [-F.col(seq)], list(fields)).select(
            F.col("_k").alias(f"_{tag}"), F.struct(*fields).alias(tag)
        )

    model, mpn = trim_text(rows["model"]), trim_text(rows["mpn"])
    joined = rows.join(keyed("model", "by_model"), model == F.col("_by_model"), "left").join(
        keyed("mpn", "by_mpn"), mpn == F.col("_by_mpn"), "left"
    )
    source = F.coalesce("by_model", "by_mpn")
    filled = {
        f: F.when(
            (trim_text(F.col(f)) == "") & (trim_text(source[f]) != ""), source[f]
        ).otherwise(F.col(f))
        for f in fields
    }
    return joined.withColumns(filled).drop("_by_model", "by_model", "_by_mpn", "by_mpn")


def match_observations(observations: DataFrame, products: DataFrame) -> DataFrame:
    """Product of each observation: by source and model, else by source and MPN (lowest id)."""

    def keyed(key: str, name: str) -> DataFrame:
        return (
            products.where(F.col(key).isNotNull() & (F.col(key) != ""))
            .groupBy("catalog_source", key)
            .agg(F.min("product_id").alias(name))
        )

    joined = observations.join(keyed("model", "_m"), ["catalog_source", "model"], "left").join(
        keyed("mpn", "_n"), ["catalog_source", "mpn"], "left"
    )
    return joined.withColumns(
        {
            "matched_product_id": F.coalesce("_m", "_n"),
            "matched_by": F.when(F.col("_m").isNotNull(), "model").when(F.col("_n").isNotNull(), "mpn"),
        }
    ).drop("_m", "_n")


def timestamp_provenance(source: Column, quality: Column, **stamps: Column) -> Column:
    """Which timestamp an observation time came from, and whether it is exact or derived."""
    exact = ("parsed_at", "fetched_at", "captured_at")
    name = F.coalesce(
        *[F.when(stamps[n].isNotNull(), n) for n in (*exact, "imported_at") if n in stamps],
        F.lit("created_at"),
    )
    return F.struct(
        F.coalesce(source, name).alias("source"),
        F.coalesce(quality, F.when(name.isin(*exact), "exact").otherwise("derived")).alias("quality"),
    )


def primary_observation(offers: DataFrame) -> DataFrame:
    """An offer read as the price observation of its product."""
    return offers.select(
        "product_id",
        "price",
        F.lit("EUR").alias("currency"),
        "availability",
        F.col("shipping").alias("shipping_cost"),
        F.col("store").alias("seller_name"),
        F.lit("offer_observation_primary_bridge").alias("persistence_source"),
    )


# -------------------------------------------------------------------- filters
def observation_predicates(
    run_id=None, source=None, catalog_source=None, model=None, mpn=None, product_id=None,
    match_status=None, include_unmatched: bool = True,
) -> list[Column]:
    wanted = {
        "run_id": run_id, "source": source, "catalog_source": catalog_source, "model": model,
        "mpn": mpn, "match_status": match_status,
    }
    out = [F.col(c) == value for c, value in wanted.items() if value]
    if product_id is not None:
        out.append(F.col("product_id") == product_id)
    if not match_status and not include_unmatched:
        out.append(F.col("match_status") == "matched")
    return out


def filter_all(df: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    for p in predicates:
        df = df.where(p)
    return df


def latest_attempt(observations: DataFrame) -> DataFrame:
    """Observations of the newest attempt of their run."""
    newest = observations.groupBy("run_id").agg(F.max("created_at").alias("created_at"))
    return observations.join(newest, ["run_id", "created_at"], "left_semi")


def newest_first(observations: DataFrame, limit: int, offset: int = 0, time: str = "created_at") -> DataFrame:
    return observations.orderBy(F.desc(time), F.desc("observation_id")).offset(offset).limit(limit)


def attempt_counts(observations: DataFrame) -> DataFrame:
    """Matched and unmatched observations of the newest attempt of every run."""
    return latest_attempt(observations).groupBy("run_id").agg(
        F.count_if(F.col("match_status") == "matched").alias("matched"),
        F.count_if(F.col("match_status") == "unmatched").alias("unmatched"),
    )


def refetch_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next attempt number of each run and how many observations it replaces."""
    before = latest_attempt(stored).groupBy("run_id").agg(
        F.max("attempt").alias("_last"), F.count(F.lit(1)).alias("replaced")
    )
    new = incoming.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(F.col("match_status") == "matched").alias("matched"),
        F.count_if(F.col("match_status") == "unmatched").alias("unmatched"),
    )
    return new.join(before, "run_id", "left").select(
        "run_id", "observation_count", "matched", "unmatched",
        F.coalesce("replaced", F.lit(0)).alias("replaced_observation_count"),
        (F.coalesce("replaced", F.lit(0)) > 0).alias("was_refetch"),
        (F.coalesce("_last", F.lit(0)) + 1).alias("fetch_attempt"),
    )


def best_observation(observations: DataFrame, key: str, seq: str) -> DataFrame:
    """Best observation per key: a valid price first, then the lowest, then input order."""
    valid = usable(F.col("competitor_price"))
    order = [~valid, F.when(valid, F.col("competitor_price")), F.col(seq)]
    return first_row(observations.where(F.col(key).isNotNull()), [key], order)


def observations_for_input(run_input: DataFrame, observations: DataFrame, seq: str) -> DataFrame:
    """Run input rows with their best observation by model, else by MPN."""
    fields = ["observation_id", "competitor_price", "competitor_name", "product_url", "source"]

    def best(key: str, tag: str) -> DataFrame:
        picked = best_observation(observations, key, seq)
        return picked.select(F.col(key).alias(f"_{tag}"), F.struct(*fields).alias(tag))

    joined = run_input.join(
        best("model", "by_model"), F.col("model") == F.col("_by_model"), "left"
    ).join(best("mpn", "by_mpn"), F.nullif(F.col("mpn"), F.lit("")) == F.col("_by_mpn"), "left")
    source = F.coalesce("by_model", "by_mpn")
    return joined.select(
        *run_input.columns, *[source[f].alias(f) for f in fields],
        F.when(F.col("by_model").isNotNull(), "model").when(F.col("by_mpn").isNotNull(), "mpn").alias("matched_by"),
    )


# --------------------------------------------------------------------- review
def review_rows(rows: DataFrame) -> DataFrame:
    """Review row per product from its own price and its best and next store.

    Expects ``model, current_price, best_store, best_price, best_url, next_store,
    next_price, next_url`` and an optional ``competitor_price`` used without listings.
    """
    price = F.col("current_price")
    fallback = F.col("competitor_price") if "competitor_price" in rows.columns else F.lit(None)
    competitor = F.coalesce(F.col("best_price"), fallback).cast(MONEY)
    own_ok, comp_ok = usable(price), usable(competitor)
    near_best = F.coalesce(
        F.abs(price - F.col("best_price")) <= F.lit(PRICE_TOLERANCE).cast(MONEY), F.lit(False)
    )
    next_basis = F.col("next_price").isNotNull() & near_best
    both = own_ok & comp_ok
    delta = F.when(both, price - F.when(next_basis, F.col("next_price")).otherwise(competitor))
    basis = F.when(both & next_basis, "next_store").when(both, "best_competitor")
    delta_percent = percent(delta, price)
    recommended = F.when(~comp_ok | price.isNull() | (price <= competitor), "ignore").otherwise("match_price")
    return rows.withColumns(
        {
            "price_delta": delta.cast(MONEY),
            "price_delta_percent": delta_percent,
            "delta_basis": basis,
            "next_store_delta": F.when(basis == "next_store", delta).cast(MONEY),
            "recommended_action": recommended,
            "status": F.when(comp_ok, "review_required").otherwise("not_exportable"),
            "warnings": labels(
                (~is_atomic_model(F.col("model")), "composite_or_invalid_model"),
                (~own_ok, "missing_or_invalid_current_price"),
                (~comp_ok, "missing_or_invalid_competitor_price"),
            ),
            "competitor_price": F.when(comp_ok, competitor),
        }
    )


def review_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("review_required", "not_exportable", "exportable", "ignored")
        ],
    )


def check_actions(actions: DataFrame, rows: DataFrame) -> DataFrame:
    """Actions with the first reason they are refused, NULL when they can be applied."""
    selected, amount = F.col("selected_action"), F.col("undercut_amount")
    repeated = actions.groupBy("model").agg(F.count(F.lit(1)).alias("_times"))
    known = rows.select("model", F.col("competitor_price").alias("_price"), F.lit(True).alias("_known"))
    target = F.when(selected == "match_price", F.col("_price")).when(
        selected == "undercut", F.col("_price") - amount
    )
    reason = (
        F.when(F.col("model") == "", "model is required")
        .when(selected == "", "selected_action is required")
        .when(~selected.isin("match_price", "undercut", "ignore"), "unsupported action")
        .when((selected == "undercut") & amount.isNull(), "undercut_amount is required")
        .when((selected == "undercut") & (amount <= 0), "undercut_amount must be positive")
        .when(F.col("_times") > 1, "duplicate action")
        .when(F.col("_known").isNull(), "unknown model")
        .when(~is_atomic_model(F.col("model")), "non-atomic model")
        .when((selected != "ignore") & ~usable(F.col("_price")), "no valid competitor price")
        .when((selected != "ignore") & ~usable(target), "target price not positive")
    )
    return (
        actions.join(repeated, "model")
        .join(known, "model", "left")
        .select(*actions.columns, reason.alias("reject_reason"))
    )


def apply_actions(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Review rows with accepted actions, target price and new status."""
    accepted = checked.where(F.col("reject_reason").isNull()).select(
        "model", "selected_action", "undercut_amount"
    )
    joined = rows.join(accepted, "model", "left")
    selected = F.col("selected_action")
    target = F.when(selected == "match_price", F.col("competitor_price")).when(
        selected == "undercut", F.col("competitor_price") - F.col("undercut_amount")
    )
    return joined.withColumns(
        {
            "target_price": F.round(target.cast(WIDE), 2).cast(MONEY),
            "status": F.when(selected == "ignore", "ignored")
            .when(selected.isNotNull(), "exportable")
            .otherwise(F.col("status")),
        }
    )


def recommended_actions(rows: DataFrame) -> DataFrame:
    """Action state that accepts every recommendation in one go."""
    action = F.col("recommended_action")
    ok = action.isin("match_price", "undercut", "ignore") & (
        (F.col("status") != "not_exportable") | (action == "ignore")
    )
    return rows.select(
        "model",
        F.when(ok, action).otherwise("").alias("selected_action"),
        F.when(ok & (action == "ignore"), "manual ignore from price review").otherwise("").alias("reason"),
    )


def export_rows(reviewed: DataFrame, ignored: DataFrame) -> DataFrame:
    """Model and two-decimal price of the rows that may be published."""
    ready = reviewed.where(
        F.col("selected_action").isin("match_price", "undercut")
        & is_atomic_model(F.col("model"))
        & usable(F.col("target_price"))
    )
    return ready.join(ignored.select("model"), "model", "left_anti").select(
        "model", money_text(F.col("target_price")).alias("price")
    )


# --------------------------------------------------------------------- alerts
def validate_alert_rules(rules: DataFrame) -> DataFrame:
    """Rules with the reason they are refused, NULL when valid."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    target = F.col("product_id").isNotNull() | (has("catalog_source") & (has("model") | has("mpn")))
    reason = (
        F.when(F.col("rule_type") != "competitor_below_own_price", "unsupported rule_type")
        .when(~target, "rule target missing")
        .when(F.col("threshold_amount") <= 0, "threshold_amount must be positive")
        .when(F.col("threshold_percent") <= 0, "threshold_percent must be positive")
    )
    return rules.withColumn("reject_reason", reason)


def alert_pairs(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Observations with the rules that watch them.

    A rule with a product id looks at nothing else; without one it goes by source and
    model, else by source and MPN. Each shape is its own equality join.
    """
    r = rules.select(
        "rule_id", "threshold_amount", "threshold_percent",
        F.col("product_id").alias("r_product"), F.col("catalog_source").alias("r_source"),
        F.col("model").alias("r_model"), F.col("mpn").alias("r_mpn"),
    )
    no_id = F.col("r_product").isNull()
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    by_id = observations.join(r.where(~no_id), F.col("product_id") == F.col("r_product"))
    by_model = observations.join(
        r.where(no_id & has("r_source") & has("r_model")),
        (F.col("catalog_source") == F.col("r_source")) & (F.col("model") == F.col("r_model")),
    )
    by_mpn = observations.join(
        r.where(no_id & has("r_source") & ~has("r_model") & has("r_mpn")),
        (F.col("catalog_source") == F.col("r_source")) & (F.col("mpn") == F.col("r_mpn")),
    )
    return by_id.unionByName(by_model).unionByName(by_mpn).drop(
        "r_product", "r_source", "r_model", "r_mpn"
    )


def alert_rows(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (rule, observation) pair that raises, with its dedupe key and message.

    Works on static and on streaming observations alike.
    """
    below = observations.where(F.col("competitor_price") < F.col("own_price")).withColumns(
        {"delta": (F.col("own_price") - F.col("competitor_price")).cast(MONEY)}
    )
    if "price_delta_percent" not in below.columns:
        below = below.withColumn("price_delta_percent", F.lit(None).cast("decimal(12,4)"))
    below = below.withColumn(
        "delta_percent",
        F.coalesce(F.col("price_delta_percent"), percent(F.col("delta"), F.col("own_price"))),
    )
    active = rules.where(F.col("active") & (F.col("rule_type") == "competitor_below_own_price"))
    pairs = alert_pairs(below, active).where(
        (F.col("threshold_amount").isNull() | (F.col("delta") >= F.col("threshold_amount")))
        & (F.col("threshold_percent").isNull() | (F.col("delta_percent") >= F.col("threshold_percent")))
    )
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    text = lambda c: F.col(c).cast("string")
    target = (
        F.when(F.col("product_id").isNotNull(), F.concat(F.lit("product:"), text("product_id")))
        .when(has("catalog_source") & has("model"), F.concat_ws(":", F.lit("catalog_model"), "catalog_source", "model"))
        .when(has("catalog_source") & has("mpn"), F.concat_ws(":", F.lit("catalog_mpn"), "catalog_source", "mpn"))
        .otherwise(F.concat(F.lit("observation:"), text("observation_id")))
    )
    label = F.coalesce(F.nullif("model", F.lit("")), F.nullif("mpn", F.lit("")), F.concat(F.lit("product "), text("product_id")))
    return pairs.withColumns(
        {
            "dedupe_key": F.concat(
                F.lit("alert_rule:"), text("rule_id"), F.lit("|run:"), F.col("run_id"), F.lit("|"),
                target, F.lit("|source:"), F.coalesce("source", F.lit("")),
            ),
            "message": F.concat(
                F.lit("Competitor price is below own price for "), label, F.lit(": own EUR "),
                money_text(F.col("own_price")), F.lit(" vs competitor EUR "),
                money_text(F.col("competitor_price")), F.lit("."),
            ),
        }
    )


def new_alert_events(observations: DataFrame, rules: DataFrame, existing: DataFrame) -> DataFrame:
    """One event per dedupe key that no stored event has; the first observation counts."""
    raised = alert_rows(observations, rules).select(
        "dedupe_key", "rule_id", "run_id", "observation_id", "product_id", "source",
        "competitor_price", "own_price", "delta", "delta_percent", "message",
    )
    first = first_row(raised, ["dedupe_key"], [F.col("observation_id")])
    fresh = first.join(existing.select("dedupe_key"), "dedupe_key", "left_anti")
    return fresh.withColumns({"severity": F.lit("warning"), "status": F.lit("open")})


def alert_evaluation(observations: DataFrame, rules: DataFrame, existing: DataFrame) -> DataFrame:
    """Counters of one evaluation: rules, pairs looked at, raised, created and duplicate events."""
    raised = alert_rows(observations, rules)
    keys = raised.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("n"))
    stored = existing.select("dedupe_key").distinct().withColumn("_old", F.lit(True))
    events = keys.join(stored, "dedupe_key", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raised"),
        F.count_if(F.col("_old").isNull()).alias("created_event_count"),
    )
    rule_counts = rules.where("active").agg(
        F.count(F.lit(1)).alias("evaluated_rule_count"),
        F.count_if(F.col("rule_type") != "competitor_below_own_price").alias("unsupported_rule_count"),
    )
    return events.select(
        rule_counts.select("evaluated_rule_count").scalar().alias("evaluated_rule_count"),
        rule_counts.select("unsupported_rule_count").scalar().alias("unsupported_rule_count"),
        "created_event_count",
        (F.col("raised") - F.col("created_event_count")).alias("duplicate_event_count"),
    )


def set_event_status(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events after acknowledge and resolve requests; the last request of an event counts."""
    last = requests.groupBy("dedupe_key").agg(F.max_by("status", "seq").alias("_to"))
    return events.join(last, "dedupe_key", "left").withColumn(
        "status", F.coalesce("_to", "status")
    ).drop("_to")


# ------------------------------------------------------------------ selection
def skip_reasons(products: DataFrame, ignored: DataFrame, excluded: DataFrame, include_ignored: bool = False) -> DataFrame:
    """Products with all reasons that keep them out of a monitoring run."""
    flag = lambda df, name: df.select(trim_text(F.col("model")).alias("model")).distinct().withColumn(name, F.lit(True))
    joined = products.join(flag(ignored, "_ignored"), "model", "left").join(
        flag(excluded, "_excluded"), "model", "left"
    )
    reasons = labels(
        (F.col("_excluded"), "explicitly_excluded"),
        (F.col("_ignored") & F.lit(not include_ignored), "ignored"),
        (~F.col("is_atomic_model"), "non_atomic_model"),
        (~F.col("status").eqNullSafe(1), "inactive"),
        (F.col("mpn") == "", "missing_mpn"),
        (~usable(F.col("price")), "missing_or_invalid_price"),
    )
    return joined.withColumn("reasons", reasons).drop("_ignored", "_excluded")


def skipped_by_reason(with_reasons: DataFrame) -> DataFrame:
    return (
        with_reasons.select(F.explode("reasons").alias("reason"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("products"))
    )


def product_url_coverage(selected: DataFrame, urls: DataFrame, sources: DataFrame, source: str | None = None) -> DataFrame:
    """URL counts per selected product; captured sources add active URLs not registered yet."""
    if source and source != "all":
        urls = urls.where(F.lower("source_name") == source)
        sources = sources.where(F.lower("source_name") == source)
    ids = selected.select("product_id")
    registered = urls.join(ids, "product_id", "left_semi").groupBy("product_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in URL_STATUSES]
    )
    extra = (
        sources.where("active").select("product_id", "url").distinct()
        .join(ids, "product_id", "left_semi")
        .join(urls.where(F.col("status") == "active").select("product_id", "url"), ["product_id", "url"], "left_anti")
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("_extra"))
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = selected.join(registered, "product_id", "left").join(extra, "product_id", "left")
    return joined.select(
        *selected.columns,
        (n("active") + n("_extra")).alias("active_urls"),
        *[n(s).alias(f"{s}_urls") for s in URL_STATUSES if s != "active"],
    ).withColumn("has_active_url", F.col("active_urls") > 0)


def coverage_totals(coverage: DataFrame) -> DataFrame:
    totals = coverage.agg(
        F.count(F.lit(1)).alias("selected_count"),
        F.count_if(F.col("has_active_url")).alias("with_active"),
        *[F.coalesce(F.sum(f"{s}_urls"), F.lit(0)).alias(f"{s}_urls") for s in URL_STATUSES],
    )
    return totals.withColumns(
        {
            "without_active": F.col("selected_count") - F.col("with_active"),
            "coverage_percent": share_percent(F.col("with_active"), F.col("selected_count")),
        }
    )


def coverage_gate(with_reasons: DataFrame, coverage: DataFrame) -> DataFrame:
    """Selection state per product: skipped with reasons, or selected when a URL is active."""
    ok = F.size("reasons") == 0
    joined = with_reasons.join(coverage.select("product_id", "has_active_url"), "product_id", "left")
    gate = F.when(ok & ~F.coalesce("has_active_url", F.lit(False)), F.array(F.lit("missing_active_source_url")))
    return joined.withColumn("reasons", F.coalesce(gate, "reasons")).withColumn(
        "selected", F.size("reasons") == 0
    ).drop("has_active_url")


# ----------------------------------------------------------------- run tables
def add_missing_snapshots(run_rows: DataFrame, snapshots: DataFrame, seq: str) -> DataFrame:
    """Snapshot rows to add: one per identity (model, else MPN), only for runs that have none."""
    blank = lambda c: F.nullif(trim_text(F.col(c)), F.lit(""))
    identity = F.coalesce(
        F.concat(F.lit("model:"), blank("model")), F.concat(F.lit("mpn:"), blank("mpn"))
    )
    new = run_rows.withColumn("identity", identity).where(F.col("identity").isNotNull())
    todo = new.join(snapshots.select("run_id").distinct(), "run_id", "left_anti")
    return first_row(todo, ["run_id", "catalog_source", "identity"], [F.col(seq)])


def price_history(observations: DataFrame, limit: int = 1000, **target) -> DataFrame:
    """Newest observations of one product or one model."""
    return newest_first(filter_all(observations, observation_predicates(**target)), limit)


def listings_of(listings: DataFrame, observations: DataFrame, limit: int = 5000) -> DataFrame:
    """Listings that belong to the given observations, cheapest first."""
    mine = listings.join(observations.select("observation_id"), "observation_id", "left_semi")
    return mine.orderBy(F.asc_nulls_last("price"), "rank", "listing_id").limit(limit)


def persistence_counts(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Per run: observations, matched, unmatched and alert events."""
    seen = observations.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("match_status") == "matched").alias("matched"),
        F.count_if(F.col("match_status") == "unmatched").alias("unmatched"),
    )
    raised = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("alert_events"))
    return seen.join(raised, "run_id", "left").withColumn(
        "alert_events", F.coalesce("alert_events", F.lit(0))
    )


def stale_jobs(jobs: DataFrame, now: Column, minutes: dict[str, int], default: int = 60) -> DataFrame:
    """Running jobs without a heartbeat for longer than their type allows."""
    limit = F.lit(default)
    for kind, value in minutes.items():
        limit = F.when(F.col("job_type") == kind, F.lit(value)).otherwise(limit)
    deadline = now - F.make_dt_interval(mins=limit)
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") <= deadline))


def job_backlog(jobs: DataFrame, now: Column, minutes: dict[str, int], default: int = 60) -> DataFrame:
    """Per job type: queued, running, oldest queued job and stale running jobs."""
    stale = stale_jobs(jobs, now, minutes, default).groupBy("job_type").agg(
        F.count(F.lit(1)).alias("stale")
    )
    counts = jobs.groupBy("job_type").agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.min(F.when(F.col("status") == "queued", F.col("heartbeat_at"))).alias("oldest_queued"),
    )
    return counts.join(stale, "job_type", "left").withColumn("stale", F.coalesce("stale", F.lit(0)))


def age_text(seconds: Column) -> Column:
    """Two largest units of an age: ``45s``, ``12m 5s``, ``3h 20m``, ``2d 3h``."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    day, hour = F.floor(s / 86400), F.floor(s % 86400 / 3600)
    minute, rest = F.floor(s % 3600 / 60), s % 60
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    return (
        F.when(seconds.isNull(), "unknown")
        .when(s >= 86400, two(day, "d", hour, "h"))
        .when(s >= 3600, two(hour, "h", minute, "m"))
        .when(s >= 60, two(minute, "m", rest, "s"))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )
