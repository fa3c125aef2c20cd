"""Repricing: rule families, rounding modes and row validation of enriched files."""

from __future__ import annotations

import re
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.money import WIDE, dot_decimal, dot_decimal_error
from shelfspark.functions.text import collapse_spaces, fold_case, trim_text

# Names a formula may use; all of them mean the observed price.
FORMULA_NAMES = ["skroutz_price", "bestprice_price", "observed_price"]
ROUNDING_MODES = ["keep_2dp", "floor", "ceil", "nearest", "minus_one_if_decimal_79_99"]

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


def formula_column(formula: str, observed: str) -> Column:
    """Arithmetic over the observed price column as a Spark expression.

    Only numbers, the price names, single ``+ - * /`` signs and parentheses are let
    through; Spark reads the checked text, with all numbers as decimals.
    """
    text = formula.strip()
    if not text:
        raise ValueError("formula must not be empty")
    out, pos = [], 0
    while pos < len(text):
        found = _TOKEN.match(text, pos)
        if not found:
            raise ValueError(f"unsupported text in pricing formula: {text[pos:]!r}")
        number, name, sign = found.groups()
        if name and name not in FORMULA_NAMES:
            raise ValueError(f"unknown name in pricing formula: {name}")
        if sign in ("*", "/") and out and out[-1] == sign:
            raise ValueError("unsupported operator in pricing formula")
        if number:
            out.append(f"CAST({number} AS {WIDE})")
        else:
            out.append(f"CAST(`{observed}` AS {WIDE})" if name else sign)
        pos = found.end()
    return F.expr(" ".join(out))


def _parameter(rule: Mapping[str, object], key: str) -> Column:
    value = rule.get(key)
    if value is None:
        raise ValueError(f"pricing rule parameter missing: {key}")
    return F.lit(Decimal(str(value))).cast(WIDE)


def store_positioning(
    observed: Column,
    best_store: Column,
    best_price: Column,
    next_price: Column,
    rule: Mapping[str, object],
) -> Column:
    """Stay when our store leads within the wanted gap, else undercut the next or the best."""
    own = rule.get("own_store")
    if not isinstance(own, str) or not own.strip():
        raise ValueError("pricing rule parameter missing: own_store")
    target, low, high = (_parameter(rule, k) for k in ("target_gap", "min_gap", "max_gap"))
    if Decimal(str(rule["min_gap"])) > Decimal(str(rule["max_gap"])):
        raise ValueError("min_gap must not exceed max_gap")
    key = lambda c: fold_case(collapse_spaces(c))
    current = F.coalesce(best_price, observed).cast(WIDE)
    gap = next_price.cast(WIDE) - current
    leads = key(F.coalesce(best_store, F.lit(""))) == key(F.lit(own))
    stay = next_price.isNull() | gap.between(low, high)
    return (
        F.when(leads & stay, current)
        .when(leads, next_price.cast(WIDE) - target)
        .otherwise(current - target)
    )


def raw_price(rule: Mapping[str, object], observed: str, **context: Column) -> Column:
    """Price of one rule family over the column ``observed``, before clamping and rounding."""
    family = rule.get("rule_family")
    price = F.col(observed).cast(WIDE)
    if family == "fixed_offset":
        return price + _parameter(rule, "offset")
    if family == "percentage_discount":
        return price * (F.lit(1).cast(WIDE) - _parameter(rule, "discount_percent") / 100)
    if family == "fixed_offset_with_floor":
        return F.greatest(price + _parameter(rule, "offset"), _parameter(rule, "floor"))
    if family == "formula_with_rounding":
        return formula_column(str(rule.get("formula") or ""), observed)
    if family == "bestprice_store_positioning":
        return store_positioning(price, rule=rule, **context)
    raise ValueError(f"unsupported rule_family: {family}")


def round_price(value: Column, mode: str) -> Column:
    """Rounded price as text. ``keep_2dp`` rounds half to even, ``nearest`` half up."""
    exact = value.cast("decimal(28,10)")
    whole = F.floor(exact)
    nearest = F.round(exact, 0).cast("decimal(20,0)").cast("string")
    if mode == "keep_2dp":
        return F.bround(exact, 2).cast("decimal(20,2)").cast("string")
    if mode == "floor":
        return whole.cast("decimal(20,0)").cast("string")
    if mode == "ceil":
        return F.ceil(exact).cast("decimal(20,0)").cast("string")
    if mode == "nearest":
        return nearest
    if mode == "minus_one_if_decimal_79_99":
        cents = exact - whole
        drop = cents.between(F.lit(Decimal("0.79")), F.lit(Decimal("0.99")))
        return F.when(drop, whole.cast("decimal(20,0)").cast("string")).otherwise(nearest)
    raise ValueError(f"unsupported rounding_mode: {mode}")


def new_price(rule: Mapping[str, object], observed: str, **context: Column) -> Column:
    """Final price text of a rule; a negative result becomes 0 before rounding."""
    value = raw_price(rule, observed, **context).cast("decimal(28,10)")
    clamped = F.when(value < 0, F.lit(0).cast("decimal(28,10)")).otherwise(value)
    return round_price(clamped, str(rule.get("rounding_mode") or "nearest"))


# ----------------------------------------------------------------- validation
def validate_input_rows(rows: DataFrame) -> DataFrame:
    """First reason a (model, mpn, price) row is unusable, and its parsed price."""
    text = {c: trim_text(F.col(c)) for c in ("model", "mpn", "price")}
    reason = (
        F.when(text["model"] == "", "missing required row value: model")
        .when(text["mpn"] == "", "missing required row value: mpn")
        .otherwise(dot_decimal_error(F.col("price")))
    )
    return rows.withColumns(
        {
            "error_reason": reason,
            "parsed_price": F.when(reason == "", dot_decimal(F.col("price"))),
        }
    )


def validate_enriched_rows(rows: DataFrame, price_col: str = "observed_price") -> DataFrame:
    """A row can be priced when it is matched and both prices read."""
    own, observed = dot_decimal(F.col("price")), dot_decimal(F.col(price_col))
    usable = (
        (trim_text(F.col("match_status")) == "matched")
        & own.isNotNull()
        & observed.isNotNull()
    )
    return rows.withColumns(
        {"parsed_price": own, "parsed_observed": observed, "is_usable": usable}
    )


def price_enriched_rows(rows: DataFrame, rule: Mapping[str, object], **context: Column) -> DataFrame:
    """Validated rows with ``new_price`` (blank when unusable) and the price to publish."""
    priced = F.when(F.col("is_usable"), new_price(rule, "parsed_observed", **context))
    return rows.withColumn("new_price", F.coalesce(priced, F.lit(""))).withColumn(
        "output_price", F.when(F.col("new_price") != "", F.col("new_price")).otherwise(F.col("price"))
    )


def pricing_summary(priced: DataFrame) -> DataFrame:
    return priced.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("is_usable")).alias("priced_rows"),
        F.count_if(~F.col("is_usable")).alias("blank_new_price_rows"),
    )
