"""Money text parsers and rounding rules. Every parser gives NULL for text it rejects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import collapse_spaces, trim_text

MONEY = "decimal(12,2)"
WIDE = "decimal(20,6)"


def greek_money(col: Column) -> Column:
    """``1.234,56 €`` style text: dots group thousands, the comma starts the cents."""
    text = F.replace(collapse_spaces(col), F.lit(" "), F.lit(" "))
    for sign in ("€", "β‚¬", "EUR"):
        text = F.replace(text, F.lit(sign), F.lit(""))
    text = F.trim(text)
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ok = text.rlike("^([0-9]{1,3}([.][0-9]{3})*(,[0-9]{2})?|[0-9]+(,[0-9]{2})?)$")
    return F.when(ok, plain.try_cast(WIDE))


def dot_decimal(col: Column) -> Column:
    """Plain non-negative decimal text; no comma, exponent or plus sign."""
    text = trim_text(col)
    return F.when(text.rlike("^(-0*[.]?0+|[0-9]+[.]?[0-9]*|[.][0-9]+)$"), text.try_cast(WIDE))


def dot_decimal_error(col: Column) -> Column:
    text = trim_text(col)
    return (
        F.when(text == "", "missing required row value: price")
        .when(dot_decimal(col).isNull(), "invalid input price format")
        .otherwise("")
    )


def lenient_decimal(col: Column) -> Column:
    """Currency signs and blanks dropped, comma read as the decimal point."""
    text = trim_text(col)
    for sign in ("EUR", "€", " "):
        text = F.replace(text, F.lit(sign), F.lit(""))
    return F.replace(text, F.lit(","), F.lit(".")).try_cast(WIDE)


def lenient_double(col: Column) -> Column:
    return F.replace(trim_text(col), F.lit(","), F.lit(".")).try_cast("double")


def lenient_int(col: Column) -> Column:
    value = lenient_double(col)
    return F.when(value.isNotNull() & ~F.isnan(value), value.try_cast("int"))


def last_euro_price(col: Column) -> Column:
    """Last price named in free text."""
    found = F.regexp_extract_all(
        F.regexp_replace(col, "[\\u00A0\\u202F\\u2007]", " "),
        F.lit("(?:[0-9]{1,3}(?:[.\\s][0-9]{3})+|[0-9]+)(?:[,.][0-9]{1,2})?"),
        F.lit(0),
    )
    digits = F.regexp_replace(F.try_element_at(found, F.lit(-1)), "[^0-9,.]", "")
    grouped = digits.rlike("^[0-9]+[.][0-9]{3}$") | digits.rlike("[.].*[.]")
    return (
        F.when(
            F.contains(digits, F.lit(",")),
            F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
        )
        .when(grouped, F.replace(digits, F.lit("."), F.lit("")))
        .otherwise(digits)
        .try_cast("double")
    )


def money_text(col: Column) -> Column:
    """Two decimals, half up; empty for a missing amount."""
    return F.coalesce(F.round(col.cast(WIDE), 2).cast(MONEY).cast("string"), F.lit(""))


def usable(price: Column) -> Column:
    """A price counts only when it is present and positive."""
    return F.coalesce(price > 0, F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` to four decimals; NULL for a missing or zero base."""
    ratio = part.cast(WIDE) * 100 / F.when(whole != 0, whole.cast(WIDE))
    return F.round(ratio, 4).cast("decimal(12,4)")


def share_percent(part: Column, whole: Column) -> Column:
    """Coverage in percent of counts, two decimals, half even; 0 when there is nothing to cover."""
    return F.when(
        whole > 0, F.bround(part.cast("double") * 100.0 / whole.cast("double"), 2)
    ).otherwise(F.lit(0.0))


def landed_price(item: Column, shipping: Column, explicit: Column) -> Column:
    """Struct of the landed price and where it came from."""
    return (
        F.when(
            usable(explicit), F.struct(explicit.cast(MONEY).alias("price"), F.lit("explicit").alias("source"))
        )
        .when(
            shipping.isNotNull(),
            F.struct(
                F.bround((item + shipping).cast(WIDE), 2).cast(MONEY).alias("price"),
                F.lit("computed").alias("source"),
            ),
        )
        .otherwise(F.struct(F.lit(None).cast(MONEY).alias("price"), F.lit("missing").alias("source")))
    )
