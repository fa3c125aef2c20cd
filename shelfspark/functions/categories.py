"""Category texts: assignments split by ``:::``, levels split by ``///``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import trim_text


def _levels(node: Column) -> Column:
    return F.filter(F.transform(F.split(node, "///"), trim_text), lambda part: part != "")


def deepest_levels(category: Column) -> Column:
    """Levels of the deepest assignment; of equal depth the last one counts."""
    paths = F.transform(F.split(trim_text(category), ":::"), _levels)
    depth = F.array_max(F.transform(paths, F.size))
    best = F.element_at(F.filter(paths, lambda p: F.size(p) == depth), -1)
    return F.when(trim_text(category) == "", F.array().cast("array<string>")).otherwise(best)


def level(levels: Column, position: int) -> Column:
    return F.coalesce(F.get(levels, F.lit(position - 1)), F.lit(""))


def assignment_paths(category: Column) -> Column:
    """Array of (depth, path) for every assignment of at least two levels; path up to three."""
    split = F.filter(
        F.transform(F.split(trim_text(category), ":::"), _levels), lambda p: F.size(p) >= 2
    )
    return F.transform(
        split,
        lambda p: F.struct(
            F.size(p).alias("depth"), F.array_join(F.slice(p, 1, 3), " > ").alias("path")
        ),
    )


def deepest_paths(category: Column) -> Column:
    """Distinct deepest paths in their order."""
    paths = assignment_paths(category)
    depth = F.array_max(F.transform(paths, lambda p: p["depth"]))
    return F.array_distinct(
        F.transform(F.filter(paths, lambda p: p["depth"] == depth), lambda p: p["path"])
    )


def serialize_category(parent: Column, leaf: Column, subs: Column) -> Column:
    """Parent, parent///leaf and parent///leaf///sub joined by ``:::``; empty without a leaf."""
    stem = F.concat_ws("///", parent, leaf)
    tails = F.transform(F.filter(subs, lambda s: s != ""), lambda s: F.concat_ws("///", stem, s))
    whole = F.array_join(F.array_distinct(F.concat(F.array(parent, stem), tails)), ":::")
    return F.when((parent != "") & (leaf != ""), whole).otherwise(F.lit(""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Short id that depends on the text only: prefix and 12 hex digits of its SHA-1."""
    text = F.concat_ws("::", *parts)
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12))
