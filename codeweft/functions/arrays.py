"""Array and tag helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags(c: str | Column = "tags") -> Column:
    """A tag array with null read as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def has_tag(c: str | Column, tag: str) -> Column:
    """Exact membership; a null array has no tag."""
    return F.array_contains(tags(c), tag)


def has_tag_folded(c: str | Column, tag: str | Column) -> Column:
    """Membership whatever the letter case."""
    want = F.lower(F.lit(tag) if isinstance(tag, str) else tag)
    return F.exists(tags(c), lambda t: F.lower(t) == want)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays have the same members, order and repetition aside."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def present(*items: Column) -> Column:
    """The non-null items as an array, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*items)))
