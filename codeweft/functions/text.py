"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_xml(c: Column) -> Column:
    """Ampersands, angle brackets and double quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_dot(c: Column) -> Column:
    """Backslashes and double quotes escaped."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def line_count(c: Column) -> Column:
    """Lines by line feeds: a trailing one starts another, empty, line."""
    return F.size(F.split(c, "\n", -1))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded half up on its exact decimal expansion."""
    return F.format_string(f"%.{digits}f", c)


def slug(c: Column) -> Column:
    """Lower case, other than letters and digits to single hyphens, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
