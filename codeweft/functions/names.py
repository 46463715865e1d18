"""Names: canonical paths, symbol parts and folded spellings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(path: Column | str) -> Column:
    """A path in canonical form: forward slashes, lower case, single slashes, no slash at the end. Null stays null."""
    p = F.lower(F.translate(_col(path), "\\", "/"))
    return F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/$", "")


def canonical_name(name: Column | str) -> Column:
    """A qualified name with its path part, up to the first ``#``, in canonical form and the rest as it is."""
    n = _col(name)
    at = F.instr(n, "#")
    return F.when(at == 0, canonical(n)).otherwise(
        F.concat(canonical(F.substring(n, F.lit(1), at - 1)), F.substring(n, at, F.length(n)))
    )


def symbol_name(name: Column | str) -> Column:
    """The part after the first ``#``, or the whole name where it has none."""
    n = _col(name)
    at = F.instr(n, "#")
    return F.when(at == 0, n).otherwise(F.substring(n, at + 1, F.length(n)))


def file_part(name: Column | str) -> Column:
    """The part before the first ``#``."""
    return F.substring_index(_col(name), "#", 1)


def folded(c: Column | str) -> Column:
    """A type or tag in lower case without outer white space; spelling variants become equal. Null stays null."""
    return F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))


def blank(c: Column | str) -> Column:
    """True for null and for strings of white space only."""
    return F.coalesce(F.regexp_replace(_col(c), r"\s", "") == "", F.lit(True))


def ascii_fold(c: Column | str) -> Column:
    """ASCII-only lower case: letters outside ASCII keep their case."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
