"""Symbols that nothing seems to use, in tiers of certainty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.arrays import has_tag
from codeweft.functions.text import fixed


def candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no call reaches, with the flags ``high`` (private), ``medium`` (public, no class, interface or function) and
    ``low`` (medium and not internal).

    Files, tests, packages, constructors, entry points and abstract symbols aside, and everything inside a container that
    implements or inherits something: a caller may hold it by its supertype. Null tags are no tags, a null degree is 0.
    """
    heirs = edges.filter(F.col("edge_type").isin("implements", "inherits")).select("from_id").distinct()
    inside = edges.filter("edge_type = 'contains'").join(heirs, "from_id", "left_semi").select(F.col("to_id").alias("id"))
    own = nodes.filter(
        (F.coalesce("fan_in", F.lit(0)) == 0)
        & ~F.col("symbol_type").isin("file", "test", "package")
        & ~F.col("qualified_name").ilike("%#constructor")
        & ~has_tag("tags", "trait:entrypoint")
        & ~has_tag("tags", "trait:abstract")
    ).join(inside, "id", "left_anti")
    medium = (F.col("visibility") == "public") & ~F.col("symbol_type").isin("class", "interface", "function")
    medium = F.coalesce(medium, F.lit(False))
    return own.withColumns({"high": F.coalesce(F.col("visibility") == "private", F.lit(False)), "medium": medium, "low": medium & ~has_tag("tags", "trait:internal")})


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(total_symbols, high, medium, low, dead_symbols, ratio): low symbols are medium ones too and count twice in the sum."""
    dead = candidates(nodes, edges).agg(*[F.count_if(F.col(t)).alias(t) for t in ("high", "medium", "low")])
    both = nodes.agg(F.count("*").alias("total_symbols")).crossJoin(F.broadcast(dead))  # one row each
    sums = F.col("high") + F.col("medium") + F.col("low")
    ratio = F.when(F.col("total_symbols") == 0, "0.00%").otherwise(F.concat(fixed(sums / F.col("total_symbols") * 100, 2), F.lit("%")))
    return both.select("total_symbols", "high", "medium", "low", sums.alias("dead_symbols"), ratio.alias("ratio"))
