"""Latent policies: which tags depend on which, with support and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import fixed

# The edge types that count as dependencies here.
EDGES = ("calls", "dynamic_calls", "inherits", "implements", "depends_on")


def latent_policies(nodes: DataFrame, edges: DataFrame, threshold: float = 0.9, min_count: int = 5, types: tuple[str, ...] = EDGES) -> DataFrame:
    """(from_tag, to_tag, count, total, probability, description) of the pairs that reach both thresholds.

    An edge counts if both ends have a tag array, be it empty; each tag of its source adds to that tag's total, each pair
    of tags to the pair's count. Edges are first counted per pair of tag arrays, which are few, and only those exploded.
    """
    own = nodes.filter("tags is not null").select("id", F.array_sort(F.array_distinct("tags")).alias("tags"))
    ends = edges.filter(F.col("edge_type").isin(*types)).select("from_id", "to_id")
    ends = ends.join(own.withColumnsRenamed({"id": "from_id", "tags": "f"}), "from_id").join(own.withColumnsRenamed({"id": "to_id", "tags": "t"}), "to_id")
    sets = ends.groupBy("f", "t").agg(F.count("*").alias("n"))
    source = sets.select(F.explode("f").alias("from_tag"), "t", "n")
    totals = source.groupBy("from_tag").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_count)
    pairs = source.select("from_tag", F.explode("t").alias("to_tag"), "n").groupBy("from_tag", "to_tag").agg(F.sum("n").alias("count"))
    share = F.col("count") / F.col("total")
    found = pairs.filter(F.col("count") >= min_count).join(totals, "from_tag").withColumn("probability", share).filter(F.col("probability") >= threshold)
    text = F.concat(
        F.lit("Implicit Policy: Components tagged '"), "from_tag", F.lit("' consistently depend on '"), "to_tag",
        F.lit("' ("), fixed(F.col("probability") * 100, 1), F.lit("% of cases)."),
    )
    return found.select("from_tag", "to_tag", "count", "total", "probability", text.alias("description"))
