"""Degrees of nodes and counters of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_metrics(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, fan_in_dynamic, fan_out_dynamic) of every id with a calls or dynamic_calls edge.

    Each edge is counted at both ends in one pass over the edges; hot ends combine on the map side.
    """
    ends = edges.filter(F.col("edge_type").isin("calls", "dynamic_calls")).select(
        "edge_type", F.inline(F.array(F.struct(F.col("to_id").alias("id"), F.lit(True).alias("inward")), F.struct(F.col("from_id").alias("id"), F.lit(False).alias("inward"))))
    )
    static = F.col("edge_type") == "calls"
    inward = F.col("inward")
    return ends.filter("id is not null").groupBy("id").agg(
        F.count_if(static & inward).cast("int").alias("fan_in"),
        F.count_if(static & ~inward).cast("int").alias("fan_out"),
        F.count_if(~static & inward).cast("int").alias("fan_in_dynamic"),
        F.count_if(~static & ~inward).cast("int").alias("fan_out_dynamic"),
    )


def reconciled(nodes: DataFrame, edges: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Nodes with recomputed degrees, 0 where they have no edges; only ids in ``changed`` (id) if it is given."""
    names = ("fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic")
    fans = fan_metrics(edges).select("id", *[F.col(n).alias(f"_{n}") for n in names])
    new = {n: F.coalesce(f"_{n}", F.lit(0)) for n in names}
    if changed is not None:
        ids = changed.select("id").distinct()
        fans = fans.join(ids, "id", "left_semi")
        nodes = nodes.join(ids.withColumn("_changed", F.lit(True)), "id", "left")
        new = {n: F.when(F.col("_changed"), c).otherwise(F.col(n)) for n, c in new.items()}
    return nodes.join(fans, "id", "left").withColumns(new).drop(*[f"_{n}" for n in names], "_changed")


def call_counters(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count_if(F.col("edge_type") == "calls").alias("total_calls_count"),
        F.count_if(F.col("edge_type") == "dynamic_calls").alias("total_dynamic_calls_count"),
    )


def ledger(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The counters beside the sums of the stored degrees; a null degree counts 0."""
    sums = nodes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in ("fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic")])
    return call_counters(edges).crossJoin(F.broadcast(sums))  # one row each
