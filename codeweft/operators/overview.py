"""Histograms, hotspots and cluster reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.arrays import has_tag, tags
from codeweft.operators.ranks import numbered
from codeweft.schema import METRICS


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each


def languages(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """Symbols of each language, files and sections aside, the most frequent first."""
    own = nodes.filter(~F.col("symbol_type").isin("file", "section")).groupBy("language").agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), F.asc_nulls_last("language")).limit(limit)


def layers(nodes: DataFrame) -> DataFrame:
    """Nodes of each layer tag."""
    return nodes.select(F.explode(tags()).alias("tag")).filter(F.col("tag").startswith("layer:")).groupBy("tag").agg(F.count("*").alias("n"))


def hotspots(nodes: DataFrame, metric: str, limit: int = 20, threshold: int | None = 0, symbol_type: str | None = None) -> DataFrame:
    """The highest nodes by a metric, ties by name and id."""
    if metric not in METRICS:
        raise ValueError(f"no metric: {metric}")
    if threshold is not None:
        nodes = nodes.filter(F.col(metric) >= threshold)
    if symbol_type:
        nodes = nodes.filter(F.col("symbol_type") == symbol_type)
    return nodes.select("id", "qualified_name", "symbol_type", metric).orderBy(F.desc(metric), "qualified_name", "id").limit(limit)


def overview_hotspots(nodes: DataFrame, limit: int = 8) -> DataFrame:
    own = nodes.filter((F.col("fan_in") > 0) & ~F.col("symbol_type").isin("file", "section"))
    return own.select("id", "qualified_name", "symbol_type", "fan_in").orderBy(F.desc("fan_in"), "qualified_name", "id").limit(limit)


def entry_points(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.filter(has_tag("tags", "trait:entrypoint")).select("id", "qualified_name").orderBy("id").limit(limit)


def sections(nodes: DataFrame, limit: int = 20) -> DataFrame:
    return nodes.filter("symbol_type = 'section'").select("id", "qualified_name").orderBy("qualified_name", "id").limit(limit)


def clusters_by_name(clusters: DataFrame, limit: int = 10) -> DataFrame:
    return clusters.select("id", "name", "cluster_type", "avg_complexity").orderBy("name", "id").limit(limit)


def cluster_sizes(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every cluster with its number of nodes, 0 if it has none."""
    own = nodes.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return clusters.join(own, clusters.id == own.cluster_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("node_count"))


def cluster_profiles(nodes: DataFrame) -> DataFrame:
    """Complexity, degrees, central symbol and type of each cluster of nodes (cluster_id, id, ...).

    A complexity of 0 or null counts as 1. The central symbol has the largest fan_out * complexity, the lowest id on ties.
    A cluster is a utility if calls come in more than twice as often as they go out, core if it calls out more than five
    times and is complex on average, else a domain.
    """
    cc = F.when(F.coalesce("cyclomatic", F.lit(0)) == 0, 1).otherwise(F.col("cyclomatic"))
    ins, outs = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
    own = nodes.filter("cluster_id is not null").groupBy("cluster_id").agg(
        F.count("*").alias("node_count"),
        F.avg(cc).alias("avg_complexity"),
        F.sum(ins).alias("sum_in"),
        F.sum(outs).alias("sum_out"),
        F.max_by("qualified_name", F.struct(outs * cc, -F.col("id"))).alias("central_symbol_qname"),
    )
    kind = F.when(F.col("sum_in") > 2 * F.col("sum_out"), "utility").when((F.col("sum_out") > 5) & (F.col("avg_complexity") > 5), "core")
    return own.withColumn("cluster_type", F.coalesce(kind, F.lit("domain")))


def named_clusters(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels (id, label) of a clustering to numbered clusters with profiles and names.

    Clusters are numbered from 1 by their lowest id; one of a single node is dropped unless the node is a file, but keeps
    its number.
    """
    own = nodes.join(labels, "id")
    firsts = own.groupBy("label").agg(F.min("id").alias("first"), F.count("*").alias("size"), F.max("symbol_type").alias("any_type"))
    at = numbered(firsts, "first").withColumn("number", F.col("place") + 1)
    kept = at.filter((F.col("size") > 1) | (F.col("any_type") == "file")).select("label", "number")
    rows = own.join(kept, "label").withColumn("cluster_id", F.col("number").cast("long"))
    return cluster_profiles(rows).withColumn("name", F.concat(F.lit("cluster_"), "cluster_id", F.lit("_"), "cluster_type"))
