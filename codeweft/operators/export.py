"""Text exports of a subgraph, one row a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import escape_dot, escape_xml

# The classes of the diagram and their styles.
STYLES = {
    "file": "fill:#fff,stroke:#333,stroke-width:1px,stroke-dasharray: 5 5",
    "class": "fill:#f9f,stroke:#333,stroke-width:2px",
    "interface": "fill:#9ff,stroke:#333,stroke-width:2px",
    "method": "fill:#bbf,stroke:#333,stroke-width:1px",
    "function": "fill:#dfd,stroke:#333,stroke-width:1px",
    "remote": "fill:#ffd,stroke:#f66,stroke-width:2px,stroke-dasharray: 5 5",
}


def _lines(spark, head: list[str], body: DataFrame, tail: list[str]) -> DataFrame:
    """(part, order_1, order_2, line): ordering by the first three gives the document."""
    kind = "part int, order_1 long, order_2 long, line string"
    first = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(head)], kind)
    last = spark.createDataFrame([(9, i, 0, x) for i, x in enumerate(tail)], kind)
    return first.unionByName(body).unionByName(last)


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A flowchart. Labels have the type and the last part of the name; remote nodes their project too."""
    short = F.element_at(F.split("qualified_name", "[#./]"), -1)
    remote = F.coalesce("remote_project_path", F.lit("")) != ""
    label = F.concat("symbol_type", F.lit(": "), short)
    label = F.when(remote, F.concat(F.lit("["), F.coalesce(F.try_element_at(F.split("qualified_name", ":"), F.lit(2)), F.lit("")), F.lit("] "), label)).otherwise(label)
    css = F.when(remote, ":::remote").when(F.col("symbol_type").isin(*[k for k in STYLES if k != "remote"]), F.concat(F.lit(":::"), "symbol_type")).otherwise("")
    own = nodes.select(F.lit(1).alias("part"), F.col("id").alias("order_1"), F.lit(0).cast("long").alias("order_2"), F.concat(F.lit("  N"), "id", F.lit('["'), label, F.lit('"]'), css).alias("line"))
    ways = edges.select(F.lit(2).alias("part"), F.col("from_id").alias("order_1"), F.col("id").alias("order_2"), F.concat(F.lit("  N"), "from_id", F.lit(" -- "), "edge_type", F.lit(" --> N"), "to_id").alias("line"))
    head = ["graph TD", *[f"  classDef {k} {v}" for k, v in STYLES.items()]]
    return _lines(nodes.sparkSession, head, own.unionByName(ways), [])


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    names = nodes.select("id", "qualified_name")
    out = edges.select("id", "from_id", "to_id")
    for side in ("from", "to"):
        out = out.join(names.withColumnsRenamed({"id": f"{side}_id", "qualified_name": side}), f"{side}_id")
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = nodes.select(F.lit(1).alias("part"), F.col("id").alias("order_1"), F.lit(0).cast("long").alias("order_2"), F.concat(F.lit('    <node id="'), escape_xml(F.col("qualified_name")), F.lit('"/>')).alias("line"))
    ways = _named(nodes, edges).select(
        F.lit(2).alias("part"), F.col("from_id").alias("order_1"), F.col("id").alias("order_2"),
        F.concat(F.lit('    <edge source="'), escape_xml(F.col("from")), F.lit('" target="'), escape_xml(F.col("to")), F.lit('"/>')).alias("line"),
    )
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/graphml">', '  <graph id="G" edgedefault="directed">']
    return _lines(nodes.sparkSession, head, own.unionByName(ways), ["  </graph>", "</graphml>"])


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = nodes.select(F.lit(1).alias("part"), F.col("id").alias("order_1"), F.lit(0).cast("long").alias("order_2"), F.concat(F.lit('  "'), escape_dot(F.col("qualified_name")), F.lit('";')).alias("line"))
    ways = _named(nodes, edges).select(
        F.lit(2).alias("part"), F.col("from_id").alias("order_1"), F.col("id").alias("order_2"),
        F.concat(F.lit('  "'), escape_dot(F.col("from")), F.lit('" -> "'), escape_dot(F.col("to")), F.lit('";')).alias("line"),
    )
    return _lines(nodes.sparkSession, ["digraph G {"], own.unionByName(ways), ["}"])


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges) of a subgraph."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each


def document(lines: DataFrame) -> str:
    """The document as one text; for subgraphs, whose size the caller has bounded."""
    return "\n".join(r["line"] for r in lines.orderBy("part", "order_1", "order_2").collect())


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line of JSON: the numbers of nodes and edges and the flowchart, which the caller bounds by the subgraph."""
    text = document(mermaid(nodes, edges))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    return counts.select(F.to_json(F.struct("nodes", "edges", F.lit(text).alias("mermaid"))).alias("line"))
