"""Queries of the general training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import heavy, hierarchy, orphans
from codeweft.sources.tables import current, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(edge_type, node_id) of nodes with a chain upward that runs into a cycle."""
    bad = hierarchy.looped_nodes(hierarchy.graph_links(table(spark, d, "edges", "from_id", "to_id", "edge_type")))
    return bad.select(F.col("tree").alias("edge_type"), F.col("node").alias("node_id"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and subtree size of every node of the contains and inherits links."""
    h = hierarchy.hierarchy(hierarchy.graph_links(table(spark, d, "edges", "from_id", "to_id", "edge_type")))
    return h.select(
        F.col("tree").alias("edge_type"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"),
        "depth", F.array_join("path", "/").alias("path"), "subtree_size", "looped",
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(edge_type, ancestor_id, descendant_id, distance) of what hangs below every sound node, by any chain."""
    x = hierarchy.descendants(hierarchy.graph_links(table(spark, d, "edges", "from_id", "to_id", "edge_type")))
    return x.select(F.col("tree").alias("edge_type"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), "distance")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(node_id) of nodes whose current fan_in differs from the distinct calls edges to them."""
    calls = heavy.calls_per_target(table(spark, d, "edges", "id", "to_id", "edge_type"))
    nodes = current(table(spark, d, "nodes", "id", "version", "fan_in"), "fan_in")
    both = nodes.join(calls, nodes.id == calls.to_id, "left")
    return both.filter(F.coalesce("fan_in", F.lit(0)) != F.coalesce("calls", F.lit(0))).select(F.col("id").alias("node_id"))


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    """(target_id, calls) of every target of a calls edge, with or without a node."""
    return heavy.calls_per_target(table(spark, d, "edges", "id", "to_id", "edge_type")).select(F.col("to_id").alias("target_id"), "calls")


def p5_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(target_id, edge_id, place) of each distinct edge among its target's, in the order of edge ids."""
    x = heavy.running_per_key(table(spark, d, "edges", "id", "to_id"), "to_id", "id", "place")
    return x.select(F.col("to_id").alias("target_id"), F.col("id").alias("edge_id"), "place")


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return (
        table(spark, d, "edges", "id", "from_id", "to_id", "indexed_at"),
        table(spark, d, "annotations", "id", "node_qname", "created_at"),
        table(spark, d, "test_specs", "id", "target_qname", "indexed_at"),
        table(spark, d, "nodes", "id", "qualified_name"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, ref_field, row_id) of references to nodes that have no row."""
    return orphans.orphan_references(*_orphans(spark, d)).select("table_name", "ref_field", "row_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, ref_field, period, orphan_rows) by month of the referring row."""
    return orphans.orphan_report(*_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_calls, p5_ranks, p6_found, p6_report)}

_PATH = "regexp_replace(regexp_replace(lower(replace({0}, '\\', '/')), '/+', '/', 'g'), '/$', '')"
_NAME = (
    "case when strpos({0}, '#') = 0 then " + _PATH + " else " + _PATH.format("substr({0}, 1, strpos({0}, '#') - 1)")
    + " || substr({0}, strpos({0}, '#')) end"
)


def name_sql(column: str) -> str:
    """DuckDB's form of ``canonical_name``."""
    return _NAME.replace("{0}", column)


def path_sql(column: str) -> str:
    """DuckDB's form of ``canonical``."""
    return _PATH.replace("{0}", column)


_LINKS = """links as (select distinct lower(trim(edge_type)) tree, case when lower(trim(edge_type)) = 'contains' then to_id else from_id end child,
  case when lower(trim(edge_type)) = 'contains' then from_id else to_id end parent from edges
  where lower(trim(edge_type)) in ('contains', 'inherits') and from_id is not null and to_id is not null)"""
_BAD = """up as (select tree, child node, parent top, 1 step from links
      union select u.tree, u.node, l.parent, u.step + 1 from up u join links l on l.tree = u.tree and l.child = u.top where u.step < 300),
  bad as (select distinct tree, node from up where step = 300)"""
_PATHS = """canon as (select l.tree, child, min(l.parent) parent from links l where (l.tree, child) not in (select (tree, node) from bad) group by all),
  paths as (select distinct tree, parent node, cast(null as bigint) parent, parent root, 0 depth, cast(parent as varchar) path from links
      where (tree, parent) not in (select (tree, child) from links)
    union all select c.tree, c.child, c.parent, p.root, p.depth + 1, p.path || '/' || c.child from paths p join canon c on c.tree = p.tree and c.parent = p.node),
  reach as (select tree, parent ancestor, child descendant, 1 distance from links where (tree, parent) not in (select (tree, node) from bad)
    union select r.tree, r.ancestor, l.child, r.distance + 1 from reach r join links l on l.tree = r.tree and l.parent = r.descendant where r.distance < 300),
  pairs as (select tree, ancestor, descendant, min(distance) distance from reach group by all)"""
_CALLS = "select to_id, count(distinct id) calls from edges where lower(trim(edge_type)) = 'calls' and to_id is not null group by to_id"
_ORPHANS = f"""refs as (
    select 'edges' table_name, 'from_id' ref_field, id row_id, indexed_at ts from edges where from_id is not null and from_id not in (select id from nodes where id is not null)
    union all select 'edges', 'to_id', id, indexed_at from edges where to_id is not null and to_id not in (select id from nodes where id is not null)
    union all select 'annotations', 'node_qname', id, make_timestamp(case when abs(created_at) >= 100000000000 then created_at * 1000 else created_at * 1000000 end) from annotations
      where trim(node_qname) <> '' and {name_sql("node_qname")} not in (select {name_sql("qualified_name")} from nodes where qualified_name is not null)
    union all select 'test_specs', 'target_qname', id, indexed_at from test_specs
      where trim(target_qname) <> '' and {name_sql("target_qname")} not in (select {name_sql("qualified_name")} from nodes where qualified_name is not null))"""

SQL = {
    # Links are walked up from every child; a walk longer than any loop-free chain is in a loop, so the depth is bounded.
    "p3_found": f"with recursive {_LINKS}, {_BAD} select tree edge_type, node node_id from bad",
    "p3_hierarchy": f"""with recursive {_LINKS}, {_BAD}, {_PATHS},
      sizes as (select tree, ancestor, count(*) n from pairs group by all)
      select p.tree edge_type, p.node node_id, p.parent parent_id, p.root root_id, p.depth, p.path, coalesce(n, 0) + 1 subtree_size, false looped
        from paths p left join sizes s on s.tree = p.tree and s.ancestor = p.node
      union all select tree, node, null, null, null, null, null, true from bad""",
    "p3_descendants": f"""with recursive {_LINKS}, {_BAD}, {_PATHS}
      select tree edge_type, ancestor ancestor_id, descendant descendant_id, distance from pairs""",
    "p5_found": f"""with calls as ({_CALLS}), cur as (select id, max(coalesce(fan_in, 0)) fan_in from nodes n
      where version = (select max(version) from nodes m where m.id = n.id) group by id)
      select id node_id from cur left join calls on to_id = id where fan_in <> coalesce(calls, 0)""",
    "p5_calls": f"select to_id target_id, calls from ({_CALLS})",
    "p5_ranks": """select to_id target_id, id edge_id, row_number() over (partition by to_id order by id) place
      from (select distinct to_id, id from edges where to_id is not null and id is not null)""",
    "p6_found": f"with {_ORPHANS} select distinct table_name, ref_field, row_id from refs",
    "p6_report": f"""with {_ORPHANS} select table_name, ref_field, cast(year(ts) * 100 + month(ts) as integer) period, count(distinct row_id) orphan_rows
      from refs group by all""",
}
