"""Scans, point lookups, filters, and one-step neighbourhoods of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.arrays import has_tag_folded, tags
from codeweft.functions.names import ascii_fold, blank, canonical_name, file_part
from codeweft.operators.orphans import epoch
from codeweft.schema import METRICS


def by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    """Exact, case-sensitive. Over raw rows, ``tables.current_where`` takes the same condition to the scan."""
    return nodes.filter(F.col("qualified_name") == name)


def by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == path)


def by_symbol_name(nodes: DataFrame, name: str) -> DataFrame:
    """Equal but for the case of ASCII letters."""
    return nodes.filter(ascii_fold("symbol_name") == ascii_fold(F.lit(name)))


def file_paths(nodes: DataFrame) -> DataFrame:
    return nodes.select("file_path").distinct()


def edges_of_types(edges: DataFrame, types: list[str]) -> DataFrame:
    """No types: no rows."""
    return edges.filter(F.col("edge_type").isin(*types)) if types else edges.limit(0)


def matching(nodes: DataFrame, symbol_type: str | None = None, language: str | None = None, visibility: str | None = None) -> DataFrame:
    """Each given value must be equal."""
    for c, v in (("symbol_type", symbol_type), ("language", language), ("visibility", visibility)):
        if v:
            nodes = nodes.filter(F.col(c) == v)
    return nodes


def at_least(nodes: DataFrame, metric: str, threshold: int = 0) -> DataFrame:
    """Rows whose metric reaches the threshold; only known metrics may be named."""
    if metric not in METRICS:
        raise ValueError(f"no metric: {metric}")
    return nodes.filter(F.col(metric) >= threshold)


def with_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.filter(has_tag_folded("tags", tag))


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: int, incoming: bool) -> DataFrame:
    """(qualified_name, call_site_line, edge_type) of every edge of the node in one direction.

    All edge types count and parallel edges stay; an end without a node has a null name.
    """
    own, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    near = edges.filter(F.col(own) == node_id).select(F.col(other).alias("id"), "call_site_line", "edge_type")
    return near.join(nodes.select("id", "qualified_name"), "id", "left").select("qualified_name", "call_site_line", "edge_type")


def test_callers(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """Names of sources of incoming edges whose file path names tests or specs; parallel edges stay."""
    near = edges.filter(F.col("to_id") == node_id).select(F.col("from_id").alias("id"))
    path = F.lower("file_path")
    return near.join(nodes.select("id", "qualified_name", "file_path"), "id").filter(path.contains("test") | path.contains("spec")).select("qualified_name")


def related_tests(targets: DataFrame, nodes: DataFrame, edges: DataFrame, specs: DataFrame) -> DataFrame:
    """Distinct (target, test) for ``targets`` (target, qualified_name): the tests that a tests edge leads from to the
    target or to its file, and the titles of the specs that name it.

    Names of specs are compared with canonical path parts. Null names and titles are none.
    """
    files = nodes.filter("symbol_type = 'file'").select(F.col("id").alias("to_id"), F.col("qualified_name").alias("_file"))
    own = targets.join(nodes.select(F.col("id").alias("to_id"), "qualified_name"), "qualified_name").select("target", "to_id")
    above = targets.filter("qualified_name like '%#%'").join(files, file_part("qualified_name") == F.col("_file")).select("target", "to_id")
    hits = edges.filter("edge_type = 'tests'").select("from_id", "to_id").join(own.unionByName(above), "to_id").select("target", F.col("from_id").alias("id")).distinct()
    found = hits.join(nodes.select("id", F.col("qualified_name").alias("test")), "id").select("target", "test")
    titles = specs.filter(~blank("target_qname")).select(canonical_name("target_qname").alias("qualified_name"), F.col("title").alias("test"))
    return found.unionByName(titles.join(targets, "qualified_name").select("target", "test")).filter("test is not null").distinct()


def first_edges(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(from_id, to_id, id, edge_type): the edge of the lowest id between each pair of ends, of the given types if any."""
    own = edges.filter(F.col("edge_type").isin(*types)) if types else edges
    best = own.filter("from_id is not null and to_id is not null").groupBy("from_id", "to_id").agg(F.min_by(F.struct("id", "edge_type"), "id").alias("e"))
    return best.select("from_id", "to_id", "e.id", "e.edge_type")


def structured(nodes: DataFrame) -> DataFrame:
    """The search result form: empty fields are null, so that JSON leaves them out."""
    return nodes.select(
        F.col("qualified_name").alias("qname"),
        F.col("symbol_type").alias("type"),
        F.col("file_path").alias("file"),
        F.nullif("signature", F.lit("")).alias("signature"),
        F.nullif(F.substring("docstring", 1, 200), F.lit("")).alias("docstring_snippet"),
        F.when(F.size(tags()) > 0, F.col("tags")).alias("tags"),
        F.when(F.col("fan_in") > 0, F.col("fan_in")).alias("fan_in"),
    )


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


def details(nodes: DataFrame, annotations: DataFrame, specs: DataFrame, name: str, summary: bool = False) -> DataFrame:
    """One row of a symbol: its fields, the five newest annotations, and its tests with their assertions; a summary has
    four fields only.

    Names of annotations and specs are compared with canonical path parts; rows without a title are no tests.
    """
    own = by_qualified_name(nodes, name)
    if summary:
        return own.select("qualified_name", "symbol_type", "file_path", "signature")
    at = epoch(F.col("created_at"))
    notes = annotations.filter(canonical_name("node_qname") == name).orderBy(F.desc_nulls_last(at), "id").limit(5)
    notes = notes.agg(F.sort_array(F.collect_list(F.struct(F.unix_seconds(at).alias("created_at"), "kind", "body")), asc=False).alias("annotations"))
    tests = specs.filter(canonical_name("target_qname") == name).filter("title is not null")
    tests = tests.agg(F.sort_array(F.collect_set(F.struct("title", "assertions"))).alias("tests"))
    return own.crossJoin(F.broadcast(notes)).crossJoin(F.broadcast(tests))  # one row each
