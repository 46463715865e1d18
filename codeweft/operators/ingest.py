"""Applying parse results and change events to the graph: upserts, deletes, name resolution, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import ascii_fold, canonical_name, symbol_name
from codeweft.operators.degree import reconciled


def upserted(old: DataFrame, new: DataFrame, key: str = "qualified_name") -> DataFrame:
    """One row a key: the one of the highest version, ``new`` before ``old`` at equal versions; the old id stays.

    A key that only ``new`` has gets the hash of its name as id, so that repeated runs agree.
    """
    columns = [c for c in old.columns if c not in (key, "id")]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(F.coalesce("version", F.lit(-(2**63))), "_new")
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("row"), F.min(F.when(F.col("_new") == 0, F.col("id"))).alias("_id"))
    return best.select(F.coalesce("_id", F.xxhash64(key)).alias("id"), key, "row.*").select(*old.columns)


def without_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the files in ``paths`` (file_path) dropped, with every edge at either of their ends."""
    gone = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
    left = nodes.join(paths.select("file_path").distinct(), "file_path", "left_anti")
    for side in ("from_id", "to_id"):
        edges = edges.join(gone.withColumnRenamed("id", side), side, "left_anti")
    return left, edges


def last_events(events: DataFrame) -> DataFrame:
    """(file_path, event, commit_hash, ts): the last event of each file; at equal times a deletion is the last."""
    rank = F.struct("ts", F.col("event") == "DELETE", "commit_hash", "event")
    return events.groupBy("file_path").agg(F.max_by(F.struct("event", "commit_hash", "ts"), rank).alias("e")).select("file_path", "e.*")


def applied(nodes: DataFrame, edges: DataFrame, events: DataFrame, new_nodes: DataFrame, raw_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a batch of change events.

    The rows of every file with an event go, those parsed from files added or modified come; names of raw edges are
    resolved against what is there then, incoming edges from other files are resolved anew by the names of their old
    ends, and the degrees are counted again. One plan without order among files; applying a batch twice changes nothing.
    """
    last = last_events(events)
    old_names = nodes.select(F.col("id").alias("_old"), F.col("qualified_name").alias("_name"))
    kept, inner = without_files(nodes, edges, last)
    touched = nodes.join(last.select("file_path"), "file_path", "left_semi").select(F.col("id").alias("to_id"))
    cut_off = edges.join(touched, "to_id", "left_semi").join(kept.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    coming = new_nodes.join(last.filter("event <> 'DELETE'").select("file_path"), "file_path", "left_semi")
    rows = upserted(kept, coming)
    again = (
        cut_off.join(old_names, cut_off.to_id == F.col("_old"))
        .join(kept.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("from_qname")), "from_id")
        .select("from_qname", F.col("_name").alias("to_qname"), "edge_type", "dynamic", "call_site_line")
    )
    found = resolved(raw_edges.select("from_qname", "to_qname", "edge_type", "dynamic", "call_site_line").unionByName(again), rows)
    added = counted_edges(found)
    every = inner.unionByName(added, allowMissingColumns=True).dropDuplicates(["id"])
    return reconciled(rows, every), every


def counted_edges(found: DataFrame) -> DataFrame:
    """Edges with ids of resolved raw ones: equal edges, such as two calls on one line, are told apart by a number among
    them, so that applying them again gives the same ids."""
    same = ["from_id", "to_id", "edge_type", "call_site_line", "dynamic"]
    counted = found.groupBy(*same).agg(F.count("*").alias("_n")).select(*same, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_place"))
    return counted.select(F.xxhash64("from_id", "to_id", "edge_type", F.coalesce("call_site_line", F.lit(-1)), "dynamic", "_place").alias("id"), *same)


def candidates(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id, tier) of distinct names (name): 1 the whole name as a qualified name, 2 without its hint up to the first
    colon, 3 as a symbol name whatever its case, a type that the hint names before others. The lowest id on ties.

    The symbol-name side is reduced to one row a name and type before the join, so a very common name joins once.
    """
    colon = F.instr("name", ":")
    asked = names.select("name", canonical_name("name").alias("c"), F.when(colon > 0, F.substring("name", F.lit(1), colon - 1)).alias("hint"), F.when(colon > 0, F.substring("name", colon + 1, F.length("name"))).otherwise(F.col("name")).alias("bare"))
    whole = nodes.groupBy(canonical_name("qualified_name").alias("c")).agg(F.min("id").alias("id"))
    by_name = nodes.groupBy(ascii_fold(symbol_name("qualified_name")).alias("s"), F.col("symbol_type").alias("kind")).agg(F.min("id").alias("id"))
    first = asked.join(whole, "c").select("name", "id", F.lit(1).alias("tier"), F.lit(0).alias("off"))
    second = asked.filter("hint is not null").withColumn("c", canonical_name("bare")).join(whole, "c").select("name", "id", F.lit(2).alias("tier"), F.lit(0).alias("off"))
    third = asked.withColumn("s", ascii_fold("bare")).join(by_name, "s").select(
        "name", "id", F.lit(3).alias("tier"), F.when(F.coalesce(F.col("hint") == F.col("kind"), F.lit(False)), 0).otherwise(1).alias("off")
    )
    every = first.unionByName(second).unionByName(third)
    return every.groupBy("name").agg(F.min(F.struct("tier", "off", "id")).alias("x")).select("name", "x.id", "x.tier")


def resolved(raw_edges: DataFrame, nodes: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """Raw edges with from_id and to_id; those with an end that no name gives are dropped.

    A ``to`` end that only another project names is found in ``remote`` (id, qualified_name), if given; ``remote`` ids are
    those of the nodes that stand for its symbols here.
    """
    names = raw_edges.select(F.explode(F.array("from_qname", "to_qname")).alias("name")).filter("name is not null").distinct()
    found = candidates(names, nodes).select("name", "id")
    if remote is not None:
        rest = raw_edges.select(F.col("to_qname").alias("name")).filter("name is not null").distinct().join(found, "name", "left_anti")
        other = candidates(rest, remote.select("id", "qualified_name", F.lit(None).cast("string").alias("symbol_type"))).select("name", "id")
        to = raw_edges.join(found.unionByName(other).withColumnsRenamed({"name": "to_qname", "id": "to_id"}), "to_qname")
        return to.join(found.withColumnsRenamed({"name": "from_qname", "id": "from_id"}), "from_qname")
    for side in ("from", "to"):
        raw_edges = raw_edges.join(found.withColumnsRenamed({"name": f"{side}_qname", "id": f"{side}_id"}), f"{side}_qname")
    return raw_edges


def project_of(path: str = "file_path"):
    """The project of a path: its second segment, null where it has none."""
    return F.nullif(F.try_element_at(F.split(path, "/"), F.lit(3)), F.lit(""))


def across_projects(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, project, id, shadow) of names (name, project) that the own project has no symbol for, found in another one.

    The first other project in order of names that has the symbol, its canonical name before its symbol name, the lowest
    id first. ``shadow`` names the node that stands for it here. The symbol side is reduced to one row a name and project.
    """
    own = nodes.select("id", "qualified_name", project_of().alias("other"), ascii_fold(symbol_name("qualified_name")).alias("s"), canonical_name("qualified_name").alias("c"))
    by_symbol = own.groupBy("s", "other").agg(F.min(F.struct("id", "qualified_name")).alias("x"))
    by_name = own.groupBy("c", "other").agg(F.min(F.struct("id", "qualified_name")).alias("x"))
    asked = wanted.select("name", "project", ascii_fold(symbol_name("name")).alias("s"), canonical_name("name").alias("c")).distinct()
    local = asked.join(by_symbol.select("s", F.col("other").alias("project")), ["s", "project"], "left_anti")
    hits = local.join(by_symbol, "s").select("name", "project", "other", F.lit(1).alias("off"), "x")
    hits = hits.unionByName(local.join(by_name, "c").select("name", "project", "other", F.lit(0).alias("off"), "x"))
    best = hits.filter("other <> project").groupBy("name", "project").agg(F.min(F.struct("other", "off", "x")).alias("b"))
    return best.select("name", "project", F.col("b.x.id").alias("id"), F.concat(F.lit("remote:"), "b.other", F.lit(":"), "b.x.qualified_name").alias("shadow"))

