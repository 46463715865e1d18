"""Bounded traversals: breadth first, level by level over the whole frontier, and depth first over a bounded subgraph."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut, small

MOST_DEPTH = 20


def bfs(edges: DataFrame, starts: DataFrame, depth: int = 5, incoming: bool = False, edge_type: str | None = None) -> DataFrame:
    """(start, id, distance, path, lines) of everything within ``depth`` steps of each start in ``starts`` (id).

    Each pair comes out once, at its least distance; the start itself at 0. Among equally short ways the one with the
    lowest parent id and then the lowest edge id counts. ``path`` holds the ids from the start on, ``lines`` the line of
    the call on each step, -1 for none. Ids without a node are walked through; join with nodes to leave them out.
    """
    if edge_type:
        edges = edges.filter(F.col("edge_type") == edge_type)
    own, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    steps = edges.filter("from_id is not null and to_id is not null").select(
        F.col(own).alias("at"), F.col(other).alias("next"), F.col("id").alias("edge"), F.coalesce("call_site_line", F.lit(-1)).alias("line")
    )
    if depth > 1:
        steps = cut(steps)  # read again at every level
    seen = cut(starts.filter("id is not null").select(F.col("id").alias("start"), "id").distinct().select(
        "start", "id", F.lit(0).alias("distance"), F.array("id").alias("path"), F.array().cast("array<int>").alias("lines")
    ))
    frontier, n = seen, seen.count()
    for level in range(1, min(depth, MOST_DEPTH) + 1):
        if not n:
            break
        here = frontier.select("start", F.col("id").alias("at"), "path", "lines")
        ways = steps.join(small(here, n, 100_000), "at")
        best = ways.groupBy("start", F.col("next").alias("id")).agg(
            F.min_by(F.struct(F.concat("path", F.array("next")).alias("path"), F.concat("lines", F.array("line")).alias("lines")), F.struct("at", "edge")).alias("way")
        )
        fresh = best.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = cut(fresh.select("start", "id", F.lit(level).alias("distance"), "way.path", "way.lines"))
        n = frontier.count()
        seen = cut(seen.unionByName(frontier)) if level % 5 == 0 else seen.unionByName(frontier)
    return seen


def named_paths(reached: DataFrame, nodes: DataFrame, separator: str = " -> ", reverse: bool = False) -> DataFrame:
    """Adds qualified_name and path_names; reached ids and steps without a node are left out."""
    names = nodes.select("id", "qualified_name")
    steps = reached.select("start", "id", F.posexplode("path").alias("at", "step"))
    named = steps.join(names.withColumnsRenamed({"id": "step", "qualified_name": "name"}), "step")
    order = F.sort_array(F.collect_list(F.struct("at", "name")), asc=not reverse)
    text = F.array_join(F.transform(order, lambda x: x["name"]), separator)
    paths = named.groupBy("start", "id").agg(text.alias("path_names"))
    return reached.join(names, "id").join(paths, ["start", "id"])


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """What a change of each start reaches, itself included: (start, id, qualified_name, distance, impact_path), the path
    written from the reached symbol back to the start."""
    reached = bfs(edges, starts, min(depth, MOST_DEPTH), incoming=True)
    out = named_paths(reached, nodes, reverse=True)
    return out.select("start", "id", "qualified_name", "distance", F.col("path_names").alias("impact_path"))


def reachable(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1, incoming: bool = True) -> DataFrame:
    """Callers or callees within ``depth`` steps over any edge type, without the start itself."""
    return bfs(edges, starts, depth, incoming).filter("distance > 0").join(nodes.select("id", "qualified_name"), "id")


def subgraph(nodes: DataFrame, edges: DataFrame, root: DataFrame | None = None, depth: int = 3, files: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the roots, or around the first ``files`` file nodes one step deep, with the edges among them."""
    if root is None:
        root = nodes.filter("symbol_type = 'file'").select("id").orderBy("id").limit(files)
        depth = 1
    ids = bfs(edges, root, depth).select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    ids = cut(ids)
    inner = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inner


def dfs(edges: DataFrame, start: int, depth: int = 5, incoming: bool = False, edge_type: str | None = None, most: int = 200_000) -> DataFrame:
    """(id, distance, place) in depth-first order, last edge first; distance is the depth of the walk, not the least one.

    The order is sequential by nature, so one task walks the edges within ``depth`` steps, counted first; more than
    ``most`` of them is an error rather than a task without bound.
    """
    spark = edges.sparkSession
    if edge_type:
        edges = edges.filter(F.col("edge_type") == edge_type)
    near = bfs(edges, spark.range(start, start + 1), depth, incoming).select(F.col("id").alias("at"))
    own, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    steps = cut(edges.select(F.col(own).alias("at"), F.col(other).alias("next"), "id").join(near.distinct(), "at", "left_semi"))
    if steps.count() > most:
        raise ValueError(f"more than {most} edges within {depth} steps")

    def walk(batches):
        ways = defaultdict(list)
        parts = list(batches)
        for at, nxt, _ in pd.concat(parts).sort_values("id").itertuples(index=False) if parts else ():
            ways[at].append(nxt)
        stack, seen, out = [(start, 0)], set(), []
        while stack:
            at, d = stack.pop()
            if at in seen or d > depth:
                continue
            seen.add(at)
            out.append((at, d, len(out)))
            stack += [(x, d + 1) for x in ways[at] if x not in seen]
        yield pd.DataFrame(out, columns=["id", "distance", "place"])

    return steps.repartition(1).mapInPandas(walk, "id long, distance int, place int")
