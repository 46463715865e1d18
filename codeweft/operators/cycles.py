"""Cyclic dependencies: pairs that depend on each other, and strongly connected components."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut

# The edge types that make a dependency.
DEPENDENCIES = ("calls", "dynamic_calls", "inherits", "implements", "depends_on")
LOCAL_LINKS = 250_000


def dependency_links(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) of the dependency edges, self loops aside."""
    own = edges.filter(F.col("edge_type").isin(*DEPENDENCIES) & (F.col("from_id") != F.col("to_id")))
    return own.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()


def two_cycles(links: DataFrame) -> DataFrame:
    """(a, b), a < b, that link to each other: both directions of a pair meet in one grouping instead of a join."""
    pair = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), (F.col("a") < F.col("b")).alias("up"))
    return pair.groupBy("low", "high").agg(F.countDistinct("up").alias("n")).filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))


def _trim(links: DataFrame, enough: int) -> tuple[DataFrame, int]:
    """Links whose ends both have links in and out, peeled round by round until few more go or ``enough`` are left."""
    links = cut(links)
    n = links.count()
    while n > enough:
        ins = links.select(F.col("b").alias("a")).distinct()
        outs = links.select(F.col("a").alias("b")).distinct()
        left = cut(links.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"))
        m = left.count()
        if m > 0.98 * n or m == 0:
            return left, m
        links, n = left, m
    return links, n


def _local(batches):
    parts = list(batches)
    ways, back = defaultdict(list), defaultdict(list)
    for a, b in pd.concat(parts)[["a", "b"]].itertuples(index=False) if parts else ():
        ways[a].append(b)
        back[b].append(a)
    seen, order = set(), []
    for root in list(ways):
        stack = [(root, iter(ways[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            at, it = stack[-1]
            for x in it:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(ways.get(x, ()))))
                    break
            else:
                order.append(at)
                stack.pop()
    done, out = set(), []
    for root in reversed(order):
        if root in done:
            continue
        group, todo = [], [root]
        done.add(root)
        while todo:
            at = todo.pop()
            group.append(at)
            for x in back.get(at, ()):
                if x not in done:
                    done.add(x)
                    todo.append(x)
        if len(group) > 1:
            low = min(group)
            out += [(i, low) for i in group]
    yield pd.DataFrame(out, columns=["id", "component"])


def _reached(links: DataFrame, start: DataFrame, at: str, to: str) -> DataFrame:
    """(id) of what the links lead to from ``start`` (id), itself included; a round looks at what is new only."""
    front = cut(start)
    parts = [front]
    while not front.isEmpty():
        seen = reduce(DataFrame.unionByName, parts)
        ahead = links.join(front.withColumnRenamed("id", at), at, "left_semi").select(F.col(to).alias("id")).distinct()
        front = cut(ahead.join(seen, "id", "left_anti"))
        parts.append(front)
    return reduce(DataFrame.unionByName, parts)


def _of_hub(links: DataFrame) -> DataFrame:
    """(id, component) of the component of the node with most links, the lowest id on ties."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id"))
    hub = cut(ends.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id"))
    own = cut(_reached(links, hub, "a", "b").join(_reached(links, hub, "b", "a"), "id", "left_semi"))
    return own.crossJoin(F.broadcast(own.agg(F.min("id").alias("component"))))  # one row


def components(links: DataFrame, local_links: int = LOCAL_LINKS, rounds: int | None = None) -> DataFrame:
    """(id, component) of every node in a strongly connected component of two or more; named by the lowest id.

    Links that can't lie on a cycle are trimmed in distributed rounds. If few are left (counted), one task finishes; else
    the component of the node with most links goes first, as what it reaches and is reached from. If many are left still,
    the lowest id that reaches a node spreads forward, components are what the lowest ids reach back, and the rest goes on
    until none is left. A rest after ``rounds`` distributed rounds, if given, is an error.
    """
    left, n = _trim(links, local_links)
    if n <= local_links:
        return left.repartition(1).mapInPandas(_local, "id long, component long")
    first = cut(_of_hub(left))
    found: DataFrame = first
    gone = first.select(F.col("id").alias("a"))
    left, n = _trim(left.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti"), local_links)
    for turn in count():
        if n <= local_links:
            found = found.unionByName(left.repartition(1).mapInPandas(_local, "id long, component long"))
            break
        if turn == rounds:
            raise ValueError(f"components unresolved after {rounds} rounds")
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        color = cut(ids.select("id", F.col("id").alias("low")))
        while True:  # forward: the lowest id that reaches each node
            heard = left.join(color.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("low").alias("_low"))
            new = cut(color.join(heard, "id", "left").select("id", F.least("low", F.coalesce("_low", "low")).alias("low"), (F.col("_low") < F.col("low")).alias("_moved")))
            color = new.select("id", "low")
            if new.filter("_moved").isEmpty():
                break
        back = cut(color.filter("id = low").select("id", "low"))
        front = back
        while not front.isEmpty():  # backward, within the same color
            up = left.join(front.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "low").distinct()
            front = cut(up.join(color, ["id", "low"], "left_semi").join(back, "id", "left_anti"))
            back = cut(back.unionByName(front))
        own = back.select("id", F.col("low").alias("component"))
        found = found.unionByName(own)
        left, n = _trim(left.join(back.select(F.col("id").alias("a")), "a", "left_anti").join(back.select(F.col("id").alias("b")), "b", "left_anti"), local_links)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(sizes.select("component"), "component", "left_semi").select("id", "component")
