"""Parent-child links to full hierarchies: paths, depths, roots, descendants, and the nodes that loops spoil.

Links may repeat, a node may have several parents, and chains may loop. A node is *looped* if some chain from child to
parent that starts at it runs into a cycle; every other node is *sound* and has a path. Where a sound node has several
parents, its path follows the one of the lowest id.

Method: leaves are peeled bottom-up in distributed rounds. A leaf leaves with its links and sends what hangs below it, as
rows (ancestor, descendant, distance), to its parents; a root's list has no bound, so it never is one value, and subtree
sizes are counted from these rows. So that long chains don't take a round a step, each round also takes out about a
quarter of the nodes with one parent and one child, by hashes of both ends, and hands their place to the link around
them, which remembers them in order. So the rounds grow with the logarithm of the nodes, not with the depth. The reverse
of the peeling then hands loops, paths, depths and the lists of the nodes taken out down, each round's nodes from what
left after them. Each round writes its own part, once.

What stays has cycles or lies between them: there, nodes without a parent are peeled from above, what then stays is
looped, and what went is sound. Once no more than ``FEW`` links stay, which may be before all leaves are peeled, one task
does this for them; their number is counted and the bound fixed, and more are worked on by distributed rounds, to the
same end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import folded
from codeweft.session import cut

NONE = "cast(null as array<long>)"
#: Links that one task may finish; at most as many squared pairs come of them.
FEW = 1000


def graph_links(edges: DataFrame) -> DataFrame:
    """Distinct (tree, child, parent) of the contains edges (parent to child) and the inherits edges (child to parent).

    Spelling variants of the type count as the type. Links with a null end are dropped: they link nothing.
    """
    e = edges.select(folded("edge_type").alias("tree"), "from_id", "to_id").filter(
        "tree in ('contains', 'inherits') and from_id is not null and to_id is not null"
    )
    down = F.col("tree") == "contains"
    return e.select(
        "tree",
        F.when(down, F.col("to_id")).otherwise(F.col("from_id")).alias("child"),
        F.when(down, F.col("from_id")).otherwise(F.col("to_id")).alias("parent"),
    ).distinct()


@dataclass
class _Peeled:
    """rounds: (tree, kind, child, parent, via, below, under) that left in each round; core: the links left over, of them
    ``n``. ``via`` holds the nodes taken out between child and parent, the child's side first; ``below`` and ``under`` are
    the child of a node taken out and the ``via`` between both."""

    rounds: list[DataFrame] = field(default_factory=list)
    core: DataFrame | None = None
    n: int = 0
    few: int = FEW


def _coin(node: str, turn: int) -> Column:
    return F.pmod(F.xxhash64("tree", node, F.lit(turn)), F.lit(2)) == 1


def _peel(links: DataFrame, few: int = FEW) -> _Peeled:
    """Bottom-up rounds until no leaf and no chain is left, or few links are."""
    out = _Peeled(few=few)
    left = links.select("tree", "child", "parent", F.expr(NONE).alias("via"))
    while True:
        turn = len(out.rounds)
        marked = cut(_marked(left, turn))
        counts = {r["kind"]: (r["n"], r["chains"]) for r in marked.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("chain").alias("chains")).collect()}
        out.core = left = marked.filter("kind = 'stay'").select("tree", "child", "parent", "via")
        out.n, chains = counts.get("stay", (0, 0))
        gone = sum(n for kind, (n, _) in counts.items() if kind != "stay")
        if gone:
            out.rounds.append(marked.filter("kind <> 'stay'").drop("chain"))
        if out.n <= few or not (gone or chains):
            return out
        if not gone:
            out.rounds.append(marked.limit(0).drop("chain"))  # another turn of the coins


def _marked(left: DataFrame, turn: int) -> DataFrame:
    """The links after a round: those that stay, those of leaves and those of nodes taken out."""
    ends = F.array(
        F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"), F.struct(F.col("parent").alias("parent"), F.col("via").alias("via")).alias("link")),
        F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"), F.expr("cast(null as struct<parent: bigint, via: array<bigint>>)").alias("link")),
    )
    nodes = left.select("tree", (F.col("child") == F.col("parent")).alias("own"), F.inline(ends))
    nodes = nodes.groupBy("tree", "node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.bool_or("own").alias("own"), F.first("link", ignorenulls=True).alias("link"))
    chain = (F.col("up") == 1) & (F.col("down") == 1) & ~F.col("own")
    nodes = nodes.select("tree", "node", "down", "link", chain.alias("chain")).withColumn("goes", F.col("chain") & _coin("node", turn) & ~_coin("link.parent", turn))
    below = nodes.select("tree", F.col("node").alias("child"), (F.col("down") == 0).alias("leaf"), "chain", F.col("goes").alias("child_goes"))
    above = nodes.filter("goes").select("tree", F.col("node").alias("parent"), "link")
    both = left.join(below, ["tree", "child"]).filter("not child_goes").join(above, ["tree", "parent"], "left")
    met = F.col("link").isNotNull()
    via = F.coalesce("via", F.expr("cast(array() as array<long>)"))
    around = F.when(met, F.concat(via, F.array("parent"), F.coalesce("link.via", F.expr("cast(array() as array<long>)")))).otherwise(F.col("via"))
    kind = F.when(F.col("leaf"), "leaf").otherwise("stay")
    null = F.lit(None).cast("long")
    row = lambda kind, child, parent, via, below, under, chain: F.struct(kind.alias("kind"), child.alias("child"), parent.alias("parent"), via.alias("via"), below.alias("below"), under.alias("under"), chain.alias("chain"))
    first = row(kind, F.col("child"), F.coalesce("link.parent", "parent"), around, null, F.expr(NONE), F.col("chain"))
    taken = row(F.lit("taken"), F.col("parent"), F.col("link.parent"), F.col("link.via"), F.col("child"), F.col("via"), F.lit(False))
    return both.select("tree", F.inline(F.when(met, F.array(first, taken)).otherwise(F.array(first))))


def _line(above: Column) -> Column:
    """The path of a link's child, by the path of its parent."""
    return F.concat(above, F.reverse(F.coalesce("via", F.expr("cast(array() as array<long>)"))), F.array("child"))


def _near() -> Column:
    return F.coalesce(F.try_element_at("via", F.lit(1)), "parent")


def _graphs(batches: Iterator[pd.DataFrame]):
    """Each tree's links left over: the parents and the children of its nodes, with the nodes between."""
    for tree, own in pd.concat(list(batches) or [pd.DataFrame({"tree": []})]).groupby("tree"):
        up, down = defaultdict(list), defaultdict(list)
        for c, q, via in zip(own.child, own.parent, own.via):
            via = () if via is None else tuple(int(x) for x in via)
            up[int(c)].append((int(q), via))
            down[int(q)].append((int(c), via))
        yield tree, up, down


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states of the children of few links."""
    for tree, up, down in _graphs(batches):
        waits = {c: len(x) for c, x in up.items()}
        ready = [q for q in down if q not in up]
        while ready:
            for c, _ in down.get(ready.pop(), ()):
                waits[c] -= 1
                if not waits[c]:
                    ready.append(c)
        paths: dict[int, list[int]] = {}
        for node in up:
            chain, at = [], node
            while at in up and not waits[at] and at not in paths:
                q, via = min(up[at], key=lambda x: (x[1] or (x[0],))[0])
                chain.append((at, q, via))
                at = q
            for n, q, via in reversed(chain):
                paths[n] = [*paths.get(q, [q]), *reversed(via), n]
        yield pd.DataFrame([(tree, n, waits[n] > 0, paths.get(n)) for n in up], columns=["tree", "node", "looped", "path"])


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What few links lead down to from each of their parents, itself at a distance of 0 included."""
    for tree, _, down in _graphs(batches):
        out = []
        for top in down:
            seen, front = {top: 0}, [top]
            while front:
                heard: dict[int, int] = {}
                for n in front:
                    for c, via in down.get(n, ()):
                        d = seen[n] + len(via) + 1
                        if d < min(seen.get(c, d + 1), heard.get(c, d + 1)):
                            heard[c] = d
                seen |= heard
                front = list(heard)
            out += [(tree, top, n, d) for n, d in seen.items()]
        yield pd.DataFrame(out, columns=["tree", "ancestor", "node", "distance"])


def _core_state(p: _Peeled, paths: bool) -> list[DataFrame]:
    """The state of the children of the links left over: parents without a parent are peeled, what stays is looped."""
    if not p.n:
        return []
    if p.n <= p.few:
        return [cut(p.core.repartition(1).mapInPandas(_finished, "tree string, node long, looped boolean, path array<long>"))]
    rest, n = p.core, p.n
    while True:
        children = rest.select("tree", F.col("child").alias("parent")).distinct()
        below = cut(rest.join(children, ["tree", "parent"], "left_semi"))
        m = below.count()
        rest = below
        if m == n:
            break
        n = m
    stuck = cut(rest.select("tree", F.col("child").alias("node")).distinct())
    parts = [stuck.select("tree", "node", F.lit(True).alias("looped"), F.expr(NONE).alias("path"))]
    sound = p.core.join(stuck.withColumnRenamed("node", "child"), ["tree", "child"], "left_anti")
    sound = cut(sound.groupBy("tree", "child").agg(F.min_by(F.struct("parent", "via"), _near()).alias("x")).select("tree", "child", "x.*"))
    tops = sound.join(sound.select("tree", F.col("child").alias("parent")), ["tree", "parent"], "left_anti")
    front = cut(tops.select("tree", F.col("child").alias("node"), F.lit(False).alias("looped"), _line(F.array("parent")).alias("path")))
    while paths and not front.isEmpty():
        parts.append(front)
        below = sound.join(front.select("tree", F.col("node").alias("parent"), "path"), ["tree", "parent"])
        front = cut(below.select("tree", F.col("child").alias("node"), F.lit(False).alias("looped"), _line(F.col("path")).alias("path")))
    return parts


def looped_nodes(links: DataFrame, few: int = FEW) -> DataFrame:
    """(tree, node) of every looped node: on a cycle, its own parent, or below one. No links: no rows."""
    return _looped(_peel(links, few))


def _looped(p: _Peeled) -> DataFrame:
    """Loops handed down in reverse peel order: only looped nodes are followed."""
    parts = [cut(x.filter("looped").select("tree", "node")) for x in _core_state(p, False)[:1]]
    if not parts:
        return p.core.select("tree", F.col("child").alias("node")).limit(0)
    for peeled in reversed(p.rounds):
        bad = reduce(DataFrame.unionByName, parts).withColumnRenamed("node", "parent")
        parts.append(cut(peeled.join(bad, ["tree", "parent"], "left_semi").select("tree", F.col("child").alias("node")).distinct()))
    return reduce(DataFrame.unionByName, parts)


def resolve(links: DataFrame, few: int = FEW) -> DataFrame:
    """(tree, node, looped, path) of every child; ``path`` leads from the root to the node and is null if looped."""
    return _resolved(_peel(links, few))


def _resolved(p: _Peeled) -> DataFrame:
    parts = _core_state(p, True)
    for peeled in reversed(p.rounds):
        links = peeled.select("tree", "child", "parent", "via").distinct()
        if parts:
            above = reduce(DataFrame.unionByName, parts).select("tree", F.col("node").alias("parent"), "looped", "path")
            handed = links.join(above, ["tree", "parent"], "left")
        else:
            handed = links.select("*", F.lit(None).cast("boolean").alias("looped"), F.expr(NONE).alias("path"))
        # A parent without a state has no parent of its own: it is a root. A child's links all left in one round.
        own = handed.groupBy("tree", F.col("child").alias("node")).agg(
            F.coalesce(F.bool_or("looped"), F.lit(False)).alias("looped"), F.min_by(_line(F.coalesce("path", F.array("parent"))), _near()).alias("path")
        )
        parts.append(cut(own.withColumn("path", F.when(~F.col("looped"), F.col("path")))))
    if not parts:
        return p.core.select("tree", F.col("child").alias("node"), F.lit(False).alias("looped"), "via").withColumnRenamed("via", "path").limit(0)
    return reduce(DataFrame.unionByName, parts)


def hierarchy(links: DataFrame, few: int = FEW) -> DataFrame:
    """Every node of the links: tree, node, parent, root, depth, path, subtree_size and looped.

    Roots have depth 0, a null parent and a path of themselves. For looped nodes all but tree, node and looped is null.
    ``subtree_size`` counts the node and its descendants, looped ones included.
    """
    links = cut(links)
    p = _peel(links, few)
    state = _resolved(p)
    roots = (
        links.select("tree", F.col("parent").alias("node"))
        .distinct()
        .join(links.select("tree", F.col("child").alias("node")), ["tree", "node"], "left_anti")
        .select("tree", "node", F.lit(False).alias("looped"), F.array("node").alias("path"))
    )
    sizes = _pairs(p, state.filter("looped").select("tree", "node")).groupBy("tree", F.col("ancestor").alias("node")).agg(F.count("*").alias("_below"))
    depth = F.size("path") - 1
    sound = ~F.col("looped")
    return state.unionByName(roots).join(sizes, ["tree", "node"], "left").select(
        "tree",
        "node",
        F.when(sound & (depth > 0), F.try_element_at("path", F.greatest(depth, F.lit(1)))).alias("parent"),
        F.when(sound, F.try_element_at("path", F.lit(1))).alias("root"),
        F.when(sound, depth).alias("depth"),
        "path",
        F.when(sound, F.coalesce("_below", F.lit(0)) + 1).alias("subtree_size"),
        "looped",
    )


def descendants(links: DataFrame, few: int = FEW) -> DataFrame:
    """(tree, ancestor, descendant, distance) of every node below each sound node, looped ones included.

    Each pair comes once, at its least distance; 1 is a child.
    """
    p = _peel(links, few)
    return _pairs(p, _looped(p))


def _members(links: DataFrame, child: str = "child", parent: str = "parent", via: str = "via") -> DataFrame:
    """(tree, ancestor, node, distance): the child of each link and the nodes taken out on it, seen from its parent."""
    inner = F.coalesce(via, F.expr("cast(array() as array<long>)"))
    n = F.size(inner)
    every = F.transform(F.concat(F.array(child), inner), lambda x, i: F.struct(x.alias("node"), (n - i + 1).alias("distance")))
    return links.select("tree", F.col(parent).alias("ancestor"), F.inline(every))


def _told(members: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """Pairs of the members themselves and of what their lists hold, once each, at the least distance."""
    out = members.withColumnRenamed("node", "descendant")
    if lists:
        known = reduce(DataFrame.unionByName, lists).select("tree", F.col("ancestor").alias("node"), "descendant", F.col("distance").alias("_more"))
        heard = members.join(known, ["tree", "node"])
        out = out.unionByName(heard.select("tree", "ancestor", "descendant", (F.col("distance") + F.col("_more")).alias("distance")))
    return out.groupBy("tree", "ancestor", "descendant").agg(F.min("distance").alias("distance"))


def _pairs(p: _Peeled, looped: DataFrame) -> DataFrame:
    """The pairs of ``descendants``: leaves' lists sent up round by round, then those of what wasn't a leaf."""
    sent: list[DataFrame] = []
    for peeled in p.rounds:
        sent.append(cut(_told(_members(peeled.filter("kind = 'leaf'")), sent)))
    full: list[DataFrame] = [cut(_core_lists(p, sent))] if p.n else []
    for peeled in reversed(p.rounds):
        taken = peeled.filter("kind = 'taken'")
        # The child of a node taken out has its whole list by now; the nodes between have what was sent to them.
        child = _told(_members(taken.withColumn("under", F.expr(NONE)), "below", "child", "under"), [*sent, *full])
        step = F.size(F.coalesce("under", F.expr("cast(array() as array<long>)")))
        child = child.join(taken.select("tree", F.col("child").alias("ancestor"), step.alias("_step")), ["tree", "ancestor"])
        child = child.select("tree", "ancestor", "descendant", (F.col("distance") + F.col("_step")).alias("distance"))
        between = _members(taken, "below", "child", "under").join(taken.select("tree", F.col("child").alias("ancestor"), F.col("below").alias("node")), ["tree", "ancestor", "node"], "left_anti")
        full.append(cut(child.unionByName(_told(between, sent))))
    every = reduce(DataFrame.unionByName, [*sent, *full]) if sent or full else _members(p.core).withColumnRenamed("node", "descendant").limit(0)
    own = every.join(looped.withColumnRenamed("node", "ancestor"), ["tree", "ancestor"], "left_anti")
    return own.groupBy("tree", "ancestor", "descendant").agg(F.min("distance").alias("distance"))


def _reach(p: _Peeled) -> DataFrame:
    """The nodes of the links left over below those that are sound, or the child of a node taken out, by rounds."""
    stuck = _core_state(p, False)[0].filter("looped").select("tree", "node")
    ends = p.core.select("tree", F.col("parent").alias("node")).distinct()
    wanted = ends.join(stuck, ["tree", "node"], "left_anti")
    for peeled in p.rounds:
        wanted = wanted.unionByName(peeled.filter("kind = 'taken'").select("tree", F.col("below").alias("node")).join(ends, ["tree", "node"], "left_semi"))
    step = F.size(F.coalesce("via", F.expr("cast(array() as array<long>)"))) + 1
    down = cut(p.core.select("tree", F.col("parent").alias("node"), F.col("child").alias("_next"), step.alias("_step")))
    front = cut(wanted.distinct().select("tree", F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")))
    reached = [front]
    while not front.isEmpty():
        heard = front.join(down, ["tree", "node"]).groupBy("tree", "ancestor", F.col("_next").alias("node")).agg(F.min(F.col("distance") + F.col("_step")).alias("distance"))
        known = reduce(DataFrame.unionByName, reached).groupBy("tree", "ancestor", "node").agg(F.min("distance").alias("_least"))
        front = cut(heard.join(known, ["tree", "ancestor", "node"], "left").filter("_least is null or distance < _least").drop("_least"))
        reached.append(front)
    return reduce(DataFrame.unionByName, reached).groupBy("tree", "ancestor", "node").agg(F.min("distance").alias("distance"))


def _core_lists(p: _Peeled, sent: list[DataFrame]) -> DataFrame:
    """What hangs below the nodes of the links left over whose lists are asked for."""
    every = _reach(p) if p.n > p.few else cut(p.core.repartition(1).mapInPandas(_reached, "tree string, ancestor long, node long, distance int"))
    links = p.core.withColumnRenamed("parent", "node")
    inner = F.coalesce("via", F.expr("cast(array() as array<long>)"))
    between = F.transform(inner, lambda x, i: F.struct(x.alias("_node"), (F.size(inner) - i).alias("_more")))
    on_links = every.join(links, ["tree", "node"]).select("tree", "ancestor", "distance", F.inline(between))
    members = every.unionByName(on_links.select("tree", "ancestor", F.col("_node").alias("node"), (F.col("distance") + F.col("_more")).alias("distance")))
    # A node's own distance of 0 stands for itself: it brings what was sent to it, and is no pair.
    return _told(members, sent).filter("distance > 0")
