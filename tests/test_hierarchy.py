import random

import pytest

from codeweft.operators import hierarchy

LINKS = "tree string, child long, parent long"
EDGES = "id long, from_id long, to_id long, edge_type string"


def brute(links):
    """Looped nodes, and the path of each other child, per tree."""
    out = {}
    for tree in {t for t, _, _ in links}:
        up = {}
        for t, c, p in links:
            if t == tree:
                up.setdefault(c, set()).add(p)
        looped = set()
        for n in up:
            front = {n}
            for _ in range(len(up) + 1):
                front = {p for x in front for p in up.get(x, ())}
            if front:
                looped.add(n)
        for n in up:
            path, at = [n], n
            while n not in looped and at in up:
                at = min(up[at])
                path.insert(0, at)
            out[tree, n] = None if n in looped else path
    return out


@pytest.mark.parametrize("seed, few", [(0, 0), (1, 40), (2, 1000)])
def test_random_graphs_against_brute_force(spark, seed, few):
    rnd = random.Random(seed)
    links = [("ab"[c % 2], c, rnd.randrange(max(1, c // 2 - 3), c)) for c in range(2, 40 if few else 20)]
    links += [("a", 100 + i, 99 + i if i else 2) for i in range(14 if few else 6)] + [("b", 200 + i, 199 + i if i else 3) for i in range(9)] + [("b", 5, 208)] * (seed == 2) + [("a", 80, 81), ("a", 81, 80), ("a", 81, 82), ("a", 82, 83), ("a", 84, 80)]
    links += [("a", 70, 71), ("a", 71, 72), ("a", 72, 70), ("a", 73, 72), ("a", 74, 73), ("a", 75, 74), ("a", 75, 2), ("b", 5, 5), ("a", 72, 1)]
    df = spark.createDataFrame(links, LINKS)
    got = {(r.tree, r.node): None if r.looped else list(r.path) for r in hierarchy.resolve(df, few).collect()}
    assert got == brute(links)
    bad = {(r.tree, r.node) for r in hierarchy.looped_nodes(df, few).collect()}
    assert bad == {k for k, v in brute(links).items() if v is None}


def test_hierarchy_columns(spark, rows):
    df = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("a", 4, 2), ("a", 9, 9)], LINKS)
    got = {r.node: (r.parent, r.root, r.depth, r.path, r.subtree_size, r.looped) for r in hierarchy.hierarchy(df).collect()}
    assert got == {
        1: (None, 1, 0, [1], 4, False),
        2: (1, 1, 1, [1, 2], 3, False),
        3: (2, 1, 2, [1, 2, 3], 1, False),
        4: (2, 1, 2, [1, 2, 4], 1, False),
        9: (None, None, None, None, None, True),
    }
    assert rows(hierarchy.descendants(df)) == [("a", 1, 2, 1), ("a", 1, 3, 2), ("a", 1, 4, 2), ("a", 2, 3, 1), ("a", 2, 4, 1)]


@pytest.mark.parametrize("seed, few", [(0, 0), (1, 40), (2, 1000)])
def test_descendants_by_any_chain(spark, rows, seed, few):
    rnd = random.Random(seed)
    links = [("ab"[c % 2], c, rnd.randrange(max(1, c // 2 - 3), c)) for c in range(2, 40 if few else 20)] + [("a", c, rnd.randrange(1, c)) for c in range(10, 20, 4)]
    links += [("a", 100 + i, 99 + i if i else 2) for i in range(14 if few else 6)] + [("b", 200 + i, 199 + i if i else 3) for i in range(9)] + [("b", 5, 208)] * (seed == 2) + [("a", 80, 81), ("a", 81, 80), ("a", 81, 82), ("a", 82, 83), ("a", 84, 80)]
    links += [("a", 100 + i, 99 + i if i else 2) for i in range(14 if few else 6)] + [("a", 105, 102), ("a", 90, 103), ("a", 80, 81), ("a", 81, 80), ("a", 81, 82), ("a", 82, 83), ("a", 83, 104), ("a", 84, 80), ("a", 85, 84)]
    links += [("a", 70, 71), ("a", 71, 72), ("a", 72, 70), ("a", 73, 72), ("a", 74, 73), ("a", 74, 2), ("a", 72, 1), ("b", 5, 5)]
    looped = {k for k, path in brute(links).items() if path is None}
    want = []
    for tree, top in {(t, p) for t, _, p in links} - looped:
        seen, front, distance = {top}, {top}, 0
        while front:
            front, distance = {c for t, c, p in links if t == tree and p in front} - seen, distance + 1
            seen |= front
            want += [(tree, top, c, distance) for c in front]
    df = spark.createDataFrame(links, LINKS)
    assert rows(hierarchy.descendants(df, few)) == sorted(want)
    sizes = {(r.tree, r.node): r.subtree_size for r in hierarchy.hierarchy(df, few).collect() if not r.looped}
    assert sizes == {k: 1 + sum(w[:2] == k for w in want) for k in sizes}


def test_directions_spellings_nulls_and_repeats(spark, rows):
    edges = spark.createDataFrame([(1, 10, 20, "contains"), (1, 10, 20, " CONTAINS "), (2, 30, 40, "Inherits"), (3, None, 5, "contains"), (4, 5, 6, "calls"), (5, 7, None, "inherits"), (6, 1, 2, None)], EDGES)
    assert rows(hierarchy.graph_links(edges)) == [("contains", 20, 10), ("inherits", 30, 40)]


def test_empty(spark):
    df = spark.createDataFrame([], LINKS)
    assert hierarchy.looped_nodes(df).count() == hierarchy.hierarchy(df).count() == hierarchy.descendants(df).count() == 0


def test_a_long_chain_and_a_hot_parent(spark):
    links = [("a", i + 1, i) for i in range(60)] + [("a", 1000 + i, 60) for i in range(500)]
    df = spark.createDataFrame(links, LINKS)
    got = {r.node: r for r in hierarchy.hierarchy(df, 30).collect()}
    assert got[1007].depth == 61 and got[0].subtree_size == 561 and got[1007].path[0] == 0
