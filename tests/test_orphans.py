import random
from datetime import datetime

import numpy as np

from codeweft.operators import orphans

E, A = "id long, from_id long, to_id long, indexed_at timestamp, key string", "id long, node_qname string, created_at long, name string"
S, N = "id long, target_qname string, indexed_at timestamp, space int", "id long, qualified_name string, version long"


def test_rows_and_periods(spark, rows):
    t = datetime(2025, 3, 4)
    edges = spark.createDataFrame([(1, 10, 11, t, "x"), (1, 10, 11, t, "x"), (2, 10, 99, t, "x"), (3, -5, 10, None, "x"), (4, None, 10, t, "x")], E)
    notes = spark.createDataFrame([(1, "/A//b.ts#Foo", 1735690081, ""), (2, "/a/b.ts#foo", 1735690081000, ""), (3, "  ", 1, ""), (4, None, None, ""), (5, "/gone", None, "")], A)
    specs = spark.createDataFrame([(1, "\\a\\B.ts#Foo", t, 1), (2, "", t, 1), (3, "/x#y", t, 1)], S)
    nodes = spark.createDataFrame([(10, "/a/b.ts#Foo", 1), (10, "/a/b.ts#Foo", 2), (11, None, 1), (None, "/q", 1)], N)
    got = rows(orphans.orphan_references(edges, notes, specs, nodes))
    assert got == [
        ("annotations", "node_qname", 202501, 2),
        ("annotations", "node_qname", None, 5),
        ("edges", "from_id", None, 3),
        ("edges", "to_id", 202503, 2),
        ("test_specs", "target_qname", 202503, 3),
    ]
    assert sum(r.orphan_rows for r in orphans.orphan_report(edges, notes, specs, nodes).collect()) == 5


def test_keys_against_sets(spark):
    rnd = random.Random(3)
    hot = [(0, 1, 77)] * 2000
    refs = hot + [(rnd.randrange(2), rnd.randrange(3), rnd.randrange(-40_000, 60_000)) for _ in range(6000)] + [(0, 0, None)]
    parents = [(rnd.randrange(2), rnd.randrange(-40_000, 60_000)) for _ in range(40_000)]
    df = orphans.missing_keys(spark.createDataFrame(refs, "space int, grp int, key long"), spark.createDataFrame(parents, "space int, key long"))
    known = set(parents)
    want = {r for r in refs if r[2] is not None and (r[0], r[2]) not in known}
    assert {tuple(r) for r in df.collect()} == want


def test_containers():
    for offsets in ([], [0], [5, 9, 16383], list(range(0, 16384, 2))):
        box = orphans._pack(np.array(offsets, np.int64))
        assert np.flatnonzero(orphans._flags([box])).tolist() == offsets


def test_dictionary_is_dense(spark):
    names = [f"n{i}" for i in range(300)] + ["n1", None, ""]
    got = {r.name: r.key for r in orphans.dictionary(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert sorted(got.values()) == list(range(301)) and [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got)


def test_empty(spark):
    e = [spark.createDataFrame([], k) for k in (E, A, S, N)]
    assert orphans.orphan_references(*e).count() == 0 == orphans.orphan_report(*e).count()
