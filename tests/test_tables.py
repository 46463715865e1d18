from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeweft.functions import names
from codeweft.operators import consistency, history, ingest, search, vectors
from codeweft.session import cut
from codeweft.sources.tables import current


@pytest.mark.parametrize("raw, want", [("\\A\\B.ts", "/a/b.ts"), ("//a///b/", "/a/b"), (None, None), ("", ""), ("A#B/", None)])
def test_canonical(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "p string")
    if want is None and raw:
        assert df.select(names.canonical_name("p")).first()[0] == "a#B/"
    else:
        assert df.select(names.canonical("p")).first()[0] == want


def test_symbol_name_takes_the_first_hash(spark):
    df = spark.createDataFrame([("a#b#c",), ("plain",), (None,)], "q string")
    assert [r[0] for r in df.select(names.symbol_name("q")).collect()] == ["b#c", "plain", None]


def test_current_rows(spark, rows):
    df = spark.createDataFrame([(1, 5, "new"), (1, 4, "old"), (1, 5, "new"), (2, None, "only"), (None, 1, "x")], "id long, version long, v string")
    assert rows(current(df, "v")) == [(1, "new"), (2, "only")]


def test_upsert_keeps_ids_and_prefers_new(spark, rows):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 9, "y")], "id long, qualified_name string, version long, v string")
    new = spark.createDataFrame([(0, "a", 1, "z"), (0, "b", 3, "w"), (0, "c", 1, "n")], old.schema)
    got = {r.qualified_name: (r.id, r.v) for r in ingest.upserted(old, new).collect()}
    assert got["a"] == (1, "z") and got["b"] == (2, "y") and got["c"][1] == "n"


def test_apply_resolves_incoming_edges_again_and_is_idempotent(spark, rows):
    kind = "id long, qualified_name string, file_path string, symbol_type string, version long, fan_in int, fan_out int, fan_in_dynamic int, fan_out_dynamic int"
    nodes = spark.createDataFrame([(1, "/a.ts#f", "/a.ts", "function", 1, 0, 1, 0, 0), (2, "/b.ts#g", "/b.ts", "function", 1, 1, 0, 0, 0), (3, "/c.ts#h", "/c.ts", "function", 1, 0, 0, 0, 0)], kind)
    edges = spark.createDataFrame([(1, 1, 2, "calls", 3, False), (2, 3, 1, "calls", 1, False)], "id long, from_id long, to_id long, edge_type string, call_site_line int, dynamic boolean")
    events = spark.createDataFrame([("MODIFY", "/b.ts", "c1", datetime(2025, 1, 1)), ("DELETE", "/c.ts", "c1", datetime(2025, 1, 1))], "event string, file_path string, commit_hash string, ts timestamp")
    new = spark.createDataFrame([(0, "/b.ts#g", "/b.ts", "function", 2, None, None, None, None)], kind)
    raw = spark.createDataFrame([("/b.ts#g", "f", "calls", False, 7)], "from_qname string, to_qname string, edge_type string, dynamic boolean, call_site_line int")
    n, e = map(cut, ingest.applied(nodes, edges, events, new, raw))
    assert {r.qualified_name for r in n.collect()} == {"/a.ts#f", "/b.ts#g"}
    by = {r.id: r.qualified_name for r in n.collect()}
    assert {(by[r.from_id], by[r.to_id]) for r in e.collect()} == {("/a.ts#f", "/b.ts#g"), ("/b.ts#g", "/a.ts#f")}
    assert {r.qualified_name: (r.fan_in, r.fan_out) for r in n.collect()} == {"/a.ts#f": (1, 1), "/b.ts#g": (1, 1)}
    n2, e2 = ingest.applied(n, e, events, new, raw)
    assert rows(n2.select("id", "qualified_name", "fan_in")) == rows(n.select("id", "qualified_name", "fan_in")) and rows(e2.select("from_id", "to_id")) == rows(e.select("from_id", "to_id"))


def test_resolution_ladder(spark):
    nodes = spark.createDataFrame([(1, "/a.ts#Foo", "class"), (2, "/b.ts#foo", "function"), (3, "package:x", "package")], "id long, qualified_name string, symbol_type string")
    asked = spark.createDataFrame([(x,) for x in ("\\A.ts#Foo", "FOO", "function:foo", "package:x", "nothing", "")], "name string")
    got = {r.name: (r.id, r.tier) for r in ingest.candidates(asked, nodes).collect()}
    assert got == {"\\A.ts#Foo": (1, 1), "FOO": (1, 3), "function:foo": (2, 3), "package:x": (3, 1)}


def test_diff_statuses(spark, rows):
    d = spark.createDataFrame([("A", None, "a", "c"), ("D", None, "d", "c"), ("R090", "o", "n", "c"), ("C75", "o", "k", "c"), ("T", None, "t", "c"), (None, None, "u", "c")], "status string, old_path string, path string, commit_hash string")
    assert rows(history.diff_events(d).select("event", "file_path")) == [("ADD", "a"), ("ADD", "k"), ("ADD", "n"), ("DELETE", "d"), ("DELETE", "o"), ("MODIFY", "t"), ("MODIFY", "u")]


def test_recent_changes(spark):
    c = "array<struct<hash:string,message:string,author:string,date:string>>"
    n = spark.createDataFrame([(1, "a", [("h1", "m1", "x", "2025-01-02"), ("h2", "m2", "x", "not a date")]), (2, "b", [("h1", "other", "x", "2025-01-02"), (None, "m", "x", None)]), (3, "c", None)], f"id long, qualified_name string, history {c}")
    got = history.recent_changes(n, 5).collect()
    assert [(r.hash, r.message, r.n_symbols, list(r.symbols)) for r in sorted(got, key=lambda r: r.hash)] == [("h1", "m1", 2, ["a", "b"]), ("h2", "m2", 1, ["a"])]
    assert [r.hash for r in history.recent_changes(n, 5, since="2025-06-01").collect()] == ["h2"]


def test_a_commit_of_many_symbols_names_all(spark):
    c = "array<struct<hash:string,message:string,author:string,date:string>>"
    names = [f"s{i:03}" for i in range(250)]
    n = spark.createDataFrame([(i, q, [("h", "m", "x", "2025-01-02")]) for i, q in enumerate(names)], f"id long, qualified_name string, history {c}")
    got = history.recent_changes(n).first()
    assert got.n_symbols == 250 and list(got.symbols) == names


def test_consistency(spark):
    disk = spark.createDataFrame([("same", "c", "h"), ("changed", "c", "h"), ("behind", "c", "h2"), ("live", "c", "h2"), ("new", "c", "h")], "file_path string, checksum string, commit_hash string")
    idx = spark.createDataFrame([("same", "c", "h"), ("changed", "d", "h"), ("behind", "c", "h1"), ("live", "c", "watcher-change"), ("gone", "c", "h")], "file_path string, checksum string, last_updated_commit string")
    assert {r.file_path: r.state for r in consistency.report(disk, idx).collect()} == {"changed": "outdated", "behind": "outdated", "new": "missing", "gone": "orphaned"}
    assert {r.state for r in consistency.report(disk, idx, force=True).collect()} == {"outdated", "orphaned"}


def test_keyword_search(spark):
    n = spark.createDataFrame([(1, "/x/y.ts#getNode", "method", "/x/y.ts"), (2, "/über/z.ts#Node", "class", "/über/z.ts"), (3, None, None, None)], "id long, qualified_name string, symbol_type string, file_path string")
    assert {r.id for r in search.keyword(n, "x get*").collect()} == {1}
    assert {r.id for r in search.keyword(n, "uber no").collect()} == {2}
    assert {r.id for r in search.keyword(n, "getnode OR class").collect()} == {1, 2}
    assert search.keyword(n, '  *"').count() == 0
    assert [r.id for r in search.like(n, "node").collect()] == [1, 2]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, place int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, place int")
    got = [(r.id, r.score) for r in search.fused(a, b).collect()]
    assert [i for i, _ in got] == [2, 1, 3] and got[0][1] == pytest.approx(1 / 61 + 1 / 62)


def test_neighbours_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    vecs = [(i, [rnd.choice([0.0, 1.0]) for _ in range(4)]) for i in range(200)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest(df.filter("vec_id % 50 = 0"), df, 7).collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    good = {i: v for i, v in vecs if v and len(v) == 4}
    for q in got:
        want = sorted((round(sum((a - b) ** 2 for a, b in zip(good[q], v)) ** 0.5, 9), i) for i, v in good.items())[:7]
        assert sorted(got[q]) == want
    assert vectors.nearest(df.limit(0), df, 3).count() == 0
    assert all(r.id != r.query_id for r in vectors.similar(df.filter("vec_id = 0"), df, 3).collect())


def test_embedding_provider_failures_leave_a_batch_out(spark):
    def bad(texts):
        if "boom" in texts:
            raise RuntimeError
        return vectors.hash_vectors(texts, 8)

    df = spark.createDataFrame([(1, "a b"), (2, "boom"), (3, None)], "id long, text string").coalesce(1)
    assert {r.id for r in vectors.embedded(df, bad, batch=1).collect()} == {1, 3}
    stale = vectors.stale(spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (4, "w")], "id long, checksum string"), spark.createDataFrame([(1, "y"), (2, "q"), (3, "z")], "id long, checksum string"))
    assert {r.id for r in stale.collect()} == {1, 4}


def test_extra_columns_with_clashing_names(spark):
    e = spark.createDataFrame([(1, 2, 3, "calls", 1, False, "x", 7)], "id long, from_id long, to_id long, edge_type string, call_site_line int, dynamic boolean, fan_in string, n long")
    from codeweft.operators import degree, heavy

    assert {r.id for r in degree.fan_metrics(e).collect()} == {2, 3}
    assert heavy.calls_per_target(e.withColumn("calls", F.lit(1))).count() == 1


def test_annotations_in_milliseconds_and_without_a_stamp(spark):
    kind = "id long, node_qname string, kind string, body string, author string, created_at long, commit_hash string"
    stamps = [(1, 1_700_000_000), (2, 1_700_086_400_500), (3, None), (4, 1_700_172_800), (5, 1_600_000_000_000)]
    notes = spark.createDataFrame([(i, "a#f", "note", "b", "x", at, "c") for i, at in stamps], kind)
    got = [(r.id, r.created_at, r.day) for r in history.annotations(notes).collect()]
    assert got == [(4, 1_700_172_800, "2023-11-16"), (2, 1_700_086_400, "2023-11-15"), (1, 1_700_000_000, "2023-11-14"), (5, 1_600_000_000, "2020-09-13"), (3, None, None)]
