import subprocess

import pytest
from pyspark.sql import functions as F

from codeweft import api
from codeweft.operators import advice, history, indexing, ingest, lookup, risk, rules, search, vectors
from codeweft.sources import files, tables

FILES = [
    ("/P/a.ts", "import x from 'lib';\n/** Adds. */\nexport function f(a) {\n  return g(a) + g(a);\n}\nfunction g(a) { return a; }\n"),
    ("/p/b.py", "from .c import q\n\nclass B:\n    def m(self):\n        return f(1)\n"),
    ("/p/a.test.ts", "describe('a', () => {\n  it('adds', () => {\n    expect(f(1)).toBe(2);\n  });\n});\n"),
    ("/p/r.md", "# One\ntext\n## Two\n"),
    ("/p/c.json", '{"k": 1}'),
    ("/p/empty.ts", ""),
    ("/p/null.ts", None),
    (None, "x"),
]


def test_index_of_a_project(spark, rows):
    nodes, edges, specs = indexing.index(spark.createDataFrame(FILES, "path string, text string"), "c1", 7)
    nodes.persist()
    by = {r.qualified_name: r for r in nodes.collect()}
    assert {"/p/a.ts", "/p/a.ts#f", "/p/a.ts#g", "/p/b.py#B", "/p/b.py#B.m", "/p/r.md#one", "/p/c.json#k", "/p/empty.ts", "/p/null.ts"} <= set(by)
    assert by["/p/a.ts#f"].docstring == "Adds." and by["/p/a.ts#f"].last_updated_commit == "c1" and by["/p/a.ts"].checksum and by["/p/r.md#one"].symbol_type == "section"
    name = {r.id: q for q, r in by.items()}
    got = [(name[r.from_id], name[r.to_id], r.edge_type) for r in edges.collect()]
    assert got.count(("/p/a.ts#f", "/p/a.ts#g", "calls")) == 2 and ("/p/b.py#B.m", "/p/a.ts#f", "calls") in got and ("/p/b.py#B", "/p/b.py#B.m", "contains") in got
    assert ("/p/r.md", "/p/r.md#one", "contains") in got and by["/p/a.ts#g"].fan_in == 2
    assert [(r.title, r.file_path) for r in specs.collect()] == [("adds", "/p/a.test.ts")]
    again = indexing.index(spark.createDataFrame(FILES, "path string, text string"), "c1", 7)[1]
    assert rows(again.select("id")) == rows(edges.select("id"))
    assert all(x.count() == 0 for x in indexing.index(spark.createDataFrame([], "path string, text string")))


def test_initialize_project_heeds_nested_ignores(spark, tmp_path):
    for name, text in {"a.ts": "function f() {}\n", "sub/b.ts": "x\n", "sub/.gitignore": "b.ts\n/c.ts\n", "sub/c.ts": "x\n", "sub/d/c.ts": "x\n", "gen/z.ts": "x", ".gitignore": "# none\ngen/\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    nodes = api.read(spark, str(tmp_path)).initialize_project(str(tmp_path))[0]
    got = {r.file_path.rsplit("/", 2)[-2] + "/" + r.file_path.rsplit("/", 1)[-1] for r in nodes.filter("file_path like '%.ts'").collect()}
    assert {x for x in got if x.endswith("c.ts")} == {"d/c.ts"} and not any(x.endswith(("b.ts", "z.ts")) for x in got)
    assert files.nested_rules({"": ["x"], "s": ["!y", "/z", ""]}) == ["x", "!/s/**/y", "/s/z", ""]


def test_filters_reach_the_scan(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i % 50, f"/f#{i % 50}", i, "class") for i in range(500)], "id long, qualified_name string, version long, symbol_type string").write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(i, i % 9, i % 7, " Calls") for i in range(100)] * 2, "id long, from_id long, to_id long, edge_type string").write.parquet(f"{d}/edges.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near = tables.clean_edges(spark, d, "from_id", "to_id", "edge_type", where=F.col("to_id") == 3)
    text = plan(near)
    assert "EqualTo(to_id,3)" in text and text.index("Filter") > text.index("Exchange")  # the plan is printed from the top
    assert near.count() == sum(i % 7 == 3 for i in range(100))
    own = tables.nodes_where(spark, d, F.col("qualified_name") == "/f#7", "qualified_name")
    text = plan(own)
    assert "EqualTo(qualified_name,/f#7)" in text and "BroadcastHashJoin" in text and [tuple(r) for r in own.collect()] == [(7, "/f#7")]
    assert tables.nodes_where(spark, d, F.col("version") < 50, "version").count() == 0  # older rows met it, no current one


def test_advice(spark):
    nodes = spark.createDataFrame([(1, "a", ["layer:core"], 1, 10, 60), (2, "b", ["layer:api"], 1, 10, 0), (3, "c", None, 40, 10, 0), (4, None, None, None, None, None)], "id long, qualified_name string, tags array<string>, cyclomatic int, loc int, fan_in int")
    kind = "from_id long, to_id long, policy_id string, description string"
    bad = spark.createDataFrame([(1, 2, "x", "d"), (1, 9, "x", "d"), (2, 1, "circular-dependency", "d"), (3, 2, "x", "d"), (2, 3, "x", "d"), (4, 4, "x", None)], kind)
    got = {(r.from_id, r.to_id): r for r in risk.remedies(bad, nodes).collect()}
    assert got[1, 2].strategy.startswith("Dependency Inversion") and got[1, 9].strategy == "Insufficient Violation Data" and got[2, 1].steps[0].startswith("1. Identify the common")
    assert got[3, 2].strategy.startswith("Single") and got[2, 3].rationale == "Illegal relationship detected: d." and "'b' and 'c'" in got[2, 3].steps[0] and len(got[4, 4].steps) == 4
    assert set(advice.REMEDIES) >= {r.strategy for r in got.values()}
    edges = spark.createDataFrame([(1, 2, 1, "calls", 1), (2, 3, 1, "calls", 1)], "id long, from_id long, to_id long, edge_type string, call_site_line int")
    own = risk.proposals(nodes, edges, spark.createDataFrame([(1,), (3,)], "id long"), 2)
    steps = {r.id: r.steps for r in own.collect()}
    assert steps[1][-2] == "4. [Verification] Run full integration tests, focusing on: a, b, c..." and len(steps[1]) == 5 and steps[3][1].startswith("2. [Abstraction]")


def test_query_operators(spark):
    nodes = spark.createDataFrame([(1, "/a#Token.get", "method", "/a"), (2, "/b#Token.set", "method", "/b"), (3, "/c#Other", "class", "/token")], "id long, qualified_name string, symbol_type string, file_path string")
    ids = lambda q: {r.id for r in search.keyword(nodes, q).collect()}
    assert ids("token") == {1, 2, 3} and ids("token NOT set") == {1, 3} and ids("qualified_name:token") == {1, 2} and ids("file_path:token OR get*") == {1, 3}
    assert ids("token NOT file_path:token") == {1, 2} and ids("NOT token") == set() and ids("") == set() and ids("nothing:token") == set()


def test_first_edges_related_tests_and_vectors(spark, rows):
    edges = spark.createDataFrame([(5, 1, 2, "tests"), (3, 1, 2, "tests"), (4, 1, 3, "tests"), (6, None, 2, "tests"), (7, 1, 2, "calls")], "id long, from_id long, to_id long, edge_type string")
    assert rows(lookup.first_edges(edges, ["tests"])) == [(1, 2, 3, "tests"), (1, 3, 4, "tests")]
    nodes = spark.createDataFrame([(1, "/t#t", "test"), (2, "/a", "file"), (3, "/a#f", "function"), (4, "/b#f", "function")], "id long, qualified_name string, symbol_type string")
    specs = spark.createDataFrame([("\\A#f", "says"), ("/a#f", None), (None, "x"), (" ", "x"), ("/q", "x")], "target_qname string, title string")
    targets = nodes.select(F.col("id").alias("target"), "qualified_name")
    assert rows(lookup.related_tests(targets, nodes, edges, specs)) == [(2, "/t#t"), (3, "/t#t"), (3, "says")]
    assert vectors.stored(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>"), 1).count() == 1


def test_remote_tables_are_checked(spark, tmp_path):
    kind = "id long, qualified_name string"
    df = spark.createDataFrame([(70, "/r.ts#far")], kind)
    df.write.parquet(f"{tmp_path}/good")
    df.withColumnRenamed("qualified_name", "other").write.parquet(f"{tmp_path}/bad")
    df.write.parquet(f"{tmp_path}/new")
    (tmp_path / "new.version").write_text("999999")
    assert [tuple(r) for r in files.remote_nodes(spark, f"{tmp_path}/good").collect()] == [(70, "/r.ts#far", "far")]
    assert files.remote_nodes(spark, f"{tmp_path}/bad") is files.remote_nodes(spark, f"{tmp_path}/new") is files.remote_nodes(spark, f"{tmp_path}/none") is None
    raw = spark.createDataFrame([("/a#f", "far", "calls", True, 1), ("far", "/a#f", "calls", True, 1), ("/a#f", "none", "calls", True, 2)], "from_qname string, to_qname string, edge_type string, dynamic boolean, call_site_line int")
    nodes = spark.createDataFrame([(1, "/a#f", "function")], "id long, qualified_name string, symbol_type string")
    got = ingest.resolved(raw, nodes, df)
    assert [(r.from_id, r.to_id) for r in got.collect()] == [(1, 70)] and ingest.resolved(raw, nodes).count() == 0


def test_backfill_keeps_messages(spark):
    log = spark.createDataFrame([("/a", f"h{i}", f"m{i}", "me", f"2025-01-0{i} 00:00:00") for i in range(1, 8)], "file_path string, commit_hash string, message string, author string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    row = history.file_commits(log).first()
    assert [c.hash for c in row.history] == ["h7", "h6", "h5", "h4", "h3"] and row.history[0].message == "m7" and row.history[0].date.startswith("2025-01-07T")


def test_layers_by_the_engine_that_runs_them(spark):
    nodes = spark.createDataFrame([(1, "/api/x", None), (2, "/z", None), (3, None, None), (4, "/a(?P<x>a)", None)], "id long, file_path string, tags array<string>")
    edges = spark.createDataFrame([], "id long, from_id long, to_id long, edge_type string")
    out = rules.drift(nodes, edges, {"layers": [{"name": "api", "pathPattern": "/api/"}, {"name": "odd", "pathPattern": "(?P<x>a)"}], "rules": []})
    assert out["unmapped"].first()[0] == 1 and {r.name: r.node_count for r in out["declared_layers"].collect()} == {"api": 1, "odd": 1}


def test_entry_hides_nothing_but_the_subpackage():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__"
    root = files.__file__.rsplit("/codeweft/", 1)[0]
    if not __import__("os").path.isdir(f"{root}/codeweft/llm"):
        pytest.skip("without the subpackage")
    assert subprocess.run(["python", "-c", code], cwd=root, capture_output=True).returncode != 0
