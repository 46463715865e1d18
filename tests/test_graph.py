import pytest
from pyspark.sql import functions as F

from codeweft import schema
from codeweft.operators import communities, cycles, deadcode, degree, export, lookup, overview, policies, risk, roles, rules, traverse
from codeweft.plans import graph, texts


def nodes_of(spark, *rows):
    full = []
    for r in rows:
        base = {f.name: None for f in schema.NODES.fields} | {"symbol_type": "method", "file_path": "test.ts", "visibility": "public", "language": "typescript", "is_generated": False, "version": 1}
        full.append(tuple((base | r)[f.name] for f in schema.NODES.fields))
    return spark.createDataFrame(full, schema.NODES)


def edges_of(spark, *rows):
    return spark.createDataFrame([(i + 1, a, b, t, i + 1, False) for i, (a, b, t) in enumerate(rows)], schema.EDGES)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def calls(spark, *pairs):
    return edges_of(spark, *[(a, b, "calls") for a, b in pairs])


@pytest.mark.parametrize(
    "pairs, depth, want",
    [
        ([(1, 2), (2, 3)], 5, {1: (0, [1]), 2: (1, [1, 2]), 3: (2, [1, 2, 3])}),
        ([(1, 2), (2, 1)], 5, {1: (0, [1]), 2: (1, [1, 2])}),
        ([(1, 2), (1, 3), (2, 4), (3, 4)], 5, {1: (0, [1]), 2: (1, [1, 2]), 3: (1, [1, 3]), 4: (2, [1, 2, 4])}),
        ([(1, 2), (2, 3), (3, 4)], 1, {1: (0, [1]), 2: (1, [1, 2])}),
        ([(1, 1), (1, 2), (1, 2)], 5, {1: (0, [1]), 2: (1, [1, 2])}),
    ],
)
def test_breadth_first(spark, pairs, depth, want):
    got = {r.id: (r.distance, list(r.path)) for r in traverse.bfs(calls(spark, *pairs), ids(spark, 1), depth).collect()}
    assert got == want


def test_incoming_types_and_dangling(spark):
    e = edges_of(spark, (1, 2, "calls"), (3, 2, "inherits"), (9, 1, "calls"))
    assert {r.id for r in traverse.bfs(e, ids(spark, 2), 5, incoming=True).collect()} == {1, 2, 3, 9}
    assert {r.id for r in traverse.bfs(e, ids(spark, 2), 5, incoming=True, edge_type="calls").collect()} == {1, 2, 9}
    n = nodes_of(spark, *[{"id": i, "qualified_name": f"n{i}"} for i in (1, 2, 3)])
    got = {r.id: r.impact_path for r in traverse.impact(n, e, ids(spark, 2)).collect()}
    assert got == {2: "n2", 1: "n1 -> n2", 3: "n3 -> n2"}
    assert traverse.bfs(e.limit(0), ids(spark, 2)).count() == 1 and traverse.bfs(e, ids(spark).limit(0)).count() == 0


def test_depth_first_takes_the_last_edge_first(spark):
    got = {r.place: (r.id, r.distance) for r in traverse.dfs(calls(spark, (1, 2), (1, 3), (3, 4), (4, 2)), 1).collect()}
    assert got == {0: (1, 0), 1: (3, 1), 2: (4, 2), 3: (2, 3)}


def test_degrees(spark):
    e = edges_of(spark, (1, 2, "calls"), (1, 2, "calls"), (2, 1, "dynamic_calls"), (1, 3, "inherits"), (None, 2, "calls"))
    got = {r.id: tuple(r)[1:] for r in degree.fan_metrics(e).collect()}
    assert got == {1: (0, 2, 1, 0), 2: (3, 0, 0, 1)}
    n = nodes_of(spark, {"id": 1, "fan_in": 9}, {"id": 3, "fan_in": 9})
    assert {r.id: r.fan_in for r in degree.reconciled(n, e).collect()} == {1: 0, 3: 0}
    assert {r.id: r.fan_in for r in degree.reconciled(n, e, ids(spark, 3)).collect()} == {1: 9, 3: 0}
    assert degree.ledger(n, e).first().total_calls_count == 3


def test_policies_support_and_confidence(spark):
    n = nodes_of(spark, *[{"id": i, "tags": ["role:utility"]} for i in range(1, 6)], *[{"id": 10 + i, "tags": ["role:service"]} for i in range(1, 6)], {"id": 99, "tags": []})
    five = [(i, 10 + i, "calls") for i in range(1, 6)]
    r = policies.latent_policies(n, edges_of(spark, *five)).collect()
    assert len(r) == 1 and (r[0].from_tag, r[0].to_tag, r[0]["count"], r[0].probability) == ("role:utility", "role:service", 5, 1.0) and "100.0%" in r[0].description
    assert policies.latent_policies(n, edges_of(spark, *five[:4])).count() == 0
    assert policies.latent_policies(n, edges_of(spark, *five, *[(1, 99, "calls")] * 4)).count() == 0


def test_risk_levels(spark):
    def row(i, churn, cc, fan):
        return {"id": i, "qualified_name": str(i), "history": [(f"h{k}", "m", "a", "2026-01-01") for k in range(churn)], "cyclomatic": cc, "fan_in": fan}

    n = nodes_of(spark, row(1, 20, 30, 50), row(2, 20, 15, 0), row(3, 15, 0, 0), row(4, 0, 0, 0), {"id": 5, "qualified_name": "5"})
    got = {r.id: (r.score, r.level) for r in risk.profiles(n).collect()}
    assert got == {1: (1.0, "CRITICAL"), 2: (0.55, "HIGH"), 3: (0.3, "MEDIUM"), 4: (0.0, "LOW"), 5: (0.0, "LOW")}
    p = risk.proposals(n, calls(spark, (4, 1), (3, 4)), ids(spark, 1, 4)).collect()
    assert {r.id: (r.impacted, r.risk) for r in p} == {1: (3, "CRITICAL"), 4: (2, "LOW")}


@pytest.mark.parametrize(
    "own, parent, want",
    [
        (["role:service"], ["role:repository"], {"role:service", "role:repository"}),
        (["role:utility"], ["role:repository"], {"role:repository"}),
        ([], ["role:utility"], {"role:utility"}),
        (["role:service"], ["role:utility"], {"role:service"}),
        (["trait:internal"], ["role:service"], {"trait:internal"}),
        (None, ["layer:api"], set()),
    ],
)
def test_merging_roles(spark, own, parent, want):
    df = spark.createDataFrame([(own, parent)], "a array<string>, b array<string>")
    assert set(df.select(roles.merge_roles(F.col("a"), F.col("b"))).first()[0]) == want


@pytest.mark.parametrize("local", [0, 1000])
def test_roles_spread_over_hops_and_loops(spark, local):
    n = nodes_of(spark, {"id": 1, "tags": ["role:repository"]}, {"id": 2, "tags": ["role:service"]}, {"id": 3, "tags": ["role:controller"]}, {"id": 4, "tags": ["role:parser"]}, {"id": 5, "tags": ["role:server"]}, {"id": 6, "tags": None}, {"id": 7, "tags": ["role:utility"]}, {"id": 8, "tags": ["trait:internal"]})
    e = edges_of(spark, (6, 7, "inherits"), (7, 1, "inherits"), (8, 1, "inherits"), (2, 99, "inherits"), (None, 1, "inherits"), (2, 1, "inherits"), (3, 2, "implements"), (4, 5, "inherits"), (5, 4, "inherits"))
    got = {r.id: set(r.tags) for r in roles.inherited(n, e, local_links=local).collect()}
    assert got[3] == {"role:controller", "role:service", "role:repository"} and got[4] == got[5] == {"role:parser", "role:server"}
    assert got[6] == got[7] == {"role:repository"} and got[8] == {"trait:internal"}
    again = n.drop("tags").join(roles.inherited(n, e, local_links=local), "id")
    assert {r.id: set(r.tags) for r in roles.inherited(again, e, local_links=local).collect()} == got


def test_structural_tags(spark):
    n = nodes_of(
        spark,
        {"id": 1, "qualified_name": "src/db/x.ts#UserRepository", "file_path": "src/db/x.ts", "symbol_type": "class"},
        {"id": 2, "qualified_name": "src/main.ts", "file_path": "src/main.ts", "symbol_type": "file"},
        {"id": 3, "qualified_name": "a#_x", "file_path": None, "modifiers": ["Static"], "visibility": None, "tags": ["own"]},
    )
    got = {r.id: r.t for r in n.select("id", roles.structural_tags().alias("t")).collect()}
    assert got == {1: ["layer:data", "role:repository", "trait:public"], 2: ["trait:public", "trait:entrypoint"], 3: ["own", "trait:static", "trait:internal"]}


def test_violations_and_remedies(spark):
    n = nodes_of(
        spark,
        {"id": 1, "qualified_name": "a/core.ts#C", "file_path": "a/core.ts", "tags": ["layer:core"]},
        {"id": 2, "qualified_name": "a/api.ts#A", "file_path": "a/api.ts", "tags": ["Layer:API"]},
        {"id": 3, "qualified_name": "a/core.ts#D", "file_path": "a/core.ts", "tags": ["layer:api"]},
        {"id": 4, "qualified_name": "b/db.ts#R", "file_path": "b/db.ts", "tags": ["role:repository", "trait:internal"]},
        {"id": 5, "qualified_name": "c/db.ts#R", "file_path": "c/db.ts", "tags": ["role:repository"]},
    )
    e = edges_of(spark, (1, 2, "calls"), (1, 3, "calls"), (5, 4, "calls"), (4, 5, "calls"), (1, 2, "contains"), (1, 77, "calls"))
    found = rules.policy_violations(n, e)
    assert {(r.edge_id, r.policy_id) for r in found.collect()} == {(1, "layer-hierarchy"), (1, "api-integrity"), (4, "domain-isolation")}
    assert {r.edge_id: r.strategy for r in risk.remedies(found, n).collect()}[4] == "Service-Layer Orchestration"
    assert risk.remedies(found.withColumn("to_id", F.lit(77).cast("long")), n).first().strategy == "Insufficient Violation Data"
    own = rules.path_violations(n, e, [{"name": "r", "from": "b", "to": "c", "allowed": False}, {"name": "s", "from": "a", "to": "a", "allowed": True}])
    assert [(r.edge_id, r.policy_id) for r in own.collect()] == [(4, "custom:r")]
    assert [(r.from_id, r.to_id) for r in rules.cycle_violations(n, e).collect()] == [(4, 5)]


def test_dead_code(spark):
    n = nodes_of(
        spark,
        {"id": 1, "qualified_name": "f#a", "visibility": "private"},
        {"id": 2, "qualified_name": "f#b"},
        {"id": 3, "qualified_name": "f#c", "tags": ["trait:internal"]},
        {"id": 4, "qualified_name": "f#Constructor"},
        {"id": 5, "qualified_name": "f#d", "fan_in": 2},
        {"id": 6, "qualified_name": "f#e"},
        {"id": 7, "qualified_name": "f#K", "symbol_type": "class"},
    )
    e = edges_of(spark, (7, 6, "contains"), (7, 1000, "implements"))
    got = {r.id: (r.high, r.medium, r.low) for r in deadcode.candidates(n, e).collect()}
    assert got == {1: (True, False, False), 2: (False, True, True), 3: (False, True, False), 7: (False, False, False)}
    assert tuple(deadcode.summary(n, e).first()) == (7, 1, 2, 1, 4, "57.14%")
    assert deadcode.summary(n.limit(0), e).first().ratio == "0.00%"


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, rows, local):
    links = cycles.dependency_links(calls(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (5, 7), (8, 8)))
    assert rows(cycles.components(links, local)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert rows(cycles.two_cycles(links)) == [(4, 5)]


def test_label_propagation(spark):
    pairs = [(a, b) for base in (0, 10, 20) for a in range(base, base + 4) for b in range(base, base + 4) if a != b] + [(3, 10), (13, 20)]
    n = nodes_of(spark, *[{"id": i, "file_path": f"f{i}"} for base in (0, 10, 20) for i in range(base, base + 4)], {"id": 99, "file_path": "x"})
    label = {r.id: r.label for r in communities.propagate(n, calls(spark, *pairs)).collect()}
    assert len({label[i] for i in range(4)}) == len({label[i] for i in range(10, 14)}) == 1 and label[99] == 99
    draw = communities.mulberry32(1)
    assert [draw(), draw(), draw()] == [0.6270739405881613, 0.002735721180215478, 0.5274470399599522]
    same = [communities.propagate_seeded(list(range(4)), [(0, 1), (1, 2), (2, 3)], {}, 7) for _ in range(2)]
    assert same[0] == same[1]


def test_lookups(spark, rows):
    n = nodes_of(spark, {"id": 1, "qualified_name": "a", "symbol_name": "Foo", "tags": ["Layer:Core"], "loc": 5, "docstring": "", "signature": "s"}, {"id": 2, "symbol_name": "fOO", "loc": None})
    assert rows(lookup.by_symbol_name(n, "FOO").select("id")) == [(1,), (2,)]
    assert rows(lookup.with_tag(n, "layer:core").select("id")) == [(1,)] and lookup.edges_of_types(calls(spark, (1, 2)), []).count() == 0
    with pytest.raises(ValueError):
        lookup.at_least(n, "password")
    assert lookup.as_json(lookup.structured(n).filter("qname = 'a'")).first()[0] == '{"qname":"a","type":"method","file":"test.ts","signature":"s","tags":["Layer:Core"]}'
    assert rows(lookup.neighbours(n, calls(spark, (9, 1), (2, 1)), 1, True).select("qualified_name")) == [(None,), (None,)]


def test_cluster_types_and_names(spark):
    n = nodes_of(spark, {"id": 1, "qualified_name": "a", "fan_in": 9, "fan_out": 1, "cyclomatic": 0}, {"id": 2, "qualified_name": "b", "fan_in": 0, "fan_out": 2, "cyclomatic": 4}, {"id": 3, "qualified_name": "c", "cyclomatic": 1})
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, label long")
    got = overview.named_clusters(labels, n).collect()
    assert [(r.name, r.node_count, r.avg_complexity, r.central_symbol_qname) for r in got] == [("cluster_1_utility", 2, 2.5, "b")]


def test_exports_escape(spark):
    n = nodes_of(spark, {"id": 1, "qualified_name": 'a<"&'}, {"id": 2, "qualified_name": "remote:p:x", "remote_project_path": "/p"})
    e = calls(spark, (1, 2))
    assert '    <node id="a&lt;&quot;&amp;"/>' in export.document(export.graphml(n, e))
    assert '  "a<\\"&" -> "remote:p:x";' in export.document(export.dot(n, e))
    assert '  N2["[p] method: remote:p:x"]:::remote' in export.document(export.mermaid(n, e))


def test_every_type_of_node_is_embedded(spark, tmp_path):
    kinds = ("file", "class", "function", "method", "Method ", None)
    n = nodes_of(spark, *[{"id": i, "qualified_name": f"a#{i}", "symbol_type": k} for i, k in enumerate(kinds)])
    n.write.parquet(f"{tmp_path}/nodes.parquet")
    assert {r.id for r in texts.embedded_symbols(spark, str(tmp_path)).collect()} == set(range(len(kinds)))


def test_impact_paths_run_through_unknown_ids_and_odd_names(spark, tmp_path):
    names = {1: "n1", 3: "n3", 4: "a -> b"}  # 2 has no node
    nodes_of(spark, *[{"id": i, "qualified_name": q} for i, q in names.items()]).write.parquet(f"{tmp_path}/nodes.parquet")
    calls(spark, (2, 1), (3, 2), (4, 1)).write.parquet(f"{tmp_path}/edges.parquet")
    got = {r.id: (r.distance, r.impact_path) for r in graph.impact_paths(spark, str(tmp_path)).collect()}
    assert got == {1: (0, "n1"), 3: (2, "n3 -> n1"), 4: (1, "a -> b -> n1")}


def test_a_bound_that_is_hit_is_an_error(spark, rows):
    n = nodes_of(spark, {"id": 0, "tags": ["role:service"]}, *[{"id": i, "tags": []} for i in range(1, 6)])
    e = edges_of(spark, *[(i, i - 1, "inherits") for i in range(1, 6)])
    with pytest.raises(ValueError):
        roles.inherited(n, e, rounds=2, local_links=0)
    assert {tuple(r.tags) for r in roles.inherited(n, e, local_links=0).collect()} == {("role:service",)}
    links = cycles.dependency_links(calls(spark, (1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 5)))
    with pytest.raises(ValueError):
        cycles.components(links, 0, rounds=1)
    assert rows(cycles.components(links, 0)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)]
