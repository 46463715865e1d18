"""Queries of the graph operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.arrays import tags
from codeweft.functions.names import ascii_fold, canonical, canonical_name, folded, symbol_name
from codeweft.operators import (
    communities, consistency, cycles, deadcode, degree, export, history, ingest, lookup, overview, policies, risk, roles, rules, search, traverse, vectors,
)
from codeweft.operators.orphans import epoch
from codeweft.plans.general import name_sql
from codeweft.sources.tables import clean_edges, current, current_nodes, nodes_of, nodes_where, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Current nodes with folded types and languages, and distinct edges with folded types.
_BASE = """cur as (select * replace (lower(trim(symbol_type)) as symbol_type, lower(trim(language)) as language)
    from (select distinct on (id) * from nodes where id is not null order by id, version desc nulls last)),
  e as (select distinct on (id) * replace (lower(trim(edge_type)) as edge_type) from edges order by id)"""
_RULES = [
    {"name": "no-utils-to-db", "from": "utils", "to": "db", "allowed": False},
    {"name": "no-db-to-api", "from": "db", "to": "api", "allowed": False},
    {"name": "api-to-db", "from": "api", "to": "db", "allowed": True},
]
_INTENT = {"layers": [{"name": "api", "pathPattern": "/(api|server)/"}, {"name": "data", "pathPattern": "/db/"}, {"name": "broken", "pathPattern": "(["}, {"name": "none", "pathPattern": "^nowhere/"}], "rules": _RULES}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name, with its SQL over the base tables if it has one."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {'recursive ' * recursive}{_BASE} {sql}"
        return f

    return put


def N(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_nodes(spark, d, *columns)


def E(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    return clean_edges(spark, d, *columns, where=where)


def _or(value: int | None, other: int = -1) -> int:
    return other if value is None else value


def _start(spark: SparkSession, d: str) -> DataFrame:
    """(id): the lowest id that a calls edge goes to."""
    return table(spark, d, "edges", "to_id", "edge_type").filter(folded("edge_type") == "calls").agg(F.min("to_id").alias("id"))


def _caller(spark: SparkSession, d: str) -> int:
    """The lowest id that a calls edge comes from."""
    return _or(table(spark, d, "edges", "from_id", "edge_type").filter(folded("edge_type") == "calls").agg(F.min("from_id")).first()[0])


_START = "(select min(to_id) from e where edge_type = 'calls')"


# -- scans, lookups, filters -------------------------------------------------------------------------------------------


@query("select id, qualified_name, symbol_type, language, visibility from cur where symbol_type = 'method' and language = 'typescript' and visibility = 'public'")
def scan_filter_nodes(spark, d):
    own = (F.col("symbol_type") == "method") & (F.col("language") == "typescript") & (F.col("visibility") == "public")
    return lookup.matching(nodes_where(spark, d, own, "qualified_name", "symbol_type", "language", "visibility"), "method", "typescript", "public")


@query("select id, symbol_type from cur where id = (select min(id) from nodes)")
def point_lookup(spark, d):
    least = table(spark, d, "nodes", "id").agg(F.min("id")).first()[0]
    return lookup.by_id(N(spark, d, "symbol_type"), _or(least))


@query("select id, qualified_name from cur where qualified_name = (select min(qualified_name) from nodes)")
def name_lookup(spark, d):
    name = table(spark, d, "nodes", "qualified_name").agg(F.min("qualified_name")).first()[0] or ""
    return lookup.by_qualified_name(nodes_where(spark, d, F.col("qualified_name") == name, "qualified_name"), name)


@query("select id, symbol_name from cur where lower(symbol_name) = (select lower(min(symbol_name)) from nodes where symbol_type = 'class')")
def name_lookup_nocase(spark, d):
    name = table(spark, d, "nodes", "symbol_name", "symbol_type").filter("symbol_type = 'class'").agg(F.min("symbol_name")).first()[0]
    name = (name or "").upper()
    return lookup.by_symbol_name(nodes_where(spark, d, ascii_fold("symbol_name") == ascii_fold(F.lit(name)), "symbol_name"), name)


@query("select id, qualified_name, start_line from cur where file_path = (select min(file_path) from nodes where symbol_type = 'class')")
def file_lookup(spark, d):
    """(id, qualified_name, start_line) of the symbols of one file."""
    path = table(spark, d, "nodes", "file_path", "symbol_type").filter("symbol_type = 'class'").agg(F.min("file_path")).first()[0] or ""
    return lookup.by_file(nodes_where(spark, d, F.col("file_path") == path, "qualified_name", "start_line", "file_path"), path).drop("file_path")


@query("select distinct file_path from cur")
def distinct_files(spark, d):
    return lookup.file_paths(N(spark, d, "file_path"))


@query("select id, from_id, to_id, edge_type from e where edge_type in ('inherits', 'implements')")
def edge_type_scan(spark, d):
    kinds = ["inherits", "implements"]
    return lookup.edges_of_types(E(spark, d, "from_id", "to_id", "edge_type", where=F.col("edge_type").isin(*kinds)), kinds)


@query("select id, loc from cur where loc >= 100")
def threshold_filter(spark, d):
    return lookup.at_least(N(spark, d, "loc"), "loc", 100).select("id", "loc")


@query("select id from cur where list_contains(list_transform(coalesce(tags, []), lambda x: lower(x)), 'layer:api')")
def tag_filter(spark, d):
    return lookup.with_tag(N(spark, d, "tags"), "Layer:API").select("id")


@query("""select qualified_name qname, symbol_type "type", file_path file, nullif(signature, '') signature, nullif(substr(docstring, 1, 200), '') docstring_snippet,
  case when len(tags) > 0 then array_to_string(tags, ',') end tags, case when fan_in > 0 then fan_in end fan_in from cur""")
def structured_results(spark, d):
    own = N(spark, d, "qualified_name", "symbol_type", "file_path", "signature", "docstring", "tags", "fan_in")
    return lookup.structured(own).withColumn("tags", F.array_join("tags", ","))


# -- neighbours and degrees --------------------------------------------------------------------------------------------


@query(f"select n.qualified_name, e.call_site_line, e.edge_type from e left join cur n on n.id = e.from_id where e.to_id = {_START}")
def callers(spark, d):
    own = _or(_start(spark, d).first()[0])
    near = E(spark, d, "from_id", "to_id", "edge_type", "call_site_line", where=F.col("to_id") == own)
    return lookup.neighbours(nodes_of(spark, d, near.select(F.col("from_id").alias("id")), "qualified_name"), near, own, True)


@query("select n.qualified_name, e.call_site_line, e.edge_type from e left join cur n on n.id = e.to_id where e.from_id = (select min(from_id) from e where edge_type = 'calls')")
def callees(spark, d):
    own = _caller(spark, d)
    near = E(spark, d, "from_id", "to_id", "edge_type", "call_site_line", where=F.col("from_id") == own)
    return lookup.neighbours(nodes_of(spark, d, near.select(F.col("to_id").alias("id")), "qualified_name"), near, own, False)


@query(f"select n.qualified_name from e join cur n on n.id = e.from_id where e.to_id = {_START} and (lower(n.file_path) like '%test%' or lower(n.file_path) like '%spec%')")
def test_callers(spark, d):
    own = _or(_start(spark, d).first()[0])
    near = E(spark, d, "from_id", "to_id", where=F.col("to_id") == own)
    return lookup.test_callers(nodes_of(spark, d, near.select(F.col("from_id").alias("id")), "qualified_name", "file_path"), near, own)


_FANS = """fans as (select id, cast(count(*) filter (t = 'calls' and inward) as integer) fan_in, cast(count(*) filter (t = 'calls' and not inward) as integer) fan_out,
    cast(count(*) filter (t <> 'calls' and inward) as integer) fan_in_dynamic, cast(count(*) filter (t <> 'calls' and not inward) as integer) fan_out_dynamic
  from (select to_id id, edge_type t, true inward from e where edge_type in ('calls', 'dynamic_calls') union all
        select from_id, edge_type, false from e where edge_type in ('calls', 'dynamic_calls')) where id is not null group by id)"""


@query(f", {_FANS} select * from fans")
def fan_metrics(spark, d):
    return degree.fan_metrics(E(spark, d, "from_id", "to_id", "edge_type"))


@query(f", {_FANS} select c.id, coalesce(f.fan_in, 0) fan_in, coalesce(f.fan_out, 0) fan_out, coalesce(f.fan_in_dynamic, 0) fan_in_dynamic, coalesce(f.fan_out_dynamic, 0) fan_out_dynamic from cur c left join fans f on f.id = c.id")
def reconciled_fans(spark, d):
    names = ("fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic")
    return degree.reconciled(N(spark, d, *names), E(spark, d, "from_id", "to_id", "edge_type")).select("id", *names)


@query("select count(*) filter (edge_type = 'calls') total_calls_count, count(*) filter (edge_type = 'dynamic_calls') total_dynamic_calls_count from e")
def call_counters(spark, d):
    return degree.call_counters(E(spark, d, "edge_type"))


@query("""select (select count(*) filter (edge_type = 'calls') from e) total_calls_count, (select count(*) filter (edge_type = 'dynamic_calls') from e) total_dynamic_calls_count,
  cast(coalesce(sum(fan_in), 0) as bigint) sum_fan_in, cast(coalesce(sum(fan_out), 0) as bigint) sum_fan_out, cast(coalesce(sum(fan_in_dynamic), 0) as bigint) sum_fan_in_dynamic,
  cast(coalesce(sum(fan_out_dynamic), 0) as bigint) sum_fan_out_dynamic from cur""")
def ledger(spark, d):
    return degree.ledger(N(spark, d, "fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic"), E(spark, d, "edge_type"))


# -- overview ----------------------------------------------------------------------------------------------------------


@query("select (select count(*) from cur) nodes, (select count(distinct file_path) from cur) files, (select count(*) from e) edges")
def overview_counts(spark, d):
    return overview.counts(N(spark, d, "file_path"), E(spark, d, "edge_type"))


@query("select language, count(*) n from cur where symbol_type not in ('file', 'section') group by language order by n desc, language nulls last limit 8")
def lang_histogram(spark, d):
    return overview.languages(N(spark, d, "symbol_type", "language"))


@query("select tag, count(*) n from (select unnest(tags) tag from cur) where tag like 'layer:%' group by tag")
def layer_histogram(spark, d):
    return overview.layers(N(spark, d, "tags"))


def _hotspots(metric: str, limit: int, where: str = "") -> str:
    return f"select id, qualified_name, symbol_type, {metric} from cur where {metric} >= 0 {where} order by {metric} desc, qualified_name, id limit {limit}"


@query(_hotspots("loc", 20))
def hotspots_loc(spark, d):
    return overview.hotspots(N(spark, d, "qualified_name", "symbol_type", "loc"), "loc")


@query(_hotspots("fan_in", 100))
def hotspots_fan_in(spark, d):
    return overview.hotspots(N(spark, d, "qualified_name", "symbol_type", "fan_in"), "fan_in", 100)


@query(_hotspots("cyclomatic", 10, "and symbol_type = 'method'"))
def hotspots_by_type(spark, d):
    return overview.hotspots(N(spark, d, "qualified_name", "symbol_type", "cyclomatic"), "cyclomatic", 10, symbol_type="method")


@query("select id, qualified_name, symbol_type, fan_in from cur where fan_in > 0 and symbol_type not in ('file', 'section') order by fan_in desc, qualified_name, id limit 8")
def overview_hotspots(spark, d):
    return overview.overview_hotspots(N(spark, d, "qualified_name", "symbol_type", "fan_in"))


@query("select id, qualified_name from cur where list_contains(tags, 'trait:entrypoint') order by id limit 10")
def entry_points(spark, d):
    return overview.entry_points(N(spark, d, "qualified_name", "tags"))


@query("select id, qualified_name from cur where symbol_type = 'section' order by qualified_name, id limit 20")
def doc_sections(spark, d):
    return overview.sections(N(spark, d, "qualified_name", "symbol_type"))


@query("select id, name, cluster_type, avg_complexity from logical_clusters order by name, id limit 10")
def clusters_by_name(spark, d):
    return overview.clusters_by_name(table(spark, d, "logical_clusters", "id", "name", "cluster_type", "avg_complexity").dropDuplicates(["id"]))


@query("select c.id, c.name, count(n.id) node_count from logical_clusters c left join cur n on n.cluster_id = c.id group by c.id, c.name")
def cluster_sizes(spark, d):
    return overview.cluster_sizes(N(spark, d, "cluster_id"), table(spark, d, "logical_clusters", "id", "name").dropDuplicates(["id"]))


@query("""select cluster_id, count(*) node_count, round(avg(cc), 6) avg_complexity, cast(sum(i) as bigint) sum_in, cast(sum(o) as bigint) sum_out,
    max_by(qualified_name, o * cc * cast(1000000000000 as hugeint) - id) central_symbol_qname,
    case when sum(i) > 2 * sum(o) then 'utility' when sum(o) > 5 and avg(cc) > 5 then 'core' else 'domain' end cluster_type
  from (select *, case when coalesce(cyclomatic, 0) = 0 then 1 else cyclomatic end cc, coalesce(fan_in, 0) i, coalesce(fan_out, 0) o from cur where cluster_id is not null) group by cluster_id""")
def cluster_profile(spark, d):
    own = overview.cluster_profiles(N(spark, d, "cluster_id", "cyclomatic", "fan_in", "fan_out", "qualified_name"))
    return own.withColumn("avg_complexity", F.round("avg_complexity", 6))


# -- traversal ---------------------------------------------------------------------------------------------------------

_WALK = """walk as (select {start} id, 0 distance union select e.{other}, w.distance + 1 from walk w join e on e.{own} = w.id where w.distance < {depth} and e.{other} is not null),
  reached as (select id, min(distance) distance from walk where id is not null group by id)"""


@query("," + _WALK.format(start=_START, own="to_id", other="from_id", depth=5) + " select r.id, c.qualified_name, r.distance from reached r join cur c on c.id = r.id", recursive=True)
def impact_bfs(spark, d):
    own = traverse.bfs(E(spark, d), _start(spark, d), 5, incoming=True)
    return own.join(N(spark, d, "qualified_name"), "id").select("id", "qualified_name", "distance")


@query(
    "," + _WALK.format(start=_START, own="to_id", other="from_id", depth=3)
    + """, best as (select r.id, r.distance, cast(r.id as varchar) ids, concat_ws(' -> ', c.qualified_name) impact_path from reached r left join cur c on c.id = r.id where r.distance = 0 union all
      select r.id, r.distance, b.ids || ',' || r.id, concat_ws(' -> ', c.qualified_name, b.impact_path) from best b join (
        select r.id, r.distance, min(e.to_id) parent from reached r join e on e.from_id = r.id join reached p on p.id = e.to_id and p.distance = r.distance - 1 group by all) r
        on r.parent = cast(list_extract(string_split(b.ids, ','), -1) as bigint) and r.distance = b.distance + 1 left join cur c on c.id = r.id)
      select b.id, distance, impact_path from best b join cur c on c.id = b.id""",
    recursive=True,
)
def impact_paths(spark, d):
    """(id, distance, impact_path) of what reaches the start in three steps; a step without a node has no name in the path."""
    whole = traverse.impact(N(spark, d, "qualified_name"), E(spark, d), _start(spark, d), 3)
    return whole.select("id", "distance", "impact_path")


@query(",walk as (select (select min(from_id) from e where edge_type = 'calls') id, 0 distance union select e.to_id, w.distance + 1 from walk w join e on e.from_id = w.id where w.distance < 2 and e.to_id is not null), reached as (select id, min(distance) distance from walk group by id) select r.id, c.qualified_name, r.distance from reached r join cur c on c.id = r.id where r.distance > 0", recursive=True)
def callees_depth2(spark, d):
    edges = E(spark, d)
    start = edges.filter("edge_type = 'calls'").agg(F.min("from_id").alias("id"))
    return traverse.reachable(N(spark, d, "qualified_name"), edges, start, 2, incoming=False).select("id", "qualified_name", "distance")


_SUB = """f as (select id from cur where symbol_type = 'file' order by id limit 10),
  sub as (select id from f union select e.to_id from e join f on f.id = e.from_id where e.to_id in (select id from cur))"""


@query(f", {_SUB} select id, from_id, to_id, edge_type from e where from_id in (select id from sub) and to_id in (select id from sub)")
def subgraph_edges(spark, d):
    return traverse.subgraph(N(spark, d, "symbol_type"), E(spark, d))[1].select("id", "from_id", "to_id", "edge_type")


@query()
def dfs_order(spark, d):
    """(id, distance, place) of the depth-first walk down three steps from the lowest calling id."""
    edges = E(spark, d)
    least = edges.filter("edge_type = 'calls'").agg(F.min("from_id")).first()[0]
    return traverse.dfs(edges, least if least is not None else -1, 3)


#: Components: what a hub reaches and is reached by is one; the pairs that reach each other in the rest are the others.
_SCC = """l as (select distinct from_id a, to_id b from e where edge_type in ('calls', 'dynamic_calls', 'inherits', 'implements', 'depends_on') and from_id <> to_id),
  hub as (select b id from l group by b order by count(*) desc, b limit 1),
  fw as (select id from hub union select l.b from fw join l on l.a = fw.id), bw as (select id from hub union select l.a from bw join l on l.b = bw.id),
  giant as (select id from fw intersect select id from bw), rest as (select a, b from l where a not in (select id from giant) and b not in (select id from giant)),
  reach as (select a, b from rest union select r.a, n.b from reach r join rest n on n.a = r.b),
  scc as (select id, (select min(id) from giant) component from giant where (select count(*) from giant) > 1
    union all select x.a, min(least(x.a, x.b)) from reach x join reach y on y.a = x.b and y.b = x.a where x.a <> x.b group by x.a)"""


# -- communities and cycles --------------------------------------------------------------------------------------------


@query()
def lpa_clusters(spark, d):
    """(id, label) by synchronous label propagation over all edges."""
    return communities.propagate(N(spark, d, "file_path"), E(spark, d, "from_id", "to_id"))


@query()
def lpa_profiles(spark, d):
    """The clusters of label propagation, numbered and described."""
    nodes = N(spark, d, "file_path", "symbol_type", "cyclomatic", "fan_in", "fan_out", "qualified_name")
    return overview.named_clusters(communities.propagate(nodes, E(spark, d, "from_id", "to_id")), nodes)


_DEP = "dep as (select distinct from_id a, to_id b from e where edge_type in ('calls', 'dynamic_calls', 'inherits', 'implements', 'depends_on') and from_id <> to_id)"


@query(f", {_DEP} select x.a, x.b from dep x join dep y on y.a = x.b and y.b = x.a where x.a < x.b")
def two_cycles(spark, d):
    return cycles.two_cycles(cycles.dependency_links(E(spark, d, "from_id", "to_id", "edge_type")))


@query(f", {_SCC} select * from scc", recursive=True)
def scc_members(spark, d):
    """(id, component) of the strongly connected dependencies."""
    return cycles.components(cycles.dependency_links(E(spark, d, "from_id", "to_id", "edge_type")))


# -- dead code, rules, policies, risk ----------------------------------------------------------------------------------

_DEAD = """dead as (select n.*, coalesce(visibility = 'private', false) high, coalesce(visibility = 'public' and symbol_type not in ('class', 'interface', 'function'), false) medium from cur n
  where coalesce(fan_in, 0) = 0 and symbol_type not in ('file', 'test', 'package') and lower(qualified_name) not like '%#constructor'
    and not coalesce(list_contains(tags, 'trait:entrypoint'), false) and not coalesce(list_contains(tags, 'trait:abstract'), false)
    and not exists (select 1 from e c where c.edge_type = 'contains' and c.to_id = n.id and exists (select 1 from e i where i.edge_type in ('implements', 'inherits') and i.from_id = c.from_id)))"""
_LOW = "(medium and not coalesce(list_contains(tags, 'trait:internal'), false))"


def _dead(tier: str) -> Callable:
    def run(spark, d):
        nodes = N(spark, d, "qualified_name", "symbol_type", "visibility", "fan_in", "tags")
        return deadcode.candidates(nodes, E(spark, d, "from_id", "to_id", "edge_type")).filter(tier).select("id", "qualified_name")

    run.__name__ = f"dead_{tier}"
    return run


for _t, _w in (("high", "high"), ("medium", "medium"), ("low", _LOW)):
    query(f", {_DEAD} select id, qualified_name from dead where {_w}")(_dead(_t))


@query(
    f", {_DEAD}, s as (select (select count(*) from cur) total_symbols, count(*) filter (high) high, count(*) filter (medium) medium, count(*) filter ({_LOW}) low from dead) "
    "select *, high + medium + low dead_symbols, printf('%.2f', (high + medium + low) / total_symbols * 100) || '%' ratio from s"
)
def dead_summary(spark, d):
    return deadcode.summary(N(spark, d, "qualified_name", "symbol_type", "visibility", "fan_in", "tags"), E(spark, d, "from_id", "to_id", "edge_type"))


_ENDS = """ends as (select e.id edge_id, e.from_id, e.to_id, e.edge_type, f.file_path f_file, t.file_path t_file, split_part(f.qualified_name, '#', 1) f_prefix, split_part(t.qualified_name, '#', 1) t_prefix,
    list_transform(coalesce(f.tags, []), lambda x: lower(x)) f_tags, list_transform(coalesce(t.tags, []), lambda x: lower(x)) t_tags from e join cur f on f.id = e.from_id join cur t on t.id = e.to_id)"""
_POLICY_ROWS = ", ".join(f"('{p}', '{a}', '{b}')" for p, a, b in rules.POLICIES)
_POLICY = f"""select edge_id, from_id, to_id, p.id policy_id, 'Illegal relationship: ' || p.a || ' -> ' || p.b description from ends, (values {_POLICY_ROWS}) p(id, a, b)
  where edge_type in {rules.POLICY_EDGES} and f_file <> t_file and f_prefix <> t_prefix and list_contains(f_tags, p.a) and list_contains(t_tags, p.b)
    and not (p.id = 'domain-isolation' and list_contains(t_tags, 'trait:internal'))"""
_CUSTOM_ROWS = ", ".join(f"('{r['name']}', '{r['from']}', '{r['to']}')" for r in _RULES if not r["allowed"])
_CUSTOM = f"""select edge_id, from_id, to_id, 'custom:' || r.name policy_id, 'Custom rule violation "' || r.name || '": ' || r.a || ' -> ' || r.b || ' is not allowed' description from ends, (values {_CUSTOM_ROWS}) r(name, a, b)
  where edge_type in {rules.RULE_EDGES} and f_file is distinct from t_file and list_contains(string_split(replace(f_file, '\\', '/'), '/'), r.a) and list_contains(string_split(replace(t_file, '\\', '/'), '/'), r.b)"""


@query(f", {_ENDS} {_POLICY}")
def arch_policy_violations(spark, d):
    return rules.policy_violations(N(spark, d, "qualified_name", "file_path", "tags"), E(spark, d, "from_id", "to_id", "edge_type"))


@query(f", {_ENDS} {_CUSTOM}")
def arch_custom_violations(spark, d):
    return rules.path_violations(N(spark, d, "file_path"), E(spark, d, "from_id", "to_id", "edge_type"), _RULES)


@query(
    f""", {_ENDS}, {_SCC}, sized as (select component, count(*) n from scc group by component),
  loops as (select cast(null as bigint) edge_id, s.component from_id, min(l.b) to_id, 'circular-dependency' policy_id, 'Circular dependency of ' || s.n || ' symbols' description
    from sized s join l on l.a = s.component join scc i on i.id = l.b and i.component = s.component group by s.component, s.n)
  select * from ({_POLICY}) union all select * from ({_CUSTOM}) union all select * from loops""",
    recursive=True,
)
def arch_violations(spark, d):
    """All violations, cycles too."""
    return rules.violations(N(spark, d, "qualified_name", "file_path", "tags"), E(spark, d, "from_id", "to_id", "edge_type"), _RULES)


@query("""select name, count(*) filter (hit) node_count, count(*) filter (hit) > 0 mapped from (
  select l.name, case when l.name = 'broken' then contains(p, '([') when l.name = 'api' then regexp_matches(p, '/(api|server)/') when l.name = 'data' then regexp_matches(p, '/db/') else regexp_matches(p, '^nowhere/') end hit
  from (select replace(file_path, '\\', '/') p from cur where file_path <> ''), (values ('api'), ('data'), ('broken'), ('none')) l(name)) group by name""")
def drift_layers(spark, d):
    return rules.drift(N(spark, d, "file_path", "tags"), E(spark, d, "from_id", "to_id", "edge_type"), _INTENT)["declared_layers"]


@query(f""", {_ENDS}, hits as (select policy_id, count(*) n from ({_CUSTOM}) group by policy_id)
  select r.name, coalesce(n, 0) violations, case when n > 0 then 'violated' else 'healthy' end status from (values ('no-utils-to-db'), ('no-db-to-api'), ('api-to-db')) r(name) left join hits on policy_id = 'custom:' || r.name""")
def drift_rules(spark, d):
    return rules.drift(N(spark, d, "file_path", "tags"), E(spark, d, "from_id", "to_id", "edge_type"), _INTENT)["rule_health"]


@query("select count(*) unmapped from (select replace(coalesce(file_path, ''), '\\', '/') p from cur) where p <> '' and not (regexp_matches(p, '/(api|server)/') or regexp_matches(p, '/db/') or contains(p, '([') or regexp_matches(p, '^nowhere/'))")
def drift_unmapped(spark, d):
    """How many nodes lie in no declared layer."""
    return rules.drift(N(spark, d, "file_path", "tags"), E(spark, d, "from_id", "to_id", "edge_type"), _INTENT)["unmapped"]


@query()
def drift_emergent(spark, d):
    """Latent policies that no rule declares."""
    return rules.drift(N(spark, d, "file_path", "tags"), E(spark, d, "from_id", "to_id", "edge_type"), _INTENT)["emergent"]


_LATENT = """d as (select list_distinct(f.tags) f, list_distinct(t.tags) t from e join cur f on f.id = e.from_id join cur t on t.id = e.to_id
    where e.edge_type in ('calls', 'dynamic_calls', 'inherits', 'implements', 'depends_on') and f.tags is not null and t.tags is not null),
  tot as (select from_tag, count(*) total from (select unnest(f) from_tag from d) group by from_tag),
  pair as (select from_tag, to_tag, count(*) n from (select from_tag, unnest(t) to_tag from (select unnest(f) from_tag, t from d)) group by all)
  select from_tag, to_tag, n count, total, round(n / total, 6) probability,
    'Implicit Policy: Components tagged ''' || from_tag || ''' consistently depend on ''' || to_tag || ''' (' || printf('%.1f', n / total * 100) || '% of cases).' description
  from pair join tot using (from_tag) where total >= {c} and n >= {c} and n / total >= {p}"""


@query("," + _LATENT.format(c=5, p=0.3))
def latent_policies(spark, d):
    own = policies.latent_policies(N(spark, d, "tags"), E(spark, d, "from_id", "to_id", "edge_type"), 0.3, 5)
    return own.select("from_tag", "to_tag", F.col("count").cast("long").alias("count"), F.col("total").cast("long").alias("total"), F.round("probability", 6).alias("probability"), "description")


@query("""select id, qualified_name, cast(churn as integer) churn, complexity, coupling, round(a, 2) churn_impact, round(b, 2) complexity_impact, round(c, 2) coupling_impact, round(a + b + c, 2) score,
  case when a + b + c > 0.8 then 'CRITICAL' when a + b + c > 0.5 then 'HIGH' when a + b + c > 0.2 then 'MEDIUM' else 'LOW' end "level" from (
    select *, least(churn / 20, cast(1 as double)) * cast(0.4 as double) a, least(complexity / 30, cast(1 as double)) * cast(0.3 as double) b, least(coupling / 50, cast(1 as double)) * cast(0.3 as double) c from (
      select id, qualified_name, coalesce(len(history), 0) churn, coalesce(cyclomatic, 0) complexity, coalesce(fan_in, 0) coupling from cur))""")
def risk_profile(spark, d):
    return risk.profiles(N(spark, d, "qualified_name", "history", "cyclomatic", "fan_in"))


_REACH = """starts as (select id from cur where symbol_type = 'interface'), walk as (select id start, id, 0 distance from starts union select w.start, e.from_id, w.distance + 1 from walk w join e on e.to_id = w.id where w.distance < 2 and e.from_id is not null),
  reach as (select start, cast(count(distinct id) as integer) impacted from walk where id in (select id from cur) group by start),
  own as (select c.id, c.qualified_name, r.impacted, coalesce(c.fan_in, 0) fan, coalesce(c.cyclomatic, 0) cc, coalesce(c.tags, []) tags from reach r join cur c on c.id = r.start)"""


@query(f""", {_REACH} select id, qualified_name, impacted, case when fan >= 50 or cc >= 30 or impacted >= 100 then 'CRITICAL' when fan >= 20 or cc >= 15 or impacted >= 30 then 'HIGH'
  when fan >= 5 or cc >= 8 or impacted >= 10 then 'MEDIUM' else 'LOW' end risk from own""", recursive=True)
def refactor_risk(spark, d):
    """Of every interface, by what reaches it in two steps."""
    nodes = N(spark, d, "qualified_name", "symbol_type", "fan_in", "cyclomatic", "tags")
    return risk.proposals(nodes, E(spark, d), nodes.filter("symbol_type = 'interface'").select("id"), 2).drop("reasons", "steps")


@query(f""", {_REACH}, said as (select id, list_filter([case when fan > 20 then printf('High coupling: %d incoming dependencies.', fan) end, case when cc > 15 then printf('High complexity: Cyclomatic complexity is %d.', cc) end,
    case when impacted > 30 then printf('Broad impact: %d symbols are transitively affected.', impacted) end,
    case when list_contains(tags, 'trait:entrypoint') then 'System entrypoint: Modification may affect overall startup or lifecycle.' end,
    case when list_contains(tags, 'layer:core') then 'Core layer symbol: Fundamental logic component.' end, case when list_contains(tags, 'layer:data') then 'Data layer symbol: Affects persistence and schema integrity.' end], lambda x: x is not null) r from own)
  select id, case when len(r) = 0 then 'Low complexity and coupling.' else array_to_string(r, '|') end reasons from said""", recursive=True)
def risk_reasons(spark, d):
    nodes = N(spark, d, "qualified_name", "symbol_type", "fan_in", "cyclomatic", "tags")
    own = risk.proposals(nodes, E(spark, d), nodes.filter("symbol_type = 'interface'").select("id"), 2)
    return own.select("id", F.array_join("reasons", "|").alias("reasons"))


@query()
def remedy_texts(spark, d):
    """(edge_id, policy_id, rationale, steps) of every policy violation."""
    nodes = N(spark, d, "qualified_name", "file_path", "tags", "cyclomatic", "loc")
    found = rules.policy_violations(nodes, E(spark, d, "from_id", "to_id", "edge_type"))
    return risk.remedies(found, nodes).select("edge_id", "policy_id", "rationale", F.array_join("steps", "|").alias("steps"))


@query()
def refactor_steps(spark, d):
    """(id, steps) for the lowest id that a calls edge goes to."""
    nodes = N(spark, d, "qualified_name", "symbol_type", "fan_in", "cyclomatic", "tags")
    return risk.proposals(nodes, E(spark, d), _start(spark, d), 2).select("id", F.array_join("steps", "|").alias("steps"))


@query(f""", {_ENDS}, v as ({_POLICY}) select v.edge_id, v.policy_id, v.description, case
    when list_contains(t.tags, 'layer:api') and (list_contains(f.tags, 'layer:core') or list_contains(f.tags, 'layer:data')) then 'Dependency Inversion via Interface/DTO'
    when list_contains(f.tags, 'role:utility') and (list_contains(t.tags, 'role:service') or list_contains(t.tags, 'role:repository')) then 'Stateless Helper Extraction'
    when list_contains(f.tags, 'role:repository') and list_contains(t.tags, 'role:repository') then 'Service-Layer Orchestration'
    when coalesce(f.cyclomatic, 0) > 30 or coalesce(f.loc, 0) > 500 then 'Single Responsibility Principle (SRP) Decomposition' else 'Architectural Decoupling' end strategy
  from v join cur f on f.id = v.from_id join cur t on t.id = v.to_id""")
def remediation(spark, d):
    nodes = N(spark, d, "qualified_name", "file_path", "tags", "cyclomatic", "loc")
    found = rules.policy_violations(nodes, E(spark, d, "from_id", "to_id", "edge_type"))
    return risk.remedies(found, nodes).select("edge_id", "policy_id", "description", "strategy")


# -- tags --------------------------------------------------------------------------------------------------------------


def _tag_sql() -> str:
    parts = "string_split(replace(lower(file_path), '\\', '/'), '/')"
    low = "lower(list_extract(string_split(qualified_name, '#'), -1))"
    out = [f"case when list_has_any({parts}, {list(dirs)}) then '{tag}' end" for tag, dirs in roles.LAYERS.items()]
    out += [f"case when contains({low}, '{p}') then '{tag}' end" for tag, p in roles.ROLES.items()]
    said = "len(list_filter(coalesce(modifiers, []), lambda x: contains(lower(x), '{}'))) > 0"
    out += [
        f"case when symbol_type = 'interface' or {said.format('abstract')} then 'trait:abstract' end",
        f"case when {said.format('static')} then 'trait:static' end",
        "case when is_generated then 'trait:generated' end",
        "case when coalesce(remote_project_path, '') <> '' then 'trait:external' end",
        "case when visibility in ('private', 'protected') or starts_with(list_extract(string_split(qualified_name, '#'), -1), '_') then 'trait:internal' "
        "when visibility = 'public' or regexp_matches(list_extract(string_split(qualified_name, '#'), -1), '^[A-Z]') then 'trait:public' end",
        "case when symbol_type = 'file' and regexp_matches(lower(file_path), '(main|bootstrap|index)\\.ts$') then 'trait:entrypoint' end",
    ]
    return f"list_distinct(list_concat(coalesce(tags, []), list_filter([{', '.join(out)}], lambda x: x is not null)))"


_TAG_COLUMNS = ("qualified_name", "file_path", "symbol_type", "modifiers", "is_generated", "remote_project_path", "visibility", "tags")


@query(f"select id, array_to_string(list_sort({_tag_sql()}), ',') tags from cur")
def tag_nodes(spark, d):
    return N(spark, d, *_TAG_COLUMNS).select("id", F.array_join(F.array_sort(roles.structural_tags()), ",").alias("tags"))


_ROLES = """il as (select distinct from_id id, to_id parent from e where edge_type in ('inherits', 'implements') and from_id is not null and to_id is not null),
  own as (select id, unnest(tags) tag from {0}), shut as (select id from own where tag = 'trait:internal'),
  up as (select id, parent anc from il where id not in (select id from shut)
    union select u.id, l.parent from up u join il l on l.id = u.anc where u.anc not in (select id from shut)),
  fresh as (select u.id, o.tag from up u join own o on o.id = u.anc where o.tag like 'role:%' and o.tag <> 'role:utility' and u.id in (select id from {0}) except select id, tag from own),
  util as (select id from own where tag = 'role:utility' and id not in (select id from fresh)
    union select l.id from util u join il l on l.parent = u.id where l.id in (select id from {0}) and l.id not in (select id from shut) and l.id not in (select id from fresh)
      and l.id not in (select id from own where tag like 'role:%'))"""


def _inherited(source: str) -> str:
    """Tags of ``source`` (id, tags) as a list once roles are inherited."""
    return f"""select c.id, c.tags old, list_sort(list_concat(
      case when f.id is null then coalesce(c.tags, []) else list_filter(coalesce(c.tags, []), lambda x: x <> 'role:utility') end, coalesce(f.tags, []),
      case when c.id in (select id from util) and not coalesce(list_contains(c.tags, 'role:utility'), false) then ['role:utility'] else [] end)) tags
    from {source} c left join (select id, list(tag) tags from fresh group by id) f on f.id = c.id"""


@query(f", {_ROLES.format('cur')} select id, array_to_string(tags, ',') tags from ({_inherited('cur')})", recursive=True)
def tag_propagate(spark, d):
    """(id, tags) of every node after roles have spread along inherits and implements edges."""
    out = roles.inherited(N(spark, d, "tags"), E(spark, d, "from_id", "to_id", "edge_type"))
    return out.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query(
    f""", set_anew as (select id, {_tag_sql()} tags from cur), {_ROLES.format('set_anew')} select x.id, array_to_string(x.tags, ',') tags from ({_inherited('set_anew')}) x join cur on cur.id = x.id
      where list_sort(list_distinct(x.tags)) <> list_sort(list_distinct(coalesce(cur.tags, [])))""",
    recursive=True,
)
def retag_changes(spark, d):
    """(id, tags) of the nodes whose tags change when everything is tagged anew."""
    out = roles.retagged(N(spark, d, *_TAG_COLUMNS), E(spark, d, "from_id", "to_id", "edge_type"))
    return out.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


# -- history -----------------------------------------------------------------------------------------------------------


@query(""", h as (select id, qualified_name, unnest(history) c from cur), f as (select c.hash hash, min_by(c, id) c, count(*) n_symbols from h where c.hash is not null group by c.hash),
  top as (select hash, c, n_symbols from f order by try_cast(c.date as timestamptz) desc nulls last, hash limit 20)
  select hash, c.message message, c.author author, c.date date, n_symbols, (select array_to_string(list_sort(list(q)), ',') from (select distinct qualified_name q from h where h.c.hash = top.hash)) symbols from top""")
def recent_changes(spark, d):
    own = history.recent_changes(N(spark, d, "qualified_name", "history"), 20)
    return own.withColumn("symbols", F.array_join("symbols", ","))


@query("select id, qualified_name, cast(i - 1 as integer) place, substr(history[i].hash, 1, 7) short_hash, history[i].message message, history[i].author author, history[i].date date from (select id, qualified_name, history, unnest(range(1, len(history) + 1)) i from cur)")
def symbol_history(spark, d):
    return history.symbol_history(N(spark, d, "qualified_name", "history"))


_LOG = f"log as (select distinct {name_sql('file_path')} file_path, commit_hash, ts, upper(trim(event)) event from change_events where file_path is not null)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "change_events", "file_path", "commit_hash", "ts", "event").filter("file_path is not null")
    return own.select(canonical("file_path").alias("file_path"), "commit_hash", "ts", F.upper(F.trim("event")).alias("event")).distinct()


@query(f", {_LOG} select distinct on (file_path) file_path, commit_hash from log order by file_path, ts desc nulls last, commit_hash desc nulls last")
def latest_commits(spark, d):
    return history.latest_commits(_log(spark, d))


@query(f""", {_LOG}, c as (select file_path, commit_hash, max(ts) ts from log group by all), r as (select *, row_number() over (partition by file_path order by ts desc, commit_hash desc) n from c)
  select file_path, array_to_string(list(commit_hash order by ts desc, commit_hash desc), ',') history from r where n <= 5 group by file_path""")
def history_limit5(spark, d):
    return history.file_histories(_log(spark, d)).withColumn("history", F.array_join("history", ","))


@query("""select id, node_qname, kind, body, author, cast(floor(ms / 1000) as bigint) created_at, strftime(make_timestamp(cast(ms * 1000 as bigint)), '%Y-%m-%d') "day", commit_hash
  from (select distinct on (id) *, case when abs(created_at) >= 100000000000 then created_at else created_at * 1000 end ms from annotations order by id) order by ms desc nulls last, id limit 50""")
def newest_annotations(spark, d):
    return history.annotations(table(spark, d, "annotations").dropDuplicates(["id"]), limit=50)


# -- ingestion ---------------------------------------------------------------------------------------------------------


@query("select qualified_name, max(version) version, min(id) id from nodes where qualified_name is not null group by qualified_name")
def upsert_latest(spark, d):
    """The newest version of each name; half of the rows stand for what is stored, the others come on top."""
    rows = table(spark, d, "nodes", "id", "qualified_name", "version").filter("qualified_name is not null")
    even = rows.groupBy("qualified_name").agg(F.min("id").alias("id"), F.min("version").alias("version"))
    return ingest.upserted(even, rows.drop("id").withColumn("id", F.lit(None).cast("long"))).select("qualified_name", "version", "id")


@query(f", {_LOG} select distinct on (file_path) file_path, event, commit_hash, ts from log order by file_path, ts desc, (event = 'DELETE') desc, commit_hash desc, event desc")
def last_events(spark, d):
    return ingest.last_events(_log(spark, d))


@query(f""", {_LOG}, l as (select distinct on (file_path) file_path, event from log order by file_path, ts desc, (event = 'DELETE') desc, commit_hash desc, event desc),
  own as (select id, {name_sql("file_path")} file_path from cur), gone as (select id from own where file_path in (select file_path from l where event = 'DELETE' or event = 'ADD'))
  select id, from_id, to_id from e where from_id not in (select id from gone) and to_id not in (select id from gone)""")
def cdc_apply(spark, d):
    """The edges left after the files whose last event adds or deletes them have gone."""
    nodes = N(spark, d, "file_path").withColumn("file_path", canonical("file_path"))
    paths = ingest.last_events(_log(spark, d)).filter("event in ('DELETE', 'ADD')")
    return ingest.without_files(nodes, E(spark, d, "from_id", "to_id"), paths)[1].select("id", "from_id", "to_id")


@query(f""", {_LOG}, x as (select case event when 'ADD' then 'A' when 'DELETE' then 'R100' else 'M' end status, file_path || '.old' old_path, file_path path, commit_hash from log)
  select 'ADD' event, path file_path, commit_hash from x where status <> 'M' union all select 'DELETE', old_path, commit_hash from x where status = 'R100' union all select 'MODIFY', path, commit_hash from x where status = 'M'""")
def diff_status(spark, d):
    kind = F.when(F.col("event") == "ADD", "A").when(F.col("event") == "DELETE", "R100").otherwise("M")
    diff = _log(spark, d).select(kind.alias("status"), F.concat("file_path", F.lit(".old")).alias("old_path"), F.col("file_path").alias("path"), "commit_hash")
    return history.diff_events(diff)


_C, _S = name_sql("target_qname"), "lower(case when strpos({0}, '#') = 0 then {0} else substr({0}, strpos({0}, '#') + 1) end)"
_ASKED = "asked as (select distinct target_qname name from test_specs where trim(target_qname) <> '')"


@query(f""", {_ASKED}, bare as (select name, case when strpos(name, ':') > 0 then substr(name, 1, strpos(name, ':') - 1) end hint, case when strpos(name, ':') > 0 then substr(name, strpos(name, ':') + 1) else name end bare from asked),
  hits as (select name, 1 tier, 0 off, n.id from asked join cur n on {name_sql("n.qualified_name")} = {name_sql("name")} union all
    select name, 2, 0, n.id from bare join cur n on hint is not null and {name_sql("n.qualified_name")} = {name_sql("bare")} union all
    select name, 3, case when hint = n.symbol_type then 0 else 1 end, n.id from bare join cur n on {_S.format("n.qualified_name")} = lower(bare))
  select distinct on (name) name, id, tier from hits order by name, tier, off, id""")
def name_resolution(spark, d):
    names = table(spark, d, "test_specs", "target_qname").filter("trim(target_qname) <> ''").select(F.col("target_qname").alias("name")).distinct()
    return ingest.candidates(names, N(spark, d, "qualified_name", "symbol_type"))


@query(f""", w as (select distinct target_qname name, nullif(split_part(file_path, '/', 3), '') project from test_specs where trim(target_qname) <> ''), n as (select id, qualified_name, nullif(split_part(file_path, '/', 3), '') other, {_S.format("qualified_name")} s, {name_sql("qualified_name")} c from cur),
  l as (select * from (select *, {_S.format("name")} s, {name_sql("name")} c from w) x where not exists (select 1 from n where n.s = x.s and n.other = x.project)),
  h as (select l.name, l.project, n.other, case when n.c = l.c then 0 else 1 end off, n.id, n.qualified_name from l join n on (n.s = l.s or n.c = l.c) and n.other <> l.project)
  select distinct on (name, project) name, project, id, 'remote:' || other || ':' || qualified_name shadow from h order by name, project, other, off, id""")
def cross_project_resolution(spark, d):
    specs = table(spark, d, "test_specs", "target_qname", "file_path").filter("trim(target_qname) <> ''")
    wanted = specs.select(F.col("target_qname").alias("name"), ingest.project_of().alias("project"))
    return ingest.across_projects(wanted, N(spark, d, "qualified_name", "file_path"))


@query(f""", {_LOG}, l as (select distinct on (file_path) file_path, event, commit_hash from log order by file_path, ts desc, (event = 'DELETE') desc, commit_hash desc, event desc),
  disk as (select file_path, sha1(file_path) checksum, commit_hash from l where event <> 'DELETE'),
  idx as (select {name_sql("qualified_name")} file_path, max(sha1({name_sql("qualified_name")})) checksum, max(last_updated_commit) last_updated_commit from cur where symbol_type = 'file' group by 1)
  select coalesce(d.file_path, i.file_path) file_path, case when d.file_path is null then 'orphaned' when i.file_path is null then 'missing' else 'outdated' end state
  from disk d full join idx i on i.file_path = d.file_path where d.file_path is null or i.file_path is null or (coalesce(i.last_updated_commit, '') <> 'watcher-change' and i.last_updated_commit is distinct from d.commit_hash)""")
def consistency_report(spark, d):
    """Files by the last event of each against the file nodes; contents stand for themselves by the path's checksum."""
    disk = ingest.last_events(_log(spark, d)).filter("event <> 'DELETE'").select("file_path", F.sha1("file_path").alias("checksum"), "commit_hash")
    idx = N(spark, d, "qualified_name", "symbol_type", "last_updated_commit").filter("symbol_type = 'file'").groupBy(canonical("qualified_name").alias("file_path"))
    idx = idx.agg(F.max("last_updated_commit").alias("last_updated_commit")).withColumn("checksum", F.sha1("file_path"))
    return consistency.report(disk, idx)


# -- search and vectors ------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', qualified_name, symbol_type, file_path)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f""", w as (select id, qualified_name, {_TOKENS} words from cur), h as (select id, qualified_name, len(words) n, len(list_filter(words, lambda x: x = 'token')) h0, len(list_filter(words, lambda x: starts_with(x, 'get'))) h1 from w),
  s as (select count(*) c, avg(n) mean, count(*) filter (h0 > 0) d0, count(*) filter (h1 > 0) d1 from h)
  select id, qualified_name, round(greatest(ln((c - d0 + 0.5) / (d0 + 0.5)), 1e-6) * h0 * 2.2 / (h0 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((c - d1 + 0.5) / (d1 + 0.5)), 1e-6) * h1 * 2.2 / (h1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) score
  from h, s where h0 > 0 and h1 > 0 order by score desc, qualified_name, id limit 20""")
def keyword_prefix(spark, d):
    return search.keyword(N(spark, d, "qualified_name", "symbol_type", "file_path"), "token get*")


@query("select id, qualified_name from cur where lower(qualified_name) like '%repository.r%' order by length(qualified_name), qualified_name, id limit 20")
def keyword_like(spark, d):
    return search.like(N(spark, d, "qualified_name"), "repository.r")


@query("select id, qualified_name, 1.0::double / row_number() over (order by length(qualified_name), qualified_name, id) score from (select * from cur where lower(qualified_name) like '%repository.s%' order by length(qualified_name), qualified_name, id limit 20)")
def positional_score(spark, d):
    own = search.like(N(spark, d, "qualified_name"), "Repository.s")
    return search.positional(own, [F.length("qualified_name"), F.col("qualified_name"), F.col("id")])


_NEAR = "near as (select q.vec_id query_id, v.vec_id id, list_distance(q.embedding::double[], v.embedding::double[]) distance from embeddings q, embeddings v where q.vec_id % 50 = 0)"


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vecs = table(spark, d, "embeddings", "vec_id", "embedding")
    return vecs.filter("vec_id % 50 = 0"), vecs


@query(f", {_NEAR} select query_id, id, round(distance, 4) distance from (select *, row_number() over (partition by query_id order by distance, id) n from near) where n <= 10")
def knn_l2(spark, d):
    return vectors.nearest(*_queries(spark, d), 10).select("query_id", "id", F.round("distance", 4).alias("distance"))


@query(f", {_NEAR} select query_id, id, round(distance, 4) distance, round(1 / (1 + distance), 4) score from (select *, row_number() over (partition by query_id order by distance, id) n from near where id <> query_id) where n <= 10")
def similar_symbols(spark, d):
    return vectors.similar(*_queries(spark, d), 10).select("query_id", "id", F.round("distance", 4).alias("distance"), F.round("score", 4).alias("score"))


@query(""", a as (select id, row_number() over (order by fan_in desc nulls last, id) place from cur), b as (select id, row_number() over (order by cyclomatic desc nulls last, id) place from cur),
  r as (select id, place, 0 l from a where place <= 50 union all select id, place, 1 from b where place <= 50), s as (select id, round(sum(1.0::double / (60 + place)), 10) score, min(l * 1000000 + place) f from r group by id)
  select id, score from s order by score desc, f, id limit 30""")
def rrf_merge(spark, d):
    nodes = N(spark, d, "fan_in", "cyclomatic")
    legs = []
    for c in ("fan_in", "cyclomatic"):
        top = nodes.orderBy(F.desc_nulls_last(c), "id").limit(50)
        legs.append(top.select("id", F.row_number().over(search.Window.orderBy(F.desc_nulls_last(c), "id")).alias("place")))
    return search.fused(*legs, limit=30)


@query("""select id, 'Symbol: ' || qualified_name || chr(10) || 'Type: ' || symbol_type || case when coalesce(signature, '') <> '' then chr(10) || 'Signature: ' || signature else '' end || chr(10) || 'Context: ' || file_path
  || case when coalesce(docstring, '') <> '' then chr(10) || 'Description: ' || substr(docstring, 1, 500) else '' end snippet from cur""")
def embedding_snippets(spark, d):
    return N(spark, d, "qualified_name", "symbol_type", "signature", "file_path", "docstring").select("id", vectors.snippet().alias("snippet"))


@query(""", m as (select id, min_by(checksum, version) checksum from nodes where version % 2 = 0 group by id) select c.id from cur c left join m on m.id = c.id where m.id is null or c.checksum <> m.checksum""")
def embedding_stale(spark, d):
    """Nodes whose checksum isn't the one that was embedded; those of an even version stand for what was."""
    meta = table(spark, d, "nodes", "id", "checksum", "version").filter("version % 2 = 0").groupBy("id").agg(F.min_by("checksum", "version").alias("checksum"))
    return vectors.stale(N(spark, d, "checksum"), meta)


# -- tests and exports -------------------------------------------------------------------------------------------------


@query(f"""select distinct s.target, t.qualified_name test from (select id target, id from cur union
    select c.id, f.id from cur c join cur f on f.symbol_type = 'file' and f.qualified_name = split_part(c.qualified_name, '#', 1) where c.qualified_name like '%#%') s
  join e on e.to_id = s.id and e.edge_type = 'tests' join cur t on t.id = e.from_id where t.qualified_name is not null
  union select c.id, s.title from test_specs s join cur c on c.qualified_name = {name_sql('s.target_qname')} where trim(s.target_qname) <> '' and s.title is not null""")
def related_tests(spark, d):
    """Tests of every symbol, those of its file and the titles of its specs among them."""
    nodes = N(spark, d, "qualified_name", "symbol_type")
    targets = nodes.select(F.col("id").alias("target"), "qualified_name")
    edges = E(spark, d, "from_id", "to_id", "edge_type", where=F.col("edge_type") == "tests")
    return lookup.related_tests(targets, nodes, edges, table(spark, d, "test_specs", "target_qname", "title"))


_TOLD = f"(select min(c.qualified_name) from cur c where c.qualified_name in (select {name_sql('target_qname')} from test_specs where title is not null))"


@query(f"""select c.qualified_name, c.symbol_type, c.signature, c.loc, cast(coalesce(len(c.history), 0) as integer) commits,
    (select count(*) from (select distinct on (id) * from annotations order by id) a where {name_sql('a.node_qname')} = c.qualified_name) notes,
    (select array_to_string(list_sort(list(distinct title)), '; ') from test_specs s where {name_sql('s.target_qname')} = c.qualified_name and title is not null) titles
  from cur c where c.qualified_name = {_TOLD}""")
def symbol_details(spark, d):
    """One symbol with its metrics, number of commits and notes (of five at most), and the titles of its tests."""
    specs = table(spark, d, "test_specs", "target_qname", "title", "assertions")
    told = specs.filter("title is not null").select(canonical_name("target_qname").alias("qualified_name"))
    name = table(spark, d, "nodes", "qualified_name").join(told, "qualified_name", "left_semi").agg(F.min("qualified_name")).first()[0] or ""
    own = nodes_where(spark, d, F.col("qualified_name") == name, "qualified_name", "symbol_type", "file_path", "signature", "loc", "history")
    whole = lookup.details(own, table(spark, d, "annotations").dropDuplicates(["id"]), specs, name)
    titles = F.array_join(F.array_sort(F.array_distinct(F.transform("tests", lambda t: t["title"]))), "; ")
    commits = F.coalesce(F.size("history"), F.lit(0))
    return whole.select("qualified_name", "symbol_type", "signature", "loc", commits.alias("commits"), F.size("annotations").cast("long").alias("notes"), titles.alias("titles"))


@query("select from_id, to_id, min(id) id, min_by(edge_type, id) edge_type from e where edge_type in ('calls', 'depends_on') and from_id is not null and to_id is not null group by from_id, to_id")
def first_edges(spark, d):
    """The first dependency between each pair of nodes."""
    kinds = ["calls", "depends_on"]
    return lookup.first_edges(E(spark, d, "from_id", "to_id", "edge_type", where=F.col("edge_type").isin(*kinds)), kinds)


@query("select vec_id, embedding from embeddings where vec_id = (select min(vec_id) from embeddings)")
def stored_vector(spark, d):
    """The stored vector of one id."""
    vecs = table(spark, d, "embeddings", "vec_id", "embedding")
    return vectors.stored(vecs, _or(vecs.agg(F.min("vec_id")).first()[0]))


def _lines(make: Callable) -> Callable:
    def run(spark, d):
        nodes, edges = traverse.subgraph(N(spark, d, "symbol_type", "qualified_name", "remote_project_path"), E(spark, d))
        return make(nodes, edges).select("line")

    run.__name__ = f"export_{make.__name__}"
    return run


_HEAD = " union all ".join(f"select '{x}' line" for x in ["graph TD", *[f"  classDef {k} {v}" for k, v in export.STYLES.items()]])
query(f""", {_SUB} select line from ({_HEAD} union all select '  N' || id || '["' || symbol_type || ': ' || list_extract(regexp_split_to_array(qualified_name, '[#./]'), -1) || '"]' ||
  case when symbol_type in ('file', 'class', 'interface', 'method', 'function') then ':::' || symbol_type else '' end from cur where id in (select id from sub) union all
  select '  N' || from_id || ' -- ' || edge_type || ' --> N' || to_id from e where from_id in (select id from sub) and to_id in (select id from sub))""")(_lines(export.mermaid))
_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
query(f""", {_SUB}, x as (select f.qualified_name f, t.qualified_name t from e join cur f on f.id = e.from_id join cur t on t.id = e.to_id where from_id in (select id from sub) and to_id in (select id from sub))
  select '<?xml version="1.0" encoding="UTF-8"?>' line union all select '<graphml xmlns="http://graphml.graphdrawing.org/graphml">' union all select '  <graph id="G" edgedefault="directed">' union all
  select '    <node id="' || {_XML.format("qualified_name")} || '"/>' from cur where id in (select id from sub) union all select '    <edge source="' || {_XML.format("f")} || '" target="' || {_XML.format("t")} || '"/>' from x union all
  select '  </graph>' union all select '</graphml>'""")(_lines(export.graphml))
_DOT = "replace(replace({0}, '\\', '\\\\'), '\"', '\\\"')"
query(f""", {_SUB}, x as (select f.qualified_name f, t.qualified_name t from e join cur f on f.id = e.from_id join cur t on t.id = e.to_id where from_id in (select id from sub) and to_id in (select id from sub))
  select 'digraph G {{' line union all select '  "' || {_DOT.format("qualified_name")} || '";' from cur where id in (select id from sub) union all
  select '  "' || {_DOT.format("f")} || '" -> "' || {_DOT.format("t")} || '";' from x union all select '}}'""")(_lines(export.dot))


@query(f", {_SUB} select (select count(*) from sub) nodes, (select count(*) from e where from_id in (select id from sub) and to_id in (select id from sub)) edges")
def export_summary(spark, d):
    return export.summary(*traverse.subgraph(N(spark, d, "symbol_type"), E(spark, d)))
