"""Architecture rules: forbidden relations by tags and by paths, cycles, and drift from a declared intent."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.arrays import has_tag_folded, tags
from codeweft.functions.names import file_part
from codeweft.operators import cycles, policies
from codeweft.schema import INTENT, RULE

# The built-in policies, and the edge types that policies and path rules look at.
POLICIES = (
    ("layer-hierarchy", "layer:data", "layer:api"),
    ("layer-hierarchy", "layer:data", "layer:core"),
    ("layer-hierarchy", "layer:core", "layer:api"),
    ("layer-hierarchy", "layer:utility", "layer:api"),
    ("layer-hierarchy", "layer:utility", "layer:core"),
    ("layer-hierarchy", "layer:utility", "layer:data"),
    ("role-integrity", "role:utility", "role:service"),
    ("role-integrity", "role:utility", "role:repository"),
    ("role-integrity", "role:repository", "role:service"),
    ("api-integrity", "layer:core", "layer:api"),
    ("api-integrity", "layer:data", "layer:api"),
    ("domain-isolation", "role:repository", "role:repository"),
)
POLICY_EDGES = ("calls", "dynamic_calls", "inherits", "implements", "depends_on", "reads", "writes")
RULE_EDGES = ("calls", "depends_on", "imports")


def _ends(nodes: DataFrame, edges: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Edges with ``columns`` of both ends, prefixed ``f_`` and ``t_``; edges with an end without a node are dropped.

    A hot end repeats one node row; adaptive execution splits its partition of the edges.
    """
    for side, p in (("from_id", "f_"), ("to_id", "t_")):
        own = nodes.select(F.col("id").alias(side), *[c.alias(p + n) for n, c in columns.items()])
        edges = edges.join(own, side)
    return edges


def policy_violations(nodes: DataFrame, edges: DataFrame, forbidden: tuple = POLICIES) -> DataFrame:
    """(edge_id, from_id, to_id, policy_id, description): one row per edge and forbidden pair of tags.

    Edges inside a file or a name's path part don't count; tags match whatever their case. The pairs that an edge breaks
    are found by looking both tag sets up in one constant array, so no join with the policies is needed.
    """
    low = F.transform(tags(), F.lower)
    cols = {"file": F.col("file_path"), "prefix": file_part("qualified_name"), "tags": low}
    own = edges.filter(F.col("edge_type").isin(*POLICY_EDGES)).select("id", "from_id", "to_id")
    both = _ends(nodes, own, cols).filter("f_file <> t_file and f_prefix <> t_prefix")
    hit = [
        F.when(
            F.array_contains("f_tags", a) & F.array_contains("t_tags", b) & (~F.array_contains("t_tags", "trait:internal") if p == "domain-isolation" else F.lit(True)),
            F.struct(F.lit(p).alias("policy_id"), F.lit(f"Illegal relationship: {a} -> {b}").alias("description")),
        )
        for p, a, b in forbidden
    ]
    return both.select(F.col("id").alias("edge_id"), "from_id", "to_id", F.inline(F.array_compact(F.array(*hit))))


def path_violations(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """The same columns for rules {name, from, to, allowed, rationale}: a forbidden rule names a path segment of each end."""
    cols = {"file": F.col("file_path"), "parts": F.split(F.replace(F.coalesce("file_path", F.lit("")), F.lit("\\"), F.lit("/")), "/")}
    own = edges.filter(F.col("edge_type").isin(*RULE_EDGES)).select("id", "from_id", "to_id")
    both = _ends(nodes, own, cols).filter("not (f_file <=> t_file)")
    hit = [
        F.when(
            F.array_contains("f_parts", r["from"]) & F.array_contains("t_parts", r["to"]),
            F.struct(F.lit(f"custom:{r['name']}").alias("policy_id"), F.lit(f'Custom rule violation "{r["name"]}": {r["from"]} -> {r["to"]} is not allowed').alias("description")),
        )
        for r in rules
        if not r.get("allowed")
    ]
    if not hit:
        return both.select(F.col("id").alias("edge_id"), "from_id", "to_id", F.lit("").alias("policy_id"), F.lit("").alias("description")).limit(0)
    return both.select(F.col("id").alias("edge_id"), "from_id", "to_id", F.inline(F.array_compact(F.array(*hit))))


def cycle_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per strongly connected component: its lowest id, the lowest id that this depends on inside, and its size."""
    links = cycles.dependency_links(edges)
    inside = cycles.components(links)
    pair = links.join(inside.withColumnRenamed("id", "a"), "a").join(inside.withColumnsRenamed({"id": "b", "component": "_other"}), "b")
    first = pair.filter("component = _other and a = component").groupBy("component").agg(F.min("b").alias("to_id"))
    sizes = inside.groupBy("component").agg(F.count("*").alias("n"))
    text = F.format_string("Circular dependency of %d symbols", F.col("n"))
    return first.join(sizes, "component").select(F.lit(None).cast("long").alias("edge_id"), F.col("component").alias("from_id"), "to_id", F.lit("circular-dependency").alias("policy_id"), text.alias("description"))


def violations(nodes: DataFrame, edges: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """All three kinds."""
    out = policy_violations(nodes, edges)
    if rules:
        out = out.unionByName(path_violations(nodes, edges, rules))
    return out.unionByName(cycle_violations(nodes, edges))


def layer_match(pattern: str, path: Column) -> Column:
    """A regular expression anywhere in the path, or a substring if it is no valid one of the engine that runs it."""
    from py4j.protocol import Py4JError
    from pyspark import SparkContext
    from pyspark.errors.exceptions.captured import CapturedException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, CapturedException):
        return path.contains(pattern)
    return path.rlike(pattern)


def drift(nodes: DataFrame, edges: DataFrame, intent: dict) -> dict[str, DataFrame]:
    """declared_layers (name, node_count, mapped), unmapped (unmapped), rule_health (name, violations, status), emergent
    (from_tag, to_tag, ...). Nodes without a path are in no layer and aren't unmapped either."""
    spark = nodes.sparkSession
    path = F.replace(F.coalesce("file_path", F.lit("")), F.lit("\\"), F.lit("/"))
    layers, rules = intent.get("layers", []), intent.get("rules", [])
    sums = nodes.select(path.alias("p")).filter("p <> ''").agg(
        F.array(*[F.struct(F.lit(x["name"]).alias("name"), F.count_if(layer_match(x["pathPattern"], F.col("p"))).alias("node_count")) for x in layers] or [F.struct(F.lit("").alias("name"), F.lit(0).cast("long").alias("node_count"))]).alias("x")
    )
    declared = sums.select(F.inline("x")).filter("name <> ''").withColumn("mapped", F.col("node_count") > 0)
    mapped = F.lit(False)
    for x in layers:
        mapped = mapped | layer_match(x["pathPattern"], F.col("p"))
    unmapped = nodes.select(path.alias("p")).filter("p <> ''").agg(F.count_if(~mapped).alias("unmapped"))
    hits = path_violations(nodes, edges, rules).groupBy("policy_id").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(r["name"], f"custom:{r['name']}") for r in rules], "name string, policy_id string")
    n = F.coalesce("n", F.lit(0))
    health = names.join(hits, "policy_id", "left").select("name", n.alias("violations"), F.when(n > 0, "violated").otherwise("healthy").alias("status"))
    pairs = [f"{r['from'].lower()}->{r['to'].lower()}" for r in rules]
    bare = lambda c: F.lower(F.regexp_replace(c, "(?i)^layer:", ""))
    latent = policies.latent_policies(nodes, edges)
    emergent = latent.filter(~F.concat(bare("from_tag"), F.lit("->"), bare("to_tag")).isin(*pairs)) if pairs else latent
    return {"declared_layers": declared, "unmapped": unmapped, "rule_health": health, "emergent": emergent}


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Path rules from a JSON array; each needs the strings name, from and to. A file of rules is small by nature."""
    rows = [r.asDict() for r in spark.read.schema(RULE).json(path, multiLine=True).collect()]
    for r in rows:
        if not all(r[k] for k in ("name", "from", "to")):
            raise ValueError(f"a rule needs name, from and to: {r}")
    return rows


def read_intent(spark: SparkSession, path: str) -> dict:
    """A declared architecture from a JSON object; layers need name and pathPattern, rules name, from and to."""
    row = spark.read.schema(INTENT).json(path, multiLine=True).first()
    out = row.asDict(recursive=True) if row else {}
    out = {"layers": out.get("layers") or [], "rules": out.get("rules") or [], "responsibilities": out.get("responsibilities") or {}}
    for key, need in (("layers", ("name", "pathPattern")), ("rules", ("name", "from", "to"))):
        for x in out[key]:
            if not all(x[k] for k in need):
                raise ValueError(f"an entry of {key} needs {', '.join(need)}: {x}")
    return out

