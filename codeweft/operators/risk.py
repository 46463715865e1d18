"""Risk of a change: scores, levels, reasons, and the kind of remedy for a violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.arrays import has_tag
from codeweft.operators.advice import refactor_steps, remedy
from codeweft.operators.traverse import bfs

# Full marks and weights of churn, complexity and coupling, and the levels of the score.
FACTORS = {"churn": (20, 0.4), "complexity": (30, 0.3), "coupling": (50, 0.3)}
LEVELS = ((0.8, "CRITICAL"), (0.5, "HIGH"), (0.2, "MEDIUM"))
# The names of levels and strategies and the texts of reasons below, and fan-in, complexity and reach from which a refactoring has a risk.
REFACTOR = ((50, 30, 100, "CRITICAL"), (20, 15, 30, "HIGH"), (5, 8, 10, "MEDIUM"))


def profiles(nodes: DataFrame) -> DataFrame:
    """(id, qualified_name, churn, complexity, coupling, *_impact, score, level); null fields count 0.

    The level follows the exact score, which comes out rounded to two decimals.
    """
    own = nodes.select(
        "id",
        "qualified_name",
        F.greatest(F.size(F.coalesce("history", F.array().cast("array<struct<hash:string,message:string,author:string,date:string>>"))), F.lit(0)).alias("churn"),
        F.coalesce("cyclomatic", F.lit(0)).alias("complexity"),
        F.coalesce("fan_in", F.lit(0)).alias("coupling"),
    )
    parts = {k: F.least(F.col(k) / full, F.lit(1.0)) * weight for k, (full, weight) in FACTORS.items()}
    own = own.withColumns({f"_{k}": c for k, c in parts.items()}).withColumn("_score", F.col("_churn") + F.col("_complexity") + F.col("_coupling"))
    level = F.lit("LOW")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("_score") > least, name).otherwise(level)
    impacts = [F.round(f"_{k}", 2).alias(f"{k}_impact") for k in FACTORS]
    return own.select("id", "qualified_name", *FACTORS, *impacts, F.round("_score", 2).alias("score"), level.alias("level"))


def refactor_risk(fan_in: Column, complexity: Column, reached: Column) -> Column:
    """The level by the first limit that any of the three reaches; ``reached`` counts the symbol itself."""
    out = F.lit("LOW")
    for a, b, c, name in reversed(REFACTOR):
        out = F.when((fan_in >= a) | (complexity >= b) | (reached >= c), name).otherwise(out)
    return out


def reasons(fan_in: Column, complexity: Column, reached: Column) -> Column:
    """Why a change is risky, as an array of texts."""
    said = F.array_compact(
        F.array(
            F.when(fan_in > 20, F.format_string("High coupling: %d incoming dependencies.", fan_in)),
            F.when(complexity > 15, F.format_string("High complexity: Cyclomatic complexity is %d.", complexity)),
            F.when(reached > 30, F.format_string("Broad impact: %d symbols are transitively affected.", reached)),
            F.when(has_tag("tags", "trait:entrypoint"), "System entrypoint: Modification may affect overall startup or lifecycle."),
            F.when(has_tag("tags", "layer:core"), "Core layer symbol: Fundamental logic component."),
            F.when(has_tag("tags", "layer:data"), "Data layer symbol: Affects persistence and schema integrity."),
        )
    )
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("Low complexity and coupling.")))


def proposals(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(id, qualified_name, impacted, risk, reasons, steps) of each start (id), by what reaches it within ``depth`` steps.

    The steps name the three symbols that are nearest, the start first, ties by the lowest id.
    """
    reached = bfs(edges, starts, depth, incoming=True).join(nodes.select("id", F.col("qualified_name").alias("_name")), "id")
    n = reached.groupBy("start").agg(F.count("*").cast("int").alias("impacted"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("distance", "id"))
    near = reached.withColumn("_place", place).filter("_place <= 3").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("_place", "_name"))).alias("_near"))
    n = n.join(near, "start")
    own = nodes.join(n, nodes.id == n.start)
    fan, cc = F.coalesce("fan_in", F.lit(0)), F.coalesce("cyclomatic", F.lit(0))
    own = own.withColumn("risk", refactor_risk(fan, cc, F.col("impacted")))
    steps = refactor_steps(F.col("qualified_name"), fan, F.col("risk"), F.transform("_near", lambda x: x["_name"]))
    return own.select("id", "qualified_name", "impacted", "risk", reasons(fan, cc, F.col("impacted")).alias("reasons"), steps.alias("steps"))


def remedies(violations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``strategy``, ``rationale`` and ``steps`` to violations (from_id, to_id, policy_id, and description if they have
    one): the first kind of remedy that fits the ends' tags.

    Tags are compared case-sensitively. An end without a node leaves too little to say.
    """
    for side, p in (("from_id", "f_"), ("to_id", "t_")):
        own = nodes.select(F.col("id").alias(side), F.col("tags").alias(f"{p}tags"), F.col("cyclomatic").alias(f"{p}cc"), F.col("loc").alias(f"{p}loc"), F.lit(True).alias(f"{p}known"), F.col("qualified_name").alias(f"{p}name"))
        violations = violations.join(own, side, "left")
    f, t = (lambda x: has_tag("f_tags", x)), (lambda x: has_tag("t_tags", x))
    strategy = (
        F.when(F.col("f_known").isNull() | F.col("t_known").isNull(), "Insufficient Violation Data")
        .when(F.col("policy_id") == "circular-dependency", "Dependency Decoupling (Abstractions or Events)")
        .when(t("layer:api") & (f("layer:core") | f("layer:data")), "Dependency Inversion via Interface/DTO")
        .when(f("role:utility") & (t("role:service") | t("role:repository")), "Stateless Helper Extraction")
        .when(f("role:repository") & t("role:repository"), "Service-Layer Orchestration")
        .when((F.coalesce("f_cc", F.lit(0)) > 30) | (F.coalesce("f_loc", F.lit(0)) > 500), "Single Responsibility Principle (SRP) Decomposition")
        .otherwise("Architectural Decoupling")
    )
    said = F.col("description") if "description" in violations.columns else F.lit("")
    rationale, steps = remedy(F.col("strategy"), said, F.col("f_name"), F.col("t_name"))
    out = violations.withColumn("strategy", strategy).withColumns({"rationale": rationale, "steps": steps})
    return out.drop("f_name", "t_name", "f_tags", "f_cc", "f_loc", "f_known", "t_tags", "t_cc", "t_loc", "t_known")
