"""The graph's tables as they lie in a folder of Parquet files, and their current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.names import folded
from codeweft.session import reachable, small


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a folder, with ``columns`` only if any are named; pruning reaches the scan."""
    reachable(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def current(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per id: the one of the highest version. Rows of equal id and version are copies, so any of them serves.

    A row whose version is null ranks below every other; rows without an id are dropped. ``max_by`` combines on the map
    side, so an id with very many deliveries shuffles one row per map task.
    """
    columns = columns or tuple(c for c in nodes.columns if c != "id")
    row = F.struct(*[F.col(c) for c in columns])
    best = F.max_by(row, F.coalesce(F.col("version"), F.lit(-(2**63))))
    return nodes.filter("id is not null").groupBy("id").agg(best.alias("row")).select("id", "row.*")


def current_of(nodes: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Current rows of some ids (``ids`` has a column id): only their rows are reduced, nothing else is shuffled.

    The ids are counted first, and broadcast if few.
    """
    ids = ids.select("id").filter("id is not null").distinct()
    return current(nodes.join(small(ids, ids.count()), "id", "left_semi"), *columns)


def current_where(nodes: DataFrame, condition: Column, *columns: str) -> DataFrame:
    """Current rows that meet ``condition``, which reads columns of ``nodes``.

    The condition reaches the scan: ids that meet it in any version are looked up first, then only their rows are reduced,
    and the current ones are held against it again. The result has ``columns``; null conditions are false.
    """
    kept = dict.fromkeys([*columns, *(c for c in nodes.columns if c not in ("id", "version"))])
    own = current_of(nodes, nodes.filter(condition), *kept).filter(condition)
    return own.select("id", *columns)


def current_nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows with ``symbol_type`` and ``language`` folded, where asked for."""
    need = tuple(dict.fromkeys([*columns, "version"]))
    df = current(table(spark, folder, "nodes", "id", *need), *columns)
    for c in ("symbol_type", "language"):
        if c in columns:
            df = df.withColumn(c, folded(c))
    return df


def nodes_where(spark: SparkSession, folder: str, condition: Column, *columns: str) -> DataFrame:
    """``current_nodes`` that meet ``condition`` on ``columns``, by ``current_where``."""
    raw = table(spark, folder, "nodes", *dict.fromkeys(["id", "version", *columns]))
    for c in ("symbol_type", "language"):
        if c in columns:
            raw = raw.withColumn(c, folded(c))
    return current_where(raw, condition, *columns)


def nodes_of(spark: SparkSession, folder: str, ids: DataFrame, *columns: str) -> DataFrame:
    """``current_nodes`` of some ids, by ``current_of``."""
    df = current_of(table(spark, folder, "nodes", *dict.fromkeys(["id", "version", *columns])), ids, *columns)
    for c in ("symbol_type", "language"):
        if c in columns:
            df = df.withColumn(c, folded(c))
    return df


def clean_edges(spark: SparkSession, folder: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Edges with folded ``edge_type``, one row per id: repeated deliveries count once.

    Deliveries of an edge are equal but for the spelling of its type, so ``where`` is applied before they are reduced and
    reaches the scan.
    """
    columns = columns or ("from_id", "to_id", "edge_type", "call_site_line", "dynamic")
    df = table(spark, folder, "edges", "id", *columns)
    if "edge_type" in columns:
        df = df.withColumn("edge_type", folded("edge_type"))
    return (df if where is None else df.filter(where)).dropDuplicates(["id"])
