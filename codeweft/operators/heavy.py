"""Per-key results where a few keys hold most records.

Rows are range-partitioned on (key, secondary order) with sampled quantiles, so a heavy key is split over as many
partitions as its share of the rows needs. Each partition reduces its part of a key to a partial state; the states,
at most one a key and partition, are stitched by a second, small aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import folded
from codeweft.session import partitions


def spread(df: DataFrame, key: str, order: str, n: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (key, order): equal pairs stay together, equal keys need not."""
    return df.repartitionByRange(n or partitions(df.sparkSession), key, order)


def distinct_per_key(df: DataFrame, key: str, order: str, name: str = "n") -> DataFrame:
    """Distinct ``order`` values of each key. A null key is a key of its own; null ``order`` values don't count.

    The range partitioning already clusters (key, order), so the inner grouping shuffles nothing more.
    """
    parts = spread(df.select(key, order).filter(F.col(order).isNotNull()), key, order)
    return parts.groupBy(key, order).agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count("_one").alias(name))


def states_per_key(df: DataFrame, key: str, order: str, **states: tuple[str, Column]) -> DataFrame:
    """``states``: name=(kind, column), kind one of sum, min, max, count. Partial states per partition, then stitched."""
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    parts = spread(df, key, order)
    return parts.groupBy(key).agg(*[kinds[k](c).alias(n) for n, (k, c) in states.items()])


def running_per_key(df: DataFrame, key: str, order: str, name: str = "rank") -> DataFrame:
    """(key, order, rank): each distinct row's place within its key, counted from 1, without gathering a key in a task.

    Ranks within a partition are added to the key's rows in the partitions before, of which the stitching table holds one
    row a key and partition.
    """
    from pyspark.sql import Window

    parts = spread(df.select(key, order).filter(F.col(key).isNotNull() & F.col(order).isNotNull()).distinct(), key, order)
    at = parts.withColumn("_part", F.spark_partition_id())
    from codeweft.session import cut

    at = cut(at)
    sums = at.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_part").orderBy(order)
    ranked = at.withColumn("_rank", F.row_number().over(own))
    return ranked.join(offset, [key, "_part"]).select(key, order, (F.col("_before") + F.col("_rank")).alias(name))


def calls_per_target(edges: DataFrame) -> DataFrame:
    """(to_id, calls): distinct edge ids of type calls, spelling variants included, per target; a null target is dropped."""
    calls = edges.select("id", "to_id", folded("edge_type").alias("kind")).filter("kind = 'calls' and to_id is not null")
    return distinct_per_key(calls, "to_id", "id", "calls")
