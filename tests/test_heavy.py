from collections import defaultdict

from pyspark.sql import functions as F

from codeweft.operators import heavy

KIND = "id long, to_id long, edge_type string, extra string"


def sample():
    rows = [(i, 7, "calls", "x") for i in range(3000)] + [(i, 7, " CALLS", "x") for i in range(0, 3000, 3)]
    rows += [(5000 + i, i % 40, "calls", None) for i in range(500)]
    return rows + [(None, 7, "calls", "x"), (1, None, "calls", "x"), (2, 7, None, "x"), (9000, 3, "reads", "x"), (9001, 8, "Calls\t", "x")]


def test_distinct_edges_per_target(spark):
    want = defaultdict(set)
    for i, t, k, _ in sample():
        if k and k.strip().lower() == "calls" and t is not None and i is not None:
            want[t].add(i)
    got = {r.to_id: r.calls for r in heavy.calls_per_target(spark.createDataFrame(sample(), KIND)).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_the_hot_key_is_split(spark):
    df = heavy.spread(spark.createDataFrame(sample(), KIND).filter("id is not null"), "to_id", "id", 8)
    parts = df.filter("to_id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3


def test_states_and_ranks(spark):
    df = spark.createDataFrame(sample(), KIND)
    got = {r.to_id: (r.n, r.low) for r in heavy.states_per_key(df, "to_id", "id", n=("count", F.col("id")), low=("min", F.col("id"))).collect()}
    assert got[7] == (3000 + 1000 + len([i for i in range(500) if i % 40 == 7]) + 1, 0)
    ranks = heavy.running_per_key(df, "to_id", "id").filter("to_id = 7").orderBy("id").collect()
    assert [r["rank"] for r in ranks] == list(range(1, len(ranks) + 1))


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert heavy.calls_per_target(df).count() == 0 == heavy.running_per_key(df, "to_id", "id").count()
