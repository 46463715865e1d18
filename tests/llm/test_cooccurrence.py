import random
from collections import Counter, defaultdict
from math import log2

import pytest
from pyspark.sql import functions as F

from codeweft.functions.names import folded
from codeweft.llm.cooccurrence import cooccurrence

KIND = "b long, t string, item string, n long"


def brute(rows):
    own, every = defaultdict(set), set()
    for b, t, *_ in rows:
        if b is not None:
            every.add(b)
            if t is not None and t.strip():
                own[b].add(t.strip().lower())
    one, two = Counter(), Counter()
    for x in own.values():
        one.update(x)
        two.update((p, q) for p in x for q in x if p < q)
    n = len(every)
    return {k: (n, one[k[0]], one[k[1]], v, v * n / (one[k[0]] * one[k[1]])) for k, v in two.items()}


def sample(seed=0):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(60), rnd.choice(["A", "a ", "b", " B", "c", "d", "e"]), "x", 1) for _ in range(400)]
    rows += [(1000, f"t{i:03d}", "x", 1) for i in range(150)] * 2  # one basket with a large share of the rows
    return rows + [(None, "a", "x", 1), (70, None, "x", 1), (71, "  ", "x", 1), (72, "", "x", 1)]


@pytest.mark.parametrize("block", [8, 64, 1000])
def test_against_brute_force(spark, block):
    df = spark.createDataFrame(sample(), KIND)
    got = {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.n_ab, r.lift) for r in cooccurrence(df, "b", folded("t"), block=block).collect()}
    want = brute(sample())
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:4] == v[:4] and got[k][4] == pytest.approx(v[4])


def test_thresholds_lose_nothing(spark):
    df = spark.createDataFrame(sample(1), KIND)
    got = {(r.item_a, r.item_b) for r in cooccurrence(df, "b", folded("t"), min_count=5, min_share=(1, 10)).collect()}
    assert got == {k for k, v in brute(sample(1)).items() if v[3] >= 5 and 10 * v[3] >= v[0]}


def test_pmi_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "", 1), (1, "b", "", 1), (2, "c", "", 1), (3, "c", "", 1)], KIND)
    r = cooccurrence(df, "b", F.col("t")).collect()
    assert len(r) == 1 and r[0].pmi == pytest.approx(log2(3))
    assert cooccurrence(df.limit(0), "b", "t").count() == 0
