import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeweft.llm.packing import best_fit, pack, pack_documents

pytest.importorskip("public_tokenizers")


def fill(sizes, clusters=None, sources=None, capacity=100):
    n = len(sizes)
    s = np.array(sizes, np.int64)
    out = best_fit(s, np.arange(n) if clusters is None else np.array(clusters), np.array(["s"] * n if sources is None else sources, object), capacity)
    load = np.bincount(out, weights=s)
    assert load.max(initial=0) <= capacity
    return out, load


def test_tight_and_within_capacity():
    rnd = random.Random(4)
    sizes = [rnd.randint(0, 60) for _ in range(3000)]
    out, load = fill(sizes)
    assert load.sum() == sum(sizes) and sum(sizes) / (100 * len(load)) > 0.995


def test_takes_the_tightest():
    out, _ = fill([70, 60, 30])
    assert out[2] == out[0] != out[1]


def test_copies_stay_apart_while_they_can():
    rnd = random.Random(6)
    clusters = [rnd.randrange(300) for _ in range(2000)]
    out, load = fill([rnd.randint(1, 20) for _ in range(2000)], clusters)
    assert max(Counter(zip(out.tolist(), clusters)).values()) == 1 and load.sum() / (100 * len(load)) > 0.98


def test_one_cluster_with_most_rows_does_not_empty_the_containers():
    sizes, clusters = [10] * 900 + [30] * 300, [0] * 900 + list(range(1, 301))
    out, load = fill(sizes, clusters)
    assert load.sum() / (100 * len(load)) > 0.95


def test_sources_are_mixed_among_equals():
    out, _ = fill([60, 60, 40], None, ["a", "b", "a"])
    assert out[2] == out[1]


def test_documents(spark):
    long_text = " ".join(["word"] * 1000)
    rows = [(1, long_text, "a"), (2, "", "a"), (3, None, None), (4, "Same text here.", "b"), (5, "same  TEXT here.", "b"), (6, " ", "c"), (6, "repeat", "c"), (6, "repeat", "c")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, item string")
    got = pack_documents(df, 100).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.n_tokens, r.container))
    assert sorted(p[:2] for p in pieces[1]) == [(i, 100) for i in range(10)]
    assert [p[1] for p in pieces[2] + pieces[3]] == [0, 0] and len(pieces[6]) == 3
    assert pieces[4][0][2] != pieces[5][0][2]
    assert pack_documents(df.limit(0), 100).count() == 0


def test_shards(spark):
    df = spark.createDataFrame([(i, 0, 1 + i % 50, None, "s") for i in range(2000)], "item long, piece int, size long, cluster long, source string")
    got = pack(df, 100, shard_items=300).toPandas()
    assert len(got) == 2000 and got.groupby("container")["size"].sum().max() <= 100
    assert got["size"].sum() / (100 * got.container.nunique()) > 0.97
