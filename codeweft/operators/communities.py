"""Label propagation: synchronous and distributed, or in seeded random order on a small graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, label) of every node: labels spread over edges in both directions until none changes, or for ``rounds``.

    Parallel edges count each, a self loop twice, a neighbour in the same file half more. A node keeps its label unless
    another has more weight; among those the lowest wins. Even and odd ids take turns, so that two halves of a bipartite
    graph don't swap labels for ever. Neighbours are combined to one weighted row a pair once, before the rounds.
    """
    files = nodes.select("id", "file_path").distinct()
    a, b = F.col("from_id"), F.col("to_id")
    both = edges.filter("from_id is not null and to_id is not null").select(
        F.inline(F.array(F.struct(a.alias("id"), b.alias("other")), F.struct(b.alias("id"), a.alias("other"))))
    )
    pairs = both.groupBy("id", "other").agg(F.count("*").alias("n"))
    placed = pairs.join(files.withColumnRenamed("file_path", "_own"), "id").join(files.withColumnsRenamed({"id": "other", "file_path": "_other"}), "other")
    weight = F.col("n") * F.when(F.col("_own") == F.col("_other"), 1.5).otherwise(1.0)
    pairs = cut(placed.select("id", "other", weight.alias("weight")))
    labels = cut(files.select("id", F.col("id").alias("label")).distinct())
    still = 0
    for k in range(rounds):
        heard = pairs.filter(F.pmod("id", F.lit(2)) == k % 2).join(labels.withColumnRenamed("id", "other"), "other")
        sums = heard.groupBy("id", "label").agg(F.sum("weight").alias("weight"))
        own = labels.withColumnRenamed("label", "_label")
        voted = sums.join(own, "id").groupBy("id").agg(
            F.max_by("label", F.struct("weight", F.col("label") == F.col("_label"), -F.col("label"))).alias("_new")
        )
        merged = labels.join(voted, "id", "left").select("id", F.coalesce("_new", "label").alias("label"), (F.col("_new") != F.col("label")).alias("_moved"))
        merged = cut(merged)
        still = still + 1 if merged.filter("_moved").isEmpty() else 0
        labels = merged.select("id", "label")
        if still == 2:
            break
    return labels


def mulberry32(seed: int) -> Callable[[], float]:
    """The 32-bit generator by that name: numbers in [0, 1) from a seed."""
    state = seed & 0xFFFFFFFF

    def times(x: int, y: int) -> int:
        return (x * y) & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = times(state ^ state >> 15, state | 1)
        x ^= (x + times(x ^ x >> 7, x | 61)) & 0xFFFFFFFF
        return (x ^ x >> 14) / 2**32

    return draw


def propagate_seeded(ids: list[int], links: list[tuple[int, int]], files: dict[int, str], seed: int = 1, rounds: int = 20) -> dict[int, int]:
    """Asynchronous propagation in a seeded random order over lists that the caller has bounded; the label of each id."""
    draw = mulberry32(seed)
    near: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in links:
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    label = {i: i for i in ids}
    order = list(ids)
    for _ in range(rounds):
        for i in range(len(order) - 1, 0, -1):
            j = int(draw() * (i + 1))
            order[i], order[j] = order[j], order[i]
        moved = False
        for i in order:
            weights: dict[int, float] = {}
            for j in near[i]:
                weights[label[j]] = weights.get(label[j], 0.0) + (1.5 if files.get(i) == files.get(j) else 1.0)
            best, most = label[i], weights.get(label[i], 0.0)
            for own, w in weights.items():
                if w > most:
                    best, most = own, w
            if best != label[i]:
                label[i], moved = best, True
        if not moved:
            break
    return label
