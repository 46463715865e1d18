"""Filling fixed-capacity containers with texts, sized in tokens of a public tokenizer.

Best fit under conflicts, largest piece first: open containers are ordered by what is left in them, and each carries a
bitmap of the duplicate clusters and one of the sources in it. A search starts at the tightest container that has room
and goes on to the next larger rest until one is compatible; among containers of equal rest one without the piece's
source is preferred. Only texts above the capacity are split, into full pieces and a rest.

Two copies of a text, equal but for case and white space, never share a container, unless a cluster has more copies than
the containers its pieces need anyway: then it is cut into sub-clusters of so many copies, one bit each. Where clusters
of very many copies would still leave room unused, their sub-clusters are halved, so that copies may meet, until they
don't. Without that rule, a cluster with a third of all rows would leave most containers nearly empty.

Pieces are spread over independent shards by a hash of their key, so that a task packs about ``shard_items`` pieces; a
shard wastes less than one container more than a single packing would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.tokenize import token_counts
from codeweft.session import cut

SHARD_ITEMS = 20_000
#: Containers of a shard; a container's number is shard * SHARD_BINS + its place.
SHARD_BINS = 1 << 24


def best_fit(sizes: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; sizes are at most the capacity. Equal sizes go in the order given.

    If heavy clusters, with more copies than a quarter of the containers needed, leave more than a hundredth of the room
    unused, their copies may meet twice as often, until they don't. Other clusters' copies never meet.
    """
    need = max(1, -(-int(sizes.sum()) // capacity))
    own, copies = np.unique(clusters, return_inverse=True, return_counts=True)[1:]
    most, meet = int(copies.max(initial=1)), 1
    while True:
        out = _fit(sizes, own, copies, sources, capacity, need, meet)
        if out.max(initial=0) + 1 <= 1.01 * need + 1 or 4 * most <= need or meet >= most:
            return out
        meet *= 2


def _fit(sizes: np.ndarray, own: np.ndarray, copies: np.ndarray, sources: np.ndarray, capacity: int, need: int, meet: int) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    bit: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    held: list[int] = []  # bitmap of sub-clusters per container
    kinds: list[int] = []  # bitmap of sources per container
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources.tolist()))}
    open_ = 0  # a bit for each rest that some container has
    for i in np.argsort(-sizes, kind="stable"):
        size, c, src, mine = int(sizes[i]), int(own[i]), source_bit[sources[i]], 0
        if copies[c] > 1:
            k = seen[c] = seen.get(c, -1) + 1
            room = max(1, need // meet) if 4 * copies[c] > need else need
            mine = bit.setdefault((c, k // room), 1 << len(bit))
        place, above = -1, open_ >> size << size
        while above:
            r = (above & -above).bit_length() - 1
            row = rest[r]
            for j in range(len(row) - 1, -1, -1):
                if not held[row[j]] & mine:
                    if place < 0:
                        place = j
                    if not kinds[row[j]] & src:
                        place = j
                        break
                    if len(row) - j >= 8:  # the preference looks at a few; the conflict at all
                        break
            if place >= 0:
                b = row[place]
                row[place] = row[-1]
                row.pop()
                if not row:
                    open_ &= ~(1 << r)
                break
            above &= above - 1
        else:
            b, r = len(held), capacity
            held.append(0)
            kinds.append(0)
        held[b] |= mine
        kinds[b] |= src
        rest[r - size].append(b)
        open_ |= 1 << (r - size)
        out[i] = b
    return out


def pack(pieces: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS, n: int | None = None) -> DataFrame:
    """Adds ``container`` to pieces (item, piece, size, cluster, source); ``n`` is their number, counted if not given.

    A null cluster conflicts with nothing; a null source is a source. Pieces of size 0 are placed too.
    """
    n = pieces.count() if n is None else n
    shards = max(1, -(-n // shard_items))
    kind = pieces.schema["item"].dataType.simpleString()

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        cluster = group["cluster"].fillna(0).to_numpy(np.int64)
        alone = group["cluster"].isna().to_numpy()
        cluster = np.unique(cluster, return_inverse=True)[1].astype(np.int64)
        cluster[alone] = -1 - np.arange(alone.sum())
        place = best_fit(group["size"].to_numpy(np.int64), cluster, group["source"].fillna("").to_numpy(), capacity)
        return pd.DataFrame({"item": group["item"], "piece": group["piece"], "size": group["size"], "container": int(key[0]) * SHARD_BINS + place})

    at = F.pmod(F.xxhash64("item", "piece"), F.lit(shards))
    return pieces.withColumn("_shard", at).groupBy("_shard").applyInPandas(run, f"item {kind}, piece int, size long, container long")


def pack_documents(documents: DataFrame, capacity: int = 4096, ranks: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of every document.

    Null and empty texts have one piece of 0 tokens. A text above the capacity has pieces of the capacity, numbered from
    0 in the order of the text, and a rest. Repeated rows of a doc_id are packed once each.
    """
    text = F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "))
    marked = documents.select("doc_id", "source", "text", F.when(text != "", F.xxhash64(text)).alias("cluster"))
    sized = cut(token_counts(marked, ("doc_id", "source", "cluster"), ranks=ranks))
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)) - 1
    rows = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("p"))
    pieces = rows.select(
        F.col("doc_id").alias("item"),
        F.col("p").cast("int").alias("piece"),
        F.least(F.col("n_tokens") - F.col("p") * capacity, F.lit(capacity)).alias("size"),
        "cluster",
        "source",
    )
    return pack(pieces, capacity, shard_items).select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")
