"""Exact nearest neighbours in blocks, and embeddings of symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block on either side.
BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str, name: str, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors: (ids, values), made inside each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                flat = np.stack(part[vector].to_numpy()).astype("<f8")
                yield pd.DataFrame({f"{name}_ids": [part[key].to_numpy()], f"{name}_values": [flat.tobytes()]})

    return df.select(key, vector).filter(f"{key} is not null and {vector} is not null").mapInPandas(run, f"{name}_ids array<long>, {name}_values binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """(query_id, id, distance, place) of the k nearest vectors to each query by Euclidean distance, ties by id.

    A stated set of queries is held against all rows block by block: each pair of blocks keeps its own k nearest, and only
    those are gathered per query. Vectors of another dimension than the queries', and null ones, are never near.
    """
    if dimension is None:
        first = queries.filter(f"{vector} is not null").select(F.size(vector)).first()
        if first is None:
            return queries.select(F.col(key).alias("query_id"), F.col(key).alias("id"), F.lit(0.0).alias("distance"), F.lit(0).alias("place")).limit(0)
        dimension = first[0]
    fits = F.size(vector) == dimension
    left = _blocks(queries.filter(fits), key, vector, "q", BLOCK // 8)
    right = _blocks(vectors.filter(fits), key, vector, "v", BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qi, qv, vi, vv in zip(pdf.q_ids, pdf.q_values, pdf.v_ids, pdf.v_values):
                q = np.frombuffer(qv, "<f8").reshape(-1, dimension)
                v = np.frombuffer(vv, "<f8").reshape(-1, dimension)
                ids = np.asarray(vi)
                rough = (v * v).sum(1)[None, :] - 2 * q @ v.T
                take = min(len(ids), k + 16)
                near = np.argpartition(rough, take - 1, axis=1)[:, :take]
                out = []
                for row, own in enumerate(near):
                    if take < len(ids):  # ties at the edge of what was taken stay in
                        edge = rough[row, own].max()
                        own = np.flatnonzero(rough[row] <= edge + 1e-9 * max(1.0, abs(edge)))
                    d = np.sqrt(((v[own] - q[row]) ** 2).sum(1))
                    best = np.lexsort((ids[own], d))[:k]
                    out.append(pd.DataFrame({"query_id": qi[row], "id": ids[own][best], "distance": d[best]}))
                yield pd.concat(out)

    pairs = left.crossJoin(right).mapInPandas(run, "query_id long, id long, distance double")  # blocks, not rows
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def similar(queries: DataFrame, vectors: DataFrame, limit: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, score) of the nearest others, score 1 / (1 + distance); ``limit`` is clamped to 1..100."""
    limit = max(1, min(100, int(limit)))
    found = nearest(queries, vectors, limit + 1, key, vector).filter("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("_n", place).filter(F.col("_n") <= limit).select("query_id", "id", "distance", (1 / (1 + F.col("distance"))).alias("score"))


def snippet(code: Column | None = None) -> Column:
    """The text by which a symbol is embedded: name, type, signature, place, description and code, empty ones left out."""
    lines = [
        F.concat(F.lit("Symbol: "), F.col("qualified_name")),
        F.concat(F.lit("Type: "), F.col("symbol_type")),
        F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("Signature: "), F.col("signature"))),
        F.concat(F.lit("Context: "), F.col("file_path")),
        F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("Description: "), F.substring("docstring", 1, 500))),
    ]
    if code is not None:
        with_code = ~F.col("symbol_type").isin("file", "module", "package")
        lines.append(F.when(with_code & (F.coalesce(code, F.lit("")) != ""), F.concat(F.lit("Code:\n"), F.substring(code, 1, 1000))))
    return F.concat_ws("\n", *lines)


def stale(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id) of nodes without an embedding, or with one of another checksum; a null checksum differs from none."""
    own = metadata.select("id", F.col("checksum").alias("_checksum"), F.lit(True).alias("_known"))
    return nodes.select("id", "checksum").join(own, "id", "left").filter("_known is null or checksum <> _checksum").select("id")


def hash_vectors(texts: list[str], dimension: int = 64) -> list[list[float]]:
    """The offline provider: a fixed unit vector for each text, from its words' hashes."""
    out = []
    for text in texts:
        v = np.zeros(dimension)
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dimension] += 1 if h >> 63 else -1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def embedded(snippets: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hash_vectors, batch: int = 50) -> DataFrame:
    """(id, embedding) of snippets (id, text), asked of the provider in batches; a batch that fails is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    vectors = provider(part["text"].tolist())
                except Exception:  # noqa: BLE001 - whatever a provider raises, the batch stays stale
                    continue
                yield pd.DataFrame({"id": part["id"], "embedding": vectors})

    return snippets.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def stored(vectors: DataFrame, vec_id: int) -> DataFrame:
    """The stored vector of an id; none where there is no row."""
    return vectors.filter(F.col("vec_id") == vec_id)
