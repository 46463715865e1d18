"""Encoding and decoding of text columns with a public tokenizer's vocabulary, batch by batch in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeweft.llm.automaton import load

#: Texts encoded before a batch is handed on.
SLICE = 512


def default_ranks() -> str:
    """The rank file of the byte-level vocabulary with 50,256 tokens; any other rank file's path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(ranks: str, ids: bool) -> Callable:
    """The text is the first column, its encoding takes its place; the others are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(ranks).encode_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own = [encode(t) if t else b"" for t in part.column(0).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in own)], dtype=np.int64)
                if ids:
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(own), "<i4"), pa.int32()))
                else:
                    out = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([out, *part.columns[1:]], names=["out", *part.schema.names[1:]])

    return run


def _mapped(df: DataFrame, keep: tuple[str, ...], text: str, ranks: str | None, ids: bool, name: str) -> DataFrame:
    own = df.select(text, *keep).toDF("out", *[f"c{i}" for i in range(len(keep))])
    kind = T.StructType([T.StructField("out", T.ArrayType(T.IntegerType()) if ids else T.LongType()), *own.schema.fields[1:]])
    out = own.mapInArrow(_encoder(ranks or default_ranks(), ids), kind).toDF(name, *keep)
    return out.select(*keep, name)


def encode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ranks: str | None = None) -> DataFrame:
    """(*keep, ids): the ids of each text without special tokens. Empty and null texts have no ids, an empty list.

    Strings of special tokens are ordinary text. Rows are kept as they come, repeated ones too.
    """
    return _mapped(df, keep, text, ranks, True, "ids")


def token_counts(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ranks: str | None = None) -> DataFrame:
    """(*keep, n_tokens) of each text; 0 for empty and null texts."""
    return _mapped(df, keep, text, ranks, False, "n_tokens")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """(key, text) of each list of ids; null ids give null, an empty list an empty text."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(path)
        for b in batches:
            text = [None if x is None else automaton.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(text, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"key {kind}, text string").toDF(key, "text")
