"""References to records that do not exist, per table, field and period.

Keys are integers: ids as they are, names by a dictionary of dense integers. References and parents become compressed
bitmaps per key range and period, references AND NOT parents is taken range by range, and the surviving bits are decoded
to keys. A container holds the offsets of one range as sorted 16-bit integers or as a bitmap, whichever is smaller, so a
sparse range costs two bytes a key. Map tasks build containers before anything is shuffled; a hot key is one bit there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import blank, canonical_name
from codeweft.operators.ranks import numbered
from codeweft.session import cut, small

#: Keys of a range; offsets fit 16 bits.
RANGE = 1 << 14
#: Keys that a map task holds before it packs them.
HELD = 2_000_000
#: The referring fields of the graph's tables; a reference carries its field's place here.
FIELDS = (("edges", "from_id"), ("edges", "to_id"), ("annotations", "node_qname"), ("test_specs", "target_qname"))
BY_ID, BY_NAME = 0, 1
#: Parts in which the containers of a range and group from all map tasks are united before they meet.
PARTS = 32
PARENT = -1


def _pack(offsets: np.ndarray) -> bytes:
    """Sorted distinct offsets as a container: kind byte, then offsets or bitmap."""
    if 2 * len(offsets) <= RANGE // 8:
        return b"\0" + offsets.astype("<u2").tobytes()
    flags = np.zeros(RANGE, np.uint8)
    flags[offsets] = 1
    return b"\1" + np.packbits(flags).tobytes()


def _flags(containers: list[bytes]) -> np.ndarray:
    """The union of containers as one flag an offset."""
    flags = np.zeros(RANGE, bool)
    for c in containers:
        if c[0]:
            flags |= np.unpackbits(np.frombuffer(c, np.uint8, offset=1)).astype(bool)
        else:
            flags[np.frombuffer(c, "<u2", offset=1)] = True
    return flags


def _boxes(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    space, group, key = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("space", "grp", "key"))
    order = np.lexsort((key, group, space))
    space, group, key = space[order], group[order], key[order]
    rng = key // RANGE
    edge = np.r_[True, (space[1:] != space[:-1]) | (group[1:] != group[:-1]) | (rng[1:] != rng[:-1])]
    first = edge | np.r_[True, key[1:] != key[:-1]]
    space, group, rng, key, edge = (x[first] for x in (space, group, rng, key, edge))
    at = np.flatnonzero(edge)
    bits = [_pack(key[a:b] - rng[a] * RANGE) for a, b in zip(at, [*at[1:], len(key)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(space[at], pa.int32()), pa.array(group[at], pa.int32()), pa.array(rng[at], pa.int64()), pa.array(bits, pa.binary())],
        names=["space", "grp", "range", "bits"],
    )


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(space, grp, key) rows to containers (space, grp, range, bits)."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= HELD:
            yield _boxes(held)
            held, n = [], 0
    if held:
        yield _boxes(held)


def _merged(table: pa.Table) -> pa.Table:
    """The containers of one space, range, group and part of the map tasks as one."""
    bits = _pack(np.flatnonzero(_flags(table.column("bits").to_pylist())))
    one = table.slice(0, 1)
    return pa.table([*[one.column(c) for c in ("space", "grp", "range")], pa.array([bits], pa.binary())], names=["space", "grp", "range", "bits"])


def _survivors(table: pa.Table) -> pa.Table:
    """One range of one space: the keys of each group that no parent has."""
    by: dict[int, list[bytes]] = {}
    for g, bits in zip(table.column("grp").to_pylist(), table.column("bits").to_pylist()):
        by.setdefault(g, []).append(bits)
    parents = _flags(by.pop(PARENT, []))
    base = table.column("range")[0].as_py() * RANGE
    keys = {g: np.flatnonzero(_flags(own) & ~parents) + base for g, own in by.items()}
    n = sum(map(len, keys.values()))
    return pa.table(
        [
            pa.array([table.column("space")[0].as_py()] * n, pa.int32()),
            pa.array([g for g, k in keys.items() for _ in k], pa.int32()),
            pa.array(np.concatenate([*keys.values(), np.zeros(0, np.int64)]), pa.int64()),
        ],
        names=["space", "grp", "key"],
    )


def missing_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(space, grp, key) of references (the same integer columns, grp from 0) without a row in parents (space, key).

    Null keys are no references. A range has at most ``RANGE`` bits a group and map task, whatever the number of rows; the
    containers of many map tasks are united in ``PARTS`` parts first, so a range then gets at most so many a group.
    """
    ints = [F.col("space").cast("int").alias("space"), F.col("grp").cast("int").alias("grp"), F.col("key").cast("long").alias("key")]
    kind = "space int, grp int, range long, bits binary"
    sides = [references, parents.withColumn("grp", F.lit(PARENT))]
    boxes = [s.filter("key is not null").select(*ints).mapInArrow(_containers, kind) for s in sides]
    every = boxes[0].unionByName(boxes[1]).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    few = every.groupBy("space", "range", "grp", "part").applyInArrow(_merged, "space int, grp int, range long, bits binary")
    return few.groupBy("space", "range").applyInArrow(_survivors, "space int, grp int, key long")


def dictionary(names: DataFrame) -> DataFrame:
    """(name, key) with dense keys from 0 in the order of the names: sorted ranges, each offset by the ranges before it.

    Null names get no key. The driver sees one count a partition.
    """
    return numbered(names.select("name").filter("name is not null").distinct(), "name", "key")


def period(ts: Column) -> Column:
    """The month of a timestamp as the integer yyyymm, 0 for null."""
    return F.coalesce(F.year(ts) * 100 + F.month(ts), F.lit(0))


def epoch(c: Column) -> Column:
    """Epoch seconds or milliseconds, told apart by size, as a timestamp."""
    return F.timestamp_seconds(F.when(F.abs(c) >= 100_000_000_000, c / 1000).otherwise(c))


def _references(edges: DataFrame, annotations: DataFrame, test_specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References by id (field, period, row_id, key) and by name (field, period, row_id, name); null and blank ones are none."""
    both = F.array(*[F.struct(F.lit(i).alias("field"), F.col(FIELDS[i][1]).alias("key")) for i in (0, 1)])
    by_id = edges.select(F.col("id").alias("row_id"), period(F.col("indexed_at")).alias("period"), F.inline(both)).filter("key is not null")
    named = [
        t.filter(~blank(FIELDS[i][1])).select(F.lit(i).alias("field"), period(ts).alias("period"), F.col("id").alias("row_id"), canonical_name(FIELDS[i][1]).alias("name"))
        for t, i, ts in ((annotations, 2, epoch(F.col("created_at"))), (test_specs, 3, F.col("indexed_at")))
    ]
    return by_id, named[0].unionByName(named[1])


def orphan_references(edges: DataFrame, annotations: DataFrame, test_specs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (table_name, ref_field, period, row_id) whose key no row of ``nodes`` has, in any version.

    Names are compared with canonical path parts. ``period`` is the month yyyymm of the referring row, null if it has no
    time. The surviving keys are joined back to the rows: broadcast if counted small, else by a shuffle with skew handling.
    """
    by_id, by_name = _references(edges, annotations, test_specs)
    words = cut(dictionary(by_name.select("name").distinct()))
    by_name = by_name.join(words, "name").drop("name")
    known = nodes.select(canonical_name("qualified_name").alias("name")).join(words, "name").select(F.lit(BY_NAME).alias("space"), "key")
    parents = nodes.select(F.lit(BY_ID).alias("space"), F.col("id").alias("key")).unionByName(known)
    refs = by_id.withColumn("space", F.lit(BY_ID)).unionByName(by_name.withColumn("space", F.lit(BY_NAME)))
    grouped = refs.select("space", (F.col("field") * 1_000_000 + F.col("period")).alias("grp"), "key")
    gone = cut(missing_keys(grouped, parents).select("space", "key").distinct())
    lost = refs.join(small(gone, gone.count()), ["space", "key"], "left_semi")
    names = [F.element_at(F.array(*[F.lit(f[i]) for f in FIELDS]), F.col("field") + 1) for i in (0, 1)]
    return lost.select(names[0].alias("table_name"), names[1].alias("ref_field"), F.nullif("period", F.lit(0)).alias("period"), "row_id").distinct()


def orphan_report(edges: DataFrame, annotations: DataFrame, test_specs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct orphan rows per table, field and month (yyyymm) of the referring row; a row without a time has a null period."""
    rows = orphan_references(edges, annotations, test_specs, nodes)
    return rows.groupBy("table_name", "ref_field", "period").agg(F.countDistinct("row_id").alias("orphan_rows"))
