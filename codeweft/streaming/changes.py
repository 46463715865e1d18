"""Change events as a stream: filters, bursts, and batches applied to a versioned graph.

A micro-batch is applied once: each writes a new version of the tables under its batch number and marks it done last, and
a batch that is already marked is skipped. The events of a batch that fails are kept beside the versions and come before
those of the next one, so none is lost when the stream goes on; the last commit up to which all is applied is stored with
the version. Batches are serial by nature. Events count in arrival order; late ones are simply processed when they come.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codeweft.functions.names import canonical
from codeweft.operators import ingest
from codeweft.session import cut, partitions
from codeweft.sources.files import MOST_BYTES, ignored

CHANGES = T.StructType(
    [T.StructField("event", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("commit_hash", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
)
# Events and quiet time after which a burst is handled, the batch from which a full sync is cheaper, and the
# failures in a row that are an error.
BURST_EVENTS, BURST_SECONDS, LARGE_BATCH, MOST_FAILURES = 50, 1, 50, 3
# What a file watcher calls its events.
WATCHED = {"add": "ADD", "change": "MODIFY", "unlink": "DELETE"}


def read_changes(spark: SparkSession, path: str, schema: T.StructType = CHANGES, files_per_batch: int = 1) -> DataFrame:
    """A stream of change rows from a folder of Parquet files, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def normalised(changes: DataFrame) -> DataFrame:
    """Watcher names to event names, spelling variants folded, paths in canonical form; unknown events and null paths go."""
    low = F.lower(F.trim("event"))
    event = F.coalesce(*[F.when(low == k, v) for k, v in WATCHED.items()], F.upper(low))
    own = changes.withColumns({"event": event, "file_path": canonical("file_path")})
    return own.filter(F.col("event").isin("ADD", "MODIFY", "DELETE") & F.col("file_path").isNotNull())


def wanted(changes: DataFrame, extensions: list[str], rules: list[str] | None = None, size: Column | None = None) -> DataFrame:
    """Changes of files with the extensions, outside the ignore rules and not too large; a deletion has no size to check."""
    ext = F.regexp_extract(F.lower("file_path"), r"\.([^./]+)$", 1)
    own = changes.filter(ext.isin(*extensions) & ~ignored(F.regexp_replace("file_path", "^/", ""), rules or []))
    return own if size is None else own.filter((F.col("event") == "DELETE") | (size <= MOST_BYTES))


def bursts(changes: DataFrame, seconds: int = BURST_SECONDS) -> DataFrame:
    """(started, ended, events, flushes) of runs of events with less than ``seconds`` between them.

    A burst is handled once more for every 50 events in it. Events without a time are in none. On batches, events are
    range-partitioned by time, and runs that cross a border are numbered through from the partitions' borders, of which
    there is one row a partition. On streams, which need a watermark on a ts that is a timestamp, sessions are Spark's.
    """
    kind = changes.schema["ts"].dataType
    own = (changes if isinstance(kind, T.TimestampType) else changes.withColumn("ts", F.col("ts").cast("timestamp"))).filter("ts is not null")
    if own.isStreaming:
        one = F.substring("event", 1, 0).alias("_one")  # sessions on a stream need a key; this one is the same for all
        runs = own.groupBy(F.session_window("ts", f"{seconds} seconds").alias("w"), one).agg(F.count("*").alias("events")).select(
            F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events"
        )
    else:
        runs = _runs(own.select("ts"), seconds)
    return runs.withColumn("flushes", F.ceil(F.col("events") / BURST_EVENTS).cast("int"))


def _runs(own: DataFrame, seconds: int) -> DataFrame:
    gap = F.expr(f"interval {seconds} seconds")
    n = partitions(own.sparkSession)
    counted = own.groupBy("ts").agg(F.count("*").alias("n"))  # equal times are of one run
    placed = cut(counted.repartitionByRange(n, "ts").withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part").orderBy("ts")
    ends = placed.groupBy("_part").agg(F.max("ts").alias("_end"))
    before = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_before"))  # one row a partition
    begun = placed.join(F.broadcast(before), "_part").withColumn("_last", F.coalesce(F.lag("ts").over(inner), "_before"))
    begun = begun.withColumn("_new", F.when(F.col("ts") < F.col("_last") + gap, 0).otherwise(1))
    begun = cut(begun.withColumn("_run", F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0))))
    sums = begun.groupBy("_part").agg(F.sum("_new").alias("_sum"))
    shift = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    whole = begun.join(F.broadcast(shift), "_part").groupBy((F.col("_run") + F.col("_shift")).alias("_run"))
    return whole.agg(F.min("ts").alias("started"), (F.max("ts") + gap).alias("ended"), F.sum("n").alias("events")).drop("_run")


@dataclass
class Store:
    """Versions of named tables in a shared folder; the newest version that is marked done holds."""

    spark: SparkSession
    root: str

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._exists(f"{self.root}/{n}/_DONE"))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.versions()[-1] if version is None else version}/{name}")

    def keep(self, batch_id: int, events: DataFrame) -> None:
        """Puts the events of a batch that failed aside."""
        events.write.mode("overwrite").parquet(f"{self.root}/pending/b={batch_id}")

    def pending(self) -> DataFrame | None:
        """The events put aside since the newest version, which holds all before it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pending")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest = max(self.versions(), default=-1)
        ids = [int(x.getPath().getName()[2:]) for x in fs.listStatus(p)] if fs.exists(p) else []
        left = [f"{self.root}/pending/b={i}" for i in sorted(ids) if i + 1 > newest]
        return self.spark.read.parquet(*left) if left else None

    def forget(self) -> None:
        """Drops what was put aside once a version holds it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pending")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def watermark(self) -> str | None:
        """The last commit up to which everything is in the newest version."""
        done = self.versions()
        if not done or not self._exists(f"{self.root}/v={done[-1]}/watermark"):
            return None
        row = self.read("watermark", done[-1]).first()
        return row["commit_hash"] if row else None

    def compact(self, keep: int = 2) -> None:
        """Deletes all but the newest versions."""
        for v in self.versions()[:-keep]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={v}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def write(self, version: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={version}/_DONE")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True).close()


@dataclass
class Applier:
    """Handles micro-batches of changes for ``foreachBatch``.

    ``parsed`` gives (nodes, raw edges) of the changed files, ``full_sync`` does everything anew and returns (nodes, edges).
    A batch of ``LARGE_BATCH`` events or more, and every batch after a failure until one succeeds, goes to the full sync.
    A failed batch's events are kept and go with the next batch. The third failure in a row is raised. ``done_commit`` is
    the last commit up to which every batch succeeded; it is read from the store, so it outlives the process.
    """

    store: Store
    parsed: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    full_sync: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None
    failures: int = 0
    log: list[tuple[int, str]] = field(default_factory=list)

    @property
    def done_commit(self) -> str | None:
        return self.store.watermark()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id + 1 in self.store.versions():
            return
        events, kept = normalised(batch), self.store.pending()
        if kept is not None:
            events = kept.unionByName(events, allowMissingColumns=True)
        events = cut(events)
        n = events.count()
        if not n:
            self.log.append((batch_id, "empty"))
            return
        way = "full" if self.full_sync and (n >= LARGE_BATCH or self.failures or kept is not None) else "events"
        try:
            if way == "full":
                nodes, edges = self.full_sync(events)
            else:
                new, raw = self.parsed(events)
                nodes, edges = ingest.applied(self.store.read("nodes"), self.store.read("edges"), events, new, raw)
            mark = events.agg(F.max_by("commit_hash", F.struct("ts", "commit_hash")).alias("commit_hash"))
            self.store.write(batch_id + 1, nodes=nodes, edges=edges, watermark=mark)
        except Exception:
            self.failures += 1
            self.log.append((batch_id, "failed"))
            if self.failures >= MOST_FAILURES:
                raise  # the stream's own checkpoint stays before this batch
            self.store.keep(batch_id, events)
            return
        self.failures = 0
        self.store.forget()
        self.log.append((batch_id, way))


def run(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """The stream with a batch handler; ``once`` handles what is there in batches and ends."""
    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{BURST_SECONDS} seconds")).start()


def last_events(changes: DataFrame, folder: str) -> DataFrame:
    """The last event of each file over the whole stream, kept up batch by batch as versions under ``folder``."""
    spark = changes.sparkSession
    store = Store(spark, f"{folder}/last")

    def handle(batch: DataFrame, batch_id: int) -> None:
        old = store.versions()
        if batch_id + 1 in old:
            return
        own = normalised(batch).select("file_path", "event", "commit_hash", "ts")
        if old:
            own = own.unionByName(store.read("events", old[-1]))
        store.write(batch_id + 1, events=ingest.last_events(own))
        store.compact()

    run(changes, handle, f"{folder}/progress").awaitTermination()
    if not store.versions():
        return spark.createDataFrame([], "file_path string, event string, commit_hash string, ts timestamp_ntz")
    return store.read("events")
