import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from codeweft.streaming import changes


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, changes.CHANGES).coalesce(1).write.parquet(f"{folder}/{name}")


def at(n):
    return datetime(2025, 1, 1, 0, 0, n)


def test_last_events_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    for i, rows in enumerate([[("add", "/A.ts", "c1", at(1)), ("DELETE ", "/b.ts", "c1", at(5))], [("modify", "/a.ts", "c2", at(9)), ("ADD", "/b.ts", "c0", at(2)), ("odd", "/z", "c", at(1)), ("ADD", None, "c", at(1))]]):
        write(spark, src, f"p{i}.parquet", rows)
    got = {r.file_path: r.event for r in changes.last_events(changes.read_changes(spark, f"{src}/*.parquet"), str(tmp_path / "out")).collect()}
    assert got == {"/a.ts": "MODIFY", "/b.ts": "DELETE"}


def test_bursts_and_filters(spark):
    df = spark.createDataFrame([("ADD", f"/x{i}.ts", "c", at(i // 60)) for i in range(120)] + [("DELETE", "/node_modules/y.ts", "c", at(30)), ("ADD", "/q.bin", "c", at(30))], changes.CHANGES)
    own = changes.wanted(df, ["ts"])
    assert own.count() == 120
    assert [(r.events, r.flushes) for r in changes.bursts(df).orderBy("started").collect()] in ([(60, 2), (60, 2), (2, 1)], [(120, 3), (2, 1)])
    assert changes.bursts(df.limit(0)).count() == 0 and changes.bursts(df.withColumn("ts", F.lit(None).cast("timestamp_ntz"))).count() == 0


def test_bursts_across_partitions(spark):
    rnd, t, rows = random.Random(2), 0.0, []
    for _ in range(400):
        t += rnd.choice([0, 0.1, 0.3, 0.9, 1, 1.5])
        rows.append(datetime.fromtimestamp(t, UTC).replace(tzinfo=None))
    want, run = [], [rows[0]]
    for x in rows[1:]:
        if (x - run[-1]).total_seconds() < 1:
            run.append(x)
        else:
            want.append((run[0], len(run)))
            run = [x]
    want.append((run[0], len(run)))
    df = spark.createDataFrame([("ADD", "/x", "c", x) for x in rnd.sample(rows, len(rows))], changes.CHANGES)
    got = [(r.started, r.events) for r in changes.bursts(df).withColumn("started", F.col("started").cast("timestamp_ntz")).orderBy("started").collect()]
    assert got == want


def test_bursts_on_a_stream(spark, tmp_path):
    write(spark, tmp_path / "in", "p.parquet", [("ADD", "/x", "c", at(1)), ("ADD", "/y", "c", at(1)), ("ADD", "/z", "c", at(40))])
    stream = changes.read_changes(spark, f"{tmp_path}/in/*.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 seconds")
    out = changes.bursts(stream).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert [(r.events, r.flushes) for r in spark.table("runs").collect()] == [(2, 1)]


def test_a_failed_batch_is_not_lost(spark, tmp_path):
    """Without a full sync the events of a batch that failed once are applied with the next; the watermark outlives the handler."""
    kind = "id long, qualified_name string, file_path string, symbol_type string, version long, fan_in int, fan_out int, fan_in_dynamic int, fan_out_dynamic int"
    nodes = spark.createDataFrame([(i, f"/{c}.ts#f", f"/{c}.ts", "function", 1, 0, 0, 0, 0) for i, c in enumerate("abc")], kind)
    store = changes.Store(spark, str(tmp_path / "store"))
    store.write(0, nodes=nodes, edges=spark.createDataFrame([], "id long, from_id long, to_id long, edge_type string, call_site_line int, dynamic boolean"))
    raw = spark.createDataFrame([], "from_qname string, to_qname string, edge_type string, dynamic boolean, call_site_line int")
    calls = []

    def parsed(events):
        calls.append(events.count())
        if len(calls) == 1:
            raise RuntimeError
        return nodes.limit(0), raw

    handle = changes.Applier(store, parsed)
    handle(spark.createDataFrame([("DELETE", "/a.ts", "c1", at(1))], changes.CHANGES), 0)
    assert handle.done_commit is None and store.versions() == [0]
    changes.Applier(store, parsed)(spark.createDataFrame([("DELETE", "/b.ts", "c2", at(2))], changes.CHANGES), 1)
    assert calls == [1, 2] and [r.file_path for r in store.read("nodes").collect()] == ["/c.ts"]
    assert changes.Applier(store, parsed).done_commit == "c2" and store.pending() is None


def test_applier_failures_and_repeats(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "/a.ts#f", "/a.ts", "function", 1, 0, 0, 0, 0)], "id long, qualified_name string, file_path string, symbol_type string, version long, fan_in int, fan_out int, fan_in_dynamic int, fan_out_dynamic int")
    edges = spark.createDataFrame([], "id long, from_id long, to_id long, edge_type string, call_site_line int, dynamic boolean")
    raw = spark.createDataFrame([], "from_qname string, to_qname string, edge_type string, dynamic boolean, call_site_line int")
    store = changes.Store(spark, str(tmp_path / "store"))
    store.write(0, nodes=nodes, edges=edges)
    broken = [True]

    def parsed(events):
        if broken[0]:
            raise RuntimeError
        return nodes.limit(0), raw

    synced = []
    handle = changes.Applier(store, parsed, lambda events: synced.append(1) or (nodes, edges))
    batch = spark.createDataFrame([("DELETE", "/a.ts", "c1", at(1))], changes.CHANGES)
    handle(batch, 0)
    assert handle.failures == 1 and store.versions() == [0]
    broken[0] = False
    handle(batch, 1)
    assert synced == [1] and handle.failures == 0 and handle.done_commit == "c1"
    handle(batch, 2)
    assert store.read("nodes").count() == 0 and [w for _, w in handle.log] == ["failed", "full", "events"]
    handle(batch, 2)
    assert len(handle.log) == 3
