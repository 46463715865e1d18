"""Commits of symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.orphans import epoch


def commit_time(date: Column) -> Column:
    """An ISO date as a timestamp, null if it can't be read."""
    return F.try_to_timestamp(date)


def recent_changes(nodes: DataFrame, limit: int = 20, since: str | None = None) -> DataFrame:
    """(hash, message, author, date, n_symbols, symbols) of the newest commits over all symbols' histories.

    A commit older than ``since`` (a timestamp) is left out; one whose date can't be read is kept and sorts last. Where
    symbols disagree on a commit, the one of the lowest id tells it. ``symbols`` has every name once and in order,
    so a row is as long as its commit is wide; ``n_symbols`` counts the nodes. ``limit`` is clamped to 1..50.
    """
    limit = max(1, min(50, int(limit)))
    own = nodes.select("id", "qualified_name", F.explode("history").alias("c")).filter("c.hash is not null")
    at = commit_time(F.col("c.date"))
    if since is not None:
        own = own.filter(F.coalesce(at >= F.lit(since).cast("timestamp"), F.lit(True)))
    first = own.groupBy("c.hash").agg(F.min_by("c", "id").alias("c"), F.count("*").alias("n_symbols"))
    top = first.orderBy(F.desc_nulls_last(commit_time(F.col("c.date"))), "hash").limit(limit)
    named = own.select("c.hash", "qualified_name").join(F.broadcast(top.select("hash")), "hash")  # at most 50 rows
    names = named.distinct().groupBy("hash").agg(F.array_sort(F.collect_list("qualified_name")).alias("symbols"))
    return top.join(names, "hash").select("hash", "c.message", "c.author", "c.date", "n_symbols", "symbols")


def symbol_history(nodes: DataFrame) -> DataFrame:
    """(id, qualified_name, place, short_hash, message, author, date) of each commit of each node, the newest first as stored."""
    own = nodes.select("id", "qualified_name", F.posexplode("history").alias("place", "c"))
    return own.select("id", "qualified_name", "place", F.substring("c.hash", 1, 7).alias("short_hash"), "c.message", "c.author", "c.date")


def latest_commits(log: DataFrame) -> DataFrame:
    """(file_path, commit_hash) of the newest entry of each file in a log (file_path, commit_hash, ts), ties by the higher hash."""
    return log.groupBy("file_path").agg(F.max_by("commit_hash", F.struct("ts", "commit_hash")).alias("commit_hash"))


def file_histories(log: DataFrame, limit: int = 5) -> DataFrame:
    """(file_path, history): the newest ``limit`` distinct commits of each file, the newest first.

    Entries beyond the limit are cut per task before files are gathered, so a file of very many commits stays small.
    """
    newest = Window.partitionBy("file_path").orderBy(F.desc("ts"), F.desc("commit_hash"))
    own = log.groupBy("file_path", "commit_hash").agg(F.max("ts").alias("ts"))
    top = own.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    rows = F.sort_array(F.collect_list(F.struct("ts", "commit_hash")), asc=False)
    return top.groupBy("file_path").agg(F.transform(rows, lambda x: x["commit_hash"]).alias("history"))


def file_commits(log: DataFrame, limit: int = 5) -> DataFrame:
    """(file_path, history): the newest commits of each file as (hash, message, author, date), the newest first.

    ``message`` and ``author`` are null where the log hasn't these columns; the date is the entry's time in ISO form.
    """
    text = lambda c: F.col(c) if c in log.columns else F.lit(None).cast("string")
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    own = log.select("file_path", "ts", "commit_hash", F.struct(F.col("commit_hash").alias("hash"), text("message").alias("message"), text("author").alias("author"), date.alias("date")).alias("c"))
    own = own.groupBy("file_path", "commit_hash").agg(F.max_by("c", "ts").alias("c"), F.max("ts").alias("ts"))
    newest = Window.partitionBy("file_path").orderBy(F.desc("ts"), F.desc("commit_hash"))
    top = own.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("_n", "c")))
    return top.groupBy("file_path").agg(F.transform(rows, lambda x: x["c"]).alias("history"))


def backfilled(nodes: DataFrame, histories: DataFrame) -> DataFrame:
    """Nodes with the history of their file, their own where the file has none."""
    own = histories.select("file_path", F.col("history").alias("_history"))
    return nodes.join(own, "file_path", "left").withColumn("history", F.coalesce("_history", "history")).drop("_history")


def diff_events(diff: DataFrame) -> DataFrame:
    """(event, file_path, commit_hash) of diff rows (status, old_path, path, commit_hash).

    A adds, D deletes, R deletes the old path and adds the new one, C adds, anything else modifies.
    """
    kind = F.upper(F.substring("status", 1, 1))
    one = lambda event, path: F.struct(F.lit(event).alias("event"), F.col(path).alias("file_path"))
    events = (
        F.when(kind == "A", F.array(one("ADD", "path")))
        .when(kind == "D", F.array(one("DELETE", "path")))
        .when(kind == "R", F.array(one("DELETE", "old_path"), one("ADD", "path")))
        .when(kind == "C", F.array(one("ADD", "path")))
        .otherwise(F.array(one("MODIFY", "path")))
    )
    return diff.select(F.inline(events), "commit_hash").select("event", "file_path", "commit_hash")


def annotations(notes: DataFrame, name: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The newest annotations, of a symbol or a kind if given; ``limit`` is clamped to 1..100.

    Stamps in milliseconds count as the seconds they stand for and come out as such; null stamps sort last.
    """
    if name:
        notes = notes.filter(F.col("node_qname") == name)
    if kind:
        notes = notes.filter(F.col("kind") == kind)
    at = epoch(F.col("created_at"))
    rows = notes.select("id", "node_qname", "kind", "body", "author", F.unix_seconds(at).alias("created_at"), F.date_format(at, "yyyy-MM-dd").alias("day"), "commit_hash", at.alias("_at"))
    return rows.orderBy(F.desc_nulls_last("_at"), "id").limit(max(1, min(100, int(limit)))).drop("_at")
