"""Session helpers: building a session, checkpoints, and broadcasts behind a size check."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; the caller counts first.
BROADCAST_ROWS = 2_000_000


def get_spark(app: str = "codeweft", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; without ``master`` the submit settings decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if master and master.startswith("local["):
        b = b.config("spark.driver.memory", "6g")  # of a JVM that is yet to start; the driver does all the work there
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies, whatever folder the driver was started in.

    On a cluster whose machines don't share that folder the package comes with ``--py-files``, as any other.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    The cluster's ``spark.checkpoint.dir`` holds if set. Only a ``local`` master without it gets a temporary folder;
    any other master without it is an error, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = sc.getCheckpointDir()
    if now:
        return now
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeweft-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
