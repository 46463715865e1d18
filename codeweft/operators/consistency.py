"""Files on disk against the indexed ones, and their version control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the commit that a live update writes, which is never behind.
LIVE = "watcher-change"


def report(disk: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """(file_path, state) of files that are not as indexed: missing, outdated or orphaned.

    ``disk`` (file_path, checksum, commit_hash), ``indexed`` (file_path, checksum, last_updated_commit). Missing: on disk
    only. Orphaned: indexed only. Outdated: another checksum, or the same but another commit, unless a live update wrote
    it. ``force`` calls every file on disk outdated.
    """
    a = disk.select("file_path", F.col("checksum").alias("_d"), "commit_hash", F.lit(True).alias("_disk"))
    b = indexed.select("file_path", F.col("checksum").alias("_i"), "last_updated_commit", F.lit(True).alias("_indexed"))
    both = a.join(b, "file_path", "full_outer")
    other = ~F.col("_d").eqNullSafe(F.col("_i"))
    behind = (F.coalesce("last_updated_commit", F.lit("")) != LIVE) & ~F.col("last_updated_commit").eqNullSafe(F.col("commit_hash"))
    state = F.when(F.col("_disk").isNull(), "orphaned")
    if force:
        state = state.otherwise("outdated")
    else:
        state = state.when(F.col("_indexed").isNull(), "missing").when(other | behind, "outdated")
    return both.select("file_path", state.alias("state")).filter("state is not null")
