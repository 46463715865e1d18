"""File trees, ignore rules and version-control logs as sources; audit lines, compaction and copies as sinks."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are never indexed, and the largest file.
ALWAYS_IGNORED = (".git", "node_modules")
MOST_BYTES = 500 * 1024
# Fixed value: the highest schema version of another project's tables that is trusted.
MOST_SCHEMA = 1000


def ignore_pattern(rule: str) -> str | None:
    """One ignore rule as a regular expression over paths relative to its directory; null for blank lines and comments."""
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    rule = rule.lstrip("!")
    anchored = "/" in rule.rstrip("/")
    body, only_dir = rule.strip("/"), rule.endswith("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)")


def ignored(path: Column, rules: list[str], always: tuple[str, ...] = ALWAYS_IGNORED) -> Column:
    """Whether a relative path falls under the rules; the last that matches counts, so a later ``!rule`` takes one back."""
    out = path.rlike("(^|/)(" + "|".join(map(re.escape, always)) + ")(/|$)")
    verdict = F.lit(False)
    for rule in rules:
        if (pattern := ignore_pattern(rule)) is not None:
            verdict = F.when(path.rlike(pattern), not rule.strip().startswith("!")).otherwise(verdict)
    return out | verdict


def nested_rules(rules: dict[str, list[str]]) -> list[str]:
    """The rules of ignore files by the directory they lie in ("" is the root) as rules of the root, outer ones first.

    A rule with a slash before its end is anchored to its directory, others hold at any depth below it.
    """
    out = []
    for folder in sorted(rules, key=lambda f: (f.count("/") + (f != ""), f)):
        base = folder.strip("/")
        for rule in rules[folder]:
            rule = rule.strip()
            if not rule or rule.startswith("#") or not base:
                out.append(rule)
                continue
            sign, body = ("!", rule[1:]) if rule.startswith("!") else ("", rule)
            deep = "" if "/" in body.rstrip("/") else "**/"
            out.append(f"{sign}/{base}/{deep}{body.lstrip('/')}")
    return out


def read_rules(spark: SparkSession, root: str, name: str = ".gitignore", excluded: list[str] | None = None) -> list[str]:
    """The rules of all ignore files under a folder, nested ones too, and the excluded patterns of a profile last.

    Ignore files are few and small by nature and their lines come to the driver; they are looked up level by level, because
    file scans pass over names that start with a dot.
    """
    jvm = spark._jvm
    base = root.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    rules: dict[str, list[str]] = {}
    level = ""
    while level == "" or fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + level)):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}{level}/{name}")) or []:
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            folder = status.getPath().getParent().toUri().getPath()
            rules[folder[len(base) :].strip("/")] = text.splitlines()
        level += "/*"
    return nested_rules(rules) + list(excluded or [])


def remote_nodes(spark: SparkSession, path: str, most: int = MOST_SCHEMA) -> DataFrame | None:
    """(id, qualified_name, symbol_name) of another project's nodes table, opened for reading only; None if it isn't to be
    trusted: no such table, no ``qualified_name``, or a schema version (a file property's number beside the table, 0 if
    there is none) out of range. A table without ``symbol_name`` has it from the names."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.version")
        known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        said = spark.read.text(f"{path}.version").first()["value"].strip() if known else "0"
    except AnalysisException:
        return None
    kinds = dict(df.dtypes)
    if not said.isdigit() or int(said) > most or kinds.get("qualified_name") != "string" or kinds.get("id") not in ("bigint", "int"):
        return None
    name = F.col("symbol_name") if "symbol_name" in kinds else F.substring_index("qualified_name", "#", -1)
    return df.select(F.col("id").cast("long").alias("id"), "qualified_name", name.alias("symbol_name"))


def restore(spark: SparkSession, copy: str, path: str) -> None:
    """Puts a table folder back from its copy; the folder is replaced."""
    spark.read.parquet(copy).write.mode("overwrite").parquet(path)


def tree(spark: SparkSession, root: str, rules: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(path, text, length) of the files under a folder that rules and size let through; texts are decoded as UTF-8.

    Only names are listed before the filter; contents of files that it drops are not read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")
    kept = raw.filter((F.col("length") <= most) & ~ignored(relative, rules or []))
    return kept.select(path.alias("path"), F.decode("content", "utf-8").alias("text"), "length")


def _git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout


def commit_log(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, commit_hash, message, author, ts) of each file in each commit of a working copy, the newest first.

    The log is one command's output on the driver; for histories beyond its memory, write it to files and use ``parse_log``.
    """
    text = _git(folder, "log", "--name-only", "--date=iso-strict", "--pretty=format:%x01%H%x02%s%x02%an%x02%ad", *extra)
    return parse_log(spark.createDataFrame([(x,) for x in text.split("\x01") if x], "value string"))


def parse_log(entries: DataFrame) -> DataFrame:
    """The same of log entries (value): fields parted by \\x02, then one path a line."""
    head = F.split(F.substring_index("value", "\n", 1), "\x02")
    at = lambda i: F.try_element_at(head, F.lit(i))
    rows = entries.select(at(1).alias("commit_hash"), at(2).alias("message"), at(3).alias("author"), F.try_to_timestamp(at(4)).alias("ts"), F.explode(F.slice(F.split("value", "\n"), 2, 1 << 30)).alias("file_path"))
    return rows.filter("file_path <> ''").select("file_path", "commit_hash", "message", "author", "ts")


def diff(spark: SparkSession, folder: str, old: str, new: str) -> DataFrame:
    """(status, old_path, path, commit_hash) between two commits, as ``history.diff_events`` takes it."""
    parts, rows, i = _git(folder, "diff", "--name-status", "-z", old, new).split("\0"), [], 0
    while i + 1 < len(parts):
        status = parts[i]
        n = 2 if status[:1] in "RC" else 1
        rows.append((status, parts[i + 1], parts[i + n], new))
        i += 1 + n
    return spark.createDataFrame(rows, "status string, old_path string, path string, commit_hash string")


def tracked(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _git(folder, "ls-files", "-z").split("\0") if x], "file_path string")


def head(folder: str) -> str:
    return _git(folder, "rev-parse", "HEAD").strip()


def sync_mode(folder: str, last: str | None) -> str:
    """full without a last commit or where it is unknown, none if nothing is new, else incremental."""
    if not last:
        return "full"
    if subprocess.run(["git", "-C", folder, "cat-file", "-e", f"{last}^{{commit}}"], capture_output=True).returncode:
        return "full"
    return "none" if head(folder) == last else "incremental"


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows as JSON lines with the time of writing."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def compact(spark: SparkSession, path: str, out: str, bytes_per_file: int = 128 << 20) -> None:
    """A Parquet folder rewritten to files of about the given size; small files are packed by the scan, nothing shuffles."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_per_file))
    try:
        spark.read.parquet(path).write.mode("overwrite").parquet(out)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def backup(spark: SparkSession, path: str, out: str) -> None:
    """A copy of a table folder; an existing copy is an error."""
    spark.read.parquet(path).write.mode("error").parquet(out)


def purge(spark: SparkSession, path: str) -> bool:
    """Removes a table folder; false if there was none."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
