"""A project's files as graph rows: nodes, edges and test specs in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import canonical, symbol_name
from codeweft.operators import ingest
from codeweft.operators.degree import reconciled
from codeweft.sources import code, parsers

_FANS = ("fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic")


def _named(path: str, name: str):
    return F.concat(F.col(path), F.lit("#"), F.col(name))


def parsed(files: DataFrame, commit: str = "", version: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes without ids, raw edges, specs) of files (path, text).

    Every file is a node; its symbols, Markdown sections and JSON keys are nodes named ``path#name`` that it contains or
    defines. A name that is defined twice in a file is one node, the first. Null paths are no files.
    """
    files = files.filter("path is not null").select(canonical("path").alias("path"), "text")
    none = lambda kind: F.lit(None).cast(kind)
    own = parsers.file_nodes(files, commit).select(
        "qualified_name", "symbol_type", "language", F.col("path").alias("file_path"), "start_line", "end_line", "loc", "checksum", none("string").alias("signature"),
        F.lit("public").alias("visibility"), none("int").alias("cyclomatic"), none("string").alias("docstring"),
    )
    found = code.symbols(files)
    lines = F.col("end_line") - F.col("start_line") + 1
    symbols = found.select(
        _named("path", "name").alias("qualified_name"), "symbol_type", parsers.language("path").alias("language"), F.col("path").alias("file_path"), "start_line", "end_line", lines.alias("loc"),
        none("string").alias("checksum"), "signature", "visibility", "cyclomatic", "docstring",
    )
    sections = parsers.markdown_sections(files.filter(parsers.extension("path") == "md")).select(
        _named("path", "slug").alias("qualified_name"), F.lit("section").alias("symbol_type"), F.lit("markdown").alias("language"), F.col("path").alias("file_path"), "start_line", "end_line", lines.alias("loc"),
        none("string").alias("checksum"), F.col("title").alias("signature"), F.lit("public").alias("visibility"), none("int").alias("cyclomatic"), "docstring",
    )
    keys = parsers.json_keys(files.filter(parsers.extension("path") == "json")).select(
        _named("path", "config_key").alias("qualified_name"), F.lit("config_key").alias("symbol_type"), F.lit("json").alias("language"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.lit(1).alias("loc"), none("string").alias("checksum"), none("string").alias("signature"), F.lit("public").alias("visibility"), none("int").alias("cyclomatic"), none("string").alias("docstring"),
    )
    every = own.unionByName(symbols).unionByName(sections).unionByName(keys)
    rest = [c for c in every.columns if c != "qualified_name"]
    nodes = every.groupBy("qualified_name").agg(F.min_by(F.struct(*rest), F.struct("start_line", "end_line")).alias("x")).select("qualified_name", "x.*")
    nodes = nodes.withColumns({"symbol_name": symbol_name("qualified_name"), "version": F.lit(version).cast("long"), "last_updated_commit": F.lit(commit), **{c: F.lit(0) for c in _FANS}})
    said = code.relations(files)
    # A name that the file itself defines is meant before any other.
    known = found.select("path", F.col("name").alias("to_name"), F.lit(True).alias("_own")).distinct()
    said = said.join(known, ["path", "to_name"], "left")
    raw = said.select(
        F.when(F.coalesce("from_name", F.lit("")) == "", F.col("path")).otherwise(_named("path", "from_name")).alias("from_qname"),
        F.when(F.col("_own"), _named("path", "to_name")).otherwise(F.col("to_name")).alias("to_qname"), "edge_type", "dynamic", "call_site_line",
    )
    within = sections.select("file_path", "qualified_name").unionByName(keys.select("file_path", "qualified_name"))
    plain = lambda df, a, b, kind: df.select(F.col(a).alias("from_qname"), F.col(b).alias("to_qname"), kind.alias("edge_type"), F.lit(False).alias("dynamic"), none("int").alias("call_site_line"))
    raw = raw.unionByName(plain(within, "file_path", "qualified_name", F.lit("contains"))).unionByName(plain(parsers.imports(files), "path", "target", F.col("edge_type")))
    specs = code.specs(files).select(_named("path", "name").alias("test_qname"), "title", none("string").alias("target_qname"), "assertions", F.col("path").alias("file_path"), "start_line")
    tested = parsers.production_files(files).select(F.col("path").alias("file_path"), F.col("production").alias("_target"))
    specs = specs.join(tested, "file_path", "left").withColumn("target_qname", F.coalesce("target_qname", "_target")).drop("_target")
    return nodes, raw, specs


def index(files: DataFrame, commit: str = "", version: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, specs) of a project's files (path, text), names resolved and degrees counted.

    Ids are hashes of names, so that indexing twice agrees. Edges with an end that nothing names are dropped; a test file
    has a tests edge to the file that it tests, as far as names tell.
    """
    nodes, raw, specs = parsed(files, commit, version)
    nodes = nodes.withColumn("id", F.xxhash64("qualified_name"))
    tests = specs.filter("target_qname is not null").select(F.col("file_path").alias("from_qname"), F.col("target_qname").alias("to_qname"), F.lit("tests").alias("edge_type"), F.lit(False).alias("dynamic"), F.lit(None).cast("int").alias("call_site_line")).distinct()
    edges = ingest.counted_edges(ingest.resolved(raw.unionByName(tests), nodes))
    return reconciled(nodes, edges), edges, specs
