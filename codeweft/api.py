"""The engine's tools: one function each, over the tables of a graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import (
    consistency, cycles, deadcode, degree, export, history, indexing, ingest, lookup, overview, policies, risk, roles, rules, search, traverse, vectors,
)
from codeweft.schema import METRICS
from codeweft.sources import files
from codeweft.sources.tables import clean_edges, current_nodes, nodes_of, nodes_where, table


@dataclass
class Graph:
    """The tables in a folder; nodes are current rows, edges distinct ones."""

    spark: SparkSession
    folder: str

    @cached_property
    def nodes(self) -> DataFrame:
        names = [c for c in table(self.spark, self.folder, "nodes").columns if c not in ("id", "version")]
        return current_nodes(self.spark, self.folder, *names, "version")

    def columns(self, *names: str) -> DataFrame:
        """Current rows with some columns: only these are read and shuffled."""
        return current_nodes(self.spark, self.folder, *names)

    def find(self, column: str, value: str, *names: str) -> DataFrame:
        """Current rows by the value of a column, which reaches the scan."""
        return nodes_where(self.spark, self.folder, F.col(column) == value, *dict.fromkeys([column, *names]))

    @cached_property
    def edges(self) -> DataFrame:
        return clean_edges(self.spark, self.folder)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def start(self, name: str) -> DataFrame:
        return self.find("qualified_name", name).select("id")

    def _id(self, name: str) -> int:
        row = self.start(name).first()
        if row is None:
            raise KeyError(f"no symbol: {name}")
        return row["id"]

    # Tools -------------------------------------------------------------------------------------------------------------

    def get_project_overview(self) -> dict[str, DataFrame]:
        n = self.columns("qualified_name", "symbol_type", "language", "tags", "fan_in", "fan_out", "loc", "cyclomatic", "file_path", "start_line")
        return {
            "counts": overview.counts(n, self.edges), "languages": overview.languages(n), "layers": overview.layers(n), "hotspots": overview.overview_hotspots(n),
            "entry_points": overview.entry_points(n), "clusters": overview.clusters_by_name(self.table("logical_clusters")), "sections": overview.sections(n),
        }

    def initialize_project(self, root: str, commit: str = "", version: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, specs) of the files under a folder, its ignore files heeded."""
        return indexing.index(files.tree(self.spark, root, files.read_rules(self.spark, root)), commit, version)

    def search_symbols(self, query: str, limit: int = 10, vector_hits: DataFrame | None = None) -> DataFrame:
        """Keyword hits, or fused with near vectors (id, place); a query with signs that no word has falls back to substrings."""
        limit = max(1, min(200, int(limit or 10)))
        if any(c in query for c in ".#/()-%") and vector_hits is None:
            return search.positional(search.like(self.nodes, query, limit), [F.length("qualified_name"), F.col("qualified_name"), F.col("id")])
        return search.hybrid(self.nodes, query, vector_hits, limit)

    def search_projects(self, graphs: list[Graph], query: str, limit: int = 10) -> DataFrame:
        """Hits of several graphs one after the other, in the order of the graphs, cut at the limit."""
        rows = None
        for i, g in enumerate([self, *graphs]):
            own = g.search_symbols(query, limit).withColumn("project", F.lit(i))
            rows = own if rows is None else rows.unionByName(own)
        return rows.orderBy("project", F.desc("score"), "id").limit(limit)

    def find_similar_symbols(self, vec_id: int, limit: int = 10) -> DataFrame:
        vecs = self.table("embeddings")
        return vectors.similar(vecs.filter(F.col("vec_id") == vec_id), vecs, limit)

    def get_symbol_details(self, name: str, summary: bool = False) -> DataFrame:
        """One row: fields, metrics, commits, the newest annotations, and the titles and assertions of its tests."""
        names = ("symbol_type", "file_path", "signature", "docstring", "tags", "visibility", "start_line", "end_line", "loc", "cyclomatic", "fan_in", "fan_out", "history")
        return lookup.details(self.find("qualified_name", name, *names), self.table("annotations"), self.table("test_specs"), name, summary)

    def analyze_impact(self, name: str, max_depth: int = 5) -> DataFrame:
        return traverse.impact(self.columns("qualified_name"), self.edges, self.start(name), min(max_depth, 20))

    def get_callers(self, name: str) -> DataFrame:
        return self._near(name, "to_id", "from_id")

    def get_callees(self, name: str) -> DataFrame:
        return self._near(name, "from_id", "to_id")

    def _near(self, name: str, own: str, other: str) -> DataFrame:
        i = self._id(name)
        near = clean_edges(self.spark, self.folder, "from_id", "to_id", "edge_type", "call_site_line", where=F.col(own) == i)
        return lookup.neighbours(nodes_of(self.spark, self.folder, near.select(F.col(other).alias("id")), "qualified_name"), near, i, own == "to_id")

    def get_related_tests(self, name: str) -> DataFrame:
        """Tests of the symbol and of its file, by edges, and the titles of specs that name it."""
        own = self.find("qualified_name", name, "qualified_name").select(F.col("id").alias("target"), "qualified_name")
        return lookup.related_tests(own, self.columns("qualified_name", "symbol_type"), self.edges, self.table("test_specs")).select("test").distinct()

    def check_architecture_violations(self, own_rules: list[dict] | None = None) -> DataFrame:
        return rules.violations(self.nodes, self.edges, own_rules)

    def get_remediation_strategy(self, violations: DataFrame) -> DataFrame:
        return risk.remedies(violations, self.nodes)

    def propose_refactor(self, name: str) -> DataFrame:
        return risk.proposals(self.nodes, self.edges, self.start(name))

    def get_risk_profile(self, name: str) -> DataFrame:
        return risk.profiles(lookup.by_qualified_name(self.find("qualified_name", name, "symbol_type", "file_path", "cyclomatic", "fan_in", "fan_out", "loc", "history", "tags", "visibility"), name))

    def get_hotspots(self, metric: str, threshold: int = 0, limit: int = 20) -> DataFrame:
        return overview.hotspots(self.columns("qualified_name", "symbol_type", "file_path", "language", *METRICS) if metric in METRICS else self.nodes, metric, limit, threshold)

    def find_dead_code(self) -> tuple[DataFrame, DataFrame]:
        return deadcode.candidates(self.nodes, self.edges), deadcode.summary(self.nodes, self.edges)

    def export_graph(self, root: str | None = None, kind: str = "json", max_depth: int = 2) -> DataFrame:
        """Lines of the export; ``json`` is one line with the counts and the flowchart."""
        makers = {"json": export.as_json, "mermaid": export.mermaid, "graphml": export.graphml, "dot": export.dot}
        if kind not in makers:
            raise ValueError(f"no export: {kind}; there are {', '.join(makers)}")
        return makers[kind](*traverse.subgraph(self.nodes, self.edges, self.start(root) if root else None, max_depth))

    def check_consistency(self, disk: DataFrame, force: bool = False) -> DataFrame:
        return consistency.report(disk, self.nodes.filter("symbol_type = 'file'"), force)

    def purge_index(self) -> bool:
        return files.purge(self.spark, self.folder)

    def re_tag_project(self) -> DataFrame:
        return roles.retagged(self.nodes, self.edges)

    def backfill_history(self, log: DataFrame) -> DataFrame:
        """Nodes with the newest commits of their file; a log with message and author gives these too."""
        return history.backfilled(self.nodes, history.file_commits(log))

    def discover_latent_policies(self, threshold: float = 0.9, min_count: int = 5) -> DataFrame:
        return policies.latent_policies(self.nodes, self.edges, threshold, min_count)

    def get_recent_changes(self, limit: int = 20, since: str | None = None) -> DataFrame:
        return history.recent_changes(self.columns("qualified_name", "history"), limit, since)

    def get_symbol_history(self, name: str) -> DataFrame:
        return history.symbol_history(self.find("qualified_name", name, "history"))

    def add_annotation(self, name: str, kind: str, body: str, author: str = "", out: str | None = None) -> DataFrame:
        """A new annotation row of an existing symbol, appended to ``out`` if given. Its id is a hash of its content and time,
        its commit the symbol's last one."""
        if kind not in ("decision", "gotcha", "todo", "rationale"):
            raise ValueError(f"no kind of annotation: {kind}")
        node = self.find("qualified_name", name, "last_updated_commit").first()
        if node is None:
            raise KeyError(f"no symbol: {name}")
        row = self.spark.range(1).select(
            F.xxhash64(F.lit(name), F.lit(kind), F.lit(body), F.lit(author), F.unix_timestamp()).alias("id"), F.lit(node["last_updated_commit"]).cast("string").alias("commit_hash"),
            F.lit(name).alias("node_qname"), F.lit(kind).alias("kind"), F.lit(body).alias("body"), F.lit(author).alias("author"), F.unix_timestamp().alias("created_at")
        )
        if out:
            row.write.mode("append").parquet(out)
        return row

    def get_annotations(self, name: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
        return history.annotations(self.table("annotations"), name, kind, limit)

    def get_architecture(self, intent: dict) -> dict[str, DataFrame]:
        return rules.drift(self.nodes, self.edges, intent)

    # Resources ---------------------------------------------------------------------------------------------------------

    def ledger(self) -> DataFrame:
        return degree.ledger(self.nodes, self.edges)

    def clusters(self) -> DataFrame:
        return overview.cluster_sizes(self.nodes, self.table("logical_clusters"))

    def cycles(self) -> DataFrame:
        return cycles.components(cycles.dependency_links(self.edges))

    def apply_changes(self, events: DataFrame, new_nodes: DataFrame, raw_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        return ingest.applied(self.nodes, self.edges, events, new_nodes, raw_edges)


def read(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark, folder)
