"""Queries of the operators on text and code over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.names import folded
from codeweft.llm import cooccurrence, docpairs, packing, provenance, quality, tokenize
from codeweft.plans.general import path_sql
from codeweft.session import cut
from codeweft.sources.tables import current, table

CAPACITY = 4096


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_tags", "node_id", "tag")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(tag_a, tag_b): pairs on at least 5 nodes and 0.3 % of them, at least twice as often as by chance."""
    pairs = cooccurrence.cooccurrence(_tags(spark, d), "node_id", folded("tag"), min_count=5, min_share=(3, 1000))
    often = F.col("n_ab") * F.col("n") >= 2 * F.col("n_a") * F.col("n_b")
    return pairs.filter(often).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(tag_a, tag_b, n_a, n_b, n_ab, lift, pmi) of every pair that shares a node."""
    pairs = cooccurrence.cooccurrence(_tags(spark, d), "node_id", folded("tag"))
    return pairs.select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(node_id) of current functions and methods with a signature and documentation that says something."""
    return _documented(spark, d).select(F.col("id").alias("node_id"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, signature, docstring) of the same nodes."""
    return _documented(spark, d).withColumnRenamed("id", "node_id")


def _documented(spark: SparkSession, d: str) -> DataFrame:
    kind = folded("symbol_type").isin("function", "method")
    names = ("symbol_name", "signature", "docstring")
    own = table(spark, d, "nodes", "id", "version", "symbol_type", *names).select(
        "id", "version", kind.alias("own"), *[F.when(kind, F.col(c)).alias(c) for c in names]
    )
    return docpairs.documented(current(own, "own", *names).filter("own"))


def p2_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, place, name, signature, docstring) of the documented functions in all documents' texts."""
    return docpairs.source_pairs(table(spark, d, "documents", "doc_id", "text", "path"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes", "id", "version", "symbol_type", "file_path", "qualified_name", "checksum", "docstring", "is_generated", "loc", "cyclomatic")
    return provenance.labelled(nodes, table(spark, d, "known_packages", "checksum"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(node_id) of files not written by hand in this project."""
    return _labels(spark, d).filter("label <> 'handwritten'").select("node_id")


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, label, probability) of every file."""
    return _labels(spark, d).select("node_id", "label", F.round("probability", 4).alias("probability"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) by the byte-level vocabulary, without special tokens."""
    return tokenize.encode(table(spark, d, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding a document's ids gives its text back; null and empty texts give an empty text."""
    docs = table(spark, d, "documents", "doc_id", "text")
    back = tokenize.decode(tokenize.encode(docs, ("doc_id", "text")).select(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("doc_id"), "ids"))
    return back.select("doc_id.doc_id", (F.col("doc_id.text") == F.col("text")).alias("same"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of all documents in containers of 4,096 tokens."""
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text", "source"), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """(containers, pieces, n_tokens, fill): how full the containers are."""
    used = p8_containers(spark, d).groupBy("container").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"))
    fill = F.round(F.sum("n") / (F.count("*") * CAPACITY), 6)
    return used.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("n").alias("n_tokens"), fill.alias("fill"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """(documents, over_capacity, split_small, gaps, copies_together): what must hold of any packing, counted.

    Containers above the capacity, documents split though they fit, documents whose pieces don't make them up, and
    containers with two pieces of texts equal but for case and white space, of clusters below a quarter of the containers.
    """
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    placed = cut(packing.pack_documents(docs, CAPACITY))
    whole = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"))
    used = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    split = whole.agg(
        F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("split_small"), F.count_if(F.col("last") + 1 != F.col("pieces")).alias("gaps")
    )
    over = used.agg(F.count_if(F.col("n") > CAPACITY).alias("over_capacity"), F.count("*").alias("containers"))
    same = docs.filter("text is not null").select("doc_id", F.xxhash64(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))).alias("cluster"), F.trim("text").alias("t")).filter("t <> ''")
    many = same.groupBy("cluster").agg(F.count("*").alias("copies")).crossJoin(over.select("containers")).filter("copies > 1 and 4 * copies <= containers")  # one row
    met = placed.filter("n_tokens > 0").join(same.join(many, "cluster", "left_semi").select("doc_id", "cluster"), "doc_id").groupBy("container", "cluster").agg(F.countDistinct("doc_id").alias("n"))
    together = met.agg(F.count_if(F.col("n") > 1).alias("copies_together"))
    return split.crossJoin(over.drop("containers")).crossJoin(together)  # one row each


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return quality.outlier_scores(quality.document_statistics(docs, table(spark, d, "common_words", "lang", "word")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of documents that running sentences make up most of: those that lie out less among prose than among the rest."""
    return _scores(spark, d).filter(quality.natural()).select("doc_id")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, its places in its language, and its outlier scores."""
    scores = _scores(spark, d)
    grid = [(F.col(s) / g).alias(s) for s, g in quality.STATISTICS.items()]
    return scores.select("doc_id", "lang_found", "n_words", *grid, *[F.round(f"low_{s}", 6).alias(f"low_{s}") for s in quality.STATISTICS], "outlier_score", "other_score")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pairs, p2_found, p2_pairs, p2_source_pairs, p4_found, p4_labels, p7_ids, p7_round_trip, p8_containers, p8_fill, p8_checks, p9_found, p9_statistics,
    )
}

_COUNTS = r"""t as (select distinct node_id, lower(regexp_replace(tag, '^\s+|\s+$', '', 'g')) tag from node_tags
    where node_id is not null and regexp_replace(tag, '\s', '', 'g') <> ''),
  c as (select tag, count(*) n from t group by tag), total as (select count(distinct node_id) n from node_tags),
  p as (select a.tag tag_a, b.tag tag_b, count(*) n_ab from t a join t b on a.node_id = b.node_id and a.tag < b.tag group by all),
  q as (select p.*, ca.n n_a, cb.n n_b, total.n from p join c ca on ca.tag = tag_a join c cb on cb.tag = tag_b cross join total)"""


def _matches(value: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({value}, '{pattern.replace(chr(39), chr(39) * 2)}'), false)"


# Bare evidence, names of directories included: on tables without middling evidence the beliefs come to the same rows.
_EVIDENCE = " or ".join(
    [
        "coalesce(is_generated, false)",
        _matches("base", provenance.GENERATED_NAMES),
        _matches("'/' || dir", provenance.BUILD_DIRS),
        _matches("regexp_replace(docstring, '</?summary>', '', 'g')", provenance.GENERATED_DOCS),
        _matches("base", provenance.MINIFIED_NAMES),
        "coalesce(code and loc > 0 and cyclomatic > 5.0 * loc and cyclomatic > 20, false)",
        _matches("dir", provenance.vendor_pattern()),
        "coalesce(checksum <> '' and checksum in (select checksum from known_packages where checksum is not null), false)",
        "coalesce(code and loc >= 2000 and coalesce(cyclomatic, 0) <= 1, false)",
    ]
)
SQL = {
    "p7_round_trip": "select doc_id, true same from documents",
    "p8_checks": "select count(*) documents, 0::bigint over_capacity, 0::bigint split_small, 0::bigint gaps, 0::bigint copies_together from documents",
    "p4_found": rf"""with f as (select *, coalesce({path_sql("file_path")}, {path_sql("qualified_name")}, '') path from (select distinct on (id) * from nodes where id is not null order by id, version desc nulls last)
        where lower(trim(symbol_type)) = 'file'),
      g as (select *, regexp_replace(path, '/?[^/]*$', '') dir, regexp_extract(path, '[^/]*$', 0) base from f), h as (select *, regexp_extract(base, '([^.]*)$', 1) not in {provenance.DATA_LANGUAGES} code from g)
      select id node_id from h where {_EVIDENCE}""",
    "p1_found": f"with {_COUNTS} select tag_a, tag_b from q where n_ab >= 5 and 1000 * n_ab >= 3 * n and n_ab * n >= 2 * n_a * n_b",
    "p1_pairs": f"""with {_COUNTS} select tag_a, tag_b, n_a, n_b, n_ab, round(n_ab * cast(n as double) / (cast(n_a as double) * n_b), 6) lift,
      round(log2(n_ab * cast(n as double) / (cast(n_a as double) * n_b)), 6) pmi from q""",
}
