"""Queries of the parsers and the change stream over the whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.text import line_count
from codeweft.operators import vectors
from codeweft.plans.general import name_sql
from codeweft.plans.graph import N
from codeweft.session import checkpoint_dir
from codeweft.sources import code, parsers
from codeweft.sources.tables import table
from codeweft.streaming import changes


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "path", "text")


def checksums(spark, d):
    """(doc_id, checksum, lines) of every text; null texts have null ones."""
    return _files(spark, d).select("doc_id", F.sha1(F.encode("text", "utf-8")).alias("checksum"), F.when(F.col("text").isNotNull(), line_count(F.col("text"))).alias("lines"))


def parser_routes(spark, d):
    """Documents of each parser and language by their path."""
    return _files(spark, d).groupBy(parsers.route("path").alias("parser"), parsers.language("path").alias("language")).agg(F.count("*").alias("n"))


def md_sections(spark, d):
    """Sections of every text, whatever its extension."""
    return parsers.markdown_sections(_files(spark, d), "doc_id")


def json_keys(spark, d):
    """(event_id, config_key) of the JSON properties of every event."""
    return parsers.json_keys(table(spark, d, "events", "event_id", F.col("props").alias("text")), "event_id")


def deps_parse(spark, d):
    """Every text read as a list of requirements."""
    own = _files(spark, d).select(F.concat("doc_id", F.lit("/requirements.txt")).alias("path"), "text")
    return parsers.dependencies(own).groupBy("package", "version").agg(F.count("*").alias("n"))


def docstrings_clean(spark, d):
    """(id, docstring) of every node without comment marks."""
    return N(spark, d, "docstring").select("id", parsers.clean_docstring(F.col("docstring")).alias("docstring"))


def import_edges(spark, d):
    return parsers.imports(_files(spark, d).select("path", "text").filter("path is not null"))


def code_symbols(spark, d):
    return code.symbols(_files(spark, d))


def code_relations(spark, d):
    return code.relations(_files(spark, d))


def code_specs(spark, d):
    return code.specs(_files(spark, d))


def embedded_symbols(spark, d):
    """(id, embedding) of every current node by the offline provider."""
    own = N(spark, d, "qualified_name", "symbol_type", "signature", "file_path", "docstring")
    return vectors.embedded(own.select("id", vectors.snippet().alias("text")))


def stream_cdc(spark, d):
    """The last event of each file, kept up by a stream over the change events."""
    schema = table(spark, d, "change_events").schema
    stream = changes.read_changes(spark, f"{d}/change_events.parquet*", schema, files_per_batch=4)
    return changes.last_events(stream.filter("file_path is not null"), f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}")


def change_bursts(spark, d):
    """Runs of change events with less than a second between them."""
    own = changes.normalised(table(spark, d, "change_events", "event", "file_path", "commit_hash", "ts")).distinct()
    return changes.bursts(own).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


QUERIES = {
    f.__name__: f
    for f in (
        checksums, parser_routes, md_sections, json_keys, deps_parse, docstrings_clean, import_edges, code_symbols, code_relations, code_specs, embedded_symbols, stream_cdc, change_bursts,
    )
}
_EXT = r"regexp_extract(lower(path), '\.([^./\\]+)$', 1)"
_LANG = "case " + " ".join(f"when {_EXT} in ({', '.join(map(repr, x))}) then '{k}'" for k, x in parsers.EXTENSIONS.items()) + " end"
SQL = {
    "parser_routes": f"""select case when {_EXT} in ('ts', 'js') then 'semantic' when {_LANG} is not null then 'generic' when regexp_matches(lower(path), '(^|/)(package\\.json|requirements\\.txt)$') then 'dependencies'
      when {_EXT} in ('yml', 'yaml') then 'yaml' when {_EXT} = 'md' then 'markdown' when {_EXT} = 'json' then 'json' end parser, {_LANG} "language", count(*) n from documents group by all""",
    "json_keys": "select event_id, unnest(json_keys(props)) config_key from events",
    "docstrings_clean": r"""with c as (select distinct on (id) id, docstring from nodes where id is not null order by id, version desc nulls last)
      select id, nullif(trim(regexp_replace(docstring, '(?m)^/\*\*?|\*/$|^///?|^#+\s?|^\s*\*\s?', '', 'g'), ' '), '') docstring from c""",
    "checksums": "select doc_id, sha1(text) checksum, cast(len(string_split(text, chr(10))) as integer) lines from documents",
    "md_sections": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) pos from documents where regexp_matches(text, '(?m)^##?\s')),
      m as (select *, sum(case when regexp_matches(line, '^##?\s') then 1 else 0 end) over (partition by doc_id order by pos) part from l),
      g as (select doc_id, part, max(case when regexp_full_match(line, '##?\s+.+') then trim(regexp_extract(line, '^##?\s+(.+)$', 1), ' ') end) title, min(pos) a, max(pos) b,
        string_agg(case when not regexp_matches(line, '^##?\s') then line end, chr(10) order by pos) body from m where part > 0 group by all)
      select doc_id, cast(part as integer) number, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug, cast(a + 1 as integer) start_line, cast(b + 1 as integer) end_line,
        nullif(substr(regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g'), 1, 2000), '') docstring from g where title is not null""",
    "deps_parse": r"""with l as (select trim(regexp_replace(unnest(string_split(text, chr(10))), '\r$', ''), ' ') line from documents)
      select 'pypi:' || regexp_extract(line, '^([a-zA-Z0-9_\-]+)', 1) package, coalesce(nullif(regexp_extract(line, '[=<>!~]+(.+)$', 1), ''), 'latest') "version", count(*) n from l
      where line <> '' and not starts_with(line, '#') and regexp_extract(line, '^([a-zA-Z0-9_\-]+)', 1) <> '' group by all""",
    "stream_cdc": f"""with log as (select distinct {name_sql("file_path")} file_path, commit_hash, ts, upper(trim(event)) event from change_events where file_path is not null)
      select distinct on (file_path) file_path, event, commit_hash, ts from log order by file_path, ts desc, (event = 'DELETE') desc, commit_hash desc, event desc""",
    "change_bursts": f"""with log as (select distinct {name_sql("file_path")} file_path, commit_hash, ts, upper(trim(event)) event from change_events where file_path is not null and ts is not null),
      g as (select ts, case when ts < lag(ts) over (order by ts) + interval 1 second then 0 else 1 end s from log), r as (select ts, sum(s) over (order by ts rows unbounded preceding) k from g)
      select min(ts) started, max(ts) + interval 1 second ended, count(*) events, cast(ceil(count(*) / 50) as integer) flushes from r group by k""",
}
