"""Fixed schemas of the graph tables and the values that their columns may take."""

from __future__ import annotations

from pyspark.sql import types as T

COMMIT = T.StructType([T.StructField(c, T.StringType()) for c in ("hash", "message", "author", "date")])

NODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("qualified_name", "symbol_name", "symbol_type", "language", "file_path")],
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("is_generated", T.BooleanType()),
        T.StructField("last_updated_commit", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("modifiers", T.ArrayType(T.StringType())),
        *[T.StructField(c, T.StringType()) for c in ("signature", "return_type", "field_type")],
        *[T.StructField(c, T.IntegerType()) for c in ("loc", "cyclomatic", "fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic")],
        T.StructField("remote_project_path", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("history", T.ArrayType(COMMIT)),
        T.StructField("docstring", T.StringType()),
        T.StructField("cluster_id", T.LongType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("from_id", T.LongType()),
        T.StructField("to_id", T.LongType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("call_site_line", T.IntegerType()),
        T.StructField("dynamic", T.BooleanType()),
    ]
)

RAW_EDGES = T.StructType(
    [
        T.StructField("from_qname", T.StringType()),
        T.StructField("to_qname", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("dynamic", T.BooleanType()),
        T.StructField("call_site_line", T.IntegerType()),
        T.StructField("target_file_hint", T.StringType()),
    ]
)

TEST_SPECS = T.StructType(
    [
        T.StructField("test_qname", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("target_qname", T.StringType()),
        T.StructField("assertions", T.ArrayType(T.StringType())),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
    ]
)

LAYER = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "pathPattern", "description")])
RULE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("allowed", T.BooleanType()),
        T.StructField("rationale", T.StringType()),
    ]
)
INTENT = T.StructType(
    [
        T.StructField("layers", T.ArrayType(LAYER)),
        T.StructField("rules", T.ArrayType(RULE)),
        T.StructField("responsibilities", T.MapType(T.StringType(), T.StringType())),
    ]
)

# The values of the enumerated columns and the columns that may be ranked.
SYMBOL_TYPES = ("file", "class", "interface", "method", "function", "field", "module", "package", "test", "section", "config_key")
EDGE_TYPES = (
    "defines", "contains", "inherits", "implements", "overrides", "calls", "depends_on", "tests", "dynamic_calls", "reads",
    "writes", "emits", "connects_to", "namespace_of", "implements_trait",
)
VISIBILITIES = ("public", "protected", "private", "internal")
CHANGE_TYPES = ("ADD", "MODIFY", "DELETE")
METRICS = ("loc", "cyclomatic", "fan_in", "fan_out", "fan_in_dynamic", "fan_out_dynamic")
