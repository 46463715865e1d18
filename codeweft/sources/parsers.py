"""Text to rows: routing of files and the parsers that column expressions can express.

Every parser takes files (path, text) and keeps what names a row, the path. A file of another kind gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.names import canonical
from codeweft.functions.text import line_count, slug

# Languages by file extension.
EXTENSIONS = {
    "typescript": ("ts",), "javascript": ("js",), "python": ("py",), "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "hpp", "hxx"),
    "csharp": ("cs",), "kotlin": ("kt", "kts"), "php": ("php",), "rust": ("rs",), "gdscript": ("gd",),
}


def extension(path: Column | str) -> Column:
    """The part after the last dot of the file name, in lower case; none gives an empty string."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(F.lower(p), r"\.([^./\\]+)$", 1)


def language(path: Column | str) -> Column:
    """The programming language by extension, null for none."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, exts in EXTENSIONS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def route(path: Column | str) -> Column:
    """The parser of a file: the first that takes it, in this order; null for none."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    ext = extension(p)
    return (
        F.when(ext.isin("ts", "js"), "semantic")
        .when(language(p).isNotNull(), "generic")
        .when(p.rlike(r"(^|/)(package\.json|requirements\.txt)$"), "dependencies")
        .when(ext.isin("yml", "yaml"), "yaml")
        .when(ext == "md", "markdown")
        .when(ext == "json", "json")
    )


def file_nodes(files: DataFrame, commit: str = "") -> DataFrame:
    """One file node a file: canonical name, language, checksum and lines; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    n = line_count(text)
    return files.select(
        canonical("path").alias("qualified_name"), F.lit("file").alias("symbol_type"), F.coalesce(language("path"), extension("path")).alias("language"), "path",
        F.lit(1).alias("start_line"), n.alias("end_line"), n.alias("loc"), F.sha1(F.encode(text, "utf-8")).alias("checksum"), F.lit(commit).alias("last_updated_commit"),
    )


def markdown_sections(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, number, title, slug, start_line, end_line, docstring) of the sections of level 1 and 2.

    A section runs to the line before the next heading of these levels; its trimmed body, up to 2,000 characters, is its
    documentation, null if empty. Windows and groups are bounded by one file.
    """
    lines = files.filter(F.col("text").rlike(r"(?m)^##?\s")).select(key, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    title = F.regexp_extract("line", r"^##?\s+(.+)$", 1)
    marked = lines.withColumns({"head": F.col("line").rlike(r"^##?\s+.+$"), "stop": F.col("line").rlike(r"^##?\s"), "title": F.trim(title)})
    running = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = marked.withColumn("part", F.sum(F.col("stop").cast("int")).over(running)).filter("part > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("stop"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    own = parts.groupBy(key, "part").agg(
        F.max(F.when(F.col("head"), F.col("title"))).alias("title"), F.min("at").alias("first"), F.max("at").alias("last"), body.alias("body")
    )
    trimmed = F.regexp_replace("body", r"^\s+|\s+$", "")
    return own.filter("title is not null").select(
        key, F.col("part").cast("int").alias("number"), "title", slug(F.col("title")).alias("slug"), (F.col("first") + 1).alias("start_line"),
        (F.col("last") + 1).alias("end_line"), F.nullif(F.substring(trimmed, 1, 2000), F.lit("")).alias("docstring"),
    )


def json_keys(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, config_key) of the top-level keys of JSON texts, comments stripped; those of an array are its places.

    Comments are stripped inside strings too, so a text with a web address doesn't parse; such a text gives no keys.
    """
    bare = F.regexp_replace(F.regexp_replace("text", r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    own = files.select(key, bare.alias("t"))
    places = F.transform(F.sequence(F.lit(1), F.json_array_length("t")), lambda i: (i - 1).cast("string"))
    keys = F.when(F.json_array_length("t") > 0, places).otherwise(F.json_object_keys("t"))
    return own.select(key, F.explode(F.array_distinct(keys)).alias("config_key"))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, package, version) of package.json (development versions win) and requirements.txt files.

    Packages are named ``package:x`` and ``pypi:x``; a requirement without a version has ``latest``. Unreadable JSON and
    blank or comment lines give no rows.
    """
    deps = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    node = files.filter(F.col("path").endswith("package.json")).select("path", deps.alias("d"))
    dev, run = F.coalesce("d.devDependencies", none), F.coalesce("d.dependencies", none)
    own = F.map_concat(F.map_filter(run, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    npm = node.select("path", F.explode(own).alias("n", "version")).select("path", F.concat(F.lit("package:"), "n").alias("package"), "version")
    lines = files.filter(F.col("path").endswith("requirements.txt")).select("path", F.explode(F.split("text", "\n")).alias("line"))
    line = F.trim(F.regexp_replace("line", r"\r$", ""))
    name = F.regexp_extract(line, r"^([a-zA-Z0-9_\-]+)", 1)
    version = F.coalesce(F.nullif(F.regexp_extract(line, r"[=<>!~]+(.+)$", 1), F.lit("")), F.lit("latest"))
    pypi = lines.filter((line != "") & ~line.startswith("#") & (name != "")).select("path", F.concat(F.lit("pypi:"), name).alias("package"), version.alias("version"))
    return npm.unionByName(pypi)


def clean_docstring(c: Column) -> Column:
    """A comment without its marks, line by line, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?m)^/\*\*?|\*/$|^///?|^#+\s?|^\s*\*\s?", "")), F.lit(""))


def is_test_file(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.(ts|js|tsx|jsx)$") | path.contains("/__tests__/")


def production_path(path: Column) -> Column:
    """The path that a test file's name points at, null for other files."""
    bare = F.regexp_replace(path, r"\.(test|spec)\.(ts|js|tsx|jsx)$", ".$2")
    return F.when(bare != path, bare).when(path.contains("/__tests__/"), F.replace(path, F.lit("/__tests__/"), F.lit("/")))


def production_files(files: DataFrame) -> DataFrame:
    """(path, production) of test files among files (path): the inferred path if it is a file; else, in a source directory,
    the same file name; else one whose stem holds the test's stem. The least deep and then first path wins.

    The fuzzy step joins on the stem's first word, a key that spreads, and checks the rest.
    """
    own = files.select("path").distinct()
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    word = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z0-9]+)", 1))
    tests = own.filter(is_test_file(F.col("path"))).select("path", production_path(F.col("path")).alias("inferred")).filter("inferred is not null")
    tests = tests.withColumn("base", F.regexp_extract("inferred", r"([^/]+)$", 1))
    source = own.filter(~is_test_file(F.col("path"))).select(F.col("path").alias("production"), base.alias("base"), F.size(F.split("path", "/")).alias("depth"))
    inside = source.filter(F.col("production").rlike(r"(^|/)(src|lib|source|app)/"))
    exact = tests.join(source.withColumnRenamed("production", "inferred").select("inferred"), "inferred", "left_semi").select("path", F.lit(1).alias("tier"), F.lit(0).alias("depth"), F.col("inferred").alias("production"))
    same = tests.join(inside, "base").select("path", F.lit(2).alias("tier"), "depth", "production")
    fuzzy = tests.withColumn("w", word("base")).join(inside.withColumnRenamed("base", "b").withColumn("w", word("b")), "w")
    fuzzy = fuzzy.filter(F.contains(stem(F.col("b")), stem(F.col("base")))).select("path", F.lit(3).alias("tier"), "depth", "production")
    every = exact.unionByName(same).unionByName(fuzzy)
    return every.groupBy("path").agg(F.min(F.struct("tier", "depth", "production")).alias("x")).select("path", "x.production")


def _target(prefix: str, part: str, kind: str) -> Callable[[Column], Column]:
    """A matched name as (target, edge_type): its ``part``, if one is given, behind the prefix."""

    def make(x: Column) -> Column:
        name = F.regexp_replace(x, part, "$1") if part else x
        return F.struct(F.concat(F.lit(prefix), name).alias("target"), F.lit(kind).alias("edge_type"))

    return make


def imports(files: DataFrame) -> DataFrame:
    """(path, target, edge_type) of the imports and the supertypes that a line of each language names.

    Relative imports of Python give the two files they may mean; modules of Rust likewise.
    """
    pairs = [
        (("ts", "js"), r"(?m)(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['\"]([^'\".][^'\"]*)['\"]", "package:", r"^(@[^/]+/[^/]+|[^/]+).*$", "depends_on"),
        (("py",), r"(?m)^\s*import\s+([A-Za-z_][\w.]*)", "pypi:", r"^([^.]+).*$", "depends_on"),
        (("py",), r"(?m)^\s*from\s+([A-Za-z_][\w.]*)\s+import\b", "pypi:", r"^([^.]+).*$", "depends_on"),
        (("go",), r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", "", "", "depends_on"),
        (("java", "kt", "kts"), r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)", "", "", "depends_on"),
        (("c", "h", "cpp", "cc", "hpp", "hxx"), r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "header:", "", "depends_on"),
        (("cs",), r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "", "", "depends_on"),
        (("php",), r"(?m)^\s*use\s+([\w\\\\]+)", "", "", "depends_on"),
        (("rs",), r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "crate:", r"^(?:.*::)?([^:]+)$", "depends_on"),
        (("gd",), r"(?m)^\s*extends\s+([A-Za-z_]\w*)", "class:", "", "inherits"),
        (("ts", "js", "java", "php"), r"(?m)\bclass\s+\w+(?:<[^>]*>)?\s+extends\s+([\w.]+)", "", "", "inherits"),
        (("ts", "java", "cs", "php"), r"(?m)\bclass\s+\w+[^{]*?\bimplements\s+([\w.]+)", "", "", "implements"),
        (("py",), r"(?m)^\s*class\s+\w+\s*\(\s*([A-Za-z_][\w.]*)", "", "", "inherits"),
        (("kt",), r"(?m)\bclass\s+\w+(?:\([^)]*\))?\s*:\s*([A-Za-z_]\w*)", "class:", "", "inherits"),
        (("cpp", "cs"), r"(?m)\bclass\s+\w+\s*:\s*(?:public\s+)?([A-Za-z_]\w*)", "", "", "inherits"),
    ]
    ext = extension("path")
    found = []
    for exts, pattern, prefix, part, kind in pairs:
        found.append(F.when(ext.isin(*exts), F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), _target(prefix, part, kind))))
    none = F.array().cast("array<struct<target:string,edge_type:string>>")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    up = lambda n: F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - n, F.lit(0))), "/")
    files_of = lambda base: F.array(*[F.struct(F.concat(base, F.lit(s)).alias("target"), F.lit("depends_on").alias("edge_type")) for s in (".py", "/__init__.py")])
    dots = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+(\.+[\w.]*)\s+import\b"), 1),
        lambda x: files_of(F.concat(up(F.length(F.regexp_extract(x, r"^(\.+)", 1)) - 1), F.lit("/"), F.replace(F.regexp_replace(x, r"^\.+", ""), F.lit("."), F.lit("/")))),
    )
    found.append(F.when(ext == "py", F.flatten(dots)))
    mods = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), 1),
        lambda x: F.array(*[F.struct(F.concat(folder, F.lit("/"), x, F.lit(s)).alias("target"), F.lit("depends_on").alias("edge_type")) for s in (".rs", "/mod.rs")]),
    )
    found.append(F.when(ext == "rs", F.flatten(mods)))
    own = files.select("path", F.flatten(F.array(*[F.coalesce(x, none) for x in found])).alias("hits"))
    return own.select("path", F.inline("hits")).distinct()
