"""Source files that were not written by hand: generated, minified, vendored, or data stored as code.

Variables with five labels form a tree: each file hangs on the group of its siblings (same directory, same extension),
each group on its directory, each directory on the one above. A file's potential grades what its row says; a
directory's says what its name declares, which no row repeats: a file in a package manager's folder is told by messages
from that folder alone. A handwritten directory may hold files of any label, a directory of another label holds only
its own. So siblings of one kind turn their group, and a file of middling evidence follows its group.

Belief propagation is exact on a tree. Files are range-partitioned in depth-first order, a large directory over several
partitions; each partition passes messages up by levels as far as its files determine them. Directories and groups on
the first and last path of a partition are shared with its neighbours: their partial sums, at most twice the depth a
partition, are stitched and get their belief, then each partition passes beliefs down. No count depends on the depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import canonical, folded
from codeweft.session import cut, partitions, small
from codeweft.sources.tables import current

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GENERATED, MINIFIED, VENDORED, BLOB = range(5)
#: Files that a partition holds in memory, some 100 MB.
FILES_PER_TASK = 200_000
#: The log weight of what can't be; beyond the sum of all graded weights.
NEVER = -1e9

# Directories in which package managers and projects keep copies of others' code.
VENDOR_DIRS = ("node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "pods", "carthage")
# Directories into which builds write, by the end of their path.
BUILD_DIRS = r"/(dist|build|generated-sources|generated-src|__generated__|target/(classes|generated-sources)|out/(gen|production|test)|obj/(release|debug)|bin/(release|debug)|\.next|\.nuxt|\.svelte-kit|\.output|cmake-build-\w+)(/|$)"
# The ends of file names that tools give to what they make.
GENERATED_NAMES = r"([._](pb|pb2|pb2_grpc|pbgrpc|pbjson|generated|autogen)|\.(gen|g|g\.i|g\.dart|freezed|designer|d\.generated))\.\w+$|^zz_generated\."
MINIFIED_NAMES = r"([.-]min|\.bundle|\.chunk|\.packed)\.(m|c)?js$|[.-]min\.css$"
# What tools write into the files that they make. A remark on generated files isn't such a line.
GENERATED_DOCS = (
    r"(?i)^[\s/*#'\"!;-]*(<summary>\s*)?[\s/*#'\"!;-]*(@generated\b|code generated (by|from)\b|auto-?generated (file|code|by|from)\b|"
    r"(this (file|code|class) )?(was |is |has been )?(automatically|machine)[ -](created|generated|written|produced) by\b|(this (file|code) (was|is) )?generated (by|from) \S+[;,.]? .*"
    r"(edit|overwritten|modify|regenerat|chang)|(this (file|code) (was|is) )?(auto-?)generated by\b|<auto-generated|(diese datei|dieser code) wurde .*(erzeugt|generiert)|"
    r"(ce fichier|ce code) .*(généré|produit|créé)|(este archivo|este código) .*(generado|creado)|이 파일은 .*(생성|만들))|(?i)^[^.\n]{0,80}\bdo not (edit|modify)( by hand| manually)?[.!]?[\s*/]*$"
)
DATA_LANGUAGES = ("json", "yaml", "yml", "md", "toml", "xml", "csv", "txt", "lock", "ini")


@dataclass(frozen=True)
class Model:
    """Log weights (nats) but for ``own``.

    own: share of a handwritten directory's files that are handwritten. turn: cost of a directory or group of another
    label in a handwritten one. sure: of a flag, a known checksum, a tool's name mark or header against handwritten.
    grade: of each doubling of branches a line beyond ``dense`` (minified) or of lines beyond ``lines`` in code without
    branches (blob). looks: cost of the labels for a row of ordinary shape without any mark; half where its shape is unknown.
    """

    own: float = 0.85
    turn: float = 14.0
    sure: float = 20.0
    grade: float = 2.0
    dense: float = 1.0
    lines: float = 500.0
    looks: tuple[float, ...] = (0.0, 4.0, 8.0, 4.0, 8.0)

    def files(self) -> np.ndarray:
        """log P(file's label, column | group's label, row)."""
        out = np.where(np.eye(5, dtype=bool), 0.0, NEVER)
        out[HAND] = [log(self.own)] + [log((1 - self.own) / 4)] * 4
        return out

    def folders(self) -> np.ndarray:
        """log P(label of a directory or group, column | label of the directory above, row)."""
        out = np.where(np.eye(5, dtype=bool), 0.0, NEVER)
        out[HAND] = [0.0] + [-self.turn] * 4
        return out


def vendor_pattern() -> str:
    return "(^|/)(" + "|".join(VENDOR_DIRS) + ")(/|$)"


def files(nodes: DataFrame) -> DataFrame:
    """Current file rows: id, path in canonical form, dir, base and the columns that hold evidence."""
    is_file = folded("symbol_type") == "file"
    heavy = [F.when(is_file, F.col(c)).alias(c) for c in ("file_path", "qualified_name", "checksum", "docstring")]
    own = nodes.select("id", "version", is_file.alias("is_file"), *heavy, "is_generated", "loc", "cyclomatic")
    rows = current(own, *[c for c in own.columns if c not in ("id", "version")]).filter("is_file")
    path = F.coalesce(canonical("file_path"), canonical("qualified_name"), F.lit(""))
    return rows.withColumn("path", path).withColumns(
        {"dir": F.regexp_replace("path", "/?[^/]*$", ""), "base": F.regexp_extract("path", "[^/]*$", 0)}
    )


def potentials(model: Model) -> Column:
    """The log weights of a row of ``files`` joined with ``known`` (its checksum is a package's), one a label."""
    no, zero = F.lit(False), F.lit(0.0)
    code = ~F.regexp_extract("base", r"([^.]*)$", 1).isin(*DATA_LANGUAGES)
    said = F.coalesce(F.regexp_replace("docstring", r"</?summary>", ""), F.lit(""))
    made = F.coalesce(F.col("is_generated"), no) | F.col("base").rlike(GENERATED_NAMES) | said.rlike(GENERATED_DOCS)
    packed = F.col("base").rlike(MINIFIED_NAMES)
    copied = F.coalesce(F.col("known"), no)
    branches = F.coalesce("cyclomatic", F.lit(0))
    density = F.when(code & (F.col("loc") > 0) & (branches > 20), F.col("cyclomatic") / F.col("loc"))
    dense = F.greatest(F.coalesce(model.grade * F.log2(density / model.dense), zero), zero)
    size = F.when(code & (branches <= 1) & (F.col("loc") > 0), F.col("loc"))
    large = F.greatest(F.coalesce(model.grade * F.log2(size / model.lines), zero), zero)
    plain = F.when(made | packed | copied | (dense > 0) | (large > 0), zero).when(F.col("loc").isNull() | F.col("cyclomatic").isNull(), F.lit(0.5)).otherwise(1.0)
    mark = lambda proof: F.when(proof, model.sure).otherwise(0.0)
    own = [zero, mark(made), mark(packed) + dense, mark(copied), large]
    return F.array(*[w - plain * x for w, x in zip(own, model.looks)])


def declared(path: str) -> int | None:
    """The label that a directory's name declares for all below it: a package manager's folder, or a build's output."""
    if _VENDOR(path):
        return VENDORED
    return GENERATED if _BUILD("/" + path) else None


_VENDOR = re.compile(r"(?:^|/)(?:" + "|".join(VENDOR_DIRS) + r")$").search
_BUILD = re.compile(BUILD_DIRS.removesuffix("(/|$)") + "$").search


def _sums(rows: np.ndarray) -> np.ndarray:
    """log of the sum of exp along the last axis."""
    top = rows.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(rows - top).sum(axis=-1, keepdims=True)))[..., 0]


def _up(belief: np.ndarray, compat: np.ndarray) -> np.ndarray:
    """Messages from children of these beliefs to what is above them."""
    return _sums(belief[:, None, :] + compat[None])


def _down(belief: np.ndarray, compat: np.ndarray) -> np.ndarray:
    """Messages to children from what is above them, its belief less what the child said."""
    out = _sums(belief[:, None, :] + compat.T[None])
    return out - out.max(axis=1, keepdims=True)


class _Tree:
    """Groups and directories of some files: ``key`` (path, extension or None), depth, parent's place and beliefs."""

    def __init__(self):
        self.place: dict[tuple[str, str | None], int] = {}
        self.parent: list[int] = []
        self.depth: list[int] = []

    def put(self, path: str | None, ext: str | None = None) -> int:
        """The place of a group, or of a directory if ``ext`` is None; the root's path is None."""
        at = self.place.get((path, ext))
        if at is None:
            if ext is not None:
                up = self.put(path)
            else:
                up = -1 if path is None else self.put(path.rpartition("/")[0] if "/" in path else None)
            at = self.place[path, ext] = len(self.parent)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
        return at

    def line(self, at: int) -> list[int]:
        out = []
        while at >= 0:
            out.append(at)
            at = self.parent[at]
        return out

    def levels(self) -> list[np.ndarray]:
        depth = np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def names(self, turn: float) -> np.ndarray:
        """The potentials that names declare, and the root's."""
        out = np.zeros((len(self.parent), 5))
        if (None, None) in self.place:
            out[self.place[None, None], 1:] = -turn
        for (path, ext), at in self.place.items():
            if ext is None and path and (label := declared(path)) is not None:
                out[at] = NEVER
                out[at, label] = 0.0
        return out

    def rise(self, heard: np.ndarray, compat: np.ndarray, shared: set[int]) -> np.ndarray:
        """Adds messages to ``heard`` from the lowest level up, those of ``shared`` places left out; returns them."""
        parent, sent = np.array(self.parent), np.zeros_like(heard)
        keep = np.ones(len(parent), bool)
        keep[list(shared)] = False
        for at in reversed(self.levels()[1:]):
            at = at[keep[at]]
            at = at[heard[at].max(axis=1) - heard[at, HAND] < -NEVER / 2]  # a declared directory says nothing about the one above
            sent[at] = _up(heard[at], compat)
            np.add.at(heard, parent[at], sent[at])
        return sent

    def fall(self, heard: np.ndarray, sent: np.ndarray, compat: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
        """The whole beliefs, from the root down; those of ``known`` places are given."""
        parent, whole = np.array(self.parent), heard.copy()
        for at, x in known.items():
            whole[at] = x
        free = np.ones(len(parent), bool)
        free[list(known)] = False
        for at in self.levels()[1:]:
            at = at[free[at]]
            whole[at] += _down(whole[parent[at]] - sent[at], compat)
        return whole


def _own_tree(f: pd.DataFrame, model: Model) -> tuple[_Tree, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of a partition's files in order, each file's group, potentials and message, and what groups hear from them."""
    tree = _Tree()
    start = np.flatnonzero(((f.dir != f.dir.shift()) | (f.ext != f.ext.shift())).to_numpy())
    runs = np.array([tree.put(d, e) for d, e in zip(f.dir.iloc[start], f.ext.iloc[start])])
    group = np.repeat(runs, np.diff([*start, len(f)]))
    own = np.stack(f.potential.to_numpy())
    said = _up(own, model.files())
    heard = np.zeros((len(tree.parent), 5))
    np.add.at(heard, runs, np.add.reduceat(said, start))
    return tree, group, own, said, heard


def _partial(model: Model):
    """Pass 1: what the groups and directories on a partition's first and last path hear from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        tree, group, _, _, heard = _own_tree(pd.concat(parts, ignore_index=True), model)
        shared = set(tree.line(int(group[0]))) | set(tree.line(int(group[-1])))
        names = tree.names(model.turn)
        names[list(shared)] = 0.0  # said once, when stitched
        heard += names
        tree.rise(heard, model.folders(), shared)
        keys = list(tree.place)
        yield pd.DataFrame([(*keys[i], heard[i].tolist()) for i in sorted(shared)], columns=["dir", "ext", "heard"])

    return run


def _stitched(rows: list, model: Model) -> dict[tuple[str | None, str | None], np.ndarray]:
    """The beliefs of all shared groups and directories from the partitions' partial sums."""
    tree = _Tree()
    at = [tree.put(r["dir"], r["ext"]) for r in rows]
    heard = tree.names(model.turn)
    for i, r in zip(at, rows):
        heard[i] += r["heard"]
    sent = tree.rise(heard, model.folders(), set())
    whole = tree.fall(heard, sent, model.folders(), {})
    return {key: whole[i] for key, i in tree.place.items()}


def _beliefs(model: Model, shared):
    """Pass 2: each file's label and its probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        f = pd.concat(parts, ignore_index=True)
        tree, group, own, said, heard = _own_tree(f, model)
        known = {i: shared.value[key] for key, i in tree.place.items() if key in shared.value}
        heard += tree.names(model.turn)
        sent = tree.rise(heard, model.folders(), set(known))
        whole = tree.fall(heard, sent, model.folders(), known)
        post = own + _down(whole[group] - said, model.files())
        best = post.argmax(axis=1)
        share = 1 / np.exp(post - post.max(axis=1, keepdims=True)).sum(axis=1)
        yield pd.DataFrame({"node_id": f.id, "path": f.path, "label": np.array(LABELS, object)[best], "probability": np.round(share, 6)})

    return run


def labelled(nodes: DataFrame, known_packages: DataFrame, model: Model | None = None, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """(node_id, path, label, probability) of every current file row.

    ``known_packages`` (checksum) is a fixed list of third-party files. Null fields are no evidence. The row of the
    highest version counts; ids without a row of type file don't come out. The driver holds the shared directories of
    the partitions: twice the depth of paths a partition, so some 50 rows for each ``files_per_task`` files.
    """
    model = model or Model()
    spark = nodes.sparkSession
    known = known_packages.select("checksum").filter("checksum <> ''").distinct().withColumn("known", F.lit(True))
    found = files(nodes).join(small(known, known.count()), "checksum", "left")
    ext = F.regexp_extract("base", r"([^.]*)$", 1)
    rows = cut(found.select("id", "path", "dir", ext.alias("ext"), F.split("dir", "/").alias("line"), potentials(model).alias("potential")))
    n = max(1, min(partitions(spark), -(-rows.count() // 1000)), -(-rows.count() // files_per_task))
    placed = cut(rows.repartitionByRange(n, "line", "ext", "id").sortWithinPartitions("line", "ext", "id").drop("line"))
    heard = placed.mapInPandas(_partial(model), "dir string, ext string, heard array<double>").collect()
    shared = spark.sparkContext.broadcast(_stitched(heard, model))
    kind = nodes.schema["id"].dataType.simpleString()
    return placed.mapInPandas(_beliefs(model, shared), f"node_id {kind}, path string, label string, probability double")
