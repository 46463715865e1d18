"""Text quality statistics of each document, their exact ranks in its language, and outlier scores from the tails.

Statistics lie on fixed grids, so a language has a bounded number of distinct values of each: their counts are combined
on the map side, range-partitioned and sorted, and each partition's cumulative counts are offset by the partitions
before it, which gives every value its exact rank. Ranks are taken among the documents that are mostly sentences by a
plain look at their lines, per language, and among those that hardly have any. Empirical tail probabilities are read off
the ranks; a document's scores add their logarithms over the statistics, and natural prose is what lies out less among
prose than among the rest. No document is ever sorted or gathered; the table of ranks is joined back to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import cut, partitions, small

SHARES = 10_000  # shares are counted in ten-thousandths
LOGS = 1_000  # logarithms to the base 2 in thousandths
#: Statistics by name and grid.
STATISTICS = {
    "log_words": LOGS,
    "log_word_length": LOGS,
    "symbol_share": SHARES,
    "digit_share": SHARES,
    "ended_lines": SHARES,
    "common_share": SHARES,
    "sentence_share": SHARES,
}

_ZERO = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_ENDED = re.compile(r"[.!?…。．！？:;]['\"”’»)\]*/]*\s*$")
_SYMBOL = re.compile(r"[\w\s]+")
_DIGIT = re.compile(r"\d+")
_EDGE = "​‌‍⁠﻿.,;:!?¿¡()[]\"'“”‘’«»…*/#"
#: Scripts without a word list here, told by their letters: sentences in them are known by their marks.
_OTHER = re.compile(r"[Ͱ-ԯ֐-ۿऀ-෿฀-໿぀-ヿ㐀-鿿]")
_STOP = re.compile(r"[.!?。！？،؟।]")


class Words:
    """The common words of each language."""

    def __init__(self, rows: Iterable[tuple[str, str]]):
        self.of: dict[str, set[str]] = {}
        for lang, word in rows:
            if lang and word:
                self.of.setdefault(lang.strip().lower(), set()).add(word.strip().lower())
        self.all = set().union(*self.of.values()) if self.of else set()


def sentence_chars(text: str, common: set[str]) -> int:
    """Characters, without white space, of the lines that look like sentences.

    A line does if it has three words or more, three fifths of them of letters only, two or more, and a tenth of them ``common`` ones
    of its language; or, in a script without a word list here, if most of it is of that script and it has a stop.
    """
    total = 0
    for line in text.splitlines():
        words = [w.strip(_EDGE) for w in line.lower().split()]
        n = len(words)
        if n < 3:
            if len(_OTHER.findall(line)) <= 0.5 * len(line) or not _STOP.search(line):
                continue
        elif 10 * sum(map(common.__contains__, words)) < n or 5 * sum(len(w) > 1 and w.isalpha() for w in words) < 3 * n:
            if line.isascii() or len(_OTHER.findall(line)) <= 0.5 * len(line) or not _STOP.search(line):
                continue
        total += len("".join(line.split()))
    return total


_NONE: set[str] = set()


def statistics(text: str | None, lang: str | None, common: Words) -> tuple[str, int, list[int]]:
    """Language, number of words and the values on their grids, in the order of ``STATISTICS``.

    The language is the one with most common words in the text, else the stated one in lower case if it has a word list,
    else "und". A null, empty or blank text has zeros.
    """
    from math import log2

    if text and not text.isascii():
        text = _ZERO.sub("", text)
    parts = text.lower().split() if text else []
    stated = (lang or "").strip().lower()
    if not parts:
        return stated if stated in common.of else "und", 0, [0] * len(STATISTICS)
    hits = [w for w in (p.strip(_EDGE) for p in parts) if w in common.all]
    found = {k: sum(map(v.__contains__, hits)) for k, v in common.of.items()}
    own = max(found, key=lambda k: (found[k], k == stated, k)) if hits else (stated if stated in common.of else "und")
    solid = sum(map(len, parts))
    lines = [x for x in text.splitlines() if x.strip()]
    share = lambda a, b: min(SHARES, int(SHARES * a / b + 0.5)) if b else 0
    values = [
        int(LOGS * log2(1 + len(parts))),
        int(LOGS * log2(solid / len(parts))),
        share(len(_SYMBOL.sub("", text)), solid),
        share(sum(map(len, _DIGIT.findall(text))), solid),
        share(sum(map(bool, map(_ENDED.search, lines))), len(lines)),
        share(found.get(own, 0), len(parts)),
        share(sentence_chars(text, common.of.get(own, _NONE)), solid),
    ]
    return own, len(parts), values


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, lang_found, n_words, one integer column a statistic) of every document.

    ``common_words`` (lang, word) is a fixed list; at most ``MOST_WORDS`` rows of it are taken to the driver, more is an
    error. Rows are kept as they come.
    """
    rows = common_words.select("lang", "word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    common = Words([(r["lang"], r["word"]) for r in rows])
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t, g, common) for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())]
            cols += [pa.array([g[2][i] for g in got], pa.int32()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "lang_found", "n_words", *STATISTICS])

    out = f"doc_id {kind}, lang_found string, n_words long, " + ", ".join(f"{s} int" for s in STATISTICS)
    return documents.select("doc_id", "text", "lang").mapInArrow(run, out)


MOST_WORDS = 100_000


_TAILS = ("at_most", "at_least", "of")
#: The group of all languages; no language is named so, as names have no outer blanks.
_ALL = " all"


def tails(counts: DataFrame, group: list[str], value: str, numbers: list[str]) -> DataFrame:
    """``counts`` (*group, value, *numbers), one row a value, with x_at_most, x_at_least and x_of for each number x: the
    records of the group with at most and at least the value, and all of them.

    Exact: values are sorted over range partitions, and each partition adds what lies before it.
    """
    n = partitions(counts.sparkSession)
    placed = cut(counts.repartitionByRange(n, *group, value).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*group, "_part").agg(*[F.sum(x).alias(f"_{x}") for x in numbers])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    offset = sums.select(
        *group, "_part", *[F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"_before_{x}") for x in numbers], *[F.sum(f"_{x}").over(every).alias(f"{x}_of") for x in numbers]
    )
    own = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumns({f"_own_{x}": F.sum(x).over(own) for x in numbers}).join(offset, [*group, "_part"])
    out = ranked.withColumns({f"{x}_at_most": F.col(f"_before_{x}") + F.col(f"_own_{x}") for x in numbers})
    out = out.withColumns({f"{x}_at_least": F.col(f"{x}_of") - F.col(f"{x}_at_most") + F.col(x) for x in numbers})
    return out.select(*group, value, *[f"{x}_{k}" for x in numbers for k in _TAILS])


@dataclass(frozen=True)
class Model:
    """prose, other: sentence shares from which a document is of the prose that others are held against, and up to which
    of the rest. weights: of each statistic's tails, negative where low values are prose's. most: bits that a tail counts
    at most. least_of: prose documents from which a language is held against its own, else against all languages'.
    lean: bits by which a document may fit prose worse than the rest and still be taken."""

    prose: float = 0.6
    other: float = 0.4
    weights: tuple[tuple[str, float], ...] = (
        ("log_word_length", -1.0), ("symbol_share", -1.0), ("digit_share", -1.0), ("ended_lines", 1.0), ("common_share", 1.0), ("sentence_share", 3.0),
    )
    most: float = 20.0
    least_of: int = 100
    lean: float = 10.0


def outlier_scores(stats: DataFrame, model: Model | None = None) -> DataFrame:
    """``stats`` with ``outlier_score``, ``other_score`` and, for each statistic s, ``low_s``.

    ``low_s`` is the share of its language at or below the value. The scores are sums over the statistics of the bits of
    one-sided tails: how far the document lies out among its language's prose, on the side away from it, and how far among
    all other documents, on prose's side. Documents between both populations are scored but are in neither. A language
    without a word list has no share of common words, so that statistic doesn't count for it.
    """
    model = model or Model()
    stats = cut(stats)
    share = F.col("sentence_share")
    kind = {"n": F.lit(1), "prose": (share >= int(model.prose * SHARES)).cast("int"), "other": (share <= int(model.other * SHARES)).cast("int")}
    pairs = F.array(*[F.struct(F.lit(i).alias("stat"), F.col(s).cast("int").alias("value")) for i, s in enumerate(STATISTICS)])
    rows = stats.select("lang_found", *[c.alias(k) for k, c in kind.items()], F.inline(pairs))
    counts = cut(rows.groupBy("lang_found", "stat", "value").agg(*[F.sum(k).alias(k) for k in kind]))
    pooled = counts.groupBy(F.lit(_ALL).alias("lang_found"), "stat", "value").agg(*[F.sum(k).alias(k) for k in kind])
    placed = cut(tails(counts.unionByName(pooled), ["lang_found", "stat"], "value", list(kind)))
    every = placed.filter(F.col("lang_found") == _ALL).select("stat", "value", *[F.col(f"prose_{k}").alias(f"all_{k}") for k in _TAILS], *[f"other_{k}" for k in _TAILS])
    placed_rows = placed.count()
    ranks = placed.filter(F.col("lang_found") != _ALL).drop(*[f"other_{k}" for k in _TAILS]).join(small(every, placed_rows), ["stat", "value"])
    bits = lambda k, n: F.least(-F.log2((F.col(k) + 0.5) / (F.col(n) + 1)), F.lit(model.most))
    weight = dict(model.weights)
    worse, better = F.lit(0.0), F.lit(0.0)
    for i, s in enumerate(STATISTICS):
        w = weight.get(s, 0.0)
        if not w:
            continue
        away, near = ("at_most", "at_least") if w > 0 else ("at_least", "at_most")
        counted = (F.col("stat") == i) & ((F.lit(s) != "common_share") | (F.col("lang_found") != "und"))
        fit = F.when(F.col("prose_of") >= model.least_of, bits(f"prose_{away}", "prose_of")).otherwise(bits(f"all_{away}", "all_of"))
        worse, better = F.when(counted, abs(w) * fit).otherwise(worse), F.when(counted, abs(w) * bits(f"other_{near}", "other_of")).otherwise(better)
    ranks = ranks.select("lang_found", "stat", "value", (F.col("n_at_most") / F.col("n_of")).alias("low"), worse.alias("worse"), better.alias("better"))
    out, score, other = stats, F.lit(0.0), F.lit(0.0)
    for i, s in enumerate(STATISTICS):
        mine = ranks.filter(F.col("stat") == i).select("lang_found", F.col("value").alias(s), F.col("low").alias(f"low_{s}"), F.col("worse").alias(f"_w{i}"), F.col("better").alias(f"_b{i}"))
        out = out.join(small(mine, placed_rows), ["lang_found", s])
        score, other = score + F.col(f"_w{i}"), other + F.col(f"_b{i}")
    keep = ["doc_id", "lang_found", "n_words", *STATISTICS, *[f"low_{s}" for s in STATISTICS]]
    return out.select(*keep, F.round(score, 4).alias("outlier_score"), F.round(other, 4).alias("other_score"))


def natural(model: Model | None = None) -> Column:
    """The document lies out among prose by less, but for ``lean`` bits, than among the others, and has words."""
    model = model or Model()
    return (F.col("outlier_score") < F.col("other_score") + model.lean) & (F.col("n_words") > 0)
