"""Keyword search, rank fusion and hybrid search over symbols."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.names import ascii_fold

# The constants of the ranking function and of rank fusion.
K1, B = 1.2, 0.75
FUSION_K = 60
INDEXED = ("qualified_name", "symbol_type", "file_path")
# Letters with accents that the index takes for plain ones.
_MARKS = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case without accents."""
    return F.filter(F.split(F.lower(F.translate(c, _MARKS, _PLAIN)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.translate(str.maketrans(_MARKS, _PLAIN)).lower())


def query_terms(query: str) -> list[tuple[list[tuple[str | None, str]], list[tuple[str | None, str]]]]:
    """The alternatives of a query, each (terms, terms that must not occur), a term (column or None, word).

    OR parts alternatives, NOT what must not occur; ``col:`` before a word binds it to an indexed column. Stars and quotes
    are dropped, words split at punctuation and stripped of the accents that the index strips.
    """
    import re

    clean = query.translate(str.maketrans("", "", "*\"'")).strip()
    out = []
    for part in re.split(r"\s+OR\s+", clean):
        sides: list[list[tuple[str | None, str]]] = []
        for side in re.split(r"(?:^|\s+)NOT\s+", part):
            terms = []
            for piece in side.replace(" AND ", " ").split():
                col, _, rest = piece.partition(":")
                bound = col if rest and col in INDEXED else None
                terms += [(bound, w) for w in _words(rest if bound else piece)]
            sides.append(terms)
        if sides[0]:
            out.append((sides[0], [t for side in sides[1:] for t in side]))
    return out


def _any(conditions: list) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def keyword(nodes: DataFrame, query: str, limit: int = 20, scored: bool = False) -> DataFrame:
    """(id, qualified_name, score) of nodes that have every term, the last one as a prefix, and none that is excluded; best
    first, ties by name and id.

    The score weighs a term by how rare it is and by its share of the row's words. An empty query gives no rows. One pass
    gathers the counts of the terms, a second ranks the matches.
    """
    alternatives = query_terms(query)
    bound = {c for terms, out in alternatives for c, _ in [*terms, *out] if c}
    own = nodes.select("id", "qualified_name", tokens(F.concat_ws(" ", *INDEXED)).alias("words"), *[tokens(F.col(c)).alias(f"in_{c}") for c in sorted(bound)])
    if not alternatives:
        return own.select("id", "qualified_name", F.lit(0.0).alias("score")).limit(0)
    flat = [(c, w, i == len(terms) - 1) for terms, _ in alternatives for i, (c, w) in enumerate(terms)]
    hits = [F.size(F.filter(f"in_{c}" if c else "words", (lambda w, p: (lambda t: t.startswith(w) if p else t == w))(w, p))) for c, w, p in flat]
    barred = [F.lit(False) if not out else F.lit(True) & _any([F.array_contains(f"in_{c}" if c else "words", w) for c, w in out]) for _, out in alternatives]
    counted = own.select("id", "qualified_name", F.size("words").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(hits)], *[x.alias(f"x{i}") for i, x in enumerate(barred)])
    sums = counted.agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"h{i}") > 0).alias(f"d{i}") for i in range(len(flat))]).first()
    score, at, match = F.lit(0.0), 0, F.lit(False)
    for i, (terms, _) in enumerate(alternatives):
        every = ~F.col(f"x{i}")
        for _ in terms:
            h = F.col(f"h{at}")
            weight = max(log((sums["rows"] - sums[f"d{at}"] + 0.5) / (sums[f"d{at}"] + 0.5)), 1e-6)
            score = score + weight * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("n") / (sums["mean"] or 1)))
            every, at = every & (h > 0), at + 1
        match = match | every
    found = counted.filter(match).select("id", "qualified_name", F.round(score, 6).alias("score"))
    return found.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def like(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, qualified_name) whose name holds the query, whatever the case of ASCII letters; % and _ are wildcards. The
    shortest first."""
    own = nodes.select("id", "qualified_name").filter(ascii_fold("qualified_name").like(f"%{query.lower()}%"))
    return own.orderBy(F.length("qualified_name"), "qualified_name", "id").limit(limit)


def positional(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """A short ranked list with score 1 / (1 + place), places from 0."""
    return ranked.withColumn("score", 1.0 / F.row_number().over(Window.orderBy(*order)))


def fused(*lists: DataFrame, limit: int = 10) -> DataFrame:
    """(id, score) of ranked lists (id, place from 1) by the sum of 1 / (60 + place); ties go to whom an earlier list has higher."""
    rows = None
    for i, x in enumerate(lists):
        own = x.select("id", F.col("place").cast("long").alias("place"), F.lit(i).alias("list"))
        rows = own if rows is None else rows.unionByName(own)
    score = F.round(F.sum(1.0 / (FUSION_K + F.col("place"))), 10)
    sums = rows.groupBy("id").agg(score.alias("score"), F.min(F.struct("list", "place")).alias("_first"))
    return sums.orderBy(F.desc("score"), "_first", "id").limit(limit).select("id", "score")


def hybrid(nodes: DataFrame, query: str, near: DataFrame | None, limit: int = 10) -> DataFrame:
    """Keyword hits alone by place, or fused with a ranked list (id, place) of near vectors; names joined."""
    hits = keyword(nodes, query, limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "qualified_name", "id"))
    hits = hits.select("id", place.alias("place"))
    if near is None:
        out = hits.select("id", (1.0 / F.col("place")).alias("score"))
    else:
        out = fused(hits, near, limit=limit)
    return nodes.select("id", "qualified_name").join(F.broadcast(out), "id")  # at most ``limit`` rows
