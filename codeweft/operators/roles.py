"""Structural tags of nodes, and the roles that they inherit along the hierarchy."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.arrays import has_tag, same_set, tags
from codeweft.session import cut, small

# Directories that tell a layer, name parts that tell a role, files that are entry points.
LAYERS = {"layer:data": ("db", "repository"), "layer:api": ("server", "api"), "layer:core": ("indexer", "engine"), "layer:utility": ("utils", "shared"), "layer:domain": ("types", "domain")}
ROLES = {"role:repository": "repo", "role:service": "service", "role:controller": "controller", "role:parser": "parser", "role:server": "server", "role:utility": "util"}
#: Links that one task may finish.
LOCAL_LINKS = 250_000
ENTRY_FILES = r"(main|bootstrap|index)\.ts$"


def structural_tags(known: Column | str = "tags") -> Column:
    """The tags of a node row, those it has first: layer by directory, role by the part of its name after the last ``#``,
    traits by type, modifiers, flags and visibility. Null fields tell nothing."""
    parts = F.split(F.lower(F.replace("file_path", F.lit("\\"), F.lit("/"))), "/")
    symbol = F.substring_index("qualified_name", "#", -1)
    low = F.lower(symbol)
    tell = [F.when(F.arrays_overlap(parts, F.array(*map(F.lit, dirs))), F.lit(tag)) for tag, dirs in LAYERS.items()]
    tell += [F.when(low.contains(part), F.lit(tag)) for tag, part in ROLES.items()]
    modifiers = F.coalesce("modifiers", F.array().cast("array<string>"))
    said = lambda word: F.exists(modifiers, lambda m: F.lower(m).contains(word))
    hidden = F.col("visibility").isin("private", "protected") | symbol.startswith("_")
    tell += [
        F.when((F.col("symbol_type") == "interface") | said("abstract"), F.lit("trait:abstract")),
        F.when(said("static"), F.lit("trait:static")),
        F.when(F.col("is_generated"), F.lit("trait:generated")),
        F.when(F.coalesce("remote_project_path", F.lit("")) != "", F.lit("trait:external")),
        F.when(hidden, F.lit("trait:internal")).when((F.col("visibility") == "public") | symbol.rlike("^[A-Z]"), F.lit("trait:public")),
        F.when((F.col("symbol_type") == "file") & F.lower("file_path").rlike(ENTRY_FILES), F.lit("trait:entrypoint")),
    ]
    return F.array_distinct(F.concat(tags(known), F.array_compact(F.array(*tell))))


def merge_roles(own: Column, parent: Column) -> Column:
    """A node's tags with its parents' roles added.

    An internal node takes none. ``role:utility`` gives way to every other role, its own or an inherited one, and is
    inherited only where there is no other.
    """
    own, parent = tags(own), tags(parent)
    is_role = lambda t: t.startswith("role:")
    other = F.filter(F.array_except(F.filter(parent, is_role), own), lambda t: t != "role:utility")
    utility = F.lit("role:utility")
    kept = F.when(F.size(other) > 0, F.filter(own, lambda t: t != "role:utility")).otherwise(own)
    bare = (F.size(other) == 0) & ~F.exists(own, is_role) & F.array_contains(parent, utility)
    merged = F.concat(kept, other, F.when(bare, F.array(utility)).otherwise(F.array().cast("array<string>")))
    return F.when(F.array_contains(own, "trait:internal"), own).otherwise(merged)


def _finish(_: tuple, links: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The fixpoint over few links, in one task, by the rule of ``merge_roles``."""
    tag = {i: list(t) for i, t in zip(state["id"], state["tags"])}
    children: dict[int, list[int]] = {}
    for i, p in zip(links["id"], links["parent"]):
        children.setdefault(p, []).append(i)
    todo = list(children)
    while todo:
        p = todo.pop()
        roles = [t for t in tag.get(p, ()) if t.startswith("role:")]
        for i in children.get(p, ()) if roles else ():
            own = tag.get(i)
            if own is None or "trait:internal" in own:
                continue
            other = [t for t in roles if t != "role:utility" and t not in own]
            if other:
                tag[i] = [t for t in own if t != "role:utility"] + other
            elif "role:utility" in roles and not any(t.startswith("role:") for t in own):
                tag[i] = [*own, "role:utility"]
            else:
                continue
            todo.append(i)
    return pd.DataFrame({"id": list(tag), "tags": list(tag.values())})


def inherited(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, tags) after every node has taken the roles of what it inherits from or implements, until none changes.

    Roles only spread, so loops end. Nodes without such a link are left alone. Up to ``local_links`` links (counted) are
    finished by one task; beyond, rounds are distributed: in each only children of nodes that changed in the last one are
    looked at, and the roles of all parents of a node are merged in one grouping. Chains may be of any length; roles that
    still spread after ``rounds`` distributed rounds, if given, are an error.
    """
    links = edges.filter(F.col("edge_type").isin("inherits", "implements") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    links = cut(links.select(F.col("from_id").alias("id"), F.col("to_id").alias("parent")).distinct())
    every = cut(nodes.select("id", tags().alias("tags")))
    n = links.count()
    ends = links.select(F.explode(F.array("id", "parent")).alias("id")).distinct()
    state = cut(every.join(small(ends, 2 * n), "id", "left_semi"))
    aside = every.join(small(ends, 2 * n), "id", "left_anti")
    if n <= local_links:
        one = F.lit(0).alias("_one")
        done = links.groupBy(one).cogroup(state.groupBy(one)).applyInPandas(_finish, "id long, tags array<string>")
        return aside.unionByName(done)
    changed = state
    for turn in count():
        if turn == rounds:
            raise ValueError(f"roles still spread after {rounds} rounds")
        sent = links.join(changed.select(F.col("id").alias("parent"), F.filter("tags", lambda t: t.startswith("role:")).alias("roles")), "parent")
        heard = sent.filter(F.size("roles") > 0).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"))
        new = state.join(heard, "id", "left").withColumn("_new", F.when(F.col("roles").isNotNull(), merge_roles(F.col("tags"), F.col("roles"))).otherwise(F.col("tags")))
        new = cut(new.select("id", F.col("_new").alias("tags"), (~same_set(F.col("_new"), F.col("tags"))).alias("_moved")))
        state = new.select("id", "tags")
        changed = new.filter("_moved").select("id", "tags")
        if changed.isEmpty():
            break
    return aside.unionByName(state)


def retagged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, tags) whose tags change when structural tags are set anew and roles inherited."""
    fresh = nodes.withColumn("tags", structural_tags())
    return inherited(fresh, edges).join(nodes.select("id", F.col("tags").alias("_old")), "id").filter(~same_set(tags("tags"), tags("_old"))).select("id", "tags")


def internal() -> Column:
    return has_tag("tags", "trait:internal")
