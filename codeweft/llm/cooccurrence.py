"""Items that appear together: counts of pairs over baskets against what chance would give.

Items become integers in their own order first, so rows and pairs travel as numbers and are decoded at the end. They are
deduplicated per basket, ordered pairs are emitted inside the basket, counts are combined on the map side and
held against the marginals. Pairs of a basket are emitted from blocks of at most ``block`` items: a basket of many items
becomes many pairs of blocks that spread over tasks, so no task holds a large basket's pairs.

Thresholds prune before pairs are made: a pair can't be more frequent than either of its items, so items below the
support are dropped from the baskets first, which loses no pair that meets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.ranks import numbered
from codeweft.session import cut, small

#: Items of a block; a block pairs with another in at most this many squared pairs.
BLOCK = 64


def _coded(df: DataFrame, basket: str, item: Column | str) -> tuple[DataFrame, DataFrame, int]:
    """Distinct (basket, item) with items as integers in their own order, without nulls and blanks; (item, code); codes."""
    item = F.col(item) if isinstance(item, str) else item
    own = df.select(F.col(basket).alias("basket"), item.alias("item")).filter("basket is not null and item is not null and item <> ''")
    codes = cut(numbered(own.select("item").distinct(), "item", "code"))
    n = codes.count()
    return own.join(small(codes, n), "item").select("basket", F.col("code").alias("item")).distinct(), codes, n


def _blocks(items: DataFrame, block: int) -> DataFrame:
    """(basket, n_blocks, block, items) with sorted arrays; items of large baskets are spread over blocks by hash."""
    sizes = items.groupBy("basket").agg(F.count("*").alias("size"))
    large = cut(sizes.filter(F.col("size") > block).select("basket", F.ceil(2 * F.col("size") / block).cast("int").alias("n_blocks")))
    split = items.join(small(large, large.count()), "basket", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    at = F.when(F.col("n_blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("item"), F.col("n_blocks"))).cast("int")
    return split.groupBy("basket", "n_blocks", at.alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items"))


def _pairs(blocks: DataFrame) -> DataFrame:
    """(item_a, item_b) per basket and pair, item_a < item_b."""
    items = F.col("items")
    own = blocks.select(F.posexplode("items").alias("i", "item_a"), items).select(
        "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b")
    )
    # Blocks of one basket meet once: the lower number goes to every higher one, row by row, spread by both numbers.
    many = blocks.filter("n_blocks > 1")
    sent = many.select("basket", "items", F.col("block").alias("low"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("high")).filter("low < high")
    met = sent.join(many.select("basket", F.col("block").alias("high"), F.col("items").alias("others")), ["basket", "high"])
    both = met.select(F.explode("items").alias("x"), "others").select("x", F.explode("others").alias("y"))
    cross = both.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return own.unionByName(cross)


def cooccurrence(
    df: DataFrame, basket: str, item: Column | str, min_count: int = 1, min_share: tuple[int, int] = (0, 1), block: int = BLOCK
) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_ab, lift, pmi) of each pair with n_ab >= min_count and den * n_ab >= num * n.

    ``n`` is the number of distinct baskets, those without an item included; ``min_share`` is (num, den). Repeated rows
    count once; rows with a null basket, a null or an empty item make no pair. lift is n_ab * n / (n_a * n_b), pmi its
    base-2 logarithm. An empty table gives no rows.
    """
    own, codes, n_codes = _coded(df, basket, item)
    own = cut(own)
    baskets = df.select(F.col(basket).alias("basket")).filter("basket is not null").distinct().agg(F.count("*").alias("n"))
    n = baskets.first()["n"]
    num, den = min_share
    least = max(min_count, -(-num * n // den), 1)
    counts = own.groupBy("item").agg(F.count("*").alias("n_item"))
    if least > 1:
        counts = counts.filter(F.col("n_item") >= least)
    counts = cut(counts.join(small(codes, n_codes), counts["item"] == codes["code"]).select(counts["item"], codes["item"].alias("name"), "n_item"))
    n_items = counts.count()
    if least > 1:
        own = own.join(small(counts.select("item"), n_items), "item", "left_semi")
    # A pair travels as one number, the lower code in its upper half.
    pair = F.shiftleft("item_a", 32).bitwiseOR(F.col("item_b"))
    found = _pairs(_blocks(own, block)).groupBy(pair.alias("pair")).agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= least)
    for side, code in (("a", F.shiftright("pair", 32)), ("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))):
        own_side = counts.select(F.col("item").alias("_code"), F.col("name").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}"))
        found = found.join(small(own_side, n_items), code == F.col("_code")).drop("_code")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return found.select("item_a", "item_b", F.lit(n).cast("long").alias("n"), "n_a", "n_b", "n_ab", lift.alias("lift"), F.log2(lift).alias("pmi"))
