"""Items that occur together more often than chance, by collapsing equal baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import WHITE, strip


def normal_item(item: Column) -> Column:
    """Lower case, runs of white space, hyphens and underscores as one space, no outer spaces."""
    return strip(F.regexp_replace(F.lower(item), rf"[{WHITE}_-]+", " "))


def latest_per_key(df: DataFrame, key: Column, moment: str, items: str) -> DataFrame:
    """(items) of each key's row with the latest moment; null is earliest, null keys are left out.

    An aggregate with partial results, not a window: a key that a third of all rows share never
    meets in one task. Rows of the same latest moment: the largest array is taken.
    """
    one = df.select(key.alias("k"), F.struct(F.col(moment).alias("m"), F.col(items).alias("items")).alias("r"))
    return one.filter(F.col("k").isNotNull()).groupBy("k").agg(F.max("r").alias("r")).select("r.items")


def baskets(records: DataFrame, items: str = "items") -> DataFrame:
    """Distinct baskets with their weight: (basket, w). One row per record goes in.

    An item counts once in a record; null and empty items go, and records without an item.
    """
    kept = F.filter(F.transform(F.col(items), normal_item), lambda x: x.isNotNull() & (F.length(x) > 0))
    return (
        records.select(F.array_sort(F.array_distinct(kept)).alias("basket"))
        .filter(F.size("basket") > 0)
        .groupBy("basket")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def pair_counts(weighted: DataFrame, min_support: int = 1) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n) of all pairs with n_both >= min_support, a < b.

    Pairs are enumerated once per distinct basket and carry its weight; before that, items that
    are themselves rarer than min_support leave the baskets, since no pair of theirs can reach
    it. Pair rows are summed on the map side first, so a frequent pair is one row per task.
    """
    long = weighted.select("basket", "w", F.explode("basket").alias("item"))
    support = long.groupBy("item").agg(F.sum("w").alias("c")).filter(F.col("c") >= min_support)
    total = weighted.agg(F.sum("w").alias("n"))
    if min_support > 1:
        slim = (
            long.join(support.select("item"), "item", "left_semi")
            .groupBy("basket", "w")
            .agg(F.array_sort(F.collect_list("item")).alias("kept"))
            .select(F.col("kept").alias("basket"), "w")
            .groupBy("basket")
            .agg(F.sum("w").alias("w"))
        )
    else:
        slim = weighted
    first = slim.filter(F.size("basket") > 1).select("w", F.posexplode("basket").alias("i", "item_a"), "basket")
    both = first.select("w", "item_a", F.explode(F.slice("basket", F.col("i") + 2, F.size("basket"))).alias("item_b"))
    pairs = both.groupBy("item_a", "item_b").agg(F.sum("w").alias("n_both")).filter(F.col("n_both") >= min_support)
    a = support.select(F.col("item").alias("item_a"), F.col("c").alias("n_a"))
    b = support.select(F.col("item").alias("item_b"), F.col("c").alias("n_b"))
    # one row: the only side that is joined without a key
    return pairs.join(a, "item_a").join(b, "item_b").join(F.broadcast(total))


def scored(counts: DataFrame) -> DataFrame:
    """Adds lift and, both ways, conviction; conviction is null where the rule never fails."""
    n = F.col("n").cast("double")

    def conviction(given: str, then: str) -> Column:
        miss = F.col(given) - F.col("n_both")
        return F.when(miss > 0, (F.col(given) * (F.col("n") - F.col(then))).cast("double") / (n * miss))

    return counts.select(
        "*",
        ((F.col("n_both") * F.col("n")).cast("double") / (F.col("n_a") * F.col("n_b")).cast("double")).alias("lift"),
        conviction("n_a", "n_b").alias("conviction_ab"),
        conviction("n_b", "n_a").alias("conviction_ba"),
    )


def frequent_pairs(records: DataFrame, items: str = "items", min_support: int = 5, min_lift: int = 4) -> DataFrame:
    """Pairs that occur in min_support records and min_lift times as often as chance has it.

    Returns the columns of ``scored``. The lift test is done in whole numbers, n_both * n >=
    min_lift * n_a * n_b, so no rounding decides.

    Nulls: null arrays, null and empty items count for nothing. Repeated items in a record
    count once; equal records count each. Ties need no rule, all pairs come out. Empty tables
    give no rows. Long baskets are enumerated as a stream, never held as pairs.
    """
    counts = pair_counts(baskets(records, items), min_support)
    return scored(counts.filter(F.col("n_both") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")))
