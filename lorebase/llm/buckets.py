"""Pairs within buckets of any size, in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a bucket that are paired in one block; larger buckets are split into blocks.
BLOCK = 1024


def crowded_members(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, id, ..., parts, part) of the rows (key, id, ...) whose key has two rows or more.

    A bucket has ceil(rows / block) parts; a row's part is a hash of its id.
    """
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    return keys.join(crowded, "key").select(
        *keys.columns, parts.alias("parts"), F.pmod(F.xxhash64("id", "key"), parts).cast("int").alias("part")
    )


def bucket_pairs(members: DataFrame, carried: list[str], near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b, distinct: members of a bucket for which ``near`` holds.

    Each pair of a bucket's parts is a join key of its own, so no task meets a large bucket.
    ``near(x, y)`` gets functions from a carried column's name to the side's column; it is part
    of the join's condition, so a rejected pair never is a row.
    """
    left = members.select("key", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"), "id", *carried)
    right = members.select("key", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("part"), F.col("part").alias("other"), "id", *carried)
    x, y = left.alias("x"), right.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.other") == F.col("y.other"))
    on = on & ((F.col("x.part") != F.col("x.other")) | (F.col("x.id") < F.col("y.id")))
    if near is not None:
        on = on & near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    return x.join(y, on).select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b")).distinct()


def role_pairs(
    keys: DataFrame, role: str, carried: list[str], near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], block: int = BLOCK
) -> DataFrame:
    """(id_a, id_b), id_a < id_b, distinct: rows (key, id, role, ...) of one key, at least one of
    which has the role, for which ``near`` holds.

    Pairs of rows without the role are never made, so a key under which many rows have it not
    costs no more than its rows times those that have it. Both sides are cut into parts by a
    hash of the id, each pair of parts is a join key of its own.
    """
    some = keys.groupBy("key").agg(F.count_if(role).alias("n"), F.count(F.lit(1)).alias("all")).filter("n > 0 AND all > 1")
    one, other = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("all") / block).cast("int")
    mark = F.xxhash64("id", "key")
    rows = keys.join(some, "key").select(*keys.columns, one.alias("one"), other.alias("other"), mark.alias("h"))
    kept = ["key", "id", role, *carried]
    left = rows.filter(role).select(*kept, F.pmod("h", "one").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias("q"))
    right = rows.select(*kept, F.explode(F.sequence(F.lit(0), F.col("one") - 1)).alias("p"), F.pmod("h", "other").cast("int").alias("q"))
    x, y = left.alias("x"), right.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    on = on & (F.col("x.id") != F.col("y.id")) & (~F.col(f"y.{role}") | (F.col("x.id") < F.col("y.id")))
    on = on & near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    return x.join(y, on).select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b")).distinct()
