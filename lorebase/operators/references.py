"""References to records that do not exist, or that came later than the reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import strip


def bare_paper_id(raw: Column) -> Column:
    """Paper id without outer white space, letter case, ``arXiv:`` prefix and address.

    The address goes up to and including the last ``/abs/``. The version stays. Null stays null.
    """
    text = F.regexp_replace(F.lower(strip(raw)), r"(?s)^.*/abs/", "")
    return strip(F.regexp_replace(strip(text), r"^arxiv:", ""))


def period_of(moment: Column, pattern: str = "yyyy-MM") -> Column:
    """The period's label, ``none`` for null."""
    return F.coalesce(F.date_format(moment, pattern), F.lit("none"))


def orphan_references(
    children: dict[str, DataFrame],
    parents: DataFrame,
    removed: DataFrame,
    key: str = "arxiv_id",
    moment: str = "created_at",
    period: str = "yyyy-MM",
) -> DataFrame:
    """Every reference to a parent that is missing, deleted or late: one row per distinct case.

    Returns (source_table, <key>, period, kind, n_rows); kind is ``deleted`` (absent, but in
    ``removed``), ``missing`` (in neither) or ``late`` (the reference's moment is strictly before
    the parent's earliest). n_rows counts the child rows of the key in the period; a late case
    needs only one of them to be late.

    The children are brought down to (table, key, period) with the earliest moment and a count
    before any join: a key that a third of all rows name is then as many rows as it has periods,
    so no join partition is hot. The anti-join runs on the distinct keys alone and its result is
    joined back. No side is forced to be broadcast, so parents of any size work.

    Nulls: null child keys are not references and are left out; null parent or removed keys
    match nothing. A null moment gives the period ``none`` and is never late; a parent with
    only null moments makes nothing late. An empty text is a key like any other. Empty children
    give no rows; empty parents make every reference missing or deleted. Repeated rows only
    raise n_rows. Further columns, also of clashing names, are dropped before any join.
    """
    if not children:
        raise ValueError("children is empty")
    rows = reduce(
        DataFrame.unionByName,
        (
            df.select(F.lit(name).alias("source_table"), bare_paper_id(F.col(key)).alias("ref"), F.col(moment).alias("at"))
            for name, df in children.items()
        ),
    )
    refs = (
        rows.filter(F.col("ref").isNotNull())
        .groupBy("source_table", "ref", period_of(F.col("at"), period).alias("period"))
        .agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n_rows"))
    )
    known = (
        parents.select(bare_paper_id(F.col(key)).alias("ref"), F.col(moment).alias("seen"))
        .filter(F.col("ref").isNotNull())
        .groupBy("ref")
        .agg(F.min("seen").alias("first_seen"))
    )
    gone = removed.select(bare_paper_id(F.col(key)).alias("ref")).filter(F.col("ref").isNotNull()).distinct()

    absent = refs.select("ref").distinct().join(known.select("ref"), "ref", "left_anti")
    kinds = absent.join(gone.withColumn("gone", F.lit(True)), "ref", "left").select(
        "ref", F.when(F.col("gone"), "deleted").otherwise("missing").alias("kind")
    )
    late = refs.join(known, "ref").filter(F.col("earliest") < F.col("first_seen"))
    out = [F.col("source_table"), F.col("ref").alias(key), F.col("period"), F.col("kind"), F.col("n_rows")]
    return refs.join(kinds, "ref").select(*out).unionByName(late.withColumn("kind", F.lit("late")).select(*out))


def orphan_report(cases: DataFrame) -> DataFrame:
    """Counts per table, period and kind: distinct references and the rows behind them."""
    return cases.groupBy("source_table", "period", "kind").agg(
        F.count(F.lit(1)).alias("n_references"), F.sum("n_rows").alias("n_rows")
    )
