"""Knowledge-base documents of readings, counts, and texts built from lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import bulleted

COLLECTIONS = ("paper_contributions", "paper_methods", "research_context")


def documents_of(readings: DataFrame, papers: DataFrame) -> DataFrame:
    """(collection, id, document, metadata): three documents a reading; empty parts give none.

    ``stack`` makes the three rows in one pass over the readings.
    """
    titled = readings.select("arxiv_id", "key_contributions", "proposed_method", "comparison_to_prior_work").join(
        papers.groupBy("arxiv_id").agg(F.max_by("title", F.struct("created_at")).alias("title")), "arxiv_id"
    )
    head = F.concat(F.lit("Paper: "), F.col("title"), F.lit("\n"))
    made = titled.select(
        "arxiv_id", "title",
        F.when(F.size("key_contributions") > 0, F.concat(head, F.lit("Contributions:\n"), bulleted(F.col("key_contributions")))).alias("c"),
        F.when(F.length("proposed_method") > 0, F.concat(head, F.lit("Method: "), "proposed_method")).alias("m"),
        F.when(F.length("comparison_to_prior_work") > 0, F.concat(head, F.lit("Context: "), "comparison_to_prior_work")).alias("x"),
    )
    a, b, c = COLLECTIONS
    rows = made.selectExpr("arxiv_id", "title", f"stack(3, '{a}', c, '{b}', m, '{c}', x) AS (collection, document)").filter("document IS NOT NULL")
    return rows.select("collection", F.col("arxiv_id").alias("id"), "document", F.struct("arxiv_id", "title").alias("metadata"))


def query_text(title: Column, problem: Column, method: Column) -> Column:
    """What a reading asks the knowledge base with."""
    return F.concat_ws(" ", title, problem, method)


def neighbours_text(documents: Column) -> Column:
    """Neighbours as a numbered list, or a sentence if there are none."""
    listed = F.array_join(F.transform(documents, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n\n")
    return F.when(F.size(documents) > 0, listed).otherwise("No related work is stored yet.")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table; every count is its own tiny aggregate."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    long = reduce(DataFrame.unionByName, parts)
    return long.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])
