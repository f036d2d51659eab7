"""Crawling as queries over a feed of papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import clip, id_of_address, strip
from lorebase.operators.gates import first_of_each, top_of_each


def from_feed(feed: DataFrame) -> DataFrame:
    """Feed entries as papers: the id out of the address, texts without outer white space."""
    return feed.withColumns(
        {"arxiv_id": id_of_address(F.col("entry_id")), "title": strip(F.col("title")), "abstract": strip(F.col("abstract"))}
    )


def newest_per_topic(papers: DataFrame, k: int, as_of: Column, days: int, topic: str = "source_topic", moment: str = "published", key: str = "arxiv_id") -> DataFrame:
    """The k newest papers of each topic that are at most ``days`` old; exactly so old still counts.

    The age is tested before the ranking: any paper young enough ranks above any that isn't, so
    the result is the same and the ranking sees fewer rows.
    """
    young = papers.filter(F.col(moment) >= as_of - F.make_dt_interval(F.lit(days)))
    return top_of_each(young, [topic], [F.col(moment).desc(), F.col(key), F.col("created_at")], k)


def keep_first(papers: DataFrame, topic_position: Column, within: list[Column], key: str = "arxiv_id") -> DataFrame:
    """One row per id: that of the earliest topic, then of the given order."""
    return first_of_each(papers, [key], [topic_position, *within])


def union_topics(frames: dict[str, DataFrame], failed: dict[str, str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All topics' papers with their topic's position; topics that failed are reported, not fatal."""
    if not frames:
        raise ValueError("no topic could be read")
    parts = [df.withColumns({"source_topic": F.lit(name), "topic_pos": F.lit(i)}) for i, (name, df) in enumerate(frames.items())]
    return reduce(DataFrame.unionByName, parts), sorted((failed or {}).items())


def search(papers: DataFrame, predicate: Column, score: Column, k: int = 10) -> DataFrame:
    """The k best matches with a clipped abstract, five authors and the date."""
    return (
        papers.filter(predicate)
        .withColumn("score", score)
        .orderBy(F.col("score").desc(), "arxiv_id", "title")
        .limit(k)
        .select(
            "arxiv_id", "title", clip(F.col("abstract"), 500).alias("abstract"), F.slice("authors", 1, 5).alias("authors"),
            F.date_format("published", "yyyy-MM-dd").alias("published"), "score",
        )
    )
