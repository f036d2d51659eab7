"""Which records a stage still has to process, and small look-ups.

Every gate is an explicit left anti-join: Catalyst keeps ``LEFT JOIN ... IS NULL`` as an outer
join with a filter, while the anti-join stops at the first match and needs the key column only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "arxiv_id"
THRESHOLD = 6


def unfiltered(papers: DataFrame, verdicts: DataFrame, key: str = KEY) -> DataFrame:
    """Papers without a verdict."""
    return papers.join(verdicts.select(key), key, "left_anti")


def relevant(verdicts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return verdicts.filter(F.col("score") >= threshold)


def unread_relevant(verdicts: DataFrame, readings: DataFrame, threshold: int = THRESHOLD, key: str = KEY) -> DataFrame:
    """Verdicts at or above the threshold whose paper has no reading."""
    return relevant(verdicts, threshold).join(readings.select(key), key, "left_anti")


def unanalysed(readings: DataFrame, deltas: DataFrame, key: str = KEY) -> DataFrame:
    return readings.join(deltas.select(key), key, "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """The rows whose key is in a list of any length; an empty list gives none."""
    return rows.join(ids.select(key), key, "left_semi")


def by_id(rows: DataFrame, value: object, key: str = KEY) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value))


def fetch_or_error(ids: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """One row per asked id; an ``error`` text where nothing is stored under it."""
    known = rows.dropDuplicates([key]).withColumn("_known", F.lit(True))
    joined = ids.select(key).distinct().join(known, key, "left")
    missing = F.when(F.col("_known").isNull(), F.concat(F.lit("Paper "), F.col(key), F.lit(" not found")))
    return joined.withColumn("error", missing).drop("_known")


def with_topic(papers: DataFrame, topics: DataFrame, position: Column | None = None) -> DataFrame:
    """Papers with their topic's profile; of topics of one name the last counts, and papers whose
    topic is unknown or has no profile are left out."""
    order = F.monotonically_increasing_id() if position is None else position
    placed = topics.select("name", "research_profile", order.alias("_at"))
    last = placed.groupBy("name").agg(F.max_by("research_profile", "_at").alias("research_profile"))
    usable = last.filter(F.length("research_profile") > 0)
    return papers.join(usable, papers["source_topic"] == usable["name"]).drop("name")


def relevance_label(score: Column, threshold: int = THRESHOLD) -> Column:
    return F.when(score >= threshold, "RELEVANT").otherwise("skip")


def three_way_label(score: Column, threshold: int = THRESHOLD, borderline: int | None = None) -> Column:
    """relevant, borderline or skip; the borderline begins two below the threshold, at 2 at least."""
    low = max(threshold - 2, 2) if borderline is None else borderline
    return F.when(score >= threshold, "relevant").when(score >= low, "borderline").otherwise("skip")


def relevance_band(score: Column) -> Column:
    """The band of a score from 0 to 10; scores outside, and null, have none."""
    return (
        F.when(score.between(9, 10), "9-10").when(score.between(7, 8), "7-8").when(score.between(5, 6), "5-6")
        .when(score.between(3, 4), "3-4").when(score.between(0, 2), "0-2")
    )


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total to be reproducible.

    row_number() <= 1 lets Catalyst put a WindowGroupLimit below the exchange, so each task sends
    one row per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
