"""Keyed upserts as functions of (old, new); plain Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """A batch that names a key more than once counts as its rows one after the other.

    A null order is the earliest: inside a struct it is not ignored, as max_by ignores it alone.
    """
    others = [c for c in new.columns if c not in key]
    return new.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("_r")).select(*key, "_r.*").select(*new.columns)


def upsert_columns(old: DataFrame, new: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """New keys come in whole; of known keys only ``replace`` is taken from the new row."""
    o, n = old.alias("o"), new.select(*old.columns).alias("n")

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        known, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
        if c in replace:
            return F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_columns(old, new, "arxiv_id", ["title", "abstract"])


def upsert_rows(old: DataFrame, new: DataFrame, key: str = "arxiv_id", first: str = "created_at") -> DataFrame:
    """New rows replace those of the same key, but ``first`` keeps the value first stored."""
    return upsert_columns(old, new, key, [c for c in old.columns if c not in (key, first)])


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert_rows, by (collection, id); empty documents change nothing."""
    fresh = new.filter(F.length("document") > 0)
    return old.join(fresh.select("collection", "id"), ["collection", "id"], "left_anti").unionByName(fresh)


def upsert_documents(old: DataFrame, documents: DataFrame) -> DataFrame:
    """upsert_vectors for documents that have no vector yet: a document that is stored unchanged
    keeps its vector, a new or changed one has none until it is embedded."""
    known = old.groupBy("collection", "id", "document").agg(F.max("embedding").alias("embedding"))
    return upsert_vectors(old, documents.join(known, ["collection", "id", "document"], "left").select(*old.columns))


def log_updates(updates: DataFrame, run: int | None = None) -> DataFrame:
    """Audit rows to append; with a run, one row per (paper, benchmark, summary, run)."""
    if run is None:
        return updates
    return updates.withColumn("run_id", F.lit(run)).dropDuplicates(["arxiv_id", "benchmark", "summary", "run_id"])


def start_run(runs: DataFrame, at: Column) -> DataFrame:
    """The runs with one more, of status ``running``; its id is one above the largest."""
    fresh = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", at.alias("started_at"), *[F.lit(None).cast(dict(runs.dtypes)[c]).alias(c) for c in ("finished_at", "papers_crawled", "papers_filtered", "papers_read")], F.lit("running").alias("status")
    )
    return runs.unionByName(fresh)


def finish_run(runs: DataFrame, run: int, at: Column, crawled: int, filtered: int, read: int, status: str = "completed") -> DataFrame:
    mine = F.col("id") == run
    values = {"finished_at": at, "papers_crawled": F.lit(crawled), "papers_filtered": F.lit(filtered), "papers_read": F.lit(read), "status": F.lit(status)}
    return runs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()})
