"""Schemas of the stored tables and their loaders. Columns are always taken by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = "struct<method_name:string,value:double,is_paper_method:boolean>"
ENTRY = f"struct<benchmark:string,setting:string,metric:string,higher_is_better:boolean,results:array<{RESULT}>>"
EXPERIMENT_TABLE = f"struct<arxiv_id:string,entries:array<{ENTRY}>,details:string>"

DDL: dict[str, str] = {
    "topics": "name string, query string, categories array<string>, research_profile string",
    "papers": "arxiv_id string, title string, abstract string, authors array<string>, pdf_url string, published timestamp_ntz, categories array<string>, source_topic string, created_at timestamp_ntz",
    "relevance_verdicts": "arxiv_id string, score int, justification string, key_topics array<string>, created_at timestamp_ntz",
    "deep_readings": f"arxiv_id string, problem_statement string, proposed_method string, key_contributions array<string>, experimental_setup string, main_results string, limitations string, comparison_to_prior_work string, experiment_table {EXPERIMENT_TABLE}, created_at timestamp_ntz",
    "sota_updates": "id bigint, arxiv_id string, benchmark string, action string, summary string, created_at timestamp_ntz",
    "contribution_deltas": "arxiv_id string, novel_contributions array<string>, incremental_improvements array<string>, contradicts_prior array<string>, overall_significance string, created_at timestamp_ntz",
    "pipeline_runs": "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, papers_crawled int, papers_filtered int, papers_read int, status string",
    "kb": "collection string, id string, embedding array<float>, document string, metadata struct<arxiv_id:string,title:string>",
    "leaderboard": "slug string, benchmark string, setting string, metric string, higher_is_better boolean, method string, value double, arxiv_id string, seq bigint, note string",
    "paper_removals": "arxiv_id string, removed_at timestamp_ntz, reason string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, arxiv_id string, fetched_at timestamp_ntz",
    "canonical_names": "canon_id bigint, field string, name string, short_name string",
    "mix_targets": "source string, target_share double, max_repeats int",
}

PRIMARY_KEYS = {
    "papers": ["arxiv_id"],
    "relevance_verdicts": ["arxiv_id"],
    "deep_readings": ["arxiv_id"],
    "contribution_deltas": ["arxiv_id"],
    "pipeline_runs": ["id"],
    "kb": ["collection", "id"],
}
RENAMED = {"deep_readings": {"extracted_benchmarks": "experiment_table"}}
DROPPED_TABLES = ("sota_entries",)


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(DDL[name])  # type: ignore[return-value]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; the scan prunes to what the plan uses."""
    return migrate(name, spark.read.parquet(f"{folder}/{name}.parquet"))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def migrate(name: str, df: DataFrame) -> DataFrame:
    """Renames columns of older layouts; frames of the present layout pass unchanged."""
    for old, new in RENAMED.get(name, {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows per broken rule of the table: null in a key, or a key that repeats.

    Returns (rule, n). Nothing is enforced at write time; this is the audit for it.
    """
    keys = PRIMARY_KEYS[name]
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    nulls = df.filter(null).agg(F.count("*").alias("n")).select(F.lit("null_key").alias("rule"), "n")
    repeats = df.filter(~null).groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n"))
    return nulls.unionByName(repeats.select(F.lit("repeated_key").alias("rule"), "n"))
