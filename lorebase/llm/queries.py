"""The queries of the operators for training data: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.canon import map_to_list
from lorebase.llm.cooccur import frequent_pairs, latest_per_key
from lorebase.llm.mixing import mix, shares
from lorebase.llm.names import link_variants, variant_pairs
from lorebase.llm.neardup import all_pairs, near_duplicates
from lorebase.llm.spam import score_pages, spam_pages
from lorebase.llm.tokenise import encode
from lorebase.functions.text import is_blank
from lorebase.operators.references import bare_paper_id
from lorebase.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = latest_per_key(
        load(spark, folder, "relevance_verdicts"), bare_paper_id(F.col("arxiv_id")), "created_at", "key_topics"
    )
    papers = latest_per_key(load(spark, folder, "papers"), F.col("arxiv_id"), "created_at", "categories")
    topics = frequent_pairs(verdicts).select(F.lit("key_topics").alias("field"), "*")
    return topics.unionByName(frequent_pairs(papers).select(F.lit("categories").alias("field"), "*"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("field", "item_a", "item_b")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def typed_values(spark: SparkSession, folder: str) -> DataFrame:
    """(source_table, record_key, field, raw_value) of method names and benchmarks."""
    entry = F.explode("experiment_table.entries").alias("e")
    methods = (
        load(spark, folder, "deep_readings")
        .select("arxiv_id", entry)
        .select("arxiv_id", F.explode("e.results.method_name").alias("raw_value"))
        .select(F.lit("deep_readings").alias("source_table"), F.col("arxiv_id").alias("record_key"), F.lit("method_name").alias("field"), "raw_value")
    )
    benchmarks = load(spark, folder, "sota_updates").select(
        F.lit("sota_updates").alias("source_table"), F.col("id").cast("string").alias("record_key"), F.lit("benchmark").alias("field"), F.col("benchmark").alias("raw_value")
    )
    return methods.unionByName(benchmarks)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_to_list(typed_values(spark, folder), load(spark, folder, "canonical_names"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that stand for no entry, with the number of records that hold them."""
    none = p3_found(spark, folder).filter("canon_id = 0")
    return none.groupBy("source_table", "raw_value").agg(F.count(F.lit(1)).alias("n_records"))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the least spelling of the same person or group."""
    return link_variants(load(spark, folder, "papers").select(F.explode("authors").alias("name")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(p4_entities(spark, folder))


def paper_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(arxiv_id, text): title, a space and abstract of each paper's latest row; left out if
    either is null or blank there. Rows of the same latest moment: the largest title and
    abstract count."""
    latest = F.max(F.struct("created_at", "title", "abstract")).alias("r")
    rows = load(spark, folder, "papers").groupBy("arxiv_id").agg(latest)
    kept = rows.filter(~is_blank(F.col("r.title")) & ~is_blank(F.col("r.abstract")))
    return kept.select("arxiv_id", F.concat_ws(" ", "r.title", "r.abstract").alias("text"))


def _paper_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(paper_texts(spark, folder), "arxiv_id", "text", n=3, threshold=0.5)


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of representatives of different texts, with their similarity."""
    return _paper_links(spark, folder)[0]


def p5_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper with the representative of the papers that have its set of shingles."""
    return _paper_links(spark, folder)[1]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs, an expansion of p5_links and p5_members."""
    return all_pairs(*_paper_links(spark, folder), "arxiv_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(load(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their number of copies. The mix is as large as the listed
    sources: no text is given up for the shares, small sources stay at their repeats and short."""
    return mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"), total_tokens="listed_tokens")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source of mix_targets, in p7_mix."""
    return shares(p7_mix(spark, folder), load(spark, folder, "mix_targets"))


def p7_mix_exact(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_mix, but the largest mix in which every source that has documents reaches its target."""
    return mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))


def p7_shares_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source of mix_targets, in p7_mix_exact."""
    return shares(p7_mix_exact(spark, folder), load(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(load(spark, folder, "documents"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_pages(load(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_members": p5_members,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_mix_exact": p7_mix_exact,
    "p7_shares_exact": p7_shares_exact,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}
