"""Queries over the parts of the stages: topics, labels, readings out of replies, neighbours, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.query_language import compile_query, with_categories
from lorebase.functions.text import arrow, direction, without_code_fence
from lorebase.operators import crawl, gates, knowledge, similarity
from lorebase.plans.catalogue import register
from lorebase.plans.pipeline import assemble_readings
from lorebase.plans.queries_knowledge import _KNN, _READINGS, latest_readings
from lorebase.tables import load

#: Words that three made-up topics ask for, in their order.
TOPIC_WORDS = ("lidar", "elevator", "memory")


@register(
    "multi_topic",
    f"""WITH found AS ({" UNION ALL ".join(f"SELECT DISTINCT arxiv_id, '{w}' AS topic, {i} AS pos FROM papers WHERE contains(lower(coalesce(title, '')), '{w}') OR contains(lower(coalesce(abstract, '')), '{w}')" for i, w in enumerate(TOPIC_WORDS))})
       SELECT arxiv_id, topic AS source_topic, CAST(pos AS INTEGER) AS topic_pos FROM found QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY pos) = 1""",
)
def multi_topic(spark: SparkSession, d: str) -> DataFrame:
    """Papers of several topics together, each under the first topic that has it."""
    papers = load(spark, d, "papers")
    low = papers.withColumns({c: F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "abstract")}).drop("source_topic")
    frames = {w: low.filter(F.contains("title", F.lit(w)) | F.contains("abstract", F.lit(w))) for w in TOPIC_WORDS}
    rows, _ = crawl.union_topics(frames)
    return crawl.keep_first(rows, F.col("topic_pos"), [F.col("created_at")]).select("arxiv_id", "source_topic", "topic_pos")


@register(
    "query_with_categories",
    """SELECT DISTINCT arxiv_id FROM papers WHERE len(list_filter(categories, lambda c: lower(trim(c)) = 'cs.ro')) > 0
         AND (contains(lower(coalesce(title, '')), 'sensor') OR contains(lower(coalesce(abstract, '')), 'sensor'))""",
)
def query_with_categories(spark: SparkSession, d: str) -> DataFrame:
    """A query that names a category already isn't restricted to others."""
    query = with_categories("cat:cs.RO AND sensor", ["cs.CV"], only_if_missing=True)
    trimmed = F.transform("categories", F.trim)
    return load(spark, d, "papers").withColumn("categories", trimmed).filter(compile_query(query)).select("arxiv_id").distinct()


@register(
    "relevance_labels",
    """SELECT arxiv_id, score, coalesce(CASE WHEN score >= 6 THEN 'RELEVANT' ELSE 'skip' END, 'skip') AS label,
         CASE WHEN score >= 6 THEN 'relevant' WHEN score >= 4 THEN 'borderline' ELSE 'skip' END AS three_way FROM relevance_verdicts""",
)
def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("score")
    return load(spark, d, "relevance_verdicts").select("arxiv_id", "score", gates.relevance_label(score).alias("label"), gates.three_way_label(score).alias("three_way"))


@register(
    "assembled_readings",
    f"""WITH {_READINGS},
       t AS (SELECT *, CASE WHEN problem_statement IS NULL THEN 'problem_statement is missing' WHEN proposed_method IS NULL THEN 'proposed_method is missing' WHEN experimental_setup IS NULL THEN 'experimental_setup is missing'
           WHEN main_results IS NULL THEN 'main_results is missing' WHEN limitations IS NULL THEN 'limitations is missing' WHEN comparison_to_prior_work IS NULL THEN 'comparison_to_prior_work is missing'
           WHEN len(list_filter(experiment_table.entries, lambda e: e.benchmark IS NULL OR e.metric IS NULL)) > 0 THEN 'an entry lacks benchmark or metric' END AS error FROM readings)
       SELECT arxiv_id, md5(problem_statement) AS problem, md5(main_results) AS results, coalesce(len(key_contributions), 0) AS n_contributions, coalesce(error, '') AS error FROM t""",
)
def assembled_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings put together from the replies of three passes, which hold what is stored."""
    rows = latest_readings(spark, d)

    def result(r: Column) -> Column:
        return F.struct(r["method_name"].alias("method"), r["value"].cast("string").alias("value"), r["is_paper_method"].alias("is_paper_method"))

    entries = F.transform("experiment_table.entries", lambda e: F.struct(*[e[c].alias(c) for c in ("benchmark", "setting", "metric", "higher_is_better")], F.transform(e["results"], result).alias("results")))
    passes = {
        "method_intro": F.struct("problem_statement", "proposed_method", "key_contributions"),
        "experiments": F.struct("experimental_setup", "main_results", entries.alias("entries"), F.col("experiment_table.details").alias("details")),
        "context": F.struct("comparison_to_prior_work", "limitations"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("pass"), F.to_json(v, {"ignoreNullFields": "false"}).alias("reply")) for k, v in passes.items()])
    replies = rows.select("arxiv_id", F.explode(each).alias("p")).select("arxiv_id", "p.pass", without_code_fence(F.concat(F.lit("```json\n"), "p.reply", F.lit("\n```"))).alias("reply"), F.lit(None).cast("string").alias("error"))
    made = assemble_readings(replies, F.current_timestamp())
    return made.select("arxiv_id", F.md5("problem_statement").alias("problem"), F.md5("main_results").alias("results"), F.size("key_contributions").cast("bigint").alias("n_contributions"), F.coalesce("error", F.lit("")).alias("error"))


@register(
    "neighbours_text",
    f"""WITH near AS ({_KNN.format(on="v.vec_id < q.vec_id")})
       SELECT vec_id AS query_id, coalesce((SELECT string_agg('[' || rank || '] document ' || near.vec_id, chr(10) || chr(10) ORDER BY rank) FROM near WHERE near.query_id = e.vec_id), 'No related work is stored yet.') AS known
       FROM embeddings e WHERE vec_id % 50 = 0""",
)
def neighbours_text(spark: SparkSession, d: str) -> DataFrame:
    """What an analyst is told of the vectors stored before each asked one."""
    rows = load(spark, d, "embeddings")
    asked = rows.filter("vec_id % 50 = 0")
    near = similarity.nearest(rows, asked, prior_only=True)
    document = F.concat(F.lit("document "), F.col("vec_id").cast("string"))
    listed = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", document.alias("d")))), lambda x: x["d"]).alias("ds"))
    told = asked.select(F.col("vec_id").alias("query_id")).join(listed, "query_id", "left")
    return told.select("query_id", knowledge.neighbours_text(F.coalesce("ds", F.array().cast("array<string>"))).alias("known"))


@register("metric_directions", "SELECT DISTINCT e.metric AS metric, CASE WHEN e.higher_is_better THEN '↑' ELSE '↓' END AS arrow, CASE WHEN e.higher_is_better THEN 'higher' ELSE 'lower' END AS better FROM (SELECT unnest(experiment_table.entries) AS e FROM deep_readings) WHERE e.metric IS NOT NULL")
def metric_directions(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "deep_readings").select(F.explode("experiment_table.entries").alias("e")).filter("e.metric IS NOT NULL")
    up = F.col("e.higher_is_better")
    return e.select(F.col("e.metric").alias("metric"), arrow(up).alias("arrow"), direction(up).alias("better")).distinct()
