"""Queries over papers, verdicts, readings, updates and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.query_language import compile_query, match_score, with_categories
from lorebase.functions.text import slug
from lorebase.operators import crawl, experiments, gates, knowledge, leaderboard, similarity, upsert
from lorebase.plans.catalogue import register
from lorebase.plans.queries_references import sql_strip
from lorebase.tables import empty, load, violations

STAMP, SQL_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"
LATEST = "created_at DESC NULLS LAST"


def stamp(c: str) -> Column:
    return F.date_format(c, STAMP)


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# --- gates and look-ups ----------------------------------------------------------------------


@register("gate_unfiltered", "SELECT DISTINCT arxiv_id, title FROM papers p WHERE NOT EXISTS (SELECT 1 FROM relevance_verdicts v WHERE v.arxiv_id = p.arxiv_id)")
def gate_unfiltered(spark: SparkSession, d: str) -> DataFrame:
    return gates.unfiltered(load(spark, d, "papers"), load(spark, d, "relevance_verdicts")).select("arxiv_id", "title").distinct()


@register(
    "gate_unfiltered_newest",
    """WITH open AS (SELECT DISTINCT arxiv_id, title, source_topic, published FROM papers p WHERE source_topic IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM relevance_verdicts v WHERE v.arxiv_id = p.arxiv_id))
       SELECT * EXCLUDE (published) FROM (SELECT *, row_number() OVER (PARTITION BY source_topic ORDER BY published DESC NULLS LAST, arxiv_id, title) AS rank FROM open) WHERE rank <= 20""",
)
def gate_unfiltered_newest(spark: SparkSession, d: str) -> DataFrame:
    open_ = gates.unfiltered(load(spark, d, "papers"), load(spark, d, "relevance_verdicts"))
    rows = open_.filter("source_topic IS NOT NULL").select("arxiv_id", "title", "source_topic", "published").distinct()
    return gates.top_of_each(rows, ["source_topic"], [F.col("published").desc_nulls_last(), F.col("arxiv_id"), F.col("title")], 20).drop("published")


@register(
    "gate_unread_relevant",
    "SELECT DISTINCT arxiv_id, score FROM relevance_verdicts v WHERE score >= 6 AND arxiv_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM deep_readings r WHERE r.arxiv_id = v.arxiv_id)",
)
def gate_unread_relevant(spark: SparkSession, d: str) -> DataFrame:
    rows = gates.unread_relevant(load(spark, d, "relevance_verdicts"), load(spark, d, "deep_readings"))
    return rows.filter("arxiv_id IS NOT NULL").select("arxiv_id", "score").distinct()


@register("gate_unanalysed", "SELECT DISTINCT arxiv_id FROM deep_readings r WHERE NOT EXISTS (SELECT 1 FROM sota_updates u WHERE u.arxiv_id = r.arxiv_id)")
def gate_unanalysed(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows stand in for analyses, which the data has no table of."""
    return gates.unanalysed(load(spark, d, "deep_readings"), load(spark, d, "sota_updates")).select("arxiv_id").distinct()


@register("lookup_by_ids", "SELECT DISTINCT arxiv_id, title FROM papers WHERE arxiv_id IN (SELECT arxiv_id FROM deep_readings)")
def lookup_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return gates.by_ids(load(spark, d, "papers"), load(spark, d, "deep_readings")).select("arxiv_id", "title").distinct()


@register("point_lookup", "SELECT arxiv_id, title FROM papers WHERE arxiv_id = (SELECT min(arxiv_id) FROM papers)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers")
    return gates.by_id(papers, papers.agg(F.min("arxiv_id")).first()[0]).select("arxiv_id", "title")


@register(
    "fetch_or_error",
    """SELECT DISTINCT r.arxiv_id, CASE WHEN p.arxiv_id IS NULL THEN 'Paper ' || r.arxiv_id || ' not found' END AS error
       FROM paper_removals r LEFT JOIN papers p USING (arxiv_id)""",
)
def fetch_or_error(spark: SparkSession, d: str) -> DataFrame:
    return gates.fetch_or_error(load(spark, d, "paper_removals"), load(spark, d, "papers").select("arxiv_id", "title")).select("arxiv_id", "error")


@register(
    "topic_join_profile",
    "SELECT arxiv_id, source_topic, md5(research_profile) AS profile, count(*) AS n FROM papers JOIN topics ON source_topic = name WHERE length(research_profile) > 0 GROUP BY 1, 2, 3",
)
def topic_join_profile(spark: SparkSession, d: str) -> DataFrame:
    both = gates.with_topic(load(spark, d, "papers"), load(spark, d, "topics"))
    return both.groupBy("arxiv_id", "source_topic", F.md5("research_profile").alias("profile")).agg(F.count("*").alias("n"))


@register(
    "relevance_bands",
    """SELECT CASE WHEN score BETWEEN 9 AND 10 THEN '9-10' WHEN score BETWEEN 7 AND 8 THEN '7-8' WHEN score BETWEEN 5 AND 6 THEN '5-6' WHEN score BETWEEN 3 AND 4 THEN '3-4' WHEN score BETWEEN 0 AND 2 THEN '0-2' END AS band,
       CASE WHEN score >= 6 THEN 'RELEVANT' ELSE 'skip' END AS label, CASE WHEN score >= 6 THEN 'relevant' WHEN score >= 4 THEN 'borderline' ELSE 'skip' END AS three_way, count(*) AS n
       FROM relevance_verdicts GROUP BY 1, 2, 3""",
)
def relevance_bands(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    keys = [gates.relevance_band(s).alias("band"), gates.relevance_label(s).alias("label"), gates.three_way_label(s).alias("three_way")]
    return load(spark, d, "relevance_verdicts").groupBy(*keys).agg(F.count("*").alias("n"))


@register("stats_counts", "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in ("papers", "relevance_verdicts", "deep_readings", "sota_updates")))
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.counts({t: load(spark, d, t) for t in ("papers", "relevance_verdicts", "deep_readings", "sota_updates")})


@register(
    "key_violations",
    """SELECT 'null_key' AS rule, count(*) AS n FROM relevance_verdicts WHERE arxiv_id IS NULL
       UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT arxiv_id FROM relevance_verdicts WHERE arxiv_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""",
)
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    return violations(load(spark, d, "relevance_verdicts"), "relevance_verdicts")


# --- crawling --------------------------------------------------------------------------------


@register(
    "crawl_topk_lookback",
    """WITH t AS (SELECT DISTINCT arxiv_id, source_topic, published, created_at FROM papers WHERE source_topic IS NOT NULL)
       SELECT arxiv_id, source_topic, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY source_topic ORDER BY published DESC, arxiv_id, created_at) AS rank
         FROM t WHERE published >= TIMESTAMP '2020-01-01' - INTERVAL 700 DAY) WHERE rank <= 20""",
)
def crawl_topk_lookback(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").filter("source_topic IS NOT NULL").select("arxiv_id", "source_topic", "published", "created_at").distinct()
    return crawl.newest_per_topic(papers, 20, at("2020-01-01"), 700).select("arxiv_id", "source_topic", "rank")


@register(
    "dedup_first",
    """SELECT arxiv_id, source_topic, title FROM papers
       QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY source_topic NULLS LAST, created_at, title, abstract) = 1""",
)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "papers").select("arxiv_id", "source_topic", "title", "abstract", "created_at")
    order = F.col("source_topic").asc_nulls_last()
    return crawl.keep_first(rows, order, [F.col("created_at"), F.col("title"), F.col("abstract")]).select("arxiv_id", "source_topic", "title")


TOPIC_QUERY = '(cat:cs.RO OR cat:cs.AI) AND (elevator OR "causal" OR ti:towards) ANDNOT abs:warehouse'
_HAY = "lower(concat_ws(' ', title, abstract))"
_MATCH = f"""coalesce(list_contains(list_transform(categories, lambda c: lower(trim(c))), 'cs.ro') OR list_contains(list_transform(categories, lambda c: lower(trim(c))), 'cs.ai'), false)
  AND (contains({_HAY}, 'elevator') OR contains({_HAY}, 'causal') OR contains(lower(coalesce(title, '')), 'towards')) AND NOT contains(lower(coalesce(abstract, '')), 'warehouse')"""


@register("bool_query", f"SELECT DISTINCT arxiv_id, title FROM papers WHERE {_MATCH}")
def bool_query(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "papers").filter(compile_query(TOPIC_QUERY)).select("arxiv_id", "title").distinct()


def _count(word: str, place: str) -> str:
    return f"CAST((length({place}) - length(replace({place}, '{word}', ''))) / {len(word)} AS INT)"


@register(
    "search_top10",
    f"""WITH t AS (SELECT DISTINCT arxiv_id, title, abstract, authors, published, lower(coalesce(title, '')) AS lt, lower(coalesce(abstract, '')) AS la FROM papers
         WHERE contains({_HAY}, 'elevator') AND coalesce(list_contains(list_transform(categories, lambda c: lower(trim(c))), 'cs.ro'), false)),
       s AS (SELECT *, 3 * {_count('elevator', 'lt')} + {_count('elevator', 'la')} AS score FROM t)
       SELECT arxiv_id, title, score, left(abstract, 500) AS abstract, array_to_string(authors[1:5], '|') AS authors, strftime(published, '%Y-%m-%d') AS published
       FROM s ORDER BY score DESC, arxiv_id, title, abstract LIMIT 10""",
)
def search_top10(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").dropDuplicates(["arxiv_id", "title", "abstract", "authors", "published"])
    found = crawl.search(papers, compile_query(with_categories("elevator", ["cs.RO"])), match_score(["elevator"]), 10)
    return found.withColumn("authors", F.array_join("authors", "|"))


# --- upserts ---------------------------------------------------------------------------------

_OLD = f"SELECT * FROM papers WHERE created_at < TIMESTAMP '2018-01-01' QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY {LATEST}, title, abstract, source_topic) = 1"
_NEW = f"SELECT * FROM papers WHERE created_at >= TIMESTAMP '2018-01-01' QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY {LATEST}, title, abstract, source_topic) = 1"


@register(
    "upsert_partial",
    f"""WITH o AS ({_OLD}), n AS ({_NEW})
       SELECT coalesce(o.arxiv_id, n.arxiv_id) AS arxiv_id, CASE WHEN n.arxiv_id IS NOT NULL THEN n.title ELSE o.title END AS title,
              CASE WHEN n.arxiv_id IS NOT NULL THEN n.abstract ELSE o.abstract END AS abstract, CASE WHEN o.arxiv_id IS NOT NULL THEN o.source_topic ELSE n.source_topic END AS source_topic
       FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id""",
)
def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers")
    order = [F.col("created_at").desc_nulls_last(), F.col("title"), F.col("abstract"), F.col("source_topic").asc_nulls_last()]
    old, new = (gates.first_of_each(papers.filter(f"created_at {op} TIMESTAMP_NTZ '2018-01-01 00:00:00'"), ["arxiv_id"], order) for op in ("<", ">="))
    return upsert.upsert_papers(old, new).select("arxiv_id", "title", "abstract", "source_topic")


_ONE_VERDICT = "SELECT arxiv_id, score, justification, created_at FROM relevance_verdicts WHERE arxiv_id IS NOT NULL AND score {test} QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY created_at DESC NULLS LAST, score, justification) = 1"


@register(
    "upsert_full",
    f"""WITH o AS ({_ONE_VERDICT.format(test='<= 6')}), n AS ({_ONE_VERDICT.format(test='> 4')})
       SELECT coalesce(n.arxiv_id, o.arxiv_id) AS arxiv_id, CASE WHEN n.arxiv_id IS NOT NULL THEN n.score ELSE o.score END AS score,
              CASE WHEN n.arxiv_id IS NOT NULL THEN n.justification ELSE o.justification END AS justification,
              strftime(CASE WHEN o.arxiv_id IS NOT NULL THEN o.created_at ELSE n.created_at END, '{SQL_STAMP}') AS created
       FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id""",
)
def upsert_full(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "relevance_verdicts").filter("arxiv_id IS NOT NULL").select("arxiv_id", "score", "justification", "created_at")
    order = [F.col("created_at").desc_nulls_last(), F.col("score"), F.col("justification")]
    old, new = (gates.first_of_each(rows.filter(test), ["arxiv_id"], order) for test in ("score <= 6", "score > 4"))
    return upsert.upsert_rows(old, new).withColumn("created", stamp("created_at")).drop("created_at")


@register("log_updates", "SELECT DISTINCT arxiv_id, benchmark, summary, 1 AS run_id FROM sota_updates")
def log_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sota_updates").select("arxiv_id", "benchmark", "summary")
    return upsert.log_updates(rows, run=1)


@register(
    "run_ledger",
    "SELECT 1 AS id, 'completed' AS status, 3 AS papers_crawled, 2 AS papers_filtered, 1 AS papers_read UNION ALL SELECT 2, 'running', -1, -1, -1",
)
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    runs = upsert.start_run(empty(spark, "pipeline_runs"), at("2026-01-01"))
    runs = upsert.finish_run(runs, 1, at("2026-01-02"), 3, 2, 1)
    return upsert.start_run(runs, at("2026-01-03")).select(F.col("id").cast("int").alias("id"), "status", "papers_crawled", "papers_filtered", "papers_read").fillna(-1)


# --- experiments -----------------------------------------------------------------------------

_READINGS = "readings AS (SELECT * FROM deep_readings WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY created_at DESC, problem_statement) = 1)"
_RESULTS = f"""{_READINGS},
 entries AS (SELECT arxiv_id, created_at, i - 1 AS entry_pos, experiment_table.entries[i] AS e FROM (SELECT *, unnest(range(1, len(experiment_table.entries) + 1)) AS i FROM readings)),
 results AS (SELECT arxiv_id, created_at, entry_pos, e.benchmark AS benchmark, e.setting AS setting, e.metric AS metric, e.higher_is_better AS higher_is_better, j - 1 AS result_pos,
   e.results[j].method_name AS method_name, e.results[j].value AS value, e.results[j].is_paper_method AS is_paper_method
   FROM (SELECT *, unnest(range(1, len(e.results) + 1)) AS j FROM entries))"""
_SLUG = "regexp_replace(" + sql_strip(r"regexp_replace(lower(benchmark), '[^\p{L}\p{N}_\s-]', '', 'g')") + r", '\s+', '_', 'g')"
_BOARD = f"""{_RESULTS}, board AS (SELECT {_SLUG} AS slug, coalesce(setting, 'default') AS setting, metric, coalesce(higher_is_better, true) AS higher_is_better, method_name AS method, value,
   arxiv_id, epoch_us(created_at) AS seq, entry_pos, result_pos, coalesce(is_paper_method, false) AS is_paper_method, benchmark FROM results
   WHERE benchmark IS NOT NULL AND metric IS NOT NULL AND method_name IS NOT NULL)"""
_LATEST = "latest AS (SELECT * FROM board WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug, setting, metric, method ORDER BY seq DESC, entry_pos DESC, result_pos DESC, value DESC) = 1)"


def latest_readings(spark: SparkSession, d: str, undated: bool = False) -> DataFrame:
    """Each paper's latest reading. Readings without a created_at are left out, as in the SQL
    (``_READINGS``), and with them papers that have no other. With ``undated`` they count as the
    earliest (``_ALL_READINGS``); the queries that end in ``_all`` keep every paper so."""
    rows = load(spark, d, "deep_readings")
    kept = rows if undated else rows.filter("created_at IS NOT NULL")
    return gates.first_of_each(kept, ["arxiv_id"], [F.col("created_at").desc_nulls_last(), F.col("problem_statement").asc_nulls_last()])


def board(spark: SparkSession, d: str, undated: bool = False) -> DataFrame:
    """Board rows of the papers' latest readings, in order of reading time, undated ones first."""
    results = experiments.unnest(latest_readings(spark, d, undated)).filter("benchmark IS NOT NULL AND metric IS NOT NULL AND method_name IS NOT NULL")
    clean = results.fillna({"setting": "default", "higher_is_better": True, "is_paper_method": False})
    seq = F.unix_micros(F.col("created_at").cast("timestamp"))
    return leaderboard.board_rows(clean, F.coalesce(seq, F.lit(UNDATED)) if undated else seq)


#: The place of readings without a moment: before all others.
UNDATED = -(1 << 62)
_ALL_READINGS = "readings AS (SELECT * FROM deep_readings QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY created_at DESC NULLS LAST, problem_statement NULLS LAST) = 1)"


def _all(sql: str) -> str:
    """The SQL over all papers' readings, undated ones as the earliest."""
    return sql.replace(_READINGS, _ALL_READINGS).replace("epoch_us(created_at)", f"coalesce(epoch_us(created_at), {UNDATED})")


@register("unnest_results", f"WITH {_RESULTS} SELECT * EXCLUDE (created_at) REPLACE (coalesce(CAST(is_paper_method AS VARCHAR), 'null') AS is_paper_method, coalesce(CAST(higher_is_better AS VARCHAR), 'null') AS higher_is_better) FROM results")
def unnest_results(spark: SparkSession, d: str) -> DataFrame:
    flags = {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("is_paper_method", "higher_is_better")}
    return experiments.unnest(latest_readings(spark, d)).drop("created_at").withColumns(flags)


@register(
    "nest_results",
    f"""WITH {_RESULTS}, kept AS (SELECT arxiv_id, entry_pos, count(*) AS n, sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS v, string_agg(coalesce(method_name, '-'), '|' ORDER BY result_pos) AS m FROM results GROUP BY 1, 2)
       SELECT arxiv_id, count(*) AS n_entries, CAST(sum(n) AS BIGINT) AS n_results, CAST(sum(v) AS BIGINT) AS n_values, string_agg(m, '#' ORDER BY entry_pos) AS methods FROM kept GROUP BY 1""",
)
def nest_results(spark: SparkSession, d: str) -> DataFrame:
    tables = experiments.nest(experiments.unnest(latest_readings(spark, d)))
    entries = F.col("experiment_table.entries")
    methods = F.array_join(F.transform(entries, lambda e: F.array_join(F.transform(e["results"], lambda r: F.coalesce(r["method_name"], F.lit("-"))), "|")), "#")
    counted = lambda f: F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + F.size(f(e["results"])))
    return tables.select("arxiv_id", F.size(entries).cast("bigint").alias("n_entries"), counted(lambda r: r).alias("n_results"), counted(lambda r: F.filter(r, lambda x: x["value"].isNotNull())).alias("n_values"), methods.alias("methods"))


@register(
    "normalise_replies",
    f"""WITH {_READINGS}, e AS (SELECT arxiv_id, unnest(experiment_table.entries) AS e FROM readings WHERE len(experiment_table.entries) > 0),
       bad AS (SELECT DISTINCT arxiv_id FROM e WHERE e.benchmark IS NULL OR e.metric IS NULL)
       SELECT arxiv_id, count(*) AS n_entries, CAST(sum(coalesce(len(list_filter(e.results, lambda r: r.value IS NOT NULL)), 0)) AS BIGINT) AS n_results,
              CAST(sum(CASE WHEN coalesce(e.setting, 'default') = 'default' THEN 1 ELSE 0 END) AS BIGINT) AS n_default
       FROM e WHERE arxiv_id NOT IN (SELECT arxiv_id FROM bad) GROUP BY 1""",
)
def normalise_replies(spark: SparkSession, d: str) -> DataFrame:
    """The stored tables, written as a model's replies would be, and read again."""

    def result(r: Column) -> Column:
        return F.struct(r["method_name"].alias("method"), r["value"].cast("string").alias("value"), r["is_paper_method"].alias("is_paper_method"))

    entries = F.transform(
        "experiment_table.entries",
        lambda e: F.struct(e["benchmark"].alias("benchmark"), e["setting"].alias("setting"), e["metric"].alias("metric"), e["higher_is_better"].alias("higher_is_better"), F.transform(e["results"], result).alias("results")),
    )
    written = latest_readings(spark, d).select("arxiv_id", F.to_json(F.struct(entries.alias("entries"), F.col("experiment_table.details").alias("details")), {"ignoreNullFields": "false"}).alias("raw"))
    read = written.select("arxiv_id", F.from_json("raw", experiments.REPLY).alias("reply"))
    tables = read.select("arxiv_id", experiments.normalise(F.col("reply"), F.col("arxiv_id")).alias("t")).filter("t IS NOT NULL")
    e = tables.select("arxiv_id", F.explode("t.entries").alias("e"))
    return e.groupBy("arxiv_id").agg(F.count("*").alias("n_entries"), F.sum(F.size("e.results")).alias("n_results"), F.sum((F.col("e.setting") == "default").cast("int")).alias("n_default"))


@register(
    "group_methods",
    f"""WITH {_RESULTS}, g AS (SELECT arxiv_id, benchmark, setting, min(entry_pos) AS group_pos, count(*) AS n_results,
         coalesce(nullif(array_to_string(list_sort(list_distinct(list(CASE WHEN is_paper_method THEN method_name END))), '|'), ''), 'baselines') AS methods FROM results GROUP BY 1, 2, 3)
       SELECT *, methods || ' on ' || benchmark || ' (' || setting || ')' AS summary FROM g""",
)
def group_methods(spark: SparkSession, d: str) -> DataFrame:
    return experiments.groups(experiments.unnest(latest_readings(spark, d)))


# --- leaderboards ----------------------------------------------------------------------------


@register(
    "leaderboard_rank",
    f"""WITH {_BOARD}, {_LATEST}, lead AS (SELECT slug, setting, min(metric) AS metric FROM latest GROUP BY 1, 2)
       SELECT slug, setting, metric, method, value, arxiv_id, row_number() OVER (PARTITION BY slug, setting ORDER BY CASE WHEN higher_is_better THEN value ELSE -value END DESC NULLS LAST, method) AS rank
       FROM latest JOIN lead USING (slug, setting, metric)""",
)
def leaderboard_rank(spark: SparkSession, d: str) -> DataFrame:
    return leaderboard.ranked(board(spark, d).filter("value IS NOT NULL")).select("slug", "setting", "metric", "method", "value", "arxiv_id", "rank")


@register(
    "leaderboard_pivot",
    f"""WITH {_BOARD}, {_LATEST} SELECT slug, setting, method, string_agg(metric, '|' ORDER BY metric) AS metrics, count(*) AS n FROM latest GROUP BY 1, 2, 3""",
)
def leaderboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = leaderboard.pivoted(board(spark, d).filter("value IS NOT NULL"))
    return wide.select("slug", "setting", "method", F.array_join(F.array_sort(F.map_keys("values")), "|").alias("metrics"), F.size("values").cast("bigint").alias("n"))


@register(
    "leaderboard_markdown",
    f"""WITH {_BOARD}, {_LATEST},
       m AS (SELECT slug, setting, metric, bool_or(higher_is_better) AS up FROM latest GROUP BY 1, 2, 3),
       heads AS (SELECT slug, setting, min(metric) AS lead, string_agg(metric || CASE WHEN up THEN '↑' ELSE '↓' END, ' | ' ORDER BY metric) AS head, count(*) AS n FROM m GROUP BY 1, 2),
       ranks AS (SELECT l.slug, l.setting, method, row_number() OVER (PARTITION BY l.slug, l.setting ORDER BY CASE WHEN higher_is_better THEN value ELSE -value END DESC NULLS LAST, method) AS rank
         FROM latest l JOIN heads h ON l.slug = h.slug AND l.setting = h.setting AND l.metric = h.lead),
       of_method AS (SELECT slug, setting, method, (max(struct_pack(s := seq, a := arxiv_id))).a AS paper FROM latest GROUP BY 1, 2, 3),
       cells AS (SELECT k.slug, k.setting, k.method, k.paper, string_agg(coalesce(CAST(l.value AS VARCHAR), '-'), ' | ' ORDER BY m.metric) AS shown
         FROM of_method k JOIN m ON k.slug = m.slug AND k.setting = m.setting LEFT JOIN latest l ON l.slug = k.slug AND l.setting = k.setting AND l.method = k.method AND l.metric = m.metric GROUP BY 1, 2, 3, 4),
       ls AS (SELECT c.*, rank, '| ' || coalesce(CAST(rank AS VARCHAR), '-') || ' | ' || c.method || ' | ' || shown || ' | ' || coalesce(paper, '') || ' |  |' AS line
         FROM cells c LEFT JOIN ranks r ON c.slug = r.slug AND c.setting = r.setting AND c.method = r.method),
       sections AS (SELECT h.slug, h.setting, '## ' || h.setting || chr(10) || chr(10) || '| Rank | Method | ' || head || ' | Paper | Notes |' || chr(10) || '|---|---|' || repeat('---|', n) || '---|---|' || chr(10)
           || (SELECT string_agg(line, chr(10) ORDER BY coalesce(rank, 1073741824), method, line) FROM ls WHERE ls.slug = h.slug AND ls.setting = h.setting) AS t FROM heads h)
       SELECT slug, '# ' || (SELECT min(benchmark) FROM latest l WHERE l.slug = s.slug) || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY setting) || chr(10) AS markdown FROM sections s GROUP BY slug""",
)
def leaderboard_markdown(spark: SparkSession, d: str) -> DataFrame:
    return leaderboard.rendered(board(spark, d).filter("value IS NOT NULL"))


_CONFLICT = """CASE WHEN o <> 0 AND NOT isnan(o) AND NOT isnan(value) THEN abs(value - o) / abs(o) > CAST(0.05 AS DOUBLE) ELSE false END"""


@register(
    "conflict_as_of",
    f"""WITH {_BOARD}, seen AS (SELECT *, last_value(value) OVER w AS o, last_value(arxiv_id) OVER w AS source FROM board WHERE value IS NOT NULL
         WINDOW w AS (PARTITION BY slug, setting, lower(metric), lower(method) ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT slug, setting, metric, arxiv_id, count(*) AS n FROM seen WHERE NOT is_paper_method AND {_CONFLICT} GROUP BY 1, 2, 3, 4""",
)
def conflict_as_of(spark: SparkSession, d: str) -> DataFrame:
    found = leaderboard.conflicts_as_of(board(spark, d))
    return found.groupBy("slug", "setting", "metric", "arxiv_id").agg(F.count("*").alias("n"))


_SPLIT = 1577836800000000  # 2020-01-01


@register(
    "fuzzy_method_conflicts",
    f"""WITH {_BOARD}, {_LATEST.replace('value IS NOT NULL', f'value IS NOT NULL AND seq < {_SPLIT}')},
       n AS (SELECT row_number() OVER () AS id, * FROM board WHERE NOT is_paper_method AND seq >= {_SPLIT}),
       b AS (SELECT slug, lower(metric) AS lm, method AS known_method, value AS o, arxiv_id AS source, seq AS s FROM latest),
       m AS (SELECT n.*, known_method, o, source FROM n JOIN b ON n.slug = b.slug AND lower(n.metric) = lm AND (contains(lower(method), lower(known_method)) OR contains(lower(known_method), lower(method)))
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, known_method) = 1)
       SELECT slug, metric, method, value, arxiv_id, known_method, o AS existing_value, source AS paper_source FROM m WHERE {_CONFLICT}""",
)
def fuzzy_method_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = board(spark, d)
    known = leaderboard.latest_rows(rows.filter((F.col("seq") < _SPLIT) & F.col("value").isNotNull()))
    found = leaderboard.conflicts_with_board(rows.filter(F.col("seq") >= _SPLIT), known)
    return found.select("slug", "metric", "method", "value", "arxiv_id", "known_method", "existing_value", "paper_source")


_GROUPED = f"""{_BOARD}, grouped AS (SELECT slug, seq, arxiv_id, benchmark, setting, min(entry_pos) AS group_pos FROM board GROUP BY 1, 2, 3, 4, 5)"""


@register(
    "action_class",
    f"""WITH {_GROUPED}, seen AS (SELECT *, last_value(value) OVER w AS o FROM board WHERE value IS NOT NULL
         WINDOW w AS (PARTITION BY slug, setting, lower(metric), lower(method) ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       c AS (SELECT arxiv_id, benchmark, setting, count(*) AS n FROM seen WHERE NOT is_paper_method AND {_CONFLICT} GROUP BY 1, 2, 3)
       SELECT slug, arxiv_id, benchmark, setting, coalesce(n, 0) AS n_conflicts,
              CASE WHEN n > 0 THEN 'conflict_resolved' WHEN row_number() OVER (PARTITION BY slug ORDER BY seq, group_pos, arxiv_id, setting) = 1 THEN 'new_entry' ELSE 'updated' END AS action
       FROM grouped LEFT JOIN c USING (arxiv_id, benchmark, setting)""",
)
def action_class(spark: SparkSession, d: str) -> DataFrame:
    rows = board(spark, d)
    grouped = rows.groupBy("slug", "seq", "arxiv_id", "benchmark", "setting").agg(F.min("entry_pos").alias("group_pos"))
    acted = leaderboard.actions(grouped, leaderboard.conflicts_as_of(rows))
    return acted.select("slug", "arxiv_id", "benchmark", "setting", "n_conflicts", "action")


#: The fold without a loop: of each look-up the rows that were put down before it, the page that
#: they make (metrics in columns by name, methods in order of their oldest entry), and the first
#: number under the first header that names the metric. A line with ``Rank`` is read as a header.
_FOLD = f"""{_BOARD},
 papergroups AS (SELECT slug, seq, arxiv_id, setting, min(entry_pos * 1000000 + result_pos) AS gpos FROM board GROUP BY 1, 2, 3, 4),
 b AS (SELECT board.*, dense_rank() OVER (PARTITION BY slug ORDER BY seq, arxiv_id, gpos) AS g, row_number() OVER (PARTITION BY slug ORDER BY seq, arxiv_id, gpos, entry_pos, result_pos) AS ins
   FROM board JOIN papergroups USING (slug, seq, arxiv_id, setting)),
 kept AS (SELECT * FROM b WHERE value IS NOT NULL AND NOT isnan(value)),
 asked AS (SELECT * FROM kept WHERE NOT is_paper_method),
 state AS (SELECT q.slug, q.g, k.setting, k.metric, k.method, arg_max(k.value, k.ins) AS value, arg_max(k.arxiv_id, k.ins) AS paper, max(k.ins) AS ins
   FROM (SELECT DISTINCT slug, g FROM asked) q JOIN kept k ON k.slug = q.slug AND k.g < q.g GROUP BY 1, 2, 3, 4, 5),
 methods AS (SELECT slug, g, setting, method, min(ins) AS place, arg_max(paper, ins) AS paper FROM state GROUP BY 1, 2, 3, 4),
 cols AS (SELECT slug, g, setting, metric, row_number() OVER (PARTITION BY slug, g, setting ORDER BY metric) AS col FROM (SELECT DISTINCT slug, g, setting, metric FROM state)),
 heads AS (SELECT slug, g, setting, lower(metric) AS wanted, min(col) AS col FROM cols GROUP BY 1, 2, 3, 4),
 cells AS (
   SELECT slug, g, setting, method, col, value FROM state JOIN cols USING (slug, g, setting, metric)
   UNION ALL SELECT slug, g, setting, method, n + 1, TRY_CAST(trim(paper) AS DOUBLE) FROM methods JOIN (SELECT slug, g, setting, count(*) AS n FROM cols GROUP BY 1, 2, 3) USING (slug, g, setting)),
 hits AS (SELECT a.slug, a.ins, c.value AS o, row_number() OVER (PARTITION BY a.slug, a.ins ORDER BY h.setting, c.setting, place) AS n
   FROM asked a JOIN heads h ON h.slug = a.slug AND h.g = a.g AND h.wanted = lower(a.metric) JOIN cells c ON c.slug = a.slug AND c.g = a.g AND c.col = h.col AND c.value IS NOT NULL
     AND NOT contains(c.method, 'Rank') AND NOT contains(c.method, '---')
     AND (contains(lower(trim(c.method)), lower(a.method)) OR contains(lower(a.method), lower(trim(c.method))))
   JOIN methods p ON p.slug = c.slug AND p.g = c.g AND p.setting = c.setting AND p.method = c.method)"""


@register("conflict_fold", f"WITH {_FOLD} SELECT slug, arxiv_id, setting, metric, method, value, o AS existing_value FROM asked JOIN (SELECT * FROM hits WHERE n = 1) USING (slug, ins) WHERE {_CONFLICT}")
def conflict_fold(spark: SparkSession, d: str) -> DataFrame:
    """The exact paper by paper fold with look-ups in rendered text."""
    return leaderboard.fold(board(spark, d))


@register(
    "paper_experiments",
    f"""WITH {_READINGS} SELECT arxiv_id, proposed_method AS method_summary, experimental_setup, main_results,
         coalesce(array_to_string(list_transform(experiment_table.entries, lambda e: coalesce(e.benchmark, '-') || '/' || coalesce(e.setting, '-') || '/' || coalesce(e.metric, '-') || '/'
           || CASE WHEN coalesce(e.higher_is_better, true) THEN 'higher' ELSE 'lower' END || '/' || CAST(coalesce(len(e.results), -1) AS VARCHAR)), ';'), '') AS benchmarks FROM readings""",
)
def paper_experiments(spark: SparkSession, d: str) -> DataFrame:
    """What each paper's latest reading says of its experiments, the benchmarks as text."""
    told = experiments.benchmarks_of(latest_readings(spark, d))
    name = lambda b, c: F.coalesce(b[c], F.lit("-"))
    count = lambda b: F.when(b["results"].isNull(), -1).otherwise(F.size(b["results"])).cast("string")
    text = F.transform("benchmarks", lambda b: F.concat_ws("/", name(b, "benchmark"), name(b, "setting"), name(b, "metric"), b["better"], count(b)))
    return told.withColumn("benchmarks", F.array_join(text, ";"))


# --- knowledge base --------------------------------------------------------------------------


_TITLES = "titles AS (SELECT arxiv_id, arg_max(title, created_at) AS title FROM papers GROUP BY 1)"


@register(
    "kb_documents",
    f"""WITH {_READINGS}, {_TITLES}, t AS (SELECT r.*, title FROM readings r JOIN titles USING (arxiv_id)),
       docs AS (
         SELECT 'paper_contributions' AS collection, arxiv_id AS id, 'Paper: ' || title || chr(10) || 'Contributions:' || chr(10) || array_to_string(list_transform(key_contributions, lambda c: '- ' || c), chr(10)) AS document FROM t WHERE len(key_contributions) > 0
         UNION ALL SELECT 'paper_methods', arxiv_id, 'Paper: ' || title || chr(10) || 'Method: ' || proposed_method FROM t WHERE length(proposed_method) > 0
         UNION ALL SELECT 'research_context', arxiv_id, 'Paper: ' || title || chr(10) || 'Context: ' || comparison_to_prior_work FROM t WHERE length(comparison_to_prior_work) > 0)
       SELECT collection, id, md5(document) AS document FROM docs WHERE document IS NOT NULL""",
)
def kb_documents(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.documents_of(latest_readings(spark, d), load(spark, d, "papers")).select("collection", "id", F.md5("document").alias("document"))


@register(
    "kb_query_text",
    f"WITH {_READINGS}, {_TITLES} SELECT arxiv_id, md5(concat_ws(' ', title, problem_statement, proposed_method)) AS query FROM readings JOIN titles USING (arxiv_id)",
)
def kb_query_text(spark: SparkSession, d: str) -> DataFrame:
    titles = load(spark, d, "papers").groupBy("arxiv_id").agg(F.max_by("title", F.struct("created_at")).alias("title"))
    text = knowledge.query_text(F.col("title"), F.col("problem_statement"), F.col("proposed_method"))
    return latest_readings(spark, d).join(titles, "arxiv_id").select("arxiv_id", F.md5(text).alias("query"))


_KNN = """SELECT query_id, vec_id, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON {on} WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""


@register("knn_top5", _KNN.format(on="q.vec_id <> v.vec_id"))
def knn_top5(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    return similarity.nearest(rows, rows.filter("vec_id % 50 = 0")).select("query_id", "vec_id", "rank")


@register("knn_prior_top5", _KNN.format(on="v.vec_id < q.vec_id"))
def knn_prior_top5(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    return similarity.nearest(rows, rows.filter("vec_id % 50 = 0"), prior_only=True).select("query_id", "vec_id", "rank")


@register("vector_upsert", "SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS document FROM embeddings")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings").select(F.lit("c").alias("collection"), F.col("vec_id").alias("id"), "label")
    old, new = rows.withColumn("document", F.lit("old")), rows.filter("id % 3 = 0").withColumn("document", F.lit("new"))
    return upsert.upsert_vectors(old, new).select(F.col("id").alias("vec_id"), "label", "document")


@register("slugify", f"SELECT DISTINCT benchmark, {_SLUG} AS slug FROM sota_updates WHERE benchmark IS NOT NULL")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sota_updates").filter("benchmark IS NOT NULL").select("benchmark", slug(F.col("benchmark")).alias("slug")).distinct()


# --- the same with undated readings ----------------------------------------------------------


@register("unnest_results_all", _all(f"WITH {_RESULTS} SELECT arxiv_id, entry_pos, result_pos, benchmark, method_name, value FROM results"))
def unnest_results_all(spark: SparkSession, d: str) -> DataFrame:
    return experiments.unnest(latest_readings(spark, d, True)).select("arxiv_id", "entry_pos", "result_pos", "benchmark", "method_name", "value")


@register("leaderboard_pivot_all", _all(f"WITH {_BOARD}, {_LATEST} SELECT slug, setting, method, string_agg(metric, '|' ORDER BY metric) AS metrics, count(*) AS n FROM latest GROUP BY 1, 2, 3"))
def leaderboard_pivot_all(spark: SparkSession, d: str) -> DataFrame:
    wide = leaderboard.pivoted(board(spark, d, True).filter("value IS NOT NULL"))
    return wide.select("slug", "setting", "method", F.array_join(F.array_sort(F.map_keys("values")), "|").alias("metrics"), F.size("values").cast("bigint").alias("n"))


@register(
    "conflict_as_of_all",
    _all(f"""WITH {_BOARD}, seen AS (SELECT *, last_value(value) OVER w AS o FROM board WHERE value IS NOT NULL
         WINDOW w AS (PARTITION BY slug, setting, lower(metric), lower(method) ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT slug, setting, metric, arxiv_id, count(*) AS n FROM seen WHERE NOT is_paper_method AND {_CONFLICT} GROUP BY 1, 2, 3, 4"""),
)
def conflict_as_of_all(spark: SparkSession, d: str) -> DataFrame:
    found = leaderboard.conflicts_as_of(board(spark, d, True))
    return found.groupBy("slug", "setting", "metric", "arxiv_id").agg(F.count("*").alias("n"))


@register("kb_query_text_all", _all(f"WITH {_READINGS}, {_TITLES} SELECT arxiv_id, md5(concat_ws(' ', title, problem_statement, proposed_method)) AS query FROM readings JOIN titles USING (arxiv_id)"))
def kb_query_text_all(spark: SparkSession, d: str) -> DataFrame:
    titles = load(spark, d, "papers").groupBy("arxiv_id").agg(F.max_by("title", F.struct("created_at")).alias("title"))
    text = knowledge.query_text(F.col("title"), F.col("problem_statement"), F.col("proposed_method"))
    return latest_readings(spark, d, True).join(titles, "arxiv_id").select("arxiv_id", F.md5(text).alias("query"))


# --- bundles, notes, reports -----------------------------------------------------------------


@register("export_rows", f"SELECT arxiv_id, coalesce(score, -999) AS score, justification, array_to_string(key_topics, '|') AS key_topics, strftime(created_at, '{SQL_STAMP}') AS created FROM relevance_verdicts")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as a bundle writes them, JSON with nulls kept, and as it reads them back."""
    from lorebase.sources.bundle import JSON
    from lorebase.tables import schema

    rows = load(spark, d, "relevance_verdicts").select(schema("relevance_verdicts").names)
    written = rows.select(F.to_json(F.struct(*rows.columns), JSON).alias("j"))
    back = written.select(F.from_json("j", schema("relevance_verdicts"), JSON).alias("r")).select("r.*")
    return back.select("arxiv_id", F.coalesce("score", F.lit(-999)).alias("score"), "justification", F.array_join("key_topics", "|").alias("key_topics"), stamp("created_at").alias("created"))


@register(
    "conflict_notes",
    f"""WITH {_BOARD}, seen AS (SELECT *, last_value(value) OVER w AS o, last_value(arxiv_id) OVER w AS source FROM board WHERE value IS NOT NULL
         WINDOW w AS (PARTITION BY slug, setting, lower(metric), lower(method) ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT arxiv_id, slug, setting, string_agg('> ⚠ ' || method || '/' || metric || ': paper reports ' || CAST(value AS VARCHAR) || ', existing shows ' || CAST(o AS VARCHAR) || ' (from ' || coalesce(source, 'unknown') || '). Cause unknown.', chr(10) ORDER BY entry_pos, result_pos) AS notes
       FROM seen WHERE NOT is_paper_method AND {_CONFLICT} GROUP BY 1, 2, 3""",
)
def conflict_notes(spark: SparkSession, d: str) -> DataFrame:
    found = leaderboard.conflicts_as_of(board(spark, d))
    note = leaderboard.conflict_note(F.col("method"), F.col("metric"), F.col("value"), F.col("existing_value"), F.col("paper_source"))
    listed = F.array_sort(F.collect_list(F.struct("entry_pos", "result_pos", note.alias("t"))))
    return found.groupBy("arxiv_id", "slug", "setting").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("notes"))


@register(
    "update_report",
    f"""WITH {_GROUPED}, seen AS (SELECT *, last_value(value) OVER w AS o FROM board WHERE value IS NOT NULL
         WINDOW w AS (PARTITION BY slug, setting, lower(metric), lower(method) ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       c AS (SELECT arxiv_id, benchmark, setting, count(*) AS n FROM seen WHERE NOT is_paper_method AND {_CONFLICT} GROUP BY 1, 2, 3)
       SELECT arxiv_id, count(*) AS n_actions, CAST(sum(coalesce(n, 0)) AS BIGINT) AS conflicts_found, CAST(sum(coalesce(n, 0)) AS BIGINT) AS conflicts_resolved
       FROM grouped LEFT JOIN c USING (arxiv_id, benchmark, setting) GROUP BY 1""",
)
def update_report(spark: SparkSession, d: str) -> DataFrame:
    rows = board(spark, d)
    grouped = rows.groupBy("slug", "seq", "arxiv_id", "benchmark", "setting").agg(F.min("entry_pos").alias("group_pos"))
    return leaderboard.report(leaderboard.actions(grouped, leaderboard.conflicts_as_of(rows)))


@register("to_fetch", "SELECT arxiv_id, min(pdf_url) AS pdf_url, translate(arxiv_id, '/.', '__') || '.pdf' AS path FROM papers p WHERE pdf_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM deep_readings r WHERE r.arxiv_id = p.arxiv_id) GROUP BY 1")
def to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Papers that have been read stand in for files that are there."""
    from lorebase.functions.text import safe_id
    from lorebase.sources.files import to_fetch as wanted

    there = load(spark, d, "deep_readings").select(F.concat(safe_id(F.col("arxiv_id")), F.lit(".pdf")).alias("path"))
    return wanted(load(spark, d, "papers"), there)


@register("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("html_text", "SELECT arxiv_id, md5(title || chr(10) || 'a & b') AS body FROM (SELECT DISTINCT arxiv_id, title FROM papers WHERE title IS NOT NULL AND NOT regexp_matches(title, '[<>&]|\\s\\s|^\\s|\\s$'))")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles wrapped as a page, and taken out of it again."""
    from lorebase.sources.files import html_text as visible

    titles = load(spark, d, "papers").filter("title IS NOT NULL").filter(~F.col("title").rlike(r"[<>&]|\s\s|^\s|\s$")).select("arxiv_id", "title").distinct()
    page = F.concat(F.lit("<html><script>if (a < b) {}</script><h1>"), "title", F.lit("</h1><!-- c --><p>a &amp; b</p></html>"))
    return titles.select("arxiv_id", F.md5(visible(page)).alias("body"))
