"""Queries over texts: sections, passes, clips, tables and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import numbers, text
from lorebase.operators import leaderboard, sections
from lorebase.plans import providers
from lorebase.plans.catalogue import register
from lorebase.plans.queries_references import sql_strip
from lorebase.tables import load

# --- sections --------------------------------------------------------------------------------


def _sql_heading(line: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({line}, '(?i)^(?:[0-9]+[.]?\\s*)?{pattern}') THEN '{name}'" for name, pattern in sections.HEADINGS
    )
    return f"CASE WHEN length({line}) = 0 THEN NULL {cases} END"


_LINES = "lines AS (SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"
_SECTIONS = f"""{_LINES},
 named AS (SELECT *, coalesce(last_value({_sql_heading(sql_strip('line'))} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'preamble') AS name FROM lines),
 sections AS (SELECT doc_id, name, {sql_strip("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM named GROUP BY 1, 2)"""


def with_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return sections.with_sections(docs)


@register("sections_segment", f"WITH {_SECTIONS} SELECT doc_id, name, length(body) AS size, md5(body) AS body FROM sections WHERE body <> ''")
def sections_segment(spark: SparkSession, d: str) -> DataFrame:
    rows = with_sections(spark, d).select("doc_id", F.explode_outer("sections").alias("s")).filter("s IS NOT NULL")
    return rows.select("doc_id", "s.name", F.length("s.body").cast("bigint").alias("size"), F.md5("s.body").alias("body"))


def _sql_pass(names: list[str], otherwise: str) -> str:
    order = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""WITH {_SECTIONS}, own AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY CASE name {order} END) AS t FROM sections WHERE body <> '' AND name IN ({listed}) GROUP BY 1)
      SELECT doc_id, length(x) AS size, md5(x) AS body FROM (SELECT doc_id, {otherwise} AS x FROM documents LEFT JOIN own USING (doc_id) WHERE text IS NOT NULL)"""


def _pass(spark: SparkSession, d: str, which: str) -> DataFrame:
    rows = with_sections(spark, d)
    got = sections.text_for_pass(sections.section_map(F.col("sections"), F.col("text")), which).alias("x")
    return rows.select("doc_id", got).select("doc_id", F.length("x").cast("bigint").alias("size"), F.md5("x").alias("body"))


@register("pass_text_method_intro", _sql_pass(["introduction", "method", "background"], "coalesce(t, left(text, 15000))"))
def pass_text_method_intro(spark: SparkSession, d: str) -> DataFrame:
    return _pass(spark, d, "method_intro")


@register(
    "pass_text_experiments",
    _sql_pass(["experiments", "discussion"], "CASE WHEN length(coalesce(t, '')) < 3000 THEN substring(text, CAST(floor(length(text) / 3) AS BIGINT) + 1) ELSE t END"),
)
def pass_text_experiments(spark: SparkSession, d: str) -> DataFrame:
    return _pass(spark, d, "experiments")


@register("pass_text_context", _sql_pass(["related_work", "conclusion", "limitations"], "coalesce(t, right(text, 10000))"))
def pass_text_context(spark: SparkSession, d: str) -> DataFrame:
    return _pass(spark, d, "context")


@register(
    "sections_from_bounds",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
       s AS (SELECT doc_id, {sql_strip("array_to_string(ls[1:3], chr(10))")} AS a, {sql_strip("array_to_string(ls[3:], chr(10))")} AS b, {sql_strip("array_to_string(ls[2:2], chr(10))")} AS c FROM l)
       SELECT doc_id, name, length(body) AS size, md5(body) AS body FROM (
         SELECT doc_id, 'abstract' AS name, a || CASE WHEN a <> '' AND c <> '' THEN chr(10) || chr(10) ELSE '' END || c AS body FROM s
         UNION ALL SELECT doc_id, 'method', b FROM s) WHERE body <> ''""",
)
def sections_from_bounds(spark: SparkSession, d: str) -> DataFrame:
    def bound(name: str, start: int | None, end: int | None) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(start).cast("int").alias("start_line"), F.lit(end).cast("int").alias("end_line"))

    bounds = F.array(bound(" Abstract", None, 3), bound("prologue", 1, 9), bound("method", 3, 10**6), bound("abstract", 2, 2))
    docs = load(spark, d, "documents").filter("text IS NOT NULL")
    rows = docs.select("doc_id", F.explode(sections.sections_from_bounds(F.col("text"), bounds)).alias("s"))
    return rows.select("doc_id", "s.name", F.length("s.body").cast("bigint").alias("size"), F.md5("s.body").alias("body"))


# --- scalar functions ------------------------------------------------------------------------


@register(
    "clip_variants",
    """SELECT doc_id, md5(left(text, 500)) AS head, md5(right(text, 60)) AS tail, md5(substring(text, CAST(floor(length(text) / 3) AS BIGINT) + 1)) AS rest, length(text) < 3000 AS short
       FROM documents WHERE text IS NOT NULL""",
)
def clip_variants(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").filter("text IS NOT NULL").select(
        "doc_id", F.md5(text.clip(t, 500)).alias("head"), F.md5(text.clip_end(t, 60)).alias("tail"), F.md5(text.latter_two_thirds(t)).alias("rest"), (F.length(t) < 3000).alias("short")
    )


@register(
    "id_functions",
    """SELECT DISTINCT arxiv_id, list_last(string_split(arxiv_id, '/abs/')) AS bare, translate(arxiv_id, '/.', '__') AS safe, nullif(regexp_extract(arxiv_id, '[0-9]{4}[.][0-9]{4,5}'), '') AS number
       FROM sota_updates WHERE arxiv_id IS NOT NULL""",
)
def id_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("arxiv_id")
    rows = load(spark, d, "sota_updates").filter("arxiv_id IS NOT NULL")
    return rows.select(c, text.id_of_address(c).alias("bare"), text.safe_id(c).alias("safe"), text.paper_id_in(c).alias("number")).distinct()


@register(
    "numbered_lines",
    """SELECT doc_id, md5(string_agg(lpad(CAST(i AS VARCHAR), 5, ' ') || '| ' || ls[i], chr(10) ORDER BY i)) AS body
       FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
)
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.numbered_lines(F.col("text"))).alias("body"))


@register(
    "bulleted_contributions",
    f"""SELECT DISTINCT arxiv_id, md5(array_to_string(list_transform(key_contributions, lambda c: '- ' || c), chr(10))) AS body,
       strftime(created_at, '%Y-%m-%d') AS day FROM deep_readings WHERE key_contributions IS NOT NULL""",
)
def bulleted_contributions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "deep_readings").filter("key_contributions IS NOT NULL")
    return rows.select("arxiv_id", F.md5(text.bulleted(F.col("key_contributions"))).alias("body"), F.date_format("created_at", "yyyy-MM-dd").alias("day")).distinct()


@register(
    "stripped_texts",
    f"SELECT doc_id, md5({sql_strip('text')}) AS body, {sql_strip('text')} = '' AS blank FROM documents WHERE text IS NOT NULL",
)
def stripped_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.strip(c)).alias("body"), text.is_blank(c).alias("blank"))


# --- tables in texts -------------------------------------------------------------------------

_ROWS = f"""{_LINES}, bars AS (SELECT doc_id, pos, line, contains(line, 'Rank') AS head FROM lines WHERE contains(line, '|') AND NOT contains(line, '---')),
 filled AS (SELECT *, last_value(CASE WHEN head THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS header_pos FROM bars)"""


@register(
    "table_cells",
    f"""WITH {_ROWS} SELECT doc_id, header_pos - 1 AS header_pos, pos - 1 AS row_pos, len(string_split(line, '|')) AS n_cells, {sql_strip("string_split(line, '|')[3]")} AS method
       FROM filled WHERE NOT head AND header_pos IS NOT NULL""",
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = leaderboard.table_rows(load(spark, d, "documents").filter("text IS NOT NULL"), "doc_id").filter("header_pos IS NOT NULL")
    return rows.select("doc_id", "header_pos", "row_pos", F.size("cells").alias("n_cells"), F.get("cells", F.lit(2)).alias("method"))


_HIT = "(contains(lower(m), 'net') OR contains('net', lower(m)))"


@register(
    "table_lookup",
    f"""WITH {_LINES}, bars AS (SELECT doc_id, pos, list_transform(string_split(line, '|'), lambda c: {sql_strip('c')}) AS cs, contains(line, 'Rank') AS head, contains(line, '---') AS rule FROM lines WHERE contains(line, '|')),
       heads AS (SELECT doc_id, pos AS hp, list_position(list_transform(cs, lambda h: lower({sql_strip("translate(h, '↑↓', '')")})), 'sr') AS col FROM bars WHERE head),
       rows_ AS (SELECT doc_id, pos, cs, coalesce(cs[3], '') AS m FROM bars WHERE NOT head AND NOT rule),
       v AS (SELECT doc_id, TRY_CAST(cs[col] AS DOUBLE) AS value FROM heads JOIN rows_ USING (doc_id) WHERE col > 0 AND len(cs) >= col AND {_HIT} AND TRY_CAST(cs[col] AS DOUBLE) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hp, pos) = 1),
       p AS (SELECT doc_id, regexp_extract(cs[6], '[0-9]{{4}}[.][0-9]{{4,5}}') AS paper FROM rows_ WHERE len(cs) > 5 AND {_HIT} AND regexp_matches(cs[6], '[0-9]{{4}}[.][0-9]{{4,5}}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1)
       SELECT doc_id, value, paper FROM v FULL JOIN p USING (doc_id)""",
)
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter(F.col("text").contains("|"))
    found = docs.select("doc_id", leaderboard.find_value(F.col("text"), F.lit("Net"), F.lit("SR")).alias("value"), leaderboard.find_paper(F.col("text"), F.lit("Net")).alias("paper"))
    return found.filter("value IS NOT NULL OR paper IS NOT NULL")


@register(
    "cell_numbers",
    f"""WITH {_ROWS}, c AS (SELECT doc_id, pos, unnest(string_split(line, '|')) AS c FROM filled WHERE NOT head AND header_pos IS NOT NULL)
       SELECT doc_id, count(*) AS n_cells, count(TRY_CAST({sql_strip('c')} AS DOUBLE)) AS n_numbers, count(TRY_CAST({sql_strip('c')} AS INT)) FILTER (regexp_matches({sql_strip('c')}, '^[+-]?[0-9]+$')) AS n_whole FROM c GROUP BY 1""",
)
def cell_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = leaderboard.table_rows(load(spark, d, "documents").filter("text IS NOT NULL"), "doc_id").filter("header_pos IS NOT NULL")
    c = rows.select("doc_id", F.explode("cells").alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.count(numbers.to_double(F.col("c"))).alias("n_numbers"), F.count(numbers.to_score(F.col("c"))).alias("n_whole"))


@register(
    "raw_lines_page",
    """SELECT id, md5('# ' || benchmark || chr(10) || chr(10) || '## ' || action || chr(10) || chr(10) || summary || chr(10)) AS fresh,
       md5(summary || chr(10) || chr(10) || '<!-- Raw data from ' || arxiv_id || ' -->' || chr(10) || summary || chr(10)) AS more
       FROM (SELECT DISTINCT id, benchmark, action, summary, arxiv_id FROM sota_updates) WHERE benchmark IS NOT NULL AND action IS NOT NULL AND summary <> '' AND arxiv_id IS NOT NULL""",
)
def raw_lines_page(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sota_updates").select("id", "benchmark", "action", "summary", "arxiv_id").distinct()
    rows = rows.filter("benchmark IS NOT NULL AND action IS NOT NULL AND summary <> '' AND arxiv_id IS NOT NULL")
    args = [F.col(c) for c in ("benchmark", "action", "arxiv_id", "summary")]
    return rows.select("id", F.md5(leaderboard.raw_lines_page(F.lit(""), *args)).alias("fresh"), F.md5(leaderboard.raw_lines_page(F.col("summary"), *args)).alias("more"))


# --- model-backed steps, replayed ------------------------------------------------------------


@register(
    "judge_replay",
    """WITH v AS (SELECT arxiv_id, score, justification FROM relevance_verdicts WHERE arxiv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY created_at DESC NULLS LAST, score, justification) = 1),
       p AS (SELECT DISTINCT arxiv_id FROM papers)
       SELECT p.arxiv_id, CASE WHEN v.arxiv_id IS NULL THEN 'no reply' WHEN score IS NULL THEN 'score is missing' WHEN justification IS NULL THEN 'justification is missing' END AS error,
              CASE WHEN score IS NOT NULL AND justification IS NOT NULL THEN coalesce(CAST(score AS VARCHAR), '') ELSE '' END AS score FROM p LEFT JOIN v USING (arxiv_id)""",
)
def judge_replay(spark: SparkSession, d: str) -> DataFrame:
    """Recorded replies joined to requests by key, parsed, failures kept as errors."""
    from lorebase.operators.gates import first_of_each

    verdicts = load(spark, d, "relevance_verdicts").filter("arxiv_id IS NOT NULL").select("arxiv_id", "score", "justification", "key_topics", "created_at")
    one = first_of_each(verdicts, ["arxiv_id"], [F.col("created_at").desc_nulls_last(), F.col("score"), F.col("justification")])
    recorded = one.select(F.col("arxiv_id").alias("request_key"), F.to_json(F.struct("score", "justification", "key_topics")).alias("reply"))
    requests = load(spark, d, "papers").select("arxiv_id").distinct().withColumn("request_key", F.col("arxiv_id"))
    judged = providers.parse_verdicts(providers.replay(requests, recorded))
    return judged.select("arxiv_id", "error", F.coalesce(F.col("score").cast("string"), F.lit("")).alias("score"))


@register(
    "judge_rule",
    """WITH t AS (SELECT name, lower(name) AS n, list_transform(categories, lambda c: lower(trim(c))) AS cats FROM topics WHERE length(research_profile) > 0),
       p AS (SELECT DISTINCT arxiv_id, source_topic, lower(coalesce(title, '')) AS lt, lower(coalesce(abstract, '')) AS la, list_transform(coalesce(categories, []), lambda c: lower(trim(c))) AS cats FROM papers)
       SELECT DISTINCT arxiv_id, source_topic, CAST(least(10, 4 * (CASE WHEN list_has_any(p.cats, t.cats) THEN 1 ELSE 0 END)
         + 3 * len(list_filter(string_split(n, ' '), lambda w: contains(lt, w))) + len(list_filter(string_split(n, ' '), lambda w: contains(la, w)))) AS INT) AS score
       FROM p JOIN t ON source_topic = name""",
)
def judge_rule(spark: SparkSession, d: str) -> DataFrame:
    return providers.rule_scores(load(spark, d, "papers"), load(spark, d, "topics")).select("arxiv_id", "source_topic", "score").distinct()
