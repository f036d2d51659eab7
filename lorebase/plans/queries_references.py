"""Problem 1: references to papers that do not exist, no longer exist or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.operators.references import orphan_references, orphan_report
from lorebase.plans.catalogue import register
from lorebase.tables import load

CHILDREN = ("sota_updates", "deep_readings", "relevance_verdicts")

#: White space for RE2's character classes, as lorebase.functions.text.WHITE is for Java's.
WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_paper_id(c: str) -> str:
    address = f"regexp_replace(lower({sql_strip(c)}), '(?s)^.*/abs/', '')"
    return sql_strip(f"regexp_replace({sql_strip(address)}, '^arxiv:', '')")


CASES = f"""
refs AS (
  SELECT source_table, arxiv_id, coalesce(strftime(created_at, '%Y-%m'), 'none') AS period,
         min(created_at) AS earliest, count(*) AS n_rows
  FROM ({" UNION ALL ".join(f"SELECT '{t}' AS source_table, {sql_paper_id('arxiv_id')} AS arxiv_id, created_at FROM {t}" for t in CHILDREN)})
  WHERE arxiv_id IS NOT NULL GROUP BY 1, 2, 3),
known AS (SELECT {sql_paper_id('arxiv_id')} AS arxiv_id, min(created_at) AS first_seen FROM papers WHERE arxiv_id IS NOT NULL GROUP BY 1),
gone AS (SELECT DISTINCT {sql_paper_id('arxiv_id')} AS arxiv_id FROM paper_removals WHERE arxiv_id IS NOT NULL),
cases AS (
  SELECT source_table, arxiv_id, period, n_rows,
         CASE WHEN known.arxiv_id IS NOT NULL THEN 'late' WHEN gone.arxiv_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs LEFT JOIN known USING (arxiv_id) LEFT JOIN gone USING (arxiv_id)
  WHERE known.arxiv_id IS NULL OR earliest < first_seen)
"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(
        {t: load(spark, folder, t) for t in CHILDREN}, load(spark, folder, "papers"), load(spark, folder, "paper_removals")
    )


@register("p1_found", f"WITH {CASES} SELECT source_table, arxiv_id, period, kind FROM cases")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).drop("n_rows")


@register(
    "p1_report",
    f"WITH {CASES} SELECT source_table, period, kind, count(*) AS n_references, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM cases GROUP BY 1, 2, 3",
)
def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(cases(spark, folder))
