"""DuckDB's SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from lorebase.plans.queries_references import WS
from lorebase.plans.queries_references import sql_paper_id as paper_id
from lorebase.plans.queries_references import sql_strip as strip


def item(c: str) -> str:
    return strip(f"regexp_replace(lower({c}), '[{WS}_-]+', ' ', 'g')")


PAIRS = f"""
verdicts AS (SELECT {paper_id('arxiv_id')} AS rec, key_topics AS items, created_at FROM relevance_verdicts WHERE arxiv_id IS NOT NULL),
records AS (
  SELECT 'key_topics' AS field, rec, items FROM verdicts
  QUALIFY row_number() OVER (PARTITION BY rec ORDER BY created_at DESC NULLS LAST, items DESC NULLS LAST) = 1
  UNION ALL
  SELECT 'categories', arxiv_id, categories FROM papers
  QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY created_at DESC NULLS LAST, categories DESC NULLS LAST) = 1),
long AS (SELECT DISTINCT field, rec, {item('x')} AS item FROM (SELECT field, rec, unnest(items) AS x FROM records) WHERE x IS NOT NULL),
kept AS (SELECT * FROM long WHERE item <> ''),
total AS (SELECT field, count(DISTINCT rec) AS n FROM kept GROUP BY 1),
single AS (SELECT field, item, count(*) AS c FROM kept GROUP BY 1, 2),
pairs AS (
  SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS n_both
  FROM kept a JOIN kept b ON a.field = b.field AND a.rec = b.rec AND a.item < b.item GROUP BY 1, 2, 3),
cases AS (
  SELECT p.field, item_a, item_b, n_both, x.c AS n_a, y.c AS n_b, n
  FROM pairs p JOIN single x ON x.field = p.field AND x.item = item_a JOIN single y ON y.field = p.field AND y.item = item_b
  JOIN total t ON t.field = p.field WHERE n_both >= 5 AND n_both * n >= 4 * x.c * y.c)
"""

SETS = f"""
latest AS (
  SELECT arxiv_id, title, abstract FROM papers
  QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY created_at DESC NULLS LAST, title DESC NULLS LAST, abstract DESC NULLS LAST) = 1),
texts AS (
  SELECT arxiv_id, regexp_extract_all(lower(title || ' ' || abstract), '[a-z0-9]+') AS w FROM latest
  WHERE {strip('title')} <> '' AND {strip('abstract')} <> ''),
sets AS (
  SELECT DISTINCT arxiv_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT arxiv_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
sizes AS (SELECT arxiv_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.arxiv_id AS id_a, b.arxiv_id AS id_b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.arxiv_id < b.arxiv_id GROUP BY 1, 2),
cases AS (
  SELECT id_a, id_b, CAST(shared.n AS DOUBLE) / (x.n + y.n - shared.n) AS jaccard FROM shared JOIN sizes x ON x.arxiv_id = id_a JOIN sizes y ON y.arxiv_id = id_b
  WHERE 2 * shared.n >= x.n + y.n - shared.n),
members AS (SELECT arxiv_id, min(arxiv_id) OVER (PARTITION BY l) AS rep FROM (SELECT arxiv_id, list(s ORDER BY s) AS l FROM sets GROUP BY 1))
"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {SETS} SELECT id_a, id_b FROM cases",
    "p5_links": f"""WITH {SETS} SELECT id_a AS rep_a, id_b AS rep_b, jaccard FROM cases
      WHERE id_a IN (SELECT rep FROM members) AND id_b IN (SELECT rep FROM members)""",
    "p5_members": f"WITH {SETS} SELECT arxiv_id, rep FROM members",
    "p2_found": f"WITH {PAIRS} SELECT field, item_a, item_b FROM cases",
    "p2_scores": f"""WITH {PAIRS} SELECT *, CAST(n_both * n AS DOUBLE) / CAST(n_a * n_b AS DOUBLE) AS lift,
      CASE WHEN n_a > n_both THEN CAST(n_a * (n - n_b) AS DOUBLE) / (CAST(n AS DOUBLE) * (n_a - n_both)) END AS conviction_ab,
      CASE WHEN n_b > n_both THEN CAST(n_b * (n - n_a) AS DOUBLE) / (CAST(n AS DOUBLE) * (n_b - n_both)) END AS conviction_ba
      FROM cases""",
}
