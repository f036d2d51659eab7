"""Leaderboards: rows ranked and rendered, values looked up, conflicts and actions.

A board is rows (slug, benchmark, setting, metric, higher_is_better, method, value, arxiv_id, seq,
note); Markdown is only its rendering. ``strict`` operators compare equal methods of one setting.
``compat`` ones look a value up in the rendered text, by a substring either way and whatever the
setting, as a text-only leaderboard has to.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.numbers import conflicts, to_double
from lorebase.functions.text import cells, contains_either_way, lines, paper_id_in, same_ignoring_case, slug, without_arrows
from lorebase.session import stage

TOLERANCE = 0.05


def board_rows(results: DataFrame, seq: Column) -> DataFrame:
    """Unnested results as board rows; seq orders the papers."""
    return results.select(
        slug(F.col("benchmark")).alias("slug"), "benchmark", "setting", "metric", "higher_is_better", F.col("method_name").alias("method"),
        "value", "arxiv_id", seq.alias("seq"), F.lit("").alias("note"), "entry_pos", "result_pos", "is_paper_method",
    )


def latest_rows(rows: DataFrame) -> DataFrame:
    """Of several values of a method for a metric the most recent one."""
    key = ["slug", "setting", "metric", "method"]
    rest = [c for c in rows.columns if c not in key]
    order = F.struct("seq", *[F.col(c) for c in ("entry_pos", "result_pos") if c in rows.columns], "value")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def ranked(rows: DataFrame, first_metric: DataFrame | None = None) -> DataFrame:
    """Latest rows with their rank: by the board's first metric in its direction, then by method.

    first_metric: (slug, setting, metric) of the metric that ranks; without it the least by name.
    NaN and null values come last, whatever the direction.
    """
    now = latest_rows(rows)
    lead = first_metric if first_metric is not None else now.groupBy("slug", "setting").agg(F.min("metric").alias("metric"))
    leading = now.join(lead, ["slug", "setting", "metric"], "left_semi")
    good = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    signed = F.when(F.col("higher_is_better"), good).otherwise(-good)
    rows = stage(leading.withColumn("_signed", signed), "ranked-rows")
    return row_numbers(rows, ["slug", "setting"], "_signed", "method").drop("_signed")


#: Rows of a board's setting that one task ranks, and parts that a larger one is spread over.
RANKED_AT_ONCE, RANK_PARTS = 1_000_000, 64


def row_numbers(rows: DataFrame, key: list[str], value: str, tie: str, parts: int = RANK_PARTS, out: str = "rank") -> DataFrame:
    """``rank``: the place of each row within its key, the largest value first, nulls last, ties by
    ``tie``. rows must be staged, they are read several times.

    Where a key has more than RANKED_AT_ONCE rows, keys are cut into ranges of values, at quantiles
    of their own values, and a row's place is its place in its range behind all rows of the ranges
    before, so no task ranks a whole hot key. Cuts only spread the work: with any, or none, the
    places are the same."""
    if rows.groupBy(*key).count().filter(F.col("count") > RANKED_AT_ONCE).isEmpty():
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(F.col(value).desc_nulls_last(), tie)))
    cuts = rows.groupBy(*key).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    known = F.col(value).isNotNull()
    part = F.when(known, F.size(F.filter("_cuts", lambda c: c > F.col(value)))).otherwise(parts)
    placed = rows.join(cuts, key).withColumn("_part", part).drop("_cuts")
    sizes = placed.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_part").orderBy(F.col(value).desc_nulls_last(), tie)
    numbered = placed.withColumn("_at", F.row_number().over(inside)).join(starts, [*key, "_part"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_at")).cast("int")).select(*rows.columns, out)


def pivoted(rows: DataFrame) -> DataFrame:
    """(slug, setting, method, values): one row per method with a map of metric to value."""
    return latest_rows(rows).groupBy("slug", "setting", "method").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("values"), F.max_by("arxiv_id", F.struct("seq", "arxiv_id")).alias("arxiv_id")
    )


def rendered(rows: DataFrame) -> DataFrame:
    """(slug, markdown): a section per setting, a table with a column per metric, notes below it.

    A board is as large as its methods; boards are rendered apart from each other.
    """
    now = latest_rows(rows)
    # a board has one name and a metric one direction, however they were spelt
    each = now.groupBy("slug", "setting", "metric").agg(F.min("benchmark").alias("b"), F.bool_or(F.coalesce("higher_is_better", F.lit(True))).alias("up"))
    metrics = each.groupBy("slug", "setting").agg(F.min("b").alias("benchmark"), F.array_sort(F.collect_list(F.struct("metric", "up"))).alias("ms"))
    lead = metrics.select("slug", "setting", F.col("ms")[0]["metric"].alias("metric"))
    rank = ranked(rows, lead).select("slug", "setting", "method", "rank")
    table = pivoted(rows).join(rank, ["slug", "setting", "method"], "left").join(metrics, ["slug", "setting"])
    shown = F.array_join(F.transform("ms", lambda m: F.coalesce(F.try_element_at(F.col("values"), m["metric"]).cast("string"), F.lit("-"))), " | ")
    line = F.concat(F.lit("| "), F.coalesce(F.col("rank").cast("string"), F.lit("-")), F.lit(" | "), "method", F.lit(" | "), shown, F.lit(" | "), F.coalesce("arxiv_id", F.lit("")), F.lit(" |  |"))
    head = F.concat(F.lit("| Rank | Method | "), F.array_join(F.transform("ms", lambda m: F.concat(m["metric"], F.when(m["up"], "↑").otherwise("↓"))), " | "), F.lit(" | Paper | Notes |"))
    rule = F.concat(F.lit("|---|---|"), F.repeat(F.lit("---|"), F.size("ms")), F.lit("---|---|"))
    order = F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("r"), F.col("method").alias("m"), line.alias("line"))
    sections = table.groupBy("slug", "benchmark", "setting", head.alias("head"), rule.alias("rule")).agg(F.array_sort(F.collect_list(order)).alias("ls"))
    noted = now.filter("note <> ''").groupBy("slug", "setting").agg(F.array_join(F.array_sort(F.collect_set("note")), "\n").alias("notes"))
    sections = sections.join(noted, ["slug", "setting"], "left")
    below = F.coalesce(F.concat(F.lit("\n\n"), "notes"), F.lit(""))
    text = F.concat(F.lit("## "), "setting", F.lit("\n\n"), "head", F.lit("\n"), "rule", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), below)
    boards = sections.groupBy("slug").agg(F.min("benchmark").alias("b"), F.array_sort(F.collect_list(F.struct("setting", text.alias("t")))).alias("ts"))
    return boards.select("slug", F.concat(F.lit("# "), "b", F.lit("\n\n"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))


# --- look-up in text -------------------------------------------------------------------------


def _data_lines(md: Column) -> Column:
    return F.filter(lines(md), lambda x: x.contains("|") & ~x.contains("---") & ~x.contains("Rank"))


def _method_cell(cs: Column) -> Column:
    return F.when(F.size(cs) > 2, F.get(cs, F.lit(2))).otherwise("")


def find_value(md: Column, method: Column, metric: Column) -> Column:
    """The number under a metric for the first row whose method contains, or is contained in, the
    asked one. Headers are lines with ``Rank``; every data line of the text is looked at for each
    header, and the next header counts only if no row had a number."""
    headers = F.filter(lines(md), lambda x: x.contains("|") & x.contains("Rank"))
    rows = F.transform(_data_lines(md), cells)

    def under(header: Column) -> Column:
        at = F.array_position(F.transform(cells(header), lambda h: F.lower(without_arrows(h))), F.lower(metric)) - 1
        hits = F.filter(rows, lambda cs: (at >= 0) & (F.size(cs) > at) & contains_either_way(_method_cell(cs), method))
        return F.get(F.filter(F.transform(hits, lambda cs: to_double(F.get(cs, at.cast("int")))), lambda v: v.isNotNull()), F.lit(0))

    return F.get(F.filter(F.transform(headers, under), lambda v: v.isNotNull()), F.lit(0))


def find_paper(md: Column, method: Column, column: int = 5) -> Column:
    """The paper number in a fixed column of the first matching row that has one."""
    rows = F.filter(F.transform(_data_lines(md), cells), lambda cs: (F.size(cs) > column) & contains_either_way(_method_cell(cs), method))
    found = F.transform(rows, lambda cs: paper_id_in(F.get(cs, F.lit(column))))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def table_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, header_pos, row_pos, headers, cells) of the tables in Markdown texts."""
    ls = docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).filter(F.col("line").contains("|") & ~F.col("line").contains("---"))
    is_head = F.col("line").contains("Rank")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = ls.select(key, "pos", cells(F.col("line")).alias("cells"), is_head.alias("head"))
    filled = marked.select(
        "*", F.last(F.when(F.col("head"), F.col("pos")), True).over(w).alias("header_pos"), F.last(F.when(F.col("head"), F.col("cells")), True).over(w).alias("headers")
    )
    return filled.filter(~F.col("head")).select(key, "header_pos", F.col("pos").alias("row_pos"), "headers", "cells")


# --- conflicts and actions -------------------------------------------------------------------


def conflicts_with_board(new: DataFrame, board: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Baseline results that differ from what a board holds, by a fuzzy method match.

    new: (slug, metric, method, value, is_paper_method, ...); board: rows with seq. Equal slug and
    metric join; of the board's rows whose method contains the new one or the other way round the
    first in board order counts.
    """
    own = [c for c in new.columns if c not in ("slug", "method")]
    n = new.filter(~F.col("is_paper_method")).groupBy("slug", "method", F.lower("metric").alias("_metric")).agg(F.collect_list(F.struct(*own)).alias("_own"))
    b = board.select(
        "slug", F.lower("metric").alias("_metric"), F.col("method").alias("known_method"), F.col("value").alias("existing_value"), F.col("arxiv_id").alias("paper_source"), F.col("seq").alias("_seq")
    ).filter("existing_value IS NOT NULL")
    # asked once per distinct method of a board and metric; equal rows of new papers share the answer
    asked = n.select("slug", "method", "_metric")
    near = asked.join(b, ["slug", "_metric"]).filter(contains_either_way(F.col("method"), F.col("known_method")))
    known = F.struct("known_method", "existing_value", "paper_source")
    first = near.groupBy("slug", "method", "_metric").agg(F.min_by(known, F.struct("_seq", "known_method")).alias("k"))
    rows = n.join(first, ["slug", "method", "_metric"]).select("slug", "method", F.explode("_own").alias("o"), "k").select("slug", "method", "o.*", "k.*")
    return rows.select(*new.columns, "known_method", "existing_value", "paper_source").filter(conflicts(F.col("value"), F.col("existing_value"), tolerance))


def conflicts_as_of(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Baseline results that differ from the latest earlier value of the same method.

    Set-based form of processing papers one after the other: every row sees what papers with a
    smaller seq left, for the same slug, setting and method, metric without case. The window is
    keyed by the method too, so a popular board is many small partitions.
    """
    key = ["slug", "setting", F.lower("metric"), F.lower("method")]
    before = Window.partitionBy(*key).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.filter("value IS NOT NULL").select(
        "*", F.last("value", True).over(before).alias("existing_value"), F.last("arxiv_id", True).over(before).alias("paper_source")
    )
    return seen.filter(~F.col("is_paper_method") & conflicts(F.col("value"), F.col("existing_value"), tolerance))


def actions(grouped: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What each (paper, benchmark, setting) group did to its board.

    grouped: (slug, seq, group_pos, arxiv_id, benchmark, setting, summary); found: conflicts with
    (arxiv_id, benchmark, setting). ``conflict_resolved`` with a conflict, else ``new_entry`` for
    the board's first group ever, else ``updated``. The first group is an aggregate, not a window
    over the whole board.
    """
    place = F.struct("seq", "group_pos", "arxiv_id", "setting")
    first = grouped.groupBy("slug").agg(F.min(place).alias("_first"))
    known = grouped.join(first, "slug").withColumn("_new", place == F.col("_first"))
    key = ["arxiv_id", "benchmark", "setting"]
    if found is None:
        n = known.withColumn("n_conflicts", F.lit(0).cast("bigint"))
    else:
        n = known.join(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n_conflicts")), key, "left").fillna({"n_conflicts": 0})
    action = F.when(F.col("n_conflicts") > 0, "conflict_resolved").when(F.col("_new"), "new_entry").otherwise("updated")
    return n.withColumn("action", action).drop("_first", "_new")


def report(acted: DataFrame) -> DataFrame:
    """Per paper: groups and conflicts; every conflict found counts as resolved."""
    return acted.groupBy("arxiv_id").agg(
        F.count(F.lit(1)).alias("n_actions"), F.sum("n_conflicts").alias("conflicts_found"), F.sum("n_conflicts").alias("conflicts_resolved")
    )


def conflict_note(method: Column, metric: Column, new: Column, old: Column, source: Column) -> Column:
    """The note for a conflict that nothing more is known about. Fixed format."""
    return F.concat(
        F.lit("> ⚠ "), method, F.lit("/"), metric, F.lit(": paper reports "), new.cast("string"), F.lit(", existing shows "), old.cast("string"),
        F.lit(" (from "), F.coalesce(source, F.lit("unknown")), F.lit("). Cause unknown."),
    )


def raw_lines_page(existing: Column, benchmark: Column, setting: Column, arxiv_id: Column, result_lines: Column) -> Column:
    """A board's text when no table can be made: the raw lines, on a new page or behind a mark.
    Fixed format."""
    fresh = F.concat(F.lit("# "), benchmark, F.lit("\n\n## "), setting, F.lit("\n\n"), result_lines, F.lit("\n"))
    more = F.concat(existing, F.lit("\n\n<!-- Raw data from "), arxiv_id, F.lit(" -->\n"), result_lines, F.lit("\n"))
    return F.when(F.length(existing) > 0, more).otherwise(fresh)


# --- the exact fold --------------------------------------------------------------------------


def _render(rows: list[dict[str, Any]]) -> str:
    by_setting: dict[str, dict[str, list[dict[str, Any]]]] = {}
    metrics: dict[str, set[str]] = {}
    for r in rows:
        by_setting.setdefault(r["setting"], {}).setdefault(r["method"], []).append(r)
        metrics.setdefault(r["setting"], set()).add(r["metric"])
    out = []
    for setting in sorted(by_setting):
        names = sorted(metrics[setting])
        out += [f"## {setting}", "| Rank | Method | " + " | ".join(names) + " | Paper | Notes |", "|" + "---|" * (len(names) + 4)]
        for i, (m, own) in enumerate(by_setting[setting].items(), 1):
            values = {r["metric"]: r["value"] for r in own}
            out.append(f"| {i} | {m} | " + " | ".join(str(values.get(n, "-")) for n in names) + f" | {own[-1]['arxiv_id']} |  |")
    return "\n".join(out)


class Page:
    """A rendered board, taken apart once for many look-ups."""

    def __init__(self, md: str):
        bars = [x for x in md.split("\n") if "|" in x]
        heads = (x for x in bars if "Rank" in x)
        self.heads = [[re.sub("[↑↓]", "", h).strip().lower() for h in x.split("|")] for x in heads]
        rows = ([c.strip() for c in x.split("|")] for x in bars if "---" not in x and "Rank" not in x)
        self.rows = [((cs[2] if len(cs) > 2 else "").lower(), cs) for cs in rows]

    @classmethod
    def joined(cls, pages: Iterable[Page]) -> Page:
        """Pages one after the other as one."""
        out = cls("")
        for p in pages:
            out.heads += p.heads
            out.rows += p.rows
        return out

    def value(self, method: str, metric: str) -> float | None:
        """find_value in Python, for the fold and as the tests' second opinion."""
        name, wanted = method.lower(), metric.lower()
        for head in self.heads:
            if wanted not in head:
                continue
            at = head.index(wanted)
            for cell, cs in self.rows:
                if len(cs) > at and (name in cell or cell in name):
                    try:
                        return float(cs[at])
                    except ValueError:
                        pass
        return None


def lookup(md: str, method: str, metric: str) -> float | None:
    return Page(md).value(method, metric)


def fold(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Conflicts of the exact, paper by paper processing of each board (``compat``).

    One task holds one board at a time; boards are independent. A look-up may hit any row of the
    board's text, whatever its setting, so a board can't be parted without other results; of its
    text only the setting that a paper changed is rendered and taken apart again. The pipeline
    uses ``conflicts_as_of``, the set-based form, for which no board is too large.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, dict[tuple[str, str], dict[str, Any]]] = {}
        pages: dict[str, Page] = {}
        out = []
        pdf = pdf[pdf["setting"].notna() & pdf["arxiv_id"].notna()].sort_values(["seq", "arxiv_id", "entry_pos", "result_pos"])
        for _, paper in groupby(pdf.to_dict("records"), key=lambda r: (r["seq"], r["arxiv_id"])):
            settings: dict[str, list[dict[str, Any]]] = {}
            for r in paper:
                settings.setdefault(r["setting"], []).append(r)
            for records in settings.values():
                page = None
                if state and not all(r["is_paper_method"] for r in records):
                    for changed in state.keys() - pages.keys():
                        pages[changed] = Page(_render(list(state[changed].values())))
                    page = Page.joined(pages[k] for k in sorted(state))
                for r in records:
                    if page and not r["is_paper_method"] and r["value"] is not None and r["value"] == r["value"]:
                        old = page.value(r["method"], r["metric"])
                        if old is not None and old == old and old != 0 and abs(r["value"] - old) / abs(old) > tolerance:
                            out.append((r["slug"], r["arxiv_id"], r["setting"], r["metric"], r["method"], r["value"], old))
                for r in records:
                    if r["value"] is not None and r["value"] == r["value"]:
                        key, own = (r["metric"], r["method"]), state.setdefault(r["setting"], {})
                        own.pop(key, None)
                        own[key] = r
                        pages.pop(r["setting"], None)
        return pd.DataFrame(out, columns=["slug", "arxiv_id", "setting", "metric", "method", "value", "existing_value"])

    cols = rows.select("slug", "arxiv_id", "seq", "setting", "metric", "method", "value", "is_paper_method", "entry_pos", "result_pos")
    return cols.groupBy("slug").applyInPandas(one, "slug string, arxiv_id string, setting string, metric string, method string, value double, existing_value double")
