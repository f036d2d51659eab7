"""Texts cut into sections, and what each reading pass gets of them.

All of it works inside a row, on arrays of lines: no explode, no shuffle, whatever the number of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import WHITE, latter_two_thirds, lines, strip

#: Heading patterns by priority, each after an optional number; open-ended. Fixed values.
HEADINGS = [
    ("introduction", r"introduction"),
    ("related_work", r"related\s+work"),
    ("background", r"background"),
    ("method", r"(?:method|approach|proposed\s+method|methodology|our\s+approach)"),
    ("experiments", r"(?:experiment|evaluation|results|empirical)"),
    ("discussion", r"discussion"),
    ("conclusion", r"(?:conclusion|concluding)"),
    ("abstract", r"abstract"),
    ("limitations", r"(?:limitation|future\s+work)"),
]
#: Names that a model may give to a section. Fixed values.
STANDARD = ["abstract", "introduction", "related_work", "background", "method", "experiments", "discussion", "conclusion", "limitations", "references", "appendix"]


def heading(line: Column, patterns: list[tuple[str, str]] = HEADINGS) -> Column:
    """The section that a line begins, null for other lines.

    One anchored pattern rejects nearly all lines; only headings are asked for their name.
    """
    start = rf"(?i)^[{WHITE}]*(?:[0-9]+[.]?\s*)?"
    out = F.when(~line.rlike(start + "(?:" + "|".join(p for _, p in patterns) + ")"), F.lit(None).cast("string"))
    for name, pattern in patterns:
        out = out.when(line.rlike(start + pattern), name)
    return out


def section_marks(text: Column, patterns: list[tuple[str, str]] = HEADINGS) -> Column:
    """array<struct<at, name>>: the lines (from 0) where a section begins, ``preamble`` first."""
    found = F.transform(lines(text), lambda line, i: F.struct(i.alias("at"), heading(line, patterns).alias("name")))
    start = F.array(F.struct(F.lit(0).alias("at"), F.lit("preamble").alias("name")))
    return F.concat(start, F.filter(found, lambda x: x["name"].isNotNull()))


def with_sections(df: DataFrame, text: str = "text", out: str = "sections", patterns: list[tuple[str, str]] = HEADINGS) -> DataFrame:
    """Adds array<struct<name, body>> in order of first appearance; a heading belongs to its own
    section, a name that comes again continues its section, empty sections are dropped. Null
    text: null."""
    marked = df.withColumns({"_lines": lines(F.col(text)), "_marks": section_marks(F.col(text), patterns)})

    def piece(m: Column, j: Column) -> Column:
        end = F.coalesce(F.get(F.col("_marks"), j + 1)["at"], F.size("_lines"))
        return F.struct(m["name"].alias("name"), F.slice(F.col("_lines"), m["at"] + 1, end - m["at"]).alias("part"))

    cut = marked.withColumn("_parts", F.transform("_marks", piece))
    names = F.array_distinct(F.transform("_parts", lambda p: p["name"]))

    def body(name: Column) -> Column:
        own = F.flatten(F.transform(F.filter(F.col("_parts"), lambda p: p["name"] == name), lambda p: p["part"]))
        return F.struct(name.alias("name"), strip(F.array_join(own, "\n")).alias("body"))

    return cut.withColumn(out, F.filter(F.transform(names, body), lambda s: F.length(s["body"]) > 0)).drop("_lines", "_marks", "_parts")


def sections_from_bounds(text: Column, bounds: Column) -> Column:
    """Sections out of array<struct<name, start_line, end_line>> (from 1, both inclusive).

    Unknown names are skipped, missing bounds are the text's, all are clamped; a name that comes
    again is appended after a blank line. Null if nothing valid is left.
    """

    def pieces(ls: Column, bs: Column) -> Column:
        n = F.size(ls)

        def piece(b: Column) -> Column:
            start = F.greatest(F.lit(0), F.coalesce(b["start_line"], F.lit(1)) - 1)
            end = F.least(n, F.coalesce(b["end_line"], n))
            part = F.slice(ls, F.least(start, n) + 1, F.greatest(F.lit(0), end - start))
            return F.struct(strip(F.lower(b["name"])).alias("name"), strip(F.array_join(part, "\n")).alias("body"))

        return F.filter(F.transform(bs, piece), lambda s: s["name"].isin(*STANDARD) & (F.length(s["body"]) > 0))

    def joined(parts: Column) -> Column:
        names = F.array_distinct(F.transform(parts, lambda s: s["name"]))
        return F.transform(
            names,
            lambda k: F.struct(k.alias("name"), F.array_join(F.transform(F.filter(parts, lambda s: s["name"] == k), lambda s: s["body"]), "\n\n").alias("body")),
        )

    parts = once(F.struct(lines(text).alias("ls"), bounds.alias("bs")), lambda x: pieces(x["ls"], x["bs"]))
    found = once(parts, joined)
    return once(found, lambda x: F.when(F.size(x) > 0, x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def section_map(sections: Column, text: Column) -> Column:
    """map<string,string> that always holds full_text."""
    pairs = F.map_from_entries(F.transform(sections, lambda s: F.struct(s["name"], s["body"])))
    return F.map_concat(F.map_filter(pairs, lambda k, _: k != "full_text"), F.create_map(F.lit("full_text"), text))


def _joined(m: Column, *names: str) -> Column:
    return F.concat_ws("\n\n", *[F.try_element_at(m, F.lit(k)) for k in names])


def _any(m: Column, *names: str) -> Column:
    out = F.lit(False)
    for k in names:
        out = out | F.map_contains_key(m, k)
    return out


def text_for_pass(m: Column, which: str) -> Column:
    """What a reading pass gets: its sections, or a part of the full text without them."""
    full = F.element_at(m, F.lit("full_text"))
    if which == "method_intro":
        own = ("introduction", "method", "background")
        return F.when(_any(m, *own), _joined(m, *own)).otherwise(F.substring(full, 1, 15000))
    if which == "experiments":
        text = _joined(m, "experiments", "discussion")
        return F.when(F.length(text) < 3000, latter_two_thirds(full)).otherwise(text)
    if which == "context":
        own = ("related_work", "conclusion", "limitations")
        return F.when(_any(m, *own), _joined(m, *own)).otherwise(F.right(full, F.lit(10000)))
    return full
