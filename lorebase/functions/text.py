"""String expressions. All are built-in Column expressions and stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class with every white space character of Unicode, for Java's regex.
WHITE = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters, one by one.
WHITE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column) -> Column:
    """Without outer white space of any kind (SQL's trim takes off spaces only).

    A trim by a set of characters looks at the ends only, where a regex would scan the text.
    """
    return F.btrim(c, F.lit(WHITE_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (F.length(strip(c)) == 0)


def clip(c: Column, n: int) -> Column:
    """The first n characters (code points)."""
    return F.substring(c, 1, n)


def clip_end(c: Column, n: int) -> Column:
    """The last n characters; a shorter text is returned whole."""
    return F.right(c, F.lit(n))


def latter_two_thirds(c: Column) -> Column:
    return F.substring(c, F.floor(F.length(c) / 3).cast("int") + 1, F.length(c))


def slug(c: Column) -> Column:
    """Lower case, only letters, digits, underscore, blanks and hyphens kept, blanks to ``_``."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(strip(kept), r"\s+", "_")


def safe_id(c: Column) -> Column:
    """An id as a file name: ``/`` and ``.`` become ``_``."""
    return F.translate(c, "/.", "__")


def id_of_address(c: Column) -> Column:
    """What follows the last ``/abs/``; the version stays part of the id."""
    return F.element_at(F.split(c, "/abs/"), -1)


def paper_id_in(c: Column) -> Column:
    """The first thing that looks like a paper number, null if there is none."""
    found = F.regexp_extract(c, r"[0-9]{4}[.][0-9]{4,5}", 0)
    return F.when(found != "", found)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def cells(line: Column) -> Column:
    """The cells of a ``|`` table line, each without outer white space; outer empties are kept."""
    return F.transform(F.split(line, "[|]", -1), strip)


def without_arrows(c: Column) -> Column:
    return strip(F.translate(c, "↑↓", ""))


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def contains_either_way(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def without_code_fence(c: Column) -> Column:
    """The inside of a fenced block if the text begins with a fence, else the text."""
    body = F.regexp_replace(F.regexp_replace(strip(c), r"\A```[^\n]*\n?", ""), r"\n?```[ \t]*\z", "")
    return F.when(strip(c).startswith("```"), strip(body)).otherwise(c)


def numbered_lines(c: Column) -> Column:
    """``    1| first`` and so on; numbers of more than five digits are not cut."""

    def one(line: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.concat(F.when(F.length(n) < 5, F.lpad(n, 5, " ")).otherwise(n), F.lit("| "), line)

    return F.array_join(F.transform(lines(c), one), "\n")


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled; a null value counts as empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not at:
            parts.append(F.lit(rest))
            break
        i, k = min(at)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(values[k].cast("string"), F.lit("")))
        rest = rest[i + len(k) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def bulleted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def numbered(items: Column) -> Column:
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )


def arrow(higher_is_better: Column) -> Column:
    return F.when(higher_is_better, "↑").otherwise("↓")


def direction(higher_is_better: Column) -> Column:
    return F.when(higher_is_better, "higher").otherwise("lower")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
