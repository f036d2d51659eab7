"""Files of binaries, pages and Markdown boards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import safe_id, strip
from lorebase.sources import storage

PAGES = 20


def to_fetch(papers: DataFrame, fetched: DataFrame) -> DataFrame:
    """(arxiv_id, pdf_url, path) of papers whose file isn't there yet; the file is the cache."""
    wanted = papers.filter("pdf_url IS NOT NULL").groupBy("arxiv_id").agg(F.min("pdf_url").alias("pdf_url"))
    named = wanted.withColumn("path", F.concat(safe_id(F.col("arxiv_id")), F.lit(".pdf")))
    return named.join(fetched.select("path"), "path", "left_anti").select("arxiv_id", "pdf_url", "path")


def stored_files(spark: SparkSession, folder: str, suffix: str = "*.pdf") -> DataFrame:
    """(path, content) of a folder's files, path without the folder. The content is only read if
    a plan uses it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content", "length")


def extract(files: DataFrame, pages_of: Callable[[bytes], list[str]], most: int = PAGES) -> DataFrame:
    """(path, text, error): the first pages' text of each file, pages joined by a line feed.

    pages_of is the extractor of a file format; what it raises becomes the row's error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path, "\n".join(pages_of(bytes(content))[:most]), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, entities back, blanks as one."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<(br|/p|/h[1-6]|/li|/tr|/div)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"))


def boards(spark: SparkSession, folder: str) -> DataFrame:
    """(name, markdown) of a folder's Markdown files, in order of name."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return files.select(name.alias("name"), F.col("value").alias("markdown")).orderBy("name")


def valid_name(name: str) -> str:
    """A file name that stays in its folder, or an error."""
    if not re.fullmatch(r"[\w][\w.\- ]*\.md", name):
        raise ValueError(f"not a board's file name: {name!r}")
    return name


def write_boards(rendered: DataFrame, folder: str) -> int:
    """One Markdown file per board (slug, markdown); boards come to the driver one by one."""
    spark = rendered.sparkSession
    storage.make_folder(spark, folder)
    n = 0
    for slug, markdown in rendered.select("slug", "markdown").toLocalIterator():
        storage.write_text(spark, storage.join(folder, valid_name(f"{slug}.md")), markdown)
        n += 1
    return n


def baselines_page(baselines: DataFrame) -> DataFrame:
    """(markdown): a page of (name, paper, note), three lines each, with defaults for nulls."""
    entry = F.concat(
        F.lit("## "), F.coalesce("name", F.lit("Unknown")), F.lit("\n- Paper: "), F.coalesce("paper", F.lit("N/A")), F.lit("\n- Why: "), F.coalesce("note", F.lit("N/A"))
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("t")))), lambda x: x["t"]), "\n\n")
    return baselines.agg(F.concat(F.lit("# Classic Baselines\n\n"), listed, F.lit("\n")).alias("markdown"))
