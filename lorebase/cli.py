"""Command line: ``python -m lorebase.cli COMMAND`` over a folder of tables.

Model-backed steps are replayed from a table of recorded replies (``--replies``).
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import safe_id
from lorebase.operators import crawl, experiments, gates, knowledge, upsert
from lorebase.plans import pipeline, providers
from lorebase.session import build_session, stage, staged
from lorebase.sources import bundle, config, files, storage
from lorebase.tables import DDL, empty, load


def tables_of(spark: SparkSession, folder: str, make: bool = False) -> dict[str, DataFrame]:
    """The folder's tables; those it doesn't hold are empty. A folder that isn't there is an error
    unless it is to be made: an address that is wrong must not look like an empty store."""
    if not storage.exists(spark, folder):
        if not make:
            raise FileNotFoundError(f"no folder of tables at {folder}")
        storage.make_folder(spark, folder)
    out = {}
    for t in DDL:
        path = storage.join(folder, f"{t}.parquet")
        storage.recover(spark, path)
        out[t] = load(spark, folder, t) if storage.exists(spark, path) else empty(spark, t)
    return out


def save(tables: dict[str, DataFrame], folder: str, names: list[str]) -> None:
    storage.replace_tables({storage.join(folder, f"{t}.parquet"): tables[t] for t in dict.fromkeys(names)})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorebase")
    p.add_argument("-c", "--config", default="config.yaml")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-d", "--data", default="data")
    p.add_argument("--replies", help="Parquet table (request_key, reply) of recorded replies")
    p.add_argument("--vectors", help="Parquet table (text_key, embedding) of recorded embeddings; without it documents are stored without")
    p.add_argument("--files", help="folder of papers' files, named by id, to take the texts from in place of the documents")
    p.add_argument("--extractor", default="", help="MODULE:FUNCTION from a file's bytes to its pages' texts")
    p.add_argument("--as-of", help="the moment that counts as now, ISO; default: now")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("crawl", "filter", "pipeline"):
        sub.add_parser(name).add_argument("--feed", help="Parquet table of crawled papers")
    sub.add_parser("read").add_argument("arxiv_id")
    sub.add_parser("sota")
    sub.add_parser("stats")
    sub.add_parser("export").add_argument("path", nargs="?", default="export")
    imp = sub.add_parser("import")
    imp.add_argument("path")
    imp.add_argument("--merge", action="store_true")
    on = sub.add_parser("onboard")
    on.add_argument("--profile", required=True)
    on.add_argument("--topic", nargs="+", action="append", required=True, help="NAME QUERY [CATEGORY ...]")
    on.add_argument("--threshold", type=int, default=6)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "onboard":
        topics = [{"name": t[0], "query": t[1], "categories": t[2:]} for t in a.topic]
        config.save_onboarding(a.config, a.profile, topics, a.threshold)
        return 0
    spark = spark or build_session()
    with staged(spark):
        return run(a, spark)


def extractor_of(named: str) -> Callable[[bytes], list[str]]:
    """A function by MODULE:NAME that turns a file's bytes into its pages' texts."""
    module, _, name = named.partition(":")
    return getattr(importlib.import_module(module), name)


def texts_of(spark: SparkSession, a: argparse.Namespace, tables: dict[str, DataFrame]) -> DataFrame:
    """(arxiv_id, text) of the papers: out of files, if a folder of them is named, else of documents."""
    if a.files:
        pages = files.extract(files.stored_files(spark, a.files, "*"), extractor_of(a.extractor))
        stem = F.regexp_replace("path", r"\.[^.]*$", "")
        named = tables["papers"].select("arxiv_id", safe_id(F.col("arxiv_id")).alias("stem")).distinct()
        return pages.filter("error IS NULL").select(stem.alias("stem"), "text").join(named, "stem").select("arxiv_id", "text")
    rows = tables["documents"].filter("arxiv_id IS NOT NULL")
    return rows.groupBy("arxiv_id").agg(F.max_by("text", F.struct("n_chars", "doc_id")).alias("text"))


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    settings_file = config.load_config(a.config)
    now = datetime.fromisoformat(a.as_of) if a.as_of else datetime.now(timezone.utc)
    as_of = F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    settings = pipeline.Settings(settings_file.scraper.max_results_per_topic, settings_file.scraper.days_lookback, settings_file.filter.relevance_threshold)
    tables = tables_of(spark, a.data, make=a.command in ("crawl", "import", "pipeline"))
    if settings_file.topics:
        tables["topics"] = config.topics_frame(spark, settings_file)
    recorded = spark.read.parquet(a.replies) if a.replies else spark.createDataFrame([], "request_key string, reply string")
    vectors = spark.read.parquet(a.vectors) if a.vectors else None
    ask = lambda requests: providers.replay(requests, recorded)
    embed = None if vectors is None else (lambda texts: providers.replay_vectors(texts, vectors))
    boards = settings_file.sota_dir

    if a.command == "stats":
        for k, v in knowledge.counts({t: tables[t] for t in ("papers", "relevance_verdicts", "deep_readings", "contribution_deltas")}).first().asDict().items():
            print(f"{k}: {v}")
        return 0
    if a.command == "sota":
        for name, text in files.boards(spark, boards).toLocalIterator() if storage.names(spark, boards, ".md") else []:
            print(f"=== {name}\n{text}")
        return 0
    if a.command == "export":
        pages = {f"{r[0]}.md": r[1] for r in files.boards(spark, boards).toLocalIterator()} if storage.names(spark, boards, ".md") else {}
        cfg: dict[str, Any] = {"topics": [vars(t) for t in settings_file.topics], "filter": vars(settings_file.filter)}
        bundle.export_bundle(tables, a.path, now, cfg, pages)
        for t, n in knowledge.counts({t: tables[t] for t in bundle.TABLES}).first().asDict().items():
            print(f"{t}: {n}")
        return 0
    if a.command == "import":
        out, counts = bundle.import_bundle(spark, a.path, tables, a.merge, boards)
        save(out, a.data, list(out))
        print(counts)
        return 0

    ledger, number = None, int(now.timestamp())
    if a.command == "pipeline":
        ledger = stage(upsert.start_run(tables["pipeline_runs"], as_of), "runs")
        number = ledger.agg(F.max("id")).first()[0]
        save({"pipeline_runs": ledger}, a.data, ["pipeline_runs"])
    try:
        code, counts = work(a, spark, tables, settings, settings_file, as_of, number, ask, embed)
    except Exception:
        if ledger is not None:
            save({"pipeline_runs": upsert.finish_run(ledger, number, as_of, 0, 0, 0, "failed")}, a.data, ["pipeline_runs"])
        raise
    if ledger is not None:
        save({"pipeline_runs": upsert.finish_run(ledger, number, as_of, *counts)}, a.data, ["pipeline_runs"])
    return code


def work(
    a: argparse.Namespace, spark: SparkSession, tables: dict[str, DataFrame], settings: pipeline.Settings, settings_file: config.Config, as_of: Column, number: int,
    ask: pipeline.Provider, embed: pipeline.Provider | None,
) -> tuple[int, tuple[int, int, int]]:
    """The stages of ``crawl``, ``filter``, ``read`` and ``pipeline``: (exit code, (crawled, filtered, read))."""
    before = {t: tables[t] for t in ("relevance_verdicts", "deep_readings")}
    errors: list[DataFrame] = []
    changed: list[str] = []
    crawled = 0
    if a.command in ("crawl", "pipeline") and a.feed:
        places = {t.name: i for i, t in enumerate(settings_file.topics)}
        at = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col("source_topic")] if places else F.lit(0)
        feed = spark.read.parquet(a.feed).withColumn("topic_pos", F.coalesce(at, F.lit(1 << 20)))
        crawled = crawl.newest_per_topic(feed, settings.per_topic, as_of, settings.lookback_days).select("arxiv_id").distinct().count()
        tables = pipeline.crawl_stage(tables, feed, as_of, settings)
        changed.append("papers")
    if a.command in ("filter", "pipeline"):
        tables, e = pipeline.filter_stage(tables, ask, as_of, settings)
        errors.append(e)
        changed.append("relevance_verdicts")
    if a.command in ("read", "pipeline"):
        only = spark.createDataFrame([(a.arxiv_id,)], "arxiv_id string") if a.command == "read" else None
        if only is not None and tables["papers"].join(only, "arxiv_id", "left_semi").isEmpty():
            print(f"unknown paper {a.arxiv_id}", file=sys.stderr)
            return 1, (0, 0, 0)
        tables, e = pipeline.read_stage(tables, texts_of(spark, a, tables), ask, as_of, settings, only, parser=ask)
        errors.append(e)
        changed.append("deep_readings")
        tables, e = pipeline.analyse_stage(tables, ask, as_of, settings, number, embed)
        errors.append(e)
        changed += ["contribution_deltas", "leaderboard", "sota_updates", "kb"]
        files.write_boards(tables["board_pages"], settings_file.sota_dir)
    failed = 0
    for e in errors:
        e = stage(e, "errors")
        failed += e.count()
        for arxiv_id, error in e.toLocalIterator() if a.verbose else []:
            print(f"{arxiv_id}: {error}", file=sys.stderr)
    if failed:
        print(f"{failed} failed and stay open", file=sys.stderr)
    if a.command == "read":
        for t, report in (("deep_readings", experiments.reading_report), ("contribution_deltas", experiments.delta_report)):
            for r in report(gates.by_id(tables[t], a.arxiv_id)).toLocalIterator():
                print(r["report"])
        for r in gates.by_id(tables["sota_updates"], a.arxiv_id).select("action", "summary").toLocalIterator():
            print(f"  [{r[0]}] {r[1]}")
    new = [tables[t].join(before[t].select("arxiv_id"), "arxiv_id", "left_anti").count() for t in before]
    save(tables, a.data, changed)
    return int(a.command == "read" and failed > 0), (crawled, new[0], new[1])


if __name__ == "__main__":
    sys.exit(main())
