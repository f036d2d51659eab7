"""Knowledge out of and into a bundle.

A bundle is a folder: ``manifest.json`` (version, time, configuration, boards) and one folder of
JSON lines per table, written and read by all tasks. ``one_document`` gives the same as a single
JSON text for a knowledge base that is small enough for one.
"""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.upsert import last_of_each, upsert_papers, upsert_rows
from lorebase.session import rows_at_most
from lorebase.sources import storage
from lorebase.sources.files import valid_name
from lorebase.tables import empty, schema

VERSION = 1
TABLES = ("papers", "relevance_verdicts", "deep_readings", "contribution_deltas")
#: JSON with nulls kept and times to the microsecond, which the default would cut.
JSON = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Rows of a table up to which it may become an array of a single document.
ONE_DOCUMENT_ROWS = 100_000


def export_bundle(tables: dict[str, DataFrame], folder: str, at: datetime, config: dict[str, Any] | None = None, boards: dict[str, str] | None = None) -> None:
    held = [t for t in TABLES if t in tables]
    if not held:
        raise ValueError("no tables to export")
    spark = tables[held[0]].sparkSession
    storage.make_folder(spark, folder)
    for name in held:
        tables[name].select(schema(name).names).write.mode("overwrite").options(**JSON).json(storage.join(folder, name))
    pages = {valid_name(k): v for k, v in sorted((boards or {}).items())}
    manifest = {
        "version": VERSION, "exported_at": at.isoformat(), "config": config or {}, "tables": held,
        "classic_baselines_md": pages.pop("classic_baselines.md", ""), "sota_tables": pages,
    }
    storage.write_text(spark, storage.join(folder, "manifest.json"), json.dumps(manifest, ensure_ascii=False, indent=1))


def read_manifest(spark: SparkSession, folder: str) -> dict[str, Any]:
    manifest = json.loads(storage.read_text(spark, storage.join(folder, "manifest.json")))
    if manifest.get("version", 0) != VERSION:
        raise ValueError(f"unsupported bundle version {manifest.get('version', 0)}, expected {VERSION}")
    for name in manifest.get("sota_tables", {}):
        valid_name(name)
    return manifest


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The bundle's tables; one that the manifest lists and the folder lacks is an error."""
    held = read_manifest(spark, folder).get("tables", [t for t in TABLES if storage.exists(spark, storage.join(folder, t))])
    if lost := [t for t in held if not storage.exists(spark, storage.join(folder, t))]:
        raise FileNotFoundError(f"the bundle {folder} lacks {', '.join(lost)}")
    return {t: spark.read.schema(schema(t)).options(**JSON).json(storage.join(folder, t)) if t in held else empty(spark, t) for t in TABLES}


def import_bundle(spark: SparkSession, folder: str, old: dict[str, DataFrame], merge: bool, boards_folder: str | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables after the import, and the number of imported rows of each and of boards.

    Without merge the old tables are dropped, the audit rows too, which no bundle holds; with it
    the bundle's rows are upserted like single records: papers take title and abstract, the others
    all but the time they were first stored.
    """
    manifest, new = read_manifest(spark, folder), read_bundle(spark, folder)
    counts = {t: df.count() for t, df in new.items()}
    out: dict[str, DataFrame] = {}
    for t, df in new.items():
        one = last_of_each(df, ["arxiv_id"], F.col("created_at"))
        if not merge:
            out[t] = one
        else:
            out[t] = (upsert_papers if t == "papers" else upsert_rows)(old.get(t, empty(spark, t)), one)
    out["sota_updates"] = old.get("sota_updates", empty(spark, "sota_updates")) if merge else empty(spark, "sota_updates")
    pages = dict(manifest.get("sota_tables", {}))
    if manifest.get("classic_baselines_md"):
        pages["classic_baselines.md"] = manifest["classic_baselines_md"]
    if boards_folder:
        storage.make_folder(spark, boards_folder)
        for name, text in pages.items():
            storage.write_text(spark, storage.join(boards_folder, valid_name(name)), text)
        for name in [] if merge else storage.names(spark, boards_folder, ".md"):
            if name not in pages:
                storage.delete(spark, storage.join(boards_folder, name))
    return out, {**counts, "sota_files": len(pages)}


def one_document(tables: dict[str, DataFrame], at: datetime, config: dict[str, Any] | None = None) -> DataFrame:
    """(json): one row with all tables as arrays, rows in order of key and time.

    Only for tables of a checked size, since an array is one value; larger ones are exported as
    a folder.
    """
    for name, df in tables.items():
        if name in TABLES and not rows_at_most(df, ONE_DOCUMENT_ROWS):
            raise ValueError(f"{name} has too many rows for one document; use export_bundle")
    out = None
    for name in TABLES:
        if name not in tables:
            continue
        row = F.struct(*schema(name).names)
        part = tables[name].agg(F.array_sort(F.collect_list(row)).alias(name))
        out = part if out is None else out.join(F.broadcast(part))  # one row each
    assert out is not None
    head = [F.lit(VERSION).alias("version"), F.lit(at.isoformat()).alias("exported_at"), F.lit(json.dumps(config or {})).alias("config")]
    return out.select(F.to_json(F.struct(*head, *out.columns), JSON).alias("json"))


write_tables = storage.replace_tables


def write_table(df: DataFrame, path: str) -> None:
    write_tables({path: df})
