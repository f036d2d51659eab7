"""Folders and small files on whatever file system an address names.

Everything goes through Hadoop's file systems, as Spark's own reads and writes do: a plain path is
looked for on the default file system, ``file:``, ``hdfs:`` or object-store addresses on theirs.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def join(folder: str, *parts: str) -> str:
    return "/".join([folder.rstrip("/") or folder, *parts])


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _plain(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """As _at; on local disks without checksum files, since people edit small files by hand."""
    fs, p = _at(spark, path)
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, _at(spark, new)[1]):
        raise OSError(f"could not move {old} to {new}")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def names(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Names in a folder that end so, in order; a folder that isn't there has none."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(suffix))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _plain(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside and moves it into its place."""
    fs, aside = _plain(spark, f"{path}.new")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    delete(spark, path)
    if not fs.rename(aside, _at(spark, path)[1]):
        raise OSError(f"could not move {path}.new to {path}")


def recover(spark: SparkSession, path: str) -> None:
    """Puts back what a crash left aside between the two moves of ``replace_tables``."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        rename(spark, f"{path}.old", path)


def replace_tables(frames: dict[str, DataFrame]) -> None:
    """Overwrites Parquet tables, by path, that the frames themselves may read.

    All are written aside before any is moved in. The old table is moved aside, not deleted,
    until the new ones are all in place, so at any moment each table is there under its name or
    as ``.old``, which ``recover`` puts back.
    """
    for path, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}.new")
    for path, df in frames.items():
        spark = df.sparkSession
        if exists(spark, path):
            delete(spark, f"{path}.old")
            rename(spark, path, f"{path}.old")
        rename(spark, f"{path}.new", path)
    for path, df in frames.items():
        delete(df.sparkSession, f"{path}.old")
