"""Session settings and the ways to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "lorebase", **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE with skew handling."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where it is unset and the session is local, as in tests, an own folder is made. A
    cluster without the setting is an error: a machine-local folder would lose data with a
    machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    now = sc.getCheckpointDir()
    if now:
        return now
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lorebase-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir() or made


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; for frames that an iteration grows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes the frame once as Parquet in the shared folder and reads it back.

    Against ``checkpoint()`` this keeps column pruning and compression, so it is the choice for
    wide frames that several later plans read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for held in _STAGED:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[list[str]] = []


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Within it, what ``stage`` writes is noted, and deleted at its end; frames that read staged
    data must have been written or collected by then."""
    held: list[str] = []
    _STAGED.append(held)
    try:
        yield
    finally:
        _STAGED.remove(held)
        for path in held:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether the frame has at most ``bound`` rows; reads no more than it must to know."""
    return df.limit(bound + 1).count() <= bound
