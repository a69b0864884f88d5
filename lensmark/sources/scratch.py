"""Intermediates written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package, wherever the driver was started. On a cluster the package is installed or shipped."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode; elsewhere an error, as
    no folder of one machine would do."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


_watched: list[list[str]] = []


def note(path: str) -> str:
    """The path of a scratch table, which scratch_tables() that are open will remove."""
    for paths in _watched:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """All scratch tables that are written within are removed at its end, so results that read them are used or saved within too."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched.remove(paths)
        conf, fs = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            p = fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def written_text(df: DataFrame, tag: str) -> str:
    """The folder of compressed text files of a column of lines in the shared folder."""
    path = note(f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")
    df.write.option("compression", "gzip").text(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df by way of a Parquet table in the shared folder: lineage ends, a lost executor costs a reread. The table stays, as lazy results read it; see scratch_tables()."""
    spark = df.sparkSession
    path = note(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
