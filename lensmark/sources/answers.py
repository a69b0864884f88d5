"""Models' answers kept by what was asked: a table addressed by the digest of back end and prompt.

A prompt is asked once, however many rows hold it, whichever run comes again and whichever task fails: prompts that the table has are not asked; the others are
dealt by digest to BUCKETS, and each bucket's task writes what it was told to a log of its own before it asks on. A task that is repeated, or a run that follows a failed one,
reads the log first. When all are told, the new answers are appended to the table in one job, and the logs go. Errors are never kept: they are asked again by the next run.
The folder is mounted: a plain path or file: URL on all machines.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.sources.scratch import written

BUCKETS = 256
#: Prompts that a task asks at once, between two writes of its log.
AT_ONCE = 64
ANSWER = "key string, backend string, prompt string, answer string"


def key_of(backend: str, prompt: str = "prompt") -> F.Column:
    return F.sha2(F.concat(F.lit(backend), F.lit("\x00"), F.coalesce(prompt, F.lit(""))), 256)


def _local(folder: str) -> str:
    path = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder
    if not path.startswith("/"):
        raise ValueError(f"answers need a mounted folder, not {folder}")
    return path.rstrip("/")


def _logged(path: str) -> dict[str, str]:
    """Answers of a log; a last line that was cut off does not count."""
    told: dict[str, str] = {}
    with contextlib.suppress(FileNotFoundError), open(path, encoding="utf-8") as f:
        for line in f:
            with contextlib.suppress(ValueError):
                row = json.loads(line)
                told[row[0]] = row[1]
    return told


def known(spark: SparkSession, folder: str) -> DataFrame:
    """The table: key, backend, prompt, answer; empty where nothing was kept yet. Should two runs at once have told a key, one row of it counts."""
    path = f"{_local(folder)}/answers"
    if not os.path.isdir(path):
        return spark.createDataFrame([], ANSWER)
    return spark.read.schema(ANSWER).parquet(path).dropDuplicates(["key"])


Ask = Callable[[list[str]], tuple[list[str | None], list[str | None]]]


def answered_once(df: DataFrame, prompt: str, backend: str, ask: Ask, folder: str) -> DataFrame:
    """df with answer and error of its prompts. ``ask`` takes prompts to as many answers and errors; runs the job that asks, so that the result only reads."""
    spark, path = df.sparkSession, _local(folder)
    os.makedirs(f"{path}/log", exist_ok=True)
    asked = df.select(key_of(backend, prompt).alias("key"), F.coalesce(prompt, F.lit("")).alias("prompt")).distinct()
    new = asked.join(known(spark, folder).select("key"), "key", "left_anti")
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    dealt = new.withColumn("bucket", bucket).repartitionById(BUCKETS, "bucket").sortWithinPartitions("key")
    digest = f"{backend}-".replace("/", "_")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: dict[str, str] | None = None
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                rows = batch.iloc[at : at + AT_ONCE]
                log = f"{path}/log/{digest}{rows['bucket'].iloc[0]:04d}.jsonl"
                told = _logged(log) if told is None else told
                open_ = rows[~rows["key"].isin(told.keys())]
                errors: dict[str, str] = {}
                if len(open_):
                    answers, failed = ask(open_["prompt"].tolist())
                    with open(log, "a", encoding="utf-8") as f:
                        for key, answer, error in zip(open_["key"], answers, failed, strict=True):
                            if error is None and answer is not None:
                                told[key] = answer
                                f.write("\n" + json.dumps([key, answer]) + "\n")
                            else:
                                errors[key] = error or "no answer"
                        f.flush()
                        os.fsync(f.fileno())
                yield pd.DataFrame({"key": rows["key"], "prompt": rows["prompt"], "answer": [told.get(k) for k in rows["key"]], "error": [errors.get(k) for k in rows["key"]]})

    out = dealt.mapInPandas(run, "key string, prompt string, answer string, error string")
    # One pass asks and writes; what was told is then appended by a job that only reads. Errors are this run's own.
    told = written(out, "told")
    told.filter("error IS NULL").select("key", F.lit(backend).alias("backend"), "prompt", "answer").write.mode("append").parquet(f"{path}/answers")
    shutil.rmtree(f"{path}/log", ignore_errors=True)
    errors = told.filter("error IS NOT NULL").select("key", "error")
    kept = known(spark, folder).select("key", "answer")
    keyed = df.withColumn("asked key", key_of(backend, prompt))
    both = keyed.join(kept.withColumnRenamed("key", "asked key"), "asked key", "left").join(errors.withColumnRenamed("key", "asked key"), "asked key", "left")
    return both.select(*df.columns, "answer", "error")
