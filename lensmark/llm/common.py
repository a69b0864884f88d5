"""Shared pieces: session settings, written intermediates, Arrow column access."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.sources.scratch import importable, shared_dir

#: Bytes of text that a numpy pass works on at once. A single longer text is one pass of its own.
CHUNK_BYTES = 1 << 20
#: Rows that go to Python at once. Texts are long: Spark's default of 10,000 would hold hundreds of MB in each worker.
ROWS_AT_ONCE = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder so that a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession):
        modest_batches(spark)
        self.spark = spark
        self.tables: dict[int, tuple[str, DataFrame]] = {}  # the frames are held, so that their ids stay theirs

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of save() that nothing lazy refers to any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            if id(df) in self.tables:
                p = jvm.org.apache.hadoop.fs.Path(self.tables.pop(id(df))[0])
                p.getFileSystem(conf).delete(p, True)

    def drop_all_but(self, *keep: DataFrame) -> None:
        held = {id(x) for x in keep}
        self.drop(*(df for k, (_, df) in list(self.tables.items()) if k not in held))


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ROWS_AT_ONCE, if they are more. Results are lazy, so the setting stays."""
    if not 0 < int(spark.conf.get(_ROWS, "10000")) <= ROWS_AT_ONCE:
        spark.conf.set(_ROWS, str(ROWS_AT_ONCE))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started within send so many rows at most to Python at once: for rows that hold whole sets."""
    before = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS)
        else:
            spark.conf.set(_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores appended until no column of df has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Groups that are split in salted_join(), and into how many parts. No other group has more than one HOT-th of all rows.
HOT, SPLIT = 1000, 32


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """rows joined with groups, a written table of one row a key. The HOT groups of the largest ``size`` (a column of groups) are
    copied SPLIT times, and their rows dealt to the copies by ``spread``, so that no task gets a group with a large share of all rows."""
    hot = groups.orderBy(F.desc(size), *keys).limit(HOT).select(*keys, F.lit(SPLIT).alias("parts"))
    dealt = rows.withColumn("spread", spread).join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod("spread", F.lit(SPLIT)).cast("int"))).drop("spread", "parts")
    copies = groups.join(F.broadcast(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [*keys, "part"]).drop("part")


def dealt_join(rows: DataFrame, groups: DataFrame, key: str, sizes: DataFrame, spread: Column) -> DataFrame:
    """rows joined with groups (few rows a key). sizes: a written table of n, rows' number a key. A key of over one HOT-th of all rows has its groups' rows copied,
    SPLIT times at most, and its rows dealt to the copies by ``spread``; there are at most HOT such keys, and small tables have none."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sizes.filter(F.col("n") > max(total // HOT, SPLIT)).select(key, F.least(F.lit(SPLIT), F.ceil(F.col("n") / SPLIT)).cast("int").alias("parts"))
    dealt = rows.withColumn("spread", spread).join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod("spread", F.col("parts")).cast("int"))).drop("spread", "parts")
    copies = groups.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def numbered(docs: DataFrame, id_column: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a long column that tells rows apart in the order of ids, and its name: the ids themselves where they are
    unique longs; where they repeat or are null, numbers of a written table's rows, null ids last."""
    if docs.groupBy(id_column).count().filter(F.col(id_column).isNull() | (F.col("count") > 1)).isEmpty():
        return docs, id_column
    row = free_name(docs, "row")
    return scratch.save(docs.orderBy(F.col(id_column).cast("long").asc_nulls_last()).withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The column in runs of whole texts of about ``size`` bytes: first row, end row, bytes, offsets."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
