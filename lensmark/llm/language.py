"""Language identification by compression.

For each language a dictionary of raw content is cut from learned texts; a text is encoded with
every dictionary by zstandard, and the language whose dictionary leaves the fewest bytes is chosen.
Texts are taken in lower case with everything but letters as one space. Windows are short and from many
texts, so that no dictionary wins by holding a copy of one long passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmark.llm.common import in_fold

#: Bounds of what is fitted: windows of a language, characters of each, and bytes of a dictionary, which takes whole windows
#: in the order of their hashes while they fit.
MOST_TEXTS, MOST_CHARS, DICTIONARY = 500, 200, 96 << 10
LEVEL = 9
#: A choice whose saving over the runner-up is a smaller share than this is marked as rejected.
LEAST_MARGIN = 0.01
UNDETERMINED = "und"


def letters(text):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 3, held_out: int = 1) -> dict[str, bytes]:
    """Language to dictionary content, most frequent language first. Windows of MOST_TEXTS texts of a language, no two alike,
    make its dictionary; which texts and windows is decided by hashes, and how many there are to choose from is counted over all documents."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), letters(F.col(text_column)).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.filter(~in_fold(F.col("id"), folds, held_out)).filter("lang IS NOT NULL AND text <> ''")
    counts = sorted(((r[1], r[0]) for r in rows.groupBy("lang").count().collect()), key=lambda x: (-x[0], x[1]))
    if not counts:
        return {}
    limits = docs.sparkSession.createDataFrame([(y, min(1.0, 2.0 * MOST_TEXTS / n + 20 / n)) for n, y in counts], "lang string, share double")
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.join(F.broadcast(limits), "lang").withColumn("spread", spread).filter("spread < share")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - MOST_CHARS + 1, F.lit(1))).cast("int") + 1
    windows = near.select("lang", "spread", F.substr("text", start, F.lit(MOST_CHARS)).alias("window")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("spread", "window"))
    found = windows.withColumn("r", first).filter(F.col("r") <= MOST_TEXTS).orderBy("lang", "r").collect()  # MOST_TEXTS windows a language at most
    out = {}
    for _, y in counts:
        content = b""
        for r in found:
            if r["lang"] == y and len(content) + len(window := r["window"].encode() + b" ") <= DICTIONARY:
                content += window
        out[y] = content
    return out


def _chosen(batches, content: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    names = list(content)
    encoders = []
    for c in content.values():
        # An encoder needs eight bytes of dictionary at least.
        d = zstandard.ZstdCompressionDict(c if len(c) >= 8 else c + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    for batch in batches:
        lang, score, rejected = [], [], []
        for x in batch.column("text"):
            text = x.as_py()
            if not names or not text:
                lang.append(UNDETERMINED)
                score.append(0.0)
                rejected.append(True)
                continue
            data = text.encode()
            size = np.array([len(e.compress(data)) for e in encoders], float)
            best = int(np.argmin(size))
            rest = np.delete(size, best)
            lang.append(names[best])
            score.append(float(1 / (1 + np.exp(-(rest - size[best]) / (1 + 0.01 * size[best])).sum())))
            rejected.append(bool(len(rest) and rest.min() - size[best] < LEAST_MARGIN * rest.min()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per row of docs: id, held_out, lang_pred, score, rejected.

    Learns where crc32(id) mod 3 is not 1 and lang is not null. lang_pred is a learned language, the more
    frequent one in ties, or ``und`` where the text is null or has no letter, and everywhere if nothing was learned.
    rejected: the margin over the runner-up is narrow (or lang_pred is ``und``); a caller that wants no guesses takes these as undetermined.
    A row of a null id is not learned from and not held out; rows that repeat an id are each judged by their own text. Texts of any
    length are encoded whole. Other columns are ignored; an empty table gives an empty result.
    """
    content = fit(docs, id_column, text_column, lang_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), letters(F.col(text_column)).alias("text"))
    out = rows.mapInArrow(lambda it: _chosen(it, content), "id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(in_fold(F.col("id"), 3, 1), F.lit(False))
    return out.select(F.col("id").alias(id_column), held.alias("held_out"), "lang_pred", "score", "rejected")
