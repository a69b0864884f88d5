"""Byte-level BPE encoding and decoding of whole tables."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmark.llm import bpe
from lensmark.llm.common import pieces


class TokenBytes:
    """All tokens' bytes in one array, and where each token's are."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes start in the text of all ids, and the text's length."""
        return np.concatenate(([0], np.cumsum(self.size[ids])))

    def text(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bytes of ids that start at ``at`` (one more than ids: the last is the length)."""
        size = np.diff(at)
        if not np.array_equal(size, self.size[ids]):
            raise ValueError("offsets do not belong to these ids")
        return self.data[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])]


@functools.lru_cache(1)
def _tables(path: str) -> tuple[TokenBytes, bpe.Merged]:
    """Tokens' bytes and kept pre-tokens, of all tasks of a worker: neither is made anew for each."""
    ranks = bpe.tiktoken_ranks(path)

    def make(piece: bytes) -> tuple[bytes, bytes]:
        """What is kept of a pre-token: its ids as decimals, each after a space, and packed."""
        ids = bpe.merge_pairs(piece, ranks)
        return b"".join([b" %d" % i for i in ids]), array("I", ids).tobytes()

    return TokenBytes(ranks), bpe.Merged(make, 500_000)


def _encoded(batches, path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    known, merged = _tables(path)
    for batch in batches:
        for first, end, data, offsets in pieces(batch.column(1)):
            texts = bpe.merged_texts(data, offsets, merged)
            digests = [hashlib.sha256(b"".join([p[0] for p in parts])[1:]).hexdigest() for parts in texts]
            packed = [b"".join([p[1] for p in parts]) for parts in texts]
            cut = np.cumsum([0, *map(len, packed)]) // 4  # texts' places among all ids
            ids = np.frombuffer(b"".join(packed), np.uint32)
            at = known.offsets(ids)
            decoded = known.text(ids, at).tobytes()
            own = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(at[cut[:-1]].tolist(), at[cut[1:]].tolist(), strict=True)]
            columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(cut)), pa.array(digests, pa.string()), pa.array(own, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                within = at[:-1] - np.repeat(at[cut[:-1]], np.diff(cut))
                lists = pa.array(cut, pa.int32())
                columns += [pa.ListArray.from_arrays(lists, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(within))]
                names += ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, path: str, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: its id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and offsets (the byte at which
    each id's text starts).

    path: a file of ranks that executors can read. ids_sha256 is of the decimal ids joined by one
    space, decoded_sha256 of the bytes that the ids decode to. A null text counts as empty: no ids, the digests of the
    empty string. Texts of any length are encoded whole, one at a time if they exceed a pass. Null and repeated ids pass
    through, each row on its own; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<bigint>" * with_ids
    return rows.mapInArrow(lambda it: _encoded(it, path, with_ids), schema).withColumnRenamed("id", id_column)


def _decoded(batches, path: str) -> Iterator[pa.RecordBatch]:
    known, _ = _tables(path)
    for batch in batches:
        texts = []
        for ids, at in zip(batch.column(1), batch.column(2), strict=True):
            if not ids.is_valid or not len(ids):
                texts.append("")
                continue
            ids, at = ids.values.to_numpy(), at.values.to_numpy()
            at = np.append(at, at[-1] + known.size[ids[-1]]) - at[0]
            texts.append(known.text(ids, at).tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids", offsets_column: str = "offsets") -> DataFrame:
    """The texts of encode(with_ids=True)'s rows, or of slices of their ids and offsets; null and empty ids give the empty text.
    Every id's bytes go where its offset says; offsets that do not follow from the ids are an error."""
    rows = encoded.select(F.col(id_column).cast("long").alias("id"), F.col(ids_column).cast("array<int>").alias("ids"), F.col(offsets_column).cast("array<bigint>").alias("offsets"))
    return rows.mapInArrow(lambda it: _decoded(it, path), "id long, text string").withColumnRenamed("id", id_column)
