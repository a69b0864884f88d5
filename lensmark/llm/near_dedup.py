"""MinHash near-dedup with sequential Bayesian verification.

Texts that are the same word sequence form a class; its smallest id stands for it. Each class has a
signature of 128 minima, cut into 32 bands of 4: two classes of similarity 0.8 share no band with
probability 5e-8. Instead of all pairs of a bucket, its members meet pivots. A pair's signatures are
compared 16 positions at a time and it is dropped once the posterior probability of a similarity at
or over the threshold falls below ``miss``; what survives is decided on the full shingle sets.

The pivot of a bucket is its smallest member. Buckets whose other members are then all in one component
are settled. Of the rest, small buckets (SMALL members at most) have their members of different
components compared; large ones are joined to clusters, and a cluster's members outside its largest component
meet all its members, in blocks of bounded size that are compared inside a task and give no more than one link for two
components. So no link between classes that share a band is lost, and rows grow with the members, not their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmark.llm import hashes
from lensmark.llm.common import Scratch, arrow_rows, dealt_join, numbered, pieces, salted_join
from lensmark.llm.components import components

BANDS, ROWS, STEP = 32, 4, 16
SIZE = BANDS * ROWS
_A = np.random.default_rng(1009).integers(1, 2**63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(2003).integers(1, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Above so many ids, an id table is joined by shuffle rather than broadcast (16 MB of longs).
BROADCAST_IDS = 2_000_000
#: Buckets of so many members at most are compared member by member; blocks of others hold about so many shingles.
SMALL, BLOCK_SHINGLES = 16, 250_000
#: Pairs with their full sets in one Arrow batch.
PAIRS_AT_ONCE = 500


def _minima(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The signature of each text's shingles; zeros without any."""
    signature = np.zeros((len(at) - 1, SIZE), np.uint32)
    full = np.flatnonzero(np.diff(at))
    with np.errstate(over="ignore"):
        for j in range(SIZE if len(full) else 0):
            signature[full, j] = np.minimum.reduceat(s * _A[j], at[:-1][full]) >> np.uint64(32)
    return [r.tobytes() for r in signature]


def _signed(values: list[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in values:
        ids = batch.column(0)
        for first, end, data, offsets in pieces(batch.column(1)):
            _, _, h, of = hashes.words(data, offsets)
            s, at = hashes.shingles(h, of, k)
            n = end - first
            counts = np.array([len(np.unique(s[at[i] : at[i + 1]])) for i in range(n)], np.int64)
            d = np.zeros((n, 2), np.uint64)
            for i in range(n):
                w = h[of[i] : of[i + 1]]
                d[i] = hashes.sequence(w), hashes.sequence(w ^ np.uint64(0xA0761D6478BD642F))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64)), pa.array(counts), pa.array(_minima(s, at), pa.binary())],
                ["id", "d1", "d2", "n_shingles", "signature"],
            )


def _banded(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        with np.errstate(over="ignore"):
            h = np.zeros(m.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64) * _B
            for j in range(ROWS):
                h = hashes.mix((h ^ m[:, :, j].astype(np.uint64)) * _B[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(h.ravel().view(np.int64))], ["id", "bucket"])


def fewest_matches(threshold: float, miss: float) -> list[int]:
    """For 16, 32, ... compared positions, the fewest matches at which P(similarity >= threshold) >= miss, prior uniform."""
    out = []
    for n in range(STEP, SIZE + 1, STEP):
        tail, m = 0.0, -1
        while tail < miss:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _surviving(x: np.ndarray, y: np.ndarray, alive: np.ndarray, least: list[int]) -> np.ndarray:
    """Of the rows ``alive`` of signatures x those that no batch of positions rules out against y (a row each, or one for all)."""
    matches = np.zeros(len(x), np.int64)
    for i, m in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches[alive] += (x[alive, part] == (y[alive, part] if y.ndim > 1 else y[part])).sum(1)
        alive = alive[matches[alive] >= m]
    return alive


def _verified(batches, least: list[int], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures survive all batches of positions and whose full sets are similar enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in ("sx", "sy"))
        alive = _surviving(x, y, np.arange(len(x)), least)
        tx, ty = batch.column("tx"), batch.column("ty")
        linked = []
        for i in alive:
            a, b = tx[i].values.to_numpy(), ty[i].values.to_numpy()
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= percent * (len(a) + len(b) - common):
                linked.append(i)
        at = pa.array(linked, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("x").take(at), batch.column("y").take(at)], ["u", "v"])


def _sets(batches, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in pieces(batch.column(1), 1 << 20):
            _, _, h, of = hashes.words(data, offsets)
            s, at = hashes.shingles(h, of, k)
            own = [np.unique(s[at[i] : at[i + 1]]) for i in range(end - first)]
            lengths = np.array([0, *map(len, own)]).cumsum()
            values = pa.array(np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values), pa.array(_minima(s, at), pa.binary())], ["id", "shingles", "signature"])


def _compared(batches, percent: int, least: list[int]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, links between different components: one for each member and component at most."""
    for batch in batches:
        for pair in batch.to_pylist():
            us, vs = [], []
            wide = pair["wide"]
            size = np.array([len(m["shingles"]) for m in wide])
            value = np.concatenate([np.array(m["shingles"], np.int64) for m in wide])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], np.repeat(np.arange(len(wide)), size)[order]
            signatures = np.frombuffer(b"".join([m["signature"] for m in wide]), np.uint32).reshape(-1, SIZE)
            component = np.array([m["component"] for m in wide])
            for m in pair["outside"]:
                near = _surviving(signatures, np.frombuffer(m["signature"], np.uint32), np.flatnonzero(component != m["component"]), least)
                if not len(near):
                    continue
                own = np.array(m["shingles"], np.int64)
                low, high = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
                n = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(wide))
                hit = near[100 * common[near] >= percent * (size[near] + len(own) - common[near])]
                for i in hit[np.unique(component[hit], return_index=True)[1]]:
                    us.append(m["id"])
                    vs.append(wide[i]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _between(rows: DataFrame, sets: DataFrame, percent: int, least: list[int], scratch: Scratch) -> DataFrame:
    """Links between members of different components in clusters of large buckets. rows: bucket, id, component."""
    first = scratch.save(rows.groupBy("bucket").agg(F.min("id").alias("v"), F.count("*").alias("size")), "first")
    star = salted_join(rows, first, ["bucket"], "size", F.xxhash64("id"))
    cluster = components(scratch.save(star.filter("id <> v").select(F.col("id").alias("u"), "v").distinct(), "star"), scratch).toDF("id", "cluster")
    own = rows.select("id", "component").distinct().join(cluster, "id", "left").select("id", "component", F.coalesce("cluster", "id").alias("cluster"))
    own = scratch.save(own.join(sets, "id"), "clustered")
    sizes = own.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("volume"))
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    sided = sizes.join(largest, "cluster").groupBy("cluster", "largest", (F.col("component") == F.col("largest")).alias("inner")).agg(F.sum("volume").alias("volume"))
    blocks = sided.select("cluster", "largest", "inner", F.ceil(F.col("volume") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = scratch.save(own.groupBy("cluster").agg(F.count("*").alias("n")), "sized")
    placed = dealt_join(own, blocks, "cluster", members, F.xxhash64("id")).filter((F.col("component") == F.col("largest")) == F.col("inner"))
    placed = placed.groupBy("cluster", "inner", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(F.collect_list(F.struct("id", "component", "signature", "shingles")).alias("members"))
    placed = scratch.save(placed, "blocks")
    outside = placed.filter("NOT inner").select("cluster", F.col("block").alias("o"), F.col("members").alias("outside"))
    counted = scratch.save(placed.groupBy("cluster").agg(F.count("*").alias("n")), "sized")
    wide = placed.select("cluster", "inner", "block", F.col("members").alias("wide"))
    pairs = dealt_join(wide, outside, "cluster", counted, F.xxhash64("inner", "block")).filter("inner OR block >= o").select("outside", "wide")
    return pairs.mapInArrow(lambda it: _compared(it, percent, least), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, miss: float = 1e-7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: its id, n_shingles, component_id and kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct
    k-word shingles; two are linked if 100 * |intersection| >= percent * |union|. component_id is the
    smallest id reachable over links, kept whether it is the row's own.

    Null and blank texts: empty set, linked with nothing. Fewer than k words: one shingle. Rows that
    repeat an id count as one document in links and each give a row. A row whose id is null is
    linked with nothing, has a null component_id and is kept. Texts of any length are compared whole; equal texts are one class, whose
    rows differ in component_id from none of it. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ids = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = scratch.save(ids.mapInArrow(lambda it: _signed(it, k), "id long, d1 long, d2 long, n_shingles long, signature binary"), "signed")
    real = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = scratch.save(real.groupBy("d1", "d2").agg(F.min("id").alias("class"), F.count("*").alias("n")), "classes")
    members = scratch.save(salted_join(real.select("id", "d1", "d2"), classes, ["d1", "d2"], "n", F.xxhash64("id")).select("id", "class").distinct(), "members")
    heads = scratch.save(real.select("id", "signature").join(members.filter("id = class").select("id"), "id", "left_semi").select("id", "signature"), "heads")

    banded = heads.mapInArrow(_banded, "id long, bucket long")
    shared = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("n")).filter("pivot < last").drop("last")
    met = scratch.save(salted_join(banded, scratch.save(shared, "buckets"), ["bucket"], "n", F.xxhash64("id")).drop("n"), "met")
    least = fewest_matches(percent / 100, miss)

    needed = met.select("id").distinct()
    few = needed.count() <= BROADCAST_IDS
    texts = ids.join(F.broadcast(needed) if few else needed, "id", "left_semi")
    sets = scratch.save(texts.mapInArrow(lambda it: _sets(it, k), "id long, shingles array<long>, signature binary"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """x meets few others, y (a bucket's pivot) may meet a third of all: its set is copied, and its pairs dealt to the copies."""
        pairs = scratch.save(pairs, "pairs")
        sized = scratch.save(pairs.groupBy("y").agg(F.count("*").alias("n")), "sized")
        both = dealt_join(pairs.join(sets.toDF("x", "tx", "sx"), "x"), sets.toDF("y", "ty", "sy"), "y", sized, F.xxhash64("x"))
        return both.mapInArrow(lambda it: _verified(it, least, percent), "u long, v long")

    with arrow_rows(spark, PAIRS_AT_ONCE):
        links = scratch.save(linked(met.filter("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()), "links")
    joined = components(links, scratch)
    rest = met.filter("id <> pivot").join(joined.toDF("id", "component"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a < b").select("bucket", "n")
    unsettled = scratch.save(salted_join(rest, scratch.save(mixed, "mixed"), ["bucket"], "n", F.xxhash64("id")), "unsettled")
    if not unsettled.isEmpty():
        few_rows = unsettled.filter(F.col("n") <= SMALL)
        other = few_rows.toDF("bucket", "y", "other", "n").drop("n")
        pairs = few_rows.join(other, "bucket").filter("id > y AND component <> other").select(F.col("id").alias("x"), "y").distinct()
        more = _between(unsettled.filter(F.col("n") > SMALL), sets, percent, least, scratch)
        with arrow_rows(spark, PAIRS_AT_ONCE):
            links = links.union(scratch.save(linked(pairs), "links"))
        with arrow_rows(spark, 2):
            links = scratch.save(links.union(more), "links")
        joined = components(links, scratch)

    found = members.join(joined.toDF("class", "component"), "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    repeated = found.groupBy("id").agg(F.min("component").alias("component"))
    out = signed.select("id", "n_shingles").join(repeated, "id", "left").select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))), "near")
    scratch.drop_all_but(out)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() does not keep.

    Where ids repeat or are null, rows are compared by numbers of their own in the order of ids, nulls last: each row is a
    document, and of a group one row of the smallest id stays. Null, blank and long texts as in near_duplicates(); other columns
    pass through, whatever their names; an empty table gives an empty one.
    """
    own, row = numbered(docs, id_column, Scratch(docs.sparkSession))
    lost = near_duplicates(own, k, percent, id_column=row, text_column=text_column).filter("NOT kept").select(row).distinct()
    return own.join(F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost, row, "left_anti").select(docs.columns)
