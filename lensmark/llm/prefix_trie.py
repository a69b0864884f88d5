"""The prefix trie of conversations: a node for each distinct sequence of first turns.

1. Distinct turns (role and text) are a dictionary, told by SHA-256 and numbered; a conversation is a row of turn numbers, with no text.
2. Equal sequences become one: their conversations are counted, and their ids hashed in order, a row a batch and sequence, so that a sequence that a third of
   all conversations share meets as partial results.
3. Most-significant-digit radix partitioning: a bucket holds the sequences of one prefix. A bucket of more than LOCAL turns goes
   on to the turn where its least and greatest sequence part, which all its sequences share, and is parted by the next turn into buckets of its own;
   the nodes on its way are known from its aggregates. Each round treats all large buckets at once, over all tasks.
4. What is left are buckets that a task can hold. Multikey quicksort parts each by one turn at a time, and every part it makes of equal turns is a node.
5. Sums over subtrees go back up: from the local buckets' top nodes through the rounds of large buckets, in reverse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmark.llm.common import Scratch, salted_join

#: Turns of the largest bucket that one task takes.
LOCAL = 20_000
#: As many large buckets at most travel to every task (some 50 bytes each); there is at most one for each LOCAL turns. More are joined by shuffles.
BROADCAST_BUCKETS = 500_000
TURN = "struct<id:long,bytes:long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def sequences(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, path: each conversation's turns in order (a null turn first, equal ones by role and text) as numbers of distinct turns with their texts' bytes.

    conversations: conv_id, turn, role, text. Null roles and texts count as empty; rows without conv_id are no conversation's. Texts are shuffled once, to their
    conversation, which is a row as a document is; from there on a turn is its SHA-256, and then its number.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    step = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")
    digest = lambda s: F.unhex(F.sha2(F.concat(F.octet_length(s["role"]), F.lit(":"), s["role"], s["text"]), 256))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda s: F.struct(digest(s).alias("turn"), F.octet_length(s["text"]).cast("long").alias("bytes"))).alias("own"))
    turns = scratch.save(own.select("conv_id", F.posexplode("own").alias("place", "t")).select("conv_id", "place", "t.turn", "t.bytes"), "turns")
    known = turns.groupBy("turn").agg(F.count("*").alias("n")).orderBy("turn").withColumn("id", F.monotonically_increasing_id())
    numbered = salted_join(turns, scratch.save(known, "dictionary"), ["turn"], "n", F.xxhash64("conv_id", "place"))
    paths = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "bytes"))).alias("own"))
    return paths.select("conv_id", F.transform("own", lambda s: F.struct(s["id"].alias("id"), s["bytes"].alias("bytes"))).alias("path"))


def _gathered(batches) -> Iterator[pa.RecordBatch]:
    """Conversations of a batch by sequence: path, order of the batch, ids joined by commas, their number and the least. Rows come by rising id."""
    for batch in batches:
        at: dict[tuple, list[int]] = {}
        paths = batch.column(1).to_pylist()
        for i, path in enumerate(paths):
            at.setdefault(tuple(s["id"] for s in path), []).append(i)
        ids = batch.column(0).to_pylist()
        firsts = [rows[0] for rows in at.values()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(1).take(pa.array(firsts, pa.int64())),
                pa.array([ids[i] for i in firsts], pa.int64()),
                pa.array([",".join(str(ids[i]) for i in rows) for rows in at.values()], pa.string()),
                pa.array([len(rows) for rows in at.values()], pa.int64()),
            ],
            ["path", "least", "ids", "n"],
        )


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """One row a sequence from rows sorted by path and least: path, n, least, and the digest of all ids. Keeps no more than a digest's state."""
    path = key = digest = None
    n = least = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path], pa.list_(pa.struct([("id", pa.int64()), ("bytes", pa.int64())]))), pa.array([n], pa.int64()), pa.array([least], pa.int64()), pa.array([digest.hexdigest()])], ["path", "n", "least", "ends"])

    for batch in batches:
        for p, low, ids, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = tuple(s["id"] for s in p)
            if own != key:
                if key is not None:
                    yield row()
                path, key, n, least, digest = p, own, 0, low, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
    if key is not None:
        yield row()


def distinct_sequences(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: conv_id, path. path, n, least, ends: how many conversations have the sequence, the smallest, and the SHA-256 of their ids, ascending, joined by commas."""
    kind = f"path array<{TURN}>, least long, ids string, n long"
    parts = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id").select("conv_id", "path").mapInArrow(_gathered, kind)
    merged = parts.repartition(F.transform("path", lambda s: s["id"])).sortWithinPartitions("path", "least")
    return scratch.save(merged.mapInArrow(_merged, f"path array<{TURN}>, n long, least long, ends string"), "sequences")


def trie_nodes(found: list[tuple], depth: int) -> list[list]:
    """Nodes of sequences (turn ids, bytes, n, least, ends) that share their first ``depth`` turns, from that prefix down: depth, parent's place in the list,
    least, n, children, leaves, saved, ends. Multikey quicksort on a stack: no depth of sequences is too much."""
    nodes = [[depth, None, min(s[3] for s in found), sum(s[2] for s in found), 0, 0, 0, NO_ENDS]]
    if depth:
        nodes[0][6] = (nodes[0][3] - 1) * found[0][1][depth - 1]
    stack = [(found, depth, 0)]
    while stack:
        own, d, at = stack.pop()
        more = []
        for s in own:
            if len(s[0]) == d:
                nodes[at][7] = s[4]  # sequences are distinct: one at most ends here
            else:
                more.append(s)
        if not more:
            continue
        pivot = more[len(more) // 2][0][d]
        below, same, above = [], [], []
        for s in more:
            (same if s[0][d] == pivot else below if s[0][d] < pivot else above).append(s)
        for part in (below, above):
            if part:
                stack.append((part, d, at))
        n = sum(s[2] for s in same)
        nodes.append([d + 1, at, min(s[3] for s in same), n, 0, 0, (n - 1) * same[0][1][d], NO_ENDS])
        nodes[at][4] += 1
        stack.append((same, d + 1, len(nodes) - 1))
    for node in reversed(nodes):  # children come after their parents
        node[5] += node[4] == 0
        if node[1] is not None:
            nodes[node[1]][5] += node[5]
            nodes[node[1]][6] += node[6]
    return nodes


def _local(batches) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets, from rows sorted by bucket: bucket, parent, above (the parent's conv_id), depth, path, n, least, ends. A bucket's top node names its parent bucket."""

    def finished(bucket) -> pa.RecordBatch:
        parent, above, depth, found = bucket
        nodes = trie_nodes(found, depth)
        columns = [
            pa.array([x[2] for x in nodes], pa.int64()),
            pa.array([x[0] for x in nodes], pa.int64()),
            pa.array([above, *(nodes[x[1]][2] for x in nodes[1:])], pa.int64()),
            *(pa.array([x[i] for x in nodes], pa.int64()) for i in (3, 4, 5, 6)),
            pa.array([x[7] for x in nodes]),
            pa.array([parent, *[None] * (len(nodes) - 1)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [*COLUMNS, "parent"])

    name, bucket = None, None
    for batch in batches:
        for key, parent, above, depth, path, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != name:
                if bucket:
                    yield finished(bucket)
                name, bucket = key, (parent, above, depth, [])
            bucket[3].append(([s["id"] for s in path], [s["bytes"] for s in path], n, least, ends))
    if bucket:
        yield finished(bucket)


def _shared(lo: Column, hi: Column) -> Column:
    """How many first elements two arrays share."""
    m = F.least(F.size(lo), F.size(hi))
    same = F.zip_with(F.slice(lo, 1, F.greatest(m, F.lit(0))), F.slice(hi, 1, F.greatest(m, F.lit(0))), lambda x, y: x["id"] == y["id"])
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, m).otherwise(at - 1).cast("long")


def prefix_trie(rows: DataFrame, scratch: Scratch | None = None, local: int = LOCAL) -> DataFrame:
    """rows: conv_id (long), path (array of turns: id, bytes), one row a conversation. A row a node, the root (depth 0) included, if there are rows.

    Members of a node are the conversations that start with its turns. conv_id is the smallest of them, parent_conv_id its parent's (null for the root), n_children
    counts children, n_leaves childless nodes of its subtree (itself included), saved_tokens sums each node's (n_convs - 1) times its last text's bytes over the
    subtree, ends_sha256 digests the ids of members that end there, in order, joined by commas. Conversations without turns end at the root; an
    empty table gives no nodes. A conversation's numbers are one row, as its texts would be; its node count is its turns.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    found = distinct_sequences(rows, scratch)
    state = found.select(F.lit("").alias("bucket"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("above"), F.lit(0).cast("long").alias("depth"), "path", "n", "least", "ends")
    small, rounds = [], []
    while True:
        size = F.size("path") - F.col("depth")
        shortest = F.min(F.struct(F.size("path").alias("size"), "ends"))
        stats = state.groupBy("bucket").agg(
            F.sum(size + 1).alias("turns"), F.count("*").alias("c"), F.min("path").alias("lo"), F.max("path").alias("hi"), F.sum("n").alias("n"), F.min("least").alias("least"),
            F.first("parent").alias("parent"), F.first("above").alias("above"), F.first("depth").alias("depth"), shortest.alias("end"),
        )
        large = stats.filter((F.col("turns") > local) & (F.col("c") > 1)).withColumn("shared", _shared(F.col("lo"), F.col("hi")))
        large = scratch.save(large.drop("turns", "c", "hi"), "buckets")
        many = large.count()
        if not many:
            small.append(state)
            break
        keys = large.select("bucket", "shared", F.col("least").alias("low"))
        if many <= BROADCAST_BUCKETS:
            keys = F.broadcast(keys)
        marked = state.join(keys, "bucket", "left")
        small.append(marked.filter("shared IS NULL").select(state.columns))
        deeper = marked.filter(F.size("path") > F.col("shared"))
        name = F.concat("bucket", F.lit("/"), F.get("path", F.col("shared").cast("int"))["id"])
        state = scratch.save(deeper.select(name.alias("bucket"), F.col("bucket").alias("parent"), F.col("low").alias("above"), (F.col("shared") + 1).alias("depth"), "path", "n", "least", "ends"), "parted")
        rounds.append(large)
    kept = small[0]
    for part in small[1:]:
        kept = kept.union(part)
    ready = kept.repartition("bucket").sortWithinPartitions("bucket")
    below = scratch.save(ready.mapInArrow(_local, f"{NODE}, parent string"), "nodes")
    out, tops = below.select(COLUMNS), below.filter("parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens")
    for large in reversed(rounds):
        sums = tops.groupBy(F.col("parent").alias("bucket")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        chain = large.join(sums, "bucket").withColumn("at", F.explode(F.sequence("depth", "shared")))
        first = F.greatest(F.col("at"), F.lit(1))
        passed = F.slice("lo", first.cast("int"), F.greatest(F.col("shared") - first + 1, F.lit(0)).cast("int"))  # turns from this node to the end of its chain
        own = F.aggregate(passed, F.lit(0).cast("long"), lambda a, s: a + (F.col("n") - 1) * s["bytes"])
        last = F.col("at") == F.col("shared")
        nodes = chain.select(
            F.col("least").alias("conv_id"),
            F.col("at").alias("depth"),
            F.when(F.col("at") > F.col("depth"), F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.col("k")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (own + F.col("saved")).alias("saved_tokens"),
            F.when(last & (F.col("end.size") == F.col("shared")), F.col("end.ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
            F.when(F.col("at") == F.col("depth"), F.col("parent")).alias("parent"),
        )
        nodes = scratch.save(nodes, "nodes")
        out = out.union(nodes.select(COLUMNS))
        tops = tops.union(nodes.filter("parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens"))
    return out
