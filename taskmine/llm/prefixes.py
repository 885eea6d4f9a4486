"""Trie of conversations that begin alike, with totals of every subtree.

A node is a distinct sequence of first turns; the textless root is one too. Its identity is
its depth and two 64-bit hashes folded over its turns, so nodes are found by one aggregate
with partial sums and no conversation is ever compared with another.

Totals go up by time-forward processing. Nodes are sorted by reverse level order; a node
sends its record to its parent's turn through a priority queue, and the parent, when its turn
comes, takes in all that was sent to it and gives its children its own id. The queue holds
``pending`` records in memory and writes sorted runs beyond that to an unnamed file of the
task, which ends with the task. A node with more than ``shard`` conversations is heavy: heavy
nodes form the top of the trie, at most (conversations / ``shard``) a level. Each light node
under a heavy one is the root of a shard; shards are processed in parallel, and what their
roots send is summed by parent before the top is processed, in one task. With very many
conversations ``shard`` grows with them, so a level of the top has 4,096 nodes at most.

A hot first turn, prefix or conversation is a heavy node: a count. Rows of one conversation are
numbered and hashed in blocks of ``_BLOCK`` turns, so that no task needs all of it. The ids that
end in one node are joined to blocks of 4,096 before a task streams them through SHA-256, which
has no parallel form: for a node where a third of all conversations end, that task reads their ids
(not their texts), one block at a time.

Null roles and texts are empty ones. Rows without a conversation id belong to none. An empty
table has no nodes. Turns with equal numbers are ordered by role and text; repeated rows are
turns of their own. Very long texts are hashed and counted in one pass. Other columns are not
read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from taskmine.operators.ranking import numbered_in_blocks
from taskmine.sources.stages import staged

SHARD, PENDING = 500, 100_000
_TOP, _BLOCK, _IDS = 4096, 1024, 12  # heavy nodes a level; turns of a block; bits of the ids of a block
_WORDS = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "k1", "k2"]
_SUMS = ["n_children", "n_leaves", "saved_tokens"]
_RECORD = ["conv_id", *_NODE, "p1", "p2", "n_convs", "words", *_SUMS]
_SENT = struct.Struct(f"<{len(_RECORD)}q")


class SpillingQueue:
    """Records in the order of their receivers (depth downwards, hashes); ``limit`` of them in memory, the rest in sorted runs."""

    def __init__(self, limit: int):
        self.limit, self.fresh, self.heads = limit, [], []
        self.file, self.runs = None, []

    @staticmethod
    def receiver(record: tuple) -> tuple:
        return (1 - record[1], record[4], record[5])  # one level up

    def push(self, record: tuple) -> None:
        if len(self.fresh) >= self.limit:
            self._spill()
        heapq.heappush(self.fresh, (self.receiver(record), record))

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        begin = self.file.seek(0, 2)
        self.file.write(b"".join(_SENT.pack(*r) for _, r in sorted(self.fresh)))
        self.runs.append([begin, begin + len(self.fresh) * _SENT.size])
        self.fresh = []
        self._head(len(self.runs) - 1, [])

    def _head(self, run: int, block: list) -> None:
        """The next record of a run joins the heads; blocks of 1,024 are read at a time."""
        if not block:
            begin, end = self.runs[run]
            self.file.seek(begin)
            data = self.file.read(min(end - begin, 1024 * _SENT.size))
            self.runs[run][0] += len(data)
            block = list(_SENT.iter_unpack(data))[::-1]
        if block:
            record = block.pop()
            heapq.heappush(self.heads, (self.receiver(record), record, run, block))

    def taken(self, receiver: tuple) -> Iterator[tuple]:
        """All records sent to a receiver; none may have been sent to an earlier one."""
        while True:
            memory = self.fresh and self.fresh[0][0] == receiver
            if self.heads and self.heads[0][0] == receiver:
                _, record, run, block = heapq.heappop(self.heads)
                self._head(run, block)
                yield record
            elif memory:
                yield heapq.heappop(self.fresh)[1]
            else:
                return


def _folded(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth) with the hashes of the prefix that ends there (k1, k2) and of the one before (p1, p2)."""
    one = turns.select(
        "conv_id", "depth", F.floor(F.col("depth") / _BLOCK).alias("block"), F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"),
        F.xxhash64("depth", "role", "text").alias("x1"), F.xxhash64(F.lit("second"), "text", "depth", "role").alias("x2"))
    one = staged(one, "trie-turns")
    blocks = one.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    begun = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(b).over(before), zero).alias(b) for b in ("b1", "b2")])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = one.select("*", F.bit_xor("x1").over(inside).alias("l1"), F.bit_xor("x2").over(inside).alias("l2"))
    own = lambda k: F.col(f"l{k}").bitwiseXOR(F.col(f"b{k}"))
    return local.join(begun, ["conv_id", "block"]).select(
        "conv_id", "depth", "words", own(1).alias("k1"), own(2).alias("k2"), own(1).bitwiseXOR(F.col("x1")).alias("p1"), own(2).bitwiseXOR(F.col("x2")).alias("p2"))


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.max("words").alias("words"))


def _fresh(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({name: F.lit(0).cast("long") for name in _SUMS})


_OUT = ("conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, parent_conv_id long, has_parent boolean, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long")
_OUT_TYPES = [pa.bool_() if " boolean" in f else pa.int64() for f in _OUT.split(", ")]
_OUT_NAMES = [f.split(" ")[0] for f in _OUT.split(", ")]


def _time_forward(nodes: DataFrame, is_root: Column, pending: int) -> DataFrame:
    """Nodes with the totals of their subtrees; ``nodes`` comes in reverse level order, whole subtrees in one partition.

    Sums that records bring along count as received. A root sends nothing; its ``has_parent`` is false.
    """
    def work(batches):
        queue, done = SpillingQueue(pending), []

        def finished(record, parent):
            conv, depth, k1, k2, p1, p2, n, _, *sums = record
            done.append((conv, depth, k1, k2, p1, p2, parent, parent is not None, n, *sums))

        def flushed():
            columns = list(zip(*done)) if done else [[]] * len(_OUT_NAMES)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT_TYPES)], names=_OUT_NAMES)

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in (*_RECORD, "_root")]
            for *record, root in zip(*columns):
                conv, depth, k1, k2, p1, p2, n, words, children, leaves, saved = record
                for sent in queue.taken((-depth, k1, k2)):
                    children, leaves, saved = children + 1, leaves + sent[9], saved + sent[10]
                    finished(sent, conv)
                    if len(done) >= 10_000:
                        yield flushed()
                record = (conv, depth, k1, k2, p1, p2, n, words, children, leaves or 1, saved + (n - 1) * words)
                if root:
                    finished(record, None)
                else:
                    queue.push(record)
        yield flushed()

    return nodes.select(*_RECORD, is_root.alias("_root")).mapInArrow(work, _OUT)


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes where conversations end, with the SHA-256 of their ids in order."""
    zero = F.lit(0).cast("long")
    at = F.struct(*_NODE)
    last = rows.select("conv_id", at.alias("at")).unionByName(convs.select("conv_id", F.struct(*[zero.alias(c) for c in _NODE]).alias("at")))
    ends = last.groupBy("conv_id").agg(F.max("at").alias("at")).select("conv_id", "at.*")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")  # 4,096 at most
    blocks = ends.groupBy(*_NODE, F.shiftright("conv_id", _IDS).alias("block")).agg(ids.alias("ids"))

    def work(batches):
        key, digest, done = None, None, []

        def flushed():
            columns = list(zip(*done)) if done else [[]] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*_NODE, "ends_sha256"])

        for batch in batches:
            for *own, ids in zip(*(batch.column(name).to_pylist() for name in (*_NODE, "ids"))):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            if len(done) >= 10_000:
                yield flushed()
        if key is not None:
            done.append((*key, digest.hexdigest()))
        yield flushed()

    ordered = blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ids")
    return ordered.mapInArrow(work, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, pending: int = PENDING) -> DataFrame:
    """One row per node: conv_id (its smallest member; with depth the node's id), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``turns``: conv_id, depth from 1 without
    gaps, role, text; ``convs``: the distinct conv_id of all members, with or without turns. Runs jobs when called.
    """
    rows = staged(_folded(turns), "trie-prefixes")
    convs = convs.select(F.col("conv_id").cast("long").alias("conv_id"))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    root = staged(convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
                  .select("conv_id", *[zero(c) for c in (*_NODE, "p1", "p2")], "n_convs", zero("words")), "trie-root")
    members = root.agg(F.max("n_convs")).head()[0] or 0
    shard = max(shard, -(-members // _TOP))
    nodes = staged(_nodes(rows), "trie-nodes")
    heavy = staged(nodes.where(F.col("n_convs") > shard).unionByName(root), "trie-heavy")
    # the first light prefix of a conversation is the root of the shard of all that follow
    light = rows.join(heavy.select(*_NODE), _NODE, "left_anti")
    of_conv = light.groupBy("conv_id").agg(F.min(F.struct(*_NODE)).alias("top"))
    below = nodes.where(F.col("n_convs") <= shard).join(of_conv, "conv_id")
    dealt = _fresh(below).repartition("top").sortWithinPartitions(F.desc("depth"), "k1", "k2")
    parts = staged(_time_forward(dealt, F.struct(*_NODE) == F.col("top"), pending), "trie-shards")
    roots = parts.where("not has_parent")
    sent = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    received = heavy.join(sent, _NODE, "left").fillna(0, _SUMS)
    ordered = received.repartition(1).sortWithinPartitions(F.desc("depth"), "k1", "k2")
    top = staged(_time_forward(ordered, F.col("depth") == 0, pending), "trie-top")
    parents = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("heavy_conv_id"))
    adopted = roots.join(parents, ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("heavy_conv_id"))
    columns = [*_NODE, "conv_id", "parent_conv_id", "n_convs", *_SUMS]
    found = parts.where("has_parent").select(*columns).unionByName(adopted.select(*columns)).unionByName(top.select(*columns))
    none = hashlib.sha256(b"").hexdigest()
    return found.join(_ends(rows, convs), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *_SUMS, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 by turn, null first), role and text (null: empty) of rows with a conversation id."""
    plain = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 60))) / _BLOCK)
    return numbered_in_blocks(plain, ["conv_id"], block, [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "pos").drop("turn")


def with_shared_start(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns (conv_id, depth, role, text) of conversations that begin with the first h turns of an earlier one.

    Conversation c takes the first h = crc32(c) % ``most`` turns of c - c % ``every`` (all if fewer,
    none if absent), then its own after its first h. The remainder has the sign of c.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    known = first.groupBy("base").agg(F.count("*").alias("n_first"))
    own = turns.select("*", h, base).where("pos >= h").join(known, "base", "left")
    taken = F.least("h", F.coalesce("n_first", F.lit(0)))
    kept = own.select("conv_id", (F.col("pos") - F.col("h") + taken + 1).cast("long").alias("depth"), "role", "text")
    shared = convs.select("conv_id", h, base).join(first, "base").where("pos < h")
    return kept.unionByName(shared.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "role", "text"))
