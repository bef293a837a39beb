"""Prefix trie of conversations by splitter paths.

A conversation's path is the chain of 16-byte digests of its turns (role and text), so that byte
order sorts conversations by their turns and keeps every trie node's members together. A bounded
sample of paths gives splitters; the trie of their prefixes, the skeleton, is broadcast. Each shard
between two splitters is sorted and read as a stream that holds one open path: a node that is no
prefix of either splitter has all its members there and is finished on the spot. Skeleton nodes get
one partial aggregate a shard; these are added up by Spark and then along the skeleton, whose size
is bounded by ``MOST_SHARDS * KEY_TURNS`` nodes.

Members that end at one node are hashed in order of their ids: in the stream where the node is
finished there, else from chunks of ``CHUNK_IDS`` ids that the shards prepare. A group of copies is
thus spread over shards, as splitters hold the conversation's id too (copies of more than
``KEY_TURNS`` turns meet in one shard, as a stream). A conversation is one row of some 40 bytes a turn;
texts are reduced to digest and word count before any shuffle.

Rows without a conv_id are left out. Turns come in order of ``turn``, null first, equal ones by the
digest of role and text; repeated rows are turns of their own. Null role or text is empty. ``%``
has the sign of conv_id. Very long texts only count as words. Further columns play no part. An
empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, n_words
from .vectors import hash_sample

GROUP = 20
HEADS = 4
SHARD_TURNS = 1 << 14
MOST_SHARDS = 4096
SAMPLE_PER_SHARD = 16
MOST_SAMPLE = 16_384
KEY_TURNS = 256
CHUNK_IDS = 512
OUT_ROWS = 8192

_DIGEST = 16
_NO_ENDS = hashlib.sha256().hexdigest()
_NODE, _PART, _ENDS = 0, 1, 2
_FOUND = (
    "kind int, skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, words long, shard int, chunk long, ends string"
)
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[part.split()[1]] for part in _FOUND.split(", ")]
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(table: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, path, words: every conversation after its first turns are those of its group's first one."""
    role = F.coalesce(column_or_null(table, "role", "string"), F.lit(""))
    text = F.coalesce(column_or_null(table, "text", "string"), F.lit(""))
    conv = column_or_null(table, "conv_id", "long")
    turns = table.select(
        (conv - conv % group).alias("base"),
        conv.alias("conv_id"),
        column_or_null(table, "turn", "long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        n_words(text).alias("words"),
    ).filter("conv_id is not null")
    # Dealt by group once; grouping and the join below keep that.
    one = F.struct(F.col("turn").isNotNull(), "turn", "digest", "words")
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    first = whole.filter("conv_id = base").select("base", F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = F.slice(F.col("turns"), h + 1, F.size("turns"))
    taken = F.when(F.col("head").isNull(), F.slice(F.col("turns"), 1, 0)).otherwise(F.slice(F.col("head"), F.lit(1), h))
    full = whole.join(first, "base", "left").select("conv_id", F.concat(taken, own).alias("turns"))
    return full.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * _DIGEST : middle * _DIGEST] == b[low * _DIGEST : middle * _DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class Skeleton:
    """Trie of the splitters' paths; node 0 is the root, which is always part of it."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = sorted(set(splitters))
        self.parents, self.depths = [-1], [0]
        self.nodes: list[list[int]] = []  # of each splitter, by depth
        for n, (path, _) in enumerate(self.splitters):
            shared = common_turns(self.splitters[n - 1][0], path) if n else 0
            chain = self.nodes[n - 1][: shared + 1] if n else [0]
            for depth in range(len(chain), len(path) // _DIGEST + 1):
                self.parents.append(chain[-1])
                self.depths.append(depth)
                chain.append(len(self.parents) - 1)
            self.nodes.append(chain)

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_left(self.splitters, (path, conv_id))

    def on(self, shard: int, path: bytes) -> list[int]:
        """Skeleton nodes along a path of a shard, from the root on."""
        best = [0]
        for n in (shard - 1, shard):
            if 0 <= n < len(self.splitters):
                shared = common_turns(self.splitters[n][0], path)
                if shared >= len(best):
                    best = self.nodes[n][: shared + 1]
        return best


@dataclass
class _Open:
    """A node of the path that is open in a shard's stream."""

    depth: int
    words: int
    skeleton: int  # -1: finished here
    least: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[str] = field(default_factory=list)
    chunks: int = 0
    digest: object = None
    waiting: list[list] = field(default_factory=list)  # children that lack this node's conv_id


class ShardStream:
    """Nodes of one shard out of its conversations in order of (path, conv_id)."""

    def __init__(self, skeleton: Skeleton, shard: int, out: list[tuple]):
        self.skeleton, self.shard, self.out = skeleton, shard, out
        self.path, self.open = b"", [_Open(0, 0, 0)]

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        shared = common_turns(self.path, path)
        while len(self.open) > shared + 1:
            self._close()
        if len(path) // _DIGEST > shared:
            spine = self.skeleton.on(self.shard, path)
            for depth in range(shared + 1, len(path) // _DIGEST + 1):
                self.open.append(_Open(depth, words[depth - 1], spine[depth] if depth < len(spine) else -1))
        self.path = path
        node = self.open[-1]
        node.convs += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.skeleton >= 0:
            node.ends.append(str(conv_id))
            if len(node.ends) == CHUNK_IDS:
                self._chunk(node)
        elif node.digest is None:
            node.digest = hashlib.sha256(str(conv_id).encode())
        else:
            node.digest.update(f",{conv_id}".encode())

    def finish(self) -> None:
        while self.open:
            self._close()

    def _chunk(self, node: _Open) -> None:
        if node.ends:
            self.out.append((_ENDS, node.skeleton, *[None] * 8, self.shard, node.chunks, ",".join(node.ends)))
            node.ends, node.chunks = [], node.chunks + 1

    def _close(self) -> None:
        node = self.open.pop()
        for child in node.waiting:
            child[4] = node.least
            self.out.append(tuple(child))
        if node.skeleton >= 0:
            self._chunk(node)
            self.out.append(
                (_PART, node.skeleton, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.words, self.shard, None, None)
            )
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.words
        up = self.open[-1]
        up.least = node.least if up.least is None else min(up.least, node.least)
        up.convs += node.convs
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        ends = node.digest.hexdigest() if node.digest else _NO_ENDS
        row = [_NODE, None, node.least, node.depth, None, node.convs, node.children, leaves, saved, None, self.shard, None, ends]
        if up.skeleton >= 0:
            row[1] = up.skeleton
            self.out.append(tuple(row))
        else:
            up.waiting.append(row)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _splitters(convs: DataFrame, shard_turns: int) -> list[tuple[bytes, int]]:
    """Evenly spread keys of a bounded sample: at most ``MOST_SHARDS`` of ``KEY_TURNS`` turns each."""
    total = convs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("turns")).first()
    shards = min(MOST_SHARDS, -(-(total["turns"] or 0) // shard_turns))
    if shards < 2:
        return []
    keys = convs.select(F.substring("path", 1, KEY_TURNS * _DIGEST).alias("path"), "conv_id")
    sample = hash_sample(keys, "conv_id", total["n"], min(MOST_SAMPLE, SAMPLE_PER_SHARD * shards))
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in sample)
    return [found[i * len(found) // shards] for i in range(1, shards)] if found else []


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: one running hash a node over its chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], ["skeleton", "ends_sha256"])

        for batch in batches:
            for own, text in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
                if own != node:
                    if digest is not None:
                        yield done()
                    node, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if digest is not None:
            yield done()

    ordered = chunks.select("skeleton", "shard", "chunk", "ends").repartition("skeleton")
    return ordered.sortWithinPartitions("skeleton", "shard", "chunk").mapInArrow(run, "skeleton long, ends_sha256 string")


def _finished(skeleton: Skeleton, parts: list, ends: dict[int, str]) -> dict[int, list]:
    """Skeleton nodes out of their sums over the shards, added up from the deepest to the root."""
    size = len(skeleton.parents)
    own = {r["skeleton"]: r for r in parts}
    value = lambda n, name: own[n][name] if n in own else 0
    convs, children, leaves, saved = ([value(n, c) for n in range(size)] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    least = [own[n]["conv_id"] if n in own else None for n in range(size)]
    for n in sorted(range(size), key=lambda i: -skeleton.depths[i]):
        if not convs[n]:
            continue  # only the root of an empty table
        leaves[n] = leaves[n] if children[n] else 1
        saved[n] += (convs[n] - 1) * value(n, "words")
        up = skeleton.parents[n]
        if up >= 0:
            convs[up] += convs[n]
            children[up] += 1
            leaves[up] += leaves[n]
            saved[up] += saved[n]
            least[up] = least[n] if least[up] is None else min(least[up], least[n])
    return {
        n: [least[n], skeleton.depths[n], least[skeleton.parents[n]] if n else None, convs[n], children[n], leaves[n], saved[n], ends.get(n, _NO_ENDS)]
        for n in range(size)
        if convs[n]
    }


def prefix_trie(table: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per trie node: ``NODE_COLUMNS``."""
    spark = table.sparkSession
    convs = stash(rebuilt(table), "trie-paths")
    skeleton = Skeleton(_splitters(convs, shard_turns))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            yield batch.append_column("shard", pa.array([shared.value.shard(*k) for k in keys], pa.int32()))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stream = None
        for batch in batches:
            for shard, conv_id, path, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words"))):
                if stream is None or stream.shard != shard:
                    if stream:
                        stream.finish()
                    stream = ShardStream(shared.value, shard, out)
                stream.add(conv_id, path, words)
                if len(out) >= OUT_ROWS:
                    yield _batch(out)
                    out.clear()
        if stream:
            stream.finish()
        for i in range(0, len(out), OUT_ROWS):
            yield _batch(out[i : i + OUT_ROWS])

    shards = len(skeleton.splitters) + 1
    dealt = convs.mapInArrow(deal, "conv_id long, path binary, words array<long>, shard int").repartition(shards, "shard")
    found = stash(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(nodes, _FOUND), "trie-nodes")
    # Both lists have at most one row per skeleton node.
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.filter(F.col("kind") == _PART).groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *sums).collect()
    ends = {r["skeleton"]: r["ends_sha256"] for r in _hashed_ends(found.filter(F.col("kind") == _ENDS)).collect()}
    done = _finished(skeleton, parts, ends)
    schema = "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    spine = spark.createDataFrame([(n, *row) for n, row in done.items()], schema)
    parents = F.broadcast(spine.select("skeleton", F.col("conv_id").alias("spine_conv")))
    inner = found.filter(F.col("kind") == _NODE).join(parents, "skeleton", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("spine_conv", "parent_conv_id")).withColumnRenamed("ends", "ends_sha256")
    return inner.select(*NODE_COLUMNS).unionByName(spine.select(*NODE_COLUMNS))
