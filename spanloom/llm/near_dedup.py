"""Near duplicates by SimHash and Burkhard-Keller trees.

A fingerprint bit is the majority of that bit over the hashes of all shingles. Distinct fingerprints
are searched, so copies cost nothing. Fingerprints that differ in at most ``radius`` bits agree in
``pieces - radius`` of ``pieces`` pieces of 64 / pieces bits (one of three pieces of 21 bits for radius
2); every choice of so many pieces is a shard key, and a shard holds the fingerprints with one key.
Its tree (children keyed by the integer distance to their parent) is sent to the task that asks it
and only edges within the radius of a query's distance are followed. Trees travel by shuffle, not by
broadcast: together they hold all fingerprints and have no size bound. A shard above ``shard_rows``
members is cut into parts that meet in pairs, so no task holds more than two parts.

A shard reports a forest, never all pairs. Components are then found by rounds of joins in which
every fingerprint hands on the smallest one it knows.

Nulls: a null text is like an empty one and has fingerprint zero, which links like any other. Rows
without an id take part; a component's id is the smallest id that is not null (null if there is
none). Repeated ids and rows are documents of their own. Very long texts are hashed in blocks.
Other columns play no part. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, hold_memory

RADIUS = 2
SHINGLE = 3
SEED = 42
PIECES = 3
SHARD_ROWS = 30_000
QUERY_BLOCK = 4096
_HASH_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a text's lower-cased word shingles."""
    words = [] if text is None else text.encode().lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    values = [hashed(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), _HASH_BLOCK):
        block = np.array(values[i : i + _HASH_BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    hold_memory("near_dedup")
    return pa.array((fingerprint(t.as_py()) for t in text), pa.int64())


def fingerprint_of(text: Column | str) -> Column:
    # Bound here: a column function needs a session, and workers import this module without one.
    return F.arrow_udf(_fingerprints, "long")(text)


class Tree:
    """Burkhard-Keller tree over distinct 64-bit values, asked with many values at once."""

    LEAF = 1

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, dict[int, int]] | np.ndarray] = []
        self.root = self._build(np.arange(len(values)))

    def _build(self, members: np.ndarray) -> int:
        # Children are built after their parent from a list of tasks, as depth has no small bound.
        self.nodes.append(members)
        todo = [0]
        while todo:
            at = todo.pop()
            rows = self.nodes[at]
            if len(rows) <= self.LEAF:
                continue
            pivot, rest = int(rows[0]), rows[1:]
            distance = np.bitwise_count(self.values[rest] ^ self.values[pivot])
            order = np.argsort(distance, kind="stable")
            edges, first = np.unique(distance[order], return_index=True)
            children = {}
            for edge, part in zip(edges.tolist(), np.split(rest[order], first[1:])):
                children[edge] = len(self.nodes)
                todo.append(len(self.nodes))
                self.nodes.append(part)
            self.nodes[at] = (pivot, children)
        return 0

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, member position) at most ``radius`` bits apart."""
        found_q, found_m = [], []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            at, asked = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                distance = np.bitwise_count(queries[asked][:, None] ^ self.values[node][None, :])
                q, m = np.nonzero(distance <= radius)
                found_q.append(asked[q])
                found_m.append(node[m])
                continue
            pivot, children = node
            distance = np.bitwise_count(queries[asked] ^ self.values[pivot]).astype(np.int16)
            near = asked[distance <= radius]
            found_q.append(near)
            found_m.append(np.full(len(near), pivot))
            for edge, child in children.items():
                follow = asked[np.abs(distance - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))
        return np.concatenate(found_q), np.concatenate(found_m)


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each member the smallest one that it hangs together with."""
    tree, label = Tree(values), np.arange(len(values))
    for begin in range(0, len(values), QUERY_BLOCK):
        q, m = tree.within(values[begin : begin + QUERY_BLOCK], radius)
        q = q + begin
        while True:
            low = np.minimum(label[q], label[m])
            before = label.copy()
            np.minimum.at(label, label[q], low)
            np.minimum.at(label, label[m], low)
            label = label[label]
            if (label == before).all():
                break
    while (label[label] != label).any():
        label = label[label]
    return label


def shard_keys(fp: Column, radius: int = RADIUS, pieces: int = PIECES) -> Column:
    """Array of shard keys of a fingerprint: each choice of ``pieces - radius`` of its pieces."""
    width = 64 // pieces
    keys = []
    for n, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum(((1 << width) - 1) << (width * i) for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def dealt(fps: DataFrame, radius: int = RADIUS, pieces: int = PIECES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, low, high, fp): members of the shards, or of pairs of parts of large ones."""
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius, pieces)).alias("key"))
    # Single members ask nobody.
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, pieces: int = PIECES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b), a > b as signed numbers, that connect all fingerprints within the radius.

    A shard key is hashed; two keys that fall together only share a larger shard.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt(fps, radius, pieces, shard_rows).repartition(n, "key", "low", "high")
    sorted_rows = spread.sortWithinPartitions("key", "low", "high", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees of one shard after the other; a shard may go over several batches."""

        def shard(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            root = forest(rows["fp"].view(np.uint64), radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return rows["fp"][moved], rows["fp"][root[moved]]

        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(a):
                yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        kind = np.dtype([("key", "<i8"), ("low", "<i4"), ("high", "<i4"), ("fp", "<i8")])
        names = ("key", "low", "high")
        held = [np.zeros(0, kind)]
        for batch in batches:
            rows = np.zeros(batch.num_rows, kind)
            for name in kind.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.logical_or.reduce([np.diff(rows[c]) != 0 for c in names])) + 1
            pieces_ = np.split(rows, change)
            found = []
            for piece in pieces_:
                if len(held[0]) and any(held[0][c][0] != piece[c][0] for c in names):
                    found.append(shard(np.concatenate(held)))
                    held = [np.zeros(0, kind)]
                held = [piece] if not len(held[0]) else [*held, piece]
            if found:
                yield from out(found)
        if len(held[0]):
            yield from out([shard(np.concatenate(held))])

    return sorted_rows.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "near-edges") -> DataFrame:
    """(node, root): the smallest node connected to each node of the edges.

    Large-star and small-star rounds in turn: neighbours above a node, then those below it, are hung
    on the smallest one. A round is two joins on keys; minima are combined before the shuffle.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b"), label)
    seen = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        star = small.select("b", "m").filter("b != m").union(least).toDF("a", "b")
        edges = stash(star.distinct(), label)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        seen = state


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Narrow rows (doc_id, text_hash, fp) of all documents, computed once."""
    text = column_or_null(docs, "text", "string")
    narrow = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), text.alias("text"))
    return stash(narrow.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_of("text").alias("fp")), "near-fps")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every row."""
    rows = fingerprinted(docs)
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(fps.select("fp"), radius, pieces)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def fingerprint_string(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_group(docs: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest id.

    Rows that agree in id and text are one document; a row without an id stays only where its
    component has no id. Columns are kept.
    """
    found = near_duplicates(docs, radius, pieces)
    best = found.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
    kept = best.select(F.xxhash64("best.doc_id", "best.text_hash").alias("key"))
    text = F.xxhash64(column_or_null(docs, "text", "string"))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(column_or_null(docs, "doc_id", "long"), text).alias("key"),
    )
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return named.join(kept, "key", "left_semi").withColumn("number", number).filter("number = 1").select("row.*")
