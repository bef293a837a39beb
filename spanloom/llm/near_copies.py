"""Near copies by wide SimHash fingerprints in Burkhard-Keller trees of shards.

The rule of a cleaning stage: documents whose sets of five-word shingles have a Jaccard similarity of
0.8 or more. A fingerprint of 256 bits tells similarities apart: two documents of similarity J differ
in 256 arccos(2 J / (1 + J)) / pi bits on average (39 at 0.8, unrelated ones in 128, give or take
8), and are linked at ``RADIUS`` bits or fewer, which lets 97 of 100 pairs at 0.8 pass. No piece of
the fingerprint has to agree at such a radius, so shards are made as often as it takes: a shard holds
the fingerprints that agree in some bits, as many as keep shards at about ``SHARD`` members
whatever the corpus, and with so many choices of bits that a pair at 0.8 misses all of them with
probability ``MISSED``. Each shard's fingerprints form a tree (children keyed by the integer
distance to their parent) that is asked by its members; only edges within the radius are followed.
A shard above ``PART`` members is cut into parts that meet in pairs.

What the trees miss is found exactly (``missed_links``): two sets at the threshold share one of the first
shingles of each (a fifth of them and one more, in any order that both follow). Sets of different
components that share one are compared, by sketches that bound the difference of two sets from below,
then as whole sets. Shingles that many texts have come last in that order, so that a common passage brings
few sets together.

Equal fingerprints are searched once. A shard reports a forest, and stops asking when all its members
hang together. Components are found by rounds of joins.

Words are lower-cased (A-Z); texts of fewer words are one shingle, and texts without words are copies
of each other, like null ones. Rows that agree in id and text are one document; rows without an id
stay only where their component has no id. Very long texts are read whole, in blocks. Columns are
kept, also of names that are used here. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, hold_memory, mix, parts_by_bytes, sizes_of, texts_of, window_hashes, word_hashes
from .near_dedup import components

SHINGLE = 5
WORDS = 4  # of 64 bits
BITS = 64 * WORDS
SIMILARITY = 0.8
RADIUS = 50
MISSED = 0.03
SHARD = 64
PART = 50_000
LEAF = 64
QUERY_BLOCK = 256
BATCH_BYTES = 1 << 20
# Two sets at the threshold agree in 4 of 5 of their union.
AGREE, OF = 4, 5
CELL_BITS = 22  # of a shingle, in which common ones are counted
COMMON = 32  # shingles of a cell, above eight times the cells' mean, that make it a common one
GROUP = 32  # sets that share a first shingle, above which it may count as a common one
PAIRS = 8  # sets to compare a set with because of larger groups, on average, that are few enough
ROUNDS = 3  # most often that first shingles are chosen anew
SKETCH_BITS = 2048
_COUNT_BLOCK = 1 << 15
_ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes; none for a text without words."""
    (hashes,), per_text = word_hashes([t.lower() for t in texts], 1)
    ends = np.cumsum(per_text)
    for end, size in zip(ends.tolist(), per_text.tolist()):
        yield np.unique(window_hashes(hashes[end - size : end], min(SHINGLE, size), 0)) if size else hashes[:0]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Wide SimHash of each text: a row of four 64-bit numbers."""
    out = np.zeros((len(texts), WORDS), np.int64)
    for n, shingles in enumerate(shingle_sets(texts)):
        if not len(shingles):
            continue
        counts = np.zeros(BITS, np.int64)
        for i in range(0, len(shingles), _COUNT_BLOCK):
            part = shingles[i : i + _COUNT_BLOCK]
            wide = np.stack([mix(part * odd) for odd in _ODD], axis=1).astype("<u8").view(np.uint8)
            counts += np.unpackbits(wide, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[n] = np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints, by broadcasting."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


class Tree:
    """Burkhard-Keller tree over the fingerprints of a shard, asked with many of them at once."""

    def __init__(self, values: np.ndarray, leaf: int = LEAF):
        self.values = values
        # node: members, or (pivot, {distance: child})
        self.nodes: list[tuple[int, dict[int, int]] | np.ndarray] = [np.arange(len(values))]
        todo = [0]
        while todo:
            at = todo.pop()
            members = self.nodes[at]
            if len(members) <= leaf:
                continue
            pivot, rest = int(members[0]), members[1:]
            distance = _distances(values[rest], values[pivot])
            order = np.argsort(distance, kind="stable")
            edges, first = np.unique(distance[order], return_index=True)
            children = {}
            for edge, part in zip(edges.tolist(), np.split(rest[order], first[1:])):
                children[edge] = len(self.nodes)
                todo.append(len(self.nodes))
                self.nodes.append(part)
            self.nodes[at] = (pivot, children)

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (member asked, member found) at most ``radius`` bits apart."""
        found_q, found_m = [asked[:0]], [asked[:0]]
        todo = [(0, asked)]
        while todo:
            at, queries = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                q, m = np.nonzero(_distances(self.values[queries][:, None], self.values[node][None]) <= radius)
                found_q.append(queries[q])
                found_m.append(node[m])
                continue
            pivot, children = node
            distance = _distances(self.values[queries], self.values[pivot])
            near = queries[distance <= radius]
            found_q.append(near)
            found_m.append(np.full(len(near), pivot))
            for edge, child in children.items():
                follow = queries[np.abs(distance - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))
        return np.concatenate(found_q), np.concatenate(found_m)


def forest(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each member of a shard the smallest one that it hangs together with."""
    label, tree = np.arange(len(values)), Tree(values)
    for begin in range(0, len(values), QUERY_BLOCK):
        if not label.any():
            break  # all hang together
        q, m = tree.within(np.arange(begin, min(begin + QUERY_BLOCK, len(values))), radius)
        while True:
            apart = label[q] != label[m]
            q, m = q[apart], m[apart]
            if not len(q):
                break
            low = np.minimum(label[q], label[m])
            for side in (q, m):
                np.minimum.at(label, label[side], low)
            while (label[label] != label).any():
                label = label[label]
    return label


def choices(n: int, similarity: float = SIMILARITY, missed: float = MISSED, shard: int = SHARD) -> list[np.ndarray]:
    """Choices of bits for ``n`` fingerprints: each an array of positions on which shards agree."""
    bits = max(8, math.ceil(math.log2(max(1, n / shard))))
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    rounds = math.ceil(math.log(missed) / math.log(1 - agree))
    rng = np.random.default_rng(1)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(rounds)]


def _key(number: int, positions: np.ndarray) -> Column:
    words = []
    for w in range(WORDS):
        mask = sum(1 << int(p % 64) for p in positions if p // 64 == w)
        if mask:
            words.append(F.col(f"f{w}").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))
    return F.xxhash64(F.lit(number), *words)


def links(fps: DataFrame, n: int, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (``node, f0`` to ``f3``) found within the radius."""
    names = [f"f{w}" for w in range(WORDS)]
    keys = F.array(*[_key(i, positions) for i, positions in enumerate(choices(n))])
    keyed = fps.select("node", *names, F.explode(keys).alias("key"))
    # Single members ask nobody; a large shard's parts meet in pairs.
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    met = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    shards = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("key", "low", "high", "node", *names).repartition(shards, "key", "low", "high")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees of one shard after the other; a shard may go over several batches."""
        hold_memory("near_copies")
        key: tuple | None = None
        held: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            rows = np.concatenate(held)
            if len(rows) > 1:
                root = forest(rows[:, 1:].view(np.uint64), radius)
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    a, b = rows[moved, 0], rows[root[moved], 0]
                    found.append((np.maximum(a, b), np.minimum(a, b)))

        def out() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)]
            found.clear()
            return pa.record_batch(columns, ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("key", "low", "high")]
            rows = np.stack([batch.column(c).to_numpy() for c in ("node", *names)], axis=1)
            cut = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(rows))):
                here = tuple(int(c[a]) for c in columns)
                if here != key:
                    if held:
                        settle()
                    key, held = here, []
                held.append(rows[a:b])
            if found:
                yield out()
        if held:
            settle()
        if found:
            yield out()

    return dealt.sortWithinPartitions("key", "low", "high", "node").mapInArrow(search, "a long, b long").distinct()


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text of every row."""
    text = column_or_null(docs, "text", "string")
    return docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, f0 to f3 of every row, computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("near_copies")
        for batch in batches:
            for begin, end in parts_by_bytes(sizes_of(batch.column(2)), BATCH_BYTES):
                part = batch.slice(begin, end - begin)
                wide = fingerprints(texts_of(part.column(2)))
                columns = [part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(wide[:, w])) for w in range(WORDS))]
                yield pa.record_batch(columns, ["doc_id", "text_hash", *(f"f{w}" for w in range(WORDS))])

    kinds = "doc_id long, text_hash long, " + ", ".join(f"f{w} long" for w in range(WORDS))
    return stash(_narrow(docs).mapInArrow(run, kinds), "copy-rows")


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _common_cells(docs: DataFrame) -> np.ndarray:
    """Packed bits of the cells that hold common shingles of some task; of one size whatever the corpus.

    They only order the shingles: any bits lead to the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("near_copies")
        counts = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for begin, end in parts_by_bytes(sizes_of(batch.column(2)), BATCH_BYTES):
                cells, n = np.unique(_cells(np.concatenate([*shingle_sets(texts_of(batch.column(2).slice(begin, end - begin)))])), return_counts=True)
                counts[cells] += n.astype(np.int32)
        bits = np.packbits(counts > COMMON + 8 * counts.mean(), bitorder="little").view("<i8")
        at = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(at), pa.array(bits[at])], ["at", "bits"])

    return _bits(_narrow(docs).mapInArrow(run, "at long, bits long"))


def _bits(words: DataFrame) -> np.ndarray:
    """Packed bits of all cells, from words of 64 (``at, bits``)."""
    out = np.zeros(1 << (CELL_BITS - 6), np.int64)
    for at, bits in words.groupBy("at").agg(F.bit_or("bits")).collect():
        out[at] = bits
    return out.view(np.uint8)


def first_shingles(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two sets at the threshold share one: ascending, but common ones last."""
    last = common[_cells(shingles)]
    n = len(shingles) - -(-AGREE * len(shingles) // OF) + 1
    return np.concatenate([shingles[~last], shingles[last]])[:n]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of each set's shingles per place: two sets differ in at least as many as their sketches."""
    places = [np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1 for s in sets]
    return np.packbits(np.array(places, np.uint8).reshape(-1, SKETCH_BITS), axis=1)


def _first_sharing(docs: DataFrame, rooted: DataFrame, packed: np.ndarray) -> DataFrame:
    """text_hash, root, size, shingle, n of first shingles that ``n`` texts of different roots have."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("near_copies")
        common = np.unpackbits(sent.value, bitorder="little").astype(bool)
        for batch in batches:
            for begin, end in parts_by_bytes(sizes_of(batch.column(2)), BATCH_BYTES):
                part = batch.slice(begin, end - begin)
                sets = [*shingle_sets(texts_of(part.column(2)))]
                firsts = [first_shingles(s, common) if len(s) else s for s in sets]
                offsets = np.append(0, np.cumsum([len(f) for f in firsts])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.record_batch([part.column(1), pa.array([len(s) for s in sets], pa.int64()), lists], ["text_hash", "size", "firsts"])

    texts = _narrow(docs).mapInArrow(first, "text_hash long, size long, firsts array<long>")
    texts = texts.join(rooted.hint("merge"), "text_hash").dropDuplicates(["text_hash"])
    held = texts.select("text_hash", "root", "size", F.explode("firsts").alias("shingle"))
    shared = Window.partitionBy("shingle")
    held = held.withColumns({"low": F.min("root").over(shared), "high": F.max("root").over(shared), "n": F.count(F.lit(1)).over(shared)})
    return stash(held.filter("low < high").drop("low", "high"), "copy-shared")


def missed_links(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Edges (a, b) of roots that hold texts at the threshold. ``rooted``: text_hash, root of every text."""
    common, n_texts = _common_cells(docs), rooted.count()
    for left in reversed(range(ROUNDS)):
        held = _first_sharing(docs, rooted, common)
        large = held.filter(F.col("n") > GROUP)
        if not left or (large.agg(F.sum("n")).first()[0] or 0) <= 2 * PAIRS * n_texts:
            break
        cell = F.shiftrightunsigned("shingle", 64 - CELL_BITS)
        large = large.select((cell / 64).cast("long").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int")).alias("bits"))
        more = _bits(large)
        if not (more & ~common).any():
            break
        common = common | more
    held = held.drop("n")
    other = held.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("text_hash", "root", "size")])
    able = (F.col("size") * OF >= F.col("other_size") * AGREE) & (F.col("other_size") * OF >= F.col("size") * AGREE)
    met = held.join(other, "shingle").filter((F.col("root") < F.col("other_root")) & able)
    pairs = stash(met.drop("shingle").distinct(), "copy-pairs")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("near_copies")
        for batch in batches:
            for begin, end in parts_by_bytes(sizes_of(batch.column(2)), BATCH_BYTES):
                part = batch.slice(begin, end - begin)
                sets = [*shingle_sets(texts_of(part.column(2)))]
                columns = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sketches(sets)], pa.binary())]
                yield pa.record_batch([part.column(1), *columns], ["text_hash", "shingles", "sketch"])

    def able_by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch", "other_sketch"))
            apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            sizes = batch.column("size").to_numpy() + batch.column("other_size").to_numpy()
            near = pa.array((OF + AGREE) * apart <= (OF - AGREE) * sizes)
            names = ["text_hash", "other_text_hash", "root", "other_root"]
            yield pa.record_batch([pc.filter(batch.column(c), near) for c in names], names)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("near_copies")
        for batch in batches:
            near = []
            for a, b in zip(batch.column("shingles"), batch.column("other_shingles")):
                left, right = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = len(np.intersect1d(left, right, assume_unique=True))
                near.append(OF * both >= AGREE * (len(left) + len(right) - both))
            yield pa.record_batch([pc.filter(batch.column(c), pa.array(near, pa.bool_())) for c in ("root", "other_root")], ["a", "b"])

    named = pairs.select("text_hash").union(pairs.select("other_text_hash")).distinct()
    sets = _narrow(docs).join(named, "text_hash", "left_semi").select("doc_id", "text_hash", "text")
    sets = stash(sets.mapInArrow(whole, "text_hash long, shingles binary, sketch binary").dropDuplicates(["text_hash"]), "copy-sets")

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        ours = sets.select("text_hash", column)
        return pairs.join(ours, "text_hash").join(ours.toDF("other_text_hash", f"other_{column}"), "other_text_hash")

    able_pairs = with_both(pairs, "sketch").mapInArrow(able_by_sketch, "text_hash long, other_text_hash long, root long, other_root long")
    able_pairs = stash(able_pairs, "copy-able")
    return with_both(able_pairs, "shingles").mapInArrow(agree, "a long, b long").distinct()


def one_per_group(docs: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id. Columns are kept."""
    names = [f"f{w}" for w in range(WORDS)]
    rows = _fingerprinted(docs)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = rows.groupBy(*names).agg(F.min(first).alias("best"))
    fps = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "copy-prints")
    roots = components(links(fps.select("node", *names), fps.count(), radius, part), "copy-edges")
    rooted = stash(fps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "copy-roots")
    texts = rows.join(rooted.select(*names, "root"), names).select("text_hash", "root").distinct()
    missed = components(missed_links(docs, texts), "copy-edges").select(F.col("node").alias("root"), F.col("root").alias("whole"))
    rooted = rooted.join(missed, "root", "left").withColumn("root", F.coalesce("whole", "root"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.xxhash64("best.doc_id", "best.text_hash").alias("key"))
    text = F.xxhash64(column_or_null(docs, "text", "string"))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(column_or_null(docs, "doc_id", "long"), text).alias("key"),
    )
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return named.join(kept, "key", "left_semi").withColumn("number", number).filter("number = 1").select("row.*")
