"""Packing token sequences: shortest pack first over the histogram of lengths.

Documents are cut into pieces of a sequence's length and a rest. Lengths are placed longest first,
all pieces of one length at once, into the pattern with the most free room; a pattern keeps a count
and is split when fewer pieces than packs are left. The histogram has one entry per length, so the
patterns are bounded by the sequence length, whatever the corpus. Pieces then find their place by
their rank among the pieces of their length.

A null or empty text is the end id alone. Repeated ids and rows are documents of their own, and
rows equal in all but further columns may change places. Very long texts are encoded whole and cut.
Other columns play no part. An empty table has no pieces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, crc_ids, parts_by_bytes, per_batch, sizes_of, texts_of
from .tokens import SpacedWords, encoder

ROOM = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
BUCKET_ROWS = 200_000
BATCH_BYTES = 1 << 20

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_hash long"


def pieces_of(docs: DataFrame, path: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document's ids: where it starts, how long it is, its checksum."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        tokens = encoder(SpacedWords, path)
        rows: list[tuple] = []
        for begin, end in parts_by_bytes(sizes_of(batch.column(1)), BATCH_BYTES):
            texts = texts_of(batch.column(1).slice(begin, end - begin))
            for doc_id, own in zip(ids[begin:end], tokens.ids(texts)):
                own = np.append(own, own.dtype.type(end_id))
                for start in range(0, len(own), room):
                    piece = own[start : start + room]
                    rows.append((doc_id, start, len(piece), crc_ids(piece), len(own)))
        columns = list(zip(*rows))
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(
        column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text")
    )
    plain = narrow.mapInArrow(per_batch(cut), _PIECE.rsplit(",", 1)[0])
    return plain.withColumn("piece_hash", F.xxhash64("doc_id", "start", "ids_crc32"))


@dataclass
class Pattern:
    """So many packs of the same lengths."""

    count: int
    lengths: list[int] = field(default_factory=list)


def patterns_for(histogram: dict[int, int], room: int = ROOM) -> list[Pattern]:
    """Packing patterns for so many pieces of each length; every piece is placed."""
    by_free: list[list[Pattern]] = [[] for _ in range(room + 1)]
    most_free = 0
    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"length {length} does not fit into {room}")
        left, moved = histogram[length], []
        while left:
            while most_free and not by_free[most_free]:
                most_free -= 1
            if most_free < length:
                each = room // length  # a new pack has the most room for the next piece, too
                packs, rest = divmod(left, each)
                moved += [Pattern(n, [length] * k) for n, k in ((packs, each), (1, rest)) if n and k]
                break
            pattern = by_free[most_free].pop()
            if pattern.count > left:
                by_free[most_free].append(Pattern(pattern.count - left, pattern.lengths))
                pattern = Pattern(left, pattern.lengths)
            left -= pattern.count
            pattern = Pattern(pattern.count, [*pattern.lengths, length])
            free = room - sum(pattern.lengths)
            if free >= length:  # it may take another piece of this length
                by_free[free].append(pattern)
            else:
                moved.append(pattern)
        for pattern in moved:
            free = room - sum(pattern.lengths)
            by_free[free].append(pattern)
            most_free = max(most_free, free)
    return [p for patterns in by_free for p in patterns]


def slots_of(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of its runs of places, ordered by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for pattern in patterns:
        offset = 0
        for length in pattern.lengths:
            rank = filled.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            filled[length] = rank + pattern.count
            offset += length
        sequence += pattern.count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(
    docs: DataFrame, path: str, room: int = ROOM, end_id: int = END_ID, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    pieces = stash(pieces_of(docs, path, room, end_id), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``room`` rows
    places = spark.sparkContext.broadcast(slots_of(patterns_for(histogram, room)))
    buckets = max(1, -(-max(histogram.values(), default=1) // bucket_rows))
    bucketed = pieces.withColumn("bucket", F.pmod("piece_hash", F.lit(buckets)))
    by_length = Window.partitionBy("length").orderBy("bucket")
    before = (
        bucketed.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("length", "bucket", (F.sum("rows").over(by_length) - F.col("rows")).alias("before"))
    )
    in_bucket = Window.partitionBy("length", "bucket").orderBy("piece_hash", "doc_id", "start", "ids_crc32")
    ranked = (
        bucketed.join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(in_bucket) - 1)
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for length in np.unique(lengths):
            first, base, at = places.value[int(length)]
            rows = lengths == length
            run = np.searchsorted(first, ranks[rows], side="right") - 1
            sequence[rows], offset[rows] = base[run] + ranks[rows] - first[run], at[run]
        kept = [batch.column(i) for i in range(5)]
        return pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(
        per_batch(place),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
