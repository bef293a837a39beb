"""Token ids in grammar-compressed files that can be read at any place.

Documents are ordered by id and dealt by range to shards; a shard is written as blocks of whole
documents. In a block, the most frequent pairs of neighbouring symbols are replaced by new symbols
(Re-Pair, many pairs a round), never across the border of two documents. A block holds

    magic, number of documents, symbols and rules
    rules: two symbols each (16 bits)
    expansion length of each rule (32 bits)
    document ids (64 bits) with a flag for null, symbols and tokens of each document (64 bits)
    the symbols (16 bits), 50,257 and above being rules

and is one row of a Parquet table, so that any store Spark writes to can hold it. Expansion lengths
make places inside a document addressable without expanding what comes before.

A null or empty text is the end id alone; a null id comes first; rows with equal ids are ordered by
text. Very long texts are one document of a block of its own size. Other columns play no part. An empty
table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import new_folder
from .common import column_or_null, crc_ids, parts_by_bytes, sizes_of
from .tokens import ByteWords, encoder

VOCABULARY = "byte_bpe_50k.json"
TERMINALS = 50_257
END_ID = 0
SYMBOLS = 1 << 16
ROUNDS = 3
LEAST_COUNT = 24
BLOCK_IDS = 1 << 21
SHARD_BYTES = 16 << 20
BATCH_BYTES = 3 << 20
_CELL_BITS = 19
_MAGIC = b"SLRP"
_HEAD = struct.Struct("<4sIII")


def _kept_pairs(hits: np.ndarray) -> np.ndarray:
    """Of runs of overlapping pairs, every other one from the left."""
    starts = np.flatnonzero(np.diff(hits, prepend=-9) != 1)
    place = np.arange(len(hits)) - np.repeat(starts, np.diff(np.append(starts, len(hits))))
    return hits[place % 2 == 0]


def compress(ids: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS, least: int = LEAST_COUNT):
    """Symbols, rules and symbols per document of ids; no rule spans two documents."""
    symbols = ids.astype(np.uint16)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    rules = np.zeros((0, 2), np.uint16)
    for turn in range(rounds):
        room = (SYMBOLS - TERMINALS - len(rules)) // (rounds - turn)
        if len(symbols) < 2 or room <= 0:
            break
        pair = (symbols[:-1].astype(np.uint32) << np.uint32(16)) | symbols[1:]
        cell = ((pair * np.uint32(2654435761)) >> np.uint32(32 - _CELL_BITS)).astype(np.int32)
        inside = ~last[:-1]
        # One pair stands for each cell of a hash table and is then counted exactly.
        shown = np.zeros(1 << _CELL_BITS, np.uint32)
        shown[cell[inside]] = pair[inside]
        counted = inside & (shown[cell] == pair)
        counts = np.bincount(cell[counted], minlength=1 << _CELL_BITS)
        best = np.flatnonzero(counts >= least)
        if len(best) > room:
            best = best[np.argpartition(counts[best], -room)[-room:]]
        if not len(best):
            break
        rule_of = np.full(1 << _CELL_BITS, -1, np.int32)
        rule_of[best] = np.arange(len(best), dtype=np.int32)
        hits = _kept_pairs(np.flatnonzero(counted & (rule_of[cell] >= 0)))
        symbols[hits] = (TERMINALS + len(rules) + rule_of[cell[hits]]).astype(np.uint16)
        last[hits] |= last[hits + 1]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, last = symbols[keep], last[keep]
        made = shown[best]
        rules = np.concatenate([rules, np.stack([made >> np.uint32(16), made & np.uint32(0xFFFF)], 1).astype(np.uint16)])
    return symbols, rules, np.diff(np.flatnonzero(last), prepend=-1)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Tokens that each symbol stands for; a rule uses earlier symbols only."""
    sizes = np.ones(TERMINALS + len(rules), np.int64)
    pending = np.arange(len(rules))
    known = np.zeros(TERMINALS + len(rules), bool)
    known[:TERMINALS] = True
    while len(pending):
        ready = known[rules[pending, 0]] & known[rules[pending, 1]]
        now = pending[ready]
        sizes[TERMINALS + now] = sizes[rules[now, 0]] + sizes[rules[now, 1]]
        known[TERMINALS + now] = True
        pending = pending[~ready]
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Tokens of a run of symbols."""
    while True:
        grown = symbols >= TERMINALS
        if not grown.any():
            return symbols
        place = np.arange(len(symbols)) + np.cumsum(grown) - grown
        out = np.empty(len(symbols) + int(grown.sum()), np.uint16)
        out[place] = symbols
        rule = symbols[grown].astype(np.int64) - TERMINALS
        out[place[grown]], out[place[grown] + 1] = rules[rule, 0], rules[rule, 1]
        symbols = out


def write_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Bytes of a block of documents, each with its end id."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    symbols, rules, per_doc = compress(np.concatenate(ids), lengths)
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    return b"".join(
        (
            _HEAD.pack(_MAGIC, len(ids), len(symbols), len(rules)),
            rules.astype("<u2").tobytes(),
            expansion_lengths(rules)[TERMINALS:].astype("<u4").tobytes(),
            known.tobytes(),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            per_doc.astype("<i8").tobytes(),
            lengths.astype("<i8").tobytes(),
            symbols.astype("<u2").tobytes(),
        )
    )


class Block:
    """A block read back: documents, and tokens from any place of them."""

    def __init__(self, data: bytes):
        magic, n_docs, n_symbols, n_rules = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token block")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
        self.sizes = np.concatenate([np.ones(TERMINALS, np.int64), take("<u4", n_rules)])
        ids = take("<i8", n_docs)
        self.doc_ids = [None if null else int(i) for i, null in zip(ids, take("u1", n_docs))]
        self.symbols_of, self.lengths = take("<i8", n_docs), take("<i8", n_docs)
        self.symbols = take("<u2", n_symbols)
        self.ends = np.cumsum(self.symbols_of)

    def documents(self) -> Iterator[np.ndarray]:
        """Tokens of all documents in order."""
        tokens, end = expand(self.symbols, self.rules), 0
        for length in self.lengths:
            end += int(length)
            yield tokens[end - int(length) : end]

    def tokens(self, n: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of the n-th document; only symbols that reach into them are expanded."""
        symbols = self.symbols[self.ends[n] - self.symbols_of[n] : self.ends[n]]
        stop = int(self.lengths[n]) if stop is None else min(stop, int(self.lengths[n]))
        if start >= stop:
            return np.zeros(0, np.uint16)
        ends = np.cumsum(self.sizes[symbols])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules)[start - skipped : stop - skipped]


def write_tokens(docs: DataFrame, path: str, folder: str, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the token files of a corpus: rows (shard, block, n_ids, data)."""
    narrow = docs.select(
        column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text")
    )
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes), narrow.sparkSession.sparkContext.defaultParallelism)
    ordered = narrow.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        tokens = encoder(ByteWords, path)
        end = np.array([END_ID], tokens.kind)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([write_block(doc_ids, held)], pa.binary())],
                ["shard", "block", "n_ids", "data"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for begin, stop in parts_by_bytes(sizes_of(batch.column(1)), BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(begin, stop - begin).to_pylist()]
                for name, own in zip(names[begin:stop], tokens.ids(texts)):
                    doc_ids.append(name)
                    held.append(np.concatenate([own, end]))
                    size += len(own) + 1
                    if size >= block_ids:
                        yield row()
                        block, size, doc_ids, held = block + 1, 0, [], []
        if held:
            yield row()

    ordered.mapInArrow(blocks, "shard int, block int, n_ids long, data binary").write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of token files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(folder)
    order = Window.orderBy("shard", "block")  # one row per block
    starts = files.select("shard", "block", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("before"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(2)[i].as_py())
                lengths = block.lengths
                sums = [crc_ids(t) for t in block.documents()]
                n = len(sums)
                yield pa.record_batch(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, pa.int32()),
                        pa.array([batch.column(1)[i].as_py()] * n, pa.int32()),
                        pa.array(block.doc_ids, pa.int64()),
                        pa.array(np.cumsum(lengths) - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("shard", "block", "data").mapInArrow(
        each, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_corpus(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write the corpus' token files and read them back."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    write_tokens(docs, path, folder)
    return read_tokens(spark, folder)
