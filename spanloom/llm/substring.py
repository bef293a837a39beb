"""Removing word sequences that an earlier document has too.

Every run of ``size`` words is a window. Counting all of them exactly would shuffle a multiple of the
corpus, so a count-min sketch goes first:

1. Documents are dealt to chunks by id. Each chunk sends its partial sketch, two rows of hashed
   cells, as sorted cell numbers; slices of the cell range add the partial sketches up. The number
   of cells follows the corpus' size. A slice answers each chunk with one bit per cell it sent:
   whether the merged count is 2 or more. The sketch itself never leaves its slices.
2. A window is estimated repeated if both rows say so. No repeated window can be missed. Only these
   are sent on, one row per chunk and window with the smallest document id, and grouped exactly by a
   128-bit fingerprint. Again one bit comes back: whether another chunk has a smaller id.
3. Each chunk covers the words of its flagged windows and keeps the rest.

What crosses the network is about two bytes per window, and full fingerprints for repeated ones
only; a window that a third of all documents share arrives once per chunk.

Nulls: a null text has no words; a null id counts as the largest number. Rows with equal ids do
not remove words from each other. An empty table stays empty; very long texts are read whole. Texts under ``size`` words are kept whole. Other columns, whatever
their names, are carried along.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_or_null, hold_memory, parts_by_bytes, texts_of, window_hashes, word_hashes

SIZE = 13
CHUNK_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
# Bytes of text per cell of a sketch row; a window takes about six bytes of text.
BYTES_PER_CELL = 1
_NO_ID = np.iinfo(np.int64).max


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte planes apart."""
    kind = values.dtype
    gaps = np.diff(values, prepend=kind.type(0))
    planes = gaps.astype(kind.newbyteorder("<")).view(np.uint8).reshape(-1, kind.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _planes(values: np.ndarray) -> bytes:
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unplanes(data, kind), dtype=kind)


class _Windows:
    """Windows of a chunk: two fingerprints and the document of each, in order of the words."""

    def __init__(self, texts: list[bytes], size: int):
        hold_memory("substring")
        self.size, self.per_text = size, np.zeros(0, np.int64)
        firsts, seconds, docs, counts = [], [], [], []
        for begin, end in parts_by_bytes(map(len, texts), BATCH_BYTES):
            (a, b), n = word_hashes(texts[begin:end])
            counts.append(n)
            whole = np.ones(max(len(a) - size + 1, 0), bool)
            owner = np.repeat(np.arange(begin, end, dtype=np.int32), n)
            if len(whole):
                whole = owner[: len(whole)] == owner[size - 1 :]
                firsts.append(window_hashes(a, size, 0)[whole])
                seconds.append(window_hashes(b, size, 1)[whole])
                docs.append(owner[: len(whole)][whole])
        self.per_text = np.concatenate(counts) if counts else self.per_text
        self.h1 = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
        self.h2 = np.concatenate(seconds) if seconds else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int32)


class Sketch:
    """Shape of the merged sketch: two rows of cells, cut into slices."""

    def __init__(self, total_bytes: int, chunk_bytes: int = CHUNK_BYTES):
        self.chunks = max(1, -(-total_bytes // chunk_bytes))
        self.slice_cells = max(1024, chunk_bytes // BYTES_PER_CELL)
        self.cells = self.chunks * self.slice_cells
        self.kind = np.uint32 if self.cells < 1 << 32 else np.uint64

    def cell(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.cells)).astype(self.kind)

    def sliced(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slices that sorted cells fall into, and where each begins."""
        slices = np.unique(cells // self.kind(self.slice_cells))
        starts = np.searchsorted(cells, slices * self.kind(self.slice_cells))
        return slices.astype(np.int64), np.append(starts, len(cells))


def _row_cells(sketch: Sketch, windows: _Windows, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by cell of a row, the cells that occur, and their counts."""
    cells = sketch.cell(windows.h1 if row == 0 else windows.h2)
    order = np.argsort(cells)
    ordered = cells[order]
    first = np.flatnonzero(np.diff(ordered.astype(np.int64), prepend=-1))
    return order, ordered[first], np.diff(np.append(first, len(ordered)))


def _estimated(sketch: Sketch, windows: _Windows, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
    """Which windows the merged sketch takes for repeated."""
    repeated = np.ones(len(windows.h1), bool)
    for row in (0, 1):
        order, cells, counts = _row_cells(sketch, windows, row)
        slices, starts = sketch.sliced(cells)
        bits = np.zeros(len(cells), bool)
        for s, a, b in zip(slices.tolist(), starts[:-1], starts[1:]):
            bits[a:b] = np.unpackbits(np.frombuffer(answers[row][s], np.uint8), count=b - a).astype(bool)
        mine = np.empty(len(order), bool)
        mine[order] = np.repeat(bits, counts)
        repeated &= mine
    return repeated


def _candidates(windows: _Windows, ids: np.ndarray, repeated: np.ndarray):
    """Distinct fingerprints among the estimated windows, their smallest document id, and which they are."""
    at = np.flatnonzero(repeated)
    h1, h2 = windows.h1[at], windows.h2[at]
    order = np.lexsort((h2, h1))
    h1, h2, doc = h1[order], h2[order], ids[windows.doc[at[order]]]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(doc, first) if len(first) else doc
    return at[order], np.cumsum(new) - 1, h1[first], h2[first], least, doc


def _exact_slices(sketch: Sketch, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of sorted first fingerprints for the exact pass."""
    part = ((h1 >> np.uint64(32)) * np.uint64(sketch.chunks) >> np.uint64(32)).astype(np.int64)
    slices, starts = np.unique(part, return_index=True)
    return slices, np.append(starts, len(h1))


def _answers(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {0: {}, 1: {}, 2: {}}
    for kind, part, data in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "bits"))):
        out[kind][part] = data
    return out


def _blobs(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def deduplicate(docs: DataFrame, size: int = SIZE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """row (all columns), doc_id, n_words, n_removed, kept, kept_sha256 (of the kept words joined by one space).

    ``kept`` is the text itself where nothing is removed and the joined words elsewhere.
    """
    text = column_or_null(docs, "text", "string")
    total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    sketch = Sketch(total, chunk_bytes)
    # The text is carried once, beside the row.
    carried = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name == "text" else F.col(f"`{f.name}`") for f in docs.schema])
    doc_id = column_or_null(docs, "doc_id", "long")
    chunked = docs.select(
        F.pmod(F.xxhash64(doc_id, F.octet_length(text)), F.lit(sketch.chunks)).alias("chunk"),
        F.coalesce(doc_id, F.lit(_NO_ID)).alias("doc_id"), text.alias("text"), carried.alias("row"),
    )
    by_chunk = chunked.groupBy("chunk")

    def sketched(table: pa.Table) -> pa.Table:
        windows = _Windows(texts_of(table.column("text")), size)
        chunk, rows = table.column("chunk")[0].as_py(), []
        for kind in (0, 1):
            _, cells, counts = _row_cells(sketch, windows, kind)
            slices, starts = sketch.sliced(cells)
            for s, a, b in zip(slices.tolist(), starts[:-1], starts[1:]):
                local = cells[a:b] - sketch.kind(s * sketch.slice_cells)
                many = np.packbits(counts[a:b] > 1)
                rows.append((kind, s, chunk, _packed(local.astype(np.uint32)), zstandard.compress(many.tobytes(), 1)))
        return _blobs(rows, ["kind", "part", "chunk", "cells", "many"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def merged(table: pa.Table) -> pa.Table:
        counts = np.zeros(sketch.slice_cells, np.uint8)
        sent = []
        for data, many in zip(table.column("cells").to_pylist(), table.column("many").to_pylist()):
            cells = _unpacked(data, np.uint32)
            twice = np.unpackbits(np.frombuffer(zstandard.decompress(many), np.uint8), count=len(cells))
            counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)  # 2 stands for "2 or more"
            sent.append(data)
        bits = [np.packbits(counts[_unpacked(d, np.uint32)] > 1).tobytes() for d in sent]
        return pa.table({"kind": table.column("kind"), "part": table.column("part"), "chunk": table.column("chunk"), "bits": pa.array(bits, pa.binary())})

    answer = "kind int, part long, chunk long, bits binary"
    first = (
        by_chunk.applyInArrow(sketched, "kind int, part long, chunk long, cells binary, many binary")
        .groupBy("kind", "part")
        .applyInArrow(merged, answer)
    )

    def picked(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _blobs([], ["part", "chunk", "h1", "h2", "least"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])
        windows = _Windows(texts_of(table.column("text")), size)
        repeated = _estimated(sketch, windows, _answers(answers))
        _, _, h1, h2, least, _ = _candidates(windows, table.column("doc_id").to_numpy(), repeated)
        slices, starts = _exact_slices(sketch, h1)
        chunk = table.column("chunk")[0].as_py()
        rows = [
            (s, chunk, _packed(h1[a:b]), h2[a:b].tobytes(), _planes(least[a:b]))
            for s, a, b in zip(slices.tolist(), starts[:-1], starts[1:])
        ]
        return _blobs(rows, ["part", "chunk", "h1", "h2", "least"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def exact(table: pa.Table) -> pa.Table:
        h1s = [_unpacked(d, np.uint64) for d in table.column("h1").to_pylist()]
        h1 = np.concatenate(h1s)
        h2 = np.frombuffer(b"".join(table.column("h2").to_pylist()), np.uint64)
        least = np.concatenate([_unplanes(d, np.int64) for d in table.column("least").to_pylist()])
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        earlier = np.empty(len(order), bool)
        earlier[order] = lowest[np.cumsum(new) - 1] < least[order]
        bits = [np.packbits(e).tobytes() for e in np.split(earlier, np.cumsum([len(h) for h in h1s])[:-1])]
        return pa.table(
            {"kind": pa.array([2] * table.num_rows, pa.int32()), "part": table.column("part"), "chunk": table.column("chunk"), "bits": pa.array(bits, pa.binary())}
        )

    second = (
        by_chunk.cogroup(first.groupBy("chunk"))
        .applyInArrow(picked, "part long, chunk long, h1 binary, h2 binary, least binary")
        .groupBy("part")
        .applyInArrow(exact, answer)
    )
    kept_type = T.StructType(
        [
            chunked.schema["row"],
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = texts_of(table.column("text")), table.column("doc_id").to_numpy()
        kept, sums, gone = [], [], np.zeros(len(texts), np.int64)
        windows = _Windows(texts, size)
        if table.num_rows:
            said = _answers(answers)
            at, key, h1, _, least, doc = _candidates(windows, ids, _estimated(sketch, windows, said))
            slices, starts = _exact_slices(sketch, h1)
            earlier = np.zeros(len(h1), bool)
            for s, a, b in zip(slices.tolist(), starts[:-1], starts[1:]):
                earlier[a:b] = np.unpackbits(np.frombuffer(said[2][s], np.uint8), count=b - a).astype(bool)
            flagged = np.zeros(len(windows.h1), bool)
            flagged[at] = earlier[key] | (doc > least[key])
        per_text = windows.per_text
        n_windows = np.maximum(per_text - size + 1, 0)
        ends = np.cumsum(n_windows)
        for i, text in enumerate(texts):
            words = text.split()
            mine = flagged[ends[i] - n_windows[i] : ends[i]]
            if mine.any():
                cover = np.zeros(len(words) + 1, np.int32)
                starts = np.flatnonzero(mine)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + size, -1)
                keep = np.cumsum(cover[:-1]) == 0
                gone[i] = len(words) - int(keep.sum())
                words = compress(words, keep.tolist())
            left = b" ".join(words)
            kept.append(left if gone[i] else text)
            sums.append(hashlib.sha256(left).hexdigest())
        blank = table.column("text").is_null().to_pylist()
        kept = [None if b else k for b, k in zip(blank, kept)]
        return pa.table(
            {
                "row": table.column("row"),
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(per_text, pa.int64()),
                "n_removed": pa.array(gone),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array(sums, pa.string()),
            }
        )

    both = first.unionByName(second)
    done = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(removed, kept_type)
    # The id as it came: inside, null stands as the largest number.
    own = F.col("row")["doc_id"].cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return done.withColumn("doc_id", own)


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with the words they repeat from earlier ones taken out; a null text stays null.

    Texts of which nothing is removed keep their white space; others have their words joined by one
    space. Columns are kept; ``n_chars`` is set anew where a text changed.
    """
    done = deduplicate(docs, size)
    changed = F.col("n_removed") > 0
    columns = []
    for name in docs.columns:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.col("kept")
        elif name == "n_chars":
            own = F.when(changed, F.length("kept")).otherwise(own).cast(docs.schema[name].dataType)
        columns.append(own.alias(name))
    return done.select(*columns)
