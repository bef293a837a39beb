"""Annotation files: JSON objects keyed by video id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import each
from ..functions.text import to_double
from ..shared import stash

RECORD_SCHEMA = "duration string, timestamps array<array<string>>, sentences array<string>"

# White space between the tokens of JSON.
_BLANK = " \t\r\n"


def read_raw_annotations(
    spark: SparkSession, path: str | list[str], split: str, layout: str = "file"
) -> DataFrame:
    """``split, pos, video_id, raw``: each record's own JSON text at its place in the object.

    ``layout="file"``: a file is one object, as in the published dataset. It may have any size: it is
    cut into blocks like any text file and many tasks read it (``_read_objects``). ``layout="lines"``:
    every line is such an object.

    A repeated key keeps its first place and its last value, of objects per file, of lines over all
    lines of files ordered by path. ``pos`` is the place in the object; of lines it is unique and
    grows along a file's block.
    """
    if layout == "lines":
        found = _read_lines(spark, path)
    elif layout == "file":
        found = _read_objects(spark, path)
    else:
        raise ValueError("layout is 'file' or 'lines'")
    return found.select(F.lit(split).alias("split"), "pos", "video_id", "raw")


def _entries(text: Column) -> Column:
    return F.map_entries(F.from_json(text, "map<string, string>"))


def _read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of objects of a few keys a line; repeated keys are settled over all files by path."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    entries = each(lines, _entries(F.col("value")), "e")
    # The numbers grow along a file's block; blocks and files are put in order by their own names.
    numbered = stash(entries.drop("value").withColumn("pos", F.monotonically_increasing_id()), "annotation-lines")
    at = F.struct("source", "block", "pos").alias("at")
    settled = _settled(numbered.select(at, F.col("e.key").alias("video_id"), F.col("e.value").alias("raw")), ["video_id"])
    return settled.select(F.col("at.pos").alias("pos"), "video_id", "raw")


def _settled(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with each key once: its last value, at its first place.

    Places are compared first. The repeated keys are written, so that the planner knows how few they
    are and sends them to the texts; only where they are many are the texts shuffled to them.
    """
    places = entries.groupBy(*keys).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = stash(places.filter("n > 1").drop("n"), "repeated-keys")
    rest = [c for c in entries.columns if c != "at"]
    return (
        entries.join(repeated, keys, "left")
        .filter(F.col("last").isNull() | (F.col("at") == F.col("last")))
        .select(F.coalesce("first", "at").alias("at"), *rest)
    )


def _segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What stands between the quotes of a file, in the order of the file within each block.

    A text file with quotes for line ends is cut at any quote, so a task reads a block whatever the
    size of the object. ``escaped``: a backslash belongs to the quote at the end. ``deeper``: brackets
    opened less those closed. ``opens``: a key may follow.
    """
    text = spark.read.option("lineSep", '"').text(path)
    tail = F.right(F.rtrim(F.col("value"), F.lit(_BLANK)), F.lit(1))
    # Most segments hold no bracket and no backslash, which plain searches find out soonest.
    slashes = F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2
    escaped = F.when(F.endswith(F.col("value"), F.lit("\\")), slashes).otherwise(F.lit(0))

    def count(mark: str) -> Column:
        return F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit(mark), F.lit("")))

    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        escaped.cast("int").alias("escaped"),
        (count("{") + count("[") - count("}") - count("]")).cast("long").alias("deeper"),
        tail.isin("{", ",").alias("opens"),
        F.col("value").alias("text"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(file, block), begin and end of each run of rows from one block."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    cut = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
        if b > a:
            yield (int(file[a]), int(block[a])), int(a), int(b)


def _column(batch: pa.RecordBatch, name: str, a: int, b: int) -> np.ndarray:
    return batch.column(name).slice(a, b - a).to_numpy(zero_copy_only=False)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether it holds an odd number of string borders, and how much deeper it ends.

    A block may begin inside a string or outside one, so there are two answers to the latter; with
    them the summaries of consecutive blocks compose.
    """

    def out(key: tuple[int, int], state: list[int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], pa.int64()) for v in (*key, *state)], ["file", "block", "odd", "outside", "inside"])

    key, state = None, [0, 0, 0]
    for batch in batches:
        for own, a, b in _runs(batch):
            if own != key:
                if key is not None:
                    yield out(key, state)
                key, state = own, [0, 0, 0]
            border = 1 - _column(batch, "escaped", a, b)
            deeper = _column(batch, "deeper", a, b)
            within = (state[0] + np.cumsum(border) - border) % 2
            state[1] += int(deeper[within == 0].sum())
            state[2] += int(deeper[within == 1].sum())
            state[0] = int(state[0] + border.sum()) % 2
    if key is not None:
        yield out(key, state)


def _block_starts(summaries: list, path: str | list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """Whether each block begins inside a string, and how deep, from the blocks before it."""

    def check() -> None:
        # The last segment of a file has no quote after it, so one border too many was counted.
        if file is not None and (not odd or depth):
            raise ValueError(f"an annotation file is not one whole JSON object: {path}")

    starts: dict[tuple[int, int], tuple[int, int]] = {}
    file, odd, depth = None, 0, 0
    for r in sorted(summaries, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            check()
            file, odd, depth = r["file"], 0, 0
        starts[r["file"], r["block"]] = odd, depth
        depth += r["inside"] if odd else r["outside"]
        odd = (odd + r["odd"]) % 2
    check()
    return starts


def _cut(starts):
    """Function for ``mapInArrow``: segments to the texts of entries, as far as a block holds them.

    Piece 0 of a block is what belongs to an entry of an earlier block, -1 tells of an unknown block.
    ``border`` marks pieces that may go on in another block. Every segment keeps the quote after it.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "block", "piece", "border", "text"])

    def joined(segments: list[str]) -> str:
        return '"'.join([*segments, ""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, depth, piece = None, 0, 0, 0
        held: list[str] = []
        for batch in batches:
            rows: list[tuple] = []
            for own, a, b in _runs(batch):
                if own != key:
                    if key is not None:
                        rows.append((*key, piece, True, joined(held)))
                    key, piece, held = own, 0, []
                    if own not in starts.value:
                        rows.append((*own, -1, True, None))
                    odd, depth = starts.value.get(own, (0, 0))
                border = 1 - _column(batch, "escaped", a, b)
                outside = (odd + np.cumsum(border) - border) % 2 == 0
                ends = depth + np.cumsum(np.where(outside, _column(batch, "deeper", a, b), 0))
                marks = np.flatnonzero(outside & (ends == 1) & _column(batch, "opens", a, b).astype(bool))
                odd, depth = int(odd + border.sum()) % 2, int(ends[-1])
                texts = batch.column("text").slice(a, b - a).to_pylist()
                begin = 0
                for mark in marks.tolist():
                    held += texts[begin : mark + 1]
                    rows.append((*key, piece, piece == 0, joined(held)))
                    piece, held, begin = piece + 1, [], mark + 1
                held += texts[begin:]
            if rows:
                yield out(rows)
        if key is not None:
            yield out([(*key, piece, True, joined(held))])

    return run


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, piece, border, text of all blocks.

    Two scans have to cut files alike. How Spark cuts them follows from the cores it has, so after a
    change of these in between both are made anew.
    """
    while True:
        segments = _segments(spark, path)
        narrow = segments.select("file", "block", "escaped", "deeper")
        # One row of five numbers for each block of some 100 MB.
        summaries = narrow.mapInArrow(_summarise, "file long, block long, odd long, outside long, inside long").collect()
        starts = spark.sparkContext.broadcast(_block_starts(summaries, path))
        pieces = stash(segments.mapInArrow(_cut(starts), "file long, block long, piece long, border boolean, text string"), "annotation-pieces")
        met = pieces.agg(F.count_distinct("file", "block").alias("n"), F.min("piece").alias("least")).first()
        if met["n"] == len(summaries) and (met["least"] or 0) >= 0:
            return pieces


def _read_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pos, video_id, raw of files that are one object each, read block by block.

    Whether a place is inside a string, and how deep in brackets, follows from all that is before it.
    A first scan brings what each block changes in that; a second one, with the state at the start
    of each block, cuts entries at the keys of the outermost object. Only an entry that crosses a
    border of blocks is put together by a shuffle.
    """
    pieces = _pieces(spark, path)
    counts = pieces.groupBy("file", "block").agg(F.max("piece").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    placed = pieces.join(offsets, ["file", "block"]).withColumn("at", F.col("before") + F.col("piece") - 1)
    placed = placed.filter("at >= 0")  # -1 is what stands before the first key
    border = placed.filter("border").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    whole = placed.filter("not border").select("file", "at", "text").unionByName(
        border.select("file", "at", F.array_join(F.col("parts.text"), "").alias("text"))
    )
    # Repeated keys are settled by the keys alone, so that the records are parsed once.
    key = F.regexp_extract("text", r'\A([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    keyed = whole.withColumn("video_id", F.get(F.from_json(F.concat(F.lit('["'), key, F.lit('"]')), "array<string>"), F.lit(0)))
    settled = _settled(keyed, ["file", "video_id"])
    # Between the quote before the key and the one of the next key: key, value and a comma, or the last bracket.
    body = F.rtrim(F.expr("left(text, length(text) - 1)"), F.lit(_BLANK))
    entry = F.concat(F.lit('{"'), F.left(body, F.length(body) - 1), F.lit("}"))
    parsed = each(settled.select("at", "text"), _entries(entry), "e")
    return parsed.select(F.col("at").cast("bigint").alias("pos"), F.col("e.key").alias("video_id"), F.col("e.value").alias("raw"))


def parse_annotations(raw_records: DataFrame) -> DataFrame:
    """``split, pos, video_id, duration, timestamps, sentences`` out of raw records.

    Numbers may be ints, decimals or numeric strings; what is not a number becomes null.
    """
    record = raw_records.withColumn("r", F.from_json("raw", RECORD_SCHEMA))
    spans = F.transform("r.timestamps", lambda t: F.transform(t, to_double))
    return record.select(
        "split",
        "pos",
        "video_id",
        to_double(F.col("r.duration")).alias("duration"),
        spans.alias("timestamps"),
        F.col("r.sentences").alias("sentences"),
    )


def read_annotations(spark: SparkSession, path: str | list[str], split: str, layout: str = "file") -> DataFrame:
    return parse_annotations(read_raw_annotations(spark, path, split, layout))


def to_json_lines(records: DataFrame) -> DataFrame:
    """Records as lines ``{video_id: {...}}``, ready for ``write.text``."""
    body = F.struct("duration", "timestamps", "sentences")
    return records.select(F.to_json(F.create_map(F.col("video_id"), body)).alias("value"))


def to_json_objects(records: DataFrame) -> DataFrame:
    """Records as the lines of one object a partition, ready for ``write.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            texts = [t[1:-1] for t in batch.column(0).to_pylist()]
            if texts:
                # All but the first line of a file begin with a comma.
                yield pa.record_batch([pa.array([(lead if n == 0 else ",") + t for n, t in enumerate(texts)])], ["value"])
                lead = ","
        yield pa.record_batch([pa.array(["{}" if lead == "{" else "}"])], ["value"])

    return to_json_lines(records).mapInArrow(run, "value string")
