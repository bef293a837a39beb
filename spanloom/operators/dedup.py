"""Greedy overlap de-duplication of detected activities.

Activities of a video are scanned by (start, pos). The first kept one with tIoU above the threshold
absorbs the newcomer, taking over its span and text if the new text is longer; otherwise the
newcomer is kept. A replaced span changes later comparisons, so this is a fold, not a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.binding import each, let
from ..functions.intervals import tiou
from ..functions.overlap import Kept, OverlapScan
from ..shared import stash
from .hotkeys import cut_chunks, split_hot

THRESHOLD = 0.5
FOLD_LIMIT = 5_000
CHUNK_ROWS = 200_000

_KEPT_TYPE = "array<struct<start: double, end: double, description: string>>"


def _length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def _fold(ordered: Column, threshold: float) -> Column:
    """The scan as an array fold over one video's activities."""

    def step(kept: Column, new: Column) -> Column:
        item = F.struct(new["start"].alias("start"), new["end"].alias("end"), new["description"].alias("description"))
        hits = F.transform(
            kept, lambda k: tiou(new["start"], new["end"], k["start"], k["end"]) > F.lit(threshold)
        )

        def place(at: Column) -> Column:
            longer = _length(new["description"]) > _length(F.get(kept, at - 1)["description"])
            swapped = F.transform(kept, lambda k, i: F.when(i == at - 1, item).otherwise(k))
            return F.when(at == 0, F.concat(kept, F.array(item))).when(longer, swapped).otherwise(kept)

        return let(F.array_position(hits, True).cast("int"), place)

    return F.aggregate(ordered, F.array().cast(_KEPT_TYPE), step)


def dedup_activities(
    activities: DataFrame,
    group: str = "video_id",
    threshold: float = THRESHOLD,
    limit: int | None = FOLD_LIMIT,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Kept activities per ``group`` with their place ``kept_no`` in kept order.

    Input: ``group, pos, start, end, description``; ``pos``, a number or a struct, orders equal starts. Videos up to
    ``limit`` rows are folded inside one row each. A row without both bounds takes no part; a null
    text counts as an empty one. Larger ones are first cut where nothing overlaps (``_dedup_hot``),
    and what is still too large is scanned in chunks (``_scan_long``). ``limit=None`` skips the size check.
    """
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    rows = activities.select(
        F.col(group).alias("key"),
        F.col("pos"),
        F.col("start").cast("double").alias("start"),
        F.col("end").cast("double").alias("end"),
        F.col("description"),
    ).filter("start is not null and end is not null")
    cool, hot, n_hot = split_hot(rows, "key", limit)
    item = F.struct("start", "pos", "end", "description")
    folded = cool.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = each(folded, _fold(F.col("items"), threshold), "k", "kept_no").select(
        "key", F.col("kept_no").cast("bigint").alias("kept_no"), "k.*"
    )
    if hot is not None:
        out = out.unionByName(_dedup_hot(hot, threshold, limit, n_hot, chunk_rows))
    return out.withColumnRenamed("key", group)


def _stretches(pieces: DataFrame) -> DataFrame:
    """Add ``stretch``: a new one begins where all activities before it have ended.

    Nothing before such a place overlaps anything after it, so stretches are scanned independently.
    Ends run on from chunk to chunk through one row a chunk.
    """
    order = W.partitionBy("key", "chunk").orderBy("start", "pos")
    earlier = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = pieces.groupBy("key", "chunk").agg(F.max("end").alias("last_end"))
    carried = ends.select("key", "chunk", F.max("last_end").over(earlier).alias("carried"))
    before = F.greatest(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("carried"))
    marked = pieces.join(carried, ["key", "chunk"]).withColumn("begins", (before.isNull() | (F.col("start") >= before)).cast("bigint"))
    counts = marked.groupBy("key", "chunk").agg(F.sum("begins").alias("n"))
    offsets = counts.select("key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("inside", inside).join(offsets, ["key", "chunk"]).select(
        "key", "pos", "start", "end", "description", "chunk", (F.col("offset") + F.col("inside")).alias("stretch")
    )


def _dedup_hot(rows: DataFrame, threshold: float, limit: int, n_rows: int, chunk_rows: int) -> DataFrame:
    """Exact scan of videos too large for one task: their stretches one by one, numbered in order."""
    stretches = stash(_stretches(cut_chunks(rows, "key", [F.col("start"), F.col("pos")], n_rows, chunk_rows)), "stretches")
    sizes = stretches.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("at"))
    long = stash(sizes.filter(F.col("n") > limit).withColumn("line", F.monotonically_increasing_id()), "long-stretches")
    n_long = long.agg(F.sum("n")).first()[0]
    item = F.struct("start", "pos", "end", "description")
    short = stretches.join(long, ["key", "stretch"], "left_anti") if n_long else stretches
    folded = short.groupBy("key", "stretch").agg(F.min("chunk").alias("at"), F.array_sort(F.collect_list(item)).alias("items"))
    kept = each(folded, _fold(F.col("items"), threshold), "k", "no").select(
        "key", "stretch", "at", F.col("no").cast("bigint").alias("no"), "k.*"
    )
    if n_long:
        lines = stretches.join(long.select("key", "stretch", "line"), ["key", "stretch"]).select(
            F.col("line").alias("key"), "pos", "start", "end", "description"
        )
        scanned = _scan_long(lines, threshold, n_long, chunk_rows).withColumnRenamed("key", "line")
        kept = kept.unionByName(
            scanned.join(long, "line").select("key", "stretch", "at", F.col("kept_no").alias("no"), "start", "end", "description")
        )
    kept = stash(kept, "kept")
    # Kept activities before each stretch: within the chunk in which it begins, and in earlier chunks.
    counts = kept.groupBy("key", "at", "stretch").agg(F.count(F.lit(1)).alias("n"))
    chunks = counts.groupBy("key", "at").agg(F.sum("n").alias("n"))
    over_chunks = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    over_stretches = W.partitionBy("key", "at").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("key", "at", F.coalesce(F.sum("n").over(over_chunks), F.lit(0)).alias("earlier"))
    counts = counts.select("key", "at", "stretch", F.coalesce(F.sum("n").over(over_stretches), F.lit(0)).alias("before"))
    offsets = counts.join(chunks, ["key", "at"]).select("key", "stretch", (F.col("earlier") + F.col("before")).alias("offset"))
    return kept.join(offsets, ["key", "stretch"]).select("key", (F.col("offset") + F.col("no")).alias("kept_no"), "start", "end", "description")


_FIELDS = ["slot", "inherited", "start", "end", "description"]
_SCANNED = "leg int, out_no int, slot bigint, inherited boolean, start double, end double, description string"
_OPENING = "array<struct<out_no: int, start: double, end: double, description: string>>"


def _scan(threshold: float, key_type: pa.DataType, apart: bool):
    """Scan chunks of videos as a stream, one after the other in a task.

    Where chunks are scanned ``apart``, each starts from its own open activities: rows come by chunk, first
    what is open (``role`` 0), then its activities. Otherwise a video is scanned over all borders: rows come
    with what is open at its start, then activities by chunk. Returns for each chunk what it settled
    (``out_no`` null) and what it leaves open, numbered in kept order; memory holds what is open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, leg, slot, scan = None, None, None, 0, None
        out: list[tuple] = []

        def tell(done: list[Kept], numbers: list[int | None]) -> None:
            out.extend((key, leg, no, *(getattr(k, f) for f in _FIELDS)) for no, k in zip(numbers, done))

        def border() -> None:
            """End of a chunk: what is open is handed on under new numbers."""
            nonlocal slot
            tell(scan.live, list(range(len(scan.live))))
            scan.live = [Kept(no, True, k.start, k.end, k.description) for no, k in enumerate(scan.live)]
            slot = 0

        def batch_of() -> pa.RecordBatch:
            kinds = [key_type, pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.string()]
            names = ["key", "leg", "out_no", *_FIELDS]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "role", "chunk", "out_no", "start", "end", "description"))
            for own, role, chunk, no, start, end, description in zip(*columns):
                if begun is None or begun != (own, chunk if apart else None):
                    if scan is not None and leg is not None:
                        border()
                    begun = (own, chunk if apart else None)
                    key, leg, slot, scan = own, None, 0, OverlapScan(threshold)
                if role == 0:
                    scan.live.append(Kept(no, True, start, end, description))
                    continue
                if leg is not None and chunk != leg:
                    border()
                leg = chunk
                done = scan.settle(start)
                tell(done, [None] * len(done))
                slot += scan.push(Kept(slot, False, start, end, description))
            if out:
                yield batch_of()
                out.clear()
        if scan is not None and leg is not None:
            border()
        if out:
            yield batch_of()

    return run


def _scan_long(rows: DataFrame, threshold: float, n_rows: int, chunk_rows: int) -> DataFrame:
    """Exact scan of long stretches that never pause.

    Chunks follow the scan order. All are scanned at once, first as if nothing was open before
    them; then the spans and texts each leaves open are handed to the next chunk, and only chunks
    whose opening state turned out different are scanned again. Once nothing changes, every chunk
    has been scanned from the true state of its predecessor, so the result is that of the one long
    scan. Where that takes more rounds than the chunks can be halved, a difference is running through
    the whole stretch; the rest is then scanned in order (``_finish_in_order``).
    """
    pieces = cut_chunks(rows, "key", [F.col("start"), F.col("pos")], n_rows, chunk_rows)
    order = W.partitionBy("key").orderBy("leg")
    found = pieces.select("key", F.col("chunk").alias("leg")).groupBy("key", "leg").count()
    legs = stash(
        found.select("key", "leg", F.lag("leg").over(order).alias("before"), F.lead("leg").over(order).alias("after")),
        "legs",
    )
    schema = f"key {rows.schema['key'].dataType.simpleString()}, {_SCANNED}"
    key_type = to_arrow_type(rows.schema["key"].dataType)
    nothing = F.array().cast(_OPENING)
    opening = legs.select("key", "leg", nothing.alias("state"))
    todo, current = opening, None
    rounds = 1 + (-(-n_rows // chunk_rows)).bit_length()
    while current is None or not todo.isEmpty():
        if not rounds:
            current = _finish_in_order(pieces, current, opening, todo, threshold, schema)
            break
        rounds -= 1
        due = todo.select("key", F.col("leg").alias("chunk"))
        work = pieces if current is None else pieces.join(due, ["key", "chunk"], "left_semi")
        states = todo.select("key", F.col("leg").alias("chunk"), F.explode("state").alias("s"))
        dealt = _with_open(work, states).repartition("key", "chunk")
        dealt = dealt.sortWithinPartitions("key", "chunk", "role", "out_no", "start", "pos").drop("pos")
        scanned = stash(dealt.mapInArrow(_scan(threshold, key_type, True), schema), "scan")
        redone = todo.select("key", "leg")
        if current is None:
            current = scanned
        else:
            current = stash(current.join(redone, ["key", "leg"], "left_anti").unionByName(scanned), "scan")
        # What each scanned leg leaves open is the opening state of the leg after it.
        left_open = (
            scanned.filter(F.col("out_no").isNotNull())
            .groupBy("key", "leg")
            .agg(F.array_sort(F.collect_list(F.struct("out_no", "start", "end", "description"))).alias("state"))
        )
        handed = (
            legs.join(redone, ["key", "leg"], "left_semi")
            .filter(F.col("after").isNotNull())
            .join(left_open, ["key", "leg"], "left")
            .select("key", F.col("after").alias("leg"), F.coalesce("state", nothing).alias("state"))
        )
        known = opening.withColumnRenamed("state", "old")
        todo = stash(handed.join(known, ["key", "leg"]).filter(F.col("state") != F.col("old")).drop("old"), "todo")
        opening = stash(opening.join(todo, ["key", "leg"], "left_anti").unionByName(todo), "opening")
    return _number_kept(current.join(legs, ["key", "leg"]), legs)


def _with_open(work: DataFrame, states: DataFrame) -> DataFrame:
    """Activities (``role`` 1) and the open ones ``s`` (``role`` 0) of chunks in one table."""
    pos = work.schema["pos"].dataType
    columns = ["key", "role", "chunk", "out_no", "pos", "start", "end", "description"]
    state = states.select("key", "chunk", "s.*").withColumns({"role": F.lit(0), "pos": F.lit(None).cast(pos)})
    work = work.withColumns({"role": F.lit(1), "out_no": F.lit(None).cast("int")})
    return state.select(*columns).unionByName(work.select(*columns))


def _finish_in_order(pieces: DataFrame, current: DataFrame, opening: DataFrame, todo: DataFrame, threshold: float, schema: str) -> DataFrame:
    """Scanned rows with all from each key's first unsettled chunk on made anew, in order."""
    # Chunks before the first one with another opening state were scanned from true states.
    first = stash(todo.groupBy("key").agg(F.min("leg").alias("first")), "unsettled")
    state = opening.join(first, "key").filter("leg = first").select("key", F.col("leg").alias("chunk"), F.explode("state").alias("s"))
    ordered = _with_open(pieces.join(first, "key").filter("chunk >= first"), state).repartition("key")
    ordered = ordered.sortWithinPartitions("key", "role", "chunk", "out_no", "start", "pos")
    key_type = to_arrow_type(pieces.schema["key"].dataType)
    rest = ordered.drop("pos").mapInArrow(_scan(threshold, key_type, False), schema)
    settled = current.join(first, "key", "left").filter("first is null or leg < first").drop("first")
    return stash(settled.unionByName(rest), "scan")


def _number_kept(scanned: DataFrame, legs: DataFrame) -> DataFrame:
    """Final activities with their place in kept order.

    An open activity of a leg is either new there or the one the leg before left open under the
    same number. Following these links by doubling leads each to the leg and slot it was first
    kept in; slots are numbered in kept order inside a leg, legs follow one another.
    """
    is_open = F.col("out_no").isNotNull()
    own = ~F.col("inherited")
    links = scanned.filter(is_open).select(
        "key",
        "leg",
        "out_no",
        F.when(own, F.col("leg")).alias("root_leg"),
        F.when(own, F.col("slot")).alias("root_slot"),
        F.when(~own, F.col("before")).alias("up_leg"),
        F.when(~own, F.col("slot").cast("int")).alias("up_no"),
    )
    links = stash(links, "links")
    while not links.filter(F.col("root_leg").isNull()).isEmpty():
        above = links.select(
            "key",
            F.col("leg").alias("up_leg"),
            F.col("out_no").alias("up_no"),
            *[F.col(c).alias(f"next_{c}") for c in ("root_leg", "root_slot", "up_leg", "up_no")],
        )
        followed = links.join(above, ["key", "up_leg", "up_no"], "left")
        links = stash(
            followed.select(
                "key",
                "leg",
                "out_no",
                F.coalesce("root_leg", "next_root_leg").alias("root_leg"),
                F.coalesce("root_slot", "next_root_slot").alias("root_slot"),
                F.col("next_up_leg").alias("up_leg"),
                F.col("next_up_no").alias("up_no"),
            ),
            "links",
        )
    final = scanned.filter(~is_open | F.col("after").isNull())
    roots = links.select(
        "key", F.col("leg").alias("before"), F.col("out_no").cast("bigint").alias("slot"), "root_leg", "root_slot"
    )
    old = final.filter("inherited").join(roots, ["key", "before", "slot"])
    new = final.filter(own).withColumn("root_leg", F.col("leg")).withColumn("root_slot", F.col("slot"))
    counts = legs.select("key", "leg").join(
        scanned.filter(own).groupBy("key", "leg").agg(F.count(F.lit(1)).alias("n_new")), ["key", "leg"], "left"
    )
    earlier = W.partitionBy("key").orderBy("leg").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "key", F.col("leg").alias("root_leg"), F.coalesce(F.sum("n_new").over(earlier), F.lit(0)).alias("offset")
    )
    return (
        new.unionByName(old)
        .join(offsets, ["key", "root_leg"])
        .select("key", (F.col("offset") + F.col("root_slot")).alias("kept_no"), "start", "end", "description")
    )
