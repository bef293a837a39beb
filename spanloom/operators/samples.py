"""From annotations to clip samples and video samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import each
from ..functions.intervals import (
    DEFAULT_DURATION,
    DURATION_CAP,
    duration_or_default,
    effective_end,
    valid_interval,
)
from ..functions.text import category_of, strip_text, video_path_of

MAX_ANNOTATIONS = 12
SMALL_SAMPLE = 100_000
SAMPLE_BIN_DIGITS = 4
DIGEST_DIGITS = 32


def pair_annotations(timestamps: Column, sentences: Column) -> Column:
    """Zip spans with sentences up to the shorter side: ``array<struct<pos, start, end, sentence>>``."""
    count = F.least(F.size(timestamps), F.size(sentences))
    pairs = F.slice(F.arrays_zip(timestamps.alias("t"), sentences.alias("s")), F.lit(1), count)
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            i.cast("bigint").alias("pos"),
            F.get(p["t"], 0).alias("start"),
            F.get(p["t"], 1).alias("end"),
            p["s"].alias("sentence"),
        ),
    )


def explode_annotations(records: DataFrame) -> DataFrame:
    """One row per (span, sentence) pair of a record; a span without a sentence is left out."""
    pairs = pair_annotations(F.col("timestamps"), F.col("sentences"))
    rest = [c for c in records.columns if c not in ("timestamps", "sentences")]
    return each(records, pairs, "p").select(
        *rest,
        F.col("p.pos").alias("ann_pos"),
        F.col("p.start").alias("start"),
        F.col("p.end").alias("end"),
        F.col("p.sentence").alias("sentence"),
    )


def keep_valid(annotations: DataFrame) -> DataFrame:
    """Spans with ``end > start`` only, sentences stripped."""
    return annotations.filter(valid_interval(F.col("start"), F.col("end"))).withColumn(
        "sentence", strip_text(F.col("sentence"))
    )


def with_duration(df: DataFrame, default: float = DEFAULT_DURATION, cap: float = DURATION_CAP) -> DataFrame:
    """Fill an absent duration and add ``effective_end``."""
    return df.withColumn("duration", duration_or_default(F.col("duration"), default)).withColumn(
        "effective_end", effective_end(F.col("duration"), cap)
    )


def clip_intervals(df: DataFrame) -> DataFrame:
    """Drop spans that start after ``effective_end`` and cut the others there.

    Apply after ``keep_valid``: a span starting exactly at the cut survives with zero length.
    """
    return df.filter(F.col("start") <= F.col("effective_end")).withColumn(
        "end", F.least(F.col("end"), F.col("effective_end"))
    )


def cap_annotations(df: DataFrame, k: int | None = MAX_ANNOTATIONS, pos: str = "ann_pos") -> DataFrame:
    """First ``k`` annotations per video by (start, end), ties in source order; all of them for None.

    The rank filter becomes a group limit ahead of the shuffle, so a task sends at most ``k`` rows
    per video, however many a video has.
    """
    order = W.partitionBy("video_id").orderBy("start", "end", pos)
    numbered = df.withColumn("line", F.row_number().over(order))
    return numbered if k is None else numbered.filter(F.col("line") <= k)


def group_by_video(df: DataFrame, k: int | None = MAX_ANNOTATIONS, pos: str = "ann_pos") -> DataFrame:
    """At most ``k`` annotations per video as one ordered array; all of them for None."""
    kept = cap_annotations(df, k, pos)
    line = F.struct("line", "start", "end", "sentence")
    return kept.groupBy("video_id").agg(F.array_sort(F.collect_list(line)).alias("lines")).select(
        "video_id",
        F.transform(
            "lines",
            lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["sentence"].alias("sentence")),
        ).alias("annotations"),
    )


def video_samples(
    records: DataFrame,
    default_duration: float = DEFAULT_DURATION,
    cap: float = DURATION_CAP,
    k: int | None = MAX_ANNOTATIONS,
    clip: bool = True,
) -> DataFrame:
    """Video samples straight from nested records, without a shuffle.

    A record already holds all annotations of its video, so pairing, checking, cutting, ordering
    and capping are array expressions on the row. ``clip=False, k=None`` gives the test form: all
    valid pairs in source order. Videos left without a pair disappear.
    """
    pairs = F.filter(
        pair_annotations(F.col("timestamps"), F.col("sentences")),
        lambda p: valid_interval(p["start"], p["end"]),
    )
    out = with_duration(records, default_duration, cap).withColumn("pairs", pairs)
    if clip:
        inside = F.filter("pairs", lambda p: p["start"] <= F.col("effective_end"))
        cut = F.transform(
            inside,
            lambda p: F.struct(
                p["start"].alias("start"),
                F.least(p["end"], F.col("effective_end")).alias("end"),
                p["pos"].alias("pos"),
                p["sentence"].alias("sentence"),
            ),
        )
        out = out.withColumn("pairs", F.array_sort(cut))
    if k is not None:
        out = out.withColumn("pairs", F.slice("pairs", 1, k))
    final = F.transform(
        "pairs",
        lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), strip_text(p["sentence"]).alias("sentence")
        ),
    )
    rest = [c for c in out.columns if c not in ("timestamps", "sentences", "pairs")]
    return out.filter(F.size("pairs") > 0).select(*rest, final.alias("annotations"))


def with_video_path(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("video_path", video_path_of(root, F.col("video_id")))


def existing_only(annotations: DataFrame, inventory: DataFrame) -> DataFrame:
    """Annotations whose video lies at its own path: in the folder of its category.

    Inventories list ``category/video`` at exactly two levels, so both together are the path.
    """
    files = inventory.select(F.col("video_id").alias("file_id"), F.col("category").alias("folder"))
    at_path = (F.col("video_id") == F.col("file_id")) & (category_of(F.col("video_id")) == F.col("folder"))
    return annotations.join(files, at_path, "left_semi")


def sample_totals(video_rows: DataFrame, array: str = "annotations") -> DataFrame:
    """Number of sampled videos and of their annotations."""
    return video_rows.agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.coalesce(F.sum(F.size(array)), F.lit(0)).alias("n_annotations"),
    )


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Named splits as one set with a ``split`` column."""
    named = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def sample_n(df: DataFrame, n: int | None, seed: int, key: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the order of ``md5(seed|key)``; None or -1 keeps all rows.

    A sample does not depend on partitioning; ``key`` must identify a row. It is a set: its rows come
    in no promised order, whatever ``n``. A small sample is one top-n. A large one is found without
    gathering it: rows are counted per leading digest digits, whole bins below the cut pass, and the
    bin in which the cut falls is counted by more digits until it is small enough to be ordered.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    ranked = df.withColumn("sample_hash", digest)
    if n is None or n == -1:
        return ranked.drop("sample_hash")
    if n < 0:
        raise ValueError("n is a count, or -1 or None for all rows")
    if n <= SMALL_SAMPLE:
        return ranked.orderBy("sample_hash", *key).limit(n).drop("sample_hash")
    edge, still = "", n
    while True:
        # At most 16^4 bins a round, so the running count is a small single-partition window.
        inside = ranked.filter(F.col("sample_hash").startswith(edge))
        bin_ = F.substring("sample_hash", 1, len(edge) + SAMPLE_BIN_DIGITS).alias("bin")
        counts = inside.groupBy(bin_).agg(F.count(F.lit(1)).alias("n_bin"))
        running = counts.withColumn("upto", F.sum("n_bin").over(W.orderBy("bin")))
        cut = running.filter(F.col("upto") >= still).orderBy("bin").limit(1).collect()
        if not cut:
            return ranked.drop("sample_hash")
        edge, still = cut[0]["bin"], still - (cut[0]["upto"] - cut[0]["n_bin"])
        if cut[0]["n_bin"] <= SMALL_SAMPLE or len(edge) == DIGEST_DIGITS:
            break
    below = ranked.filter(F.substring("sample_hash", 1, len(edge)) < edge)
    last = ranked.filter(F.col("sample_hash").startswith(edge)).orderBy("sample_hash", *key).limit(still)
    return below.unionByName(last).drop("sample_hash")
