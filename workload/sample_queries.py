"""Annotations, samples, windows, joins and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.intervals import tiou
from spanloom.functions.text import category_of, fmt1, strip_text, to_double, video_path_of
from spanloom.operators.dedup import dedup_activities
from spanloom.operators.evaluate import attach_scores
from spanloom.operators.samples import (
    cap_annotations,
    clip_intervals,
    existing_only,
    explode_annotations,
    group_by_video,
    keep_valid,
    sample_n,
    sample_totals,
    union_splits,
    video_samples,
    with_duration,
)
from spanloom.operators.windows import video_windows
from spanloom.plans.loading import clip_samples, dense_samples
from spanloom.shared import new_folder
from spanloom.sources import read_annotations, to_json_lines, to_json_objects, write_samples

from .registry import query
from .views import (
    STRIP,
    annotations,
    complete_records,
    ctes,
    labelled_inventory,
    partial_inventory,
    records,
    table,
    valid_annotations,
)


_READ_SQL = (
    ctes("rec")
    + """
SELECT 'all' AS split, video_id, duration, CAST(len(ts) AS BIGINT) AS n_spans,
       CAST(coalesce(len(sents), -1) AS BIGINT) AS n_sentences, round(list_sum(list_transform(ts, lambda t: t[2])), 6) AS ends_total,
       md5(array_to_string(sents, chr(10))) AS sentences_md5
FROM rec"""
)


def _repeated_records(spark, sf):
    """Every key twice; the later record holds."""
    now = records(spark, sf)
    old = now.withColumn("duration", F.lit(-1.0)).withColumn("sentences", F.array(F.lit("old")))
    return old, now


def _shown_records(read):
    ends = F.aggregate("timestamps", F.lit(0.0), lambda acc, t: acc + t[1])
    return read.select(
        "split",
        "video_id",
        "duration",
        F.size("timestamps").cast("bigint").alias("n_spans"),
        F.coalesce(F.size("sentences"), F.lit(-1)).cast("bigint").alias("n_sentences"),
        F.when(F.size("timestamps") > 0, F.round(ends, 6)).alias("ends_total"),
        F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"),
    )


@query("read_annotations", _READ_SQL)
def q_read_annotations(spark, sf):
    path = new_folder(spark, "annotation-lines")
    old, now = _repeated_records(spark, sf)
    to_json_lines(old.unionByName(now)).write.text(path)
    return _shown_records(read_annotations(spark, path, "all", layout="lines"))


@query("read_annotation_objects", _READ_SQL)
def q_read_annotation_objects(spark, sf):
    """Files of one object each, cut into some hundred blocks."""
    path = new_folder(spark, "annotation-objects")
    # Both records of a key stand in one file, the old one first.
    both = records(spark, sf).withColumn("now", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumns(
        {
            "duration": F.when(F.col("now"), F.col("duration")).otherwise(F.lit(-1.0)),
            "sentences": F.when(F.col("now"), F.col("sentences")).otherwise(F.array(F.lit("old"))),
        }
    )
    to_json_objects(both).write.text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    blocks = spark.newSession()
    blocks.conf.set("spark.sql.files.maxPartitionBytes", max(1024, size // 128))
    blocks.conf.set("spark.sql.files.openCostInBytes", 1024)
    return _shown_records(read_annotations(blocks, path, "all"))


@query(
    "write_samples",
    ctes("rec", "recpair")
    + """
SELECT split, video_id, ann_pos, start, "end", md5(sentence) AS sentence_md5 FROM recpair WHERE "end" > start""",
)
def q_write_samples(spark, sf):
    path = new_folder(spark, "samples")
    write_samples(explode_annotations(complete_records(spark, sf)).filter(F.col("end") > F.col("start")), path)
    return spark.read.parquet(path).select(
        "split", "video_id", "ann_pos", "start", "end", F.md5("sentence").alias("sentence_md5")
    )


@query(
    "category_and_path",
    ctes("ann")
    + r"""
SELECT ann_pos, regexp_replace(video_id, '\d+_x264$', '') AS category,
       '/videos/' || regexp_replace(video_id, '\d+_x264$', '') || '/' || video_id || '.mp4' AS video_path
FROM ann""",
)
def q_category(spark, sf):
    return annotations(spark, sf).select(
        "ann_pos",
        category_of(F.col("video_id")).alias("category"),
        video_path_of("/videos", F.col("video_id")).alias("video_path"),
    )


@query(
    "explode_annotations",
    ctes("rec", "recpair")
    + """
SELECT video_id, ann_pos, start, "end", md5(sentence) AS sentence_md5 FROM recpair""",
)
def q_explode(spark, sf):
    return explode_annotations(complete_records(spark, sf)).select(
        "video_id", "ann_pos", "start", "end", F.md5("sentence").alias("sentence_md5")
    )


@query(
    "valid_annotations",
    ctes("rec", "recpair")
    + rf"""
SELECT video_id, ann_pos, start, "end", md5(regexp_replace(sentence, '{STRIP}', '', 'g')) AS sentence_md5
FROM recpair WHERE "end" > start""",
)
def q_valid(spark, sf):
    return keep_valid(explode_annotations(complete_records(spark, sf))).select(
        "video_id", "ann_pos", "start", "end", F.md5("sentence").alias("sentence_md5")
    )


@query(
    "strip_text",
    rf"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars_left, md5(t) AS text_md5
FROM (SELECT doc_id, regexp_replace(text, '{STRIP}', '', 'g') AS t FROM documents)""",
)
def q_strip(spark, sf):
    stripped = strip_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(stripped).cast("bigint").alias("n_chars_left"), F.md5(stripped).alias("text_md5")
    )


@query(
    "to_double",
    """SELECT event_id, TRY_CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS k,
TRY_CAST(event_type AS DOUBLE) AS no_number FROM events""",
)
def q_to_double(spark, sf):
    number = F.replace(F.replace(F.col("props"), F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
    return table(spark, sf, "events").select(
        "event_id", to_double(number).alias("k"), to_double(F.col("event_type")).alias("no_number")
    )


@query(
    "clip_to_effective_end",
    ctes("rec", "recpair")
    + """
, eff AS (SELECT *, coalesce(duration, CAST(120 AS DOUBLE)) AS dur,
               least(coalesce(duration, CAST(120 AS DOUBLE)), CAST(120 AS DOUBLE)) AS eff FROM recpair)
SELECT video_id, ann_pos, dur AS duration, eff AS effective_end, start, least("end", eff) AS "end"
FROM eff WHERE "end" > start AND start <= eff""",
)
def q_clip_intervals(spark, sf):
    kept = keep_valid(explode_annotations(with_duration(complete_records(spark, sf))))
    return clip_intervals(kept).select("video_id", "ann_pos", "duration", "effective_end", "start", "end")


VIDEO_SAMPLE_SQL = (
    ctes("rec", "recpair")
    + rf"""
, eff AS (SELECT *, coalesce(duration, CAST(120 AS DOUBLE)) AS dur,
               least(coalesce(duration, CAST(120 AS DOUBLE)), CAST(120 AS DOUBLE)) AS eff FROM recpair)
, cut AS (SELECT split, video_id, dur, eff, ann_pos, start, least("end", eff) AS e,
                 regexp_replace(sentence, '{STRIP}', '', 'g') AS s
          FROM eff WHERE "end" > start AND start <= eff)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, e, ann_pos) AS rn FROM cut)
, kept AS (SELECT * FROM ranked WHERE rn <= 12)
"""
)


@query(
    "video_samples",
    VIDEO_SAMPLE_SQL
    + """
SELECT video_id, dur AS duration, eff AS effective_end, CAST(count(*) AS BIGINT) AS n_annotations,
       string_agg(printf('%.1f', start) || '-' || printf('%.1f', e) || ' ' || md5(s), ',' ORDER BY rn) AS annotations
FROM kept GROUP BY ALL""",
)
def q_video_samples(spark, sf):
    shown = F.transform(
        "annotations",
        lambda a: F.concat(fmt1(a["start"]), F.lit("-"), fmt1(a["end"]), F.lit(" "), F.md5(a["sentence"])),
    )
    return video_samples(complete_records(spark, sf)).select(
        "video_id",
        "duration",
        "effective_end",
        F.size("annotations").cast("bigint").alias("n_annotations"),
        F.array_join(shown, ",").alias("annotations"),
    )


@query(
    "dense_test_samples",
    ctes("rec", "recpair")
    + rf"""
SELECT video_id, coalesce(duration, CAST(120 AS DOUBLE)) AS duration, CAST(count(*) AS BIGINT) AS n_gt,
  string_agg(printf('%.1f', start) || '-' || printf('%.1f', "end") || ' ' || md5(regexp_replace(sentence, '{STRIP}', '', 'g')), ',' ORDER BY ann_pos) AS gt
FROM recpair WHERE "end" > start GROUP BY ALL""",
)
def q_dense_test(spark, sf):
    shown = F.transform(
        "annotations",
        lambda a: F.concat(fmt1(a["start"]), F.lit("-"), fmt1(a["end"]), F.lit(" "), F.md5(a["sentence"])),
    )
    return video_samples(complete_records(spark, sf), k=None, clip=False).select(
        "video_id",
        "duration",
        F.size("annotations").cast("bigint").alias("n_gt"),
        F.array_join(shown, ",").alias("gt"),
    )


@query(
    "sample_totals",
    VIDEO_SAMPLE_SQL
    + """
SELECT CAST(count(DISTINCT video_id) AS BIGINT) AS n_videos, CAST(count(*) AS BIGINT) AS n_annotations FROM kept""",
)
def q_sample_totals(spark, sf):
    return sample_totals(video_samples(complete_records(spark, sf)))


@query(
    "sample_totals_on_write",
    VIDEO_SAMPLE_SQL
    + """
SELECT CAST(count(DISTINCT video_id) AS BIGINT) AS n_videos, CAST(count(*) AS BIGINT) AS n_annotations FROM kept""",
)
def q_sample_totals_on_write(spark, sf):
    """Totals that are counted while the samples are written."""
    return write_samples(video_samples(complete_records(spark, sf)), new_folder(spark, "samples"), array="annotations")


@query(
    "tiou_with_next_clip",
    ctes("ann", "valid")
    + """
, pair AS (SELECT a.ann_pos, a.start AS s, a."end" AS e, b.start AS s2, b."end" AS e2
           FROM valid a JOIN valid b ON a.ann_pos = b.ann_pos + 1)
, shared AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(e, e2) - greatest(s, s2)) AS i FROM pair)
SELECT ann_pos, CASE WHEN (e - s) + (e2 - s2) - i > 0 THEN i / ((e - s) + (e2 - s2) - i) ELSE CAST(0 AS DOUBLE) END AS tiou
FROM shared""",
)
def q_tiou(spark, sf):
    a = valid_annotations(spark, sf).select("ann_pos", "start", "end")
    b = a.select((F.col("ann_pos") + 1).alias("ann_pos"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, "ann_pos").select(
        "ann_pos", tiou(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")).alias("tiou")
    )


@query(
    "fmt1",
    ctes("ann")
    + """
SELECT ann_pos, printf('%.1f', start) AS start1, printf('%.1f', CAST(ann_pos AS DOUBLE) / CAST(20 AS DOUBLE)) AS tie1 FROM ann""",
)
def q_fmt1(spark, sf):
    return annotations(spark, sf).select(
        "ann_pos",
        fmt1(F.col("start")).alias("start1"),
        fmt1(F.col("ann_pos").cast("double") / F.lit(20.0)).alias("tie1"),
    )


@query(
    "existing_only",
    ctes("ann", "part_inv")
    + """
SELECT ann_pos, video_id, start FROM ann WHERE video_id IN (SELECT video_id FROM part_inv)""",
)
def q_existing(spark, sf):
    return existing_only(annotations(spark, sf), partial_inventory(spark, sf)).select("ann_pos", "video_id", "start")


@query(
    "clip_samples",
    ctes("rec", "recpair", "lab_inv")
    + rf"""
SELECT split, video_id, ann_pos, start, "end", md5(regexp_replace(sentence, '{STRIP}', '', 'g')) AS sentence_md5
FROM recpair WHERE "end" > start AND video_id IN (SELECT video_id FROM lab_inv)
ORDER BY md5('42|' || split || '|' || video_id || '|' || CAST(ann_pos AS VARCHAR)), split, video_id, ann_pos LIMIT 200""",
)
def q_clip_samples(spark, sf):
    samples = clip_samples(records(spark, sf), labelled_inventory(spark, sf), 200, 42)
    return samples.select("split", "video_id", "ann_pos", "start", "end", F.md5("sentence").alias("sentence_md5"))


@query(
    "dense_samples",
    VIDEO_SAMPLE_SQL
    + """
SELECT video_id, dur AS duration, CAST(count(*) AS BIGINT) AS n_annotations, max(e) AS last_end
FROM kept WHERE video_id IN (SELECT 'Doc' || CAST(doc_id AS VARCHAR) || '_x264' FROM labels)
GROUP BY video_id, dur, split ORDER BY md5('42|' || split || '|' || video_id), split, video_id LIMIT 50""",
)
def q_dense_samples(spark, sf):
    samples = dense_samples(records(spark, sf), labelled_inventory(spark, sf), 50, 42)
    return samples.select(
        "video_id",
        "duration",
        F.size("annotations").cast("bigint").alias("n_annotations"),
        F.array_max(F.transform("annotations", lambda a: a["end"])).alias("last_end"),
    )


@query(
    "group_flat_annotations",
    ctes("ann", "valid")
    + """
SELECT video_id, CAST(count(*) AS BIGINT) AS n_annotations, string_agg(sentence, '|' ORDER BY start, "end", ann_pos) AS sentences
FROM valid GROUP BY video_id""",
)
def q_group_flat(spark, sf):
    return group_by_video(valid_annotations(spark, sf), k=None).select(
        "video_id",
        F.size("annotations").cast("bigint").alias("n_annotations"),
        F.array_join(F.transform("annotations", lambda a: a["sentence"]), "|").alias("sentences"),
    )


@query(
    "attach_scores",
    ctes("ann", "valid", "pred", "scored")
    + """
SELECT v.ann_pos AS sample_id, v.video_id, v.start, s.tiou, s.pred_start
FROM ann v LEFT JOIN scored s ON v.ann_pos = s.sample_id""",
)
def q_attach(spark, sf):
    from spanloom.operators.evaluate import score_spans

    from .views import predictions

    samples = annotations(spark, sf).select(F.col("ann_pos").alias("sample_id"), "video_id", "start")
    scores = score_spans(predictions(spark, sf)).select("sample_id", "tiou", "pred_start")
    return attach_scores(samples, scores)


@query(
    "cap_annotations",
    ctes("ann", "valid")
    + """
SELECT video_id, CAST(rn AS BIGINT) AS line, ann_pos, start, "end"
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", ann_pos) AS rn FROM valid) WHERE rn <= 12""",
)
def q_cap(spark, sf):
    return cap_annotations(valid_annotations(spark, sf)).select(
        "video_id", F.col("line").cast("bigint").alias("line"), "ann_pos", "start", "end"
    )


@query(
    "group_by_video",
    ctes("ann", "valid")
    + """
SELECT video_id, CAST(count(*) AS BIGINT) AS n_annotations,
       string_agg(sentence, '|' ORDER BY rn) AS sentences, max("end") AS last_end
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", ann_pos) AS rn FROM valid)
WHERE rn <= 12 GROUP BY video_id""",
)
def q_group(spark, sf):
    return group_by_video(valid_annotations(spark, sf)).select(
        "video_id",
        F.size("annotations").cast("bigint").alias("n_annotations"),
        F.array_join(F.transform("annotations", lambda a: a["sentence"]), "|").alias("sentences"),
        F.array_max(F.transform("annotations", lambda a: a["end"])).alias("last_end"),
    )


def _videos(spark, sf):
    """Videos with a length: customers' balances as seconds, some of them unknown (not positive)."""
    from .views import video_name

    return table(spark, sf, "customer").select(
        video_name(F.col("c_custkey")).alias("video_id"), F.col("c_acctbal").alias("duration")
    )


@query(
    "video_windows",
    """
WITH v AS (SELECT ['Lobby','Yard','Gate','Dock','Hall'][CAST(c_custkey % 5 AS INTEGER) + 1] || CAST(c_custkey AS VARCHAR) || '_x264' AS video_id,
                  c_acctbal AS d FROM customer),
w AS (SELECT *, unnest(range(0, CASE WHEN d <= 120 THEN 1 ELSE CAST(ceil((d - 120) / CAST(60 AS DOUBLE)) AS BIGINT) + 1 END)) AS i FROM v)
SELECT video_id, CAST(i AS BIGINT) AS window_idx, CASE WHEN d > 0 THEN CAST(i * 60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS window_start,
       CASE WHEN d > 0 THEN least(CAST(i * 60 + 120 AS DOUBLE), d) ELSE CAST(120 AS DOUBLE) END AS window_end,
       i = CASE WHEN d <= 120 THEN 0 ELSE CAST(ceil((d - 120) / CAST(60 AS DOUBLE)) AS BIGINT) END AS is_last,
       CASE WHEN d > 0 THEN 'sliding_window' ELSE 'single_pass' END AS mode
FROM w""",
)
def q_windows(spark, sf):
    return video_windows(_videos(spark, sf)).select(
        "video_id", "window_idx", "window_start", "window_end", "is_last", "mode"
    )


@query(
    "sample_n",
    ctes("ann", "valid")
    + """
SELECT video_id, ann_pos, start, "end" FROM valid
ORDER BY md5('42|' || video_id || '|' || CAST(ann_pos AS VARCHAR)), video_id, ann_pos LIMIT 200""",
)
def q_sample(spark, sf):
    valid = valid_annotations(spark, sf).select("video_id", "ann_pos", "start", "end")
    return sample_n(valid, 200, 42, ["video_id", "ann_pos"])


@query(
    "union_splits",
    ctes("ann", "part_inv")
    + """
SELECT 'Test' AS split, video_id, ann_pos FROM ann WHERE video_id IN (SELECT video_id FROM part_inv)
UNION ALL
SELECT 'Train' AS split, video_id, ann_pos FROM ann WHERE video_id NOT IN (SELECT video_id FROM part_inv)""",
)
def q_union_splits(spark, sf):
    everything = annotations(spark, sf).select("video_id", "ann_pos")
    test = existing_only(everything, partial_inventory(spark, sf))
    train = everything.join(partial_inventory(spark, sf).select("video_id"), "video_id", "left_anti")
    return union_splits({"Test": test, "Train": train}).select("split", "video_id", "ann_pos")


_IOU = """(greatest(CAST(0 AS DOUBLE), least(y[1].e, {0}.e) - greatest(y[1].s, {0}.s))
   / ((y[1].e - y[1].s) + ({0}.e - {0}.s) - greatest(CAST(0 AS DOUBLE), least(y[1].e, {0}.e) - greatest(y[1].s, {0}.s))))"""


def fold_sql(source: str, pos: str, text: str) -> str:
    """De-duplication of ``source`` as a list fold: ``kept`` has video_id, kept_no, start, end, description."""
    at = "coalesce(list_position(list_transform(acc, lambda {0}: " + _IOU + " > 0.5), true), 0)"
    return f"""
, folded AS (
  SELECT video_id, list_reduce(
    list({{'s': start, 'e': "end", 'd': {text}}} ORDER BY start, {pos}).list_transform(lambda x: [x]),
    lambda acc, y: CASE WHEN {at.format('k')} = 0 THEN list_concat(acc, y)
      ELSE list_transform(acc, lambda k, i: CASE WHEN i = {at.format('q')} AND length(y[1].d) > length(k.d) THEN y[1] ELSE k END) END) AS kept
  FROM {source} GROUP BY video_id)
, kept AS (SELECT video_id, CAST(i - 1 AS BIGINT) AS kept_no, kept[i].s AS start, kept[i].e AS "end", kept[i].d AS description
  FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM folded))
"""


DEDUP_SQL = ctes("ann", "valid") + fold_sql("valid", "ann_pos", "sentence") + "SELECT * FROM kept"


@query("dedup_activities", DEDUP_SQL)
def q_dedup(spark, sf):
    return dedup_activities(
        valid_annotations(spark, sf).select(
            "video_id", F.col("ann_pos").alias("pos"), "start", "end", F.col("sentence").alias("description")
        )
    )


# Spans two hundred seconds longer never pause: a video is one stretch from its first to its last.
_LONG = """, longer AS (SELECT video_id, ann_pos, start, "end" + 200 AS "end", sentence FROM valid)
"""


@query("dedup_without_pauses", ctes("ann", "valid") + _LONG + fold_sql("longer", "ann_pos", "sentence") + "SELECT * FROM kept")
def q_dedup_without_pauses(spark, sf):
    """Chunks of a few activities: open ones are handed from chunk to chunk, the last ones in order."""
    rows = valid_annotations(spark, sf).select(
        "video_id", F.col("ann_pos").alias("pos"), "start", (F.col("end") + 200.0).alias("end"), F.col("sentence").alias("description")
    )
    n = rows.count()
    return dedup_activities(rows, limit=5, chunk_rows=max(20, n // 64))


@query("dedup_with_pauses", DEDUP_SQL)
def q_dedup_with_pauses(spark, sf):
    """Every video counts as hot and is cut where nothing overlaps."""
    rows = valid_annotations(spark, sf).select(
        "video_id", F.col("ann_pos").alias("pos"), "start", "end", F.col("sentence").alias("description")
    )
    n = rows.count()
    return dedup_activities(rows, limit=1, chunk_rows=max(20, n // 16))
