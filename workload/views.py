"""Logical video tables derived from the driver's tables, in Spark and as SQL for checking.

Every view reads its whole source table. ``SQL`` holds the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.chat import clip_response
from spanloom.sources.tables import read_table

PLACES = ("Lobby", "Yard", "Gate", "Dock", "Hall")
EPOCH_MICROS = 1704067200000000  # 2024-01-01


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, f"{sf}/{name}.parquet")


def video_name(number: Column) -> Column:
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (number % 5 + 1).cast("int"))
    return F.concat(place, number.cast("string"), F.lit("_x264"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as annotations: the user is the video, two hours of the log are one video second."""
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_MICROS)
    start = micros.cast("double") / F.lit(1e6) / F.lit(7200.0)
    return e.select(
        video_name(F.col("user_id")).alias("video_id"),
        F.col("event_id").alias("ann_pos"),
        "event_type",
        start.alias("start"),
        (start + F.col("value") - F.lit(5.0)).alias("end"),
        F.concat("event_type", F.lit(" "), "props").alias("sentence"),
    )


def valid_annotations(spark: SparkSession, sf: str) -> DataFrame:
    from spanloom.operators.samples import keep_valid

    return keep_valid(annotations(spark, sf))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return annotations(spark, sf).select(
        "video_id",
        F.col("start").alias("pts"),
        (F.col("event_type") == "view").alias("is_keyframe"),
        F.col("ann_pos").cast("string").alias("frame_ref"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Clip samples with a generated text: with span, without span, or span only."""
    said = clip_response(F.col("sentence"), F.col("start") * F.lit(0.75) + F.lit(1.0), F.col("end"))
    bare = clip_response(F.lit(""), F.col("start") * F.lit(0.75) + F.lit(1.0), F.col("end"))
    pred = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("some "), F.col("sentence"), F.lit(" seen")))
        .when(F.col("event_type") == "click", F.substring(bare, 2, 1 << 30))
        .otherwise(said)
    )
    return valid_annotations(spark, sf).select(
        F.col("ann_pos").alias("sample_id"),
        "video_id",
        "event_type",
        "start",
        "end",
        F.col("sentence").alias("gt"),
        pred.alias("pred"),
    )


def _files(df: DataFrame, name: Column) -> DataFrame:
    from spanloom.functions.text import category_of, video_path_of

    return df.select(
        video_path_of("/videos", name).alias("path"), category_of(name).alias("category"), name.alias("video_id")
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for the videos that are on disk."""
    return _files(table(spark, sf, "customer"), video_name(F.col("c_custkey")))


def partial_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A disk that lacks videos: only the customers of one segment are there."""
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return _files(c, video_name(F.col("c_custkey")))


def labelled_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Videos of the document records: those of labelled documents are on disk."""
    return _files(
        table(spark, sf, "labels"), F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.lit("_x264"))
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested annotation records: lines are sentences, some records are faulty."""
    d = table(spark, sf, "documents")
    lines = F.split("text", "\n")
    n_spans = F.greatest(F.size(lines) + (F.col("doc_id") % 3).cast("int") - 1, F.lit(0))
    start = lambda i: i.cast("double") * F.lit(2.5) - F.lit(2.5)
    length = lambda i: ((i * 7 + F.col("doc_id")) % 5).cast("double") - F.lit(1.0)
    spans = F.transform(
        F.array_repeat(F.lit(0), n_spans), lambda _, i: F.array(start(i), start(i) + length(i))
    )
    lacks = F.col("doc_id") % 11 == 3
    return d.select(
        F.col("lang").alias("split"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.lit("_x264")).alias("video_id"),
        F.when(F.col("doc_id") % 7 != 2, F.col("n_chars").cast("double") / F.lit(10.0)).alias("duration"),
        spans.alias("timestamps"),
        F.when(~lacks, lines).alias("sentences"),
    )


def complete_records(spark: SparkSession, sf: str) -> DataFrame:
    """All records; loaders find no pairs where a list is missing."""
    return records(spark, sf)


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    body = F.struct("duration", "timestamps", "sentences")
    return records(spark, sf).select("split", "pos", "video_id", F.to_json(body).alias("raw"))


def dirty_records(spark: SparkSession, sf: str) -> DataFrame:
    """A record per document with one of eight forms of spans and three of sentences, most of them faulty."""
    spans = ("null", '"x"', "[[1]]", "[[1,2,3]]", '[["abc",2]]', "[3,[0,1]]", "[[0,1],[2,1]]", "[null]")
    form = F.element_at(F.array(*map(F.lit, spans)), (F.col("doc_id") % 8 + 1).cast("int"))
    texts = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("text"))).otherwise(
        F.when(F.col("doc_id") % 3 == 1, F.lit("null")).otherwise(F.lit('"x"'))
    )
    raw = F.concat(F.lit('{"duration":1.5,"timestamps":'), form, F.lit(',"sentences":'), texts, F.lit("}"))
    return table(spark, sf, "documents").select(
        F.col("lang").alias("split"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.lit("_x264")).alias("video_id"),
        raw.alias("raw"),
    )


def chat_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn with the turn before it."""
    c = table(spark, sf, "conversations")
    answer = c.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("response")
    )
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return answer.join(before, ["conv_id", "turn"])


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents against a rewording that swaps and drops words all over the text."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.col("text").alias("ref"),
        F.regexp_replace("text", "([a-z]+) ([a-z]+) ([a-z]+)", "$2 $1").alias("pred"),
    )


_VIDEO = (
    "['Lobby','Yard','Gate','Dock','Hall'][CAST({0} % 5 AS INTEGER) + 1] || CAST({0} AS VARCHAR) || '_x264'"
)
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"

SQL = {
    "ann": f"""ann AS (
  SELECT {_VIDEO.format('user_id')} AS video_id, event_id AS ann_pos, event_type,
         CAST(epoch_us(ts) - {EPOCH_MICROS} AS DOUBLE) / CAST(1e6 AS DOUBLE) / CAST(7200 AS DOUBLE) AS start,
         CAST(epoch_us(ts) - {EPOCH_MICROS} AS DOUBLE) / CAST(1e6 AS DOUBLE) / CAST(7200 AS DOUBLE)
           + value - CAST(5 AS DOUBLE) AS "end",
         event_type || ' ' || props AS sentence
  FROM events)""",
    "valid": """valid AS (SELECT * FROM ann WHERE "end" > start)""",
    "fr": """fr AS (
  SELECT video_id, start AS pts, event_type = 'view' AS is_keyframe, CAST(ann_pos AS VARCHAR) AS frame_ref FROM ann)""",
    "pred": """pred AS (
  SELECT ann_pos AS sample_id, video_id, event_type, start, "end", sentence AS gt,
         CASE event_type WHEN 'error' THEN 'some ' || sentence || ' seen'
           WHEN 'click' THEN 'Timestamps: [' || printf('%.1f', start * CAST(0.75 AS DOUBLE) + 1) || ', ' || printf('%.1f', "end") || ']'
           ELSE sentence || ' Timestamps: [' || printf('%.1f', start * CAST(0.75 AS DOUBLE) + 1) || ', ' || printf('%.1f', "end") || ']'
         END AS pred
  FROM valid)""",
    "scored": r"""spans AS (
  SELECT *, regexp_extract(pred, '\[\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\]', 1) AS s1,
            regexp_extract(pred, '\[\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\]', 2) AS s2,
            regexp_replace(pred, '[Tt]imestamps?:?\s*\[.*?\]', '', 'g') AS rest
  FROM pred),
found AS (
  SELECT * EXCLUDE (s1, s2, rest),
         TRY_CAST(nullif(s1, '') AS DOUBLE) AS pred_start, TRY_CAST(nullif(s2, '') AS DOUBLE) AS pred_end,
         CASE WHEN trim(rest) = '' THEN pred ELSE trim(rest) END AS pred_text
  FROM spans),
overlap AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), least(pred_end, "end") - greatest(pred_start, start)) AS shared FROM found),
scored AS (
  SELECT * EXCLUDE (shared), CASE WHEN pred_start IS NULL THEN CAST(0 AS DOUBLE)
      WHEN (pred_end - pred_start) + ("end" - start) - shared > 0
      THEN shared / ((pred_end - pred_start) + ("end" - start) - shared) ELSE CAST(0 AS DOUBLE) END AS tiou
  FROM overlap)""",
    "inv": f"""inv AS (
  SELECT {_VIDEO.format('c_custkey')} AS video_id, ['Lobby','Yard','Gate','Dock','Hall'][CAST(c_custkey % 5 AS INTEGER) + 1] AS category
  FROM customer)""",
    "part_inv": f"""part_inv AS (
  SELECT {_VIDEO.format('c_custkey')} AS video_id FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "lab_inv": """lab_inv AS (SELECT 'Doc' || CAST(doc_id AS VARCHAR) || '_x264' AS video_id FROM labels)""",
    "rec": r"""rec AS (
  SELECT lang AS split, doc_id AS pos, 'Doc' || CAST(doc_id AS VARCHAR) || '_x264' AS video_id,
         CASE WHEN doc_id % 7 <> 2 THEN CAST(n_chars AS DOUBLE) / CAST(10 AS DOUBLE) END AS duration,
         list_transform(range(greatest(len(string_split(text, chr(10))) + doc_id % 3 - 1, 0)),
           lambda i: [CAST(i AS DOUBLE) * CAST(2.5 AS DOUBLE) - CAST(2.5 AS DOUBLE),
                      CAST(i AS DOUBLE) * CAST(2.5 AS DOUBLE) - CAST(2.5 AS DOUBLE) + CAST((i * 7 + doc_id) % 5 AS DOUBLE) - CAST(1 AS DOUBLE)]) AS ts,
         CASE WHEN doc_id % 11 <> 3 THEN string_split(text, chr(10)) END AS sents
  FROM documents)""",
    "recpair": rf"""recpair AS (
  SELECT split, pos, video_id, duration, i - 1 AS ann_pos, ts[i][1] AS start, ts[i][2] AS "end", sents[i] AS sentence
  FROM (SELECT *, unnest(range(1, least(len(ts), len(sents)) + 1)) AS i FROM rec WHERE sents IS NOT NULL))""",
    "chat": """chat AS (
  SELECT a.conv_id, a.turn, b.text AS prompt, a.text AS response
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
  WHERE a.role = 'assistant')""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
