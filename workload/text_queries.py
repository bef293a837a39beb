"""Rendering, parsing and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.chat import (
    clip_prompt,
    clip_response,
    dense_prompt,
    dense_response,
    messages,
    render_chat,
    video_metadata,
    window_prompt,
)
from spanloom.functions.chat import CLIP_PROMPT, DENSE_PROMPT, WINDOW_PROMPT_HEAD, WINDOW_PROMPT_TAIL
from spanloom.functions.pairs import bleu_counts, lcs_counts
from spanloom.functions.parse import extract_description, parse_activities, parse_span, shift_activities
from spanloom.operators.samples import group_by_video
from spanloom.operators.textmetrics import (
    bleu4,
    embed_and_match,
    greedy_match_score,
    rouge_l,
    stemmed_tokens,
    tokenize_13a,
)

from .registry import query
from .views import (
    SPACE,
    annotations,
    chat_pairs,
    ctes,
    predictions,
    table,
    text_pairs,
    valid_annotations,
)


@query(
    "clip_responses",
    ctes("ann", "valid")
    + """
SELECT ann_pos, sentence || ' Timestamps: [' || printf('%.1f', start) || ', ' || printf('%.1f', "end") || ']' AS response FROM valid""",
)
def q_clip_response(spark, sf):
    return valid_annotations(spark, sf).select(
        "ann_pos", clip_response(F.col("sentence"), F.col("start"), F.col("end")).alias("response")
    )


_DENSE_SQL = (
    ctes("ann", "valid")
    + """
, kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", ann_pos) AS rn FROM valid)
, dense AS (SELECT video_id, string_agg(rn || '. [' || printf('%.1f', start) || ', ' || printf('%.1f', "end") || '] ' || sentence, chr(10) ORDER BY rn) AS response
            FROM kept WHERE rn <= 12 GROUP BY video_id)
"""
)
_ALL_SQL = _DENSE_SQL.replace(" WHERE rn <= 12", "")


def _dense_texts(spark, sf, k=12):
    return group_by_video(valid_annotations(spark, sf), k).select(
        "video_id", dense_response(F.col("annotations")).alias("response")
    )


@query("dense_responses", _DENSE_SQL + "SELECT * FROM dense")
def q_dense_response(spark, sf):
    return _dense_texts(spark, sf)


@query(
    "parse_activities",
    _ALL_SQL
    + r"""
, m AS (SELECT video_id, regexp_extract_all(response, '\d+\.\s*\[(\d+\.?\d*),\s*(\d+\.?\d*)\]\s*(.+)', 1) AS s,
          regexp_extract_all(response, '\d+\.\s*\[(\d+\.?\d*),\s*(\d+\.?\d*)\]\s*(.+)', 2) AS e,
          regexp_extract_all(response, '\d+\.\s*\[(\d+\.?\d*),\s*(\d+\.?\d*)\]\s*(.+)', 3) AS d FROM dense)
, r AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM m)
SELECT video_id, CAST(i - 1 AS BIGINT) AS line, CAST(s[i] AS DOUBLE) + 30 AS start, CAST(e[i] AS DOUBLE) + 30 AS "end", trim(d[i]) AS description FROM r""",
)
def q_parse_activities(spark, sf):
    acts = shift_activities(parse_activities(F.col("response")), F.lit(30.0))
    return (
        _dense_texts(spark, sf, k=None)
        .select("video_id", F.posexplode(acts).alias("line", "a"))
        .select("video_id", F.col("line").cast("bigint").alias("line"), "a.*")
    )


@query(
    "parse_activities_in_documents",
    r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '([A-Z])', '3. [\1 1.5, 2.]  \1', 'g') AS a FROM documents),
u AS (SELECT doc_id, regexp_replace(a, '\[[A-M] ', '[', 'g') AS t FROM t),
m AS (SELECT doc_id, regexp_extract_all(t, '\d+\.\s*\[(\d+\.?\d*),\s*(\d+\.?\d*)\]\s*(.+)', 1) AS s,
             regexp_extract_all(t, '\d+\.\s*\[(\d+\.?\d*),\s*(\d+\.?\d*)\]\s*(.+)', 3) AS d FROM u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CAST(list_sum(list_transform(d, lambda x: length(x))) AS BIGINT) AS chars FROM m WHERE len(s) > 0""",
)
def q_parse_documents(spark, sf):
    text = F.regexp_replace("text", "([A-Z])", r"3. [$1 1.5, 2.]  $1")
    acts = parse_activities(F.regexp_replace(text, r"\[[A-M] ", "["))
    chars = F.aggregate(
        F.transform("acts", lambda a: F.length(a["description"]).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda x, y: x + y,
    )
    found = table(spark, sf, "documents").select("doc_id", acts.alias("acts")).filter(F.size("acts") > 0)
    return found.select("doc_id", F.size("acts").cast("bigint").alias("n"), chars.alias("chars"))


@query(
    "parse_spans",
    ctes("ann", "valid", "pred", "scored") + "\nSELECT sample_id, pred_start, pred_end, pred_text FROM found",
)
def q_parse_spans(spark, sf):
    span = parse_span(F.col("pred"))
    return predictions(spark, sf).select(
        "sample_id",
        span["start"].alias("pred_start"),
        span["end"].alias("pred_end"),
        extract_description(F.col("pred")).alias("pred_text"),
    )


_PROMPT_SQL = {k: v.replace("'", "''") for k, v in {"clip": CLIP_PROMPT, "dense": DENSE_PROMPT}.items()}


@query(
    "prompts",
    ctes("ann")
    + f"""
SELECT ann_pos, '{_PROMPT_SQL['clip']}' AS clip, '{_PROMPT_SQL['dense']}' AS dense,
       '{WINDOW_PROMPT_HEAD}' || printf('%.0f', start) || '{WINDOW_PROMPT_TAIL}' AS at_window FROM ann""",
)
def q_prompts(spark, sf):
    return annotations(spark, sf).select(
        "ann_pos",
        clip_prompt().alias("clip"),
        dense_prompt().alias("dense"),
        window_prompt(F.col("start")).alias("at_window"),
    )


@query(
    "video_metadata",
    ctes("ann", "valid")
    + """
SELECT ann_pos, CAST(greatest(trunc("end"), 8) AS BIGINT) AS total_num_frames, CAST(1 AS DOUBLE) AS fps, "end" AS duration,
  array_to_string(list_transform(range(8), lambda i: CAST(CAST(trunc(start + CAST(i AS DOUBLE) * ("end" - start) / CAST(7 AS DOUBLE)) AS BIGINT) AS VARCHAR)), ',') AS frames_indices
FROM valid""",
)
def q_metadata(spark, sf):
    m = valid_annotations(spark, sf).select(
        "ann_pos", video_metadata(F.col("start"), F.col("end"), 8).alias("m")
    )
    return m.select(
        "ann_pos",
        F.col("m.total_num_frames").cast("bigint").alias("total_num_frames"),
        "m.fps",
        "m.duration",
        F.array_join("m.frames_indices", ",").alias("frames_indices"),
    )


@query(
    "render_chat",
    ctes("chat")
    + """
SELECT conv_id, turn, 'User: <video>' || prompt || chr(10) || 'Assistant: ' || response || chr(10) AS training_text,
       'User: <video>' || prompt || chr(10) || 'Assistant:' AS generation_text
FROM chat""",
)
def q_render_chat(spark, sf):
    asked = messages(F.col("prompt"))
    return chat_pairs(spark, sf).select(
        "conv_id",
        "turn",
        render_chat(messages(F.col("prompt"), F.col("response"))).alias("training_text"),
        render_chat(asked, add_generation_prompt=True).alias("generation_text"),
    )


def _tokens_13a_sql(column: str) -> str:
    out = rf"regexp_replace({column}, '{SPACE}+\z', '')"
    for old, new in (("<skipped>", "''"), ("-' || chr(10) || '", "''"), ("' || chr(10) || '", "' '")):
        out = f"replace({out}, '{old}', {new})"
    for old, new in (("&quot;", "\""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{old}', '{new}')"
    out = f"' ' || {out} || ' '"
    for pattern, new in (
        (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split(regexp_replace({out}, '{SPACE}+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(
    "tokens_13a",
    f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {_tokens_13a_sql('text')} AS t FROM documents)""",
)
def q_tokens_13a(spark, sf):
    return tokenize_13a(table(spark, sf, "documents"), "text").select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


def _bleu_sql(source: str, key: str) -> str:
    """BLEU from exploded n-gram counts of both sides."""
    return f"""
, tok AS (SELECT {key} AS id, {_tokens_13a_sql('pred')} AS p, {_tokens_13a_sql('ref')} AS r FROM {source})
, orders_ AS (SELECT unnest([1, 2, 3, 4]) AS n)
, pw AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM tok)
, pl AS (SELECT id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM pw WINDOW o AS (PARTITION BY id ORDER BY i))
, pg AS (SELECT id, n, gram, count(*) AS c FROM (
    SELECT id, 1 AS n, w AS gram FROM pl UNION ALL SELECT id, 2, w || ' ' || w2 FROM pl
    UNION ALL SELECT id, 3, w || ' ' || w2 || ' ' || w3 FROM pl UNION ALL SELECT id, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM pl)
  WHERE gram IS NOT NULL GROUP BY ALL)
, rw AS (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM tok)
, rl AS (SELECT id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM rw WINDOW o AS (PARTITION BY id ORDER BY i))
, rg AS (SELECT id, n, gram, count(*) AS c FROM (
    SELECT id, 1 AS n, w AS gram FROM rl UNION ALL SELECT id, 2, w || ' ' || w2 FROM rl
    UNION ALL SELECT id, 3, w || ' ' || w2 || ' ' || w3 FROM rl UNION ALL SELECT id, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM rl)
  WHERE gram IS NOT NULL GROUP BY ALL)
, hit AS (SELECT pg.id, pg.n, sum(least(pg.c, rg.c)) AS m FROM pg JOIN rg ON pg.id = rg.id AND pg.n = rg.n AND pg.gram = rg.gram GROUP BY ALL)
, per AS (SELECT t.id, o.n, len(t.p) AS lp, len(t.r) AS lr, coalesce(h.m, 0) AS m, greatest(len(t.p) - o.n + 1, 0) AS total
          FROM tok t CROSS JOIN orders_ o LEFT JOIN hit h ON h.id = t.id AND h.n = o.n)
, k AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS misses FROM per)
, bleu AS (SELECT id, CASE WHEN min(total) = 0 OR max(m) = 0 THEN CAST(0 AS DOUBLE)
      ELSE (CASE WHEN any_value(lp) < any_value(lr) THEN exp(1 - any_value(lr) / CAST(any_value(lp) AS DOUBLE)) ELSE 1 END)
           * exp(sum(ln(CASE WHEN m = 0 THEN 1 / (pow(2, misses) * greatest(total, 1)) ELSE m / CAST(greatest(total, 1) AS DOUBLE) END)) / 4) END AS bleu4,
      CAST(max(CASE WHEN n = 1 THEN m END) AS BIGINT) AS hits_1, CAST(max(CASE WHEN n = 4 THEN m END) AS BIGINT) AS hits_4
   FROM k GROUP BY id)
"""


@query(
    "bleu4_documents",
    r"""WITH pairs AS (SELECT doc_id, text AS ref, regexp_replace(text, '([a-z]+) ([a-z]+) ([a-z]+)', '\2 \1', 'g') AS pred FROM documents)"""
    + _bleu_sql("pairs", "doc_id")
    + "SELECT id AS doc_id, round(bleu4, 6) AS bleu4, hits_1, hits_4 FROM bleu",
)
def q_bleu(spark, sf):
    counted = text_pairs(spark, sf).withColumn("c", bleu_counts(F.col("pred"), F.col("ref")))
    from spanloom.functions.pairs import bleu_score

    return counted.select(
        "doc_id",
        F.round(bleu_score(F.col("c")), 6).alias("bleu4"),
        F.col("c.matches")[0].alias("hits_1"),
        F.col("c.matches")[3].alias("hits_4"),
    )


@query(
    "bleu4_conversations",
    ctes("chat")
    + ", pairs AS (SELECT conv_id * 1000 + turn AS id0, response AS pred, prompt AS ref FROM chat)"
    + _bleu_sql("pairs", "id0")
    + "SELECT id AS pair_id, round(bleu4, 6) AS bleu4 FROM bleu",
)
def q_bleu_chat(spark, sf):
    pairs = chat_pairs(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "response", "prompt"
    )
    return bleu4(pairs, "response", "prompt").select("pair_id", F.round("bleu4", 6).alias("bleu4"))


# The captions' words all have different stems, so that a comparison without stemming must agree.
_LCS_SQL = r"""
, words AS (SELECT sample_id,
    string_split(trim(regexp_replace(lower(pred_text), '[^a-z0-9]+', ' ', 'g')), ' ') AS p,
    string_split(trim(regexp_replace(lower(gt), '[^a-z0-9]+', ' ', 'g')), ' ') AS r FROM scored)
, lcs AS (SELECT sample_id, len(p) AS n_pred, len(r) AS n_ref, list_reduce(
    list_concat([list_transform(range(len(r) + 1), lambda i: CAST(0 AS BIGINT))], list_transform(range(1, len(p) + 1), lambda i: [CAST(i AS BIGINT)])),
    lambda line, w: list_transform(range(1, len(r) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda q:
       CASE WHEN q > 1 AND r[q - 1] = p[w[1]] THEN line[q - 1] + 1 ELSE line[q] END))))[len(r) + 1] AS lcs FROM words)
, rouge AS (SELECT sample_id, lcs, n_pred, n_ref, CASE WHEN lcs = 0 THEN CAST(0 AS DOUBLE)
     ELSE 2 * (lcs / CAST(n_pred AS DOUBLE)) * (lcs / CAST(n_ref AS DOUBLE)) / (lcs / CAST(n_pred AS DOUBLE) + lcs / CAST(n_ref AS DOUBLE)) END AS rouge_l FROM lcs)
"""


@query(
    "rouge_l_captions",
    ctes("ann", "valid", "pred", "scored")
    + _LCS_SQL
    + "SELECT sample_id, CAST(lcs AS BIGINT) AS lcs, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_ref AS BIGINT) AS n_ref, round(rouge_l, 6) AS rouge_l FROM rouge",
)
def q_rouge(spark, sf):
    from spanloom.functions.pairs import rouge_f

    counts = lcs_counts(extract_description(F.col("pred")), F.col("gt"))
    scored = predictions(spark, sf).select("sample_id", counts.alias("c"))
    return scored.select("sample_id", "c.*", F.round(rouge_f(F.col("c")), 6).alias("rouge_l"))


@query("rouge_l_documents")
def q_rouge_documents(spark, sf):
    return rouge_l(text_pairs(spark, sf), "pred", "ref").select("doc_id", F.round("rouge_l", 6).alias("rouge_l"))


@query("stemmed_tokens")
def q_stems(spark, sf):
    return stemmed_tokens(table(spark, sf, "documents"), "text").select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


@query(
    "greedy_match_score",
    """
WITH v AS (SELECT vec_id // 16 AS sample_id, vec_id % 2 = 0 AS is_cand, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.sample_id, a.vec_id AS c, b.vec_id AS r,
        list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))
        / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) AS cos
      FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.is_cand AND NOT b.is_cand),
p AS (SELECT sample_id, avg(m) AS p FROM (SELECT sample_id, c, max(cos) AS m FROM s GROUP BY ALL) GROUP BY ALL),
r AS (SELECT sample_id, avg(m) AS r FROM (SELECT sample_id, r, max(cos) AS m FROM s GROUP BY ALL) GROUP BY ALL)
SELECT CAST(sample_id AS BIGINT) AS sample_id, round(p, 6) AS bertscore_precision, round(r, 6) AS bertscore_recall, round(2 * p * r / (p + r), 6) AS bertscore_f1
FROM p JOIN r USING (sample_id)""",
)
def q_greedy(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("sample_id", F.floor(F.col("vec_id") / 16).cast("bigint"))
    # Sixteen vectors a sample at most, as vec_id is unique.
    side = lambda even: F.collect_list(F.when((F.col("vec_id") % 2 == 0) == F.lit(even), F.col("embedding")))
    samples = vectors.groupBy("sample_id").agg(side(True).alias("cand"), side(False).alias("ref"))
    scored = greedy_match_score(samples.filter((F.size("cand") > 0) & (F.size("ref") > 0)), "cand", "ref")
    return scored.select(
        "sample_id",
        *[F.round(f"bertscore_{p}", 6).alias(f"bertscore_{p}") for p in ("precision", "recall", "f1")],
    )


def letter_embedder():
    """A word's vector: how long it is and how often it holds an e and a digit."""

    def embed(texts):
        return [[[float(len(w)), float(w.count("e")), float(sum(c.isdigit() for c in w))] for w in t.split()] for t in texts]

    return embed


_LETTERS = """SELECT sample_id, i, CAST(length(w) AS DOUBLE) AS x, CAST(length(w) - length(replace(w, 'e', '')) AS DOUBLE) AS y,
  CAST(length(regexp_replace(w, '[^0-9]', '', 'g')) AS DOUBLE) AS z
FROM (SELECT sample_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w
      FROM (SELECT sample_id, list_filter(string_split({0}, ' '), lambda w: w <> '') AS ws FROM pred))"""


@query(
    "embed_and_match",
    ctes("ann", "valid", "pred")
    + f"""
, a AS ({_LETTERS.format('pred')}), b AS ({_LETTERS.format('gt')})
, sim AS (SELECT a.sample_id, a.i, b.i AS j, (a.x * b.x + a.y * b.y + a.z * b.z)
            / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z)) AS c FROM a JOIN b ON a.sample_id = b.sample_id)
, p AS (SELECT sample_id, avg(c) AS p FROM (SELECT sample_id, i, max(c) AS c FROM sim GROUP BY ALL) GROUP BY sample_id)
, r AS (SELECT sample_id, avg(c) AS r FROM (SELECT sample_id, j, max(c) AS c FROM sim GROUP BY ALL) GROUP BY sample_id)
SELECT p.sample_id, round(p, 6) AS match_p, round(r, 6) AS match_r, round(2 * p * r / (p + r), 6) AS match_f1 FROM p JOIN r ON p.sample_id = r.sample_id""",
)
def q_embed(spark, sf):
    scored = embed_and_match(predictions(spark, sf), letter_embedder, "pred", "gt", "match")
    return scored.select(
        "sample_id",
        F.round("match_precision", 6).alias("match_p"),
        F.round("match_recall", 6).alias("match_r"),
        F.round("match_f1", 6).alias("match_f1"),
    )
