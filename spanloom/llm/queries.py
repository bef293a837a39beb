"""Registered queries of the corpus operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    hard_negatives,
    html_extract,
    licenses,
    metric_links,
    mixing,
    near_dedup,
    neighbours,
    packing,
    prefix_trie,
    quality,
    substring,
    token_store,
    toxicity,
)
from .tokens import vocabulary_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dedup.fingerprint_string(F.col("fp")).alias("fingerprint"), "component_id")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(packing.VOCABULARY))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_corpus(table(spark, sf_dir, "documents"), vocabulary_path(token_store.VOCABULARY))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_links.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_html_main_text,
        op3_mix_sources,
        op4_substring_dedup,
        op5_pack,
        op6_quality_rules,
        op7_token_files,
        op8_toxicity,
        op9_nearest_neighbours,
        op10_license_scan,
        op11_embedding_near_dedup,
        op12_hard_negatives,
        op13_prefix_trie,
        pipeline,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_SYMBOLS = quality.SYMBOLS

# Letters of the test tables are Latin, where DuckDB's and Java's classes agree.
QUALITY_SQL = rf"""
with w as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as t, {_WORDS} as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
    from documents
), wins as (
    select rid, p, list_slice(words, p, p + 2) as win
    from (select rid, words, unnest(range(1, len(words) - 1)) as p from w)
), hit as (
    select rid, p from (select rid, p, count(*) over (partition by rid, win) as c from wins) where c > 1
), covered as (
    select rid, count(distinct p + o) as n from hit, (values (0), (1), (2)) as s(o) group by rid
), m as (
    select doc_id, len(words) as n_words,
        length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
        length(t) - length(translate(t, '{_SYMBOLS}', '')) as n_symbols,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(c.n, 0) as n_repeat_words,
        len(list_filter(words, lambda x: lower(x) in ({_STOPS}))) as n_stop,
        len(list_filter(lines, lambda l: rtrim(l, ' ') like '%...' or rtrim(l, ' ') like '%…')) as n_dots,
        length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as n_letters,
        length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper
    from w left join covered c using (rid)
), j as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed
    and coalesce(word_chars / nullif(n_words, 0) between 2.0 and 14.0, true)
    and coalesce(n_symbols / nullif(n_words, 0) <= 0.25, true)
    and coalesce(n_stop / nullif(n_words, 0) >= 0.02, true)
    and coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true)
    and coalesce(n_dots / nullif(n_lines, 0) <= 0.5, true)
    and coalesce(n_upper / nullif(n_letters, 0) <= 0.6, true) as kept
from j
"""

# A word at position p is removed if a window that covers it starts earlier in another document.
SUBSTRING_SQL = rf"""
with w as (
    select row_number() over () as rid, doc_id, {_WORDS} as words from documents
), wins as (
    select rid, doc_id, p, list_slice(words, p, p + 12) as win
    from (select rid, doc_id, words, unnest(range(1, len(words) - 11)) as p from w)
), first_in as (
    select rid, p from (select rid, doc_id, p, min(doc_id) over (partition by win) as least from wins) where least < doc_id
), gone as (
    select distinct rid, p + o as pos from first_in, range(13) as s(o)
), kept as (
    select rid, string_agg(word, ' ' order by pos) as text, count(*) as n
    from (select rid, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from w) as every
    anti join gone using (rid, pos)
    group by rid
)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from w left join kept using (rid)
"""

_FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

LINKS_SQL = f"""
with recursive r as (
    select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: x::double) as v,
        {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
    from embeddings
), e as (
    select a.rid as a, b.rid as b from r as a join r as b on a.ok and b.ok and a.rid <> b.rid and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= {metric_links.LINK}
), reach as (
    select rid, rid as other from r union select reach.rid, e.b from reach join e on e.a = reach.other
), c as (
    select reach.rid, min(o.vec_id) as component_id from reach join r as o on o.rid = reach.other group by reach.rid
)
select r.vec_id, (select count(*) from e where e.a = r.rid) as n_links, component_id, coalesce(r.vec_id = component_id, false) as kept
from r join c using (rid)
"""

_H = hard_negatives
NEGATIVES_SQL = f"""
with r as (
    select vec_id, case when vec_id % {_H.RELABEL_EVERY} = 0 then (label + 1) % {_H.LABELS} else label end::bigint as label,
        list_transform(embedding, lambda x: floor({_H.SCALE} * x::double)) as v
    from embeddings where vec_id is not null and label is not null and {_FINITE}
), s as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from r as a join r as b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % {_H.ANCHOR_EVERY} = 0
), p as (
    select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {_H.POSITIVES}
)
select p.anchor_id, p.vec_id as positive_id,
    (row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id))::integer as rank,
    n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s as n on n.anchor_id = p.anchor_id and not n.same
    and {_H.LOWEST} * p.score <= 100 * n.score and 100 * n.score <= {_H.HIGHEST} * p.score
qualify rank <= {_H.NEGATIVES}
"""

# CRC-32 bit by bit, as DuckDB has none.
_CRC_BYTE = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, b: {_CRC_BYTE}), 4294967295)"

TRIE_SQL = rf"""
with whole as (
    select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first) as turns
    from conversations where conv_id is not null group by conv_id
), h as (
    select conv_id, turns, ({_CRC} % {prefix_trie.HEADS})::bigint as h from whole
), full_ as (
    select h.conv_id, coalesce(b.turns, [])[1:h.h] || h.turns[h.h + 1:] as path
    from h left join whole as b on b.conv_id = h.conv_id - h.conv_id % {prefix_trie.GROUP}
), steps as (
    select conv_id, len(path) as n, d, path[1:d] as node
    from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from full_)
), nodes as (
    select d, node, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256,
        len(list_filter(regexp_split_to_array(coalesce(node[d].text, ''), '[ 	-]+'), lambda w: w <> '')) as words
    from steps group by d, node
), kids as (
    select d - 1 as d, node[1:d - 1] as node, count(*) as n from nodes where d > 0 group by all
), known as (
    select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids using (d, node)
), up as (
    select d, node, sum(leaf) as n_leaves, sum(saved) as saved_tokens from (
        select unnest(range(0, d + 1)) as d, node as deep, (n_children = 0)::bigint as leaf, (n_convs - 1) * words as saved from known
    ) as k, lateral (select deep[1:k.d] as node) group by d, node
)
select known.conv_id, known.d as depth, parent.conv_id as parent_conv_id, known.n_convs, known.n_children,
    up.n_leaves::bigint as n_leaves, up.saved_tokens::bigint as saved_tokens, known.ends_sha256
from known join up using (d, node) left join nodes as parent on parent.d = known.d - 1 and parent.node = known.node[1:known.d - 1]
"""

# Exact neighbours: equal to the tree's where its search is exact, so not the query's own check.
ORACLES: dict[str, str] = {
    "op6_quality_rules": QUALITY_SQL,
    "op4_substring_dedup": SUBSTRING_SQL,
    "op11_embedding_near_dedup": LINKS_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
