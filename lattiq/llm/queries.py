"""Registered queries of the llm problems and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from lattiq.functions.scratch import Scratch
from lattiq.llm import clusters, neighbours, packing, quality, sampling, tokenizer, topn


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_top(spark, d):
    return topn.ranked(topn.top_n(topn.entries(_t(spark, d, "search_result")), 10)).selectExpr("g as query_id", "item as passage_id", "score", "rank")


def p1_found(spark, d):
    return topn.top_n(topn.entries(_t(spark, d, "search_result")), 10).selectExpr("g as query_id", "item as passage_id")


def p7_ids(spark, d):
    return tokenizer.encode_corpus(_t(spark, d, "documents"))


def p9_stats(spark, d):
    return quality.statistics(_t(spark, d, "documents"), _t(spark, d, "common_words"))


def p9_counts(spark, d):
    return p9_stats(spark, d).select("doc_id", "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_share", "closed_line_share", "common_word_share")


def p9_found(spark, d):
    return p9_stats(spark, d).where("is_prose").select("doc_id")


def p4_found(spark, d):
    return neighbours.near_pairs(_t(spark, d, "in_memory_source"))


def p4_nearest(spark, d):
    return neighbours.nearest(_t(spark, d, "in_memory_source"))


def p5_found(spark, d):
    return clusters.cluster(_t(spark, d, "in_memory_source")).select("cluster_vec_id", "vec_id")


def p5_typical(spark, d):
    return clusters.describe(clusters.cluster(_t(spark, d, "in_memory_source")))


SAMPLE_SIZE = 1000


def p6_sample(spark, d):
    return sampling.sample(_t(spark, d, "doc_chunk"), SAMPLE_SIZE, seed=42)


def p6_vectors(spark, d):
    pieces = _t(spark, d, "doc_chunk")
    return sampling.with_vectors(sampling.sample(pieces, SAMPLE_SIZE, seed=42), pieces)


def p8_containers(spark, d):
    return packing.pack(tokenizer.count_corpus(_t(spark, d, "documents")))


def p8_checked(spark, d):
    sized = Scratch(spark, "sizes").write(tokenizer.count_corpus(_t(spark, d, "documents")), "sized")
    return packing.check(packing.pack(sized), sized)


def p8_fill(spark, d):
    return packing.fill_report(p8_containers(spark, d))


QUERIES = {"p1_found": p1_found, "p1_top": p1_top, "p7_ids": p7_ids, "p4_found": p4_found, "p4_nearest": p4_nearest, "p5_found": p5_found, "p5_typical": p5_typical, "p6_sample": p6_sample, "p6_vectors": p6_vectors, "p8_containers": p8_containers, "p8_checked": p8_checked, "p8_fill": p8_fill, "p9_found": p9_found, "p9_stats": p9_stats, "p9_counts": p9_counts}

_TOP = """with e as (
    select query_id, unnest(list_zip(passage_ids, scores)) as z from search_result where query_id is not null),
  b as (select query_id, z[1] as passage_id, max(z[2]) as score from e where z[1] is not null and z[2] is not null and not isnan(z[2]) group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by score desc, passage_id) as rank from b)
"""

_UNIT = """with v as (
    select vec_id, any_value(embeddings)::double[64] as e from in_memory_source
    where vec_id is not null and len(embeddings) = 64 and len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embeddings, lambda x: x <> 0)) > 0 group by vec_id)
"""

ORACLE = {
    "p4_found": _UNIT
    + """, c as (select a.vec_id as a, b.vec_id as b, array_cosine_similarity(a.e, b.e) as s from v a join v b on a.vec_id <> b.vec_id),
  r as (select a, b, s, row_number() over (partition by a order by round(s, 6) desc, b) as rank from c where s >= 0.9)
select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from r where rank <= 5 and s >= 0.985""",
    "p5_found": _UNIT.replace("with v", "with recursive v")
    + """, edge as (select a.vec_id as a, b.vec_id as b from v a join v b on array_cosine_similarity(a.e, b.e) >= 0.85),
  reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
  low as (select a as vec_id, min(b) as cluster_vec_id from reach group by a),
  big as (select cluster_vec_id from low group by cluster_vec_id having count(*) >= 5)
select cluster_vec_id, vec_id from low where cluster_vec_id in (select cluster_vec_id from big)""",
    "p8_checked": "select 0::bigint as overfull, count(*) as documents, 0::bigint as cut_wrongly, 0::bigint as ids_off from documents",
    "p1_found": _TOP + "select query_id, passage_id from r where rank <= 10",
    "p1_top": _TOP + "select query_id, passage_id, score, cast(rank as int) as rank from r where rank <= 10",
    "p9_counts": r"""
with cw as (select list(distinct lower(word)) as known from common_words where word is not null),
  t as (select doc_id, coalesce(text, '') as raw,
    regexp_replace(coalesce(text, ''), '[\x{85}\x{a0}\x{2000}-\x{200d}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]', ' ', 'g') as text from documents),
  w as (select doc_id, length(raw) as n_chars, regexp_extract_all(text, '[A-Za-z\x{80}-\x{10ffff}]+') as words,
    length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) as n_symbols,
    length(regexp_replace(text, '[\x{0}-\x{20}]', '', 'g')) as n_visible,
    list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda l: regexp_replace(l, '[\x{0}-\x{20}]', '', 'g')), lambda l: length(l) > 0) as lines from t),
  e as (select w.*, list_transform(lines, lambda l: case when length(l) > 7 and l[-1] = '>' and l[-4] = '<' then l[-5]
    when length(l) > 1 and l[-1] in ('"', '''', ')', ']') then l[-2] else l[-1] end) as ends from w)
select doc_id, n_chars, len(words) as n_words, cast(len(lines) as bigint) as n_lines,
  case when len(words) > 0 then list_sum(list_transform(words, lambda x: length(x))) / len(words) else 0 end as mean_word_length,
  case when n_visible > 0 then n_symbols / n_visible else 0 end as symbol_share,
  case when len(lines) > 0 then len(list_filter(ends, lambda c: c in ('.', '!', '?', ':', ';'))) / len(lines) else 0 end as closed_line_share,
  case when len(words) > 0 then len(list_filter(words, lambda x: list_contains(known, lower(x)))) / len(words) else 0 end as common_word_share
from e, cw""",
}
