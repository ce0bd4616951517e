"""Registered queries of the two general data problems (p2: heavy keys, p3: small files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch
from lattiq.operators import compaction, salted


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark, d):
    return salted.merged_postings(_t(spark, d, "partial_compacted")).where("shared").select("cid", "pid")


def p2_merged(spark, d):
    return salted.merged_postings(_t(spark, d, "partial_compacted"))


def p2_salted(spark, d):
    """As p2_merged, with so few entries to a salt that the heavy keys of any scale are salted."""
    return salted.merged_postings(_t(spark, d, "partial_compacted"), per_salt=50)


def p2_segments(spark, d):
    segments = salted.posting_segments(_t(spark, d, "partial_compacted"), seg_len=256)
    return segments.selectExpr("cid", "inline(arrays_zip(pids, counts)) as (pid, n_entries)").join(segments.groupBy("cid").agg(F.max(F.size("pids")).alias("longest")), "cid").selectExpr("cid", "pid", "n_entries", "longest < 400 as bounded")


def p2_totals(spark, d):
    return salted.centroid_totals(_t(spark, d, "partial_compacted"))


def p3_rows(spark, d):
    return compaction.consolidate(_t(spark, d, "disk_embedding_source"), _t(spark, d, "embedding_files"))


def p3_found(spark, d):
    return p3_rows(spark, d).select("source_id", "passage_id")


def p3_pieces(spark, d):
    return (
        p3_rows(spark, d)
        .groupBy("source_id", "piece")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doclen").alias("n_rows"), F.sum(F.length("vectors")).alias("n_bytes"))
    )


def p3_reconciled(spark, d):
    sources, files = _t(spark, d, "disk_embedding_source"), _t(spark, d, "embedding_files")
    written = compaction.write_consolidated(compaction.consolidate(sources, files), f"{Scratch(spark, 'pieces').root}/pieces")
    return compaction.reconcile(sources, files, written)


QUERIES = {"p2_found": p2_found, "p2_merged": p2_merged, "p2_salted": p2_salted, "p2_segments": p2_segments, "p3_reconciled": p3_reconciled, "p2_totals": p2_totals, "p3_found": p3_found, "p3_pieces": p3_pieces}

_ENTRIES = """with seg as (select distinct partial_id, cid, seg, centroid_pids from partial_compacted
    where cid is not null and partial_id is not null and len(centroid_pids) > 0),
  e as (select * from (select partial_id, cid, unnest(centroid_pids) as pid from seg) where pid >= 0),
  m as (select cid, pid, count(*) as n_entries, count(distinct partial_id) > 1 as shared from e group by cid, pid)
"""

_DOCUMENTS = """
with recursive named as (
    select source_id, unnest(files) as f from disk_embedding_source),
  spelled as (select distinct source_id, f from named where f is not null
    union select distinct source_id, file_path from embedding_files where file_path is not null),
  split as (select source_id, f, list_filter(string_split(f, '/'), lambda p: p not in ('', '.')) as parts from spelled),
  walk(source_id, f, acc, i, parts) as (
    select source_id, f, cast([] as varchar[]), 1, parts from split
    union all
    select source_id, f, case when parts[i] = '..' and len(acc) > 0 and acc[-1] != '..' then acc[:len(acc) - 1]
        else list_append(acc, parts[i]) end, i + 1, parts from walk where i <= len(parts)),
  canon as (select source_id, f, array_to_string(acc, '/') as path from walk where i > len(parts)),
  listed as (select distinct n.source_id, c.path from named n join canon c on n.source_id = c.source_id and n.f = c.f),
  whole as (select e.source_id, c.path, e.passage_ids from embedding_files e join canon c on e.source_id = c.source_id and e.file_path = c.f
    where e.payload is not null and coalesce(list_sum(e.doclens), 0) * 16 = octet_length(e.payload) - 10
      - (('0x' || substr(hex(e.payload), 17, 2))::int + 256 * ('0x' || substr(hex(e.payload), 19, 2))::int)),
  docs as (select w.source_id, unnest(w.passage_ids) as passage_id from whole w join listed l on w.source_id = l.source_id and w.path = l.path)
"""

ORACLE = {
    "p2_found": _ENTRIES + "select cid, pid from m where shared",
    "p2_merged": _ENTRIES + "select cid, pid, n_entries, shared from m",
    "p2_salted": _ENTRIES + "select cid, pid, n_entries, shared from m",
    "p2_segments": _ENTRIES + "select cid, pid, n_entries, true as bounded from m",
    "p2_totals": _ENTRIES
    + "select cid, cast(sum(n_entries) as bigint) as n_entries, count(*) as n_pids, cast(sum(shared::int) as bigint) as n_shared from m group by cid",
    "p3_found": _DOCUMENTS + "select distinct source_id, passage_id from docs where passage_id is not null",
    "p3_reconciled": _DOCUMENTS
    + "select source_id, count(distinct passage_id) as expected, count(distinct passage_id) as written, count(distinct passage_id) as distinct_docs, true as ok "
    "from docs where passage_id is not null group by source_id",
}
