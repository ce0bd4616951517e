"""Far too many small files: consolidation planned in SQL.

Cumulative-size grouping: the documents of usable files are settled and frozen (written once) with the manifest of their
files, files are put into one fixed order, their sizes are summed along that order, and every file goes to the
interval of the target size in which it starts.  The size of a file is its share of a piece: of the documents a piece
should hold or of its bytes, whichever is more.  The rewrite moves each document once, and ``reconcile`` compares the
documents of the source files with those written.

What counts as usable: the file is named by its source (spellings are resolved from the root of the
source; case matters) and its payload holds exactly as many rows as its doclens say (null counts 0).
A document that several usable files or versions of a file hold is taken from the latest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

FILES_PER_BUCKET = 50_000
DEFAULT_CHUNK = 25_000
"""Documents per piece where a source has no usable chunk_size."""
PIECE_BYTES = 256 << 20
"""Bytes of source files per piece, at most about."""
_WHOLE = 1_000_000_000
"""Units of a whole piece in the running sums."""

_RESOLVED = """array_join(aggregate(split({0}, '/'), cast(array() as array<string>), (acc, p) ->
    case when p in ('', '.') then acc
         when p = '..' and size(acc) > 0 and element_at(acc, -1) != '..' then slice(acc, 1, size(acc) - 1)
         else concat(acc, array(p)) end), '/')"""


def resolved_path(column: str) -> str:
    """SQL for the canonical form of a relative path; ``..`` above the root is kept as it is."""
    # element_at fails on an empty array under ANSI, so the size test guards it in a short-circuit case
    return _RESOLVED.format(column)


def payload_rows(column: str = "payload", width: int = 8, item: int = 2) -> str:
    """SQL for the rows an NPY (version 1) payload really holds; null if it is no whole NPY block.

    The header length is the little-endian number at bytes 9 and 10.  Truncated data, or a header whose
    shape disagrees with the bytes that follow, give null.
    """
    hlen = f"(cast(conv(hex(substring({column}, 9, 1)), 16, 10) as int) + 256 * cast(conv(hex(substring({column}, 10, 1)), 16, 10) as int))"
    shape = f"regexp_extract(decode(substring({column}, 1, 512), 'ISO-8859-1'), 'shape[^(]*[(]([0-9]+) *, *{width} *[)]', 1)"
    return f"""case when {column} is null or length({column}) < 12 or hex(substring({column}, 1, 6)) != '934E554D5059' then null
        when try_cast({shape} as bigint) * {width * item} = length({column}) - 10 - {hlen} then try_cast({shape} as bigint) end"""


def usable_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are named and whole, one row per stored version, copies dropped.

    Columns: source_id, path, version, doclens, passage_ids, payload, written_at, n_bytes, chunk_size.
    """
    named = (
        sources.where("source_id is not null")
        .select("source_id", F.explode("files").alias("f"), "chunk_size")
        .where("f is not null")
        .selectExpr("source_id", f"{resolved_path('f')} as path", "chunk_size")
        .groupBy("source_id", "path")
        .agg(F.max("chunk_size").alias("chunk_size"))
    )
    whole = (
        files.where("source_id is not null and file_path is not null and size(passage_ids) > 0")
        .selectExpr(
            "source_id", f"{resolved_path('file_path')} as path", "doclens", "passage_ids", "payload", "written_at",
            "xxhash64(passage_ids, doclens, payload) as version", f"{'if(n_bytes > 0, n_bytes, length(payload))' if 'n_bytes' in files.columns else 'length(payload)'} as n_bytes",
            "aggregate(coalesce(doclens, array()), 0L, (s, x) -> s + coalesce(x, 0L)) as n_rows", f"{payload_rows()} as held",
        )
        .where("held = n_rows")
        .drop("held")
    )
    return whole.join(named, ["source_id", "path"])


def settled(usable: DataFrame) -> DataFrame:
    """Every document of a source once: ``(source_id, passage_id, path, version, n_bytes, doclen, vectors)``.

    It comes from the latest written version, then the greatest path.  Documents are cut out of the payload as
    they leave its row, so payloads are read once and never copied to their documents.
    """
    head = "(11 + cast(conv(hex(substring(payload, 9, 1)), 16, 10) as int) + 256 * cast(conv(hex(substring(payload, 10, 1)), 16, 10) as int))"
    starts = "aggregate(doclens, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) + coalesce(x, 0L))))"
    one = (
        "struct(get(passage_ids, i) as passage_id, -i as neg, coalesce(get(doclens, i), 0L) as doclen, "
        "substring(payload, cast(head + coalesce(get(starts, i), 0L) * 16 as int), cast(coalesce(get(doclens, i), 0L) * 16 as int)) as vectors)"
    )
    docs = usable.selectExpr("source_id", "path", "version", "written_at", "n_bytes", "passage_ids", "payload", "coalesce(doclens, array()) as doclens").selectExpr("*", f"{head} as head", f"{starts} as starts")
    docs = docs.selectExpr("source_id", "path", "version", "written_at", "n_bytes", f"inline(transform(sequence(0, size(passage_ids) - 1), i -> {one}))").where("passage_id is not null")
    best = docs.groupBy("source_id", "passage_id").agg(F.max(F.struct("written_at", "path", "version", "neg", "n_bytes", "doclen", "vectors")).alias("o"))
    return best.select("source_id", "passage_id", "o.path", "o.version", "o.n_bytes", "o.doclen", "o.vectors")


def plan_pieces(owned: DataFrame, chunks: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(source_id, path, version, piece, n_docs, n_bytes)``: cumulative sizes cut at multiples of a whole piece.

    The fixed order is (bucket, path, version) within a source, where the bucket is a hash of the path
    and a source has about one bucket per FILES_PER_BUCKET files.  Running sums are taken over buckets
    first and inside each bucket second, so no task sees more than one bucket of a huge source.
    """
    per_file = owned.groupBy("source_id", "path", "version").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_bytes").alias("n_bytes"))
    spread = per_file.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / FILES_PER_BUCKET).alias("buckets"))
    target = f"(case when chunk_size > 0 then chunk_size else {DEFAULT_CHUNK} end)"
    sized = (
        per_file.join(spread, "source_id")
        .join(chunks, "source_id")
        .selectExpr(
            "source_id", "path", "version", "n_docs", "n_bytes", "pmod(xxhash64(path), buckets) as bucket",
            f"cast(greatest(n_docs / {target}, n_bytes / {piece_bytes}) * {_WHOLE} as decimal(38, 0)) as share",
        )
    )
    return sized.sparkSession.sql(
        f"""
        with b as (select source_id, bucket, sum(share) as n from {{m}} group by source_id, bucket),
        before as (select source_id, bucket, sum(n) over (partition by source_id order by bucket) - n as head from b),
        run as (select m.*, sum(share) over (partition by source_id, bucket order by path, version) - share as at
                from {{m}} m)
        select r.source_id, r.path, r.version, r.n_docs, r.n_bytes, cast(floor((h.head + r.at) / {_WHOLE}) as bigint) as piece
        from run r join before h on r.source_id = h.source_id and r.bucket = h.bucket""",
        m=sized,
    )


def consolidate(sources: DataFrame, files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The documents of all sources, each once, with the piece it moves to.

    Returns (source_id, piece, passage_id, doclen, vectors): ``vectors`` are the bytes of the document's rows
    as stored (two-byte floats).  Extra columns of the inputs are ignored.  Empty inputs give no rows.
    """
    scratch = Scratch(files.sparkSession, "compaction")
    usable = usable_files(sources.select("source_id", "files", "chunk_size"), files)
    frozen = scratch.write(settled(usable), "documents")
    chunks = sources.groupBy("source_id").agg(F.max("chunk_size").alias("chunk_size"))
    plan = scratch.write(plan_pieces(frozen.drop("vectors"), chunks, piece_bytes), "plan")
    return frozen.drop("n_bytes").join(plan, ["source_id", "path", "version"]).select("source_id", "piece", "passage_id", "doclen", "vectors")


def write_consolidated(rows: DataFrame, path: str) -> DataFrame:
    """Write the pieces, one file per piece and source, and return the table written.

    Rows are clustered by (source_id, piece), so a piece lands in one task; a huge source has many pieces.
    """
    placed = rows.repartition("source_id", "piece").sortWithinPartitions("source_id", "piece", "passage_id")
    placed.write.mode("overwrite").partitionBy("source_id", "piece").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def reconcile(sources: DataFrame, files: DataFrame, written: DataFrame) -> DataFrame:
    """Per source: documents of its usable files, written, distinct; ``ok`` if nothing was lost or doubled."""
    usable = usable_files(sources.select("source_id", "files", "chunk_size"), files)
    docs = usable.select("source_id", F.explode("passage_ids").alias("passage_id")).where("passage_id is not null")
    a = docs.groupBy("source_id").agg(F.countDistinct("passage_id").alias("expected"))
    b = written.groupBy("source_id").agg(F.count(F.lit(1)).alias("written"), F.countDistinct("passage_id").alias("distinct_docs"))
    return a.join(b, "source_id", "full").withColumn(
        "ok", F.coalesce((F.col("expected") == F.col("written")) & (F.col("written") == F.col("distinct_docs")), F.lit(False))
    )
