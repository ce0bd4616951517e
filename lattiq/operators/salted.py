"""Per-key results where a few keys hold most records: two-stage salted aggregation.

Posting lists arrive as segments of partial merges.  A handful of centroids own most of the entries, so
grouping by centroid alone would leave a few tasks with nearly all the work.  Heavy centroids get salts.  Stage 1
computes partial results under ``(cid, salt)``: entries and the least and greatest partial of each passage there.
Stage 2 merges the partial results of all salts by the original key.

The salt of an entry is drawn by hashing the row it comes from (partial and segment), not by ``rand()``: it is as
good as random for the key, and a retried task repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

ENTRIES_PER_SALT = 10_000
"""Entries of a key that one salt may hold on average before the key gets a further salt."""
MOST_HEAVY = 100_000
"""Keys that can be salted, which bounds what is broadcast: beyond, an unsalted key holds less than such a share of all
entries, which is no more than an even share of a task at that size."""
BROADCAST_ROWS = 1_000_000
"""A table of one row per key is broadcast only if it was counted to have no more rows."""
HOT_ROWS = 1_000_000
"""Rows of one key that may meet in one task."""

SEED_COLUMNS = ("partial_id", "cid", "seg", "centroid_counts", "centroid_pids")


def distinct_segments(partials: DataFrame) -> DataFrame:
    """One row per stored segment: copies of a row (same place, same list) are dropped.

    Rows without a centroid, a partial or a list hold no entries and leave no segment.
    """
    return (
        partials.select(*SEED_COLUMNS)
        .where("cid is not null and partial_id is not null and size(centroid_pids) > 0")
        .withColumn("_content", F.xxhash64("centroid_pids"))
        .groupBy("partial_id", "cid", "seg", "_content")
        .agg(F.first("centroid_pids").alias("centroid_pids"), F.max("centroid_counts").alias("centroid_counts"))
        .drop("_content")
    )


def heavy_keys(sized: DataFrame, key: str, size: str, per_salt: int = ENTRIES_PER_SALT) -> DataFrame:
    """``(key, salts)`` of the keys that need more than one salt: at most MOST_HEAVY rows, so it may be broadcast."""
    per_key = sized.groupBy(key).agg(F.sum(size).alias("_n"))
    total = per_key.agg(F.sum("_n").alias("_all"))
    least = f"greatest({per_salt}L, _all div {MOST_HEAVY})"
    return (
        per_key.crossJoin(F.broadcast(total))  # one row
        .where(f"_n > {least}")
        .select(key, F.expr(f"cast(ceil(_n / {least}) as int)").alias("salts"))
    )


def attached(rows: DataFrame, table: DataFrame, key: str, scratch: Scratch, name: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that has one row per key; a key may own any share of ``rows``.

    The table is broadcast if it was counted to be small.  If not, the keys of more than HOT_ROWS rows (there can be
    only one for so many rows) are broadcast and all others are shuffled, so no hot key meets its rows in one task.
    """
    stored = scratch.write(table, name)
    if stored.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stored), key, how)
    hot = F.broadcast(scratch.write(rows.groupBy(key).count().where(f"count > {HOT_ROWS}").select(key), f"{name}_hot"))
    few = F.broadcast(stored.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(stored, key, how))


def salted_counts(partials: DataFrame, per_salt: int = ENTRIES_PER_SALT) -> DataFrame:
    """Stage 1: ``(cid, salt, pid, n_entries, first_partial, last_partial)``, partial results of each salt.

    Null and negative entries are no passages.
    """
    segments = distinct_segments(partials)
    heavy = heavy_keys(segments.select("cid", F.size("centroid_pids").alias("n")), "cid", "n", per_salt)
    salted = segments.join(F.broadcast(heavy), "cid", "left").withColumn("salt", F.expr("case when salts is null then 0 else cast(pmod(xxhash64(partial_id, seg), salts) as int) end"))
    entries = salted.select("partial_id", "cid", "salt", F.explode("centroid_pids").alias("pid")).where("pid >= 0")
    return entries.groupBy("cid", "salt", "pid").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.min("partial_id").alias("first_partial"),
        F.max("partial_id").alias("last_partial"),
    )


def merged_postings(partials: DataFrame, per_salt: int = ENTRIES_PER_SALT) -> DataFrame:
    """Stage 2: the merged list of every centroid in long form: ``(cid, pid, n_entries, shared)``.

    ``shared`` says that a passage came from several partials.  The list of a large centroid never becomes one value
    or one task; ``posting_segments`` packs it into bounded arrays.
    """
    return (
        salted_counts(partials, per_salt)
        .groupBy("cid", "pid")
        .agg(F.sum("n_entries").alias("n_entries"), F.min("first_partial").alias("first"), F.max("last_partial").alias("last"))
        .selectExpr("cid", "pid", "n_entries", "first < last as shared")
    )


def centroid_totals(partials: DataFrame, per_salt: int = ENTRIES_PER_SALT) -> DataFrame:
    """True size and passage counts per centroid, ``(cid, n_entries, n_pids, n_shared)``; sums have partial stages."""
    return merged_postings(partials, per_salt).groupBy("cid").agg(F.sum("n_entries").alias("n_entries"), F.count(F.lit(1)).alias("n_pids"), F.sum(F.col("shared").cast("bigint")).alias("n_shared"))


def posting_segments(partials: DataFrame, seg_len: int = 4096, per_salt: int = ENTRIES_PER_SALT) -> DataFrame:
    """Merged lists as bounded arrays: ``(cid, bucket, pids, counts)``, each sorted by pid.

    A bucket is a slice of the pid hash space of its centroid with about ``seg_len`` passages, whatever the number of
    centroids and the size of the largest.
    """
    scratch = Scratch(partials.sparkSession, "segments")
    merged = scratch.write(merged_postings(partials, per_salt), "merged")
    buckets = merged.groupBy("cid").agg(F.expr(f"cast(ceil(count(1) / {seg_len}) as int)").alias("buckets")).where("buckets > 1")
    return (
        attached(merged, buckets, "cid", scratch, "buckets", "left")
        .withColumn("bucket", F.expr("cast(pmod(xxhash64(pid, 7), coalesce(buckets, 1)) as int)"))
        .groupBy("cid", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("pid", "n_entries"))).alias("l"))
        .select("cid", "bucket", F.col("l.pid").alias("pids"), F.col("l.n_entries").alias("counts"))
    )
