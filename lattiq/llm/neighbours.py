"""The k most similar vectors for every vector of a collection (problem 4).

Method: balanced posting lists.  Heads are trained on two levels and kept balanced, so lists keep their size as the
collection grows; a vector near a boundary is replicated to several lists; the heads are searched by a best-first
walk over an in-memory graph of heads; and a distance ratio prunes, for each vector, the lists in which it searches.  Every usable vector is
indexed and every one is a query.  Lists of one neighbourhood form a group, and a vector travels once to each
group it touches; inside a list, queries meet postings in dense blocks, and only the best few candidates leave.

Ties go by the smaller id (cosines are compared in steps of 1e-6).  Vectors of one direction: only the K + 1
smallest ids are indexed, since a query can never need more of them; the others find their neighbours among
those ids.  Rows with the same vec_id count once.  Null, short, non-finite and zero vectors are left out.
Fewer than k + 1 usable vectors give as many neighbours as there are.  Cosines are accurate to about 4e-6;
``near_pairs`` settles those next to its threshold with the original values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch
from lattiq.llm import vectors as V

PER_LIST = 450
"""Vectors per list, on average, before replication."""
PER_GROUP = 8_000
POSTED, SEARCHED, RATIO, EXTRA = 8, 12, 0.15, 4
STEP = 1_000_000
_BITS = 30
_LOW = (1 << _BITS) - 1
"""A code holds a cosine in steps above an index of 30 bits (the rows of one group, which fit one task)."""


def _code(score: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Cosines in steps of 1e-6 above the complement of the index; -1 for a vector itself."""
    return np.where(score < -2, -1, (np.rint((score.astype(np.float64) + 4) * STEP).astype(np.int64) << _BITS) | (_LOW - index))


def _best(score: np.ndarray, index: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a score of at least ``least``, and for each the codes of the k best.

    Scores are folded in sixteen strips by maximum.  The k-th best of a fold bounds the k-th best of the row
    from below, so only strips that reach that bound (or the one given) are looked into.
    """
    n, w = score.shape
    wide = w // 16
    if wide <= 2 * k:
        rows = np.flatnonzero(score.max(1) >= least)
        code = -np.sort(-_code(score[rows], index), axis=1)[:, :k]
        return rows, code if code.shape[1] == k else np.pad(code, ((0, 0), (0, k - code.shape[1])), constant_values=-1)
    fold = score[:, :wide].copy()
    for i in range(1, 16):
        np.maximum(fold, score[:, i * wide : (i + 1) * wide], out=fold)
    tail = score[:, 16 * wide :]
    rows = np.flatnonzero((np.maximum(fold.max(1), tail.max(1)) if tail.shape[1] else fold.max(1)) >= least)
    fold, tail, limit = fold[rows], tail[rows], least[rows].copy()
    new = np.flatnonzero(limit < -1)
    if len(new):
        limit[new] = np.partition(fold[new], wide - k, axis=1)[:, wide - k] - 2 / STEP
    limit = limit.astype(np.float32)
    r, c = np.nonzero(fold >= limit[:, None])
    col = c[:, None] + np.arange(16) * wide
    val = score[rows[r][:, None], col]
    hit = val >= limit[r][:, None]
    tr, tc = np.nonzero(tail >= limit[:, None])
    r = np.concatenate([np.broadcast_to(r[:, None], hit.shape)[hit], tr])
    col, val = np.concatenate([col[hit], tc + 16 * wide]), np.concatenate([val[hit], tail[tr, tc]])
    code = _code(val, index[col])
    order = np.lexsort((-code, r))
    r, code = r[order], code[order]
    rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r]
    out = np.full((len(rows), k), -1, np.int64)
    top = rank < k
    out[r[top], rank[top]] = code[top]
    return rows, out


def _union(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k best of two code tables, an index counted once."""
    both = np.concatenate([a, b], 1)
    order = np.argsort(both & _LOW, axis=1, kind="stable")
    both = np.take_along_axis(both, order, 1)
    low = both & _LOW
    twin = (low[:, 1:] == low[:, :-1]) & (both[:, 1:] >= 0) & (both[:, :-1] >= 0)
    later = both[:, 1:]
    later[twin & (later <= both[:, :-1])] = -1
    # where the later one is better, keep it and drop the earlier
    first = both[:, :-1]
    first[twin & (later > first)] = -1
    return -np.sort(-both, axis=1)[:, :k]


def search_group(m: V.Members, k: int) -> np.ndarray:
    """Codes of the best k postings for each member over the lists of the group in which it searches.

    Every member searches its first list (its home list, if that is in the group) before all others, so that in
    further lists only those rows are ranked that hold something as good as what it has.
    """
    best = np.full((len(m.ids), k), -1, np.int64)
    for first in (True, False):
        for bit in range(V.GROUP_LISTS):
            p = np.flatnonzero(m.post & (1 << bit))
            q = np.flatnonzero((m.search & (1 << bit) != 0) & ((m.home_bit == bit) == first))
            if not len(p) or not len(q):
                continue
            target = np.ascontiguousarray(m.vecs[p].T)
            place = np.full(len(m.ids), -1)
            place[p] = np.arange(len(p))
            rows = max(16, min(512, 500_000 // len(p)))
            for at in range(0, len(q), rows):
                part = q[at : at + rows]
                score = m.vecs[part] @ target
                own = place[part]
                hit = np.flatnonzero(own >= 0)
                score[hit, own[hit]] = -3
                last = best[part, k - 1]
                least = np.where(last >= 0, (last >> _BITS) / STEP - 4 - 2 / STEP, -2)
                some, code = _best(score, p, k, least)
                if len(some):
                    best[part[some]] = _union(best[part[some]], code, k)
    return best


def nearest(
    rows: DataFrame, k: int = 5, per_list: int = PER_LIST, per_group: int = PER_GROUP, posted: int = POSTED, searched: int = SEARCHED, ratio: float = RATIO, extra: int = EXTRA,
    cell_lists: int | None = None, head_bytes: int | None = None,
) -> DataFrame:
    """``(vec_id, neighbour_id, rank, cosine)`` for every usable vector.

    More lists posted to and searched (``posted``, ``searched``, ``ratio``, ``extra``) give more recall for more work.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    base = scratch.write(V.usable(rows), "base")
    n = base.count()
    shape = "vec_id bigint, neighbour_id bigint, rank int, cosine float"
    if n == 0:
        return spark.createDataFrame([], shape)
    surplus, first = V.crowded(base, k + 1, scratch)
    index = V.without(base, surplus)
    lists = V.train(base, n, per_list, per_group, scratch, cell_lists=cell_lists, head_bytes=head_bytes)
    laid = V.exchange(index, lists, posted, searched, ratio, ratio, extra)
    buckets = lists.tasks

    def local(batches):
        for m in V.gathered(batches):
            best = search_group(m, k)
            some = np.flatnonzero(best[:, 0] >= 0)
            best = best[some]
            ids = m.ids[some]
            with np.errstate(over="ignore"):
                mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, best, ids = bucket[order], best[order], ids[order]
            other = np.where(best >= 0, m.ids[np.minimum(_LOW - (best & _LOW), len(m.ids) - 1)], -1)
            cos = np.where(best >= 0, (best >> _BITS) / STEP - 4, -9).astype(np.float32)
            ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[ends - 1].astype(np.int32)), V.binary(ids.view(np.uint8), ends * 8),
                    V.binary(other.ravel().view(np.uint8), ends * 8 * k), V.binary(cos.ravel().view(np.uint8), ends * 4 * k),
                ],
                ["bucket", "ids", "others", "cos"],
            )

    def merge(batches):
        held: dict[int, list[list[np.ndarray]]] = {}
        for b in batches:
            for i, g in enumerate(b.column(0).to_pylist()):
                held.setdefault(g, []).append([np.frombuffer(b.column(c)[i].as_buffer(), np.uint8) for c in range(1, 4)])
        for g in list(held):
            ids, other, cos = (np.concatenate(x) for x in zip(*held.pop(g), strict=True))
            x, y, c = np.repeat(ids.view(np.int64), k), other.view(np.int64), cos.view(np.float32)
            live = c > -5
            x, y, c = x[live], y[live], c[live]
            step = np.rint(c.astype(np.float64) * STEP).astype(np.int64)
            o = np.lexsort((y, -step, x))
            x, y, c = x[o], y[o], c[o]
            start = np.flatnonzero(np.diff(x, prepend=x[0] - 1 if len(x) else 0))
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
            # the same neighbour from several groups: equal up to a step, so keep its first place
            pair = np.lexsort((np.arange(len(x)), y, run))
            again = np.zeros(len(x), bool)
            again[pair[1:]] = (run[pair[1:]] == run[pair[:-1]]) & (y[pair[1:]] == y[pair[:-1]])
            x, y, c, run = x[~again], y[~again], c[~again], run[~again]
            start = np.flatnonzero(np.diff(run, prepend=-1))
            rank = np.arange(len(x)) - start[run] + 1 if len(x) else np.zeros(0, np.int64)
            top = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(x[top]), pa.array(y[top]), pa.array(rank[top].astype(np.int32)), pa.array(np.clip(c[top], -1, 1))], ["vec_id", "neighbour_id", "rank", "cosine"])

    found = laid.mapInArrow(local, "bucket int, ids binary, others binary, cos binary").repartitionById(buckets, F.col("bucket")).mapInArrow(merge, shape)
    if surplus.isEmpty():
        return found
    # beyond the indexed ids of a direction, a vector's neighbours are the k smallest of them
    same = V.attach(surplus, first.where(f"nth <= {k}").withColumnRenamed("vec_id", "neighbour_id"), "key", scratch, "best")
    return found.unionByName(same.selectExpr("vec_id", "neighbour_id", "cast(nth as int) as rank", "cast(1 as float) as cosine"))


def near_pairs(rows: DataFrame, least: float = 0.985, k: int = 5, band: float = 3e-5) -> DataFrame:
    """``(vec_id_a, vec_id_b)``, a < b, with a cosine of at least ``least``, one among the k nearest of the other.

    Pairs whose stored cosine is within ``band`` of the threshold are decided by the original values.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "pairs")
    near = nearest(rows, k).where(F.col("cosine") >= least - band)
    pairs = scratch.write(
        near.groupBy(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).agg(F.max("cosine").alias("c")),
        "pairs",
    )
    sure = pairs.where(F.col("c") > least + band).select("vec_id_a", "vec_id_b")
    edge = pairs.where(F.col("c") <= least + band).select("vec_id_a", "vec_id_b")
    n = edge.count()
    if n == 0:
        return sure
    ends = edge.selectExpr("explode(array(vec_id_a, vec_id_b)) as vec_id").distinct()
    real = rows.select("vec_id", "embeddings").join(F.broadcast(ends) if n <= V.BROADCAST_ROWS else ends, "vec_id", "left_semi")
    real = real.where(f"size(embeddings) = {V.DIM}").groupBy("vec_id").agg(F.first("embeddings").alias("e")).selectExpr("vec_id", "transform(e, x -> cast(x as double)) as e")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    checked = (
        edge.join(real.withColumnsRenamed({"vec_id": "vec_id_a", "e": "a"}), "vec_id_a")
        .join(real.withColumnsRenamed({"vec_id": "vec_id_b", "e": "b"}), "vec_id_b")
        .where(f"{dot.format('a', 'b')} / sqrt({dot.format('a', 'a')}) / sqrt({dot.format('b', 'b')}) >= {least}")
    )
    return sure.unionByName(checked.select("vec_id_a", "vec_id_b"))
