"""Fixed-size uniform sample from data that arrives in pieces of unknown total (problem 6).

Method: pieces are counted after their arrival, not before.  The distinct documents are laid out in leaves by a
hash of the id; the leaf counts form the bottom of a binary partition tree.  From the root down, the sample size
k is split between the two children by a hypergeometric draw, which is exactly how a uniform sample of k falls
on them.  Inside a leaf, sequential selection sampling takes exactly its quota in one pass over the ids in
order: an id is taken with probability (still wanted) / (still to come).

Every distinct id is equally likely whatever its length or number of copies.  The result depends only on the
seed and the data, so a retried task repeats it.  If there are fewer than k documents all are returned; k = 0
or no documents give no rows.  Null ids and null or empty pieces hold no documents; of several mentions of an
id the earliest arrival counts.  A missing doclen is 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

LEAF = 100_000
"""Documents of a leaf, about; there are at most MAX_LEAVES leaves, so a leaf grows beyond that."""
MAX_LEAVES = 65_536
BLOCK = 1_024
"""Positions tested one by one inside a leaf; larger blocks take a hypergeometric share."""


def documents_of(pieces: DataFrame) -> DataFrame:
    """Distinct documents ``(pid, piece_id, pos, doclen)`` of the pieces, copies of a piece and of an id settled."""
    # elements travel, not lists: a row carries its own id and length only (lists may differ in length)
    zipped = pieces.where("size(pids) > 0").selectExpr("piece_id", "arrived_at", "arrays_zip(pids, slice(coalesce(doclens, array()), 1, size(pids))) as z")
    mention = zipped.selectExpr("piece_id", "arrived_at", "posexplode(z) as (pos, e)").selectExpr("piece_id", "arrived_at", "pos", "e.pids as pid", "coalesce(e['1'], 0L) as doclen").where("pid is not null")
    first = mention.groupBy("pid").agg(F.min(F.struct("arrived_at", "piece_id", "pos", "doclen")).alias("m"))
    return first.selectExpr("pid", "m.piece_id as piece_id", "m.pos as pos", "m.doclen as doclen")


def split(counts: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of the leaves: k divided down a binary tree by hypergeometric draws."""
    quota = np.zeros(len(counts), np.int64)
    below = np.concatenate([[0], np.cumsum(counts)])
    todo = [(0, len(counts), min(k, int(below[-1])))]
    while todo:
        lo, hi, want = todo.pop()
        if want == 0 or lo == hi:
            continue
        if hi - lo == 1:
            quota[lo] = want
            continue
        mid = (lo + hi) // 2
        left, right = int(below[mid] - below[lo]), int(below[hi] - below[mid])
        got = _hypergeometric(rng, left, right, want)
        todo += [(lo, mid, got), (mid, hi, want - got)]
    return quota


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn without return are good; exact at any size.

    The generator has a limit on its arguments.  Beyond it the draw goes by inversion outward from the mode, whose
    probability follows from log-factorials and whose neighbours from ratios; a few standard deviations are visited.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    at = math.exp(_log_choose(good, mode) + _log_choose(bad, n - mode) - _log_choose(good + bad, n))
    u, left, right, p_left, p_right = rng.random() - at, mode, mode, at, at
    if u <= 0:
        return mode
    while True:
        stuck = True
        if right < hi and p_right > 0:
            p_right *= (good - right) / (right + 1) * ((n - right) / (bad - n + right + 1))
            right, u, stuck = right + 1, u - p_right, False
            if u <= 0:
                return right
        if left > lo and p_left > 0:
            p_left *= left / (good - left + 1) * ((bad - n + left) / (n - left + 1))
            left, u, stuck = left - 1, u - p_left, False
            if u <= 0:
                return left
        if stuck:  # what rounding left of the unit interval
            return mode


def _log_choose(n: int, k: int) -> float:
    """Logarithm of a binomial coefficient, from the difference of log-gammas without their large common part."""
    k = min(k, n - k)
    if k == 0:
        return 0.0
    if k < 256:
        return sum(math.log((n - i) / (k - i)) for i in range(k))
    m = n - k
    tail = lambda v: 1 / (12 * v) - 1 / (360 * v**3)
    return -m * math.log1p(-k / n) + k * math.log(n / k) + 0.5 * math.log(n / (2 * math.pi * k * m)) + tail(n) - tail(k) - tail(m)


def select(n: int, want: int, rng: np.random.Generator) -> np.ndarray:
    """Positions, in order, of a uniform sample of ``want`` from ``n``: sequential selection, a block at a time.

    A block of positions takes a hypergeometric share of what is still wanted, which is what one test per item (taken
    with probability (still wanted) / (still to come)) amounts to; shares are divided on until blocks are small, and
    inside a block each item is tested.
    """
    out = []
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        got = _hypergeometric(rng, size, n - at - size, want)
        want -= got
        if got:
            out.append(at + np.sort(_tested(size, got, rng)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _tested(n: int, want: int, rng: np.random.Generator) -> np.ndarray:
    """``want`` of ``n`` positions, items taken while they are still wanted (n is at most BLOCK)."""
    taken, rest = [], want
    for i, u in enumerate(rng.random(n).tolist()):
        if u * (n - i) < rest:
            taken.append(i)
            rest -= 1
            if not rest:
                break
    return np.array(taken, np.int64)


def sample(pieces: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``(pid, piece_id, pos, doclen)`` of k documents."""
    spark = pieces.sparkSession
    docs = documents_of(pieces)
    scratch = Scratch(spark, "sampling")
    # leaves by hash; their number follows from the count after arrival
    stored = scratch.write(docs, "documents")
    total = stored.count()
    leaves = int(min(MAX_LEAVES, max(1, -(-total // LEAF))))
    laid = stored.withColumn("leaf", F.expr(f"cast(pmod(xxhash64(pid, {int(seed)}), {leaves}) as int)"))
    counts = np.zeros(leaves, np.int64)
    for leaf, n in laid.groupBy("leaf").count().collect():  # at most MAX_LEAVES rows
        counts[leaf] = n
    quota = split(counts, k, np.random.default_rng([seed, 1]))
    given = spark.sparkContext.broadcast((counts, quota))

    def take(batches):
        counts, quota = given.value
        leaf, seen, wanted = -1, 0, np.zeros(0, np.int64)
        for b in batches:
            of = np.asarray(b.column(4))
            edges = np.flatnonzero(np.diff(of, prepend=-1 if not len(of) else of[0] - 1))
            keep = np.zeros(len(of), bool)
            for a, z in zip(edges, np.append(edges[1:], len(of)), strict=True):
                if of[a] != leaf:
                    leaf, seen = int(of[a]), 0
                    wanted = select(int(counts[leaf]), int(quota[leaf]), np.random.default_rng([seed, 2, leaf]))
                lo, hi = np.searchsorted(wanted, [seen, seen + z - a])
                keep[a + wanted[lo:hi] - seen] = True
                seen += int(z - a)
            yield pa.Table.from_batches([b]).filter(pa.array(keep)).select([0, 1, 2, 3]).combine_chunks().to_batches()[0] if keep.any() else b.slice(0, 0).select([0, 1, 2, 3])

    placed = laid.select("pid", "piece_id", "pos", "doclen", "leaf").repartition("leaf").sortWithinPartitions("leaf", "pid")
    return placed.mapInArrow(take, stored.schema)


def with_vectors(chosen: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds ``vectors``, the token vectors of each sampled document, from its piece."""
    wanted = pieces.join(chosen.select("piece_id").distinct(), "piece_id", "left_semi")  # other pieces stay where they are
    bodies = wanted.groupBy("piece_id").agg(F.first("doclens", True).alias("doclens"), F.first("embeddings", True).alias("embeddings"))
    # a body is read once for all its sampled documents (k at most), never copied to each of them
    asked = chosen.groupBy("piece_id").agg(F.collect_list(F.struct("pid", "pos", "doclen")).alias("asked"))
    cut = "slice(embeddings, cast(1 + aggregate(slice(doclens, 1, c.pos), 0L, (s, x) -> s + coalesce(x, 0L)) as int), cast(c.doclen as int))"
    return asked.join(bodies, "piece_id").selectExpr(
        "piece_id", f"inline(transform(asked, c -> struct(c.pid as pid, c.pos as pos, c.doclen as doclen, {cut} as vectors)))"
    ).select("pid", "piece_id", "pos", "doclen", "vectors")
