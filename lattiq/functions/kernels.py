"""Arrow kernels for the two dense products of the engine: tokens by centroids, and postings by query tokens.

Both run inside ``mapInArrow`` over batches.  The codebook and the query batch are broadcast; both are bounded
(``MAX_CODEBOOK_BYTES`` is checked, and queries are searched in batches).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.functions import codec

MAX_CODEBOOK_BYTES = 1 << 30
BLOCK_BYTES = 64 << 20
"""Bytes of a block of products (rows by centroids, or rows by query tokens) in a task."""


def row_blocks(rows: int, width: int, item: int = 8):
    """Slices of rows whose products with ``width`` columns take about BLOCK_BYTES."""
    step = max(1, BLOCK_BYTES // max(1, width * item))
    return (slice(at, min(rows, at + step)) for at in range(0, rows, step))



def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def vectors(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


Codebook = tuple[np.ndarray, np.ndarray]


def codebook(centroids: DataFrame | Codebook, dtype=np.float64) -> Codebook:
    """``(cids, matrix)`` in order of cid, collected to the driver after a check of its size."""
    given = isinstance(centroids, tuple)
    n = len(centroids[0]) if given else centroids.count()
    dim = (centroids[1].shape[1] if given else len(centroids.first()["vec"])) if n else 0
    if n * dim * 8 > MAX_CODEBOOK_BYTES:
        raise ValueError(f"a codebook of {n} x {dim} is too large to broadcast")
    if given:
        return centroids
    rows = centroids.select("cid", "vec").orderBy("cid").toArrow().combine_chunks()
    return rows.column(0).combine_chunks().to_numpy(), matrix(rows.column(1).combine_chunks(), dtype)


def nearest_centroid(tokens: DataFrame, centroids: DataFrame | Codebook) -> DataFrame:
    """Adds ``cid, score, residual`` to rows with a double ``vec``: greatest inner product, ties to the lowest cid."""
    shared = tokens.sparkSession.sparkContext.broadcast(codebook(centroids))
    keep = [c for c in tokens.columns if c not in ("cid", "score", "residual")]

    def run(batches):
        cids, c = shared.value
        for b in batches:
            v = matrix(b.column(keep.index("vec")))
            cols = list(b.columns)
            if not len(v):
                cid, score, res = np.zeros(0, np.int32), np.zeros(0), np.zeros((0, c.shape[1]))
            else:
                at, score = np.empty(len(v), np.int64), np.empty(len(v))
                for rows in row_blocks(len(v), len(c)):
                    s = v[rows] @ c.T
                    at[rows] = s.argmax(1)
                    score[rows] = s[np.arange(len(s)), at[rows]]
                cid, res = cids[at].astype(np.int32), v - c[at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cid), pa.array(score), vectors(res, pa.float64())], [*keep, "cid", "score", "residual"])

    schema = tokens.select(*keep).schema.add("cid", T.IntegerType()).add("score", T.DoubleType()).add("residual", T.ArrayType(T.DoubleType()))
    return tokens.select(*keep).mapInArrow(run, schema)


def centroid_scores(queries: DataFrame, centroids: DataFrame | Codebook, keep: int | None = None) -> DataFrame:
    """``(qid, tok, cid, score, rn)``: the ``keep`` best centroids of each query token (all if None)."""
    shared = queries.sparkSession.sparkContext.broadcast(codebook(centroids))

    def run(batches):
        cids, c = shared.value
        for b in batches:
            v = matrix(b.column(2))
            if not len(v):
                continue
            k = len(c) if keep is None else min(keep, len(c))
            qid, tok = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows in row_blocks(len(v), len(c)):
                order, top = best_columns(v[rows] @ c.T, k)
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid[rows], k)), pa.array(np.repeat(tok[rows], k)), pa.array(cids[order].ravel().astype(np.int32)), pa.array(top.ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))],
                    ["qid", "tok", "cid", "score", "rn"],
                )

    return queries.select(F.col("qid").cast("bigint"), F.col("tok").cast("int"), "vec").mapInArrow(run, "qid bigint, tok int, cid int, score double, rn int")


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row in order, equal ones by the lower column; only a few columns are sorted."""
    if k < s.shape[1]:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        # everything above the k-th value, and of the columns equal to it the first ones
        above = s > least
        tie = s == least
        tie &= np.cumsum(tie, axis=1) <= k - above.sum(1, keepdims=True)
        cols = np.nonzero(above | tie)[1].reshape(len(s), k)
    else:
        cols = np.broadcast_to(np.arange(k), s.shape)
    top = np.take_along_axis(s, cols, 1)
    order = np.argsort(-top, axis=1, kind="stable")
    return np.take_along_axis(cols, order, 1), np.take_along_axis(top, order, 1)


@dataclass
class Probes:
    """A query batch: probed cells in order of cid, the token of each, and the token vectors."""

    cid: np.ndarray
    token: np.ndarray
    base: np.ndarray
    qid: np.ndarray
    tok: np.ndarray
    vecs: np.ndarray


def score_postings(postings: DataFrame, probes: Probes, weights: np.ndarray, nbits: int) -> DataFrame:
    """``(qid, tok, pid, score)``: the best score of a passage for a query token over the postings of a batch.

    ``postings`` has (cid, pid, res).  Residuals are unpacked by byte, and all tokens probing a cell are
    scored against its rows in one product; a passage keeps its best row per token before rows leave.
    """
    shared = postings.sparkSession.sparkContext.broadcast((probes, codec.byte_lookup(weights, nbits)))

    def run(batches):
        p, table = shared.value
        for b in batches:
            cid, pid = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            if not len(cid):
                continue
            order = np.argsort(cid, kind="stable")
            starts = np.flatnonzero(np.diff(cid[order], prepend=-1))
            packed = _bytes(b.column(2))
            out_t, out_p, out_s = [], [], []
            for a, z in zip(starts, np.append(starts[1:], len(cid)), strict=True):
                lo, hi = np.searchsorted(p.cid, [cid[order[a]], cid[order[a]] + 1])
                if lo == hi:
                    continue
                rows = order[a:z]
                res = table[packed[rows]].reshape(len(rows), -1)
                tokens = p.token[lo:hi]
                s = p.vecs[tokens] @ res.T + p.base[lo:hi, None]
                out_t.append(np.repeat(tokens, len(rows)))
                out_p.append(np.tile(pid[rows], len(tokens)))
                out_s.append(s.ravel())
            if not out_t:
                continue
            t, q, s = np.concatenate(out_t), np.concatenate(out_p), np.concatenate(out_s)
            o = np.lexsort((-s, q, t))
            t, q, s = t[o], q[o], s[o]
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1])
            t, q, s = t[first], q[first], s[first]
            yield pa.RecordBatch.from_arrays([pa.array(p.qid[t]), pa.array(p.tok[t]), pa.array(q), pa.array(s)], ["qid", "tok", "pid", "score"])

    return postings.select("cid", "pid", "res").mapInArrow(run, "qid bigint, tok int, pid bigint, score double")


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + column.offset + 1)[column.offset :]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def encode_tokens(assigned: DataFrame, cutoffs: np.ndarray, nbits: int) -> DataFrame:
    """Replaces ``residual`` by packed codes ``res`` and adds ``norm``, the length of the residual."""
    keep = [c for c in assigned.columns if c not in ("residual", "vec", "score")]

    def run(batches):
        for b in batches:
            r = matrix(b.column(len(keep)))
            if not len(r):
                r = np.zeros((0, 8))
            packed = codec.pack(codec.bucketize(r, cutoffs), nbits)
            n, w = packed.shape
            res = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], res, pa.array(np.sqrt((r * r).sum(1)))], [*keep, "res", "norm"])

    schema = assigned.select(*keep).schema.add("res", T.BinaryType()).add("norm", T.DoubleType())
    return assigned.select(*keep, "residual").mapInArrow(run, schema)
