"""Token rows ``(pid, pos, vec)`` from arrays, NPY folders and data frames."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pid bigint, pos int, vec array<double>"


def from_arrays(spark: SparkSession, docs: Sequence[np.ndarray] | np.ndarray) -> DataFrame:
    """One ``[tokens, dim]`` array per document (a three-dimensional array works too); pids count from 0."""
    parts = [np.asarray(d, np.float64) for d in docs]
    parts = [p[0] if p.ndim == 3 else p for p in parts]
    if any(p.ndim != 2 for p in parts):
        raise ValueError("every document must be a two-dimensional array of token vectors")
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    flat = np.concatenate(parts)
    lens = [len(p) for p in parts]
    table = pa.table(
        {
            "pid": pa.array(np.repeat(np.arange(len(parts)), lens)),
            "pos": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lens])),
            "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel())),
        }
    )
    return spark.createDataFrame(table, SCHEMA)


def npy_files(path: str | Path) -> list[str]:
    """Data files of a folder: names with a number after the last underscore first, by number, then by name."""
    path = str(path)
    if os.path.isfile(path):
        return [path]
    names = [n for n in os.listdir(path) if n.endswith(".npy") and not n.endswith(".doclens.npy")]
    if not names:
        raise FileNotFoundError(f"no .npy files in {path}")

    def order(name: str):
        m = re.fullmatch(r".*_(\d+)\.npy", name)
        return (0, int(m[1]), name) if m else (1, 0, name)

    return [os.path.join(path, n) for n in sorted(names, key=order)]


def _doclens(file: str) -> np.ndarray:
    side = file[: -len(".npy")] + ".doclens.npy"
    if not os.path.exists(side):
        raise FileNotFoundError(f"{file} has no doclens file {side}")
    return np.load(side).astype(np.int64)


def from_npy(spark: SparkSession, path: str | Path, keep: DataFrame | None = None) -> DataFrame:
    """NPY files with doclens beside them, read by tasks of one file each; headers are checked first.

    ``keep`` (pid) reads only the files that own one of its documents, and of those only these documents.
    """
    plan, start = [], 0
    for f in npy_files(path):
        lens, shape = _doclens(f), np.load(f, mmap_mode="r").shape
        if len(shape) != 2 or int(lens.sum()) != shape[0]:
            raise ValueError(f"{f}: doclens add up to {int(lens.sum())}, the file has shape {shape}")
        plan.append((f, start, start + len(lens)))
        start += len(lens)
    files = spark.createDataFrame(plan, "file string, start bigint, stop bigint")
    if keep is not None:
        files = files.join(keep, (F.col("pid") >= F.col("start")) & (F.col("pid") < F.col("stop")), "left_semi")

    def read(batches):
        for b in batches:
            for f, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lens, data = _doclens(f), np.load(f, mmap_mode="r")
                at = 0
                for lo in range(0, len(lens), 1000):
                    part = lens[lo : lo + 1000]
                    n = int(part.sum())
                    rows = np.asarray(data[at : at + n], np.float64)
                    at += n
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(first + lo + np.arange(len(part)), part)),
                            pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in part]) if len(part) else np.zeros(0, np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * data.shape[1], pa.int32()), pa.array(rows.ravel())),
                        ],
                        ["pid", "pos", "vec"],
                    )

    rows = files.repartition(max(1, len(plan)), "file").mapInArrow(read, SCHEMA)
    return rows if keep is None else rows.join(keep, "pid", "left_semi")


def tokens_of(spark: SparkSession, source) -> DataFrame:
    """Any accepted source as token rows with dense pids from 0."""
    if isinstance(source, DataFrame):
        return source.selectExpr("cast(pid as bigint) as pid", "cast(pos as int) as pos", "transform(vec, x -> cast(x as double)) as vec")
    if isinstance(source, (str, Path)):
        return from_npy(spark, source)
    return from_arrays(spark, source)


def count_of(source, last: int | None) -> int:
    """Ids that a source takes up: documents without tokens count, and so do gaps in a frame."""
    if isinstance(source, (str, Path)):
        return sum(len(_doclens(f)) for f in npy_files(source))
    if isinstance(source, DataFrame):
        return 0 if last is None else int(last) + 1
    return len(source)


def pad_queries(queries) -> np.ndarray:
    """``[queries, tokens, dim]``: shorter queries are padded with zero tokens, which count as tokens."""
    if isinstance(queries, (list, tuple)):
        parts = [np.asarray(q, np.float64) for q in queries]
        parts = [p[0] if p.ndim == 3 else p for p in parts]
        out = np.zeros((len(parts), max(map(len, parts)), parts[0].shape[-1]))
        for i, p in enumerate(parts):
            out[i, : len(p)] = p
        return out
    q = np.asarray(queries, np.float64)
    if q.ndim == 2:
        q = q[None]
    if q.ndim != 3:
        raise ValueError(f"queries must have two or three dimensions, not {q.ndim}")
    return q


def query_rows(spark: SparkSession, queries: np.ndarray) -> DataFrame:
    b, t, d = queries.shape
    table = pa.table(
        {
            "qid": pa.array(np.repeat(np.arange(b), t)),
            "tok": pa.array(np.tile(np.arange(t, dtype=np.int32), b)),
            "vec": pa.ListArray.from_arrays(pa.array(np.arange(b * t + 1) * d, pa.int32()), pa.array(queries.ravel())),
        }
    )
    return spark.createDataFrame(table, "qid bigint, tok int, vec array<double>")
