"""The retrieval engine: create, load, search, filter, add, update, delete and compact an index.

An index is a folder of immutable tables.  Every mutation writes new tables under the next version and then makes
one small commit file; readers of the old version are not disturbed.  Postings, documents and metadata are lists of
segments, so an addition writes its own rows, and small segments of postings are joined as they pile up; compaction
folds all into one.

    <index>/_COMMITS/after=M    number of the version that follows M
    <index>/_CURRENT            number of the live version, or of an earlier one from which the commits lead on
    <index>/v=N/meta.json       statistics, codec and the paths of the tables below
    .../centroids .../postings (cid, pid, gen, res) .../docs (pid, gen, doclen, deleted) .../metadata
"""

from __future__ import annotations

import json
import numbers
import time
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import codec, kernels
from lattiq.functions.scratch import Scratch
from lattiq.operators import build, maintain, predicates, search
from lattiq.plans import parameters as rules
from lattiq.sources import tokens as src
from lattiq.sources.files import Files

HELD_OUT_SHARE, HELD_OUT_MOST = 0.05, 50_000
PROBE_ROWS = 4_000_000
"""Probed cells (query tokens times nprobe) that one broadcast may hold; larger batches are cut."""
COALESCE_DOCS = 2_000
SEGMENTS = 16
"""Segments of documents or metadata beyond which they are joined."""
ROWS_PER_FILE = 4_000_000


def probe_batch(cells: DataFrame, queries: DataFrame) -> kernels.Probes:
    """Probed cells and token vectors of one query batch as arrays (bounded by PROBE_ROWS)."""
    q = queries.select(F.col("qid").cast("bigint"), F.col("tok").cast("int"), "vec").toArrow().combine_chunks()
    c = cells.select(F.col("qid").cast("bigint"), F.col("tok").cast("int"), "cid", "score").distinct().toArrow().combine_chunks()
    column = lambda t, i: t.column(i).combine_chunks().to_numpy(zero_copy_only=False)
    qid, tok = column(q, 0), column(q, 1)
    order = np.lexsort((tok, qid))
    qid, tok, vecs = qid[order], tok[order], kernels.matrix(q.column(2).combine_chunks())[order]
    cq, ct, cid, score = (column(c, i) for i in range(4))
    span = int(tok.max()) + 1 if len(tok) else 1
    token = np.searchsorted(qid * span + tok, cq * span + ct)
    by_cell = np.argsort(cid, kind="stable")
    return kernels.Probes(cid[by_cell], token[by_cell], score[by_cell], qid, tok, vecs)


class Engine:
    """One index at a path (any file system Spark can write)."""

    def __init__(self, index: str, spark: SparkSession | None = None, device: str | None = None):
        self.index, self.device = str(index).rstrip("/"), device
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.files = Files(self.spark, self.index)
        self._loaded: dict | None = None

    # storage

    def _version(self) -> int:
        """The live version, the last one of the chain of commits; 0 where there is none.

        ``_CURRENT`` is where the chain is entered; if it is missing or behind, the commits lead to the same version.
        """
        version = int(self.files.read("_CURRENT")) if self.files.exists("_CURRENT") else 0
        while self.files.exists(f"_COMMITS/after={version}"):
            version = int(self.files.read(f"_COMMITS/after={version}"))
        return version

    def _next(self) -> int:
        """A version that nobody has begun: abandoned ones are not written over."""
        return max([0, *(int(n[2:]) for n in self.files.names() if n.startswith("v=") and n[2:].isdigit())]) + 1

    def meta(self) -> dict:
        """Statistics of the live version, always read fresh."""
        version = self._version()
        if not version:
            raise FileNotFoundError(f"no index at {self.index}")
        return json.loads(self.files.read(f"v={version}/meta.json"))

    def _commit(self, version: int, meta: dict, before: int) -> None:
        """Make a version the live one.  The commit that follows a version can be made only once, so of two writers
        that began from the same version one fails, and nothing is written over."""
        self.files.write(f"v={version}/meta.json", json.dumps(meta))
        self.files.write(f"_COMMITS/after={before}", str(version), replace=False)
        self.files.write("_CURRENT", str(version))

    def _store(self, df: DataFrame, version: int, name: str) -> str:
        path = f"v={version}/{name}"
        df.write.mode("overwrite").parquet(f"{self.index}/{path}")
        return path

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.index}/{p}" for p in paths))

    def _store_postings(self, postings: DataFrame, rows: int, version: int) -> str:
        return self._store(build.sorted_postings(postings.select("cid", "pid", "gen", "res"), max(1, -(-rows // ROWS_PER_FILE))), version, "postings")

    def _appended(self, segments: list[str], counts: dict[str, int], new: DataFrame, rows: int, version: int) -> tuple[list[str], dict[str, int]]:
        """Segments with new rows after them.  A last segment that is not much larger than what is written is joined
        with it, up to ROWS_PER_FILE rows, so there are few small ones and a row is rewritten a few times at most."""
        kept = list(segments)
        while kept and counts.get(kept[-1], ROWS_PER_FILE) <= min(2 * rows, ROWS_PER_FILE - rows):
            rows += counts[kept[-1]]
            new = new.select("cid", "pid", "gen", "res").unionByName(self._read(kept.pop()).select("cid", "pid", "gen", "res"))
        path = self._store_postings(new, rows, version)
        return [*kept, path], {k: v for k, v in counts.items() if k in kept} | {path: rows}

    # creation

    def create(
        self, embeddings_source, device: str | None = None, kmeans_niters: int = 4, max_points_per_centroid: int = 256, nbits: int = 4, n_samples_kmeans: int | None = None,
        seed: int = 42, metadata: Sequence[Mapping] | DataFrame | None = None, num_partitions: int | None = None,
        centroids: kernels.Codebook | DataFrame | None = None, buckets: tuple[Sequence[float], Sequence[float]] | None = None,
    ) -> Engine:
        """Build an index from documents; accepts arrays, an NPY folder or a frame (pid, pos, vec).

        Ids of arrays and folders count from 0; documents without tokens keep theirs.  Ids of a frame are taken as they
        are, gaps included, and the next addition continues after the greatest.  ``centroids`` and ``buckets``
        (cutoffs, weights) are trained where they are not given.
        """
        self.device = device or self.device
        scratch = Scratch(self.spark, "create")
        tokens = scratch.write(src.tokens_of(self.spark, embeddings_source), "tokens")
        first = tokens.select("vec").first()
        if first is None:
            raise ValueError("an index needs at least one token vector")
        dim = len(first.vec)
        codec.check_layout(dim, nbits)
        docs = build.doc_lengths(tokens)
        n_docs, n_tokens, last = docs.agg(F.count(F.lit(1)), F.sum("doclen"), F.max("pid")).first()
        given = src.count_of(embeddings_source, last)
        if metadata is not None and not isinstance(metadata, DataFrame) and len(metadata) != given:
            raise ValueError(f"{len(metadata)} metadata rows for {given} documents")

        sampled = build.sample_documents(tokens, n_samples_kmeans or rules.sample_size(n_docs), seed)
        sample = scratch.write(tokens.join(sampled, "pid", "left_semi"), "sample")
        sample_docs, sample_tokens = sample.agg(F.countDistinct("pid"), F.count(F.lit(1))).first()
        wanted = num_partitions or rules.partitions_for(sample_tokens / sample_docs * n_docs)
        if centroids is None:
            book = self._train(sample, rules.power_of_two(min(wanted, sample_tokens)), kmeans_niters, max_points_per_centroid, seed)
        else:
            book = kernels.codebook(centroids)

        held = max(1, round(min(HELD_OUT_SHARE * sample_tokens, HELD_OUT_MOST)))
        tail = sample.orderBy(F.xxhash64("pid", "pos", F.lit(seed + 1))).limit(held)
        residuals = scratch.write(kernels.nearest_centroid(tail, book), "held_out")
        quant = build.bucket_quantiles(residuals, nbits).first() if buckets is None else Row(cutoffs=list(buckets[0]), weights=list(buckets[1]))
        threshold = build.nearest_rank(build.residual_norms(residuals)).first().threshold
        spread = [r.avg_abs for r in build.mean_abs_residual(residuals).orderBy("dim").collect()]  # dim rows

        coded = kernels.encode_tokens(kernels.nearest_centroid(tokens, book), np.array(quant.cutoffs), nbits).withColumn("gen", F.lit(0))
        before, version = self._version(), self._next()
        paths = {
            "centroids": self._store(self._book_frame(book), version, "centroids"),
            "postings": [self._store_postings(coded, n_tokens, version)],
            "docs": [self._store(docs.selectExpr("pid", "0 as gen", "doclen", "false as deleted"), version, "docs")],
            "metadata": [],
        }
        if metadata is not None and (isinstance(metadata, DataFrame) or len(metadata)):
            paths["metadata"] = [self._store(self._metadata_frame(metadata, 0), version, "metadata")]
        self._commit(
            version,
            {
                "num_chunks": max(1, -(-n_docs // build.CHUNK_DOCS)), "last_chunk_docs": (n_docs - 1) % build.CHUNK_DOCS + 1, "nbits": nbits,
                "num_partitions": rules.partitions_for(n_tokens), "num_embeddings": n_tokens, "avg_doclen": n_tokens / n_docs, "num_passages": n_docs,
                "next_passage_id": given, "num_centroids": len(book[0]), "dim": dim, "created_at": time.time(), "cutoffs": list(quant.cutoffs),
                "weights": list(quant.weights), "avg_residual": spread, "cluster_threshold": threshold, "paths": paths, "streams": {},
                "rows": {paths["postings"][0]: n_tokens},
            },
            before,
        )
        return self

    def _train(self, sample: DataFrame, k: int, rounds: int, per_centroid: int, seed: int) -> kernels.Codebook:
        """Unit-length k-means centres from at most ``per_centroid`` points a centroid."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n, most = sample.count(), per_centroid * k
        points = sample if n <= most else sample.where(F.expr(f"pmod(xxhash64(pid, pos, {int(seed)}), 1000000) < {most / n * 1e6}"))  # about ``most``, no order
        points = points.select(array_to_vector("vec").alias("features"))
        if k > 1:
            centres = np.array(KMeans(k=k, maxIter=rounds, seed=seed, initMode="random").fit(points).clusterCenters())
        else:  # one centre is the mean, which KMeans declines to compute
            from pyspark.ml.stat import Summarizer

            centres = points.select(Summarizer.mean(F.col("features")).alias("m")).first().m.toArray()[None]
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        return np.arange(len(centres), dtype=np.int32), (centres / np.where(length > 0, length, 1)).astype(np.float32).astype(np.float64)

    def _book_frame(self, book: kernels.Codebook) -> DataFrame:
        table = pa.table({"cid": pa.array(book[0].astype(np.int32)), "vec": kernels.vectors(book[1], pa.float64())})
        return self.spark.createDataFrame(table, "cid int, vec array<double>").coalesce(1)

    def _metadata_frame(self, metadata, start: int) -> DataFrame:
        """Rows keyed ``_passage_id``; keys missing in some rows become nulls, nested dicts become structs."""
        if isinstance(metadata, DataFrame):
            return metadata
        keys = list(dict.fromkeys(k for m in metadata for k in m))
        rows = [{"_passage_id": start + i} | {k: m.get(k) for k in keys} for i, m in enumerate(metadata)]
        return self.spark.createDataFrame(pa.Table.from_pylist(rows))

    # loading

    def load(self, device=None, dtype=None, mmap: bool = True) -> Engine:
        """Open the live version: codebook and cell sizes to the driver, postings kept in memory and on disk."""
        if self._loaded is not None:
            warnings.warn("the index is already loaded", stacklevel=2)
            self.free()
        meta = self.meta()
        docs = self._read(*meta["paths"]["docs"])
        postings = self._read(*meta["paths"]["postings"])
        if meta.get("replaced"):  # only a replaced document leaves postings of an older generation
            postings = maintain.live(postings, docs)
        postings = postings.persist()
        book = kernels.codebook(self._read(meta["paths"]["centroids"]))
        counts = {r.cid: r.n for r in postings.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per centroid
        sizes = [(int(c), int(counts.get(c, 0))) for c in book[0]]
        self._loaded = {
            "meta": meta, "book": book, "postings": postings, "docs": docs, "sizes": self.spark.createDataFrame(sizes, "cid int, size bigint").coalesce(1),
            "metadata": self._metadata_table(meta), "args": (device, dtype, mmap),
        }
        return self

    def free(self) -> None:
        if self._loaded is not None:
            self._loaded["postings"].unpersist()
            self._loaded = None

    @property
    def loaded(self) -> bool:
        return self._loaded is not None

    def _open(self) -> dict:
        if self._loaded is None:
            raise RuntimeError("Index not loaded, call load() first")
        return self._loaded

    def _reload(self, reload: bool) -> None:
        if self._loaded is not None:
            args = self._loaded["args"]
            self.free()
            if reload:
                self.load(*args)

    # search

    def optimize_hyperparams(self, top_k: int, queries) -> tuple[int, int, float, int, int]:
        return rules.search_parameters(self._open()["meta"], top_k, src.pad_queries(queries).shape[1])

    def search_frame(self, queries: DataFrame, top_k: int, params: search.Parameters, subset: DataFrame | None = None) -> DataFrame:
        """``(qid, rank, pid, score)`` for query tokens (qid, tok, vec) of one batch: at most PROBE_ROWS probed cells."""
        at = self._open()
        p = params.clamped(len(at["book"][0]))
        if queries.count() * p.nprobe > PROBE_ROWS:
            raise ValueError(f"more than {PROBE_ROWS} probed cells in one batch of queries; cut it, or use search()")
        scores = kernels.centroid_scores(search.live_tokens(queries), at["book"], p.bound)
        picked = Scratch(self.spark, "search").write(search.selected(scores, at["sizes"], p), "picked")
        batch = probe_batch(search.probes(picked, queries, at["sizes"], p), queries)
        found = search.missing_estimates(picked, p)
        estimates = queries.select("qid", "tok").join(found, ["qid", "tok"], "left").na.fill(0.0, ["m"])
        postings = at["postings"]
        cells = np.unique(batch.cid)
        if len(cells) < len(at["book"][0]):
            wanted = self.spark.createDataFrame(pa.table({"cid": pa.array(cells.astype(np.int32))}), "cid int")
            postings = postings.join(F.broadcast(wanted), "cid", "left_semi")  # at most one row per centroid
        if subset is not None and "qid" not in subset.columns:
            postings = search.only(postings, subset)
        scored = kernels.score_postings(postings, batch, np.array(at["meta"]["weights"]), at["meta"]["nbits"])
        if subset is not None and "qid" in subset.columns:
            scored = search.only(scored, subset)
        totals = search.merge_sum(search.merge_max(scored), estimates)
        return search.top_k(search.living(totals, at["docs"].where("deleted").select("pid")), top_k)

    def search(
        self, queries_embeddings, top_k: int, num_threads: int | None = None, bound: int | None = None, t_prime: int | None = None, nprobe: int | None = None,
        max_candidates: int | None = None, centroid_score_threshold: float | None = None, batch_size: int | None = 8192, subset=None,
    ) -> list[list[tuple[int, float]]]:
        """Lists of (passage id, score) per query, best first.

        ``max_candidates`` and ``num_threads`` are accepted as hints: ordering is exact and Spark schedules.
        ``subset`` is a list of ids, one list of ids per query, or a frame (pid) or (qid, pid).
        """
        self._open()
        if isinstance(queries_embeddings, (list, tuple)) and not queries_embeddings:
            return []
        queries = src.pad_queries(queries_embeddings)
        n, t, _ = queries.shape
        auto = self.optimize_hyperparams(top_k, queries)
        pick = lambda given, i: auto[i] if given is None else given
        params = search.Parameters(pick(nprobe, 1), pick(bound, 0), pick(centroid_score_threshold, 2), pick(t_prime, 4))
        kept = self._subset(subset, n)
        out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        step = max(1, min(batch_size or n, PROBE_ROWS // max(1, t * params.nprobe)))
        for at in range(0, n, step):
            frame = src.query_rows(self.spark, queries[at : at + step])
            part = kept
            if kept is not None and "qid" in kept.columns:
                part = kept.where(F.col("qid").between(at, at + step - 1)).withColumn("qid", F.col("qid") - at)
            for r in self.search_frame(frame, top_k, params, part).orderBy("qid", "rank").collect():  # top_k rows a query
                out[at + r.qid].append((r.pid, r.score))
        return out

    def _subset(self, subset, n: int) -> DataFrame | None:
        if subset is None or isinstance(subset, DataFrame):
            return subset
        subset = list(subset)
        ints = pa.int64()
        if all(isinstance(s, numbers.Integral) for s in subset):
            return self.spark.createDataFrame(pa.table({"pid": pa.array([int(s) for s in subset], ints)}), "pid bigint").distinct()
        if len(subset) != n:
            raise ValueError(f"{len(subset)} subsets for {n} queries")
        pairs = [(i, int(p)) for i, ids in enumerate(subset) for p in ids]
        return self.spark.createDataFrame(pa.table({"qid": pa.array([a for a, _ in pairs], ints), "pid": pa.array([b for _, b in pairs], ints)}), "qid bigint, pid bigint").distinct()

    # metadata

    def filter_frame(self, condition: str, parameters: Sequence | None = None) -> DataFrame:
        """Matching ids as a lazy frame (pid), ready to be a subset."""
        store = self._open()["metadata"] if self._loaded else None
        if store is None:
            raise RuntimeError("No metadata available; give it to create() or add() and load the index")
        return predicates.matching(store, condition, parameters).selectExpr("_passage_id as pid")

    def filter(self, condition: str, parameters: Sequence | None = None) -> list[int]:
        return [r.pid for r in self.filter_frame(condition, parameters).collect()]

    def get_metadata(self, passage_ids: Sequence[int] | None = None) -> list[dict]:
        store = self._open()["metadata"]
        if store is None:
            return []
        if passage_ids is not None:
            ids = self.spark.createDataFrame([(int(p),) for p in passage_ids], "_passage_id bigint")
            store = store.join(ids, "_passage_id", "left_semi")
        return [r.asDict(True) for r in store.collect()]

    def _metadata_table(self, meta: dict) -> DataFrame | None:
        parts = [self._read(p) for p in meta["paths"]["metadata"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    # mutation

    def _encode(self, source, meta: dict, scratch: Scratch, pid_of) -> tuple[DataFrame, kernels.Codebook]:
        """Coded rows of new documents under their final ids, stored, with their residual norms."""
        tokens = scratch.write(pid_of(src.tokens_of(self.spark, source)), "tokens")
        book = kernels.codebook(self._read(meta["paths"]["centroids"]))
        assigned = kernels.nearest_centroid(tokens, book)
        return scratch.write(kernels.encode_tokens(assigned, np.array(meta["cutoffs"]), meta["nbits"]), "coded"), book

    def add(
        self, embeddings_source, reload: bool = True, min_outliers: int = 50, max_growth_rate: float = 0.1, max_points_per_centroid: int = 256, metadata: Sequence[Mapping] | None = None,
        names: DataFrame | None = None, stream: tuple[str, int] | None = None,
    ) -> range:
        """Append documents; returns their ids, which continue the watermark and are never reused.

        Documents without tokens get an id like all others.  ``names`` (pid from 0, doc_id) is kept as metadata, so
        that callers find their documents again.  ``stream`` (name, batch number) is stored with the version: a
        batch that was committed before adds nothing.

        Tokens far from every centroid may add (empty) centroids, and the outlier threshold is blended.
        """
        meta = self.meta()
        if stream is not None and stream[1] <= meta.get("streams", {}).get(stream[0], -1):
            return range(0)
        if hasattr(embeddings_source, "__len__") and len(embeddings_source) == 0:
            return range(0)
        start = meta["next_passage_id"]
        scratch = Scratch(self.spark, "add")
        coded, book = self._encode(embeddings_source, meta, scratch, lambda t: t.withColumn("pid", F.col("pid") + start))
        docs = scratch.write(build.doc_lengths(coded), "docs")
        n_docs, n_tokens, last = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("doclen"), F.lit(0)), F.max("pid")).first()
        given = src.count_of(embeddings_source, None if last is None else last - start)
        if not given:
            return range(start, start)
        if metadata is not None and len(metadata) != given:
            raise ValueError(f"{len(metadata)} metadata rows for {given} documents")
        before, version = self._version(), self._next()
        paths = dict(meta["paths"])
        paths["postings"], counts = self._appended(paths["postings"], meta.get("rows", {}), coded.withColumn("gen", F.lit(0)), n_tokens, version)
        paths["docs"] = [*paths["docs"], self._store(docs.selectExpr("pid", "0 as gen", "doclen", "false as deleted"), version, "docs")]
        if len(paths["docs"]) > SEGMENTS:
            paths["docs"] = [self._store(self._read(*paths["docs"]), version, "all_docs")]
        if metadata or names is not None:
            rows = self._metadata_frame(metadata, start) if metadata else None
            if names is not None:
                named = names.select((F.col("pid") + start).alias("_passage_id"), "doc_id")
                rows = named if rows is None else rows.join(named, "_passage_id", "left")
            paths["metadata"] = [*paths["metadata"], self._store(rows, version, "metadata")]
            if len(paths["metadata"]) > SEGMENTS:
                paths["metadata"] = [self._store(self._metadata_table({"paths": paths}), version, "all_metadata")]

        far = maintain.outliers(coded, meta["cluster_threshold"])
        grow = 0 if isinstance(embeddings_source, (str, Path)) else maintain.growth(far.count(), meta["num_centroids"], min_outliers, max_growth_rate, max_points_per_centroid)
        if grow:
            points = self.spark.read.parquet(f"{scratch.root}/tokens").join(far.select("pid", "pos"), ["pid", "pos"], "left_semi")
            more = self._train(points, grow, 4, max_points_per_centroid, 42)
            book = (np.arange(len(book[0]) + grow, dtype=np.int32), np.concatenate([book[1], more[1]]))
            paths["centroids"] = self._store(self._book_frame(book), version, "centroids")
        tail = coded if n_tokens <= HELD_OUT_MOST else coded.where(F.expr(f"pmod(xxhash64(pid, pos, 42), 1000000) < {HELD_OUT_MOST / n_tokens * 1e6}"))
        linear = build.linear_rank(tail).first().threshold or 0.0  # no token, no weight
        total = meta["num_embeddings"] + n_tokens
        passages = meta["num_passages"] + n_docs
        # a small last chunk is filled up before new ones are begun
        joined = n_docs + (meta["last_chunk_docs"] if meta["last_chunk_docs"] < COALESCE_DOCS else 0)
        kept = meta["num_chunks"] - (meta["last_chunk_docs"] < COALESCE_DOCS)
        meta |= {
            "num_embeddings": total, "num_passages": passages, "avg_doclen": total / passages, "next_passage_id": start + given, "num_centroids": len(book[0]),
            "num_chunks": kept + max(1, -(-joined // build.CHUNK_DOCS)), "last_chunk_docs": (joined - 1) % build.CHUNK_DOCS + 1,
            "cluster_threshold": maintain.blended(meta["cluster_threshold"], total - n_tokens, linear, n_tokens), "paths": paths, "rows": counts,
        }
        if stream is not None:
            meta["streams"] = {**meta.get("streams", {}), stream[0]: stream[1]}
        self._commit(version, meta, before)
        self._reload(reload)
        return range(start, start + given)

    def update(self, passage_ids: Sequence[int], embeddings_source, reload: bool = True) -> Engine:
        """New vectors under the same ids; a tombstone on them is lifted, metadata stays."""
        ids = [int(p) for p in passage_ids]
        meta = self.meta()
        if len(set(ids)) != len(ids):
            raise ValueError("an id is given twice")
        if not isinstance(embeddings_source, (DataFrame, str, Path)) and len(embeddings_source) != len(ids):
            raise ValueError(f"{len(embeddings_source)} documents for {len(ids)} ids")
        if not ids:
            return self
        scratch = Scratch(self.spark, "update")
        names = self.spark.createDataFrame(list(enumerate(ids)), "pid bigint, target bigint")
        old = self._read(*meta["paths"]["docs"])
        known = old.join(names.selectExpr("target as pid"), "pid", "left_semi").count()
        if known != len(ids):
            raise ValueError(f"{len(ids) - known} of the ids are unknown")
        coded, _ = self._encode(embeddings_source, meta, scratch, lambda t: t.join(names, "pid").selectExpr("target as pid", "pos", "vec"))
        fresh = scratch.write(
            build.doc_lengths(coded).join(old.select("pid", "gen"), "pid").selectExpr("pid", "gen + 1 as gen", "doclen", "false as deleted"), "docs"
        )
        before, version = self._version(), self._next()
        paths = dict(meta["paths"])
        rows = coded.join(fresh.select("pid", "gen"), "pid")
        paths["postings"], counts = self._appended(paths["postings"], meta.get("rows", {}), rows, coded.count(), version)
        paths["docs"] = [self._store(maintain.replaced(old, fresh), version, "docs")]
        total = self._read(*paths["docs"]).agg(F.sum("doclen")).first()[0]
        meta |= {"num_embeddings": total, "avg_doclen": total / meta["num_passages"], "paths": paths, "rows": counts, "replaced": True}
        self._commit(version, meta, before)
        self._reload(reload)
        return self

    def delete(self, passage_ids: Sequence[int], compact_threshold: float | None = 0.2) -> Engine:
        """Tombstone documents; compacts by itself once their share reaches the threshold."""
        meta = self.meta()
        ids = self.spark.createDataFrame([(int(p),) for p in passage_ids], "pid bigint")
        before, version = self._version(), self._next()
        paths = dict(meta["paths"])
        paths["docs"] = [self._store(maintain.delete(self._read(*paths["docs"]), ids), version, "docs")]
        store = self._metadata_table(meta)
        if store is not None:
            paths["metadata"] = [self._store(store.join(ids.withColumnRenamed("pid", "_passage_id"), "_passage_id", "left_anti"), version, "metadata")]
        self._commit(version, meta | {"paths": paths}, before)
        gone = self._read(*paths["docs"]).where("deleted").count()
        if compact_threshold is not None and meta["num_passages"] > 0 and gone / (meta["num_passages"] + gone) >= compact_threshold:
            self.compact()
        else:
            self._reload(True)
        return self

    def compact(self, reload: bool = True) -> Engine:
        """Rewrite without deleted and superseded rows, drop unused centroids and recalibrate."""
        meta = self.meta()
        scratch = Scratch(self.spark, "compact")
        docs = self._read(*meta["paths"]["docs"])
        kept = docs.where("not deleted")
        postings = maintain.compacted(self._read(*meta["paths"]["postings"]), docs)
        centroids = self._read(meta["paths"]["centroids"])
        mapping = scratch.write(build.prune_empty(centroids, postings), "mapping")
        before, version = self._version(), self._next()
        n_tokens, n_docs = kept.agg(F.coalesce(F.sum("doclen"), F.lit(0)), F.count(F.lit(1))).first()
        paths = dict(meta["paths"])
        paths["postings"] = [self._store_postings(maintain.renumbered(postings, mapping), n_tokens, version)]
        paths["docs"] = [self._store(kept, version, "docs")]
        if n_tokens:
            paths["centroids"] = self._store(maintain.renumbered(centroids, mapping).select("cid", "vec").coalesce(1), version, "centroids")
        store = self._metadata_table(meta)
        if store is not None:
            paths["metadata"] = [self._store(store.join(docs.where("deleted").selectExpr("pid as _passage_id"), "_passage_id", "left_anti"), version, "metadata")]
        meta |= {
            "num_embeddings": n_tokens, "num_passages": n_docs, "avg_doclen": n_tokens / n_docs if n_docs else 0.0, "paths": paths,
            "num_centroids": mapping.count() if n_tokens else meta["num_centroids"], "num_chunks": max(1, -(-n_docs // build.CHUNK_DOCS)),
            "last_chunk_docs": (n_docs - 1) % build.CHUNK_DOCS + 1 if n_docs else 0, "replaced": False, "rows": {paths["postings"][0]: n_tokens},
        }
        if n_tokens:
            meta |= self._recalibrate(paths["postings"][0], meta)
        self._commit(version, meta, before)
        self._reload(reload)
        return self

    def _recalibrate(self, path: str, meta: dict) -> dict:
        """Threshold and mean residual from the stored codes of at most HELD_OUT_MOST rows."""
        rows = self._read(path).orderBy(F.xxhash64("pid", "cid")).limit(HELD_OUT_MOST).select("res").toArrow().column(0).combine_chunks()
        values = np.array(meta["weights"])[codec.unpack(kernels._bytes(rows), meta["nbits"])]
        norms = np.sort(np.sqrt((values**2).sum(1)))
        return {"cluster_threshold": float(norms[-(-len(norms) * 3 // 4) - 1]), "avg_residual": np.abs(values).mean(0).tolist()}

    # planning

    def estimate_index_memory(self) -> dict[str, int]:
        m = self.meta()
        return maintain.memory_estimate(m["num_embeddings"], m["num_centroids"], m["dim"], m["nbits"])

    def recommend_device_map(self, devices: list[str]) -> dict[str, float]:
        est = self.estimate_index_memory()
        return rules.device_ratios(devices, est["pids"] + est["residuals"])

    def shard_boundaries(self, ratios: Sequence[float]) -> list[tuple[int, int, int]]:
        """``(shard, first cid, end cid)`` by cumulative embeddings."""
        return [tuple(r) for r in build.shard_of(self._open()["sizes"], list(ratios)).collect()]
