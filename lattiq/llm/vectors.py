"""Vectors as compact rows, posting lists around heads, and the exchange that brings neighbours together.

A usable vector has the given number of values, all finite and not all zero.  It is stored by direction: 16-bit
integers and one scale (a cosine computed from it is off by about 4e-6).  Heads (list centres) have two levels: coarse
heads are trained on a bounded sample at the driver, and each coarse cell trains its own fine heads in a task, so
a list has the same size whatever the number of vectors.  Lists lie in groups of near lists; a vector travels once to
each group it touches, with bit masks saying which lists of the group it is posted to and searches in.  Rows
travel as blocks (one row holds many vectors), so neither engine handles vectors one by one.

The fine heads and their graph are broadcast if they take no more than HEAD_BYTES.  Beyond, vectors go to their coarse
cell first, where the heads of the cell and its NEAR neighbours arrive before them; lists are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

DIM = 64
SAMPLE = 60_000
"""Vectors in the sample that trains the coarse heads, at most about this many (chosen by a hash of vec_id)."""
CELL_LISTS = 128
"""Fine heads of a coarse cell, about."""
MAX_CELLS = 4_096
"""Coarse cells, at most; beyond, a cell has more fine heads, and lists keep their size."""
POINTS = 32
"""Training vectors of a list, about, where heads are trained in tasks."""
NEAR = 8
"""Coarse cells whose heads a cell knows: links of the graph lie within them."""
PROBE, DEGREE, EXPAND = 4, 64, 2
"""Coarse cells in which a walk begins, links of a head, and heads expanded by a walk."""
HEAD_BYTES = 256 << 20
"""Heads are broadcast if they take at most so many bytes."""
TASKS = 20_000
"""Partitions of an exchange, at most; beyond, a partition holds several groups, one after another."""
GROUP_LISTS = 31
"""Lists of a group, at most (bits of a mask)."""
BROADCAST_ROWS = 1_000_000
"""A side of (id) or (id, id) rows is broadcast only if it was counted to have no more rows."""
HOT_ROWS = 1_000_000
"""Rows of one key that may meet in one task."""


def _hash_rows(q: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(q).view(np.uint64)
    h = np.zeros(len(q), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def encode(unit: np.ndarray) -> np.ndarray:
    """Rows of bytes: 16-bit values and a float32 scale."""
    scale = np.abs(unit).max(1, keepdims=True) / 32767
    q = np.rint(unit / scale).astype(np.int16)
    return np.concatenate([q.view(np.uint8).reshape(len(q), 2 * unit.shape[1]), scale.astype(np.float32).view(np.uint8).reshape(-1, 4)], 1)


def decode(block: np.ndarray, dim: int = DIM) -> np.ndarray:
    rows = np.ascontiguousarray(block).reshape(-1, 2 * dim + 4)
    return np.ascontiguousarray(rows[:, : 2 * dim]).view(np.int16) * np.ascontiguousarray(rows[:, 2 * dim :]).view(np.float32)


def binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def column_bytes(col: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, end to end."""
    if not len(col):
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + col.offset + 1)[col.offset :]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def usable(rows: DataFrame, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embeddings") -> DataFrame:
    """``(vec_id, key, v)`` of the usable vectors; equal directions have equal keys. Copies stay."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            good = np.flatnonzero(np.asarray(col.value_lengths().fill_null(0)) == dim)
            b = b.take(pa.array(good))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            b, x = b.filter(pa.array(ok)), x[ok]
            if not len(x):
                continue
            x = x / np.abs(x).max(1, keepdims=True)
            code = encode(x / np.linalg.norm(x, axis=1, keepdims=True))
            key = _hash_rows(code[:, : 2 * dim])
            v = binary(code.ravel(), np.arange(1, len(x) + 1) * code.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), v], ["vec_id", "key", "v"])

    source = rows.where(f"{id_col} is not null").select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("e"))
    return source.mapInArrow(run, "vec_id bigint, key bigint, v binary")


def attach(rows: DataFrame, table: DataFrame, key: str, scratch: Scratch, name: str, how: str = "inner") -> DataFrame:
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


def crowded(base: DataFrame, keep: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Vectors beyond the ``keep`` smallest ids of one direction, and those smallest.

    Returns ``(vec_id, key)`` of the surplus, which need not be indexed, and ``(key, vec_id, nth)`` of the
    first ones.  A direction shared by a third of all rows costs one aggregation and no pairs: its rows meet
    its key by broadcast, and the ranking is limited before it is shuffled.
    """
    ids = base.select("key", "vec_id").distinct()
    full = ids.groupBy("key").count().where(f"count > {keep}").select("key")
    nth = attach(ids, full, "key", scratch, "full").withColumn("nth", F.expr("row_number() over (partition by key order by vec_id)"))
    first = scratch.write(nth.where(f"nth <= {keep}"), "first")
    last = first.groupBy("key").agg(F.max("vec_id").alias("to"))
    return scratch.write(attach(ids, last, "key", scratch, "last").where("vec_id > to").select("vec_id", "key"), "surplus"), first


def without(base: DataFrame, dropped: DataFrame) -> DataFrame:
    """``base`` less the ids of ``dropped`` (a stored table); broadcast only when counted small."""
    n = dropped.count()
    if n == 0:
        return base
    ids = dropped.select("vec_id")
    return base.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "vec_id", "left_anti")


@dataclass
class Layout:
    """Heads by coarse cell, their graph, and the group and bit of every list."""

    coarse: np.ndarray
    starts: np.ndarray
    heads: np.ndarray
    links: np.ndarray
    group: np.ndarray
    bit: np.ndarray
    name: np.ndarray

    def search(self, x: np.ndarray, k: int, probe: int | None = None, expand: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest heads of each row and their cosines (-4 for none), by a best-first walk over the graph.

        The walk begins at the heads of the nearest coarse cells.  A row keeps the best heads it has seen and nothing
        else, so its cost does not depend on the number of heads.
        """
        k = min(k, len(self.heads))
        probe = min(PROBE if probe is None else probe, len(self.coarse))
        expand = (EXPAND if expand is None else expand) if len(self.coarse) > probe else 0
        keep, n = k + expand, len(x)
        ids, score = np.full((n, probe * keep), -1, np.int32), np.full((n, probe * keep), -4, np.float32)
        near = x @ self.coarse.T
        cells = np.argpartition(-near, probe - 1, axis=1)[:, :probe] if probe < len(self.coarse) else np.broadcast_to(np.arange(probe), (n, probe))
        for r in range(probe):
            order = np.argsort(cells[:, r], kind="stable")
            edge = np.flatnonzero(np.diff(cells[order, r], prepend=-1))
            for a, z in zip(edge, np.append(edge[1:], n), strict=True):
                rows, first, last = order[a:z], *self.starts[cells[order[a], r] :][:2]
                s = x[rows] @ self.heads[first:last].T
                most = min(keep, last - first)
                top = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < last - first else np.broadcast_to(np.arange(most), s.shape)
                at = slice(r * keep, r * keep + most)
                ids[rows, at], score[rows, at] = top + first, np.take_along_axis(s, top, 1)
        got = [self._walk(x[at : at + 512], ids[at : at + 512], score[at : at + 512], k, expand) for at in range(0, n, 512)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def _walk(self, x: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(x), np.arange(len(x))
        fresh, been = score, np.full((n, expand), -1, np.int32)
        for turn in range(expand):
            at = ids[rows, np.where((ids[:, :, None] == been[:, None, :turn]).any(2), -5, fresh).argmax(1)]
            been[:, turn] = at
            near = self.links[at]
            ids, score = np.concatenate([ids, near], 1), np.concatenate([score, np.matmul(self.heads[near], x[:, :, None])[:, :, 0]], 1)
            fresh = score
        if expand:
            # a head is seen once in its cell and once in a step, so so many places hold the k best distinct ones
            wide = k * (expand + 1)
            if wide < ids.shape[1]:
                top = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
                ids, score = np.take_along_axis(ids, top, 1), np.take_along_axis(score, top, 1)
            order = np.argsort(ids, axis=1, kind="stable")
            ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
            score[:, 1:][ids[:, 1:] == ids[:, :-1]] = -4
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.maximum(np.take_along_axis(ids, order, 1), 0), np.take_along_axis(score, order, 1)


def balanced_heads(sample: np.ndarray, lists: int, rounds: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Heads from a sample of unit vectors and their sizes in it: spherical k-means in which the heads of overfull
    lists are doubled at the cost of nearly empty ones."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(sample)))
    heads = sample[rng.choice(len(sample), lists, replace=False)]
    step = max(256, (1 << 24) // lists)
    for turn in range(rounds + 1):
        owner = np.concatenate([(sample[i : i + step] @ heads.T).argmax(1) for i in range(0, len(sample), step)])
        size = np.bincount(owner, minlength=lists)
        if turn == rounds:
            break
        order = np.argsort(owner, kind="stable")
        full = np.flatnonzero(size)
        sums = np.zeros((lists, sample.shape[1]))
        sums[full] = np.add.reduceat(sample[order].astype(np.float64), np.concatenate([[0], np.cumsum(size[full])[:-1]]))
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        heads = np.where(norm > 0, sums / np.maximum(norm, 1e-12), heads).astype(np.float32)
        light = np.flatnonzero(size < size.mean() / 4)
        heavy = np.argsort(-size)[: len(light)]
        heavy = heavy[size[heavy] > 2 * size.mean()]
        if turn < rounds - 1 and len(heavy):
            light = light[np.argsort(size[light])][: len(heavy)]
            member = np.full(lists, -1)
            member[owner[::-1]] = np.arange(len(sample))[::-1]
            spare = heads[heavy] + 0.7 * (sample[member[heavy]] - heads[heavy])
            heads[light] = spare / np.linalg.norm(spare, axis=1, keepdims=True)
    return heads.astype(np.float32), size


def grouped(heads: np.ndarray, size: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Group and bit of every list, by recursive bisection of the heads, and the number of groups."""
    lists = len(heads)
    group, bit = np.zeros(lists, np.int32), np.zeros(lists, np.int32)
    groups, todo = 0, [np.arange(lists)]
    weight = np.maximum(size, 0.25)
    while todo:
        part = todo.pop()
        if len(part) == 1 or (weight[part].sum() <= target and len(part) <= GROUP_LISTS):
            group[part], bit[part], groups = groups, np.arange(len(part)), groups + 1
            continue
        centred = heads[part] - heads[part].mean(0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0]
        part = part[np.argsort(centred @ axis, kind="stable")]
        half = int(np.searchsorted(np.cumsum(weight[part]), weight[part].sum() / 2))
        half = min(max(1, half), len(part) - 1)
        todo += [part[:half], part[half:]]
    return group, bit, groups


def nearest_heads(own: np.ndarray, heads: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The DEGREE nearest of ``heads`` (their names) for each of ``own``; the last is repeated where there are fewer."""
    near = min(DEGREE, len(heads))
    found = np.concatenate([np.argpartition(-(own[i : i + 1024] @ heads.T), near - 1, axis=1)[:, :near] for i in range(0, len(own), 1024)])
    return np.pad(names[found], ((0, 0), (0, DEGREE - near)), mode="edge").astype(np.int32)


@dataclass
class Lists:
    """Trained heads: the coarse ones, the table of the fine ones by cell, and the Layout if it may be broadcast."""

    coarse: np.ndarray
    starts: np.ndarray
    groups: int
    table: DataFrame | None
    layout: Layout | None

    @property
    def tasks(self) -> int:
        return max(1, min(self.groups, TASKS))


_HEADS = "cell int, lists int, groups int, heads binary, grp binary, bit binary"


def train(base: DataFrame, n: int, per_list: int, per_group: int, scratch: Scratch, dim: int = DIM, cell_lists: int | None = None, head_bytes: int | None = None) -> Lists:
    """Lists of about ``per_list`` vectors for a stored base table of ``n`` rows, in groups of about ``per_group``."""
    spark = base.sparkSession
    lists = max(1, round(n / per_list))
    cells = min(MAX_CELLS, -(-lists // (cell_lists or CELL_LISTS)))
    picked = lambda every: base.where(f"pmod(xxhash64(vec_id, 3), {every}) = 0").select("v")
    every = max(1, -(-n // SAMPLE))
    sample = decode(column_bytes(picked(every).toArrow().column(0).combine_chunks()), dim).astype(np.float32)
    if cells == 1:
        heads, size = balanced_heads(sample, lists)
        group, bit, groups = grouped(heads, size, max(1, per_group * len(sample) / n))
        starts = np.array([0, len(heads)])
        layout = Layout(heads[:1], starts, heads, nearest_heads(heads, heads, np.arange(len(heads))), group, bit, np.arange(len(heads)))
        return Lists(heads[:1], starts, groups, None, layout)
    first = balanced_heads(sample, cells)[0]
    every = max(1, min(every, per_list // POINTS))

    def place(batches):
        for b in batches:
            x = decode(column_bytes(b.column(0)), dim).astype(np.float32)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array((x @ first.T).argmax(1).astype(np.int32)), b.column(0)], ["cell", "v"])

    def fine(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            cell, raw = np.asarray(b.column(0)), column_bytes(b.column(1)).reshape(b.num_rows, -1)
            for c in np.unique(cell):
                held.setdefault(int(c), []).append(raw[cell == c])
        for c in list(held):
            x = decode(np.concatenate(held.pop(c)), dim).astype(np.float32)
            heads, size = balanced_heads(x, round(len(x) * every / per_list))
            group, bit, groups = grouped(heads, size, max(1, per_group / every))
            row = [pa.array([v], pa.int32()) for v in (c, len(heads), groups)] + [pa.array([v.tobytes()], pa.binary()) for v in (heads, group, bit)]
            yield pa.RecordBatch.from_arrays(row, ["cell", "lists", "groups", "heads", "grp", "bit"])

    placed = picked(every).mapInArrow(place, "cell int, v binary").repartitionById(cells, F.col("cell"))
    stored = scratch.write(placed.mapInArrow(fine, _HEADS), "heads")
    known = stored.select("cell", "lists", "groups").orderBy("cell").toPandas()  # at most MAX_CELLS rows
    coarse, starts = first[known.cell.to_numpy()], np.concatenate([[0], np.cumsum(known.lists)])
    before = np.concatenate([[0], np.cumsum(known.groups)])
    # cells under their places, with the first group and the first head of each
    places = spark.createDataFrame([(int(c), i, int(before[i]), int(starts[i])) for i, c in enumerate(known.cell)], "cell int, place int, first_group int, first_head int")
    table = stored.join(F.broadcast(places), "cell")
    found = Lists(coarse, starts, int(before[-1]), table, None)
    if starts[-1] * dim * 4 > (HEAD_BYTES if head_bytes is None else head_bytes):
        return found
    rows = table.orderBy("place").toPandas()
    heads = np.concatenate([np.frombuffer(h, np.float32).reshape(-1, dim) for h in rows.heads])
    group = np.concatenate([np.frombuffer(g, np.int32) + f for g, f in zip(rows.grp, rows.first_group, strict=True)])
    bit = np.concatenate([np.frombuffer(g, np.int32) for g in rows.bit])
    near = nearest_cells(coarse)
    told = spark.sparkContext.broadcast(heads)

    def link(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                names = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in near[c]])
                made = nearest_heads(told.value[starts[c] : starts[c + 1]], told.value[names], names)
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([made.tobytes()], pa.binary())], ["place", "links"])

    made = spark.range(0, len(coarse), 1, min(len(coarse), 256)).mapInArrow(link, "place bigint, links binary").orderBy("place").toPandas()
    links = np.concatenate([np.frombuffer(v, np.int32).reshape(-1, DEGREE) for v in made.links])
    told.destroy()
    found.layout = Layout(coarse, starts, heads, links, group, bit, np.arange(len(heads)))
    return found


def nearest_cells(coarse: np.ndarray) -> np.ndarray:
    """The NEAR cells nearest to each, itself first."""
    score = coarse @ coarse.T
    np.fill_diagonal(score, 2)
    return np.argsort(-score, axis=1, kind="stable")[:, :NEAR]


_BLOCKS = "group int, ids binary, post binary, search binary, home binary, close binary, vecs binary"


def exchange(base: DataFrame, lists: Lists, posted: int, searched: int, ratio_post: float, ratio_search: float, extra: int = 8, dim: int = DIM) -> DataFrame:
    """Blocks ``(group, ids, post, search, home, close, vecs)``, every group whole in one partition.

    A vector is posted to its nearest list and to further ones (boundary replicas), and searches in lists,
    as long as the distance to the head is within a ratio of the distance to the nearest head, and no more
    than ``posted`` or ``searched``.  In the groups so reached it also joins ``extra`` further near lists,
    which costs no transport.  ``home`` is the nearest head and ``close`` the cosine to it.
    """

    def send(lay: Layout, ids: np.ndarray, raw: np.ndarray):
        for at in range(0, len(ids), 4096):
            part, code = ids[at : at + 4096], raw[at : at + 4096]
            most = max(posted, searched)
            top, cos = lay.search(decode(code, dim).astype(np.float32), most + extra)
            dist = np.sqrt(np.maximum(0, 2 - 2 * cos))
            reach = dist <= (1 + max(ratio_post, ratio_search)) * dist[:, :1] + 1e-6
            rank = np.arange(top.shape[1])
            sent = reach & (rank < most)
            grp, bit = lay.group[top], np.int32(1) << lay.bit[top]
            near_p = dist <= (1 + ratio_post) * dist[:, :1] + 1e-6
            near_s = dist <= (1 + ratio_search) * dist[:, :1] + 1e-6
            # one copy for each (row, group) with a sent list; masks over all near lists of that group
            pair = (np.arange(len(part))[:, None] << np.int64(32)) | grp
            flat, inv = np.unique(pair, return_inverse=True)
            inv = inv.reshape(pair.shape)
            go = np.zeros(len(flat), bool)
            go[inv[sent]] = True
            masks = []
            for near, limit in ((near_p, posted), (near_s, searched)):
                mask = np.zeros(len(flat), np.int32)
                use = near & (rank < limit + extra)
                np.bitwise_or.at(mask, inv[use], bit[use])
                masks.append(mask[go])
            home, close = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.float32)
            home[inv[:, 0]], close[inv[:, 0]] = lay.name[top[:, 0]].astype(np.int64) << 5 | lay.bit[top[:, 0]], cos[:, 0]
            row, g = flat[go] >> 32, flat[go] & 0xFFFFFFFF
            order = np.argsort(g, kind="stable")
            row, g = row[order], g[order]
            ends = np.flatnonzero(np.diff(g, append=-1)) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g[ends - 1].astype(np.int32)),
                    binary(part[row].view(np.uint8), ends * 8),
                    *(binary(np.ascontiguousarray(m[order]).view(np.uint8), ends * m.itemsize) for m in (*masks, home[go], close[go])),
                    binary(code[row].ravel(), ends * code.shape[1]),
                ],
                ["group", "ids", "post", "search", "home", "close", "vecs"],
            )

    if lists.layout is not None:
        shared = base.sparkSession.sparkContext.broadcast(lists.layout)  # at most HEAD_BYTES of heads

        def run(batches):
            for b in batches:
                yield from send(shared.value, np.asarray(b.column(0)), column_bytes(b.column(1)).reshape(b.num_rows, -1))

        blocks = base.select("vec_id", "v").mapInArrow(run, _BLOCKS)
    else:
        blocks = _by_cell(base, lists, send, dim)
    tasks = lists.tasks
    laid = blocks.repartitionById(tasks, F.expr(f"group % {tasks}"))
    return laid if tasks == lists.groups else laid.sortWithinPartitions("group")


def _by_cell(base: DataFrame, lists: Lists, send, dim: int) -> DataFrame:
    """Blocks of vectors sent from their coarse cells, where the heads of the cell and its neighbours come first."""
    spark, coarse = base.sparkSession, lists.coarse
    near = nearest_cells(coarse)
    knows = spark.createDataFrame([(int(i), c) for c in range(len(coarse)) for i in near[c]], "place int, cell int")
    heads = lists.table.drop("cell").join(F.broadcast(knows), "place")
    heads = heads.selectExpr("cell", "0 as kind", "place", "cast(null as bigint) as vec_id", "cast(null as binary) as v", "first_group", "first_head", "heads", "grp", "bit")

    def place(batches):
        for b in batches:
            x = decode(column_bytes(b.column(1)), dim).astype(np.float32)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array((x @ coarse.T).argmax(1).astype(np.int32)), b.column(0), b.column(1)], ["cell", "vec_id", "v"])

    rows = base.select("vec_id", "v").mapInArrow(place, "cell int, vec_id bigint, v binary")
    rows = rows.selectExpr("cell", "1 as kind", "0 as place", "vec_id", "v", "0 as first_group", "0 as first_head", "cast(null as binary) as heads", "cast(null as binary) as grp", "cast(null as binary) as bit")

    def run(batches):
        known: list[dict] = []
        lay, at = None, -1
        for b in batches:
            cell, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
            edge = np.flatnonzero(np.diff(cell * 2 + kind, prepend=-1))
            for a, z in zip(edge, np.append(edge[1:], len(cell)), strict=True):
                part = b.slice(a, z - a)
                if kind[a] == 0:
                    known = (known if at == cell[a] else []) + part.select([2, 5, 6, 7, 8, 9]).to_pylist()
                    lay, at = None, cell[a]
                    continue
                lay = lay or _local_layout(known, coarse, dim)
                yield from send(lay, np.asarray(part.column(3)), column_bytes(part.column(4)).reshape(len(part), -1))

    together = heads.unionByName(rows).repartitionById(len(coarse), F.col("cell")).sortWithinPartitions("cell", "kind", "place")
    return together.mapInArrow(run, _BLOCKS)


def _local_layout(rows: list[dict], coarse: np.ndarray, dim: int) -> Layout:
    heads = [np.frombuffer(r["heads"], np.float32).reshape(-1, dim) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    name = np.concatenate([r["first_head"] + np.arange(len(h)) for r, h in zip(rows, heads, strict=True)])
    group = np.concatenate([r["first_group"] + np.frombuffer(r["grp"], np.int32) for r in rows])
    every = np.concatenate(heads)
    links = nearest_heads(every, every, np.arange(len(every)))
    return Layout(coarse[[r["place"] for r in rows]], starts, every, links, group, np.concatenate([np.frombuffer(r["bit"], np.int32) for r in rows]), name)


@dataclass
class Members:
    """One group: distinct ids in ascending order with their vectors, masks, and home lists (-1: in another group)."""

    group: int
    ids: np.ndarray
    post: np.ndarray
    search: np.ndarray
    home: np.ndarray
    home_bit: np.ndarray
    close: np.ndarray
    codes: np.ndarray
    vecs: np.ndarray


def gathered(batches, dim: int = DIM):
    """The groups of a partition, one after another, copies of an id dropped; rows of a group lie together."""
    held: list[list[np.ndarray]] = []
    group = -1
    for b in batches:
        for i, g in enumerate(b.column(0).to_pylist()):
            if g != group and held:
                yield _members(group, held, dim)
                held = []
            group = g
            held.append([np.frombuffer(b.column(c)[i].as_buffer(), np.uint8) for c in range(1, 7)])
    if held:
        yield _members(group, held, dim)


def _members(g: int, held: list[list[np.ndarray]], dim: int) -> Members:
    ids, post, search, home, close, vecs = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, first = np.unique(ids.view(np.int64), return_index=True)
    take = lambda v, kind: v.view(kind)[first]
    home, codes = take(home, np.int64), vecs.reshape(-1, 2 * dim + 4)[first]
    return Members(g, ids, take(post, np.int32), take(search, np.int32), home >> 5, np.where(home < 0, -1, home & 31), take(close, np.float32), codes, decode(codes, dim).astype(np.float32))
