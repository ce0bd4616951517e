"""Clusters of like vectors, their sizes and their most typical members (problem 5).

Method: grid density clustering.  Features are quantised to cells, cells are counted, dense cells next to each
other are joined, and minimum labels are propagated in SQL until nothing changes; each cluster is reported with
its size and members of its densest cell.

The cells: in 64 dimensions a box grid cuts nearly every cluster at every cell wall, so directions are quantised to
the nearest head of a balanced codebook instead (a cell is the region of a head), and a vector near a wall is also
listed in the cells beyond it.  Two cells are adjacent where a vector is listed in both, and they are joined
where it belongs to linked members of both.  Links inside a cell are exact tests of the cosine over dense blocks;
a crowded cell is first reduced by a leader: everything linked to it is one set, and only the rest is compared
on.

The lists of a vector end by count and by ratio, so a linked pair may share no cell.  ``bridges`` makes the result
exact: the vectors of a cell are split into units by closeness to the head (and by label where one is large), the
triangle inequality on the closeness stored for each unit rules out what cannot hold a link, and everything else with
another label is compared.  Vectors far from every head cannot be ruled out, so this step is quadratic in their
number.

Two vectors belong together if their cosine reaches the threshold or others join them in this way.

Equal directions are collapsed to their smallest id before and attached after.  Rows with the same vec_id count
once; unusable vectors are left out.  Cosines are accurate to about 4e-6.  No input, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch
from lattiq.llm import vectors as V

LINK = 0.85
LEAST_SIZE = 5
PER_LIST = 400
PER_GROUP = 8_000
LISTED, RATIO, EXTRA = 4, 0.2, 18
MAX_HEAD_BYTES = 1 << 30
"""The heads of cells are broadcast; beyond so many bytes cells grow."""
CROWD = 128
"""Links of one vector in a cell beyond which the cell is reduced by a leader."""
RINGS = (0.95, 0.9, 0.8, 0.6)
"""Cosines to the head at which the vectors of a cell are split into units."""
TIGHT = 2
"""Rings up to this one (0: the innermost) are a goal of comparisons only where vectors of several labels reach them."""
UNIT = 256
"""Vectors of one label in one ring that are a unit of their own."""
OWN, MEANS = 4, 200_000
"""Linked vectors far from their head that make a cell of their own, and such cells, at most (the largest)."""
HOSTS = 200_000
"""Vectors broadcast in one round of comparisons, at most about this many."""


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))  # only roots are hooked
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def cell_links(x: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that give the connected components, over cosine >= link, of the rows of ``x``."""
    left, right = [], []
    rest = np.arange(len(x))
    while len(rest) > CROWD:
        probe = rest[:: max(1, len(rest) // 64)]
        hits = x[probe] @ x[rest].T >= link
        count = hits.sum(1)
        top = int(count.argmax())
        if count[top] <= CROWD:
            break
        mine = hits[top]
        crowd, others = rest[mine], rest[~mine]
        left.append(crowd)
        right.append(np.full(len(crowd), probe[top]))
        target = np.ascontiguousarray(x[crowd].T)
        for at in range(0, len(others), 512):
            part = others[at : at + 512]
            joined = part[(x[part] @ target).max(1) >= link]
            left.append(joined)
            right.append(np.full(len(joined), probe[top]))
        rest = others
    y = x[rest]
    for at in range(0, len(rest), 256):
        i, j = np.nonzero(y[at : at + 256] @ y[at:].T >= link)
        keep = i < j
        left.append(rest[at + i[keep]])
        right.append(rest[at + j[keep]])
    return np.concatenate(left), np.concatenate(right)


def memberships(rows: DataFrame, link: float, scratch: Scratch, per_list: int, per_group: int, listed: int) -> tuple[DataFrame, DataFrame, object] | None:
    """``(root, vec_id, cell, closeness, v)``: local components of linked vectors, named by their smallest id.

    ``cell`` is the cell of the vector, and ``v`` the vector, given where its own group reports it (once), else null.
    That is the cell of its nearest head, but linked vectors far from their heads make a cell of their own about their
    mean.  The second table, ``(vec_id, first)``, has the vectors that only repeat the direction of another one; the
    last item is the broadcast heads and means.
    """
    spark = rows.sparkSession
    base = scratch.write(V.usable(rows), "base")
    n = base.count()
    if n == 0:
        return None
    surplus, first = V.crowded(base, 1, scratch)
    lists = V.train(base, n, per_list, per_group, scratch, head_bytes=MAX_HEAD_BYTES)
    laid = V.exchange(V.without(base, surplus), lists, listed, listed, RATIO, RATIO, EXTRA)

    def local(batches):
        for m in V.gathered(batches):
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for bit in range(V.GROUP_LISTS):
                p = np.flatnonzero(m.post & (1 << bit))
                if len(p) > 1:
                    i, j = cell_links(m.vecs[p], link)
                    a.append(p[i])
                    b.append(p[j])
            label = _labels(len(m.ids), np.concatenate(a), np.concatenate(b))
            size = np.bincount(label, minlength=len(m.ids))
            keep = np.flatnonzero((size[label] > 1) | (m.home >= 0))
            keep = keep[np.argsort(m.home[keep], kind="stable")]
            away = m.home[keep] < 0
            root, close = label[keep], np.where(away, 2, m.close[keep]).astype(np.float32)
            part, means = _own_cells(m.vecs[keep], root, close)
            own, count = np.full(len(keep), -1, np.int64), np.bincount(part[part >= 0], minlength=len(means))
            in_part = np.flatnonzero(part >= 0)
            own[in_part] = (m.group << 24) + part[in_part]
            near = np.zeros(len(keep), np.float32)
            near[in_part] = np.einsum("ij,ij->i", m.vecs[keep[in_part]], means[part[in_part]])
            codes = np.concatenate([m.codes[keep[~away]], V.encode(means.astype(np.float64))])
            last = np.zeros(len(means), bool)  # rows of means follow
            void = np.concatenate([away, last])
            ends = np.cumsum(np.where(void, 0, codes.shape[1]))
            v = pa.Array.from_buffers(pa.binary(), len(void), [pa.array(~void).buffers()[1], pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
            mean = np.concatenate([np.zeros(len(keep), bool), ~last])
            stack = lambda x, y: np.concatenate([x, np.full(len(means), y, x.dtype)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([m.ids[root], count])), pa.array(stack(m.ids[keep], 0), mask=mean), pa.array(stack(m.home[keep].astype(np.int32), 0), mask=void | mean),
                    pa.array(stack(close, 0), mask=void | mean), pa.array(stack(near, 0)), pa.array(np.concatenate([own, (m.group << 24) + np.arange(len(means))])), v,
                ],
                ["root", "vec_id", "cell", "closeness", "near", "own", "v"],
            )

    stored = scratch.write(laid.mapInArrow(local, "root bigint, vec_id bigint, cell int, closeness float, near float, own bigint, v binary"), "memberships")
    heads = lists.layout.heads
    made = stored.where("vec_id is null").orderBy(F.desc("root"), "own").limit(MEANS).select("own", "v").toArrow()  # the count is under root
    means = V.decode(V.column_bytes(made.column(1).combine_chunks())).astype(np.float32)
    numbers = scratch.write(spark.createDataFrame(pa.table({"own": made.column(0), "mean": pa.array(len(heads) + np.arange(len(means)), pa.int32())}), "own bigint, mean int"), "means")
    # a mean beyond the MEANS largest is no cell; its vectors stay with their heads
    found = stored.where("vec_id is not null").join(F.broadcast(numbers), "own", "left")
    found = found.selectExpr("root", "vec_id", "coalesce(mean, cell) as cell", "if(mean is null, closeness, near) as closeness", "v")
    copies = V.attach(surplus, first.where("nth = 1").select("key", F.col("vec_id").alias("first")), "key", scratch, "firsts").select("vec_id", "first")
    return found, copies, spark.sparkContext.broadcast(np.concatenate([heads, means]))


def _own_cells(x: np.ndarray, label: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells for linked vectors whose heads are far: a number for each row (-1: stays) and the unit means."""
    part = np.full(len(x), -1)
    far = np.flatnonzero(close < RINGS[2])
    name, inv, count = np.unique(label[far], return_inverse=True, return_counts=True)
    sums = np.zeros((len(name), x.shape[1]))
    np.add.at(sums, inv, x[far])
    mean = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    join = (count[inv] >= OWN) & (np.einsum("ij,ij->i", x[far], mean[inv]) > np.maximum(close[far], RINGS[2]))
    kept, number = np.unique(inv[join], return_inverse=True)
    part[far[join]] = number
    return part, V.decode(V.encode(mean[kept].astype(np.float64))).astype(np.float32) if len(kept) else mean[kept]


def _window(low: np.ndarray, high: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines to a head outside of which no vector links to one whose cosine to that head is in [low, high]."""
    reach = np.arccos(np.clip(link, -1, 1)) + 1e-3
    far, near = np.arccos(np.clip(low, -1, 1)) + reach, np.arccos(np.clip(high, -1, 1)) - reach
    return np.where(far >= np.pi, -2, np.cos(np.minimum(far, np.pi))), np.where(near <= 0, 2, np.cos(np.maximum(near, 0)))


def bridges(named: DataFrame, heads, link: float, scratch: Scratch) -> DataFrame | None:
    """Pairs ``(a, b)`` of labels with a link between them, whatever cells it lies in; None if none can exist.

    ``named`` has (label, cell, closeness, v) of every vector that was compared.  Units are ranked from the widest to
    the tightest; the vectors of a unit are compared with those vectors of the units up to it that lie in its window.
    Tight units that only vectors of one label reach are no goal; the rest is broadcast in rounds of about HOSTS vectors.
    """
    ring = " + ".join(f"cast(closeness < {c} as int)" for c in RINGS)
    named = named.selectExpr("label", "cell", "closeness", f"{ring} as ring", "v")
    spread = named.drop("v")
    large = scratch.write(spread.groupBy("cell", "ring", "label").count().where(f"count >= {UNIT}").selectExpr("cell", "ring", "label", "1 as large"), "large")
    key = ["cell", "ring", "single", "own"]
    placed = lambda t: t.join(large, ["cell", "ring", "label"], "left").withColumns({"single": F.expr("coalesce(large, 0)"), "own": F.expr("if(large = 1, label, 0L)")})
    units = placed(spread).groupBy(key).agg(F.min("closeness").alias("low"), F.max("closeness").alias("high"), F.count(F.lit(1)).alias("n"))
    units = scratch.write(units.withColumn("unit", F.expr("row_number() over (order by low, cell, ring, single, own) - 1")), "units")
    points = placed(named).join(units.select("unit", *key), key).select("label", "unit", "v")
    spark = named.sparkSession
    table = units.orderBy("unit").toArrow()
    cell, ring, single, own, low, high, n = (np.asarray(table.column(c).combine_chunks()) for c in ("cell", "ring", "single", "own", "low", "high", "n"))
    low, high = _window(low.astype(np.float64), high.astype(np.float64), link)
    bounds = spark.sparkContext.broadcast((cell, ring, single, own, low.astype(np.float32), high.astype(np.float32)))

    def seen(batches):
        """The least and the greatest label among the vectors that may link to a tight unit."""
        cell, ring, _, _, low, high = bounds.value
        tight = np.flatnonzero(ring <= TIGHT)
        least, most = np.full(len(cell), np.iinfo(np.int64).max), np.full(len(cell), np.iinfo(np.int64).min)
        for label, _, x in _sorted_points(batches):
            cos = x @ heads.value.T
            some = tight[(cos.max(0)[cell[tight]] >= low[tight])]
            for at in range(0, len(some), 1024):
                which = some[at : at + 1024]
                c = cos[:, cell[which]]
                near = (c >= low[which]) & (c <= high[which])
                least[which] = np.minimum(least[which], np.where(near, label[:, None], np.iinfo(np.int64).max).min(0))
                most[which] = np.maximum(most[which], np.where(near, label[:, None], np.iinfo(np.int64).min).max(0))
        hit = np.flatnonzero(least <= most)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(least[hit]), pa.array(most[hit])], ["unit", "least", "most"])

    mixed = points.mapInArrow(seen, "unit int, least bigint, most bigint").groupBy("unit").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    open_ = scratch.write(mixed.where("least < most").select("unit").unionByName(units.where(f"ring > {TIGHT}").select("unit")), "open")
    wanted = np.sort(np.asarray(open_.toArrow().column(0).combine_chunks()))
    # rounds: ranges of units of together about HOSTS vectors, a larger unit in parts
    rounds, first, held = [], None, 0
    for k, u in enumerate(wanted):
        first, held = u if first is None else first, held + int(n[u])
        if k + 1 == len(wanted) or held + n[wanted[k + 1]] > HOSTS:
            parts = -(-held // HOSTS)
            rounds += [(int(first), int(u), parts, part) for part in range(parts)]
            first, held = None, 0
    for turn, (a, b, parts, part) in enumerate(rounds):
        block = points.where(f"unit between {a} and {b} and pmod(xxhash64(v), {parts}) = {part}").join(F.broadcast(open_), "unit", "left_semi").select("unit", "label", "v").orderBy("unit").toArrow()
        if not block.num_rows:
            continue
        told = spark.sparkContext.broadcast(tuple(np.asarray(block.column(c).combine_chunks()) for c in (0, 1)) + (V.column_bytes(block.column(2).combine_chunks()),))
        points.where(f"unit >= {a}").mapInArrow(_compare(told, bounds, heads, link), "a bigint, b bigint").distinct().write.parquet(f"{scratch.root}/bridges/{turn}")
        told.destroy()
    return spark.read.schema("a bigint, b bigint").parquet(f"{scratch.root}/bridges/*") if rounds else None


def _compare(told, bounds, heads, link: float):
    """The kernel that compares points with the broadcast vectors ``(unit, label, code)``, sorted by unit."""

    def run(batches):
        host, names, code = told.value
        y = V.decode(code).astype(np.float32)
        short = _shortened(y)
        cells, _, single, own, low, high = bounds.value
        last, cos = -1, None
        for label, unit, x in _sorted_points(batches):
            a, b = [], []
            edge = np.flatnonzero(np.diff(unit, prepend=-1))
            for s, e in zip(edge, np.append(edge[1:], len(unit)), strict=True):
                u = int(unit[s])
                upto = int(np.searchsorted(host, u, "right"))
                if cells[u] != last:
                    last, cos = cells[u], y @ heads.value[cells[u]]
                near = (cos[:upto] >= low[u]) & (cos[:upto] <= high[u])
                if single[u]:
                    near &= names[:upto] != own[u]
                goal = np.flatnonzero(near)
                dense = len(goal) > upto // 2
                if dense:
                    goal = np.arange(upto)
                mine = _shortened(x[s:e])
                for at in range(0, len(goal), 4096):
                    to = goal[at : at + 4096]
                    i, j = np.divmod(np.flatnonzero(mine @ (short[at : at + len(to)] if dense else short[to]).T >= link - 1e-5), len(to))
                    la, lb = label[s + i], names[to[j]]
                    differ = np.flatnonzero(la != lb)
                    if len(differ):
                        differ = differ[np.einsum("ij,ij->i", x[s + i[differ]], y[to[j[differ]]]) >= link]
                        pair = np.unique(np.stack([la[differ], lb[differ]], 1), axis=0)
                        a.append(pair[:, 0])
                        b.append(pair[:, 1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _shortened(x: np.ndarray) -> np.ndarray:
    """The first half of each vector and the length of the rest: products of these are never less than the cosine."""
    half = x.shape[1] // 2 - 1
    return np.concatenate([x[:, :half], np.sqrt(np.maximum(0, (x[:, half:] ** 2).sum(1, keepdims=True)))], 1)


def _sorted_points(batches, rows: int = 1024, most: int = 32_768):
    """``(label, unit, vectors)`` of a partition in pieces of ``rows`` rows, sorted by unit as far as memory is bounded."""
    held, count = [], 0

    def pieces():
        label, unit = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in (0, 1))
        code = np.concatenate([V.column_bytes(b.column(2)) for b in held]).reshape(len(unit), -1)
        order = np.argsort(unit, kind="stable")
        for at in range(0, len(order), rows):
            take = order[at : at + rows]
            yield label[take], unit[take], V.decode(code[take]).astype(np.float32)

    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count >= most:
            yield from pieces()
            held, count = [], 0
    if held:
        yield from pieces()


def propagate(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Minimum labels over the edges ``(a, b)``, in SQL rounds to convergence: ``(node, label)``.

    A round hands every node the least label among itself and its neighbours and then jumps to the label
    of that label, so chains shorten by more than half each time.
    """
    edges = scratch.write(links.select("a", "b").unionByName(links.selectExpr("b as a", "a as b")).where("a <> b").distinct(), "edges")
    labels = scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as label"), "labels0")
    turn = 0
    while True:
        turn += 1
        # hook the current label of every node to the least label next to it, then jump
        seen = edges.join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b").groupBy("a").agg(F.min("lb").alias("low"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").selectExpr("node", "label", "least(label, low) as low")
        hook = near.groupBy("label").agg(F.min("low").alias("to")).withColumnRenamed("label", "at")
        step = near.join(hook, F.col("low") == F.col("at"), "left").selectExpr("node", "label as old", "least(low, coalesce(to, low)) as label")
        stored = scratch.write(step, f"labels{turn}")
        if stored.where("label <> old").isEmpty():
            return stored.select("node", "label")
        labels = stored.select("node", "label")
        if turn > 1:
            scratch.drop(f"labels{turn - 2}")


def cluster(rows: DataFrame, link: float = LINK, least: int = LEAST_SIZE, per_list: int = PER_LIST, per_group: int = PER_GROUP, listed: int = LISTED) -> DataFrame:
    """``(cluster_vec_id, vec_id, size, cell, closeness)`` of the members of clusters of ``least`` or more."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    found = memberships(rows, link, scratch, per_list, per_group, listed)
    if found is None:
        return spark.createDataFrame([], "cluster_vec_id bigint, vec_id bigint, size bigint, cell int, closeness float")
    inner, copies, heads = found
    # a vector reported under several roots joins their cells
    roots = inner.groupBy("vec_id").agg(F.min("root").alias("a"), F.collect_set("root").alias("roots")).where("size(roots) > 1")
    links = roots.selectExpr("a", "explode(roots) as b").where("a <> b").distinct()
    # a root or a cluster may own a third of all vectors: labels and sizes never meet their rows by a plain shuffle
    labels = propagate(links, scratch).withColumnRenamed("node", "root")
    home = inner.where("cell is not null")
    named = V.attach(home, labels, "root", scratch, "labels", "left").withColumn("label", F.coalesce("label", "root"))
    joined = bridges(named, heads, link, scratch)
    named = named.selectExpr("label as cluster_vec_id", "vec_id", "cell", "closeness")
    if joined is not None:
        final = propagate(joined, Scratch(spark, "bridges")).withColumnsRenamed({"node": "cluster_vec_id", "label": "final"})
        named = V.attach(named, final, "cluster_vec_id", scratch, "final", "left").selectExpr("coalesce(final, cluster_vec_id) as cluster_vec_id", "vec_id", "cell", "closeness")
    # copies take the place of the vector they repeat; many may repeat the same one
    origin = named.withColumnRenamed("vec_id", "first").join(copies.select("first").distinct(), "first", "left_semi")
    alike = V.attach(copies, origin, "first", scratch, "origin").select("cluster_vec_id", "vec_id", "cell", "closeness")
    named = scratch.write(named.unionByName(alike), "all")
    sizes = named.groupBy("cluster_vec_id").agg(F.count(F.lit(1)).alias("size")).where(f"size >= {least}")
    return V.attach(named, sizes, "cluster_vec_id", scratch, "sizes").select("cluster_vec_id", "vec_id", "size", "cell", "closeness")


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster: size, its densest cell with the count there, and the members of that cell nearest its head.

    ``(cluster_vec_id, size, cell, in_cell, rank, vec_id)``, ``typical`` rows per cluster.
    """
    counts = members.where("cell is not null").groupBy("cluster_vec_id", "size", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    dense = counts.groupBy("cluster_vec_id", "size").agg(F.max(F.struct("in_cell", F.expr("-cell").alias("c"))).alias("d")).selectExpr("cluster_vec_id", "size", "-d.c as cell", "d.in_cell as in_cell")
    ranked = members.join(dense.select("cluster_vec_id", "cell", "in_cell"), ["cluster_vec_id", "cell"]).withColumn(
        "rank", F.expr("row_number() over (partition by cluster_vec_id order by closeness desc, vec_id)")
    )
    return ranked.where(f"rank <= {typical}").select("cluster_vec_id", "size", "cell", "in_cell", "rank", "vec_id")
