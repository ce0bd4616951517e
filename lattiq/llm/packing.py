"""Filling fixed-capacity containers with items of varying length (problem 8).

Method: a configuration linear program over the length histogram.  A configuration is a multiset of length
classes that fits one container.  Multiplicative weights solve the covering program approximately: each
class carries a weight, a knapsack dynamic program prices the most valuable configuration under the current
weights (among the classes of greatest value for their length), and the classes it covers lose weight.  The most used
configurations become whole containers, a share of them at a time, and the program is solved again for the demand
that is left, until that fills a few containers only.  The last items, and a reserve of the shortest ones, go best-fit
into the real gaps and only then into further containers.

The driver sees the histogram (at most one row per length up to the capacity) and never an item.  The plan is
a list of runs ``(length, first rank, count, first container)`` whose number depends on the capacity, not on
the data; items find their container by their rank among items of the same length, which is computed in
two steps (bucket offsets, rank inside a bucket) so that one very common length does not end in one task.

Defined results: an item longer than the capacity is cut into full containers and one rest, any other is
kept whole; an item of length 0 (empty or null text) is put in some existing container; repeated rows are
items of their own; without any item there is no row.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

CAPACITY = 4096
CLASSES = 256
"""Length classes of the linear program."""
ROUNDS = 40
"""Rounds of multiplicative weights between two roundings."""
COLUMNS = 32
"""Classes that the pricing looks at, those of greatest value for their length."""
TAKEN = 0.4
"""Share of the program's containers that one rounding makes real."""
TAIL = 3
"""Containers' worth of demand that is left to best fit."""
CELLS = 1024
"""Cells of the knapsack program: lengths are rounded up to capacity / CELLS (to 1 for small capacities)."""
RESERVE = 0.01
"""Share of the total length, in the shortest items, kept back to fill gaps."""
RANK_BUCKET = 200_000


@dataclass
class Plan:
    """Runs of equal lengths and the number of containers; ``run`` rows are length, rank, count, container.

    ``by_program`` containers come from the linear program, the others from best fit."""

    run: list[tuple[int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    by_program: int = 0


class _Stock:
    """Items left, by exact length, and how many of each have been placed."""

    def __init__(self, hist: dict[int, int]):
        self.left = {n: c for n, c in hist.items() if c > 0}
        self.used = dict.fromkeys(hist, 0)
        self.lengths = sorted(self.left)

    def fitting(self, gap: int) -> int:
        """The greatest length left that fits, or 0."""
        while True:
            i = bisect.bisect_right(self.lengths, gap) - 1
            if i < 0:
                return 0
            if self.left[self.lengths[i]]:
                return self.lengths[i]
            self.lengths.pop(i)

    def place(self, plan: Plan, n: int, count: int, container: int) -> None:
        plan.run.append((n, self.used[n], count, container))
        self.used[n] += count
        self.left[n] -= count


def price(units: np.ndarray, limit: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable configuration: bounded knapsack over classes, copies in powers of two."""
    best = np.zeros(capacity + 1)
    steps = []
    for c in np.flatnonzero(value > 0):
        room, k = min(int(limit[c]), capacity // int(units[c])), 1
        while room > 0:
            k = min(k, room)
            room -= k
            w = k * int(units[c])
            trial = best[: capacity + 1 - w] + k * value[c]
            better = trial > best[w:]
            if better.any():
                best[w:] = np.where(better, trial, best[w:])
                steps.append((c, k, w, better))
            k *= 2
    take, at = np.zeros(len(units), np.int64), capacity
    for c, k, w, better in reversed(steps):
        if at >= w and better[at - w]:
            take[c] += k
            at -= w
    return take


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = 0.5, weight: np.ndarray | None = None) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Fractional copies of configurations that cover ``demand``, by multiplicative weights, and the last weights."""
    unit = max(1, capacity // CELLS)
    units, room = -(-sizes // unit), capacity // unit
    fits = units <= room
    weight = np.where(fits, 1.0 if weight is None else weight, 0.0)
    covered = np.where(fits, -np.log(np.maximum(weight, 1e-12)) / (8 * rate), 0.0)
    covered -= covered[fits].min() if fits.any() else 0
    start = covered.copy()
    count: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        value = weight / np.maximum(demand, 1)
        dense = value / units
        if len(sizes) > COLUMNS:  # pricing looks at the best columns only
            value = np.where(dense >= np.partition(dense, -COLUMNS)[-COLUMNS], value, 0.0)
        take = price(units, demand, value, room)
        if not take.any():
            break
        # one step covers the tightest class of the configuration by a fixed share
        share = take / demand
        step = 1 / (share.max() * 8)
        covered += step * share
        weight = np.where(fits, np.exp(-rate * 8 * (covered - covered[fits].min())), 0.0)
        key = tuple(take.tolist())
        count[key] = count.get(key, 0) + step
    if not count:
        return {}, weight
    scale = 1 / max((covered - start)[fits].mean(), 1e-9)
    return {k: v * scale for k, v in count.items()}, weight


def make_plan(hist: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, rounds: int = ROUNDS) -> Plan:
    """Containers for a histogram of lengths from 1 to ``capacity``."""
    plan, stock = Plan(), _Stock(hist)
    if not stock.lengths:
        return plan
    lengths = np.array(stock.lengths)
    counts = np.array([hist[n] for n in stock.lengths], np.int64)
    mass = np.cumsum(lengths * counts)
    main = mass > RESERVE * mass[-1]
    lengths, counts = lengths[main], counts[main]
    # classes of about equal mass, each as long as its longest member
    edge = np.searchsorted(np.cumsum(lengths * counts) / (lengths * counts).sum(), np.arange(1, classes + 1) / classes - 1e-12)
    edge = np.unique(np.minimum(edge, len(lengths) - 1))
    sizes = lengths[edge]
    rest = np.add.reduceat(counts, np.concatenate([[0], edge[:-1] + 1]))
    home = {int(n): int(np.searchsorted(sizes, n)) for n in lengths}
    members = [[] for _ in sizes]
    for n in lengths.tolist():
        members[home[n]].append(n)
    gaps: list[tuple[int, int, int]] = []  # gap, first container, containers
    weight = np.ones(len(sizes))
    while (sizes * rest).sum() > TAIL * capacity:
        live = np.flatnonzero(rest)
        found, weight[live] = solve(sizes[live], rest[live], capacity, rounds, weight=weight[live])
        if not found:
            break
        goal, made = max(1, int(TAKEN * sum(found.values()))), 0
        full = {take: int(np.dot(take, sizes[live])) for take in found}
        for take in sorted(found, key=lambda t: (-int(found[t]), -full[t], t)):
            need = np.zeros(len(sizes), np.int64)
            need[live] = take
            n = min(max(1, int(found[take])), int((rest[need > 0] // need[need > 0]).min()))
            if n <= 0:
                continue
            gaps += _use(plan, stock, members, home, rest, need, n, capacity)
            made += n
            if made >= goal:
                break
        if not made:
            break
    plan.by_program = plan.containers
    _fill(plan, stock, gaps)
    while stock.fitting(capacity):
        # one more configuration, best fit, for as many containers as its items last
        take, gap = {}, capacity
        while n := stock.fitting(gap):
            k = min(gap // n, stock.left[n] - take.get(n, 0))
            if k <= 0:
                n = next((m for m in reversed(stock.lengths) if m <= gap and stock.left[m] - take.get(m, 0) > 0), 0)
                if not n:
                    break
                k = min(gap // n, stock.left[n] - take.get(n, 0))
            take[n] = take.get(n, 0) + k
            gap -= k * n
        copies = min(stock.left[n] // k for n, k in take.items())
        for n, k in take.items():
            for _ in range(k):
                stock.place(plan, n, copies, plan.containers)
        plan.containers += copies
    return plan


def _use(plan: Plan, stock: _Stock, members: list[list[int]], home: dict[int, int], rest: np.ndarray, need: np.ndarray, n: int, capacity: int) -> list[tuple[int, int, int]]:
    """Fill ``n`` containers by one configuration, longest members first; the gaps that are left.

    The smallest member comes last, and there the longest item of any class that fits the real gap is taken.
    """
    first, segments = plan.containers, [(0, n, capacity)]
    plan.containers += n
    slots = [int(c) for c in np.flatnonzero(need)[::-1] for _ in range(int(need[c]))]
    for c in slots[:-1] or slots:
        cuts, todo = [], n
        while todo:
            size = members[c][-1]
            if not stock.left[size]:
                members[c].pop()
                continue
            got = min(stock.left[size], todo)
            stock.place(plan, size, got, first + n - todo)
            cuts.append((n - todo, n - todo + got, size))
            todo -= got
        rest[c] -= n
        segments = _subtract(segments, cuts)
    if len(slots) == 1:
        return [(g, first + a, b - a) for a, b, g in segments]
    gaps = []
    for a, b, gap in segments:
        while a < b:
            size = stock.fitting(gap)
            got = min(b - a, stock.left[size]) if size else b - a
            if size:
                stock.place(plan, size, got, first + a)
                if size in home:
                    rest[home[size]] -= got
            gaps.append((gap - size, first + a, got))
            a += got
    return gaps


def _subtract(segments, cuts):
    """Lower the gaps of segments by the sizes of cuts; both cover the same range in order."""
    out, i, j = [], 0, 0
    while i < len(segments) and j < len(cuts):
        a, b = max(segments[i][0], cuts[j][0]), min(segments[i][1], cuts[j][1])
        out.append((a, b, segments[i][2] - cuts[j][2]))
        i, j = i + (segments[i][1] == b), j + (cuts[j][1] == b)
    return out


def _fill(plan: Plan, stock: _Stock, gaps: list[tuple[int, int, int]]) -> None:
    """Best fit of what is left into the gaps, largest gaps first."""
    gaps.sort(reverse=True)
    while gaps:
        gap, at, n = gaps.pop(0)
        size = stock.fitting(gap)
        if not size:
            continue
        got = min(n, stock.left[size])
        stock.place(plan, size, got, at)
        if got < n:
            gaps.insert(0, (gap, at + got, n - got))
        if gap > size:
            bisect.insort(gaps, (gap - size, at, got), key=lambda e: -e[0])


def _ranked(items: DataFrame, by: list[str], amount: str | None, total: int) -> DataFrame:
    """Adds ``rank``: how many rows (or how much ``amount``) come before a row among rows equal in ``by``.

    Rows are spread over hash buckets of about RANK_BUCKET rows; bucket totals give the offset, and only
    the rows of one bucket are ordered in one task.
    """
    buckets = max(1, -(-total // RANK_BUCKET))
    keyed = items.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, 11), {buckets}) as int)"))
    what = f"sum({amount})" if amount else "count(1)"
    part = ", ".join(by)
    head = keyed.groupBy(*by, "bucket").agg(F.expr(f"{what} as n")).withColumn("before", F.expr(f"sum(n) over ({'partition by ' + part if by else ''} order by bucket) - n")).drop("n")
    inner = f"{what if amount else 'row_number()'} over (partition by {', '.join([*by, 'bucket'])} order by doc_id{' rows unbounded preceding' if amount else ''})"
    return keyed.withColumn("inner", F.expr(inner)).join(head, [*by, "bucket"]).withColumn("rank", F.expr(f"before + inner - {amount or 1}")).drop("before", "inner", "bucket")


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, part, container_id, n_ids)`` for rows ``(doc_id, n_ids)``."""
    spark = sized.sparkSession
    scratch = Scratch(spark, "packing")
    kind = sized.schema["doc_id"].dataType.simpleString()
    items = scratch.write(
        sized.selectExpr("doc_id", "cast(coalesce(n_ids, 0) as bigint) as n_ids").selectExpr(
            "doc_id", f"case when n_ids > {capacity} then n_ids div {capacity} else 0L end as full", f"case when n_ids > {capacity} then n_ids % {capacity} else n_ids end as rest"
        ),
        "items",
    )
    hist = {r[0]: r[1] for r in items.groupBy("rest").count().collect()}  # at most capacity + 1 rows
    total = sum(hist.values())
    plan = make_plan({int(k): int(v) for k, v in hist.items() if k > 0}, capacity)
    big = items.where("full > 0").agg(F.count(F.lit(1)), F.sum("full")).first()
    every = max(1, plan.containers + int(big[1] or 0))
    runs = np.array(sorted(plan.run), np.int64).reshape(-1, 4)
    place = spark.sparkContext.broadcast((runs[:, 0] * (1 << 42) + runs[:, 1], runs[:, 1], runs[:, 3]))

    def assign(batches):
        keys, first, container = place.value
        for b in batches:
            size, rank = np.asarray(b.column(2)).astype(np.int64), np.asarray(b.column(3)).astype(np.int64)
            i = np.searchsorted(keys, size * (1 << 42) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(container[i] + rank - first[i]), pa.array(size)], ["doc_id", "part", "container_id", "n_ids"])

    out = f"doc_id {kind}, part bigint, container_id bigint, n_ids bigint"
    rests = _ranked(items.where("rest > 0"), ["rest"], None, total).selectExpr("doc_id", "full as part", "rest", "rank").mapInArrow(assign, out)
    cut = _ranked(items.where("full > 0").select("doc_id", "full"), [], "full", int(big[0] or 0))
    fulls = cut.selectExpr("doc_id", "explode(sequence(0L, full - 1)) as part", "rank").selectExpr("doc_id", "part", f"{plan.containers}L + rank + part as container_id", f"{capacity}L as n_ids")
    empty = items.where("rest = 0 and full = 0").selectExpr("doc_id", "0L as part", f"pmod(xxhash64(doc_id), {every}L) as container_id", "0L as n_ids")
    return rests.unionByName(fulls).unionByName(empty)


def check(packed: DataFrame, sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers above the capacity, documents, documents cut without need, and ids lost or doubled."""
    per = packed.groupBy("container_id").agg(F.sum("n_ids").alias("n")).agg(F.sum((F.col("n") > capacity).cast("bigint")).alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_ids").alias("got"), F.count(F.lit(1)).alias("parts"))
    want = sized.selectExpr("doc_id", "cast(coalesce(n_ids, 0) as bigint) as n_ids")
    whole = want.join(docs, "doc_id", "full").agg(
        F.count("parts").alias("documents"), F.sum(F.expr(f"cast(coalesce(parts, 0) <> greatest(1, ceil(n_ids / {capacity})) as bigint)")).alias("cut_wrongly"),
        F.sum(F.abs(F.coalesce("n_ids", F.lit(0)) - F.coalesce("got", F.lit(0)))).alias("ids_off"),
    )
    return per.join(whole)  # one row each


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers used, the least number possible by length alone, and the filled share."""
    per = packed.groupBy("container_id").agg(F.sum("n_ids").alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("ids"), F.max("n").alias("fullest")
    ).selectExpr("containers", f"cast(ceil(ids / {capacity}) as bigint) as least", "fullest", f"ids / (containers * {capacity}) as filled")
