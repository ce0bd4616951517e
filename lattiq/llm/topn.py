"""Top N items within every group, for groups of any size (problem 1).

Method: simultaneous per-group bisection.  Every item has an order-preserving code of two parts: the score
as an ordered integer and, below it, the complement of the identifier (smaller ids come first).  Each round
lays evenly spaced midpoints into the open interval of every unsettled group, counts the rows between them
for all groups in one aggregation, and keeps the one interval in which the N-th item lies, until the rows
above a cutoff are exactly N.  No group is ever sorted, collected or windowed row by row: a group with a
third of all rows costs the same number of rounds as a group of twenty.

Ties are consistent: higher score first, then the smaller id.  NaN and null scores and null ids are no
items; -0.0 equals 0.0; infinite scores are ordinary.  An item given several times in a group counts once
with its highest score.  Groups with fewer than N items give all; a null group gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scratch import Scratch

BITS = 5
"""A round splits each open interval into about 2**BITS parts, as BITS halvings at once would."""
HOT_ROWS = 100_000
"""Rows under one salt, about: a group with more is salted in joins."""
MOST_HOT = 100_000
"""Groups that can be salted, which bounds what is broadcast: beyond HOT_ROWS * MOST_HOT rows, the rows under one salt
grow to a MOST_HOT-th of all rows, which is no more than an even share of a task at that size."""


def entries(results: DataFrame, group: str = "query_id", ids: str = "passage_ids", scores: str = "scores") -> DataFrame:
    """``(g, item, score)`` of parallel lists; elements without partner, null or NaN are dropped."""
    zipped = f"filter(arrays_zip({ids}, {scores}), e -> e.{ids} is not null and e.{scores} is not null and not isnan(e.{scores}))"
    return results.where(f"{group} is not null").selectExpr(f"{group} as g", f"inline({zipped}) as (item, score)")


def ordered_code(score: str) -> str:
    """SQL for a float score as an integer in the same order (sign and magnitude turned to two's complement)."""
    bits = f"cast(java_method('java.lang.Float', 'floatToIntBits', {score} + 0.0f) as int)"
    return f"transform(array({bits}), b -> case when b >= 0 then cast(b as bigint) else -cast(b & 2147483647 as bigint) end)[0]"


def _bounds(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("code").alias("c_lo"), F.max("code").alias("c_hi"), F.min("inv").alias("i_lo"), F.max("inv").alias("i_hi"),
    )


def _open(b: DataFrame) -> DataFrame:
    """Bounds of the part of the code that still varies: the score, or among equal scores the id."""
    return b.selectExpr(
        "g", "salt", "need", "c_lo", "c_hi", "i_lo", "c_lo = c_hi as by_id",
        "greatest(0, cast(ceil(log2(case when c_lo = c_hi then cast(i_hi as double) - cast(i_lo as double) "
        f"else cast(c_hi as double) - cast(c_lo as double) end + 1)) as int) - {BITS}) as k",
    )


def top_n(items: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    """``(g, item, score)`` of the N best items of every group; ``items`` has exactly these columns."""
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "topn")
    best = items.groupBy("g", "item").agg(F.max("score").alias("score"))
    coded = best.selectExpr("g", "item", "score", f"{ordered_code('score')} as code", "~cast(item as bigint) as inv")
    rows = scratch.write(coded, "rows")

    groups = scratch.write(_bounds(rows, ["g"]), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    per_salt = max(HOT_ROWS, n, -(-total // MOST_HOT))
    hot = scratch.write(groups.where(f"n > {per_salt}").select("g", F.ceil(F.col("n") / per_salt).cast("int").alias("salts")), "hot")

    def salted(frame: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(hot), "g", "left").withColumn("salt", F.expr("case when salts is null then 0 else cast(pmod(xxhash64(item), salts) as int) end")).drop("salts")

    def spread(bounds: DataFrame) -> DataFrame:
        return bounds.join(F.broadcast(hot), "g", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")

    bounds = _open(spread(groups.where(f"n > {n}").withColumn("need", F.lit(n).cast("bigint"))))
    small = rows.join(F.broadcast(hot), "g", "left_anti")  # a hot group is not small, and its rows need not travel
    done: DataFrame = small.join(groups.where(f"n <= {n}").select("g"), "g", "left_semi").select("g", "item", "score")
    open_rows, turn = rows, 0
    while True:
        # midpoints: the open part of the code, cut at multiples of 2**k
        binned = (
            salted(open_rows)
            .join(bounds, ["g", "salt"])
            .selectExpr(
                "g", "item", "score", "code", "inv", "need",
                "case when by_id then shiftright(inv, k) - shiftright(i_lo, k) else shiftright(code, k) - shiftright(c_lo, k) end as bin",
            )
        )
        stored = binned if turn == 0 else scratch.write(binned, f"binned{turn}")
        counts = _bounds(stored, ["g", "need", "bin"]).withColumn("upto", F.expr("sum(n) over (partition by g order by bin desc)"))
        # the bin in which the N-th item lies; above it all rows are in, below it all are out
        cut = scratch.write(
            counts.where("upto >= need and upto - n < need").selectExpr("g", "bin as cut", "upto = need as exact", "need - upto + n as need", "c_lo", "c_hi", "i_lo", "i_hi"),
            f"cut{turn}",
        )
        # cut bins never hold more groups than are open; hot groups are salted again on the way
        kept = salted(stored.drop("need")).join(spread(cut.select("g", "cut", "exact")), ["g", "salt"]).where("bin >= cut")
        kept = scratch.write(kept.selectExpr("g", "item", "score", "code", "inv", "bin > cut or exact as chosen"), f"kept{turn}")
        done = done.unionByName(kept.where("chosen").select("g", "item", "score"))
        left = cut.where("not exact")
        if left.isEmpty():
            return done
        if turn:
            scratch.drop(f"binned{turn}")
        open_rows = kept.where("not chosen").select("g", "item", "score", "code", "inv")
        bounds = _open(spread(left.drop("cut", "exact")))
        turn += 1


def ranked(top: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 inside each group of at most N rows."""
    return top.withColumn("rank", F.expr("row_number() over (partition by g order by score desc, item)"))
