"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Target words of each source follow from weights (water-filled under ``most`` times its size). Rates
r in (0, most) of the documents of a source are those closest, in entropy, to the overall share
whose words meet the target: r = most / (1 + exp(-(a + lambda * z))), an exponential tilt by z =
size over the source's mean size, where ``a`` gives the overall share. Lambda solves the convex dual by Newton
steps, each one aggregate over a (source, size, count) histogram, for all sources at once; sums are
exact decimals, so reruns agree whatever the order of rows. Rates become whole copies by rounding
running totals from long documents to short ones, and what is missing or over is then put right on
the shortest documents, cell by cell. Ties inside a cell go by a hash of the id.

Defined results: a null or wordless text has size 0 and takes nothing; a source without words has
target 0; null is a source of its own, after all others; repeated ids are rows of their own. Empty
tables give an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EXACT = "decimal(38,9)"
#: Rows of one (source, size) cell that a task ranks at a time.
CELL = 4096


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text: the places where one begins."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target; a row for each source, so the windows hold only those.

    The level mu of ``target = least(most * size, mu * weight)`` is found exactly: sources are put in
    the order in which they fill up, and mu is what the first level gives at which the next one is not full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1)
    picked = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", picked).withColumn("limit", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("rank"))
    filled = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = full.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum("limit").over(filled), F.lit(0.0)).alias("below"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("open"),
    ).withColumn("mu", (F.col("budget") - F.col("below")) / F.col("open"))
    level = level.withColumn("fill", F.row_number().over(fill))
    first = F.min(F.when(F.col("mu") * F.col("weight") <= F.col("limit"), F.struct("fill", "mu"))).over(everything)
    return level.withColumn("level", first["mu"]).select("source", "source_size", "rank", "weight", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))


def _rate(most: float) -> Column:
    at = F.col("start") + F.col("lambda") * F.col("z")
    return F.when(F.col("full"), F.lit(most)).when(F.col("none"), F.lit(0.0)).otherwise(F.lit(most) / (1 + F.exp(-F.greatest(F.least(at, F.lit(500.0)), F.lit(-500.0)))))


def solve(cells: DataFrame, state: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0, steps: int = 60, close: float = 1e-7) -> DataFrame:
    """The dual variable of every source.

    ``cells``: rank, size, n; ``state``: rank, source_size, target, mean. A Newton step that leaves
    the bracket found so far is replaced by its middle.
    """
    state = state.select(
        "rank", "target", "mean",
        (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
        (F.col("target") <= 0).alias("none"),
        F.lit(math.log(share / (most - share))).alias("start"), F.lit(0.0).alias("lambda"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"),
    )
    state = scratch.table(state, "dual")
    for _ in range(steps):
        rate = _rate(most)
        tilted = cells.join(state, "rank").withColumn("z", F.col("size") / F.col("mean")).withColumn("words", F.col("size") * F.col("n")).withColumn("rate", rate)
        sums = tilted.groupBy("rank").agg(
            F.sum((F.col("words") * F.col("rate")).cast(EXACT)).cast("double").alias("taken"),
            F.sum((F.col("words") * F.col("z") * F.col("rate") * (1 - F.col("rate") / most)).cast(EXACT)).cast("double").alias("slope"),
        )
        gap = F.col("target") - F.col("taken")
        fixed = F.col("full") | F.col("none") | (F.abs(gap) <= F.greatest(F.col("target") * close, F.lit(1e-6)))
        low, high = F.when(gap > 0, F.greatest("low", "lambda")).otherwise(F.col("low")), F.when(gap < 0, F.least("high", "lambda")).otherwise(F.col("high"))
        newton = F.col("lambda") + gap / F.greatest("slope", F.lit(1e-12))
        stepped = state.join(sums, "rank", "left").select(
            "rank", "target", "mean", "full", "none", "start", F.coalesce(fixed, F.lit(True)).alias("done"),
            low.alias("low"), high.alias("high"), newton.alias("newton"), F.col("lambda").alias("old"),
        )
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = F.when(F.col("done"), F.col("old")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = scratch.table(stepped.select("rank", "target", "mean", "full", "none", "start", F.round(moved, 12).alias("lambda"), "low", "high", "done"), "dual")
        if not state.where(~F.col("done")).limit(1).count():
            break
        state = state.drop("done")
    return state.drop("done")


def mix(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source, size, source_size, target, rate, copies, taken: a row for each document."""
    measured = scratch.table(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), sizes(docs, text).alias("size")), "sizes")
    totals = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("worded"))
    goal = scratch.table(targets(totals, weights, share, float(most)).join(totals.select(F.col("source").alias("s"), "worded"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    # a row for each source; Spark broadcasts it while it is small
    ranked = measured.join(goal.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = scratch.table(ranked.where("size > 0").groupBy("rank", "size").agg(F.count("*").alias("n")), "cells")
    dual = solve(cells, goal.withColumn("mean", F.col("source_size") / F.greatest("worded", F.lit(1))), scratch, share, float(most))

    # whole copies a cell: round running totals from long to short
    down = Window.partitionBy("rank").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rated = cells.join(dual, "rank").withColumn("z", F.col("size") / F.col("mean")).withColumn("rate", F.round(_rate(float(most)), 9))
    run = rated.withColumn("until", F.sum((F.col("rate") * F.col("n")).cast(EXACT)).over(down))
    before = F.coalesce(F.lag("until").over(Window.partitionBy("rank").orderBy(F.col("size").desc())), F.lit(0).cast(EXACT))
    counted = run.withColumn("whole", (F.round("until", 0) - F.round(before, 0)).cast("long")).withColumn("whole", F.greatest(F.lit(0).cast("long"), F.least(F.col("whole"), F.col("n") * most)))

    # what is missing or over is put right on the shortest documents
    everything = Window.partitionBy("rank")
    up = Window.partitionBy("rank").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    missing = counted.withColumn("missing", F.round(F.col("target") - F.sum(F.col("whole") * F.col("size")).over(everything)).cast("long"))
    room = missing.withColumn("room", F.when(F.col("missing") > 0, F.col("n") * most - F.col("whole")).otherwise(F.col("whole")))
    left = room.withColumn("left", F.abs("missing") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(up), F.lit(0).cast("long")))
    moved = F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.floor(F.col("left") / F.col("size"))))
    final = left.select("rank", F.col("size"), "n", F.round("rate", 9).alias("rate"), (F.col("whole") + F.when(F.col("missing") > 0, moved).otherwise(-moved)).alias("whole"))

    # copies of each document: a cell's documents in runs of about CELL, ranked by hash inside a run
    final = scratch.table(final, "copies")
    # several rows may have one id and so one hash: any order of them gives the same multiset of results
    placed = ranked.where("size > 0").join(final, ["rank", "size"]).withColumn("run", F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / CELL))))
    runs = placed.groupBy("rank", "size", "run").agg(F.count("*").alias("docs"))
    offset = runs.withColumn("offset", F.coalesce(F.sum("docs").over(Window.partitionBy("rank", "size").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("docs")
    inside = Window.partitionBy("rank", "size", "run").orderBy(F.xxhash64("id", F.lit(2)), "id")
    numbered = placed.withColumn("nth", F.row_number().over(inside)).join(offset, ["rank", "size", "run"]).withColumn("nth", F.col("nth") + F.col("offset"))
    copies = F.floor(F.col("whole") / F.col("n")) + F.when(F.col("nth") <= F.col("whole") % F.col("n"), 1).otherwise(0)
    some = numbered.select("id", "rank", "size", "rate", copies.cast("long").alias("copies"))
    empty = ranked.where("size = 0").select("id", "rank", "size", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    return (
        some.unionByName(empty)
        .join(goal.select("rank", "source", "source_size", "target"), "rank")
        .select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
