"""Preference data: disagreement pairs, rule judge, assembly under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def disagreement_pairs(left: DataFrame, right: DataFrame, cap: int, seed: str) -> DataFrame:
    """(example_id, gold, chosen, rejected) where exactly one of two outputs is right; per class at most ``cap`` by hash.

    Sides: example_id, gold, decision, output.
    """
    joined = left.alias("l").join(right.alias("r"), "example_id")
    l_ok, r_ok = F.col("l.decision") == F.col("l.gold"), F.col("r.decision") == F.col("l.gold")
    one = joined.where(l_ok != r_ok).select("example_id", F.col("l.gold").alias("gold"), F.when(l_ok, F.col("l.output")).otherwise(F.col("r.output")).alias("chosen"), F.when(l_ok, F.col("r.output")).otherwise(F.col("l.output")).alias("rejected")).where("chosen <> rejected")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("gold").orderBy(T.rank_key(seed, F.col("gold"), "example_id"), "example_id"))).where(F.col("rank") <= cap).drop("rank")


def judge_score(text: Column, wants_call: Column, max_chars: int = 2000) -> Column:
    """Additive rule score of a candidate reply: a call where one is wanted, no empty, endless or declining text."""
    called = text.contains("<tool_call>")
    return F.when(called == wants_call, 2.0).otherwise(-2.0) + F.when(F.trim(text) == "", -3.0).otherwise(0.0) + F.when(F.length(text) > max_chars, -1.0).otherwise(0.0) + F.when(T.refusal(text).isNotNull(), -1.0).otherwise(0.5)


def judged_pairs(candidates: DataFrame, margin: float = 1.5) -> DataFrame:
    """(prompt, chosen, rejected, gap): a prompt's best and worst candidate, where they are far enough apart. ``candidates``: prompt, text, score."""
    best = candidates.groupBy("prompt").agg(F.max(F.struct("score", "text")).alias("b"), F.min(F.struct("score", "text")).alias("w"))
    return best.select("prompt", F.col("b.text").alias("chosen"), F.col("w.text").alias("rejected"), (F.col("b.score") - F.col("w.score")).alias("gap")).where((F.col("gap") >= margin) & (F.col("chosen") != F.col("rejected")))


def assemble(pairs: DataFrame, by: str, quota: int, seed: str, ident: str, forbidden: list[str]) -> DataFrame:
    """Pairs without sensitive literals, so many a class by hash, in one hash order."""
    clean = pairs
    for literal in forbidden:
        clean = clean.where(~F.col("chosen").contains(literal) & ~F.col("rejected").contains(literal))
    ranked = clean.dropDuplicates(["chosen", "rejected"]).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(T.rank_key(seed, F.col(by), ident), ident)))
    return ranked.where(F.col("rank") <= quota).drop("rank").withColumn("order_key", T.order_key(seed, ident))
