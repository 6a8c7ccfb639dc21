"""Mixtures, yields and gates: shares, per-source yields, ablation mass, weights, and rule gates over metric rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """(by, samples, sample_share, tokens, token_share)."""
    w = weight if weight is not None else F.lit(1)
    counted = rows.groupBy(by).agg(F.count("*").alias("samples"), F.sum(w).cast("long").alias("tokens"))
    every = Window.partitionBy()
    return counted.select(by, "samples", (F.col("samples") / F.sum("samples").over(every)).alias("sample_share"), "tokens", F.when(F.sum("tokens").over(every) > 0, F.col("tokens") / F.sum("tokens").over(every)).otherwise(0.0).alias("token_share"))


def yields(rows: DataFrame, by: str) -> DataFrame:
    """Counts along the way to training and their ratios; ``rows``: rendered, trainable, call_target booleans."""
    counted = rows.groupBy(by).agg(F.count("*").alias("canonical"), *(F.count_if(F.col(c)).alias(c) for c in ("rendered", "trainable", "call_target")))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counted.withColumn("render_yield", ratio("rendered", "canonical")).withColumn("trainable_yield", ratio("trainable", "rendered")).withColumn("call_share", ratio("call_target", "trainable"))


def yield_gate(measured: DataFrame, expected: DataFrame, by: str, collapse: float = 0.5, anomaly: float = 0.9) -> DataFrame:
    """verdict of each source's yield against what is expected of it; sources without an expectation are NOT_EXPECTED."""
    joined = measured.join(expected.select(by, F.col("expected")), by, "left")
    ratio = F.when(F.col("expected") > 0, F.col("trainable_yield") / F.col("expected"))
    verdict = F.when(ratio.isNull(), "NOT_EXPECTED").when(ratio < collapse, "COLLAPSE").when(ratio < anomaly, "ANOMALY").otherwise("OK")
    return joined.select(by, "trainable_yield", "expected", verdict.alias("verdict"))


def ablation(rows: DataFrame, source: str, tokens: str, excluded: str, steps: int) -> DataFrame:
    """(variant, records, tokens, mean, median, longest, matched_steps) with and without one source."""
    variants = rows.select(F.explode(F.when(F.col(source) == excluded, F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("without")))).alias("variant"), F.col(tokens).alias("t"))
    counted = variants.groupBy("variant").agg(F.count("*").alias("records"), F.sum("t").alias("tokens"), F.avg("t").alias("mean"), F.percentile("t", 0.5).alias("median"), F.max("t").alias("longest"))
    whole = F.max(F.when(F.col("variant") == "full", F.col("tokens"))).over(Window.partitionBy())
    return counted.withColumn("matched_steps", F.bround(F.lit(steps) * F.col("tokens") / whole, 0).cast("long"))


def residual_weights(failures: DataFrame, capability: DataFrame, floor: float = 0.05, cap: float = 0.5) -> DataFrame:
    """(capability, weight): failures summed by capability, shares floored and capped, then made to add up again.

    ``failures``: code, n; ``capability``: code, capability.
    """
    summed = failures.join(capability, "code").groupBy("capability").agg(F.sum("n").alias("n"))
    every = Window.partitionBy()
    bounded = summed.withColumn("w", F.greatest(F.lit(floor), F.least(F.lit(cap), F.col("n") / F.sum("n").over(every))))
    return bounded.select("capability", (F.col("w") / F.sum("w").over(every)).alias("weight"))


CHECKS = "gate string, dimension string, observed double, requirement double, passed boolean, code string"


def check(name: str, dimension: Column, observed: Column, requirement: Column, at_least: bool = True, digits: int = 6) -> Column:
    """One long-format check: null where it can't be measured."""
    o, r = F.bround(observed.cast("double"), digits), F.bround(requirement.cast("double"), digits)
    passed = (o >= r) if at_least else (o <= r)
    code = F.when(observed.isNull(), "NOT_EVALUABLE").when(passed, "PASS").otherwise("FAIL")
    return F.struct(F.lit(name).alias("gate"), dimension.alias("dimension"), observed.cast("double").alias("observed"), requirement.cast("double").alias("requirement"), passed.alias("passed"), code.alias("code"))


def promotion(candidate: DataFrame, parent: DataFrame, floors: dict[str, float], ceilings: dict[str, float], retention: dict[str, float]) -> DataFrame:
    """Check rows of a candidate against fixed floors and ceilings and against its parent. Both: metric, value."""
    c = candidate.select("metric", F.col("value").alias("c")).join(parent.select("metric", F.col("value").alias("p")), "metric", "full")
    parts = []
    for name, values, at_least, relative in (("floor", floors, True, False), ("ceiling", ceilings, False, False), ("retention", retention, True, True)):
        if values:
            spec = candidate.sparkSession.createDataFrame(list(values.items()), "metric string, limit double")
            need = F.col("limit") * F.col("p") if relative else F.col("limit")
            parts.append(spec.join(c, "metric", "left").select(check(name, F.col("metric"), F.col("c"), need, at_least).alias("k")).select("k.*"))
    return reduce(DataFrame.unionByName, parts)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: FAIL before NOT_EVALUABLE before PASS; no checks at all fail."""
    n = F.count_if
    return checks.agg(F.count("*").alias("checked"), n(F.col("code") == "PASS").alias("passed"), n(F.col("code") == "FAIL").alias("failed"), n(F.col("code") == "NOT_EVALUABLE").alias("not_evaluable")).withColumn(
        "verdict", F.when((F.col("failed") > 0) | (F.col("checked") == 0), "FAIL").when(F.col("not_evaluable") > 0, "BLOCKED").otherwise("PASS")
    )


def poststratified(sample: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """One row: precision of flagged items weighted by population; null and the strata without a sample if any.

    ``sample``: stratum, flagged, hit booleans; ``population``: stratum, size.
    """
    counts = sample.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(F.col("flagged")).alias("predicted"), F.count_if(F.col("flagged") & F.col("hit")).alias("hits"))
    joined = population.join(counts, stratum, "left")
    weight = F.col("size") / F.col("n")
    out = joined.agg(F.sum(weight * F.col("hits")).alias("a"), F.sum(weight * F.col("predicted")).alias("b"), F.count_if(F.col("n").isNull()).alias("uncovered"))
    return out.select("uncovered", F.when((F.col("uncovered") == 0) & (F.col("b") > 0), F.col("a") / F.col("b")).alias("precision"))
