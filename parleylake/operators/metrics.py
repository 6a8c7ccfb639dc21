"""Evaluation metrics over prediction rows: routing, residuals, accounting, comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conversations import DECISIONS


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted", labels: tuple[str, ...] = DECISIONS) -> DataFrame:
    """(actual, predicted, n) with every cell of the matrix, empty ones as 0."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    counted = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def routing(rows: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Call precision, recall and F1, per-class recall, under- and over-call rates; 0 where a class is empty."""
    a, p = F.col(actual), F.col(predicted)
    n = F.count_if
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        n((a == "CALL") & (p == "CALL")).alias("tp"), n(p == "CALL").alias("called"), n(a == "CALL").alias("calls"),
        *(n((a == c) & (p == c)).alias(f"{c}_ok") for c in DECISIONS[1:]), *(n(a == c).alias(f"{c}_n") for c in DECISIONS[1:]),
        n((a == "CALL") & (p == "ANSWER")).alias("under"), n((a != "CALL") & (p == "CALL")).alias("over"),
    )
    rated = counts.withColumn("call_precision", _rate(F.col("tp"), F.col("called"))).withColumn("call_recall", _rate(F.col("tp"), F.col("calls")))
    both = F.col("call_precision") + F.col("call_recall")
    return rated.select(
        *by, "n", "call_precision", "call_recall",
        F.when(both > 0, 2 * F.col("call_precision") * F.col("call_recall") / both).otherwise(0.0).alias("call_f1"),
        _rate(F.col("ANSWER_ok"), F.col("ANSWER_n")).alias("no_call_accuracy"),
        _rate(F.col("CLARIFY_ok"), F.col("CLARIFY_n")).alias("clarification_accuracy"),
        _rate(F.col("UNSUPPORTED_ok"), F.col("UNSUPPORTED_n")).alias("unsupported_accuracy"),
        _rate(F.col("under"), F.col("calls")).alias("under_call_rate"),
        _rate(F.col("over"), F.col("n") - F.col("calls")).alias("over_call_rate"),
    )


def residual(actual: Column, predicted: Column, status: Column, truncated: Column) -> Column:
    """What went wrong first: a format error, a missed call, a needless call, a stop too early; else null."""
    return (
        F.when(status == "FORMAT_ERROR", "FORMAT_ERROR")
        .when((actual == "CALL") & (predicted != "CALL"), "UNDER_CALL")
        .when((actual != "CALL") & (predicted == "CALL"), "OVER_CALL")
        .when(truncated, "PREMATURE_STOP")
    )


def residual_rates(rows: DataFrame) -> DataFrame:
    """(residual, n, rate) over rows with actual, predicted, status, truncated."""
    marked = rows.select(residual(F.col("actual"), F.col("predicted"), F.col("status"), F.col("truncated")).alias("residual"))
    total = marked.agg(F.count("*").alias("total"))
    counted = marked.where("residual is not null").groupBy("residual").agg(F.count("*").alias("n"))
    return counted.select("residual", "n", (F.col("n") / total.scalar()).alias("rate"))


def accounting(rows: DataFrame, by: list[str]) -> DataFrame:
    """Four buckets that add up: correct, wrong after an attempt, refused, not parsed; accuracy of attempts is null without one.

    ``rows``: correct boolean, refused boolean, parsed boolean.
    """
    bucket = F.when(F.col("correct"), "correct").when(F.col("refused"), "refusals").when(~F.col("parsed"), "parse_failures").otherwise("incorrect_attempted")
    counts = rows.withColumn("bucket", bucket).groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("bucket") == b).alias(b) for b in ("correct", "incorrect_attempted", "refusals", "parse_failures")))
    attempts = F.col("correct") + F.col("incorrect_attempted")
    return counts.withColumn("accuracy", F.col("correct") / F.col("total")).withColumn("accuracy_given_answer", F.when(attempts > 0, F.col("correct") / attempts))


def task_metrics(tasks: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, mean of positive latencies and tokens a second; ``tasks``: success, latency, tokens."""
    timed = F.when(F.col("latency") > 0, F.col("latency"))
    return tasks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("accuracy"), F.avg(timed).alias("mean_latency"), (F.sum(F.when(F.col("latency") > 0, F.col("tokens"))) / F.sum(timed)).alias("tokens_per_second"))


def clusters(failures: DataFrame, code: Column, ident: str, samples: int = 3) -> DataFrame:
    """(code, n, share, first ids): failures by code, the most common first."""
    named = failures.select(code.alias("code"), F.col(ident).alias("id"))
    total = named.agg(F.count("*").alias("t"))
    ranked = named.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nth") <= samples).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return named.groupBy("code").agg(F.count("*").alias("n")).join(ranked, "code").select("code", "n", (F.col("n") / total.scalar()).alias("share"), "samples").orderBy(F.col("n").desc(), "code")


def exactly_once(left: DataFrame, right: DataFrame, ident: str) -> DataFrame:
    """(problem, n) of a join that has to be one to one: unknown, missing and repeated ids; no rows if it holds."""
    l, r = left.groupBy(ident).agg(F.count("*").alias("l")), right.groupBy(ident).agg(F.count("*").alias("r"))
    problem = F.when(F.col("l").isNull(), "UNKNOWN").when(F.col("r").isNull(), "MISSING").when((F.col("l") > 1) | (F.col("r") > 1), "DUPLICATE")
    return l.join(r, ident, "full").select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def flips(base: DataFrame, candidate: DataFrame, ident: str = "example_id") -> DataFrame:
    """(flip, n) of predictions that differ: fixed, broke, or lateral. Sides: id, gold, predicted."""
    joined = base.select(ident, "gold", F.col("predicted").alias("b")).join(candidate.select(ident, F.col("predicted").alias("c")), ident).where("b <> c")
    kind = F.when(F.col("c") == F.col("gold"), "fixed").when(F.col("b") == F.col("gold"), "broke").otherwise("lateral")
    return joined.groupBy(kind.alias("flip")).agg(F.count("*").alias("n"))


def transitions(base: DataFrame, candidate: DataFrame, ident: str = "example_id") -> DataFrame:
    """(transition, n): ``a->b`` of predictions that changed on shared ids."""
    joined = base.select(ident, F.col("predicted").alias("b")).join(candidate.select(ident, F.col("predicted").alias("c")), ident).where("b <> c")
    return joined.groupBy(F.concat_ws("->", "b", "c").alias("transition")).agg(F.count("*").alias("n"))


def failure_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys with new, fixed or persistent."""
    b, a = before.select(*keys).distinct().withColumn("b", F.lit(True)), after.select(*keys).distinct().withColumn("a", F.lit(True))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "fixed").otherwise("persistent")
    return b.join(a, keys, "full").select(*keys, state.alias("state"))


def compare_filled(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """before, after and delta of each key of either side; a missing value is 0."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full").select(key, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def compare_shared(before: DataFrame, after: DataFrame, key: str, value: str, lower_is_better: tuple[str, ...] = (), tolerance: float = 0.0) -> DataFrame:
    """delta and verdict of the keys that both sides have."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    delta = F.col("after") - F.col("before")
    gain = F.when(F.col(key).isin(*lower_is_better), -delta).otherwise(delta) if lower_is_better else delta
    return b.join(a, key).select(key, "before", "after", delta.alias("delta"), F.when(gain > tolerance, "IMPROVED").when(gain < -tolerance, "REGRESSED").otherwise("UNCHANGED").alias("verdict"))


def parity(left: DataFrame, right: DataFrame, order: list[str], value: str, parts: list[str]) -> DataFrame:
    """(parts, pairs, equal): two runs laid side by side by position within each part, up to the shorter."""
    w = Window.partitionBy(*parts).orderBy(*order)
    l = left.select(*parts, F.row_number().over(w).alias("nth"), F.col(value).alias("l"))
    r = right.select(*parts, F.row_number().over(w).alias("nth"), F.col(value).alias("r"))
    return l.join(r, [*parts, "nth"]).groupBy(*parts).agg(F.count("*").alias("pairs"), F.count_if(F.col("l").eqNullSafe(F.col("r"))).alias("equal"))


def pareto(rows: DataFrame, name: str, goods: list[str]) -> DataFrame:
    """Rows that no other row is at least as good as in everything and better in something.

    Best-first order by the first good needs only earlier rows, but any pair may decide: a candidate
    list of runs or models, not a corpus.
    """
    other = rows.select(F.col(name).alias("__other"), *(F.col(g).alias(f"__{g}") for g in goods))
    as_good, better, differs = F.lit(True), F.lit(False), F.col("__other") != F.col(name)
    for g in goods:
        as_good, better = as_good & (F.col(f"__{g}") >= F.col(g)), better | (F.col(f"__{g}") > F.col(g))
    return rows.join(other, differs & as_good & better, "left_anti")


def depth_acceptance(rows: DataFrame, floor: float = 0.30) -> DataFrame:
    """Acceptance by speculative depth, on its own and given the depth before; ``rows``: depth, drafted, accepted."""
    by = rows.groupBy("depth").agg(F.sum("drafted").alias("drafted"), F.sum("accepted").alias("accepted"))
    rate = F.when(F.col("drafted") > 0, F.col("accepted") / F.col("drafted")).otherwise(0.0)
    before = F.lag("acceptance").over(Window.orderBy("depth"))
    return by.withColumn("acceptance", rate).withColumn("conditional", F.when(before.isNull(), F.col("acceptance")).when(before > 0, F.col("acceptance") / before).otherwise(0.0)).withColumn("useful", F.col("acceptance") >= floor)
