"""Deduplication and identity: first-wins, repeat suffixes, greedy multi-key, fingerprints and overlaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Column, order: list[str], ident: str) -> DataFrame:
    """Rows with ``kept`` and ``duplicate_of``: the first of each key stays."""
    group = Window.partitionBy("__key").orderBy(*order)
    marked = rows.withColumn("__key", key).withColumn("__n", F.row_number().over(group)).withColumn("__first", F.first(ident).over(group))
    return marked.withColumn("kept", F.col("__n") == 1).withColumn("duplicate_of", F.when(F.col("__n") > 1, F.col("__first"))).drop("__key", "__n", "__first")


def repeat_suffix(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``unique_id``: the key, with ``#n`` on its nth repetition."""
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return rows.withColumn("__key", key).withColumn("__n", nth).withColumn("unique_id", F.when(F.col("__n") == 1, F.col("__key")).otherwise(F.concat("__key", F.lit("#"), F.col("__n").cast("string")))).drop("__key", "__n")


def groups(rows: DataFrame, key: Column, ident: str) -> DataFrame:
    """(key, n, first): keys that several rows have."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(ident).alias("first")).where("n > 1")


def greedy(rows: DataFrame, ident: str, order: list[str], keys: list[str], rounds: int = 50) -> DataFrame:
    """Rows that survive when they are taken in order and one goes if a survivor has any of its keys.

    A row that is first on all of its keys survives; whatever shares a key with a survivor goes; the rest
    is looked at again. That is the sequential rule, in as many rounds as its longest chain of decisions.
    Rows left after ``rounds`` (long chains) are settled in order, a connected chain at a time.
    """
    by = list(dict.fromkeys([*order, ident]))
    pending = rows.withColumn("__rank", F.struct(*(F.col(c).alias(f"o_{c}") for c in by)))
    kept = None
    for _ in range(rounds):
        least = pending
        for key in keys:
            first = pending.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__rank").alias(f"__min_{key}"))
            least = least.join(first, key, "left")
        sure = least.where(" and ".join(f"(`{k}` is null or `__min_{k}` = `__rank`)" for k in keys)).select(pending.columns).checkpoint()
        kept = sure if kept is None else kept.unionByName(sure)
        pending = pending.join(sure.select(ident), ident, "left_anti")
        for key in keys:
            pending = pending.join(sure.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        pending = pending.select(sure.columns).checkpoint()
        if pending.isEmpty():
            return kept.drop("__rank")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[set] = [set() for _ in keys]
        good = []
        for row in pdf.sort_values(by).itertuples(index=False):
            own = [getattr(row, k) for k in keys]
            free = not any(v is not None and v in seen for v, seen in zip(own, taken, strict=True))
            good.append(free)
            if free:
                for v, seen in zip(own, taken, strict=True):
                    seen.add(v)
        return pdf.sort_values(by)[good]

    rest = pending.drop("__rank")
    return kept.drop("__rank").unionByName(rest.groupBy(F.lit(0).alias("all")).applyInPandas(settle, rest.schema))


def fingerprint_rows(rows: DataFrame, order: list[str], parts: list[Column], by: list[str], separator: str = "\n") -> DataFrame:
    """(by, n, fingerprint): sha256 of each group's parts in order."""
    line = F.concat_ws(":", *parts)
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), items.alias("items")).select(*by, "n", F.sha2(F.array_join(F.transform("items", lambda i: i["__line"]), separator), 256).alias("fingerprint"))


def population_fingerprint(rows: DataFrame, value: Column, trailing: bool = False, separator: str = "\n", buckets: int = 256) -> DataFrame:
    """(n, fingerprint): sha256 of the sorted values, joined.

    The values of one population make one text, so this is for id lists that fit a task; see ``merkle_fingerprint``.
    """
    joined = F.array_join(F.array_sort(F.collect_list(value)), separator)
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat(joined, F.lit(separator)) if trailing else joined, 256).alias("fingerprint"))


def merkle_fingerprint(rows: DataFrame, value: Column, depth: int = 4) -> DataFrame:
    """(n, fingerprint) whatever the order and size: sorted hashes are hashed by their first hex digits, and those once more."""
    hashed = rows.select(F.sha2(value.cast("string"), 256).alias("h"))
    parts = hashed.groupBy(F.substr("h", F.lit(1), F.lit(depth)).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("f"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "f"))), lambda x: x["f"]), "\n"), 256).alias("fingerprint"))


def overlaps(rows: DataFrame, source: str, keys: dict[str, Column], drop_empty: bool = True) -> DataFrame:
    """(left, right, key, shared): for each pair of sources and each key, the values that both have."""
    each = F.array(*(F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")) for name, value in keys.items()))
    values = rows.select(F.col(source).alias("source"), F.explode(each).alias("e")).select("source", "e.key", "e.value").where("value is not null")
    if drop_empty:
        values = values.where("value <> ''")
    values = values.distinct()
    left, right = values.select(F.col("source").alias("left"), "key", "value"), values.select(F.col("source").alias("right"), "key", "value")
    return left.join(right, ["key", "value"]).where(F.col("left") < F.col("right")).groupBy("left", "right", "key").agg(F.count("*").alias("shared"))


def exact_overlap(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Distinct keys that both sides have."""
    return left.select(key.alias("key")).intersect(right.select(key.alias("key")))
