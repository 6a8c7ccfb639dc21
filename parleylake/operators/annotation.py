"""Annotation analytics: composite labels, disagreements, consensus, progress, history chains, ledgers and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite(labels: DataFrame, sessions: list[str]) -> DataFrame:
    """(item, session, label): of the sessions in order, the first that labelled the item. ``labels``: item, session, label."""
    place = F.array_position(F.array(*(F.lit(s) for s in sessions)), F.col("session"))
    ranked = labels.where(F.col("label").isNotNull() & (place > 0)).groupBy("item").agg(F.min(F.struct(place.alias("o"), "session", "label")).alias("m"))
    return ranked.select("item", "m.session", "m.label")


def disagreements(labels: DataFrame, left: str, right: str, nulls: bool = False) -> DataFrame:
    """(item, left, right) where two sessions differ; with ``nulls`` an item of one session only counts too."""
    l = labels.where(F.col("session") == left).select("item", F.col("label").alias("left"))
    r = labels.where(F.col("session") == right).select("item", F.col("label").alias("right"))
    joined = l.join(r, "item", "full" if nulls else "inner")
    return joined.where(~F.col("left").eqNullSafe(F.col("right")) if nulls else F.col("left") != F.col("right"))


def consensus(labels: DataFrame) -> DataFrame:
    """(item, n, label, kind): unanimous, majority or none of an item's labels."""
    counts = labels.where("label is not null").groupBy("item", "label").agg(F.count("*").alias("k"))
    best = counts.groupBy("item").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("top"))
    major = F.col("top.k") * 2 > F.col("n")
    return best.select("item", "n", F.when(major, F.col("top.label")).alias("label"), F.when(F.col("top.k") == F.col("n"), "unanimous").when(major, "majority").otherwise("none").alias("kind"))


def agreement_matrix(labels: DataFrame) -> DataFrame:
    """(left, right, n, equal) over the items that both sessions labelled."""
    l, r = labels.select("item", F.col("session").alias("left"), F.col("label").alias("a")), labels.select("item", F.col("session").alias("right"), F.col("label").alias("b"))
    return l.join(r, "item").where(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


def progress(items: DataFrame, labels: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(session, label, n, done, total): every label of the vocabulary for every session, unused ones as 0."""
    spark = items.sparkSession
    total = items.agg(F.count("*").alias("t"))
    own = labels.where("label is not null").groupBy("session", "label").agg(F.count("*").alias("n"))
    done = labels.where("label is not null").groupBy("session").agg(F.count_distinct("item").alias("done"))
    grid = done.select("session", "done", F.explode(F.array(*(F.lit(v) for v in vocabulary))).alias("label"))
    return grid.join(own, ["session", "label"], "left").select("session", "label", F.coalesce("n", F.lit(0)).alias("n"), "done", total.scalar().alias("total"))


def review_queue(items: DataFrame, flagged: DataFrame, labels: list[str], sample: int, seed: str) -> DataFrame:
    """(item, reason): flagged items, then those of certain labels, then a hash sample of the rest; each once. ``items``: item, label."""
    marked = items.join(flagged.select("item").distinct().withColumn("f", F.lit(True)), "item", "left")
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col("item").cast("string")), 256)
    reason = F.when(F.col("f"), "FLAGGED").when(F.col("label").isin(labels), "LABEL")
    taken = marked.withColumn("reason", reason).withColumn("key", key)
    rest = taken.where("reason is null").orderBy("key", "item").limit(sample).withColumn("reason", F.lit("SAMPLE"))
    return taken.where("reason is not null").unionByName(rest).select("item", "reason", "key")


def chain_hash(previous: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), *parts), 256)


def verify_chain(entries: DataFrame, order: str, parts: list[str], by: list[str]) -> DataFrame:
    """(by, entries, broken): entries whose stored previous hash, or own hash, is not what it should be."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag("hash").over(w)
    good = F.col("prev_hash").eqNullSafe(before) & (F.col("hash") == chain_hash(F.col("prev_hash"), *(F.col(p).cast("string") for p in parts)))
    return entries.withColumn("good", good).groupBy(*by).agg(F.count("*").alias("entries"), F.count_if(~F.col("good")).alias("broken"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    fields = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("e")).select(key, "e.*")


def headline(points: DataFrame, by: str, promoted: DataFrame, order: list[str], ident: str) -> DataFrame:
    """Of each run's points, the promoted id's first one, else the last. ``promoted``: by, promoted."""
    joined = points.join(promoted, by, "left")
    rank = F.struct(*order)
    picked = joined.groupBy(by).agg(F.min_by(F.struct(*points.columns), F.when(F.col(ident) == F.col("promoted"), rank)).alias("a"), F.max_by(F.struct(*points.columns), rank).alias("b"))
    return picked.select(F.coalesce("a", "b").alias("x")).select("x.*")


def drift(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind, expected, actual): rows and fields of an index that differ from what it derives from."""
    e = expected.select(key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("e"))
    a = actual.select(key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("a"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").alias("x"), F.col(f"a.{f}").alias("y")) for f in fields))).alias("c")
    joined = e.join(a, key, "full").select(key, F.col("e").isNull().alias("extra"), F.col("a").isNull().alias("missing"), each)
    kind = F.when(F.col("extra"), "EXTRA").when(F.col("missing"), "MISSING").when(~F.col("c.x").eqNullSafe(F.col("c.y")), "MISMATCH")
    return joined.select(key, F.col("c.field").alias("field"), kind.alias("kind"), F.col("c.x").alias("expected"), F.col("c.y").alias("actual")).where("kind is not null")


def lineage_problems(runs: DataFrame) -> DataFrame:
    """(run, problem): a parent that does not exist, an accepted run without a checkpoint. ``runs``: run, parent, status, checkpoint."""
    orphans = runs.where("parent is not null").join(runs.select(F.col("run").alias("parent")), "parent", "left_anti").select("run", F.lit("MISSING_PARENT").alias("problem"))
    return orphans.unionByName(runs.where("status = 'accepted' and checkpoint is null").select("run", F.lit("ACCEPTED_WITHOUT_CHECKPOINT").alias("problem")))


def deltas(points: DataFrame, by: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """Consecutive differences and, for each series, the first step whose difference is beyond the threshold."""
    w = Window.partitionBy(*by).orderBy(order)
    moved = points.withColumn("delta", F.col(value) - F.lag(value).over(w))
    return moved.withColumn("first_beyond", F.min(F.when(F.abs("delta") > threshold, F.col(order))).over(Window.partitionBy(*by)))


def history(log: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """first, last, least and mean of an ordered log."""
    rows = log.withColumn("v", value).where("v is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("v", order).alias("first"), F.max_by("v", order).alias("last"), F.min("v").alias("least"), F.avg("v").alias("mean"))
