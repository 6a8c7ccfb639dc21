"""URL filters: rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models (Witten-Bell, contexts backed off to the longest that
was seen twice) learn from all different URLs that rules accept and reject, but for those held back.
A URL that no rule fits is allowed if its log-likelihood difference per byte reaches a threshold,
calibrated on the held-back fifth of the different URLs that rules judge (by a hash of the URL).

Nothing of the models is gathered in one place. N-grams of up to ``ORDER`` bytes are whole numbers, last byte
first, with their length below: sorted, an n-gram comes right before all that end in it, so smoothing walks
each task's sorted rows with the last shorter n-grams at hand. Only n-grams of one and two bytes (65,792 at most)
stand in all tasks. A URL's difference is the sum of the values at its places, in fixed-point numbers, so their order
does not matter; the commonest values (``OFTEN`` at most) are looked up in every task, and all others are joined.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule, and its
difference is that of its whole text (0 for none); without URLs of both kinds the difference is 0
and the threshold 0, so the verdict is ``allow``; without held-back URLs of both kinds (a kind of fewer than
``FEW`` different URLs holds none back) the threshold is 0. Repeated rows agree; other columns pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ngram_lm
from .common import Scratch, map_arrow, slices
from .hashing import buffers

#: The longest n-grams, in bytes; and how often a context must be seen in a model (the empty one once).
ORDER, MIN_CONTEXT = 6, 2
FEW = 10
#: The most values, and different URLs, that go to every task because they are common; the rest are joined.
OFTEN, OFTEN_URLS = 1 << 16, 1000
#: Log-likelihood differences are summed as whole numbers of this part.
UNIT = 2.0**30
#: Bytes of URLs whose n-grams are counted at a time.
SLICE = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """host, path, rule and rule_verdict; of the rules that fit, the one with the longest name (then the first) counts."""
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: -len(r.name))[::-1]:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all URLs, each with a border before and after; first and past-last places."""
    column = pc.fill_null(column, "")
    raw, offsets = buffers(column)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full(len(raw) + 2 * len(sizes), ngram_lm.BORDER, np.uint32)
    out[np.arange(len(raw)) + 2 * row + 1] = raw
    first = offsets[:-1] + 2 * np.arange(len(sizes))
    return out, first, first + sizes + 2


def _ngrams(column: pa.Array):
    """Of n-grams of 1 to ``ORDER`` bytes: key and URL of each, and whether it is the longest at its place (borders before URLs have none)."""
    codes, first, last = _codes(column)
    row = np.repeat(np.arange(len(first)), last - first)
    place = np.arange(len(codes)) - first[row]
    bits = np.zeros(len(codes), np.int64)
    for k in range(1, ORDER + 1):
        bits[k - 1 :] |= codes[: len(codes) - k + 1].astype(np.int64) << 8 * (ORDER - k)
        inside = place >= k - 1
        longest = (place >= 1) & (k == np.minimum(ORDER, place + 1))
        yield (bits[inside] << 3) | k, row[inside], longest[inside]


def _count(urls: DataFrame) -> DataFrame:
    """key, uses (places where it is the longest), and by model its count n, and its context's total t and kinds k."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "url", SLICE):
                side = part.column("side").to_numpy(zero_copy_only=False)
                for keys, row, longest in _ngrams(part.column("url")):
                    own, at = np.unique(keys, return_inverse=True)
                    sums = [np.bincount(at[mask], minlength=len(own)) for mask in (longest, side[row] == 0, side[row] == 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x.astype(np.int64)) for x in sums)], names=["key", "uses", "n0", "n1"])

    counts = map_arrow(urls.select("url", "side"), work, "key long, uses long, n0 long, n1 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("uses", "n0", "n1")))
    # without its last byte, which stands first
    before = F.shiftleft(F.shiftrightunsigned("key", 3).bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)), 11) + F.col("key").bitwiseAND(F.lit(7)) - 1
    context = Window.partitionBy("context")
    stats = [f(c).over(context).alias(name) for c, i in (("n0", 0), ("n1", 1)) for f, name in ((F.sum, f"t{i}"), (lambda c: F.count_if(F.col(c) > 0), f"k{i}"))]
    return counts.withColumn("context", before).select("key", "uses", "n0", "n1", *stats)


COUNTS = ("n0", "t0", "k0", "n1", "t1", "k1")


def _shares(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys; by model an n-gram's own share of its context, and the weight of what the shorter n-gram has."""
    key = table.column("key").to_numpy()
    own, weight = np.zeros((len(key), 2)), np.ones((len(key), 2))
    for c in (0, 1):
        n, total, kinds = (table.column(f"{x}{c}").to_numpy() for x in "ntk")
        known = total >= np.where(key & 7 == 1, 1, MIN_CONTEXT)
        both = np.maximum(total + kinds, 1)
        own[:, c], weight[:, c] = np.where(known, n / both, 0.0), np.where(known, kinds / both, 1.0)
    return key, own, weight


def _values(counts: DataFrame, tasks: int, spark) -> DataFrame:
    """key, uses, value: the log of the n-gram's probability by the first model, less that by the second, in ``UNIT``."""
    short = F.col("key").bitwiseAND(F.lit(7)) <= 2
    key, own, weight = _shares(counts.where(short).select("key", *COUNTS).toArrow())
    one, two = np.full((1 << 8, 2), 1.0 / 257), np.ones((1 << 16, 2))
    at = key & 7 == 1
    one[key[at] >> 43] = own[at] + weight[at] / 257
    at = key & 7 == 2
    two[key[at] >> 35] = own[at] + weight[at] * one[key[at] >> 43]
    shared = spark.sparkContext.broadcast(two)

    def work(batches):
        held: dict[int, tuple] = {}  # the last n-gram of each length: those that it ends later ones in
        for batch in batches:
            if not batch.num_rows:
                continue
            key, own, weight = _shares(batch)
            p = np.zeros((len(key), 2))
            last = {}
            for k in range(2, ORDER + 1):
                at = np.flatnonzero(key & 7 == k)
                if not len(at):
                    continue
                if k == 2:
                    p[at] = shared.value[key[at] >> 35]
                    continue
                if k == 3:
                    lower = shared.value[key[at] >> 35]
                else:
                    cut = 3 + 8 * (ORDER - k + 1)
                    ending = (key[at] >> cut << cut) | (k - 1)
                    place = ngram_lm.find(key, ending)
                    lower = p[place]
                    out = place < 0
                    if out.any():
                        known, value = held[k - 1]
                        if (ending[out] != known).any():
                            raise RuntimeError("an n-gram's ending is missing")
                        lower[out] = value
                p[at] = own[at] + weight[at] * lower
                last[k] = (key[at[-1]], p[at[-1]].copy())
            held |= last
            used = batch.column("uses").to_numpy() > 0
            value = np.rint((np.log(p[used, 0]) - np.log(p[used, 1])) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[used]), batch.column("uses").filter(pa.array(used)), pa.array(value)], names=["key", "uses", "value"])

    ordered = counts.where(F.col("key").bitwiseAND(F.lit(7)) >= 2).repartition(tasks, F.shiftright("key", 3 + 8 * (ORDER - 3))).sortWithinPartitions("key")
    return map_arrow(ordered.select("key", "uses", *COUNTS), work, "key long, uses long, value long")


def _sums(urls: DataFrame, values: DataFrame, often: int) -> DataFrame:
    """id and the sum of the values at the URL's places."""
    total = values.agg(F.sum("uses")).first()[0] or 0
    common = values.where(F.col("uses") * often >= total).select("key", "value").toArrow().sort_by("key")
    shared = urls.sparkSession.sparkContext.broadcast((common["key"].to_numpy(), common["value"].to_numpy()))

    def work(rest: bool):
        def run(batches):
            table, value = shared.value
            for batch in batches:
                for part in slices(batch, "url", SLICE):
                    ids, sums = part.column("id").to_numpy(), np.zeros(part.num_rows, np.int64)
                    for keys, row, longest in _ngrams(part.column("url")):
                        keys, row = keys[longest], row[longest]
                        at = ngram_lm.find(table, keys)
                        hit = at >= 0
                        if rest:
                            yield pa.RecordBatch.from_arrays([pa.array(ids[row[~hit]]), pa.array(keys[~hit])], names=["id", "key"])
                        else:
                            np.add.at(sums, row[hit], value[at[hit]])
                    if not rest:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["id", "value"])

        return run

    rows = urls.select("id", "url")
    looked_up = map_arrow(rows, work(False), "id long, value long")
    joined = map_arrow(rows, work(True), "id long, key long").join(values.select("key", "value"), "key").select("id", "value")
    return looked_up.unionByName(joined).groupBy("id").agg(F.sum("value").alias("value"))


def _threshold(held: DataFrame, scratch: Scratch, tasks: int) -> float:
    """The border between differences that keeps most of the allowed and stops most of the blocked, by shares; the one nearest 0, then the lowest."""
    counts = held.groupBy("difference").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    ranged = scratch.table(counts.repartitionByRange(tasks, "difference").withColumn("bucket", F.spark_partition_id()), "marks")
    runs = ranged.groupBy("bucket").agg(F.min("difference").alias("low"), F.max("difference").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("low").collect()
    n_good, n_bad = sum(r["good"] for r in runs), sum(r["bad"] for r in runs)
    if not n_good or not n_bad:
        return 0.0
    before, good, bad, high = [], 0, 0, None
    for r in runs:
        before.append((r["bucket"], good, bad, high))
        good, bad, high = good + r["good"], bad + r["bad"], r["high"]
    order = Window.partitionBy("bucket").orderBy("difference")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    marks = ranged.join(F.broadcast(held.sparkSession.createDataFrame(before, "bucket int, good0 long, bad0 long, high0 double")), "bucket").select(
        F.coalesce((F.coalesce(F.lag("difference").over(order), "high0") + F.col("difference")) / 2, F.col("difference") - 1e-6).alias("mark"),
        (F.coalesce(F.sum("good").over(below), F.lit(0)) + F.col("good0")).cast("decimal(19,0)").alias("lost"),
        (F.coalesce(F.sum("bad").over(below), F.lit(0)) + F.col("bad0")).cast("decimal(19,0)").alias("stopped"),
    )
    gain = (F.col("stopped") * n_good - F.col("lost") * n_bad).alias("gain")
    best = marks.select(gain, "mark").orderBy(F.desc("gain"), F.abs("mark"), "mark").first()
    return min((-int(best["gain"]), abs(best["mark"]), best["mark"]), (0, abs(high + 1e-6), high + 1e-6))[2]


def learn(urls: DataFrame, scratch: Scratch, often: int = OFTEN) -> tuple[DataFrame, float]:
    """Each different URL with its difference, and the threshold. ``urls``: id, url (all different), verdict (of a rule, or null) and copies."""
    spark = urls.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kinds = {r["verdict"]: r["count"] for r in urls.groupBy("verdict").count().collect()}
    if not kinds.get("allow") or not kinds.get("block"):
        return urls.withColumn("difference", F.lit(0.0)), 0.0
    many = F.col("verdict").isin([k for k in ("allow", "block") if kinds[k] >= FEW])
    held = F.coalesce(many, F.lit(False)) & (F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    side = F.when(held | F.col("verdict").isNull(), -1).when(F.col("verdict") == "allow", 0).when(F.col("verdict") == "block", 1).otherwise(-1)
    counts = scratch.table(_count(urls.withColumn("side", side)), "counts")
    values = scratch.table(_values(counts, tasks, spark), "values")
    length = F.octet_length("url")
    difference = F.when(length > 0, F.col("value") / F.lit(UNIT) / (length + 1)).otherwise(F.lit(0.0))
    found = scratch.table(urls.withColumn("held", held).join(_sums(urls, values, often), "id").withColumn("difference", difference).drop("value"), "differences")
    return found, _threshold(found.where("held"), scratch, tasks)


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", scratch: Scratch | None = None, often: int = OFTEN, often_urls: int = OFTEN_URLS) -> DataFrame:
    """key, host, path, rule, verdict and the model's difference and threshold, a row for each page."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    rows = pages.select(key, F.col(url).cast("string").alias("url"))
    ruled = rule_columns(rows.where("url is not null").groupBy("url").agg(F.count("*").alias("copies")), rules)
    urls = scratch.table(ruled.select(F.monotonically_increasing_id().alias("id"), "url", F.col("rule_verdict").alias("verdict"), "copies"), "urls")
    found, threshold = learn(urls, scratch, often)
    total = urls.agg(F.sum("copies")).first()[0] or 0
    common = found.where(F.col("copies") * often_urls >= total).select("url", "difference")
    # pages of a common URL are not gathered in one task
    marked = rows.join(F.broadcast(common), "url", "left")
    done = marked.where("difference is not null or url is null").select(key, "url", F.coalesce("difference", F.lit(0.0)).alias("difference"))
    rest = marked.where("difference is null and url is not null").drop("difference").join(found.select("url", "difference"), "url").select(key, "url", "difference")
    scored = rule_columns(done.unionByName(rest), rules).withColumn("threshold", F.lit(threshold))
    verdict = F.coalesce("rule_verdict", F.when(F.col("difference") >= F.col("threshold"), "allow").otherwise("block"))
    return scored.select(key, "host", "path", "rule", verdict.alias("verdict"), "difference", "threshold")
