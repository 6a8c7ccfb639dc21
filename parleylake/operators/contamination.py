"""Screening training text against held-out text: exact, normalized, n-gram and edit similarity; the queue and its audit.

Held-out text is small beside the corpus, but nothing here relies on it: what is broadcast is chosen by
Spark from measured sizes, and n-grams of the corpus meet the held-out universe before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Bits of the hashes that n-grams of the corpus pass by in the word probe: at most 2 ** PROBE_BITS numbers are broadcast.
PROBE_BITS = 20


@dataclass(frozen=True)
class Thresholds:
    max_df: int = 1000
    min_shingles: int = 25
    jaccard: float = 0.5
    containment: float = 0.6
    edit_floor: float = 0.2
    edit: float = 0.8
    top_k: int = 5


def hash_matches(heldout: DataFrame, training: DataFrame, key: Column) -> DataFrame:
    """(heldout, training[]): rows of equal hash, ids of training in order. Both sides: id, text."""
    left = heldout.select(F.col("id").alias("heldout"), key.alias("hash"))
    right = training.select(F.col("id").alias("training"), key.alias("hash"))
    return left.join(right, "hash").groupBy("heldout").agg(F.array_sort(F.collect_list("training")).alias("training"))


def exact_matches(heldout: DataFrame, training: DataFrame) -> DataFrame:
    return hash_matches(heldout, training, T.sha("text"))


def normalized_matches(heldout: DataFrame, training: DataFrame) -> DataFrame:
    return hash_matches(heldout, training, T.sha(T.normalize("text")))


def shingle_scores(heldout: DataFrame, training: DataFrame, thresholds: Thresholds = Thresholds(), n: int = 5) -> DataFrame:
    """(heldout, training, shared, jaccard, containment, short) of every pair that shares an unpruned character n-gram.

    Sizes are those of the whole sets; the overlap counts only n-grams that at most ``max_df`` training rows have.
    """
    own = heldout.select(F.col("id").alias("heldout"), T.char_ngrams(T.normalize("text"), n).alias("grams")).where(F.size("grams") > 0)
    own = own.select("heldout", F.size("grams").alias("own_size"), F.explode("grams").alias("gram"))
    grams = training.select(F.col("id").alias("training"), T.char_ngrams(T.normalize("text"), n).alias("grams"))
    theirs = grams.select("training", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    common = theirs.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") <= thresholds.max_df).select("gram")
    shared = own.join(theirs.join(common, "gram", "left_semi"), "gram").groupBy("heldout", "training", "own_size", "size").agg(F.count("*").alias("shared"))
    return shared.select(
        "heldout", "training", "shared",
        (F.col("shared") / (F.col("own_size") + F.col("size") - F.col("shared"))).alias("jaccard"),
        (F.col("shared") / F.col("own_size")).alias("containment"),
        (F.col("own_size") < thresholds.min_shingles).alias("short"),
    )


def shingle_findings(scores: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Pairs that either threshold flags; containment counts only where there are enough n-grams."""
    return scores.where((F.col("jaccard") >= thresholds.jaccard) | (~F.col("short") & (F.col("containment") >= thresholds.containment)))


def top_findings(findings: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The best few of each held-out row, by shared n-grams and then id, both falling."""
    best = Window.partitionBy("heldout").orderBy(F.col("shared").desc(), F.col("training").desc())
    return findings.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= thresholds.top_k)


def edit_matches(findings: DataFrame, heldout: DataFrame, training: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Of all findings with enough Jaccard, those whose texts are alike in order too."""
    pairs = findings.where(F.col("jaccard") >= thresholds.edit_floor).select("heldout", "training", "jaccard")
    texts = pairs.join(heldout.select(F.col("id").alias("heldout"), F.col("text").alias("l")), "heldout").join(training.select(F.col("id").alias("training"), F.col("text").alias("r")), "training")
    return texts.withColumn("ratio", T.edit_similarity("l", "r")).where(F.col("ratio") >= thresholds.edit).select("heldout", "training", "ratio", "jaccard")


def queue(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(heldout, levels, n_training): one entry for each held-out row that any level flagged."""
    parts = [df.select("heldout", F.lit(level).alias("level"), F.col("training").cast("string").alias("training")) for level, df in levels]
    return reduce(DataFrame.unionByName, parts).groupBy("heldout").agg(F.array_sort(F.collect_set("level")).alias("levels"), F.count_distinct("training").alias("n_training"))


def word_probe(heldout: DataFrame, training: DataFrame, n: int = 8, share: float = 0.5, min_chars: int = 12) -> DataFrame:
    """(heldout, corpus, covered, total, contained): places of word n-grams found in one corpus, or the whole text found exactly."""
    items, texts = heldout.withColumn("norm", T.normalize("text")), training.withColumn("norm", T.normalize("text"))
    left = items.withColumn("grams", T.text_word_ngrams("norm", n)).select(F.col("id").alias("heldout"), F.size("grams").alias("total"), F.posexplode_outer("grams").alias("place", "gram"))
    # hashes of few bits drop most other n-grams before the shuffle, whatever the number of held-out ones; the n-grams themselves decide
    bucket = F.pmod(F.xxhash64("gram"), F.lit(1 << PROBE_BITS)).alias("bucket")
    buckets = F.broadcast(left.where("gram is not null").select(bucket).distinct())
    # outer, so that no filter on the n-grams is put below, where it would work them out a second time
    near = texts.select("corpus", F.explode_outer(T.text_word_ngrams("norm", n)).alias("gram")).select("corpus", "gram", bucket).join(buckets, "bucket", "left_semi")
    right = near.select("corpus", "gram").join(left.select("gram").distinct(), "gram", "left_semi").distinct()
    covered = left.join(right, "gram").groupBy("heldout", "corpus", "total").agg(F.count_distinct("place").alias("covered"))
    # texts meet the held-out ones before they are shuffled
    whole = items.where(F.length("norm") >= min_chars).select(F.col("id").alias("heldout"), "norm").join(texts.select("corpus", "norm"), "norm").select("heldout", "corpus", F.lit(True).alias("exact")).distinct()
    both = covered.join(whole, ["heldout", "corpus"], "full")
    return both.select("heldout", "corpus", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("exact", F.lit(False)) | F.coalesce(F.col("covered") / F.col("total") >= share, F.lit(False))).alias("contained"))


def passages(items: DataFrame, documents: DataFrame, n: int = 8) -> DataFrame:
    """(item, doc): documents that hold an item's whole normalized text; candidates share the item's first n words.

    Items of fewer than n words are found by all their words.
    """
    def words(df):
        return df.withColumn("norm", T.normalize("text")).withColumn("words", F.split("norm", " "))

    heads = words(items).where(F.length("norm") > 0).select(F.col("id").alias("item"), "norm", F.least(F.size("words"), F.lit(n)).alias("k"), F.array_join(F.slice("words", 1, n), " ").alias("gram"))
    lengths = [r["k"] for r in heads.select("k").distinct().collect()]
    text = words(documents).select(F.col("id").alias("doc"), "norm", "words")
    found = []
    for k in lengths:
        grams = text.select("doc", F.explode(F.array_distinct(T.word_ngrams(F.col("words"), k))).alias("gram"))
        found.append(grams.join(heads.where(F.col("k") == k), "gram").select("item", "doc", F.col("norm").alias("needle")))
    if not found:
        return items.select(F.col("id").alias("item")).join(documents.select(F.col("id").alias("doc")), F.lit(False))
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.join(text.select("doc", "norm"), "doc").where(F.concat(F.lit(" "), "norm", F.lit(" ")).contains(F.concat(F.lit(" "), "needle", F.lit(" ")))).select("item", "doc").distinct()


def exclude(rows: DataFrame, rules: list[tuple[str, DataFrame, Column]]) -> tuple[DataFrame, DataFrame]:
    """Ordered exclusions: (kept rows, rule counts). A row counts for the first rule whose keys it hits.

    ``rules``: name, DataFrame of one column ``key``, and the row's key expression.
    """
    reason = F.lit(None).cast("string")
    marked = rows
    for number, (name, keys, key) in enumerate(rules):
        hit = keys.select(F.col("key").alias(f"__k{number}")).distinct().withColumn(f"__h{number}", F.lit(True))
        marked = marked.withColumn(f"__own{number}", key).join(hit, F.col(f"__own{number}") == F.col(f"__k{number}"), "left")
        reason = F.coalesce(reason, F.when(F.col(f"__h{number}"), F.lit(name)))
    marked = marked.withColumn("excluded_by", reason)
    return marked.where("excluded_by is null").select(rows.columns), marked.groupBy("excluded_by").agg(F.count("*").alias("n"))


def merge_audit(state: DataFrame, found: DataFrame) -> DataFrame:
    """Audit state after a new screen: verdicts are carried on, items of another fingerprint are stale, quarantined ones stay.

    ``state``: item, fingerprint, verdict; ``found``: item, fingerprint.
    """
    old, new = state.alias("o"), found.alias("n")
    joined = old.join(new, F.col("o.item") == F.col("n.item"), "full")
    changed = F.col("o.item").isNotNull() & F.col("n.item").isNotNull() & ~F.col("o.fingerprint").eqNullSafe(F.col("n.fingerprint"))
    kept = F.col("n.item").isNotNull() | (F.col("o.verdict") == "CONTAMINATED")
    return joined.where(kept).select(
        F.coalesce("n.item", "o.item").alias("item"),
        F.coalesce("n.fingerprint", "o.fingerprint").alias("fingerprint"),
        F.when(changed & (F.col("o.verdict") != "CONTAMINATED"), F.lit("PENDING")).otherwise(F.coalesce("o.verdict", F.lit("PENDING"))).alias("verdict"),
        changed.alias("stale"),
    )
