"""The corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm import decontaminate, mixing, shingle_join, tokens, toxicity
from parleylake.llm.common import Scratch, held_out
from parleylake.llm.queries import read, vocabulary_file

#: Near duplicates: words of a shingle, and percent of shared shingles from which documents are one group.
SHINGLE, SIMILAR = 5, 80

_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Scratch for a stage. The stages before it have been written out, so theirs goes."""
    while _open:
        _open.pop().clear()
    _open.append(Scratch(spark, name))
    return _open[-1]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(row, own): each row with a number of its own, and whether that is the id. Where ids repeat or are null, rows are numbered and written."""
    own = F.struct(*docs.columns).alias("own")
    total = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("k")).first()
    if total["n"] == total["k"] and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("row"), own), True
    return scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), own), "rows"), False


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Rows of an id that repeats go together if one of them is rejected. Null and empty texts get the rate of examples without
    words, and rows of a null id are kept. An empty table stays empty.
    """
    scored = toxicity.score(docs, read(spark, sf_dir, "labels"), _scratch(spark, "toxicity"), ~held_out("doc_id"))
    return _without(docs, scored.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id.

    Where ids repeat or are null every row is a document of its own: of a group the row of the smallest id stays (null
    ids last), of equal ids the first by a hash of the text, then in the order of the files. Null and empty texts link with nothing and are kept.
    """
    scratch = _scratch(spark, "duplicates")
    keyed, by_id = _keyed(docs, scratch)
    linked = shingle_join.link(keyed.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text")), scratch, SHINGLE, SIMILAR)
    if by_id:
        return _without(docs, linked.where("component_id <> doc_id"))
    linked = scratch.table(linked, "linked")
    several = linked.groupBy("component_id").count().where("count > 1").select("component_id")
    members = linked.join(several, "component_id", "left_semi").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("own.doc_id").isNull().alias("x"), F.col("own.doc_id").alias("y"), F.xxhash64("own.text").alias("z"), "row")
    grouped = scratch.table(keyed.join(members, "row").select("row", "component_id", order.alias("place")), "members")
    stays = grouped.groupBy("component_id").agg(F.min("place").alias("place")).select("place.row")
    return keyed.join(grouped.select("row").join(stays, "row", "left_anti"), "row", "left_anti").select("own.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows of an id that repeats go together if one of them has a passage; rows of a null id, null and empty texts are kept.
    """
    _scratch(spark, "benchmark")
    return _without(docs, decontaminate.matches(docs, read(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    Rows that repeat an id, or have none, are documents of their own. Documents without words are left out, as the mix takes none of theirs.
    """
    scratch = _scratch(spark, "mix")
    keyed, _ = _keyed(docs, scratch)
    mixed = mixing.mix(keyed.select(F.col("row").alias("doc_id"), F.col("own.source").alias("source"), F.col("own.text").alias("text")), scratch)
    times = mixed.where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    repeated = keyed.join(times, "row").select("own", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    return repeated.select("own.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet-matrix shards; a row for each document, read back from them. Null and empty texts have the end id alone."""
    _, back = tokens.round_trip(docs, _scratch(spark, "tokens"), vocabulary_file())
    return back


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_ids", write_tokens),
]

#: No SQL can express these stages; tests hold each of them against its operator, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    between = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = between.table(stage(spark, docs, sf_dir), name)
    return docs
