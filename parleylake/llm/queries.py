"""The operators' queries, by their registered names, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lines, mixing, ogg, shingle_join, tokens, toxicity, urlfilter
from .common import Scratch, held_out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "op1"), ~held_out("doc_id"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out("doc_id")))
    return langid.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def vocabulary_file() -> str:
    """The vocabulary that op3's contract names; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, back = tokens.round_trip(read(spark, sf_dir, "documents"), Scratch(spark, "op3"), vocabulary_file())
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "op4").table(ogg.encode_column(read(spark, sf_dir, "documents")), "media")
    return ogg.decode_column(stored).drop("error")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link(read(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The host and path rules of op8's contract.
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES, scratch=Scratch(spark, "op8"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), Scratch(spark, "op10"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_language_id": op2_language_id, "op3_token_ids": op3_token_ids, "op4_ogg_media": op4_ogg_media, "op5_line_dedup": op5_line_dedup, "op6_ngram_jaccard_join": op6_ngram_jaccard_join, "op7_decontaminate": op7_decontaminate, "op8_url_filter": op8_url_filter, "op9_source_mix": op9_source_mix, "op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
