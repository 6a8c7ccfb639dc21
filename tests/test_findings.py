"""Registered queries on small tables where a cut of the work would show."""

from pyspark.sql import functions as F

from parleylake.functions import text as T
from parleylake.plans import queries

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew potions"


def test_screen_keeps_ngrams_of_many_documents(spark, tmp_path):
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"{PASSAGE} number {i}") for i in range(150)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["contam_l4_edit"](spark, str(tmp_path)).count() == 150
    top = queries.QUERIES["contam_l3_char5"](spark, str(tmp_path)).collect()
    assert len(top) == 5 and all(r["containment"] == 1.0 for r in top)
    (entry,) = queries.QUERIES["contamination_queue"](spark, str(tmp_path)).collect()
    assert (entry["heldout"], entry["levels"], entry["n_training"]) == (7, [3], 150)


def test_all_refusals_are_counted(spark, tmp_path):
    said = ["I cannot help with that.", "As an AI, I cannot say.", "I do not have the ability.", "It is unable to perform calculations.", "I'm sorry, I can't.", "I am unable to say.", "I must decline.", "Fine."]
    spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.QUERIES["refusal_rate_by_role"](spark, str(tmp_path)).collect()
    assert (row["n"], row["refusals"]) == (8, 7)


def test_word_probe_works_ngrams_out_once(spark, tmp_path):
    """n-grams repeated in a filter below normalized the whole text again at every place."""
    long = " ".join(f"w{i % 9973}\U0001f600" for i in range(20_000))
    items = [(1, PASSAGE), (2, "Short but \t exact"), (3, "never seen words that stand in no document at all here"), (4, " ".join(long.split()[5:25]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "a", PASSAGE.upper()), (2, "a", f"{PASSAGE} number 2"), (3, None, long), (4, "b", " short BUT exact\n"), (5, "b", None), (6, "b", ""), (7, "c", " ".join(PASSAGE.split()[:9]))]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["contam_probe_word8"](spark, str(tmp_path))
    assert "Filter (size(" not in found._jdf.queryExecution().toString()
    places = len(PASSAGE.split()) - 7
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", places, places, True), (1, "c", 2, places, False), (2, "b", 0, 0, True), (4, None, 13, 13, True)], key=str)


def test_text_word_ngrams_are_those_of_the_words(spark):
    texts = ["", "a", "a b c", "a  b ", " ", " a b", "\U0001f600 \U0001f600x y\n z", "é\x00 ü\t w", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.split("t", " "))
    for n in (1, 2, 3):
        for r in rows.select("t", T.text_word_ngrams("t", n).alias("got"), T.word_ngrams(F.col("w"), n).alias("want")).collect():
            assert r["got"] == (None if r["t"] is None else r["want"]), (r["t"], n)
