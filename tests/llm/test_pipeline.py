"""The pipeline's decisions, stage by stage, on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parleylake.llm.common import Scratch
from parleylake.llm.queries import read

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from parleylake.llm.queries import QUERIES, read

    docs = read(spark, DATA, "documents")
    toxic = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, DATA).where("predicted = 1").collect()}
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "token_ids":
            assert docs.columns == columns
    assert set(kept["toxicity"]) == set(texts) - toxic
    assert len({texts[i] for i in kept["near_duplicates"]}) == len(kept["near_duplicates"])
    assert set(kept["decontamination"]) <= set(kept["near_duplicates"])
    assert set(kept["source_mix"]) <= set(kept["decontamination"])
    assert sorted(kept["token_ids"]) == sorted(kept["source_mix"])


def _docs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("copies", "copy", "row", "own", "doc"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_stages_on_odd_rows(spark, tmp_path):
    """Repeated and null ids, null and empty texts, clashing columns; and an empty table."""
    import corpus_pipeline

    item = read(spark, DATA, "benchmark").where("text is not null").first()["text"]
    a, b = " ".join(f"alpha{i}" for i in range(80)), " ".join(f"beta{i}" for i in range(80))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, None), (None, ""), (None, a + " tail"), (5, f"{b} {item} {a}"), (6, "short one"), (6, "another text")]
    docs = _docs(spark, [(i, t, "en", ("web", None)[n % 2], 0) for n, (i, t) in enumerate(rows)])
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("toxicity", "near_duplicates", "decontamination", "source_mix"):
        left = stages[name](spark, docs, DATA)
        assert left.columns == docs.columns
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept["toxicity"] == sorted(rows, key=str)
    assert kept["near_duplicates"] == sorted([(1, a), (2, b), (4, None), (None, ""), rows[7], (6, "short one"), (6, "another text")], key=str)
    assert kept["decontamination"] == sorted([r for r in rows if r[0] != 5], key=str)
    assert {t for _, t in kept["source_mix"]} <= {t for _, t in rows if t}
    assert stages["token_ids"](spark, docs, DATA).count() == len(rows)
    none = docs.where("false")
    for stage in stages.values():
        assert stage(spark, none, DATA).count() == 0


def test_stages_keep_what_their_operators_keep(spark, tmp_path):
    """Each stage against its operator applied to the same rows."""
    import corpus_pipeline
    from parleylake.llm import decontaminate, mixing, shingle_join

    docs = read(spark, DATA, "documents").limit(120)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, stages = spark.read.parquet(f"{tmp_path}/docs"), dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    linked = {r["doc_id"]: r["component_id"] for r in shingle_join.link(docs, Scratch(spark, "t"), 5, 80).collect()}
    assert ids(stages["near_duplicates"](spark, docs, DATA)) == sorted(set(linked.values()))
    found = {r["doc_id"] for r in decontaminate.matches(docs, read(spark, DATA, "benchmark")).collect()}
    assert ids(stages["decontamination"](spark, docs, DATA)) == sorted(set(linked) - found)
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, Scratch(spark, "t")).collect()}
    assert ids(stages["source_mix"](spark, docs, DATA)) == sorted(i for i, n in times.items() for _ in range(n))
