"""Operators on small tables where a cut of the work would show."""

import numpy as np

from parleylake.llm import decontaminate, licenses, lines, shingle_join, toxicity
from parleylake.llm.common import Scratch


def test_toxicity_searches_for_every_text(spark):
    pool = np.random.default_rng(1).choice([a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"], (200, 12))
    rows = [(i, " ".join(pool[i]) + (" zorkface" if i % 5 == 0 else "")) for i in range(200)]
    odd = "an unlisted insult of other words"
    docs = spark.createDataFrame([*rows, (500, odd), (501, odd)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 5 == 0)) for i, _ in rows), (500, 1)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, labels, Scratch(spark, "t")).collect()}
    first = found[501]["evidence"][0]
    assert (first["doc_id"], first["label"]) == (500, 1) and abs(first["cosine"] - 1.0) < 1e-9
    assert found[501]["predicted"] == 1 and all(found[i]["predicted"] == int(i % 5 == 0) for i, _ in rows)


def test_every_licence_of_a_file_is_found(spark):
    text = ". ".join(t.words for t in licenses.TEMPLATES)
    common = [(i, "licensed under the apache license version 2 0") for i in range(1, 40)]
    rows = licenses.scan(spark.createDataFrame([(0, text), *common], "doc_id long, text string"), Scratch(spark, "t")).where("doc_id = 0").collect()
    assert {t.label for t in licenses.TEMPLATES} <= set(rows[0]["labels"].split(","))


def test_copies_of_repetitive_items_are_found(spark):
    items = [(i, " ".join([f"w{i}x{k}" for k in range(40)] + [f"r{i}y{k}" for k in range(5)] * 10)) for i in range(40)]
    docs = [(i, f"some words before the item {text} and others after it") for i, text in items]
    rows = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in rows) == [(i, i, 1.0) for i, _ in items]


def test_pairs_of_near_copies_are_laid_out_once(spark, monkeypatch):
    words, texts = [f"w{i}" for i in range(200)], []
    for i in range(50):  # forty near copies, and ten texts that are near all of them but reach the threshold with none
        own = list(words)
        for at in np.random.default_rng(i).choice(range(4, 100, 4) if i < 40 else range(100, 196, 4), 2 if i < 40 else 6, replace=False):
            own[at] = f"edit{i}x{at}"
        texts.append(" ".join(own))
    rows, pairs, table = 0, set(), Scratch.table

    def counted(self, df, label):
        nonlocal rows
        out = table(self, df, label)
        if label in ("likeliest", "traversed"):
            found = [(r["a"], r["b"]) for r in out.where("a is not null").collect()]
            rows += len(found)
            pairs.update(found)
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in shingle_join.link(docs, Scratch(spark, "t"), 3, 80).collect()}
    sets = [{tuple(t.split()[k : k + 3]) for k in range(198)} for t in texts]
    linked = {(i, j) for i in range(50) for j in range(i + 1, 50) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    roots = list(range(50))
    for _ in roots:
        for i, j in linked:
            roots[i] = roots[j] = min(roots[i], roots[j])
    assert [found[i] for i in range(50)] == roots and len(set(roots)) > 5
    assert len(pairs) > 200 and rows <= 2 * len(pairs)


def test_postings_of_lines_come_in_shares(spark, monkeypatch):
    words = [[f"w{k}" for k in np.random.default_rng(i).choice(300, 12, replace=False)] for i in range(60)]
    texts = [" ".join(w) for w in words] + [" ".join(w[1:]) for w in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shares, pairs = [], lines._pairs

    def counted(postings, percent, wanted=None):
        shares.append(postings.count())
        return pairs(postings, percent, wanted)

    monkeypatch.setattr(lines, "_pairs", counted)
    found = {r["doc_id"]: r["n_removed"] for r in lines.summary(docs, Scratch(spark, "t")).collect()}
    assert found == {i: int(i >= 60) for i in range(120)}
    assert max(shares) < sum(shares) / 2


def test_lines_are_joined_by_dataframe_operations_only(spark, monkeypatch):
    plans, table = [], Scratch.table

    def seen(self, df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, label)

    monkeypatch.setattr(Scratch, "table", seen)
    words = [f"w{k}" for k in range(20)]
    texts = [" ".join(words), " ".join(words[:18] + ["x", "y"]), " ".join(words[:16] + ["a", "b", "c", "d"]), " ".join(words * 9) + " " + " ".join(f"v{k}" for k in range(180))]
    texts.append(texts[-1].replace("v7 ", "other "))
    found = lines.summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}
    assert len(plans) > 5 and not any("Python" in p or "Arrow" in p or "Pandas" in p for p in plans)
