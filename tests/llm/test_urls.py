"""op8 learns from all URLs; its differences and threshold against a plain recursion over all of them."""

from collections import Counter
from math import log

import numpy as np
from pyspark.sql import functions as F

from parleylake.llm import urlfilter

RULES = [urlfilter.Rule("allow", "com", "/"), urlfilter.Rule("block", "net", "/")]


def plain_ratio(learned, order=6):
    """Differences by the definition: Witten-Bell from the empty context up, contexts seen twice."""
    grams = [Counter(), Counter()]
    for counter, urls in zip(grams, learned, strict=True):
        for url in urls:
            raw = b" " + url.encode() + b" "
            counter.update(raw[i : i + k] for k in range(1, order + 1) for i in range(len(raw) - k + 1))
    total, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for gram, n in grams[c].items():
            total[c][gram[:-1]] += n
            kinds[c][gram[:-1]] += 1

    def logp(c, gram):
        p = 1 / 257
        for k in range(1, len(gram) + 1):
            own = gram[-k:]
            t, d = total[c][own[:-1]], kinds[c][own[:-1]]
            if t >= (1 if k == 1 else 2):
                p = (grams[c][own] + d * p) / (t + d)
        return log(p)

    def difference(url):
        raw = b" " + (url or "").encode() + b" "
        return sum(logp(0, raw[max(i - order + 1, 0) : i + 1]) - logp(1, raw[max(i - order + 1, 0) : i + 1]) for i in range(1, len(raw))) / (len(raw) - 1) if url else 0.0

    return difference


def test_all_urls_are_learned_from(spark):
    rng = np.random.default_rng(5)
    urls = [f"http://{'abcde'[int(rng.integers(5))]}{int(rng.integers(90))}.{'com' if i % 2 else 'net'}/{'shop' if i % 2 else 'win'}/{int(rng.integers(400))}" for i in range(300)]
    urls += urls[:40] + [urls[0]] * 30 + [f"http://x.org/{w}/{i}" for i, w in enumerate(["shop", "win", "é  \x00\x00\x00é"] * 4)] + [None, "", "a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    different = spark.createDataFrame([(u,) for u in sorted({u for u in urls if u is not None})], "url string")
    held = {r["url"] for r in different.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    kinds = [sorted({u for u in urls if u and f".{end}/" in u}) for end in ("com", "net")]
    difference = plain_ratio([[u for u in k if u not in held] for k in kinds])
    good, bad = (np.array([difference(u) for u in k if u in held]) for k in kinds)
    for often, often_urls in ((urlfilter.OFTEN, urlfilter.OFTEN_URLS), (50, 5)):  # all values looked up; most joined
        rows = urlfilter.judge(pages, RULES, often=often, often_urls=often_urls).collect()
        assert sorted(r["page_id"] for r in rows) == list(range(len(urls)))
        assert all(abs(r["difference"] - difference(urls[r["page_id"]])) < 1e-6 for r in rows)
        (mark,) = {r["threshold"] for r in rows}
        values = np.unique(np.concatenate([good, bad]))
        marks = np.concatenate([values[:1] - 1e-6, (values[1:] + values[:-1]) / 2, values[-1:] + 1e-6])
        gains = np.array([(good >= m).mean() + (bad < m).mean() for m in marks])
        best = marks[gains >= gains.max() - 1e-9]
        assert abs(mark - best[np.argmin(abs(best))]) < 1e-6
        assert all(r["verdict"] == ("allow" if r["difference"] >= mark else "block") for r in rows if r["rule"] is None)


def test_batches_may_part_endings(spark):
    urls = [f"http://s{i % 7}.{'com' if i % 2 else 'net'}/{i * 37 % 500}" for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    whole = {r["page_id"]: r["difference"] for r in urlfilter.judge(pages, RULES).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert whole == {r["page_id"]: r["difference"] for r in urlfilter.judge(pages, RULES).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
