"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line is its set of lower-case words (``lower`` of Spark) between ASCII blanks. A line goes if an earlier one (by document
id, then line number) has a set of Jaccard similarity ``percent`` or more. Equal lines are one class at first occurrence.

Sets of that similarity differ in at most K = (n1 + n2) * (100 - percent) / (100 + percent) words. A level of sizes has B
blocks of the hash space, so in one block at most K / B words differ; a block is dealt to m parts, of which all but K / B
agree. The words of a part are its signature. Signatures have a fixed order, the bytes of their words, longest first, so
both sets have an equal one among their first K / B + 1 (the prefix filter, with signatures for words). Long signatures are
rare ones, and the short and empty ones are left over. A line is posted in its own level and in those of larger partners.

Each line is held against the earliest of each signature first; that settles most copies, so a large group of near copies
costs a pair a member. What it does not settle is held against all earlier lines of its signatures. Pairs are filtered by
size and by parity signatures (a word in one set only flips at most a bit), and verified on whole sets of word hashes. No candidate
is dropped. Signatures of more than HOT lines are dealt to as many tasks as that needs.

Defined results: blank lines are kept; null and empty texts have no lines. Rows that repeat an id are told apart: they
follow one another by a hash of the text, each in its own numbering; of wholly equal rows all but one lose all lines with a
word. Rows without an id are left as they are. Columns of any other name pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Parts of a block in the levels of sizes; the last holds for all larger ones, which have more blocks.
PARTS = (4, 6, 10, 16)
#: Lines of a signature that a task holds an open line against; and up to which they are never dealt out.
HOT, SMALL = 5_000, 256
#: Earlier lines up to which an open line is verified against all at once, not the earliest first.
LISTED = 4
#: Shares of the signatures whose postings are on disk at a time.
SHARES = 4
BLANKS = "\t\r\x0b\x0c"


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))


def _tasks(docs: DataFrame) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _numbered(source: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``source`` with ``place``, a number in the order of id and text hash (null without an id); and the bits of a line number."""
    some = source.where("doc is not null")
    low, high, rows, longest = some.agg(F.min("doc"), F.max("doc"), F.count("*"), F.max(F.octet_length("text"))).first()
    bits = ((longest or 0) + 1).bit_length()
    if not rows or (high - low).bit_length() + bits <= 62 and some.groupBy("doc").count().where("count > 1").limit(1).count() == 0:
        return source.withColumn("place", F.col("doc") - F.lit(low or 0)), bits
    # ids that repeat or lie far apart: numbered over the sorted table; row numbers may differ when they are computed again
    source = scratch.table(source, "source")
    ordered = scratch.table(source.where("doc is not null").select("row", "doc", F.xxhash64("text").alias("hash")).orderBy("doc", "hash", "row").select("row", F.monotonically_increasing_id().alias("at")), "order")
    before, start = {}, 0
    for part, n in sorted(ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        before[part], start = start, start + n
    starts = source.sparkSession.createDataFrame(sorted(before.items()), "part long, start long")
    place = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))
    return source.join(place, "row", "left"), bits


def _split(text: str) -> Column:
    """Lines in lower case, with spaces for all blanks."""
    own = F.col(text)
    return F.split(F.lower(F.when(own.rlike(f"[{BLANKS}]"), F.translate(own, BLANKS, " " * len(BLANKS))).otherwise(own)), "\n", -1)


def _lines(source: DataFrame, bits: int) -> DataFrame:
    """(id, line) of the lines with a word; ids are in the lines' order."""
    found = source.where("place is not null and text <> ''").select("place", F.posexplode(_split("text")).alias("at", "line"))
    return found.where(F.trim("line") != "").select(F.shiftleft("place", bits).bitwiseOR(F.col("at").cast("long")).alias("id"), "line")


def _words(line: str) -> Column:
    """Distinct words as hashes whose lowest six bits are the word's bytes (63 at most)."""
    hashes = F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-64)).bitwiseOR(F.least(F.octet_length(w), F.lit(63)).cast("long")))
    blank = F.xxhash64(F.lit("")).bitwiseAND(F.lit(-64))
    return F.array_remove(F.array_distinct(hashes), blank)


def _level(n: Column, unit: int) -> Column:
    return F.when(n < unit, 0).otherwise(F.length(F.bin(F.floor(n / unit))))


def _described(lines: DataFrame, percent: int) -> DataFrame:
    """(id, level, own, n, p0, p1, keys): parity signatures and first part signatures of each line's blocks, for its own level and those of larger partners."""
    unit = max(7 * percent // (4 * max(100 - percent, 1)), 1)
    n = F.col("n")
    sets = lines.select("id", _words("line").alias("words")).select("id", "words", F.size("words").alias("n"))
    largest = F.floor(n * 100 / percent)
    levels = sets.select("id", "words", "n", _level(n, unit).alias("mine"), largest.alias("largest")).select("*", F.explode_outer(F.sequence("mine", _level(F.col("largest"), unit))).alias("level"))
    level = F.col("level")
    blocks = F.when(level < len(PARTS), 1).otherwise(F.call_function("shiftleft", F.lit(1), level - len(PARTS) + 1))
    parts = F.element_at(F.array(*map(F.lit, PARTS)), F.least(level + 1, F.lit(len(PARTS))))
    reach = F.least("largest", F.call_function("shiftleft", F.lit(unit).cast("long"), level) - 1)
    away = F.floor(F.floor((n + reach) * (100 - percent) / (100 + percent)) / blocks).cast("int")
    out = levels.select("id", "words", "n", "level", (level == F.col("mine")).alias("own"), blocks.alias("blocks"), parts.alias("parts"), away.alias("away"))
    one = out.select("id", "level", "n", "own", "away", "blocks", "parts", F.explode_outer("words").alias("h"))
    h = F.col("h")
    bit = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(127))
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    one = one.select(
        "id", "level", "n", "own", "away", "parts",
        F.shiftrightunsigned(h, 6).bitwiseAND(F.col("blocks").cast("long") - 1).cast("int").alias("block"),
        (F.shiftrightunsigned(h, 32) % F.col("parts")).cast("int").alias("part"),
        F.shiftleft(F.shiftrightunsigned(h, 20), 12).bitwiseOR(h.bitwiseAND(F.lit(63))).alias("v"),
        F.when(bit < 64, flip).otherwise(0).alias("f0"), F.when(bit < 64, F.lit(0)).otherwise(flip).alias("f1"),
    )
    sums = [F.sum(F.when(F.col("part") == j, F.col("v")).otherwise(0)).alias(f"s{j}") for j in range(max(PARTS))]
    shape = F.shiftleft(F.col("n").cast("long"), 8).bitwiseOR(F.col("away").cast("long"))
    found = one.withColumn("shape", F.shiftleft(shape, 1).bitwiseOR(F.col("own").cast("long"))).groupBy("id", "level", "block").agg(F.max("shape").alias("shape"), F.bit_xor("f0").alias("p0"), F.bit_xor("f1").alias("p1"), *sums)
    # bytes in front, so that they sort; an empty part is its number
    value = lambda j: F.when(F.col(f"s{j}") == 0, F.lit(j).cast("long")).otherwise(F.shiftleft(F.col(f"s{j}").bitwiseAND(F.lit(4095)), 51).bitwiseOR(F.shiftrightunsigned(f"s{j}", 12)))
    whole = F.array(*(value(j) for j in range(max(PARTS))))
    parts = F.element_at(F.array(*map(F.lit, PARTS)), F.least(level + 1, F.lit(len(PARTS))))
    first = F.slice(F.sort_array(F.slice(whole, 1, parts), False), 1, F.shiftrightunsigned("shape", 1).bitwiseAND(F.lit(255)).cast("int") + 1)
    return found.select("id", "level", "block", (F.col("shape").bitwiseAND(F.lit(1)) == 1).alias("own"), F.shiftrightunsigned("shape", 9).cast("int").alias("n"), "p0", "p1", first.alias("first"))


def _postings(described: DataFrame, share: int) -> DataFrame:
    """(key, id): a row for each first signature of a line, of a share of the signatures."""
    posts = described.select("id", "level", "block", F.explode("first").alias("first")).select(F.xxhash64("first", "level", "block").alias("key"), "id")
    return posts.where(F.pmod("key", F.lit(SHARES)) == share)


def _pairs(postings: DataFrame, tasks: int, least: int | None = None) -> DataFrame:
    """(key, id, other, c): the lines of signatures that ``least`` (2) lines have, with the earliest of them and their number."""
    dealt = postings.repartition(tasks, "key")
    groups = dealt.groupBy("key").agg(F.min("id").alias("other"), F.count("*").alias("c")).where(F.col("c") >= (least or 2))
    return dealt.join(groups.hint("shuffle_hash"), "key")


def _near(a: str, b: str, percent: int) -> Column:
    """Size and parity filters."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    flips = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in ("p0", "p1")), F.lit(0))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (flips * (100 + percent) <= (n1 + n2) * (100 - percent))


def _verified(pairs: DataFrame, lines: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Ids of the pairs (id, other) whose whole sets reach the threshold."""
    wanted = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    sets = scratch.table(lines.join(wanted.hint("shuffle_hash"), "id", "left_semi").select("id", _words("line").alias("words")), "sets")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("other"), F.col("words").alias("words2")), "other")
    shared = F.size(F.array_intersect("words", "words2"))
    both = both.select("id", shared.alias("shared"), (F.size("words") + F.size("words2")).alias("both"))
    found = scratch.table(both.where(F.col("shared") * 100 >= (F.col("both") - F.col("shared")) * percent).select("id").distinct(), "settled")
    scratch.drop("sets")
    scratch.release()
    return found


def _kept(lines: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Ids of the lines that stay."""
    tasks = _tasks(lines)
    first = lines.groupBy(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")).agg(F.min("id").alias("id"))
    first = scratch.table(first.select("id"), "first")
    described = scratch.table(_described(lines.join(first.hint("shuffle_hash"), "id", "left_semi"), percent), "described")
    scratch.release()
    members = None
    for share in range(SHARES):
        found = scratch.table(_pairs(_postings(described, share), tasks), "members")
        members = found if members is None else members.unionByName(found)
        scratch.release()
    classes = described.where("own").groupBy("id").agg(F.max("n").alias("n"), F.bit_xor("p0").alias("p0"), F.bit_xor("p1").alias("p1"))
    classes = scratch.table(classes, "classes")
    scratch.drop("described")
    a, b = classes.alias("a"), classes.alias("b")
    hubs = members.where("id <> other").groupBy("id", "other").agg(F.max(F.col("c") > 2).alias("many")).alias("h")
    hubs = hubs.join(a, F.col("h.id") == F.col("a.id")).join(b, F.col("h.other") == F.col("b.id")).select("h.id", "other", "many", _near("a", "b", percent).alias("near"))
    hubs = scratch.table(hubs, "hubs")
    settled = _verified(hubs.where("near").select("id", "other"), lines, scratch, percent)
    open_ = scratch.table(hubs.where("many").select("id").distinct().join(settled, "id", "left_anti"), "open")
    described = members.where("c > 2").join(classes, "id")
    shares = F.when(F.col("c") <= SMALL, 1).otherwise(F.ceil(F.col("c") / HOT)).cast("int")
    asked = described.join(open_, "id", "left_semi").withColumn("share", (F.pmod(F.xxhash64("id"), shares)).cast("int")).alias("a")
    against = described.withColumn("share", F.explode_outer(F.sequence(F.lit(0), shares - 1))).alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.share") == F.col("b.share"))
    earlier = (F.col("b.id") < F.col("a.id")) & (F.col("b.id") != F.col("a.other"))
    rest = scratch.table(asked.join(against, same & earlier & _near("a", "b", percent)).select("a.id", F.col("b.id").alias("other")).distinct(), "rest")
    scratch.drop("members")
    scratch.release()
    counted = rest.groupBy("id").agg(F.min("other").alias("earliest"), F.count("*").alias("c"))
    rest = scratch.table(rest.join(counted, "id").select("id", "other", ((F.col("c") <= LISTED) | (F.col("other") == F.col("earliest"))).alias("now")), "asked")
    settled = settled.unionByName(_verified(rest.where("now").select("id", "other"), lines, scratch, percent))
    left = scratch.table(rest.where(~F.col("now")).select("id", "other").join(settled, "id", "left_anti"), "left")
    if left.limit(1).count():
        settled = settled.unionByName(_verified(left, lines, scratch, percent))
    return first.join(settled, "id", "left_anti")


def _removed(source: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(row, doc, n_lines, removed): a row for each row of ``source``."""
    numbered, bits = _numbered(source, scratch)
    kept = _kept(_lines(numbered, bits), scratch, percent)
    lists = kept.groupBy(F.shiftright("id", bits).alias("place")).agg(F.collect_list(F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")).alias("stay"))
    own = F.filter(F.transform(_split("text"), lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull())
    counted = numbered.select("row", "doc", "place", F.when(F.col("text") != "", F.size(F.split("text", "\n", -1))).otherwise(0).cast("long").alias("n_lines"), F.when((F.col("text") != "") & F.col("place").isNotNull(), own).alias("own"))
    joined = counted.join(lists, "place", "left")
    gone = F.array_except(F.coalesce("own", F.array().cast("array<int>")), F.coalesce("stay", F.array().cast("array<int>")))
    return joined.select("row", "doc", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), gone.alias("removed"))


def summary(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0): a row for each row of ``docs``."""
    removed = _removed(_source(docs, text, key), scratch, percent)
    return removed.select(F.col("doc").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def clean(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; other columns as they are."""
    kept = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("own")), "rows")
    source = kept.select("row", F.col("own")[key].cast("long").alias("doc"), F.col("own")[text].cast("string").alias("text"))
    lists = _removed(source, scratch, percent).where(F.size("removed") > 0).select("row", "removed")
    left = F.array_join(F.filter(F.split(F.col("own")[text], "\n", -1), lambda _, i: ~F.array_contains("removed", i)), "\n")
    joined = kept.join(lists, "row", "left")
    columns = [F.when(F.col("removed").isNull(), F.col("own")[c]).otherwise(left).alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns]
    return joined.select(*columns)
