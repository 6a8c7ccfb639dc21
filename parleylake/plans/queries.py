"""Driver queries of the library's operators over the test tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text

from ..session import ship
from ..operators import annotation, contamination, conversations, dedup, metrics, mixture, outputs, preferences, sampling, validators

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str, table: str = "documents", ident: str = "doc_id") -> DataFrame:
    return read(spark, sf_dir, table).select(F.col(ident).alias("id"), "text")


# SQL of text.normalize and of the derived evaluation rows, used in several oracles.
NORM = r"lower(trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g')))"
N_DOC = NORM.format("text")


# ---------------------------------------------------------------- identity, duplicates, overlap


@query("select sha256(text) as digest, count(*) as n_docs, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def exact_dup_docs(spark, sf_dir):
    return dedup.groups(read(spark, sf_dir, "documents"), text.sha("text"), "doc_id").select(F.col("key").alias("digest"), F.col("n").alias("n_docs"), F.col("first").alias("first_doc"))


@query(f"select sha256({N_DOC}) as digest, count(*) as n_docs, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def normalized_dup_docs(spark, sf_dir):
    return dedup.groups(read(spark, sf_dir, "documents"), text.sha(text.normalize("text")), "doc_id").select(F.col("key").alias("digest"), F.col("n").alias("n_docs"), F.col("first").alias("first_doc"))


@query("""select doc_id, row_number() over w = 1 as kept, case when row_number() over w > 1 then first_value(doc_id) over w end as duplicate_of
from documents window w as (partition by text order by doc_id)""")
def dup_groups_first_wins(spark, sf_dir):
    return dedup.first_wins(read(spark, sf_dir, "documents"), text.sha("text"), ["doc_id"], "doc_id").select("doc_id", "kept", "duplicate_of")


@query("""select doc_id, case when n = 1 then h else h || '#' || n::varchar end as unique_id
from (select doc_id, sha256(text) as h, row_number() over (partition by text order by doc_id) as n from documents)""")
def repeat_suffix_ids(spark, sf_dir):
    return dedup.repeat_suffix(read(spark, sf_dir, "documents"), text.sha("text"), ["doc_id"]).select("doc_id", "unique_id")


@query()
def greedy_multi_key_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", text.sha("text").alias("text_key"), text.sha(F.substring_index("text", "\n", 1)).alias("head_key"))
    return dedup.greedy(docs, "doc_id", ["text_key"], ["text_key", "head_key"])


@query("""with v as (select distinct source, 'text' as key, sha256(text) as value from documents where text <> ''
 union all select distinct source, 'first_line', split_part(text, chr(10), 1) from documents where split_part(text, chr(10), 1) <> '')
select a.source as "left", b.source as "right", a.key, count(*) as shared from v a join v b on a.key = b.key and a.value = b.value and a.source < b.source group by all""")
def overlap_matrix_by_source(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text <> ''")
    return dedup.overlaps(docs, "source", {"text": text.sha("text"), "first_line": F.substring_index("text", "\n", 1)})


@query(f"""select distinct sha256({N_DOC}) as key from documents where lang = 'en'
intersect select distinct sha256({N_DOC}) from documents where source in ('src1', 'src2')""")
def exact_overlap(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return dedup.exact_overlap(docs.where("lang = 'en'"), docs.where("source in ('src1', 'src2')"), text.sha(text.normalize("text")))


@query("""select conv_id, count(*) as n, sha256(string_agg(role || ':' || text, chr(10) order by turn)) as fingerprint from conversations group by conv_id""")
def fingerprint_conversations(spark, sf_dir):
    return dedup.fingerprint_rows(read(spark, sf_dir, "conversations"), ["turn"], [F.col("role"), F.col("text")], ["conv_id"])


@query("select count(*) as n, sha256(string_agg(sha256(text), chr(10) order by sha256(text))) as fingerprint from benchmark")
def dataset_fingerprint(spark, sf_dir):
    return dedup.population_fingerprint(read(spark, sf_dir, "benchmark"), text.sha("text"))


@query("select count(*) as n, sha256(string_agg(item_id::varchar || chr(10), '' order by item_id::varchar)) as fingerprint from benchmark")
def population_fingerprint(spark, sf_dir):
    return dedup.population_fingerprint(read(spark, sf_dir, "benchmark"), F.col("item_id").cast("string"), trailing=True)


@query("""with h as (select sha256(doc_id::varchar) as h from documents),
p as (select h[1:4] as p, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as f from h group by 1)
select sum(n)::bigint as n, sha256(string_agg(f, chr(10) order by p)) as fingerprint from p""")
def merkle_fingerprint(spark, sf_dir):
    return dedup.merkle_fingerprint(read(spark, sf_dir, "documents"), F.col("doc_id"))


# ---------------------------------------------------------------- contamination


def with_copies(spark, sf_dir, changed) -> DataFrame:
    """Documents, and a changed copy of every benchmark item under an id of its own."""
    copies = texts(spark, sf_dir, "benchmark", "item_id").select((F.col("id") + 1_000_000_000).alias("id"), changed(F.col("text")).alias("text"))
    return texts(spark, sf_dir).unionByName(copies)


@query("""select b.item_id as heldout, list_sort(list(d.id)) as training from benchmark b join (select doc_id as id, text from documents union all select item_id + 1000000000, text from benchmark) d on sha256(b.text) = sha256(d.text) group by 1""")
def contam_l1(spark, sf_dir):
    return contamination.exact_matches(texts(spark, sf_dir, "benchmark", "item_id"), with_copies(spark, sf_dir, lambda t: t))


@query(f"""select b.item_id as heldout, list_sort(list(d.id)) as training from benchmark b join (select doc_id as id, text from documents union all select item_id + 1000000000, '  ' || replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', chr(9) || ' ') || chr(10) from benchmark) d
on {NORM.format("b.text")} = {NORM.format("d.text")} group by 1""")
def contam_l2(spark, sf_dir):
    changed = lambda t: F.concat(F.lit("  "), F.replace(F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), F.lit("\t ")), F.lit("\n"))
    return contamination.normalized_matches(texts(spark, sf_dir, "benchmark", "item_id"), with_copies(spark, sf_dir, changed))


GRAMS = """h as (select item_id as heldout, list_distinct([t[i:i+4] for i in range(1, length(t) - 3)]) as g from (select item_id, {norm} as t from benchmark) where length(t) >= 5),
hs as (select heldout, len(g) as own_size, unnest(g) as gram from h),
d as (select doc_id as training, list_distinct([t[i:i+4] for i in range(1, length(t) - 3)]) as g from (select doc_id, {norm} as t from documents) where length(t) >= 5),
ds as (select training, size, gram from (select training, len(g) as size, unnest(g) as gram from d) where gram in (select gram from hs)),
ok as (select gram from ds group by gram having count(*) <= {max_df}),
s as (select heldout, training, own_size, size, count(*) as shared from hs join ds using (gram) where gram in (select gram from ok) group by all),
f as (select heldout, training, shared, shared / (own_size + size - shared) as jaccard, shared / own_size as containment, own_size < 25 as short from s)
"""


@query("with " + GRAMS.format(norm=N_DOC, max_df=1000) + """
select heldout, training, shared, jaccard, containment, rank from (select *, row_number() over (partition by heldout order by shared desc, training desc) as rank from f where jaccard >= 0.5 or (not short and containment >= 0.6)) where rank <= 5""")
def contam_l3_char5(spark, sf_dir):
    return char5(spark, sf_dir, contamination.Thresholds())


def char5(spark, sf_dir, limits: contamination.Thresholds) -> DataFrame:
    scores = contamination.shingle_scores(texts(spark, sf_dir, "benchmark", "item_id"), texts(spark, sf_dir), limits)
    return contamination.top_findings(contamination.shingle_findings(scores, limits), limits).select("heldout", "training", "shared", "jaccard", "containment", "rank")


@query()
def contam_l4_edit(spark, sf_dir):
    limits = contamination.Thresholds(edit_floor=0.05, edit=0.1)
    held, docs = texts(spark, sf_dir, "benchmark", "item_id"), texts(spark, sf_dir)
    found = contamination.shingle_findings(contamination.shingle_scores(held, docs, limits), limits)
    return contamination.edit_matches(found, held, docs, limits)


@query("with " + GRAMS.format(norm=N_DOC, max_df=1000) + f""",
q as (select b.item_id as heldout, 1 as level, d.doc_id::varchar as training from benchmark b join documents d on b.text = d.text
 union all select b.item_id, 2, d.doc_id::varchar from benchmark b join documents d on {NORM.format("b.text")} = {NORM.format("d.text")}
 union all select heldout, 3, training::varchar from f where jaccard >= 0.5 or (not short and containment >= 0.6))
select heldout, list_sort(list_distinct(list(level))) as levels, count(distinct training) as n_training from q group by 1""")
def contamination_queue(spark, sf_dir):
    return screened(spark, sf_dir, contamination.Thresholds())


def screened(spark, sf_dir, limits: contamination.Thresholds) -> DataFrame:
    held, docs = texts(spark, sf_dir, "benchmark", "item_id"), texts(spark, sf_dir)
    found = contamination.shingle_findings(contamination.shingle_scores(held, docs, limits), limits).withColumn("training", F.array("training"))
    levels = [(1, contamination.exact_matches(held, docs)), (2, contamination.normalized_matches(held, docs)), (3, found)]
    return contamination.queue([(n, df.select("heldout", F.explode("training").alias("training"))) for n, df in levels])


@query(f"""with b as (select item_id, string_split({N_DOC}, ' ') as w, {N_DOC} as norm from benchmark), d as (select source, string_split({N_DOC}, ' ') as w, {N_DOC} as norm from documents),
bg as (select item_id, greatest(len(w) - 7, 0) as total, unnest(range(0, greatest(len(w) - 7, 0))) as place, w from b),
bs as (select item_id, total, place, array_to_string(w[place + 1:place + 8], ' ') as gram from bg),
dg as (select source, w, unnest(range(0, greatest(len(w) - 7, 0))) as place from d), ds as (select distinct source as corpus, array_to_string(w[place + 1:place + 8], ' ') as gram from dg),
c as (select item_id as heldout, corpus, total, count(distinct place) as covered from bs join ds using (gram) group by all),
e as (select distinct b.item_id as heldout, d.source as corpus from b join d on b.norm = d.norm where length(b.norm) >= 12)
select heldout, corpus, coalesce(covered, 0) as covered, coalesce(total, 0) as total, (e.heldout is not null or coalesce(covered / total >= 0.5, false)) as contained
from c full join e using (heldout, corpus)""")
def contam_probe_word8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("corpus"), "text")
    return contamination.word_probe(texts(spark, sf_dir, "benchmark", "item_id"), docs)


@query(f"""select b.item_id as item, d.doc_id as doc from (select item_id, {N_DOC} as t from benchmark) b join (select doc_id, {N_DOC} as t from documents) d
on contains(' ' || d.t || ' ', ' ' || b.t || ' ')""")
def benchmark_passage_containment(spark, sf_dir):
    return contamination.passages(texts(spark, sf_dir, "benchmark", "item_id"), texts(spark, sf_dir))


@query("""select case when doc_id % 10 = 0 then 'held_out' when b.text is not null then 'benchmark' end as excluded_by, count(*) as n
from documents d left join (select distinct text from benchmark) b using (text) group by 1""")
def ordered_exclusions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rules = [("held_out", docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("key")), F.col("doc_id")), ("benchmark", read(spark, sf_dir, "benchmark").select(F.col("text").alias("key")), F.col("text"))]
    return contamination.exclude(docs, rules)[1]


@query("""with o as (select item_id as item, sha256(text) as fp, case when item_id % 3 = 0 then 'CONTAMINATED' else 'INCIDENTAL_OVERLAP' end as v from benchmark where item_id % 4 <> 1),
n as (select item_id as item, case when item_id % 5 = 0 then 'new' else sha256(text) end as fp from benchmark where item_id % 4 <> 2)
select coalesce(n.item, o.item) as item, coalesce(n.fp, o.fp) as fingerprint,
case when o.item is not null and n.item is not null and o.fp <> n.fp and o.v <> 'CONTAMINATED' then 'PENDING' else coalesce(o.v, 'PENDING') end as verdict,
(o.item is not null and n.item is not null and o.fp is distinct from n.fp) as stale
from o full join n on o.item = n.item where n.item is not null or o.v = 'CONTAMINATED'""")
def audit_merge(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    state = items.where("item_id % 4 <> 1").select(F.col("item_id").alias("item"), text.sha("text").alias("fingerprint"), F.when(F.col("item_id") % 3 == 0, "CONTAMINATED").otherwise("INCIDENTAL_OVERLAP").alias("verdict"))
    found = items.where("item_id % 4 <> 2").select(F.col("item_id").alias("item"), F.when(F.col("item_id") % 5 == 0, "new").otherwise(text.sha("text")).alias("fingerprint"))
    return contamination.merge_audit(state, found)


@query(f"""with g as (select item_id, list_distinct([t[i:i+4] for i in range(1, length(t) - 3)]) as g from (select item_id, {N_DOC} as t from benchmark)),
e as (select item_id, p, unnest(g) as gram from g, range(0, 32) r(p))
select item_id, list(m order by p) as signature from (select item_id, p, min(sha256(p::varchar || gram)) as m from e group by all) group by 1""")
def minhash_signature(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", text.char_ngrams(text.normalize("text")).alias("grams"))
    return items.select("item_id", text.minhash(F.col("grams")).alias("signature"))


@query(f"""with g as (select item_id, list_distinct([t[i:i+4] for i in range(1, length(t) - 3)]) as g from (select item_id, {N_DOC} as t from benchmark))
select a.item_id, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) as jaccard from g a join g b on b.item_id = a.item_id + 1""")
def char_ngram_jaccard(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", text.char_ngrams(text.normalize("text")).alias("grams"))
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("grams").alias("next"))
    return items.join(following, "item_id").select("item_id", text.jaccard(F.col("grams"), F.col("next")).alias("jaccard"))


# ---------------------------------------------------------------- conversations


def chats(spark, sf_dir):
    return conversations.assemble(read(spark, sf_dir, "conversations"))


CHAT = "m as (select conv_id as id, list(role order by turn) as roles, list(text order by turn) as texts from conversations group by conv_id)"


@query(f"""with {CHAT}, b as (select *, case when roles[1] = 'system' then roles[2:] else roles end as body from m)
select id, roles[1] = 'system' as leading_system_message, case when body = ['user', 'assistant'] then 'single_exchange' else 'multi_turn' end as exchange_shape,
len(list_filter(roles, lambda r: r = 'user')) as user_turns, len(list_filter(roles, lambda r: r = 'assistant')) as assistant_turns, roles[-1] as final_role,
(roles[-1] = 'assistant' and trim(coalesce(texts[-1], '')) <> '') as final_assistant_prose from b""")
def conv_structure(spark, sf_dir):
    return conversations.structure(chats(spark, sf_dir)).select("id", "leading_system_message", "exchange_shape", F.col("user_turns").cast("long"), F.col("assistant_turns").cast("long"), "final_role", "final_assistant_prose")


@query(f"""with {CHAT}, e as (select unnest([{{'f': 'turns', 'v': len(roles)::varchar}}, {{'f': 'multi_turn', 'v': (len(roles) > 3)::varchar}}, {{'f': 'final_role', 'v': roles[-1]}}]) as e from m)
select e.f as facet, e.v as value, count(*) as n, count(*) / sum(count(*)) over (partition by e.f) as share from e group by 1, 2""")
def turn_shape_hist(spark, sf_dir):
    rows = chats(spark, sf_dir)
    size = F.size("messages")
    return conversations.histogram(rows, {"turns": size, "multi_turn": size > 3, "final_role": F.try_element_at("messages", F.lit(-1))["role"]})


@query(f"""with {CHAT}, b as (select id, case when roles[1] = 'system' then roles[2:] else roles end as r, case when roles[1] = 'system' then texts[2:] else texts end as t from m),
s as (select *, len(r) >= 2 and r[1] = 'user' and r[2] = 'assistant' as shaped from b)
select id, case when not shaped then 'NOT_USER_THEN_ASSISTANT' when trim(coalesce(t[2], '')) = '' or t[1] is null then 'EMPTY_REPLY' end as reason,
case when len(r) = 2 then 'SINGLE_EXCHANGE' else 'HAS_CONTINUATION' end as unit, case when shaped then length(t[2]) end as reply_chars from s""")
def first_reply_units(spark, sf_dir):
    return conversations.first_replies(chats(spark, sf_dir)).select("id", "reason", "unit", F.length("reply").cast("long").alias("reply_chars"))


@query("""with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as at from conversations)
select a.conv_id::varchar || '_turn_' || a.at::varchar as prompt_state_id, 'ANSWER' as target_action_type, a.at as n_prefix,
coalesce((select arg_max(s.text, s.at) from t s where s.conv_id = a.conv_id and s.at < a.at and s.role = 'system'), '') as system_prompt from t a where a.role = 'assistant'""")
def prompt_states(spark, sf_dir):
    return conversations.prompt_states(chats(spark, sf_dir)).select("prompt_state_id", "target_action_type", F.size("prefix").cast("long").alias("n_prefix"), "system_prompt")


@query("""select count(distinct conv_id) as samples, count(*) as turns, count(*) / count(distinct conv_id) as mean_turns, 0::bigint as calls from conversations""")
def conv_stats(spark, sf_dir):
    return conversations.stats(chats(spark, sf_dir))


@query("""select conv_id as id, sha256(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn)) as rendered from conversations group by 1""")
def rendered_chats(spark, sf_dir):
    return chats(spark, sf_dir).select("id", text.sha(conversations.render(F.col("messages"))).alias("rendered"))


REFUSED = " or ".join("regexp_matches(left(text, {0}), '(?im){1}')".format(text.REFUSAL_WINDOW, pattern.replace("'", "''")) for _, pattern in text.REFUSAL_PATTERNS)


@query(f"select role, count(*) as n, count_if({REFUSED}) as refusals from conversations group by 1")
def refusal_rate_by_role(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(text.refusal("text").isNotNull()).alias("refusals"))


@query("""select template, count(*) as n from (select array_to_string(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' ')[1:12], ' ') as template from conversations where role = 'assistant') group by 1 order by n desc, template limit 10""")
def refusal_template_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(text.refusal_template("text").alias("template"))
    return rows.groupBy("template").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "template").limit(10)


@query("""select conv_id, turn, case when contains(lower(text), 'cannot help') or contains(lower(text), 'can''t help') or contains(lower(text), 'unable to') or contains(lower(text), 'not supported') or contains(lower(text), 'unsupported') then 'UNSUPPORTED'
 when contains(text, '?') or contains(lower(text), 'could you clarify') or contains(lower(text), 'please provide') or contains(lower(text), 'which one') then 'CLARIFY' else 'ANSWER' end as decision from conversations where role = 'assistant'""")
def prose_decisions(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", outputs.prose_decision("text").alias("decision"))


@query()
def parsed_outputs(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", outputs.parsed("text", F.lit(False)).alias("p")).select("conv_id", "turn", "p.decision", "p.status", F.size("p.calls").alias("n_calls"))


# ---------------------------------------------------------------- evaluation

LABELS = ("CALL", "ANSWER", "CLARIFY", "UNSUPPORTED")


def predictions(spark, sf_dir, shift: int = 0) -> DataFrame:
    """Evaluation rows made from documents: gold and predicted decisions by arithmetic on the id."""
    names = F.array(*(F.lit(x) for x in LABELS))
    i = F.col("doc_id")
    right = (i + shift) % 7 < 5
    return read(spark, sf_dir, "documents").select(
        i.alias("example_id"), F.col("source").alias("source"), F.col("lang").alias("benchmark"), F.get(names, (i % 4).cast("int")).alias("gold"),
        F.get(names, F.when(right, i % 4).otherwise((i + shift + 1) % 4).cast("int")).alias("predicted"),
        F.when(i % 11 == 0, "FORMAT_ERROR").otherwise("RAW_VALID").alias("status"), (i % 13 == 0).alias("truncated"), F.col("n_chars").alias("tokens"),
    )


def _pred(shift: int = 0) -> str:
    label = "['CALL', 'ANSWER', 'CLARIFY', 'UNSUPPORTED']"
    return f"""(select doc_id as example_id, source, lang as benchmark, {label}[doc_id % 4 + 1] as gold, {label}[case when (doc_id + {shift}) % 7 < 5 then doc_id % 4 else (doc_id + {shift} + 1) % 4 end + 1] as predicted,
case when doc_id % 11 = 0 then 'FORMAT_ERROR' else 'RAW_VALID' end as status, doc_id % 13 = 0 as truncated, n_chars as tokens from documents)"""


@query(f"""select a.l as actual, p.l as predicted, count(x.gold) as n from (select unnest(['CALL','ANSWER','CLARIFY','UNSUPPORTED']) as l) a, (select unnest(['CALL','ANSWER','CLARIFY','UNSUPPORTED']) as l) p
left join {_pred()} x on x.gold = a.l and x.predicted = p.l group by 1, 2""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "gold", "predicted")


ROUTING = """select {by} count(*) as n, coalesce(count_if(gold='CALL' and predicted='CALL') / nullif(count_if(predicted='CALL'), 0), 0) as call_precision,
coalesce(count_if(gold='CALL' and predicted='CALL') / nullif(count_if(gold='CALL'), 0), 0) as call_recall,
coalesce(count_if(gold='ANSWER' and predicted='ANSWER') / nullif(count_if(gold='ANSWER'), 0), 0) as no_call_accuracy,
coalesce(count_if(gold='CLARIFY' and predicted='CLARIFY') / nullif(count_if(gold='CLARIFY'), 0), 0) as clarification_accuracy,
coalesce(count_if(gold='UNSUPPORTED' and predicted='UNSUPPORTED') / nullif(count_if(gold='UNSUPPORTED'), 0), 0) as unsupported_accuracy,
coalesce(count_if(gold='CALL' and predicted='ANSWER') / nullif(count_if(gold='CALL'), 0), 0) as under_call_rate,
coalesce(count_if(gold<>'CALL' and predicted='CALL') / nullif(count_if(gold<>'CALL'), 0), 0) as over_call_rate from {rows} group by all"""


@query("select *, case when call_precision + call_recall > 0 then 2 * call_precision * call_recall / (call_precision + call_recall) else 0 end as call_f1 from (" + ROUTING.format(by="source,", rows=_pred()) + ")")
def routing_metrics(spark, sf_dir):
    return metrics.routing(predictions(spark, sf_dir), ("source",), "gold", "predicted")


RESIDUAL = "case when status = 'FORMAT_ERROR' then 'FORMAT_ERROR' when gold = 'CALL' and predicted <> 'CALL' then 'UNDER_CALL' when gold <> 'CALL' and predicted = 'CALL' then 'OVER_CALL' when truncated then 'PREMATURE_STOP' end"


@query(f"with r as (select {RESIDUAL} as residual from {_pred()}) select residual, count(*) as n, count(*) / (select count(*) from r) as rate from r where residual is not null group by 1")
def residual_rates(spark, sf_dir):
    return metrics.residual_rates(predictions(spark, sf_dir).withColumnRenamed("gold", "actual"))


BUCKET = "case when gold = predicted then 'correct' when predicted = 'UNSUPPORTED' then 'refusals' when status <> 'RAW_VALID' then 'parse_failures' else 'incorrect_attempted' end"


@query(f"""select benchmark, count(*) as total, count_if(b = 'correct') as correct, count_if(b = 'incorrect_attempted') as incorrect_attempted, count_if(b = 'refusals') as refusals, count_if(b = 'parse_failures') as parse_failures,
count_if(b = 'correct') / count(*) as accuracy, count_if(b = 'correct') / nullif(count_if(b in ('correct', 'incorrect_attempted')), 0) as accuracy_given_answer from (select *, {BUCKET} as b from {_pred()}) group by 1""")
def answer_accounting(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("benchmark", (F.col("gold") == F.col("predicted")).alias("correct"), (F.col("predicted") == "UNSUPPORTED").alias("refused"), (F.col("status") == "RAW_VALID").alias("parsed"))
    return metrics.accounting(rows, ["benchmark"])


@query(f"""select benchmark, count(*) as n, avg((gold = predicted)::int) as accuracy, avg(case when tokens % 3 > 0 then tokens % 3 end)::double as mean_latency, sum(case when tokens % 3 > 0 then tokens end) / sum(case when tokens % 3 > 0 then tokens % 3 end)::double as tokens_per_second from {_pred()} group by 1""")
def task_metrics(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("benchmark", (F.col("gold") == F.col("predicted")).alias("success"), (F.col("tokens") % 3).alias("latency"), "tokens")
    return metrics.task_metrics(rows, ["benchmark"])


@query(f"""with f as (select {RESIDUAL} as code, example_id from {_pred()} where {RESIDUAL} is not null), t as (select count(*) as t from f)
select code, count(*) as n, count(*) / (select t from t) as share, list_sort(list(example_id order by example_id)[1:3]) as samples from f group by 1""")
def failure_clusters(spark, sf_dir):
    code = metrics.residual(F.col("gold"), F.col("predicted"), F.col("status"), F.col("truncated"))
    return metrics.clusters(predictions(spark, sf_dir).where(code.isNotNull()), code, "example_id")


@query(f"""select case when c.predicted = b.gold then 'fixed' when b.predicted = b.gold then 'broke' else 'lateral' end as flip, count(*) as n from {_pred()} b join {_pred(3)} c using (example_id) where b.predicted <> c.predicted group by 1""")
def flips_fixed_broke_lateral(spark, sf_dir):
    return metrics.flips(predictions(spark, sf_dir), predictions(spark, sf_dir, 3))


@query(f"""select b.predicted || '->' || c.predicted as transition, count(*) as n from {_pred()} b join {_pred(3)} c using (example_id) where b.predicted <> c.predicted group by 1""")
def transition_histogram(spark, sf_dir):
    return metrics.transitions(predictions(spark, sf_dir), predictions(spark, sf_dir, 3))


@query(f"""select benchmark, example_id, case when b is null then 'new' when a is null then 'fixed' else 'persistent' end as state from (select benchmark, example_id, 1 as b from {_pred()} where gold <> predicted) full join (select benchmark, example_id, 1 as a from {_pred(3)} where gold <> predicted) using (benchmark, example_id)""")
def failure_diff(spark, sf_dir):
    wrong = F.col("gold") != F.col("predicted")
    return metrics.failure_diff(predictions(spark, sf_dir).where(wrong), predictions(spark, sf_dir, 3).where(wrong), ["benchmark", "example_id"])


def _accuracy(spark, sf_dir, shift: int, keep: str) -> DataFrame:
    return predictions(spark, sf_dir, shift).where(keep).groupBy("source").agg((F.count_if(F.col("gold") == F.col("predicted")) / F.count("*")).alias("accuracy"))


def _acc(shift: int, keep: str) -> str:
    return f"(select source, count_if(gold = predicted) / count(*) as accuracy from {_pred(shift)} where {keep} group by 1)"


@query(f"""select source, coalesce(b.accuracy, 0) as before, coalesce(a.accuracy, 0) as after, coalesce(a.accuracy, 0) - coalesce(b.accuracy, 0) as delta from {_acc(0, "source <> 'src1'")} b full join {_acc(3, "source <> 'src2'")} a using (source)""")
def regression_full_outer(spark, sf_dir):
    return metrics.compare_filled(_accuracy(spark, sf_dir, 0, "source <> 'src1'"), _accuracy(spark, sf_dir, 3, "source <> 'src2'"), "source", "accuracy")


@query(f"""select source, b.accuracy as before, a.accuracy as after, a.accuracy - b.accuracy as delta, case when a.accuracy > b.accuracy then 'IMPROVED' when a.accuracy < b.accuracy then 'REGRESSED' else 'UNCHANGED' end as verdict from {_acc(0, "source <> 'src1'")} b join {_acc(3, "source <> 'src2'")} a using (source)""")
def metric_inner_compare(spark, sf_dir):
    return metrics.compare_shared(_accuracy(spark, sf_dir, 0, "source <> 'src1'"), _accuracy(spark, sf_dir, 3, "source <> 'src2'"), "source", "accuracy")


@query(f"""with l as (select source, predicted, row_number() over (partition by source order by example_id) as nth from {_pred()}), r as (select source, predicted, row_number() over (partition by source order by example_id) as nth from {_pred(3)} where example_id % 5 <> 0)
select source, count(*) as pairs, count_if(l.predicted = r.predicted) as equal from l join r using (source, nth) group by 1""")
def positional_parity(spark, sf_dir):
    return metrics.parity(predictions(spark, sf_dir), predictions(spark, sf_dir, 3).where("example_id % 5 <> 0"), ["example_id"], "predicted", ["source"])


@query(f"""with b as (select example_id from {_pred()} where example_id % 9 <> 0), c as (select example_id from {_pred()} where example_id % 8 <> 0 union all select example_id from {_pred()} where example_id % 10 = 1),
l as (select example_id, count(*) as l from b group by 1), r as (select example_id, count(*) as r from c group by 1)
select problem, count(*) as n from (select case when l is null then 'UNKNOWN' when r is null then 'MISSING' when l > 1 or r > 1 then 'DUPLICATE' end as problem from l full join r using (example_id)) where problem is not null group by 1""")
def exactly_once_join(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("example_id")
    return metrics.exactly_once(rows.where("example_id % 9 <> 0"), rows.where("example_id % 8 <> 0").unionByName(rows.where("example_id % 10 = 1")), "example_id")


@query("""select s_suppkey, s_acctbal, s_nationkey from supplier a where not exists (select 1 from supplier b where b.s_suppkey <> a.s_suppkey and b.s_acctbal >= a.s_acctbal and b.s_nationkey >= a.s_nationkey and (b.s_acctbal > a.s_acctbal or b.s_nationkey > a.s_nationkey))""")
def pareto_front(spark, sf_dir):
    return metrics.pareto(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey", ["s_acctbal", "s_nationkey"])


@query("""with b as (select l_linenumber as depth, sum(l_quantity) as drafted, sum(case when l_returnflag = 'N' then l_quantity else 0 end) as accepted from lineitem group by 1), r as (select *, case when drafted > 0 then accepted / drafted else 0 end as acceptance from b)
select depth, drafted, accepted, acceptance, case when lag(acceptance) over (order by depth) is null then acceptance when lag(acceptance) over (order by depth) > 0 then acceptance / lag(acceptance) over (order by depth) else 0 end as conditional, acceptance >= 0.3 as useful from r""")
def depth_acceptance(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("depth"), F.col("l_quantity").alias("drafted"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0).alias("accepted"))
    return metrics.depth_acceptance(rows)


# ---------------------------------------------------------------- statistics

W = "1.959963984540054"
WILSON_SQL = """(p + {z}*{z}/(2*n)) / (1 + {z}*{z}/n) {sign} {z} * sqrt(p*(1-p)/n + {z}*{z}/(4*n*n)) / (1 + {z}*{z}/n)"""


@query(f"""select source, k, n::bigint as n, round({WILSON_SQL.format(z=W, sign='-')}, 9) as low, round({WILSON_SQL.format(z=W, sign='+')}, 9) as high, round({W} * sqrt(0.25 / n), 9) as half_width, case when n >= 601 then 'FULL' when n >= 385 then 'GOOD' when n >= 200 then 'FAIR' else 'SMALL' end as status
from (select source, k, n, k / n as p from (select source, count_if(gold = predicted) as k, count(*)::double as n from {_pred()} group by 1))""")
def wilson_ci(spark, sf_dir):
    counts = predictions(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("gold") == F.col("predicted")).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("source", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(stats.worst_half_width(F.col("n")), 9).alias("half_width"), stats.ladder(F.col("n"), ((601, "FULL"), (385, "GOOD"), (200, "FAIR")), "SMALL").alias("status"))


def _w(k: str, n: str, sign: str) -> str:
    return WILSON_SQL.format(z=W, sign=sign).replace("(1-p)", f"(1-{k}/{n})").replace("(p +", f"({k}/{n} +").replace("sqrt(p*", f"sqrt({k}/{n}*").replace("2*n", f"2*{n}").replace("4*n*n", f"4*{n}*{n}").replace(f"{W}/n", f"{W}/{n}").replace("))/n", f"))/{n}").replace(")/n +", f")/{n} +")


@query(f"""with a as (select source, count_if(gold = predicted)::double as k1, count(*)::double as n1 from {_pred()} group by 1), b as (select source, count_if(gold = predicted)::double as k2, count(*)::double as n2 from {_pred(3)} group by 1),
i as (select source, k1/n1 as p1, k2/n2 as p2, {_w('k1', 'n1', '-')} as l1, {_w('k1', 'n1', '+')} as u1, {_w('k2', 'n2', '-')} as l2, {_w('k2', 'n2', '+')} as u2 from a join b using (source))
select source, round(p1 - p2 - sqrt((p1-l1)*(p1-l1) + (u2-p2)*(u2-p2)), 9) as low, round(p1 - p2 + sqrt((u1-p1)*(u1-p1) + (p2-l2)*(p2-l2)), 9) as high from i""")
def newcombe_diff(spark, sf_dir):
    def counts(shift, k, n):
        return predictions(spark, sf_dir, shift).groupBy("source").agg(F.count_if(F.col("gold") == F.col("predicted")).alias(k), F.count("*").alias(n))

    low, high = stats.newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return counts(0, "k1", "n1").join(counts(3, "k2", "n2"), "source").select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""with r as (select benchmark, gold as l, predicted as r from {_pred()}), t as (select benchmark, count(*)::double as n, count_if(l = r) / count(*) as po from r group by 1),
m as (select benchmark, label, count_if(s = 0) as a, count_if(s = 1) as b from (select benchmark, l as label, 0 as s from r union all select benchmark, r, 1 from r) group by 1, 2), c as (select benchmark, sum(a * b) as two from m group by 1)
select benchmark, n::bigint as n, round(po, 9) as agreement, round(case when two / (n * n) < 1 then (po - two / (n * n)) / (1 - two / (n * n)) end, 9) as kappa from t join c using (benchmark)""")
def cohen_kappa(spark, sf_dir):
    out = stats.cohen_kappa(predictions(spark, sf_dir), "gold", "predicted", ("benchmark",))
    return out.select("benchmark", "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("select lang, quantile_cont(n_chars, [0, 0.25, 0.5, 0.75, 1]) as quartiles from documents group by 1")
def quartiles_inclusive(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(stats.quartiles("n_chars").alias("quartiles"))


@query("""with s as (select lang, list_sort(list(n_chars)) as v from documents group by 1)
select lang, v[floor((len(v) - 1) * 0.9)::int + 1] as p90_floor, v[round_even((len(v) - 1) * 0.9, 0)::int + 1] as p90_even from s""")
def nearest_rank_percentiles(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_list("n_chars")).alias("v"))
    return rows.select("lang", stats.percentile_at(F.col("v"), 0.9).alias("p90_floor"), stats.percentile_at(F.col("v"), 0.9, half_even=True).alias("p90_even"))


@query(f"""with c as (select source, count(*) as n, count_if(predicted = 'CALL') as p, count_if(predicted = 'CALL' and gold = 'CALL') as h from {_pred()} where example_id % 3 = 0 group by 1), s as (select source, count(*) as size from documents group by 1),
j as (select *, size / n as w from s left join c using (source)) select count_if(n is null) as uncovered, round(case when count_if(n is null) = 0 and sum(w * p) > 0 then sum(w * h) / sum(w * p) end, 9) as precision from j""")
def poststratified_ratio(spark, sf_dir):
    sample = predictions(spark, sf_dir).where("example_id % 3 = 0").select("source", (F.col("predicted") == "CALL").alias("flagged"), (F.col("gold") == "CALL").alias("hit"))
    size = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return mixture.poststratified(sample, size, "source").select("uncovered", F.round("precision", 9).alias("precision"))


# ---------------------------------------------------------------- samples


@query("select doc_id, sha256('s1|' || source || '|' || doc_id::varchar) as rank_key, row_number() over (partition by source order by sha256('s1|' || source || '|' || doc_id::varchar)) as rank from documents qualify rank <= 5")
def hash_rank_sample(spark, sf_dir):
    return sampling.hash_sample(read(spark, sf_dir, "documents"), "s1", "doc_id", 5, ["source"]).select("doc_id", "rank_key", "rank")


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('b|' || lang || '|' || doc_id::varchar), doc_id) as rank, count(*) over (partition by lang) as n from documents)
select doc_id, lang, rank from r where rank <= (select min(n) from r)""")
def balanced_min_supply(spark, sf_dir):
    return sampling.balanced(read(spark, sf_dir, "documents"), "lang", "b", "doc_id").select("doc_id", "lang", "rank")


@query("""select doc_id, case when rank <= greatest(1, least(round_even(n * 0.35, 0)::bigint, n - 1)) then 'dev' else 'confirm' end as part
from (select doc_id, row_number() over (partition by lang order by sha256('d|' || lang || '|' || doc_id::varchar), doc_id) as rank, count(*) over (partition by lang) as n from documents)""")
def dev_confirm_split(spark, sf_dir):
    return sampling.split(read(spark, sf_dir, "documents"), "lang", "d", "doc_id").select("doc_id", "part")


@query("""with s as (select lang, count(*) as n, sum(count(*)) over () as a from documents group by 1), f as (select *, (100 * n // a)::bigint as q, row_number() over (order by n desc, lang) as o from s), r as (select *, 100 - sum(q) over () as rest from f),
k as (select lang, q + case when o <= rest then 1 else 0 end as quota from r),
d as (select doc_id, lang, row_number() over (partition by lang order by sha256('q|' || lang || '|' || doc_id::varchar), doc_id) as rank from documents)
select doc_id, lang, rank, quota::bigint as quota from d join k using (lang) where rank <= quota""")
def quota_take_per_stratum(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    quotas = sampling.allocate_proportional(sampling.supply(docs, "lang"), 100)
    table = spark.createDataFrame(sorted(quotas.items()), "lang string, quota long")
    return sampling.take_quotas(docs, table, ["lang"], "q", "doc_id").select("doc_id", "lang", "rank", "quota")


@query("select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents qualify rank <= 3")
def top_k_per_group(spark, sf_dir):
    return sampling.top_k(read(spark, sf_dir, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).select("doc_id", "source", "n_chars", "rank")


@query("""with d as (select o_orderdate as step, sum(o_totalprice::decimal(18, 2)) as tokens from orders group by 1), r as (select step, sum(tokens) over (order by step) as run, sum(tokens) over () as every from d)
select f as fraction, min(step) as step from r, (select unnest([0.1, 0.25, 0.5, 1.0]::double[]) as f) where run >= f * every group by 1""")
def exposure_milestones(spark, sf_dir):
    steps = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("step")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("tokens"))
    return sampling.exposure(steps, [0.1, 0.25, 0.5, 1.0])


@query()
def packed_batches(spark, sf_dir):
    return sampling.pack(read(spark, sf_dir, "documents"), "p", "doc_id", "n_chars", 20_000).select("doc_id", "window", "batch")


# ---------------------------------------------------------------- mixtures and gates


@query("select source, count(*) as samples, count(*) / sum(count(*)) over () as sample_share, sum(n_chars)::bigint as tokens, sum(n_chars) / sum(sum(n_chars)) over () as token_share from documents group by 1")
def mixture_shares(spark, sf_dir):
    return mixture.shares(read(spark, sf_dir, "documents"), "source", F.col("n_chars"))


YIELD = """select source, count(*) as canonical, count_if(r) as rendered, count_if(t) as trainable, count_if(c) as call_target, coalesce(count_if(r) / nullif(count(*), 0), 0) as render_yield, coalesce(count_if(t) / nullif(count_if(r), 0), 0) as trainable_yield, coalesce(count_if(c) / nullif(count_if(t), 0), 0) as call_share
from (select source, n_chars > 100 as r, n_chars > 100 and doc_id % 5 <> 0 as t, n_chars > 100 and doc_id % 5 = 1 as c from documents) group by 1"""


def _yields(spark, sf_dir):
    long, i = F.col("n_chars") > 100, F.col("doc_id")
    return mixture.yields(read(spark, sf_dir, "documents").select("source", long.alias("rendered"), (long & (i % 5 != 0)).alias("trainable"), (long & (i % 5 == 1)).alias("call_target")), "source")


@query(YIELD)
def yield_by_source(spark, sf_dir):
    return _yields(spark, sf_dir)


@query(f"""select source, trainable_yield, expected, case when expected is null or expected <= 0 then 'NOT_EXPECTED' when trainable_yield / expected < 0.5 then 'COLLAPSE' when trainable_yield / expected < 0.9 then 'ANOMALY' else 'OK' end as verdict
from ({YIELD}) left join (select col0 as source, col1 as expected from (values ('src0', 0.8::double), ('src1', 0.95::double), ('src2', 2.0::double))) using (source)""")
def yield_gate(spark, sf_dir):
    expected = spark.createDataFrame([("src0", 0.8), ("src1", 0.95), ("src2", 2.0)], "source string, expected double")
    return mixture.yield_gate(_yields(spark, sf_dir), expected, "source")


@query("""with v as (select 'full' as variant, n_chars as t from documents union all select 'without', n_chars from documents where source <> 'src0'), c as (select variant, count(*) as records, sum(t)::bigint as tokens, avg(t) as mean, median(t) as median, max(t) as longest from v group by 1)
select *, round_even(2400 * tokens / (select tokens from c where variant = 'full'), 0)::bigint as matched_steps from c""")
def ablation_mass(spark, sf_dir):
    return mixture.ablation(read(spark, sf_dir, "documents"), "source", "n_chars", "src0", 2400)


@query(f"""with f as (select {RESIDUAL} as code, count(*) as n from {_pred()} where {RESIDUAL} is not null group by 1), c as (select * from (values ('FORMAT_ERROR', 'format'), ('UNDER_CALL', 'calling'), ('OVER_CALL', 'calling'), ('PREMATURE_STOP', 'length')) x(code, capability)),
s as (select capability, sum(n) as n from f join c using (code) group by 1), w as (select capability, greatest(0.05, least(0.5, n / sum(n) over ())) as w from s) select capability, round(w / sum(w) over (), 9) as weight from w""")
def residual_weights(spark, sf_dir):
    code = metrics.residual(F.col("gold"), F.col("predicted"), F.col("status"), F.col("truncated"))
    failures = predictions(spark, sf_dir).select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    capability = spark.createDataFrame([("FORMAT_ERROR", "format"), ("UNDER_CALL", "calling"), ("OVER_CALL", "calling"), ("PREMATURE_STOP", "length")], "code string, capability string")
    return mixture.residual_weights(failures, capability).select("capability", F.round("weight", 9).alias("weight"))


def _metric_rows(spark, sf_dir, shift):
    row = metrics.routing(predictions(spark, sf_dir, shift), (), "gold", "predicted")
    names = ["call_f1", "call_recall", "over_call_rate"]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m")).select("m.*")


@query()
def promotion_gate(spark, sf_dir):
    checks = mixture.promotion(_metric_rows(spark, sf_dir, 3), _metric_rows(spark, sf_dir, 0), {"call_f1": 0.4, "missing_metric": 0.5}, {"over_call_rate": 0.2}, {"call_recall": 0.9})
    return checks.unionByName(mixture.verdict(checks).select(F.lit("verdict").alias("gate"), F.col("verdict").alias("dimension"), F.col("passed").cast("double").alias("observed"), F.col("checked").cast("double").alias("requirement"), (F.col("verdict") == "PASS").alias("passed"), F.col("verdict").alias("code")))


# ---------------------------------------------------------------- annotation, ledger, preferences


def sessions(spark, sf_dir) -> DataFrame:
    """Annotations of three sessions, made from the document id."""
    names = F.array(*(F.lit(x) for x in LABELS))
    each = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), each).where((F.col("item") + F.col("s")) % 5 != 0)
    return rows.select("item", F.concat(F.lit("a"), F.col("s").cast("string")).alias("session"), F.get(names, ((F.col("item") * (F.when(F.col("item") % 3 == 0, F.col("s")).otherwise(F.lit(0)) + 1)) % 4).cast("int")).alias("label"))


SESSIONS = """a as (select item, 'a' || s::varchar as session, ['CALL','ANSWER','CLARIFY','UNSUPPORTED'][(item * (case when item % 3 = 0 then s else 0 end + 1)) % 4 + 1] as label from (select doc_id as item, unnest([0, 1, 2]) as s from documents) where (item + s) % 5 <> 0)"""


@query(f"with {SESSIONS} select item, arg_min(session, o) as session, arg_min(label, o) as label from (select *, list_position(['a2', 'a0', 'a1'], session) as o from a) group by 1")
def composite_label_priority(spark, sf_dir):
    return annotation.composite(sessions(spark, sf_dir), ["a2", "a0", "a1"])


@query(f"""with {SESSIONS} select item, l.label as "left", r.label as "right" from (select * from a where session = 'a0') l full join (select * from a where session = 'a1') r using (item) where l.label is distinct from r.label""")
def disagreement(spark, sf_dir):
    return annotation.disagreements(sessions(spark, sf_dir), "a0", "a1", nulls=True)


@query(f"""with {SESSIONS}, c as (select item, label, count(*) as k from a group by 1, 2), t as (select item, sum(k)::bigint as n, max(k) as k, arg_max(label, (k, label)) as label from c group by 1)
select item, n, case when k * 2 > n then label end as label, case when k = n then 'unanimous' when k * 2 > n then 'majority' else 'none' end as kind from t""")
def consensus_majority(spark, sf_dir):
    return annotation.consensus(sessions(spark, sf_dir))


@query(f"""with {SESSIONS} select l.session as "left", r.session as "right", count(*) as n, count_if(l.label = r.label) as equal from a l join a r on l.item = r.item and l.session < r.session group by 1, 2""")
def agreement_matrix(spark, sf_dir):
    return annotation.agreement_matrix(sessions(spark, sf_dir))


@query(f"""with {SESSIONS}, d as (select session, count(distinct item) as done from a group by 1), g as (select session, done, unnest(['CALL','ANSWER','CLARIFY','UNSUPPORTED','UNKNOWN']) as label from d)
select session, label, count(a.item) as n, any_value(done) as done, (select count(*) from documents) as total from g left join a using (session, label) group by 1, 2""")
def annotation_progress(spark, sf_dir):
    return annotation.progress(read(spark, sf_dir, "documents"), sessions(spark, sf_dir), [*LABELS, "UNKNOWN"])


@query("""with i as (select doc_id as item, lang as label, doc_id % 50 = 0 as f, sha256('r|' || doc_id::varchar) as key from documents), t as (select *, case when f then 'FLAGGED' when label = 'es' then 'LABEL' end as reason from i)
select item, reason, key from t where reason is not null union all (select item, 'SAMPLE', key from t where reason is null order by key, item limit 20)""")
def review_queue(spark, sf_dir):
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("label"))
    return annotation.review_queue(items, items.where("item % 50 = 0"), ["es"], 20, "r")


@query("""with recursive e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as n from events),
c as (select user_id, event_id, event_type, n, null::varchar as prev_hash, sha256('|' || event_type) as hash from e where n = 1
union all select e.user_id, e.event_id, e.event_type, e.n, c.hash, sha256(c.hash || '|' || e.event_type) from e join c on e.user_id = c.user_id and e.n = c.n + 1),
t as (select user_id, event_id, event_type, prev_hash, case when event_id % 7 = 0 then sha256('x' || hash) else hash end as hash from c),
v as (select *, lag(hash) over (partition by user_id order by event_id) as before from t)
select user_id, count(*) as entries, count_if(prev_hash is distinct from before or hash <> sha256(coalesce(prev_hash, '') || '|' || event_type)) as broken from v group by 1""")
def hash_chain_check(spark, sf_dir):
    """Chains of each user's events, some entries of which were changed later."""
    events = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("events"))
    linked = F.aggregate("events", F.array().cast("array<string>"), lambda done, x: F.concat(done, F.array(annotation.chain_hash(F.try_element_at(done, F.lit(-1)), x["event_type"]))))
    rows = events.withColumn("hashes", linked).select("user_id", "hashes", F.posexplode("events").alias("n", "e"))
    own = F.get("hashes", F.col("n"))
    changed = F.when(F.col("e.event_id") % 7 == 0, F.sha2(F.concat(F.lit("x"), own), 256)).otherwise(own)
    entries = rows.select("user_id", "e.event_id", "e.event_type", F.when(F.col("n") > 0, F.get("hashes", F.col("n") - 1)).alias("prev_hash"), changed.alias("hash"))
    return annotation.verify_chain(entries, "event_id", ["event_type"], ["user_id"])


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def ledger_latest_state(spark, sf_dir):
    return annotation.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])


@query("""with p as (select l_orderkey as run, l_linenumber as step, l_partkey as checkpoint from lineitem), q as (select o_orderkey as run, min(l_partkey) as promoted from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 2 = 0 group by 1),
j as (select p.*, promoted, (step, checkpoint) as o from p left join q using (run))
select run, coalesce(arg_min(step, o) filter (checkpoint = promoted), arg_max(step, o)) as step, coalesce(arg_min(checkpoint, o) filter (checkpoint = promoted), arg_max(checkpoint, o)) as checkpoint from j group by 1""")
def headline_checkpoint(spark, sf_dir):
    points = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("checkpoint"))
    promoted = points.where("run % 2 = 0").groupBy("run").agg(F.min("checkpoint").alias("promoted"))
    return annotation.headline(points, "run", promoted, ["step", "checkpoint"], "checkpoint")


@query("""with e as (select s_suppkey as k, s_name as n, s_nationkey::varchar as c from supplier where s_suppkey % 7 <> 0), a as (select s_suppkey as k, case when s_suppkey % 5 = 0 then 'x' else s_name end as n, s_nationkey::varchar as c from supplier where s_suppkey % 6 <> 0),
j as (select coalesce(e.k, a.k) as s_suppkey, e.k is null as extra, a.k is null as missing, unnest([{'f': 's_name', 'x': e.n, 'y': a.n}, {'f': 's_nationkey', 'x': e.c, 'y': a.c}]) as c from e full join a on e.k = a.k)
select s_suppkey, c.f as field, case when extra then 'EXTRA' when missing then 'MISSING' else 'MISMATCH' end as kind, c.x as expected, c.y as actual from j where extra or missing or c.x is distinct from c.y""")
def registry_drift(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    actual = rows.where("s_suppkey % 6 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise(F.col("s_name")))
    return annotation.drift(rows.where("s_suppkey % 7 <> 0"), actual, "s_suppkey", ["s_name", "s_nationkey"])


@query("""with r as (select o_orderkey as run, case when o_orderkey % 3 = 0 then o_orderkey + 1000000 when o_orderkey % 3 = 1 then o_orderkey end as parent, case when o_orderstatus = 'F' then 'accepted' else 'open' end as status, case when o_orderkey % 4 > 0 then 'c' end as checkpoint from orders)
select run, 'MISSING_PARENT' as problem from r where parent is not null and parent not in (select run from r) union all select run, 'ACCEPTED_WITHOUT_CHECKPOINT' from r where status = 'accepted' and checkpoint is null""")
def lineage_problems(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(i.alias("run"), F.when(i % 3 == 0, i + 1000000).when(i % 3 == 1, i).alias("parent"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("open").alias("status"), F.when(i % 4 > 0, "c").alias("checkpoint"))
    return annotation.lineage_problems(rows)


@query("""with m as (select l_suppkey as series, l_linenumber as step, avg(l_quantity) as v from lineitem group by 1, 2), d as (select series, step, v - lag(v) over (partition by series order by step) as delta from m)
select series, step, round(delta, 6) as delta, min(case when abs(delta) > 2 then step end) over (partition by series) as first_beyond from d""")
def stage_deltas(spark, sf_dir):
    points = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.col("l_linenumber").alias("step")).agg(F.avg("l_quantity").alias("v"))
    return annotation.deltas(points, ["series"], "step", "v", 2.0).select("series", "step", F.round("delta", 6).alias("delta"), "first_beyond")


@query("select event_type, count(*) as n, arg_min(value, event_id) as first, arg_max(value, event_id) as last, min(value) as least, round(avg(value), 6) as mean from events where value is not null group by 1")
def loss_history(spark, sf_dir):
    return annotation.history(read(spark, sf_dir, "events"), ["event_type"], "event_id", F.col("value")).withColumn("mean", F.round("mean", 6))


@query(f"""with j as (select l.example_id, l.gold, l.predicted = l.gold as lo, r.predicted = l.gold as ro, 'l' || l.predicted as lp, 'r' || r.predicted as rp from {_pred()} l join {_pred(3)} r using (example_id)),
p as (select example_id, gold, case when lo then lp else rp end as chosen, case when lo then rp else lp end as rejected, row_number() over (partition by gold order by sha256('p|' || gold || '|' || example_id::varchar), example_id) as rank from j where lo <> ro)
select example_id, gold, chosen, rejected from p where rank <= 10""")
def disagreement_pairs(spark, sf_dir):
    def side(shift, mark):
        return predictions(spark, sf_dir, shift).select("example_id", "gold", F.col("predicted").alias("decision"), F.concat(F.lit(mark), "predicted").alias("output"))

    return preferences.disagreement_pairs(side(0, "l"), side(3, "r"), 10, "p")


@query("select source, count(*) as n from documents where source is not null group by 1 having count(*) < 51")
def small_counterfactual_groups(spark, sf_dir):
    return validators.small_groups(read(spark, sf_dir, "documents"), "source", 51)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def windowed_events(spark, sf_dir):
    from ..streaming.incremental import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))
