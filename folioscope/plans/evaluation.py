"""Evaluation: recall, ranks, gated scores, latency, run comparison, answer checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evalmetrics as ev
from ..operators import fusion
from ..operators.evidence import abstains, case_scores, citation_id, json_objects, valid_citations
from . import query
from .retrieval import _vectors


def _runs(t):
    """40 questions: the first 20 vectors for each, and the question's label as its gold, in sets of two neighbours."""
    v = _vectors(t, *range(40))
    ids = t("embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("want"))
    top = fusion.ranked(v, F.desc("score"), "doc_id", limit=20)
    ranked = top.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranked"))
    gold = ids.where("qid < 40").select("qid", "want", F.array(F.array(F.col("qid"), F.col("qid") + 1), F.array(F.pmod(F.col("qid") * 7, F.lit(50)))).alias("gold"))
    return ranked.join(gold, "qid")


RUNS = """base as (select q.vec_id qid, v.vec_id doc_id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) s, q.label want from embeddings v, embeddings q where q.vec_id < 40),
top as (select *, row_number() over (partition by qid order by s desc, doc_id) r from base qualify r <= 20),
gold as (select distinct qid, want, g.s set_no, unnest(g.d) doc_id from (select distinct qid, want from base) , lateral (select * from (values (0, [qid, qid + 1]), (1, [qid * 7 % 50])) x(s, d)) g),
sets as (select g.qid, g.want, g.set_no, count(*) n, count(t.r) hit, max(t.r) worst from gold g left join top t on t.qid = g.qid and t.doc_id = g.doc_id group by 1, 2, 3),
per as (select qid, want, max((hit = n and worst <= 5)::int) r5, max((hit = n and worst <= 20)::int) r20, min(case when hit = n then worst end) rk from sets group by 1, 2),
rel as (select distinct qid, doc_id from gold), dcg as (select rel.qid, sum(coalesce(1 / log2(t.r + 1), 0)) dcg, count(*) n from rel left join top t on t.qid = rel.qid and t.doc_id = rel.doc_id and t.r <= 10 group by 1),
nd as (select qid, dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) ndcg from dcg)"""


@query(f"""with {RUNS}, g as (select 'ALL' "group", * from per join nd using (qid) union all select 'label:' || want, * from per join nd using (qid))
select "group", count(*) n, round(avg(r5), 6) recall5, round(avg(r20), 6) recall20, round(avg(coalesce(1.0::double / rk, 0)), 6) mrr, round(avg(ndcg), 6) ndcg10 from g group by 1""")
def recall_mrr_ndcg(t):
    runs = _runs(t)
    rank = ev.satisfying_rank(F.col("ranked"), F.col("gold"))
    scored = runs.select(F.explode(ev.groups(("label", F.col("want")))).alias("group"), ev.recall_at(F.col("ranked"), F.col("gold"), 5).alias("r5"), ev.recall_at(F.col("ranked"), F.col("gold"), 20).alias("r20"), F.coalesce(1.0 / rank, F.lit(0.0)).alias("rr"), ev.ndcg_at(F.col("ranked"), F.array_distinct(F.flatten("gold")), 10).alias("nd"))
    avg = lambda c: F.round(F.avg(c), 6)
    return scored.groupBy("group").agg(F.count("*").alias("n"), avg("r5").alias("recall5"), avg("r20").alias("recall20"), avg("rr").alias("mrr"), avg("nd").alias("ndcg10"))


@query(f"with {RUNS} select qid, rk \"rank\" from per where rk is null or rk > 5")
def recall_misses(t):
    return _runs(t).select("qid", ev.satisfying_rank(F.col("ranked"), F.col("gold")).alias("rank")).where("rank is null or rank > 5")


@query("""with j as (select d.doc_id, lang, source, l.toxic = 1 critical, (l.quality * 2)::int correctness, d.doc_id % 10 = 0 abstain, d.doc_id % 20 = 0 abstained from documents d join labels l using (doc_id)),
s as (select *, case when abstain then abstained::int::double when critical then 0.0 else correctness / 2.0 end gated from j), g as (select 'ALL' "group", * from s union all select 'lang:' || lang, * from s union all select 'cat:' || source, * from s)
select "group", count(*) n, count(*) filter (where abstain) n_oos, round(avg(gated) filter (where not abstain), 6) gated, round(avg(correctness / 2.0) filter (where not abstain), 6) correctness, round(avg(critical::int) filter (where not abstain), 6) critical, round(avg(abstained::int) filter (where abstain), 6) abstention from g group by 1""")
def gated_scores(t):
    j = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id")
    abstain, critical, right = F.col("doc_id") % 10 == 0, F.col("toxic") == 1, F.col("quality") * 2
    s = j.select(F.explode(ev.groups(("lang", F.col("lang")), ("cat", F.col("source")))).alias("group"), abstain.alias("oos"), (F.col("doc_id") % 20 == 0).cast("int").alias("abst"), critical.cast("int").alias("crit"), (right / 2.0).alias("corr"), ev.gated(abstain, F.col("doc_id") % 20 == 0, critical, right).alias("gated"))
    avg = lambda c, when: F.round(F.avg(F.when(when, F.col(c))), 6)
    oos = F.col("oos")
    return s.groupBy("group").agg(F.count("*").alias("n"), F.count_if(oos).alias("n_oos"), avg("gated", ~oos).alias("gated"), avg("corr", ~oos).alias("correctness"), avg("crit", ~oos).alias("critical"), avg("abst", oos).alias("abstention"))


@query("""with o as (select event_type, value, row_number() over (partition by event_type order by value) k, count(*) over (partition by event_type) n from events)
select event_type, count(*) n, round(avg(value), 6) mean, max(case when k = floor((n - 1) * 50 / 100.0) + 1 then value end) p50, max(case when k = floor((n - 1) * 95 / 100.0) + 1 then value end) p95, max(value) "max" from o group by 1""")
def stage_latency(t):
    return ev.latency_summary(t("events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("""with d as (select distinct ts::date "day" from events) select event_type, d."day", count(*) n, round(avg(value), 6) mean, max(value) "max" from d join events e on e.ts::date between d."day" - 6 and d."day" group by 1, 2""")
def sliding_latency(t):
    """Latency by type over seven days, merged from daily sketches; percentiles are approximate and compared in the tests, the others are exact."""
    daily = ev.latency_sketches(t("events").withColumn("day", F.col("ts").cast("date")), ["event_type", "day"], "value")
    return ev.sliding_latency(daily, "event_type", "day", 7).select("event_type", "day", "n", F.round("mean", 6).alias("mean"), "max")


@query("""with a as (select doc_id, quality + toxic v from labels where doc_id % 3 <> 0), b as (select doc_id, quality v from labels where doc_id % 4 <> 0)
select coalesce(a.doc_id, b.doc_id) doc_id, case when a.doc_id is null then 'missing' when b.doc_id is null then 'added' when a.v > b.v then 'better' when a.v < b.v then 'worse' else 'same' end status from a full join b on a.doc_id = b.doc_id""")
def run_diff(t):
    labels = t("labels")
    return ev.run_diff(labels.where("doc_id % 3 <> 0").select("doc_id", (F.col("quality") + F.col("toxic")).alias("v")), labels.where("doc_id % 4 <> 0").select("doc_id", F.col("quality").alias("v")), "doc_id", "v")


@query("select doc_id, right(sha1(doc_id::varchar), 1) in ('0', '4', '8', 'c') holdout from documents")
def holdout_split(t):
    return t("documents").select("doc_id", ev.holdout(F.col("doc_id")).alias("holdout"))


@query("""with a as (select doc_id, list_distinct_sorted cited from (select doc_id, [doc_id % 7, doc_id % 5, doc_id % 7, 99] list_distinct_sorted from labels))
select doc_id, case when len(ok) > 0 then ok else fb end cited from (select doc_id, list_sort(list_distinct(list_filter(cited, lambda x: x <= 3))) ok, list_sort(list_distinct(list_filter([doc_id % 4, 50], lambda x: x <= 3))) fb from a)""")
def citation_fix(t):
    c = lambda n: F.pmod("doc_id", F.lit(n))
    scope = F.array(*(F.lit(i).cast("long") for i in range(4)))
    return t("labels").select("doc_id", F.array_sort(valid_citations(F.array(c(7), c(5), c(7), F.lit(99).cast("long")), scope, F.array(c(4), F.lit(50).cast("long")))).alias("cited"))


@query("""with r as (select conv_id, turn, case when turn % 3 = 0 then 'doc_' || conv_id when turn % 3 = 1 then conv_id::varchar else 'x' || conv_id end raw from conversations)
select conv_id, turn::bigint turn, case when regexp_matches(raw, '^[0-9]+$') then raw::bigint when regexp_matches(raw, '^doc_[0-9]+$') then substring(raw, 5)::bigint end id from r""")
def citation_parse(t):
    turn = F.col("turn")
    raw = F.when(turn % 3 == 0, F.concat(F.lit("doc_"), F.col("conv_id").cast("string"))).when(turn % 3 == 1, F.col("conv_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("conv_id").cast("string")))
    return t("conversations").select("conv_id", turn.cast("long").alias("turn"), citation_id(raw).alias("id"))


@query("""with c as (select conv_id, turn::bigint turn, lower(text) x, turn % 3 req, turn % 2 found from conversations), h as (select *, contains(x, 'the')::int + contains(x, 'and')::int hit, contains(x, 'zzz') bad from c),
s as (select conv_id, turn, hit / 2.0 recall, case when bad then 0.0 when req <= 0 then 1.0 else least(1.0, found / req::double) end faithful, hit, bad, req, found from h)
select conv_id, turn, round(recall, 6) recall, round(faithful, 6) faithful, faithful >= 0.85 passed, case when faithful >= 0.85 then null when req > found then 'citation_gap' when not bad and hit = 1 then 'lexical_mismatch' else 'content_failure' end failure from s""")
def answer_cases(t):
    words = F.array(F.lit("the"), F.lit("and"))
    s = case_scores(F.col("text"), words, F.array(F.lit("zzz")), F.col("turn") % 3, F.col("turn") % 2)
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), s.alias("s")).select("conv_id", "turn", F.round("s.recall", 6).alias("recall"), F.round("s.faithful", 6).alias("faithful"), "s.passed", "s.failure")


@query("select conv_id, arg_min(text like '%the%', turn) first_hit, arg_max(text like '%the%', turn) final_hit, bool_or(text like '%the%') any_hit from conversations group by 1")
def multi_turn_hits(t):
    hit = F.contains("text", F.lit("the"))
    return t("conversations").groupBy("conv_id").agg(F.min_by(hit, "turn").alias("first_hit"), F.max_by(hit, "turn").alias("final_hit"), F.bool_or(hit).alias("any_hit"))


@query("select role, count(*) n, count(*) filter (where regexp_matches(text, '(?i)\\b(no consta|not stated|no information|no se indica)\\b') and length(text) <= 200) abstained from conversations group by 1")
def abstention_rate(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(abstains(F.col("text"))).alias("abstained"))


@query("""with x as (select item_id, length(text) n from benchmark), k as (select unnest(['len:' || (n // 100), 'ALL']) reason from x) select reason, count(*) n, row_number() over (order by count(*) desc, reason) rank from k group by 1""")
def frequency_counters(t):
    size = F.concat(F.lit("len:"), F.floor(F.length("text") / 100).cast("string"))
    n = t("benchmark").select(F.explode(F.array(size, F.lit("ALL"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "reason")).cast("long"))


@query("select event_id, props json from events")
def json_from_text(t):
    """The objects inside fenced answers: each event's properties, which are in canonical form as they are."""
    raw = F.concat(F.lit("<think>{no}</think>```json\n"), "props", F.lit("\n```"))
    return json_objects(t("events").select("event_id", raw.alias("raw")), "event_id", "raw")
