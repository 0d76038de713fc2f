"""Further operators of the inventory: selection, evidence scoring, lookups, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vector import quantised
from ..operators import etl, evalmetrics, fusion, selection
from ..operators.corpus import chunk_windows, embedding_text
from ..operators import evidence as evid
from ..operators.evidence import coverage_ranking, density_evidence, unsupported_numbers
from ..operators.graph import veto
from ..operators.lexical import postings
from ..streaming import retry_state, windowed_counts
from . import query
from .ingest import CODES, IN_ORDER, ORDERS, _parts, _titled, canonical_sql
from .retrieval import BATCH, CHUNKS, COS, DOCS, TERMS, WORDS, _fused_batch, _lanes, _occ, _similarities, _vector_lane, _vectors, docs, lanes_sql


@query(f"""with {BATCH}, sim as (select v.label::bigint lb, q.vec_id qid, v.vec_id doc_id, round({COS}, 6) sim from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.vec_id % 3 <> 0),
j as (select f.qid, f.doc_id, coalesce(s.sim, -1.0) sim, f.score from f8 f left join sim s on s.qid = f.qid and s.doc_id = f.doc_id where f.rank <= 20)
select qid, doc_id, sim, row_number() over (partition by qid order by sim desc, score desc, doc_id) rank from j qualify rank <= 12""")
def rerank_presort(t):
    pool = _fused_batch(t, 20)
    sims = _similarities(t, pool.where("doc_id % 3 <> 0").select("qid", "doc_id"))
    return selection.presort(pool, sims, 12).select("qid", "doc_id", "sim", "rank")


@query(f"""with {BATCH}, c as (select qid, doc_id, rank from f8 where rank <= 10), o as (select qid, doc_id, min((doc_id * 7 + qid) % 13) place from c where doc_id % 2 = 0 group by 1, 2)
select c.qid, c.doc_id, row_number() over (partition by c.qid order by o.place nulls last, c.rank) rank from c left join o on o.qid = c.qid and o.doc_id = c.doc_id""")
def order_merge(t):
    c = _fused_batch(t, 10).select("qid", "doc_id", "rank")
    return selection.merge_order(c, c.where("doc_id % 2 = 0").select("qid", "doc_id", F.pmod(F.col("doc_id") * 7 + F.col("qid"), F.lit(13)).alias("place")))


@query(f"""with {lanes_sql()}, p as (select f.doc_id, f.rank, contains(lower(title), 'the')::int + contains(lower(title), 'and')::int cov, issue_date from fused f join docs using (doc_id) where f.rank <= 20),
h as (select *, row_number() over (partition by cov >= 1 order by issue_date desc, rank) k from p), m as (select *, cov >= 1 and k <= 4 head from h)
select 0::bigint qid, doc_id, row_number() over (order by head desc, case when head then k end, rank) rank from m""")
def coverage_keep(t):
    pool = fusion.rrf(_lanes(t), limit=20).join(docs(t).select("doc_id", "title", "issue_date"), "doc_id")
    return selection.promote(pool, tx.coverage(F.lower("title"), ["the", "and"]) >= 1, 4, [F.desc("issue_date")]).select("qid", "doc_id", "rank")


@query(f"""with {DOCS}, m as (select doc_id, contains(strip_accents(lower(title)), 'tion')::int + contains(strip_accents(lower(title)), 'the')::int overlap from docs where month(issue_date) = 3 and year(issue_date) = 2024 and doc_id % 5 <> 0)
select doc_id, overlap::bigint overlap, row_number() over (order by overlap desc, doc_id) rank from m where overlap > 0 qualify rank <= 20""")
def enumeration_augment(t):
    return selection.enumerate_documents(docs(t), F.lit(3), F.lit(2024), ["tion", "the"], docs(t).where("doc_id % 5 = 0").select("doc_id"), 20)


@query(f"""with {lanes_sql()}, {CHUNKS}, rd as (select doc_id, rank from fused where rank <= 12), bare as (select * from rd where doc_id % 3 <> 0 order by rank limit 5),
s as (select c.doc_id, chunk_index, {_occ('lower(c.text)')} score from chunks c join bare using (doc_id)) select doc_id, chunk_index, score::bigint score from s qualify row_number() over (partition by doc_id order by score desc, chunk_index) = 1""")
def citation_floor(t):
    read = fusion.rrf(_lanes(t), limit=12).select("doc_id", "rank")
    chunks = chunk_windows(t("documents").join(read, "doc_id", "left_semi"))
    return selection.citation_floor(read, read.where("doc_id % 3 = 0"), chunks, tx.total_occurrences(F.lower("text"), TERMS), 5)


@query(f"""with {ORDERS}, tt as (select case when doc_id % 200 = 8 and doc_id < 100 then 'Special ' || title else title end title from titled),
n as (select count(*) n, sum(contains(lower(title), 'special')::int) da, sum(contains(lower(title), 'decreto')::int) dd from tt),
r as (select title, unnest(regexp_extract_all(title, '[0-9]+/[0-9]+')) ref from tt), w as (select ref, right(lower(split_part(title, ref, 1)), 90) near from r),
s as (select ref, round(max(case when contains(near, 'special') then ln(1 + n / da) else 0 end + case when contains(near, 'decreto') then ln(1 + n / dd) else 0 end), 6) score from w, n group by 1)
select ref, score from s where score > 0 and score = (select max(score) from s) qualify count(*) over () = 1""")
def principal_inference(t):
    marked = F.when((F.col("doc_id") % 200 == 8) & (F.col("doc_id") < 100), F.concat(F.lit("Special "), "title")).otherwise(F.col("title"))
    return selection.principal_reference(_titled(t).select(marked.alias("title")), ["special", "decreto"], "[0-9]+/[0-9]+")


@query(f"with {CHUNKS}, s as (select doc_id, chunk_index, len(regexp_extract_all(text, '[0-9]+|%')) score from chunks), b as (select * from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, chunk_index) = 1) select doc_id, chunk_index, score from b order by score desc, doc_id limit 2")
def numeric_density(t):
    return density_evidence(chunk_windows(t("documents")), r"[0-9]+|%").select("doc_id", "chunk_index", "score")


@query(f"""with {CHUNKS}, e as (select doc_id, chunk_index, contains(lower(text), 'of the')::int phrases, contains(lower(text), 'with')::int + contains(lower(text), 'from')::int entities, {' + '.join(f"contains(lower(text), '{w}')::int" for w in TERMS)} terms, {_occ('lower(text)')} hits from chunks)
select doc_id, chunk_index, phrases::bigint phrases, entities::bigint entities, terms::bigint terms, hits::bigint hits from e order by phrases desc, entities desc, terms desc, hits desc, doc_id, chunk_index limit 8""")
def evidence_ranking(t):
    return coverage_ranking(chunk_windows(t("documents")), ["of the"], ["with", "from"], TERMS).select("doc_id", "chunk_index", "phrases", "entities", "terms", "hits")


_SAYS = "text || ' ' || turn || ',50'"


@query(f"""with c as (select conv_id, turn, {canonical_sql(_SAYS)} x, {canonical_sql(f"text || case when turn % 2 = 0 then ' ' || turn || ',50' else '' end")} src from conversations)
select conv_id, turn::bigint turn, unnest(list_filter({IN_ORDER}, lambda v: not list_contains(src, v))) claim from c""")
def unsupported_claims(t):
    extra = F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(",50"))
    claims = unsupported_numbers(F.concat("text", extra), F.concat("text", F.when(F.col("turn") % 2 == 0, extra).otherwise("")))
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(claims).alias("claim"))


@query(f"""with {CODES}, a as (select doc_id, title, doc_id // 10 g from parts) select x.doc_id a, y.doc_id b from a x join a y on x.g = y.g and x.doc_id < y.doc_id
where not (len(regexp_extract_all(lower(x.title), '[a-z]+/[0-9]+/[0-9]+')) > 0 and regexp_extract(lower(x.title), '[a-z]+/[0-9]+/[0-9]+') <> regexp_extract(lower(y.title), '[a-z]+/[0-9]+/[0-9]+'))""")
def title_vetoes(t):
    p = _parts(t).select("doc_id", "title", F.floor(F.col("doc_id") / 10).alias("g"))
    q = p.toDF("b", "tb", "g")
    return p.join(q, "g").where("doc_id < b").where(~veto(F.col("title"), F.col("tb"), ["corrige", "convoca"], "[a-z]+/[0-9]+/[0-9]+")).select(F.col("doc_id").alias("a"), "b")


@query(rf"""with {DOCS}, s as (select doc_id, title, lang, source, array_to_string(({WORDS})[1:120], ' ') s from docs), c as (select *, case when length(s) <= 1200 then s else regexp_replace(substring(s, 1, 1200), '\s+\S*$', '') end short from s)
select doc_id, md5(concat_ws(chr(10), {', '.join(f"case when length({c}) > 0 then '{n}: ' || {c} end" for n, c in (('title', 'title'), ('language', 'lang'), ('kind', 'source'), ('summary', 'short')))})) digest from c""")
def embedding_text_build(t):
    return docs(t).select("doc_id", F.md5(embedding_text(F.col("title"), F.col("lang"), F.col("source"), F.col("text")).cast("binary")).alias("digest"))


@query("select vec_id, list_transform(embedding, lambda x: round(x::double, 6)) literal from embeddings")
def vector_literals(t):
    return t("embeddings").select("vec_id", quantised("embedding").alias("literal"))


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(strip_accents(lower(split_part(text, chr(10), 1))), '[\p{L}\p{N}_·''/-]+')) lexeme, 2.0::double w from documents union all select doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_·''/-]+')), 1.0 from documents)
select doc_id, round(sum(w), 4) weight, count(*) n from t where lexeme in ('the', 'with') group by 1""")
def weighted_postings(t):
    d = docs(t)
    both = postings(d, "title", 2.0).unionByName(postings(d, "text", 1.0, offset=1000))
    return both.where(F.col("lexeme").isin("the", "with")).groupBy("doc_id").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("n"))


@query(r"""with p as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[?;.]'), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda x: length(x) >= 6 and contains(x, ' ')) parts from conversations)
select conv_id, turn::bigint turn, case when len(parts) >= 2 then len(parts) else 0 end n from p""")
def facet_split(t):
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.size(tx.sentence_parts("text")).cast("long").alias("n"))


MARKERS = {"fr": ["le", "et", "les"], "en": ["the", "of", "and"], "de": ["der", "und", "die"], "es": ["el", "los", "que"]}
_SCORES = {k: " + ".join(f"list_contains(t, '{w}')::int" for w in v) for k, v in MARKERS.items()}


@query(rf"""with t as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_·''/-]+') t from documents), s as (select doc_id, {', '.join(f'{v} {k}' for k, v in _SCORES.items())} from t)
select doc_id, case when greatest(fr, en, de, es) = 0 then 'es' when fr = greatest(fr, en, de, es) then 'fr' when en = greatest(fr, en, de, es) then 'en' when de = greatest(fr, en, de, es) then 'de' else 'es' end lang from s""")
def language_guess(t):
    return t("documents").select("doc_id", tx.guess_language(F.col("text"), MARKERS, "es").alias("lang"))


@query("select doc_id, len(regexp_extract_all(text, '%')) + 3 * len(regexp_extract_all(text, '[$]')) + (len(regexp_extract_all(text, '(?m)^\\s*(?:[-*•]|[0-9]+[.)]|[a-z]\\))\\s')) >= 3 or len(regexp_extract_all(text, ';')) >= 5)::int richness from documents")
def richness(t):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return t("documents").select("doc_id", (n("%") + 3 * n("[$]") + tx.list_like(F.col("text")).cast("int")).cast("long").alias("richness"))


@query("""with s as (select source, count(*) attempts, max(ts) last from (select event_type source, ts from events where value > 90) group by 1)
select source, attempts, last, last + to_minutes(cast(60 * pow(2, least(attempts, 5) - 1) as integer)) next_retry from s""")
def retry_backoff(t):
    return retry_state(t("events").where("value > 90").select(F.col("event_type").alias("source"), "ts"))


@query("select event_id, event_type from events where value < 5 and (event_id % 3 = 0 or ts <= timestamp '2024-01-15') order by coalesce(case when event_id % 3 <> 0 then ts end, timestamp '1970-01-01'), event_id limit 30")
def due_rows(t):
    state = t("events").where("value < 5").select(F.col("event_id").alias("id"), "event_type", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("next_retry"), F.lit(False).alias("resolved"))
    return etl.due(state, F.lit("2024-01-15").cast("timestamp"), 30).select(F.col("id").alias("event_id"), "event_type")


@query("select time_bucket(interval 1 day, ts) \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_windows(t):
    return windowed_counts(t("events"), "ts", "1 day", "1 day", "event_type").withColumn("total", F.round("total", 4))


@query("""with x as (select l.doc_id, [l.doc_id % 5, l.doc_id % 11] cited, [[l.doc_id % 5, 1], [l.doc_id % 11, 7]] gold from labels l)
select doc_id, len(list_intersect(cited, flatten(gold))) > 0 any_hit, len(list_intersect(cited, gold[1])) > 0 and len(list_intersect(cited, gold[2])) > 0 all_hit from x""")
def gold_group_hits(t):
    m = lambda n: F.pmod("doc_id", F.lit(n))
    cited, gold = F.array(m(5), m(11)), F.array(F.array(m(5), F.lit(1).cast("long")), F.array(m(11), F.lit(7).cast("long")))
    return t("labels").select("doc_id", F.arrays_overlap(cited, F.flatten(gold)).alias("any_hit"), F.forall(gold, lambda g: F.arrays_overlap(g, cited)).alias("all_hit"))


@query(f"""with {BATCH}, g as (select qid, unnest([qid, qid + 10, qid + 20]) doc_id from (select distinct qid from f8)), x as (select g.qid, count(f.rank) pool, count(case when f.rank <= 10 then 1 end) rd, count(*) n from g left join f8 f on f.qid = g.qid and f.doc_id = g.doc_id and f.rank <= 40 group by 1),
k as (select unnest(['ALL', 'half:' || (qid % 2)]) "group", * from x) select "group", count(*) n, round(avg((pool > 0)::int), 6) pool_any, round(avg((pool = n)::int), 6) pool_full, round(avg((rd > 0)::int), 6) read_any, round(avg((rd = n)::int), 6) read_full from k group by 1""")
def pipeline_recall(t):
    pool = _fused_batch(t, 40)
    ids = lambda n: pool.where(F.col("rank") <= n).groupBy("qid").agg(F.collect_set("doc_id").alias(f"s{n}"))
    gold = F.array(F.col("qid"), F.col("qid") + 10, F.col("qid") + 20)
    x = ids(40).join(ids(10), "qid")
    has = lambda c: (F.arrays_overlap(gold, c).cast("int"), (F.size(F.array_except(gold, c)) == 0).cast("int"))
    (pa, pf), (ra, rf) = has(F.col("s40")), has(F.col("s10"))
    rows = x.select(F.explode(evalmetrics.groups(("half", F.col("qid") % 2))).alias("group"), pa.alias("a"), pf.alias("b"), ra.alias("c"), rf.alias("d"))
    avg = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("group").agg(F.count("*").alias("n"), avg("a").alias("pool_any"), avg("b").alias("pool_full"), avg("c").alias("read_any"), avg("d").alias("read_full"))


@query(f"""with {BATCH}, r as (select qid, doc_id, r from ra where r <= 100), j as (select r.qid, r.doc_id, r.r lane, f.rank fused from r left join f8 f on f.qid = r.qid and f.doc_id = r.doc_id and f.rank <= 20 where r.doc_id % 50 = r.qid % 50) select qid, min(lane) lane, min(fused) fused from j group by 1""")
def gold_rank_by_stage(t):
    every = _vector_lane(t)
    lane = every.where("doc_id % 50 = qid % 50").select("qid", "doc_id", F.col("rank").alias("lane"))
    fused = _fused_batch(t, 20, every).select("qid", "doc_id", F.col("rank").alias("fused"))
    return lane.join(fused, ["qid", "doc_id"], "left").groupBy("qid").agg(F.min("lane").alias("lane"), F.min("fused").alias("fused"))


@query("""with m as (select doc_id, map_concat(map {'even': doc_id % 2 = 0, coalesce(lang, 'none'): true}, case when doc_id % 2 = 0 then map {'even': lang = 'en', 'seen': true} else map {'en': false} end) m from documents)
select doc_id, array_to_string(list_sort(list_transform(map_entries(m), lambda e: e.key || '=' || e.value)), ',') tags from m""")
def tag_merge(t):
    even = F.col("doc_id") % 2 == 0
    old = F.create_map(F.lit("even"), even, F.coalesce("lang", F.lit("none")), F.lit(True))
    new = F.when(even, F.create_map(F.lit("even"), F.col("lang") == "en", F.lit("seen"), F.lit(True))).otherwise(F.create_map(F.lit("en"), F.lit(False)))
    tags = F.transform(F.map_entries(etl.merge_tags(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return t("documents").select("doc_id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("""with r as (select s_suppkey k, 'S/' || (s_suppkey % 60) sig from supplier), x as (select distinct 'S/' || (c_custkey % 90) sig from customer) select x.sig from x where not exists (select 1 from r where r.sig = x.sig)""")
def missing_signatures(t):
    sig = lambda k, n: F.concat(F.lit("S/"), F.pmod(k, F.lit(n)).cast("string")).alias("sig")
    return t("customer").select(sig("c_custkey", 90)).distinct().join(t("supplier").select(sig("s_suppkey", 60)), "sig", "left_anti")


@query(f"with {DOCS} select doc_id, case when length(title) <= 40 then title else regexp_replace(substring(title, 1, 40), '\\s+\\S*$', '') || '…' end short from docs")
def snippet_shorten(t):
    return docs(t).select("doc_id", tx.shorten(F.col("title"), 40).alias("short"))


@query("select conv_id, turn::bigint turn, coalesce(nullif(trim(case when turn % 2 = 0 then text end), ''), role) snippet from conversations")
def snippet_fallback(t):
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), selection.snippet_chain(F.when(F.col("turn") % 2 == 0, F.col("text")), F.col("role")).alias("snippet")).withColumn("snippet", F.trim("snippet"))


@query("select distinct cast(o_orderdate as date) \"day\" from orders where o_orderdate > timestamp '1995-06-01' order by 1 limit 100")
def dates_after_checkpoint(t):
    return t("orders").where(F.col("o_orderdate") > F.lit("1995-06-01").cast("timestamp")).select(F.to_date("o_orderdate").alias("day")).distinct().orderBy("day").limit(100)


@query("select user_id, session::bigint session, count(*) n from (select user_id, sum(gap) over (partition by user_id order by ts, event_id) session from (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hour then 1 else 0 end gap from events)) group by 1, 2")
def sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")).cast("int")
    s = t("events").withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("session", F.sum("gap").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))


# -- evidence rows: quotes cut from the documents' own chunks -------------------------------------------------------------

QUOTES = f"""{CHUNKS}, ev as (select doc_id, chunk_index ord, case chunk_index % 3 when 0 then substring(text, 20, 60) when 1 then substring(text, 5, 20) || ' … ' || substring(text, 100, 20) else 'zz ' || substring(text, 40, 30) end quote from chunks where length(text) > 200)"""


def _quotes(t):
    c = chunk_windows(t("documents"))
    sub = lambda a, n: F.substring("text", a, n)
    quote = F.when(F.col("chunk_index") % 3 == 0, sub(20, 60)).when(F.col("chunk_index") % 3 == 1, F.concat(sub(5, 20), F.lit(" … "), sub(100, 20))).otherwise(F.concat(F.lit("zz "), sub(40, 30)))
    return c, c.where(F.length("text") > 200).select("doc_id", F.col("chunk_index").alias("ord"), quote.alias("quote"))


@query(f"""with {QUOTES}, pr as (select e.doc_id, e.ord, e.quote, c.chunk_index, lower(c.text) low, list_filter(list_transform(string_split(lower(e.quote), '…'), lambda x: trim(regexp_replace(x, '[ ]+', ' ', 'g'))), lambda x: x <> '') parts, list_distinct(string_split(lower(trim(regexp_replace(e.quote, '[ ]+', ' ', 'g'))), ' ')) w from ev e join chunks c using (doc_id)),
g as (select doc_id, ord, chunk_index, case when contains(low, lower(quote)) then 2 when len(parts) > 1 and len(list_filter(parts, lambda x: contains(low, x))) = len(parts) then 1 else 0 end grade, len(list_filter(w, lambda x: contains(low, x))) common from pr)
select doc_id, ord, ['nearest', 'stitched', 'verbatim'][grade + 1] status, chunk_index from g qualify row_number() over (partition by doc_id, ord order by grade desc, common desc, chunk_index) = 1""")
def quote_regrounding(t):
    chunks, quotes = _quotes(t)
    return evid.reground(quotes, chunks)


@query(f"""with {QUOTES}, k as (select doc_id, ord, lower(trim(regexp_replace(quote, '[ ]+', ' ', 'g'))) key from ev) select doc_id, ord from k where key <> '' qualify row_number() over (partition by doc_id, key order by ord) = 1""")
def evidence_dedupe(t):
    _, quotes = _quotes(t)
    return evid.dedupe(quotes).select("doc_id", "ord")


@query(f"with {CHUNKS}, h as (select doc_id, chunk_index, regexp_matches(text, '[0-9]') hit from chunks), nm as (select *, row_number() over (partition by doc_id order by hit desc, chunk_index) n from h) select doc_id, chunk_index, hit from nm where (hit and n <= 6) or n = 1")
def chunk_facts(t):
    return evid.facts(chunk_windows(t("documents")), "[0-9]")


@query(f"""with {BATCH}, c as (select qid, doc_id, rank, doc_id % 7 v from f8 where rank <= 20 and not (rank <= 5)) select qid, doc_id, row_number() over (partition by qid order by v desc, rank) rank from c where v > 0 qualify rank <= 3""".replace("qualify rank <= 3", "qualify row_number() over (partition by qid order by v desc, rank) <= 3"))
def coverage_extras(t):
    pool = _fused_batch(t, 20)
    return evid.extras(pool, pool.where("rank <= 5"), F.pmod("doc_id", F.lit(7)), 3)


@query("""with v as (select conv_id, turn, length(trim(text)) = 0 as empty, turn % 4 = 0 as uncited, turn % 4 > 2 as out_of_scope, turn % 2 = 1 and regexp_matches(text, '[0-9]') unsupported from conversations)
select conv_id, turn::bigint turn, empty, uncited, out_of_scope, unsupported, not (empty or uncited or out_of_scope or unsupported) valid from v""")
def answer_validation(t):
    """Odd turns are held against a source without the text's numbers, even ones against the text itself."""
    turn = F.pmod("turn", F.lit(4))
    cited = F.when(turn == 0, F.array().cast("array<long>")).otherwise(F.array(turn))
    source = F.when(F.col("turn") % 2 == 1, F.regexp_replace("text", "[0-9]", "")).otherwise(F.col("text"))
    v = evid.validation(F.col("text"), cited, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), source)
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), v.alias("v")).select("conv_id", "turn", "v.*")


@query("select conv_id, 'Sources:' || array_to_string(list_transform((list(substring(text, 1, 300) order by turn))[1:3], lambda x: chr(10) || '- ' || x), '') summary from conversations group by 1")
def fallback_summaries(t):
    titles = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.substring("text", 1, 300).alias("s")))), lambda x: x["s"])
    return t("conversations").groupBy("conv_id").agg(titles.alias("titles")).select("conv_id", evid.fallback_summary(F.col("titles"), 3, "Sources:").alias("summary"))


@query("select doc_id, (quality = 0 and toxic = 1) or (doc_id % 3 = 0 and not doc_id % 2 = 0) or not doc_id % 5 <> 0 review from labels")
def regression_flags(t):
    d = F.col("doc_id")
    return t("labels").select("doc_id", evid.needs_review((F.col("quality") == 0) & (F.col("toxic") == 1), d % 3 == 0, d % 2 == 0, d % 5 != 0).alias("review"))


@query("select label::bigint as \"class\", count(*) n, round(avg((vec_id % 4 = 0)::int), 6) hit_rate, count(*) filter (where vec_id % 4 <> 0 and vec_id % 6 = 0) regressions from embeddings group by 1")
def probe_hit_rates(t):
    hit, was = F.col("vec_id") % 4 == 0, F.col("vec_id") % 6 == 0
    return t("embeddings").groupBy(F.col("label").cast("long").alias("class")).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"), F.count_if(~hit & was).alias("regressions"))


@query("select page_id, url, pdf from (select page_id, nullif(url, case when page_id % 3 = 0 then url end) url, case when page_id % 2 = 0 then 'files/' || page_id || '.pdf' end pdf from pages) where url is not null or pdf is not null")
def asset_scan(t):
    """Of every page; some have neither address."""
    id_ = F.col("page_id")
    rows = t("pages").select("page_id", F.when(id_ % 3 != 0, F.col("url")).alias("url"), F.when(id_ % 2 == 0, F.concat(F.lit("files/"), id_.cast("string"), F.lit(".pdf"))).alias("pdf"))
    return rows.where("url is not null or pdf is not null")
