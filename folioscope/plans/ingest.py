"""Ingest: reconciliation, upserts, retention, gaps, extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import clean_control, first_line, numbers, strip_artifacts
from ..operators import corpus, etl, intervals
from ..operators.graph import companions
from . import query


def html_sql(rest: str) -> str:
    """DuckDB: the text of each page as w, followed by ``rest``."""
    return r"""with s as (select page_id, regexp_replace(html, '(?is)<(script|style|noscript|header|footer|nav|aside|svg)\b.*?</(script|style|noscript|header|footer|nav|aside|svg)\s*>', chr(10), 'g') h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') h from s),
e as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') h from b),
x as (select page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: length(x) >= 3), chr(10)) tx from e), w as (""" + rest


@query(html_sql("select * from x) select page_id, md5(tx) digest from w"))
def html_to_text(t):
    return t("pages").select("page_id", F.md5(corpus.html_text(F.col("html")).cast("binary")).alias("digest"))


@query(html_sql("""select page_id, 'plan AB/2024/' || page_id || ' decreto ' || (page_id % 7 + 1) || '/2024 ' || tx tx from x), n as (select page_id, tx, len(list_filter(string_split(trim(regexp_replace(regexp_replace(tx, '\\p{Cc}', ' ', 'g'), '[ ]+', ' ', 'g')), ' '), lambda v: v <> '')) n from w),
m as (select *, case when n <= 500 then 1 else 1 + ceil((n - 500) / 420.0) end::bigint many from n) select page_id, case when page_id % 2 = 0 then 'Convocatorias' else 'Otros' end label, length(tx)::bigint n_chars, case when n = 0 then 0 when many > 1 and n - 420 * (many - 1) < 300 then many - 1 else many end::bigint n_chunks, 'ab/2024/' || page_id code, case when page_id >= 7 then (select min(p.page_id) from pages p where p.page_id = m.page_id % 7) end cites from m"""))
def ingest_order(t):
    """From pages to chunks and identifiers in the order of the ingest: text, label, chunks, references, identifiers. A page is a decree and cites another."""
    raw = F.when(F.col("page_id") % 2 == 0, " Convocatoria").otherwise("x")
    pages = t("pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("Decreto "), (F.col("page_id") + 1).cast("string"), F.lit("/2024")).alias("title"), F.concat(F.lit("plan AB/2024/"), F.col("page_id").cast("string"), F.lit(" decreto "), (F.col("page_id") % 7 + 1).cast("string"), F.lit("/2024 "), corpus.html_text(F.col("html"))).alias("text"), raw.alias("raw"))
    documents, chunks, edges, ids = corpus.ingested(pages, {"convocatoria": "Convocatorias"}, "Otros")
    many = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    first = ids.where("id_key like 'ab/2024/%'").groupBy("doc_id").agg(F.min("id_key").alias("code"))
    cited = edges.where("target is not null").groupBy("doc_id").agg(F.min("target").alias("cites"))
    rows = documents.join(many, "doc_id", "left").join(first, "doc_id", "left").join(cited, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("page_id"), "label", "cites", F.length("text").cast("long").alias("n_chars"), F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), "code")


@query()
def html_tree_to_text(t):
    return corpus.html_tree_text(t("pages"))


@query(r"""with x as (select doc_id, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) h, case when doc_id % 3 = 0 then 0 else length(trim(regexp_replace(substring(text, 1, cast(length(text) * (doc_id % 5) / 2 as integer)), '[ \t\n\r\f\v]+', ' ', 'g'))) end p from documents)
select doc_id, case when h > 200 and (p = 0 or h >= p * 0.6) then 'html' when p > 200 then 'pdf' when h > 0 then 'html' when p > 0 then 'pdf' end source from x""")
def source_choice(t):
    part = F.expr("substring(text, 1, cast(round(length(text) * (doc_id % 5) / 2) as int))")
    pdf = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(part)
    return t("documents").select("doc_id", corpus.source_choice(F.col("text"), pdf).alias("source"))


def _snapshots(t):
    d = t("documents").select("doc_id", F.concat_ws("|", "lang", F.pmod("doc_id", F.lit(97)).cast("string")).alias("key"))
    old = d.where("doc_id % 7 <> 0").select("key", "doc_id", F.concat("key", F.pmod("doc_id", F.lit(5)).cast("string")).alias("body"))
    new = d.where("doc_id % 5 <> 0").select("key", "doc_id", F.concat("key", F.pmod(F.col("doc_id") + (F.col("doc_id") % 11 == 0).cast("int"), F.lit(5)).cast("string")).alias("body"))
    return old, new


@query("""with d as (select doc_id, lang || '|' || (doc_id % 97) k from documents),
o as (select k, doc_id, k || (doc_id % 5) body, row_number() over (partition by k order by doc_id) n from d where doc_id % 7 <> 0),
w as (select k, doc_id, k || ((doc_id + (doc_id % 11 = 0)::int) % 5) body, row_number() over (partition by k order by doc_id) n from d where doc_id % 5 <> 0)
select case when o.k is null then 'insert' when w.k is null then case when o.doc_id % 13 = 0 then 'unchanged' else 'remove' end when o.body = w.body then 'unchanged' else 'update' end status, count(*) n from o full join w on o.k = w.k and o.n = w.n group by 1""")
def doc_reconcile(t):
    old, new = _snapshots(t)
    return etl.reconcile(old, new, ["key"], "body", "doc_id", keep_removed=F.col("doc_id") % 13 == 0).groupBy("status").agg(F.count("*").alias("n"))


@query("""with d as (select doc_id, lang || '|' || (doc_id % 97) k from documents),
o as (select k, doc_id, k || (doc_id % 5) body, row_number() over (partition by k order by doc_id) n from d where doc_id % 7 <> 0),
w as (select k, doc_id, k || ((doc_id + (doc_id % 11 = 0)::int) % 5) body, row_number() over (partition by k order by doc_id) n from d where doc_id % 5 <> 0),
gone as (select o.k, o.n from o left join w on o.k = w.k and o.n = w.n where case when w.k is null then o.doc_id % 13 <> 0 else o.body <> w.body end)
select o.k as key, o.n, c.chunk from o, (select unnest([0, 1]) chunk) c where not exists (select 1 from gone g where g.k = o.k and g.n = o.n)""")
def derived_after_reconcile(t):
    """Two chunks of every old row; those of rows that changed or went are dropped."""
    old, new = _snapshots(t)
    statuses = etl.reconcile(old, new, ["key"], "body", "doc_id", keep_removed=F.col("doc_id") % 13 == 0)
    numbered = old.select("key", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")).cast("long").alias("n"))
    chunks = numbered.withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1))))
    return etl.invalidated(chunks, statuses, ["key", "n"])


@query("""with f as (select cast(ts as date) "day", event_type, count(*) n, max_by(event_id, ts + event_id * interval 1 microsecond) e from events where value > 50 group by 1, 2),
s as (select distinct cast(ts as date) "day", event_type, 2::bigint attempts from events where day(ts) <= 10 and event_type <> 'click')
select coalesce(f."day", s."day") "day", coalesce(f.event_type, s.event_type) event_type, (coalesce(attempts, 0) + coalesce(n, 0))::bigint attempts, f."day" is null resolved from f full join s on f."day" = s."day" and f.event_type = s.event_type""")
def upsert_counter(t):
    e = t("events").withColumn("day", F.to_date("ts"))
    fails = e.where("value > 50").select("day", "event_type", F.col("ts").alias("at"), F.col("event_id").cast("string").alias("error"))
    state = e.where((F.dayofmonth("day") <= 10) & (F.col("event_type") != "click")).select("day", "event_type").distinct().select("day", "event_type", F.lit(2).cast("long").alias("attempts"), F.lit("old").alias("last_error"), F.lit(True).alias("resolved"))
    return etl.upsert_counter(state, fails, ["day", "event_type"]).select("day", "event_type", "attempts", "resolved")


@query("""with base as (select c_custkey k, c_acctbal v from customer where c_custkey % 3 <> 0), new as (select c_custkey k, c_acctbal + 1 v from customer where c_custkey % 2 = 0)
select k, round(v, 2) v from new union all select k, round(v, 2) from base where k not in (select k from new)""")
def keyed_upsert(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return etl.upsert(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", F.col("v") + 1), ["k"]).select("k", F.round("v", 2).alias("v"))


@query("""with base as (select c_custkey k, c_acctbal v from customer where c_custkey % 3 <> 0), new as (select c_custkey k, c_acctbal + 1 v from customer where c_custkey % 2 = 0)
select k, round(v, 2) v from base union all select k, round(v, 2) from new where k not in (select k from base)""")
def insert_if_absent(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return etl.insert_absent(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", F.col("v") + 1), ["k"]).select("k", F.round("v", 2).alias("v"))


@query("""with o as (select o_orderkey, o_orderdate < add_cut and o_orderkey % 50 <> 0 gone from orders, (select max(o_orderdate)::date - interval 24 month add_cut from orders))
select 'orders' "table", count(*) n from o where not gone union all select 'lineitem', count(*) from lineitem l join o on l.l_orderkey = o.o_orderkey where not gone""")
def retention_purge(t):
    o, li = t("orders"), t("lineitem").select("l_orderkey", "l_linenumber")
    cut = o.agg(F.add_months(F.to_date(F.max("o_orderdate")), -24).alias("cut"))
    o = o.select("o_orderkey", "o_orderdate").crossJoin(F.broadcast(cut))
    kept, (lines,) = etl.purge(o, [(li, "l_orderkey")], "o_orderkey", F.col("o_orderdate") < F.col("cut"), F.col("o_orderkey") % 50 == 0)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
    return count(kept, "orders").unionByName(count(lines, "lineitem"))


@query("""with e as (select cast(ts as date) d, event_type, value from events), sp as (select unnest(generate_series(min(d), max(d), interval 1 day))::date d from e), ty as (select distinct event_type from e)
select sp.d "day", ty.event_type from sp, ty where not exists (select 1 from e where e.d = sp.d and e.event_type = ty.event_type and e.value > 97)""")
def gap_scan(t):
    e = t("events").select(F.to_date("ts").alias("day"), "event_type", "value")
    have = e.where("value > 97").select("day", "event_type").distinct()
    return intervals.spine(e, "day", "event_type").join(have, ["day", "event_type"], "left_anti")


@query("""with d as (select o_custkey k, cast(o_orderdate as date) s, cast(o_orderdate as date) + cast(o_orderkey % 9 as integer) e from orders),
m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) r from d), i as (select *, sum(case when r is null or s > r + 1 then 1 else 0 end) over (partition by k order by s, e) g from m)
select k, min(s) "start", max(e) "end" from i group by k, g""")
def interval_coalesce(t):
    day = F.to_date("o_orderdate")
    d = t("orders").select(F.col("o_custkey").alias("k"), day.alias("start"), F.date_add(day, F.pmod("o_orderkey", F.lit(9)).cast("int")).alias("end"))
    return intervals.coalesce_ranges(d, "k")


@query("""with b as (select event_type, min(cast(ts as date)) lo, max(cast(ts as date)) hi from events group by 1), w as (select event_type, lo, hi, lo - 3 s, hi + 5 e from b)
select event_type, s lo, lo - 1 hi from w union all select event_type, hi + 1, e from w""")
def interval_difference(t):
    b = t("events").groupBy("event_type").agg(F.to_date(F.min("ts")).alias("have_min"), F.to_date(F.max("ts")).alias("have_max"))
    return intervals.missing_ranges(b.withColumns({"start": F.date_sub("have_min", 3), "end": F.date_add("have_max", 5)})).select("event_type", "lo", "hi")


# -- identifiers and references: the driver tables hold none, so codes and titles are built from keys on both sides ------

CODES = """parts as (select p_partkey doc_id, 'Call ' || substring(p_brand, 1, 5) || '/' || (2015 + (p_partkey // 5) % 10) || '/' || (p_partkey // 5) || ' for ' || p_type title, 'See brand/' || (2010 + p_partkey % 15) || ' and 2' || (p_partkey % 9) || 'I' || (100 + p_partkey % 90) || '.' "text", date '2024-01-01' + cast(p_partkey % 365 as integer) issue_date from part)"""


def _parts(t):
    k = F.col("p_partkey")
    mod = lambda n: F.pmod(k, F.lit(n)).cast("string")
    five = F.floor(k / 5)
    title = F.concat(F.lit("Call "), F.substring("p_brand", 1, 5), F.lit("/"), (2015 + F.pmod(five, F.lit(10))).cast("string"), F.lit("/"), five.cast("string"), F.lit(" for "), "p_type")
    text = F.concat(F.lit("See brand/"), (2010 + F.pmod(k, F.lit(15))).cast("string"), F.lit(" and 2"), mod(9), F.lit("I"), (100 + F.pmod(k, F.lit(90))).cast("string"), F.lit("."))
    return t("part").select(k.alias("doc_id"), title.alias("title"), text.alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k, F.lit(365)).cast("int")).alias("issue_date"))


IDS = CODES + r""", hit as (select doc_id, 'title' source, 0 rk, unnest(regexp_extract_all(title, '(?i)\b([a-z]{2,10}/(?:19|20)[0-9]{2}/[0-9]{1,6})\b', 1)) raw from parts
union all select doc_id, 'body', 1, unnest(regexp_extract_all("text", '(?i)\b(brand/20[0-9]{2})\b', 1)) from parts union all select doc_id, 'body', 1, unnest(regexp_extract_all("text", '(?i)\b([0-9]{2}i[0-9]{3,4})\b', 1)) from parts),
ids as (select doc_id, 'code' id_kind, lower(raw) id_key, raw, source from hit qualify row_number() over (partition by doc_id, lower(raw) order by rk) = 1)"""


@query(f"with {IDS} select * from ids")
def identifier_extract(t):
    return corpus.identifiers(_parts(t))


@query(f"""with {IDS}, ask as (select distinct id_key qid, id_key from ids), n as (select id_key, count(distinct doc_id) n from ids group by 1)
select a.qid, i.doc_id, row_number() over (partition by a.qid order by p.issue_date desc, i.doc_id) rank from ask a join n on n.id_key = a.id_key and n.n <= 6 join ids i on i.id_key = a.id_key join parts p on p.doc_id = i.doc_id""")
def identifier_pin(t):
    ids = corpus.identifiers(_parts(t))
    ask = ids.select(F.col("id_key").alias("qid"), "id_kind", "id_key").distinct()
    return corpus.identifier_pins(ask, ids, _parts(t))


ORDERS = """titled as (select o_orderkey doc_id, case when o_orderkey % 4 = 0 then 'Decreto ' || (o_orderkey % 999) || '/' || (2000 + o_orderkey % 25) || ', annual plan' else 'Orden ' || (o_orderkey % 1999) || '/' || (2000 + o_orderkey % 25) || ', rules' end title,
case when o_custkey % 3 = 0 then 'This text amends nothing' when o_custkey % 3 = 1 then 'Se modifica el Decreto ' || (o_custkey % 999) || '/' || (2000 + o_custkey % 25) || ' en parte' else 'Vista la Orden ' || (o_custkey % 1999) || '/' || (2000 + o_custkey % 25) || ' citada' end body, o_custkey from orders)"""


def _titled(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda k, n, base=0: (F.pmod(k, F.lit(n)) + base).cast("string")
    title = F.when(o % 4 == 0, F.concat(F.lit("Decreto "), s(o, 999), F.lit("/"), s(o, 25, 2000), F.lit(", annual plan"))).otherwise(F.concat(F.lit("Orden "), s(o, 1999), F.lit("/"), s(o, 25, 2000), F.lit(", rules")))
    body = F.when(c % 3 == 0, "This text amends nothing").when(c % 3 == 1, F.concat(F.lit("Se modifica el Decreto "), s(c, 999), F.lit("/"), s(c, 25, 2000), F.lit(" en parte"))).otherwise(F.concat(F.lit("Vista la Orden "), s(c, 1999), F.lit("/"), s(c, 25, 2000), F.lit(" citada")))
    return t("orders").select(o.alias("doc_id"), title.alias("title"), body.alias("text"))


EDGES = ORDERS + """, ref as (select doc_id, case when o_custkey % 3 = 1 then 'decreto' else 'orden' end ref_type, case when o_custkey % 3 = 1 then o_custkey % 999 else o_custkey % 1999 end number, 2000 + o_custkey % 25 "year", case when o_custkey % 3 = 1 then 'modifica' else 'cita' end ref_kind, title from titled where o_custkey % 3 <> 0),
keep as (select * from ref where not (number || '/' || "year" = regexp_extract(title, '([0-9]+/[0-9]+)', 1) and ref_type = lower(split_part(title, ' ', 1)))),
tgt as (select doc_id target, lower(split_part(title, ' ', 1)) ty, regexp_extract(title, '([0-9]+/[0-9]+)', 1) ny from titled),
edge as (select r.doc_id, r.ref_type, r.number, r."year", r.ref_kind, case when count(distinct case when t.target <> r.doc_id then t.target end) = 1 then min(case when t.target <> r.doc_id then t.target end) end target from keep r left join tgt t on t.ty = r.ref_type and t.ny = r.number || '/' || r."year" group by 1, 2, 3, 4, 5)"""


@query(f"with {EDGES} select doc_id, ref_type, number::bigint number, \"year\"::bigint as \"year\", ref_kind, target from edge")
def reference_graph(t):
    d = _titled(t)
    return corpus.resolve_references(corpus.references(d), d).select("doc_id", "ref_type", "number", "year", "ref_kind", "target")


@query(f"""with {EDGES}, k as (select doc_id src, target dst, ref_kind, count(*) over (partition by target) dg from edge where target is not null and target <> doc_id), g as (select * from k where dg <= 25),
seed as (select o_orderkey qid, o_orderkey doc_id from orders where o_orderkey % 20 = 0),
n as (select qid, dst doc_id, case ref_kind when 'modifica' then 1 when 'cita' then 2 end p from seed join g on seed.doc_id = g.src union all select qid, src, case ref_kind when 'modifica' then 1 when 'cita' then 2 end from seed join g on seed.doc_id = g.dst),
m as (select qid, doc_id, min(p) p from n group by 1, 2), o as (select qid, doc_id, row_number() over (partition by qid order by p, doc_id) rank from m where (qid, doc_id) not in (select qid, doc_id from seed)) select * from o where rank <= 2""")
def companion_expansion(t):
    d = _titled(t)
    edges = corpus.resolve_references(corpus.references(d), d).select(F.col("doc_id").alias("src"), F.col("target").alias("dst"), F.col("ref_kind").alias("kind"))
    seeds = t("orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("qid"), F.col("o_orderkey").alias("doc_id"))
    return companions(edges, seeds, 25, ["modifica", "cita"], 2)


def canonical_sql(text: str, most: int = 38) -> str:
    """DuckDB: the canonical numbers of a text, repeats and all. Its decimals end at 38 digits, so a longer number fails instead of going missing."""
    return rf"""list_transform(regexp_extract_all({text}, '[0-9]+(?:\.[0-9]{{3}})*(?:,[0-9]+)?'), lambda r: regexp_replace(regexp_replace(cast(round(cast(replace(replace(r, '.', ''), ',', '.') as decimal({most},6)), 2) as varchar), '(\.[0-9]*?)0+$', '\1'), '\.$', ''))"""


#: DuckDB: the distinct values of a list x, in order.
IN_ORDER = "list_filter(list_transform(range(1, len(x) + 1), lambda i: case when list_position(x, x[i]) = i then x[i] end), lambda v: v is not null)"


@query(f"select doc_id, {IN_ORDER} n from (select doc_id, {canonical_sql('text')} x from documents)")
def number_claims(t):
    return t("documents").select("doc_id", numbers("text").alias("n"))


@query(r"""select conv_id, turn::bigint turn, md5(trim(regexp_replace(regexp_replace(text, '\p{Cc}', ' ', 'g'), '[ ]+', ' ', 'g'))) digest from conversations""")
def control_cleanup(t):
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5(clean_control("text").cast("binary")).alias("digest"))


@query("select doc_id, sha1(json_object('lang', lang, 'n_chars', n_chars, 'source', case when doc_id % 3 <> 0 then source end)::varchar) signature, split_part(text, chr(10), 1) title from documents")
def raw_signature(t):
    signature = etl.canonical_signature(source=F.when(F.col("doc_id") % 3 != 0, F.col("source")), n_chars=F.col("n_chars"), lang=F.col("lang"))
    return t("documents").select("doc_id", signature.alias("signature"), first_line("text").alias("title"))


@query("""with n as (select event_id new_id, user_id, cast(ts as date) d, event_type e from events where event_id % 2 = 0), o as (select event_id old_id, user_id, cast(ts as date) od, event_type oe from events where event_id % 2 <> 0),
p as (select new_id, old_id, case when d = od and e = oe then 0 when e = oe then 1 when d = od then 2 end r from n join o using (user_id)), b as (select * from p where r is not null qualify row_number() over (partition by new_id order by r, old_id) = 1)
select n.new_id, b.old_id, b.r::bigint "rule" from n left join b using (new_id)""")
def issue_match(t):
    """Every event is on one of the two sides."""
    e = t("events").select("event_id", "user_id", F.to_date("ts").alias("d"), F.col("event_type").alias("e"))
    new, old = e.where("event_id % 2 = 0").withColumnRenamed("event_id", "new_id"), e.where("event_id % 2 <> 0").toDF("old_id", "ou", "od", "oe")
    same_day, same_type = F.col("d") == F.col("od"), F.col("e") == F.col("oe")
    return etl.best_match(new, old, [same_day & same_type, same_type, same_day], "new_id", "old_id", F.col("user_id") == F.col("ou"), ["old_id"])


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text || ' [doc_12] (doc 3, doc 4)', '[ \t\n\r\f\v]*[\[(][ \t\n\r\f\v]*doc[_ ]?[0-9]+(?:[ \t\n\r\f\v]*,[ \t\n\r\f\v]*doc[_ ]?[0-9]+)*[ \t\n\r\f\v]*[\])]', '', 'gi'), '[ \t\n\r\f\v]+([.,;:])', '\1', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) cleaned from documents""")
def artifact_stripping(t):
    return t("documents").select("doc_id", strip_artifacts(F.concat(F.col("text"), F.lit(" [doc_12] (doc 3, doc 4)"))).alias("cleaned"))
