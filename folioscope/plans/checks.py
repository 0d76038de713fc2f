"""Evidence for answers, checks of answers, and the resolution of references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import canonical_label
from ..operators import corpus
from ..operators import evidence as evid
from ..operators.corpus import chunk_windows
from ..operators.references import MONTHS
from . import query
from .ingest import IN_ORDER, ORDERS, _titled, canonical_sql
from .retrieval import CHUNKS, DOCS

#: Four questions read twelve documents each; a document's subkind is its id's.
READ = f"{DOCS}, rd as (select qid, doc_id, subkind, row_number() over (partition by qid order by k desc, doc_id) r from (select q.qid, doc_id, (doc_id * 37 + q.qid * 11) % 101 k, case doc_id % 3 when 0 then ' Convocatoria' when 1 then 'bases' else 'otros' end subkind from docs, (select unnest(range(0, 4)) qid) q) qualify row_number() over (partition by qid order by k desc, doc_id) <= 12)"


def _read(t):
    q = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("qid")
    kind = F.when(F.col("doc_id") % 3 == 0, " Convocatoria").when(F.col("doc_id") % 3 == 1, "bases").otherwise("otros")
    rows = t("documents").select("doc_id", q).withColumn("k", F.expr("(doc_id * 37 + qid * 11) % 101"))
    w = Window.partitionBy("qid").orderBy(F.desc("k"), "doc_id")
    return rows.select("qid", "doc_id", kind.alias("subkind"), F.row_number().over(w).cast("long").alias("rank")).where("rank <= 12")


def _chunks(t, read):
    return chunk_windows(t("documents").join(read.select("doc_id").distinct(), "doc_id", "left_semi"))


_CUE, _TERM = "(?i)(?:the|les|der|que) ", "(?i) (?:with|from|este|dans|eine)"


@query(rf"""with {CHUNKS}, {READ}, s as (select rd.qid, rd.doc_id, chunk_index, text, (select count(*) from rd x where x.qid = rd.qid) n, r from rd join chunks c using (doc_id) where trim(lower(subkind)) in ('convocatoria', 'bases') and regexp_matches(c.text, '{_CUE}') and regexp_matches(c.text, '{evid.AMOUNT}')),
k as (select *, (n - r + 1) * 100 + len(regexp_extract_all(text, '{_CUE}')) + (contains(text, '€') or contains(lower(text), 'euro'))::int score from s), o as (select * from k qualify row_number() over (partition by qid, doc_id order by score desc, chunk_index) = 1)
select qid, doc_id, chunk_index, score::bigint score, md5(substring(trim(text), 1, 800)) digest from o qualify row_number() over (partition by qid order by score desc, doc_id) <= 2""")
def program_totals(t):
    read = _read(t)
    out = evid.program_totals(read, _chunks(t, read), ["convocatoria", "bases"], _CUE)
    return out.select("qid", "doc_id", "chunk_index", "score", F.md5(F.col("quote").cast("binary")).alias("digest"))


@query(rf"""with {CHUNKS}, {READ}, k as (select rd.qid, rd.doc_id, chunk_index, c.text, len(regexp_extract_all(c.text, '{_TERM}')) score from rd join chunks c using (doc_id)), o as (select * from k where score > 0 qualify row_number() over (partition by qid, doc_id order by score desc, chunk_index) = 1)
select qid, doc_id, chunk_index, score::bigint score, md5(substring(trim(text), 1, 800)) digest from o qualify row_number() over (partition by qid order by score desc, doc_id) <= 3""")
def eligibility_terms(t):
    read = _read(t)
    rows = read.select("qid", "doc_id").join(_chunks(t, read), "doc_id")
    out = evid.best_for_questions(rows, F.regexp_count("text", F.lit(_TERM)).cast("long"), 3)
    return out.select("qid", "doc_id", "chunk_index", "score", F.md5(F.col("quote").cast("binary")).alias("digest"))


_PHRASES, _ENTITIES, _TERMS = ["of the", "de la"], ["tion the"], ["with", "from", "ment"]


def _keys(c: str) -> str:
    cover = lambda ws: " + ".join(f"contains(lower({c}), '{w}')::int" for w in ws)
    hits = " + ".join(f"((length(lower({c})) - length(replace(lower({c}), '{w}', ''))) // {len(w)})" for w in _TERMS)
    return f"{{'p': {cover(_PHRASES)}, 'e': {cover(_ENTITIES)}, 't': {cover(_TERMS)}, 'h': {hits}}}"


@query(f"""with {CHUNKS}, {READ}, ev as (select qid, r ord, doc_id, substring(c.text, 1, 90) quote, r % 4 = 0 pinned from rd join chunks c using (doc_id) where chunk_index = 0 and r % 2 = 0),
b as (select rd.qid, rd.doc_id, substring(c.text, 1, 800) chunk, {_keys('c.text')} own from rd join chunks c using (doc_id) qualify row_number() over (partition by rd.qid, rd.doc_id order by {_keys('c.text')} desc, chunk_index) = 1),
e1 as (select ev.qid, ev.doc_id, quote, pinned, ord, {_keys('quote')} k, own from ev left join b using (qid, doc_id)), e2 as (select qid, doc_id, quote, pinned, ord, case when k.p = 0 and k.e = 0 and k.t = 0 then coalesce(own, k) else k end k from e1),
x as (select * from b where (own.p > 0 or own.e > 0 or own.t > 0) and own.e > 0 and (own.p > 0 or own.e > 0) and not exists (select 1 from ev where ev.qid = b.qid and ev.doc_id = b.doc_id) and qid in (select qid from ev) qualify row_number() over (partition by qid order by own desc, doc_id) <= 6),
u as (select * from e2 union all select qid, doc_id, chunk, false, row_number() over (partition by qid order by own desc, doc_id) + 1048576, {_keys('chunk')} from x), f as (select *, max((not pinned and k.e > 0)::int) over (partition by qid) be, max((not pinned and k.p > 0)::int) over (partition by qid) bp from u),
g as (select * from f where pinned or case when be = 1 then k.e > 0 when bp = 1 then k.p > 0 else true end), o as (select *, row_number() over (partition by qid order by k desc, ord) place from g),
d as (select * from o qualify row_number() over (partition by qid, doc_id, lower(trim(regexp_replace(quote, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) order by place) = 1), m as (select *, count(*) over (partition by qid) many from d)
select qid, doc_id, md5(quote) digest, pinned, row_number() over (partition by qid order by case when many > 5 then not pinned else false end, place) as "rank" from m qualify row_number() over (partition by qid order by case when many > 5 then not pinned else false end, place) <= 5""")
def ranked_evidence(t):
    read = _read(t)
    chunks = _chunks(t, read)
    even = read.where("rank % 2 = 0")
    evidence = even.join(chunks.where("chunk_index = 0"), "doc_id").select("qid", F.col("rank").alias("ord"), "doc_id", F.substring("text", 1, 90).alias("quote"), (F.col("rank") % 4 == 0).alias("pinned"))
    out = evid.ranked_evidence(evidence, read.select("qid", "doc_id").join(chunks, "doc_id"), _PHRASES, _ENTITIES, _TERMS, most=5)
    return out.select("qid", "doc_id", F.md5(F.col("quote").cast("binary")).alias("digest"), "pinned", "rank")


_UNITS = {"percent": "%|percent", "currency": r"€|euros?|\$"}
_CLAIM = "text || ' up to ' || turn || '.500,50 euros.' || chr(10) || (turn + 1) || ') and ' || (turn * 3) || ' percent, 7%'"
_NUM_SQL = r"[0-9]+(?:\.[0-9]{3})*(?:,[0-9]+)?"


@query(rf"""with c as (select conv_id, turn, {_CLAIM} x from conversations), p as (select conv_id, turn, regexp_extract_all(x, '{_NUM_SQL}') m, regexp_split_to_array(x, '{_NUM_SQL}') g from c),
i as (select conv_id, turn, m, g, unnest(range(1, len(m) + 1)) i from p), s as (select conv_id, turn, i, m[i] n, right(array_to_string(list_transform(range(1, i + 1), lambda j: g[j] || case when j < i then m[j] else '' end), ''), 16) l, array_to_string(list_transform(range(i + 1, len(g) + 1), lambda j: g[j] || coalesce(m[j], '')), '') r from i),
w as (select conv_id, turn, i, n, lower(l || n || substring(r, 1, 16)) near from s where not starts_with(r, ')')), k as (select *, regexp_matches(near, '{_UNITS["percent"]}') pc, regexp_matches(near, '{_UNITS["currency"]}') cu from w),
a as (select conv_id, turn, coalesce(list(n order by i) filter (where pc), []) p, coalesce(list(n order by i) filter (where cu and not pc), []) q from k group by 1, 2)
select conv_id, turn::bigint turn, (select {IN_ORDER} from (select {canonical_sql("array_to_string(p, ' ')")} x)) percent, (select {IN_ORDER} from (select {canonical_sql("array_to_string(q, ' ')")} x)) currency from c left join a using (conv_id, turn)""")
def unit_claims(t):
    turn = F.col("turn").cast("string")
    text = F.concat("text", F.lit(" up to "), turn, F.lit(".500,50 euros.\n"), (F.col("turn") + 1).cast("string"), F.lit(") and "), (F.col("turn") * 3).cast("string"), F.lit(" percent, 7%"))
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), evid.unit_claims(text, _UNITS).alias("u")).select("conv_id", "turn", "u.percent", "u.currency")


@query("""with e as (select conv_id qid, turn % 5 doc_id, turn ord, 0 side, trim(substring(text, 1, 40)) tx from conversations where turn % 2 = 0 union all select conv_id, turn % 5, turn, 1, trim(text) from conversations where turn % 3 = 0), f as (select * from e where tx <> ''),
a as (select distinct conv_id qid, case conv_id % 3 when 0 then [0, 2] when 1 then [9] else []::int[] end cited from conversations), n as (select a.qid, count(f.tx) n from a left join f on f.qid = a.qid and list_contains(cited, f.doc_id) group by 1),
k as (select f.* from f join a using (qid) join n using (qid) where n = 0 or list_contains(cited, doc_id)) select a.qid, md5(coalesce(s, '')) digest from a left join (select qid, string_agg(tx, chr(10) order by side, ord, doc_id) s from k group by 1) using (qid)""")
def cited_text(t):
    c = t("conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") % 5).cast("int").alias("doc_id"), F.col("turn").alias("ord"), "text")
    cited = F.when(F.col("qid") % 3 == 0, F.array(F.lit(0), F.lit(2))).when(F.col("qid") % 3 == 1, F.array(F.lit(9))).otherwise(F.array().cast("array<int>"))
    out = evid.cited_text(c.select("qid").distinct().withColumn("cited", cited), c.where("ord % 2 = 0").withColumn("text", F.substring("text", 1, 40)), c.where("ord % 3 = 0"))
    return out.select("qid", F.md5(F.col("source").cast("binary")).alias("digest"))


@query("""with a as (select conv_id, turn, turn || ' euros' answer, case turn % 4 when 0 then []::int[] when 1 then [1] when 2 then [1, 8] else [9] end cited, case when turn % 3 = 0 then 'nothing' else turn || ' euros' end src from conversations),
e as (select *, len(cited) = 0 un, len(list_filter(cited, lambda c: c not in (1, 2))) > 0 outside, turn % 3 = 0 loose from a), m as (select *, case when un or outside then case when len(list_filter(cited, lambda c: c in (1, 2))) > 0 then list_filter(cited, lambda c: c in (1, 2)) else [2] end else cited end mended from e),
o as (select *, case when not loose then case when un or outside then 'fixed' else 'valid' end when turn % 5 = 0 then 'repaired' else 'fallback' end outcome from m)
select conv_id, turn::bigint turn, case when outcome = 'repaired' then 'none' else answer end answer, case when outcome = 'repaired' then [2] else mended end cited, array_to_string(list_filter([case when un then 'uncited' end, case when outside then 'out_of_scope' end, case when loose then 'unsupported' end], lambda x: x is not null), ',') initial, un or outside as fixed, case when outcome = 'fallback' then 'unsupported' else '' end final, outcome from o""")
def settled_answers(t):
    """Every fifth turn has a repaired answer; every third answer has a number that its source lacks."""
    turn = F.col("turn")
    answer = F.concat(turn.cast("string"), F.lit(" euros"))
    ids = lambda *x: F.array(*(F.lit(i) for i in x)).cast("array<int>")
    cited = F.when(turn % 4 == 0, ids()).when(turn % 4 == 1, ids(1)).when(turn % 4 == 2, ids(1, 8)).otherwise(ids(9))
    source = F.when(turn % 3 == 0, "nothing").otherwise(answer)
    rows = t("conversations").select("conv_id", turn.cast("long").alias("turn"), answer.alias("answer"), cited.alias("cited"), ids(1, 2).alias("scope"), ids(2).alias("evidence"), source.alias("source"), F.when(turn % 5 == 0, "none").alias("repaired"), ids(7).alias("repaired_cited"))
    return evid.settled(rows).select("conv_id", "turn", "answer", "cited", F.array_join("initial", ",").alias("initial"), "fixed", F.array_join("final", ",").alias("final"), "outcome")


_SIGNALS = {"digit": "[0-9]", "mail": "@", "link": "https?://", "money": r"[$€]", "share": "%"}


@query(f"""with recursive s as (select doc_id // 8 qid, doc_id, row_number() over (partition by doc_id // 8 order by doc_id) pos, list_filter([{', '.join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in _SIGNALS.items())}], lambda x: x is not null) sg from documents),
c as (select qid, list({{'i': pos, 'd': doc_id, 's': sg}} order by pos) c from s group by 1),
st as (select qid, c, list_filter({sorted(_SIGNALS)}, lambda x: not list_contains(flatten(list_transform(list_filter(c, lambda y: y.d = qid * 8), lambda y: y.s)), x)) missing, [qid * 8] picks, 0 n from c
union all select qid, c, list_filter(missing, lambda x: not list_contains(b.s, x)), list_append(picks, b.d), n + 1 from (select qid, c, missing, picks, n, list_sort(list_transform(list_filter(c, lambda y: y.d <> qid * 8), lambda y: {{'w': -len(list_filter(y.s, lambda x: list_contains(missing, x))), 'i': y.i, 'd': y.d, 's': y.s}}))[1] b from st) where b.w < 0 and n < 5)
select qid, list_sort(list_distinct(picks)) gold from st qualify row_number() over (partition by qid order by n desc) = 1""")
def gold_augment(t):
    """Eight neighbours are a question's candidates; the first is its gold."""
    rows = t("documents").select(F.floor(F.col("doc_id") / 8).cast("long").alias("qid"), "doc_id", evid.signals(F.col("text"), _SIGNALS).alias("signals"))
    per = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("doc_id", "signals"))).alias("c"))
    required = F.array(*(F.lit(x) for x in sorted(_SIGNALS)))
    return per.select("qid", evid.augmented(required, F.array(F.col("qid") * 8), F.col("c")).alias("gold"))


_LABELS = {"convocatoria": "Convocatorias", "call": "Convocatorias", "resolucion": "Resoluciones", "acuerdo": "Acuerdos", "orden general": "Órdenes"}
_RAW = ["  Convocatoria ", "CALL", "Resolución", "acuerdo", "Orden   General", "other", ""]


@query(f"""with r as (select doc_id, ({_RAW})[doc_id % 7 + 1] raw from documents), f as (select doc_id, trim(regexp_replace(strip_accents(lower(raw)), '[ ]+', ' ', 'g')) k from r) select doc_id, case k {' '.join(f"when '{k}' then '{v}'" for k, v in _LABELS.items())} else 'Otros' end label from f""")
def canonical_labels(t):
    raw = F.get(F.array(*(F.lit(x) for x in _RAW)), F.pmod("doc_id", F.lit(7)).cast("int"))
    return t("documents").select("doc_id", canonical_label(raw, _LABELS, "Otros").alias("label"))


_WORDS = ["becas", "premios", "fallas", "riego", "vivienda"]
_MONTH_LIST = str(MONTHS[0])
#: Resolutions by date: five topics, three issuers; each refers to one by its date and issuer.
_ISSUED = f"""iss as (select c_custkey doc_id, 'Resolución de ' || (1 + c_custkey % 14) || ' de ' || ({_MONTH_LIST})[1 + c_custkey % 6] || ' de 2024, ' || ({_WORDS})[1 + c_custkey % 5] || ' ' || ({_WORDS})[1 + c_custkey % 3] title, 'Conselleria ' || ['Norte', 'Sur', 'Este'][1 + c_custkey % 3] issuer, 1 + (c_custkey + 17) % 14 d, 1 + (c_custkey + 17) % 6 m, 'Conselleria ' || ['Norte', 'Sur', 'Este'][1 + (c_custkey // 2) % 3] wanted from customer)"""


def _issued(t):
    k = F.col("c_custkey")
    at = lambda words, i: F.get(F.array(*(F.lit(x) for x in words)), i.cast("int"))
    name = ["Norte", "Sur", "Este"]
    title = F.concat(F.lit("Resolución de "), (1 + k % 14).cast("string"), F.lit(" de "), at(MONTHS[0], k % 6), F.lit(" de 2024, "), at(_WORDS, k % 5), F.lit(" "), at(_WORDS, k % 3))
    day, month = (1 + (k + 17) % 14).cast("string"), at(MONTHS[0], (k + 17) % 6)
    text = F.concat(F.lit("Vista la Resolución de "), day, F.lit(" de "), month, F.lit(" de 2024, de la Conselleria "), at(name, F.floor(k / 2) % 3), F.lit(", que resuelve lo anterior"))
    return t("customer").select(k.alias("doc_id"), title.alias("title"), text.alias("text"), F.concat(F.lit("Conselleria "), at(name, k % 3)).alias("issuer"))


@query(rf"""with {_ISSUED}, r as (select * from iss where not (1 + doc_id % 14 = d and 1 + doc_id % 6 = m)), tgt as (select doc_id target, issuer by_, 1 + doc_id % 14 td, 1 + doc_id % 6 tm, list_distinct(regexp_extract_all(lower(title), '\p{{L}}{{5,}}')) w from iss),
c as (select r.doc_id, r.d, r.m, target, by_ = wanted own, len(list_intersect(w, list_distinct(regexp_extract_all(lower(r.title), '\p{{L}}{{5,}}')))) common from r join tgt on td = d and tm = m and target <> r.doc_id), n as (select doc_id, count(*) n, min(target) one, count(*) filter (where own) n1 from c group by 1),
k as (select doc_id, target, common, row_number() over (partition by doc_id order by common desc, target) i, lead(common) over (partition by doc_id order by common desc, target) nx from c where own)
select r.doc_id, r.d::bigint as "day", r.m::bigint as "month", r.wanted issuer, case when n = 1 then one when n1 = 1 then k.target when k.common > k.nx and k.common > 0 then k.target end target from r left join n using (doc_id) left join k on k.doc_id = r.doc_id and k.i = 1""")
def reference_resolution(t):
    """By date, then issuer, then topic."""
    d = _issued(t)
    return corpus.resolve_references(corpus.references(d), d).select("doc_id", "day", "month", "issuer", "target")


@query(f"""with {ORDERS}, t as (select doc_id, lower(split_part(title, ' ', 1)) ty, regexp_extract(title, '([0-9]+/[0-9]+)', 1) ny, doc_id % 28 + 1 dd, doc_id % 12 + 1 dm from titled), q as (select c_custkey qid, case c_custkey % 3 when 0 then 'decreto' when 1 then 'orden' end ty, (c_custkey % 999) || '/' || (2000 + c_custkey % 25) ny, case when c_custkey % 4 = 0 then c_custkey % 28 + 1 end d, c_custkey % 12 + 1 m from customer),
h as (select qid, doc_id, d from q join t on t.ny = q.ny and (q.ty is null or q.ty = t.ty) where d is null or (d = dd and m = dm)) select qid, doc_id, count(*) over (partition by qid) = 1 or d is not null pinned from h qualify row_number() over (partition by qid order by doc_id) <= 4""")
def reference_lookup(t):
    """Titles state their date in one of two languages."""
    d = F.col("doc_id")
    name = lambda i: F.get(F.array(*(F.lit(x) for x in MONTHS[i])), (d % 12).cast("int"))
    titled = _titled(t).select("doc_id", F.concat("title", F.lit(", de "), (d % 28 + 1).cast("string"), F.when(d % 2 == 0, F.concat(F.lit(" de "), name(0))).otherwise(F.concat(F.lit(" d'"), name(1)))).alias("title"))
    k = F.col("c_custkey")
    asked = t("customer").select(k.alias("qid"), F.when(k % 3 == 0, "decreto").when(k % 3 == 1, "orden").alias("ref_type"), (k % 999).alias("number"), (2000 + k % 25).alias("year"), F.when(k % 4 == 0, k % 28 + 1).alias("day"), (k % 12 + 1).alias("month"))
    return corpus.reference_lookup(asked, titled)
