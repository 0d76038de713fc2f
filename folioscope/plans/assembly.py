"""From lanes to a read set: pool assembly, hops, gates, budgets, payloads. Eight questions over the vectors' ids; a lane's order is an expression that both engines read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.vector import cosine
from ..operators import fusion, pool
from ..operators.corpus import chunk_windows
from . import query
from .ingest import CODES, _parts
from .retrieval import CHUNKS, DOCS, docs

GRID = "grid as (select q.qid, v.vec_id doc_id from embeddings v, (select unnest(range(0, 8)) qid) q)"
#: Lanes: how their documents are ordered (largest first), which of them count, how many stay.
LANES = {
    "broad": ("(doc_id * 31 + qid * 17) % 101", "doc_id % 3 <> 0", "r <= 40"),
    "strict": ("(doc_id * 7 + qid) % 53", "(doc_id + qid) % 9 = 0", "r <= 4 + 2 * qid"),
    "title": ("(doc_id * 13 + qid * 5) % 97", "doc_id % 2 = 0", "r <= 15"),
    "vec": ("(doc_id * 41 + qid * 3) % 89", "true", "r <= 30"),
    "tiny": ("(doc_id * 29 + qid) % 71", "doc_id % 4 = qid % 4", "r <= 2 + qid"),
}


def _grid(t):
    return t("embeddings").select(F.col("vec_id").alias("doc_id")).withColumn("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))


def _lane(t, name: str, extra: str = "true"):
    order, where, limit = LANES[name]
    rows = _grid(t).where(f"({where}) and ({extra})").withColumn("s", F.expr(order))
    return fusion.ranked(rows, F.desc("s"), "doc_id").withColumnRenamed("rank", "r").where(limit).select("qid", "doc_id", F.col("r").alias("rank"))


def lane_sql(name: str, extra: str = "true", to: str = "") -> str:
    order, where, limit = LANES[name]
    return f"{to or name} as (select * from (select qid, doc_id, row_number() over (partition by qid order by {order} desc, doc_id) r from grid where ({where}) and ({extra})) where {limit})"


def fuse_sql(to: str, parts: list[tuple[str, float]], limit: int | None = None) -> str:
    votes = " union all ".join(f"select qid, doc_id, {float(w)}::double / (60 + r) v from {p}" for p, w in parts)
    return f"{to} as (select *, row_number() over (partition by qid order by score desc, doc_id) r from (select qid, doc_id, round(sum(v), 12) score from ({votes}) group by 1, 2) qualify {f'row_number() over (partition by qid order by score desc, doc_id) <= {limit}' if limit else 'true'})"


def merge_sql(to: str, p: str, s: str, limit: int) -> str:
    budget = max(5, int(limit * 0.3))
    gone = lambda x: f"not exists (select 1 from {x} h where h.qid = x.qid and h.doc_id = x.doc_id)"
    return f"""{to}_two as (select qid from {p} intersect select qid from {s}), {to}_head as (select qid, doc_id, 1 phase, r from {p} where r <= {limit - budget} and qid in (from {to}_two)),
{to}_sec as (select qid, doc_id, 2 phase, r, row_number() over (partition by qid order by r) k from {s} x where qid in (from {to}_two) and {gone(to + '_head')}), {to}_took as (select qid, doc_id, phase, r from {to}_sec where k <= {budget}),
{to}_rest as (select qid, doc_id, 3 phase, r from {p} x where r > {limit - budget} and qid in (from {to}_two) and {gone(to + '_took')}),
{to}_all as (select * from {to}_head union all select * from {to}_took union all select * from {to}_rest),
{to} as (select qid, doc_id, phase, nr r from (select qid, doc_id, phase, row_number() over (partition by qid order by phase, r) nr from {to}_all) where nr <= {limit} union all select qid, doc_id, 1, r from (select qid, doc_id, r from {p} union all select qid, doc_id, r from {s}) where qid not in (from {to}_two) and r <= {limit})"""


_LEX = f"""{lane_sql('broad')}, {lane_sql('strict')}, {lane_sql('title')}, lead as (select qid from strict group by 1 having count(*) >= 10),
prim as (select qid, doc_id, r from strict where qid in (from lead) union all select qid, doc_id, r from broad where qid not in (from lead)),
b1 as (select * from broad where qid in (from lead)), s1 as (select * from strict where qid not in (from lead)), {fuse_sql('oth', [('b1', 1.0), ('s1', 1.2), ('title', 0.9)], 20)}, {merge_sql('lex', 'prim', 'oth', 20)}"""


def _lexical(t):
    return pool.lexical_lane(_lane(t, "broad"), _lane(t, "strict"), _lane(t, "title"), 20)


@query(f"with {GRID}, {_LEX} select qid, doc_id, phase::bigint phase, r as \"rank\" from lex")
def lexical_lane(t):
    return _lexical(t).select("qid", "doc_id", F.col("phase").cast("long").alias("phase"), "rank")


@query(f"with {GRID}, {_LEX}, {lane_sql('vec')}, {lane_sql('tiny')}, lx as (select qid, doc_id, r from lex), {fuse_sql('sec', [('vec', 1.0), ('tiny', 1.0)], 20)}, {merge_sql('out', 'lx', 'sec', 20)} select qid, doc_id, r as \"rank\" from out")
def facet_lane(t):
    return pool.facet_lane([_lexical(t), _lane(t, "vec"), _lane(t, "tiny")], 20).select("qid", "doc_id", "rank")


#: Even questions filter by language; a document's language is its id's.
_OWN = "qid % 2 <> 0 or doc_id % 5 = qid % 5"


@query(f"""with {GRID}, {', '.join(lane_sql(n, _OWN) for n in ('vec', 'broad', 'title', 'tiny'))}, {', '.join(lane_sql(n, to=n + '0') for n in ('vec', 'broad', 'title', 'tiny'))},
lex1 as (select * from title where qid not in (select qid from tiny group by 1 having count(*) >= 6)), lex0 as (select * from title0 where qid not in (select qid from tiny0 group by 1 having count(*) >= 6)),
{fuse_sql('f1', [('vec', 1.0), ('broad', 1.0), ('tiny', 1.0), ('lex1', 0.8)], 20)}, m1 as (select qid, count(*) n, case when max(score) > 0 then (max(score) - max(case when r = 5 then score end)) / max(score) else 0 end margin, max(case when r = 5 then 1 end) five, (max(score) - min(score)) / max(score) low from f1 group by 1),
thin as (select q.qid from (select unnest(range(0, 8, 2)) qid) q left join m1 using (qid) where coalesce(n, 0) < 6 or coalesce(case when n >= 5 then margin else low end, 0) < 0.12),
{', '.join(f'{n}2 as (select * from {n}0 where qid in (from thin))' for n in ('vec', 'broad', 'tiny'))}, lex2 as (select * from lex0 where qid in (from thin)),
{fuse_sql('full_', [('vec', 1.0), ('broad', 1.0), ('tiny', 1.0), ('lex1', 0.8), ('vec2', 1.0), ('broad2', 1.0), ('tiny2', 1.0), ('lex2', 0.8)])},
m2 as (select qid, (max(score) - max(case when r = least(n, 5) then score end)) / max(score) margin from (select *, count(*) over (partition by qid) n from full_ where r <= 20) group by 1),
pl as (select f.* from full_ f join m2 using (qid) where r <= case when margin < 0.12 then 40 else 20 end),
want as (select qid, doc_id, min(a) a from (select qid, doc_id, 1000 + r a from vec where r <= 3 union all select qid, doc_id, 2000 + r from tiny where r <= 3 union all select qid, doc_id, 3000 + r from vec2 where r <= 3 union all select qid, doc_id, 4000 + r from tiny2 where r <= 3) group by 1, 2),
late as (select w.qid, w.doc_id, f.score, (select max(r) from pl p where p.qid = w.qid) + row_number() over (partition by w.qid order by a) r from want w join full_ f on f.qid = w.qid and f.doc_id = w.doc_id where not exists (select 1 from pl p where p.qid = w.qid and p.doc_id = w.doc_id))
select qid, doc_id, round(score, 6) score, r as "rank", false as anchor from pl union all select qid, doc_id, round(score, 6), r, true from late""")
def pool_assembly(t):
    def lanes(extra: str):
        lists = {n: _lane(t, n, extra) for n in ("vec", "broad", "title", "tiny")}
        return [pool.Lane("vec", lists["vec"], anchor=True), pool.Lane("broad", lists["broad"]), pool.Lane("tiny", lists["tiny"], anchor=True), pool.Lane("words", lists["title"], 0.8, only_below="tiny")]

    qid = F.col("id")
    questions = t("embeddings").sparkSession.range(8).select(qid.alias("qid"), F.when(qid % 2 == 0, F.lit("es")).alias("language"))
    out = pool.assemble(lanes(_OWN), lanes("true"), questions, 6)
    return out.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "anchor")


@query(f"""with {GRID}, {_LEX}, {lane_sql('vec')}, {lane_sql('tiny')}, p as (select qid, doc_id, r from vec where r <= 8), {fuse_sql('two', [('vec', 1.0), ('broad', 1.0)], 20)},
m as (select qid, (max(score) - max(case when r = 5 then score end)) / max(score) margin from two group by 1) select t.qid, t.doc_id, t.r as "rank" from tiny t join m using (qid) where margin < 0.22 and t.qid % 3 <> 0""")
def gated_lane(t):
    margins = fusion.margin_ratio(fusion.rrf([_lane(t, "vec"), _lane(t, "broad")], limit=20))
    barred = t("embeddings").sparkSession.range(8).select(F.col("id").alias("qid")).where("qid % 3 = 0")
    return pool.gated(_lane(t, "tiny"), margins, 0.22, barred)


def _in(x: str, y: str) -> str:
    return f"exists (select 1 from {y} h where h.qid = {x}.qid and h.doc_id = {x}.doc_id)"


_HOPS = f"""{GRID}, {lane_sql('vec')}, {lane_sql('tiny', 'qid % 2 = 0')}, {lane_sql('broad', to='h2')}, {lane_sql('title', to='h3')}, p as (select qid, doc_id, r from vec where r <= 12),
t1 as (select * from tiny where r <= 5), n1 as (select * from t1 where not {_in('t1', 'p')}), p1 as (select qid, doc_id from p union all select qid, doc_id from n1), q1 as (select distinct qid from n1),
t2 as (select * from h2 where r <= 5 and qid not in (from q1)), c2 as (select qid from t2 where r = 1 and {_in('t2', 'p1')}), n2 as (select * from t2 where qid not in (from c2) and not {_in('t2', 'p1')}), p2 as (select * from p1 union all select qid, doc_id from n2), q2 as (select distinct qid from n2),
t3 as (select * from h3 where r <= 5 and qid not in (from q1)), c3 as (select qid from t3 where r = 1 and {_in('t3', 'p2')}), n3 as (select * from t3 where qid not in (from c3) and not {_in('t3', 'p2')}),
every as (select qid, doc_id, 0 h, r, false added from p union all select qid, doc_id, 1, r, true from n1 union all select qid, doc_id, 2, r, true from n2 union all select qid, doc_id, 3, r, true from n3)"""


def _hopped(t):
    start = _lane(t, "vec").where("rank <= 12")
    return start, *pool.hop(start, [("reference", _lane(t, "tiny", "qid % 2 = 0")), ("facet", _lane(t, "broad")), ("facet", _lane(t, "title"))])


@query(f"with {_HOPS} select qid, doc_id, row_number() over (partition by qid order by h, r) as \"rank\", added from every")
def second_hop(t):
    return _hopped(t)[1].drop("pinned")


@query(f"""with {_HOPS}, shield as (select distinct qid, doc_id from (select qid, doc_id from t1 where r <= 3 and {_in('t1', 'p')} union all select qid, doc_id from t2 where r <= 3 and {_in('t2', 'p1')} union all select qid, doc_id from t3 where r <= 3 and {_in('t3', 'p2')})),
gone as (select qid, doc_id from p where doc_id % 3 = 0 and qid % 4 > 1 and not {_in('p', 'shield')}) select qid, doc_id, row_number() over (partition by qid order by r) as "rank" from p where not {_in('p', 'gone')}""")
def current_editions(t):
    """Every third document is an old edition; some questions want a series, some a stated period; what hops found stays."""
    start, _, shield = _hopped(t)
    q = F.col("id")
    questions = t("embeddings").sparkSession.range(8).select(q.alias("qid"), (q % 4 == 0).alias("enumerates"), (q % 4 == 1).alias("windowed"))
    return pool.current_editions(start, start.where("doc_id % 3 = 0").select("qid", "doc_id"), questions, shield).select("qid", "doc_id", "rank")


@query(f"""with {GRID}, {lane_sql('vec')}, {lane_sql('strict')}, {lane_sql('broad')}, {fuse_sql('two', [('vec', 1.0), ('broad', 1.0)], 20)}, m as (select qid, (max(score) - max(case when r = 5 then score end)) / max(score) margin from two group by 1),
n as (select qid, count(*) n from strict group by 1) select s.qid, s.doc_id, s.r as "rank" from strict s join n using (qid) join m using (qid) where s.r <= greatest(3, least(n, case when s.qid % 3 = 0 then 10 else 6 end)) + case when margin < 0.12 then 2 else 0 end""")
def read_budget(t):
    q = F.col("id")
    questions = t("embeddings").sparkSession.range(8).select(q.alias("qid"), (q % 3 == 0).alias("enumerates"))
    return pool.read_budget(_lane(t, "strict"), fusion.rrf([_lane(t, "vec"), _lane(t, "broad")], limit=20), questions, cap=6, series_cap=10).select("qid", "doc_id", "rank")


TOKENS = [(0, 0, "Brand/2019"), (0, 1, "R-0007"), (1, 0, "ECONOMY"), (1, 1, "R-00"), (2, 0, "nothing"), (3, 0, "r-0011")]


@query(f"""with {CODES}, d as (select doc_id, 'R-' || lpad(doc_id::varchar, 4, '0') ref, title, case when doc_id % 3 = 0 then 'va' else 'es' end lang, issue_date from parts), a(qid, place, token) as (values {', '.join(f"({q}, {p}, '{k.upper()}')" for q, p, k in TOKENS)}),
h as (select a.qid::bigint qid, place, doc_id, issue_date, case when upper(ref) = token then 0 when contains(upper(ref), token) then 1 else 2 end kind, a.qid <> 1 or lang = 'va' own from a join d on contains(upper(ref), token) or contains(upper(title), token)),
o as (select *, row_number() over (partition by qid, place order by kind, issue_date desc, doc_id desc) pos from h qualify own or not max(own) over (partition by qid, place)), k as (select *, row_number() over (partition by qid, place order by kind, issue_date desc, doc_id desc) at_ from (select qid, place, doc_id, issue_date, kind from o)),
f as (select qid, doc_id, min((place, at_)) x from k where at_ <= 5 group by 1, 2) select qid, doc_id, round(greatest(1.0::double, 5.0 - x[2] * 0.1), 6) score, row_number() over (partition by qid order by x) as "rank" from f""")
def reference_hits(t):
    d = _parts(t).select("doc_id", F.concat(F.lit("R-"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("ref"), "title", F.when(F.col("doc_id") % 3 == 0, "va").otherwise("es").alias("language"), "issue_date")
    spark = d.sparkSession
    asked = spark.createDataFrame(TOKENS, "qid long, place int, token string")
    questions = spark.createDataFrame([(0, None), (1, "va"), (2, None), (3, None)], "qid long, language string")
    return pool.reference_hits(asked, d, questions).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


_REFS = "d as (select doc_id, 'R-' || lpad(doc_id::varchar, 4, '0') ref, title, case when doc_id % 3 = 0 then 'va' else 'es' end lang, issue_date from parts)"


@query(f"""with {CODES}, {_REFS}, a as (select p_partkey qid, 0 place, upper(substring(p_brand, 1, 5) || '/' || (2015 + (p_partkey // 5) % 10) || '/' || (p_partkey // 5)) token from part union all select p_partkey, 1, upper(split_part(p_type, ' ', -1)) from part union all select p_partkey, 2, right('R-' || lpad(p_partkey::varchar, 4, '0'), 2) from part),
w as (select *, case when qid % 3 = 0 then 'va' when qid % 3 = 1 then 'es' end want from a), t as (select distinct token, want from w),
h as (select token, want, doc_id, issue_date, case when upper(ref) = token then 0 when contains(upper(ref), token) then 1 else 2 end kind, coalesce(lang = want, true) own from t join d on contains(upper(ref), token) or contains(upper(title), token)),
k as (select *, row_number() over (partition by token, want order by kind, issue_date desc, doc_id desc) at_ from (select * from h qualify own or not max(own) over (partition by token, want))),
f as (select qid, doc_id, min((place, at_)) x from w join k on k.token = w.token and k.want is not distinct from w.want where at_ <= 5 group by 1, 2) select qid, doc_id, round(greatest(1.0::double, 5.0 - x[2] * 0.1), 6) score, row_number() over (partition by qid order by x) as "rank" from f""")
def part_references(t):
    """Three tokens of every part (its code, its material, the end of its reference) against all references and titles."""
    d = _parts(t).select("doc_id", F.concat(F.lit("R-"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("ref"), "title", F.when(F.col("doc_id") % 3 == 0, "va").otherwise("es").alias("language"), "issue_date")
    kind = t("part").select(F.col("p_partkey").alias("doc_id"), F.split_part("p_type", F.lit(" "), F.lit(-1)).alias("material"))
    code = F.regexp_extract("title", "([A-Za-z]+/[0-9]+/[0-9]+)", 1)
    named = F.posexplode(F.array(code, F.col("material"), F.right(F.col("ref"), F.lit(2)))).alias("place", "token")
    asked = d.join(kind.hint("merge"), "doc_id").select(F.col("doc_id").alias("qid"), named)  # a broadcast would grow with the parts
    questions = d.select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 3 == 0, "va").when(F.col("doc_id") % 3 == 1, "es").alias("language"))
    return pool.reference_hits(asked, d, questions).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {GRID}, {lane_sql('tiny')}, {lane_sql('vec')}, u as (select qid, doc_id, min((0, r)) x from tiny group by 1, 2 union all select qid, doc_id, min((1, r)) from vec group by 1, 2), o as (select qid, doc_id, min(x) x from u group by 1, 2) select qid, doc_id, row_number() over (partition by qid order by x) as "rank" from o""")
def references_ahead(t):
    return pool.ahead(_lane(t, "tiny"), _lane(t, "vec"))


_COS = "list_dot_product(c.e, q.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.e, q.e)))"


@query(f"""with c as (select vec_id // 4 doc_id, vec_id % 4 chunk_index, embedding::double[] e from embeddings), q as (select vec_id // 3 qid, vec_id % 3 place, embedding::double[] e from embeddings where vec_id < 12), p as (select qid, doc_id, chunk_index, place, round({_COS}, 6) s from c, q where doc_id % 4 = qid)
select qid, doc_id, chunk_index, s score from p qualify row_number() over (partition by qid, doc_id order by s desc, place, chunk_index) = 1""")
def best_snippets(t):
    """Four vectors are the chunks of a document; a question has three vectors."""
    v = t("embeddings").select("vec_id", "embedding")
    part = lambda n: (F.floor(F.col("vec_id") / n).cast("long"), F.pmod("vec_id", F.lit(n)))
    chunks = v.select(part(4)[0].alias("doc_id"), part(4)[1].alias("chunk_index"), "embedding")
    queries = v.where("vec_id < 12").select(part(3)[0].alias("qid"), part(3)[1].alias("place"), F.col("embedding").alias("asked"))
    candidates = chunks.select("doc_id").distinct().select(F.pmod("doc_id", F.lit(4)).alias("qid"), "doc_id")
    return pool.snippets(candidates, chunks, queries, F.round(cosine("embedding", "asked"), 6))


_TARGETS = "tg as (select doc_id, row_number() over (order by n_chars desc, doc_id) r from documents where doc_id % 7 = 0 or n_chars = 0 qualify r <= 40)"


@query(f"""with {CHUNKS}, {_TARGETS}, {DOCS.replace('docs as', 'meta as')}, ch as (select c.* from chunks c join tg using (doc_id)), l0 as (select doc_id, chunk_index, row_number() over (partition by doc_id order by length(text), chunk_index) r from ch), l1 as (select doc_id, chunk_index, row_number() over (partition by doc_id order by chunk_index desc) r from ch), l2 as (select doc_id, chunk_index, row_number() over (partition by doc_id order by chunk_index) r from ch),
a as (select * from l0 where r <= 2), b as (select *, row_number() over (partition by doc_id order by r) k from l1 x where not exists (select 1 from a where a.doc_id = x.doc_id and a.chunk_index = x.chunk_index)), b1 as (select doc_id, chunk_index, r from b where k <= 2),
c1 as (select * from l2 x where not exists (select 1 from a where a.doc_id = x.doc_id and a.chunk_index = x.chunk_index) and not exists (select 1 from b1 where b1.doc_id = x.doc_id and b1.chunk_index = x.chunk_index)),
o as (select doc_id, chunk_index, row_number() over (partition by doc_id order by s, r) k from (select *, 0 s from a union all select *, 1 from b1 union all select *, 2 from c1)), tx as (select o.doc_id, k, substring(text, 1, 300) t from o join chunks using (doc_id, chunk_index) where k <= 6),
g as (select doc_id, list(t order by k) ts from tx group by 1) select tg.r as "rank", doc_id, md5(title) title, coalesce(len(ts), case when length(meta.text) > 0 then 1 else 0 end)::bigint n, md5(coalesce(array_to_string(ts, chr(10)), substring(meta.text, 1, 12000))) digest from tg join meta using (doc_id) left join g using (doc_id)""")
def read_payload(t):
    d = t("documents").select("doc_id", "n_chars")
    targets = d.where("doc_id % 7 = 0 or n_chars = 0").orderBy(F.desc("n_chars"), "doc_id").limit(40).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_chars"), "doc_id")).cast("long")).select("doc_id", "rank")
    texts = chunk_windows(t("documents").join(targets, "doc_id", "left_semi"))
    by = lambda *order: texts.select("doc_id", "chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long").alias("rank"))
    out = pool.payload(targets, docs(t), [(by(F.length("text"), "chunk_index"), 2), (by(F.desc("chunk_index")), 2), (by("chunk_index"), None)], texts, 300)
    return out.select("rank", "doc_id", F.md5(F.col("title").cast("binary")).alias("title"), F.size("chunks").cast("long").alias("n"), F.md5(F.array_join("chunks", "\n").cast("binary")).alias("digest"))


_PARTS = "tion ment les que ent ati ers con pre des our ous ant eur ion est ell res ter men and ing the ung".split()
TOPICS = [(0, _PARTS), (1, ["der", "ung", "heit", "sch"]), (2, _PARTS[:12]), (3, _PARTS[8:]), (4, [])]
_TOPIC_SQL = ", ".join(f"({q}, {ts if ts else '[]::varchar[]'})" for q, ts in TOPICS)


@query(f"""with {DOCS}, q(qid, topic) as (values {_TOPIC_SQL}), h as (select qid::bigint qid, doc_id, len(list_filter(topic, lambda x: contains(strip_accents(lower(title)), x))) n, len(topic) m from docs, q), f as (select * from h where n >= 2 and m > 0 and n / m >= 0.5)
select qid, doc_id from f where n = (select max(n) from f g where g.qid = f.qid) qualify count(*) over (partition by qid) = 1""")
def forced_target(t):
    topics = t("documents").sparkSession.createDataFrame(TOPICS, "qid long, topic array<string>")
    titles = docs(t).select("doc_id", fold("title").alias("low")).crossJoin(F.broadcast(topics))  # a literal batch
    return pool.forced_target(titles.select("qid", "doc_id", pool.named_target(F.col("topic"), F.col("low"), folded=True).alias("target")))


@query(f"""with {CODES}, h as (select doc_id % 60 qid, doc_id hit, row_number() over (partition by doc_id % 60 order by doc_id) place, contains(lower(title), 'brass')::int + contains(lower(title), 'economy')::int topic, doc_id % 2 = 0 own, title, 'Brand/' || (2015 + doc_id % 3) want from parts)
select qid, hit from h where contains(title, want) qualify row_number() over (partition by qid order by topic desc, own desc, place) = 1""")
def portal_hit(t):
    low = fold("title")
    q = F.pmod("doc_id", F.lit(60))
    hits = _parts(t).select(q.alias("qid"), F.col("doc_id").alias("hit"), F.row_number().over(Window.partitionBy(q).orderBy("doc_id")).alias("place"), (F.contains(low, F.lit("brass")).cast("int") + F.contains(low, F.lit("economy")).cast("int")).alias("topic"), (F.col("doc_id") % 2 == 0).alias("same_language"), "title", F.concat(F.lit("Brand/"), (2015 + F.col("doc_id") % 3).cast("string")).alias("want"))
    return pool.best_portal_hit(hits.where(F.contains("title", F.col("want"))))
