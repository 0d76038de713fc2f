"""Kept indexes, and a pool assembled from lanes that search them: questions are the texts of ``benchmark``, documents those of ``documents``, in chunks and by title."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold, guess_language, tokens
from ..operators import fusion, pool, textindex, vectorindex
from ..operators.corpus import chunk_windows
from ..operators.features import hashed_vectors, hashed_words
from ..operators.spanish import spanish_stems
from ..workers import Shared
from . import query
from .assembly import merge_sql
from .retrieval import CHUNKS, COS, TOK, docs

#: Words that tell a question's language, in the order in which ties go.
MARKERS = {"en": ["the", "of", "and"], "fr": ["le", "la", "et"], "es": ["el", "los", "que"], "de": ["der", "die", "und"]}
#: A chunk's id is its document's times this, plus its index.
STRIDE = 1 << 16
LIMIT, LEAST = 20, 6


@query(f"""select qid, id, score, rank from (select q.vec_id qid, v.vec_id id, round({COS}, 6) score, row_number() over (partition by q.vec_id order by round({COS}, 6) desc, v.vec_id) rank
from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.label = (q.label + 3) % 10) where rank <= 10""")
def vector_index_filtered(t):
    """Every twentieth vector against all vectors of another label, by the kept index with all its cells."""
    rows = t("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    spark = rows.sparkSession
    path = f"{Shared(spark, 'vectors').base}/index"
    vectorindex.build(rows, path)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"), ((F.col("label") + 3) % 10).alias("want_label"))
    return vectorindex.search(spark, path, asked, 10, filters=("label",)).drop("probed")


def _questions(t):
    words = F.slice(F.array_distinct(F.filter(tokens(fold("text")), lambda w: F.length(w) >= 4)), 1, 8)
    return t("benchmark").select(F.col("item_id").alias("qid"), "text", words.alias("words"), guess_language("text", MARKERS, "en").alias("language"))


_Q = f"""qt as (select item_id qid, {TOK} tok, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_·''/-]+') plain from benchmark),
qs as (select qid, tok, {', '.join(f"len(list_intersect(plain, {m})) s{i}" for i, m in enumerate(MARKERS.values()))} from qt),
ql as (select qid, tok, case when greatest(s0, s1, s2, s3) = 0 then 'en' {' '.join(f"when s{i} = greatest(s0, s1, s2, s3) then '{x}'" for i, x in enumerate(MARKERS))} end lang from qs),
qu as (select qid, unnest(range(1, len(tok) + 1)) i, unnest(tok) w from ql), qf as (select qid, w, min(i) i from qu where length(w) >= 4 group by 1, 2),
qw as (select qid, w, row_number() over (partition by qid order by i) n from qf qualify row_number() over (partition by qid order by i) <= 8)"""


def _bm25_sql(to: str, table: str) -> str:
    """Scores of all documents (id, text, lang) of a table against the questions' words: (qid, id, lang, score, two: how many of the first two words it has)."""
    return f"""{to}_t as (select id, lang, {TOK} tok from {table}), {to}_l as (select id, lang, tok, len(tok) n from {to}_t), {to}_a as (select count(*) total, avg(n) avg from {to}_l),
{to}_p as (select id, lang, n, w, count(*) tf from (select id, lang, n, unnest(tok) w from {to}_l) where w in (select w from qw) group by 1, 2, 3, 4), {to}_d as (select w, count(*) df from {to}_p group by 1),
{to} as (select qid, id, lang, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * {to}_p.n / avg))), 6) score, count(*) filter (qw.n <= 2) two,
round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * {to}_p.n / avg))) filter (qw.n <= 2), 6) score2
from {to}_p join {to}_d using (w) join qw using (w), {to}_a group by 1, 2, 3)"""


@query(f"""with {_Q}, d as (select doc_id id, text, lang from documents), {_bm25_sql('b', 'd')} select qid, id doc_id, score, row_number() over (partition by qid order by score desc, id) rank from b qualify row_number() over (partition by qid order by score desc, id) <= 10""")
def text_index_topk(t):
    """The benchmark's questions on an index of all documents that was built in two batches and merged."""
    d = t("documents").select("doc_id", "text", "lang")
    spark = d.sparkSession
    path = f"{Shared(spark, 'texts').base}/index"
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    textindex.add(d.where(english), path)
    textindex.add(d.where(~english), path)
    return textindex.search(spark, path, _questions(t).select("qid", "words"), 10)[0]


@query()
def spanish_stem_counts(t):
    """(stem, words, tokens) of the Spanish documents: each distinct word is stemmed once."""
    lexeme = F.explode(tokens(F.lower("text"))).alias("lexeme")
    words = t("documents").where("lang = 'es'").select(lexeme).groupBy("lexeme").agg(F.count("*").alias("n"))
    return spanish_stems(words).groupBy("stem").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


def _documents(hits, chunk: bool):
    """Hits on chunks or titles as a list of documents."""
    doc = F.floor(F.col("id") / STRIDE).cast("long") if chunk else F.col("id")
    return fusion.first_seen(hits.select("qid", doc.alias("doc_id"), "rank"))


def _chunks(documents):
    return chunk_windows(documents, more=("lang",)).select((F.col("doc_id") * STRIDE + F.col("chunk_index")).alias("doc_id"), "text", F.col("lang").alias("part"))


class _Lanes:
    """All hits of the questions, in both passes: with the filter on their language, and without."""

    def __init__(self, t):
        spark = t("benchmark").sparkSession
        base = Shared(spark, "pool").base
        d = docs(t).select("doc_id", "lang", "title")
        chunks = _chunks(t("documents"))
        spans = textindex.TextIndexConfig(span=STRIDE * 128)
        titles = d.select("doc_id", F.col("title").alias("text"), F.col("lang").alias("part"))
        for rows, cfg, name, vectors in ((chunks, spans, "chunks", "vectors"), (titles, None, "titles", "title_vectors")):
            mine = Shared(spark, "words")  # tokens are made once, for both indexes; vectors are read twice, for the sample and the cells
            words = mine.keep(rows.select("doc_id", "part", textindex.joined("text").alias("words")), "words")
            textindex.add(words, f"{base}/{name}", cfg)
            vectorindex.build(mine.keep(hashed_words(words.select(F.col("doc_id").alias("id"), F.col("part").alias("lang"), "words"), ["id", "lang"], F.col("words")), "rows"), f"{base}/{vectors}")
            mine.clear()
        scratch = Shared(spark, "pool")
        self.questions = scratch.keep(_questions(t), "questions")
        # A question is asked as 4 * qid with its language, 4 * qid + 1 without.
        both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("language").alias("part")), F.struct(F.lit(1).alias("k"), F.lit(None).cast("string").alias("part")))).alias("x")
        asked = self.questions.select("*", both).select((F.col("qid") * 4 + F.col("x.k")).alias("qid"), "x.part", "words", "text")
        first = asked.withColumn("words", F.slice("words", 1, 2))
        self.broad = scratch.keep(textindex.search(spark, f"{base}/chunks", asked, 60, cfg=spans)[0].withColumnRenamed("doc_id", "id"), "broad")
        self.strict = scratch.keep(textindex.search(spark, f"{base}/chunks", first, 60, every=True, cfg=spans)[0].withColumnRenamed("doc_id", "id"), "strict")
        self.titles = scratch.keep(textindex.search(spark, f"{base}/titles", asked, 60)[0].withColumnRenamed("doc_id", "id"), "titles")
        # The stand-in for a written answer: the best chunk's text.
        best = self.broad.where("rank = 1 and qid % 4 = 0").select((F.col("qid") + 2).alias("qid"), F.col("id").alias("doc_id"))
        few = t("documents").join(F.broadcast(best.select(F.floor(F.col("doc_id") / STRIDE).cast("long").alias("doc_id")).distinct()), "doc_id", "left_semi")  # a row a question
        answers = _chunks(few).join(best, "doc_id").select("qid", "text")
        texts = asked.select("qid", "text", "part").unionByName(answers.join(asked.select((F.col("qid") + 2).alias("qid"), "part"), "qid"))
        vectors = scratch.keep(hashed_vectors(texts, ["qid", "part"], F.col("text")).select("qid", F.col("part").alias("want_lang"), F.col("embedding").alias("vector")), "asked")
        self.vectors = scratch.keep(vectorindex.search(spark, f"{base}/vectors", vectors, 100, filters=("lang",)), "vectors")
        self.title_vectors = scratch.keep(vectorindex.search(spark, f"{base}/title_vectors", vectors.where("qid % 4 < 2"), 50, filters=("lang",)), "title_vectors")

    def lanes(self, k: int, hyde: bool) -> list[pool.Lane]:
        of = lambda hits, k=k: hits.where(F.col("qid") % 4 == k).withColumn("qid", F.floor(F.col("qid") / 4).cast("long"))
        vec, tvec, title = _documents(of(self.vectors), True), _documents(of(self.title_vectors), False), _documents(of(self.titles), False)
        words = pool.lexical_lane(_documents(of(self.broad), True), _documents(of(self.strict), True), title, LIMIT)
        lanes = [pool.Lane("vec", vec, anchor=True)]
        if hyde:
            margins = fusion.margin_ratio(fusion.rrf([vec, words], limit=LIMIT))
            barred = self.questions.where(F.col("text").rlike("[0-9]")).select("qid")
            lanes.append(pool.Lane("answer", pool.gated(_documents(of(self.vectors, 2), True), margins, 0.22, barred), 3.0))
        return [*lanes, pool.Lane("words", words), pool.Lane("tvec", tvec, anchor=True), pool.Lane("title", title, 0.8, only_below="tvec")]

    def candidates(self, pooled, per_doc: int = 4):
        """(qid, doc_id, chunks): of each pooled document its first chunks, of the word searches before those by vector, with the language before without."""
        order = [(self.broad, 0), (self.strict, 0), (self.vectors, 0), (self.broad, 1), (self.strict, 1), (self.vectors, 1)]
        rows = None
        for i, (hits, k) in enumerate(order):
            x = hits.where(F.col("qid") % 4 == k).select(F.floor(F.col("qid") / 4).cast("long").alias("qid"), "id", F.struct(F.lit(i).alias("list"), "rank").alias("at"))
            rows = x if rows is None else rows.unionByName(x)
        first = rows.groupBy("qid", "id").agg(F.min("at").alias("at")).select("qid", F.floor(F.col("id") / STRIDE).cast("long").alias("doc_id"), (F.col("id") % STRIDE).alias("chunk"), "at")
        some = fusion.ranked(first.join(pooled.select("qid", "doc_id"), ["qid", "doc_id"]).select(F.struct("qid", "doc_id").alias("qid"), "chunk", "at"), "at", limit=per_doc)
        listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"].cast("string"))  # per_doc at most
        return some.groupBy("qid").agg(F.array_join(listed, ",").alias("chunks")).select("qid.qid", "qid.doc_id", "chunks")


def _fuse(to: str, parts: list[tuple[str, float]]) -> str:
    votes = " union all ".join(f"select qid, doc_id, {float(w)}::double / (60 + r) v from {p}" for p, w in parts)
    return f"{to} as (select *, row_number() over (partition by qid order by score desc, doc_id) r from (select qid, doc_id, round(sum(v), 12) score from ({votes}) group by 1, 2))"


def _margin(to: str, fused: str) -> str:
    return f"{to} as (select qid, max(n) n, (max(score) - max(case when r = least(n, 5) then score end)) / max(score) margin from (select *, count(*) over (partition by qid) n from {fused} where r <= {LIMIT}) group by 1)"


def _seen(to: str, hits: str) -> str:
    """A list of documents from hits (qid, id, r) on chunks (id // STRIDE) or titles."""
    return f"{to} as (select qid, doc_id, row_number() over (partition by qid order by m) r from (select qid, doc_id, min(r) m from {hits} group by 1, 2))"


def _pass_sql(p: str, soft: bool) -> str:
    """The lists of one pass: ``p``vec, ``p``words, ``p``tvec, ``p``title, and hits on chunks."""
    own = "true" if soft else "x.lang = ql.lang"
    top = lambda to, src, score, k, doc, where="true": f"{to}_h as (select qid, id, {doc} doc_id, row_number() over (partition by qid order by {score} desc, id) r from {src} x join ql using (qid) where {where} and {own} qualify row_number() over (partition by qid order by {score} desc, id) <= {k}), {_seen(to, to + '_h')}"
    lists = [top(f"{p}broad", "cb", "score", 60, f"id // {STRIDE}"), top(f"{p}strict", "cb", "score2", 60, f"id // {STRIDE}", "two = (select least(2, max(n)) from qw where qw.qid = x.qid)"), top(f"{p}ttl", "tb", "score", 60, "id"), top(f"{p}vec", "cv", "score", 100, f"id // {STRIDE}"), top(f"{p}tvec", "tv", "score", 50, "id")]
    return f"""{', '.join(lists)}, {p}lead as (select qid from {p}strict group by 1 having count(*) >= 10), {p}prim as (select * from {p}strict where qid in (from {p}lead) union all select * from {p}broad where qid not in (from {p}lead)),
{p}b1 as (select * from {p}broad where qid in (from {p}lead)), {p}s1 as (select * from {p}strict where qid not in (from {p}lead)), {_fuse(p + 'othw', [(p + 'b1', 1.0), (p + 's1', 1.2), (p + 'ttl', 0.9)])}, {p}oth as (select qid, doc_id, r from {p}othw where r <= {LIMIT}), {merge_sql(p + 'words_', p + 'prim', p + 'oth', LIMIT)},
{p}words as (select qid, doc_id, r from {p}words_), {p}title as (select * from {p}ttl where qid not in (select qid from {p}tvec group by 1 having count(*) >= {LEAST}))"""


def _features_sql(to: str, table: str, keys: str) -> str:
    return f"""{to} as (select {keys}, b, sum(s) v from (select {keys}, ('0x' || h[1:2])::int % 64 b, case when ('0x' || h[3:3])::int < 8 then 1 else -1 end s from (select {keys}, md5(w) h from (select {keys}, unnest({TOK}) w from {table}) where length(w) >= 3)) group by all having sum(s) <> 0)"""


def _cosines_sql(to: str, asked: str, rows: str) -> str:
    """Cosines of all questions and rows that have vectors; 0 where no place is shared."""
    size = lambda x, key, more="": f"(select {key}{more}, sqrt(sum(v * v)::double) s from {x} group by all)"
    return f"""{to} as (select q.qid, r.id, r.lang, round(coalesce(dot, 0) / (q.s * r.s), 6) score from {size(asked, 'qid')} q, {size(rows, 'id', ', lang')} r left join (select qid, id, sum(a.v * b.v)::double dot from {asked} a join {rows} b using (b) group by 1, 2) d on d.qid = q.qid and d.id = r.id)"""


POOL = f"""{_Q}, {CHUNKS}, ch as (select c.doc_id * {STRIDE} + chunk_index id, c.text, d.lang from chunks c join documents d on d.doc_id = c.doc_id), ti as (select doc_id id, split_part(text, chr(10), 1) text, lang from documents),
{_bm25_sql('cb', 'ch')}, {_bm25_sql('tb', 'ti')}, {_features_sql('cf', 'ch', 'id, lang')}, {_features_sql('tf', 'ti', 'id, lang')}, {_features_sql('qv', '(select item_id qid, text from benchmark)', 'qid')}, {_cosines_sql('cv', 'qv', 'cf')}, {_cosines_sql('tv', 'qv', 'tf')},
{_pass_sql('o', False)}, {_pass_sql('s', True)}, an as (select qid, text from obroad_h join ch using (id) where r = 1), {_features_sql('av', 'an', 'qid')}, {_cosines_sql('acv', 'av', 'cf')},
ans_h as (select qid, id // {STRIDE} doc_id, row_number() over (partition by qid order by score desc, id) r from acv x join ql using (qid) where x.lang = ql.lang qualify row_number() over (partition by qid order by score desc, id) <= 100), {_seen('ans_', 'ans_h')},
{_fuse('two', [('ovec', 1.0), ('owords', 1.0)])}, {_margin('mtwo', 'two')}, answer as (select a.* from ans_ a join mtwo using (qid) where margin < 0.22 and qid not in (select item_id from benchmark where regexp_matches(text, '[0-9]'))),
{_fuse('f1', [('ovec', 1.0), ('answer', 3.0), ('owords', 1.0), ('otvec', 1.0), ('otitle', 0.8)])}, {_margin('m1', 'f1')}, thin as (select qid from ql left join m1 using (qid) where coalesce(n, 0) < {LEAST} or coalesce(margin, 0) < 0.12),
{', '.join(f's2{x} as (select * from s{x} where qid in (from thin))' for x in ('vec', 'words', 'tvec', 'title'))}, {_fuse('full_', [('ovec', 1.0), ('answer', 3.0), ('owords', 1.0), ('otvec', 1.0), ('otitle', 0.8), ('s2vec', 1.0), ('s2words', 1.0), ('s2tvec', 1.0), ('s2title', 0.8)])},
{_margin('m2', 'full_')}, pl as (select f.* from full_ f join m2 using (qid) where r <= case when margin < 0.12 then {2 * LIMIT} else {LIMIT} end),
want as (select qid, doc_id, min(a) a from (select qid, doc_id, 1000 + r a from ovec where r <= 3 union all select qid, doc_id, 2000 + r from otvec where r <= 3 union all select qid, doc_id, 3000 + r from s2vec where r <= 3 union all select qid, doc_id, 4000 + r from s2tvec where r <= 3) group by 1, 2),
late as (select w.qid, w.doc_id, f.score, (select max(r) from pl p where p.qid = w.qid) + row_number() over (partition by w.qid order by a) r from want w join full_ f on f.qid = w.qid and f.doc_id = w.doc_id where not exists (select 1 from pl p where p.qid = w.qid and p.doc_id = w.doc_id)),
pooled as (select qid, doc_id, score, r, false anchor from pl union all select qid, doc_id, score, r, true from late),
hits as (select qid, id, min(k) k from (select qid, id, 1000 + r k from obroad_h union all select qid, id, 2000 + r from ostrict_h union all select qid, id, 3000 + r from ovec_h union all select qid, id, 4000 + r from sbroad_h union all select qid, id, 5000 + r from sstrict_h union all select qid, id, 6000 + r from svec_h) group by 1, 2),
few as (select qid, id // {STRIDE} doc_id, id % {STRIDE} chunk, k from hits qualify row_number() over (partition by qid, id // {STRIDE} order by k) <= 4), listed as (select qid, doc_id, string_agg(chunk::varchar, ',' order by k) chunks from few group by 1, 2)"""


@query(f'with recursive {POOL} select qid, doc_id, round(score, 6) score, r "rank", anchor, coalesce(chunks, \'\') chunks from pooled left join listed using (qid, doc_id)')
def pool_from_texts(t):
    """The pool of every question of the benchmark with its chunk candidates: vector, answer, word, title-vector and title-word lanes, relaxed where the pool is thin."""
    lanes = _Lanes(t)
    out = pool.assemble(lanes.lanes(0, True), lanes.lanes(1, False), lanes.questions, LEAST)
    out = Shared(t("benchmark").sparkSession, "pool").keep(out, "pooled")
    rows = out.join(lanes.candidates(out), ["qid", "doc_id"], "left")
    return rows.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "anchor", F.coalesce("chunks", F.lit("")).alias("chunks"))
