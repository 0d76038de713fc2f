"""Queries on what questions ask for. Questions are the turns of ``conversations``, each with a tail made from its keys: the tables' own texts name no norms, codes, fields or windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as ask
from ..functions.text import MARKED, PLAIN, TOKEN
from ..operators import corpus
from ..operators.questions import lexical_queries
from . import query
from .ingest import IDS, _parts

#: A tail for each sixth of the questions: {n} is 1 to 90, {m} the next number, {y} a year, {c} the conversation, {b} the year and {k} the number of a code in the titles of parts.
TAILS = [
    " ¿Qué dice el Decreto {n}/{y} y qué plazo da la Orden {m}/{y} de Aguas?",
    ' Is the brand {b} {k} of the "rural plan" open, BDNS: 1{c}00000?',
    " Ayudas de la Conselleria de Agricultura y Pesca Norte, last week",
    " recent notices since {y}-05-01 of Plan Rural Norte y el Fondo Municipal {y}",
    " Para aquella beca de Norte Plan: 1) requisitos, 2) importe; cuál es el plazo y el importe?",
    "",
]
KEYS = {"n": "conv_id % 90 + 1", "m": "conv_id % 90 + 2", "y": "1990 + conv_id % 34", "c": "conv_id % 90 + 10", "b": "2015 + {} % 10", "k": "{}"}


def _asked(t):
    keys = {k: F.expr(v.format("floor(conv_id / 5)")).cast("long").cast("string") for k, v in KEYS.items()}
    tail = F.lit(TAILS[0])
    for i, text in enumerate(TAILS):
        tail = F.lit(text) if i == 0 else F.when(F.expr("pmod(conv_id + turn, 6)") == i, F.lit(text)).otherwise(tail)
    for k, v in keys.items():
        tail = F.replace(tail, F.lit("{" + k + "}"), v)
    rows = t("conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("qid"), "conv_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


def _tail_sql() -> str:
    out = "case (conv_id + turn) % 6 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(TAILS)) + " end"
    for k, v in KEYS.items():
        out = f"replace({out}, '{{{k}}}', ({v.format('(conv_id // 5)')})::bigint::varchar)"
    return out


ASKED = f"asked as (select (conv_id * 1000 + turn)::bigint qid, conv_id, coalesce(\"text\", '') || {_tail_sql()} as \"text\" from conversations)"
_TOK = TOKEN.replace("'", "''")
_FOLDED = f"translate(lower(\"text\"), '{MARKED}', '{PLAIN}')"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# -- references and identifiers: places from lengths, windows cut from the text ------------------------------------------------

_ENDS = ", ".join(f"{{'e': length(regexp_extract(near, '(?s)^.*\\b(?:{p})\\b')), 's': {len(t)}, 't': '{t}'}}" for t, p in ask.TYPES.items())
REFS = rf"""{ASKED}, rf as (select qid, {_FOLDED} f from asked), rm as (select qid, f, regexp_extract_all(f, '{ask.NUMBERED}') m, regexp_split_to_array(f, '{ask.NUMBERED}') b from rf),
ri as (select *, unnest(range(1, len(m) + 1)) i from rm), rp as (select qid, i, m[i] raw, f, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint p from ri),
rn as (select qid, i, raw, substring(f, greatest(p - 30, 0) + 1, least(p, 30) + length(raw) + 5) near, split_part(raw, '/', 2)::bigint yy from rp),
rt as (select qid, i, split_part(raw, '/', 1)::bigint number, case when yy < 80 then yy + 2000 when yy < 100 then yy + 1900 else yy end "year", list_max([{_ENDS}]) best from rn),
refs as (select qid, case when best.e > 0 then best.t end ref_type, number, "year", min(i) i from rt where "year" between 1980 and 2100 group by all)"""


@query(f"""with {REFS} select qid, row_number() over (partition by qid order by i) rank, ref_type, number, "year" from refs""")
def question_references(t):
    """The references that questions name, each with the type nearest before it."""
    each = _asked(t).select("qid", F.posexplode(ask.references("text")).alias("i", "r"))
    return each.select("qid", (F.col("i") + 1).cast("long").alias("rank"), "r.ref_type", "r.number", "r.year")


KEYED = REFS + r""", cr as (select qid, unnest(regexp_split_to_array("text", '[^\p{L}\p{N}_\s/-]+')) r from asked), cp as (select qid, list_filter(regexp_split_to_array(r, '[\s/-]+'), lambda x: x <> '') p from cr), ci as (select qid, p, unnest(range(1, len(p) + 1)) i from cp),
cj as (select qid, p, i, unnest(range(1, 6)) j from ci where regexp_full_match(p[i], '[A-Za-z]{3,}')), cw as (select qid, p[i:i + j] w from cj where i + j <= len(p)),
keyed as (select qid, 'code' kind, lower(array_to_string(w, '/')) as "key" from cw where len(list_filter(w, lambda s: regexp_full_match(s, '(19|20)[0-9]{2}'))) > 0 and len(list_filter(w, lambda s: not regexp_full_match(s, '[A-Za-z0-9]+'))) = 0
union select qid, 'code', lower(unnest(regexp_extract_all("text", '\b([0-9]{2}[Ii][0-9]{3,4})\b', 1))) from asked union select qid, 'bdns', unnest(regexp_extract_all("text", '(?i)\bbdns\b[^0-9]{0,20}?([0-9]{5,7})\b', 1)) from asked
union select qid, 'ref', unnest(regexp_extract_all("text", '\b(20[0-9]{2}/[0-9]{3,5})\b', 1)) from asked union select qid, 'norm', ref_type || '/' || number || '/' || "year" from refs where ref_type is not null)"""


def _keyed(t):
    return _asked(t).select("qid", F.explode(ask.identifiers("text")).alias("k")).select("qid", "k.kind", "k.key")


@query(f'with {KEYED} select qid, kind, "key" from keyed')
def question_identifiers(t):
    return _keyed(t)


@query(f"""with {KEYED}, {IDS}, met as (select distinct k.qid, k.kind, k."key", i.doc_id from keyed k join ids i on i.id_kind = k.kind and i.id_key = k."key"), few as (select distinct qid, doc_id from met qualify count(*) over (partition by qid, kind, "key") <= 6)
select f.qid, f.doc_id, row_number() over (partition by f.qid order by p.issue_date desc, f.doc_id) rank from few f join parts p using (doc_id)""")
def question_pins(t):
    """Documents that the codes of questions pin: whatever a question may mean by a code, the kept identifiers decide."""
    parts = _parts(t)
    return corpus.identifier_pins(_keyed(t).withColumnsRenamed({"kind": "id_kind", "key": "id_key"}), corpus.identifiers(parts), parts)


# -- phrases and terms: stretches by windows over one row a word ----------------------------------------------------------------

_CONN, _STOP = _in(ask.CONNECTORS), _in(ask.STOP)
GENERIC, WEAK, SHORT = ("importe", "plan", "plazo", "with", "that"), ("that", "dice"), ("ley",)
_KEEP = r"(length(w) >= 4 or regexp_matches(w, '[0-9]'))"
_GOOD = rf"""length(p) >= 6 and len(string_split(p, ' ')) >= 2 and len(list_filter(string_split(p, ' '), lambda w: length(w) = 1 and not regexp_matches(w, '[0-9]'))) = 0
and (regexp_matches(p, '[0-9]') or len(list_filter(string_split(p, ' '), lambda w: w not in {_CONN} and w not in {_in(WEAK)})) > 0)"""
PHRASED = rf"""{ASKED}, wl as (select qid, regexp_extract_all("text", '{_TOK}') tok from asked), ws as (select qid, unnest(range(1, len(tok) + 1)) i, unnest(tok) raw from wl), wo as (select *, lower(raw) w, regexp_matches(raw, '^\p{{Lu}}|[0-9]') named from ws),
wa as (select *, w in {_CONN} conn, w not in {_CONN} and {_KEEP} and w not in {_STOP} content from wo),
na as (select *, sum((not named and not conn)::int) over (partition by qid order by i) island from wa), nb as (select *, min(case when named then i end) over (partition by qid, island) head from na where named or conn),
nr as (select qid, min(i) o, string_agg(w, ' ' order by i) p from nb where i >= head group by qid, island),
ca as (select *, sum((not content and not conn)::int) over (partition by qid order by i) island from wa), cb as (select *, case when content then row_number() over (partition by qid, island, content order by i) - 1 end c from ca where content or conn),
cc as (select a.qid, a.i o, b.i j, a.island from cb a join cb b on a.qid = b.qid and a.island = b.island and a.c < b.c and b.c <= a.c + 2 and a.c // 5 = b.c // 5 where a.content and b.content qualify row_number() over (partition by a.qid order by a.i, b.i) <= 8),
cd as (select cc.qid, o, j, string_agg(w, ' ' order by i) p from cc join cb on cb.qid = cc.qid and cb.i between cc.o and cc.j group by all),
qa as (select qid, regexp_extract_all("text", '"([^"]+)"', 1) x from asked), qb as (select qid, unnest(range(1, len(x) + 1)) o, unnest(x) p from qa),
every as (select qid, {{'k': 1, 'o': o, 'j': 0}} pl, trim(regexp_replace(lower(p), '[ \t\n\r\f\v]+', ' ', 'g')) p from qb union all select qid, {{'k': 2, 'o': o, 'j': 0}}, p from nr union all select qid, {{'k': 3, 'o': o, 'j': j}}, p from cd),
phrased as (select qid, p, min(pl) pl from every where {_GOOD} group by 1, 2)"""


@query(f"""with {PHRASED} select asked.qid, string_agg(p, '|' order by pl) phrases, count(p) many from asked left join phrased using (qid) group by 1""")
def question_phrases(t):
    found = ask.phrases("text", weak=WEAK)
    rows = _asked(t).select("qid", found.alias("p"))
    return rows.select("qid", F.when(F.size("p") > 0, F.array_join("p", "|")).alias("phrases"), F.size("p").cast("long").alias("many"))


_CAP = r"regexp_matches(raw, '^\p{Lu}|^[dDlL]''\p{Lu}')"


@query(rf"""with {ASKED}, wl as (select qid, regexp_extract_all("text", '{_TOK}') tok from asked), ws as (select qid, unnest(range(1, len(tok) + 1)) i, unnest(tok) raw from wl), wo as (select *, lower(raw) w, {_CAP} cap from ws),
na as (select *, sum((not cap and w not in {_CONN})::int) over (partition by qid order by i) island from wo), nb as (select *, min(case when cap and w not in {_STOP} then i end) over (partition by qid, island) head from na where cap or w in {_CONN}),
nr as (select qid, min(i) o, string_agg(w, ' ' order by i) entity from nb where i >= head group by qid, island having sum(cap::int) >= 2), d as (select qid, entity, min(o) o from nr group by 1, 2)
select qid, row_number() over (partition by qid order by o) rank, entity from d qualify row_number() over (partition by qid order by o) <= 6""")
def question_entities(t):
    each = _asked(t).select("qid", F.posexplode(ask.entities("text")).alias("i", "entity"))
    return each.select("qid", (F.col("i") + 1).cast("long").alias("rank"), "entity")


_PAIR = """'(' || (select string_agg('"' || p || '"', ' OR ' order by o) from pn where pn.qid = b.qid and o <= 2) || ')' || coalesce(' (' || (select string_agg(w, ' OR ' order by r) from an where an.qid = b.qid and r <= 2) || ')', '')"""
QUERIES = rf"""{PHRASED}, pn as (select *, row_number() over (partition by qid order by pl) o from phrased), pw as (select qid, unnest(string_split(p, ' ')) w from phrased), pc as (select qid, w, count(*) n from pw where w not in {_CONN} group by 1, 2),
pr as (select *, row_number() over (partition by qid order by n desc, length(w) desc, w) r from pc qualify row_number() over (partition by qid order by n desc, length(w) desc, w) <= 4),
tk as (select qid, w, min(i) i from wo where {_KEEP} and w not in {_STOP} group by 1, 2), ta as (select qid, w, min(i) i from wo where ({_KEEP} or w in {_in(SHORT)}) and w not in {_STOP} and w not in {_in(WEAK)} group by 1, 2),
av as (select ta.qid, ta.w, length(ta.w) + case when ta.w in {_in(GENERIC)} then -1 else 2 end + case when regexp_matches(ta.w, '[0-9]') then 2 else 0 end + case when ta.w in {_in(SHORT)} then 1 else 0 end + case when pc.w is not null then 2 else 0 end v from ta left join pc using (qid, w)),
an as (select *, row_number() over (partition by qid order by v desc, w) r from av qualify row_number() over (partition by qid order by v desc, w) <= 3),
sp as (select qid, 1 k, o, '"' || p || '"' x from pn union all select qid, 2, i, w from tk where w not in {_in(GENERIC)}), sn as (select qid, count(*) n from sp group by 1),
gn as (select tk.*, row_number() over (partition by qid order by w in {_in(WEAK)}, length(w) desc, i) o from tk where w in {_in(GENERIC)}), al as (select * from sp union all select gn.qid, 3, gn.o, gn.w from gn left join sn using (qid) where gn.o <= case when sn.n > 0 then 2 else 4 end),
br as (select qid, string_agg(x, ' OR ' order by k, o) broad from (select * from al qualify row_number() over (partition by qid order by k, o) <= 8) group by 1), b as (select a.qid, coalesce(br.broad, a."text") broad from asked a left join br using (qid)),
st as (select b.qid, broad, (select count(*) from pn where pn.qid = b.qid) phrases, (select count(*) from pr where pr.qid = b.qid) words, (select string_agg(w, ' ' order by r) from pr where pr.qid = b.qid) ranked, (select count(*) from an where an.qid = b.qid) anchors, (select string_agg(w, ' ' order by r) from an where an.qid = b.qid) anchored, {_PAIR} pair from b),
sx as (select qid, broad, case when phrases = 0 then case when anchors >= 2 then anchored end when words >= 2 then ranked else pair end strict from st), queried as (select qid, broad, nullif(strict, broad) strict from sx)"""


@query(f"with {QUERIES} select * from queried")
def question_queries(t):
    """Broad and strict queries of every question."""
    return lexical_queries(_asked(t).select("qid", "text", F.lit(None).cast("array<string>").alias("keywords")), GENERIC, WEAK, SHORT)


@query(rf"""with {ASKED}, x as (select qid, {_FOLDED} f from asked) select qid, v.lang proposed_by, v.phrase added from x, (values ('es', 'ayudas rurales'), ('es', 'fondo municipal'), ('en', 'water network'), ('en', 'of the')) v(lang, phrase) where not contains(lower((select "text" from asked a where a.qid = x.qid)), v.phrase) and v.phrase <> 'of the'""")
def question_expansion(t):
    """Which of the phrases proposed for every question add something to it."""
    proposed = {"ayudas rurales": "es", "fondo municipal": "es", "water network": "en", "of the": "en"}
    found = ask.expansion_terms("text", F.array().cast("array<string>"), F.array(*map(F.lit, proposed)), generic=GENERIC)
    by = F.create_map(*(F.lit(x) for pair in proposed.items() for x in pair))
    return _asked(t).select("qid", F.explode(found["phrases"]).alias("added")).select("qid", by[F.col("added")].alias("proposed_by"), "added")


# -- clauses, fields, windows -----------------------------------------------------------------------------------------------

CUES = {"amount": "importe", "deadline": "plazo", "who": "requisit", "length": "duracion"}
SUBJECT, MARKERS = r"\b(?:beca|ayudas?|orden)\b", r"\b(?:cual|que)\b"
_HITS = " + ".join(f"contains(low, '{p}')::int" for p in CUES.values())
MULTI = rf"""{REFS}, fl as (select a.qid, a."text", {_FOLDED} low from asked a), fm as (select qid, "text", low, [x for x in [{', '.join(f"case when contains(low, '{p}') then '{f}' end" for f, p in CUES.items())}] if x is not null] fields, (select count(*) from refs where refs.qid = fl.qid) n from fl),
multi as (select qid, "text", low, fields, regexp_matches(low, '{SUBJECT}') and len(fields) >= 2 and n < 2 several from fm)"""
_IDENTITY = rf"""ia as (select qid, regexp_split_to_array(regexp_replace("text", '\b[0-9]{{1,2}}\)\s*[^,.;:?()]*', ' ', 'g'), '[.?!;:]') c from multi), ib as (select qid, unnest(range(1, len(c) + 1)) i, regexp_replace(unnest(c), '^[ ,¿¡«»"''\n]+|[ ,¿¡«»"''\n]+$', '', 'g') c from ia),
ic as (select qid, i, c, translate(lower(c), '{MARKED}', '{PLAIN}') low from ib where c <> ''), id as (select qid, i, c, {_HITS} hits, regexp_matches(low, '{MARKERS}') mark, regexp_matches(low, '{SUBJECT}') subj from ic),
ident as (select qid, trim(string_agg(c, ' ' order by i)) k from id where not (hits >= 2 or hits = 1 and mark and not subj) group by 1)"""


@query(f"""with {MULTI}, {_IDENTITY} select m.qid, array_to_string(fields, ',') fields, several, md5(case when length(k) >= 15 then k else '' end) identity from multi m left join ident using (qid)""")
def question_fields(t):
    """The fields that questions ask, whether they ask several of one subject, and what is left as its identity."""
    rows = _asked(t)
    said = F.md5(ask.identity_query("text", CUES, SUBJECT, MARKERS).cast("binary"))
    return rows.select("qid", F.array_join(ask.asked_fields("text", CUES), ",").alias("fields"), ask.multi_field("text", CUES, SUBJECT).alias("several"), said.alias("identity"))


_PARTS = r"""list_filter(list_transform(regexp_split_to_array("text", '[?;.]'), lambda p: trim(regexp_replace(p, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda p: length(p) >= 6 and len(string_split(p, ' ')) >= 2)"""


@query(rf"""with {MULTI}, {_IDENTITY}, p as (select m.qid, "text", case when several then [case when length(k) >= 15 then k else '' end] when (length("text") - length(replace("text", '?', '')) > 1 or contains("text", ';') or regexp_matches(lower("text"), ' [yi] ')) and len({_PARTS}) >= 2 then {_PARTS} else [] end x from multi m left join ident using (qid)),
u as (select qid, 0 i, "text" facet from p union all select qid, unnest(range(1, len(x) + 1)), unnest(x) from p), d as (select qid, min(i) i, min_by(facet, i) facet from u where i = 0 or trim(facet) <> '' group by qid, lower(trim(facet)))
select qid, row_number() over (partition by qid order by i) rank, md5(facet) digest from d qualify row_number() over (partition by qid order by i) <= 3""")
def question_facets(t):
    """What each question is searched by: itself, then its identity or its parts."""
    each = _asked(t).select("qid", F.posexplode(ask.facets("text", CUES, SUBJECT, MARKERS)).alias("i", "facet"))
    return each.select("qid", (F.col("i") + 1).cast("long").alias("rank"), F.md5(F.col("facet").cast("binary")).alias("digest"))


_EDGE = r"[\s¿?¡!.,;:]+"
_CUT = lambda h: rf"regexp_replace(regexp_split_to_array(regexp_replace({h}, '^{_EDGE}|{_EDGE}$', '', 'g'), '[?;.]')[1], '^{_EDGE}|{_EDGE}$', '', 'g')"
_MEANT = lambda h: rf"len(list_distinct(list_filter(list_transform(regexp_extract_all({h}, '{_TOK}'), lambda w: lower(regexp_replace(w, '^[''/-]+|[''/-]+$', '', 'g'))), lambda w: w <> '' and (length(w) >= 4 or regexp_matches(w, '[0-9]')) and w not in {_STOP})))"


@query(rf"""with {ASKED}, s as (select qid, string_split(regexp_replace(trim("text"), '(?i)(\s(?:y|i|and)\s)', chr(1) || '\1' || chr(1), 'g'), chr(1)) x from asked), i as (select qid, x, unnest(range(3, len(x) + 1, 2)) i from s),
k as (select qid, any_value(x) x, coalesce(min(case when regexp_matches(translate(lower(x[i]), '{MARKED}', '{PLAIN}'), '^[\s¿¡]*(?:{'|'.join(ask.INTERROGATIVES)})\b') then i end), max(i)) i from i group by 1),
h as (select qid, {_CUT("array_to_string(x[1:i - 2], '')")} l, {_CUT("array_to_string(x[i:], '')")} r from k)
select qid, md5(l) first_half, md5(r) second_half from h where {_MEANT('l')} >= 2 and {_MEANT('r')} >= 2 and (regexp_matches(r, '[0-9]') or regexp_matches(r, '\s\p{{Lu}}'))""")
def question_clauses(t):
    """The halves of compound questions."""
    rows = _asked(t).select("qid", ask.clauses("text").alias("c")).where(F.size("c") == 2)
    digest = lambda i: F.md5(F.get("c", F.lit(i)).cast("binary"))
    return rows.select("qid", digest(0).alias("first_half"), digest(1).alias("second_half"))


@query(rf"""with {ASKED}, r as (select qid, conv_id, date '2024-01-01' + (conv_id % 365)::int today, case when not regexp_matches("text", '\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b') then regexp_extract(lower("text"), '\b(last week|recent)(?:ly)?\b', 1) else '' end phrase, regexp_matches(lower("text"), '\bbeca\b') grant_hint from asked),
w as (select *, case phrase when 'last week' then date_trunc('week', today)::date - 7 when 'recent' then today - 6 when '' then date '2024-06-01' + (conv_id % 50)::int end s, case phrase when 'last week' then date_trunc('week', today)::date - 1 when 'recent' then today when '' then date '2024-06-20' end u from r)
select qid, nullif(phrase, '') phrase, least(s, u)::date since, greatest(s, u)::date "until", grant_hint from w""")
def question_windows(t):
    """The filters of each question: its own window where it names one, else given bounds, put in order; and a category's hint."""
    day = lambda first, n: F.date_add(F.lit(first).cast("date"), F.pmod("conv_id", F.lit(n)).cast("int"))
    w = ask.window("text", day("2024-06-01", 50), F.lit("2024-06-20").cast("date"), day("2024-01-01", 365))
    rows = _asked(t).select("qid", ask.relative_phrase("text").alias("phrase"), w.alias("w"), ask.has_hint("text", "beca").alias("grant_hint"))
    return rows.select("qid", "phrase", "w.since", "w.until", "grant_hint")
