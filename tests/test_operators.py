"""Operators on rows of our own, where the tables have no such cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import corpus, etl, evidence, fusion, graph, intervals, lexical
from folioscope.operators import evalmetrics as ev
from folioscope.operators.html import page_text
from folioscope.operators.references import find_references


def ranked(spark, *lists):
    return [spark.createDataFrame([(1, d, i) for i, d in enumerate(x, 1)], "qid long, doc_id long, rank long") for x in lists]


def ids(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


# -- fusion -------------------------------------------------------------------------------------------------------------


def test_one_vote_at_rank_one(spark):
    a, b = ranked(spark, [7], [7])
    assert fusion.rrf([a, ranked(spark, [8])[0]]).where("doc_id = 7").first()["score"] == pytest.approx(1 / 61, abs=1e-12)
    assert fusion.rrf([a, b]).first()["score"] == pytest.approx(2 / 61, abs=1e-12)


def test_fusion_ignores_the_order_of_equal_sources_and_skips_weight_zero(spark):
    a, b, c = ranked(spark, [1, 2, 3], [3, 4], [9])
    assert ids(fusion.rrf([a, b])) == ids(fusion.rrf([b, a]))
    assert 9 not in ids(fusion.rrf([a, b, c], [1, 1, 0]))
    assert ids(fusion.rrf([ranked(spark, [5, 6, 5])[0]], limit=1)) == [5, 6]


def sequential_merge(primary, secondary, limit, ratio):
    if not primary or not secondary:
        return (primary or secondary)[:limit]
    budget = max(5, int(limit * ratio))
    out = list(dict.fromkeys(primary[: max(1, limit - budget)]))
    extra = [d for d in dict.fromkeys(secondary) if d not in out][: min(budget, max(0, limit - len(out)))]
    out += extra
    return out + [d for d in dict.fromkeys(primary[max(1, limit - budget) :]) if d not in out][: limit - len(out)]


def test_budget_merge_against_the_sequential_definition(spark):
    r = random.Random(2)
    cases = [([], [1, 2]), ([1, 1, 2], []), ([1, 2], [2, 1])] + [([r.randint(0, 30) for _ in range(25)], [r.randint(0, 30) for _ in range(25)]) for _ in range(4)]
    for p, s in cases:
        a, b = ranked(spark, p, s)
        assert ids(fusion.budget_merge(a, b, 12, 0.3)) == sequential_merge(p, s, 12, 0.3)


def sequential_quota(sources, cap):
    out = []
    for s, take in sources:
        new = [d for d in dict.fromkeys(s) if d not in out]
        out += (new if take is None else new[:take])[: cap - len(out)]
    for s, _ in sources:
        out += [d for d in dict.fromkeys(s) if d not in out][: cap - len(out)]
    return out


def test_quota_merge_against_the_sequential_definition(spark):
    r = random.Random(3)
    for _ in range(3):
        lists = [[r.randint(0, 15) for _ in range(10)] for _ in range(3)]
        dfs = ranked(spark, *lists)
        takes = [3, 2, None]
        assert ids(fusion.quota_merge(list(zip(dfs, takes, strict=True)), 9)) == sequential_quota(list(zip(lists, takes, strict=True)), 9)


def test_anchors_leave_a_pool_that_has_them(spark):
    lane, full = ranked(spark, [1, 2, 3], [1, 2, 3])
    full = full.withColumn("score", 1 / F.col("rank"))
    assert ids(fusion.semantic_anchors(full, full, [lane])) == [1, 2, 3]
    assert ids(fusion.semantic_anchors(full.where("rank <= 2"), full, [lane])) == [1, 2, 3]


def test_margin(spark):
    f = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 0.5), (2, 1, 1, 0.0)], "qid long, doc_id long, rank long, score double")
    assert {r["qid"]: r["margin"] for r in fusion.margin_ratio(f).collect()} == {1: 0.5, 2: 0.0}


def test_read_set_skips_oversized_and_stops_at_the_budget(spark):
    f = spark.createDataFrame([(1, i, i, n) for i, n in enumerate([10, 999, 20, 80, 5], 1)], "qid long, doc_id long, rank long, size long")
    assert ids(fusion.read_set(f, "size", 100, 60, 9)) == [1, 3]


def test_strict_winner_needs_no_tie(spark):
    f = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 3, 2.0), (2, 4, 1.0)], "qid long, doc_id long, score double")
    assert [r["doc_id"] for r in fusion.strict_winner(f).collect()] == [3]


# -- text ---------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    s = F.col("s")
    assert one(spark, tx.fold(s), s="ÀçÑü L·L") == "acnu l·l"
    assert one(spark, tx.numbers(s), s="1.366,740 euros, 4) 25 y 25,00") == ["1366.74", "4", "25"]
    assert one(spark, tx.normal_code(s), s=" ABC - 2024//7 ") == "abc/2024/7"
    assert one(spark, tx.occurrences(s, "aa"), s="aaaaa") == 2
    assert one(spark, tx.strip_artifacts(s), s="Yes [doc_12] and (doc 3, doc 4).") == "Yes and."
    assert one(spark, tx.sentence_parts(s), s="What is due? And when is it due; x") == ["What is due", "And when is it due"]
    assert one(spark, tx.sentence_parts(s), s="Only one part here") == []
    assert one(spark, tx.list_like(s), s="- a\n- b\n- c") and not one(spark, tx.list_like(s), s="plain")
    assert [one(spark, tx.full_year(F.lit(y))) for y in (24, 95, 1999)] == [2024, 1995, 1999]
    assert one(spark, tx.guess_language(s, {"es": ["el", "los"], "va": ["els", "dels"]}, "es"), s="Els dels pobles") == "va"
    assert one(spark, tx.units_claimed(s, "euros|€"), s="unos 1.500 euros o 20 dias") == ["1500"]
    assert one(spark, tx.shorten(s, 9), s="alpha beta gamma") == "alpha…"


def test_first_json():
    assert evidence.first_json('<think>{"a": 0}</think> x {bad} ```{"b": {"c": [1]}}``` {"d": 2}') == '{"b": {"c": [1]}}'
    assert evidence.first_json("none {") is None and evidence.first_json(None) is None


def test_window_keeps_late_terms():
    text = "head " * 100 + "filler " * 200 + "the amount is 500 " + "tail " * 200
    got = evidence.windowed(text, ["amount"], 300)
    assert "amount" in got and len(got) <= 300 and evidence.JOIN in got
    assert evidence.windowed(text, ["absent"], 300) == text[:300] and evidence.windowed("short", ["x"], 300) == "short"


def test_page_text_drops_marked_nodes():
    html = "<html><head><title>Title</title></head><body><div class='main-Menu'><p>gone <b>too</b></p></div><nav>no</nav><p>kept &amp; whole<br>ab</p><script>x()</script></body></html>"
    assert page_text(html) == "Title\nkept & whole"


def test_references():
    types, kinds = corpus.NORM_TYPES, corpus.REFERENCE_KINDS
    text = "Se modifica el Decreto 12/2020. Vista la Orden 7/99 y la Ley 5/1850; 12/34/2020."
    plain = lambda t, n, y, k: (t, n, y, k, None, None, None)
    assert find_references("Decreto 1/2021", text + " Decreto 1/2021", types, kinds, 20, 40) == [plain("decreto", 12, 2020, "modifica"), plain("orden", 7, 1999, "cita")]
    assert find_references("Orden 1/2021", "el Decreto 1/2021 y el 9/2020", types, kinds, 20, 15) == [plain("decreto", 1, 2021, "cita")], "the same number of another type is another norm; a number without a type is none"
    dated = "según la Resolució de 3 d'abril de 2024, de la Conselleria de Norte, y el 5 de mayo de 2024; Resolución de 7 de MARZO"
    assert find_references("Resolución de 7 de marzo de 2024", dated, types, kinds, 5, 40) == [("resolucion", None, 2024, "cita", 3, 4, "Conselleria de Norte"), ("resolucion", None, None, "cita", 7, 3, None)]


def test_resolution_needs_one_candidate(spark):
    docs = spark.createDataFrame([(1, "Decreto 5/2020, a"), (2, "Orden 6/2020, b"), (3, "Orden 6/2020, c")], "doc_id long, title string")
    refs = spark.createDataFrame([(9, "decreto", 5, 2020, "cita", None, None, None), (9, "orden", 6, 2020, "cita", None, None, None), (1, "decreto", 5, 2020, "cita", None, None, None), (3, "orden", 6, 2020, "cita", None, None, None)], corpus._FOUND)
    got = {(r["doc_id"], r["number"]): r["target"] for r in corpus.resolve_references(refs, docs).collect()}
    assert got == {(9, 5): 1, (9, 6): None, (1, 5): None, (3, 6): 2}


def test_resolution_by_issuer_and_topic(spark):
    head = "Resolución de 5 de marzo de 2024"
    docs = [(1, f"{head}, becas premios", "Conselleria A"), (2, f"{head}, becas riego", "Conselleria A"), (3, f"{head}, otras", "Conselleria B"), (9, "Plan de becas y riego", None), (8, "Plan de otras", None)]
    refs = [(9, "resolucion", None, 2024, "cita", 5, 3, by) for by in ("conselleria b", "Conselleria A", "Conselleria C", None)] + [(8, "resolucion", None, 2024, "cita", 5, 3, "Conselleria A")]
    got = corpus.resolve_references(spark.createDataFrame(refs, corpus._FOUND), spark.createDataFrame(docs, "doc_id long, title string, issuer string")).collect()
    assert {(r["doc_id"], r["issuer"]): r["target"] for r in got} == {(9, "conselleria b"): 3, (9, "Conselleria A"): 2, (9, "Conselleria C"): None, (9, None): None, (8, "Conselleria A"): None}


def test_chunk_windows_join_a_short_tail(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = corpus.chunk_windows(spark.createDataFrame([(1, text), (2, "  "), (3, "a b")], "doc_id long, text string"), 10, 2, 9).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["n_words"]) for r in got] == [(1, 0, 10), (1, 1, 10), (1, 2, 9), (3, 0, 2)]


# -- search -------------------------------------------------------------------------------------------------------------


def test_query_syntax():
    q = lexical.parse_query('plan "public works" cats or dogs -old')
    assert q == lexical.Query(all=("plan",), phrases=(("public", "works"),), any=(("cats", "dogs"),), none=("old",))


def test_cover_rank_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b x x a"), (2, "a x b"), (3, "a a")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lexical.cover_rank(lexical.postings(docs), ["a", "b"]).collect()}
    assert got == {1: pytest.approx(1 / 2 + 1 / 4), 2: pytest.approx(1 / 3)}


# -- tables over time ---------------------------------------------------------------------------------------------------


def test_ranges_merge_and_stay_merged(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([("k", d(1), d(3)), ("k", d(4), d(5)), ("k", d(2), d(2)), ("k", d(9), d(8)), ("k", d(7), d(9))], "k string, start date, end date")
    once = intervals.coalesce_ranges(rows, "k")
    want = [("k", d(1), d(5)), ("k", d(7), d(9))]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, intervals.coalesce_ranges(once, "k").collect()))


def test_missing_ranges(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(1, d(1), d(9), d(3), d(5)), (2, d(4), d(4), d(3), d(5)), (3, d(1), d(2), None, None), (4, d(1), d(2), d(5), d(6))], "i int, start date, end date, have_min date, have_max date")
    assert sorted((r["i"], r["lo"].day, r["hi"].day) for r in intervals.missing_ranges(rows).collect()) == [(1, 1, 2), (1, 6, 9), (3, 1, 2), (4, 1, 2)]


def test_families_are_transitive_and_keep_the_newest(spark):
    pairs = spark.createDataFrame([(0, i, i + 1) for i in range(1, 12)] + [(0, 30, 31), (1, 12, 30)], "qid long, a long, b long")
    every = graph.families(pairs, "qid")
    assert {(r["qid"], r["id"]): r["family"] for r in every.collect()} == {**{(0, i): 1 for i in range(1, 13)}, (0, 30): 30, (0, 31): 30, (1, 12): 12, (1, 30): 12}
    fam = every.where("qid = 0")
    dates = fam.select("id", F.when(F.col("id") != 30, F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))).alias("date"))
    assert sorted(r["id"] for r in graph.stale_members(fam, dates, "qid", F.col("id") == 3).collect()) == [1, 2, *range(4, 12)]
    assert graph.stale_members(fam, dates, "qid", most=3).collect() == []


def test_veto(spark):
    v = lambda a, b: one(spark, graph.veto(F.col("a"), F.col("b"), ["convoca", "corrige"], r"[a-z]+/\d{4}"), a=a, b=b)
    assert v("Convoca ayudas", "Corrige ayudas") and v("abc/2024 x", "abd/2024 x") and not v("Convoca abc/2024", "convoca ABC/2024") and not v("a", "b")


def test_merge_tags(spark):
    got = one(spark, etl.merge_tags(F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(True)), F.create_map(F.lit("b"), F.lit(False), F.lit("c"), F.lit(True))))
    assert got == {"a": True, "b": False, "c": True}


def test_match_key_precedence(spark):
    key = etl.match_key(*(F.col(c) for c in ("h", "p", "r", "t", "k", "s", "raw")))
    base = {"h": "", "p": "", "r": "", "t": "", "k": "x", "s": "y", "raw": "{}"}
    got = [one(spark, key, **base | extra) for extra in ({"h": "u", "p": "v"}, {"p": "v"}, {"r": "1", "t": "T"}, {"t": "T"}, {})]
    assert got[:4] == ["html:u", "pdf:v", "ref|1|T", "title|T|x|y"] and got[4].startswith("raw:")


def test_resolved_state(spark):
    state = spark.createDataFrame([("a", 3, "x", False), ("b", 1, "y", False)], "k string, attempts long, last_error string, resolved boolean")
    got = {r["k"]: (r["attempts"], r["resolved"]) for r in etl.mark_resolved(state, spark.createDataFrame([("a",)], "k string"), ["k"]).collect()}
    assert got == {"a": (0, True), "b": (1, False)}


# -- measures -----------------------------------------------------------------------------------------------------------


def test_measures(spark):
    ranked_, gold = F.array(*map(F.lit, [5, 6, 7])), F.array(F.array(F.lit(6), F.lit(7)), F.array(F.lit(9)))
    assert one(spark, ev.recall_at(ranked_, gold, 2)) == 0 and one(spark, ev.recall_at(ranked_, gold, 3)) == 1
    assert one(spark, ev.satisfying_rank(ranked_, gold)) == 3
    assert one(spark, ev.floor_percentile(F.sequence(F.lit(1), F.lit(10)), 95)) == 9
    assert one(spark, evidence.valid_citations(F.array(F.lit(9), F.lit(2)), F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))) == [2]
    assert one(spark, evidence.valid_citations(F.array(F.lit(9)), F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))) == [1]
    assert one(spark, evidence.unsupported_numbers(F.lit("500,00 y 7"), F.lit("son 500 euros"))) == ["7"]


def test_diverse_chunks_pick_new_targets(spark):
    rows = [(1, 0, "alpha alpha"), (1, 1, "alpha beta"), (1, 2, "gamma"), (1, 3, "none"), (2, 0, "none")]
    got = evidence.diverse_chunks(spark.createDataFrame(rows, "doc_id long, chunk_index long, text string"), ["alpha", "beta", "gamma"], 3)
    assert [(r["doc_id"], r["chunk_index"]) for r in got.orderBy("pick").collect()] == [(1, 1), (1, 2)]


def test_number_claims_of_every_document(spark):
    """Numbers of any length, against decimals of any length."""
    import decimal
    import re

    texts = ["none", "7 and 1.366,740", "0" * 20 + "12", "9" * 18 + ",995", "9" * 19 + ",995", "8" + "9" * 24 + ",999 5", "1" * 40 + " 1" + "0" * 30 + ",50 3", "12" * 15 + ",004", "5" * 20 + ".123,10"]
    def canonical(raw):
        with decimal.localcontext(prec=99, rounding=decimal.ROUND_HALF_UP):
            x = f"{decimal.Decimal(raw.replace('.', '').replace(',', '.')).quantize(decimal.Decimal('0.01')):f}"
        return x.rstrip("0").rstrip(".")

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", tx.numbers("text").alias("n")).collect()}
    assert got == {i: list(dict.fromkeys(map(canonical, re.findall(tx.NUMBER, t)))) for i, t in enumerate(texts)}


def test_quantised_components_keep_their_sign(spark):
    from folioscope.functions.vector import quantised

    x = one(spark, quantised("v"), v=[-2e-7, 2e-7, -0.0, -1.5000005, 0.5, float("nan"), float("-inf")])
    assert [repr(c) for c in x] == ["-0.0", "0.0", "-0.0", "-1.500001", "0.5", "nan", "-inf"]


def test_resolution_of_many_that_share_a_key(spark):
    """20,000 sources against 20,000 documents of one date and issuer: 400 million pairs, were they paired."""
    import time

    head, n = "Resolución de 5 de marzo de 2024", 20_000
    word = F.when(F.col("id") == 7, "fallas").when(F.col("id") == 8, "riego").when(F.col("id") == 9, "riego").otherwise("becas")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{head}, "), word).alias("title"), F.lit("Conselleria A").alias("issuer"))
    more = spark.createDataFrame([(n, "Plan de fallas", None), (n + 1, "Plan de becas", None)], "doc_id long, title string, issuer string")
    ref = spark.createDataFrame([("resolucion", None, 2024, "cita", 5, 3, "Conselleria A")], ", ".join(corpus._FOUND.split(", ")[1:]))
    docs = docs.unionByName(more)
    began = time.time()
    got = corpus.resolve_references(docs.select("doc_id").crossJoin(ref), docs).where("target is not null").collect()
    # 8 and 9 share a word that no third has; each is the other's only one.
    assert sorted((r["doc_id"], r["target"]) for r in got) == [(8, 9), (9, 8), (n, 7)]
    assert time.time() - began < 60


def test_a_key_that_all_documents_have_meets_no_question(spark):
    """5,000 questions ask for a key of 40,000 documents: 200 million pairs, were they paired."""
    import time

    n = 40_000
    table = spark.range(n).select(F.lit("code").alias("id_kind"), F.lit("brand/2020").alias("id_key"), F.col("id").alias("doc_id"))
    rare = spark.createDataFrame([("code", "x/1", d) for d in range(6)] + [("code", "x/2", d) for d in range(7)], "id_kind string, id_key string, doc_id long")
    asked = spark.range(5_000).select(F.col("id").alias("qid"), F.lit("code").alias("id_kind"), F.lit("brand/2020").alias("id_key"))
    asked = asked.unionByName(spark.createDataFrame([(1, "code", "x/1"), (1, "code", "x/1"), (2, "code", "x/2")], "qid long, id_kind string, id_key string"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("issue_date"))
    began = time.time()
    got = corpus.identifier_pins(asked, table.unionByName(rare), docs).collect()
    assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in got) == [(1, i + 1, 5 - i) for i in range(6)]
    assert time.time() - began < 30


def test_many_documents_and_questions_of_one_reference(spark):
    from folioscope.operators.corpus import reference_lookup

    docs = [(i, f"Orden 7/2020, de {1 + i % 2} de enero") for i in range(9)] + [(50, "Decreto 8/2020, de 3 d'abril")]
    asks = [(1, "orden", 7, 2020, None, 1), (2, None, 7, 2020, 2, 1), (3, "decreto", 8, 2020, None, 5), (4, None, 8, 2020, 3, 4), (5, None, 8, 2020, 3, 0), (6, "orden", 8, 2020, None, 1)]
    asked = spark.createDataFrame(asks, "qid long, ref_type string, number int, year int, day int, month int")
    out = reference_lookup(asked, spark.createDataFrame(docs, "doc_id long, title string"), 3)
    want = [(1, 0, False), (1, 1, False), (1, 2, False), (2, 1, True), (2, 3, True), (2, 5, True), (3, 50, True), (4, 50, True)]
    assert sorted(map(tuple, out.collect())) == want
    # Documents of a reference become one row before questions meet them.
    assert "collect_list(doc_id" in out._jdf.queryExecution().toString()


def test_a_held_quote_is_not_looked_for_word_by_word(spark):
    from folioscope.operators.evidence import reground

    chunks = spark.createDataFrame([(1, 0, "alpha beta gamma"), (1, 1, "x alpha beta … gamma"), (1, 2, "delta")], "doc_id long, chunk_index long, text string")
    quotes = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "alpha … gamma"), (1, 2, "zz delta")], "doc_id long, ord long, quote string")
    out = reground(quotes, chunks)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "verbatim", 0), (1, 1, "stitched", 1), (1, 2, "nearest", 2)]
    # Of a chunk that holds the quote only the words with an ellipsis are looked for.
    assert "filter(filter(words" in out._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_vectors_and_chunks_shuffle_once(spark):
    from folioscope.operators.corpus import chunk_windows
    from folioscope.operators.features import hashed_vectors

    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "", "fr")], "doc_id long, text string, lang string")
    rows = chunk_windows(docs, more=("lang",))
    assert [tuple(r) for r in rows.select("doc_id", "text", "lang").collect()] == [(1, "one two three", "en")]
    out = hashed_vectors(rows, ["doc_id", "lang"], F.col("text"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
