"""Hand-made pools, evidence and answers."""

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import etl, evidence, lexical, pool


def lists(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, rank long")


def ordered(df, qid=0):
    """A question's documents by rank."""
    return [r["doc_id"] for r in df.where(F.col("qid") == qid).orderBy("rank").collect()]


def test_strict_search_leads_where_it_has_enough(spark):
    broad, title = lists(spark, [(q, d, d) for q in (0, 1) for d in range(1, 30)]), lists(spark, [(0, 90, 1), (1, 90, 1)])
    strict = lists(spark, [(0, 100 + d, d) for d in range(1, 11)] + [(1, 100 + d, d) for d in range(1, 3)])
    out = pool.lexical_lane(broad, strict, title, 12, least=10)
    assert ordered(out)[:7] == list(range(101, 108)) and ordered(out, 1)[:7] == list(range(1, 8))


def test_lanes_of_thin_questions_are_relaxed(spark):
    lane = lambda rows: [pool.Lane("a", lists(spark, rows), anchor=True), pool.Lane("b", lists(spark, [(q, 70 + q, 1) for q in (0, 1, 2)]), 0.8, only_below="a")]
    strict, relaxed = [(0, 1, 1), (1, 1, 1), *[(2, d, d) for d in range(1, 9)]], [(q, 200 + d, d) for q in (0, 1, 2) for d in range(1, 4)]
    questions = spark.createDataFrame([(0, "es"), (1, None), (2, "es")], "qid long, language string")
    out = pool.assemble(lane(strict), lane(relaxed), questions, least=3, ratio=0.0)
    assert set(ordered(out)) == {1, 70, 201, 202, 203} and set(ordered(out, 1)) == {1, 71} and set(ordered(out, 2)) == set(range(1, 9)), "only questions with a language and too few documents are relaxed; lane b counts only below the least"


def test_hops_append_and_protect(spark):
    start = lists(spark, [(q, d, d) for q in (0, 1) for d in range(1, 6)])
    by_name, facet = lists(spark, [(0, 3, 1), (0, 50, 2)]), lists(spark, [(0, 60, 1), (1, 60, 1), (1, 2, 2), (1, 61, 3)])
    covered = lists(spark, [(1, 1, 1), (1, 70, 2)])
    out, shield = pool.hop(start, [("reference", by_name), ("facet", facet), ("facet", covered)])
    assert ordered(out) == [1, 2, 3, 4, 5, 50] and ordered(out, 1) == [1, 2, 3, 4, 5, 60, 61]
    assert {tuple(r) for r in shield.collect()} == {(0, 3), (1, 2), (1, 1)}


def test_portal_and_named_targets(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1, False), (0, 2, 2, 1, True), (0, 3, 3, 0, True)], "qid long, hit long, place int, topic int, same_language boolean")
    assert [tuple(r) for r in pool.best_portal_hit(rows).collect()] == [(0, 2)]
    titles = spark.createDataFrame([(0, 1, "Ley de Vivienda Pública"), (0, 2, "Ley de vivienda"), (1, 1, "Ley de vivienda pública"), (1, 2, "vivienda y pública")], "qid long, doc_id long, title string")
    target = pool.named_target(F.array(F.lit("vivienda"), F.lit("publica")), F.col("title"))
    assert [tuple(r) for r in pool.forced_target(titles.withColumn("target", target)).collect()] == [(0, 1)], "an ambiguous question has none"


def test_unit_claims(spark):
    ask = lambda s: spark.range(1).select(evidence.unit_claims(F.lit(s), {"percent": "%|percent", "currency": "€|euro"}).alias("u")).first()["u"]
    assert ask("pays 1.500,50 euros in all, and beyond that 12 %").asDict() == {"percent": ["12"], "currency": ["1500.5"]}
    assert ask("440 euros.\n4) hours").asDict() == {"percent": [], "currency": ["440"]}, "list marks are no claims"
    assert ask("none").asDict() == {"percent": [], "currency": []}
    assert ask("7 far away from any unit at all, truly 5%").asDict() == {"percent": ["5"], "currency": []}


def test_answers_are_settled(spark):
    def ask(answer, cited, repaired=None, repaired_cited=None):
        row = (answer, cited, [1, 2], [2], "5 euros", repaired, repaired_cited)
        return evidence.settled(spark.createDataFrame([row], "answer string, cited array<int>, scope array<int>, evidence array<int>, source string, repaired string, repaired_cited array<int>")).first()

    assert ask("5 euros", [1])["outcome"] == "valid"
    fixed = ask("5 euros", [1, 9])
    assert (fixed["outcome"], fixed["cited"], fixed["initial"], fixed["final"]) == ("fixed", [1], ["out_of_scope"], [])
    assert ask("6 euros", [1])["outcome"] == "fallback"
    again = ask("6 euros", [1], "5 euros", [9])
    assert (again["outcome"], again["answer"], again["cited"]) == ("repaired", "5 euros", [2])
    assert ask("6 euros", [1], "7 euros", [1])["outcome"] == "fallback"


def test_gold_grows_until_signals_are_covered(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [1], [(1, ["a"]), (2, ["b"]), (3, ["b", "c"]), (4, ["c"])]), (["a"], [1], [(1, ["a"]), (2, ["a"])]), (["z"], [1], [(1, [])])], "r array<string>, g array<bigint>, c array<struct<doc_id:bigint,signals:array<string>>>")
    assert [r[0] for r in rows.select(evidence.augmented(F.col("r"), F.col("g"), F.col("c"))).collect()] == [[1, 3], [1], [1]]


def test_not_in_is_null_aware(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    keys = lambda *k: spark.createDataFrame([(v,) for v in k], "k int")
    left = lambda *k: sorted((r["x"] for r in etl.not_in(rows, "x", keys(*k), "k").collect()), key=str)
    assert left(1) == [2] and left(1, None) == [] and left() == [1, 2, None]


def test_rungs_of_the_word_search(spark):
    table = lexical.postings(spark.createDataFrame([(1, "casas rurales"), (2, "the casa")], "doc_id long, text string"), stop=("the",), stemmed=True)
    rung = lambda *ladder: sorted(map(tuple, lexical.fallback_search(list(ladder)).collect()))
    assert rung((table, ["cas", "rural"], True), (table, ["cas"], False)) == [(1, 0)]
    assert rung((table, ["cas", "none"], True), (table, ["cas", "the"], False)) == [(1, 1), (2, 1)]
    assert lexical.or_terms("l'ajuda d'habitatge per-a joves") == ["ajuda", "habitatge", "per-a", "joves"]


def test_labels(spark):
    names = {"call": "Calls", "resolucion": "Resolutions"}
    got = spark.createDataFrame([("  CALL",), ("Resolución",), ("x",), (None,)], "s string").select(tx.canonical_label(F.col("s"), names, "Other")).collect()
    assert [r[0] for r in got] == ["Calls", "Resolutions", "Other", "Other"]


def plain_cover(rows, targets, most):
    """Greedy cover by plain sets."""
    left, out = set(range(len(targets))), []
    rows = {c: [t.lower().count(x) for x in targets] for c, t in rows}
    while left and len(out) < most:
        keys = {c: (sum(1 for i in left if h[i]), sum(1 for n in h if n), sum(h), -c) for c, h in rows.items() if c not in out}
        best = max(keys, key=keys.get, default=None)
        if best is None or not keys[best][0]:
            break
        left -= {i for i, n in enumerate(rows[best]) if n}
        out.append(best)
    return out


def test_diverse_chunks_of_the_table_against_plain_sets(spark):
    from folioscope.operators.corpus import chunk_windows
    from folioscope.plans import registered
    from folioscope.plans.retrieval import FOLDED

    targets = [*FOLDED, "with", "queaux", "heit"]
    per = {}
    for r in chunk_windows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect():
        per.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"]))
    want = {(d, c, i) for d, rows in per.items() for i, c in enumerate(plain_cover(rows, targets, 4), 1)}
    assert {tuple(r) for r in registered()[0]["diverse_chunks_query"](spark, "/root/testdata/sf0.001").collect()} == want and len(want) > 100


def test_windows_pages_and_objects_of_the_tables(spark):
    """The three other queries without SQL: every row is there, and each result has the property that defines it."""
    import hashlib
    import json

    from folioscope.operators.corpus import chunk_windows
    from folioscope.operators.evidence import JOIN
    from folioscope.plans import registered
    from folioscope.plans.retrieval import FOLDED

    folder, queries = "/root/testdata/sf0.001", registered()[0]
    chunks = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunk_windows(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    windows = {(r["doc_id"], r["chunk_index"]): r for r in queries["chunk_keyword_window"](spark, folder).collect()}
    assert windows.keys() == chunks.keys() and all(r["size"] <= 1200 for r in windows.values())
    for k, t in chunks.items():
        low, head = t.lower(), t.lower()[:600]
        new = [w for w in FOLDED if w in low and w not in head]
        if len(t) <= 1200 or not any(low.find(w, 600) >= 0 for w in new):
            assert windows[k]["digest"] == hashlib.md5(t[:1200].encode()).hexdigest()
        else:
            assert windows[k]["digest"] != hashlib.md5(t[:1200].encode()).hexdigest() and JOIN
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    texts = {r["page_id"]: r["text"] for r in queries["html_tree_to_text"](spark, folder).collect()}
    assert texts.keys() == pages.keys() and not any("<script" in t or "</" in t for t in texts.values())
    rows = queries["json_from_text"](spark, folder).collect()
    assert rows and all(r["json"] is None or isinstance(json.loads(r["json"]), dict) for r in rows)


def test_tokens_are_found_by_their_rarest_gram(spark):
    import random

    from pyspark.sql import functions as F

    from folioscope.operators.pool import holding, reference_hits

    r = random.Random(6)
    texts = {i: "".join(r.choice("ABC/é") for _ in range(r.randrange(0, 12))) for i in range(120)} | {200: None, 201: "AB"}
    tokens = ["", None, "A", "AB", "A/", "é", "ABC", "C/AB", "ABCABC", "ZZZ", "Z", "ABZ"]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(t,) for t in [*tokens, "AB"]], "token string")
    got = {tuple(x) for x in holding(asked, df).where("true").collect()}
    want = {(t, d) for t in tokens if t for d, x in texts.items() if x and t in x}
    assert want <= got and all(t in tokens for t, _ in got) and not any(t in ("ZZZ", "Z", "ABZ") for t, _ in got)
    docs = df.select("doc_id", F.lit(None).cast("string").alias("ref"), F.col("text").alias("title"), F.lit("es").alias("language"), F.lit("2024-01-01").cast("date").alias("issue_date"))
    questions = spark.createDataFrame([(1, None), (2, "va")], "qid long, language string")
    batch = spark.createDataFrame([(1, 0, "zzz"), (1, 1, "abc"), (2, 0, "c/ab"), (3, 0, "é")], "qid long, place int, token string")
    out = reference_hits(batch, docs, questions)
    hits = {q: [x["doc_id"] for x in out.where(f"qid = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    of = lambda t: sorted((d for d, x in texts.items() if x and t in x.upper()), reverse=True)[:5]
    assert hits == {1: of("ABC"), 2: of("C/AB"), 3: of("É")}
    assert "BroadcastNestedLoop" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def plain_hops(have, hops, top=5, most=2, keep=3, pin=2):
    """By the rule, a question at a time."""
    have, n, fired, named, shield, pins = list(have), len(have), 0, False, [], []
    for kind, docs, direct in hops:
        docs = docs[:top]
        if fired >= most or (kind != "reference" and named) or not (docs or (kind == "reference" and direct)):
            continue
        shield += [d for d in docs[:keep] if d in have]
        if kind == "facet" and docs[0] in have:
            continue
        new = [d for d in dict.fromkeys(docs + direct) if d not in have]
        have += new
        pins += new + (docs[:pin] if kind == "identity" else [])
        if new or kind == "identity":
            fired += 1
            named = named or kind != "facet"
    return [(d, i, i > n, d in pins) for i, d in enumerate(have, 1)], sorted(set(shield))


def test_hops_of_every_kind(spark):
    import random

    from folioscope.operators.pool import hop

    r = random.Random(8)
    cases = {}
    for qid in range(60):
        some = lambda n: r.sample(range(25), r.randrange(0, n))
        cases[qid] = (r.sample(range(25), r.randrange(1, 12)), [("reference", some(8), some(3)), ("identity", some(7), []), ("facet", some(6), []), ("facet", some(6), [])])
    frame = lambda rows: spark.createDataFrame(rows, "qid long, doc_id long, rank long")
    ranked = lambda pick: frame([(q, d, i) for q, c in cases.items() for i, d in enumerate(pick(c), 1)])
    hops = [(cases[0][1][k][0], ranked(lambda c, k=k: c[1][k][1])) for k in range(4)]
    hops[0] = (*hops[0], ranked(lambda c: c[1][0][2]))
    out, shield = hop(ranked(lambda c: c[0]), hops)
    got, safe = {}, {}
    for x in out.orderBy("qid", "rank").collect():
        got.setdefault(x["qid"], []).append((x["doc_id"], x["rank"], x["added"], x["pinned"]))
    for x in shield.collect():
        safe.setdefault(x["qid"], []).append(x["doc_id"])
    for qid, (have, rows) in cases.items():
        want, kept = plain_hops(have, rows)
        assert (got[qid], sorted(safe.get(qid, []))) == (want, kept)


def test_old_editions_go_before_an_identity_is_pinned(spark):
    from folioscope.operators.pool import fresh_hits

    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (2, 10, 1)], "qid long, doc_id long, rank long")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.1]), (12, [0.0, 1.0]), (13, [0.05, 1.0])], "id long, embedding array<double>")
    dates = spark.createDataFrame([(10, "2024-01-01"), (11, "2025-01-01"), (12, "2024-01-01"), (13, None)], "id long, date string").selectExpr("id", "cast(date as date) date")
    got = [tuple(x) for x in fresh_hits(hits, vectors, dates).select("qid", "doc_id", "rank").orderBy("qid", "rank").collect()]
    assert got == [(1, 11, 1), (1, 12, 2), (1, 13, 3), (2, 10, 1)]


def test_candidates_of_long_tokens_grow_with_the_texts_only(spark):
    from pyspark.sql import functions as F

    from folioscope.operators.pool import holding

    n = 4000
    code = F.concat(F.lit("BRAND/"), (2015 + F.col("id") % 10).cast("string"), F.lit("/"), (100_000 + F.col("id") * 7).cast("string"))
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("CALL "), code, F.lit(" FOR ALL")).alias("text"))
    got = holding(spark.range(n).select(code.alias("token")), texts)
    assert got.count() <= 2 * n  # many times that by grams of three letters alone, of which there are some thousands whatever n
    assert got.join(texts, "doc_id").where(F.contains("text", F.col("token"))).count() == n


def test_references_broadcast_nothing_that_grows(spark):
    """Spark takes rows exploded from a small file for small, and broadcast them all."""
    import re

    from folioscope.plans import registered

    for name in ("part_references", "reference_hits"):
        plan = registered()[0][name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan)) <= {"counter"}, name


def test_references_of_every_language(spark):
    from itertools import product

    from folioscope.operators.pool import reference_hits

    docs = [(i, f"R-{i:04d}", f"call {'abc' if i % 3 else 'abd'} {i % 5}", ("es", "va", None)[i % 7 % 3], f"2024-01-{1 + i * 5 % 9:02d}") for i in range(90)]
    wants, tokens = ["es", "va", "fr", None], ["abc", "abd 4", "r-00", "R-0010", "none"]
    questions = [(i, w) for i, (w, _) in enumerate(product(wants, tokens))]
    batch = [(i, 0, t) for i, (_, t) in enumerate(product(wants, tokens))]
    frame = spark.createDataFrame(docs, "doc_id long, ref string, title string, language string, issue_date string").selectExpr("doc_id", "ref", "title", "language", "cast(issue_date as date) issue_date")
    out = reference_hits(spark.createDataFrame(batch, "qid long, place int, token string"), frame, spark.createDataFrame(questions, "qid long, language string"))
    got = {}
    for x in out.orderBy("qid", "rank").collect():
        got.setdefault(x["qid"], []).append(x["doc_id"])
    for (qid, _, t), (_, want) in zip(batch, questions, strict=True):
        t = t.upper()
        hits = [((r != t) + (t not in r), day, d, want is None or lang == want) for d, r, title, lang, day in docs if t in r or t in title.upper()]
        own = [h for h in hits if h[3]] or hits
        first = sorted(sorted(own, key=lambda h: (h[1], h[2]), reverse=True), key=lambda h: h[0])[:5]
        assert got.get(qid, []) == [h[2] for h in first], (t, want)


def test_hashed_vectors_by_definition(spark):
    import hashlib
    import math
    import re

    from folioscope.operators.features import hashed_vectors

    rows = [(1, "es", "Aguas y agua l'Aigua de 2024"), (1, "es", "otra agua"), (1, None, "agua"), (None, "es", "río río"), (None, "es", "mar"), (2, "es", "y a de"), (3, "es", None), (4, "es", "")] + [(10 + i, "de", f"wort{i} und wort{i % 7}") for i in range(40)]
    want = {}
    for key, lang, text in rows:
        for w in re.findall(r"[\w·'/-]+", (text or "").lower().replace("í", "i")):
            if len(w) >= 3:
                h = hashlib.md5(w.encode()).digest()
                want.setdefault((key, lang), [0] * 64)[h[0] % 64] += 1 if h[1] < 128 else -1
    want = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in want.items() if any(v)}
    got = hashed_vectors(spark.createDataFrame(rows, "id long, lang string, text string").repartition(3), ["id", "lang"], F.col("text")).collect()
    assert len(got) == len(want) and {(r["id"], r["lang"]): r["embedding"] for r in got} == want


def test_hashed_vectors_have_no_sum_a_place(spark):
    """64 sums in one aggregate are more code than the JVM compiles."""
    from folioscope.operators.features import hashed_vectors

    plan = hashed_vectors(spark.createDataFrame([(1, "a text")], "id long, text string"), ["id"], F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" not in plan


def test_a_text_is_split_once_for_its_chunks(spark):
    from folioscope.operators.corpus import chunk_windows

    df = spark.createDataFrame([(1, "a b\nc"), (2, ""), (3, None), (4, " \x01 "), (5, "w " * 1300)], "doc_id long, text string")
    out = chunk_windows(df)
    assert [(r["doc_id"], r["chunk_index"], r["n_words"]) for r in out.orderBy("doc_id", "chunk_index").collect()] == [(1, 0, 3), (5, 0, 500), (5, 1, 500), (5, 2, 460)]
    big = chunk_windows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert big._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
