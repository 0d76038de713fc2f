from folioscope.llm.suffix import brute_force

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert len(names) == 4
    out = []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert new.columns == docs.columns
        out.append((docs, new))
        docs = new
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out[0][1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.98

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    before = {r["doc_id"]: shingles(r["text"] or "") for r in out[1][0].collect()}
    after = {r["doc_id"] for r in out[1][1].collect()}
    like = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    assert all(any(like(before[d], before[e]) for e in before if e != d) for d in before.keys() - after)
    firsts = [d for d in before if not any(e < d and like(before[d], before[e]) for e in before)]
    assert set(firsts) <= set(before) and all(d in after or any(like(before[d], before[e]) for e in before if e != d) for d in firsts)
    assert not any(like(before[a], before[b]) for a in after for b in after if a < b)
    want = brute_force({r["doc_id"]: r["text"].encode() for r in out[2][0].collect()}, p.PASSAGE.length)
    for r in out[2][1].collect():
        assert r["n_chars"] == len(r["text"]) and (want[r["doc_id"]][1] > 0 or len(r["text"].encode()) == want[r["doc_id"]][0])
    assert {r["doc_id"] for r in out[3][1].collect()} == {r["doc_id"] for r in out[3][0].collect()}


def test_hard_rows(spark, hard, nothing):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (hard.select(*columns), nothing.select(*columns)):
        for _, stage in p.STAGES[:3]:
            got = stage(spark, table, FOLDER)
            assert got.columns == columns
        assert p.STAGES[3][1](spark, table, FOLDER).columns[0] == "doc_id"


def test_every_operator_is_registered():
    from folioscope.llm.queries import queries

    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 14))


def test_passages_of_over_fifty_words_go(spark):
    """Passages of 51 to 60 words, most under 400 bytes, each in three documents that have nothing else in common; the rest of a text stays."""
    import random

    import corpus_pipeline as p

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8])))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(51 + i % 10) for i in range(40)]
    own = {(i, k): (prose(90), prose(90)) for i in range(40) for k in range(3)}
    rows = [(3 * i + k, f"{a}. {passages[i]}. {b}", "en", "s", 0) for (i, k), (a, b) in own.items()] + [(1000 + i, prose(200), "en", "s", 0) for i in range(40)]
    assert sum(len(x) < 400 for x in passages) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in p.suffix_dedup(spark, docs, FOLDER).collect()}
    for (i, k), (a, b) in own.items():
        left = got[3 * i + k]
        assert passages[i] not in left and len(left) <= len(a) + len(b) + 4 and left.startswith(a[:-4]) and left.endswith(b[4:])  # neighbours may share a letter
    assert all(got[d] == t for d, t, *_ in rows if d >= 1000)


def test_texts_of_a_repeated_id_stay(spark):
    import corpus_pipeline as p

    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("c")), (3, text("c")), (None, text("d")), (4, None), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_dedup(spark, docs, FOLDER)
    want = [(1, text("a")), (1, text("b")), (2, text("c")), (4, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = sorted(((r["doc_id"], r["text"] or None) for r in p.suffix_dedup(spark, got, FOLDER).collect()), key=str)
    assert kept == sorted(want, key=str)
