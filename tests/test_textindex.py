import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import textindex
from folioscope.operators.textindex import TextIndexConfig, add, search
from folioscope.workers import Shared, children

CFG = TextIndexConfig(span=16, buckets=3, slices=2)


def plain(docs, questions, k):
    """BM25 by definition, over all documents."""
    words = {d: re.findall(r"[\w·'/-]+", (t or "").lower()) for d, t in docs.items()}
    n, avg = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = Counter(w for x in words.values() for w in set(x))
    out = set()
    for q, terms in questions.items():
        got = []
        for d, x in words.items():
            tf = Counter(x)
            hit = [w for w in set(terms or ()) if tf[w]]
            if hit:
                got.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / avg)) for w in hit), 6), d))
        out |= {(q, d, -s, r) for r, (s, d) in enumerate(sorted(got)[:k], 1)}
    return out


def corpus(n):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    out = {i: " ".join(r.choice(vocabulary[: r.choice([3, 30, 200])]) for _ in range(r.randrange(0, 80))) for i in range(n)}
    return out | {5: None, 6: "", 7: "w1 " * 400, -40: "w5 w6", 10**12: "w5 w5 w199"}


def close(got, want):
    key = lambda rows: sorted((q, r, d) for q, d, _, r in rows)
    assert key(got) == key(want)
    have = {(q, d): s for q, d, s, _ in want}
    assert all(abs(s - have[q, d]) < 2e-6 for q, d, s, _ in got)


QUESTIONS = {1: ["w1", "w2"], 2: ["w150", "w151", "w1", "w1"], 3: ["none"], 4: None, 5: [], 6: ["w199", None, "w5"], 7: [f"w{i}" for i in range(40)]}


def test_same_rows_as_a_scan(spark):
    docs = corpus(700)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("lexeme", F.lit("x"))
    asked = spark.createDataFrame(list(QUESTIONS.items()), "qid long, words array<string>")
    shared = Shared(spark, "text-test")
    path = f"{shared.base}/i"
    assert search(spark, path, asked, 5)[0].collect() == []
    for k in range(6):
        add(df.where(F.pmod("doc_id", F.lit(6)) == k), path, CFG)
        if k in (0, 2):
            some = {d: t for d, t in docs.items() if d % 6 <= k}
            close(set(map(tuple, search(spark, path, asked, 5, 1, cfg=CFG)[0].collect())), plain(some, QUESTIONS, 5))
    add(df.limit(50).unionByName(df.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))), path, CFG)  # known already
    got, read = search(spark, path, asked, 5, 2, cfg=CFG)
    close(set(map(tuple, got.collect())), plain(docs, QUESTIONS, 5))
    read = {r["qid"]: (r["blocks"], r["read"]) for r in read.collect()}
    assert all(r <= b for b, r in read.values()) and read[2][1] < read[2][0]
    _, segments = textindex._manifest(spark, path)
    assert len(segments) <= 3 and sum(s[1] for s in segments) == len(docs)
    assert set(children(spark, f"{path}/segments")) == {f"seg={s[0]}" for s in segments}
    shared.clear()


def test_parts_and_every_word(spark):
    docs = corpus(300)
    part = lambda d: [None, "a", "b"][d % 3]
    df = spark.createDataFrame([(d, t, part(d)) for d, t in docs.items()], "doc_id long, text string, part string")
    shared = Shared(spark, "text-test")
    path = f"{shared.base}/i"
    add(df, path, CFG)
    questions = [(1, ["w1", "w2"], "a"), (2, ["w1", "w2"], None), (3, ["w1"], "c"), (4, ["w1", "none"], "b"), (5, ["w40", "w2", "w2"], "b")]
    asked = spark.createDataFrame(questions, "qid long, words array<string>, part string")
    for every in (False, True):
        got = {(r["qid"], r["doc_id"], r["rank"]) for r in search(spark, path, asked, 4, 1, every, cfg=CFG)[0].collect()}
        want = set()
        for qid, words, only in questions:
            rows = sorted(plain(docs, {qid: words}, 10**6), key=lambda r: r[3])
            fit = [d for _, d, _, _ in rows if only in (None, part(d)) and (not every or all(re.search(rf"\b{w}\b", docs[d]) for w in words))]
            want |= {(qid, d, r) for r, d in enumerate(fit[:4], 1)}
        assert got == want and got
    shared.clear()


def test_a_dead_writer_leaves_nothing_that_readers_see(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["b"])], "qid long, words array<string>")
    shared = Shared(spark, "text-test")
    path = f"{shared.base}/i"
    add(df.where("doc_id = 1"), path, CFG)

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(textindex, "_merged", dies)
    with pytest.raises(OSError):
        add(df, path, CFG)
    assert [r["doc_id"] for r in search(spark, path, asked, 5, cfg=CFG)[0].collect()] == [1]
    monkeypatch.undo()
    add(df, path, CFG)
    assert [r["doc_id"] for r in search(spark, path, asked, 5, cfg=CFG)[0].orderBy("rank").collect()] == [1, 2]
    shared.clear()


def test_large_batches_are_dealt_to_more_tasks_than_buckets_and_slices(spark, monkeypatch):
    monkeypatch.setattr(textindex, "TASK", 300, raising=False)
    docs = corpus(400)
    asked = spark.createDataFrame(list(QUESTIONS.items()), "qid long, words array<string>")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    shared = Shared(spark, "text-test")
    path = f"{shared.base}/i"
    for k in range(2):  # the second merges with the first
        add(df.where(F.pmod("doc_id", F.lit(2)) == k), path, CFG)
    close(set(map(tuple, search(spark, path, asked, 5, 1, cfg=CFG)[0].collect())), plain(docs, QUESTIONS, 5))
    files = spark.read.parquet(f"{path}/segments").select(F.input_file_name().alias("f")).distinct().count()
    assert files > CFG.buckets * CFG.slices
    shared.clear()


def test_search_reads_the_whole_index_once(spark):
    """Both rounds of a search shuffled all blocks of all words."""
    docs = spark.createDataFrame(list(corpus(300).items()), "doc_id long, text string")
    path = f"{Shared(spark, 'text-once').base}/i"
    add(docs, path, CFG)
    out, read = search(spark, path, spark.createDataFrame([(1, ["w1", "w150"])], "qid long, words array<string>"), 5, cfg=CFG)
    assert out.count() == 5 and not [f for df in (out, read) for f in df.inputFiles() if "/segments/" in f]


def test_words_instead_of_texts(spark):
    docs = corpus(300) | {8: "  Él l'AIGUA, w1  w1", 9: "..."}
    df = spark.createDataFrame([(d, t, ("es", "va", None)[d % 3]) for d, t in docs.items()] + [(7, "a smaller text", "xx"), (None, "w1", "es")], "doc_id long, text string, part string")
    df = df.where("text is null or text <> 'a smaller text'").unionByName(df.where("doc_id = 9"))
    asked = spark.createDataFrame([(q, w, "es" if q % 2 else None) for q, w in QUESTIONS.items()] + [(8, ["el", "l'aigua"], None)], "qid long, words array<string>, part string")
    found = []
    for rows in (df, df.select("doc_id", "part", textindex.joined("text").alias("words"))):
        path = f"{Shared(spark, 'text-words').base}/i"
        for k in (0, 1):
            add(rows.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == k), path, CFG)
        found.append({tuple(r) for r in search(spark, path, asked, 9, cfg=CFG)[0].collect()})
    assert found[0] == found[1] and {r[1] for r in found[0] if r[0] == 8} == {8}


def test_postings_of_held_batches(spark, monkeypatch):
    """Blocks of documents that come in several batches and are cut before their range ends."""
    import pyarrow as pa

    r = random.Random(9)
    docs = {d: (d // 16, r.choice(["es", None]), " ".join(r.choice("abcdé") for _ in range(r.randrange(0, 9)))) for d in r.sample(range(90), 60)}
    monkeypatch.setattr(textindex, "HELD", 40)
    schema = pa.schema([("range", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("words", pa.string())])
    batches = [pa.RecordBatch.from_pylist([{"range": docs[d][0], "doc_id": d, "part": docs[d][1], "words": docs[d][2] if d % 7 else docs[d][2] or None} for d in some], schema=schema) for some in (list(docs)[:0], list(docs)[:25], list(docs)[25:])]
    got = []
    for out in textindex._posted(iter(batches)):
        for b in out.to_pylist():
            assert b["n"] == len(b["docs"]) and b["most"] == max(b["tfs"]) and b["short"] == min(b["lens"]) and b["docs"] == sorted(b["docs"])
            got += [(b["lexeme"], b["range"], b["part"], d, tf, n) for d, tf, n in zip(b["docs"], b["tfs"], b["lens"], strict=True)]
    want = [(w, span, part, d, tf, len(t.split())) for d, (span, part, t) in docs.items() for w, tf in [*Counter(t.split()).items(), (None, 0)]]
    assert sorted(got, key=str) == sorted(want, key=str)
