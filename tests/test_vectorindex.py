import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators.vectorindex import IndexConfig, build, search
from folioscope.workers import Shared

FOLDER = "/root/testdata/sf0.1"


def exact(ids, x, labels, q, want, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ (q / np.linalg.norm(q)), 6)
    return [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if want is None or labels[j] == want][:k]


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    shared = Shared(spark, "ivf-test")
    build(rows, f"{shared.base}/i", IndexConfig(block=700))
    p = rows.orderBy("id").toPandas()
    yield rows, f"{shared.base}/i", p.id.to_numpy(), np.stack(p.embedding).astype(float), p.label.to_numpy()
    shared.clear()


def asked(rows, want):
    return rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"), want.cast("int").alias("want_label"))


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["id"], r["score"]))
    return out


def test_all_cells_are_exact(spark, table):
    rows, path, ids, x, labels = table
    got = found(search(spark, path, asked(rows, F.when(F.col("id") % 40 == 0, F.col("label"))), 10, filters=("label",), cfg=IndexConfig(block=60)))
    assert got == {int(i): exact(ids, x, labels, x[n], labels[n] if i % 40 == 0 else None, 10) for n, i in enumerate(ids) if i % 20 == 0}


def test_recall_of_probing(spark, table):
    rows, path, ids, x, labels = table
    df = search(spark, path, asked(rows, F.lit(None)), 10, probe=40)
    got, hit, n = found(df), 0, 0
    for i, at in zip(ids, range(len(ids)), strict=True):
        if i % 20 == 0:
            want = {a for a, _ in exact(ids, x, labels, x[at], None, 10)}
            hit, n = hit + len(want & {a for a, _ in got[i]}), n + 10
    assert hit / n >= 0.9 and {r["probed"] for r in df.collect()} == {40}


def test_a_filter_that_empties_the_cells_widens_the_probing(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist(), 7 if i == 123 else 1) for i in range(600)]
    rows += [(900, None, 7), (901, [0.0] * 8, 7), (902, [float("nan")] * 8, 7), (903, [1.0], 7), (None, [1.0] * 8, 7)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    shared = Shared(spark, "ivf-test")
    build(df, f"{shared.base}/i", IndexConfig(cells=32))
    ask = df.where("id < 20 or id >= 900").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"), F.when(F.col("id") % 2 == 0, 7).otherwise(1).alias("want_label"))
    got = search(spark, f"{shared.base}/i", ask, 3, probe=2, filters=("label",)).collect()
    even, odd = ([x for x in got if x["qid"] % 2 == k] for k in (0, 1))
    assert {(x["qid"], x["id"]) for x in even} == {(q, 123) for q in range(0, 20, 2)} and max(x["probed"] for x in even) > 2
    assert len(odd) == 30 and {x["probed"] for x in odd} == {2}
    none = search(spark, f"{shared.base}/i", ask.withColumn("want_label", F.lit(99)), 3, probe=2, filters=("label",))
    assert none.collect() == []
    build(df.where("id > 899"), f"{shared.base}/j")
    build(df.where("false"), f"{shared.base}/k")
    assert search(spark, f"{shared.base}/k", ask, 3).collect() == []
    shared.clear()


def test_nearest_of_all_compares_no_pair_as_a_row(spark):
    from folioscope.functions.vector import cosine
    from folioscope.operators import fusion, nearest

    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [1.0, 2.0] * 4) for i in range(60)]
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0]), (504, [1.0, None] * 4), (505, [-2.0, -4.0] * 4)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = v.where("doc_id % 20 = 0 or doc_id > 500").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("asked"))
    pairs = v.crossJoin(q).select("qid", "doc_id", F.round(cosine("embedding", "asked"), 6).alias("score"))
    top = lambda df: sorted((x["qid"], x["rank"], x["doc_id"]) for x in fusion.ranked(df, F.desc("score"), "doc_id", limit=30).collect())
    found = nearest.candidates(q, v, 30)
    assert top(found) == top(pairs)
    # The old step had as many rows as pairs; a tile's join has 30 at most for each question.
    assert found.count() == 30 * q.count()
    kept, nearest.ROWS, nearest.ASKED = (nearest.ROWS, nearest.ASKED), 50, 7
    try:
        assert top(nearest.candidates(q, v, 30)) == top(pairs)
    finally:
        nearest.ROWS, nearest.ASKED = kept
