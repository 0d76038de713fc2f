import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm.kmtree import TreeConfig, neighbours
from folioscope.llm.rpforest import ForestConfig, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string"


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 16))
    x[300:360] = x[300] + r.normal(size=(60, 16)) * 0.05
    x[400:410] = x[400]
    rows = [(i, [float(v) for v in row], 0, "z") for i, row in enumerate(x.astype(np.float32))]
    rows += [(600, None, 0, "z"), (601, [0.0] * 16, 0, "z"), (602, [float("nan")] * 16, 0, "z"), (603, [1.0] * 3, 0, "z"), (604, [None] + [1.0] * 15, 0, "z"), (None, [1.0] * 16, 0, "z")]
    return spark.createDataFrame(rows, SCHEMA), x.astype(np.float32).astype(float)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_reach_the_recall(cloud):
    df, x = cloud
    got = neighbours(df, F.col("vec_id") % 5 == 0, TreeConfig(leaf=16)).toPandas()
    assert set(got.query_id) == set(range(0, 600, 5))
    u, hit = unit(x), 0
    for q, rows in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hit += len(set(best) & set(rows.vec_id))
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(rows.score, s[rows.vec_id.to_numpy()], atol=1e-12)
        assert list(rows.score) == sorted(rows.score, reverse=True)
    assert hit / (5 * 120) >= 0.9


def test_ties_go_to_the_smaller_id(cloud):
    got = neighbours(cloud[0], F.col("vec_id") == 409, TreeConfig(leaf=16)).orderBy("rank").toPandas()
    assert list(got.vec_id) == [400, 401, 402, 403, 404]


def test_repeated_rows_are_one(cloud, spark):
    """Queries and candidates that repeat, a repeat with another vector, one that takes no part."""
    df, x = cloud
    again = df.where("vec_id in (0, 5, 409, 400)")
    larger = df.where("vec_id = 10").withColumn("embedding", F.transform("embedding", lambda c: F.abs(c) + 1))
    broken = spark.createDataFrame([(15, [float("nan")] * 16, 0, "z")], SCHEMA)
    ask = F.col("vec_id") % 5 == 0
    want = sorted(map(tuple, neighbours(df, ask, TreeConfig(leaf=16)).collect()))
    got = sorted(map(tuple, neighbours(df.unionByName(again).unionByName(again).unionByName(larger).unionByName(broken), ask, TreeConfig(leaf=16)).collect()))
    assert got == want and len(got) == 5 * 120


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "z"), (1, [0.0, 1.0], 0, "z")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours(df, F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]


@pytest.mark.parametrize("cfg", [ForestConfig(rows=64), ForestConfig(rows=64, block=16)])
def test_links_are_exact_here(cloud, cfg):
    df, x = cloud
    got = near_vectors(df, cfg).toPandas().set_index("vec_id").sort_index()
    near = unit(x) @ unit(x).T >= 0.9
    label = np.arange(600)
    for _ in range(600):
        new = np.where(near, label[None, :], 999).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (got.n_links.loc[:599].to_numpy() == near.sum(axis=1) - 1).all()
    assert (got.component_id.loc[:599].to_numpy() == label).all()
    odd = got.loc[600:604]
    assert (odd.n_links == 0).all() and odd.kept.all() and len(got) == 605


def test_planted_links_are_found(spark):
    """Recall of op6 where the forest has many leaves: 6,000 vectors of 64 dimensions, pairs planted at cosines of 0.90 to 0.95 and groups in one place."""
    r = np.random.default_rng(8)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(600):
        c = r.uniform(0.901, 0.95)
        side = r.normal(size=64)
        side -= (side @ x[i]) * x[i]
        x[3000 + i] = c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[5000:5300] = x[5000] + r.normal(size=(300, 64)) * 0.02
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in row], 0, "z") for i, row in enumerate(x)], SCHEMA)
    got = near_vectors(df, ForestConfig(rows=128)).toPandas().set_index("vec_id").sort_index()
    near = unit(x) @ unit(x).T >= 0.9
    want = near.sum(axis=1) - 1
    assert (got.n_links.to_numpy() <= want).all()
    planted = np.r_[0:600, 3000:3600]
    assert got.n_links.to_numpy()[planted].sum() / want[planted].sum() >= 0.9
    assert (got.component_id.to_numpy()[5000:5300] == 5000).all()
    lost = got.n_links.to_numpy()[planted] < want[planted]
    assert (got.component_id.to_numpy()[planted][lost] == planted[lost]).all()


def test_subtrees_of_large_leaves(spark):
    """Leaves beyond cfg.rows get subtrees; the recall holds, and so do leaves of equal vectors, which can't be split."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1400] = x[1000]
    df = spark.createDataFrame([(i, [float(v) for v in row], 0, "z") for i, row in enumerate(x)], SCHEMA)
    cfg = TreeConfig(sample=256, leaf=32, rows=100, sub=64)
    got = neighbours(df, F.col("vec_id") % 20 == 0, cfg).toPandas()
    u, hit = unit(x.astype(float)), 0
    for q, rows in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]) & set(rows.vec_id))
    assert len(got) == 5 * 150 and hit / len(got) >= 0.9


def test_grafted_trees_file_every_row():
    from folioscope.llm.kmtree import Tree

    r = np.random.default_rng(1)
    x = unit(r.normal(size=(4000, 8)))
    tree = Tree(x[:300], TreeConfig(leaf=32))
    leaf = tree.file(x)
    below = {int(k): Tree(x[leaf == k], TreeConfig(leaf=16)) for k in np.unique(leaf)[::2]}
    before = tree.leaves
    tree.graft(below)
    assert tree.leaves == before - len(below) + sum(t.leaves for t in below.values())
    new = tree.file(x)
    for k, t in below.items():
        assert len(np.unique(new[leaf == k])) == len(np.unique(t.file(x[leaf == k])))
    assert sorted(tree.visit(x[0], tree.leaves)) == list(range(tree.leaves)) and tree.visit(x[0], 1) == [new[0]]


def test_ties_of_links(spark):
    """Pairs at the threshold itself link; just below it they don't."""
    rows = [(0, [1.0, 0.0], 0, "z"), (1, [0.9, float(np.sqrt(1 - 0.81))], 0, "z"), (2, [0.0, 1.0], 0, "z"), (3, [0.0, 2.0], 0, "z"), (3, [0.0, 2.0], 0, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, leaf string")
    got = sorted(map(tuple, near_vectors(df).collect()))
    assert got[0][:3] == (0, int(got[0][1]), 0) and got[2] == (2, 2, 2, True) and [r[:3] for r in got[3:]] == [(3, 2, 2), (3, 2, 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours(none, F.lit(True)).collect() == [] and near_vectors(none).collect() == []


def test_small_leaves_still_give_k(cloud):
    """One visit reaches the recall asked for here, and no leaf holds five others."""
    got = neighbours(cloud[0], F.col("vec_id") % 5 == 0, TreeConfig(leaf=3, recall=0.01)).groupBy("query_id").count().collect()
    assert {(r["query_id"], r["count"]) for r in got} == {(q, 5) for q in range(0, 600, 5)}
