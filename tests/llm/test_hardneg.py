import math
import random

import numpy as np
import pytest

from folioscope.llm.hardneg import Lists, MiningConfig, _best, _centers, _search, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, anchor_id long, list string"


def brute(rows, cfg):
    have = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or not x or len(x) != 4 or any(c is None or not math.isfinite(c) for c in x):
            continue
        x = [float(np.float32(c)) for c in x]
        have[vec_id] = min(have.get(vec_id, (label, x)), (label, x))
    have = {k: (label, [math.floor(cfg.scale * c) for c in x]) for k, (label, x) in have.items()}
    dot = lambda a, b: sum(map(lambda p, q: p * q, a, b))
    out = []
    for a in (k for k in have if k % 50 == 0):
        found = [(-dot(have[a][1], q), k, label == have[a][0]) for k, (label, q) in have.items() if k != a]
        for p, pos, _ in sorted(x for x in found if x[2])[: cfg.positives]:
            fit = [(s, k) for s, k, same in sorted(found) if not same and cfg.low * -p <= 100 * -s <= cfg.high * -p]
            out += [(a, pos, r, k, -p, -s) for r, (s, k) in enumerate(fit[: cfg.negatives], 1)]
    return sorted(out)


def rows():
    r = random.Random(2)
    vectors = lambda n: [[round(r.uniform(-1, 1), 1) for _ in range(4)] for _ in range(n)]
    some = vectors(40)  # few different vectors: many ties
    out = [(i, r.choice(some), r.randint(0, 3)) for i in range(700)]
    out += [(1000, None, 1), (1001, [0.1, None, 0.2, 0.3], 1), (1050, [float("nan"), 0.0, 0.0, 0.0], 1), (1100, [float("inf"), 0.0, 0.0, 0.0], 0), (1150, [], 1), (1200, [1.0, 2.0], 1), (None, some[0], 1), (1250, some[1], None), (1300, [0.0] * 4, 2)]
    return out + [(50, some[3], 0), (7, some[2], 1), (7, some[2], 1)]


def test_against_brute_force(spark):
    table = spark.createDataFrame([(*x, "s", "r", 9, "l") for x in rows()], SCHEMA)
    from pyspark.sql import functions as F

    for cfg in (MiningConfig(), MiningConfig(lists=12, block=40, first=1, sample=200)):
        got = sorted(map(tuple, hard_negatives(table.repartition(5), F.col("vec_id") % 50 == 0, cfg).collect()))
        assert got == brute(rows(), cfg) and got


def test_empty_and_alone(spark):
    from pyspark.sql import functions as F

    anchor = F.col("vec_id") % 50 == 0
    assert hard_negatives(spark.createDataFrame([], SCHEMA), anchor).collect() == []
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives(one, anchor).collect() == []
    long = spark.createDataFrame([(0, [1e30, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too long for exact scores"):
        hard_negatives(long, anchor).collect()


def test_bounds_hold_and_lists_are_skipped():
    r = np.random.default_rng(5)
    x = np.floor(256 * (r.normal(size=(8, 6)).repeat(60, axis=0) + 0.01 * r.normal(size=(480, 6))))
    centers = _centers(x, MiningConfig(lists=8))
    near = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    radii = np.array([np.sqrt(((x[near == c] - centers[c]) ** 2).sum(axis=1)).max() for c in range(len(centers))])
    lists = Lists.of(centers, radii, np.bincount(near, minlength=len(centers)), 100)
    least, most = lists.bounds(x[:50])
    scores = x[:50] @ x.T
    assert (least[:, near] <= scores).all() and (scores <= most[:, near]).all()
    counted = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            counted.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    ids = np.arange(480)
    asks = {"q": x[:50], "least": np.full(50, -1e18), "low": np.full(50, -1e18), "high": np.full(50, 1e18), "anchor_id": ids[:50], "label": np.zeros(50)}
    have = {"vec_id": ids, "label": np.zeros(480), "list": near, "q": x}
    ask, row, score = _search(asks, have, lists, 3, True)
    np.fill_diagonal(scores, -np.inf)
    want = [sorted(range(480), key=lambda j: (-scores[i, j], j))[:3] for i in range(50)]
    assert row.reshape(50, 3).tolist() == want and (score == scores[ask, row]).all()
    asks["q"] = x[:50].view(Seen)
    lists.bounds(x[:1])
    counted.clear()
    _search(asks, have, lists, 3, True)
    assert sum(counted[1:]) < 50 * 480 / 2  # the first product is that with the centres


def test_ties_go_to_the_first_columns():
    score = np.array([[5.0, 7, 7, 7, 1], [1, 1, 1, 1, 1]])
    r, c = _best(score, np.array([[True] * 5, [False, True, True, True, True]]), 2, np.full(2, -1e18))
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    r, c = _best(score, np.ones((2, 5), bool), 2, np.array([7.0, 2.0]))
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 1), (0, 2)]
