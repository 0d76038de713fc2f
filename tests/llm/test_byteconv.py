import zlib

import numpy as np

from folioscope.llm.byteconv import ConvConfig, Net, fit, held_out, lay, learn, probabilities, score

CFG = ConvConfig(steps=150, batch=24)


def laid(texts):
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_gradient_against_differences():
    cfg = ConvConfig(embed=2, filters=3, units=2)
    net = Net.fresh(cfg)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, want = lay(*laid([b"hello world" * 40, b"", b"abc" * 7])), np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(x).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - want * z))

    g = net.gradient(x, want)
    for k, at in (("out", (0,)), ("chunk", (1, 1)), ("conv", (3, 4)), ("table", (ord("l"), 1)), ("conv_bias", (1,))):
        old, eps = net.weights[k][at], 1e-5
        net.weights[k][at] = old + eps
        up = loss()
        net.weights[k][at] = old - eps
        down = loss()
        net.weights[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-4, k


def test_a_score_depends_on_its_text_alone():
    net = fit([b"good text here " * 9, b"@@##!! " * 20] * 8, np.array([1.0, 0.0] * 8), ConvConfig(steps=30, batch=8))
    texts = [b"good text here " * 9, b"", b"x", b"@@##!! " * 90, b"y" * 700]
    together = probabilities(net, *laid(texts))
    alone = [probabilities(net, *laid([t]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def test_a_very_long_text_is_covered_to_its_end():
    net = fit([b"good text here " * 9, b"@@##!! " * 20] * 8, np.array([1.0, 0.0] * 8), ConvConfig(steps=60, batch=8))
    clean = b"good text here " * 90_000
    assert probabilities(net, *laid([clean]))[0] - probabilities(net, *laid([clean + b"@@##!! " * 60]))[0] > 0.05


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs.select("doc_id", "text"), learn(docs, labels)).withColumn("held_out", held_out()).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    own = got[got.held_out]
    assert (own.predicted == own.quality).mean() > 0.95
    assert own.predicted[own.quality == 1].mean() > 0.99
    assert (own.predicted == (own.score >= 0.3)).all() and own.score.between(0, 1).all()


def test_hard_rows_and_columns(spark, hard, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = learn(hard, labels, CFG)
    got = score(hard, net, CFG)
    assert got.count() == hard.count() and got.columns == [c for c in hard.columns if c != "score"] + ["score", "predicted"]
    assert score(nothing, net).collect() == []
    assert learn(nothing, labels, CFG).weights["out"].sum() == 0


def naive(net, text: bytes) -> float:
    """The network by its description, one block and one chunk at a time."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    n_halves = max(-(-len(text) // 128), 1)
    padded, blocks, inside = text.ljust(n_halves * 128, b"\0"), n_halves * 32, max(-(-len(text) // 4), 1)
    embed = lambda i: np.concatenate([w["table"][x] for x in padded[4 * i : 4 * i + 4]])
    n = w["conv"].shape[1] // 2
    acts = []
    for i in range(blocks):
        pre = embed(i) @ w["conv"][:, :n] + w["conv_bias"]
        if i + 1 < blocks:
            pre = pre + embed(i + 1) @ w["conv"][:, n:]
        acts.append(np.maximum(pre, 0) if i < inside else np.zeros(n))
    units = []
    for first in range(max(n_halves - 1, 1)):
        lo, hi = first * 32, min((first + 2) * 32, blocks)
        mean = np.sum(acts[lo:hi], axis=0) / (min(hi, inside) - lo)
        units.append(np.maximum(mean @ w["chunk"] + w["chunk_bias"], 0))
    logit = np.max(units, axis=0) @ w["out"] + w["out_bias"][0]
    return 1 / (1 + np.exp(-logit))


def test_scores_are_those_of_the_plain_network():
    r = np.random.default_rng(9)
    net = Net.fresh(ConvConfig())
    for k in net.weights:
        net.weights[k] = net.weights[k] + r.normal(0, 0.1, net.weights[k].shape).astype(np.float32)
    texts = [r.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 4, 5, 127, 128, 129, 255, 256, 257, 1000, 3000)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = probabilities(net, np.frombuffer(b"".join(texts), dtype=np.uint8), offs)
    assert np.allclose(got, [naive(net, t) for t in texts], atol=1e-4)
