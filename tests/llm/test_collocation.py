import random
import re
from collections import Counter

import numpy as np
import pytest

from folioscope.llm.collocation import CollocationConfig, _reach, collocations

SCHEMA = "doc_id long, text string, lang string, a string, n string, score string, phrase string, rank string"


def brute(rows, cfg):
    f = {}
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, cfg.longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault("und" if lang is None else lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: v for g, v in c.items() if len(g) > 1 and v >= cfg.least}
        longer = Counter()
        for g, v in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], v)
        scored = []
        for g, a in cand.items():
            if 100 * longer[g] >= cfg.share * a:
                continue
            score, k = min((1000 * a * n // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[: cfg.top], 1)]
    return sorted(out)


def rows():
    r = random.Random(7)
    vocabulary = ["the", "The", "of", "é", "日本", "New", "york", "a-b", "x" * 50] + [f"w{i}" for i in range(60)]
    out = []
    for i in range(300):
        words = [r.choice(vocabulary[: r.choice([4, 12, 69])]) for _ in range(r.randrange(0, 60))]
        text = "".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for w in words)
        out.append((i, text + r.choice(["", "in New York City today", "in new york city ."]), r.choice(["en", "de", None, "l\nx"])))
    return out + [(None, "the of the of the of", "en"), (3, None, "en"), (4, "", None), (5, " \t\n.,", "xx"), (6, "the the the the the the the " * 40, "en"), (7, "of the " * 900, "de"), (7, "of the " * 900, "de")]


@pytest.mark.parametrize("cfg", [CollocationConfig(least=5), CollocationConfig(least=3, longest=3, share=60, top=15), CollocationConfig(least=4, cells=16, tokens=300, turns=2, step=2000), CollocationConfig(least=5, cells=1, tokens=20, turns=1, step=500)])
def test_against_brute_force(spark, cfg):
    """With few counters words share them; with few tokens a task, pivots are dealt to several and tasks report unpruned."""
    docs = spark.createDataFrame([(*x, "a", "n", "s", "p", "r") for x in rows()], SCHEMA).repartition(3)
    got = sorted(map(tuple, collocations(docs, cfg).collect()))
    assert got == brute(rows(), cfg) and got


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations(docs).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "once only", "en")], "doc_id long, text string, lang string")).collect() == []


def test_scores_past_64_bits(spark):
    from folioscope.llm.collocation import scored

    a, n = 4_000_000_000_000, 900_000_000_000_000
    candidates = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long")
    known = spark.createDataFrame([("en", "x", a + 3), ("en", "y", a + 1)], "lang string, phrase string, f long")
    got = scored(candidates, known, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got["score"] == 1000 * a * n // ((a + 3) * (a + 1))


def test_each_phrase_has_one_pivot():
    r = np.random.default_rng(3)
    order = r.integers(-1, 4, 200)
    piece = np.cumsum(r.random(200) < 0.1)
    left, right = _reach(order, piece, 4)
    owners = Counter()
    for p in np.flatnonzero(order >= 0):
        for i in range(left[p] + 1):
            for j in range(right[p] + 1):
                if 1 < i + j + 1 <= 5:
                    owners[int(p - i), i + j + 1] += 1
    want = {(s, k): 1 for k in range(2, 6) for s in range(201 - k) if (order[s : s + k] >= 0).all() and len(set(piece[s : s + k])) == 1}
    assert owners == want
