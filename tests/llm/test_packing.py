from collections import Counter, defaultdict

import public_tokenizers

from folioscope.llm.packing import Bins, PackingConfig, pack
from folioscope.llm.packing import items as items_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def items(docs):
    return items_of(docs, MODEL)


def check(rows, cfg, want):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        assert sum(r["n_tokens"] for r in held) == held[0]["used"] <= cfg.capacity
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        sources = Counter(want[r["doc_id"]][1] for r in held if want[r["doc_id"]][1] is not None)
        clusters = Counter(want[r["doc_id"]][2] for r in held if want[r["doc_id"]][2] is not None)
        assert max(sources.values(), default=0) <= cfg.per_source and max(clusters.values(), default=0) <= 1
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    return bins, total


def test_bins_against_plain_search():
    import random

    r = random.Random(4)
    for _ in range(50):
        bins, plain = Bins(20, 2), []
        for _ in range(60):
            size, cluster, source = r.randint(1, 20), 1 << r.randint(0, 5) if r.random() < 0.5 else 0, 1 << r.randint(0, 2)
            fits = [(b["room"], b["since"], i) for i, b in enumerate(plain) if b["room"] >= size and not b["clusters"] & cluster and b["sources"].count(source) < 2]
            got = bins.put(size, cluster, source)
            if fits:
                assert got in [i for room, _, i in fits if room == min(fits)[0]]
            else:
                assert got == len(plain)
                plain.append({"room": 20, "since": 0, "clusters": 0, "sources": []})
            b = plain[got]
            b["room"] -= size
            b["clusters"] |= cluster
            b["sources"].append(source)


def test_whole_table(small):
    cfg = PackingConfig(shard=60)
    want = {r["doc_id"]: (r["n_tokens"], r["source"], r["cluster"]) for r in items(small).collect()}
    rows = pack(items(small), cfg).collect()
    _, total = check(rows, cfg, want)
    assert total == {d: n for d, (n, _, _) in want.items()}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack(items(small.repartition(7)), cfg).collect()))


def test_rows_by_plain_search(spark, small):
    """Every bin and slot, from the definition; with texts over 100,000 tokens and equal rows among them."""
    long = spark.createDataFrame([(10_000, 150_000, "s", None), (10_001, 64, None, 5), (10_001, 64, None, 5), (10_002, 64, None, None)], "doc_id long, n_tokens long, source string, cluster long")
    table = items(small).unionByName(long)
    for cfg in (PackingConfig(), PackingConfig(capacity=900, per_source=2, shard=70)):
        given = {(r["doc_id"], r["n_tokens"]): (r["source"], r["cluster"]) for r in table.collect()}
        size = {d: n for d, n in given}
        shards = defaultdict(list)
        got = [tuple(r) for r in pack(table, cfg).collect()]
        for doc, part, start, n, bin_id, slot, used in got:
            assert start == part * cfg.capacity and n == min(size[doc] - start, cfg.capacity)
            source, cluster = given[doc, size[doc]]
            shards[bin_id >> 32].append((-n, doc, part, source, cluster))
        assert sum(map(len, shards.values())) == sum(-(-r["n_tokens"] // cfg.capacity) for r in table.collect())
        want = []
        for shard, rows in shards.items():
            bins = []  # [room, when it came to that room, rows]
            for turn, row in enumerate(sorted(rows, key=lambda x: x[:3])):
                n, source, cluster = -row[0], *row[3:]
                fits = [b for b in bins if b[0] >= n and (source is None or sum(x[3] == source for x in b[2]) < cfg.per_source) and (cluster is None or all(x[4] != cluster for x in b[2]))]
                b = min(fits, key=lambda b: b[:2], default=None)
                if b is None:
                    bins.append(b := [cfg.capacity, 0, []])
                b[:2] = b[0] - n, turn
                b[2].append(row)
            want += [(x[1], x[2], x[2] * cfg.capacity, -x[0], (shard << 32) + i, k, cfg.capacity - b[0]) for i, b in enumerate(bins) for k, x in enumerate(b[2])]
        assert sorted(got) == sorted(want)


def test_hard_rows(spark, hard, nothing):
    cfg = PackingConfig(capacity=64)
    good = hard.where("doc_id is not null")
    got = pack(items(hard), cfg)
    assert got.groupBy("doc_id").count().count() == good.select("doc_id").distinct().count()
    assert {r["doc_id"]: r["n_tokens"] for r in got.where("doc_id in (4, 5, 7)").collect()} == {4: 1, 5: 1, 7: 2}
    parts = sorted((r["part"], r["start"], r["n_tokens"]) for r in got.where("doc_id = 12").collect())
    assert all(s == 64 * p for p, s, _ in parts) and all(n == 64 for _, _, n in parts[:-1])
    assert pack(items(nothing)).collect() == []
    near = items_of(good, MODEL, good.where("doc_id < 4").selectExpr("doc_id", "1L component_id"))
    assert {r["doc_id"] for r in near.where("cluster = 1").collect()} == {1, 2, 3}
    together = pack(near).where("doc_id < 4").collect()
    assert len({r["bin_id"] for r in together}) == 3
    null = spark.createDataFrame([(1, None, None, None), (2, -3, None, None)], "doc_id long, n_tokens long, source string, cluster long")
    assert {r["n_tokens"] for r in pack(null).collect()} == {1}
