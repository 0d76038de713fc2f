from folioscope.llm.minhash import MinHashConfig, near_duplicates


def exact(texts, width):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.setdefault(d, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else sets.setdefault(d, set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(df, width):
    got = near_duplicates(df, MinHashConfig(width=width)).collect()
    want = exact([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None], width)
    assert len(got) == df.where("doc_id is not null").count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_brute_force(small):
    check(small, 2)


def test_hard_rows(hard):
    check(hard, 5)


def test_empty_table(nothing):
    assert near_duplicates(nothing).collect() == []


def test_family_whose_smallest_member_links_nobody(spark):
    """All meet in table entries whose smallest member is like none of them; the others link among themselves."""
    core = [f"c{i}" for i in range(100)]
    docs = [(0, " ".join(core[:76] + [f"z{i}" for i in range(24)]))]
    docs += [(d, " ".join(core[:95] + [f"e{d}x{i}" for i in range(3)])) for d in range(1, 12)]
    check(spark.createDataFrame(docs, "doc_id long, text string"), 1)


def test_entries_whose_smallest_member_is_too_large(spark):
    """1,000 texts of smaller id and 52 own words embed a passage; two that are almost only the passage meet in their entries alone."""
    passage = " ".join(f"p{i}" for i in range(200))
    own = lambda d, n: " ".join([passage, *(f"o{d}x{i}" for i in range(n))])
    docs = [(d, own(d, 52)) for d in range(1000)] + [(1000, own(1000, 1)), (1001, own(1001, 1))]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), MinHashConfig(width=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: min(d, 1000) for d, _ in docs}
