from folioscope.llm.suffix import SuffixConfig, brute_force, digest, remove_repeats


def check(df, cfg):
    got = digest(remove_repeats(df.select("doc_id", "text", "lang"), cfg)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect() if r["doc_id"] is not None}
    want = brute_force(texts, cfg.length)
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] != 11} == {d: v for d, v in want.items() if d != 11}
    return {r["doc_id"]: r for r in got}


def test_brute_force(small):
    check(small, SuffixConfig())


def test_crowded_names_take_the_exact_way(small):
    check(small, SuffixConfig(shard=2))


def test_hard_rows(hard):
    got = check(hard.where("doc_id <> 11"), SuffixConfig(length=60, window=24, gram=8))
    assert got[4]["n_bytes"] == got[5]["n_bytes"] == 0


def test_repeated_rows_are_copies(hard):
    got = digest(remove_repeats(hard.where("doc_id = 11"), SuffixConfig())).collect()
    assert len(got) == 2 and all(r["n_removed"] == r["n_bytes"] > 400 for r in got)


def test_empty_table(nothing):
    assert remove_repeats(nothing).collect() == []


def test_text_keeps_whole_characters(hard):
    rows = remove_repeats(hard.select("doc_id", "text"), SuffixConfig(length=61, window=24, gram=8), as_text=True).collect()
    assert all(isinstance(r["kept"], str) for r in rows)
