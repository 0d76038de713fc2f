import random

from folioscope.llm.automaton import Automaton, AutomatonConfig, brute_force, digest, remove_earlier


def check(df, cfg):
    got = {r["doc_id"]: tuple(r)[1:] for r in digest(remove_earlier(df.select("doc_id", "text", "lang"), cfg)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"] is not None}
    assert got == brute_force(texts, cfg.width)


def test_brute_force(small):
    check(small, AutomatonConfig())


def test_crowded_grams_take_the_exact_way(small):
    check(small, AutomatonConfig(shard=2))


def test_hard_rows(hard):
    check(hard.where("doc_id <> 11"), AutomatonConfig(width=5, gram=3))


def test_rows_that_share_an_id_remove_nothing_of_one_another(hard):
    rows = remove_earlier(hard.where("doc_id = 11"), AutomatonConfig()).collect()
    assert len(rows) == 2 and all(r["n_removed"] == 0 for r in rows)


def test_empty_table(nothing):
    assert remove_earlier(nothing).collect() == []


def test_automaton_against_search():
    r = random.Random(1)
    for _ in range(100):
        parts = [([r.randint(0, 2) for _ in range(r.randint(1, 12))], r.randint(0, 9)) for _ in range(r.randint(1, 8))]
        a = Automaton(parts)
        words = [r.randint(0, 2) for _ in range(12)]
        for width in (1, 3, 5):
            want = []
            for i in range(len(words) - width + 1):
                owners = [o for p, o in parts if any(p[j : j + width] == words[i : i + width] for j in range(len(p) - width + 1))]
                want.append(min(owners, default=-1))
            assert a.first_owners(words, width) == want
