"""The ten registered queries, each over the whole smallest tables, against SQL, a library or plain definitions."""

import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from folioscope.llm.common import _LIVE, owned, release
from folioscope.llm.queries import ORACLES, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())


def test_quality_scores(spark, duck, texts):
    rows = QUERIES["op2_byte_conv_quality"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    quality = dict(duck.execute("select doc_id, quality from labels").fetchall())
    good, bad = ([r["score"] for r in rows if r["held_out"] and quality.get(r["doc_id"]) == q] for q in (1, 0))
    wins = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert not wins or sum(wins) / len(wins) > 0.8


def test_neighbours(spark, duck):
    """Recall on the test table against an exact search; rows, ranks and scores of what is found."""
    rows = QUERIES["op3_kmeans_tree_neighbours"](spark, FOLDER).toPandas()
    ids, x = zip(*duck.execute("select vec_id, embedding::double[] from embeddings order by 1").fetchall(), strict=True)
    ids, x = np.array(ids), np.array(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    asked = ids[ids % 50 == 0]
    assert set(rows.query_id) == set(asked) and len(rows) == 5 * len(asked)
    for q in asked:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        own = rows[rows.query_id == q].sort_values("rank")
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(own.vec_id))
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and list(own.score) == sorted(own.score, reverse=True)
        assert np.allclose(own.score, [s[ids == v][0] for v in own.vec_id], atol=1e-12)
    assert hit / len(rows) >= 0.9


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op5_elias_fano_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_packing(spark, texts):
    rows = QUERIES["op8_conflict_best_fit_packing"](spark, FOLDER).toPandas()
    tokens = {r["doc_id"]: r["n_tokens"] + 1 for r in QUERIES["op10_unigram_token_counts"](spark, FOLDER).collect()}
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == tokens
    assert (rows.groupby("bin_id").n_tokens.sum() == rows.groupby("bin_id").used.first()).all() and rows.used.max() <= 4096


def test_counts_are_those_of_the_ids(spark, texts):
    nine = {r["doc_id"]: r for r in QUERIES["op9_unigram_round_trip"](spark, FOLDER).collect()}
    ten = {r["doc_id"]: r for r in QUERIES["op10_unigram_token_counts"](spark, FOLDER).collect()}
    assert nine.keys() == ten.keys() == texts.keys()
    assert all(nine[d]["n_ids"] == ten[d]["n_tokens"] and math.isfinite(ten[d]["score"]) for d in texts)
    assert all(nine[d]["same"] for d, t in texts.items() if "▁" not in (t or ""))


def test_scratch_goes_with_its_owner(spark):
    from folioscope.llm.suffix import digest, remove_repeats

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, tables = len(_LIVE), {t.name for t in spark.catalog.listTables()}
    with owned():
        digest(remove_repeats(docs.limit(20))).collect()
        assert len(_LIVE) > before
    assert len(_LIVE) == before and {t.name for t in spark.catalog.listTables()} == tables
    digest(remove_repeats(docs.limit(20))).collect()
    release(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000
    assert not _LIVE and not [t for t in spark.catalog.listTables() if t.name.startswith(("texts_", "level_"))]


@pytest.fixture(scope="module")
def long_texts(spark):
    """A text of over a megabyte without repeats, a near copy of it, and a short one that shares a passage with both; columns whose names clash with the operators' own."""
    import random

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(130_000)]
    passage = " ".join(words[60_000:60_100])
    near = [*words[:129_000], *("x" + w for w in words[129_000:])]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, f"Q {passage} Z")]
    assert len(rows[0][1]) > 1 << 20
    names = "key h1 k1 code part shard pos lo score kept component vec_id rank n_tokens ids items start family size".split()
    return spark.createDataFrame([(*row, *names) for row in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)), words, passage


def test_long_texts(spark, long_texts):
    from tokenizers import Tokenizer

    from folioscope.llm import automaton, minhash, suffix, tokenfile, unigram

    docs, words, passage = long_texts
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs, minhash.MinHashConfig(width=2)).collect()}
    assert [near[d]["component_id"] for d in (1, 2, 3)] == [1, 1, 3] and near[1]["n_shingles"] == len(words) - 1
    cut = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect()}
    same = len(" ".join(words[:129_000])) + 1
    assert cut[1]["n_removed"] == cut[2]["n_removed"] == same and cut[3]["n_removed"] in range(len(passage), len(passage) + 3)
    assert cut[1]["kept"] == text[1].encode()[same:] and cut[1]["key"] == "key"
    first = {r["doc_id"]: r for r in automaton.remove_earlier(docs).collect()}
    assert (first[1]["n_removed"], first[2]["n_removed"], first[3]["n_removed"], first[3]["kept"]) == (0, 129_000, 100, "Q Z")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokenfile.tokens_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert sizes == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in text.items()}
    model = public_tokenizers.path("piece_bpe_32k.model")
    nine, ten = ({r["doc_id"]: r for r in f(docs, model).collect()} for f in (unigram.round_trip, unigram.token_counts))
    assert all(nine[d]["same"] and nine[d]["n_ids"] == ten[d]["n_tokens"] for d in text)
