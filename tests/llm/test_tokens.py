import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from folioscope.llm import unigram
from folioscope.llm.tokenfile import EliasFano, TokenFile, WordCachedEncoder, tokens_round_trip, write_file

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "\n", "a", "b", "é", "'s", "1", "\t", "!", "  ", ".", ",", "_", "\x1c", "the", "<|endoftext|>", "\r", "日", "▁", " ", "\U0001f600", "ing"]


@pytest.mark.parametrize("top", [1, 2, 50, 10**6])
def test_elias_fano(top):
    r = np.random.default_rng(top)
    for n in (1, 2, 255, 256, 257, 2000):
        v = np.concatenate([[0], np.cumsum(r.integers(0, top, n))]).astype(np.int64)
        code = EliasFano.encode(v)
        assert (code.all() == v).all()
        assert all(code.at(i) == v[i] for i in range(0, len(v), 3))
        assert code.low_bits * len(v) / 8 + len(code.highs) * 8 <= len(v) * (2 + np.log2(v[-1] / len(v) + 1) + 1) / 8 + 16


def test_file(tmp_path):
    fs, docs = pafs.LocalFileSystem(), [np.arange(n, dtype="<u2") for n in (3, 0, 700, 1)]
    write_file(fs, str(tmp_path / "x.tok"), iter([(np.array([5, 6, 9]), [d.tobytes() for d in docs[:3]]), (np.array([12]), [docs[3].tobytes()])]), 2)
    f = TokenFile(fs, str(tmp_path / "x.tok"))
    assert f.doc_ids.tolist() == [5, 6, 9, 12] and all((f.document(i) == d).all() for i, d in enumerate(docs))
    (tmp_path / "y.tok").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError):
        TokenFile(fs, str(tmp_path / "y.tok"))


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x, add_special_tokens=False).ids, 2]


def test_pieces_encode_as_the_whole():
    r, whole, encode = random.Random(3), library(), WordCachedEncoder(BPE, 2, most=500)
    for _ in range(400):
        texts = ["".join(r.choices(ODD, k=r.randint(0, 25))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        got = encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [np.frombuffer(g, dtype="<u2").tolist() for g in got] == [whole(t) for t in texts]


def test_round_trip_of_files(hard, nothing):
    got = sorted(tuple(r) for r in tokens_round_trip(hard, BPE).collect())
    whole, start, want = library(), 0, []
    for d, t in sorted(((r["doc_id"], r["text"] or "") for r in hard.collect() if r["doc_id"] is not None)):
        ids = np.array(whole(t), dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens_round_trip(nothing, BPE).collect() == []


def test_added_tokens_as_the_loaded_tokenizer_reads_them(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain text, and more.", "<|endoftext|>", "", "x<|endoftext|><|endoftext|>\n y", "<|endof", "text|> z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t, start, want = Tokenizer.from_file(BPE), 0, []
    for d, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens_round_trip(docs, BPE).collect()) == want
    assert want[0][2] == 5


# -- unigram ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def loaded():
    """The solver of the vocabulary file, and the library with the same unigram model."""
    import sentencepiece

    return unigram.solver(PIECES), sentencepiece.SentencePieceProcessor(model_proto=unigram.as_unigram(PIECES))


def encoded(solver, texts):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [ids[a:b].tolist() for _, ids, ptr in unigram.encode_texts(iter([batch]), solver) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


def test_encoding_and_decoding_as_the_library(loaded):
    solver, sp = loaded
    r = random.Random(1)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 14))) for _ in range(1500)] + [None, "", "x" * 300, "日本" * 200, "the " * 50]
    for text, ids in zip(texts, encoded(solver, texts), strict=True):
        assert ids == sp.encode(text or "")
        assert solver.decode(np.array(ids, dtype=np.int64)) == sp.decode(ids) == (text or "").replace("▁", " ")


def test_whole_table_as_the_library(spark, hard, small, loaded):
    """Ids and counts of every document; common words are single pieces."""
    _, sp = loaded
    for df in (hard.where("doc_id is not null"), small):
        texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = sorted((d, sp.encode(t)) for d, t in texts)
        assert sorted((r["doc_id"], list(r["ids"])) for r in unigram.encode(df, PIECES).collect()) == want
        assert sorted((r["doc_id"], r["n_tokens"]) for r in unigram.token_counts(df, PIECES).collect()) == [(d, len(x)) for d, x in want]
        crc = [(d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in want]
        assert sorted((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in unigram.round_trip(df, PIECES).collect()) == sorted(crc)
    assert [sp.encode_as_pieces(w) for w in ("one", "the language")] == [["▁one"], ["▁the", "▁language"]]


def test_unigram_files_stay_as_they_are(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(unigram.as_unigram(PIECES))
    model.pieces[300].score = -1.25
    (tmp_path / "m").write_bytes(model.SerializeToString())
    assert unigram.as_unigram(str(tmp_path / "m")) == model.SerializeToString()


def test_decoding_of_broken_bytes(loaded):
    solver, sp = loaded
    for ids in ([3 + 0xE3, 3 + 0x81], [3 + 0xFF, 300], []):
        assert solver.decode(np.array(ids, dtype=np.int64)) == sp.decode(ids)


def test_counts_as_encoding(spark, hard, nothing, small):
    for df in (hard, small):
        n = {(r["doc_id"], r["n_ids"]) for r in unigram.round_trip(df, PIECES).collect()}
        assert n == {(r["doc_id"], r["n_tokens"]) for r in unigram.token_counts(df, PIECES).collect()}
        ids = unigram.encode(df, PIECES)
        assert {(r["doc_id"], len(r["ids"])) for r in ids.collect()} == n
        texts = {(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()}
        assert {(r["doc_id"], r["text"]) for r in unigram.decode(ids, PIECES).collect()} == texts
    assert unigram.token_counts(nothing, PIECES).collect() == unigram.round_trip(nothing, PIECES).collect() == []


def test_best_path_by_brute_force():
    rows = [(0, "<unk>", 0.0, False, True, False)] + [(i, p, s, False, False, False) for i, (p, s) in enumerate([("▁", -3.0), ("a", -2.0), ("ab", -3.0), ("b", -1.0), ("ba", -3.0), ("aba", -6.0), ("▁a", -5.0)], 1)]
    solver = unigram.Solver(unigram.Vocabulary.build(rows, 0))
    scores = {p: s for _, p, s, *_ in rows[1:]}

    def best(text):
        table = {0: (0.0, ())}
        for e in range(1, len(text) + 1):
            options = [(table[s][0] + scores[text[s:e]], s) for s in range(e) if text[s:e] in scores and s in table]
            if text[e - 1] not in scores and e - 1 in table:
                options.append((table[e - 1][0] - 16, e - 1))
            top = max(o[0] for o in options)
            s = min(s for v, s in options if v == top)
            table[e] = (top, (*table[s][1], text[s:e]))
        return table[len(text)]

    r = random.Random(5)
    texts = ["".join(r.choices("abc ", k=r.randint(1, 9))) for _ in range(300)]
    for text, ids in zip(texts, encoded(solver, texts), strict=True):
        score, pieces = best("▁" + text.replace(" ", "▁"))
        assert [rows[i][1] if i else "c" for i in ids] == list(pieces)
        chunk = np.frombuffer(("▁" + text.replace(" ", "▁")).encode(), dtype=np.uint8)[None, :]
        assert [x[0] for x in solver.count(chunk, np.array([chunk.shape[1]]))] == [len(pieces), score]
