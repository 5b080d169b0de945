"""Encoding by backtracking against the library that the model file belongs to."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corploom.llm.piece_bpe import BLOCK, PieceBpe, decode, encode, id_arrays, piece_bpe
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def check(text):
    raw, want = piece_bpe(PATH).encode(text), LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids(raw) == want
    assert piece_bpe(PATH).decode(np.frombuffer(raw, dtype="<u4")) == LIBRARY.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_mixed_pieces():
    rng = random.Random(4)
    pool = ["a", "b", "th", "er", " ", "  ", "\n", "▁", "é", "😀", "中", "国", "1", "23", ".", "...", "\t", "\x00", "ing", " the", "ß", "́", "Ω", "xxxxx", "\r\n", "　"]
    for _ in range(3000):
        check("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))))


@pytest.mark.parametrize("unit", [" ", "\n", "a", "ab", "中", "😀", "the ", "x▁"])
def test_long_runs(unit):
    check(unit * 60_000)


def test_very_long_text():
    check("of the people, " * (3 * BLOCK // 15))  # cut into blocks
    check(" " * (3 * BLOCK))


def test_given_documents(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in texts:
        check(text or "")


def test_forgetting_changes_nothing(monkeypatch):
    import corploom.llm.piece_bpe as module

    monkeypatch.setattr(module, "MOST_CHUNKS", 5)
    monkeypatch.setattr(module, "MOST_PAIRS", 5)
    model = PieceBpe(PATH)
    for text in ("one two three four five six seven eight nine ten " * 3, "ten nine eight seven six five four three two one"):
        assert ids(model.encode(text)) == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_decoding_any_ids():
    rng = random.Random(5)
    for _ in range(3000):
        some = [rng.choice([rng.randrange(300), rng.randrange(32000), rng.choice([259, 28705, 2, 1, 0])]) for _ in range(rng.randint(0, 12))]
        assert piece_bpe(PATH).decode(np.array(some, dtype="<u4")) == LIBRARY.decode(some), some


def test_rows(spark):
    texts = [None, "", "Hello  world", "Hello  world", "é\n😀 " * 50, "x" * 100_000]
    docs = spark.createDataFrame([(k if k else None, t, "a", b"b", 3) for k, t in enumerate(texts)], "doc_id long, text string, lang string, ids binary, n_tokens int").repartition(3)
    rows = encode(docs, PATH)
    got = {r["doc_id"]: (ids(r["ids"]), r["text"]) for r in decode(rows, PATH).collect()}
    want = {k if k else None: LIBRARY.encode(t or "", add_bos=True, add_eos=True) for k, t in enumerate(texts)}
    assert got == {k: (v, LIBRARY.decode(v)) for k, v in want.items()}
    assert {r["doc_id"]: r["ids"] for r in id_arrays(rows).collect()} == want
    assert encode(docs.limit(0), PATH).collect() == []
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).collect()[0]["text"] == ""


def test_query(spark):
    from corploom.llm.queries import op11_piece_encoding

    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op11_piece_encoding(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        found = LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(found), hashlib.sha256(np.array(found, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(found).encode()).hexdigest()))
    assert got == sorted(want)
