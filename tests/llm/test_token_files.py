import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardframe.llm.packing import pack_documents
from boardframe.llm.token_files import TokenFile, pack, to_file, token_files, unpack, width
from boardframe.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "one two, three.", "It's a <|endoftext|> b <|ENDOFTEXT|>", "É́ x y ΑΣ. İstanbul 12.5%% don't", "word " * 9000, "the same", "the same", "a\x1cb c"]
ROWS = [(i, t, "own", "x") for i, t in enumerate(TEXTS)] + [(6, "the same", "own", "x"), (None, "no id", "own", "x")]
SCHEMA = "doc_id long, text string, start string, length string"


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids + [2]


@given(st.lists(st.integers(0, 2**16 - 1)), st.integers(16, 32))
@settings(max_examples=60, deadline=None)
def test_bits(ids, bits):
    flat = np.array(ids, "<u4")
    assert unpack(pack(flat, bits), bits, len(ids)).tolist() == ids


def test_width_and_random_access():
    assert [width(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 1000, n).astype("<u4") for n in (0, 5, 9000, 4096, 1)]
    file = TokenFile(to_file([3, None, 5, 6, 7], [x.tobytes() for x in ids], 10))
    assert [file.document(i).tolist() for i in range(5)] == [x.tolist() for x in ids]
    assert [(d, x.tolist()) for d, x in file.documents(100)] == [(d, x.tolist()) for d, x in zip([3, None, 5, 6, 7], ids)]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_give_the_library_s_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == plain(text)


ENCODER = Encoder(PATH, 2)


def test_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = sorted(token_files(docs, PATH, end_id=2, vocab_size=49_408).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for doc, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(plain(text), "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == want
    assert token_files(docs.where("false"), PATH, end_id=2, vocab_size=49_408).count() == 0


def check_packing(docs, rows, tiers=(512, 1024, 2048, 4096)):
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    ids = {}
    for doc, text in docs:
        ids.setdefault((doc, len(x := plain(text))), []).append(np.array(x, "<u4"))
    assert pieces.keys() == ids.keys()
    for key, same in pieces.items():
        texts = ids[key]
        spans = sorted((r["start"], r["length"]) for r in same)
        assert sum(n for _, n in spans) == key[1] * len(texts)
        if len(texts) == 1:
            at = 0
            for r in sorted(same, key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(texts[0][at : at + r["length"]].tobytes())
                at += r["length"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for same in sequences.values():
        at = 0
        for r in sorted(same, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at + same[0]["padding"] == same[0]["window"]
        padding += same[0]["padding"]
    return padding, len(sequences)


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = pack_documents(docs, PATH, end_id=2).collect()
    check_packing([(r[0], r[1]) for r in ROWS], rows)
    assert pack_documents(docs.where("false"), PATH, end_id=2).count() == 0


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pack_documents(docs, PATH, end_id=2, step_tokens=8192).collect()
    padding, _ = check_packing([(r[0], r[1]) for r in docs.collect()], rows)
    assert padding < 4096
    steps = {}
    for r in rows:
        if not r["padding"]:
            steps.setdefault((r["window"], r["step_group"]), 0)
            steps[r["window"], r["step_group"]] += r["length"]
    assert all(n <= 8192 for n in steps.values())
