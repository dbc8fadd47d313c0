"""Encoding and decoding against the tokenizers library, merges against a plain merging of neighbours."""

import hashlib
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardframe.llm import bpe, queries
from boardframe.llm.bpe import Codec, Merges

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return Codec(path), tokenizers.Tokenizer.from_file(path)


def same(both, text):
    own, library = both
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert ids == array("I", want).tobytes()
    assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


MARKED = ["a", "ab", "the", "J̌", "T̈", "İ", "İ", "ß", "ς", "Σ", "日本", "한", "ᄀ", "ᅡ", "😀", "'s", "'LL", "1", ".,", " ", "\n", " ", "\u0085", "​", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(MARKED), max_size=25).map("".join)))
def test_any_text(both, text):
    same(both, text)


def test_documents(spark, both):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        same(both, row["text"])


def test_memory_is_bounded(monkeypatch, both):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    own = Codec(public_tokenizers.path(FILES[0]))
    text = " ".join(f"word{i % 13} Ünï{i % 9}" for i in range(200))
    want = tokenizers.Tokenizer.from_file(public_tokenizers.path(FILES[0])).encode(text, add_special_tokens=False).ids
    assert own.encode(text) == array("I", want).tobytes() and len(own) <= 5 and len(own.pieces) <= 5


@pytest.mark.parametrize("seed", range(60))
def test_any_merges(seed):
    """Random vocabularies, with many merges that never happen; a piece is merged where the merge comes first, the leftmost of equal ones."""
    rng = random.Random(seed)
    names, merges = list("abc"), []
    for _ in range(25):
        a, b = rng.choice(names), rng.choice(names)
        if a + b not in names and len(a + b) < 9:
            names.append(a + b)
            merges.append((a, b))
    own = Merges({"type": "BPE", "vocab": {x: i for i, x in enumerate(names)}, "merges": merges})
    for _ in range(200):
        piece = rng.choices("abc", k=rng.randint(1, 20))
        want = list(piece)
        while found := [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(want, want[1:])) if (a, b) in merges]:
            _, i = min(found)
            want[i : i + 2] = [want[i] + want[i + 1]]
        assert [names[i] for i in own.encode([names.index(x) for x in piece])] == want


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Merges({"type": "Unigram", "vocab": {}, "merges": []})
    with pytest.raises(ValueError):
        Merges({"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, "merges": [["a", "b"], ["b", "c"], ["a", "bc"], ["ab", "c"]]})


def test_query_and_edges(spark, tmp_path):
    path = public_tokenizers.path(FILES[0])
    library = tokenizers.Tokenizer.from_file(path)
    texts = [(1, "Hello, World!"), (1, "Hello, World!"), (2, None), (3, ""), (4, " \t"), (None, "x"), (5, "y" * 100_000), (6, "some words " * 60_000), (7, "<|endoftext|>")]
    docs = spark.createDataFrame([(*t, 0, b"") for t in texts], "doc_id long, text string, n_tokens int, ids binary")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op13_bpe_codec(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    encoded = bpe.encode(docs, path)
    assert encoded.columns == ["doc_id", "ids"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).where("doc_id IN (1, 2, 7)").collect()}
    assert back == {1: "hello</w> ,</w> world</w> !</w>", 2: "", 7: "<|endoftext|>"}
    assert bpe.encode(docs.limit(0), path, decoded=True).count() == 0
