import hashlib
import random

from boardframe.llm import suffix_dedup
from boardframe.llm.suffix_dedup import dedup_strings


def brute(docs, length):
    """docs in order; every window against all earlier ones."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, x in zip(raw, gone) if not x)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, base = text(25), text(150)
    docs = [text(rng.randint(0, 120)) for _ in range(15)]
    docs += [base, base, base[:300] + "X" + base[300:], base[50:400], f"{text(5)} {common} {text(9)}", f"{text(12)} {common}", common, f"{common} {common}", "ab" * 400, "a" * 350, "a" * 99, "a" * 100, None, "", "é" * 70, base + base]
    docs += [base[: k * 40] + text(2) + base[k * 40 :] for k in range(12)]
    rng.shuffle(docs)
    return docs


def compare(spark, docs, length=100):
    rows = [(i, t, 1, "x") for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doc int, twin string").repartition(5)
    got = [tuple(r)[1:5] for r in sorted(dedup_strings(frame, length=length).collect())]
    assert got == brute([(i, t) for i, t, *_ in rows], length)


def test_against_all_windows(spark):
    compare(spark, corpus(0))
    compare(spark, corpus(1), 64)


def test_ranks_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 1)
    compare(spark, corpus(2))


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 20)
    compare(spark, corpus(3))


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(5).choices("abcdefghij ", k=150))
    frame = spark.createDataFrame([(7, text), (7, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(dedup_strings(frame).collect(), key=lambda r: (r["n_bytes"], r["n_removed"]))
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(None, 0), (None, 0), (7, 150), (7, 150)]
    assert dedup_strings(frame.where("false")).count() == 0
