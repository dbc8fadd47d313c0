import random

import pytest

from boardframe.llm.line_dedup import line_dedup


def near(a, b):
    """Whether one edit apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[k + (len(a) == len(b)) :] == long[k + 1 :]


def brute(docs, min_chars=4):
    lines = [(doc, n + 1, line.strip(" \t\r\f\v").lower()) for doc, text in docs if text is not None for n, line in enumerate(text.split("\n"))]
    lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = []
    for i, (doc, n, line) in enumerate(lines):
        if not line:
            out.append((doc, n, doc, n, True, "blank"))
            continue
        j = next(j for j in range(i + 1) if lines[j][2] == line or min(len(line), len(lines[j][2])) >= min_chars and near(lines[j][2], line))
        out.append((doc, n, *lines[j][:2], i == j, "first" if i == j else "later"))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    base = [text(n) for n in (18, 19, 20, 21, 33, 64, 65, 66, 127, 130, 131, 400, 3000)]
    lines = base + [text(5), "", " ", "Word", "word", "wort", "a", "b", "ab", "}", "abc", "ac", "xyz", "abcd", "é"]
    for line in base:
        for _ in range(6):
            x = list(line)
            for _ in range(rng.choice([1, 1, 1, 2])):
                k = rng.randrange(len(x))
                x[k : k + rng.choice([0, 1])] = rng.choice(["", "Z", "é", "a"])
            lines.append("".join(x))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 8 : i * 8 + 8])) for i in range(len(lines) // 8 + 1)]
    return docs + [(50, None), (51, ""), (None, "no id\n" + base[4])]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, line string, first int").repartition(3)
    got = sorted((tuple(r) for r in line_dedup(frame).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == brute(docs)


@pytest.mark.parametrize("least", [1, 2, 3, 4, 20])
def test_short_lines_against_all_pairs(spark, least):
    rng = random.Random(3)
    lines = ["heti eror anesti.", "heti, eror anesti.", "page", "pages", "abc", "abd", "ab", "a"]
    for n in [*range(1, 24)] * 4:
        line = "".join(rng.choice("abé ") for _ in range(n))
        k = rng.randrange(n)
        lines += [line, line[:k] + rng.choice(["", "x", "xé"]) + line[k + 1 :], line[:k] + "y" + line[k + 1 :]]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(len(lines) // 7 + 1)]
    got = sorted(tuple(r) for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=least).collect())
    assert got == brute(docs, least)


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([(1, "one line of some length"), (1, "one line of some length")], "doc_id long, text string")
    assert [r["kept"] for r in line_dedup(frame).collect()] == [True, True]
    assert line_dedup(frame.where("false")).count() == 0


def test_native(spark):
    plan = line_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
