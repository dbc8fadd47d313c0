import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from boardframe.llm.decontaminate import MARKS, canonical, decontaminate, ends, templates

WORDS = ["alpha", "beta", "gamma", "delta", "and", "of", "runs", "to", "sells", "each", "with", "left", "after", "how", "many", "does"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ","]) + str(rng.randint(0, 9)) * 0 for _ in range(n))


def brute(docs, items, n=8, coverage=0.25):
    """Windows of templates, one by one."""

    def windows(t):
        words, opens, out = (t or "").split(), True, []
        forms = []
        for w in words:
            forms.append(canonical(w, opens))
            opens = ends(w)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            part = forms[i : i + size]
            if 2 * sum(f.startswith("<") and f.endswith(">") for f in part) <= size:
                out.append((i, tuple(part), [w.strip(MARKS).lower() if f[:1] == "<" else None for w, f in zip(words[i : i + size], part)]))
        return out

    cut = {k: windows(t) for k, t in items}
    found = {}
    for d, t in docs:
        own = windows(t)
        hits = []
        for k, mine in cut.items():
            pairs = [(i - j, j, a, b) for i, x, b in own for j, y, a in mine if x == y]
            bad = set()
            for s, *_ in pairs:
                seen, back = {}, {}
                for s2, _, a, b in pairs:
                    if s2 == s:
                        for p, q in zip(a, b):
                            if p is not None and (seen.setdefault(p, q) != q or back.setdefault(q, p) != p):
                                bad.add(s)
            places = {j for s, j, *_ in pairs if s not in bad}
            if mine and len(places) / len(mine) >= coverage and (len(places) > 1 or len(mine) == 1):
                hits.append(k)
        found[d] = sorted(hits)
    return found


def test_templates():
    assert [canonical(w, False) for w in ("3.5kg", "$4,000", "km", "Ada,", "ada", "50%", "**")] == ["<num>", "<num>", "<unit>", "<name>", "ada", "<num>", ""]
    assert canonical("Ada", True) == "ada"


@given(st.text("aAé Éß.1k5 m|*İ\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_templates_of_a_text(text):
    words, opens, forms = re.split(r"[ \t-\r]+", text.strip(" \t\n\v\f\r")) if text.strip(" \n") else [], True, []
    for w in words:
        forms.append(canonical(w, opens))
        opens = ends(w)
    hashes, slots = templates(text)
    assert slots.tolist() == [f in ("<num>", "<unit>", "<name>") for f in forms]
    assert len(set(zip(forms, hashes.tolist()))) == len(set(forms)) == len(set(hashes.tolist()))


def test_against_windows(spark):
    rng = random.Random(1)
    items = [(i, text(rng, rng.choice([3, 7, 8, 20, 40]))) for i in range(12)]
    question = "A train with 40 cars leaves Paris and after 40 minutes how many cars does Ada with 7 friends left to sells each of them"
    items += [(20, question), (21, None), (22, "")]
    docs = [(i, text(rng, 30)) for i in range(10)]
    docs += [(30 + i, f"{text(rng, 9)}. {t} {text(rng, 5)}") for i, t in items if t]
    docs += [(60, question.replace("40", "55").replace("Ada", "Bob").replace("Paris", "Rome")), (61, question.replace("40 cars", "55 cars").replace("Ada", "Bob")), (62, None), (63, ""), (64, items[0][1]), (65, items[4][1].upper())]
    docs += [(60, docs[-4][1]), (None, question)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, id int")
    found = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["item_ids"]) for r in found), key=key)
    assert got == sorted(((d, brute([(d, t)], items)[d]) for d, t in docs), key=key)
    assert (60, [20]) in got and (None, [20]) in got


def test_rows_of_one_doc_id_are_judged_apart(spark):
    question = "A train with 40 cars leaves Paris and after 40 minutes how many cars does Ada with 7 friends left to sells each of them"
    docs = [(1, question.replace("40", "55")), (1, question.replace("40", "66")), (1, question.replace("40 cars", "66 cars")), (1, None), (1, question.replace("40", "55"))]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, question)], "item_id long, text string"))
    assert sorted(r["contaminated"] for r in found.collect()) == [False, False, True, True, True]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["contaminated"], r["n_items"]) for r in decontaminate(docs, none).collect()] == [(False, 0)]
    assert decontaminate(docs.where("false"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_copies_of_any_item(spark):
    rng = random.Random(5)
    long = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    items = [(1, "Which alpha runs beta"), (2, "THE TOWN OF PARIS HAS FOUR OLD BRIDGES AND TWO NEW ONES"), (3, "Mix 5 kg 7 g 9 m 12 km 3 l 8 h"), (4, " ".join(long))]
    filler = lambda n: " ".join(rng.choice(["red", "blue", "green", "grey"]) for _ in range(n))
    inside = lambda t: f"{filler(12)}. {t} {filler(12)}"
    docs = [(k, inside(t)) for k, t in items] + [(5, inside(" ".join(long[20:33]))), (6, inside(" ".join(long[20:31]))), (7, inside(items[1][1].replace("PARIS", "ROME").replace("OLD", "RED"))), (8, inside(items[2][1].replace("7", "6").replace("12", "11"))), (9, items[0][1])]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), short=True)
    assert {r["doc_id"]: r["item_ids"] for r in found.collect()} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [4], 6: [], 7: [], 8: [], 9: [1]}


def test_slots_are_one_to_one(spark):
    """Two values of an item may not become one, nor one two."""
    item = "then Ada paid Ben exactly 12 coins and kept 7 coins for the long way home with the other guests"
    texts = [(1, item), (2, item.replace("Ada", "Eve").replace("Ben", "Tom").replace("12", "31").replace("7", "9")), (3, item.replace("Ada", "Eve").replace("Ben", "Eve").replace("12", "9").replace("7", "9"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r["covered"] for r in decontaminate(docs, items).collect()}
    assert found[1] == found[2] == 1.0 and found[3] < 1.0
