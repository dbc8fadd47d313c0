import math
import random
from collections import Counter

import numpy as np

from boardframe.llm import language
from boardframe.llm.language import BUCKETS, fit, identify, infer, train

PARTS = {"en": ["th", "ing", "er", "wh", "and"], "de": ["sch", "ung", "ei", "ü", "ver"], "fr": ["eau", "que", "é", "tion", "oi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_mixtures(spark):
    rng = random.Random(0)
    rows = [(text(rng, lang, 60), lang, 1) for lang in PARTS for _ in range(20)] + [(None, "en", 1), ("xyz", None, 1), ("", "en", 1)]
    model = train(spark.createDataFrame(rows, "text string, lang string, doc_id int").repartition(4))
    assert model.languages == ["de", "en", "fr"]
    docs = [(i, text(rng, lang, n)) for i, (lang, n) in enumerate([("en", 3), ("de", 40), ("fr", 900)])]
    docs += [(10, f"{text(rng, 'en', 70)} {text(rng, 'fr', 30)}"), (11, None), (12, ""), (13, "12 -- ¶ 3"), (None, text(rng, "de", 9)), (1, docs[1][1])]
    got = {(r["doc_id"], r["lang_pred"]): r for r in identify(spark.createDataFrame([(*d, "zz", 9) for d in docs], "doc_id long, text string, lang string, score int"), model).collect()}
    assert set(got) == {(0, "en"), (1, "de"), (2, "fr"), (10, "en"), (11, "und"), (12, "und"), (13, "und"), (None, "de")}
    mixed = got[10, "en"]
    assert mixed["languages"] == ["en", "fr"] and abs(mixed["proportions"][0] - 0.7) < 0.05 and abs(mixed["score"] - 0.7) < 0.05
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[11, "und"]["score"] == 0 and len(got[2, "fr"]["languages"]) == 1
    empty = train(spark.createDataFrame([], "text string, lang string"))
    assert infer("words", empty, 3.0)[0] == "und"
    assert identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_against_a_plain_mixture(spark):
    """Proportions and languages as of word by word loops over a model's own table."""
    rng = random.Random(3)
    rows = [(text(rng, lang, 60), lang) for lang in PARTS for _ in range(10)]
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    count, total = {}, Counter()
    for body, lang in rows:
        for gram in grams(body):
            count[lang, gram] = count.get((lang, gram), 0) + 1
            total[lang] += 1
    logs = lambda word, lang: sum(math.log((count.get((lang, g), 0) + 0.5) / (total[lang] + 0.5 * BUCKETS)) for g in grams(word))

    def mixture(words, langs):
        like = []
        for w in words:
            all_ = [logs(w, lang) for lang in model.languages]
            like.append([math.exp(max(logs(w, lang) - max(all_), -60)) for lang in langs])
        share = [1 / len(langs)] * len(langs)
        for _ in range(12):
            new = [sum(share[k] * row[k] / sum(s * x for s, x in zip(share, row)) for row in like) / len(like) for k in range(len(langs))]
            share = new
        return share, sum(math.log(sum(s * x for s, x in zip(share, row))) for row in like)

    for parts in ({"en": 40}, {"en": 30, "fr": 20}, {"de": 25, "en": 15, "fr": 30}):
        words = " ".join(text(rng, lang, n) for lang, n in parts.items()).split()
        found = infer(" ".join(words), model, 3.0)
        assert set(found[2]) == set(parts)
        share, _ = mixture(words, found[2])
        assert all(abs(a - b) < 0.01 for a, b in zip(share, found[3]))
        price = 3.0 * math.log1p(len(words))
        whole = {lang: sum(logs(w, lang) for w in words) for lang in model.languages}
        value = lambda langs: mixture(words, langs)[1] - price * (len(langs) - 1)
        if len(parts) == 1:
            assert found[2] == [max(whole, key=whole.get)]
        assert value(found[2]) >= max(value([lang]) for lang in model.languages) - 1e-6


def grams(body):
    """Three bytes around each letter of a lower-cased text."""
    raw = f" {body.lower()} ".encode()
    seen = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in raw)
    return [seen[i - 1 : i + 2] for i in range(1, len(seen) - 1) if seen[i] != 32]


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    model = train(spark.createDataFrame([(text(rng, lang, 60), lang) for lang in PARTS for _ in range(10)], "text string, lang string"))
    body = " ".join(text(rng, lang, 50) for lang in ("en", "fr"))
    whole = infer(body, model, 3.0)
    for n in (1, 7, 100):
        monkeypatch.setattr(language, "WORDS_AT_ONCE", n)
        assert infer(body, model, 3.0) == whole


def test_expectation_maximisation_raises_the_likelihood():
    like = np.random.default_rng(1).random((200, 4))
    values = [fit(like, n)[1] for n in (1, 2, 4, 12)]
    assert values == sorted(values) and abs(fit(like)[0].sum() - 1) < 1e-9


def test_held_out_accuracy(spark):
    from boardframe.llm.queries import op2_language_mixture

    got = op2_language_mixture(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    right, total = got.join(truth, "doc_id").selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right / total > 0.98
