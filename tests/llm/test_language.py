import itertools
import zlib
from collections import Counter

import numpy as np
from edge import no_documents, odd_documents

from quire.llm import language


def test_viterbi():
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 6, 40)
    scores = rng.normal(size=(int(lengths.sum()), 3)) * 3
    labels, start = language.viterbi(scores, lengths, 2.0), 0
    for n in lengths.tolist():
        own = scores[start : start + n]
        total = lambda x: sum(own[i, x[i]] for i in range(n)) - 2.0 * sum(x[i] != x[i - 1] for i in range(1, n))  # noqa: E731, B023
        if n:
            assert np.isclose(total(labels[start : start + n]), max(map(total, itertools.product(range(3), repeat=n))))
        start += n


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = [r for r in language.op10_language(spark, sf_dir).collect() if r.held_out]
    assert found and sum(docs[r.doc_id].lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_mixed_text_has_spans(spark):
    rows = [(i, "the river and the house with thing and other words that they think " * 3, "en") for i in range(80)]
    rows += [(i, "река и дом где люди говорят о погоде и хлебе ", "ru") for i in range(100, 180)]
    rows += [(i, "der fluss und das haus mit vielen worten die wir denken und sprechen ", "de") for i in range(200, 280)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    text = "the house and the river that they think река и дом где люди говорят mit vielen worten die wir denken und sprechen"
    lang, score, spans = language.labelled(model, [text.encode()], 6.0)[0]
    assert [s[2] for s in spans] == ["en", "ru", "de"] and spans[1][:2] == (8, 6) and 0 < score < 1
    cyrillic = model.scores(["дом"])[0][0]
    assert cyrillic[model.langs.index("ru")] == 0 and cyrillic[model.langs.index("en")] <= -900


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = language.fit(docs)
    found = {(r.doc_id, r.lang_pred, r.score) for r in language.identified(docs, model).collect()}
    assert (0, "und", 0.0) in found and (1, "und", 0.0) in found and (2, "und", 0.0) in found
    assert all(lang in ("en", "und") and 0 <= score <= 1 for _, lang, score in found)
    empty = language.fit(no_documents(spark))
    assert {r.lang_pred for r in language.identified(docs, empty).collect()} == {"und"}
    assert language.identified(no_documents(spark), model).count() == 0
    tiny = language.identified(docs, model, at_once=10)
    assert {(r.doc_id, r.lang_pred, r.score) for r in tiny.collect()} == found


def test_rare_language(spark):
    """A language with few and short rows beside two with many keeps all of its n-grams, and its texts."""
    rows = [(i, " ".join(f"the{i}river and{i * 7 % 91}house".split()) + " with thing and other words that they think " * 20, "en") for i in range(400)]
    rows += [(1000 + i, f"der fluss{i} und das haus mit vielen worten die wir denken " * 20, "de") for i in range(400)]
    rare = [(5000 + i, "ang ilog at bahay kung saan nag uusap", "tl") for i in range(6)]
    model = language.fit(spark.createDataFrame([*rows, *rare], "doc_id long, text string, lang string"))
    assert set(model.counts["tl"]) == set(grams("ang ilog at bahay kung saan nag uusap"))
    assert language.labelled(model, [b"ang bahay at ilog"], 12.0)[0][0] == "tl"


def test_sample_is_bounded(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "'some words' as text", "if(id % 100 = 0, 'xx', 'en') as lang")
    model = language.fit(rows, per_lang=300)
    words = {x: model.counts[x]["s"] // 2 for x in ("en", "xx")}  # "some words" has two
    assert 200 < words["en"] < 400 and words["xx"] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 6000, 100))


def grams(text):
    """All n-grams that end at a letter or mark and their contexts, one by one."""
    found = Counter()
    for word in text.split():
        m = "\x02" + word + "\x03"
        for i in range(1, len(m)):
            for n in (1, 2, 3):
                if i - n + 1 >= 0:
                    found[m[i - n + 1 : i + 1]] += 1
                    if n > 1:
                        found["^" + m[i - n + 1 : i]] += 1
    return found


def test_scores_by_hand(spark):
    """A word's score is the sum of smoothed trigram log probabilities, written out."""
    texts = {"aa": "abba baab abab", "bb": "bcbc cbbc ccb abc"}
    rows = [(k, t, lang) for lang, t in texts.items() for k in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = {x: grams(t) for x, t in texts.items()}
    n = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(60))

    def logp(word, lang):
        c, m, total = own[lang], "\x02" + word + "\x03", 0.0
        size = n * sum(v for g, v in c.items() if len(g) == 1)
        for i in range(1, len(m)):
            p = (n * c[m[i]] + 0.05) / (size + 50)
            for width in (2, 3):
                if i - width + 1 >= 0:
                    p = (n * c[m[i - width + 1 : i + 1]] + 3 * p) / (n * c["^" + m[i - width + 1 : i]] + 3)
            total += np.log(p)
        return total

    for word in ("abc", "bab", "c", "zz"):
        want = np.array([logp(word, x) for x in model.langs])
        assert np.allclose(model.scores([word])[0][0], want - want.max())
