import zlib
from collections import Counter

import numpy as np
import pytest
from edge import no_documents, odd_documents

from quire.llm import toxicity


def model(rng, n=600, terms=30, k=25):
    examples = []
    for i in range(n):
        own = rng.choice(terms, rng.integers(0, 6), replace=False).tolist()
        examples.append((i, int(rng.random() < 0.3 or 0 in own), own, rng.integers(1, 4, len(own)).tolist()))
    return toxicity.Model([str(t) for t in range(terms)], rng.random(terms) + 0.5, examples, k), examples


def test_search_is_exact():
    rng = np.random.default_rng(2)
    own, examples = model(rng)
    dense = np.zeros((len(examples), 30))
    for i, e in enumerate(examples):
        t, w = own.vector(e[2], e[3])
        dense[i, t] = w
    assert own.index.n_blocks > own.index.FIRST
    for _ in range(200):
        n = rng.integers(1, 7)
        t, w = own.vector(rng.choice(30, n, replace=False), rng.integers(1, 4, n))
        q = np.zeros(30)
        q[t] = w
        sims = dense @ q
        kth = np.sort(sims)[::-1][own.index.k - 1]
        want = sims[(sims >= kth - 1e-9) & (sims > 0)]
        entries, cosines = own.index.search(t, w)
        assert own.index.n[entries].sum() == len(want) and np.isclose((cosines * own.index.n[entries]).sum(), want.sum())


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1, 2, 2]), np.array([1.0, 0, 1, 0]))
    assert x.tolist() == [1, 2, 3] and y.tolist() == [0, 0.5, 1]
    _, y = toxicity.isotonic(np.array([1.0, 2, 3]), np.array([1.0, 0, 1]))
    assert y.tolist() == [0.5, 0.5, 1]


def test_counts_whole_words_and_grams():
    counts = toxicity.Counts({"idiot": 0, "idio": 1, "_clo": 2})
    assert counts(b"Idiot! idiots, a clown; clowns") == {0: 1, 1: 2, 2: 2}
    assert counts(None) == {} and counts(b"") == {}


@pytest.fixture(scope="module")
def labelled(spark):
    clean = "the quiet river bends near old stone houses where people talk about weather and bread number{}"
    docs = [(i, clean.format(i) + (" you stupid moron" if i % 4 == 0 else ""), "en", "s") for i in range(1200)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 1200, 2)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, labelled):
    docs, labels = labelled
    found = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in found) and all(0 <= r.score <= 1 for r in found)
    learned = {i for r in found for i in r.evidence}
    assert learned and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in learned)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 900


def brute_scores(docs, labels, vocabulary, prior, k=25):
    """Shares of positive votes before calibration, from dense TF-IDF vectors and all similarities."""
    texts = {r.doc_id: toxicity.WORD.findall(r.text.lower()) for r in docs}
    found = {i: Counter(f for w in t for f in toxicity.features(w)) for i, t in texts.items()}
    place = {t: j for j, t in enumerate(sorted(vocabulary))}
    idf = np.zeros(len(place))
    for t, j in place.items():
        idf[j] = np.log((len(texts) + 1) / (sum(t in c for c in found.values()) + 1)) + 1
    dense = {}
    for i, c in found.items():
        v = np.zeros(len(place))
        for t, n in c.items():
            if t in place:
                v[place[t]] = (1 + np.log(n)) * idf[place[t]]
        dense[i] = v / (np.linalg.norm(v) or 1)
    known = {r.doc_id: r.toxic for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    out = {}
    for i, v in dense.items():
        near = sorted(((float(v @ dense[j]), y) for j, y in known.items()), reverse=True)
        near = [(s, y) for s, y in near if s >= near[k - 1][0] - 1e-9 and s > 0]
        weights = [s / (1.05 - min(s, 1.0)) for s, _ in near]
        out[i] = (sum(w * y for w, (_, y) in zip(weights, near)) + prior) / (sum(weights) + 1)
    return out


@pytest.mark.parametrize("chance", [1.0, None])
def test_scores_equal_brute_force(spark, chance):
    """End to end over selected terms and over all terms of whole texts: nearest examples by every similarity."""
    rng = np.random.default_rng(6)
    words = [f"w{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10]}" for x in range(60)]
    rows = []
    for i in range(330):
        own = [words[x] for x in rng.integers(0, 60, 12)]
        rows.append((i, " ".join(own + (["nastyword"] * int(rng.integers(1, 3)) if i % 5 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0 or i % 37 == 0)) for i in range(0, 330, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, chance=chance)
    want = brute_scores(docs.collect(), labels.collect(), model.vocabulary, model.empty)
    if chance is None:
        assert len(model.vocabulary) > 150
    else:
        assert "nastyword" in model.vocabulary and len(model.vocabulary) < 20
    counts = toxicity.Counts({t: i for i, t in enumerate(model.vocabulary)})
    for i, text in rows:
        found = counts(text.encode())
        if found:
            assert model.votes(*model.vector(list(found), list(found.values())))[0] == pytest.approx(want[i], abs=1e-9)


def test_limit_of_association():
    assert toxicity.chi_square_limit(0.05) == pytest.approx(3.841, abs=1e-3) and toxicity.chi_square_limit(1e-5) == pytest.approx(19.51, abs=1e-2)
    assert toxicity.chi_square_limit(1.0) == pytest.approx(0, abs=1e-6)


def test_no_labels_and_odd_rows(spark, labelled):
    docs, labels = labelled
    odd = odd_documents(spark)
    none = toxicity.fit(odd, labels.where("false"))
    assert {r.score for r in toxicity.scored(odd, none).collect()} == {0.0}
    repeated = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (7, 1, None), (99999, 0, 1)], labels.schema))
    own = toxicity.fit(docs, repeated)
    assert toxicity.scored(odd, own).count() == odd.count()
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.scored(no_documents(spark), own).count() == 0
