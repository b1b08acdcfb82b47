import re

import numpy as np
import pytest
from edge import no_documents, odd_documents

import corpus_pipeline
from quire.llm import copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_kept(docs):
    """Ids of the first rows of all classes that a Jaccard similarity of 0.8 links; ids are distinct."""
    docs = sorted(docs)
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {docs[root(i)][0] for i in range(len(docs))}


def changed(rng, words, share):
    """A copy with a new word at about ``share`` of its places."""
    return [f"new{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_copies_of_random_texts(spark, broadcast, monkeypatch):
    """Copies, copies of copies and texts just under the limit, also where the fingerprints are more than 4 bits apart."""
    if not broadcast:
        monkeypatch.setattr(copies, "FEW", 0)
    rng, rows = np.random.default_rng(3), []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, 60 + 10 * k)]
        rows.append((len(rows), " ".join(words)))
        for share in (0.005, 0.02, 0.03, 0.05):
            rows.append((len(rows), " ".join(changed(rng, words, share))))
            rows.append((len(rows), " ".join(changed(rng, rows[-1][1].split(), 0.01))))
    got = {r.doc_id for r in corpus_pipeline.keep_first_copies(spark, frame(spark, rows), None).collect()}
    assert got == brute_kept(rows)
    prints = [simhash.simhash(t.encode()) for _, t in rows]
    lost = set(range(len(rows))) - got
    assert any(min((prints[i] ^ prints[j]).bit_count() for j in range(i)) > 4 for i in lost if i)


def test_shared_passages(spark):
    """Texts that share long passages fill buckets without being copies; the copies among them are still found."""
    rng, rows = np.random.default_rng(8), []
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 10**6, 50)) for _ in range(3)]
    for k in range(240):
        own = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(8, 30)))]
        rows.append((len(rows), passages[k % 3] + " " + " ".join(own)))
        if k % 6 == 0:
            rows.append((len(rows), passages[k % 3] + " " + " ".join(changed(rng, own, 0.1))))
    assert {r.doc_id for r in copies.drop_near_duplicates(frame(spark, rows)).collect()} == brute_kept(rows)


def test_prefixes_meet(spark):
    """Two sets at the limit share one of their rarest shingles; shingles of one node alone are left out."""
    own = [list(range(0, 100)), list(range(11, 111)), list(range(0, 100, 2))]
    rows = spark.createDataFrame([(i, bytearray(np.array(x, np.uint64).tobytes())) for i, x in enumerate(own)], "node long, shingles binary")
    found = {}
    for r in copies.prefixes(rows, 0.8).collect():
        found.setdefault(r.node, {})[r.key] = r.place
    assert set(found[0]) & set(found[1]) and 110 not in found[1] and max(found[0].values()) <= 21


def test_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.keep_first_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute_kept([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = copies.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, i) for i in (0, 3, 4, 5, 6, 7, 8, 9, 90)] + [(True, 0)]
    assert copies.drop_near_duplicates(no_documents(spark)).count() == 0


def test_repeated_and_null_ids(spark):
    """A unique text stays though its id is that of a copy; a class keeps one row where ids repeat or are null."""
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, one), (2, one), (2, two), (5, three), (5, three), (None, three), (None, four), (None, four)]
    got = [(r.doc_id, r.text) for r in copies.drop_near_duplicates(frame(spark, rows)).collect()]
    assert len(got) == 4 and set(got) == {(1, one), (2, two), (5, three), (None, four)}
