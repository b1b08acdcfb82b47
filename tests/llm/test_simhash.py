import re

import numpy as np
import pytest
import xxhash
from edge import no_documents, odd_documents

from quire.llm import graph, simhash
from quire.llm.common import salted_join


def brute_print(text, n=4):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(codes, most):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(codes))]


def test_fingerprint():
    for t in ("", None, "One", "a b c", "A b c D", "x " * 50, "É é\u00a0w a\x0bb c d e f"):
        assert simhash.simhash(t.encode() if t is not None else None) == brute_print(t)


def test_gray_rank_walks_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))


def test_masks():
    """Any four flipped bits leave one mask untouched."""
    rng = np.random.default_rng(2)
    for blocks, n in ((5, 5), (6, 15), (8, 70)):
        own = simhash.masks(4, blocks)
        assert len(own) == n
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not m & flips for m in own)
    assert [simhash.blocks_for(n, 4) for n in (10**5, 10**7, 10**9, 10**12)] == [5, 5, 6, 8]


@pytest.mark.parametrize("bucket_rows,blocks", [(2_000_000, None), (30, None), (2_000_000, 7)])
@pytest.mark.parametrize("most", [1, 4])
def test_links(spark, bucket_rows, blocks, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(3)]
    ball = base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)) ^ np.uint64(5)
    codes = np.unique(np.concatenate([base, *flips, flips[0] ^ np.uint64(3), ball, np.array([0, 1, 2**64 - 1], np.uint64)]))
    rows = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    root = {r.node: r.root for r in graph.components(simhash.links(rows, most, bucket_rows, blocks=blocks)).collect()}
    want = brute_classes([int(c) for c in codes], most)
    got = [root.get(int(c), int(c)) for c in codes.view(np.int64)]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(got) == groups(want)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r.doc_id: r for r in simhash.op7_simhash(spark, sf_dir).collect()}
    docs.sort(key=lambda r: r.doc_id)
    codes = [brute_print(r.text) for r in docs]
    assert all(found[r.doc_id].fingerprint == f"{c:016x}" for r, c in zip(docs, codes))
    roots = brute_classes(codes, 4)
    assert all(found[r.doc_id].component_id == docs[k].doc_id for r, k in zip(docs, roots))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    zero = {r.class_id for r in found if r.fp == 0}
    assert zero == {0}
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_repeated_ids(spark):
    """Rows that repeat an id are documents of their own."""
    rows = spark.createDataFrame([(3, "a b c d"), (5, "a b c d"), (5, "q r s t u"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((r.id or 0, r.class_id) for r in simhash.near_duplicates(rows).collect()) == [(0, 5), (3, 3), (5, 3), (5, 5)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 1), (7, 8)], "u long, v long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert set(found.values()) == {0} and len(found) == 201
    assert graph.components(edges.where("u > 900")).count() == 0


def test_components_without_broadcast(spark, monkeypatch):
    """Hubs are cut into parts where there are too many edges to broadcast."""
    monkeypatch.setattr(graph, "FEW", 10)
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 50)] + [(9000, 9001)], "u long, v long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert len(found) == 3051 and {r for n, r in found.items() if n < 9000} == {0} and found[9001] == found[9000] == 9000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, how):
    """A key of most rows, null keys and keys without a partner: the same rows as a plain join."""
    big = spark.createDataFrame([(i, 7 if i % 4 else i % 50) for i in range(6000)] + [(6000, None)], "i int, k int")
    small = spark.createDataFrame([(7, "x"), (8, "y"), (9, "z"), (None, "n")], "k int, s string")
    want, got = big.join(small, "k", how), salted_join(big, small, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))

def test_rows_without_id_link(spark):
    """A fingerprint that only rows without id have still joins the two beside it."""
    a, b, c = 0b0, 0b1111, 0b11111111
    rows = spark.createDataFrame([(5, a), (3, c), (9, c), (None, b), (None, 1 << 40 | (1 << 50) - 1)], "least_id long, fp long")
    name = simhash.F.coalesce("least_id", simhash.F.shiftrightunsigned("fp", 2).bitwiseOR(simhash.F.lit(simhash.NAMELESS)))
    edges = simhash.links(rows.groupBy("fp").agg(simhash.F.min("least_id").alias("least_id")).withColumn("node", name))
    assert {r.root for r in graph.components(edges).collect()} == {3}
