import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from edge import no_documents, odd_documents

from quire.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_as_whole_texts():
    enc = packing.WordEncoder(PATH)
    rng = random.Random(1)
    letters = " \n\t  　abcé́ÄßİΣς'’s😀中文ا٣½\x1c\x85.,<|>_-1I'll"
    for _ in range(800):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert enc(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    t = "a <|endoftext|> b"
    assert enc(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def check_plan(histogram, length):
    rows = packing.plan(histogram, length)
    used, places = Counter(), defaultdict(list)
    for n, lo, hi, base, offset in rows:
        assert hi > lo
        used[n] += hi - lo
        for s in range(base, base + hi - lo):
            places[s].append((offset, n))
    assert used == Counter({n: c for n, c in histogram.items() if c})
    for own in places.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= length
    spans = defaultdict(list)
    for n, lo, hi, _, _ in rows:
        spans[n].append((lo, hi))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    return len(places)


def best_fit(histogram, length):
    gaps = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(length - n)
    return len(gaps)


def test_plans():
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = int(rng.integers(1, 400))
        h = Counter(np.minimum(512, rng.lognormal(4, 1.2, n)).astype(int).clip(1).tolist())
        made = check_plan(h, 512)
        assert made <= best_fit(h, 512) * 1.03 + 1 and made >= -(-sum(k * c for k, c in h.items()) // 512)
    assert packing.plan({}) == []
    assert check_plan({4096: 3, 1: 5}, 4096) == 4


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_rows(packing.op5_packing(spark, sf_dir).collect(), docs, 4096)


def check_rows(rows, docs, length):
    enc = packing.WordEncoder(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // length))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.start == r.piece * length and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_seq.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= length


def test_salted_ranks(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(300)], "doc_id long, text string")
    found = packing.pack(packing.cut(packing.pieces(docs, PATH, 8)), 8, part_rows=10)
    assert "ids" in found.columns
    check_rows(found.collect(), {i: "word " * (i % 7) for i in range(300)}, 8)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = packing.packed(docs)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()}
    places = [(r.sequence_id, r.offset) for r in found.collect()]
    assert len(places) == len(set(places))
    assert packing.packed(no_documents(spark)).count() == 0
