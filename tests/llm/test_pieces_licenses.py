import random
import zlib

import numpy as np
import public_tokenizers
from edge import no_documents, odd_documents

from quire.llm import licenses, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(n, seed=4):
    rng = random.Random(seed)
    for _ in range(n):
        out = ""
        for _ in range(rng.randint(0, 30)):
            out += rng.choice(["hello", "world", "thontion", "queux", "aaaaaaaaaa", "x" * rng.randint(1, 40), "".join(rng.choice("abcdethein▁ \n\téß😀中文") for _ in range(rng.randint(1, 30)))])
            out += rng.choice([" ", "", " ", "  ", "     "])
        yield out


def chunked_ids(v, text, chunk):
    m, reach = pieces.marked(text), v.reach
    own = [(m[max(0, a - reach) : a], m[a : a + chunk], m[a + chunk : a + chunk + reach]) for a in range(0, len(m), chunk)]
    if not own:
        return [], []
    matrices = [pieces.transfer(v, *c) for c in own]
    states = pieces.trace(matrices, (0, ""), None)
    out = []
    for (_, text_, right), a, b in zip(own, states, states[1:]):
        out += np.frombuffer(v.encode((text_ + right[: b[0]])[a[0] :]), "<u4").tolist()
    return out, matrices


def test_scan_equals_library():
    v = pieces.vocabulary(PATH, "bpe")
    for t in texts(120):
        want = v.library.encode(t)
        assert np.frombuffer(v.encode(pieces.marked(t)), "<u4").tolist() == want
        for chunk in (20, 47):
            found, matrices = chunked_ids(v, t, chunk)
            assert found == want
            if len(matrices) > 2:
                a, b, c = matrices[:3]
                assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c))


class Unigram(pieces.Vocabulary):
    """A unigram model made by hand."""

    def __init__(self):
        self.kind, self.longest, self.pairs = "unigram", 4, {}
        self.score = {"▁": -2.0, "a": -1.5, "b": -1.5, "ab": -2.2, "ba": -2.5, "aba": -3.1, "▁ab": -2.8, "abab": -4.6, "bb": -2.0}
        self.unknown = -20.0


def test_unigram_scan_is_optimal():
    v, rng = Unigram(), random.Random(1)
    for _ in range(200):
        m = "▁" + "".join(rng.choice("aab▁b?") for _ in range(rng.randint(1, 40)))
        best = sum(v.weight(p) for p in v.best(m))
        chunk, reach = rng.randint(5, 12), v.reach
        own = [(m[max(0, a - reach) : a], m[a : a + chunk], m[a + chunk : a + chunk + reach]) for a in range(0, len(m), chunk)]
        matrices = [pieces.transfer(v, *c) for c in own]
        total = matrices[0]
        for x in matrices[1:]:
            total = pieces.compose(total, x)
        assert abs(max(w for s, w in total[0, ""].items() if s[0] == 0) - best) < 1e-9
        states = pieces.trace(matrices, (0, ""), None)
        parts = [p for (_, t, r), a, b in zip(own, states, states[1:]) for p in v.best((t + r[: b[0]])[a[0] :])]
        assert "".join(parts) == m and abs(sum(map(v.weight, parts)) - best) < 1e-9


def test_crc_join():
    a, b = random.Random(1).randbytes(99), random.Random(2).randbytes(77)
    assert pieces.crc32_join(zlib.crc32(a), zlib.crc32(b), 77) == zlib.crc32(a + b) and pieces.crc32_join(5, 0, 0) == 5


def test_query(spark, sf_dir):
    v = pieces.vocabulary(PATH, "bpe")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for chunk in (pieces.CHUNK, 1000):
        for r in pieces.digests(frame, PATH, chunk=chunk).collect():
            ids = v.library.encode(docs[r.doc_id])
            assert (r.n_ids, r.ids_crc32, r.decoded) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_many_groups_and_decoding(spark, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP", 3)
    text = "xyz " * 400 + "q" * 900 + " end of it  "
    docs = spark.createDataFrame([(1, text), (2, "short"), (1, text)], "doc_id long, text string")
    parts = pieces.encode(docs, PATH, chunk=100)
    v = pieces.vocabulary(PATH, "bpe")
    own = sorted(((r.k, bytes(r.ids)) for r in parts.where("doc_id = 1").collect()), key=lambda x: x[0])[::2]
    assert np.frombuffer(b"".join(x[1] for x in own), "<u4").tolist() == v.library.encode(text)
    back = sorted({(r.k, r.text) for r in pieces.decode(parts.where("doc_id = 1"), PATH).collect()})
    assert "".join(t for _, t in back) == " " + text


def test_pieces_odd_rows(spark):
    docs = odd_documents(spark)
    v = pieces.vocabulary(PATH, "bpe")
    found = pieces.digests(docs, PATH, chunk=5000).collect()
    assert len(found) == docs.count() and all(r.decoded for r in found)
    want = sorted(len(v.library.encode(r.text or "")) for r in docs.collect())
    assert sorted(r.n_ids for r in found) == want
    assert pieces.digests(no_documents(spark), PATH).count() == 0


def test_licenses_found_and_clean_texts_left():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(3)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    for name, text in licenses.TEMPLATES.items():
        for _ in range(10):
            words = licenses.WORDS.findall(text.lower())
            if len(words) > 40:
                words[rng.randrange(len(words))] = "changed"
            doc = " ".join([*rng.choices(filler, k=rng.randint(0, 80)), *words, *rng.choices(filler, k=rng.randint(0, 80))])
            assert name in [m[0] for m in scanner.matches(doc)]
    assert scanner.matches(" ".join(filler)) == [] and scanner.matches("") == []
    short = scanner.matches("Released under the MIT License. x y z. Released under the MIT License.")
    assert [(m[0], m[1]) for m in short] == [("mit-notice", 0), ("mit-notice", 8)]


def test_license_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = {n: licenses.shingles(licenses.WORDS.findall(t.lower())) for n, t in licenses.TEMPLATES.items()}
    for r in licenses.op1_licenses(spark, sf_dir).collect():
        words = licenses.WORDS.findall(docs[r.doc_id].lower())
        own = licenses.shingles(words)
        brute = {n for n, t in wanted.items() if any(len(set(t) & set(own[i : i + len(t)])) >= 0.8 * len(set(t)) for i in range(max(1, len(own) - len(t) + 1)))}
        assert set(filter(None, r.licenses.split(","))) == brute


def test_licenses_odd_rows(spark):
    docs = odd_documents(spark)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_documents(spark)).count() == 0
    assert licenses.scan(docs, {}).where("size(matches) > 0").count() == 0
