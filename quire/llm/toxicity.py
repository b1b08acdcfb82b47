"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes, calibrated.

Terms are lower-cased words of letters and their character 4-grams. Kept are those that a G-test ties to the label in
the sample, beyond a limit that ``chance`` unrelated terms of all that the sample has are expected to pass; so the rule is
the same at any size and has no cap. A table with too few positive rows to tie any term to the label gives every text
the positive rate. With ``chance=None`` all terms are kept: vectors are then those of the whole texts, as far as the
examples have their terms. Document frequencies of the kept terms are counted over all documents. Examples with equal vectors share one
entry that carries their counts, so ties at the k-th place are all counted and no order decides. A list of examples is
cut into blocks that know each term's largest weight; a block whose bound is under the k-th similarity found so far
cannot hold a neighbour and is skipped, which leaves the search exact.

Bound: ``sample`` labelled rows (by hash of the id) make the classifier, whatever the input; its terms are among theirs.

Defined cases: a null, empty or unmatched text has no neighbour and gets the positive rate of examples without terms;
without any labelled example every score is 0; repeated label rows count once, 1 if any is 1; labels without document
and null labels are ignored; documents that repeat are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc32_of, cut, map_arrow, raw, table

WORD = re.compile(r"[^\W\d_]+")
GRAM, BLOCK, CACHED = 4, 64, 300_000


def features(word: str) -> list[str]:
    """The word itself and its character 4-grams with marked ends."""
    marked = f"_{word}_"
    return [word, *{marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)}]


class Counts:
    """Term counts of a text over a fixed vocabulary; the kept terms of a word are remembered, within a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.cache = vocabulary, {}

    def __call__(self, text: bytes | None) -> Counter:
        found: Counter = Counter()
        if not text or not self.vocabulary:
            return found
        cache = self.cache
        for token, n in Counter(text.decode("utf-8", "replace").lower().split()).items():
            own = cache.get(token)
            if own is None:
                if len(cache) >= CACHED:
                    cache.clear()
                own = tuple(i for w in WORD.findall(token) for f in features(w) if (i := self.vocabulary.get(f)) is not None)
                if len(token) <= 64:
                    cache[token] = own
            for i in own:
                found[i] += n
        return found


@lru_cache(1)
def counter(terms: tuple[str, ...]) -> Counts:
    """The counts over a vocabulary, one per worker, so that later passes find the tokens of earlier ones."""
    return Counts({t: i for i, t in enumerate(terms)})


class BlockMax:
    """Inverted lists of example vectors, cut into blocks of examples that keep each term's largest weight.

    ``search`` evaluates the most promising blocks, takes the k-th cosine found there, then evaluates every block whose
    bound reaches it, and no other.
    """

    FIRST = 4  # blocks that are evaluated to get a threshold

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int, int, list]], n_terms: int, k: int):
        """rows: term ids (ascending), unit weights, examples, positive examples, some of their ids."""
        self.k = k
        self.n, self.pos, self.ids = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), [r[4] for r in rows]
        self.n_blocks = -(-len(rows) // BLOCK)
        term = np.concatenate([r[0] for r in rows])
        entry = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        order = np.lexsort((entry, term))
        self.entry, self.weight, term = entry[order], np.concatenate([r[1] for r in rows])[order], term[order]
        block = self.entry // BLOCK
        self.start = np.concatenate(([0], np.flatnonzero((term[1:] != term[:-1]) | (block[1:] != block[:-1])) + 1))
        self.size = np.diff(np.append(self.start, len(term)))
        self.most, self.block = np.maximum.reduceat(self.weight, self.start), block[self.start]
        self.cells = np.searchsorted(term[self.start], np.arange(n_terms + 1))  # cells of term t: cells[t] to cells[t + 1]

    def search(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of all examples at least as near as the k-th; ``without``: one example of this entry is left out."""
        first, count = self.cells[terms], self.cells[terms + 1] - self.cells[terms]
        cell = _ranges(first, count)
        w = np.repeat(weights, count)
        block = self.block[cell]
        bound = np.bincount(block, w * self.most[cell], self.n_blocks)
        chosen = np.zeros(self.n_blocks, bool)
        if self.n_blocks > self.FIRST:
            chosen[np.argpartition(-bound, self.FIRST)[: self.FIRST]] = True
            near = self._cosines(cell, w, chosen[block])
            rest = ~chosen & (bound > 0) & (bound >= self._kth(near, without) - 1e-9)
            if rest.any():
                near = near + self._cosines(cell, w, rest[block])
        else:
            near = self._cosines(cell, w, chosen[block] | True)
        found = np.flatnonzero((near > 0) & (near >= self._kth(near, without) - 1e-9))
        return found, near[found]

    def _cosines(self, cell: np.ndarray, w: np.ndarray, keep: np.ndarray) -> np.ndarray:
        own, w = cell[keep], w[keep]
        at = _ranges(self.start[own], self.size[own])
        return np.bincount(self.entry[at], np.repeat(w, self.size[own]) * self.weight[at], len(self.n))

    def _kth(self, near: np.ndarray, without: int | None) -> float:
        """The k-th largest cosine over examples, 0 if fewer have any; at most k entries hold k examples."""
        top = np.argpartition(-near, self.k)[: self.k + 1] if len(near) > self.k + 1 else np.arange(len(near))
        top = top[np.argsort(-near[top], kind="stable")]
        enough = np.flatnonzero(np.cumsum(self.n[top] - (top == without)) >= self.k)
        return float(near[top[enough[0]]]) if len(enough) else 0.0


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then the same from first[1], and so on."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x ascending) and the fitted, never falling means of y."""
    values, place = np.unique(x, return_inverse=True)
    total, count = np.bincount(place, y), np.bincount(place)
    pools: list[list[float]] = []
    for v, t, c in zip(values, total, count):
        pools.append([t, c, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t, c, v = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + c, v]
    ends = np.array([p[2] for p in pools])
    means = np.array([p[0] / p[1] for p in pools])
    return values, means[np.searchsorted(ends, values)]


class Model:
    """What scoring needs: vocabulary, idf, index, calibration and the rate among examples without terms."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: Iterable[tuple[int, int, list[int], list[int]]], k: int):
        self.vocabulary, self.idf = tuple(vocabulary), idf
        entries: dict[bytes, list] = {}
        bare, total, found = [0, 0], [0, 0], []
        for doc_id, label, ids, tf in examples:
            total = [total[0] + 1, total[1] + label]
            terms, weights = self.vector(ids, tf)
            if not len(terms):
                bare = [bare[0] + 1, bare[1] + label]
                continue
            key = terms.tobytes() + weights.tobytes()
            row = entries.setdefault(key, [terms, weights, 0, 0, []])
            row[2], row[3] = row[2] + 1, row[3] + label
            row[4] = sorted([*row[4], doc_id])[:3]
            found.append((key, label))
        base = total[1] / total[0] if total[0] else 0.0
        self.empty = (bare[1] + base) / (bare[0] + 1) if total[0] else 0.0
        # Entries that share their weightiest term stand together, so that few blocks matter to one text.
        order = sorted(entries, key=lambda e: (int(entries[e][0][np.argmax(entries[e][1])]), entries[e][0].tolist(), entries[e][1].tolist()))
        self.index = BlockMax([tuple(entries[e]) for e in order], len(vocabulary), k) if entries else None
        self.knots = (np.zeros(1), np.full(1, self.empty))
        if entries:
            place = {e: i for i, e in enumerate(order)}
            known: dict[tuple[bytes, int], float] = {}
            for key, label in found:
                if (key, label) not in known:
                    known[key, label] = self.votes(*entries[key][:2], without=(place[key], label))[0]
            x, y = np.array([known[f] for f in found]), np.array([f[1] for f in found], float)
            self.knots = isotonic(x, y)
        self.cache: dict[bytes, tuple[float, list[int]]] = {}

    def vector(self, ids, tf) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids)
        terms = np.asarray(ids, np.int64)[order] if len(ids) else np.zeros(0, np.int64)
        weights = (1 + np.log(np.asarray(tf, float)[order])) * self.idf[terms] if len(ids) else np.zeros(0)
        return terms, weights / (np.linalg.norm(weights) or 1.0)

    def votes(self, terms: np.ndarray, weights: np.ndarray, without: tuple[int, int] | None = None) -> tuple[float, list[int]]:
        """The share of positive votes, each weighted by nearness, with one vote for the rate among bare examples; evidence ids, nearest first."""
        entries, cosines = self.index.search(terms, weights, without and without[0])
        own = (entries == without[0]) if without else np.zeros(len(entries), bool)
        n, pos = self.index.n[entries] - own, self.index.pos[entries] - own * (without[1] if without else 0)
        weight = cosines / (1.05 - np.minimum(cosines, 1.0))
        order = np.argsort(-cosines, kind="stable")[:3]
        return float((weight @ pos + self.empty) / (weight @ n + 1)), [i for e in entries[order] for i in self.index.ids[e]][:3]

    def score(self, counts: Counter) -> tuple[float, list[int]]:
        if not counts or self.index is None:
            return self.empty, []
        terms, weights = self.vector(list(counts), list(counts.values()))
        key = terms.tobytes() + weights.tobytes()
        if key not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            share, evidence = self.votes(terms, weights)
            self.cache[key] = float(np.clip(np.interp(share, *self.knots), 0, 1)), evidence
        return self.cache[key]


def training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(id, label, text): at most ``sample`` labelled ids by hash, those with crc32(id) mod 3 = 1 left out."""
    known = labels.where("doc_id is not null and toxic is not null").where(crc32_of("doc_id") % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    held = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    chosen = known.join(held, known.doc_id == held.id, "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return F.broadcast(chosen).join(docs.select(F.col("doc_id").alias("id"), "text"), F.col("doc_id") == F.col("id")).select("id", "label", "text")


def chi_square_limit(tail: float) -> float:
    """What a chi-square variable of one degree of freedom exceeds with chance ``tail``."""
    low, high = 0.0, 1500.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > tail else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_192, chance: float | None = 1.0, k: int = 25) -> Model:
    """Learn from a bounded sample of labelled rows; count the kept terms over all ``docs``. ``chance``: how many unrelated terms may be expected among the kept ones, None to keep all."""
    rows = cut(training(docs, labels, sample))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, pos = Counter(), Counter()
        for label, text in zip(batch.column(1).to_pylist(), raw(batch.column(2))):
            own = {f for w in set(WORD.findall((text or b"").decode("utf-8", "replace").lower())) for f in features(w)}
            n.update(own)
            if label:
                pos.update(own)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[t] for t in n], pa.int64())], ["term", "n", "pos"])

    all_n, all_pos = rows.agg(F.count("*"), F.sum("label")).first()
    vocabulary: list[str] = []
    if all_n and all_pos:
        seen = cut(map_arrow(rows, counted, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
        limit = 0.0 if chance is None else chi_square_limit(min(1.0, chance / max(1, seen.count())))

        def part(observed, expected):
            return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

        n, pos, rate = F.col("n"), F.col("pos"), all_pos / all_n
        cells = [(pos, n * rate), (n - pos, n * (1 - rate)), (all_pos - pos, (all_n - n) * rate), (all_n - all_pos - n + pos, (all_n - n) * (1 - rate))]
        g = 2 * sum((part(o, e) for o, e in cells), F.lit(0.0))
        best = seen if chance is None else seen.where(g >= limit)
        vocabulary = sorted(r.term for r in best.select("term").collect())  # among the terms of the sample
    terms = tuple(vocabulary)

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found = counter(terms), np.zeros(len(terms) + 1, np.int64)
        for text in raw(batch.column(0)):
            found[list(counts(text))] += 1
        found[-1] = batch.num_rows
        at = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["term", "n"])

    frequency = np.zeros(len(terms) + 1)
    for r in map_arrow(docs.select("text"), present, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r.term] = r.n
    idf = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(terms)
        found = [counts(t) for t in raw(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["id", "label", "terms", "tf"])

    examples = map_arrow(rows, vectors, "id long, label int, terms array<int>, tf array<int>").collect()
    return Model(vocabulary, idf, sorted((r.id, r.label, r.terms, r.tf) for r in examples), k)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence): the calibrated score of each row and ids of up to three nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        counts = counter(model.vocabulary)
        found = [model.score(counts(t)) for t in raw(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, score double, evidence array<long>")


THRESHOLD = 0.7


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of each row of ``documents`` with ids of its nearest examples; defined cases as in the module's docstring."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.coalesce(crc32_of("doc_id") % 3, F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold, with their own columns. The score depends on the text alone and is computed in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        counts = counter(model.vocabulary)
        clean = [model.score(counts(t))[0] < THRESHOLD for t in raw(batch.column(batch.schema.get_field_index("text")))]
        return batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, rows, docs.schema)
