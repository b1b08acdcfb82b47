"""Near-duplicate removal of the corpus pipeline: SimHash and its Gray index first, an exact similarity after it.

Two texts are near copies if the Jaccard similarity of their five-word shingles is 0.8 or more; words are those of the
SimHash contract (A-Z lower-cased, split at ASCII white space). Only distinct word sequences enter, so any number of
exact copies costs one entry. Candidates come from two sources, and each is compared by its shingles themselves:

1. the Gray-order index of ``simhash.links`` over 64-bit fingerprints of those shingles, ``max_bits`` apart at most;
2. MinHash signatures of 32 bands of four rows, because fingerprints cannot reach 0.8: at that similarity they differ
   in about ten bits, and a radius that holds nearly all such pairs also holds unrelated texts. Two texts at 0.8 share
   no band with a chance of 5e-8, and a lesser one at higher similarity.

A bucket (the texts that share a band) starts from the classes that the first source found. Its pivot, the least text,
is compared with those of other classes and leaves; a bucket in one class is settled. So a group of near copies costs
about one comparison for each, not one for each pair. Texts of buckets that stay open mostly share a passage and nothing
else. They are dealt anew by their rarest shingles (``prefixes``), in a way that no pair at the limit can escape; such
buckets are compared pair by pair, except within a class. Before any comparison, the places of the shared shingle and
the number of bits at which parity masks of the two sets differ rule pairs out, only such as are below the limit.
No proposed pair is left out unless its texts are in one class already.

Defined cases: null and wordless texts are copies of each other; texts under the shingle length are one shingle; of a
class the row with the least id stays (null ids come last; ties go by a hash of the whole row), and of wholly equal rows
one; an empty table gives an empty one; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import FEW, cut, few, few_tasks, in_few_tasks, map_arrow, raw, salted_join
from quire.llm.graph import components
from quire.llm.simhash import links, majority

BANDS, ROWS = 32, 4
#: Shingles hashed for all rows of a signature at once: a table of 128 KB.
SLICE = 256
#: Bits of a mask, a power of two, and the names of its longs.
MASK = 512
WORDS = [f"w{k}" for k in range(MASK // 64)]
_RNG = np.random.default_rng(11)
MUL = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``shingle`` words; all words are one run if they are fewer. Word hashes are mixed by place."""
    from xxhash import xxh3_64_intdigest

    own = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(own))
    out = np.full(len(own) - width + 1 if width else 0, width, np.uint64)
    for k in range(width):
        out = (out ^ own[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the signature of a shingle set. Permutations are multiplications of the upper 32 bits."""
    from xxhash import xxh64_intdigest

    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(upper), SLICE):
        moved = upper[None, k : k + SLICE] * MUL
        moved += ADD
        np.minimum(low, moved.min(axis=1), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(part.tobytes(), b) for b, part in enumerate(parts)], np.uint64)


def node_of(words: list[bytes]) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b" ".join(words))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits of a row's values and of which of them are null."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    own = [*cols, *[c.isNull() for c in cols]]
    return [F.xxhash64(F.lit(k), *own).alias(f"__quire_k{k}") for k in (1, 2)]


def _texts(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, k1, k2, node, fp, size, keys) per row: ``node`` is a hash of the text's words, ``fp`` its fingerprint, ``size`` the number of its shingles."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, prints, sizes, keys = [], [], [], []
        for text in raw(batch.column(3)):
            words = (text or b"").lower().split()
            own = shingle_set(words, shingle)
            nodes.append(node_of(words))
            prints.append(majority(own))
            sizes.append(len(own))
            keys.append(bands(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
        made = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, prints)]
        made += [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], ["id", "k1", "k2", "node", "fp", "size", "keys"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), *_row_key(docs), F.col(text_col).alias("text"))
    return map_arrow(given, rows, "id long, k1 long, k2 long, node long, fp long, size long, keys array<bigint>")


def _sets(docs: DataFrame, chosen: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the rows of ``docs`` whose keys are in ``chosen`` (k1, k2). Sets are made again for the few texts that must be compared; keeping those of all would take more room than the texts."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t or b"").lower().split() for t in raw(batch.column(0))]
        nodes = np.array([node_of(w) for w in words], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([shingle_set(w, shingle).tobytes() for w in words], pa.binary())], ["node", "shingles"])

    keys = chosen.select(F.col("k1").alias("__quire_k1"), F.col("k2").alias("__quire_k2"))
    marked = docs.select(F.col(text_col).alias("text"), *_row_key(docs))
    made = map_arrow(marked.join(few(keys), ["__quire_k1", "__quire_k2"], "left_semi").select("text"), rows, "node long, shingles binary")
    return cut(made.groupBy("node").agg(F.first("shingles").alias("shingles")))  # wholly equal rows share a key


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a similarity of at least ``least``; a pivot of many pairs is compared in many tasks."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        near = pa.array([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), least) for a, b in zip(one, two)], pa.bool_())
        return batch.select([0, 1]).filter(near)

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    proposed = cut(pairs.distinct())
    n = proposed.count()
    both = salted_join(in_few_tasks(proposed, n), left, "u").join(right, "v").select("u", "v", "a", "b")
    return in_few_tasks(cut(map_arrow(both, rows, "u long, v long")), n)


def print_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): pairs that join the nodes (node, fp) whose fingerprints link, a spanning forest of the links and one pair for each further node of a fingerprint."""
    leads = cut(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    shared = leads.where("n > 1").select("fp", F.col("node").alias("u"))
    same = salted_join(nodes, shared, "fp").where("u <> node").select("u", F.col("node").alias("v"))
    return links(leads.select("fp", "node"), max_bits).unionByName(same)


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(key, node, size, place): the rarest shingles of each node (node, shingles), as many as two sets at ``least`` cannot both miss.

    A set of n shingles at similarity ``least`` with another shares at least ceil(least * n) of its own, so it shares one
    of its first n - ceil(least * n) + 1 in any order that is common to all sets; here the rarest come first. Shingles
    of one node alone are left out: they cannot be shared. A passage that many texts hold comes last in all of them.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        size = np.array([len(x) for x in own], np.int64)
        node = np.repeat(batch.column(0).to_numpy(), size)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(size, size)), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], ["node", "size", "key"])

    dealt = cut(map_arrow(sets.select("node", "shingles"), rows, "node long, size long, key long", 100))
    often = cut(dealt.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    seen = dealt.join(F.broadcast(often), "key", "left") if often.count() <= FEW else salted_join(dealt, often, "key", "left")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "key"))
    return seen.withColumn("place", place).where(F.col("often").isNotNull() & (F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)).select("key", "node", "size", "place")


def masks(sets: DataFrame) -> DataFrame:
    """(node, mask): of each shingle set (node, shingles), MASK bits that tell whether an odd number of its hashes falls on each, as longs."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x, np.uint64) >> np.uint64(64 - MASK.bit_length() + 1) for x in batch.column(1).to_pylist()]
        odd = np.array([np.packbits(np.bincount(x.astype(np.int64), minlength=MASK) & 1).view(np.int64) for x in own], np.int64).reshape(-1, MASK // 64)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in odd.T]], ["node", *WORDS])

    made = map_arrow(sets.select("node", "shingles"), rows, ", ".join(f"{c} long" for c in ["node", *WORDS]))
    return made.select("node", F.struct(*WORDS).alias("mask"))


def apart(a: str, b: str) -> Column:
    """At how many bits two masks differ. Each shingle that only one of the sets has changes one bit, so the sets differ in at least as many shingles."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in WORDS])


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, size, place, root): the rows of buckets that hold more than one of the classes ``found``."""
    rooted = cut(shared.select("key", "node", "size", "place").join(few(found), "node", "left").select("key", "node", "size", "place", F.coalesce("root", "node").alias("root")))
    spread = cut(rooted.groupBy("key").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).where("__low <> __high").select("key"))
    return cut(rooted.join(few(spread), "key", "left_semi"))


def classes(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float, max_bits: int = 4) -> DataFrame:
    """(node, root) for the nodes of checkpointed ``texts`` that link to another; ``root`` is the least node of the class. ``sets_of`` gives the shingle sets (node, shingles) of rows (k1, k2)."""
    # Rows of one node have the same fingerprint, keys and shingles, whichever is taken.
    nodes = cut(texts.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("first"), F.min("fp").alias("fp")).select("node", "first.k1", "first.k2", "fp"))
    dealt = texts.select("node", "size", F.lit(1).alias("place"), F.explode("keys").alias("key"))
    many = cut(dealt.groupBy("key").agg(F.min("node").alias("__low"), F.max("node").alias("__high")).where("__low <> __high").select("key"))
    shared = few_tasks(dealt.join(few(many), "key", "left_semi").distinct())
    pairs = few_tasks(print_pairs(nodes.select("node", "fp"), max_bits))
    met = cut(shared.select("node").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("node"))).distinct())
    sets = sets_of(cut(nodes.join(few(met), "node", "left_semi").select("k1", "k2")))
    odd = cut(masks(sets))
    # What two sets can share from these places on must reach their least overlap; at place 1 this compares sizes alone.
    overlap = F.ceil((F.col("size") + F.col("pivot.size")) * (least / (1 + least)) - 1e-9)
    near = F.least(F.col("size") - F.col("place"), F.col("pivot.size") - F.col("pivot.place")) + 1 >= overlap
    edges: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        edges.append(verified(pairs, sets, least))
        return cut(components(reduce(DataFrame.unionByName, edges)))

    def compared(shared: DataFrame, pivot: DataFrame) -> DataFrame:
        with_mask = pivot.select("key", "pivot.*").join(few(odd), "node").select("key", F.struct("node", "size", "place", "root", "mask").alias("pivot"))
        both = shared.join(few(odd), "node").join(with_mask, "key").where((F.col("pivot.node") < F.col("node")) & (F.col("root") != F.col("pivot.root")) & near)
        both = both.where(apart("mask", "pivot.mask") <= F.col("size") + F.col("pivot.size") - 2 * overlap)
        return linked(both.select(F.col("pivot.node").alias("u"), F.col("node").alias("v")))

    def pivoted(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        pivot = shared.groupBy("key").agg(F.min(F.struct("node", "size", "place", "root")).alias("pivot"))
        found = compared(shared, pivot)
        return found, _open(shared.join(pivot, "key").where(F.col("node") != F.col("pivot.node")), found)

    found = linked(pairs)
    found, shared = pivoted(_open(shared, found))
    if shared.isEmpty():
        return found
    left = cut(shared.select("node").distinct())
    shared = _open(few_tasks(prefixes(sets.join(few(left), "node", "left_semi"), least)), found)
    return found if shared.isEmpty() else compared(shared, shared.select("key", F.struct("node", "size", "place", "root").alias("pivot")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` for each class of near copies: that with the least id."""
    texts = cut(_texts(docs, id_col, text_col, shingle))
    rows = texts.groupBy("node", "id", "k1", "k2").agg(F.count("*").alias("n"))
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k1", "k2", "n")).alias("best"))
    named = best.join(few(classes(texts, lambda chosen: _sets(docs, chosen, text_col, shingle), least, max_bits)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = cut(named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.k1").alias("__quire_k1"), F.col("best.k2").alias("__quire_k2"), F.col("best.n").alias("n")))
    marked, keys = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *_row_key(docs)), ["__quire_k1", "__quire_k2"]
    out = marked.join(few(cut(kept.where("n = 1").select(*keys))), keys, "left_semi").drop(*keys)
    equal = kept.where("n > 1").select(*keys)
    if equal.isEmpty():
        return out
    return out.unionByName(marked.join(equal, keys, "left_semi").dropDuplicates(keys).drop(*keys))
