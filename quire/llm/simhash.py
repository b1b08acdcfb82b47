"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index over them, and classes of linked documents.

Only distinct fingerprints enter the search, so any number of exact copies costs one entry. Two fingerprints within
``max_bits`` differences agree on all but ``max_bits`` of any set of bit blocks; each fingerprint therefore goes to one
bucket per choice of the other blocks, and every link is found in some bucket. Five blocks serve up to about 16 million
fingerprints, more blocks keep the buckets small beyond. Inside a bucket, fingerprints are sorted by Gray rank and
runs of them are folded into nodes that keep the bits all members share. Two nodes are compared on the bits both share:
more differences than allowed prune all their pairs at once. A bucket returns a spanning forest of its links, never
all pairs. Buckets above ``bucket_rows`` are split into parts that meet pair by pair in tasks of their own.

Defined cases: a null or wordless text has fingerprint zero and links like any other; texts under the shingle length
are one shingle; null ids keep their rows and link; rows that repeat an id
are documents of their own, each with the class of its own text; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, map_arrow, partitions_for, raw, released, salted_join, table, whole
from quire.llm.graph import components

FAN = 8
HASH_SEED = 42
#: Ids are below this number.
NAMELESS = 1 << 62
#: Shingles turned into bits at once, and node pairs compared at once: what bounds a task's memory.
SLICE, FRONT = 1 << 14, 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; zero without any."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLICE):
        votes += np.unpackbits(hashes[k : k + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text: A-Z lower-cased, words split at ASCII white space, XXH64 of each shingle."""
    import xxhash

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= shingle:
        return int.from_bytes(digest(line, HASH_SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for k in range(0, len(first), SLICE):
        hashes = b"".join([digest(line[a:b], HASH_SEED) for a, b in zip(first[k : k + SLICE], last[k : k + SLICE])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint's 64 bits as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([simhash(t, shingle) for t in raw(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in reflected Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the graph over 0..n-1."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by (group, Gray rank); no node crosses a group's border."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, max_bits: int):
        self.codes, self.max_bits = codes, max_bits
        n = len(codes)
        near = (group[1:] == group[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= max_bits)
        self.run = np.concatenate(([0], np.cumsum(~near)))  # neighbours in Gray order that link already
        self.chain = np.flatnonzero(near)
        self.levels = []
        own, first, last, both, any_ = group, np.arange(n), np.arange(1, n + 1), codes, codes
        while True:
            border = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            place = np.arange(len(own)) - np.repeat(border, np.diff(np.append(border, len(own))))
            start = np.flatnonzero(place % FAN == 0)
            stop = np.append(start[1:], len(own))
            both, any_ = np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(any_, start)
            first, last, own = first[start], last[stop - 1], own[start]
            shared = ~(both ^ any_)
            self.levels.append({"start": start, "stop": stop, "shared": shared, "bits": both & shared, "run": np.where(self.run[first] == self.run[last - 1], self.run[first], -1)})
            if len(own) == len(border):
                break
        self.groups = own

    def links(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between top nodes left[i] and right[i] (a node with itself: within it)."""
        a_all, b_all = [self.chain], [self.chain + 1]
        todo = [(len(self.levels) - 1, left, right)]
        found = 0
        while todo:
            k, a, b = todo.pop()
            if len(a) > FRONT // (FAN * FAN):
                half = len(a) // 2
                todo += [(k, a[:half], b[:half]), (k, a[half:], b[half:])]
                continue
            if k < 0:
                near = np.bitwise_count(self.codes[a] ^ self.codes[b]) <= self.max_bits
                a_all.append(a[near])
                b_all.append(b[near])
                found += int(near.sum())
                if found > FRONT:
                    x, y = _forest(len(self.codes), np.concatenate(a_all), np.concatenate(b_all))
                    a_all, b_all, found = [x], [y], 0
                continue
            v = self.levels[k]
            apart = np.bitwise_count((v["bits"][a] ^ v["bits"][b]) & v["shared"][a] & v["shared"][b])
            keep = (apart <= self.max_bits) & ~((v["run"][a] >= 0) & (v["run"][a] == v["run"][b]))
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            wide_a, wide_b = v["stop"][a] - v["start"][a], v["stop"][b] - v["start"][b]
            pair = np.repeat(np.arange(len(a)), wide_a * wide_b)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(wide_a * wide_b) - wide_a * wide_b, wide_a * wide_b)
            x = v["start"][a][pair] + step // wide_b[pair]
            y = v["start"][b][pair] + step % wide_b[pair]
            fresh = (a[pair] != b[pair]) | ((x < y) if k == 0 else (x <= y))
            todo.append((k - 1, x[fresh], y[fresh]))
        return _forest(len(self.codes), np.concatenate(a_all), np.concatenate(b_all))


def masks(max_bits: int, blocks: int) -> list[int]:
    """Bit masks of which two fingerprints agree on at least one if at most ``max_bits`` bits differ: all choices of blocks - max_bits of the blocks."""
    border = [round(64 * k / blocks) for k in range(blocks + 1)]
    own = [((1 << b) - (1 << a)) for a, b in zip(border, border[1:])]
    return [sum(c) for c in combinations(own, blocks - max_bits)]


def blocks_for(n: int, max_bits: int, aim: int = 2_000) -> int:
    """The fewest blocks with which n spread-out fingerprints make buckets of about ``aim`` or fewer, so that the work of a fingerprint does not grow with n: more blocks make more and smaller buckets."""
    blocks = max_bits + 1
    while blocks < max_bits + 5 and n / 2 ** (64 * (blocks - max_bits) / blocks) > aim:
        blocks += 1
    return blocks


def links(distinct: DataFrame, max_bits: int = 4, bucket_rows: int = 2_000_000, task_rows: int = 1_000_000, blocks: int | None = None) -> DataFrame:
    """(u, v) for the distinct fingerprints ``fp``: edges whose components are those of all links of ``max_bits`` or fewer differing bits. Ends are named by the column ``node`` if there is one, else by fp. ``blocks`` is chosen by the number of rows unless given."""
    spark = distinct.sparkSession
    distinct = distinct.select("fp", F.col("node" if "node" in distinct.columns else "fp").alias("node"))
    own = masks(max_bits, blocks or blocks_for(distinct.count(), max_bits))
    keys = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)), F.lit(k)) for k, m in enumerate(own)]
    dealt = distinct.select("fp", "node", F.explode(F.array(*keys)).alias("bucket"))
    count = dealt.groupBy("bucket").count()
    total = count.agg(F.sum("count")).first()[0] or 0
    hot = count.where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts"))
    dealt = dealt.select("fp", "node", "bucket", F.lit(0).alias("side"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    if total > bucket_rows and (n_hot := hot.count()):
        if n_hot > 1_000_000:
            raise ValueError("bucket_rows is too small for this table")
        split = dealt.join(F.broadcast(hot), "bucket", "left")  # counted above
        split = split.withColumn("side", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        dealt = split.select("fp", "node", "bucket", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = whole(batches)
        if rows is None:
            return
        fp, node, bucket, side, low, high = (c.to_numpy() for c in rows.columns)
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), side, high, low, bucket))
        codes, node, bucket, side, low, high = codes[order], node[order], bucket[order], side[order], low[order], high[order]
        task = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))).cumsum()
        group = np.concatenate(([True], (task[1:] != task[:-1]) | (side[1:] != side[:-1]))).cumsum()
        index = GrayIndex(group, codes, max_bits)
        at = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))  # a row of each top node
        top = np.arange(len(at))
        within = low[at] == high[at]
        two = np.flatnonzero((task[at][1:] == task[at][:-1]) & ~within[1:])
        a, b = index.links(np.concatenate((top[within], two)), np.concatenate((top[within], two + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])
        del rows, index, order, codes, node, bucket, side, low, high, task, group
        released()

    task = partitions_for(spark, total, task_rows)
    return dealt.repartition(task, "bucket", "low", "high").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fp, class_id) for each input row; class_id is the smallest id that links reach from the row's fingerprint."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    # Copies of one text share a fingerprint that a third of all rows may have: its rows meet their class in many tasks.
    # A fingerprint is named by its smallest id, so the least name that links reach is the class; ones without any id get
    # names above all ids.
    name = F.coalesce("least_id", F.shiftrightunsigned("fp", 2).bitwiseOR(F.lit(NAMELESS)))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least_id")).select("fp", name.alias("node")))
    root = components(links(distinct, max_bits)).select("node", "root")
    classes = distinct.join(root, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    classes = classes.select("fp", F.when(F.col("class_id") < NAMELESS, F.col("class_id")).alias("class_id"))
    return salted_join(marked, classes, "fp").select("id", "fp", "class_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and class of each row of ``documents``; ids that are null or repeat and empty tables as in the module's docstring."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))
