"""SentencePiece encoding and decoding of texts of any length by a max-plus scan over chunks.

A text is a path through the lattice of pieces that match it. Under a unigram model the best path has the highest sum
of scores. Under a byte-pair model the encoding is the one path whose neighbouring pieces all stay apart when their
pair is merged alone, so its weights are 0 (stable pair) and minus infinity. Either way a chunk is a matrix over the
pieces that may lie across its two borders: the best weight from each piece that enters to each piece that leaves.
Matrices are combined associatively, in groups and then groups of a text, which gives the piece across every border;
each chunk is then traced back on its own between the two pieces known at its ends.

No piece has a word mark behind another character (checked on the vocabulary), so paths meet wherever a word begins:
inside a chunk only the stretch before its first and behind its last word start needs the lattice, and the words
between are encoded one by one and remembered, within a bound. Texts of at most ``chunk`` characters are one chunk.

Defined cases: a null or empty text has no ids; characters without a piece fall back to bytes; a literal word mark is a
space, as in the library; texts that are equal share one scan; decoding gives back the text with word marks as spaces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, map_arrow, partitions_for, raw, salted_join, table, whole

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CUTS = re.compile(f"(?<=[^{MARK}]){MARK}")
CHUNK, GROUP, CACHED = 16_384, 256, 150_000
#: Chunks whose matrices one task combines.
TASK_CHUNKS = 512
NONE = float("-inf")


class Vocabulary:
    """Pieces and scores of a model file; ``kind`` is bpe or unigram."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        n = self.library.get_piece_size()
        normal = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in normal}
        self.ids = {self.library.id_to_piece(i): i for i in normal}
        self.piece = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.score))
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has a word mark behind another character")
        byte = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.byte = [byte.get(b, self.library.unk_id()) for b in range(256)]
        self.unknown = min(self.score.values()) - 10
        self.surface = {i: p.replace(MARK, " ").encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in byte.items()}
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @property
    def reach(self) -> int:
        """How many characters of its surroundings a chunk is given on either side: more than a piece, enough for most words."""
        return 4 * self.longest

    def best(self, text: str) -> list[str]:
        """Pieces (or single unknown characters) of a marked text that is encoded alone."""
        return self._merged(text) if self.kind == "bpe" else self._viterbi(text)

    def _merged(self, text: str) -> list[str]:
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score, heap = self.score, []

        def push(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, len(parts[i]), len(parts[j])))

        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] is None or len(parts[i]) != a:
                continue
            j = after[i]
            if j >= len(parts) or len(parts[j]) != b:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p is not None]

    def _viterbi(self, text: str) -> list[str]:
        n = len(text)
        best, back = [0.0] + [NONE] * n, [0] * (n + 1)
        for p in range(n):
            for piece in self.at(text, p):
                w = best[p] + self.weight(piece)
                if w > best[p + len(piece)]:
                    best[p + len(piece)], back[p + len(piece)] = w, p
        out = []
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1]

    def at(self, text: str, p: int) -> list[str]:
        """The pieces that match at p; the character itself if none of one character does."""
        own = [text[p : p + n] for n in range(1, min(self.longest, len(text) - p) + 1)]
        return [s for k, s in enumerate(own) if k == 0 or s in self.score]

    def weight(self, piece: str) -> float:
        return 0.0 if self.kind == "bpe" else self.score.get(piece, self.unknown)

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` in one path."""
        if self.kind != "bpe":
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            found = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return found

    def to_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return out

    def encode(self, marked: str) -> bytes:
        """Ids of a marked text between two piece borders, as little-endian 32-bit numbers."""
        units = UNITS.findall(marked)
        cache = self.cache
        found = list(map(cache.get, units))
        if None in found:
            own: dict[str, bytes] = {}
            fresh = list(dict.fromkeys(u for u, ids in zip(units, found) if ids is None))
            # The library puts a word mark before a text, so it can encode units that begin with one.
            whole = [u for u in fresh if u[0] == MARK and len(u) > 1]
            for u, ids in zip(whole, self.library.encode([u[1:] for u in whole], num_threads=1)):
                own[u] = np.array(ids, "<u4").tobytes()
            for u in fresh:
                if u not in own:
                    own[u] = np.array(self.to_ids(self.best(u)), "<u4").tobytes()
            found = [ids or own[u] for u, ids in zip(units, found)]
            if len(cache) > CACHED:
                cache.clear()
            cache.update((u, ids) for u, ids in own.items() if len(u) <= 64)
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        surface = self.surface
        return b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(4)
def vocabulary(path: str, kind: str) -> Vocabulary:
    return Vocabulary(path, kind)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


State = tuple[int, str]  # characters by which a piece passes the border, and the piece ("" where paths met)
Matrix = dict[State, dict[State, float]]


def border(v: Vocabulary, before: str, after: str) -> list[State]:
    """The pieces that may lie across or end at the border between two neighbouring stretches of ``v.reach`` characters (fewer at the text's ends). One state where a word starts, and where the word around the border is seen whole; its encoding does not depend on others."""
    if after[:1] == MARK and before[-1:] != MARK:
        return [(0, "")]
    around, at = before + after, len(before)
    cuts = [m.start() for m in CUTS.finditer(around)]
    start = max((c for c in cuts if c < at), default=None)
    end = min((c for c in cuts if c > at), default=len(around) if len(after) < v.reach else None)
    if start is not None and end is not None:
        p = start
        for s in v.best(around[start:end]):
            p += len(s)
            if p >= at:
                return [(p - at, s if v.kind == "bpe" else "")]
    near = max(0, at - v.longest)
    out = {(p + len(s) - at, s) for p in range(near, at) for s in v.at(around[: at + v.longest], p) if p + len(s) >= at}
    return sorted(out) if v.kind == "bpe" else sorted({(d, "") for d, _ in out})


def transfer(v: Vocabulary, left: str, text: str, right: str) -> Matrix:
    """Best weights from each entering to each leaving state of a chunk; ``left`` and ``right`` are its surroundings."""
    n, around = len(text), text + right[: v.longest]
    sources: list[State] = border(v, left[-v.reach :], (text + right)[: v.reach]) if left else [(0, "")]
    exits = set(border(v, (left + text)[-v.reach :], right[: v.reach])) if right else None
    starts = [m.start() for m in re.finditer(f"(?<!{MARK}){MARK}", (left[-1:] or "x") + text)]
    starts = [s - 1 for s in starts if s >= 1]
    last_start = starts[-1] if starts else None
    exits_cut = right[:1] == MARK and text[-1:] != MARK
    live: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    leaving: dict[State, np.ndarray] = {}

    def put(table: dict, key, value: np.ndarray) -> None:
        table[key] = np.maximum(table[key], value) if key in table else value

    for k, (d, s) in enumerate(sources):
        unit = np.full(len(sources), NONE)
        unit[k] = 0.0
        if d >= n:
            if d <= len(around):
                put(leaving, (d - n, "" if exits_cut else s), unit)
        else:
            put(live[d], s, unit)
    cuts, p = set(starts), 0
    while p < n:
        own = live.pop(p, None)
        if own is None:
            p += 1
            continue
        if p in cuts:
            met = np.max(list(own.values()), axis=0)
            if p < last_start:
                if v.kind != "bpe":
                    met = met + sum(v.weight(s) for u in UNITS.findall(text[p:last_start]) for s in v.best(u))
                live[last_start] = {"": met}
                p = last_start
                continue
            own = {"": met}
        for s in v.at(around, p):
            end = p + len(s)
            reach = [w for before, w in own.items() if before == "" or v.follows(before, s)]
            if not reach:
                continue
            best = np.max(reach, axis=0) + v.weight(s)
            key = s if v.kind == "bpe" else ""
            if end < n:
                put(live[end], key, best)
            else:
                put(leaving, (end - n, "" if exits_cut else key), best)
        p += 1
    return {src: {dst: float(w[k]) for dst, w in leaving.items() if w[k] > NONE and (exits is None or dst in exits)} for k, src in enumerate(sources)}


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for src, row in a.items():
        own: dict[State, float] = {}
        for mid, w in row.items():
            for dst, x in b.get(mid, {}).items():
                if w + x > own.get(dst, NONE):
                    own[dst] = w + x
        out[src] = own
    return out


def trace(matrices: list[Matrix], source: State, target: State | None) -> list[State]:
    """The states at all borders of a chain, from ``source`` to ``target`` (None: the best way to end exactly)."""
    ahead = [{source: 0.0}]
    for m in matrices:
        ahead.append(compose({source: ahead[-1]}, m)[source])
    if target is None:
        done = {s: w for s, w in ahead[-1].items() if s[0] == 0}
        target = max(sorted(done), key=done.get)
    path = [target]
    for m, before in zip(reversed(matrices), reversed(ahead[:-1])):
        path.append(max(sorted(s for s in before if path[-1] in m.get(s, {})), key=lambda s: before[s] + m[s][path[-1]]))
    return path[::-1]


CELL = "array<struct<d: int, s: string, to_d: int, to_s: string, w: double>>"
_CELL = pa.list_(pa.struct([("d", pa.int32()), ("s", pa.string()), ("to_d", pa.int32()), ("to_s", pa.string()), ("w", pa.float64())]))


def _cells(m: Matrix) -> list[dict]:
    return [{"d": a, "s": s, "to_d": b, "to_s": t, "w": w} for (a, s), row in m.items() for (b, t), w in row.items()]


def _matrix(cells: list[dict]) -> Matrix:
    out: Matrix = {}
    for c in cells:
        out.setdefault((c["d"], c["s"]), {})[c["to_d"], c["to_s"]] = c["w"]
    return out


def crc32_join(a: int, b: int, length_b: int) -> int:
    """crc32 of two byte strings joined, from theirs: ``a`` is moved over ``length_b`` zero bytes in GF(2)."""

    def times(matrix: list[int], vector: int) -> int:
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    shift = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):
        shift = [times(shift, x) for x in shift]
    while length_b:
        if length_b & 1:
            a = times(shift, a)
        shift = [times(shift, x) for x in shift]
        length_b >>= 1
    return a ^ b


def chunks(texts: DataFrame, path: str, kind: str, chunk: int) -> DataFrame:
    """(h, k, left, text, right) of texts (h, text): marked chunks with as much of their surroundings as a piece may reach."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        reach = vocabulary(path, kind).reach
        out: list[list] = [[], [], [], [], []]
        for h, t in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            whole = marked(t.decode("utf-8", "replace"))
            for k, a in enumerate(range(0, len(whole), chunk)):
                for column, value in zip(out, (h, k, whole[max(0, a - reach) : a], whole[a : a + chunk], whole[a + chunk : a + chunk + reach])):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *[pa.array(c, pa.string()) for c in out[2:]]], ["h", "k", "left", "text", "right"])

    return map_arrow(texts, rows, "h string, k long, left string, text string, right string")


def borders(split: DataFrame, path: str, kind: str) -> DataFrame:
    """(h, k, in_d, out_d): by how many characters pieces pass the borders of each chunk."""

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path, kind)
        found = [_cells(transfer(v, *surround)) for surround in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _CELL)], ["h", "k", "cells"])

    each = cut(map_arrow(split.select("h", "k", "left", "text", "right"), matrices, f"h string, k long, cells {CELL}").withColumn("g", F.floor(F.col("k") / GROUP)))

    # Matrices are small but work to combine. Tasks that are merged by size would get all of them, so groups of chunks
    # are dealt to a number of tasks that follows the number of chunks, and a task goes through its groups itself.
    tasks = partitions_for(each.sparkSession, each.count(), TASK_CHUNKS)

    def by_group(rows_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = whole(batches)
            if rows is None:
                return
            rows = rows.sort_by([("h", "ascending"), ("g", "ascending"), ("k", "ascending")])
            h, g = rows["h"].to_pylist(), rows["g"].to_pylist()
            begin = [i for i in range(len(h)) if not i or (h[i], g[i]) != (h[i - 1], g[i - 1])]
            for a, b in zip(begin, [*begin[1:], len(h)]):
                yield from rows_of(rows.slice(a, b - a)).to_batches()

        return run

    def product(own: pa.Table) -> pa.Table:
        total = None
        for cells in own["cells"].to_pylist():
            total = _matrix(cells) if total is None else compose(total, _matrix(cells))
        return pa.table({"h": own["h"][:1], "g": own["g"][:1], "cells": pa.array([_cells(total)], _CELL)})

    groups = each.repartition(tasks, "h", "g").mapInArrow(by_group(product), f"h string, g long, cells {CELL}")

    def ends(own: pa.Table) -> pa.Table:
        own = own.sort_by("g")
        states = trace([_matrix(c) for c in own["cells"].to_pylist()], (0, ""), None)
        return pa.table({"h": own["h"], "g": own["g"], **{f"{side}_{part}": pa.array([s[i] for s in states[a : a + len(own)]], kind_) for side, a in (("from", 0), ("to", 1)) for part, i, kind_ in (("d", 0, pa.int32()), ("s", 1, pa.string()))}})

    known = groups.groupBy("h").applyInArrow(ends, "h string, g long, from_d int, from_s string, to_d int, to_s string")

    def inside(own: pa.Table) -> pa.Table:
        at = own.slice(0, 1).to_pylist()[0]
        states = trace([_matrix(c) for c in own["cells"].to_pylist()], (at["from_d"], at["from_s"]), (at["to_d"], at["to_s"]))
        return pa.table({"h": own["h"], "k": own["k"], "in_d": pa.array([s[0] for s in states[:-1]], pa.int32()), "out_d": pa.array([s[0] for s in states[1:]], pa.int32())})

    return each.join(known, ["h", "g"]).repartition(tasks, "h", "g").mapInArrow(by_group(inside), "h string, k long, in_d int, out_d int")


PART = "n_ids long, crc long, decoded boolean, ids binary"


def _part(v: Vocabulary, own: str) -> tuple[int, int, bool, bytes]:
    ids = v.encode(own)
    return len(ids) // 4, zlib.crc32(ids), v.decode(ids) == own.replace(MARK, " ").encode(), ids


def _parts(keys: list, names: list[str], found: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    columns = [pa.array([f[i] if i < 3 or with_ids else None for f in found], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*keys, *columns], [*names, "n_ids", "crc", "decoded", "ids"])


def _encoded(docs: DataFrame, path: str, kind: str, chunk: int, with_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of one chunk encoded; (doc_id, h) of longer rows; and the encoded chunks (h, k) of each longer text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") >= chunk, F.lit(False))

    def whole_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path, kind)
        found = [_part(v, marked((t or b"").decode("utf-8", "replace"))) for t in raw(batch.column(1))]
        return _parts([batch.column(0), pa.array([0] * len(found), pa.int64())], ["doc_id", "k"], found, with_ids)

    def traced(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path, kind)
        text, right, a, b = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
        found = [_part(v, (t + r[:d_out])[d_in:]) for t, r, d_in, d_out in zip(text, right, a, b)]
        return _parts([batch.column(0), batch.column(1)], ["h", "k"], found, with_ids)

    short = map_arrow(docs.where(~long), whole_texts, f"doc_id long, k long, {PART}")
    giant = docs.where(long).select("doc_id", "text", F.sha2("text", 256).alias("h"))
    split = cut(chunks(giant.select("h", "text"), path, kind, chunk).dropDuplicates(["h", "k"]))
    joined = split.join(borders(split, path, kind), ["h", "k"]).select("h", "k", "text", "right", "in_d", "out_d")
    return short, cut(giant.select("doc_id", "h")), map_arrow(joined, traced, f"h string, k long, {PART}")


def encode(docs: DataFrame, path: str, kind: str = "bpe", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, k, n_ids, crc, decoded, ids): one row per chunk of each row's text, one chunk for texts under ``chunk`` characters.

    ids are little-endian 32-bit numbers, crc their crc32; decoded tells whether decoding them gives back their text.
    """
    short, giant, parts = _encoded(docs, path, kind, chunk, True)
    return short.unionByName(salted_join(giant, parts, "h").drop("h"))


def decode(parts: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, k, text) of rows with ids: what each chunk decodes to; chunks in order of k make the text behind one leading space."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path, kind)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.decode(i or b"").decode("utf-8", "replace") for i in batch.column(2).to_pylist()], pa.string())], ["doc_id", "k", "text"])

    return map_arrow(parts.select("doc_id", "k", "ids"), rows, "doc_id long, k long, text string")


def digests(docs: DataFrame, path: str, kind: str = "bpe", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chunks, n_ids, ids_crc32, decoded) for each row of docs: the crc32 of all its ids, joined from its chunks'."""
    short, giant, parts = _encoded(docs, path, kind, chunk, False)

    def joined(own: pa.Table) -> pa.Table:
        own = own.sort_by("k")
        crc = 0
        for c, n in zip(own["crc"].to_pylist(), own["n_ids"].to_pylist()):
            crc = crc32_join(crc, c, 4 * n)
        return pa.table({"h": own["h"][:1], "n_chunks": pa.array([len(own)], pa.int64()), "n_ids": pa.array([sum(own["n_ids"].to_pylist())], pa.int64()), "ids_crc32": pa.array([crc], pa.int64()), "decoded": pa.array([all(own["decoded"].to_pylist())])})

    texts = parts.drop("ids").groupBy("h").applyInArrow(joined, "h string, n_chunks long, n_ids long, ids_crc32 long, decoded boolean")
    return short.select("doc_id", F.lit(1).cast("long").alias("n_chunks"), "n_ids", F.col("crc").alias("ids_crc32"), "decoded").unionByName(salted_join(giant, texts, "h").drop("h"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Chunks, ids and their crc32 for each row of ``documents``, and whether they decode to its text; defined cases as in the module's docstring."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
