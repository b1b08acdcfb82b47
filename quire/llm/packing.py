"""Best-fit packing: tokenised documents into as few fixed-length sequences as possible, planned on the length histogram.

The plan needs only how many pieces have each length (at most ``length`` numbers, whatever the corpus). Lengths fall
into ``bins`` classes; all patterns of at most ``most_parts`` classes that together fill a sequence are enumerated, and
their repeat counts are fitted to the histogram by non-negative least squares, rounded down, and filled with the real
lengths. What is left goes best-fit, longest first, into the gaps of those sequences and then into new ones, again on
counts. A plan row says: places lo..hi-1 of the pieces of this length go to the sequences from ``base`` on, at one
offset. Pieces find their place by their rank among equal lengths, which is counted in salted parts, so that a length
that a third of all pieces have is ranked in many tasks.

Defined cases: a null or empty text is one piece, the end token alone; repeated ids are pieces of their own; null ids
keep their rows; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, map_arrow, raw, table

LENGTH, END = 4096, 1
CACHED = 120_000
#: Where words of a text can influence each other: strings of special tokens, and controls that str.split() takes for white space.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Marks that the tokenizer takes off the end of a word of letters, all at once.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


def _byte_letters() -> dict[int, str]:
    """Bytes to the letters that byte-level vocabularies write them with: printable ones as themselves, the others from code point 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


class Recent:
    """A bounded memory in two generations: when the young one is full it becomes the old one, from which what is asked for again returns."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit arrays. The tokenizer never joins text across white space, so a word's ids are remembered, within a bound. New words of plain letters go straight to its merge table; texts with special strings are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, _byte_letters()
        self.words, self.runs = Recent(CACHED), Recent(CACHED)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in ODD):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            text.encode("latin-1")  # such texts are composed, and lower-case letter by letter
            words, plain = text.lower().split(), True
        except UnicodeEncodeError:
            words, plain = text.split(), False
        self.words.turn()
        known, old = self.words.young, self.words.old
        for w in set(words).difference(known):
            ids = old.get(w)
            if ids is None:
                letters = w.rstrip(MARKS) if plain else ""
                if letters.isalpha():
                    ids = self._run(letters)
                    if len(letters) < len(w):
                        ids += self._whole(w[len(letters) :])
                else:
                    ids = self._whole(w)
            known[w] = ids
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")

    def _run(self, letters: str) -> bytes:
        runs = self.runs
        ids = runs.young.get(letters)
        if ids is None:
            ids = runs.old.get(letters)
            if ids is None:
                spelled = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.merges.tokenize(spelled)]).tobytes()
            runs.turn()
            runs.young[letters] = ids
        return ids

    def _whole(self, word: str) -> bytes:
        runs, key = self.runs, " " + word  # no run of letters begins with a space
        ids = runs.young.get(key)
        if ids is None:
            ids = runs.young[key] = runs.old.get(key) or array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return ids


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the token ids of each text and an end token, cut at ``length``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, last = encoder(path), np.array([end], "<u4")
        at, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
        for i, text in enumerate(raw(batch.column(1))):
            ids = np.concatenate((encode((text or b"").decode("utf-8", "replace")), last))
            for k, start in enumerate(range(0, len(ids), length)):
                own = ids[start : start + length]
                at.append(i)
                for name, value in (("piece", k), ("start", start), ("length", len(own)), ("ids_crc32", zlib.crc32(own.tobytes()))):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(own.astype(np.int32))
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(out["piece"], pa.int32()), *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]]
        if with_ids:
            columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, schema)


def patterns(bins: int, most_parts: int) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``most_parts`` classes that sum to ``bins``."""

    def grow(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for c in range(min(left, most), (left - 1) // parts, -1):
                for rest in grow(left - c, c, parts - 1):
                    yield (c, *rest)

    return list(grow(bins, bins, most_parts))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    ata, atb = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        gain = np.where(active, -np.inf, atb - ata @ x)
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            own = np.flatnonzero(active)
            s = np.linalg.lstsq(ata[np.ix_(own, own)], atb[own], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[own] = s
                break
            low = s <= 0
            step = np.min(x[own][low] / np.maximum(x[own][low] - s[low], 1e-300))
            x[own] += step * (s - x[own])
            active[own[x[own] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], length: int = LENGTH, bins: int = 64, most_parts: int = 3) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (piece length, lo, hi, base, offset): places lo..hi-1 of this length open at offset in sequences base..base+hi-lo-1."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if not left:
        return []
    width = -(-length // bins)
    classes = defaultdict(list)
    for n in sorted(left):
        classes[-(-n // width)].append(n)
    # Rounded-up classes always fit together; the shortest are left to fill gaps.
    found = [p for p in patterns(bins, most_parts) if all(c in classes for c in p) and min(p) > 2]
    groups: list[tuple[tuple[int, ...], int]] = []
    lengths = np.array(sorted(left))

    def falling(most: int):
        return (int(n) for n in lengths[: np.searchsorted(lengths, most, "right")][::-1])

    if found:
        matrix = np.zeros((bins + 1, len(found)))
        for j, p in enumerate(found):
            for c in p:
                matrix[c, j] += 1
        target = np.array([sum(left[n] for n in classes.get(c, [])) for c in range(bins + 1)], float)
        weight = np.sqrt(np.arange(bins + 1) / bins)  # a token missed counts alike in long and short classes
        # Fit shares, not counts, so that the fit is as well scaled for any corpus.
        repeats = nnls(matrix * weight[:, None], target * weight / max(1.0, target.max())) * max(1.0, target.max())
        for j in np.argsort(-repeats, kind="stable").tolist():
            p, need = found[j], int(repeats[j] + 1e-6)
            while need > 0:
                parts, used = [], {}
                for c in p[:-1]:
                    n = next((n for n in reversed(classes[c]) if left[n] > used.get(n, 0)), None)
                    if n is None:
                        break
                    parts.append(n)
                    used[n] = used.get(n, 0) + 1
                # The last part is the longest piece that still fits: it takes what rounding up left open.
                if len(parts) == len(p) - 1:
                    n = next((n for n in falling(length - sum(parts)) if left[n] > used.get(n, 0)), None)
                    if n is not None:
                        parts.append(n)
                        used[n] = used.get(n, 0) + 1
                if len(parts) < len(p):
                    break
                times = min(need, *(left[n] // k for n, k in used.items()))
                for n, k in used.items():
                    left[n] -= times * k
                groups.append((tuple(parts), times))
                need -= times
    # Best fit of the rest, longest first: gaps[g] are groups with g tokens open.
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for parts, times in groups:
        gaps[length - sum(parts)].append((parts, times))
    size = np.zeros(length + 1, bool)
    size[[g for g, v in gaps.items() if v]] = True
    for n in sorted(left, reverse=True):
        while left[n] > 0:
            fit = np.flatnonzero(size[n:])
            if len(fit):
                gap = n + int(fit[0])
                parts, times = gaps[gap].pop()
                take = min(times, left[n])
                if times > take:
                    gaps[gap].append((parts, times - take))
                size[gap] = bool(gaps[gap])
            else:
                per = length // n
                parts, take, gap = (), max(1, left[n] // per), length
                if left[n] >= per:
                    parts, gap = (n,) * (per - 1), length - n * (per - 1)
                    left[n] -= take * (per - 1)
                else:
                    take = 1
            gaps[gap - n].append(((*parts, n), take))
            size[gap - n] = True
            left[n] -= take
    rows, placed, base = [], defaultdict(int), 0
    for own in gaps.values():
        for parts, times in own:
            offset = 0
            for n in parts:
                rows.append((n, placed[n], placed[n] + times, base, offset))
                placed[n] += times
                offset += n
            base += times
    return rows


def pack(found: DataFrame, length: int = LENGTH, part_rows: int = 2_000) -> DataFrame:
    """``found`` (doc_id, piece, length and more; its rows are read twice) with sequence_id and offset."""
    total = found.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in total.collect()}  # at most ``length`` rows
    rows = plan(counts, length)
    # A length is ranked in parts of about ``part_rows`` pieces, dealt by hash; the table of parts has a row per length.
    salts = found.sparkSession.createDataFrame([(n, -(-c // part_rows)) for n, c in counts.items()], "__n long, __salts long")
    salted = found.join(F.broadcast(salts), F.col("length") == F.col("__n")).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__salts"))).drop("__n", "__salts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).select(F.col("length").alias("__length"), F.col("__salt").alias("__part"), F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("__rank", rank - 1)
    ranked = ranked.join(parts, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__part"))).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = ranked.select(*found.columns, "__rank")
    by_length = defaultdict(list)
    for n, lo, _, base, offset in rows:
        by_length[n].append((lo, base, offset))
    places = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for n, v in by_length.items()}
    shared = found.sparkSession.sparkContext.broadcast(places)  # a few rows per length, whatever the corpus
    at = ranked.columns.index("length")

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, k = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
            lo, base, off = shared.value[int(n[own[0]])]
            j = np.searchsorted(lo, k[own], "right") - 1
            sequence[own], offset[own] = base[j] + k[own] - lo[j], off[j]
        columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*found.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return map_arrow(ranked, rows_of, schema)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the pieces of all texts by the public word vocabulary."""
    import public_tokenizers

    found = pack(cut(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every row of ``documents`` with its sequence and place; defined cases as in the module's docstring."""
    return packed(table(spark, sf_dir, "documents"))
