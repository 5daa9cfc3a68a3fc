"""Packing token pieces into sequences by length patterns.

The plan depends on the histogram of piece lengths alone, which has at most ``capacity`` entries
whatever the corpus: patterns of few lengths that fill a sequence well are enumerated, non-negative
least squares gives the number of times to repeat each, the numbers are rounded to what the
histogram allows, and best-fit packs the pieces that remain. Pieces then find their place by their
rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .batches import bound_batches, release

CAPACITY = 4096
#: Share of a sequence that a fitted pattern fills.
FILL = 0.95
#: Buckets that the pieces of one length are ranked in, and pieces of all lengths that add another.
SALTS, SALT_ROWS = 64, 200_000
#: Pieces that a task places at least, if there are so many.
PART_ROWS = 20_000
#: Chunks kept in a worker's cache of encoded chunks.
CACHE = 400_000
_MARKS = frozenset(b".,!?;:|")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others are numbered from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_LETTERS = byte_letters()


class Chunks(dict):
    """Encoded ids of chunks of text without white space, filled as they are asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.word = tokenizer, tokenizer.model.tokenize

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > 1 and chunk[-1] in _MARKS and 97 <= chunk[-2] <= 122:
            ids = self[chunk[:-1]] + self[chunk[-1:]]  # one mark after a letter is a word of its own
        else:
            text = chunk.decode("utf-8", "replace")
            if text.isascii():
                simple = text.isalpha() and text.islower()
            else:  # Latin letters, whose case and composition are the same everywhere
                simple = text.isalpha() and max(text) < "\u0250" and "\u0130" not in text
                text = text.lower().encode().decode("latin-1").translate(_LETTERS) if simple else text
            if simple:  # one run of letters is one word
                found = [t.id for t in self.word(text)]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[chunk] = ids
        return ids


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The tokenizer drops white space and nothing it does reaches across it, so a text's ids are those
    of its chunks between ASCII white space, one after another. It folds case, so A-Z is folded
    first, unless a special token's name may be spelt. The cache of chunks is of bounded size."""

    def __init__(self, path: str, keep: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache, self.keep = Chunks(Tokenizer.from_file(path)), keep

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.cache) > self.keep:
            self.cache.clear()
        find = self.cache.__getitem__
        return [b"".join(map(find, (t if b"<|" in t else t.lower()).split())) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document (null text: empty); only longer documents
    are cut. A document always has the end id, so every row gives at least one piece."""
    bound_batches(documents.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        own = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for ident, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        chunk = ids[start : start + 4 * capacity]
                        rows.append((ident, k, start // 4, len(chunk) // 4, zlib.crc32(chunk)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(cut, PIECES)


def patterns(lengths: list[int], capacity: int, per_length: int = 4) -> list[tuple[int, ...]]:
    """For every length, patterns of one to four lengths that hold it and fill a sequence best."""
    found: set[tuple[int, ...]] = set()
    have = sorted(lengths)

    def largest(room: int) -> int | None:
        i = bisect.bisect_right(have, room)
        return have[i - 1] if i else None

    for a in have:
        found.add((a,) * max(1, min(4, capacity // a)))
        second = largest(capacity - a)
        tried = 0
        i = bisect.bisect_right(have, capacity - a) - 1
        while second is not None and i >= 0 and tried < per_length:
            b = have[i]
            pattern, room = [a, b], capacity - a - b
            while len(pattern) < 4 and (c := largest(room)) is not None:
                pattern.append(c)
                room -= c
            found.add(tuple(sorted(pattern, reverse=True)))
            i, tried = i - 1, tried + 1
        for parts in (3, 4):  # lengths near an even share, then the best third or fourth
            if (b := largest((capacity - a) // (parts - 1))) is not None:
                pattern, room = [a] + [b] * (parts - 2), capacity - a - b * (parts - 2)
                if (c := largest(room)) is not None:
                    found.add(tuple(sorted([*pattern, c], reverse=True)))
    return sorted(found, key=lambda p: (-sum(p), p))


def nonnegative_fit(patterns_: list[tuple[int, ...]], wanted: dict[int, int], capacity: int, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W(Ax - h)|^2 + waste by least squares, each length weighed by
    the share of a sequence that it fills: projected coordinate descent on the sparse pattern matrix,
    in which each pattern touches at most four lengths."""
    x = np.zeros(len(patterns_))
    rest = {n: float(c) for n, c in wanted.items()}
    uses = [tuple((n, m, m * (n / capacity) ** 2) for n, m in Counter(p).items()) for p in patterns_]
    norm = [sum(m * w for _, m, w in u) for u in uses]
    waste = [(capacity - sum(p)) / capacity for p in patterns_]
    for _ in range(rounds):
        moved = 0.0
        for j, u in enumerate(uses):
            step = (sum(w * rest[n] for n, _, w in u) - waste[j]) / norm[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for n, m, _ in u:
                    rest[n] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (pattern, repeats), equal sequences built at once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    have = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []
    while have:
        pattern, room, used = [], capacity, Counter()
        while True:
            i = bisect.bisect_right(have, room) - 1
            while i >= 0 and used[have[i]] >= left[have[i]]:
                i -= 1
            if i < 0:
                break
            pattern.append(have[i])
            used[have[i]] += 1
            room -= have[i]
        times = min(left[n] // m for n, m in used.items())
        out.append((tuple(pattern), times))
        for n, m in used.items():
            left[n] -= m * times
            if not left[n]:
                have.remove(n)
    return out


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up a histogram of lengths exactly: the fitted patterns, then best fit
    of the pieces that rounding leaves."""
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    plan = fitted_plan(left, capacity)
    return plan + best_fit(left, capacity)


def fitted_plan(left: dict[int, int], capacity: int, fill: float = FILL) -> list[tuple[tuple[int, ...], int]]:
    """The patterns that fill a sequence to ``fill``, repeated as the fit says; ``left`` loses their pieces.

    Repeats are rounded by largest remainders: whole parts first, then one more of each pattern by
    falling remainder, as far as the histogram allows."""
    plan: list[tuple[tuple[int, ...], int]] = []
    if capacity in left:
        plan.append(((capacity,), left.pop(capacity)))
    options = [p for p in patterns(list(left), capacity) if sum(p) >= fill * capacity]
    if not options:
        return plan
    fit = nonnegative_fit(options, left, capacity)
    uses = [Counter(p) for p in options]
    repeats = np.zeros(len(options), np.int64)

    def take(j: int, times: int) -> None:
        times = min(times, *(left.get(n, 0) // m for n, m in uses[j].items()))
        if times > 0:
            repeats[j] += times
            for n, m in uses[j].items():
                left[n] -= m * times

    for j in np.argsort(-fit, kind="stable"):
        take(j, int(fit[j]))
    rest = fit - np.floor(fit)
    for j in np.argsort(-rest, kind="stable"):
        if rest[j] > 1e-6:
            take(j, 1)
    for n in [n for n, c in left.items() if not c]:
        del left[n]
    return plan + [(options[j], int(t)) for j, t in enumerate(repeats) if t]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, pieces a sequence) of the plan's places:
    ranks of a length are dealt to the plan's patterns one after another."""
    out, taken, sequence = [], defaultdict(int), 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from pieces(), written) with sequence_id and offset.

    The driver sees one count a length (at most ``capacity``) and the plan's places are found by
    binary search in each task. Ranks within a length come from buckets, more for a larger table, and the
    counts before them, so a length that most pieces have is no hot key, nor are pieces without doc_id.
    Pieces of equal length are dealt by bucket, doc_id, piece; rows equal in all are alike.
    An empty table gives an empty result."""
    spark = cut.sparkSession
    salts = SALTS + cut.count() // SALT_ROWS
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths", 8)  # a row a length and salt at most
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    places: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    for length, first, _, sequence, offset in slots(packing_plan(histogram, capacity)):
        for store, value in zip(places[length], (first, sequence, offset)):
            store.append(value)
    table = spark.sparkContext.broadcast({n: tuple(np.asarray(c, np.int64) for c in v) for n, v in places.items()})
    within = Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(counts.select("length", "salt", "base"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within")).alias("rank"))

    def place(batches):
        plan = table.value
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                first, base, at = plan[int(n)]
                k = np.searchsorted(first, ranks[own], "right") - 1
                sequence[own] = base[k] + ranks[own] - first[k]
                offset[own] = at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.coalesce(1 + sum(histogram.values()) // PART_ROWS).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Cut, plan and place all documents: one row a piece.

    Null and empty texts are one piece with the end id; repeated rows are packed once each; extra
    columns are ignored; an empty table gives no pieces."""
    return pack(materialize(pieces(documents, tokenizer, doc_id=doc_id, text=text, end_id=end_id, capacity=capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
