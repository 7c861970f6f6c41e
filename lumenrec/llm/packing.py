"""Best-fit packing of token sequences by linear grouping.

1. Every document becomes pieces of at most `capacity` tokens; only longer ones are cut.
2. The driver sees a histogram: how many pieces have each length (at most `capacity` numbers, for any corpus).
3. Large lengths are put into groups of equal cardinality and rounded up to their group's largest, which
   leaves few sizes. The cheapest mix of configurations of these sizes comes from a linear program (column
   generation; a configuration is priced by a knapsack), rounded down.
4. Actual lengths take the places of the rounded ones, and the room that this frees goes to the longest
   piece that fits it. What rounding left over, the sequences that this leaves too empty, and all small
   pieces then go, longest first, to the fullest sequence that has room. Of several limits for "too empty"
   the plan with the fewest sequences wins.
   All this is done on runs of equal sequences, never on single ones, so that it costs the same for any corpus.
5. Each piece finds its place by its rank among the pieces of its length. Ranks are counted in hashed
   buckets, so that a length that a third of all pieces have is not gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged
from .tokens import END, encoder, vocabulary_path

CAPACITY = 1024
#: Pieces up to this share of the capacity are small: they fill what the others leave.
SMALL = 1 / 8
#: Sizes that rounding leaves; also the rows of the linear program.
GROUPS = 128
#: A run of the linear program's columns ends here at the latest; any basis is feasible, a further one only saves room.
ROUNDS = 3000
#: Pieces of a length that are ranked in one bucket, more or less.
BUCKET = 100_000
#: Rooms up to which a filled configuration is kept as it is before best fit.
TIGHT = (CAPACITY, 64, 32, 16, 8, 4, 2, 1, 0)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


# --- the plan, on the driver ------------------------------------------------


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken by the most valuable configuration."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right").tolist()
    for room in range(int(s[0]) if len(s) else capacity + 1, capacity + 1):
        got = best[room - s[: fits[room]]] + v[: fits[room]]
        k = int(got.argmax())
        best[room], take[room] = best[room - 1], -2
        if got[k] > best[room] + 1e-12:
            best[room], take[room] = got[k], k
    out, room = np.zeros(len(sizes)), capacity
    while room > 0 and take[room] != -1:
        if take[room] == -2:
            room -= 1
        else:
            out[order[take[room]]] += 1
            room -= int(s[take[room]])
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination: a small matrix, and no threads of a linear algebra library beside Spark's."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        rest = np.arange(n) != i
        both[rest] -= both[rest, i, None] * both[i]
    return both[:, n:]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (configurations) and how often each is used, by the linear program min sum x, A x >= wanted."""
    exact, wanted = wanted, wanted * (1 + 1e-4 * np.random.default_rng(0).random(len(wanted)))  # equal groups would make steps of length 0
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    for k in range(ROUNDS):
        price = inverse.sum(axis=0)
        column = _knapsack(np.maximum(price, 0), sizes, capacity)
        if (price * column).sum() <= 1 + 1e-7:
            break
        step, x = _times(inverse, column), _times(inverse, wanted)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse[out] /= step[out]
        rest = np.arange(len(sizes)) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
        if k % 100 == 99:
            inverse = _inverse(basis)
    return basis, np.maximum(_times(_inverse(basis), exact), 0)


class _Plan:
    """Runs of equal sequences, and which ranks of which lengths lie in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next, self.runs = capacity, 0, []
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)

    def put(self, length: int, rank: int, end: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, rank, end, first, each, offset))

    def leave(self, room: int, first: int, count: int) -> None:
        if count:
            self.open.setdefault(room, []).append((first, count))

    def new(self, count: int) -> int:
        self.next += count
        return self.next - count

    def best_fit(self, length: int, rank: int, end: int) -> None:
        """Each piece to the fullest sequence with room, else to a new one, for many pieces of one length."""
        while rank < end:
            room = min((r for r in self.open if r >= length), default=self.capacity)
            if room in self.open:
                first, count = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
            else:
                count = -(-(end - rank) // (room // length))
                first = self.new(count)
            each, n = room // length, end - rank
            whole = min(count, n // each)
            if whole:
                self.put(length, rank, rank + whole * each, first, each, self.capacity - room)
                self.leave(room - each * length, first, whole)
                rank += whole * each
            rest = min(end - rank, each) if whole < count else 0
            if rest:
                self.put(length, rank, rank + rest, first + whole, rest, self.capacity - room)
                self.leave(room - rest * length, first + whole, 1)
                rank += rest
            used = whole + bool(rest)
            self.leave(room, first + used, count - used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, ...]], int]:
    """(length, first rank, end rank, first sequence, pieces in each, offset) and the number of sequences."""
    small = int(capacity * SMALL)
    large = sorted((n for n in histogram if small < n < capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    left = _Left([], capacity)
    if total:
        # groups of equal cardinality along the lengths, longest first; a length may fall into several
        cuts = np.unique(np.linspace(0, total, min(groups, total) + 1).round().astype(np.int64))
        ends = np.cumsum([histogram[n] for n in large])
        rounded = np.array(large)[np.searchsorted(ends, cuts[:-1], "right")]
        sizes = np.unique(rounded)[::-1]
        wanted = np.array([float(sum(b - a for a, b, s in zip(cuts[:-1], cuts[1:], rounded) if s == size)) for size in sizes])
        basis, used = configurations(sizes, wanted, capacity)

        # a group's actual pieces, longest first, as [length, how many]
        have: list[list[list[int]]] = [[] for _ in sizes]
        for size, (a, b) in zip(rounded, zip(cuts[:-1], cuts[1:])):
            k = int(np.flatnonzero(sizes == size)[0])
            for i in range(int(np.searchsorted(ends, a, "right")), len(large)):
                begin = int(ends[i]) - histogram[large[i]]
                if begin >= b:
                    break
                have[k].append([large[i], int(min(b, ends[i]) - max(a, begin))])

        left = _Left(have, capacity)
        for column, count in zip(basis.T.round().astype(int), np.floor(used + 1e-6).astype(np.int64).tolist()):
            slots = [int(k) for k in np.flatnonzero(column) for _ in range(column[k])]
            left.fill(slots, count)
    plans = [_finish(histogram, left.filled, room, capacity) for room in TIGHT]
    return min(plans, key=lambda p: p[1])


class _Left:
    """Actual lengths that wait for a place, by group, and the sequences filled with them."""

    def __init__(self, have: list[list[list[int]]], capacity: int) -> None:
        self.have, self.capacity = have, capacity
        self.filled: list[tuple[list[int], int]] = []  # the actual lengths in a sequence, and how many sequences hold just these
        self.count: Counter = Counter()
        for group in have:
            for length, n in group:
                self.count[length] += n
        self.lengths = sorted(self.count)

    def longest(self, room: int, taken: Counter) -> int:
        """The longest waiting length that fits, 0 if none does."""
        for i in range(bisect_right(self.lengths, room) - 1, -1, -1):
            if self.count[self.lengths[i]] > taken[self.lengths[i]]:
                return self.lengths[i]
        return 0

    def fill(self, slots: list[int], count: int) -> None:
        """So many sequences of a configuration: a slot takes the longest actual piece of its group, the last one the longest that fits at all.

        What rounding up has left free is so given to longer pieces than the configuration asks for, and after
        the last slot to further ones. Equal sequences are filled at once, each turn uses up a length.
        """
        while count > 0:
            taken: Counter = Counter()
            room = self.capacity
            for k in slots[:-1]:
                mine = next((length for length, _ in self.have[k] if self.count[length] > taken[length] and length <= room), 0) or self.longest(room, taken)
                if mine:
                    taken[mine] += 1
                    room -= mine
            while mine := self.longest(room, taken):
                taken[mine] += 1
                room -= mine
            if not taken:
                return
            n = min([count, *(self.count[x] // t for x, t in taken.items())])
            for x, t in taken.items():
                self.count[x] -= n * t
            self.filled.append((sorted(taken.elements(), reverse=True), n))
            count -= n
            for k in set(slots):
                while self.have[k] and not self.count[self.have[k][0][0]]:
                    self.have[k].pop(0)
            self.lengths = [x for x in self.lengths if self.count[x]]


def _finish(histogram: dict[int, int], filled: list[tuple[list[int], int]], room: int, capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Keep the sequences that actual pieces fill up to `room`; best-fit everything else, longest first."""
    out, taken = _Plan(capacity), dict.fromkeys(histogram, 0)
    if n := histogram.get(capacity, 0):
        out.put(capacity, 0, n, out.new(n), 1, 0)
        taken[capacity] = n
    for inside, count in filled:
        if capacity - sum(inside) <= room:
            first, offset = out.new(count), 0
            for length in inside:
                out.put(length, taken[length], taken[length] + count, first, 1, offset)
                taken[length] += count
                offset += length
            out.leave(capacity - offset, first, count)
    for length in sorted((n for n in histogram if n), reverse=True):
        out.best_fit(length, taken[length], histogram[length])
    return out.runs, out.next


# --- the operator ----------------------------------------------------------


def _cut(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_pylist(), []
            for doc, ids in zip(docs, encoder(vocabulary).encode(batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n])) for i, (s, n) in enumerate(pieces_of(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are packed too, as the end id alone; rows of equal
    doc_id are documents of their own; an empty table gives an empty result.
    What is broadcast are the runs of equal sequences, some thousands for any
    input, and the numbers of buckets, one for each length; the sums of the buckets
    before one, a row for each BUCKET pieces, are joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or vocabulary_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(_cut(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = staged(pieces, "pieces")
    histogram = {r["length"]: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)

    # a bucket for so many pieces of a length; at most `capacity` rows
    buckets = spark.createDataFrame([(n, -(-count // BUCKET)) for n, count in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    schema = "run_length long, low long, high long, first long, each long, place long"
    table = spark.createDataFrame([tuple(int(x) for x in r) for r in runs], schema)
    here = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    sequence = F.col("first") + F.floor(nth / F.col("each")).cast("long")
    return ranked.join(F.broadcast(table), here).select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"))
