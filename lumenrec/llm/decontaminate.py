"""Benchmark decontamination: documents that hold a benchmark item, up to some edits.

Items and documents are sequences of words (lower case, letters and digits). An
item-sized window of a document is a match if its word edit distance to the item
is at most `edits` of the item's words.

Candidates come from CGK embeddings. A random walk along a sequence puts out the
word it stands on and goes on to the next one if a random bit of that word and the
step says so; sequences a few edits apart walk apart for some steps and fall into
step again, so that edit distance becomes Hamming distance between the words put
out. Bit sampling compares the words at a few steps. Each repetition lays its
windows along a word of the item: the window reaches from that word on to the
item's end or back to its begin, the first sampled step is the word itself, and
the others are drawn from a geometric grid of steps. Only places of a document
that hold such a word are walked from. The rarest words of the benchmark's items
come first, since they have the fewest places.

The number of repetitions belongs to the item's length: it is the least one with
which simulated items, as many of their words edited as are allowed, are found
with the target recall; the tests and the README give the recall that results.
Every candidate is verified by its exact distance.

Items are taken to the workers in blocks of at most BLOCK_WORDS words; each block
is a pass over the documents, so the memory does not grow with the benchmark.

Odd input: items and texts that are null or without words match nothing; an item
of up to four words matches only as it is; equal rows get equal results; null ids
are carried along; an empty table on either side gives no match; other columns
are ignored or, where rows are filtered, kept.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_words, mix, small_batches, table_of, utf8

EDITS = 0.2
TARGET = 0.999
#: Words of the items that a worker holds at once.
BLOCK_WORDS = 1 << 20
#: Walks at once.
WALKS = 200_000
#: More repetitions than this are not tried.
MOST = 32
#: Simulated items of each length by which repetitions are counted.
TRIALS = 500

_INSIDE, _VALUE = table_of({b for b in range(128) if not chr(b).isalnum()}, lower=False)
#: Steps that may be sampled; a word moves the walk on by half a word a step.
GRID = np.unique(np.geomspace(1, 2048, 34).round().astype(np.int64))


def _random(*parts: np.ndarray | int) -> np.ndarray:
    """A fixed random number for each combination of some numbers."""
    out = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        out = mix((out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def walk(words: np.ndarray, bits: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, way: np.ndarray, salt: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Where walks from the words `at` stand after `steps` steps, way +1 or -1; -1 once they leave [low, high)."""
    out = np.full(len(at), -1)
    order = np.argsort(-steps, kind="stable")
    place, last = (at + way)[order], steps[order]
    way, salt, low, high = way[order], salt[order], low[order], high[order]
    alive = np.arange(len(order))
    for step in range(1, int(last.max(initial=0)) + 1):
        alive = alive[: np.searchsorted(-last[alive], -step, "right")]
        alive = alive[(place[alive] >= low[alive]) & (place[alive] < high[alive])]
        if not len(alive):
            break
        here = place[alive]
        done = last[alive] == step
        out[order[alive[done]]] = here[done]
        move = (bits[here] >> ((salt[alive] + 23 * step) & 63).astype(np.uint64)) & np.uint64(1)
        place[alive] = here + way[alive] * move.astype(np.int64)
    return out


class Index:
    """Sampled walks of a block of items, found by the words that their windows begin with."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float, repetitions: dict[int, int] | None = None, samples: int | None = None) -> None:
        self.items, self.edits = items, edits
        size = np.array([len(w) for _, w in items], np.int64)
        # one sampled word more for each hundredfold number of items keeps chance candidates rare
        self.samples = samples or max(1, math.ceil(math.log(len(items) + 1, 100) - 1))
        need = repetitions if repetitions is not None else {n: needed(n, edits, self.samples) for n in set(size.tolist()) if n}
        words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        begin = np.concatenate([[0], np.cumsum(size)])
        _, number, often = np.unique(words, return_inverse=True, return_counts=True)
        item, offset, rep = [], [], []
        for i, n in enumerate(size.tolist()):
            if n:
                own = slice(begin[i], begin[i + 1])
                rare = np.lexsort((_random(words[own], 1), often[number[own]]))
                count = need[n]
                item.append(np.full(count, i))
                rep.append(np.arange(count))
                offset.append(rare[np.arange(count) % n])
        item, offset, rep = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, offset, rep))
        at, low, high = begin[item] + offset, begin[item], begin[item + 1]
        key = _random(words[at], rep)
        plan = np.zeros((len(item), self.samples), np.int64)  # way * step of each sample
        for s in range(self.samples):
            draw = _random(rep, item, s, 2)
            ahead, behind = high - at - 1, at - low
            forward = (draw >> np.uint64(8)) % np.maximum(ahead + behind, 1).astype(np.uint64) < ahead.astype(np.uint64)
            way = np.where(forward, 1, -1)
            # a walk of 3/2 steps a word hardly leaves the item before its end
            room = np.searchsorted(GRID, np.maximum(3 * np.where(forward, ahead, behind) // 2, 1), "right")
            step = GRID[((draw >> np.uint64(32)) % np.maximum(room, 1).astype(np.uint64)).astype(np.int64)]
            for _ in range(8):  # a walk that does leave it is sampled earlier
                end = walk(words, mix(words), at, low, high, way, self.salt(rep, s), step)
                step = np.where((end < 0) & (step > 1), GRID[np.maximum(np.searchsorted(GRID, step) * 2 // 3, 0)], step)
            end = walk(words, mix(words), at, low, high, way, self.salt(rep, s), step)
            plan[:, s] = np.where(end >= 0, way * step, 0)
            key = np.where(end >= 0, _random(key, plan[:, s], words[np.maximum(end, 0)]), key)
        order = np.argsort(key, kind="stable")
        self.keys, self.item, self.offset, self.rep_of = key[order], item[order], offset[order], rep[order]
        self.present, self.low = self._bits(self.keys)
        # what is walked from a word: a plan for each repetition
        entries, _ = np.unique(np.column_stack([words[at].view(np.int64), rep, plan]), axis=0, return_index=True) if len(item) else (np.zeros((0, 2 + self.samples), np.int64), None)
        anchors = entries[:, 0].view(np.uint64) if len(entries) else np.zeros(0, np.uint64)
        order = np.argsort(anchors, kind="stable")
        self.anchors, first = np.unique(anchors[order], return_index=True)
        self.first = np.append(first, len(anchors))
        self.rep, self.plan = entries[order, 1], entries[order, 2:]
        self.begins, self.begins_low = self._bits(self.anchors)

    @staticmethod
    def salt(rep: np.ndarray, sample: int) -> np.ndarray:
        return rep * 29 + sample * 7

    @staticmethod
    def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        size = 1 << max(16, int(16 * len(keys)).bit_length())
        present = np.zeros(size, bool)
        present[keys & np.uint64(size - 1)] = True
        return present, np.uint64(size - 1)

    def hits(self, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place in the text, number of the sampled walk), as many places at once as keep the walks in the cache."""
        hit = np.flatnonzero(self.begins[words & self.begins_low]) if len(self.anchors) else ()
        if not len(hit):
            return
        a = np.minimum(np.searchsorted(self.anchors, words[hit]), len(self.anchors) - 1)
        same = self.anchors[a] == words[hit]
        hit, a = hit[same], a[same]
        bits = mix(words)
        count = self.first[a + 1] - self.first[a]
        stops = np.concatenate([[0], np.cumsum(count)])
        done = 0
        while done < len(hit):
            until = max(done + 1, int(np.searchsorted(stops, stops[done] + WALKS, "right")) - 1)
            c, f = count[done:until], self.first[a[done:until]]
            at = np.repeat(hit[done:until], c)
            entry = np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(f, c)
            done = until
            text = np.searchsorted(begin, at, "right") - 1
            key = _random(words[at], self.rep[entry])
            keep = np.ones(len(at), bool)
            for s in range(self.samples):
                plan = self.plan[entry, s]
                live = np.flatnonzero(keep & (plan != 0))
                end = walk(words, bits, at[live], begin[text[live]], begin[text[live] + 1], np.sign(plan[live]), self.salt(self.rep[entry[live]], s), np.abs(plan[live]))
                keep[live[end < 0]] = False
                key[live] = _random(key[live], plan[live], words[np.maximum(end, 0)])
            live = np.flatnonzero(keep)
            live = live[self.present[key[live] & self.low]]
            left, right = np.searchsorted(self.keys, key[live], "left"), np.searchsorted(self.keys, key[live], "right")
            n = right - left
            live = np.repeat(live, n)
            yield text[live], at[live] - begin[text[live]], np.arange(len(live)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)

    def candidates(self, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place in the text where the item would begin) for texts whose words follow each other."""
        for text, place, z in self.hits(words, begin):
            yield from sorted(set(zip(text.tolist(), self.item[z].tolist(), (place - self.offset[z]).tolist())))


_needed: dict[tuple, int] = {}


def edited(rng: np.random.Generator, items: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Items (a row each) with so many of their words replaced, deleted or followed by a new one: words in a row, and where each item begins."""
    chosen = rng.random(items.shape).argsort(axis=1).argsort(axis=1) < edits
    kind = np.where(chosen, rng.integers(3, size=items.shape), 3).ravel()
    times = np.array([1, 0, 2, 1])[kind]
    out = np.repeat(items.ravel(), times)
    last = np.cumsum(times) - 1
    new = last[(kind == 0) | (kind == 2)]
    out[new] = rng.integers(1 << 62, size=len(new), dtype=np.uint64)
    return out, np.concatenate([[0], np.cumsum(times.reshape(items.shape).sum(axis=1))])


def needed(n: int, edits: float, samples: int, target: float = TARGET) -> int:
    """Repetitions with which the target share of edited items of n words are candidates; lengths in steps of an eighth share theirs."""
    e = int(edits * n)
    if not e:
        return 1
    step = max(1, 1 << max(0, n.bit_length() - 4))
    n = -(-n // step) * step
    e = int(edits * n)
    key = (n, edits, samples, target)
    if key not in _needed:
        rng = np.random.default_rng(n)
        # an item's words stand between foreign ones on both sides
        plain = rng.integers(1 << 62, size=(TRIALS, n), dtype=np.uint64)
        words, begin = edited(rng, plain, e)
        size = np.diff(begin)
        text = rng.integers(1 << 62, size=len(words) + 2 * n * TRIALS, dtype=np.uint64)
        text[np.arange(len(words)) + n * (2 * np.repeat(np.arange(TRIALS), size) + 1)] = words
        begin = begin + 2 * n * np.arange(TRIALS + 1)
        index = Index(list(enumerate(plain)), edits, {n: MOST}, samples)
        first = np.full(TRIALS, MOST)
        for t, _, z in index.hits(text, begin):
            np.minimum.at(first, t, np.where(index.item[z] == t, index.rep_of[z], MOST))
        _needed[key] = min(MOST, int(np.sort(first)[math.ceil(target * TRIALS) - 1]) + 1)
    return _needed[key]


def distance(item: np.ndarray, words: np.ndarray) -> int:
    """Least number of word edits between the item and any run of the words."""
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for w in item:
        after = np.empty_like(row)
        after[0] = row[0] + 1
        after[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(after - steps) + steps
    return int(row.min())


def matches(index: Index, words: np.ndarray, begin: np.ndarray, edits: float) -> Iterator[tuple[int, int, int]]:
    """(text, item, distance) of the matches; each text and item once, at its best place."""
    best: dict[tuple[int, int], int] = {}
    reached: dict[tuple[int, int], tuple[int, int]] = {}
    for text, i, place in index.candidates(words, begin):
        item = index.items[i][1]
        slack = int(edits * len(item)) + 1
        if best.get((text, i)) == 0 or reached.get((text, i), (0, -1))[0] <= place <= reached.get((text, i), (0, -1))[1]:
            continue
        reached[text, i] = (place - slack // 2, place + slack // 2)  # nearby places are inside the stretch that is compared
        own = words[begin[text] : begin[text + 1]]
        own = own[max(0, place - slack) : place + len(item) + 3 * slack]
        if (own[:, None] == item).any(axis=1).sum() < len(item) - edits * len(item):
            continue  # too few of its words
        d = distance(item, own)
        if d <= edits * len(item) and d < best.get((text, i), 1 << 60):
            best[text, i] = d
    for (text, i), d in best.items():
        yield text, i, d


def item_words(text: str | None) -> np.ndarray:
    data, offsets = utf8(pc.utf8_lower(pa.array([text or ""], pa.large_string())))
    return next((h for _, h, _ in documents_words(data, offsets, _INSIDE, _VALUE)), np.zeros(0, np.uint64))


def _blocks(benchmark: DataFrame, edits: float) -> Iterator[Index]:
    """Indexes of about BLOCK_WORDS words each, one block of rows on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for row in items.toLocalIterator():
        block.append((row.item_id, item_words(row.text)))
        held += len(block[-1][1]) + 16
        if held >= BLOCK_WORDS:
            yield Index(block, edits)
            block, held = [], 0
    if block:
        yield Index(block, edits)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return documents_words(*utf8(pc.utf8_lower(column.cast(pa.large_string()))), _INSIDE, _VALUE)


def contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, n_words of the item, n_edits and similarity = 1 - n_edits / n_words of each match."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_words long, n_edits long, similarity double"
    out = None
    for index in _blocks(benchmark, edits):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for first, words, begin in _texts(batch.column(1)):
                    for text, i, d in matches(index, words, begin, edits):
                        n = len(index.items[i][1])
                        found.append((ids[first + text], index.items[i][0], n, d, 1 - d / n))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, kinds)], names=["doc_id", "item_id", "n_words", "n_edits", "similarity"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _clean(shared, edits: float):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        for first, words, begin in _texts(texts):
            out[[first + text for text, _, _ in matches(shared.value, words, begin, edits)]] = False
        return pa.array(out)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of docs without any benchmark item, all columns kept."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _blocks(benchmark, edits):
        docs = docs.filter(_clean(spark.sparkContext.broadcast(index), edits)(F.col("text").cast("string")))
    return docs
