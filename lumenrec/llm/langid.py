"""Language ID by unigram pieces over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. The
probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, found by a forward pass along the word; a
text's is the product over its words. A pass is scaled as it goes, so that no
word is too long for it. Piece probabilities are learned by expectation
maximisation (forward and backward sums) over all words of about SAMPLE documents
of each language, chosen by a hash of their id. Each round is a pass of the
workers over the counted words; the driver sees a number for each piece and
language.

Words are runs of letters (by their Unicode category), lower case, with the
vocabulary's word-begin mark in front. Their language scores are remembered by a
worker, so the forward pass runs once for a word, not once for each occurrence.
In learning, words of more than LONG letters are taken in parts of that length.

Odd input: null texts and texts without a letter are `und` with score 0; a null
lang is not learned from; ties go to the alphabetically first language; rows of
equal doc_id are predicted each for itself; without any labelled document all
are `und`; an empty table gives an empty result; other columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, staged
from .toxicity import held_out

SAMPLE = 2_000
ROUNDS = 4
VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Learning takes longer words in parts.
LONG = 4096
#: Letters of a block of words, and of a stretch of one long word, that are worked on at once.
BLOCK = 60_000
#: Words up to this length are summed without logarithms in learning; the least piece probabilities to this power are still numbers.
SHORT = 24
#: Sums below this are scaled up.
TINY = 1e-100

_RUNS = re.compile(r"[^\W\d_]+").findall


def letters(run: str) -> list[str]:
    """The runs of letters of a word; numbers such as a half are no letters."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters, numbered."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return {p: i for i, p in enumerate(sorted(p for p in found if p.lstrip(MARK).isalpha()))}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[int, tuple] = {}


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of some words as numbers, place x word, and the words' lengths."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    out = np.zeros((int(size.max(initial=0)), len(words)), np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    out[np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size), word] = codes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return out, size


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
    for t in range(len(codes)):
        out[t + 1] = out[t] * _BASE + codes[t]
    return out


def _table(vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted hashes of the pieces, their numbers, which low bits occur, and the longest piece."""
    known = _tables.get(id(vocabulary))
    if known is None or known[0] is not vocabulary:
        codes, size = _codes(list(vocabulary))
        keys = _prefixes(codes)[size, np.arange(len(size))]
        order = np.argsort(keys)
        present = np.zeros(1 << 19, bool)
        present[keys & np.uint64((1 << 19) - 1)] = True
        known = _tables[id(vocabulary)] = (vocabulary, keys[order], np.array(list(vocabulary.values()), np.int64)[order], present, int(size.max(initial=1)))
    return known[1:]


def arcs(codes: np.ndarray, valid: np.ndarray, vocabulary: dict[str, int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """All pieces in some words, by length: (length, bounds, word, piece); those that end after t letters are bounds[t] to bounds[t + 1].

    valid: place x word, whether a word has such a place. Single letters that are no piece count as the piece after the last.
    """
    keys, numbers, present, longest = _table(vocabulary)
    prefix, (n, width) = _prefixes(codes), codes.shape
    out, power = [], 1
    for length in range(1, min(longest, n) + 1):
        power = power * int(_BASE) % (1 << 64)
        h = (prefix[length:] - prefix[:-length] * np.uint64(power)).ravel()
        maybe = np.flatnonzero(present[h & np.uint64(len(present) - 1)] & valid[length - 1 :].ravel())
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        same = keys[at] == h[maybe]
        if length == 1:
            found = np.flatnonzero(valid.ravel())
            piece = np.full(len(h), len(vocabulary))
            piece[maybe[same]] = numbers[at[same]]
            piece = piece[found]
        else:
            found, piece = maybe[same], numbers[at[same]]
        if len(found):
            out.append((length, np.searchsorted(found, width * (np.arange(n + 2) - length)), found % width, piece))
    return out


def score(words: list[str], p: np.ndarray, vocabulary: dict[str, int]) -> np.ndarray:
    """Logarithm of each word's probability, word x language; p: piece x language.

    Only the sums of the last places are kept, and they are scaled up whenever they become small.
    """
    longest = _table(vocabulary)[3]
    codes, size = _codes([MARK + w for w in words])
    stretch, last = max(longest, BLOCK // len(words)), set(size.tolist())
    out, scale = np.zeros((len(words), p.shape[1])), np.zeros((len(words), p.shape[1]))
    sums = np.zeros((longest + stretch, len(words), p.shape[1]))
    sums[longest - 1] = 1
    for low in range(0, len(codes), stretch):
        high = min(low + stretch, len(codes))
        before = min(low, longest - 1)
        part = codes[low - before : high]
        inside = np.arange(low - before + 1, high + 1)[:, None] <= size
        mine = arcs(part, inside, vocabulary)
        if len(words) == 1:  # the arcs of one long word in a row, by their ends
            ends = np.concatenate([np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) for _, bounds, _, _ in mine])
            order = np.argsort(ends, kind="stable")
            lengths, numbers = np.concatenate([np.full(len(x), n) for n, _, _, x in mine])[order], np.concatenate([x for _, _, _, x in mine])[order]
            first = np.searchsorted(ends[order], np.arange(len(part) + 2))
        for t in range(low + 1, high + 1):
            row, here = longest - 1 + t - low, t - low + before
            if len(words) == 1:
                some = slice(first[here], first[here + 1])
                sums[row, 0] = (sums[row - lengths[some], 0] * p[numbers[some]]).sum(axis=0)
            else:
                sums[row] = 0
                for length, bounds, word, piece in mine:
                    if bounds[here] < bounds[here + 1]:
                        w = word[bounds[here] : bounds[here + 1]]
                        sums[row, w] += sums[row - length, w] * p[piece[bounds[here] : bounds[here + 1]]]
            small = sums[row] < TINY
            if small.any() and (small := small & (size >= t)[:, None]).any():
                window = sums[max(row - longest + 1, 0) : row + 1]
                window[:, small] /= TINY
                scale[small] += np.log(TINY)
            if t in last:
                done = size == t
                out[done] = np.log(sums[row, done]) + scale[done]
        sums[:longest] = sums[high - low : high - low + longest].copy()
    return out


def expected(words: list[str], weight: np.ndarray, p: np.ndarray, vocabulary: dict[str, int]) -> np.ndarray:
    """How often each piece is used in words of one language, over all segmentations by their share; p: of each piece."""
    out = np.zeros(len(p))
    codes, size = _codes([MARK + w for w in words])
    n, every = len(codes), np.arange(len(words))
    mine = arcs(codes, np.arange(1, n + 1)[:, None] <= size, vocabulary)
    logs = n > SHORT
    one, none = (0.0, -np.inf) if logs else (1.0, 0.0)
    value = np.log(p) if logs else p
    times, plus = (np.add, np.logaddexp) if logs else (np.multiply, np.add)
    ahead, back = np.full((n + 1, len(words)), none), np.full((n + 1, len(words)), none)
    ahead[0], back[size, every] = one, one
    each = lambda t: ((length, word[a:b], piece[a:b]) for length, bounds, word, piece in mine if (a := bounds[t]) < (b := bounds[t + 1]))
    for t in range(1, n + 1):
        for length, w, piece in each(t):
            ahead[t, w] = plus(ahead[t, w], times(ahead[t - length, w], value[piece]))
    total = ahead[size, every]
    for t in range(n, 0, -1):
        for length, w, piece in each(t):
            on = times(back[t, w], value[piece])
            back[t - length, w] = plus(back[t - length, w], on)
            share = np.exp(ahead[t - length, w] + on - total[w]) if logs else ahead[t - length, w] * on / total[w]
            np.add.at(out, piece, share * weight[w])
    return out


def blocks_of(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words, those of like length together, so many at once as have about BLOCK letters with their padding."""
    block: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if block and (len(block) + 1) * (len(words[i]) + 1) > BLOCK:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


class Scorer:
    def __init__(self, model: tuple[list[str], np.ndarray, dict[str, int]]) -> None:
        self.langs, self.p, self.vocabulary = model
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def _learn(self, new: list[str]) -> None:
        parts = [letters(w) for w in new]
        flat = [x for own in parts for x in own]
        scores = np.zeros((len(flat), len(self.langs)))
        for block in blocks_of(flat):
            scores[block] = score([flat[i] for i in block], self.p, self.vocabulary)
        begin = np.cumsum([0] + [len(own) for own in parts])
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(scores, axis=0)]) if any(len(own) != 1 for own in parts) else None
        mine = scores if sums is None else sums[begin[1:]] - sums[begin[:-1]]
        self.number.update((w, len(self.rows) + i if own else -1) for i, (w, own) in enumerate(zip(new, parts)))
        self.rows = np.concatenate([self.rows, mine])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.number) > 500_000:
            self.number, self.rows = {}, self.rows[:0]
        parts = [_RUNS((t or "").lower()) for t in texts]
        new = sorted(set().union(*parts).difference(self.number))
        if new and self.langs:
            self._learn(new)
        names, scores = [], []
        for words in parts:
            at = np.array(list(map(self.number.__getitem__, words)), np.int64) if self.langs else np.zeros(0, np.int64)
            at = at[at >= 0]
            if not len(at):
                names.append("und")
                scores.append(0.0)
                continue
            total = self.rows[at].sum(axis=0)
            best = int(total.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


# --- learning ---------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(_RUNS((text or "").lower()))
    for lang, runs in counts.items():
        c: Counter = Counter()
        for run, n in runs.items():
            for w in letters(run):
                for i in range(0, len(w), LONG):
                    c[w[i : i + LONG]] += n
        words, times = list(c), list(c.values())
        for i in range(0, len(words), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words[i : i + 10_000]), pa.string()), pa.array(words[i : i + 10_000], pa.string()), pa.array(times[i : i + 10_000], pa.int64())], names=["lang", "word", "n"])


def _used(langs: list[str], p, vocabulary):
    """How often the counted words use each piece in each language: rows (lang number, piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(langs), len(vocabulary.value) + 1))
        waiting: list[tuple[list[str], list[int]]] = [([], []) for _ in langs]

        def work(k: int) -> None:
            words, n = waiting[k]
            weight = np.array(n, float)
            for block in blocks_of(words):
                out[k] += expected([words[i] for i in block], weight[block], p.value[:, k], vocabulary.value)
            waiting[k] = ([], [])

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                k = langs.index(lang)
                waiting[k][0].append(word)
                waiting[k][1].append(n)
                if len(waiting[k][0]) >= 5_000:
                    work(k)
        for k in range(len(langs)):
            work(k)
        k, piece = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(out[k, piece], pa.float64())], names=["k", "piece", "n"])

    return run


def learn(counts: DataFrame, langs: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Piece probabilities, piece x language, from counts(lang, word, n)."""
    context = counts.sparkSession.sparkContext
    names = context.broadcast(vocabulary)
    p = np.full((len(vocabulary) + 1, len(langs)), 1 / (len(vocabulary) + 1))
    for _ in range(ROUNDS):
        shared = context.broadcast(p)
        rows = counts.mapInArrow(_used(langs, shared, names), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        used = np.full(p.shape, 0.1)
        used[rows.piece, rows.k] += rows.n
        p = used / used.sum(axis=0)
        shared.destroy()
    names.destroy()
    return p


def train(docs: DataFrame, usable: Column, vocabulary: str | None = None) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """Languages, piece probabilities and the vocabulary, from docs(doc_id, text, lang) whose doc_id meets `usable`."""
    names = pieces(vocabulary or vocabulary_path())
    labelled = docs.filter(usable).filter("lang is not null and text is not null")
    # of a language with n documents those with the least hashes, a share of SAMPLE / n; one number for each language
    size = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return [], np.zeros((len(names) + 1, 0)), names
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, SAMPLE / n))) for x, n in size.items()))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = labelled.filter(hashed < share).select(F.col("text").cast("string"), "lang").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the sample's words are few bytes but much work, so they are dealt out
    tasks = min(64, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counts = staged(counts.repartition(tasks, F.xxhash64("word")), "words")
    p = learn(counts, langs, names)
    discard(counts)
    return langs, p, names


def languages(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs(doc_id, text, lang); lang of held-out ids is not looked at."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out(5, 0), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            names, scores = scorer(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
