"""Near-duplicate documents: SetSketch registers, banded, estimated jointly, verified on whole shingle sets.

A document's set holds the hashes of its k-word shingles. Each of M registers
keeps 1 - log_b of the least of the set's exponential draws, truncated to 16
bits: registers of a union are maxima of registers, and two sets agree in a
register about as often as their Jaccard similarity. Four registers make a band;
documents that share a band are compared.

Nothing compares all pairs of a group. Documents with equal sets are one class.
In a bucket each class is first compared with the bucket's least one, and the
links found are closed to components. Only where a bucket still holds several
components are its members compared with those of other components, on whole sets,
and only links that join two components are returned. Members of a bucket's
largest component are one side and all others the other; a side is dealt into size
classes, of which only like or neighbouring ones can be similar, and these into
blocks. Blocks are compared in pairs, except two of the largest component, so an
outlier in a bucket costs one more copy of its members and not their square.

Odd input: null and empty texts, and texts without words, have the empty set and
are linked with nothing; equal rows get equal results; a null doc_id is never
linked and is kept; an empty table gives an empty result; further columns are
ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_words, free_name, mix, small_batches, staged, table_of, utf8
from .graph import components

REGISTERS, ROWS = 64, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Classes compared at once in a bucket that is still open.
BLOCK = 256
#: Tasks over which the members of one open bucket are dealt when they meet its blocks.
SALTS = 16
#: Bits of the largest map that says which documents' sets are wanted before their texts are shuffled.
MAP = 1 << 27
#: Deviations of the estimate by which a pair must miss the threshold to be ruled out unseen.
MARGIN = 5.5
SIGNATURE = "doc_id long, n_shingles long, set_id binary, bands array<long>"

_rng = np.random.Generator(np.random.PCG64(7))
_FLIP = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_INSIDE, _VALUE = table_of({32, 9, 10, 11, 12, 13}, lower=True)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, as sorted hashes; fewer words make one shingle of all."""
    n = len(words)
    if not n:
        return words
    out = np.zeros(max(1, n - k + 1), np.uint64)
    for i in range(min(k, n)):
        out = (out ^ words[i : i + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(mix(out + np.uint64(min(k, n))))


def registers(items: np.ndarray) -> np.ndarray:
    """The M registers of a non-empty set, 16 bits each."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(items), 2048):
        np.minimum(least, ((items[i : i + 2048, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, hashes, begin in documents_words(*utf8(column), _INSIDE, _VALUE):
        for i in range(len(begin) - 1):
            yield shingle_set(hashes[begin[i] : begin[i + 1]], k)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, bands = [], [], []
            for s in _sets(batch.column(1), k):
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1), k)], pa.binary())], names=["doc_id", "shingles"])

    return run


_GRID = np.linspace(0, 1, 201)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity under which the registers' order is likeliest, sizes given (one row a pair)."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - above - below
    share = na / (na + nb)
    u, v = share[:, None], 1 - share[:, None]
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    least = 1e-12
    score = above * np.log(np.maximum(up, least)) + below * np.log(np.maximum(down, least)) + same * np.log(np.maximum(1 - up - down, least))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], 1)[:, 0]


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int64), np.uint16).reshape(len(column), REGISTERS)


def _plausible(threshold: int):
    low = threshold / 100 - MARGIN * np.sqrt(threshold / 100 * (1 - threshold / 100) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, nu, nv, bu, bv = batch.columns
            if not batch.num_rows:
                continue
            nu, nv = nu.to_numpy().astype(float), nv.to_numpy().astype(float)
            sized = 100 * np.minimum(nu, nv) >= threshold * np.maximum(nu, nv)
            keep = sized & (likely_similarity(_registers(bu), _registers(bv), nu, nv) >= low)
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep))

    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def links_between(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that join components, as a forest: every pair of different components is compared on whole sets.

    sides: 0 and 1 for the two blocks of a pair of blocks, which are compared with each other only; 0 for one block.
    """
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size, comp, two = np.diff(at), comps.copy(), bool(sides.max())
    seen = np.zeros(int(flat.max()) + 1, np.int32)
    found = []
    for i in range(len(ids)):
        other = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]))
        other[: i + 1] = False
        if two:
            other &= sides != sides[i]
        rest = np.flatnonzero(other)
        if not len(rest):
            continue
        seen[flat[at[i] : at[i + 1]]] = 1
        both = np.add.reduceat(seen[np.concatenate([flat[at[j] : at[j + 1]] for j in rest])], np.concatenate([[0], np.cumsum(size[rest])[:-1]]))
        seen[flat[at[i] : at[i + 1]]] = 0
        for j in rest[100 * both >= threshold * (size[i] + size[rest] - both)]:
            if comp[j] != comp[i]:
                found.append((int(ids[i]), int(ids[j])))
                comp[comp == comp[j]] = comp[i]
    return found


def _opened(threshold: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        sets = [np.frombuffer(x, np.uint64) for x in group.shingles]
        found = links_between(group.doc_id.to_numpy(), group.comp.to_numpy(), group.side.to_numpy(), sets, threshold)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def open_blocks(members: DataFrame, threshold: int) -> DataFrame:
    """band, key, i, j, side, doc_id, comp: members(band, key, main, doc_id, comp, n) of open buckets, once for each pair of blocks (i, j) that has them."""
    least = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold) + 1e-9).cast("int") if threshold < 100 else F.col("n").cast("int")
    members = members.select("band", "key", "doc_id", "comp", (F.col("comp") != F.col("main")).cast("int").alias("other"), least.alias("class"))
    units = members.groupBy("band", "key", "other", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # a bucket's members are dealt over SALTS tasks, and its few units go to each of them
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).cast("int"))
    dealt = salted.join(units.select("*", salts), ["band", "key", "other", "class", "salt"]).withColumn("nth", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).cast("int")).drop("blocks")
    partner = units.select(F.col("band").alias("b"), F.col("key").alias("k"), F.col("other").alias("o"), F.col("class").alias("c"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("m")).select("*", salts.alias("s"))
    like = (F.col("band") == F.col("b")) & (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")) & (F.abs(F.col("class") - F.col("c")) <= 1) & (F.col("other") + F.col("o") > 0)
    mine, its = F.struct(F.col("other").alias("o"), F.col("class").alias("c"), F.col("nth").alias("m")), F.struct("o", "c", "m")
    return dealt.join(partner, like).select("band", "key", F.least(mine, its).alias("i"), F.greatest(mine, its).alias("j"), (mine > its).cast("int").alias("side"), "doc_id", "comp")


def perhaps(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose doc_id is among the n wanted ones, and a few others (3 to 6 in 100 as long as the map is not full size), without a shuffle.

    A hashed bit for each of the wanted, in a map of limited size that goes to all tasks: more of them let more others pass.
    """
    size = min(MAP, max(64, 1 << (16 * n).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    one = F.expr("shiftleft(1L, cast(bit % 64 AS int))")
    bits = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    marked = rows.withColumn("bit", bit).join(F.broadcast(bits), F.shiftright("bit", 6) == F.col("word"))
    return marked.filter(F.col("bits").bitwiseAND(one) != 0).select(*rows.columns)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text); threshold in hundredths."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(texts.mapInArrow(_signatures(k), SIGNATURE), "signatures")

    # one row for each distinct set; equal sets are one class, named by its least doc_id
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    banded = classes.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("hub")).filter("members > 1")
    shared = staged(banded.join(hubs, ["band", "key"]), "buckets")

    pairs = shared.filter("doc_id <> hub").select(F.col("doc_id").alias("u"), F.col("hub").alias("v")).distinct()
    left, right = (classes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"b{x}")) for x in "uv")
    near = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(_plausible(threshold), "u long, v long")
    near = staged(near, "pairs")

    wanted = near.select(F.col("u").alias("doc_id")).union(near.select("v")).union(shared.filter("members > 2").select("doc_id"))
    wanted = staged(wanted.distinct(), "wanted")
    # sets are made where the texts lie; only those of wanted documents, and of few others, are shuffled
    made = perhaps(texts, wanted, wanted.count()).mapInArrow(_shingles(k), "doc_id long, shingles binary")
    sets = staged(made.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")
    part = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    starred = staged(near.join(part("u"), "u").join(part("v"), "v").select("u", "v", "su", "sv").mapInArrow(_verified(threshold), "u long, v long"), "links")
    labels = components(starred)

    # buckets in which members other than the hub are still in different components
    comp = F.coalesce("v", "doc_id").alias("comp")
    many = shared.filter("members > 2").join(labels, F.col("doc_id") == F.col("u"), "left").select("band", "key", "doc_id", comp, "n")
    many = staged(many, "members")
    sides = many.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("own"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"))
    opened = sides.groupBy("band", "key").agg(F.max(F.struct("own", "comp"))["comp"].alias("main"), F.sum("own").alias("members"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    # buckets of the same members are compared once
    opened = opened.groupBy("members", "s", "x").agg(F.min(F.struct("band", "key")).alias("b"), F.first("main").alias("main")).select("b.band", "b.key", "main")
    blocks = open_blocks(many.join(opened, ["band", "key"]), threshold)
    joined = blocks.join(sets, "doc_id").groupBy("band", "key", "i", "j").applyInPandas(_opened(threshold), "u long, v long")
    links = staged(starred.union(joined), "links")
    labels = components(links)

    final = classes.select("set_id", "doc_id").join(labels, F.col("doc_id") == F.col("u"), "left").select("set_id", F.coalesce("v", "doc_id").alias("component"))
    for done in (shared, near, wanted, sets, starred, many, links):
        discard(done)
    out = signed.join(final, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs whose document is the least of its component, all columns kept."""
    gone = free_name(docs, "gone")
    copies = near_duplicates(docs, k, threshold).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")
