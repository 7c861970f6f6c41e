"""Token ids in binary files: canonical length-limited Huffman code from global counts, blocks with bit-offset checkpoints.

File format. A folder holds Parquet files whose rows are segments: `part` (number
of the range of documents), `segment` (its place there), `documents` (how many
documents it holds), `tokens` and `payload`. A payload is, all little-endian:

    4 bytes   b"LHC1"
    uint32    number of tokens, n
    uint32    number of documents, d
    uint32    tokens in a block, BLOCK
    d x int64 document ids, d x uint8 1 where the id is null, d x uint32 tokens of each document
    uint64 x ceil(n / BLOCK)  checkpoints: the bit at which each block begins
    bytes     the code words, most significant bit first, and 3 bytes of padding

The code book is one row (`symbols`, `lengths`) in a folder beside it; code words
follow from the lengths (canonical). Each block is decoded from its checkpoint
alone; a segment's blocks are decoded side by side, one symbol of each at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, small_batches, staged
from .tokens import END, encoder, vocabulary_path

#: Longest code word; 2 ** LIMIT must be at least the number of symbols. The decoding table has 2 ** LIMIT entries.
LIMIT = 16
BLOCK = 512
#: Tokens after which a segment ends at the next document.
SEGMENT = 1 << 19


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths under the limit for positive counts in ascending order (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need code words of more than {limit} bits")
    leaf_rows, weights = [], counts.astype(np.float64)
    for _ in range(limit - 1):
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([counts.astype(np.float64), packages])
        order = np.argsort(merged, kind="stable")
        leaf_rows.append(order < n)
        weights = merged[order]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaves in reversed(leaf_rows):
        chosen = int(leaves[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[:take] += 1
    return lengths


def code_words(symbols: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code words and their lengths, indexed by symbol."""
    words, sizes = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
    order = np.lexsort((symbols, lengths))
    word = last = 0
    for s, n in zip(symbols[order].tolist(), lengths[order].tolist()):
        word <<= n - last
        words[s], sizes[s], last = word, n, n
        word += 1
    return words, sizes


def pack(ids: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of some ids, and the bit at which every block begins."""
    lengths = sizes[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.zeros(int(ends[-1] + 7) // 8 + 3 if len(ids) else 3, np.int64)
    if len(ids):
        byte = starts >> 3
        placed = words[ids].astype(np.int64) << (24 - (starts & 7) - lengths)
        first = np.flatnonzero(np.diff(byte, prepend=-1))
        sums, at = np.add.reduceat(placed, first), byte[first]  # code words do not overlap, so a sum joins them
        for shift in (16, 8, 0):
            out[at + (2 - shift // 8)] += sums >> shift & 255
    return out.astype(np.uint8).tobytes(), starts[::BLOCK].astype("<u8")


def decoding_table(symbols: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For every LIMIT-bit window: symbol * 32 + length of the code word that it begins with."""
    words, sizes = code_words(symbols, lengths, size)
    table = np.zeros(1 << LIMIT, np.int64)
    order = np.lexsort((symbols, lengths))
    entry = symbols[order].astype(np.int64) * 32 + lengths[order]
    filled = np.repeat(entry, 1 << (LIMIT - lengths[order].astype(np.int64)))
    table[: len(filled)] = filled
    return table


def unpack(stream: np.ndarray, checkpoints: np.ndarray, n: int, table: np.ndarray, block: int) -> np.ndarray:
    """The ids of a segment, all blocks side by side."""
    if not n:
        return np.zeros(0, "<u4")
    s = stream.astype(np.int64)
    window = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((block, len(at)), "<u4")
    top, mask = len(window) - 1, (1 << LIMIT) - 1
    for step in range(min(block, n)):
        entry = table[window[np.minimum(at >> 3, top)] >> (24 - LIMIT - (at & 7)) & mask]
        out[step] = entry >> 5
        at += entry & 31
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


# --- the operator ----------------------------------------------------------


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = [np.append(x, np.uint32(END)) for x in encoder(path).encode(batch.column(1))]
            packed = [squeeze(x.astype("<u2" if x.max() < 65536 else "<u4").tobytes()) for x in ids]
            wide = [bool(x.max() >= 65536) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(wide), pa.array(packed, pa.binary())], names=["doc_id", "tie", "wide", "ids"])

    return run


def _ids(wide: pa.Array, packed: pa.Array) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(expand(x.as_buffer()), "<u4" if w.as_py() else "<u2").astype("<u4") for w, x in zip(wide, packed)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            now = np.bincount(np.concatenate(_ids(*batch.columns)))
            if len(now) > len(total):
                now, total = total, now.astype(np.int64)
            total[: len(now)] += now
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _write(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, lengths = book.value
        words, sizes = code_words(symbols, lengths, int(symbols.max(initial=0)) + 1)
        part, segment = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        texts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(texts)
            stream, checkpoints = pack(ids, words, sizes)
            head = b"LHC1" + np.array([len(ids), len(docs), BLOCK], "<u4").tobytes()
            head += np.array([x or 0 for x in docs], "<i8").tobytes() + np.array([x is None for x in docs], "u1").tobytes() + np.array([len(x) for x in texts], "<u4").tobytes()
            row = [part, segment, len(docs), len(ids), head + checkpoints.tobytes() + stream]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "segment", "documents", "tokens", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1), batch.column(2))):
                docs.append(doc)
                texts.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield flush()
                    docs, texts, size, segment = [], [], 0, segment + 1
        if docs:
            yield flush()

    return run


def read_payload(payload: bytes | memoryview, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are null, tokens of each document, and all token ids of a segment."""
    raw = np.frombuffer(payload, np.uint8)
    if raw[:4].tobytes() != b"LHC1":
        raise ValueError("not a segment of token ids")
    n, d, block = (int(x) for x in raw[4:16].view("<u4"))
    at = 16
    docs = raw[at : at + 8 * d].copy().view("<i8")
    at += 8 * d
    null = raw[at : at + d].astype(bool)
    at += d
    sizes = raw[at : at + 4 * d].copy().view("<u4")
    at += 4 * d
    blocks = -(-n // block)
    checkpoints = raw[at : at + 8 * blocks].copy().view("<u8")
    return docs, null, sizes, unpack(raw[at + 8 * blocks :], checkpoints, n, table, block)


def _read(book, bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, lengths = book.value
        table = decoding_table(symbols, lengths, int(symbols.max(initial=0)) + 1)
        for batch in batches:
            for part, segment, payload in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns))):
                docs, null, sizes, ids = read_payload(payload.as_buffer(), table)
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                start = at[:-1] + bases.value[part, segment]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(start, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> str:
    """Encode docs(doc_id, text) in ascending doc_id order into token files under path (nulls first; null text: empty).

    Rows of equal doc_id follow each other in the order of a hash of their text.
    An empty table gives an empty folder. Texts are not shuffled, only their
    compressed ids. The collected counts have at most one row for each id of the
    vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or vocabulary_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = staged(texts.withColumn("tie", F.xxhash64("text")).mapInArrow(_encode(vocabulary), "doc_id long, tie long, wide boolean, ids binary"), "ids")
    counts = ids.select("wide", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"])
    symbols = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64)) if len(counts) else np.zeros(0, np.uint8)
    spark.createDataFrame([(bytearray(symbols.astype("<u4").tobytes()), bytearray(lengths.tobytes()))], "symbols binary, lengths binary").coalesce(1).write.parquet(f"{path}/book")
    book = spark.sparkContext.broadcast((symbols, lengths))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.select("doc_id", "wide", "ids").mapInArrow(_write(book), "part int, segment int, documents long, tokens long, payload binary").write.parquet(f"{path}/segments")
    discard(ids)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    The driver adds up the tokens of the segments before each one: one number for
    every SEGMENT tokens, 8 MB for a million million tokens.
    """
    book = spark.read.parquet(f"{path}/book").first()
    symbols, lengths = np.frombuffer(book.symbols, "<u4").astype(np.int64), np.frombuffer(book.lengths, np.uint8)
    segments = spark.read.schema("part int, segment int, documents long, tokens long, payload binary").parquet(f"{path}/segments")
    sizes = segments.select("part", "segment", "tokens").toPandas().sort_values(["part", "segment"])
    before = sizes["tokens"].cumsum() - sizes["tokens"]
    bases = spark.sparkContext.broadcast(dict(zip(zip(sizes["part"].tolist(), sizes["segment"].tolist()), before.tolist())))
    return segments.select("part", "segment", "payload").mapInArrow(_read(spark.sparkContext.broadcast((symbols, lengths)), bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' ids as token files into the shared folder and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, new_path(spark, "tokens"), vocabulary))
