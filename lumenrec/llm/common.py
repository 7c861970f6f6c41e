"""What several text operators share: the shared folder, staged tables, Arrow text access, word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handed to Python at once; with documents of some kB a batch stays at a few MB.
ARROW_ROWS = 512
#: Bytes hashed at once; numpy holds about 50 bytes for each of them meanwhile.
PIECE = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without it gets one of its own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        master = conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.get("LUMENREC_SHARED") or os.environ.setdefault("LUMENREC_SHARED", tempfile.mkdtemp(prefix="lumenrec-"))
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenrec/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives the loss of executors.

    Shuffled rows are written in files of the advisory size, not in one for each
    core: small tables make few files, and so few calls to the file system.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenrec_path = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def discard(df: DataFrame) -> None:
    """Remove a staged table that no later read needs."""
    remove(df.sparkSession, df._lumenrec_path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts fit into a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, ARROW_ROWS + 1):
        spark.conf.set(key, ARROW_ROWS)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


# --- hashes of words -------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        steps = np.full(size, _BASE if kind == "up" else _INV, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def table_of(separators: bytes | set[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the value of each byte, A-Z as a-z if wanted."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    value = _BYTE.copy()
    if lower:
        value[65:91] = _BYTE[97:123]
    return inside, value


def word_hashes(data: np.ndarray, inside: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words in some bytes."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    is_word = np.empty(len(data) + 2, np.int8)
    is_word[0] = is_word[-1] = 0
    is_word[1:-1] = inside[data]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edge[::2], edge[1::2]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value[data] * _power("up", len(data))[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(data))[starts]), starts, ends


def documents_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text's number, their word hashes in a row, and where each text's words begin.

    Texts go through in pieces of about PIECE bytes; longer ones are cut between words.
    """
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        if last == first + 1 and high - low > 2 * PIECE:
            parts = []
            while low < high:
                cut = min(low + PIECE, high)
                while cut < high and inside[data[cut]]:
                    cut += 1
                parts.append(word_hashes(data[low:cut], inside, value)[0])
                low = cut
            hashes = np.concatenate(parts)
            yield first, hashes, np.array([0, len(hashes)])
        else:
            # one separator after each text keeps the words of neighbours apart
            lengths = np.diff(offsets[first : last + 1])
            padded = np.full(high - low + len(lengths), 32, np.uint8)
            padded[np.arange(high - low) + np.repeat(np.arange(len(lengths)), lengths)] = data[low:high]
            hashes, starts, _ = word_hashes(padded, inside, value)
            begin = offsets[first : last + 1] - low + np.arange(len(lengths) + 1)
            yield first, hashes, np.searchsorted(starts, begin)
        first = last
