"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: lines with their ends, long ones cut at sentence ends and,
where a sentence is long too, after words whose hash says so. A section is a run
of leaves that ends where a leaf's hash is a multiple of SECTION; its digest is
that of its leaves' digests, and the root's that of the sections'. All cuts
depend on the text around them only, so an edit changes the leaves it touches,
their sections and the root, and nothing else.

A fingerprint is a string: the root, then for each section `;`, its digest and
for each of its leaves `,`, its digest and, in base 36, its code points. Equal
texts have equal fingerprints. Two fingerprints are compared from the root down:
equal roots or sections need no look inside, differing ones lead to the leaves.
Their likeness is the share of code points in leaves that both have.
"""

import base64
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SECTION = 8
LONG = 80

_LINES = re.compile(r"[^\n]*\n|[^\n]+").findall
_SENTENCES = re.compile(r"(?:[^.!?]|[.!?](?!\s))*[.!?]*\s*").findall
_WORDS = re.compile(r"\s*\S+\s*|\s+").findall
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def leaves(text: str) -> list[str]:
    """The paragraphs of a text; joined they give it again."""
    out = []
    for line in _LINES(text):
        if len(line) <= LONG:
            out.append(line)
            continue
        for sentence in _SENTENCES(line):
            if len(sentence) <= LONG:
                if sentence:
                    out.append(sentence)
                continue
            begin = at = 0
            for word in _WORDS(sentence):
                at += len(word)
                if crc32(word.encode()) & 7 == 0:
                    out.append(sentence[begin:at])
                    begin = at
            if begin < at:
                out.append(sentence[begin:at])
    return out


def _base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = _DIGITS[r] + out
        if not n:
            return out


def _short(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest[:6]).decode()


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def fingerprint(text: str | None) -> str:
    """The tree of a text as a string; null counts as empty.

    Digests have 128 bits, each over those below it, so the root stands for the whole text; the string shows of
    leaves and sections the first 48 bits.
    """
    sections: list[bytes] = []
    body, run, below = [], [], []

    def close() -> None:
        sections.append(_digest(b"".join(below)))
        body.append(f";{_short(sections[-1])}{''.join(run)}")
        run.clear()
        below.clear()

    for leaf in leaves(text or ""):
        raw = _digest(leaf.encode())
        run.append(f",{_short(raw)}{_base36(len(leaf))}")
        below.append(raw)
        if raw[0] % SECTION == 0:
            close()
    if run:
        close()
    return _digest(b"".join(sections)).hex() + "".join(body)


def _tree(mark: str) -> dict[str, list[tuple[str, int]]]:
    """Leaves of each differing section; a repeated section is numbered."""
    out: dict[str, list[tuple[str, int]]] = {}
    for section in mark[33:].split(";") if len(mark) > 33 else []:
        name, *parts = section.split(",")
        k, n = name, 1
        while k in out:
            n += 1
            k = f"{name}#{n}"
        out[k] = [(p[:8], int(p[8:], 36)) for p in parts]
    return out


def likeness(a: str, b: str) -> float:
    """Share of code points in leaves that both fingerprints have, 0 to 1."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = _tree(a), _tree(b)
    size = sum(n for t in (x, y) for s in t.values() for _, n in s)
    both = sum(n for name in x.keys() & y.keys() for _, n in x[name])
    left = Counter(p for name in x.keys() - y.keys() for p in x[name])
    right = Counter(p for name in y.keys() - x.keys() for p in y[name])
    both += sum(n * k for (_, n), k in (left & right).items())
    return 2 * both / size if size else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(begin, end) code points of a's leaves that b has not, found down the branches that differ."""
    if a[:32] == b[:32]:
        return []
    x, y = _tree(a), _tree(b)
    spare = Counter(p for name in y.keys() - x.keys() for p in y[name])
    out, at = [], 0
    for name, section in x.items():
        for p in section:
            if name not in y:
                if spare[p] > 0:
                    spare[p] -= 1
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + p[1])
                else:
                    out.append((at, at + p[1]))
            at += p[1]
    return out


# --- every document against an edited one and against the next one -----------

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, look, doc_id, text) in order; the rows with look = 1 end a part and are only looked at."""
    rows: list[tuple] = []
    last = None  # (part, doc_id, text, fingerprint) that waits for the one after it

    def settle(text: str, mark: str) -> None:
        _, doc, own, own_mark = last
        k = len(own) // 3
        edited = own[: len(own) - k] + text[:k]
        edited_mark = fingerprint(edited)
        rows.append((doc, len(own), sha256(edited.encode()).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        rows.clear()
        return out

    for batch in batches:
        for part, look, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            if look and (last is None or last[0] != part):
                continue  # a further row of the document looked at
            mark = fingerprint(text)
            if last is not None:
                settle(text, mark)
            last = None if look else (part, doc, text, mark)
        yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text): fingerprints of its text and of its edited text, and their likeness.

    The edited text has its last third replaced by the first code points of the
    next document in descending doc_id order; after the last comes the first.
    Rows of equal doc_id follow each other by a hash of their text, null ids come
    last, equal rows are next to each other; a null text is empty; a single row is its own next; an empty table
    gives an empty result; other columns are ignored.

    Documents are dealt into ranges of doc_id and text hash, and the first document
    of each range is dealt to the range before it as well, where it is looked at
    only; so texts are shuffled once. The driver sees the begins of the ranges only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ascending order of these is descending doc_id, null last, then the text's hash
    keys = rows.select(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), "tie")
    begins = keys.repartitionByRange(4 * tasks, "none", "down", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "down", "tie")).alias("k")).select("k.*").collect()
    begins = sorted(tuple(b) for b in begins)
    own = [(np.array([b[1] for b in begins if b[0] == none], np.int64), np.array([b[2] for b in begins if b[0] == none], np.int64)) for none in (False, True)]
    first_null = len(own[0][0])

    @F.arrow_udf("int")
    def part_of(none: pa.Array, down: pa.Array, tie: pa.Array) -> pa.Array:
        none, down, tie = (c.to_numpy(zero_copy_only=False) for c in (none, down, tie))
        part = np.zeros(len(none), np.int64)
        for kind in (False, True):
            mine = np.flatnonzero(none == kind)
            ids, ties = own[kind]
            low, high = np.searchsorted(ids, down[mine], "left"), np.searchsorted(ids, down[mine], "right")
            for i in np.flatnonzero(high > low):  # a document with rows in several ranges
                low[i] += np.searchsorted(ties[low[i] : high[i]], tie[mine[i]], "right")
            part[mine] = low - 1 + (first_null if kind else 0)
        return pa.array(part, pa.int32())

    dealt = rows.withColumn("none", F.col("doc_id").isNull()).withColumn("down", F.bitwise_not(F.coalesce("doc_id", F.lit(0)))).withColumn("part", part_of("none", "down", "tie"))
    heads = spark.createDataFrame([(*b, True) for b in begins], "none boolean, down long, tie long, first boolean")
    dealt = dealt.join(F.broadcast(heads), ["none", "down", "tie"], "left")
    both = F.when(F.col("first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = dealt.select("part", "tie", "doc_id", "text", F.explode(both).alias("look"))
    dealt = dealt.withColumn("part", F.when(F.col("look") == 1, F.pmod(F.col("part") - 1, F.lit(max(len(begins), 1)))).otherwise(F.col("part")))
    dealt = dealt.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "look", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return dealt.select("part", "look", "doc_id", "text").mapInArrow(_walk, SCHEMA)
