"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, turn after turn:

    ### role\\n text \\n</turn>\\n

(without the blanks). In roles and texts a backslash goes before each backslash,
each #, the / of each </ and the | of each <|, so that neither a mark nor a
control string of the vocabulary can stand in a text; a line end in a role is
written \\n. Taking the backslashes away gives the text again.

The whole rendering is encoded once, with offsets. The spans of assistant texts
and the spans of tokens are both sorted; where they meet is found by binary
search. A token that also covers a mark belongs to the mask with the characters
that it has of the text only.

Odd input: null roles and texts are empty; rows of equal turn follow each other
by role and text, null turns come last; rows without conv_id are one
conversation; an empty table gives an empty result; other columns are ignored.
A conversation is rendered in one task, since it is encoded as a whole; rows come
to it sorted, in small batches, and only its text is held.
"""

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import vocabulary_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
HEAD, CLOSE = "### ", "\n</turn>\n"
ASSISTANT = "assistant"

_CONTROL = re.compile(r"[\\#]|(?<=<)[/|]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\n])*)\n(.*?)\n</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns and the spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role).replace('\n', '\\n')}\n", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    return [(_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask(offsets: np.ndarray, spans: np.ndarray) -> list[tuple[int, int, int, int]]:
    """For each span: its first token, the one after its last, and its own begin and end."""
    if not len(spans):
        return []
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.maximum(np.searchsorted(offsets[:, 0], spans[:, 1], "left"), first)
    return [tuple(int(x) for x in row) for row in zip(first, last, spans[:, 0], spans[:, 1])]


_libraries: dict = {}


def _library(path: str):
    from tokenizers import Tokenizer

    if path not in _libraries:
        _libraries[path] = Tokenizer.from_file(path)
    return _libraries[path]


FORMATTED = "conv_id long, formatted string, ids binary, mask array<struct<first: long, last: long, begin: long, end: long>>, offsets binary"


def _format(path: str):
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "begin", "end")])), pa.binary())

    def done(conv: int | None, turns: list[tuple[str, str]]) -> pa.RecordBatch:
        formatted, spans = render(turns)
        encoded = _library(path).encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets, "<i8").reshape(-1, 2)
        found = [dict(zip(("first", "last", "begin", "end"), m)) for m in mask(offsets, np.array(spans, np.int64).reshape(-1, 2))]
        row = (conv, formatted, np.array(encoded.ids, "<u4").tobytes(), found, offsets.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["conv_id", "formatted", "ids", "mask", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, started = None, [], False
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if started and conv != now:
                    yield done(now, turns)
                    turns = []
                now, started = conv, True
                turns.append((role or "", text or ""))
        if started:
            yield done(now, turns)

    return run


def format_conversations(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row for each conversation of rows(conv_id, turn, role, text): its rendering, token ids, their offsets and the loss mask.

    ids: unsigned 32-bit, offsets: pairs of signed 64-bit, both little-endian.
    mask: for each assistant text its tokens [first, last) and characters [begin, end).
    """
    small_batches(rows.sparkSession)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    turns = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(_format(vocabulary or vocabulary_path()), FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        rows = []
        for conv, formatted, ids, found, raw in zip(*(c.to_pylist() for c in batch.columns)):
            turns = parse(formatted)
            offsets = np.frombuffer(raw, "<i8").reshape(-1, 2)
            loss = []
            for m in found:
                tokens = offsets[m["first"] : m["last"]]
                # the characters of the masked tokens that lie in the text
                begin, end = (max(int(tokens[0, 0]), m["begin"]), min(int(tokens[-1, 1]), m["end"])) if len(tokens) else (0, 0)
                loss.append(unescape(formatted[begin:end]))
            text = "".join(loss)
            digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
            rows.append((conv, len(turns), digest, len(text), hashlib.sha256(text.encode()).hexdigest(), len(formatted), len(ids) // 4))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What can be read from format_conversations' output: turns, loss text, sizes."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
