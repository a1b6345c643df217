"""Chat formatting at token level.

A turn becomes <|start|> role \\n content <|end|> \\n, where the two marks are
reserved ids beyond the vocabulary.  Role and content are encoded apart from
each other and from the marks, and their ids are spliced in, so no content can
produce a reserved id.  A control string that occurs in content is escaped with
a backslash after its opening, which ``unescape`` takes away again.  The loss
mask is a prefix sum over the ends of the trained spans.

A conversation of more than ``PART`` turns comes in parts of so many, so that no
task has to hold it.  Turns are formatted each by itself, so its parts in their
order, put together, are what the whole would be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.text import type_of
from meridian.llm.token_counts import VOCABULARY, encoding_of
from meridian.plans.materialize import materialize
from meridian.plans.numbering import numbered

START, END = "<|start|>", "<|end|>"
TRAINED = "assistant"
#: Turns of one row, at most.
PART = 1024
#: Long conversations whose ids are sent to every executor, at most.
BROADCAST_LONG = 100_000
_CONTROL = re.compile(r"<\|(\\*(?:start|end|[A-Za-z0-9_]{1,64})\|>)")
_ESCAPED = re.compile(r"<\|\\(\\*[A-Za-z0-9_]{1,64}\|>)")


def escape(text: str) -> str:
    """Put a backslash into every control string <|name|>, and one more into every escaped one."""
    return _CONTROL.sub(r"<|\\\1", text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _ESCAPED.sub(r"<|\1", text)


def escape_role(role: str) -> str:
    """escape() for a role, which ends at the first line break, so that it has none."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """The inverse of escape_role()."""
    return re.sub(r"\\([n\\])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def assemble(segments: list[tuple[list[int], list[int], bool]], start: int, end: int, newline: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of (role ids, content ids, trained) segments.

    Trained are a trained turn's content and its end mark.
    """
    parts, edges, n = [], [], 0
    for role, content, trained in segments:
        parts += [[start], role, newline, content, [end], newline]
        if trained:
            low = n + 1 + len(role) + len(newline)
            edges += [(low, 1), (low + len(content) + 1, -1)]
        n += 2 + len(role) + 2 * len(newline) + len(content)
    steps = np.zeros(n + 1, np.int8)
    for at, by in edges:
        steps[at] += by
    return np.fromiter((i for p in parts for i in p), np.int32, n), np.cumsum(steps[:n], dtype=np.int8)


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary_path: str = VOCABULARY, trained: str = TRAINED) -> DataFrame:
    """(conv_id, part, n_turns, ids, mask, n_trained), one row for each ``PART`` turns of each conversation, parts from 0.

    Turns go by number, null numbers first; equal numbers by role and text.
    Exactly repeated rows count once.  Ids can be of any type.  Nulls: a null
    role is ``user``, a null text is empty; rows with a null conv_id are one
    conversation.  An empty text is a turn without content.  Very long texts are
    encoded whole.  Roles can be any text; their backslashes and line breaks are
    escaped.  An empty table gives no rows.  Other columns are not read.
    """
    with open(vocabulary_path, "rb") as file:
        vocabulary = conversations.sparkSession.sparkContext.broadcast(file.read())  # bounded by the tokenizer
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > PART).select(F.col("conv_id").alias("own")), "long")
    many = long.count()
    held = F.broadcast(long) if many <= BROADCAST_LONG else long
    is_long = lambda df, other: df["conv_id"].eqNullSafe(other["own"])
    parts = (turns.join(held, is_long(turns, held), "left_anti") if many else turns).withColumn("part", F.lit(0))
    if many:
        order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
        placed = materialize(numbered(turns.join(held, is_long(turns, held), "left_semi").distinct(), *order), "placed")
        first = placed.groupBy(F.col("conv_id").alias("own")).agg(F.min("position").alias("first"))
        first = F.broadcast(first) if many <= BROADCAST_LONG else first
        parts = parts.unionByName(placed.join(first, is_long(placed, first)).select(*turns.columns, F.expr(f"cast((position - first) div {PART} as int)").alias("part")))
    grouped = parts.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(vocabulary.value)
        start, end = encoding.n_vocab, encoding.n_vocab + 1
        newline, roles = encoding.encode_ordinary("\n"), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for chat in part.column(2).to_pylist():
                    texts = encoding.encode_ordinary_batch([escape(t["text"]) for t in chat], num_threads=1)
                    for t in chat:
                        if t["role"] not in roles:
                            roles = {} if len(roles) > 1000 else roles
                            roles[t["role"]] = encoding.encode_ordinary(escape_role(t["role"]))
                    segments = [(roles.get(t["role"]) or encoding.encode_ordinary(escape_role(t["role"])), ids, t["role"] == trained) for t, ids in zip(chat, texts)]
                    out.append((len(chat), *assemble(segments, start, end, newline)))
                arrays = [*part.columns[:2], pa.array([n for n, _, _ in out], pa.int32()), pa.array([i for _, i, _ in out], pa.list_(pa.int32())), pa.array([m for _, _, m in out], pa.list_(pa.int8())), pa.array([int(m.sum()) for _, _, m in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "n_turns", "ids", "mask", "n_trained"])

    return grouped.mapInArrow(encode, f"conv_id {type_of(turns, 'conv_id')}, part int, n_turns int, ids array<int>, mask array<tinyint>, n_trained long")


def decode_chat(ids: list[int], vocabulary: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted ids: the inverse of the formatting."""
    encoding = encoding_of(vocabulary)
    start, end = encoding.n_vocab, encoding.n_vocab + 1
    turns, ids = [], list(ids)
    while ids:
        stop = ids.index(end)
        role, _, text = encoding.decode(ids[1:stop]).partition("\n")
        assert ids[0] == start
        turns.append((unescape_role(role), unescape(text)))
        ids = ids[stop + 2 :]
    return turns
