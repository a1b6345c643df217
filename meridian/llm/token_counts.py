"""Token counts by a map-side two-tier lookup of pre-token lengths.

A byte-level BPE encodes each pre-token (a match of the tokenizer's pattern) by
itself, so a text has as many tokens as its pre-tokens add up to.  The first
pass keeps each partition's most frequent pre-tokens; their counts are summed,
and the lengths of the most frequent overall are encoded once and sent to every
worker as a compact table.  The second pass looks each pre-token up there, then
in the worker's own cache of what it has encoded.  No pre-token is shuffled:
what moves is one bounded summary for each partition.  The table saves time
only; a count never depends on it.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.text import texts_of

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in the table that every worker gets.
TABLE = 65_536
#: Pre-tokens in a partition's summary, and those counted before the rare half is dropped.
SUMMARY, COUNTED = 8_192, 300_000
#: Entries of a worker's cache before it starts afresh.
CACHE = 300_000
#: Longest pre-token in characters that is remembered; longer ones are encoded each time.
LONGEST = 64


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def encoding_of(vocabulary: bytes, pattern: str = PATTERN, specials: dict[str, int] | None = None) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(vocabulary), special_tokens=specials or {})


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The table as three runs of bytes: texts, their ends, their token counts (at most 255)."""
    texts = [t.encode() for t in lengths]
    return b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.uint32).tobytes(), bytes(lengths.values())


def unpack(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    ends = np.frombuffer(table[1], np.uint32).tolist()
    return {table[0][a:b].decode(): n for a, b, n in zip([0, *ends], ends, table[2])}


class Lengths(dict):
    """Token counts of pre-tokens: the sent table is the first tier, this cache the second, encoding the last."""

    def __init__(self, table: dict[str, int], encoding: tiktoken.Encoding):
        super().__init__(table)
        self.table, self.encoding = table, encoding

    def __missing__(self, pre_token: str) -> int:
        n = len(self.encoding.encode_ordinary(pre_token))
        if len(pre_token) <= LONGEST:
            if len(self) >= len(self.table) + CACHE:
                self.clear()
                self.update(self.table)
            self[pre_token] = n
        return n


def _frequent(texts: DataFrame, pattern: str, size: int) -> list[str]:
    """The most frequent pre-tokens of all texts, by the partitions' summaries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                total.update(split(text))
                if len(total) > COUNTED:
                    total = Counter(dict(total.most_common(COUNTED // 2)))
        top = [(t, n) for t, n in total.most_common(SUMMARY) if len(t) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pre_token", "n"])

    summed = texts.mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return [r["pre_token"] for r in summed.orderBy(F.desc("n"), "pre_token").limit(size).collect()]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY, pattern: str = PATTERN, table: int = TABLE) -> DataFrame:
    """(doc_id, n_tokens, n_pre_tokens), one row for each row of ``docs``.

    The strings of special tokens count as ordinary text.  Nulls: a null text
    has 0 tokens, as an empty one; null ids are kept.  Very long texts are
    counted whole.  Repeated rows are counted each; ties in frequency only
    decide what the table holds.  An empty table gives no rows.  Other columns
    are not read.
    """
    with open(vocabulary_path, "rb") as file:
        vocabulary = file.read()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    encoding = encoding_of(vocabulary, pattern)
    frequent = _frequent(named.select("text").where("length(text) > 0"), pattern, table)
    lengths = {t: n for t, n in zip(frequent, map(len, encoding.encode_ordinary_batch(frequent))) if n <= 255}
    context = docs.sparkSession.sparkContext
    # both are bounded: the table by its parameters, the vocabulary by the tokenizer
    sent, ranks = context.broadcast(pack(lengths)), context.broadcast(vocabulary)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern).findall, Lengths(unpack(sent.value), encoding_of(ranks.value, pattern))
        for batch in batches:
            tokens, parts = [], []
            for text in texts_of(batch.column(1)):
                found = split(text) if text else ()
                tokens.append(sum(map(known.__getitem__, found)))
                parts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(parts, pa.int64())], ["doc_id", "n_tokens", "n_pre_tokens"])

    return named.mapInArrow(measure, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pre_tokens long")
