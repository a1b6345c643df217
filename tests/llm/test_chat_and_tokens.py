"""Chat formatting and token counts against the plain tokenizer."""

import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import CLASHING, prose

from meridian.llm import chat as ch
from meridian.llm import token_counts as tc

with open(tc.VOCABULARY, "rb") as _file:
    VOCABULARY = _file.read()


@pytest.fixture(scope="module")
def encoding():
    return tc.encoding_of(VOCABULARY)


TRICKY = ["", "plain text", "<|start|>user", "a <|end|> b", "<|\\end|> kept", "<|\\\\end|>", "<|endoftext|>", "emoji 😀 漢字 é", "<|x|><|y|>", " \n\t ", "<| end |>"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>end start_a \n", max_size=40))
def test_escaping_is_undone(text):
    assert ch.unescape(ch.escape(text)) == text
    assert "<|start|>" not in ch.escape(text) and "<|end|>" not in ch.escape(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>n\nend a", max_size=30))
def test_escaping_of_roles_is_undone(role):
    assert ch.unescape_role(ch.escape_role(role)) == role and "\n" not in ch.escape_role(role)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_round_trip_and_mask(spark, encoding):
    rows = [(c, k, "assistant" if k % 2 else "user", TRICKY[(c + k) % len(TRICKY)]) for c in range(12) for k in range(c % 5 + 1)]
    got = {r["conv_id"]: r for r in ch.format_chats(conversations(spark, rows)).collect()}
    start, end = encoding.n_vocab, encoding.n_vocab + 1
    for c in range(12):
        want = [(r, t) for cc, _, r, t in rows if cc == c]
        ids, mask = got[c]["ids"], got[c]["mask"]
        assert ch.decode_chat(ids, VOCABULARY) == want
        assert ids.count(start) == ids.count(end) == len(want) == got[c]["n_turns"]
        at, trained = 0, []
        for role, text in want:
            head = 1 + len(encoding.encode_ordinary(role)) + 1
            body = len(encoding.encode_ordinary(ch.escape(text)))
            trained += [0] * head + [int(role == "assistant")] * (body + 1) + [0]
            at += head + body + 2
        assert mask == trained and len(ids) == at and got[c]["n_trained"] == sum(trained)


def test_awkward_conversations(spark):
    long = prose(1, 20_000)
    rows = [(1, 2, "assistant", "b"), (1, None, None, "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (None, 1, "user", "x"), (None, 2, "user", None), (2, 1, "user", long), (3, 1, "assistant", "")]
    df = conversations(spark, rows)
    from pyspark.sql import functions as F

    for name, value in CLASHING.items():
        df = df.withColumn(name, F.expr(value))
    got = {r["conv_id"]: ch.decode_chat(r["ids"], VOCABULARY) for r in ch.format_chats(df).collect()}
    assert got[1] == [("user", "a"), ("assistant", "a"), ("assistant", "b")]
    assert got[None] == [("user", "x"), ("user", "")] and got[2] == [("user", long)] and got[3] == [("assistant", "")]
    assert ch.format_chats(df.where("false")).count() == 0


@pytest.mark.parametrize("limit", [ch.BROADCAST_LONG, 0])
def test_long_conversations_come_in_parts(spark, monkeypatch, limit):
    """One conversation, and the null one, hold most rows; their parts in order are the whole."""
    monkeypatch.setattr(ch, "PART", 4)
    monkeypatch.setattr(ch, "BROADCAST_LONG", limit)
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, None, None, 2, 3]), rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), rng.choice(["assistant", None, "a\nb", "x\\n"]), rng.choice(TRICKY)) for _ in range(120)] + [(4, 1, "user", "only")]
    got = {}
    for r in sorted(ch.format_chats(conversations(spark, rows)).collect(), key=lambda r: (str(r["conv_id"]), r["part"])):
        assert r["n_turns"] <= 4 and len(r["ids"]) == len(r["mask"]) and r["part"] == len(got.setdefault(r["conv_id"], []))
        got[r["conv_id"]].append(ch.decode_chat(r["ids"], VOCABULARY))
    for c in {r[0] for r in rows}:
        want = sorted({(t is not None, t or 0, r or "user", x) for cc, t, r, x in rows if cc == c})
        assert [t for part in got[c] for t in part] == [x[2:] for x in want]
        assert all(len(p) == 4 for p in got[c][:-1])


def test_whole_table_of_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r["conv_id"]: ch.decode_chat(r["ids"], VOCABULARY) for r in ch.format_chats(df).collect()}
    want = {}
    for r in df.orderBy("conv_id", "turn").dropDuplicates().orderBy("conv_id", "turn", "role", "text").collect():
        want.setdefault(r["conv_id"], []).append((r["role"] or "user", r["text"] or ""))
    assert got == want


@pytest.mark.parametrize(("table", "cache", "counted"), [(tc.TABLE, tc.CACHE, tc.COUNTED), (3, 2, 4), (0, 1, 1)])
def test_counts_equal_the_tokenizer(docs_of, encoding, monkeypatch, table, cache, counted):
    monkeypatch.setattr(tc, "CACHE", cache)
    monkeypatch.setattr(tc, "COUNTED", counted)
    rng = random.Random(3)
    texts = [*TRICKY, "x" * 5000, "don't they'll we've 12345  spaces   ", "word " * 3000] + ["".join(rng.choice("aé漢 1.\n'") for _ in range(60)) for _ in range(40)]
    got = {r["doc_id"]: (r["n_tokens"], r["n_pre_tokens"]) for r in tc.token_counts(docs_of(list(enumerate(texts))), table=table).collect()}
    split = regex.compile(tc.PATTERN).findall
    assert got == {i: (len(encoding.encode_ordinary(t)), len(split(t))) for i, t in enumerate(texts)}


def test_table_packs_and_unpacks():
    lengths = {" a": 1, "é漢": 7, "": 0}
    assert tc.unpack(tc.pack(lengths)) == lengths and tc.unpack(tc.pack({})) == {}


def test_awkward_documents(docs_of, awkward, encoding):
    got = [(r["doc_id"], r["n_tokens"]) for r in tc.token_counts(docs_of(awkward, **CLASHING)).collect()]
    want = [(i, len(encoding.encode_ordinary(t or ""))) for i, t in awkward]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert tc.token_counts(docs_of([(1, "a")]).where("false")).count() == 0
