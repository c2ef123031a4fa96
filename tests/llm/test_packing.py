"""Packing: token ids against the tokenizer, places against the constraints, counts against a lower bound."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
SCHEMA = "doc_id long, text string"


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.text(max_size=40),
            st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "don't", "'s", "'", "é", "ñandú", "12", "3.5", "!!", "漢字", " ", " ", "　", "\u0085", "x", "<|endoftext|>", "мир"]), max_size=20).map("".join),
        ),
        max_size=8,
    )
)
def test_ids_are_the_tokenizers(texts):
    own = tokens.encoder(PATH)
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in texts]


def test_memory_of_the_encoder_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    own = tokens.Encoder(PATH)
    for k in range(5):
        texts = [f"some words {k} and {i} more." for i in range(6)]
        ids, offsets = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(t) for t in texts]
        assert len(own.chunks[0]) <= 10 + 40 and len(own.pieces) <= 20 + 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.integers(1, 6), st.sampled_from([200, 400, 1024]), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(lengths, documents, attention, rule):
    lengths = np.array([n for n in lengths if n * n <= attention], dtype=np.int64)
    sequence, offset = packing.best_fit(lengths, (32, documents, attention), rule)
    for k in set(sequence.tolist()):
        own = np.flatnonzero(sequence == k)
        size = lengths[own][np.argsort(offset[own])]
        assert size.sum() <= 32 and len(own) <= documents and (size * size).sum() <= attention
        assert sorted(offset[own].tolist()) == (np.cumsum(size) - size).tolist()
    # no two sequences could be one: best fit opens a new one only where nothing has room
    if len(lengths):
        used = np.bincount(sequence, weights=lengths)
        count = np.bincount(sequence)
        cost = np.bincount(sequence, weights=lengths * lengths)
        for a in range(len(used)):
            for b in range(a):
                assert used[a] + used[b] > 32 or count[a] + count[b] > documents or cost[a] + cost[b] > attention


def test_an_oversized_piece_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([20]), (32, 4, 100))


def verified(spark, rows, length=64, **named):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("length", F.lit("x")).withColumn("ids", F.lit("x")).repartition(3)
    packed = packing.pack(df, PATH, length=length, **named)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = packed.withColumn("crc", F.crc32("ids")).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert r.crc == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length and len(own) <= named.get("documents", length) and sum(s * s for _, s in own) <= named.get("attention", length * length)
    return packed, pieces, places


TEXTS = ["", None, "one", "two words", "word " * 300, "é" * 50, "a b  c\n\nd " * 40, "x" * 1000] + [f"text number {i} " * (i % 9 + 1) for i in range(200)]


def test_documents_come_back_whole(spark):
    rows = list(enumerate(TEXTS))
    packed, pieces, places = verified(spark, rows)
    total = 0
    for i, text in rows:
        own = sorted(pieces[i], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == [*plain(text), 0]
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == (np.cumsum([r.length for r in own]) - [r.length for r in own]).tolist()
        assert all(r.length == 64 for r in own[1:])
        total += len(ids)
    assert len(places) <= -(-total // 64) + 2
    whole = packing.sequences(packed).collect()
    assert {r.sequence_id: r.length for r in whole} == {k: sum(s for _, s in v) for k, v in places.items()}
    assert all(len(r.ids) == 4 * r.length for r in whole)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_binds(spark, rule):
    rows = [(i, t) for i, t in enumerate(TEXTS) if len(plain(t)) < 30]
    verified(spark, rows, documents=3, attention=900, rule=rule)


def test_shards_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20)
    rows = list(enumerate(TEXTS))
    _, pieces, places = verified(spark, rows)
    total = sum(r.length for own in pieces.values() for r in own)
    assert len(places) <= -(-total // 64) * 1.05 + 1


def test_repeated_and_null_ids_and_empty_tables(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = [(1, "same"), (1, "same"), (None, "other"), (None, None)]
    _, pieces, _ = verified(spark, rows)
    assert len(pieces[1]) == 2 and len(pieces[None]) == 2


def test_one_length_in_a_third_of_the_rows(spark):
    rows = [(i, "same text here" if i % 3 else f"other {i} " * (i % 7)) for i in range(300)]
    _, pieces, places = verified(spark, rows)
    total = sum(r.length for own in pieces.values() for r in own)
    assert len(places) <= -(-total // 64) + 1
