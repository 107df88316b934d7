"""Packing: tokens of the tokenizer itself, every constraint, and few sequences."""

import math

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import packing
from lexmill.llm.packing import Limits, pack_group, pack_pieces, packed_sequences, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " \t\n ", "It's we'll DON'T 'tis", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> x",
    "Straße ΣΑΣ İstanbul ŉ ﬁ", "日本語 テスト　全角", "é é ́x a b c\x1cd", "x" * 5000,
    "12,345.67 ... !!! \x00 \x0b\x0c", "😀😀 👩‍👩‍👧 ok", "word " * 3000, "Same text", "Same text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(13, "Same text"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'x' AS piece", "1 AS length", "'y' AS ids", "2 AS sequence_id"
    )


def plain(text, capacity):
    known = Tokenizer.from_file(PATH)
    ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
    return [ids[i : i + capacity] for i in range(0, len(ids), capacity)]


def test_pieces_are_the_tokenizers(spark, docs):
    pieces = token_pieces(docs, PATH, capacity=700).collect()
    got = sorted(
        ((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in pieces), key=str
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = [
        (doc, k, 700 * k, ids) for doc, text in rows for k, ids in enumerate(plain(text, 700))
    ]
    assert got == sorted(expected, key=str)
    assert all(r.length == len(r.ids) // 4 for r in pieces)
    assert token_pieces(docs.limit(0), PATH).count() == 0


def test_forgotten_words_are_encoded_again(docs):
    known = packing.KnownWords(PATH, most=3)
    column = docs.select("text").toArrow().column(0)
    for _ in range(2):
        out = []
        for _, tokens, offsets in packing.token_stream(column, known):
            out += [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
        assert out == [plain(r.text, 10**9)[0] for r in docs.collect()]


def test_sequences(spark, docs):
    pieces = token_pieces(docs, PATH, capacity=512)
    packed = pack_pieces(pieces, Limits(512), group=4)
    rows = packed.collect()
    assert len(rows) == pieces.count()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    whole = {r.sequence_id: r for r in packed_sequences(packed).collect()}
    for key, own in by.items():
        ids = b"".join(r.ids for r in sorted(own, key=lambda r: r.offset))
        assert (whole[key].ids, whole[key].length, whole[key].pieces) == (ids, len(ids) // 4, len(own))
    assert pack_pieces(pieces.limit(0)).count() == 0
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"}


def test_few_sequences_at_any_grouping(spark):
    """Three groups of pieces and one of all need the fewest sequences, but for a few."""
    rng = np.random.default_rng(4)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.2, 3000).astype(int) + 1)
    least = math.ceil(lengths.sum() / 2048)
    df = spark.createDataFrame([(int(x),) for x in lengths], "length long")
    for group in (1000, 10_000):
        packed = pack_pieces(df, group=group)
        assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
        assert packed.select("sequence_id").distinct().count() <= least + 3


@pytest.mark.parametrize("limits", [Limits(100), Limits(100, documents=3), Limits(100, 50, 2500), Limits(100, 2, 6000)])
def test_every_constraint_holds(limits):
    rng = np.random.default_rng(1)
    most = limits.vector()
    lengths = rng.integers(1, int(min(100, most[2] ** 0.5)) + 1, 400)
    sequence, offset = pack_group(lengths, limits)
    count = np.bincount(sequence)
    assert np.bincount(sequence, lengths).max() <= 100 and count.max() <= most[1]
    assert np.bincount(sequence, lengths**2).max() <= most[2]
    assert (count > 0).all()
    # no worse than first fit, by the same sizes
    bins = []
    for x in sorted(lengths, reverse=True):
        size = np.array([x, 1, x * x])
        for b in bins:
            if (b >= size).all():
                b -= size
                break
        else:
            bins.append(most - size)
    assert len(count) <= len(bins) * 1.02 + 1


def test_pieces_too_large_are_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        pack_group(np.array([5, 2049]))
    with pytest.raises(ValueError, match="does not fit"):
        pack_group(np.array([0]))
    with pytest.raises(ValueError, match="does not fit"):
        pack_group(np.array([60]), Limits(100, attention=3000))
