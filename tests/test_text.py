"""Cleaning: hand-worked rows, invariants, and the shortened forms against the long ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx

ROWS = [
    (tx.safe_str, [(None, ""), (" NaN ", ""), (" a ", "a"), (" nan ", "")]),
    (
        tx.fix_missing_spaces,
        [
            ("camelCase", "camel Case"),
            ("ABCDef", "ABC Def"),
            ("hello.World", "hello. World"),
            ("3.5", "3.5"),
            ("a,b", "a, b"),
        ],
    ),
    (
        tx.normalize_text,
        [
            ("ﬁne\tx\nhttps://a.b/c y", "fine x y"),
            ("NaN", ""),
            ("nan http://x.y", ""),
            ("\x00nan", ""),
            ("ＮＡＮ", ""),
            (None, ""),
            ("a\x01b　 c", "a b c"),
            ("see www.x.org/a,b now", "see now"),
        ],
    ),
    (
        tx.normalize_phones,
        [
            ("+62 812 345 678", "+62812345678"),
            ("(+1) 415-555-2671", "(+14155552671"),
            ("0049 30 1234 567", "+49301234567"),
            ("0812-345-6789", "08123456789"),
            ("123-4567", "123-4567"),
            ("a 0812 3456 7890, b +1 415 555 2671 c", "a 081234567890, b +14155552671 c"),
            ("camelCase stays", "camelCase stays"),
            ("id x12345678901", "id x12345678901"),
            ("0812345678**", "0812345678**"),
            ("nan", ""),
            ("", ""),
        ],
    ),
    (
        tx.clean_news,
        [
            ("KOMPAS - Isi berita", "Isi berita"),
            ("KOMPAS.com - Isi berita", "KOMPAS. com - Isi berita"),
            ("a Baca Selengkapnya b", "a b"),
            ("- : isi", ": isi"),
            ("JAKARTA, KOMPAS - Isi", "Isi"),
            ("BOLA - KOMPAS - isi", "isi"),
            ("KOMPAS - nan", ""),
            ("Baca berita dengan sedikit iklan, klik di sini x", "x"),
        ],
    ),
    (
        tx.mask_finance,
        [
            ("naik 6,25 persen", "naik <PCT>"),
            ("naik 6.25% hari", "naik 6.25% hari"),
            ("Rp 1,2 triliun", "<AMT_IDR>"),
            ("USD 2.5B", "<AMT_FX>"),
            ("$120", "<AMT_USD>"),
            ("beli $BBCA", "beli <TICKER>"),
            ("BTC/USDT", "<PAIR>"),
            ("ada", "<CRYPTO>"),
            ("turun 25 bps", "turun <BPS>"),
            ("Rp 5 orang", "<AMT_IDR> orang"),
            ("nan", ""),
        ],
    ),
    (
        lambda c: tx.mask_finance(c, mask_numbers=True, keep_currency_words=False),
        [("nilai 12 hari usd", "nilai <NUM> hari"), ("bayar us$x", "bayar x")],
    ),
    (
        tx.chain("clean_news", "mask_finance"),
        [(None, ""), ("KOMPAS - naik 3 persen", "naik <PCT>")],
    ),
    (tx.model_text, [(None, ""), (" nan ", ""), (" a ", " a ")]),
]


@pytest.mark.parametrize(("fn", "rows"), ROWS)
def test_rows(apply, fn, rows):
    assert apply(fn, [r[0] for r in rows]) == [r[1] for r in rows]


def test_unknown_step(spark):
    with pytest.raises(ValueError, match="applies or repeats"):
        tx.apply_steps(F.col("t"), [("twice", "a", "b", None)])


def test_empty_text_stops_the_steps(apply):
    steps = [("apply", "^", "X ", None), ("repeat", "^X ", "Y", 2)]
    assert apply(lambda c: tx.apply_steps(c, steps), ["", " ", None, "a"]) == ["", "", "", "Ya"]

    def mark(c):
        return F.concat(c, F.lit("Z"))

    assert apply(tx.chain("normalize_text", mark, mark), ["", None, "nan", "a"]) == ["", "", "", "aZZ"]


def test_custom_steps(apply):
    steps = [("apply", "x+", "", None), ("repeat", "^a ", "", 0)]
    assert apply(lambda c: tx.apply_steps(c, steps), ["a a a a bxx", "a"]) == ["a b", "a"]


def test_python_function(apply):
    assert apply(tx.python_text_fn(lambda s: s[::-1]), ["abc", None]) == ["cba", ""]


def _random_texts(n):
    rng = random.Random(7)
    pieces = [
        "KOMPAS", "kompas", "JAKARTA", "TEMPO.CO", "ANTARANEWS", " - ", "–", "•", ":", "|", ", ",
        "nan", "NaN", " ", "\n", "\t", "\x07", "aB", "ABCd", "x.Y", "Baca Selengkapnya",
        "klik di sini", "https://a.b/C", "www.q", "é", "Ñandu", "1.5", " ", "-", "isi",
        "ﬁ", "word", "THE NEWS", "scroll  bawah",
    ]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(n)]


def _step_by_step(c):
    """The normalisation as separate passes over the text."""
    c = tx.nfkc(tx.safe_str(c))
    c = F.regexp_replace(c, r"[\x00-\x1F\x7F-\x9F]", " ")
    c = F.regexp_replace(c, r"(?U)https?://\S+|www\.\S+", " ")
    c = tx.safe_str(c)
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z])([A-Z][a-z])", "$1 $2")
    c = F.regexp_replace(c, "([.!?,;:])([A-Za-z])", "$1 $2")
    return tx.strip(F.regexp_replace(c, r"(?U)\s+", " "))


def test_normalize_equals_separate_passes(apply):
    texts = _random_texts(2000)
    assert apply(tx.normalize_text, texts) == apply(_step_by_step, texts)


def test_news_needs_no_full_renormalisation(apply):
    texts = _random_texts(2000)
    full = apply(lambda c: tx.apply_steps(c, tx.NEWS_STEPS), texts)
    assert apply(tx.clean_news, texts) == full


def test_normalize_is_idempotent(apply):
    once = apply(tx.normalize_text, _random_texts(500))
    assert apply(tx.normalize_text, once) == once


def test_long_runs_do_not_overflow(apply):
    digits, dashes = "1" * 50_000, "KOMPAS " + "- " * 20_000
    assert apply(tx.normalize_phones, [digits])[0] == digits
    assert apply(tx.clean_news, [dashes + "isi"]) == ["isi"]
    assert apply(tx.mask_finance, [digits + " persen"]) == ["<PCT>"]
