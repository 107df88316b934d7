import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm.byte_words import PUNCTUATED, row_shingles, set_key, words_of

LOWERED = {k: k + 32 for k in range(65, 91)}


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWERED))


def grouped(texts, size):
    """Rows with equal shingle sets, as found by hashes."""
    out = {}
    for words in words_of(pa.array(texts, pa.string())):
        for row, found in row_shingles(words, size):
            out[row] = (len(found), int(set_key(found)))
    return [out[i] for i in range(len(texts))]


texts = st.lists(
    st.one_of(st.none(), st.text(st.sampled_from("aAbB é\n\t\x0b中\x00."), max_size=40)), max_size=12
)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles_equal_those_of_strings(rows, size):
    sets = []
    for text in rows:
        w = plain_words(text)
        windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        sets.append(frozenset(windows))
    found = grouped(rows, size)
    assert [n for n, _ in found] == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (a == b) == (found[i] == found[j])


def test_rows_do_not_run_together():
    words = next(words_of(pa.array(["ab", "cd", "", None, "x y"])))
    assert list(np.diff(words.first)) == [1, 1, 0, 0, 2]
    assert words.hashes[0] != words.hashes[1]


def test_sliced_arrays_and_long_texts():
    long = "word " * 400_000
    column = pa.array(["skip", "a b", long, "a b"])[1:]
    counts = {}
    keys = {}
    for words in words_of(column):
        for i in range(words.rows):
            counts[words.start + i] = int(words.first[i + 1] - words.first[i])
            keys[words.start + i] = list(words.hashes[words.first[i] : words.first[i + 1]][:2])
    assert counts == {0: 2, 1: 400_000, 2: 2}
    assert keys[0] == keys[2]


def test_punctuation_can_part_words():
    words = next(words_of(pa.array(["Idiot, idiot. IDIOT!"]), PUNCTUATED))
    assert len(set(words.hashes)) == 1 and len(words.hashes) == 3
