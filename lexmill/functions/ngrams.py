"""Word and character n-grams as rows, or listed.

As rows, n-grams are produced by exploding positions and cutting the piece at each position,
which stays inside generated code; nothing larger than one document's token array is ever held in
a row. Listed, the n-grams of a row's texts are one array, cut where the texts lie: what looks at a
document's n-grams together needs no shuffle or sort of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lexmill import fixed_values as fv
from lexmill.functions.grams import CharGrams, Words, runs_of_rows
from lexmill.functions.text import SPACE_CLASS, WORD

# Bytes of words whose n-grams are listed together inside a task.
_RUN_BYTES = 1 << 20


def word_tokens(text):
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{WORD}+"), F.lit(0))


def spaced_words(text):
    """Lower-case pieces between white space."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?U)[^{SPACE_CLASS}]+"), F.lit(0))


def _never_null(piece):
    # tells Catalyst so; otherwise joins on the term cut every piece twice to test for null
    return F.coalesce(piece, F.lit(""))


def _word_list(text, ngram_max: int):
    def grams(tokens):
        def of_size(n):
            starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
            return F.transform(starts, lambda at: F.array_join(F.slice(tokens, at, n), " "))

        sizes = F.sequence(F.lit(1), F.least(F.lit(ngram_max), F.size(tokens)))
        none = F.array().cast("array<string>")
        return F.when(F.size(tokens) > 0, F.flatten(F.transform(sizes, of_size))).otherwise(none)

    # a lambda's variable, so that the text is cut once
    return F.transform(F.array(word_tokens(text)), grams)[0]


def _char_lister(names: list[str]):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(batch.num_columns - 1)
            for rows in runs_of_rows(words, _RUN_BYTES):
                grams = CharGrams(Words.of(words, rows))
                distinct = grams.strings(np.arange(len(grams.hashes)))
                order = pc.sort_indices(distinct)
                rank = np.zeros(len(order), np.int64)
                rank[order.to_numpy()] = np.arange(len(order))
                found, ends = [np.zeros(0, np.int64)], [0]
                for ids, times in grams.documents():
                    at = np.argsort(rank[ids])
                    found.append(np.repeat(rank[ids[at]], times[at]))
                    ends.append(ends[-1] + len(found[-1]))
                terms = distinct.take(order).take(pa.array(np.concatenate(found)))
                same = pa.array(np.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.take(same) for k in batch.columns[:-1]),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms),
                    ],
                    names,
                )

    return lists


def word_ngrams(
    df: DataFrame, text_col: str, keep: list[str], ngram_max: int, listed: bool = False
) -> DataFrame:
    """One row per word n-gram, n = 1..``ngram_max``: columns ``keep``, ``n``, ``term``.

    With ``listed`` the text column is an array of texts, and a row that has n-grams stays one:
    ``keep``, ``terms`` in order.
    """
    if listed:
        of_texts = F.transform(F.col(text_col), lambda text: _word_list(text, ngram_max))
        terms = F.sort_array(F.flatten(of_texts))
        return df.select(*keep, terms.alias("terms")).filter(F.size("terms") > 0)
    tokens = df.select(*keep, word_tokens(F.col(text_col)).alias("_tokens"))
    if ngram_max == 1:
        return tokens.select(*keep, F.lit(1).alias("n"), F.explode("_tokens").alias("term"))
    # no tokens: a null array, which explodes to nothing
    positions = F.when(F.size("_tokens") > 0, F.sequence(F.lit(1), F.size("_tokens")))
    starts = tokens.select(*keep, "_tokens", F.explode(positions).alias("_at"))
    room = F.least(F.lit(ngram_max), F.size("_tokens") - F.col("_at") + 1)
    sized = starts.select(
        *keep, "_tokens", "_at", F.explode(F.sequence(F.lit(1), room)).alias("n")
    )
    piece = F.array_join(F.slice("_tokens", F.col("_at"), F.col("n")), " ")
    return sized.select(*keep, "n", _never_null(piece).alias("term"))


def char_ngrams(
    df: DataFrame, text_col: str, keep: list[str], listed: bool = False
) -> DataFrame:
    """One row per character n-gram inside space-padded words: ``keep``, ``n``, ``term``.

    A padded word no longer than n is emitted whole, once, and gets no longer n-grams. ``listed``
    is that of ``word_ngrams``.
    """
    if listed:
        words = df.select(*keep, F.flatten(F.transform(F.col(text_col), spaced_words)).alias("_words"))
        schema = StructType([df.schema[k] for k in keep])
        schema = schema.add("terms", ArrayType(StringType()))
        lists = words.mapInArrow(_char_lister(schema.fieldNames()), schema)
        return lists.filter(F.size("terms") > 0)
    low, high = fv.CHAR_NGRAM_RANGE
    words = df.select(*keep, F.explode(spaced_words(F.col(text_col))).alias("_word"))
    padded = words.select(
        *keep,
        F.concat(F.lit(" "), "_word", F.lit(" ")).alias("_word"),
        (F.length("_word") + 2).alias("_len"),
    )
    last = F.greatest(F.lit(low), F.least(F.lit(high), F.col("_len")))
    sized = padded.select(
        *keep, "_word", "_len", F.explode(F.sequence(F.lit(low), last)).alias("n")
    )
    placed = sized.select(
        *keep,
        "_word",
        "n",
        F.explode(
            F.sequence(F.lit(1), F.greatest(F.col("_len") - F.col("n") + 1, F.lit(1)))
        ).alias("_at"),
    )
    piece = F.substring(F.col("_word"), F.col("_at"), F.col("n"))
    return placed.select(*keep, "n", _never_null(piece).alias("term"))


WORD_BLOCK = "word"
CHAR_BLOCK = "char"
BLOCKS = (WORD_BLOCK, CHAR_BLOCK)
