"""Text cleaning as Column builders.

Every builder takes a string Column and returns one; each names its input once, so
chains of builders stay linear in size. Character classes follow the Unicode rules
of the usual text tools: a word character is a letter, a number or ``_``; white
space includes the separators U+001C to U+001F.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill import fixed_values as fv

TextFn = Callable[[Column], Column]

WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
# White space as the inside of a class, for patterns with the flag (?U). Spelling the
# ranges out instead is many times slower.
SPACE_CLASS = r"\s\x1C-\x1F"
BLANK_CLASS = r"\s" + fv.CONTROL_RANGE
# The same characters as a trim set.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

_MISSING = "".join(f"[{ch.upper()}{ch}]" for ch in fv.MISSING_WORD)
_PUNCT = re.escape(fv.TIGHT_PUNCTUATION)


def let(value: Column, body: TextFn) -> Column:
    """Bind ``value`` once for a ``body`` that names it several times."""
    return F.transform(F.array(value), body)[0]


def python_text_fn(fn: Callable[[str], str]) -> TextFn:
    """Wrap any ``str -> str`` function as a Column builder (Arrow batches)."""

    @F.pandas_udf(StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    return lambda c: apply(F.coalesce(c, F.lit("")))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    def norm(v):
        if v is None or unicodedata.is_normalized("NFKC", v):
            return v
        return unicodedata.normalize("NFKC", v)

    return values.map(norm)


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Only rows with a non-ASCII character travel to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _drop_missing(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_MISSING}\z", "")


def safe_str(c: Column) -> Column:
    """Null and the missing word become empty; other text is stripped."""
    return _drop_missing(strip(F.coalesce(c.cast("string"), F.lit(""))))


def _open_up(c: Column) -> Column:
    # One pass: a space goes behind a character whose right neighbour starts a new word.
    return F.regexp_replace(
        c, rf"[a-z](?=[A-Z])|[A-Z](?=[A-Z][a-z])|[{_PUNCT}](?=[A-Za-z])", "$0 "
    )


def fix_missing_spaces(c: Column) -> Column:
    return _open_up(safe_str(c))


def _squeeze(c: Column) -> Column:
    """Runs of white space and control characters become one space; trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U)[{BLANK_CLASS}]+", " "))


def _drop_urls(c: Column) -> Column:
    starts = "|".join(fv.URL_STARTS)
    return F.regexp_replace(c, rf"(?U)(?:{starts})[^{BLANK_CLASS}]+", " ")


def normalize_text(c: Column, fix_spaces: bool = True, compose: bool = True) -> Column:
    """NFKC, no control characters, no web addresses, single spaces.

    ``compose=False`` skips the NFKC step for text known to be composed already.
    Control characters end a web address and are squeezed with the white space, so
    no separate pass over the text is needed for them.
    """
    c = F.coalesce(c.cast("string"), F.lit(""))
    if not fix_spaces:
        # here the missing word is recognised on the raw text only
        c = F.regexp_replace(c, rf"(?U)^[{SPACE_CLASS}]*{_MISSING}[{SPACE_CLASS}]*\z", "")
    if compose:
        c = nfkc(c)
    c = _drop_urls(c)
    if fix_spaces:
        c = F.regexp_replace(c, rf"(?U)^[{BLANK_CLASS}]*{_MISSING}[{BLANK_CLASS}]*\z", "")
        c = _open_up(c)
    return _squeeze(c)


# --- phone numbers -----------------------------------------------------------

_SEP = r"\s\-.()"
# The open-ended digit group is written as a fixed part and one class: same language,
# but no recursion on long digit runs.
PHONE = (
    rf"(?<!{WORD})(?:\+|00)?\s*(?:\(?{DIGIT}{{1,4}}\)?[\s\-.]*)?"
    rf"(?:{DIGIT}[{_SEP}]*){{{fv.PHONE_RUN}}}[{DIGIT}{_SEP}]*\**(?!{WORD})"
)


def _rewrite_phone(hit: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(hit, rf"[^{DIGIT}+*]+", ""), "^00", "+")
    return let(
        kept,
        lambda k: F.when(
            F.length(F.regexp_replace(k, "[+*]", "")) < fv.PHONE_MIN_DIGITS, hit
        ).otherwise(k),
    )


def normalize_phones(c: Column) -> Column:
    """Rewrite phone-like runs to bare digits with at most one leading ``+``."""
    pattern = F.lit(PHONE)

    def rewrite(text: Column) -> Column:
        gaps = F.split(text, PHONE, -1)
        hits = F.regexp_extract_all(text, pattern, F.lit(0))
        pairs = F.zip_with(
            gaps,
            F.transform(hits, _rewrite_phone),
            lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))),
        )
        return F.array_join(pairs, "")

    return let(normalize_text(c, fix_spaces=False), rewrite)


# --- step engine ---------------------------------------------------------------

Step = tuple[str, str, str, int | None]


def _stays_composed(pattern: str, replacement: str) -> bool:
    """Whether a replacement surely leaves composed text composed.

    It does when it ends in an ASCII character that takes no combining mark, or when it
    only cuts a prefix.
    """
    if not replacement:
        return pattern.startswith("^") and "|" not in pattern
    last = replacement[-1]
    return replacement.isascii() and not last.isalpha() and last not in "<=>" and "$" not in replacement


def apply_steps(c: Column, steps: Sequence[Step], renormalize: TextFn | None = None) -> Column:
    """Run ``(kind, pattern, replacement, max_iter)`` steps over normalised text.

    ``kind`` is ``apply`` (once) or ``repeat`` (up to ``max_iter`` passes, 0 or None
    meaning three; a pass over text that no longer changes has no effect, so the
    passes are simply unrolled). After each pass the text is normalised again, with the
    NFKC step (which needs Python) only where the replacement could call for it.
    """
    c = normalize_text(c)
    for kind, pattern, replacement, max_iter in steps:
        if kind == "apply":
            passes = 1
        elif kind == "repeat":
            passes = max_iter or fv.REPEAT_PASSES
        else:
            raise ValueError(f"a step applies or repeats, not {kind!r}")
        again = renormalize or partial(
            normalize_text, compose=not _stays_composed(pattern, replacement)
        )
        for _ in range(passes):
            c = again(_unless_empty(c, partial(_replaced, pattern, replacement)))
    return c


def _replaced(pattern: str, replacement: str, c: Column) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def _unless_empty(c: Column, step: TextFn) -> Column:
    """A step without Python that leaves empty text alone."""
    return let(c, lambda t: F.when(t == "", t).otherwise(step(t)))


# --- news ------------------------------------------------------------------------


def _phrase(words: str) -> str:
    return r"\s+".join(words.split())


def _outlet(name: str, suffixes: Sequence[str]) -> str:
    return name + "".join(f"(?:{re.escape(s)})?" for s in suffixes)


def _times(bounds: tuple[int, int]) -> str:
    return "{%d,%d}" % bounds


# A run of marks and spaces that begins with a mark.
_MARKS = rf"[{fv.PREFIX_MARKS}][{fv.PREFIX_MARKS}\s]*"

AD_PATTERN = rf"(?iu)(?<!{WORD}){fv.AD_NOTICE[0]}\s*{fv.AD_NOTICE[1]}(?!{WORD})"
UI_PATTERN = rf"(?iu)(?<!{WORD})(?:{'|'.join(_phrase(p) for p in fv.UI_PHRASES)})(?!{WORD})"
SECTION_PATTERN = rf"^\s*[A-Z][A-Z\s]{_times(fv.SECTION_TAIL)}\s*{_MARKS}"
OUTLET_PATTERN = (
    rf"(?iu)^\s*(?:[A-Z][A-Z\s.\-]{_times(fv.DATELINE_TAIL)}?,\s*)?"
    rf"(?:{'|'.join(_outlet(n, s) for n, s in fv.OUTLETS)})"
    rf"\s*(?:,?\s*[A-Za-z][A-Za-z\s.\-]{_times(fv.OUTLET_PLACE_TAIL)})?"
    rf"\s*{_MARKS}"
)
LEADING_PATTERN = rf"^\s*[{fv.LEADING_MARKS}]+\s*"

NEWS_STEPS: tuple[Step, ...] = (
    ("apply", AD_PATTERN, " ", None),
    ("apply", UI_PATTERN, " ", None),
    ("repeat", SECTION_PATTERN, " ", fv.REPEAT_PASSES),
    ("repeat", OUTLET_PATTERN, " ", fv.REPEAT_PASSES),
    ("apply", LEADING_PATTERN, "", None),
)


def _retrim(c: Column) -> Column:
    # Enough for steps that only put a space or cut a prefix: nothing that was apart
    # comes together, so no new word boundary or web address can appear.
    return _drop_missing(F.trim(F.regexp_replace(c, " {2,}", " ")))


def clean_news(c: Column) -> Column:
    """Strip boilerplate, section and outlet prefixes from news text."""
    return apply_steps(c, NEWS_STEPS, renormalize=_retrim)


# --- finance -----------------------------------------------------------------------


def _any(words: Sequence[str]) -> str:
    return "|".join(w if w.startswith("[") else w.replace("$", r"\$") for w in words)


_CODE = rf"[A-Z]{_times(fv.CODE_LENGTH)}"
_NUMBER = rf"(?<!{WORD}){DIGIT}+(?:[.,]{DIGIT}+)?"
_AMOUNT = rf"\s*{DIGIT}[{DIGIT}.,]*"

FINANCE_MASKS: tuple[tuple[str, str], ...] = (
    (fv.PAIR_TOKEN, rf"(?<!{WORD}){_CODE}\s*[/\-]\s*{_CODE}(?!{WORD})"),
    (fv.TICKER_TOKEN, rf"(?<!{WORD})\${_CODE}(?!{WORD})"),
    (fv.CRYPTO_TOKEN, rf"(?iu)(?<!{WORD})(?:{_any(fv.CRYPTO_CODES)})(?!{WORD})"),
    # a percent sign counts only when a word character follows it directly
    (fv.PERCENT_TOKEN, rf"(?iu){_NUMBER}\s*(?:%(?={WORD})|{fv.PERCENT_WORD}(?!{WORD}))"),
    (fv.BASIS_POINT_TOKEN, rf"(?iu){_NUMBER}\s*(?:{_any(fv.BASIS_POINT_WORDS)})(?!{WORD})"),
    (
        fv.IDR_TOKEN,
        rf"(?iu)(?<!{WORD})(?:rp\.?|idr){_AMOUNT}\s*(?:{_any(fv.IDR_UNITS)})?(?!{WORD})",
    ),
    (
        fv.FX_TOKEN,
        rf"(?iu)(?<!{WORD})(?:{_any(fv.FX_CODES)}){_AMOUNT}\s*(?:{_any(fv.FX_UNITS)})?(?!{WORD})",
    ),
    (fv.DOLLAR_TOKEN, rf"(?<!{WORD})\${_AMOUNT}(?:\s*[KMBT])?(?!{WORD})"),
)
CURRENCY_PATTERN = (
    rf"(?iu)(?<!{WORD})(?:(?:{_any(fv.CURRENCY_WORDS)})(?!{WORD})"
    rf"|(?:{_any(fv.CURRENCY_DOLLAR_WORDS)})(?={WORD}))"
)
NUMBER_PATTERN = rf"{_NUMBER}(?!{WORD})"


def mask_finance(
    c: Column, mask_numbers: bool = False, keep_currency_words: bool = True
) -> Column:
    """Replace pairs, tickers, percentages and amounts by tokens, in a fixed order."""
    c = normalize_text(c)
    for token, pattern in FINANCE_MASKS:
        c = F.regexp_replace(c, pattern, f" {token} ")
    if not keep_currency_words:
        c = F.regexp_replace(c, CURRENCY_PATTERN, " ")
    if mask_numbers:
        c = F.regexp_replace(c, NUMBER_PATTERN, f" {fv.NUMBER_TOKEN} ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


# --- chains --------------------------------------------------------------------------

CLEANERS: dict[str, TextFn] = {
    "normalize_text": normalize_text,
    "normalize_phones": normalize_phones,
    "clean_news": clean_news,
    "mask_finance": mask_finance,
}


_KEEP_EMPTY = frozenset(CLEANERS.values())


def chain(*cleaners: TextFn | str) -> TextFn:
    """Run cleaners in order; null counts as empty, and empty text stays empty."""
    steps = [CLEANERS[s] if isinstance(s, str) else s for s in cleaners]

    def run(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        for step in steps:
            # cleaners of this module leave empty text empty
            c = step(c) if step in _KEEP_EMPTY else F.when(c == "", c).otherwise(step(c))
        return c

    return run


def model_text(c: Column, clean: TextFn | None = None) -> Column:
    """Text as a model sees it: missing becomes empty, the rest stays unstripped."""
    c = F.regexp_replace(
        F.coalesce(c.cast("string"), F.lit("")),
        rf"(?U)^[{SPACE_CLASS}]*{_MISSING}[{SPACE_CLASS}]*\z",
        "",
    )
    return clean(c) if clean is not None else c
