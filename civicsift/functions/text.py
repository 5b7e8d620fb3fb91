"""Text columns: whitespace handling, dedupe key, tokens, n-grams, lengths."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicsift.functions.regex import java_pattern

# Members of the character classes shared by every operator (Unicode-aware).
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

RULE_TOKEN = f"[{WORD}]+|[^{WORD}{SPACE}]"
MODEL_TOKEN = f"[{WORD}]{{2,}}"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, although ``use`` mentions it often or per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keep_if(value: Column, wanted: Callable[[Column], Column]) -> Column:
    """Generator of ``value`` for rows where it is ``wanted``; other rows go away.

    A filter on a computed column makes the optimizer compute the column twice, once for the
    filter and once for the output; a generator is computed once.
    """
    return F.explode(F.filter(F.array(value), wanted))


def settled(value: Column) -> Column:
    """Generator that yields ``value`` once per row.

    Filters on columns derived from it stay above it, instead of being rewritten in terms of
    the expensive expression and evaluated a second time below.
    """
    return F.explode(F.array(value))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone only knows U+0020)."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+\z", "")


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def clean_text(text: Column) -> Column:
    """Training and scoring form of a text; case is kept and null becomes blank."""
    return collapse(F.coalesce(text, F.lit("")))


def dedupe_key(text: Column) -> Column:
    """Lower-case collapsed text; blank for missing texts and texts that start with a URL."""
    return F.regexp_replace(F.lower(clean_text(text)), r"(?s)\Ahttps?://.*", "")


def rule_tokens(text: Column) -> Column:
    """Lower-case word runs and single punctuation marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(RULE_TOKEN), F.lit(0))


def model_tokens(
    text: Column,
    pattern: str | None = None,
    lowercase: bool = True,
    stop_words: Sequence[str] | None = None,
) -> Column:
    """Tokens for the model; an unusable custom pattern falls back to the default one."""
    regex = MODEL_TOKEN
    if pattern:
        try:
            regex = java_pattern(pattern.removeprefix("(?u)"), ignore_case=False)
        except (re.error, ValueError) as problem:
            warnings.warn(f"token pattern not usable, default taken: {problem}", stacklevel=2)
    tokens = F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(regex), F.lit(0))
    tokens = F.filter(tokens, lambda token: token != "") if pattern else tokens
    if stop_words:
        stops = sorted({word.lower() if lowercase else word for word in stop_words})
        tokens = F.filter(tokens, lambda token: ~token.isin(stops))
    return tokens


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Blank-joined n-grams for every n in ``low..high``."""
    def build(words: Column) -> Column:
        return F.concat(*[_grams_of_size(words, n) for n in range(max(low, 1), high + 1)])

    if high < max(low, 1):
        return F.array().cast("array<string>")
    if (max(low, 1), high) == (1, 1):
        return tokens
    return bind(tokens, build)


def _grams_of_size(words: Column, n: int) -> Column:
    """Neighbours are joined by zipping the list with itself shifted, one step per extra word."""
    grams = words
    for step in range(1, n):
        shifted = F.slice(words, step + 1, F.greatest(F.size(words) - step, F.lit(0)))
        heads = F.slice(grams, 1, F.greatest(F.size(words) - step, F.lit(0)))
        grams = F.zip_with(heads, shifted, lambda head, word: F.concat(head, F.lit(" "), word))
    return grams


def is_number(text: Column) -> Column:
    """Whether a text is a decimal number; casts also take forms like ``1d``."""
    return text.rlike(rf"(?i)\A[{SPACE}]*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf(?:inity)?)[{SPACE}]*\z")


def token_count(cleaned: Column) -> Column:
    """Number of blank-separated tokens of a cleaned text."""
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " ")))
