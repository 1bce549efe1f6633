"""Token expressions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.stop_words import ENGLISH

# What counts as a word for term tables, and the default text
# clean-up in its order (tags, punctuation, blanks, digits).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
TAG_PATTERN = r"<([^>]+)>"
PUNCTUATION_PATTERN = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"
DIGIT_PATTERN = r"[0-9]+"
MIN_TOKEN_LENGTH = 3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def english_stop_words() -> list[str]:
    return list(ENGLISH)


def word_tokens(text: Column | str) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_PATTERN), F.lit(0))


def clean_tokens(text: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower, strip tags, punctuation and digits, drop stop words and short tokens."""
    words = english_stop_words() if stop_words is None else stop_words
    text = F.regexp_replace(F.lower(_col(text)), TAG_PATTERN, "")
    text = F.regexp_replace(text, PUNCTUATION_PATTERN, " ")
    text = F.regexp_replace(text, DIGIT_PATTERN, "")
    parts = F.split(text, r"\s+")
    return F.filter(parts, lambda t: (F.length(t) >= MIN_TOKEN_LENGTH) & ~t.isin(words))


def plain_tokens(text: Column | str) -> Column:
    """Words longer than two characters, stop words kept."""
    return F.filter(word_tokens(text), lambda t: F.length(t) > 2)


def without_stop_words(tokens: Column | str, stop_words: list[str], parity: bool = False) -> Column:
    """Drop stop words. ``parity=True`` keeps all, as the original filter never fires."""
    if parity:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(stop_words))


def ngrams(tokens: Column | str, low: int, high: int) -> Column:
    """All n-grams with ``low <= n <= high``, joined by a blank."""
    tokens = _col(tokens)
    parts = [tokens if n == 1 else _grams(tokens, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _grams(tokens: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))
