"""Shannon entropy of tokens, and the tokens worth measuring."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkblot.functions.arrays import let
from inkblot.functions.dialect import SPACE
from inkblot.functions.spans import place, regex_hit, regex_spans

# Token separators, least token length, threshold in bits.
TOKEN_CLASS = r"[^\s\"'\(\)\{\}\[\]=,;:\\]"
MIN_TOKEN_LENGTH = 8
ENTROPY_THRESHOLD = 3.2

_TOKEN = TOKEN_CLASS.replace(r"\s", SPACE)


def shannon_entropy(token: Column) -> Column:
    """Bits per character over the code points up to U+00FF; others count in the length only."""

    def bits(token: Column) -> Column:
        chars = F.filter(F.sort_array(F.array_distinct(F.split(token, ""))), lambda c: (F.length(c) == 1) & (c <= "ÿ"))
        counts = F.transform(chars, lambda c: F.length(token) - F.length(F.replace(token, c, F.lit(""))))
        total = F.length(token).cast("double")
        return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - (n / total) * F.log2(n / total))

    return F.when(F.length(token) > 0, let(token, bits)).otherwise(F.lit(0.0))


def least_length(threshold: float = ENTROPY_THRESHOLD) -> int:
    """A token of n characters carries at most log2(n) bits, so shorter ones can never exceed."""
    return max(MIN_TOKEN_LENGTH, math.floor(2**threshold) + 1)


def token_spans(text: Column, min_length: int = 1) -> Column:
    """Runs of characters other than separators, at least ``min_length`` long."""
    return regex_spans(text, f"{_TOKEN}{{{min_length},}}+")


def is_candidate(token: Column) -> Column:
    """Long enough, and not made of ASCII letters and underscores alone."""
    return (F.length(token) >= MIN_TOKEN_LENGTH) & ~token.rlike(r"^[a-zA-Z_]+\z")


def high_entropy_hit(text: Column, threshold: float = ENTROPY_THRESHOLD) -> Column:
    """Tokens above ``threshold``. Most words fail :func:`is_candidate`, so the pattern skips them."""
    separators = f"(?:[{_TOKEN[2:]}|\\z)"
    pattern = f"(?<!{_TOKEN})(?![a-zA-Z_]++{separators}){_TOKEN}{{{least_length(threshold)},}}+"
    return regex_hit(text, pattern, keep=lambda token: shannon_entropy(token) > threshold)


def high_entropy_spans(text: Column, threshold: float = ENTROPY_THRESHOLD) -> Column:
    return let(high_entropy_hit(text, threshold), place)
