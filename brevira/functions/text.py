"""Column expressions over text, all inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word tokens: letters, digits and the underscore (``\\w`` is ASCII-only in Java's and RE2's dialects).
WORD = r"[\p{L}\p{N}_]+"


def strip(c) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c) -> Column:
    """White-space runs as one space, ends trimmed; case is kept."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def content_hash(c) -> Column:
    return F.sha2(normalised(c), 256)


def token_count(c) -> Column:
    """3.5 characters a token, rounded up; 0 for an empty text."""
    return F.ceil(F.length(c) / F.lit(3.5)).cast("long")


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def all_matches(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def holds(c, *strings: str) -> Column:
    """Whether a text holds one of the strings: a quick test before a pattern that needs one of them."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in strings])


def matches_if(hint: Column, c, pattern: str) -> Column:
    """:func:`all_matches`, for texts without ``hint`` none without a search."""
    return F.when(hint, all_matches(c, pattern)).otherwise(F.array().cast("array<string>"))


def word_count(c) -> Column:
    """Words by white space."""
    s = strip(c)
    odd = reduce(lambda a, b: a | b, [F.endswith(c, F.lit(x)) for x in "\u0085\u2028\u2029"])  # before these white space counts as the end
    return F.when(odd, F.when(F.length(s) == 0, 0).otherwise(F.size(F.split(s, r"\s+")))).otherwise(F.regexp_count(c, F.lit(r"\S+")))


def entropy(c) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    each = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def sentences(c) -> Column:
    """Parts that end with . or ! before white space; blank parts dropped."""
    return F.filter(F.split(c, r"(?<=[.!])\s+"), lambda x: F.length(F.trim(x)) > 0)


def contains_any(c, needles) -> Column:
    """Whether a text holds one of an array of strings, in any case."""
    return F.exists(needles, lambda s: F.contains(F.lower(c), F.lower(s)))
