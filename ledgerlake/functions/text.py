"""Text expressions that follow Python's Unicode rules while staying on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that Python's ``str.strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

WORD = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def tokenize(text: Column) -> Column:
    """Lower-cased words of two or more characters, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda word: F.length(word) > 1)


def content_hash(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text: the key of the embedding store."""
    return F.sha2(text, 256)


def preview(text: Column, length: int = 150) -> Column:
    return F.substring(text, 1, length)
