"""Text expressions. All of them are built-in Spark functions on Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters for which comparing lower-cased strings differs from a
# case-insensitive comparison letter by letter (dotted and dotless i, long s,
# micro sign, the sigmas, Greek and Cyrillic variant letters, dotted long s).
SPECIAL_LETTERS = (
    "\u0130\u0131\u017f\u00b5\u03a3\u03c2\u0345\u1fbe\u03d0\u03f5\u03d1\u03f0"
    "\u03d6\u03f1\u03d5\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86\u1c87\u1c88\u1e9b"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (linear, no regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def literal_pattern(phrase: str, match_case: bool) -> str:
    """Java regex that matches ``phrase`` literally; case-insensitive by letter unless ``match_case``."""
    quoted = "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return quoted if match_case else "(?iu)" + quoted


def has_special_letters(text: Column) -> Column:
    """True for the few texts on which lower-case comparison is not exact.

    The byte test settles all-ASCII texts without looking at single letters, and one plain
    range most of the others: the letters are the micro sign and some from U+0130 on.
    """
    return (
        (F.octet_length(text) != F.length(text))
        & text.rlike("[^\\x00-\u00b4\u00b6-\u012f]")
        & text.rlike(f"[{SPECIAL_LETTERS}]")
    )


def is_special_phrase(phrase: str) -> bool:
    return bool(re.search(f"[{SPECIAL_LETTERS}]", phrase))


def count_literal(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle``, left to right.

    ``contains`` is several times faster than ``replace`` on a text without the needle, which
    most are. Byte lengths are stored with the value, so only the search reads the text.
    """
    removed = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    count = F.call_function("div", removed, F.octet_length(needle)).cast("int")
    return F.when(F.contains(text, needle), count).otherwise(0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Of an array of whole numbers the sum of all that stand before each.

    Arrays grow by copying, so the sums run in blocks: within each, and over the blocks' totals.
    """

    def scan(values: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            values,
            start,
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def in_blocks(values: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
        return F.transform(cuts, lambda at: F.slice(values, at, F.lit(block)))

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda total, x: total + x))
        return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0)), scan))

    return bound(bound(lengths, in_blocks), summed)


def sanitize(text: Column, max_length: int = 500) -> Column:
    """Text fit for a report cell: printable ASCII, single spaces, cut to ``max_length``."""
    # The three patterns and what replaces them.
    clean = F.regexp_replace(text, "_{3,}", "_")
    clean = F.regexp_replace(clean, "[^\\x20-\\x7E\\n\\r\\t]+", "")
    clean = F.regexp_replace(clean, "\\s+", " ")

    def cut(c: Column) -> Column:
        short = F.concat(F.substring(c, 1, max_length - 3), F.lit("..."))
        return F.trim(F.when(F.length(c) > max_length, short).otherwise(c))

    def shown(c: Column) -> Column:
        return F.when(c == "", F.lit("No text available")).otherwise(c)

    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(
        bound(bound(clean, cut), shown)
    )
