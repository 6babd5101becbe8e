"""Spellings: blanks, names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: blanks are spaces and tabs.
BLANKS = " \t"


def strip_blanks(c: Column) -> Column:
    """``c`` without surrounding spaces and tabs; null stays null."""
    return F.trim(c, F.lit(BLANKS))


def plain_name(c: Column) -> Column:
    """Trimmed, upper-case form of a name; null stays null."""
    return F.upper(strip_blanks(c))


def duration_text(seconds: Column) -> Column:
    """``12.3s`` below a minute, else ``h:mm:ss`` of the nearest second, with days before it where there are some; null stays null."""
    whole = F.rint(seconds).cast("long")
    days, rest = F.floor(whole / 86_400), whole % 86_400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    named = F.when(days == 1, F.concat(F.lit("1 day, "), clock)).when(days > 1, F.concat(days.cast("string"), F.lit(" days, "), clock)).otherwise(clock)
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", F.bround(seconds, 1)), F.lit("s"))).otherwise(F.when(seconds.isNotNull(), named))


def canonical_id(c: Column, width: int = 7) -> Column:
    """``letters-number`` spelling of an id: lower case, number padded to ``width``.

    Letter case, blanks, separators and leading zeros make no difference. An id
    that isn't letters followed by a number gives null.
    """
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    letters = F.regexp_extract(bare, "^([a-z]+)0*([0-9]+)$", 1)
    number = F.regexp_extract(bare, "^([a-z]+)0*([0-9]+)$", 2)
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return F.when(letters != "", F.concat(letters, F.lit("-"), padded))


def known_id(c: Column, width: int = 7) -> Column:
    """:func:`canonical_id`, null also for numbers that stand for "not known" (all 0 or all 9)."""
    key = canonical_id(c, width)
    number = F.regexp_extract(key, "([0-9]+)$", 1)
    return F.when(~number.isin("0" * width, "9" * width), key)
