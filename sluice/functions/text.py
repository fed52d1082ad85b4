"""Scalar text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space that surrounds a value: fixed values, the characters that Unicode counts as such and four separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a character class of a pattern.
SPACE = f"[{WHITE}]"


def stripped(c: Column) -> Column:
    """Without the white space around it, which only texts with an odd first or last character are searched for."""
    first, last = F.ascii(c), F.ascii(F.right(c, F.lit(1)))
    return F.when((first <= 32) | (first > 126) | (last <= 32) | (last > 126), F.btrim(c, F.lit(WHITE))).otherwise(c)


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """Null or the empty text. White space is a value, as in the data model's null rule."""
    return c.isNull() | (c == "")


def slug(c: Column) -> Column:
    """Runs of characters other than letters, digits and _ become one _; outer _ go; nothing left: "value"."""
    trimmed = F.regexp_replace(F.regexp_replace(c.cast("string"), r"[^a-zA-Z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(trimmed == "", F.lit("value")).otherwise(trimmed)


def label(c: Column) -> Column:
    """Each character other than letters, digits and _ becomes _."""
    return F.regexp_replace(c.cast("string"), r"[^A-Za-z0-9_]", "_")


def label_text(name: str) -> str:
    """label() of a name that the driver knows."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null unless bottom is positive."""
    return F.when(bottom > 0, top / bottom)
