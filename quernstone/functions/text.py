"""Text functions as Column expressions."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of words; spelled out because \\w and \\b differ between regular-expression dialects.
WORD = r"[\p{L}\p{N}_]+"
#: Between two sentences: white space after an end mark and before what can begin one.
SENTENCE_GAP = r"""(?<=[.?!])\s+(?=[A-Z0-9"'(\[])"""


#: Leading zeros of numeric references, and numbers beyond all characters: unescape() fails at more digits than Python makes numbers of.
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?+")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", x)) if "&#" in x else x) if x is not None else None)


#: References that end in a semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(x: str) -> str:
    return _CLOSED.sub(lambda m: unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", m[0]))) if m[0][1] == "#" or m[0][1:] in html5 else m[0], x)


@F.pandas_udf(T.StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _closed(x) if x is not None else None)


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean(t: Column, closed: bool = False) -> Column:
    """Character references decoded, tabs and no-break spaces to spaces, CR to LF, runs of spaces to one, of line feeds to two.

    closed: only references that end in a semicolon; otherwise also those that HTML reads without one (&amp at the end of a cut title).
    Python is entered only for rows that have an ampersand at all.
    """
    t = F.coalesce(t, F.lit(""))
    t = F.when(t.contains("&"), (_unescape_closed if closed else _unescape)(F.when(t.contains("&"), t))).otherwise(t)
    t = F.translate(t, " \t", "  ")
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r" {2,}", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def tokens(t: Column) -> Column:
    """Lower-case ASCII words; a word with any other letter or digit in it yields none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(WORD), F.lit(0)), lambda x: x.rlike("^[a-z0-9_]+$"))


def terms(t: Column, least: int) -> Column:
    """Distinct lower-case words of at least so many characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0)))


def sentences(t: Column, gap: str = SENTENCE_GAP) -> Column:
    """Trimmed sentences that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), gap), strip), lambda s: s != "")


def citations(t: Column) -> Column:
    """Distinct numbers in [1] or [1, 2], ascending."""
    groups = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\[(\d+(?:,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, r",\s*")))
    return F.sort_array(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def snippet(t: Column, most: int = 180) -> Column:
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def content_id(source: Column, strategy: str, size: int, overlap: int, text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of where a chunk comes from, how it was cut and what it says."""
    return F.substring(F.sha2(F.concat(source.cast("string"), F.lit(f":{strategy}:{size}:{overlap}:"), text), 256), 1, 16)
