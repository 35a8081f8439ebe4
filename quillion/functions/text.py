"""Text functions: Catalyst expressions, with Arrow functions only for what Unicode tables demand."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java's regular expressions need (?U) for Unicode classes, and trim() strips spaces only


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _folded(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    for x in set(s):
        if unicodedata.combining(x):
            s = s.replace(x, "")
    return s


def _ranges(codes: list[int]) -> str:
    """A regular expression class body for sorted code points."""
    out, start = [], None
    for c, after in zip(codes, [*codes[1:], -1], strict=True):
        start = c if start is None else start
        if after != c + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{c:x}}}")
            start = None
    return "".join(out)


#: Characters that JVM functions can handle: Latin letters and usual punctuation.
_NEAR = [*range(0x250), *range(0x2010, 0x2024)]
_SIMPLE = [c for c in _NEAR if len(_folded(chr(c))) == 1]
_MAPPED = [c for c in _SIMPLE if _folded(chr(c)) != chr(c)]
_FOLD_FROM, _FOLD_TO = "".join(map(chr, _MAPPED)), "".join(_folded(chr(c)) for c in _MAPPED)
# ASCII, which is simple, fails the first part at once; the ranges are looked through for the rest alone
_FAR = r"[\x{80}-\x{10FFFF}&&[^%s]]"
_NEEDS_FOLD = _FAR % _ranges([c for c in _SIMPLE if c > 127])
_NEEDS_NFKC = _FAR % _ranges([c for c in _NEAR if c > 127 and unicodedata.normalize("NFKC", chr(c)) == chr(c)])


@F.pandas_udf(T.StringType())
def _fold_rest(s: pd.Series) -> pd.Series:
    return s.map(_folded, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_rest(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks.

    Only rows with characters outside the table of Latin letters reach Python.
    """
    rest = F.coalesce(_fold_rest(F.when(c.rlike(_NEEDS_FOLD), c)), F.translate(c, _FOLD_FROM, _FOLD_TO))
    return F.when(c.rlike(r"[^\x00-\x7F]"), rest).otherwise(c)


def nfkc(c: Column) -> Column:
    return F.coalesce(_nfkc_rest(F.when(c.rlike(_NEEDS_NFKC), c)), c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_rest(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else html.unescape(x) for x in xs], na_action="ignore")


#: Entities as they end properly, with a semicolon.
_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _unescape_ended(s: str) -> str:
    return _ENDED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0], s)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_ended_rest(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else _unescape_ended(x) for x in xs], na_action="ignore")


def unescape(texts: Column, ended: bool = False) -> Column:
    """HTML entities decoded in each text of an array; arrays without any stay in the JVM.

    With ``ended`` an entity ends with its semicolon: one that was cut off, or whose end went with a tag, stays as it is.
    """
    rest = _unescape_ended_rest if ended else _unescape_rest
    return F.coalesce(rest(F.when(F.exists(texts, lambda t: F.coalesce(F.contains(t, F.lit("&")), F.lit(False))), texts)), texts)


def plain_texts(texts: Column, ended: bool = False) -> Column:
    """Markup stripped from each text of an array: tags, entities (with ``ended`` those that end properly alone), encoded tags, runs of blanks; empty ones null."""
    bare = unescape(F.transform(texts, lambda t: F.regexp_replace(t, "<[^<>]*>", "")), ended)
    return F.transform(bare, lambda t: nonempty(strip(F.regexp_replace(F.regexp_replace(t, r"(?i)</?(?:p|br|jats:[a-z-]+)\b[^<>]*>", ""), r"[ \t\r\f\x0B]+", " "))))


def doi_bare(c: Column) -> Column:
    """A DOI without its usual prefix, case kept; null if nothing is left."""
    return nonempty(strip(F.regexp_replace(strip(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")))


def stem(w: Column) -> Column:
    """Plural endings removed, on both sides of a comparison alike."""
    n = F.length(w)
    plural = w.endswith("s") & ~w.rlike("(ss|us|is)$")
    return F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & plural, F.substring(w, F.lit(1), n - 1)).otherwise(w)


def words(c: Column) -> Column:
    """Lower-case, accent-free, stemmed words of a text; null has none."""
    found = F.regexp_extract_all(F.lower(fold(F.coalesce(c, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$")), stem)


def title_key(c: Column) -> Column:
    """A title for comparison: folded, lower case, words separated by single spaces; null if none."""
    return nonempty(strip(F.regexp_replace(F.lower(fold(c)), r"(?U)[\W_]+", " ")))
