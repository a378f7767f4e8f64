"""Text clean-up as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANKS = r"(?U)[\s\x00-\x1f\x7f\x85]+"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
DASHES = "−–—"


def _latin_table() -> tuple[str, str]:
    """Accented letters below U+2000 whose decomposition is one base letter and marks."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _latin_table()


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, as an expression tree has no names for its parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c: Column) -> Column:
    """True for null and empty: what counts as missing."""
    return F.coalesce(c, F.lit("")) == ""


def norm_ws(c: Column) -> Column:
    """Runs of white space and control characters as one blank, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


def ascii_digits(c: Column) -> Column:
    """Superscript digits as digits, long dashes and the minus sign as a hyphen."""
    return F.translate(c, SUPERSCRIPTS + DASHES, DIGITS + "-" * len(DASHES))


def deaccent(c: Column) -> Column:
    """Latin, Greek and Cyrillic letters without accents; combining marks dropped. Stays in the JVM."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), r"\p{Mn}+", "")


@F.pandas_udf(StringType())
def deaccent_full(texts: pd.Series) -> pd.Series:
    """Any script, with compatibility forms taken apart."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def casefold_key(c: Column) -> Column:
    return F.replace(F.lower(norm_ws(deaccent(F.coalesce(c, F.lit(""))))), F.lit("ß"), F.lit("ss"))


def guard_form(c: Column) -> Column:
    """The form in which quotes are sought: blanks and case folded, accents kept."""
    return F.replace(F.lower(norm_ws(c)), F.lit("ß"), F.lit("ss"))


#: Reference numbers from 0 to 20, perhaps with a leading zero, in a list.
_REF = r"(?:0?[0-9]|1[0-9]|20)"
FOOTNOTE = rf"(?<=[A-Za-z%\)\d])\(\s*{_REF}(?:\s*,\s*{_REF})*\s*\)"


def strip_footnotes(c: Column) -> Column:
    """Drops reference marks such as (1) or (1, 2) glued to a word, a number, % or a bracket."""
    return F.regexp_replace(ascii_digits(c), FOOTNOTE, "")


def slug(c: Column) -> Column:
    """Folded text, other characters as single underscores, none at the ends, 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(casefold_key(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)


def cap(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def clean_title(title: Column, stem: Column) -> Column:
    """The title, or the file's stem if it is empty, over 70 characters, or has two semicolons."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when((t == "") | (F.length(t) > 70) | (F.regexp_count(t, F.lit(";")) >= 2), stem).otherwise(t)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
