"""Entity and attribute keys (E1-E4, E8) and string similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import casefold_key, let, norm_ws

# Legal forms, forms of address, self references, filler words, plurals and known attribute names.
LEGAL = (
    r"(?i)\b(private limited|pvt\.? ?ltd\.?|limited|ltd\.?|pvt\.?|plc|inc\.?|incorporated|"
    r"corp\.?|corporation|llp|l\.l\.p\.|company|co\.?|holdings?|group)\b"
)
HONORIFIC = r"(?i)^(mr|mrs|ms|miss|dr|prof|shri|smt|sri|hon'?ble|the)\.?\s+"
SELF = (
    r"(?i)^(the\s+)?(company|group|bank|corporation|firm|issuer|organisation|organization|"
    r"government|nation|country|economy|central bank|reserve bank|board|management|"
    r"we|our company|your company|the parent|it)$"
)
FILLER = r"\b(the|a|an|of|for|to|our|its|their|overall)\b"
PLURALS = ["revenues", "centres", "centers", "shipments", "parcels", "tonnes", "days", "customers", "estimates"]
ATTRIBUTES = {
    "revenue": [
        "revenue", "revenues", "total revenue", "revenue from services", "revenue from service", "revenues from services",
        "revenue from customers", "revenues from customers", "total revenues from customers",
        "revenue from contracts with customers", "revenue from operations", "income from services",
    ],
    "profit after tax": ["pat", "profit after tax", "net profit", "loss for the year", "profit / (loss) after tax", "profit/(loss) after tax", "profit for the year"],
    "ebitda": ["ebitda"],
    "adjusted ebitda": ["adjusted ebitda", "adj ebitda", "adj. ebitda"],
    "real gdp growth": ["gdp growth", "real gdp growth", "real gross domestic product growth", "growth in real gdp"],
    "real gva growth": ["gva growth"],
    "foreign exchange reserves": ["forex reserves", "fx reserves", "foreign exchange reserves"],
    "current account deficit": ["cad", "current account deficit"],
    "headline inflation": ["cpi inflation", "retail inflation", "headline inflation", "consumer price index inflation"],
    "corporate identity number": ["cin", "corporate identity number"],
    "pin code": ["pincode", "pin code"],
    "registered office address": ["registered office", "registered office address"],
    "corporate office address": ["corporate office", "corporate office address", "corporate address"],
    "board membership": ["board membership", "directorship", "board position", "board seat"],
}
ORGANISATION = r"\b([A-Z][A-Za-z&.\-]+(?:\s+[A-Z][A-Za-z&.\-]+){0,4}\s+(?:Limited|Ltd|Bank|Corporation|Authority|Board|Fund|Company|PLC|Inc))\b"


def is_self_reference(name: Column) -> Column:
    return norm_ws(name).rlike(SELF)


def entity_key(name: Column, primary: Column | None = None) -> Column:
    """The comparable form of a name; a self reference is the document's primary entity, if it has one."""
    n = norm_ws(name)
    primary = F.lit(None).cast("string") if primary is None else F.when(primary != "", primary)
    bare = F.regexp_replace(n, HONORIFIC, "")
    bare = F.regexp_replace(bare, r"(?U)[^\w\s&/-]", " ")
    key = norm_ws(casefold_key(norm_ws(F.regexp_replace(bare, LEGAL, " "))))
    return F.when(n == "", "").when(n.rlike(SELF) & primary.isNotNull(), primary).otherwise(key)


def person_display(name: Column) -> Column:
    return norm_ws(F.regexp_replace(norm_ws(name), HONORIFIC, ""))


def attribute_key(label: Column) -> Column:
    """The canonical name of an attribute: known names as they stand, without marks, then without filler and plurals."""
    known = F.create_map(*[F.lit(x) for key, names in ATTRIBUTES.items() for name in names for x in (name, key)])

    def bare(n: Column) -> Column:
        return norm_ws(F.regexp_replace(n, r"(?U)[^\w\s%/&-]", " "))

    def core(plain: Column) -> Column:
        out = norm_ws(F.regexp_replace(plain, FILLER, " "))
        for word in PLURALS:
            out = F.regexp_replace(out, rf"\b{word}\b", word[:-1])
        return norm_ws(out)

    def found(plain: Column) -> Column:
        return F.coalesce(F.try_element_at(known, plain), let(core(plain), lambda c: F.coalesce(F.try_element_at(known, c), c)))

    return let(casefold_key(label), lambda n: F.when(n == "", "").otherwise(F.coalesce(F.try_element_at(known, n), let(bare(n), found))))


def attribute_display(label: Column) -> Column:
    return norm_ws(label)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * common subsequence / total length; two empty texts are alike."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def key_score(a: str, b: str) -> float:
    """The better of the ratio as written and of the ratio with words sorted."""
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def partial_ratio(short: str, text: str) -> float:
    """The best ratio of `short` with a stretch of `text` no longer than it, which may stick out at the ends."""
    if len(short) > len(text):
        short, text = text, short
    n, best = len(short), 0.0
    if not n:
        return 100.0 if not text else 0.0
    letters = set(short)
    for begin in range(1 - n, len(text)):
        stretch = text[max(0, begin) : begin + n]
        edge = stretch[0] if begin < 0 else stretch[-1]
        if edge in letters and 200 * len(stretch) / (n + len(stretch)) > best:
            best = max(best, ratio(short, stretch))
            if best == 100:
                break
    return best


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.nan if x is None or y is None else ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def key_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([key_score(x, y) for x, y in zip(a, b)])


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two texts of one length differ, in the JVM."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
