"""Written values as numbers with unit, currency and scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, let, norm_ws

# Scale words by scale, currency marks and unit words in their order of precedence.
SCALES = {
    "thousand": 1e3, "k": 1e3, "'000": 1e3, "000s": 1e3,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "cr.": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9, "b": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
}
CURRENCIES = [
    ("INR", r"(?i)₹|\brs\.?\b|\binr\b|\brupees?\b|\bcrores?\b|\blakhs?\b|\blacs?\b"),
    ("USD", r"(?i)us\$|\bus\s*dollar|\busd\b|(?<![A-Za-z])\$"),
    ("EUR", r"(?i)€|\beur\b|\beuros?\b"),
    ("GBP", r"(?i)£|\bgbp\b"),
]
INDIAN_SCALE = r"(?i)\b(cr|cr\.|crore|crores|lakh|lakhs|lac|lacs)\b"
PERCENT = r"(?i)%|per\s?cent|percent|\bpc\b|\bpp[t]?\b|percentage\s+points?"
BASIS_POINTS = r"(?i)\bbps\b|basis\s+points?"
TONNES = r"(?i)\b(tonnes?|tons?|mt)\b"
DAYS = r"(?i)\bdays?\b"
MULTIPLE = r"(?i)\d\s*x\b"
NUMBER = r"[-+]?\d[\d,]*\.?\d*"
MONEY_LABEL = (
    r"(?i)revenue|income|ebitda|profit|loss|turnover|sales|capex|expenditure|expense|"
    r"deficit|borrowing|debt|net worth|cash|gdp|gva|reserves|fdi|assets|liabilit"
)
BRACKETED = r"(?i)\(\s*(?:rs\.?|inr|₹|us\$|usd|\$)?\s*[\d,]+(?:\.\d+)?\s*(?:%|per\s?cent|cr|crore|mn|million|bn|billion|lakh|k|bps)?\s*\)"

SCALE = "(?i)(?<![A-Za-z])(" + "|".join(k.replace(".", r"\.") for k in sorted(SCALES, key=lambda k: (-len(k), k))) + ")(?![A-Za-z])"


def currency_of(c: Column) -> Column:
    out = F.when(c.rlike(CURRENCIES[0][1]), CURRENCIES[0][0])
    for code, pattern in CURRENCIES[1:]:
        out = out.when(c.rlike(pattern), code)
    return F.coalesce(out, F.when(c.rlike(INDIAN_SCALE), "INR"))


def scale_of(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(c, SCALE, 1)))


def first_number(c: Column) -> Column:
    """The first signed, grouped decimal; ordinary blanks are ignored, so "12 345" is one number."""
    return F.replace(F.regexp_extract(F.replace(c, F.lit(" "), F.lit("")), NUMBER, 0), F.lit(","), F.lit("")).try_cast("double")


def is_negative(c: Column) -> Column:
    """A leading minus, or a number in brackets that is most of the text, or brackets around all of it."""
    t = ascii_digits(F.trim(F.coalesce(c, F.lit(""))))
    bracketed = F.length(F.regexp_extract(t, BRACKETED, 0))
    return (
        t.rlike(r"^\s*-\s*[\d(]")
        | ((bracketed > 0) & (bracketed >= F.greatest(F.lit(3), F.floor(F.lit(0.6) * F.length(t)))))
        | (t.startswith("(") & F.regexp_replace(t, r"[ .]+$", "").endswith(")") & t.rlike(r"\d"))
    )


def parse_quantity(value: Column, unit: Column, label: Column, kind: Column) -> Column:
    """struct(value_num, currency, unit_canonical, scale_applied) of a written value; the first case that fits."""
    unit = F.coalesce(unit, F.lit(""))

    def read(raw: Column) -> Column:
        return let(norm_ws(F.concat(raw, F.lit(" "), unit)), lambda both: F.struct(
            raw.alias("raw"), both.alias("both"), currency_of(both).alias("currency"), scale_of(both).alias("scale"), first_number(raw).alias("number"),
            is_negative(raw).alias("negative"), both.rlike(PERCENT).alias("percent"), both.rlike(BASIS_POINTS).alias("points"),
        ))

    parts = let(norm_ws(ascii_digits(F.coalesce(value, F.lit("")))), read)
    return let(parts, lambda p: _quantity(p, unit, label, kind))


def _quantity(p: Column, unit: Column, label: Column, kind: Column) -> Column:
    """parse_quantity of a text that was read into parts, each of which is worked out once."""
    raw, both, currency, scale, number, percent, points = (p[c] for c in ("raw", "both", "currency", "scale", "number", "percent", "points"))
    ratio = percent | points
    signal = ratio | currency.isNotNull() | scale.isNotNull() | (unit != "")
    with_sign = lambda x: F.when(p["negative"], -F.abs(x)).otherwise(x)
    value = with_sign(number * F.coalesce(scale, F.lit(1.0)))

    def q(num, money, name: str, factor=None):
        null = F.lit(None)
        return F.struct(
            (null if num is None else num).cast("double").alias("value_num"),
            (null if money is None else money).cast("string").alias("currency"),
            F.lit(name).alias("unit_canonical"),
            (null if factor is None else factor).cast("double").alias("scale_applied"),
        )

    words = F.regexp_count(raw, F.lit(r"[A-Za-z]{3,}"))
    return (
        F.when(raw == "", q(None, None, "text"))
        .when(kind.isin("status", "event") & ~ratio, q(None, currency, "text"))
        .when((kind == "attribute") & ~signal, q(None, currency, "text"))
        .when(percent, q(with_sign(number) / 100.0, None, "ratio"))
        .when(points, q(with_sign(number) / 10000.0, None, "ratio"))
        .when(raw.rlike(MULTIPLE), q(with_sign(number), None, "ratio"))
        .when(number.isNull() | (~signal & (words >= 3)), q(None, currency, "text"))
        .when(both.rlike(TONNES), q(value, None, "tonnes", scale))
        .when(both.rlike(DAYS), q(value, None, "days", scale))
        .when(currency.isNotNull() | F.coalesce(scale.isin(1e7, 1e5), F.lit(False)) | F.coalesce(label, F.lit("")).rlike(MONEY_LABEL), q(value, currency, "currency_amount", scale))
        .when(scale.isNotNull(), q(value, None, "count", scale))
        .otherwise(q(value, None, "number"))
    )


def _halves(v: Column) -> Column:
    """v as the exact sum of two numbers of half its digits."""
    return let(v * 134217729.0, lambda c: let(c - (c - v), lambda high: F.struct(high.alias("h"), (v - high).alias("l"))))


def _product_error(u: Column, v: Column, w: Column) -> Column:
    """u * v - w, exactly, where w is u * v rounded."""
    return let(F.struct(_halves(u).alias("u"), _halves(v).alias("v")), lambda s: ((s["u"]["h"] * s["v"]["h"] - w) + s["u"]["h"] * s["v"]["l"] + s["u"]["l"] * s["v"]["h"]) + s["u"]["l"] * s["v"]["l"])


def _rounded(x: Column, power: Column) -> Column:
    """x * 10^power rounded half to even on x's exact binary value, as a whole number; power may be negative.

    A product that seems to end in .5 is settled by the exact error of the multiplication or division.
    """

    def settle(s: Column) -> Column:
        x, ten, up, p, floor = s["x"], s["ten"], s["up"], s["p"], F.floor(s["p"]).cast("double")
        rest = F.when(up, _product_error(x, ten, p)).otherwise(let(p * ten, lambda exact: (x - exact) - _product_error(p, ten, exact)))
        tie = let(rest, lambda r: F.when(r > 0, floor + 1).when(r < 0, floor).otherwise(floor + F.pmod(floor, F.lit(2.0))))
        return F.when(p - floor == 0.5, tie).when(p - floor > 0.5, floor + 1).otherwise(floor)

    def scaled(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["ten"].alias("ten"), s["up"].alias("up"), F.when(s["up"], s["x"] * s["ten"]).otherwise(s["x"] / s["ten"]).alias("p"))

    start = let(power, lambda n: F.struct(x.alias("x"), F.pow(F.lit(10.0), F.abs(n)).alias("ten"), (n >= 0).alias("up")))
    return let(start, lambda s: let(scaled(s), settle))


def significant(x: Column, digits: int = 3) -> Column:
    """struct(m, e): x to `digits` significant digits is m * 10^e, compared as a pair; 0 is (0, 0)."""

    def made(s: Column) -> Column:
        full = s["m"] >= 10.0**digits
        return F.struct((F.signum(x) * F.when(full, s["m"] / 10).otherwise(s["m"])).alias("m"), (s["size"] - (digits - 1) + F.when(full, 1).otherwise(0)).alias("e"))

    size = F.floor(F.log10(F.abs(x))).cast("int")
    pair = let(size, lambda n: F.struct(n.alias("size"), _rounded(F.abs(x), F.lit(digits - 1) - n).alias("m")))
    return F.when(x == 0, F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("e"))).otherwise(F.when(x.isNotNull(), let(pair, made)))


def thousandths(x: Column) -> Column:
    """x rounded to three decimals, as a whole number of thousandths."""
    return F.signum(x) * _rounded(F.abs(x), F.lit(3))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
