"""Scalar functions against tables of written values."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factweave.functions import flags, keys, period, quantity, text


def run(spark, rows, names, *cols):
    schema = ", ".join(f"{n} {'double' if any(isinstance(r[i], float) for r in rows) else 'int' if any(isinstance(r[i], int) for r in rows) else 'string'}" for i, n in enumerate(names))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {schema}")
    return [tuple(r)[1:] for r in df.select("k", *cols).orderBy("k").collect()]


QUANTITIES = [
    ("8,142 Cr", None, "revenue", "numeric", 8.142e10, "INR", "currency_amount"),
    ("Rs. 81,415 million", None, "revenue", "numeric", 8.1415e10, "INR", "currency_amount"),
    ("6.4 per cent", None, "growth", "numeric", 0.064, None, "ratio"),
    ("25 bps", None, "margin", "numeric", 0.0025, None, "ratio"),
    ("US$ 634.6 billion", None, "reserves", "numeric", 6.346e11, "USD", "currency_amount"),
    ("1,429K tonnes", None, "freight", "numeric", 1429000.0, None, "tonnes"),
    ("(452)", "Rs. Cr", "profit after tax", "numeric", -4.52e9, "INR", "currency_amount"),
    ("(6.3%)", None, "margin", "numeric", -0.063, None, "ratio"),
    ("0.01x", None, "debt to equity", "numeric", 0.01, None, "ratio"),
    ("740 million", None, "parcels", "numeric", 7.4e8, None, "count"),
    ("18,793", None, "centres", "numeric", 18793.0, None, "number"),
    ("45 days", None, "cycle", "numeric", 45.0, None, "days"),
    ("12 345", None, "count", "numeric", 12345.0, None, "number"),
    ("Plot 5, Sector 44, Somewhere 122002", None, "address", "attribute", None, None, "text"),
    ("resigned on August 24, 2023", None, "role", "status", None, None, "text"),
    ("", None, "x", "numeric", None, None, "text"),
    (None, None, None, None, None, None, "text"),
    ("a number 7 in plain prose text", None, "x", "numeric", None, None, "text"),
    ("€ 3.5 mn", None, "x", "numeric", 3.5e6, "EUR", "currency_amount"),
    ("-12.5", None, "x", "numeric", -12.5, None, "number"),
    ("5 lakh", None, "x", "numeric", 5e5, "INR", "currency_amount"),
]


def test_quantities(spark):
    q = quantity.parse_quantity(F.col("v"), F.col("u"), F.col("l"), F.col("t"))
    got = run(spark, [r[:4] for r in QUANTITIES], ["v", "u", "l", "t"], q.alias("q"))
    for row, (g,) in zip(QUANTITIES, got):
        assert (g["currency"], g["unit_canonical"]) == row[5:], row
        assert g["value_num"] == (pytest.approx(row[4], rel=1e-12) if row[4] is not None else None), row


PERIODS = [
    ("FY24", "FY:2023-24"), ("FY 2024", "FY:2023-24"), ("fiscal 2024", "FY:2023-24"), ("2023-24", "FY:2023-24"), ("FY2023/24", "FY:2023-24"),
    ("year ended March 31, 2024", "FY:2023-24"), ("Q4 FY24", "Q4 FY:2023-24"), ("fourth quarter of FY24", "Q4 FY:2023-24"), ("H1 FY25", "H1 FY:2024-25"),
    ("first half of FY25", "H1 FY:2024-25"), ("April-December 2024", "RANGE:2024-04..2024-12"), ("nine months ended December 31, 2024", "RANGE:2024-04..2024-12"),
    ("as on 3 January 2025", "POINT:2025-01-03"), ("January 3, 2025", "POINT:2025-01-03"), ("in 2024", "CY:2024"), ("CY2024", "CY:2024"), ("calendar year 2024", "CY:2024"),
    ("2020-24", None), ("in 1888", None), ("", None), (None, None), ("nothing here", None), ("FY99", "FY:1998-99"), ("2023–24", "FY:2023-24"),
]


def test_periods(spark):
    assert [g for (g,) in run(spark, [(t,) for t, _ in PERIODS], ["t"], period.parse_period(F.col("t")).alias("p"))] == [e for _, e in PERIODS]


def test_vintage_and_dates(spark):
    stages = [("Second Advance Estimates of", "second_advance"), ("first advance estimate", "first_advance"), ("advance estimate", "first_advance"), ("provisional estimates", "provisional"), ("(RE)", "revised"), ("is projected to", "projection"), ("expected to grow", "projection"), ("plain", None), (None, None)]
    assert [g for (g,) in run(spark, [(t,) for t, _ in stages], ["t"], period.estimate_status(F.col("t")).alias("s"))] == [e for _, e in stages]
    dates = [("as on 2025-01-03 ok", "2025-01-03"), ("3 January 2025", "2025-01-03"), ("March 1, 2025", "2025-03-01"), ("end-March 2025", "2025-03-01"), ("", None), ("soon", None)]
    assert [g for (g,) in run(spark, [(t,) for t, _ in dates], ["t"], period.explicit_date(F.col("t")).alias("d"))] == [e for _, e in dates]
    pairs = [("2024-05-11", "2024-01-17", 115), ("2024-01-45", "2024-01-01", None), (None, "2024-01-01", None), ("2024-01-01T00", "2024-01-02", 1)]
    assert [g for (g,) in run(spark, [p[:2] for p in pairs], ["a", "b"], period.days_apart(F.col("a"), F.col("b")).alias("d"))] == [p[2] for p in pairs]
    cover = [(None, "Prospectus dated May 14, 2022", "D:20240808140748", "2022-05-14", "cover_dated_phrase"), ("2020-01-01", "", None, "2020-01-01", "explicit"), (None, "as at 3 June 2021", None, "2021-06-03", "cover_dated_phrase"), (None, "x", "D:20240808140748", "2024-08-08", "pdf_creation_date"), (None, None, None, None, "unknown")]
    got = run(spark, [c[:3] for c in cover], ["e", "c", "s"], period.published_date(F.col("e"), F.col("c"), F.col("s")).alias("p"))
    assert [tuple(g) for (g,) in got] == [c[3:] for c in cover]


def test_keys(spark):
    names = [("Acme Holdings Limited", None, "acme"), ("The Company", "acme", "acme"), ("Mr. John Smith", None, "john smith"), ("Foo & Bar Pvt. Ltd.", None, "foo & bar"), ("", None, ""), ("the government", "india", "india"), ("Café Über GmbH", None, "cafe uber gmbh"), ("it", None, "it")]
    assert [g for (g,) in run(spark, [n[:2] for n in names], ["n", "p"], keys.entity_key(F.col("n"), F.col("p")).alias("k"))] == [n[2] for n in names]
    labels = [("Total Revenue", "revenue"), ("Revenues from customers", "revenue"), ("PAT", "profit after tax"), ("Adj. EBITDA", "adjusted ebitda"), ("the number of shipments", "number shipment"), ("GDP growth", "real gdp growth"), ("CIN", "corporate identity number"), ("", "")]
    assert [g for (g,) in run(spark, [(a,) for a, _ in labels], ["a"], keys.attribute_key(F.col("a")).alias("k"))] == [e for _, e in labels]


def test_flags(spark):
    rows = [("restated, consolidated", "real GDP growth", ["consolidated", "real", "restated"]), (None, "gross domestic product", []), ("gross", None, ["gross"]), (None, None, [])]
    assert [g for (g,) in run(spark, [r[:2] for r in rows], ["t", "q"], flags.basis_flags(F.col("t"), F.col("q")).alias("f"))] == [r[2] for r in rows]
    rows = [("excluding traded goods", "", ["excl_traded_goods"]), ("India only!", "", ["scope:india_only"]), (None, "for the quarter", ["per_period"]), ("...", None, [])]
    assert [g for (g,) in run(spark, [r[:2] for r in rows], ["t", "q"], flags.scope_flags(F.col("t"), F.col("q")).alias("f"))] == [r[2] for r in rows]
    rows = [("numeric", "net loss", "452", 452.0, "currency_amount", 0.4, ["sign_suspect", "low_structural"]), ("numeric", "share", "x", 2.0, "ratio", 0.9, ["implausible_percent"]), ("numeric", "head", "2024", 2024.0, "number", 0.9, ["year_as_value"]), ("numeric", "x", "y", 1e16, "currency_amount", 0.9, ["huge_magnitude"]), ("attribute", None, None, None, None, 0.9, [])]
    got = run(spark, [r[:6] for r in rows], ["k2", "l", "v", "n", "u", "s"], flags.sanity_flags(*[F.col(c) for c in ("k2", "l", "v", "n", "u", "s")]).alias("f"))
    assert [g for (g,) in got] == [r[6] for r in rows]


def test_text(spark):
    rows = [("a  b\x07c \n d", "a b c d"), (None, ""), ("  ", "")]
    assert [g for (g,) in run(spark, [(r[0],) for r in rows], ["t"], text.norm_ws(F.col("t")).alias("x"))] == [r[1] for r in rows]
    rows = [("platform(1)", "platform"), ("12.7%(2)", "12.7%"), ("(452)", "(452)"), ("cost (1)", "cost (1)"), ("A(1, 3)", "A"), ("x(45)", "x(45)"), ("8,142²", "8,1422"), ("n(1,008 Cr)", "n(1,008 Cr)")]
    assert [g for (g,) in run(spark, [(r[0],) for r in rows], ["t"], text.strip_footnotes(F.col("t")).alias("x"))] == [r[1] for r in rows]
    rows = [("Straße ÉÀ ñ", "strasse ea n"), ("é", "e")]
    assert [g for (g,) in run(spark, [(r[0],) for r in rows], ["t"], text.casefold_key(F.col("t")).alias("x"))] == [r[1] for r in rows]


def test_blocks_and_labels(spark):
    rows = [("Annual Report", False, "heading"), ("ABC", False, "heading"), ("Note:", False, "list"), ("1 2 3\n4 5 6", False, "table_region"), ("• point one", False, "list"), ("(a) text here goes on", False, "list"), ("a plain sentence here.", False, "list"), ("10 20 30", True, "table_region"), ("hello there", True, "slide_textbox")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "k int, t string, d boolean")
    assert [r["c"]["kind"] for r in df.select("k", flags.classify_block(F.col("t"), F.col("d")).alias("c")).orderBy("k").collect()] == [r[2] for r in rows]
    rows = [("top\nbody\n12", 10, "12"), ("iv\nbody", 99, "iv"), ("500\nbody", 3, None), ("", 1, None), (None, 1, None)]
    assert [g for (g,) in run(spark, [r[:2] for r in rows], ["t", "p"], flags.printed_label(F.col("t"), F.col("p")).alias("l"))] == [r[2] for r in rows]


def test_json_repair(spark):
    rows = [('```json\n{"a": [1, 2,],}\n```', '{"a": [1, 2]}'), ('noise {"a": “x”} tail', '{"a": "x"}'), ("  ", None), (None, None)]
    assert [g for (g,) in run(spark, [(r[0],) for r in rows], ["t"], flags.repair_json(F.col("t")).alias("j"))] == [r[1] for r in rows]
    rows = [("Up 5.0 from 4", "5.0", "4", True), ("Up 6", "5", "4", False), ("", "1", "2", False)]
    assert [g for (g,) in run(spark, [r[:3] for r in rows], ["c", "a", "b"], flags.rephrase_allowed(F.col("c"), F.col("a"), F.col("b")).alias("ok"))] == [r[3] for r in rows]


def plain_significant(x, digits=3):
    if not x:
        return Decimal(0)
    from math import floor, log10

    return Decimal(repr(round(x, digits - 1 - floor(log10(abs(x))))))


def test_significant_digits_and_thousandths(spark):
    import random

    r = random.Random(7)
    values = [0.2605, 1245.0, 1255.0, 0.0, 999.5, -2.675, 0.0644, 1000.0, 0.001, 12.5, 1e14 + 0.5, 0.1005, -0.0005, 2.0005]
    values += [round(r.uniform(-1, 1) * 10 ** r.randint(-4, 12), r.randint(0, 6)) for _ in range(4000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    for row in df.select("v", quantity.significant(F.col("v")).alias("s"), quantity.thousandths(F.col("v")).alias("t")).collect():
        v = row["v"]
        assert Decimal(int(row["s"]["m"])).scaleb(row["s"]["e"]) == plain_significant(v), v
        if abs(v) < 1e11:
            assert Decimal(int(row["t"])).scaleb(-3) == Decimal(repr(round(v, 3))), v


def test_similarity():
    assert keys.ratio("U63090DL2011PLC221234", "L63090DL2011PLC221234") == pytest.approx(2000 / 21)
    assert keys.ratio("", "") == 100 and keys.ratio("a", "") == 0
    assert keys.key_score("data services acme", "acme data services") == 100
    assert keys.partial_ratio("abc", "xxabcxx") == 100
    assert keys.partial_ratio("hello world", "say helo world now") > 90


def test_no_named_group_is_needed():
    for pattern in (quantity.SCALE, keys.LEGAL, period.MONTH):
        re.compile(pattern)
