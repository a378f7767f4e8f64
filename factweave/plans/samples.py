"""Facts, rendered values and documents derived from plain tables, as SQL that Spark and DuckDB both run.

The fact set has five documents of yearly (and one of quarterly) sums by nation, with values, dates, flags and stages varied
by key arithmetic so that every rule of the cascade has its cases, and textual facts for identifiers and addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_YEARLY = """
  SELECT n.n_nationkey AS nk, lower(n.n_name) AS entity_key, year(o.o_orderdate) AS y, {quarter} AS q,
         CAST(sum(CAST({amount} AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey {more}
  GROUP BY n.n_nationkey, lower(n.n_name), year(o.o_orderdate), {quarter}
"""
_SUMS = _YEARLY.format(quarter="year(o.o_orderdate) * 0", amount="o.o_totalprice", more="").strip()
_QUARTERS = _YEARLY.format(quarter="quarter(o.o_orderdate)", amount="o.o_totalprice", more="").strip()
_LINES = _YEARLY.format(quarter="year(o.o_orderdate) * 0", amount="l.l_extendedprice", more="JOIN lineitem l ON l.l_orderkey = o.o_orderkey").strip()

#: Common table expressions that end in `f`, the facts.
FACTS = f"""
s1 AS ({_SUMS}),
s2 AS ({_LINES}),
s4 AS ({_QUARTERS}),
u AS (
  SELECT 1 AS doc_id, nk, entity_key, y, q, v FROM s1
  UNION ALL SELECT 2, nk, entity_key, y, q, v FROM s2
  UNION ALL SELECT 3, nk, entity_key, y, q, v * CASE WHEN nk % 10 = 0 THEN 1.002 WHEN nk % 5 = 0 THEN 1.006 WHEN nk % 5 = 1 THEN 10.0 WHEN nk % 5 = 2 THEN 1.05 WHEN nk % 5 = 3 THEN 1.0 ELSE 0.9 END FROM s1
  UNION ALL SELECT 4, nk, entity_key, y, q, v FROM s4
  UNION ALL SELECT 5, nk, entity_key, y, q, v * 1.3 FROM s1
),
m AS (
  SELECT CAST(doc_id * 10000000 + nk * 100000 + (y - 1990) * 10 + q AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS doc_id,
         concat('Document ', CAST(doc_id AS STRING)) AS doc_title, entity_key, 'revenue' AS attribute_key, 'Revenue' AS attribute_display,
         CASE WHEN nk % 9 = 8 THEN 'status' ELSE 'numeric' END AS fact_kind, CAST(CAST(v AS DECIMAL(20,2)) AS STRING) AS value_text, v AS value_num,
         CASE WHEN doc_id = 5 AND nk % 4 = 0 THEN 'USD' WHEN doc_id = 2 THEN CAST(NULL AS STRING) ELSE 'INR' END AS currency,
         CASE WHEN doc_id = 5 AND nk % 7 = 3 THEN 'count' ELSE 'currency_amount' END AS unit_canonical,
         CASE WHEN q > 0 THEN concat('Q', CAST(q AS STRING), ' CY:', CAST(y AS STRING)) WHEN doc_id = 5 AND nk % 6 = 1 THEN '' WHEN doc_id >= 3 AND nk % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('CY:', CAST(y AS STRING)) END AS period_canonical,
         concat(CAST(y + 1 AS STRING), CASE WHEN doc_id = 2 THEN '-01-45' WHEN doc_id = 3 AND nk % 2 = 0 THEN '-06-30' WHEN doc_id = 5 AND nk % 9 = 8 THEN '-06-30' ELSE '-01-15' END) AS as_of_date,
         CASE WHEN doc_id = 3 AND nk % 4 = 1 THEN 'provisional' WHEN doc_id = 5 AND nk % 4 = 1 THEN 'first_advance' ELSE CAST(NULL AS STRING) END AS estimate_status,
         CASE WHEN doc_id = 5 AND nk % 5 = 2 THEN 'adjusted,net' ELSE '' END AS basis_text,
         CASE WHEN doc_id = 2 AND nk % 5 = 4 THEN 'per_period' ELSE '' END AS scope_text,
         CASE WHEN doc_id = 1 AND nk % 11 = 5 THEN 'sign_suspect' ELSE '' END AS sanity_text,
         CASE WHEN doc_id = 5 AND nk % 2 = 0 THEN 'Agency' ELSE CAST(NULL AS STRING) END AS attributed_to,
         CASE WHEN nk % 10 = 7 THEN CAST(0.4 AS DOUBLE) WHEN nk % 10 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS extraction_confidence,
         CAST(y % 3 AS INT) AS source_page,
         CASE WHEN doc_id = 3 AND nk % 5 = 3 THEN concat('h1-', CAST(nk AS STRING), '-', CAST(y AS STRING)) ELSE concat('h', CAST(doc_id AS STRING), '-', CAST(nk AS STRING), '-', CAST(y AS STRING), '-', CAST(q AS STRING)) END AS content_hash
  FROM u
),
t AS (
  SELECT CAST(60000000 + s_suppkey * 10 + d.k AS BIGINT) AS id, CAST(d.k AS BIGINT) AS doc_id, concat('Document ', CAST(d.k AS STRING)) AS doc_title,
         lower(s_name) AS entity_key, CASE WHEN s_suppkey % 2 = 0 THEN 'corporate identity number' ELSE 'registered office address' END AS attribute_key,
         CASE WHEN s_suppkey % 2 = 0 THEN 'CIN' ELSE 'Registered Office' END AS attribute_display, 'attribute' AS fact_kind,
         CASE WHEN s_suppkey % 2 = 0 THEN concat(CASE WHEN d.k = 1 THEN 'U' ELSE 'L' END, CAST(63090 + CASE WHEN s_suppkey % 6 = 0 THEN d.k * 1111 ELSE 0 END AS STRING), 'DL2011PLC', CAST(221000 + s_suppkey AS STRING))
              WHEN s_suppkey % 3 = 0 THEN concat('Plot ', CAST(d.k AS STRING), ' Sector 44 ', CAST(122000 + (s_suppkey % 7) * (d.k - 1) AS STRING))
              WHEN s_suppkey % 5 = 0 THEN CASE WHEN d.k = 1 THEN 'Main Street' ELSE '12 MAIN   street North' END
              ELSE concat('Lane ', CAST(d.k AS STRING)) END AS value_text,
         CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS STRING) AS currency, 'text' AS unit_canonical, CAST(NULL AS STRING) AS period_canonical,
         concat('202', CAST(d.k AS STRING), '-03-31') AS as_of_date, CAST(NULL AS STRING) AS estimate_status, '' AS basis_text, '' AS scope_text, '' AS sanity_text,
         CAST(NULL AS STRING) AS attributed_to, CAST(0.81 AS DOUBLE) AS extraction_confidence, CAST(1 AS INT) AS source_page,
         concat('t', CAST(s_suppkey AS STRING), '-', CAST(d.k AS STRING)) AS content_hash
  FROM supplier CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) d
),
f AS (SELECT * FROM m UNION ALL SELECT * FROM t)
"""


#: Written quantities: k, value, unit, label, kind.
QUANTITIES = """
quantities AS (
  SELECT p_partkey AS k,
    CASE p_partkey % 20
      WHEN 0 THEN concat('Rs. ', x, ' Cr') WHEN 1 THEN concat(x, ' million') WHEN 2 THEN concat(x, '%') WHEN 3 THEN concat('(', x, ')')
      WHEN 4 THEN concat(x, 'x') WHEN 5 THEN concat(n, ' days') WHEN 6 THEN concat(n, 'K tonnes') WHEN 7 THEN concat('US$ ', x, ' billion')
      WHEN 8 THEN concat('€ ', x) WHEN 9 THEN concat(n, ' bps') WHEN 10 THEN concat('-', x) WHEN 11 THEN concat(n, ',', '345')
      WHEN 12 THEN p_name WHEN 13 THEN concat(x, ' lakh') WHEN 14 THEN '' WHEN 15 THEN concat('£', x, ' mn') WHEN 16 THEN concat('(', x, ' per cent)')
      WHEN 17 THEN concat('Plot ', n, ' Some Long Street Name') WHEN 18 THEN concat(n, ' ', n) ELSE concat('resigned on August ', n, ', 2023') END AS value,
    CASE WHEN p_partkey % 7 = 0 THEN 'Rs. Cr' WHEN p_partkey % 7 = 1 THEN '' WHEN p_partkey % 7 = 2 THEN 'nos' ELSE CAST(NULL AS STRING) END AS unit,
    CASE WHEN p_partkey % 3 = 0 THEN 'Total revenue' WHEN p_partkey % 3 = 1 THEN 'centres' ELSE 'Net loss' END AS label,
    CASE WHEN p_partkey % 5 = 0 THEN 'attribute' WHEN p_partkey % 5 = 1 THEN 'status' ELSE 'numeric' END AS kind
  FROM (SELECT p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS x, CAST(p_size AS STRING) AS n FROM part) z
)
"""

#: Written periods and dates: k, txt.
DATED_TEXTS = """
dated AS (
  SELECT o_orderkey AS k,
    CASE o_orderkey % 24
      WHEN 0 THEN concat('FY', yy) WHEN 1 THEN concat('FY ', y) WHEN 2 THEN concat('fiscal ', y) WHEN 3 THEN concat(y1, '-', yy)
      WHEN 4 THEN concat('FY', y1, '/', yy) WHEN 5 THEN concat('year ended March 31, ', y) WHEN 6 THEN concat('Q', q, ' FY', yy)
      WHEN 7 THEN concat('fourth quarter of FY', yy) WHEN 8 THEN concat('H1 FY', yy) WHEN 9 THEN concat('second half of FY', y)
      WHEN 10 THEN concat('April-December ', y) WHEN 11 THEN concat('nine months ended December 31, ', y) WHEN 12 THEN concat('as on ', d, ' ', mon, ' ', y)
      WHEN 13 THEN concat('As at ', mon, ' ', d, ', ', y) WHEN 14 THEN concat('in ', y) WHEN 15 THEN concat('CY', y) WHEN 16 THEN concat('calendar year ', y)
      WHEN 17 THEN concat(y, '-12-0', q, ' report') WHEN 18 THEN concat('end-', mon, ' ', y) WHEN 19 THEN concat('financial  year ', y) WHEN 20 THEN concat(y1, '-', y)
      WHEN 21 THEN 'no period' WHEN 22 THEN concat('dated ', d, ' ', mon, ' ', y) ELSE '' END AS txt
  FROM (
    SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y, CAST(year(o_orderdate) - 1 AS STRING) AS y1, right(CAST(year(o_orderdate) AS STRING), 2) AS yy,
           CAST(quarter(o_orderdate) AS STRING) AS q, CAST(day(o_orderdate) AS STRING) AS d,
           CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June'
             WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS mon
    FROM orders) z
)
"""

#: Names, labels and qualifier texts: k, name, label, basis, scope, quote.
NAMED_TEXTS = """
named AS (
  SELECT c_custkey AS k,
    CASE c_custkey % 8 WHEN 0 THEN concat(c_name, ' Limited') WHEN 1 THEN concat('Mr. ', c_name) WHEN 2 THEN 'The Company' WHEN 3 THEN concat('  ', c_name, '  Pvt. Ltd. ')
      WHEN 4 THEN concat(c_name, ' Holdings (India), Inc.') WHEN 5 THEN 'our Company' WHEN 6 THEN '' ELSE concat('Caf', chr(233), ' ', c_name, ' Group') END AS name,
    CASE c_custkey % 10 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'Revenues from Customers' WHEN 2 THEN 'PAT' WHEN 3 THEN 'Adj. EBITDA' WHEN 4 THEN 'the number of shipments'
      WHEN 5 THEN 'GDP growth' WHEN 6 THEN 'CIN' WHEN 7 THEN concat('Estimates for ', c_mktsegment) WHEN 8 THEN '' ELSE 'Profit/(Loss) after tax' END AS label,
    CASE c_custkey % 6 WHEN 0 THEN 'Restated, pro forma' WHEN 1 THEN 'on a reported basis' WHEN 2 THEN 'seasonally adjusted' WHEN 3 THEN 'Consolidated; net of tax' WHEN 4 THEN CAST(NULL AS STRING) ELSE 'annualised nominal' END AS basis,
    CASE c_custkey % 5 WHEN 0 THEN 'excluding traded goods' WHEN 1 THEN concat('Only ', c_mktsegment, '!') WHEN 2 THEN 'since inception' WHEN 3 THEN CAST(NULL AS STRING) ELSE '' END AS scope,
    CASE c_custkey % 7 WHEN 0 THEN 'real GDP growth for the year' WHEN 1 THEN 'gross domestic product' WHEN 2 THEN 'gross margin (1) of 5%(2)' WHEN 3 THEN 'Second advance estimates' WHEN 4 THEN 'is projected to grow'
      WHEN 5 THEN 'first revised estimate (RE)' ELSE 'provisional estimates were made' END AS quote
  FROM customer
)
"""


def view(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample facts, with flag arrays."""
    view(spark, sf_dir, ("nation", "customer", "supplier", "orders", "lineitem"))
    df = spark.sql(f"WITH {FACTS} SELECT * FROM f")
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return df.select("*", split("basis_text").alias("basis_flags"), split("scope_text").alias("scope_flags"), split("sanity_text").alias("sanity_flags"), F.lit(None).cast("string").alias("entity_display")).drop("basis_text", "scope_text", "sanity_text")
