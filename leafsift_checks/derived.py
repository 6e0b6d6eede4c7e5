"""Report blocks derived from lineitem and orders, at any scale factor.

A report is (customer, four years), a page is an order (by rank among the
orders of the report), and every line item is a block of its page, ranked by
number and content: each row of both tables is used. The windows hold one
customer's orders or one order's lines. The DuckDB text states the same
derivation for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# {q} quantity, {p} price, {k} part, {s} supplier, {n} line number; \n is a line feed.
SENTENCES = [
    "We had an average number of employees\nof {q} this year.",
    "Our team: we employ {q} people in total.",
    "There were {f} fatalities; safety is our priority.",
    "The number of agency contractors was {q}.",
    "Gender balance:  {q}% of managers are female.",
    "Lost time injury frequency rate (LTIFR) improved to 0.{f}.",
    "Staff receive private medical insurance cover for {f} family members.",
    "Maternity and family benefits were extended to {q} colleagues.",
    "The CEO pay ratio was {q}:1 this year.",
    "Some {q}% of the board are from an ethnic minority background.",
    "Employees of {q} nationalities serve across {f} countries.",
    "The rate is a total",
    "recordable case rate, TRCR, of 1.{f}",
    "The total workforce of {q} staff is spread over {f} sites.",
    "With a headcount of {q}, the team grew; average employees: {k}.",
    "Revenue grew by {q}% in every market.",
    "Sadly, {f} people died in an accident at sea.",
    "The total number of employees was {p}.",
]
OTHERS = {
    10: "<image: DeviceRGB, width {q}>",
    11: "Report_AW.indd {q}",
    12: "bad {U+FFFD} glyph {q}",
    13: "{U+F0B7} bullet {q}",
    14: "2019 {U+2013} 2020",
    15: "Café \n notes\t{q}   end",
}
TABLE = "Quantity\nPrice\nItem {n}\n{q}\n{p}\n{k}\n{s}\n"
TAIL = "{q}\n{p}\n{k}\n{s}\n{q}\n"
BLANK = " \n \n \n \n \n \n \n \n"

WIDE = {"{U+FFFD}": 0xFFFD, "{U+F0B7}": 0xF0B7, "{U+2013}": 0x2013}


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, page, paragraph, text`` from the given tables."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    of_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    cells = lines.select(
        "l_orderkey",
        F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("int").alias("q"),
        F.floor("l_extendedprice").cast("int").alias("p"),
        F.col("l_partkey").alias("k"),
        F.col("l_suppkey").alias("s"),
        F.row_number().over(of_order).alias("paragraph"),
    )
    years = F.year("o_orderdate") - F.year("o_orderdate") % 4
    pages = orders.select("o_orderkey", "o_custkey", years.alias("y"),
                          F.row_number().over(Window.partitionBy("o_custkey", years).orderBy("o_orderkey")).alias("page"))
    rows = cells.join(pages.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("f", F.col("q") % 10)
    kind = F.col("k") % 16
    pick = (F.col("k") + F.col("s")) % len(SENTENCES)
    sentence = F.get(F.array(*map(F.lit, SENTENCES)), pick.cast("int"))
    fixed = [TABLE] * 3 + [TAIL, BLANK] + [OTHERS.get(i) for i in range(5, 16)]
    text = F.coalesce(F.get(F.array(*map(F.lit, fixed)), kind.cast("int")), sentence)
    for slot, code in WIDE.items():
        text = F.replace(text, F.lit(slot), F.lit(chr(code)))
    for slot in "qpksnf":
        text = F.replace(text, F.lit("{" + slot + "}"), F.col(slot).cast("string"))
    # A generator keeps later filters from repeating the whole expression.
    rows = rows.withColumn("text", F.explode(F.array(text)))
    return rows.select(
        F.concat(
            F.lit("Company_"), F.col("o_custkey").cast("string"), F.lit("_Annual_Report_"),
            F.col("y").cast("string"), F.lit(".pdf"),
        ).alias("filename"),
        "page",
        "paragraph",
        "text",
    )


def _duck_text(template: str) -> str:
    def quote(t: str) -> str:
        return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    out = quote(template)
    for slot, code in WIDE.items():
        if slot in template:
            out = f"replace({out}, '{slot}', chr({code}))"
    for slot in "qpksnf":
        if "{" + slot + "}" in template:
            out = f"replace({out}, '{{{slot}}}', CAST({slot} AS VARCHAR))"
    return out


def report_blocks_sql() -> str:
    """The same rows as a DuckDB SELECT."""
    cases = [f"WHEN k % 16 < 3 THEN {_duck_text(TABLE)}", f"WHEN k % 16 = 3 THEN {_duck_text(TAIL)}",
             f"WHEN k % 16 = 4 THEN {_duck_text(BLANK)}"]
    cases += [f"WHEN k % 16 = {n} THEN {_duck_text(t)}" for n, t in OTHERS.items()]
    cases += [f"WHEN (k + s) % {len(SENTENCES)} = {n} THEN {_duck_text(t)}" for n, t in enumerate(SENTENCES)]
    return f"""
SELECT 'Company_' || CAST(o_custkey AS VARCHAR) || '_Annual_Report_' || CAST(y AS VARCHAR) || '.pdf' AS filename,
       CAST(page AS INT) AS page, CAST(paragraph AS INT) AS paragraph,
       CASE {' '.join(cases)} END AS text
FROM (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS INT) AS q, CAST(floor(l_extendedprice) AS INT) AS p,
             l_partkey AS k, l_suppkey AS s, CAST(l_quantity AS INT) % 10 AS f,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS paragraph
      FROM lineitem) c
JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderkey) AS page
      FROM (SELECT o_orderkey, o_custkey, year(o_orderdate) - year(o_orderdate) % 4 AS y FROM orders)) o ON o_orderkey = l_orderkey"""
