"""``loan_book``: the raw loan table (12 columns plus a key) derived from the
driver tables as orders JOIN customer LEFT JOIN per-order lineitem aggregates.

At scale this is two shuffles keyed on the join keys (lineitem is reduced to
one row per order with a partial aggregate before it moves); Spark decides
between broadcast and sort-merge from size statistics, so nothing is forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Column order of the raw table (reference order), then the derived two.
RAW_COLUMNS = [
    "person_age", "person_income", "person_home_ownership", "person_emp_length",
    "loan_intent", "loan_grade", "loan_amnt", "loan_int_rate", "loan_status",
    "loan_percent_income", "cb_person_default_on_file", "cb_person_cred_hist_length",
]
KEY = "loan_id"
LABEL = "loan_status"


def _case(col: Column, mapping: dict[int, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def loan_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_discount", "l_returnflag"])
          .groupBy("l_orderkey")
          .agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"),
               F.count(F.lit(1)).alias("n"),
               # max(flag) = 'R' as two integer maxima, so the aggregate stays a
               # hash aggregate (a string max falls back to a sort aggregate)
               F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_r"),
               F.max(F.when(F.col("l_returnflag") > "R", 1).otherwise(0)).alias("above_r")))
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    cust = read_table(spark, sf_dir, "customer",
                      ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    base = (orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
            .join(li, li.l_orderkey == orders.o_orderkey, "left"))
    ck = F.col("c_custkey")
    b = base.select(
        F.col("o_orderkey").alias(KEY),
        (20 + ck % 60 + F.when(ck % 97 == 7, 90).otherwise(0)).cast("int").alias("person_age"),
        F.round(F.col("c_acctbal") * 12).cast("bigint").alias("person_income"),
        _case(F.col("c_nationkey") % 4, {0: "MORTGAGE", 1: "OTHER", 2: "OWN", 3: "RENT"})
        .alias("person_home_ownership"),
        F.when(F.col("o_orderkey") % 37 == 0, F.lit(None).cast("double"))
        .otherwise((ck % 31).cast("double")).alias("person_emp_length"),
        F.col("o_orderpriority").alias("loan_intent"),
        F.col("c_mktsegment").alias("loan_grade"),
        F.round(F.col("o_totalprice") / 16).cast("bigint").alias("loan_amnt"),
        (F.col("d").cast("double") / F.col("n")).alias("loan_int_rate"),
        F.when((F.col("has_r") == 1) & (F.col("above_r") == 0), "Y").otherwise("N")
        .alias("cb_person_default_on_file"),
        (2 + ck % 17 + F.when(ck % 53 == 0, 30).otherwise(0)).cast("int")
        .alias("cb_person_cred_hist_length"),
    )
    inc, amt = F.col("person_income"), F.col("loan_amnt")
    return b.select(
        "*",
        F.when(inc > 0, F.round(amt.cast("double") / inc, 2)).alias("loan_percent_income"),
        F.when((amt > 0.5 * inc) | (F.col(KEY) % 20 == 0), 1).otherwise(0).alias(LABEL),
    )


# Same table as SQL text, for the DuckDB oracle (and usable with spark.sql).
LOAN_BOOK_SQL = """
li AS (
  SELECT l_orderkey, SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS d, COUNT(*) AS n, MAX(l_returnflag) AS rf
  FROM lineitem GROUP BY l_orderkey),
lb_base AS (
  SELECT o_orderkey AS loan_id,
    CAST(20 + c_custkey % 60 + CASE WHEN c_custkey % 97 = 7 THEN 90 ELSE 0 END AS INT) AS person_age,
    CAST(ROUND(c_acctbal * 12) AS BIGINT) AS person_income,
    CASE c_nationkey % 4 WHEN 0 THEN 'MORTGAGE' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'OWN' ELSE 'RENT' END AS person_home_ownership,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(c_custkey % 31 AS DOUBLE) END AS person_emp_length,
    o_orderpriority AS loan_intent, c_mktsegment AS loan_grade,
    CAST(ROUND(o_totalprice / 16) AS BIGINT) AS loan_amnt,
    CAST(d AS DOUBLE) / n AS loan_int_rate,
    CASE WHEN rf = 'R' THEN 'Y' ELSE 'N' END AS cb_person_default_on_file,
    CAST(2 + c_custkey % 17 + CASE WHEN c_custkey % 53 = 0 THEN 30 ELSE 0 END AS INT) AS cb_person_cred_hist_length
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
loan_book AS (
  SELECT *,
    CASE WHEN person_income > 0 THEN ROUND(CAST(loan_amnt AS DOUBLE) / person_income, 2) END AS loan_percent_income,
    CASE WHEN loan_amnt > 0.5 * person_income OR loan_id % 20 = 0 THEN 1 ELSE 0 END AS loan_status
  FROM lb_base)"""
