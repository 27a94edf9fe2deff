"""loan_book against the measurements recorded in FIXTURES.md (sf0.001)."""

from pyspark.sql import functions as F

from creditspark.operators import features as Fe
from creditspark.plans import prepare as PR
from creditspark.sources import loan_book

from .conftest import SF_SMALL


def test_loan_book_fixture_counts(spark):
    lb = loan_book(spark, SF_SMALL)
    r = lb.agg(F.count(F.lit(1)).alias("n"), F.avg("loan_status").alias("share"),
               F.count_if(F.col("person_age") >= 100).alias("old"),
               F.count_if(F.col("person_income") <= 0).alias("no_income"),
               F.count_if(F.col("person_emp_length").isNull()).alias("emp_null"),
               F.count_if(F.col("loan_int_rate").isNull()).alias("rate_null")).first()
    assert (r["n"], round(r["share"], 3), r["old"], r["no_income"], r["emp_null"], r["rate_null"]) == \
        (1500, 0.379, 17, 106, 41, 27)
    bins = Fe.discretize(lb, drop_source=False)
    inc = {x["income_group"]: x["count"] for x in bins.groupBy("income_group").count().collect()}
    amt = {x["loan_amount_group"]: x["count"] for x in bins.groupBy("loan_amount_group").count().collect()}
    assert [inc[k] for k in Fe.INCOME_LABELS] == [350, 268, 278, 304, 194]
    assert [amt[k] for k in Fe.AMOUNT_LABELS] == [249, 236, 222, 793]


def test_iqr_fence_fixture(spark):
    imputed, q = PR.impute_loans(loan_book(spark, SF_SMALL), {"cb_person_cred_hist_length": [0.25, 0.75]})
    q1, q3 = q["cb_person_cred_hist_length"]
    assert q3 + 1.5 * (q3 - q1) == 26.0
    kept = imputed.where(F.col("cb_person_cred_hist_length").between(q1 - 1.5 * (q3 - q1), 26.0)).count()
    assert imputed.count() - kept == 28
