"""Queries over scheme and department finance: exact decimals, missing stays missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import markup, money
from ledgerloom.sources.ledger import Ledger, with_tables


def _variance(df):
    known = F.col("allocated_inr").isNotNull() & F.col("released_inr").isNotNull() & F.col("utilized_inr").isNotNull()
    return df.select(
        "*",
        money.minus(F.col("released_inr"), F.col("utilized_inr")).alias("release_variance_inr"),
        money.minus(F.col("allocated_inr"), F.col("utilized_inr")).alias("allocation_variance_inr"),
        F.when(known, "complete").otherwise("insufficient_data").alias("status"),
    )


def scheme_variance(spark, sf_dir):
    """Every finance row with its variances; null, and said to be insufficient, where a stage is not published."""
    return _variance(Ledger(spark, sf_dir).scheme_finance.drop("department_id"))


def department_years(spark, sf_dir):
    """Department years, newest first: sums, the sum of schemes as an alternate, and how many schemes lack expenditure."""
    f = Ledger(spark, sf_dir).scheme_finance
    total = lambda c: F.sum(c).cast("decimal(30,2)")
    years = f.groupBy("department_id", "fiscal_year").agg(
        total("allocated_inr").alias("allocated_inr"), total("released_inr").alias("released_inr"),
        F.when(F.count_if(F.col("utilized_inr").isNull()) == 0, total("utilized_inr")).alias("utilized_inr"),
        F.countDistinct("scheme_id").alias("scheme_count"), F.count_if(F.col("utilized_inr").isNull()).alias("missing_expenditure"),
    )
    alternate = f.where("utilized_inr IS NOT NULL").groupBy("department_id", "fiscal_year").agg(total("allocated_inr").alias("allocated_alternate_inr"))
    joined = years.join(alternate, ["department_id", "fiscal_year"], "left")
    variance = (F.col("released_inr") - F.col("utilized_inr")).cast("decimal(31,2)").alias("release_variance_inr")
    return joined.select("*", variance, F.when(F.col("missing_expenditure") > 0, "insufficient_data").otherwise("complete").alias("status")).orderBy("department_id", F.desc("fiscal_year"))


def budget_departments(spark, sf_dir):
    """Departments that have finance, the newest year, and whether any amount is missing, for each state of suppliers."""
    x = Ledger(spark, sf_dir)
    home = x.raw("supplier").join(x.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("department_id"), (F.col("n_regionkey") + 1).cast("long").alias("state_id"))
    by_department = x.scheme_finance.groupBy("department_id").agg(F.max("fiscal_year").alias("newest"), F.bool_or(F.col("utilized_inr").isNull()).alias("any_missing"))
    return by_department.join(home, "department_id").groupBy("state_id").agg(F.countDistinct("department_id").alias("departments"), F.max("newest").alias("newest_year"), F.bool_or("any_missing").alias("any_missing"))


def amounts_to_paise(spark, sf_dir):
    """Each line's price printed in rupees, lakh and crore and read back to exact paise, and shown again."""
    price = F.col("allocated_inr").cast("string")
    rows = markup.bound(Ledger(spark, sf_dir).scheme_finance, ["object_code"], digits=price)
    read = lambda unit: money.amount_to_paise(F.col("digits"), F.lit(unit))
    rupees = money.rupees_to_paise(F.concat(F.lit("₹ "), F.col("digits")))
    rows = markup.bound(rows, ["object_code", "digits"], rupees_paise=rupees, lakh_paise=read("lakh"), crore_paise=read("crore"), thousand_paise=read("thousand"))
    return rows.select(
        "object_code", "rupees_paise", "lakh_paise", "crore_paise", money.decimal_string(F.col("crore_paise")).alias("crore_rupees"), money.to_rupees(F.col("thousand_paise")).alias("thousand_inr"),
        money.amount_to_paise(F.col("digits"), F.lit(None).cast("string")).alias("bare_refused"),
    )


def pair_figures(spark, sf_dir):
    """Figures of an order stated in both halves (shipped early, shipped late): paired if each half states the value once."""
    f = Ledger(spark, sf_dir).raw("lineitem")
    half = F.when(F.month("l_shipdate") <= 6, "a").otherwise("b")
    groups = f.groupBy("l_orderkey", F.col("l_quantity").cast("long").alias("value")).agg(F.count_if(half == "a").alias("in_a"), F.count_if(half == "b").alias("in_b"))
    kind = F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), "paired").when((F.col("in_a") > 0) & (F.col("in_b") > 0), "ambiguous").otherwise("unpaired")
    return groups.groupBy(kind.alias("kind")).agg(F.count("*").alias("figures"))


def budget_bands(spark, sf_dir):
    """Values in fixed bands, and nearest-rank median and third quartile, by event type."""
    e = Ledger(spark, sf_dir).raw("events")
    banded = e.groupBy("event_type", money.count_bucket(F.col("value")).alias("band")).agg(F.count("*").alias("n"))
    ranks = e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY value)").alias("p75"))
    return banded.join(ranks, "event_type")


QUERIES = [scheme_variance, department_years, budget_departments, amounts_to_paise, pair_figures, budget_bands]

SQL = {
    "scheme_variance": with_tables("""SELECT scheme_id, fiscal_year, object_code, allocated_inr, released_inr, utilized_inr,
  CAST(released_inr - utilized_inr AS DECIMAL(21,2)) AS release_variance_inr, CAST(allocated_inr - utilized_inr AS DECIMAL(21,2)) AS allocation_variance_inr,
  CASE WHEN allocated_inr IS NULL OR released_inr IS NULL OR utilized_inr IS NULL THEN 'insufficient_data' ELSE 'complete' END AS status FROM scheme_finance""", "scheme_finance"),
    "department_years": with_tables("""SELECT department_id, fiscal_year, CAST(sum(allocated_inr) AS DECIMAL(30,2)) AS allocated_inr, CAST(sum(released_inr) AS DECIMAL(30,2)) AS released_inr,
  CASE WHEN count(*) FILTER (WHERE utilized_inr IS NULL) = 0 THEN CAST(sum(utilized_inr) AS DECIMAL(30,2)) END AS utilized_inr, count(DISTINCT scheme_id) AS scheme_count,
  count(*) FILTER (WHERE utilized_inr IS NULL) AS missing_expenditure, CAST(sum(allocated_inr) FILTER (WHERE utilized_inr IS NOT NULL) AS DECIMAL(30,2)) AS allocated_alternate_inr,
  CASE WHEN count(*) FILTER (WHERE utilized_inr IS NULL) = 0 THEN CAST(sum(released_inr) - sum(utilized_inr) AS DECIMAL(31,2)) END AS release_variance_inr,
  CASE WHEN count(*) FILTER (WHERE utilized_inr IS NULL) > 0 THEN 'insufficient_data' ELSE 'complete' END AS status FROM scheme_finance GROUP BY 1, 2""", "scheme_finance"),
    "budget_departments": with_tables("""SELECT CAST(n_regionkey + 1 AS BIGINT) AS state_id, count(DISTINCT department_id) AS departments, max(fiscal_year) AS newest_year, bool_or(utilized_inr IS NULL) AS any_missing
FROM scheme_finance JOIN supplier ON s_suppkey = department_id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""", "scheme_finance"),
    "amounts_to_paise": with_tables("""SELECT object_code, CAST(allocated_inr * 100 AS DECIMAL(38,0)) AS rupees_paise, CAST(allocated_inr * 100 AS DECIMAL(28,0)) * 100000 AS lakh_paise, CAST(allocated_inr * 100 AS DECIMAL(28,0)) * 10000000 AS crore_paise,
  CAST(CAST(allocated_inr * 100 AS DECIMAL(28,0)) * 100000 AS VARCHAR) || '.00' AS crore_rupees, CAST(allocated_inr * 1000 AS DECIMAL(20,2)) AS thousand_inr, CAST(NULL AS DECIMAL(38,0)) AS bare_refused FROM scheme_finance""", "scheme_finance"),
    "pair_figures": """SELECT CASE WHEN a = 1 AND b = 1 THEN 'paired' WHEN a > 0 AND b > 0 THEN 'ambiguous' ELSE 'unpaired' END AS kind, count(*) AS figures FROM (
  SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS v, count(*) FILTER (WHERE month(l_shipdate) <= 6) AS a, count(*) FILTER (WHERE month(l_shipdate) > 6) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
    "budget_bands": """SELECT event_type, band, n, median, p75 FROM (SELECT event_type, CASE WHEN value IS NULL OR isnan(value) OR value <= 0 THEN '0' WHEN value <= 3 THEN '1-3' WHEN value <= 10 THEN '4-10' WHEN value <= 50 THEN '11-50' ELSE '51+' END AS band, count(*) AS n FROM events GROUP BY 1, 2)
JOIN (SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS p75 FROM events GROUP BY 1) USING (event_type)""",
}
