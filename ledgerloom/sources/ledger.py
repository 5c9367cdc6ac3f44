"""The ledger's tables, derived by Spark from the given star-schema tables.

Every table is a lazy DataFrame with explicit types. The same derivations are written as SQL in
``SQL_TABLES``, so that a query and its oracle read one definition each of the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the instant at which "open" and "stale" are judged; nothing reads a wall clock.
AS_OF = "1998-01-01 00:00:00"
LEVELS = ("country", "state", "district", "sub_district", "village")
METHODS = ("chain_unit", "office_code", "location_district", "pincode", "place_name")
INFERRED = ("location_district", "pincode", "place_name", "manual")


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


class Ledger:
    """The tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def admin_unit(self) -> DataFrame:
        """id, level, lgd_code, name_en, parent_id: regions as states, nations as districts, customers as sub-districts."""
        unit = lambda df, id_, level, code, name, parent: df.select(F.expr(id_).cast("long").alias("id"), F.lit(level).alias("level"), F.expr(code).cast("string").alias("lgd_code"), F.col(name).alias("name_en"), F.expr(parent).cast("long").alias("parent_id"))
        states = unit(self.raw("region"), "r_regionkey + 1", "state", "r_regionkey", "r_name", "null")
        return states.unionByName(self.districts).unionByName(unit(self.raw("customer"), "100000 + c_custkey", "sub_district", "c_custkey", "c_name", "1000 + c_nationkey"))

    @cached_property
    def districts(self) -> DataFrame:
        n = self.raw("nation")
        return n.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.lit("district").alias("level"), F.col("n_nationkey").cast("string").alias("lgd_code"), F.col("n_name").alias("name_en"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))

    @cached_property
    def states(self) -> DataFrame:
        return self.admin_unit.where("level = 'state'")

    @cached_property
    def tender(self) -> DataFrame:
        """Orders as tenders: closing 30 days after the order, placed in the customer's district unless it is unplaced."""
        o, c = self.raw("orders"), self.raw("customer").select("c_custkey", "c_nationkey")
        placed = F.when(F.col("o_custkey") % 7 != 0, F.col("c_nationkey") + 1000).cast("long")
        method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Tender "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("title"),
            F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string")).alias("portal_code"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("closing_at"),
            F.col("o_orderpriority").alias("department"),
            F.col("o_orderstatus").alias("tender_category"),
            (F.col("o_totalprice").cast("decimal(20,2)") * 100).cast("decimal(38,0)").alias("tender_value_paise"),
            placed.alias("admin_unit_id"),
            F.when(placed.isNotNull(), method).alias("district_source"),
            (F.lit(100000) + F.col("o_custkey")).cast("long").alias("issuer_id"),
            F.col("o_orderdate").alias("first_seen_at"),
        )

    @cached_property
    def scheme_finance(self) -> DataFrame:
        """Lines as scheme finance: allocated, released, and utilised, which open lines have not published."""
        price = F.col("l_extendedprice").cast("decimal(20,2)")
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("scheme_id"),
            F.col("l_suppkey").alias("department_id"),
            F.year("l_shipdate").alias("fiscal_year"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("object_code"),
            price.alias("allocated_inr"),
            F.round(price * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(20,2)").alias("released_inr"),
            F.when(F.col("l_returnflag") != "N", F.round(price * (1 - F.col("l_tax").cast("decimal(4,2)")), 2).cast("decimal(20,2)")).alias("utilized_inr"),
        )

    @cached_property
    def document(self) -> DataFrame:
        """Documents with their review status: labelled ones are decided, toxic ones rejected, others await review."""
        d, lab = self.raw("documents"), self.raw("labels")
        status = F.when(F.col("quality").isNull(), "unverified").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "verified").otherwise("corrected")
        return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), "source", "lang", "text", (F.col("doc_id") % 5 + 1).cast("long").alias("state_id"), status.alias("verification_status"))

    @cached_property
    def observation(self) -> DataFrame:
        """Events as sightings of a portal (the user): what was seen, when, and the value it stated."""
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("ts").alias("seen_at"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("portal_code"), "event_type", F.col("value").cast("decimal(20,2)").alias("stated_inr"), "props")


#: The same tables for DuckDB, each a common table expression.
SQL_TABLES = {
    "admin_unit": """SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 'state' AS level, CAST(r_regionkey AS VARCHAR) AS lgd_code, r_name AS name_en, CAST(NULL AS BIGINT) AS parent_id FROM region
  UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), 'district', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey + 1 AS BIGINT) FROM nation
  UNION ALL SELECT 100000 + c_custkey, 'sub_district', CAST(c_custkey AS VARCHAR), c_name, CAST(1000 + c_nationkey AS BIGINT) FROM customer""",
    "tender": """SELECT o_orderkey AS id, 'Tender ' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS title, 'p' || (o_custkey % 10) AS portal_code,
    CASE WHEN o_orderkey % 11 != 0 THEN o_orderdate + INTERVAL 30 DAY END AS closing_at, o_orderpriority AS department, o_orderstatus AS tender_category,
    CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 100 AS DECIMAL(38,0)) AS tender_value_paise,
    CASE WHEN o_custkey % 7 != 0 THEN CAST(1000 + c_nationkey AS BIGINT) END AS admin_unit_id,
    CASE WHEN o_custkey % 7 != 0 THEN ['chain_unit', 'office_code', 'location_district', 'pincode', 'place_name'][o_orderkey % 5 + 1] END AS district_source,
    100000 + o_custkey AS issuer_id, o_orderdate AS first_seen_at
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "scheme_finance": """SELECT l_partkey AS scheme_id, l_suppkey AS department_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, l_orderkey || '-' || l_linenumber AS object_code,
    CAST(l_extendedprice AS DECIMAL(20,2)) AS allocated_inr,
    CAST(round(CAST(l_extendedprice AS DECIMAL(20,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(20,2)) AS released_inr,
    CASE WHEN l_returnflag != 'N' THEN CAST(round(CAST(l_extendedprice AS DECIMAL(20,2)) * (1 - CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(20,2)) END AS utilized_inr
  FROM lineitem""",
    "document": """SELECT d.doc_id AS id, d.source, d.lang, d.text, CAST(d.doc_id % 5 + 1 AS BIGINT) AS state_id,
    CASE WHEN l.quality IS NULL THEN 'unverified' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'verified' ELSE 'corrected' END AS verification_status
  FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "observation": "SELECT event_id AS id, ts AS seen_at, 'p' || user_id AS portal_code, event_type, CAST(value AS DECIMAL(20,2)) AS stated_inr, props FROM events",
}


def with_tables(body: str, *names: str) -> str:
    """SQL over the derived tables that it names; the body may begin with further common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL_TABLES[n]})" for n in names) + f"\n{body}"
