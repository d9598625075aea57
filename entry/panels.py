"""Person-year panels derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from personyear.functions.labels import flag_text, member
from personyear.functions.numbers import half_even_bucket
from personyear.operators.windows import collapse

HIGH = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long and doubles with six digits, as the SQL states them."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("long")
        elif isinstance(field.dataType, T.DecimalType):
            value = value.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pay records: several per person and year."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("position"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("salary"),
        "o_orderkey",
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, F.col("id") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("state"), "id", "year", "position", "status", "salary", "o_orderkey")
    )


def customer_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and year: the dearest order, with all prices summed."""
    records = customer_orders(spark, folder).withColumn("price", F.col("salary"))
    kept = collapse(
        records.drop("status"), ["state", "id", "year"], [F.col("price"), F.col("o_orderkey")], totals=["salary"]
    )
    return kept.withColumn("teacher", flag_text(member("position", HIGH))).drop("price")


CUSTOMER_ORDERS_SQL = """
pay AS (
  SELECT n_name AS state, o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year,
         o_orderpriority AS position, o_orderstatus AS status, o_totalprice AS salary, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CUSTOMER_PANEL_SQL = CUSTOMER_ORDERS_SQL + """,
panel AS (
  SELECT state, id, year, position, total AS salary, o_orderkey,
         CASE WHEN position IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'TRUE' ELSE 'FALSE' END AS teacher
  FROM (SELECT *, sum(salary) OVER (PARTITION BY state, id, year) AS total,
               row_number() OVER (PARTITION BY state, id, year ORDER BY salary DESC, o_orderkey DESC) AS rn
        FROM pay) WHERE rn = 1)"""


def district_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as persons, nations of their customers as districts of regions.

    One row per supplier, nation and year; flagged if any line was kept.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("NCES_leaid"), F.col("r_name").alias("state")
    )
    kept = F.max((F.col("l_returnflag") != "R").cast("int"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("state", "NCES_leaid", F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"))
        .agg(F.when(kept == 1, "TRUE").otherwise("FALSE").alias("teacher"))
    )


DISTRICT_PANEL_SQL = """
panel AS (
  SELECT r_name AS state, n_name AS NCES_leaid, l_suppkey AS id, CAST(year(l_shipdate) AS BIGINT) AS year,
         CASE WHEN max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) = 1 THEN 'TRUE' ELSE 'FALSE' END AS teacher
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


def link_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Named persons: customers in the years they order, with the words of a part as name.

    Last names lose a letter in odd years for some persons; the official id is known.
    """
    seen = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    part = table(spark, folder, "part")
    words = F.split("p_name", " ")
    last = F.concat(F.get(words, F.lit(1)), F.lower("p_type"))
    typo = ((F.col("year") % 2) == 1) & ((F.col("c_custkey") % 7) == 0)
    salary = F.col("p_retailprice") * 50 + 200 * (F.col("year") - 1995)
    return (
        seen.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("c_custkey") == F.col("p_partkey"))
        .select(
            F.col("n_name").alias("state"),
            "year",
            (F.col("c_custkey") * 10 + F.col("year") - 1995).alias("index"),
            F.col("c_custkey").cast("string").alias("source_id"),
            F.get(words, F.lit(0)).alias("name_first"),
            F.when(F.col("p_size") % 3 != 0, F.substring(F.lower("p_type"), 1, 1)).alias("name_middle"),
            F.when(typo, F.expr("left({0}, length({0}) - 1)".format("concat(get(split(p_name, ' '), 1), lower(p_type))")))
            .otherwise(last)
            .alias("name_last"),
            F.when(F.col("p_size") % 10 == 0, "jr").alias("name_other"),
            F.lower("c_mktsegment").alias("position"),
            F.col("p_brand").alias("NCES_leaid"),
            F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("FALSE").alias("teacher"),
            salary.alias("salary"),
            half_even_bucket(salary, 5000).alias("round_salary"),
        )
    )


LINK_PANEL_SQL = """
panel AS MATERIALIZED (
  SELECT *, round_even(salary / 5000.0, 0) * 5000.0 AS round_salary FROM (
  SELECT n_name AS state, year, c_custkey * 10 + year - 1995 AS index, CAST(c_custkey AS VARCHAR) AS source_id,
         split_part(p_name, ' ', 1) AS name_first,
         CASE WHEN p_size % 3 <> 0 THEN lower(p_type)[1] END AS name_middle,
         CASE WHEN year % 2 = 1 AND c_custkey % 7 = 0
              THEN (split_part(p_name, ' ', 2) || lower(p_type))[:-2]
              ELSE split_part(p_name, ' ', 2) || lower(p_type) END AS name_last,
         CASE WHEN p_size % 10 = 0 THEN 'jr' END AS name_other,
         lower(c_mktsegment) AS position, p_brand AS NCES_leaid,
         CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS teacher,
         p_retailprice * 50 + 200 * (year - 1995) AS salary
  FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders)
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN part ON p_partkey = c_custkey))"""

# Years that the generated SQL spells out; the queries take theirs from the data.
YEARS = list(range(1995, 2002))


def order_years(spark: SparkSession, folder: str) -> list[int]:
    """The years in which there are orders, at most one number per year."""
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return sorted(row.year for row in years.collect() if row.year is not None)


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select
