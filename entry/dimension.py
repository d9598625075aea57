"""Queries that join reference tables, correct records and profile columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from personyear.operators import joins
from personyear.operators.aggregate import match_rate as rates
from personyear.operators.aggregate import null_profile as nulls
from personyear.operators.sets import distinct_dimension as prepared
from personyear.operators.sets import extra_columns, sample_groups as sampled, union_labeled

from .panels import table, tidy


def _nation(spark, folder):
    return table(spark, folder, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("nation"), "n_name")


def left_join_dimension(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("home"))
    known = _nation(spark, folder).where("nation is null or nation < 20")
    return tidy(joins.attach(customer, known, {"home": "nation"}, keep_keys=True))


def natural_join(spark, folder):
    supplier = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_nationkey") % 5).alias("area")
    )
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("area"), "n_name"
    )
    return tidy(joins.attach_common(supplier, nation))


def regex_join(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    words = F.split("p_name", " ")
    nouns = part.select(F.get(words, F.lit(1)).alias("rule")).distinct()
    starts = part.select(F.concat(F.lit("^"), F.get(words, F.lit(0)), F.lit(" .*t$")).alias("rule")).distinct()
    rules = nouns.unionByName(starts).where("rule <> 'ring'")
    return joins.attach_by_pattern(part, "p_name", rules, "rule").select("p_partkey", "rule")


def _bucket(name):
    return F.floor(F.col(name) / 100).alias("bucket")


def _suppliers(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), _bucket("s_acctbal"), "s_name")


def _customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), _bucket("c_acctbal"))


def unique_key_join(spark, folder):
    return tidy(joins.attach_unique(_customers(spark, folder), _suppliers(spark, folder), ["nation", "bucket"]))


def join_guard(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return joins.attach_checked(orders, customer, ["c_custkey"])


def fallback_match(spark, folder):
    unique = joins.unique_rows(_suppliers(spark, folder), ["nation", "bucket"]).withColumnRenamed("s_name", "label")
    # Some first hits have no label, and nations with negative balances alone are not listed.
    unique = unique.withColumn("label", F.when(F.col("nation") % 3 != 0, F.col("label")))
    listed = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top")).where("top > 0")
    nation = (
        table(spark, folder, "nation")
        .join(listed, F.col("n_nationkey") == F.col("s_nationkey"))
        .select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("label"))
    )
    passes = [(unique, ["nation", "bucket"]), (nation, {"nation": "place"})]
    first = joins.attach_first_match(_customers(spark, folder), passes, ["label"], source="pass").select(
        "c_custkey", "label", "pass"
    )
    filled = joins.attach_first_match(_customers(spark, folder), passes, ["label"], per_column=True)
    return tidy(first.join(filled.select("c_custkey", F.col("label").alias("filled")), "c_custkey"))


def apply_corrections(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    open_orders = orders.where("o_orderstatus = 'P'")
    fixed = open_orders.select("o_orderkey", "o_custkey", F.lit("corrected").alias("note"))
    return joins.correct(orders, open_orders.select("o_custkey", "o_orderkey"), fixed)


def sample_groups(spark, folder):
    return tidy(sampled(table(spark, folder, "part"), "p_brand", "p_partkey", 5, 351129))


def distinct_dimension(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return prepared(part, F.col("p_type") != "SMALL", {"p_name": F.upper("p_name")}, ["p_partkey", "p_brand"])


def _parties(spark, folder):
    return {
        "customer": table(spark, folder, "customer").select(
            F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
        ),
        "supplier": table(spark, folder, "supplier").select(
            F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        ),
    }


def union_by_name(spark, folder):
    return tidy(union_labeled(_parties(spark, folder), "source"))


def match_rate(spark, folder):
    return tidy(rates(unique_key_join(spark, folder), ["s_name"], ["nation"]))


def null_profile(spark, folder):
    rows = union_labeled(_parties(spark, folder), "source")
    overall = nulls(rows).withColumn("source", F.lit("all"))
    return tidy(overall.select("source", "var", "pct_na").unionByName(nulls(rows, "source")))


KNOWN = ["l_orderkey", "o_orderkey", "l_quantity", "o_totalprice"]


def schema_diff(spark, folder):
    """Columns beyond the known ones, with the number of records that fill them."""
    frames = {name: table(spark, folder, name) for name in ("orders", "lineitem")}
    extra = extra_columns(spark, {name: frame.columns for name, frame in frames.items()}, KNOWN)
    filled = {
        name: frame.agg(*[F.count(column).alias(column) for column in frame.columns]).unpivot(
            [], frame.columns, "column", "filled"
        )
        for name, frame in frames.items()
    }
    return extra.join(union_labeled(filled, "source"), ["source", "column"])


QUERIES = {
    "left_join_dimension": left_join_dimension,
    "natural_join": natural_join,
    "regex_join": regex_join,
    "unique_key_join": unique_key_join,
    "join_guard": join_guard,
    "fallback_match": fallback_match,
    "apply_corrections": apply_corrections,
    "sample_groups": sample_groups,
    "distinct_dimension": distinct_dimension,
    "union_labeled": union_by_name,
    "match_rate": match_rate,
    "null_profile": null_profile,
    "schema_diff": schema_diff,
}

_UNIQUE = """
u AS (SELECT nation, bucket, max(s_name) AS s_name FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(floor(s_acctbal / 100) AS BIGINT) AS bucket, s_name FROM supplier)
  GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, CAST(floor(c_acctbal / 100) AS BIGINT) AS bucket FROM customer),
j AS (SELECT c.*, u.s_name FROM c LEFT JOIN u USING (nation, bucket))"""

_PARTIES = """
rows AS (SELECT 'customer' AS source, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
  UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL, s_acctbal FROM supplier)"""

_NULLS = " UNION ALL ".join(
    f"SELECT {{source}} AS source, '{name}' AS var, round(avg(CAST({name} IS NULL AS INT)), 6) AS pct_na FROM rows {{group}}"
    for name in ("name", "nation", "segment", "balance")
)

_COLUMNS = {
    "orders": "o_custkey o_orderstatus o_orderdate o_orderpriority".split(),
    "lineitem": (
        "l_partkey l_suppkey l_linenumber l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
    ).split(),
}

SQL = {
    "left_join_dimension": """
SELECT c_custkey, CAST(nullif(c_nationkey, 3) AS BIGINT) AS home, CAST(nation AS BIGINT) AS nation, n_name FROM customer
LEFT JOIN (SELECT nullif(n_nationkey, 3) AS nation, n_name FROM nation WHERE n_nationkey < 20)
ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nation""",
    "natural_join": """
SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation, CAST(s_nationkey % 5 AS BIGINT) AS area, n_name FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey AND s_nationkey % 5 = n_regionkey""",
    "regex_join": """
WITH rules AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS rule FROM part UNION SELECT '^' || split_part(p_name, ' ', 1) || ' .*t$' FROM part)
SELECT p_partkey, rule FROM part LEFT JOIN (SELECT * FROM rules WHERE rule <> 'ring') ON regexp_matches(p_name, rule)""",
    "unique_key_join": f"WITH {_UNIQUE} SELECT * FROM j",
    "join_guard": "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "fallback_match": f"""WITH {_UNIQUE},
k AS (SELECT c_custkey, s_name, CASE WHEN nation % 3 <> 0 THEN s_name END AS one, n_name AS two FROM j
  LEFT JOIN (SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING max(s_acctbal) > 0))
  ON nation = n_nationkey)
SELECT c_custkey, CASE WHEN s_name IS NOT NULL THEN one ELSE two END AS label, coalesce(one, two) AS filled,
  CAST(CASE WHEN s_name IS NOT NULL THEN 1 WHEN two IS NOT NULL THEN 2 END AS BIGINT) AS pass FROM k""",
    "apply_corrections": """
SELECT o_orderkey, o_custkey, o_orderstatus, NULL AS note FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, o_custkey, NULL, 'corrected' FROM orders WHERE o_orderstatus = 'P'""",
    "sample_groups": """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part
WHERE p_brand IN (SELECT p_brand FROM part ORDER BY md5('351129:' || p_partkey) LIMIT 5)""",
    "distinct_dimension": "SELECT DISTINCT upper(p_name) AS p_name, p_type FROM part WHERE p_type <> 'SMALL'",
    "union_labeled": f"WITH {_PARTIES} SELECT source, name, nation, segment, round(balance, 6) AS balance FROM rows",
    "match_rate": f"WITH {_UNIQUE} SELECT nation, count(*) AS n, round(avg(CAST(s_name IS NOT NULL AS INT)), 6) AS rate_s_name FROM j GROUP BY 1",
    "null_profile": f"WITH {_PARTIES} " + _NULLS.format(source="'all'", group="")
    + " UNION ALL SELECT 'all', 'source', 0.0::DOUBLE UNION ALL " + _NULLS.format(source="source", group="GROUP BY source"),
    "schema_diff": " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{column}' AS \"column\", count({column}) AS filled FROM {source}"
        for source, columns in _COLUMNS.items()
        for column in columns
    ),
}
