"""Queries that write extracts of the given tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personyear.functions.labels import keyword_flag
from personyear.operators.joins import stitch
from personyear.operators.project import clean_headers, clean_names
from personyear.operators.reshape import unpivot_aliases as long_aliases
from personyear.operators.reshape import unpivot_years as long_years
from personyear.operators.sets import union_labeled
from personyear.plans import compile as compiling
from personyear.plans.standardize import Collapse, District, SourceSpec, standardize
from personyear.session import new_folder
from personyear.sources import delimited, fixed_width, snapshots

from .panels import CUSTOMER_PANEL_SQL, customer_panel, order_years, table, tidy, with_sql


def _csv(df: DataFrame, label: str) -> str:
    path = new_folder(df.sparkSession, label)
    df.write.option("header", True).csv(path)
    return path


def _pay(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("pay"),
        F.when(F.col("o_orderstatus") == "P", "NDR").otherwise(F.col("o_orderpriority")).alias("position"),
        F.year("o_orderdate").alias("year"),
    )


def scan_csv_typed(spark, folder):
    """The same extract read four ways: schema, text, type letters, below title lines."""
    path = _csv(_pay(spark, folder), "pay")
    text = delimited.read_csv(spark, path, na="NDR")
    wanted = {"o_orderkey": "number", "pay": "money", "position": "text", "year": "number", "absent": "text"}
    typed = delimited.read_columns(text, wanted)
    lettered = delimited.read_csv(
        spark, path, delimited.compact_schema(["o_orderkey", "pay", "position", "year"], "dccd"), na="NDR"
    )
    inferred = delimited.read_csv(spark, path, na="NDR", infer=True)
    below = delimited.read_csv_below(spark, _titled(_pay(spark, folder)), skip=2, na="NDR")
    counted = {"letters": lettered, "inferred": inferred, "below": below, "columns": typed}
    summaries = {
        name: frame.agg(
            F.count("*").alias("n"),
            F.sum(F.col("o_orderkey").cast("double")).alias("keys"),
            F.count("position").alias("positions"),
            F.sum(F.col("year").cast("double")).alias("years"),
            (F.lit(None).cast("double") if name != "columns" else F.round(F.sum("pay"), 2)).alias("pay"),
        )
        for name, frame in counted.items()
    }
    return tidy(union_labeled(summaries, "scan"))


def _titled(df: DataFrame) -> str:
    """CSV text files that each begin with two title lines and end lines with a comma."""
    path = new_folder(df.sparkSession, "titled")
    quoted = [F.concat(F.lit('"'), F.col(name).cast("string"), F.lit('"')) for name in df.columns]
    lines = df.select("year", F.concat(F.concat_ws(",", *quoted), F.lit(",")).alias("line"))
    heads = [(0, "Staff report"), (1, ""), (2, ",".join(df.columns) + ",")]
    head = F.array(*[F.struct(F.lit(place).alias("place"), F.lit(line).alias("line")) for place, line in heads])
    titles = df.select("year").distinct().select("year", F.explode(head).alias("head"))
    # A year is several files, so that no task writes a whole year; each has its own titles.
    parts = F.pmod(F.xxhash64("line"), F.lit(4)).cast("int")
    spread = lines.withColumn("part", parts)
    heads = titles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3))))
    heads = heads.join(spread.select("year", "part").distinct(), ["year", "part"], "left_semi")
    body = spread.select("year", "part", F.lit(3).alias("place"), "line").unionByName(
        heads.select("year", "part", "head.place", "head.line")
    )
    ordered = body.repartition("year", "part").sortWithinPartitions("year", "part", "place")
    ordered.select("year", "part", F.col("line").alias("value")).write.partitionBy("year", "part").text(path)
    return path


def scan_dir_union(spark, folder):
    """Two vintages with different headers in one folder tree."""
    base = new_folder(spark, "vintages")
    pay = _pay(spark, folder)
    old = pay.where("year < 1998").select("o_orderkey", "pay")
    new = pay.where("year >= 1998").select("o_orderkey", F.col("pay").alias("Total Pay"), "position")
    old.write.option("header", True).csv(f"{base}/kind=a")
    new.write.option("header", True).csv(f"{base}/kind=b")
    new.write.option("header", True).csv(f"{base}/draft")
    rows = delimited.read_csv_folder(spark, base, recursive=True, label="path", without="/draft/")
    keyed = rows.withColumn("kind", delimited.path_key(F.col("path"), "kind")).drop("path")
    return tidy(keyed.withColumn("o_orderkey", F.col("o_orderkey").cast("long")))


def scan_file_year(spark, folder):
    """Spring year from folder names written as fiscal years and as school years."""
    pay = _pay(spark, folder).select("o_orderkey", "year")
    fiscal = new_folder(spark, "fiscal")
    pay.withColumn("vintage", F.format_string("FY%02d", F.col("year") - 1995)).drop("year").write.partitionBy(
        "vintage"
    ).option("header", True).csv(fiscal)
    ranged = new_folder(spark, "ranged")
    for year in order_years(spark, folder):
        pay.where(F.col("year") == year).select("o_orderkey").write.option("header", True).csv(
            f"{ranged}/{year - 1}-{year}"
        )
    one = delimited.with_file_year(delimited.read_csv(spark, fiscal, recursive=True), "fiscal", folder=True)
    two = delimited.with_file_year(delimited.read_csv(spark, ranged, recursive=True), "leading", folder=True)
    rows = union_labeled({"fiscal": one, "leading": two}, "rule")
    return tidy(rows.select("rule", F.col("o_orderkey").cast("long").alias("o_orderkey"), "year"))


def scan_fixed_width(spark, folder):
    customer = table(spark, folder, "customer")
    line = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 12, " "),
        F.rpad("c_name", 24, " "),
        F.lpad(F.col("c_nationkey").cast("string"), 3, " "),
        F.col("c_mktsegment"),
    )
    path = new_folder(spark, "fixed")
    customer.select(line.alias("value")).write.text(path)
    slots = fixed_width.layout([("Cust Key", 1, 12), ("Name.", 13, 20), ("Nation", 37, 3), ("Segment", 40, 5)])
    rows = fixed_width.read_fixed_width(spark, path, fixed_width.patch_length(slots, 13, 24))
    return tidy(rows.withColumn("cust_key", F.col("cust_key").cast("long")))


def roundtrip_partitioned(spark, folder):
    panel = customer_panel(spark, folder)
    path = new_folder(spark, "snapshot")
    snapshots.save_snapshot(panel, path, ["state"])
    snapshots.save_snapshot(panel.where("state = 'NATION_1'").withColumn("position", F.lower("position")), path, ["state"])
    return tidy(snapshots.load_snapshot(spark, path).select("state", "id", "year", "position", "salary"))


def export_by_state(spark, folder):
    """One folder of CSV files per state, read back as text with the state from the path."""
    path = new_folder(spark, "export")
    snapshots.export_csv(customer_panel(spark, folder).select("state", "id", "year", "teacher"), path)
    rows = delimited.read_csv_folder(spark, path, recursive=True, label="path")
    keyed = rows.withColumn("state", delimited.path_key(F.col("path"), "state"))
    return tidy(keyed.select("state", F.col("id").cast("long").alias("id"), F.col("year").cast("long").alias("year"), "teacher"))


def curated_roundtrip(spark, folder):
    """A dictionary written for curation, and the curated file cut to its first columns."""
    part = table(spark, folder, "part")
    counted = snapshots.label_dictionary(part, F.lower("p_type").alias("position"), F.col("p_brand").alias("brand"))
    path = new_folder(spark, "dictionary")
    snapshots.write_dictionary(counted.withColumn("remark", F.lit("by hand")), path)
    curated = snapshots.read_curated(spark, path, 3)
    return tidy(curated.withColumn("n", F.col("n").cast("long")))


def positional_stitch(spark, folder):
    """Orders split by columns into files in the same order, put back together by position."""
    orders = table(spark, folder, "orders").orderBy("o_orderkey")
    columns = (["o_orderkey"], ["o_custkey", "o_orderstatus"], ["o_orderpriority"])
    frames = [
        delimited.with_ordinal(delimited.read_csv(spark, _csv(orders.select(*names), "columns"))) for names in columns
    ]
    rows = stitch(frames).drop("ordinal")
    return rows.withColumns({name: F.col(name).cast("long") for name in ("o_orderkey", "o_custkey")})


def _wide(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("deid"),
        F.concat(F.lit("sum_wag_amt_"), F.year("o_orderdate").cast("string")).alias("name"),
        "o_totalprice",
    )
    return orders.groupBy("deid").pivot("name", [f"sum_wag_amt_{year}" for year in order_years(spark, folder)]).agg(F.sum("o_totalprice"))


def unpivot_years(spark, folder):
    return tidy(long_years(_wide(spark, folder), "sum_wag_amt", 13, 4, "year", "salary"))


def unpivot_aliases(spark, folder):
    customer = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_name").alias("X4"),
        F.when(F.col("c_nationkey") > 10, F.lower("c_name")).otherwise(F.col("c_name")).alias("X5"),
        F.when(F.col("c_nationkey") > 5, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("X6"),
    )
    return long_aliases(customer, ["c_custkey"], ["X4", "X5", "X6"], "X")


def normalize_headers(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_name", "c_mktsegment", "c_nationkey")
    messy = customer.toDF("Cust. Key", "Full Name", "FULL NAME", "Segment (Market)", "Nation/Code")
    return tidy(clean_headers(messy).withColumnRenamed("full_name.1", "full_name_1"))


STANDARD = SourceSpec(
    state="AMERICA",
    columns={
        "position": ["Job Title", "job"],
        "location": ["Agency"],
        "salary": ["Total Pay"],
        "salary_base": ["Base Pay"],
        "source_id": ["ID"],
        "record": ["Record"],
    },
    source="order records",
    names=("Employee Name", "any_order"),
    derived={"year": lambda df: F.col("Year").cast("int")},
    lower=("position", "location"),
    numbers=("salary_base",),
    money=("salary",),
    keep=lambda: F.col("position") != "5-low",
    once=Collapse(["source_id", "year"], ["salary_base", "record"], ["salary"], {"n_position": "position"}),
    teacher=lambda: keyword_flag("position", ["urgent", "high", "not"], ["specified"]),
    district=District(
        label=lambda df: F.upper("location"), drop=("year", "localid"), guard="checked"
    ),
)


def _raw_pay(spark, folder):
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    words = F.split("p_name", " ")
    rows = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("o_custkey") == F.col("p_partkey"))
    )
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.get(words, F.lit(1)), F.lit(" Jr, "), F.get(words, F.lit(0))))
    return rows.select(
        name.otherwise(F.concat(F.initcap("p_name"), F.lit(" II"))).alias("Employee Name"),
        F.col("o_orderpriority").alias("Job Title"),
        F.lower("n_name").alias("Agency"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total Pay"),
        F.col("o_totalprice").cast("string").alias("Base Pay"),
        F.col("o_custkey").cast("string").alias("ID"),
        F.col("o_orderkey").alias("Record"),
        F.year("o_orderdate").cast("string").alias("Year"),
    )


def _districts(spark, folder):
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.explode(F.array(F.lit(1999), F.lit(2000), F.lit(2017))).alias("year"),
        F.col("r_name").alias("state"),
        F.initcap("n_name").alias("NCES_name"),
        F.lit("regular").alias("NCES_type"),
        F.format_string("%07d", F.col("n_nationkey")).alias("NCES_leaid"),
        F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("localid"),
    )


def standardize_records(spark, folder):
    rows = standardize(_raw_pay(spark, folder), _districts(spark, folder), STANDARD)
    return tidy(
        rows.select(
            "source_id", "year", "name_first", "name_middle", "name_last", "name_other", "position", "teacher",
            "salary", "n_position", "record", "NCES_name", "NCES_type", "NCES_leaid", "state", "source",
        )
    )


def compile_master(spark, folder):
    """Two cleaned sources, a curated position list, and records with a district."""
    panel = customer_panel(spark, folder).withColumns(
        {"NCES_leaid": F.when(F.col("state") != "NATION_7", F.col("state")), "source_id": F.col("id").cast("string")}
    )
    first = panel.where("year < 1998").select(
        "state", "year", "source_id", "position", "teacher", "NCES_leaid", F.col("salary").alias("salary_base"),
        (F.col("salary") / 10).alias("salary_fringe"),
    )
    second = panel.where("year >= 1998").select(
        "state", "year", "source_id", F.upper("position").alias("position"), F.lit("kept").alias("source"),
        F.nullif("teacher", F.lit("FALSE")).alias("teacher"), "NCES_leaid",
        F.concat(F.lit("$"), F.format_number("salary", 2)).alias("salary"),
    )
    sources = {"old": first, "new": second}
    parts = {"old": ["salary_base", "salary_fringe"]}
    counted = compiling.position_dictionary(compiling.unite_sources(sources, parts))
    curated = counted.withColumn(
        "teacher_new", F.when(F.col("position") == "5-low", "TRUE").when(F.col("position") == "1-urgent", "FALSE")
    )
    done = compiling.compile_master(sources, curated, parts)
    return tidy(done.select("filename", "state", "year", "source_id", "position", "teacher", "salary", "NCES_leaid"))


QUERIES = {
    "scan_csv_typed": scan_csv_typed,
    "scan_dir_union": scan_dir_union,
    "scan_file_year": scan_file_year,
    "scan_fixed_width": scan_fixed_width,
    "roundtrip_partitioned": roundtrip_partitioned,
    "export_by_state": export_by_state,
    "curated_roundtrip": curated_roundtrip,
    "positional_stitch": positional_stitch,
    "unpivot_years": unpivot_years,
    "unpivot_aliases": unpivot_aliases,
    "normalize_headers": normalize_headers,
    "standardize_records": standardize_records,
    "compile_master": compile_master,
}

_SCAN = """SELECT '{name}' AS scan, count(*) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS keys,
  count(*) FILTER (o_orderstatus <> 'P') AS positions, CAST(sum(year(o_orderdate)) AS DOUBLE) AS years, {pay} AS pay FROM orders"""

SQL = {
    "scan_csv_typed": " UNION ALL ".join(
        _SCAN.format(name=name, pay="round(sum(o_totalprice), 2)" if name == "columns" else "NULL::DOUBLE")
        for name in ("letters", "inferred", "below", "columns")
    ),
    "scan_dir_union": """
SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN m END AS pay, CASE WHEN year(o_orderdate) >= 1998 THEN m END AS "Total Pay",
  CASE WHEN year(o_orderdate) >= 1998 THEN CASE WHEN o_orderstatus = 'P' THEN 'NDR' ELSE o_orderpriority END END AS position,
  CASE WHEN year(o_orderdate) < 1998 THEN 'a' ELSE 'b' END AS kind
FROM (SELECT *, '$' || format('{:,.2f}', o_totalprice) AS m FROM orders)""",
    "scan_file_year": """
SELECT 'fiscal' AS rule, o_orderkey, CAST(year(o_orderdate) + 6 AS BIGINT) AS year FROM orders
UNION ALL SELECT 'leading', o_orderkey, CAST(year(o_orderdate) AS BIGINT) FROM orders""",
    "scan_fixed_width": """
SELECT c_custkey AS cust_key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer""",
    "roundtrip_partitioned": with_sql(CUSTOMER_PANEL_SQL, select="""
SELECT state, id, year, CASE WHEN state = 'NATION_1' THEN lower(position) ELSE position END AS position, round(salary, 6) AS salary FROM panel"""),
    "export_by_state": with_sql(CUSTOMER_PANEL_SQL, select="SELECT state, id, year, teacher FROM panel"),
    "curated_roundtrip": "SELECT lower(p_type) AS position, p_brand AS brand, count(*) AS n FROM part GROUP BY ALL",
    "positional_stitch": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "unpivot_years": """
SELECT c.deid, CAST(y AS BIGINT) AS year, round(s, 6) AS salary FROM (SELECT DISTINCT o_custkey AS deid FROM orders) c
CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders) t LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS oy, sum(o_totalprice) AS s FROM orders GROUP BY ALL)
ON o_custkey = deid AND oy = y""",
    "unpivot_aliases": """
SELECT DISTINCT c_custkey, X FROM (SELECT c_custkey, c_name AS X FROM customer
  UNION ALL SELECT c_custkey, CASE WHEN c_nationkey > 10 THEN lower(c_name) ELSE c_name END FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey <= 5)""",
    "normalize_headers": """
SELECT c_custkey AS cust_key, c_name AS full_name, c_name AS full_name_1, c_mktsegment AS segment_market,
  CAST(c_nationkey AS BIGINT) AS nationcode FROM customer""",
    "standardize_records": """
WITH r AS (SELECT *, lower(o_orderpriority) AS pos, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON o_custkey = p_partkey
    WHERE o_orderpriority <> '5-LOW'),
t AS (SELECT o_custkey AS k, y AS ky, sum(o_totalprice) AS total, count(DISTINCT pos) AS n_position FROM r GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM r)
SELECT CAST(o_custkey AS VARCHAR) AS source_id, y AS year, split_part(p_name, ' ', 1) AS name_first, NULL AS name_middle,
  split_part(p_name, ' ', 2) AS name_last, CASE WHEN p_size % 2 = 0 THEN 'jr' ELSE 'ii' END AS name_other, pos AS position,
  regexp_matches(pos, 'urgent|high|not') AND NOT regexp_matches(pos, 'specified') AS teacher, round(total, 6) AS salary,
  n_position, o_orderkey AS record, upper(n_name) AS NCES_name, CASE WHEN n_regionkey = 1 THEN 'regular' END AS NCES_type,
  CASE WHEN n_regionkey = 1 THEN lpad(CAST(n_nationkey AS VARCHAR), 7, '0') END AS NCES_leaid, 'AMERICA' AS state, 'order records' AS source
FROM b JOIN t ON o_custkey = k AND y = ky WHERE rn = 1""",
    "compile_master": with_sql(CUSTOMER_PANEL_SQL, select="""
SELECT CASE WHEN year < 1998 THEN 'old' ELSE 'new' END AS filename, state, year, CAST(id AS VARCHAR) AS source_id, lower(position) AS position,
  CASE WHEN position = '5-LOW' THEN 'TRUE' WHEN position = '1-URGENT' THEN 'FALSE' ELSE teacher END AS teacher,
  round(CASE WHEN year < 1998 THEN salary + salary / 10 ELSE round(salary, 2) END, 6) AS salary, state AS NCES_leaid
FROM panel WHERE state <> 'NATION_7'"""),
}
