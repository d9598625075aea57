"""Queries over text, numbers, names and label classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from personyear.functions import labels, names, numbers, text
from personyear.operators.aggregate import crosstab as cross
from personyear.operators.aggregate import top_labels
from personyear.operators.joins import classify_labels
from personyear.operators.project import banded, first_present, recode_exact, recode_sets
from personyear.operators.quantiles import numeric_summary as summary
from personyear.operators.sets import union_labeled
from personyear.sources.snapshots import label_dictionary as dictionary

from .panels import table, tidy, with_sql


def _people(spark, folder):
    """Names in several writings made of part columns, and whole texts of other tables."""
    words = F.split("p_name", " ")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("Jr", "Sr", "II", "III", "iv")]), F.col("p_size") % 5 + 1)
    first, last, middle = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.col("p_brand")
    kind = F.col("p_size") % 4
    writing = (
        F.when(kind == 0, F.concat_ws(" ", first, F.concat(middle, F.lit(".")), last, suffix))
        .when(kind == 1, F.concat(last, F.lit(" "), suffix, F.lit(", "), first, F.lit(" "), middle))
        .when(kind == 2, F.concat_ws(", ", last, suffix, F.concat_ws(" ", first, F.lower("p_type"))))
        .otherwise(F.col("p_name"))
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), writing.alias("name"))
    items = table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.col("text").alias("name"))
    talks = table(spark, folder, "conversations").select(
        (-1000000 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.col("text").alias("name")
    )
    return parts.unionByName(items).unionByName(talks)


PEOPLE_SQL = """
people AS (
  SELECT p_partkey AS id, CASE p_size % 4
    WHEN 0 THEN concat_ws(' ', first, p_brand || '.', last, suffix)
    WHEN 1 THEN last || ' ' || suffix || ', ' || first || ' ' || p_brand
    WHEN 2 THEN concat_ws(', ', last, suffix, first || ' ' || lower(p_type)) ELSE p_name END AS name
  FROM (SELECT *, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last,
          ['Jr', 'Sr', 'II', 'III', 'iv'][p_size % 5 + 1] AS suffix FROM part)
  UNION ALL SELECT -1 - item_id, text FROM benchmark
  UNION ALL SELECT -1000000 - conv_id * 1000 - turn, text FROM conversations)"""


def _tokens_sql(value: str) -> str:
    return (
        f"list_filter(list_transform(string_split({value}, ' '), lambda x:"
        " regexp_replace(x, '[[:punct:]]', '', 'g')), lambda x: x <> '')"
    )


_SUFFIX = "('jr', 'sr', 'ii', 'iii', 'iv')"


def _spaced_sql(value: str) -> str:
    return f"nullif(array_to_string({value}, ' '), '')"


FML_SQL = f"""
fml AS (SELECT id, name, kept[1] AS name_first,
  CASE WHEN len(kept) > 2 THEN {_spaced_sql("kept[2:len(kept) - 1]")} END AS name_middle,
  kept[len(kept)] AS name_last, {_spaced_sql("other")} AS name_other
  FROM (SELECT id, name, list_filter(t, lambda x: x NOT IN {_SUFFIX}) AS kept, list_filter(t, lambda x: x IN {_SUFFIX}) AS other
    FROM (SELECT id, name, {_tokens_sql("lower(name)")} AS t FROM people)))"""

LCFM_SQL = f"""
lcfm AS (SELECT id, name, r[1] AS name_first, {_spaced_sql("r[2:]")} AS name_middle, {_spaced_sql("l")} AS name_last,
  CASE WHEN len(rt) > 0 THEN {_spaced_sql("list_concat(lo, ro)")} END AS name_other
  FROM (SELECT id, name, rt, list_filter(lt, lambda x: x NOT IN {_SUFFIX}) AS l, list_filter(lt, lambda x: x IN {_SUFFIX}) AS lo,
      list_filter(rt, lambda x: x NOT IN {_SUFFIX}) AS r, list_filter(rt, lambda x: x IN {_SUFFIX}) AS ro
    FROM (SELECT id, name, {_tokens_sql("split_part(lower(name), ',', 1)")} AS lt,
      {_tokens_sql("replace(substring(lower(name), length(split_part(lower(name), ',', 1)) + 2), ',', ' ')")} AS rt FROM people)))"""

_PARTS = "id, name_first, name_middle, name_last, name_other"


def _parsed(spark, folder, parse):
    people = _people(spark, folder)
    return people.select("id", parse("name").alias("n")).select("id", "n.*")


def names_fml(spark, folder):
    return _parsed(spark, folder, names.first_middle_last)


def names_lcfm(spark, folder):
    return _parsed(spark, folder, names.last_comma_first_middle)


def names_dispatch(spark, folder):
    return _parsed(spark, folder, names.any_order)


def names_three_part(spark, folder):
    writings = {
        "last_suffix_first": names.last_suffix_first,
        "last_first_suffix": lambda name: names.last_first_suffix(F.upper(F.col(name))),
        "last_first_other": names.last_first_other,
    }
    rows = _people(spark, folder)
    parsed = {
        form: rows.select("id", parse("name").alias("n")).select("id", "n.*") for form, parse in writings.items()
    }
    return union_labeled(parsed, "form")


def split_name_parts(spark, folder):
    people = _people(spark, folder)
    first, middle = names.split_given("name")
    _, two = names.split_given("name", 2)
    return people.select("id", first.alias("first"), middle.alias("middle"), two.alias("two"))


def string_functions(spark, folder):
    pages = table(spark, folder, "pages")
    url, html = F.col("url"), F.col("html")
    return tidy(
        pages.select(
            "page_id",
            F.upper("url").alias("upper"),
            F.trim(F.concat(F.lit("  "), url, F.lit(" "))).alias("trimmed"),
            url.rlike(r"/\d+\.html").alias("has_file"),
            text.replace_first(url, "e", "E").alias("first_replaced"),
            F.regexp_replace(url, "[0-9]+", "#").alias("all_replaced"),
            F.regexp_replace(url, "^https?://", "").alias("removed"),
            text.extract(url, r"page=(\d+)", 1).alias("page_no"),
            text.part(url, "/", 2).alias("host"),
            text.part(url, "/", 7).alias("absent"),
            F.substring(url, 1, 5).alias("scheme"),
            text.join_parts(text.extract(url, r"ref=(\w+)", 1), text.extract(url, r"page=(\d+)", 1), sep="-").alias("joined"),
            text.pad_left(text.extract(url, r"page=(\d+)", 1), 4).alias("padded"),
            F.length("html").alias("n_chars"),
            F.md5(text.strip_punctuation(html).cast("binary")).alias("no_punctuation"),
            F.md5(text.repair_bytes(html).cast("binary")).alias("repaired"),
            F.size(F.split("html", "<p>")).alias("n_pieces"),
            text.prefix_to_suffix(url, "https://", "https").alias("moved"),
            text.percent_label(F.length("url") / F.lit(70.0), 1).alias("share"),
        )
    )


def parse_numbers(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("money"),
        F.when(F.col("o_orderstatus") == "P", "Not Provided").otherwise(F.col("o_totalprice").cast("string")).alias("pay"),
        F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("?").alias("flag"),
        F.format_string("%.2f", F.col("o_orderkey") % 400 / 4).alias("share"),
    )
    return tidy(
        orders.select(
            "o_orderkey",
            numbers.parse_money("money").alias("money"),
            numbers.to_number("pay").alias("pay"),
            numbers.to_boolean("flag").alias("flag"),
            numbers.scaled_text("share", 100.0).alias("scaled"),
            numbers.half_even(F.col("o_totalprice") / 1000, 2).alias("thousands"),
        )
    )


def pad_identifier(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", text.pad_left(F.col("o_orderkey").cast("string"), 4).alias("padded")
    )


TYPE_SETS = {"big": ["LARGE", "ECONOMY"], "small": ["SMALL"]}
BRAND_NAMES = {f"Brand#{i}": f"House {i}" for i in range(1, 13)}


def recode_values(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    grouped = part.withColumn("size_class", recode_sets("p_type", TYPE_SETS))
    return recode_exact(grouped, "p_brand", BRAND_NAMES).select("p_partkey", "size_class", "p_brand")


INCLUDE, EXCLUDE, EXACT = ["ring", "bolt"], ["red", "old"], ["hot rod", "old gizmo"]


def classify_keywords(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.nullif("p_name", F.lit("red plate")).alias("label"))
    flag = labels.keyword_flag("label", INCLUDE, EXCLUDE, EXACT)
    flagged = part.select("p_partkey", labels.keyword_flag("label", INCLUDE, EXCLUDE).alias("words"), flag.alias("with_list"))
    docs = table(spark, folder, "documents").select(
        "doc_id", labels.keyword_flag(F.lower("text"), ["tion", "ment"], ["copyright", "license"]).alias("words")
    )
    return union_labeled(
        {"part": flagged.withColumnRenamed("p_partkey", "id"), "document": docs.withColumnRenamed("doc_id", "id")}, "kind"
    )


def classify_exact(spark, folder):
    label = F.nullif("p_type", F.lit("SMALL"))
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey",
        labels.member(label, ["LARGE", "ECONOMY"]).alias("listed"),
        (label == "LARGE").alias("code"),
        F.upper("p_name").contains("RING").alias("contains"),
    )


def by_dictionary(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    flagged = classify_labels(rows, "p_name", labels.keyword_flag("p_name", INCLUDE, EXCLUDE, EXACT), "flag")
    return tidy(flagged.select("l_orderkey", "l_linenumber", "l_partkey", "flag"))


def regex_filter(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    return docs.where(labels.lacks_pattern("text", "the|lic[ea]nse")).select("doc_id")


def not_in_keeps_null(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return orders.where(labels.not_member("priority", ["1-URGENT", "2-HIGH"]))


def school_year(spark, folder):
    orders = table(spark, folder, "orders")
    spring = numbers.spring_year("o_orderdate")
    return tidy(orders.select("o_orderkey", spring.alias("year"), numbers.school_year_label(spring).alias("label")))


def coalesce_variants(spark, folder):
    customer = table(spark, folder, "customer")
    segment = F.col("c_mktsegment")
    vintages = customer.select(
        "c_custkey",
        F.when(segment == "MACHINERY", F.col("c_name")).alias("Name"),
        F.when(segment == "HOUSEHOLD", F.lower("c_name")).alias("full name"),
        F.when(segment.isin("MACHINERY", "FURNITURE"), segment).alias("NAME_2"),
    )
    return vintages.select(
        "c_custkey", first_present(vintages, ["Name", "full name", "NAME_2", "absent"]).alias("name"),
        F.concat_ws("", "Name", "full name").alias("glued"),
    )


def banded_coalesce(spark, folder):
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    chosen = banded(
        orders, "year",
        [(1995, 1996, "o_orderstatus"), (1997, 1999, "o_orderpriority"), (2000, 2000, F.substring("o_orderpriority", 1, 1)), (2002, 2003, "absent")],
    )
    return orders.select("o_orderkey", chosen.alias("chosen"))


def label_dictionary(spark, folder):
    part = table(spark, folder, "part")
    return dictionary(part, F.lower("p_type").alias("position"), F.col("p_brand").alias("brand"))


def sorted_top_labels(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey")
    part = table(spark, folder, "part").select("p_partkey", F.nullif("p_name", F.lit("red plate")).alias("label"))
    return top_labels(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "label", 20)


def crosstab(spark, folder):
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    return tidy(cross(orders, "year", "o_orderstatus", ["F", "O"]))


def numeric_summary(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    return tidy(
        union_labeled(
            {"all": summary(lines, "l_extendedprice"), "by flag": summary(lines, "l_extendedprice", ["l_returnflag"])}, "scope"
        )
    )


QUERIES = {
    "names_fml": names_fml,
    "names_lcfm": names_lcfm,
    "names_dispatch": names_dispatch,
    "names_three_part": names_three_part,
    "split_name_parts": split_name_parts,
    "string_functions": string_functions,
    "parse_numbers": parse_numbers,
    "pad_identifier": pad_identifier,
    "recode_values": recode_values,
    "classify_keywords": classify_keywords,
    "classify_exact": classify_exact,
    "classify_dictionary": by_dictionary,
    "regex_filter": regex_filter,
    "not_in_keeps_null": not_in_keeps_null,
    "school_year": school_year,
    "coalesce_variants": coalesce_variants,
    "banded_coalesce": banded_coalesce,
    "label_dictionary": label_dictionary,
    "sorted_top_labels": sorted_top_labels,
    "crosstab": crosstab,
    "numeric_summary": numeric_summary,
}

_FLAG = """(regexp_matches(label, 'ring|bolt') OR coalesce(label IN ('hot rod', 'old gizmo'), FALSE))
  AND NOT regexp_matches(label, 'red|old')"""

_SUMMARY = """round(min(v), 6) AS minimum, round(quantile_cont(v, .25), 6) AS p25, round(quantile_cont(v, .5), 6) AS median,
  round(avg(v), 6) AS mean, round(quantile_cont(v, .75), 6) AS p75, round(max(v), 6) AS maximum"""

_GIVEN = """CASE WHEN len(g) > 1 THEN nullif(trim(array_to_string(g[2:{end}], ' ')), '') END"""

SQL = {
    "names_fml": with_sql(PEOPLE_SQL, FML_SQL, select=f"SELECT {_PARTS} FROM fml"),
    "names_lcfm": with_sql(PEOPLE_SQL, LCFM_SQL, select=f"SELECT {_PARTS} FROM lcfm"),
    "names_dispatch": with_sql(PEOPLE_SQL, FML_SQL, LCFM_SQL, select=f"""
SELECT {_PARTS} FROM fml WHERE NOT contains(name, ',') UNION ALL SELECT {_PARTS} FROM lcfm WHERE contains(name, ',')"""),
    "names_three_part": with_sql(PEOPLE_SQL, f"""
s1 AS (SELECT id, string_split(name, ', ') AS p, string_split(replace(replace(replace(coalesce(p[3], p[2]), '  ', ' '),
   ' S R', ' SR'), ' J R', ' JR'), ' ') AS g FROM (SELECT id, name, string_split(name, ', ') AS p FROM people))""", """
u AS (SELECT id, string_split(upper(replace(name, 'ß', 'SS')), ',') AS p FROM people)""", """
s2 AS (SELECT id, trim(p[1]) AS last, trim(p[2]) AS b, trim(p[3]) AS c, trim(p[4]) AS d FROM u)""", """
s3 AS (SELECT *, coalesce(b IN ('JR','SR','II','III'), FALSE) AS bs, coalesce(c IN ('JR','SR','II','III'), FALSE) AS cs FROM s2)""", """
s4 AS (SELECT *, string_split(trim(concat_ws(' ', CASE WHEN NOT bs THEN b END, CASE WHEN NOT cs THEN c END, d)), ' ') AS g FROM s3)""", """
o AS (SELECT id, p, trim(p[2]) AS given FROM (SELECT id, string_split(lower(replace(name, ',,', ',')), ',') AS p FROM people))""",
        select=f"""
SELECT 'last_suffix_first' AS form, id, g[1] AS name_first, {_GIVEN.format(end=5)} AS name_middle, p[1] AS name_last,
  CASE WHEN p[3] IS NOT NULL THEN p[2] END AS name_other FROM s1
UNION ALL SELECT 'last_first_suffix', id, g[1], {_GIVEN.format(end=7)}, last, CASE WHEN bs THEN b WHEN cs THEN c END FROM s4
UNION ALL SELECT 'last_first_other', id, nullif(split_part(given, ' ', 1), ''),
  CASE WHEN contains(given, ' ') THEN nullif(trim(substring(given, length(split_part(given, ' ', 1)) + 2)), '') END,
  trim(p[1]), nullif(trim(p[3]), '') FROM o"""),
    "split_name_parts": with_sql(PEOPLE_SQL, select=f"""
SELECT id, g[1] AS first, {_GIVEN.format(end='len(g)')} AS middle, {_GIVEN.format(end=3)} AS two
FROM (SELECT id, string_split(name, ' ') AS g FROM people)"""),
    "string_functions": r"""
WITH x AS (SELECT *, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page_no, nullif(regexp_extract(url, 'ref=(\w+)', 1), '') AS ref FROM pages)
SELECT page_id, upper(url) AS upper, url AS trimmed, regexp_matches(url, '/\d+\.html') AS has_file,
  regexp_replace(url, 'e', 'E') AS first_replaced, regexp_replace(url, '[0-9]+', '#', 'g') AS all_replaced,
  regexp_replace(url, '^https?://', '') AS removed, page_no, split_part(url, '/', 3) AS host,
  CASE WHEN len(string_split(url, '/')) > 7 THEN split_part(url, '/', 8) END AS absent, url[1:5] AS scheme,
  nullif(concat_ws('-', ref, page_no), '') AS joined, CASE WHEN length(page_no) < 4 THEN lpad(page_no, 4, '0') ELSE page_no END AS padded,
  length(html) AS n_chars, md5(regexp_replace(html, '[[:punct:]]', '', 'g')) AS no_punctuation,
  md5(translate(html, 'ÑÊ', 'N ')) AS repaired, CAST(len(string_split(html, '<p>')) AS BIGINT) AS n_pieces,
  CASE WHEN contains(url, 'https://') THEN replace(url, 'https://', '') || ' https' ELSE url END AS moved,
  printf('%.1f%%', length(url) / 70.0 * 100.0) AS share
FROM x""",
    "parse_numbers": """
SELECT o_orderkey, round(o_totalprice, 6) AS money, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 6) END AS pay,
  CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS flag, CAST(o_orderkey % 400 * 25 AS VARCHAR) AS scaled,
  round_even(o_totalprice / 1000, 2) AS thousands FROM orders""",
    "pad_identifier": """
SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS padded FROM orders""",
    "recode_values": """
SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'big' WHEN p_type = 'SMALL' THEN 'small' END AS size_class,
  CASE WHEN CAST(p_brand[7:] AS INT) BETWEEN 1 AND 12 THEN 'House ' || p_brand[7:] ELSE p_brand END AS p_brand FROM part""",
    "classify_keywords": f"""
SELECT 'part' AS kind, id, regexp_matches(label, 'ring|bolt') AND NOT regexp_matches(label, 'red|old') AS words, {_FLAG} AS with_list
FROM (SELECT p_partkey AS id, nullif(p_name, 'red plate') AS label FROM part)
UNION ALL SELECT 'document', doc_id, regexp_matches(lower(text), 'tion|ment') AND NOT regexp_matches(lower(text), 'copyright|license'), NULL FROM documents""",
    "classify_exact": """
SELECT p_partkey, coalesce(t IN ('LARGE', 'ECONOMY'), FALSE) AS listed, t = 'LARGE' AS code, contains(upper(p_name), 'RING') AS contains
FROM (SELECT *, nullif(p_type, 'SMALL') AS t FROM part)""",
    "classify_dictionary": f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {_FLAG} AS flag
FROM lineitem JOIN (SELECT p_partkey, p_name AS label FROM part) ON l_partkey = p_partkey""",
    "regex_filter": "SELECT doc_id FROM documents WHERE lang = 'de' OR NOT regexp_matches(text, '(?i)the|lic[ea]nse')",
    "not_in_keeps_null": """
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""",
    "school_year": """
SELECT o_orderkey, y AS year, (y - 1) || '_' || y AS label FROM (
  SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS BIGINT) AS y FROM orders)""",
    "coalesce_variants": """
SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN c_name WHEN 'HOUSEHOLD' THEN lower(c_name) WHEN 'FURNITURE' THEN c_mktsegment END AS name,
  CASE c_mktsegment WHEN 'MACHINERY' THEN c_name WHEN 'HOUSEHOLD' THEN lower(c_name) ELSE '' END AS glued FROM customer""",
    "banded_coalesce": """
SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN o_orderstatus
  WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN o_orderpriority WHEN year(o_orderdate) = 2000 THEN o_orderpriority[1:1] END AS chosen FROM orders""",
    "label_dictionary": "SELECT lower(p_type) AS position, p_brand AS brand, count(*) AS n FROM part GROUP BY ALL",
    "sorted_top_labels": """
SELECT nullif(p_name, 'red plate') AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 ORDER BY n DESC, label ASC NULLS LAST LIMIT 20""",
    "crosstab": """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) FILTER (o_orderstatus = 'F') AS "F",
  count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS other FROM orders GROUP BY 1""",
    "numeric_summary": f"""
SELECT 'all' AS scope, NULL AS l_returnflag, {_SUMMARY} FROM (SELECT l_extendedprice AS v FROM lineitem)
UNION ALL SELECT 'by flag', l_returnflag, {_SUMMARY} FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY l_returnflag""",
}
