"""State jobs over extracts made of the given tables in each state's header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personyear.operators.ranks import running_before
from personyear.plans import fixed_values as v
from personyear.plans import states
from personyear.session import new_folder, written

from .panels import order_years, table, tidy, with_sql


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of customers that have a part, with the words of the part's name."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
    words = F.split("p_name", " ")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("o_custkey") == F.col("p_partkey"))
        .withColumns({"first": F.get(words, F.lit(0)), "last": F.get(words, F.lit(1)), "year": F.year("o_orderdate")})
    )


RECORDS_SQL = """
r AS (SELECT *, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last,
    CAST(year(o_orderdate) AS BIGINT) AS year, upper(n_name) AS place FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON o_custkey = p_partkey)"""


def _choose(number, *texts: str):
    """The text at the place that a number leaves on division."""
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (number % len(texts) + 1).cast("int"))


def _choose_sql(number: str, *texts: str) -> str:
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in texts)
    return f"([{listed}])[{number} % {len(texts)} + 1]"


def _dim(spark: SparkSession, folder: str, state: str, name, local=None) -> DataFrame:
    """Two reference years and the prefixed one; every seventh nation is listed twice, every fifth not at all."""
    key = F.col("n_nationkey")
    local = F.concat(F.lit("L"), key.cast("string")) if local is None else local
    rows = table(spark, folder, "nation").where(key % 5 != 4).select(
        F.explode(F.array(F.lit(1999), F.lit(2000), F.lit(v.PREFIXED_REFERENCE_YEAR))).alias("year"),
        F.lit(state).alias("state"),
        name.alias("NCES_name"),
        _choose(key, "1", "2").alias("NCES_type"),
        F.lit("a").alias("half"),
        key.alias("key"),
        local.alias("localid"),
    )
    twice = rows.where("key % 7 = 0 and year = 2000").withColumn("half", F.lit("b"))
    return rows.unionByName(twice).select(
        "year", "state", "NCES_name", "NCES_type", F.format_string("%06d%s", "key", "half").alias("NCES_leaid"), "localid"
    )


def _dim_sql(name: str, local: str = "'L' || n_nationkey", which: str = "n_year <> 2017") -> str:
    return f"""
dim AS (SELECT DISTINCT upper({name}) AS NCES_name, {_choose_sql("n_nationkey", "1", "2")} AS NCES_type,
    lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || half AS NCES_leaid, {local} AS localid, n_year, n_nationkey FROM nation,
    (VALUES (1999, 'a'), (2000, 'a'), (2000, 'b'), (2017, 'a')) t(n_year, half)
  WHERE n_nationkey % 5 <> 4 AND (half = 'a' OR n_nationkey % 7 = 0) AND {which})"""


# ------------------------------------------------------------------ CA and NV

ENDINGS = (" City School District", " Union School District", " Unified School District", "")
SHORT = (" City", " Union", " Unified", "")
TITLES = ("Math TCHR", "Teacher Aide", "Substitute Teacher", "Clerk", "Special Ed Teacher")


def _pay_extract(spark: SparkSession, folder: str, agency) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat("last", F.lit(" Jr, "), "first")).otherwise(F.concat(F.initcap("p_name"), F.lit(" II")))
    price = F.col("o_totalprice").cast("string")
    small = (F.col("o_orderkey") % 100).cast("string")
    return _records(spark, folder).select(
        name.alias("Employee Name"),
        _choose(F.col("o_orderkey"), *TITLES).alias("Job Title"),
        F.when(F.col("o_orderstatus") == "P", "Not Provided").otherwise(price).alias("Base Pay"),
        small.alias("Overtime Pay"),
        F.lit(None).cast("string").alias("Other Pay"),
        small.alias("Benefits"),
        price.alias("Total Pay"),
        price.alias("Total Pay & Benefits"),
        F.col("year").cast("string").alias("Year"),
        agency.alias("Agency"),
        F.lit(None).cast("string").alias("Status"),
    )


_PAY_SQL = f"""lower({_choose_sql("o_orderkey", *TITLES)}) AS position, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 6) END AS salary_base,
  CAST(o_orderkey % 100 AS DOUBLE) AS salary_overtime, NULL::DOUBLE AS salary_other, CAST(o_orderkey % 100 AS DOUBLE) AS salary_benefits,
  round(o_totalprice, 6) AS salary_total, round(o_totalprice, 6) AS salary_total_benefits, CAST(year AS DOUBLE) AS year,
  first AS name_first, NULL AS name_middle, last AS name_last, CASE WHEN p_size % 2 = 0 THEN 'jr' ELSE 'ii' END AS name_other,
  o_orderkey % 5 IN (0, 4) AS teacher"""


def state_ca(spark, folder):
    key = F.col("n_nationkey")
    raw = _pay_extract(spark, folder, F.concat(F.initcap("n_name"), _choose(key, *ENDINGS)))
    return tidy(states.clean_ca(raw, _dim(spark, folder, "CA", F.concat(F.initcap("n_name"), _choose(key, *SHORT)))))


def state_nv(spark, folder):
    raw = _pay_extract(spark, folder, F.initcap("n_name"))
    return tidy(states.clean_nv(raw, _dim(spark, folder, "NV", F.lower("n_name"))))


# ------------------------------------------------------------------ KS

KS_TITLES = ("Art", "Sub Teacher", "Head TCH", "Kitchen Teacher", "Clerk", "English")


def state_ks(spark, folder):
    records = _records(spark, folder)
    given = F.concat_ws(" ", F.initcap("first"), _choose(F.col("p_size"), "Bea", "Bea Cee", "Bea Cee Dee"))
    raw = records.select(
        F.col("year").cast("string").alias("Year"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total Pay"),
        F.when(F.col("p_size") % 4 == 0, F.initcap("first")).otherwise(given).alias("First Name"),
        F.initcap("last").alias("Last Name"),
        F.initcap("n_name").alias("District"),
        _choose(F.col("o_orderkey"), *KS_TITLES).alias("Position"),
    )
    return tidy(states.clean_ks(raw, _dim(spark, folder, "KS", F.initcap("n_name"))))


# ------------------------------------------------------------------ OK

OK_TITLES = ("TEACHER", "COACH", "TOTAL OTHER PAY", "RESOURCE TEACHER")


def state_ok(spark, folder):
    """Numbers stand under two headings; pay of a person and year is added up."""
    records = _records(spark, folder)
    number, key = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    text = lambda value: value.cast("string")
    blank = F.lit(None).cast("string")
    raw = records.select(
        text(F.col("year")).alias("year"),
        F.when(key % 2 == 0, number).alias("TeacherNumber"),
        F.when(key % 2 == 1, number).alias("Teacher Number"),
        blank.alias("staff_id"),
        F.upper("first").alias("fname"),
        F.upper("last").alias("lname"),
        F.lit("c").alias("county_name"),
        F.lpad(text(F.col("n_nationkey")), 2, "0").alias("co"),
        F.lit("I001").alias("dist"),
        text(key % 3).alias("site"),
        F.col("n_name").alias("district_name"),
        text(key % 3).alias("school_name"),
        F.lit("F").alias("gender"),
        _choose(key, *OK_TITLES).alias("jobdesc"),
        text(key % 4).alias("jobcode"),
        text(key % 5).alias("subject"),
        F.concat(F.lit("s"), text(key % 5)).alias("subject_desc"),
        text(F.col("p_size") % 6).alias("race"),
        F.col("p_brand").alias("race_desc"),
        text(F.col("p_size") % 4).alias("degree"),
        F.col("p_type").alias("degree_desc"),
        F.lit("0.5").alias("fte"),
        text(F.col("o_totalprice")).alias("base_salary"),
        text(key % 10).alias("total_fringe"),
        blank.alias("total_oth_salary"),
        F.when(key % 3 == 0, "7").alias("total_extra_duty"),
    )
    local = F.concat(F.lit("OK-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("-I001"))
    dim = _dim(spark, folder, "OK", F.initcap("n_name"), local).where(f"year = {v.PREFIXED_REFERENCE_YEAR}")
    kept = states.clean_ok(raw, dim)
    return tidy(
        kept.select(
            "source_id", "year", "name_first", "name_last", "county_id", "district_name", "gender", "position_code", "position",
            "race_code", "race_desc", "degree_code", "degree_desc", "subject_code", "subject_desc", "fte", "salary_base",
            "salary_fringe", "salary_other", "salary_extra_duty", "localid", "school_id", "n_districts", "n_schools", "n_position",
            "n_subject", "teacher", "NCES_name", "NCES_leaid", "state", "source",
        )
    )


# ------------------------------------------------------------------ GA

ORGANISATIONS = (" BOARD OF EDUCATION", " SCHOOL SYSTEM", " CHARTER ACADEMY", " PORTS AUTHORITY", " (KIPP) SCHOOL")
GA_TITLES = ("GRADE 4", "SUBSTITUTE TEACHER", "CLERK", "TCH PREK")


def state_ga(spark, folder):
    key = F.col("n_nationkey")
    name = F.concat(F.upper("last"), F.when(F.col("p_size") % 2 == 0, F.lit(",JR")).otherwise(F.lit("")), F.lit(","), F.upper("first"), F.lit(" M"))
    raw = _records(spark, folder).select(
        name.alias("NAME"),
        _choose(F.col("o_orderkey"), *GA_TITLES).alias("TITLE"),
        F.col("o_totalprice").alias("SALARY"),
        F.concat(F.upper("n_name"), _choose(key, *ORGANISATIONS)).alias("ORGANIZATION"),
        F.col("year").alias("FISCAL_YEAR"),
    )
    dim = _dim(spark, folder, "GA", F.when(key % 3 == 0, F.concat("n_name", F.lit(" COUNTY"))).otherwise(F.col("n_name")))
    return tidy(states.clean_ga(raw, dim))


# ------------------------------------------------------------------ IL

IL_FIRST, IL_SECOND = ("Kindergarten", "Clerk", "High School Teacher"), ("PE Teacher", "Cook")
RACES = ("White", "White, Non-Hispanic", "Asian", "Unknow", "Other")


def state_il(spark, folder):
    """Two vintages; the second leaves out the retired."""
    records, key, text = _records(spark, folder), F.col("o_orderkey"), lambda value: value.cast("string")
    names = [F.initcap("first"), F.lit("Q"), F.initcap("last")]
    first = records.where("o_orderstatus <> 'F'").select(
        text(F.col("year")).alias("fy"), text(F.col("o_totalprice")).alias("salary"),
        *[c.alias(n) for c, n in zip(names, ("first_name", "mid_init", "last_name"), strict=True)],
        F.initcap("n_name").alias("dst_name"), _choose(key, *IL_FIRST).alias("pos_desc"), F.lit("s").alias("sch_name"),
        _choose(key, "Female", "Male").alias("gender"), _choose(F.col("p_size"), *RACES).alias("race_ethnicity_desc"),
        F.lit("100").alias("fte"), text(F.col("n_nationkey")).alias("rcdt"), text(key % 7).alias("sch_num"),
    )
    second = records.where("o_orderstatus = 'F'").select(
        text(F.col("year")).alias("School Year"), text(F.col("o_totalprice")).alias("Salary"), F.lit("1").alias("Bonus"),
        *[c.alias(n) for c, n in zip(names, ("First name", "Middle Name", "Last Name"), strict=True)],
        text(F.col("o_custkey")).alias("ID Number"), F.initcap("n_name").alias("Employer"), _choose(key, *IL_SECOND).alias("Position"),
        text(key % 7).alias("Primary Working Location RCDTS"), F.lit("s").alias("Primary Working Location Name"),
        _choose(key, "F", "M").alias("Gender"), _choose(F.col("p_size"), *RACES).alias("Race/Ethnicity"),
        _choose(key % 5, "No", "Yes", "0").alias("Retired Staff"), F.lit("0.5").alias("Full Time Equivalent"),
        F.lit("1").alias("Retirement Benefits"), text(key % 3).alias("Other Benefits"), F.lit("3").alias("Annuities"),
    )
    return tidy(states.clean_il(first, second, _dim(spark, folder, "IL", F.initcap("n_name"))))


# ------------------------------------------------------------------ IN

IN_TITLES = ("Grade 3", "Aide to Teacher", "Mathematics", "Clerk")


def state_in(spark, folder):
    """A crosswalk of aliases and one of units; some aliases have no district, some units no alias."""
    key = F.col("n_nationkey")
    raw = _records(spark, folder).select(
        F.concat(F.initcap("last"), F.when(F.col("p_size") % 2 == 0, F.lit(", JR, ")).otherwise(F.lit(", ")), F.initcap("first"), F.lit(" M")).alias("employee"),
        F.col("year").cast("string").alias("year"),
        F.col("o_totalprice").cast("string").alias("total_compensation"),
        _choose(F.col("o_orderkey"), *IN_TITLES).alias("job_title"),
        F.concat(F.initcap("n_name"), F.lit(" Schools")).alias("department"),
        F.concat(F.lit("u"), key.cast("string")).alias("unit_id"),
    )
    number = (key + 10).cast("string")
    crosswalk = table(spark, folder, "nation").select(
        number.alias("localid"),
        F.when(key % 4 == 1, "*").otherwise(F.concat(F.lit("u"), key.cast("string"))).alias("unit_id"),
        F.initcap("n_name").alias("NCES_name"),
        F.when(key % 3 != 0, F.concat(F.upper("n_name"), F.lit(" SCHOOLS"))).alias("X4"),
        F.when(key % 2 == 0, "").otherwise(F.upper("n_name")).alias("X5"),
    )
    dim = _dim(spark, folder, "IN", F.initcap("n_name"), F.lpad(number, 4, "0"))
    return tidy(states.clean_in(raw, crosswalk, dim, ["X4", "X5"]))


# ------------------------------------------------------------------ ND

def state_nd(spark, folder):
    raw = _records(spark, folder).select(
        F.concat((F.col("year") - 1).cast("string"), F.lit("-"), F.col("year").cast("string"), F.lit(".csv")).alias("filename"),
        F.col("o_custkey").cast("string").alias("LicenseNumber"),
        F.col("o_totalprice").cast("string").alias("SALincCOMP"),
        _choose(F.col("o_orderkey"), "Teacher", "Principal").alias("P1_Desc"),
        F.initcap("n_name").alias("DistrictName"),
    )
    local = F.concat(F.lit("ND-"), F.col("n_nationkey").cast("string"))
    return tidy(states.clean_nd(raw, _dim(spark, folder, "ND", F.initcap("n_name"), local)))


# ------------------------------------------------------------------ NY

NY_PLACES = (" Public Schools", " CSD", " City School District")
NY_NAMES = (" School District", " CSD", " City School District")


def state_ny(spark, folder):
    """District names in two spellings; some are found through a curated link alone."""
    key = F.col("n_nationkey")
    name = F.concat(F.initcap("last"), F.lit(", "), F.initcap("first"), F.lit(" Q"), F.when(F.col("p_size") % 2 == 0, F.lit(", Jr")).otherwise(F.lit("")))
    raw = _records(spark, folder).select(
        name.alias("WholeName"),
        F.col("o_totalprice").cast("string").alias("YTDPay"),
        F.when(F.col("year") % 3 == 0, F.lit("2008")).otherwise(F.col("year").cast("string")).alias("PayYear"),
        F.concat(F.initcap("n_name"), _choose(key, *NY_PLACES)).alias("AgencyName"),
        _choose(F.col("o_orderkey"), v.NY_TEACH_AGENCY, "Other").alias("SubAgencyName"),
    )
    links = table(spark, folder, "nation").where(key % 3 == 1).select(
        F.lower(F.concat("n_name", _choose(key, *NY_PLACES))).alias("school_district"),
        F.lower(F.concat("n_name", F.lit(" central school district"))).alias("NCES_name"),
    )
    dim = _dim(spark, folder, "NY", F.concat("n_name", _choose(key, *NY_NAMES)))
    return tidy(states.clean_ny(raw, links, dim))


# ------------------------------------------------------------------ OH

OH_TITLES = ("Teacher", "Clerk", "Regular Teaching", "Aide")


def state_oh(spark, folder):
    """Two headings of the same fields; the id is the number of the name."""
    records, key = _records(spark, folder), F.col("o_orderkey")
    old = F.col("year") < 1998

    def under(before: str, after: str, value):
        return [F.when(old, value).alias(before), F.when(~old, value).alias(after)]

    raw = records.select(
        F.concat((F.col("year") - 1).cast("string"), F.lit("-"), F.col("year").cast("string"), F.lit("_x")).alias("filename"),
        *under("LASTNAME", "Last_Name", F.upper("last")),
        *under("FIRSTNAME", "First_Name", F.concat(F.lit(" "), F.upper("first"), F.lit(" Q R"))),
        *under("COUNTY", "COUNTYNAME", F.lit("C")),
        F.lit("t").alias("CITYNAME"),
        *under("SCHOOLNAME", "Building", (key % 3).cast("string")),
        *under("DISTRICTNAME", "District", F.initcap("n_name")),
        *under("DAYSWORKED", "Days_Worked", (key % 200).cast("string")),
        F.lit("7").alias("HOURSWORKEDPERDAY"),
        F.lit("d").alias("EDUCATIONLEVEL"),
        *under("PAYAMOUNT", "Salary", F.col("o_totalprice").cast("string")),
        *under("JOBDESCRIPTION", "Job_Description", _choose(key, *OH_TITLES)),
    )
    kept = states.clean_oh(raw, _dim(spark, folder, "OH", F.initcap("n_name")))
    return tidy(
        kept.select(
            "id", "year", "year2", "name_first", "name_middle", "name_last", "county", "city", "days_worked", "salary", "hours_worked",
            "n_districts", "n_schools", "n_position", "state", "source",
        )
    )


# ------------------------------------------------------------------ PA

def state_pa(spark, folder):
    """A sheet per school year; one has a column more."""
    records = _records(spark, folder)
    sheets = {}
    for year in order_years(spark, folder):
        sheet = records.where(F.col("year") == year).select(
            F.col("year").cast("string").alias("year"),
            F.col("first").alias("name_first"),
            F.col("last").alias("name_last"),
            _choose(F.col("o_orderkey"), "Secondary", "Clerk", "Ungraded Teacher").alias("position_description"),
            F.initcap("n_name").alias("lea_name"),
            F.col("o_totalprice").alias("salary"),
            F.col("o_custkey").cast("string").alias("source_id"),
        )
        sheets[f"{year - 1}_{year}"] = sheet.withColumn("name_suffix", F.lit("jr")) if year % 2 else sheet
    return tidy(states.clean_pa(sheets, _dim(spark, folder, "PA", F.initcap("n_name"))))


# ------------------------------------------------------------------ MI

def state_mi(spark, folder):
    """Wages of a person and district by year, in three column files; some rows are deleted, some are put in."""
    years = order_years(spark, folder)
    wide = (
        _records(spark, folder)
        .groupBy("o_custkey", "first", "last", "n_name", "p_type")
        .pivot("year", years)
        .agg(F.sum("o_totalprice"))
    )
    wide = running_before(wide, [F.col("o_custkey")], F.lit(1), "ordinal")
    pay = [F.col(f"`{year}`").cast("string").alias(f"sum_wag_amt_{year}") for year in years]
    whole = written(
        wide.select(
            F.col("ordinal").cast("long"), F.col("o_custkey").cast("string").alias("deid"),
            F.concat(F.initcap("first"), F.lit(" Q")).alias("fst_nm"), F.upper("last").alias("last_nm"),
            F.col("p_type").alias("job_class"), F.initcap("n_name").alias("org_nm"), *pay,
        ),
        "wages",
    )
    parts = [
        whole.select("ordinal", "deid", "fst_nm", "last_nm"),
        whole.select("ordinal", "job_class", "org_nm"),
        whole.select("ordinal", *[f"sum_wag_amt_{year}" for year in years]),
    ]
    delete = whole.where("cast(deid as long) % 10 = 3").select("deid")
    insert = whole.where("cast(deid as long) % 10 = 3").select(
        F.concat(F.lit("new"), "deid").alias("deid"), "fst_nm", "last_nm", "job_class", "org_nm",
        *[F.lit("5").alias(f"sum_wag_amt_{year}") for year in years],
    )
    key = F.col("n_nationkey")
    crosswalk = table(spark, folder, "nation").where(key % 2 == 0).select(
        F.upper("n_name").alias("MI_name"), F.concat(F.upper("n_name"), F.lit(" PUBLIC")).alias("NCES_name")
    )
    dim = _dim(spark, folder, "MI", F.when(key % 2 == 0, F.concat("n_name", F.lit(" Public"))).otherwise(F.col("n_name")))
    return tidy(states.clean_mi(parts, delete, insert, crosswalk, dim))


# ------------------------------------------------------------------ WI

WI_CODES, WI_POSITIONS = ("53", "09", "88"), ("53 - Teacher", "88 - Aide")
WI_RACES, WI_NEW_RACES = ("W", "A", "?"), ("W - White", "H - Hispanic/Latino", "Two or More Races")
#: The years of the tables stand for one year of each layout: five of fixed width, a spreadsheet, a CSV file.
WI_YEARS = (1995, 1999, 2004, 2008, 2013, 2016, 2018)
#: Two-digit first year of a layout, its header of sex, race, degree, pay, fringe, agency and school.
WI_HEADERS = {
    95: ("Sex", "Race", "Highest Degree", "Salary", "Fringe", "Agency of Work Location", "School of Work Location"),
    99: ("Sex/Gender", "Race/Primary Ethnic Origin", "Highest Degree", "Salary", "Fringe", "Agency of Work Location", "School of Work Location"),
    4: ("Sex/Gender", "Race/Primary Ethnic Origin", "Highest Degree", "Salary", "Fringe", "Agency of Work Location", "School of Work Location"),
    8: ("Sex/Gender", "Race/Primary Ethnic Origin", "Highest Degree", "Salary", "Fringe", "Agency of Work Location", "School of Work Location"),
    12: ("Gender", "Race/Ethnicity", "Highest Degree Code", "Total Salary", "Total Fringe - Employee Benefits", "Agency of Work Location Code",
         "School of Work Location Code"),
}


def _wi_formats() -> list[tuple[int, str, int, int]]:
    """The documented layouts: two-digit year, variable, start, length."""
    rows = []
    for era, (sex, race, degree, pay, fringe, agency, school) in WI_HEADERS.items():
        fields = [
            ("ID Number", 9), ("Year and Session", 5), ("Last Name", 20), ("Name First", 20), ("Birth Year", 4), (sex, 1), (race, 1),
            (degree, 1), (pay, 12), (fringe, 12), ("Local Experience in Education", 5), ("Total Experience in Education", 5),
            ("Filler", 36), ("Filler", 15), ("Position Code", 2), (agency, 4), (school, 4),
        ]
        begin = 1
        for variable, length in fields:
            rows.append((era, variable, begin, length))
            begin += length
    return rows


def _wi_text(spark: SparkSession, rows: DataFrame) -> dict[int, str]:
    """Fixed-width files by year, as they come: a quote leads the lines of the last era, and one filler is shorter than documented."""
    padded = lambda column, length: F.rpad(F.coalesce(column, F.lit("")), length, " ")
    line = F.concat(
        F.when(F.col("y") >= 2012, '"').otherwise(""), padded(F.col("person"), 9), padded(F.concat(F.col("y").cast("string"), F.lit("A")), 5),
        padded(F.upper("last"), 20), padded(F.upper("first"), 20), F.lit("1960"), F.col("sex"), F.col("race"), F.col("degree"),
        padded(F.col("pay"), 12), padded(F.col("fringe"), 12), padded(F.col("local_years"), 5), padded(F.col("total_years"), 5),
        F.repeat(F.lit(" "), F.lit(36)), F.repeat(F.lit(" "), F.when(F.col("y").between(2004, 2007), 14).otherwise(15)),
        F.col("code"), F.col("place"), F.col("school"),
    )
    path = new_folder(spark, "staff")
    rows.select("y", line.alias("value")).write.partitionBy("y").text(path)
    return {r.y: f"{path}/y={r.y}" for r in rows.select("y").distinct().collect()}


def state_wi(spark, folder):
    """The fixed-width files of all five layouts, a spreadsheet's and a CSV file's headers, whose years are moved to where each holds."""
    key = F.col("o_orderkey")
    person = F.col("o_custkey").cast("string")
    rows = _records(spark, folder).select(
        F.element_at(F.array(*[F.lit(y) for y in WI_YEARS]), (F.pmod(F.col("year") - 1995, F.lit(len(WI_YEARS))) + 1).cast("int")).alias("y"),
        "first", "last", "n_name", person.alias("person"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("pay"), (key % 1000).cast("string").alias("fringe"),
        F.col("p_size").cast("string").alias("local_years"), (F.col("p_size") + key % 3).cast("string").alias("total_years"),
        _choose(key, "F", "M").alias("sex"), _choose(F.col("p_size"), *WI_RACES).alias("race"),
        _choose(F.col("p_size"), *WI_NEW_RACES).alias("new_race"), _choose(F.col("p_size"), "4", "5", "9").alias("degree"),
        _choose(F.col("p_size"), "4 - Bachelor", "5 - Masters").alias("new_degree"), _choose(key, *WI_CODES).alias("code"),
        _choose(key, *WI_POSITIONS).alias("title"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("place"),
        F.lpad((F.col("o_custkey") % 97).cast("string"), 4, "0").alias("school"),
    )
    rows = written(rows, "wi-records")
    text = states.read_wi_text(spark, _wi_text(spark, rows.where("y < 2015")), _wi_formats())
    sheet = rows.where("y between 2015 and 2016").select(
        F.col("y").alias("year"), F.upper("last").alias("last_name"), F.upper("first").alias("name_first"), F.lit("1960").alias("birth_year"),
        F.col("person").alias("id_nbr"), F.concat(F.lit("f"), "person").alias("file_number"), F.col("sex").alias("gndr"),
        F.col("race").alias("raceethn"), F.col("degree").alias("high_degree"), F.col("pay").alias("tot_salary"),
        F.col("fringe").alias("tot_fringe"), F.col("local_years").alias("local_exp"), F.col("total_years").alias("total_exp"),
        F.col("code").alias("position_cd"), F.col("place").alias("work_agncy_cd"), F.col("school").alias("school_cd"),
    )
    late = rows.where("y >= 2017").select(
        F.col("y").alias("year"), F.initcap("last").alias("last_name"), F.initcap("first").alias("name_first"),
        F.lit("1970").alias("birth_year"), F.col("person").alias("research_id"), F.concat(F.lit("e"), "person").alias("entity_id"),
        F.col("sex").alias("gender"), F.col("new_race").alias("raceethnicity"), F.col("new_degree").alias("contract_high_degree"),
        F.col("pay").alias("total_salary"), F.col("fringe").alias("total_fringe"), F.col("local_years").alias("contract_local_experience"),
        F.col("total_years").alias("contract_total_experience"), F.col("title").alias("assignment_position"),
        F.concat("place", F.lit(" - "), "n_name").alias("assignment_work_agency"),
        F.concat("school", F.lit(" - school")).alias("assignment_work_school"),
    )
    # The code list is made of the codes in use.
    used = rows.where("y < 2017").select(F.regexp_replace("code", "^0", "").alias("Code")).distinct()
    codes = used.select(F.lit("position_code").alias("Variable"), "Code", F.concat(F.lit("Title "), "Code").alias("Description"))
    place = F.lpad(F.col("n_nationkey").cast("string"), 4, "0")
    dim = _dim(spark, folder, "WI", F.initcap("n_name"), place).where("NCES_leaid like '%a'")
    return tidy(states.clean_wi({"text": text, "sheet": sheet, "late": late}, codes, dim))


QUERIES = {
    "state_ca": state_ca,
    "state_ga": state_ga,
    "state_il": state_il,
    "state_in": state_in,
    "state_ks": state_ks,
    "state_mi": state_mi,
    "state_nd": state_nd,
    "state_nv": state_nv,
    "state_ny": state_ny,
    "state_oh": state_oh,
    "state_ok": state_ok,
    "state_pa": state_pa,
    "state_wi": state_wi,
}

_KNOWN = "known AS (SELECT DISTINCT NCES_name, NCES_type, NCES_leaid, localid FROM dim)"
_INITCAP = "upper({0}[1]) || lower({0}[2:])"
_WHITE = """(['White', 'White', 'Asian', 'Unknown', NULL])[p_size % 5 + 1]"""

_LATEST = """
ends AS (SELECT NCES_name, max(n_year) AS n_year, min(NCES_type) AS NCES_type FROM dim GROUP BY 1),
latest AS (SELECT NCES_name, max(NCES_type) AS NCES_type, max(NCES_leaid) AS NCES_leaid, max(localid) AS localid
  FROM dim JOIN ends USING (NCES_name, n_year, NCES_type) GROUP BY 1 HAVING count(*) = 1)"""

SQL = {
    "state_ca": with_sql(
        RECORDS_SQL, _dim_sql(f"n_name || {_choose_sql('n_nationkey', *SHORT)}"), _LATEST, f"""
named AS (SELECT *, place || {_choose_sql("c_nationkey", *[x.upper() for x in SHORT])} AS NCES_name FROM r)""",
        select=f"""SELECT {_PAY_SQL}, lower(n_name || {_choose_sql("c_nationkey", *ENDINGS)}) AS location, 'CA' AS state,
  NCES_name, NCES_type, NCES_leaid, localid FROM named LEFT JOIN latest USING (NCES_name)"""),
    "state_nv": with_sql(
        RECORDS_SQL, _dim_sql("n_name"),
        "known AS (SELECT DISTINCT NCES_name, NCES_type, NCES_leaid, localid FROM dim)",
        select=f"""SELECT {_PAY_SQL}, lower(n_name) AS location, CASE WHEN NCES_leaid IS NOT NULL THEN 'NV' END AS state,
  place AS NCES_name, NCES_type, NCES_leaid, localid, '{v.SOURCES["NV"]}' AS source FROM r LEFT JOIN known ON NCES_name = place"""),
    "state_ks": with_sql(
        RECORDS_SQL, _dim_sql("n_name"),
        "known AS (SELECT DISTINCT NCES_name, NCES_type, NCES_leaid, localid FROM dim)",
        select=f"""SELECT CAST(year AS VARCHAR) AS year, round(round(o_totalprice, 2), 6) AS salary,
  upper(first[1]) || first[2:] AS name_first, CASE WHEN p_size % 4 <> 0 THEN (['Bea', 'Bea Cee', 'Bea Cee'])[p_size % 3 + 1] END AS name_middle,
  upper(last[1]) || last[2:] AS name_last, upper(n_name[1]) || lower(n_name[2:]) AS school_district,
  {_choose_sql("o_orderkey", *KS_TITLES)} AS position, o_orderkey % 6 IN (0, 2, 5) AS teacher, place AS NCES_name, NCES_type, NCES_leaid,
  localid AS NCES_localid, CASE WHEN NCES_leaid IS NOT NULL THEN 'KS' END AS state, '{v.SOURCES["KS"]}' AS source
FROM r LEFT JOIN known ON NCES_name = place"""),
    "state_ok": with_sql(
        RECORDS_SQL, _dim_sql("n_name", which="n_year = 2017"), f"""
k AS (SELECT *, 'OK-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-I001' AS lid,
    {_choose_sql("o_orderkey", *OK_TITLES)} AS title, o_orderkey % 3 AS site FROM r WHERE o_orderkey % 4 <> 2)""", """
t AS (SELECT o_custkey AS tk, year AS ty, sum(o_totalprice) AS base, sum(o_orderkey % 10) AS fringe,
    sum(CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END) AS extra, count(DISTINCT lid) AS n_districts, count(DISTINCT site) AS n_schools,
    count(DISTINCT title) AS n_position, count(DISTINCT o_orderkey % 5) AS n_subject FROM k GROUP BY ALL)""", """
best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY o_custkey, year ORDER BY o_totalprice DESC) = 1)""",
        select=f"""SELECT CAST(o_custkey AS VARCHAR) AS source_id, CAST(year AS VARCHAR) AS year, first AS name_first, last AS name_last,
  lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS county_id, n_name AS district_name, 'f' AS gender, CAST(o_orderkey % 4 AS VARCHAR) AS position_code,
  title AS position, CAST(p_size % 6 AS VARCHAR) AS race_code, p_brand AS race_desc, CAST(p_size % 4 AS VARCHAR) AS degree_code,
  p_type AS degree_desc, CAST(o_orderkey % 5 AS VARCHAR) AS subject_code, 's' || (o_orderkey % 5) AS subject_desc, '0.5' AS fte,
  round(base, 6) AS salary_base, CAST(fringe AS DOUBLE) AS salary_fringe, 0::DOUBLE AS salary_other, CAST(extra AS DOUBLE) AS salary_extra_duty,
  lid AS localid, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-I001-' || site AS school_id, n_districts, n_schools, n_position, n_subject,
  title IN ('TEACHER', 'RESOURCE TEACHER') AS teacher, d.NCES_name, NCES_leaid, 'OK' AS state, '{v.SOURCES["OK"]}' AS source
FROM best JOIN t ON tk = o_custkey AND ty = year LEFT JOIN (SELECT DISTINCT NCES_name, NCES_leaid, n_nationkey FROM dim) d
  ON d.n_nationkey = c_nationkey"""),
    "state_ga": with_sql(
        RECORDS_SQL, _dim_sql("CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' COUNTY' ELSE n_name END"), _KNOWN, f"""
named AS (SELECT *, place || {_choose_sql("c_nationkey", *ORGANISATIONS)} AS organisation,
    CASE c_nationkey % 5 WHEN 4 THEN place || ' (KIPP)' WHEN 3 THEN NULL ELSE place END AS plain FROM r)""", """
best AS (SELECT plain, k.* FROM (SELECT DISTINCT plain FROM named WHERE plain IS NOT NULL) JOIN known k ON contains(NCES_name, plain)
  QUALIFY row_number() OVER (PARTITION BY plain ORDER BY NCES_leaid, k.NCES_name) = 1)""",
        select=f"""SELECT round(o_totalprice, 6) AS salary, lower({_choose_sql("o_orderkey", *GA_TITLES)}) AS position, organisation AS location,
  year, upper(first) AS name_first, 'M' AS name_middle, upper(last) AS name_last, CASE WHEN p_size % 2 = 0 THEN 'JR' END AS name_other,
  o_orderkey % 4 IN (0, 3) AS teacher, 'GA' AS state, coalesce(b.NCES_name, n.plain) AS NCES_name, NCES_type, NCES_leaid, localid AS NCES_localid
FROM named n LEFT JOIN best b ON b.plain = n.plain"""),
    "state_il": with_sql(
        RECORDS_SQL, _dim_sql("n_name", which="n_year <> 2017"),
        "known AS (SELECT DISTINCT NCES_name, NCES_type, NCES_leaid FROM dim)",
        select=f"""SELECT CAST(year AS VARCHAR) AS year, round(o_totalprice, 6) AS salary, NULL::DOUBLE AS bonus,
  lower(first) AS name_first, 'q' AS name_middle, lower(last) AS name_last, NULL AS source_id, {_INITCAP.format("n_name")} AS school_district,
  {_choose_sql("o_orderkey", *IL_FIRST)} AS position, 's' AS school_name, {_choose_sql("o_orderkey", "F", "M")} AS gender, {_WHITE} AS race,
  '100' AS fte, c_nationkey || (o_orderkey % 7)::VARCHAR AS school_id, NULL::DOUBLE AS benefits, o_orderkey % 3 <> 1 AS teacher,
  'IL' AS state, '{v.SOURCES["IL"]}' AS source, place AS NCES_name, NCES_type, NCES_leaid
FROM r LEFT JOIN known ON NCES_name = place WHERE o_orderstatus <> 'F'
UNION ALL SELECT CAST(year AS VARCHAR), round(o_totalprice, 6), 1, lower(first), 'q', lower(last), CAST(o_custkey AS VARCHAR),
  {_INITCAP.format("n_name")}, {_choose_sql("o_orderkey", *IL_SECOND)}, 's', {_choose_sql("o_orderkey", "F", "M")}, {_WHITE}, '50',
  CAST(o_orderkey % 7 AS VARCHAR), 4.0 + o_orderkey % 3, o_orderkey % 2 = 0, 'IL', '{v.SOURCES["IL2"]}', place, NCES_type, NCES_leaid
FROM r LEFT JOIN known ON NCES_name = place WHERE o_orderstatus = 'F' AND o_orderkey % 5 % 3 <> 1"""),
    "state_in": with_sql(
        RECORDS_SQL, _dim_sql("n_name", "lpad(CAST(n_nationkey + 10 AS VARCHAR), 4, '0')"), """
alias AS (SELECT DISTINCT X, lpad(CAST(n_nationkey + 10 AS VARCHAR), 4, '0') AS localid FROM (
  SELECT n_nationkey, upper(n_name) || ' SCHOOLS' AS X FROM nation WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 2 <> 0))""", """
ids AS (SELECT DISTINCT localid, NCES_leaid FROM dim)""", """
a AS (SELECT DISTINCT X, localid, NCES_leaid FROM alias LEFT JOIN ids USING (localid))""", """
u AS (SELECT DISTINCT n_nationkey, lpad(CAST(n_nationkey + 10 AS VARCHAR), 4, '0') AS localid FROM nation WHERE n_nationkey % 4 <> 1)""", """
b AS (SELECT DISTINCT n_nationkey, localid, NCES_leaid FROM u LEFT JOIN ids USING (localid))""",
        select=f"""SELECT CAST(year AS VARCHAR) AS year, CAST(o_totalprice AS VARCHAR) AS salary, lower({_choose_sql("o_orderkey", *IN_TITLES)}) AS position,
  upper(n_name[1]) || lower(n_name[2:]) || ' Schools' AS location, upper(first) AS name_first, 'M' AS name_middle, upper(last) AS name_last,
  CASE WHEN p_size % 2 = 0 THEN 'JR' END AS name_other, o_orderkey % 4 IN (0, 2) AS teacher, 'IN' AS state,
  coalesce(a.localid, b.localid) AS NCES_localid, coalesce(a.NCES_leaid, b.NCES_leaid) AS NCES_leaid
FROM r LEFT JOIN a ON a.X = place || ' SCHOOLS' LEFT JOIN b ON b.n_nationkey = c_nationkey"""),
    "state_nd": with_sql(
        RECORDS_SQL, _dim_sql("n_name", "CAST(n_nationkey AS VARCHAR)", "TRUE"),
        "known AS (SELECT DISTINCT lower(NCES_name) AS NCES_name, NCES_leaid, localid FROM dim)",
        select=f"""SELECT CAST(o_custkey AS VARCHAR) AS source_id, CAST(o_totalprice AS VARCHAR) AS salary,
  {_choose_sql("o_orderkey", "Teacher", "Principal")} AS position, year, lower(place) AS school_district, NULL AS name_first, NULL AS name_middle,
  NULL AS name_last, NULL AS name_other, o_orderkey % 2 = 0 AS teacher, 'ND' AS state, '{v.SOURCES["ND"]}' AS source, NCES_name, NCES_leaid, localid
FROM r LEFT JOIN known ON NCES_name = lower(place)"""),
    "state_ny": with_sql(
        RECORDS_SQL, _dim_sql("n_name"), """
known AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN lower(NCES_name) || ' school district' WHEN 1 THEN lower(NCES_name) || ' central school district'
    ELSE lower(NCES_name) || '  school district' END AS NCES_name, NCES_type, NCES_leaid, localid FROM dim)""", """
spelt AS (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN ' public schools' WHEN 1 THEN ' csd' ELSE ' city school district' END AS ending FROM r)""", """
named AS (SELECT *, lower(place) || ending AS school_district, CASE c_nationkey % 3 WHEN 0 THEN lower(place) || '  school district'
    WHEN 1 THEN lower(place) || ' csd' ELSE lower(place) || '  school district' END AS plain,
    CASE WHEN c_nationkey % 3 = 1 THEN lower(place) || ' central school district' END AS curated FROM spelt)""",
        select=f"""SELECT round(o_totalprice, 6) AS salary, CAST(CASE WHEN year % 3 = 0 THEN 2008 ELSE year END AS DOUBLE) AS year, school_district,
  lower(first) AS name_first, 'q' AS name_middle, lower(last) AS name_last, CASE WHEN p_size % 2 = 0 THEN 'jr' END AS name_other,
  o_orderkey % 2 = 0 AS teacher, 'NY' AS state, '{v.SOURCES["NY"]}' AS source, coalesce(k1.NCES_name, k2.NCES_name) AS NCES_name,
  coalesce(k1.NCES_leaid, k2.NCES_leaid) AS NCES_leaid, coalesce(k1.localid, k2.localid) AS localid, coalesce(k1.NCES_type, k2.NCES_type) AS NCES_type
FROM named LEFT JOIN known k1 ON k1.NCES_name = plain LEFT JOIN known k2 ON k2.NCES_name = curated WHERE year % 3 <> 0"""),
    "state_oh": with_sql(
        RECORDS_SQL, f"""
k AS (SELECT *, dense_rank() OVER (ORDER BY last, first) AS id, {_choose_sql("o_orderkey", *OH_TITLES)} AS title, o_orderkey % 200 AS days FROM r)""", """
t AS (SELECT id, year, sum(o_totalprice) AS salary, count(DISTINCT place) AS n_districts, count(DISTINCT o_orderkey % 3) AS n_schools,
    count(DISTINCT title) AS n_position, max(days) AS days FROM k GROUP BY ALL)""", """
n AS (SELECT DISTINCT id, first, last FROM k)""",
        select=f"""SELECT id, year, (year - 1) || '_' || year AS year2, lower(first) AS name_first, 'q' AS name_middle, lower(last) AS name_last,
  'c' AS county, 't' AS city, CAST(days AS DOUBLE) AS days_worked, round(salary, 6) AS salary, 7.0::DOUBLE AS hours_worked, n_districts, n_schools,
  n_position, 'OH' AS state, '{v.SOURCES["OH"]}' AS source FROM t JOIN n USING (id)"""),
    "state_pa": with_sql(
        RECORDS_SQL, _dim_sql("n_name"), _KNOWN,
        select=f"""SELECT CAST(year AS VARCHAR) AS year, (year - 1) || '_' || year AS year2, first AS name_first, NULL AS name_middle, last AS name_last,
  CASE WHEN year % 2 = 1 THEN 'jr' END AS name_other, {_choose_sql("o_orderkey", "Secondary", "Clerk", "Ungraded Teacher")} AS position,
  {_INITCAP.format("n_name")} AS lea_name, round(o_totalprice, 6) AS salary, CAST(o_custkey AS VARCHAR) AS source_id, o_orderkey % 3 <> 1 AS teacher,
  place AS NCES_name, NCES_type, NCES_leaid, localid, 'PA' AS state, '{v.SOURCES["PA"]}' AS source
FROM r LEFT JOIN known ON NCES_name = place"""),
    "state_mi": with_sql(
        RECORDS_SQL, _dim_sql("CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' PUBLIC' ELSE n_name END"), _KNOWN, """
w AS (SELECT o_custkey, year, first, last, place, c_nationkey, p_type, sum(o_totalprice) AS pay FROM r GROUP BY ALL)""", """
people AS (SELECT DISTINCT o_custkey, first, last, place, c_nationkey, p_type FROM w WHERE o_custkey % 10 = 3)""", """
long AS (SELECT CAST(o_custkey AS VARCHAR) AS deid, year, first, last, place, c_nationkey, p_type, pay FROM w WHERE o_custkey % 10 <> 3
  UNION ALL SELECT 'new' || o_custkey, year, first, last, place, c_nationkey, p_type, 5.0 FROM people, (SELECT DISTINCT year FROM r))""",
        select=f"""SELECT year, lower(first) AS name_first, 'q' AS name_middle, lower(last) AS name_last, lower(p_type) AS position, round(pay, 6) AS salary,
  place AS school_district, CASE WHEN c_nationkey % 2 = 0 THEN place || ' PUBLIC' ELSE place END AS NCES_name, NCES_type, NCES_leaid,
  localid AS NCES_localid, 'MI' AS state, '{v.SOURCES["MI"]}' AS source
FROM long LEFT JOIN known ON known.NCES_name = CASE WHEN c_nationkey % 2 = 0 THEN place || ' PUBLIC' ELSE place END"""),
    "state_wi": with_sql(
        RECORDS_SQL, f"""
k AS (SELECT * REPLACE ([{", ".join(map(str, WI_YEARS))}][(year - 1995) % {len(WI_YEARS)} + 1] AS year),
    lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS local FROM r)""", f"""
best AS (SELECT *, CASE WHEN year < 2017 THEN {_choose_sql("o_orderkey", *WI_CODES)} ELSE {_choose_sql("o_orderkey", "53", "88")} END AS code FROM k
  QUALIFY row_number() OVER (PARTITION BY o_custkey, year ORDER BY o_totalprice DESC) = 1)""",
        select=f"""SELECT CAST(year AS BIGINT) AS year, lower(last) AS name_last, lower(first) AS name_first,
  CASE WHEN year < 2017 THEN '1960' ELSE '1970' END AS birth_year, {_choose_sql("o_orderkey", "F", "M")} AS gender,
  CASE WHEN year < 2017 THEN {_choose_sql("p_size", "4", "5", "9")} ELSE {_choose_sql("p_size", "4", "5")} END AS degree,
  round(o_totalprice, 2) AS salary, CAST(o_orderkey % 1000 AS DOUBLE) AS salary_fringe, CAST(p_size AS VARCHAR) AS experience_local,
  CAST(p_size + o_orderkey % 3 AS VARCHAR) AS experience_total, code AS position_code,
  CASE WHEN code <> '88' THEN 'Title ' || ltrim(code, '0') END AS position_title, local AS localid,
  lpad(CAST(o_custkey % 97 AS VARCHAR), 4, '0') AS school_id,
  CASE WHEN year >= 2017 THEN 'e' || o_custkey WHEN year >= 2015 THEN 'f' || o_custkey END AS source_id, CAST(o_custkey AS VARCHAR) AS other_id,
  CASE WHEN year < 2017 THEN (['White', 'Asian', NULL])[p_size % 3 + 1] ELSE (['White', 'Hispanic', 'TwoOrMore'])[p_size % 3 + 1] END AS race,
  CASE WHEN year < 2017 THEN (['Bachelor', 'Masters', NULL])[p_size % 3 + 1] ELSE (['Bachelor', 'Masters'])[p_size % 2 + 1] END AS degree_title,
  code = '53' AS teacher, CASE WHEN c_nationkey % 5 <> 4 THEN place END AS NCES_name,
  CASE WHEN c_nationkey % 5 <> 4 THEN lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || 'a' END AS NCES_leaid, 'WI' AS state,
  '{v.SOURCES["WI"]}' AS source FROM best"""),
}
