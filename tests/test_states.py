"""Each state job on a few literal records."""

import pytest
from pyspark.sql import functions as F

from personyear.plans import compile as compiling
from personyear.plans import states
from personyear.plans.reports import availability, without_hole
from personyear.sources import delimited

DIM = "year int, state string, NCES_name string, NCES_type string, NCES_leaid string, localid string"


def frame(spark, names, *rows):
    schema = ", ".join(f"`{name}` string" for name in names)
    return spark.createDataFrame([tuple(row) for row in rows], schema)


def dim(spark, *rows):
    return spark.createDataFrame(list(rows), DIM)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


PAY = ["Employee Name", "Job Title", "Base Pay", "Overtime Pay", "Other Pay", "Benefits", "Total Pay",
       "Total Pay & Benefits", "Year", "Agency", "Status"]


def pay(name, title, agency):
    return (name, title, "Not Provided", "1", "2", "3", "40.5", "50", "2014", agency, None)


def test_ca(spark):
    raw = frame(spark, PAY, pay("Ann B. Lee Jr", "Math TCHR", "Camino Union School District"), pay("Lee, Bo", "Teacher Aide", "Twin School"))
    ref = dim(
        spark,
        (2010, "CA", "Camino Union Elem", "1", "06A", "l1"), (2012, "CA", "Camino Union Elem", "1", "06B", "l2"),
        (2012, "CA", "Camino Union Elem", "2", "06C", "l3"), (2012, "CA", "Twin School", "1", "06D", "l4"),
        (2012, "CA", "Twin School", "1", "06E", "l5"), (2017, "CA", "Camino Union Elem", "0", "CA06", "x"),
    )
    rows = {r.name_first: r for r in states.clean_ca(raw, ref).collect()}
    assert len(rows) == 2
    assert (rows["ann"].NCES_leaid, rows["ann"].teacher, rows["ann"].salary_total, rows["ann"].salary_base) == ("06B", True, 40.5, None)
    assert (rows["bo"].NCES_leaid, rows["bo"].teacher, rows["bo"].state) == (None, False, "CA")


def test_nv(spark):
    raw = frame(spark, PAY, pay("Lee, Ann", "Teacher", "Elko"), pay("Bo Day", "Clerk", "Nowhere"))
    rows = {r.name_first: r for r in states.clean_nv(raw, dim(spark, (2012, "NV", "ELKO", "1", "32A", "n"))).collect()}
    assert (rows["ann"].state, rows["ann"].NCES_leaid) == ("NV", "32A")
    assert rows["bo"].state is None


def test_ga(spark):
    raw = frame(
        spark, ["NAME", "TITLE", "SALARY", "ORGANIZATION", "FISCAL_YEAR"],
        ("PEÑA,JR,ANN M", "GRADE 4", "10", "BIBB BOARD OF EDUCATION", "2012"),
        ("LEE,BO", "SUBSTITUTE TEACHER", "5", "CITY OF ROME SCHOOL DISTRICT", "2012"),
        ("DAY,CY", "CLERK", "5", "PORTS AUTHORITY", "2012"),
        ("FOX,DI", "CLERK", "5", "CHARTER SCHOOL", "2012"),
        ("ELM,ED", "CLERK", "5", "KIPP (METRO ATLANTA", "2012"),
        ("OAK,FY", "CLERK", "5", "LONE ACADEMY", "2012"),
    )
    ref = dim(spark, (2012, "GA", "BIBB COUNTY", "1", "13B", "b"), (2012, "GA", "ROME CITY", "1", "13R", "r"))
    rows = {r.name_first: r for r in states.clean_ga(raw, ref).collect()}
    assert (rows["ANN"].name_last, rows["ANN"].name_other, rows["ANN"].NCES_leaid, rows["ANN"].teacher) == ("PENA", "JR", "13B", True)
    assert (rows["BO"].NCES_leaid, rows["BO"].teacher) == ("13R", False)
    assert rows["CY"].NCES_leaid is None and rows["CY"].NCES_name is None
    # Nothing left of a name fits no district, marks are literal, and a cleaned name without a district stays.
    assert (rows["DI"].NCES_leaid, rows["DI"].NCES_name) == (None, None)
    assert (rows["ED"].NCES_leaid, rows["ED"].NCES_name) == (None, "KIPP (METRO ATLANTA")
    assert (rows["FY"].NCES_leaid, rows["FY"].NCES_name) == (None, "LONE")


def test_il(spark):
    first = frame(
        spark, ["fy", "salary", "first_name", "mid_init", "last_name", "dst_name", "pos_desc", "sch_name", "gender",
                "race_ethnicity_desc", "fte", "rcdt", "sch_num"],
        ("2010", "10", "ANN", "B", "LEE", "Alton", "Kindergarten", "s", "Female", "White", "100", "1", "2"),
    )
    second = frame(
        spark, ["School Year", "Salary", "Bonus", "First name", "Middle Name", "Last Name", "ID Number", "Employer",
                "Position", "Primary Working Location RCDTS", "Primary Working Location Name", "Gender", "Race/Ethnicity",
                "Retired Staff", "Full Time Equivalent", "Retirement Benefits", "Other Benefits", "Annuities"],
        ("2014", "20", "1", "BO", None, "DAY", "77", "Alton", "PE Teacher", "r", "s", "M", "Unknow", "No", "0.5", "1", "2", "3"),
        ("2014", "20", "1", "CY", None, "DAY", "78", "Alton", "PE Teacher", "r", "s", "M", "NULL", "Yes", "1", "1", "2", "3"),
    )
    rows = {r.name_first: r for r in states.clean_il(first, second, dim(spark, (2012, "IL", "ALTON", "1", "17A", "z"))).collect()}
    assert set(rows) == {"ann", "bo"}
    assert (rows["ann"].teacher, rows["ann"].gender, rows["ann"].race, rows["ann"].NCES_leaid) == (True, "F", "White", "17A")
    assert (rows["bo"].fte, rows["bo"].benefits, rows["bo"].race, rows["bo"].teacher) == ("50", 6.0, "Unknown", True)


def test_in(spark):
    raw = frame(
        spark, ["employee", "year", "total_compensation", "job_title", "department", "unit_id"],
        ("Lee, JR, Ann J R", "2012", "10", "Grade 3", "Adams Schools", "u1"),
        ("Day, Estate of Bo", "2012", "10", "Teacher", "Adams Schools", "u1"),
        ("Fox, Cy", "2012", "10", "Aid", "Other", "u2"),
    )
    crosswalk = frame(
        spark, ["localid", "unit_id", "NCES_name", "X4", "X5"],
        ("15", None, "A", "ADAMS SCHOOLS", ""), ("200", "u2", "B", None, None), ("9770", "*", "C", "OTHER", None),
    )
    ref = dim(spark, (2012, "IN", "A", "1", "18A", "0015"), (2012, "IN", "B", "1", "18B", "0200"))
    rows = {r.name_first: r for r in states.clean_in(raw, crosswalk, ref, ["X4", "X5"]).collect()}
    assert set(rows) == {"ANN", "CY"}
    assert (rows["ANN"].NCES_leaid, rows["ANN"].NCES_localid, rows["ANN"].name_middle, rows["ANN"].teacher) == ("18A", "0015", "JR", True)
    assert (rows["CY"].NCES_leaid, rows["CY"].teacher) == ("18B", False)


def test_ks(spark):
    raw = frame(
        spark, ["Year", "Total Pay", "First Name", "Last Name", "District", "Position"],
        ("2014", "$1,200.50", "Ann Bea Cee Dee", "Lee", "Riley", "Art"), ("2014", "$5", "Bo", "Day", "Blue Valley", "Sub Teacher"),
    )
    ref = dim(spark, (2012, "KS", "Riley County", "1", "20R", "r"), (2012, "KS", "Blue Valley", "1", "2010980", "b"),
              (2012, "KS", "Blue Valley", "1", "2012000", "c"))
    rows = {r.name_first: r for r in states.clean_ks(raw, ref).collect()}
    assert (rows["Ann"].salary, rows["Ann"].name_middle, rows["Ann"].teacher, rows["Ann"].NCES_leaid) == (1200.5, "Bea Cee", True, "20R")
    assert (rows["Bo"].teacher, rows["Bo"].NCES_leaid, rows["Bo"].state) == (False, "2012000", "KS")


def test_mi(spark):
    number = lambda df: df.withColumn("ordinal", F.col("ordinal").cast("long"))
    a = number(frame(spark, ["ordinal", "deid", "fst_nm", "last_nm"], ("0", "1", "Ann Bea", "LEE"), ("1", "2", "Bo", "DAY")))
    b = number(frame(spark, ["ordinal", "job_class", "org_nm"], ("0", "Teaching", "Alma"), ("1", "Clerk", "Troy")))
    c = number(frame(spark, ["ordinal", "sum_wag_amt_2011", "sum_wag_amt_2012"], ("0", "10", "0"), ("1", "7", None)))
    insert = frame(spark, ["deid", "fst_nm", "last_nm", "job_class", "org_nm", "sum_wag_amt_2011"], ("3", "Cy", "Fox", "x", "Alma", "9"))
    rows = states.clean_mi([a, b, c], frame(spark, ["deid"], ("2",)), insert, frame(spark, ["MI_name", "NCES_name"], ("ALMA", "ALMA PUBLIC")),
                           dim(spark, (2012, "MI", "Alma Public", "1", "26A", "m"))).collect()
    got = sorted((r.year, r.name_first, r.name_middle, r.salary, r.NCES_leaid) for r in rows)
    assert got == [(2011, "ann", "bea", 10.0, "26A"), (2011, "cy", None, 9.0, "26A")]


def test_ny(spark):
    raw = frame(
        spark, ["WholeName", "YTDPay", "PayYear", "AgencyName", "SubAgencyName"],
        ("Lee, Ann Bea,, Sr", "10", "2012", "Ford Edward Schools", "NYSTRS - Educator"),
        ("Day, Bo", "10", "2012", "Odd Name", None), ("Fox, Cy", "10", "2008", "Odd Name", "x"),
    )
    links = frame(spark, ["school_district", "NCES_name"], ("odd name", "plain central school district"))
    ref = dim(spark, (2012, "NY", "Fort Edward School District", "1", "36F", "f"), (2012, "NY", "Plain CSD", "1", "36P", "p"))
    rows = {r.name_first: r for r in states.clean_ny(raw, links, ref).collect()}
    assert set(rows) == {"ann", "bo"}
    assert (rows["ann"].NCES_leaid, rows["ann"].name_other, rows["ann"].teacher) == ("36F", "sr", True)
    assert (rows["bo"].NCES_leaid, rows["bo"].teacher) == ("36P", None)


def test_nd(spark):
    raw = frame(spark, ["filename", "LicenseNumber", "SALincCOMP", "P1_Desc", "DistrictName"], ("2015ECR.csv", "9", "10", "Teacher", "Fargo"))
    row = one(states.clean_nd(raw, dim(spark, (2017, "ND", "FARGO", "1", "38F", "ND-0901"))))
    assert (row["year"], row["source_id"], row["teacher"], row["localid"], row["NCES_name"]) == (2015, "9", True, "0901", "fargo")
    assert row["name_first"] is None and row["state"] == "ND"


def test_oh(spark):
    raw = frame(
        spark, ["filename", "LASTNAME", "FIRSTNAME", "COUNTY", "CITYNAME", "SCHOOLNAME", "DISTRICTNAME", "DAYSWORKED",
                "HOURSWORKEDPERDAY", "EDUCATIONLEVEL", "PAYAMOUNT", "JOBDESCRIPTION", "Last_Name", "First_Name", "Salary"],
        ("2008_x", "LEE ", "ANN MAY", "c", "t", "s1", "Ada", "180", "8", "d", "10", "TEACHER", None, None, None),
        ("2008_x", "LEE", "ANN", "c", "t", "s2", "Bay", "20", "8", "d", "5", "CLERK", None, None, None),
        ("2012-2013_x", None, None, "c", "t", "s2", "Bay", "20", "8", "d", None, "CLERK", "Lee", "Ann", "7"),
    )
    ref = dim(spark, (2012, "OH", "Ada", "1", "39A", "a"), (2012, "OH", "Bay", "1", "39B", "b"), (2012, "OH", "Bay", "1", "39C", "c"))
    rows = {r.year: r for r in states.clean_oh(raw, ref).collect()}
    assert (rows[2008].salary, rows[2008].n_districts, rows[2008].NCES_leaid, rows[2008].teacher) == (15.0, 2, "39A", True)
    assert (rows[2013].NCES_leaid, rows[2013].id, rows[2013].year2, rows[2013].teacher) == (None, rows[2008].id, "2012_2013", False)


def ok_raw(spark, *rows):
    names = ["year", "TeacherNumber", "Teacher Number", "staff_id", "fname", "lname", "county_name", "co", "dist", "site",
             "district_name", "school_name", "gender", "jobdesc", "jobcode", "subject", "fte", "FTE", "base_salary",
             "total_fringe", "total_oth_salary", "total_extra_duty", "race", "race_desc", "degree", "degree_desc", "subject_desc"]
    # names that differ in case alone come from different files, never from one
    names = [n for n in names if n != "FTE"]
    return frame(spark, names, *rows)


def test_ok(spark):
    line = lambda number, alt, title, fte, base: ("2008", number, alt, "x", "ANN", "LEE", "c", "01", "I002", "105", "d", "s", "F", title, "1", "m", fte, base, "1", None, None, "4", "White", "2", "Master", "Algebra")
    raw = ok_raw(spark, line("5", None, "TEACHER", "0.6", "10"), line(None, "5", "COACH", "0.4", "30"), line("5", None, "TOTAL OTHER PAY", "9", "99"))
    row = one(states.clean_ok(raw, dim(spark, (2017, "OK", "Ada", "1", "40A", "OK-01-I002"))))
    assert (row["position"], row["teacher"], row["salary_base"], row["salary_other"], row["n_position"]) == ("TEACHER", True, 40.0, 0.0, 2)
    assert (row["NCES_leaid"], row["localid"], row["source_id"]) == ("40A", "OK-01-I002", "5")
    kept = ("race_code", "race_desc", "degree_code", "degree_desc", "subject_desc")
    assert [row[name] for name in kept] == ["4", "White", "2", "Master", "Algebra"]


def test_pa(spark):
    names = ["year", "name_first", "name_last", "position_description", "lea_name"]
    sheets = {"2007_2008": frame(spark, names, ("2008", "ann", "lee", "Secondary", "Avon")),
              "2008_2009": frame(spark, [*names, "name_suffix"], ("2009", "bo", "day", "Clerk", "Bly", "jr"))}
    rows = {r.name_first: r for r in states.clean_pa(sheets, dim(spark, (2012, "PA", "Avon", "1", "42A", "a"))).collect()}
    assert (rows["ann"].teacher, rows["ann"].NCES_leaid, rows["ann"].year2) == (True, "42A", "2007_2008")
    assert (rows["bo"].teacher, rows["bo"].name_other) == (False, "jr")


def test_wi(spark):
    old = frame(spark, ["year_and_session", "last_name", "name_first", "birth_year", "id_number", "sex", "race", "highest_degree", "salary",
                        "position_code", "agency_of_work_location"],
                ("1996A", "LEE", "ANN", "1960", "7", "F", "W", "5", "100", "53", "0007"), ("1996A", "LEE", "ANN", "1960", "7", "F", "W", "5", "20", "9", "0007"))
    new = frame(spark, ["last_name", "name_first", "birth_year", "research_id", "entity_id", "gender", "raceethnicity", "contract_high_degree",
                        "total_salary", "assignment_position", "assignment_work_agency"],
                ("Day", "Bo", "1970", "8", "e8", "M", "H - Hispanic/Latino", "4 - Bachelor", "$1,000", "53 - Teacher", "0009 - Bay"))
    codes = frame(spark, ["Variable", "Code", "Description"], ("position_code", "53", "Teacher"), ("position_code", "9", "Aide"), ("x", "53", "y"))
    files = {"old": states.wi_fixed_width_year(old), "new": new.withColumn("year", F.lit(2017))}
    ref = dim(spark, (2012, "WI", "Ada", "1", "55A", "0007"), (2012, "WI", "CEO LEADERSHIP ACADEMY AGENCY", "1", "55X", "0007"))
    rows = {r.name_first: r for r in states.clean_wi(files, codes, ref).collect()}
    assert (rows["ann"].salary, rows["ann"].teacher, rows["ann"].NCES_leaid, rows["ann"].race, rows["ann"].degree_title) == (100.0, True, "55A", "White", "Masters")
    assert (rows["bo"].salary, rows["bo"].localid, rows["bo"].position_title, rows["bo"].race, rows["bo"].source_id) == (1000.0, "0009", "Teacher", "Hispanic", "e8")


def test_wi_layouts_follow_corrected_lengths(spark, tmp_path):
    fields = [("ID Number", 4), ("Year and Session", 5), ("Filler", 122), ("Filler", 15), ("Position Code", 2), ("Salary", 6)]
    formats = []
    for era in (95, 99, 4, 8, 12):
        begin = 1
        for variable, length in fields:
            formats.append((era, variable, begin, 9 if (era, begin) == (12, 1) else length))
            begin += length
    found = states.wi_layouts(formats)
    assert sorted(found) == [1995, 1999, 2004, 2008, 2012]
    assert [(s.variable, s.start, s.length) for s in found[2004][2:]] == [
        ("filler", 10, 122), ("filler.1", 132, 14), ("position_code", 146, 2), ("salary", 148, None),
    ]
    assert [(s.start, s.length) for s in found[2012][:2]] == [(1, 10), (11, 5)]
    files = {}
    for year, quote, gap in ((1998, "", 137), (2003, "", 137), (2007, "", 136), (2011, "", 137), (2014, '"', 137)):
        size = 9 if year > 2011 else 4
        files[year] = str(tmp_path / f"{year}.txt")
        lines = [f"{quote}{who:{size}}{year}A{' ' * gap}53{pay}" for who, pay in (("7", "100"), ("8", "  2500.75"))]
        (tmp_path / f"{year}.txt").write_text("\n".join(lines) + "\n")
    rows = states.read_wi_text(spark, files, formats).collect()
    assert sorted((r.year, r.id_number, r.position_code, r.salary) for r in rows) == [
        (year, who, "53", pay) for year in sorted(files) for who, pay in (("7", "100"), ("8", "2500.75"))
    ]


def test_compile_links_and_guard(spark):
    names = "state string, year int, source_id string, index long"
    original = spark.createDataFrame([("OK", 2010, "12", 1), ("ND", 2010, "9", 2), ("IL", 2010, None, 3)], names)
    linked = original.where("state <> 'ND'").withColumn("ensemble_id", F.col("index") + 100).withColumn("ensemble_id_2010", F.lit(1))
    done = compiling.compile_links(linked, original)
    assert {r.state: r.id for r in done.collect()} == {"OK": "000012", "ND": "9", "IL": "103"}
    assert "ensemble_id_2010" not in done.columns
    with pytest.raises(ValueError):
        compiling.compile_links(linked.limit(1), original)


def test_hole_and_availability(spark):
    panel = spark.createDataFrame([("ND", 2016, "TRUE"), ("ND", 2018, "TRUE"), ("OK", 2018, None), (None, 2018, "TRUE")], "state string, year int, teacher string")
    assert without_hole(panel).count() == 2
    rows = {r.state: (r.years, r.total_records, r.proportion_teacher) for r in availability(panel).collect()}
    assert rows == {"ND": ("2016-2016", 1, "100%"), "OK": ("2018-2018", 1, "0%")}


def test_compact_schema():
    schema = delimited.compact_schema(["year", "state"], "dc")
    assert schema.simpleString() == "struct<year:double,state:string>"
    with pytest.raises(ValueError):
        delimited.compact_schema(["a"], "dd")
