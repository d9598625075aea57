"""The thirteen state sources.

Each job takes the raw records of its state (see :mod:`personyear.sources`) and
the district reference table, and returns records in the common schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import keyword_flag, lacks_pattern, member, mentions, not_member
from ..functions.numbers import leading_file_year, scaled_text, school_year_label
from ..functions.text import (
    blank_to_null,
    pad_left,
    part,
    prefix_to_suffix,
    remove_words,
    repair_bytes,
    replace_each,
)
from ..operators.joins import (
    attach,
    attach_common,
    attach_first_match,
    classify_labels,
    correct,
    first_by,
    stitch,
    substring_matches,
    unique_rows,
)
from ..operators.project import banded, code_titles, recode_exact, recode_sets
from ..operators.reshape import unpivot_aliases, unpivot_years
from ..operators.sets import union_labeled
from ..operators.windows import group_index
from ..session import measured
from ..sources.fixed_width import Slot, layout, read_fixed_width
from . import fixed_values as v
from .standardize import Collapse, District, SourceSpec, standardize

PAY_COLUMNS = {
    "position": ["Job Title"],
    "salary_base": ["Base Pay"],
    "salary_overtime": ["Overtime Pay"],
    "salary_other": ["Other Pay"],
    "salary_benefits": ["Benefits"],
    "salary_total": ["Total Pay"],
    "salary_total_benefits": ["Total Pay & Benefits"],
    "year": ["Year"],
    "location": ["Agency"],
}
PAY_NUMBERS = tuple(name for name in PAY_COLUMNS if name.startswith("salary")) + ("year",)


def _teach() -> Column:
    return keyword_flag("position", v.TEACH_WORDS, v.NOT_TEACH_WORDS)


# ---------------------------------------------------------------- CA and NV

def latest_unique(dim: DataFrame) -> DataFrame:
    """Per name the rows of its latest year and smallest type, if that leaves one row."""
    ends = dim.groupBy("NCES_name").agg(
        F.max("year").alias("year"), F.min("NCES_type").alias("NCES_type")
    )
    rows = dim.join(ends, ["NCES_name", "year", "NCES_type"], "left_semi").distinct()
    return unique_rows(rows, ["NCES_name"])


def clean_ca(raw: DataFrame, dim: DataFrame) -> DataFrame:
    spec = SourceSpec(
        state="CA",
        columns=PAY_COLUMNS,
        names=("Employee Name", "any_order"),
        lower=("position", "location"),
        numbers=PAY_NUMBERS,
        teacher=_teach,
    )
    rows = standardize(raw, None, spec)
    rows = rows.withColumn("NCES_name", replace_each(F.upper("location"), v.CA_NAME_ENDINGS))
    rows = recode_exact(rows, "NCES_name", v.CA_DISTRICT_NAMES)
    rule = District(prepare=latest_unique)
    return attach(rows, rule.reference(dim, "CA").drop("state"), ["NCES_name"])


NV = SourceSpec(
    state="NV",
    columns=PAY_COLUMNS,
    source=v.SOURCES["NV"],
    names=("Employee Name", "any_order"),
    lower=("position", "location"),
    numbers=PAY_NUMBERS,
    teacher=_teach,
    district=District(label=lambda df: F.upper("location")),
    state_from_reference=True,
)


def clean_nv(raw: DataFrame, dim: DataFrame) -> DataFrame:
    return standardize(raw, dim, NV)


# ---------------------------------------------------------------- GA

def ga_districts(labels: DataFrame, dim: DataFrame) -> DataFrame:
    """District of each school organisation: same name, or its name found inside a district name.

    Names are literals, whatever marks they hold.  An organisation all of whose
    words are dropped fits no district.  One without a district keeps its cleaned
    name as ``NCES_name``.
    """
    schools = labels.select("location").distinct().where(mentions("location", v.GA_SCHOOL_WORDS))
    stripped = remove_words("location", v.GA_DROPPED_WORDS)
    plain = F.trim(prefix_to_suffix(stripped, "CITY OF", "CITY"))
    schools = recode_exact(schools.withColumn("plain", plain), "plain", v.GA_DISTRICT_NAMES)
    reference = District().reference(dim, "GA").drop("state")
    exact = schools.join(reference, F.col("plain") == F.col("NCES_name"))
    named = schools.where("plain <> ''")
    found = substring_matches(reference, "NCES_name", named, "plain")
    inside = (
        named.join(found, F.col("plain") == F.col("pattern"))
        .join(reference, F.col("label") == F.col("NCES_name"))
        .select(*exact.columns)
    )
    order = [F.col("NCES_leaid").asc_nulls_last(), F.col("NCES_name")]
    known = first_by(exact.unionByName(inside), ["location"], order).drop("plain")
    values = [name for name in known.columns if name != "location"]
    return attach(schools, known, ["location"]).select(
        "location",
        *[F.coalesce("NCES_name", F.nullif("plain", F.lit(""))).alias(name) if name == "NCES_name" else F.col(name) for name in values],
    )


def clean_ga(raw: DataFrame, dim: DataFrame) -> DataFrame:
    spec = SourceSpec(
        state="GA",
        columns={
            "salary": ["SALARY"],
            "position": ["TITLE"],
            "location": ["ORGANIZATION"],
            "year": ["FISCAL_YEAR"],
        },
        prepare=lambda df: df.withColumn("NAME", repair_bytes("NAME")),
        names=("NAME", "last_first_suffix"),
        lower=("position",),
        teacher=lambda: keyword_flag("position", v.GA_TEACH_WORDS, v.GA_NOT_TEACH_WORDS),
    )
    rows = standardize(raw, None, spec)
    matched = attach(rows, measured(ga_districts(rows, dim), "districts"), ["location"])
    return matched.withColumnRenamed("localid", "NCES_localid")


# ---------------------------------------------------------------- IL

_IL_DISTRICT = District(label=lambda df: F.upper("school_district"), drop=("year", "localid"))

IL_SERVICE_RECORD = SourceSpec(
    state="IL",
    columns={
        "year": ["fy"],
        "salary": ["salary"],
        "name_first": ["first_name"],
        "name_middle": ["mid_init"],
        "name_last": ["last_name"],
        "school_district": ["dst_name"],
        "position": ["pos_desc"],
        "school_name": ["sch_name"],
        "gender": ["gender"],
        "race": ["race_ethnicity_desc"],
        "fte": ["fte"],
    },
    source=v.SOURCES["IL"],
    derived={"school_id": lambda df: F.concat("rcdt", "sch_num")},
    lower=("name_first", "name_middle", "name_last"),
    numbers=("salary",),
    teacher=lambda: member("position", v.IL_TEACH_POSITIONS),
)

IL_EMPLOYMENT_SYSTEM = SourceSpec(
    state="IL",
    columns={
        "year": ["School Year"],
        "salary": ["Salary"],
        "bonus": ["Bonus"],
        "name_first": ["First name"],
        "name_middle": ["Middle Name"],
        "name_last": ["Last Name"],
        "source_id": ["ID Number"],
        "school_district": ["Employer"],
        "position": ["Position"],
        "school_id": ["Primary Working Location RCDTS"],
        "school_name": ["Primary Working Location Name"],
        "gender": ["Gender"],
        "race": ["Race/Ethnicity"],
        "retired": ["Retired Staff"],
    },
    source=v.SOURCES["IL2"],
    derived={
        "fte": lambda df: scaled_text("Full Time Equivalent", 100.0),
        "benefits": lambda df: F.col("Retirement Benefits").try_cast("double")
        + F.col("Other Benefits").try_cast("double")
        + F.col("Annuities").try_cast("double"),
    },
    lower=("name_first", "name_middle", "name_last"),
    numbers=("salary", "bonus"),
    keep=lambda: F.col("retired").isin(v.IL_NOT_RETIRED),
    teacher=lambda: F.upper("position").contains("TEACHER"),
    finish=lambda df: df.drop("retired"),
)


def clean_il(service_record: DataFrame, employment_system: DataFrame, dim: DataFrame) -> DataFrame:
    vintages = {
        "first": standardize(service_record, None, IL_SERVICE_RECORD),
        "second": standardize(employment_system, None, IL_EMPLOYMENT_SYSTEM),
    }
    rows = union_labeled(vintages).withColumns(
        {
            "gender": recode_sets("gender", v.GENDER_CODES),
            "race": recode_sets("race", v.IL_RACE_CODES),
            "NCES_name": F.upper("school_district"),
        }
    )
    return attach(rows, _IL_DISTRICT.reference(dim, "IL").drop("state"), ["NCES_name"])


# ---------------------------------------------------------------- IN

def four_digits(value) -> Column:
    """Ids of two or three digits padded to four; other lengths are not ids."""
    text = F.col(value).cast("string")
    return F.when(F.length(text).between(2, 4), pad_left(text, 4))


def in_crosswalks(crosswalk: DataFrame, dim: DataFrame, aliases: list[str]) -> tuple[DataFrame, DataFrame]:
    """(alias to district, unit to district) from the wide curated table."""
    reference = District().reference(dim, "IN").drop("NCES_name", "NCES_type")
    mended = crosswalk.withColumns({name: repair_bytes(name) for name in aliases})
    known = mended.where(
        blank_to_null(F.col(aliases[0])).isNotNull() & (F.col(aliases[0]) != v.IN_DROPPED_ALIAS)
    ).select("localid", *aliases)
    by_alias = unpivot_aliases(known, ["localid"], aliases, "X").withColumn("localid", four_digits("localid"))
    by_alias = attach_common(by_alias, reference).where(not_member("localid", v.IN_DROPPED_LOCAL_IDS)).distinct()
    units = mended.select("unit_id", "localid").where("unit_id is not null and unit_id <> '*'")
    by_unit = attach_common(units.withColumn("localid", four_digits("localid")), reference).distinct()
    return by_alias, by_unit


def clean_in(raw: DataFrame, crosswalk: DataFrame, dim: DataFrame, aliases: list[str]) -> DataFrame:
    spec = SourceSpec(
        state="IN",
        columns={
            "year": ["year"],
            "salary": ["total_compensation"],
            "position": ["job_title"],
            "location": ["department"],
            "unit_id": ["unit_id"],
        },
        prepare=lambda df: df.where(
            lacks_pattern(F.coalesce(part("employee", ", ", 2), part("employee", ", ", 1)), "ESTATE OF")
        ),
        names=("employee", "last_suffix_first"),
        lower=("position",),
        teacher=lambda: keyword_flag("position", v.IN_TEACH_WORDS, v.IN_NOT_TEACH_WORDS, v.IN_TEACH_POSITIONS),
    )
    rows = standardize(raw, None, spec).withColumn("X", F.upper("location"))
    by_alias, by_unit = in_crosswalks(crosswalk, dim, aliases)
    matched = attach_first_match(
        rows, [(by_alias, ["X"]), (by_unit, ["unit_id"])], ["localid", "NCES_leaid"], per_column=True
    )
    names = ["name_first", "name_middle", "name_last", "name_other"]
    return matched.withColumns({name: F.upper(name) for name in names}).drop("X", "unit_id").withColumnRenamed(
        "localid", "NCES_localid"
    )


# ---------------------------------------------------------------- KS

KS = SourceSpec(
    state="KS",
    columns={
        "year": ["Year"],
        "salary": ["Total Pay"],
        "name_first": ["First Name"],
        "name_last": ["Last Name"],
        "school_district": ["District"],
        "position": ["Position"],
    },
    source=v.SOURCES["KS"],
    given=2,
    money=("salary",),
    classify=lambda df: classify_labels(
        df,
        "position",
        (mentions(F.upper("position"), v.KS_TEACH_WORDS) | member("position", v.KS_TEACH_POSITIONS))
        & ~mentions(F.upper("position"), v.KS_NOT_TEACH_WORDS),
        "teacher",
    ),
    district=District(
        label=lambda df: F.upper("school_district"),
        prepare=lambda dim: dim.where(not_member("NCES_leaid", v.KS_DROPPED_DISTRICTS)).withColumn(
            "NCES_name", replace_each("NCES_name", v.KS_REFERENCE_NAMES)
        ),
    ),
    state_from_reference=True,
    finish=lambda df: df.withColumnRenamed("localid", "NCES_localid"),
)


def clean_ks(raw: DataFrame, dim: DataFrame) -> DataFrame:
    return standardize(raw, dim, KS)


# ---------------------------------------------------------------- MI

MI = SourceSpec(
    state="MI",
    columns={
        "year": ["year"],
        "name_first": ["fst_nm"],
        "name_last": ["last_nm"],
        "position": ["job_class"],
        "salary": ["salary"],
    },
    source=v.SOURCES["MI"],
    derived={"school_district": lambda df: F.upper("org_nm")},
    lower=("name_first", "name_last", "position"),
    numbers=("salary",),
    given=2,
    keep=lambda: F.col("salary") != 0,
)


def clean_mi(
    parts: list[DataFrame], delete: DataFrame, insert: DataFrame, crosswalk: DataFrame, dim: DataFrame
) -> DataFrame:
    """Numbered column files side by side, corrected, made long, and matched by name."""
    wide = correct(stitch(parts).drop("ordinal"), delete, insert)
    rows = standardize(unpivot_years(wide, "sum_wag_amt", 13, 4, "year", "salary"), None, MI)
    names = crosswalk.withColumnsRenamed({"MI_name": "school_district"})
    named = attach(rows, names.select("school_district", "NCES_name"), ["school_district"])
    named = named.withColumn("NCES_name", F.coalesce("NCES_name", "school_district"))
    reference = District().reference(dim, "MI").drop("state")
    return attach(named, reference, ["NCES_name"]).withColumnRenamed("localid", "NCES_localid")


# ---------------------------------------------------------------- NY

NY = SourceSpec(
    state="NY",
    columns={"salary": ["YTDPay"], "year": ["PayYear"], "school_district": ["AgencyName"], "agency": ["SubAgencyName"]},
    source=v.SOURCES["NY"],
    names=("WholeName", "last_first_other"),
    lower=("school_district",),
    numbers=("salary", "year"),
    teacher=lambda: F.col("agency") == v.NY_TEACH_AGENCY,
    finish=lambda df: df.drop("agency"),
)


def ny_districts(labels: DataFrame, links: DataFrame, dim: DataFrame) -> DataFrame:
    """District per agency: by normalised name, else by the curated link."""
    rule = District(fold=F.lower)
    reference = (
        rule.reference(dim, "NY")
        .drop("state")
        .withColumn("NCES_name", replace_each("NCES_name", v.NY_REFERENCE_NAMES))
        .where(
            not_member("localid", v.NY_DROPPED_LOCAL_IDS)
            & not_member(F.col("NCES_leaid").cast("string"), v.NY_DROPPED_DISTRICTS)
        )
        .distinct()
    )
    names = labels.select("school_district").distinct().withColumn(
        "plain", replace_each("school_district", v.NY_RECORD_NAMES)
    )
    curated = links.select("school_district", repair_bytes("NCES_name").alias("curated"))
    named = attach(names, curated, ["school_district"])
    values = ["NCES_name", "NCES_leaid", "localid", "NCES_type"]
    found = attach_first_match(
        named, [(reference, {"plain": "NCES_name"}), (reference, {"curated": "NCES_name"})], values
    )
    return found.drop("plain", "curated")


def clean_ny(raw: DataFrame, links: DataFrame, dim: DataFrame) -> DataFrame:
    rows = standardize(raw, None, NY)
    matched = attach(rows, measured(ny_districts(rows, links, dim), "districts"), ["school_district"])
    return matched.where(not_member("year", v.NY_BAD_YEARS))


# ---------------------------------------------------------------- ND

ND = SourceSpec(
    state="ND",
    columns={"source_id": ["LicenseNumber"], "salary": ["SALincCOMP"], "position": ["P1_Desc"]},
    source=v.SOURCES["ND"],
    derived={
        "year": lambda df: leading_file_year("filename"),
        "school_district": lambda df: F.lower("DistrictName"),
        **{name: lambda df: F.lit(None).cast("string") for name in ("name_first", "name_middle", "name_last", "name_other")},
    },
    teacher=lambda: F.col("position") == v.ND_TEACH_POSITION,
)


def clean_nd(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """``raw`` carries its file name; ids of the reference lose their state prefix."""
    rule = District(
        fold=F.lower,
        keep_prefixed_year=True,
        drop=("year", "state", "NCES_type"),
        prepare=lambda d: d.withColumn("localid", F.regexp_replace("localid", "ND-", "")),
    )
    rows = standardize(raw, None, ND)
    return attach(rows, rule.reference(dim, "ND"), {"school_district": "NCES_name"}, keep_keys=True)


# ---------------------------------------------------------------- OH

_OH_VARIANTS = {
    "name_last": ["LASTNAME", "Last_Name"],
    "name_first": ["FIRSTNAME", "First_Name", "FirstName"],
    "county": ["COUNTY", "COUNTYNAME"],
    "city": ["CITYNAME"],
    "school": ["SCHOOLNAME", "Building"],
    "district": ["DISTRICTNAME", "District"],
    "days_worked": ["DAYSWORKED", "DaysWorked", "Days_Worked"],
    "hours_worked": ["HOURSWORKEDPERDAY"],
    "degree": ["EDUCATIONLEVEL"],
    "salary": ["PAYAMOUNT", "Salary"],
    "position": ["JOBDESCRIPTION", "PositionCode", "Job_Description"],
}

OH = SourceSpec(
    state="OH",
    columns=_OH_VARIANTS,
    source=v.SOURCES["OH"],
    prepare=lambda df: df.select(*[F.trim(F.col(f"`{name}`")).alias(name) for name in df.columns]),
    derived={"year": lambda df: leading_file_year("filename")},
    lower=("name_last", "name_first", "county", "city", "school", "district", "position"),
    numbers=("salary", "days_worked", "hours_worked"),
    given=1,
)


def clean_oh(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """``raw`` carries its file name.  The id is the number of the name; names that
    several districts share find no district."""
    rows = standardize(raw, None, OH).withColumn("year2", school_year_label("year"))
    rows = group_index(rows, ["name_last", "name_first"], ["state"], "id")
    rule = District(
        label=lambda df: F.upper("district"), drop=("year", "state", "NCES_type"), guard="unique"
    )
    return standardize(
        rows,
        dim,
        SourceSpec(
            state="OH",
            columns={name: [name] for name in rows.columns if name not in ("state", "source")},
            source=v.SOURCES["OH"],
            once=Collapse(
                ["id", "year"],
                ["days_worked", "salary"],
                ["salary"],
                {"n_districts": "district", "n_schools": "school", "n_position": "position"},
            ),
            teacher=lambda: member("position", v.OH_TEACH_POSITIONS),
            district=rule,
        ),
    )


# ---------------------------------------------------------------- OK

OK = SourceSpec(
    state="OK",
    columns={
        "year": ["year"],
        "source_id": ["TeacherNumber", "Teacher Number"],
        "source_id_2": ["staff_id"],
        "name_first": ["fname", "firstname"],
        "name_last": ["lname", "lastname"],
        "county_name": ["county_name"],
        "county_id": ["co"],
        "district_name": ["district_name"],
        "school_name": ["school_name"],
        "gender": ["gender"],
        "position": ["jobdesc"],
        "position_code": ["jobcode"],
        "subject_code": ["subject"],
        "subject_desc": ["subject_desc"],
        "race_code": ["race"],
        "race_desc": ["race_desc"],
        "degree_code": ["degree"],
        "degree_desc": ["degree_desc"],
        "experience_total": ["total_experience", "tot_exper"],
        "fte": ["fte", "FTE"],
        "salary_base": ["base_salary"],
        "salary_fringe": ["total_fringe"],
        "salary_other": ["total_oth_salary", "Other pay"],
        "salary_extra_duty": ["total_extra_duty", "extra_duty pay"],
        "reason_for_leaving_desc": ["reason_for_leaving", "Reason_for_Leaving"],
        "reason_for_leaving_code": ["Reason For Leaving  (RFL_code)", "rfl_code"],
    },
    source=v.SOURCES["OK"],
    derived={
        "localid": lambda df: F.concat_ws("-", F.lit("OK"), "co", "dist"),
        "school_id": lambda df: F.concat_ws("-", "co", "dist", "site"),
    },
    lower=("name_first", "name_last", "gender"),
    numbers=("salary_base", "salary_fringe", "salary_other", "salary_extra_duty"),
    keep=lambda: not_member("position", v.OK_PSEUDO_POSITIONS),
    once=Collapse(
        ["source_id", "year"],
        ["fte", "salary_base"],
        ["salary_base", "salary_fringe", "salary_other", "salary_extra_duty"],
        {
            "n_districts": "localid",
            "n_schools": "school_name",
            "n_position": "position",
            "n_subject": "subject_code",
        },
    ),
    teacher=lambda: member("position", v.OK_TEACH_POSITIONS),
    district=District(
        key="localid", keep_prefixed_year=True, drop=("year", "state", "NCES_type"), guard="checked"
    ),
)


def clean_ok(raw: DataFrame, dim: DataFrame) -> DataFrame:
    return standardize(raw, dim, OK)


# ---------------------------------------------------------------- PA

def clean_pa(years: dict[str, DataFrame], dim: DataFrame) -> DataFrame:
    """Yearly sheets, keyed by their school-year label, as one source."""
    spec = SourceSpec(
        state="PA",
        columns={
            "year": ["year"],
            "year2": ["year2"],
            "name_first": ["name_first"],
            "name_middle": ["name_middle"],
            "name_last": ["name_last"],
            "name_other": ["name_suffix"],
            "position": ["position_description"],
            "lea_name": ["lea_name"],
            "salary": ["salary"],
            "source_id": ["source_id"],
        },
        source=v.SOURCES["PA"],
        teacher=lambda: member("position", v.PA_TEACH_POSITIONS),
        district=District(label=lambda df: F.upper("lea_name")),
    )
    return standardize(union_labeled(years, "year2"), dim, spec)


# ---------------------------------------------------------------- WI

def _wi_choices(df: DataFrame) -> dict[str, Column]:
    """Which column holds a field in which years."""
    rules = {
        "gender": [(1995, 1998, "sex"), (1999, 2011, "sexgender"), (2012, 2014, "gender"),
                   (2015, 2016, "gndr"), (2017, 2018, "gender")],
        "race": [(1995, 1998, "race"), (1999, 2011, "raceprimary_ethnic_origin"), (2012, 2014, "raceethnicity"),
                 (2015, 2016, "raceethn"), (2017, 2018, "raceethnicity")],
        "degree": [(1995, 2011, "highest_degree"), (2012, 2014, "highest_degree_code"),
                   (2015, 2016, "high_degree"), (2017, 2018, ("contract_high_degree", 1))],
        "salary": [(1995, 2011, "salary"), (2012, 2014, "total_salary"),
                   (2015, 2016, "tot_salary"), (2017, 2018, "total_salary")],
        "salary_fringe": [(1995, 2011, "fringe"), (2012, 2014, "total_fringe__employee_benefits"),
                          (2015, 2016, "tot_fringe"), (2017, 2018, "total_fringe")],
        "experience_local": [(1995, 2014, "local_experience_in_education"), (2015, 2016, "local_exp"),
                             (2017, 2018, "contract_local_experience")],
        "experience_total": [(1995, 2014, "total_experience_in_education"), (2015, 2016, "total_exp"),
                             (2017, 2018, "contract_total_experience")],
        "position_code": [(1995, 2014, "position_code"), (2015, 2016, "position_cd"),
                          (2017, 2018, ("assignment_position", 2))],
        "localid": [(1995, 2011, "agency_of_work_location"), (2012, 2014, "agency_of_work_location_code"),
                    (2015, 2016, "work_agncy_cd"), (2017, 2018, ("assignment_work_agency", 4))],
        "school_id": [(1995, 2012, "school_of_work_location"), (2013, 2014, "school_of_work_location_code"),
                      (2015, 2016, "school_cd"), (2017, 2018, ("assignment_work_school", 4))],
        "source_id": [(2015, 2016, "file_number"), (2017, 2018, "entity_id")],
        "other_id": [(1995, 2014, "id_number"), (2015, 2016, "id_nbr"), (2017, 2018, "research_id")],
    }

    def value(choice):
        if isinstance(choice, tuple):
            name, width = choice
            return F.substring(name, 1, width) if name in df.columns else F.lit(None).cast("string")
        return choice

    return {
        name: banded(df, "year", [(low, high, value(choice)) for low, high, choice in bands])
        for name, bands in rules.items()
    }


def wi_layouts(formats: list[tuple[int, str, int, int]]) -> dict[int, list[Slot]]:
    """Layout of each era by its first year, from the documented ``(two-digit year, variable, start, length)``.

    Fields stand one after another in the order of their starts, so a corrected
    length moves those behind it.
    """
    eras: dict[int, list[tuple[str, int, int]]] = {}
    for era, variable, start, length in sorted(formats, key=lambda row: (row[0], row[2])):
        year = era + (1900 if era > 50 else 2000)
        fields = eras.setdefault(year, [])
        begin = fields[-1][1] + fields[-1][2] if fields else 1
        fields.append((variable, begin, v.WI_CORRECTED_LENGTHS.get((era, start), length)))
    return {year: layout(fields) for year, fields in eras.items()}


def read_wi_text(spark: SparkSession, files: dict[int, str], formats: list[tuple[int, str, int, int]]) -> DataFrame:
    """The fixed-width files by year as one source; a file has the layout of the last era that began by its year."""
    layouts = wi_layouts(formats)
    by_era: dict[int, list[str]] = {}
    for year, path in sorted(files.items()):
        by_era.setdefault(max(first for first in layouts if first <= year), []).append(path)
    read = [read_fixed_width(spark, paths, layouts[era]) for era, paths in by_era.items()]
    return wi_fixed_width_year(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read))


def wi_fixed_width_year(df: DataFrame) -> DataFrame:
    """Year of the fixed-width files; those of 2012 to 2014 have a quote before the id."""
    dated = df.withColumn("year", F.substring("year_and_session", 1, 4).try_cast("int"))
    quoted = F.col("year").between(2012, 2014)
    return dated.withColumn("id_number", F.when(quoted, F.expr("substring(id_number, 2)")).otherwise(F.col("id_number")))


def clean_wi(files: dict[str, DataFrame], codes: DataFrame, dim: DataFrame) -> DataFrame:
    """All vintages, with clean headers and a year, as one source."""
    raw = union_labeled(files)
    rows = raw.select(
        "year",
        F.lower("last_name").alias("name_last"),
        F.lower("name_first").alias("name_first"),
        "birth_year",
        *[column.alias(name) for name, column in _wi_choices(raw).items()],
    )
    titles = (
        codes.where(F.col("Variable") == "position_code")
        .select(pad_left("Code", 2).alias("position_code"), F.col("Description").alias("position_title"))
        .distinct()
        .where(not_member("position_code", v.WI_CHANGED_POSITION_CODES))
    )
    rows = code_titles(rows, "position_code", titles, "position_code", "position_title")
    spec = SourceSpec(
        state="WI",
        columns={name: [name] for name in rows.columns if name != "race"},
        source=v.SOURCES["WI"],
        derived={
            "race": lambda df: recode_sets("race", v.WI_RACE_CODES),
            "degree_title": lambda df: recode_sets("degree", v.WI_DEGREE_CODES),
        },
        money=("salary", "salary_fringe"),
        once=Collapse(["year", "other_id"], ["salary"]),
        teacher=lambda: F.col("position_code") == v.WI_TEACH_CODE,
        district=District(
            key="localid",
            drop=("year", "state", "NCES_type"),
            prepare=lambda d: d.where(not_member("NCES_name", v.WI_DROPPED_NAMES)),
            guard="checked",
        ),
    )
    return standardize(rows, dim, spec)
