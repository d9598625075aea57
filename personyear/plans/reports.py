"""The published tables and series, from a linked panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_boolean
from ..functions.text import percent_label
from ..operators.sets import union_labeled
from ..operators.survival import kaplan_meier, median_survival
from ..operators.turnover import district_overall, turnover_by, turnover_counts
from .fixed_values import TENURE_BY_PROFESSION


def without_hole(panel: DataFrame, state: str = "ND", last: int = 2017, year: str = "year") -> DataFrame:
    """Leave out the years of a state that follow a hole in its series."""
    return panel.where(~((F.col("state") == state) & (F.col(year) > last)))


def four_turnovers(panel: DataFrame, district: str, person: str, year: str = "year") -> DataFrame:
    """Yearly rates by state: seen again as a teacher or in any job, in the state or district."""
    series = {}
    for job, flagged in (("Teacher", True), ("Any Job", False)):
        for place, group in (("State", ["state"]), ("District", [district, "state"])):
            counts = turnover_counts(panel, group, person, flagged_only=flagged, year=year)
            series[f"{job} {place}"] = turnover_by(counts, [year, "state"])
    return union_labeled(series, "turnover_type")


def median_against_turnover(spells: DataFrame, series: DataFrame, district: str) -> DataFrame:
    """Median spell length per district next to its overall turnover and size.

    Curves are stratified by the district id alone.
    """
    medians = median_survival(kaplan_meier(spells, [district]), [district])
    return medians.join(district_overall(series, district), district)


def with_professions(medians: DataFrame, label: str) -> DataFrame:
    """State medians above the published medians of other professions."""
    rows = medians.sparkSession.createDataFrame(TENURE_BY_PROFESSION, "label string, median double")
    return union_labeled(
        {"state": medians.select(F.col(label).alias("label"), "median"), "profession": rows}, "kind"
    )


def availability(panel: DataFrame, hole: tuple[str, int] = ("ND", 2017), year: str = "year") -> DataFrame:
    """Years, records, flagged records and their share by state."""
    flag = to_boolean("teacher")
    counts = (
        without_hole(panel, *hole, year=year)
        .groupBy("state")
        .agg(
            F.min(year).alias("first"),
            F.max(year).alias("last"),
            F.count("*").alias("total_records"),
            F.count_if(flag).alias("teacher_records"),
        )
        .where("state is not null")
    )
    return counts.select(
        "state",
        F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")).alias("years"),
        "total_records",
        "teacher_records",
        percent_label(F.col("teacher_records") / F.col("total_records")).alias("proportion_teacher"),
    )
