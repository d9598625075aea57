"""Union of the standardised sources into one panel, and of the links into one id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pad_left
from ..operators.joins import attach
from ..operators.project import drop_prefix
from ..operators.sets import union_labeled
from ..sources.delimited import read_columns

# The columns read from every cleaned source.
WANTED = {
    "name_first": "text",
    "name_middle": "text",
    "name_last": "text",
    "name_other": "text",
    "source_id": "text",
    "position": "text",
    "teacher": "text",
    "fte": "text",
    "salary": "money",
    "salary_total": "money",
    "salary_base": "money",
    "salary_fringe": "money",
    "salary_other": "money",
    "salary_extra_duty": "money",
    "NCES_name": "text",
    "NCES_type": "text",
    "NCES_leaid": "text",
    "localid": "text",
    "year": "number",
    "state": "text",
    "source": "text",
}

# Which pay columns make up the salary of a source.
SALARY_PARTS = {
    "CA": ["salary_total"],
    "NV": ["salary_total"],
    "OK": ["salary_base", "salary_fringe", "salary_other", "salary_extra_duty"],
}

# States whose official id is used, and the width it is padded to.
OFFICIAL_ID_STATES = ["OK", "ND"]
PADDED_IDS = {"OK": 6}
UNLINKED_STATES = ["ND"]


def _salary(parts: list[str]) -> Column:
    total = F.col(parts[0])
    for part in parts[1:]:
        total = total + F.col(part)
    return total


def unite_sources(
    sources: dict[str, DataFrame], salary_parts: dict[str, list[str]] = SALARY_PARTS
) -> DataFrame:
    """Read the wanted columns of each source, settle its salary, and unite all."""
    typed = {}
    for name, frame in sources.items():
        columns = read_columns(frame, WANTED)
        if name in salary_parts:
            columns = columns.withColumn("salary", _salary(salary_parts[name]))
        typed[name] = drop_prefix(columns, "salary_")
    return union_labeled(typed, "filename").withColumn("year", F.col("year").cast("int"))


def position_dictionary(panel: DataFrame) -> DataFrame:
    """Lower-case positions with their flag and number of records, for curation."""
    return panel.groupBy(F.lower("position").alias("position"), "teacher").agg(F.count("*").alias("n"))


def apply_curated_flags(panel: DataFrame, curated: DataFrame) -> DataFrame:
    """The curated flag wins over the source's; without either a record is not flagged."""
    lookup = curated.select("position", "teacher", "teacher_new")
    joined = attach(panel.withColumn("position", F.lower("position")), lookup, ["position", "teacher"])
    flag = F.coalesce("teacher_new", "teacher", F.lit("FALSE"))
    return joined.withColumn("teacher", flag).drop("teacher_new")


def compile_master(
    sources: dict[str, DataFrame],
    curated: DataFrame,
    salary_parts: dict[str, list[str]] = SALARY_PARTS,
) -> DataFrame:
    """The master panel: all sources, curated flags, records with a district only."""
    flagged = apply_curated_flags(unite_sources(sources, salary_parts), curated)
    dropped = ["NCES_name", "localid", "NCES_type", "source"]
    return flagged.where(F.col("NCES_leaid").isNotNull()).drop(*dropped)


def compile_links(
    linked: DataFrame,
    original: DataFrame,
    official: list[str] = OFFICIAL_ID_STATES,
    padded: dict[str, int] = PADDED_IDS,
    unlinked: list[str] = UNLINKED_STATES,
    linked_id: str = "ensemble_id",
) -> DataFrame:
    """Add the states that were not linked and settle the final id.

    Fails if the number of records differs from that of the original panel.
    """
    rest = original.where(F.col("state").isin(unlinked)) if unlinked else original.limit(0)
    rows = drop_prefix(linked, f"{linked_id}_").unionByName(rest, allowMissingColumns=True)
    chosen = F.when(F.col("state").isin(official), F.col("source_id"))
    for state, width in reversed(list(padded.items())):
        chosen = F.when(F.col("state") == state, pad_left("source_id", width)).otherwise(chosen)
    own = F.col(linked_id).cast("string")
    result = rows.withColumn("id", F.when(F.col("state").isin([*official, *padded]), chosen).otherwise(own))
    if result.count() != original.count():
        raise ValueError("linked and original records differ in number")
    return result
