"""Fixed-width text driven by a layout table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators.project import clean_names


@dataclass(frozen=True)
class Slot:
    """One field of a layout; without a length it runs to the end of the line."""

    variable: str
    start: int
    length: int | None = None


def layout(rows: list[tuple[str, int, int]]) -> list[Slot]:
    """Slots from (variable, start, length) rows, with clean unique names.

    The last slot is left open because lines end raggedly.
    """
    names = clean_names([row[0] for row in rows])
    slots = [Slot(name, row[1], row[2]) for name, row in zip(names, rows)]
    return [*slots[:-1], replace(slots[-1], length=None)]


def patch_length(slots: list[Slot], start: int, length: int) -> list[Slot]:
    """Correct the documented length of the slot that begins at ``start``."""
    return [replace(slot, length=length) if slot.start == start else slot for slot in slots]


def read_fixed_width(spark: SparkSession, path: str | list[str], slots: list[Slot]) -> DataFrame:
    """Trimmed text columns; blank fields are NULL.  One substring per used column."""
    fields = [
        F.expr(f"substring(value, {slot.start})")
        if slot.length is None
        else F.substring("value", slot.start, slot.length)
        for slot in slots
    ]
    return spark.read.text(path).select(
        *[blank_to_null(field).alias(slot.variable) for field, slot in zip(fields, slots)],
    )
