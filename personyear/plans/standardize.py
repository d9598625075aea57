"""One configurable job that turns an extract into the common record schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAME_FIELDS, NAME_FORMATS, split_given
from ..functions.numbers import parse_money, to_number
from ..operators.joins import attach, attach_checked, attach_unique
from ..operators.project import apply_to, first_present
from ..operators.sets import distinct_dimension
from ..operators.windows import collapse
from .fixed_values import PREFIXED_REFERENCE_YEAR

Make = Callable[[DataFrame], Column]
Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Collapse:
    """Keep one record per key: the largest by ``order``; add up ``totals``."""

    keys: list[str]
    order: list[str]
    totals: list[str] = field(default_factory=list)
    distinct: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class District:
    """How records find their district in the reference table."""

    label: Make | None = None
    key: str = "NCES_name"
    fold: Callable[[Column], Column] = F.upper
    keep_prefixed_year: bool = False
    drop: tuple[str, ...] = ("year",)
    prepare: Change | None = None
    guard: str = "none"

    def reference(self, dim: DataFrame, state: str) -> DataFrame:
        keep = F.col("state") == state
        if not self.keep_prefixed_year:
            keep = keep & (F.col("year") != PREFIXED_REFERENCE_YEAR)
        if self.prepare is not None:
            rows = self.prepare(dim.where(keep).withColumn("NCES_name", self.fold("NCES_name")))
            return rows.drop(*self.drop).distinct()
        return distinct_dimension(dim, keep, {"NCES_name": self.fold("NCES_name")}, list(self.drop))


@dataclass(frozen=True)
class SourceSpec:
    """Everything that is particular to one source.

    ``columns`` maps an output column to its spellings across file vintages.
    """

    state: str
    columns: dict[str, list[str]]
    source: str | None = None
    prepare: Change | None = None
    names: tuple[str, str] | None = None
    given: int | None = None
    derived: dict[str, Make] = field(default_factory=dict)
    lower: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    money: tuple[str, ...] = ()
    keep: Callable[[], Column] | None = None
    teacher: Callable[[], Column] | None = None
    classify: Change | None = None
    once: Collapse | None = None
    district: District | None = None
    state_from_reference: bool = False
    finish: Change | None = None


def _named(df: DataFrame, spec: SourceSpec) -> list[Column]:
    if spec.names is None:
        return []
    raw, form = spec.names
    parsed = NAME_FORMATS[form](F.col(f"`{raw}`"))
    return [parsed.getField(name).alias(name) for name in NAME_FIELDS]


def _typed(df: DataFrame, spec: SourceSpec) -> DataFrame:
    df = apply_to(df, [name for name in spec.lower if name in df.columns], F.lower)
    df = apply_to(df, list(spec.numbers), to_number)
    df = apply_to(df, list(spec.money), parse_money)
    if spec.given is not None:
        first, middle = split_given("name_first", spec.given)
        df = df.withColumns({"name_first": first, "name_middle": middle})
    return df


def _districts(df: DataFrame, dim: DataFrame, spec: SourceSpec) -> DataFrame:
    rule = spec.district
    if rule.label is not None:
        df = df.withColumn(rule.key, rule.label(df))
    reference = rule.reference(dim, spec.state)
    kept = [name for name in reference.columns if name == rule.key or name not in df.columns]
    joins = {"none": attach, "unique": attach_unique, "checked": attach_checked}
    return joins[rule.guard](df, reference.select(*kept), [rule.key])


def standardize(raw: DataFrame, dim: DataFrame | None, spec: SourceSpec) -> DataFrame:
    """Apply a source specification to its raw records."""
    df = raw if spec.prepare is None else spec.prepare(raw)
    chosen = [first_present(df, variants).alias(name) for name, variants in spec.columns.items()]
    made = [make(df).alias(name) for name, make in spec.derived.items()]
    df = _typed(df.select(*chosen, *made, *_named(df, spec)), spec)
    if spec.keep is not None:
        df = df.where(spec.keep())
    if spec.once is not None:
        order = [F.col(name) for name in spec.once.order]
        df = collapse(df, spec.once.keys, order, spec.once.totals, spec.once.distinct)
    if spec.classify is not None:
        df = spec.classify(df)
    if spec.teacher is not None:
        df = df.withColumn("teacher", spec.teacher())
    if spec.district is not None and dim is not None:
        df = _districts(df, dim, spec)
    if not spec.state_from_reference:
        df = df.drop("state").withColumn("state", F.lit(spec.state))
    if spec.source is not None:
        df = df.withColumn("source", F.lit(spec.source))
    return df if spec.finish is None else spec.finish(df)
