"""Turnover: who is not seen again in the following year."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured
from .joins import attach
from .windows import drop_last_period


def leaves(next_year: Column, year: Column) -> Column:
    return next_year.isNull() | (next_year != year + 1)


def _next_years(df: DataFrame, keys: list[str], year: str, *measures: Column) -> DataFrame:
    """One row per person and year with the next year the person is seen.

    Records are counted per (person, year) before the window, which therefore
    holds one row per year even for an id that very many records share.
    """
    seen = df.groupBy(*keys, year).agg(*measures)
    person = Window.partitionBy(*keys).orderBy(year)
    return seen.withColumn("__next", F.lead(year).over(person))


def turnover_micro(
    df: DataFrame, group: list[str], person: str, record: str, year: str = "year"
) -> DataFrame:
    """Every record with its turnover flag, reported for the year after it.

    Of several records in one year only the last (largest ``record``) looks at
    the next year; the others are followed by the same year and so count as
    turnover.
    """
    keys = [*group, person]
    last = _next_years(df, keys, year, F.max(record).alias("__last"))
    # Written, so that both sides move for the join and a key with very many records can be split.
    joined = attach(df, measured(last, "next-years"), [*keys, year])
    flag = (F.col(record) != F.col("__last")) | leaves(F.col("__next"), F.col(year))
    return joined.withColumn("turnover", flag).withColumn(year, F.col(year) + 1).drop("__last", "__next")


def turnover_counts(
    df: DataFrame,
    group: list[str],
    person: str,
    flag: str = "teacher",
    flagged_only: bool = True,
    year: str = "year",
) -> DataFrame:
    """Flagged records ``n`` and turnovers ``left`` per person and reported year.

    ``flagged_only`` keeps flagged records alone before looking ahead; without
    it any record counts as being seen again.  Among the records of one person
    and year a flagged one is taken to be the last.
    """
    keys = [*group, person]
    flagged = F.col(flag) == "TRUE"
    source = df.where(flagged) if flagged_only else df
    seen = _next_years(source, keys, year, F.count_if(flagged).alias("n")).where("n > 0")
    left = F.col("n") - 1 + leaves(F.col("__next"), F.col(year)).cast("long")
    return seen.select(*keys, (F.col(year) + 1).alias(year), "n", left.alias("left"))


def rate() -> Column:
    return (F.sum("left") / F.sum("n")).alias("turnover")


def turnover_by(counts: DataFrame, by: list[str], size: bool = False) -> DataFrame:
    """Share of flagged records that are turnovers, with the group size if wanted."""
    extra = [F.sum("n").alias("n")] if size else []
    return counts.groupBy(*by).agg(rate(), *extra)


def label_spans(series: DataFrame, keys: list[str], label: str, year: str = "year") -> DataFrame:
    """Drop the last year of each group and add a text such as ``ST (1996-2001)``."""
    kept = drop_last_period(series, keys, year)
    group = Window.partitionBy(*keys)
    low, high = F.min(year).over(group), F.max(year).over(group)
    text = F.concat(
        F.col(keys[0]), F.lit(" ("), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(")")
    )
    return kept.withColumn(label, text)


def district_turnover(
    df: DataFrame, district: str, person: str, state: str = "state", year: str = "year"
) -> DataFrame:
    """Turnover and size per district and year; the last year of a district is dropped."""
    counts = turnover_counts(df, [state, district], person, year=year)
    series = turnover_by(counts, [district, state, year], size=True)
    return drop_last_period(series, [district, state], year)


def district_overall(series: DataFrame, district: str, state: str = "state", year: str = "year") -> DataFrame:
    """Turnover over all years and the mean yearly number of records."""
    span = F.max(year) - F.min(year) + 1
    return series.groupBy(district, state).agg(
        (F.sum(F.col("turnover") * F.col("n")) / F.sum("n")).alias("turnover"),
        (F.sum("n") / span).alias("n"),
    )


def in_scope(size: int, years: tuple[int, int] | None = None, year: str = "year") -> Column:
    wanted = F.col("n") >= size
    return wanted if years is None else wanted & F.col(year).between(*years)


def turnover_table(series: DataFrame, size: int, state: str = "state", year: str = "year") -> DataFrame:
    """Distribution of district-year rates per state; the input is already aggregated."""
    return series.where(in_scope(size)).groupBy(state).agg(
        F.percentile("turnover", 0.25).alias("p25"),
        F.percentile("turnover", 0.5).alias("median"),
        F.percentile("turnover", 0.75).alias("p75"),
        F.avg("turnover").alias("mean"),
        F.stddev_samp("turnover").alias("sd"),
        F.count("*").alias("n"),
        F.concat_ws(":", F.min(year).cast("string"), F.max(year).cast("string")).alias("years"),
    )


def share_excluded(series: DataFrame, size: int, years: tuple[int, int], limit: float) -> DataFrame:
    """Share of district-years above ``limit``, as number and as text."""
    scoped = series.where(in_scope(size, years))
    share = F.avg((F.col("turnover") > limit).cast("int"))
    return scoped.agg(F.count("*").alias("n"), share.alias("p")).withColumn(
        "label", F.format_string("%.1f%%", F.col("p") * 100.0)
    )


def turnover_density(
    series: DataFrame, size: int, years: tuple[int, int], limit: float, step: float, by: list[str]
) -> DataFrame:
    """Histogram of rates below ``limit`` on a fixed grid."""
    scoped = series.where(in_scope(size, years) & (F.col("turnover") < limit))
    return scoped.groupBy(*by, F.floor(F.col("turnover") / step).alias("bin")).agg(F.count("*").alias("n"))


def kernel_density(
    df: DataFrame, value: str, panel: list[str], group: list[str], low: float, high: float, points: int, least: int = 3
) -> DataFrame:
    """Gaussian kernel density of each group on a fixed grid: ``x, density``.

    All groups of a panel have one bandwidth, the mean of the rule-of-thumb ones
    (0.9 times the smaller of standard deviation and interquartile range / 1.34, times
    n to the power -1/5) of those with at least ``least`` values; smaller groups have no
    density.  A value's weight is split between the two grid points around it, so the
    sum runs over grid points and does not grow with the values.  Values beyond the
    grid count at its ends.
    """
    keys, step = [*panel, *group], (high - low) / (points - 1)
    known = df.where(F.col(value).isNotNull())
    spread = F.stddev_samp(value)
    quarters = (F.percentile(value, 0.75) - F.percentile(value, 0.25)) / 1.34
    positive = lambda x: F.when(x > 0, x)
    sizes = (
        known.groupBy(*keys)
        .agg(F.count("*").alias("n"), spread.alias("sd"), quarters.alias("iqr"), F.abs(F.min(value)).alias("least"))
        .where(F.col("n") >= least)
        .withColumn("scale", F.coalesce(positive(F.least("sd", "iqr")), positive(F.col("sd")), positive(F.col("least")), F.lit(1.0)))
        .withColumn("own", 0.9 * F.col("scale") * F.pow(F.col("n"), F.lit(-0.2)))
    )
    whole = Window.partitionBy(*panel) if panel else Window.partitionBy(F.lit(1))
    sizes = measured(sizes.select(*keys, "n", F.avg("own").over(whole).alias("bandwidth")), "bandwidths")
    place = (F.greatest(F.least(F.col(value), F.lit(high)), F.lit(low)) - low) / step
    at = F.least(F.floor(place), F.lit(points - 2))
    split = F.explode(F.array(F.struct(at.alias("i"), (1 - place + at).alias("w")), F.struct((at + 1).alias("i"), (place - at).alias("w"))))
    weights = known.select(*keys, split.alias("part")).groupBy(*keys, F.col("part.i").alias("i")).agg(F.sum("part.w").alias("w"))
    weighed = attach(weights.where("w > 0"), sizes, keys).where("n is not null")
    gap = (F.col("j") - F.col("i")) * step / F.col("bandwidth")
    kernel = F.col("w") * F.exp(-gap * gap / 2) / (F.sqrt(F.lit(2 * math.pi)) * F.col("bandwidth") * F.col("n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j")
    return (
        weighed.select("*", grid)
        .groupBy(*keys, "j")
        .agg(F.sum(kernel).alias("density"))
        .select(*keys, (low + F.col("j") * step).alias("x"), "density")
    )


def series_difference(series: DataFrame, label: str, one: str, other: str, year: str = "year") -> DataFrame:
    """Five-number summary and mean of the gap between two yearly series, last year out."""
    pick = lambda name, alias: series.where(F.col(label) == name).select(year, F.col("turnover").alias(alias))
    gaps = pick(one, "a").join(pick(other, "b"), year).select(year, (F.col("a") - F.col("b")).alias("gap"))
    kept = drop_last_period(gaps, [], year)
    return kept.agg(
        F.min("gap").alias("minimum"),
        F.percentile("gap", 0.25).alias("p25"),
        F.percentile("gap", 0.5).alias("median"),
        F.avg("gap").alias("mean"),
        F.percentile("gap", 0.75).alias("p75"),
        F.max("gap").alias("maximum"),
    )
