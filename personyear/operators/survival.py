"""Employment spells and Kaplan-Meier curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured
from .joins import attach

# Two survival values closer than this are the same.
TOLERANCE = 1.5e-8
# The standard normal quantile of limits that hold in 95 of 100 cases.
NORMAL_975 = 1.959963984540054


def observation_window(df: DataFrame, state: str = "state", year: str = "year") -> DataFrame:
    return df.groupBy(state).agg(F.min(year).alias("state_start"), F.max(year).alias("state_end"))


def _finished(spells: DataFrame, observed: DataFrame, state: str) -> DataFrame:
    """Add event status and label, and leave out spells that began before observation."""
    label = F.concat(
        F.col(state),
        F.lit(" ("),
        (F.col("state_start") + 1).cast("string"),
        F.lit("-"),
        F.col("state_end").cast("string"),
        F.lit(")"),
    )
    return (
        attach(spells, measured(observed, "observed"), [state])
        .withColumn("status", (F.col("year_last") < F.col("state_end")).cast("int"))
        .where(F.col("year_first") != F.col("state_start"))
        .withColumn("state_fmt", label)
    )


def spells(
    df: DataFrame,
    observed: DataFrame,
    keys: list[str],
    flag: str = "teacher",
    state: str = "state",
    year: str = "year",
) -> DataFrame:
    """Spells of flagged records; the length is the number of records."""
    folded = (
        df.where(F.col(flag) == "TRUE")
        .groupBy(*keys)
        .agg(
            F.min(year).alias("year_first"),
            F.max(year).alias("year_last"),
            F.count("*").alias("n_years"),
        )
        .withColumn("length", F.col("n_years"))
    )
    return _finished(folded, observed, state)


def spells_any_job(
    df: DataFrame,
    observed: DataFrame,
    keys: list[str],
    flag: str = "teacher",
    state: str = "state",
    year: str = "year",
) -> DataFrame:
    """Spells over all records except unflagged ones in a person's first year.

    The length is the span in years.  Records are reduced to one row per person
    and year first, so the window over a person is as short as the years.
    """
    seen = df.groupBy(*keys, year).agg(F.max((F.col(flag) == "TRUE").cast("int")).alias("__flag"))
    person = Window.partitionBy(*keys)
    folded = (
        seen.withColumn("__first", F.min(year).over(person))
        .where((F.col("__flag") == 1) | (F.col(year) > F.col("__first")))
        .groupBy(*keys)
        .agg(F.min(year).alias("year_first"), F.max(year).alias("year_last"))
        .withColumn("length", F.col("year_last") - F.col("year_first") + 1)
    )
    return _finished(folded, observed, state)


def kaplan_meier(df: DataFrame, strata: list[str], length: str = "length", status: str = "status") -> DataFrame:
    """Survival table per stratum: at risk, events, censored, survival, Greenwood error.

    Spells are counted per length first; the windows see one row per length.
    """
    counts = df.groupBy(*strata, F.col(length).alias("time")).agg(
        F.sum(status).alias("n_event"),
        F.sum(1 - F.col(status)).alias("n_censor"),
    )
    later = Window.partitionBy(*strata).orderBy(F.col("time").desc())
    so_far = Window.partitionBy(*strata).orderBy("time")
    risk = counts.withColumn("n_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(later))
    events, at_risk = F.col("n_event"), F.col("n_risk")
    step = F.try_divide(events, at_risk * (at_risk - events))
    return (
        risk.withColumn("survival", F.product(1 - events / at_risk).over(so_far))
        .withColumn("__variance", F.sum(step).over(so_far))
        .withColumn(
            "std_error",
            F.when(F.col("survival") > 0, F.col("survival") * F.sqrt("__variance")),
        )
        .select(*strata, "time", "n_risk", "n_event", "n_censor", "survival", "std_error")
    )


def confidence_limits(curve: DataFrame, z: float = NORMAL_975) -> DataFrame:
    """Add ``lower`` and ``upper``, the limits of the survival on the logarithmic scale.

    The error of log survival is Greenwood's error over the survival.  The upper limit
    is at most one; where survival is 0 there is no limit.
    """
    spread = F.exp(z * F.col("std_error") / F.col("survival"))
    alive = F.col("survival") > 0
    return curve.withColumns(
        {
            "lower": F.when(alive, F.col("survival") / spread),
            "upper": F.when(alive, F.least(F.col("survival") * spread, F.lit(1.0))),
        }
    )


def median_survival(curve: DataFrame, strata: list[str], value: str = "survival", name: str = "median") -> DataFrame:
    """First time at which survival is at most one half, NULL if it never is.

    A curve that is exactly one half over a stretch has its median in the
    middle between the start of the stretch and the next drop.
    """
    half = F.lit(0.5)
    reached = F.col(value) < half + TOLERANCE
    stratum = Window.partitionBy(*strata)
    top = F.max(F.when(reached, F.col(value))).over(stratum)
    folded = (
        curve.withColumn("__top", top)
        .groupBy(*strata)
        .agg(
            F.min(F.when(reached, F.col("time"))).alias("__at"),
            F.min(F.when(reached & (F.col(value) < F.col("__top")), F.col("time"))).alias("__drop"),
            F.max("__top").alias("__top"),
        )
    )
    flat = (F.abs(F.col("__top") - half) < TOLERANCE) & F.col("__drop").isNotNull()
    middle = (F.col("__at") + F.col("__drop")) / 2
    return folded.select(*strata, F.when(flat, middle).otherwise(F.col("__at").cast("double")).alias(name))


def median_limits(curve: DataFrame, strata: list[str]) -> DataFrame:
    """The median with its limits: the times at which the limits of the curve reach one half."""
    limited = confidence_limits(curve)
    medians = median_survival(limited, strata)
    for name in ("lower", "upper"):
        medians = attach(medians, median_survival(limited, strata, name, name), strata)
    return medians


def risk_table(df: DataFrame, strata: list[str], length: str = "length") -> DataFrame:
    """Spells still running at every whole time from 0 to the longest one.

    The number at risk is constant between two observed lengths, so each
    length fills the whole times since the one before it.
    """
    counts = df.groupBy(*strata, F.floor(length).alias("time")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(*strata).orderBy("time")
    later = Window.partitionBy(*strata).orderBy(F.col("time").desc())
    steps = counts.withColumns(
        {
            "n_risk": F.sum("n").over(later),
            "__after": F.coalesce(F.lag("time").over(ordered) + 1, F.lit(0).cast("long")),
        }
    )
    times = F.explode(F.sequence("__after", "time")).alias("time")
    return steps.select(*strata, times, "n_risk")
