"""How well constructed ids reproduce official ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured
from .reshape import transposed
from .sets import union_labeled

CLASSES = ["true_match", "false_non_match", "false_match", "true_non_match"]


def year_pairs(df: DataFrame, year: str = "year") -> DataFrame:
    """(pair_year, year): each pair of neighbouring observed years, named by its later year."""
    ordered = Window.orderBy("later")
    years = df.select(F.col(year).alias("later")).distinct()
    pairs = years.withColumn("earlier", F.lag("later").over(ordered)).where("earlier is not null")
    return pairs.select(
        F.col("later").alias("pair_year"), F.explode(F.array("earlier", "later")).alias("__year")
    )


def confusion(df: DataFrame, official: str, constructed: str, year: str = "year") -> DataFrame:
    """Record counts in four classes per pair of neighbouring years.

    Records are classed by the number of records that share their official id
    in the pair (one or two; others are left out), then by the number that
    share the constructed id among records of the same official class.  An
    official id that passes has at most two records, so its constructed ids
    are the minimum and maximum of one aggregate: no id, not even a missing one
    that many records share, is gathered anywhere.
    """
    pairs = measured(year_pairs(df, year), "pairs")
    # A missing id is the smallest.  Without structs numbers are added up in a hash aggregate.
    least = F.when(F.count(constructed) == F.count("*"), F.min(constructed))
    officials = (
        df.join(pairs, F.col(year) == F.col("__year"))
        .groupBy("pair_year", official)
        .agg(F.count("*").alias("same"), least.alias("a"), F.max(constructed).alias("b"))
        .where("same <= 2")
    )
    records = officials.select(
        "pair_year",
        "same",
        F.explode(F.when(F.col("same") == 2, F.array("a", "b")).otherwise(F.array("a"))).alias("v"),
    )
    groups = records.groupBy("pair_year", "same", "v").agg(F.count("*").alias("n"))
    kept = lambda wanted: F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0))
    both, single = F.col("same") == 2, F.col("same") == 1
    pair, alone = F.col("n") == 2, F.col("n") == 1
    counts = groups.groupBy("pair_year").agg(
        kept(both & pair).alias("true_match"),
        kept(both & ~pair).alias("false_non_match"),
        kept(single & pair).alias("false_match"),
        kept(single & alone).alias("true_non_match"),
    )
    named = pairs.select("pair_year").distinct()
    return named.join(counts, "pair_year", "left").select(
        "pair_year", *[F.coalesce(name, F.lit(0)).alias(name) for name in CLASSES]
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def accuracy(counts: DataFrame) -> DataFrame:
    """Precision, recall, F measure, and the two error shares of each row of counts."""
    tm, fnm, fm, tnm = (F.col(name) for name in CLASSES)
    return counts.withColumns(
        {
            "precision": _ratio(tm, tm + fm),
            "recall": _ratio(tm, tm + fnm),
            "f_measure": _ratio(2 * tm, fnm + fm + 2 * tm),
            "false_share_of_matches": _ratio(fm, fm + tm),
            "false_share_of_non_matches": _ratio(fnm, fnm + tnm),
        }
    )


def total_counts(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.sum(name).alias(name) for name in CLASSES])


def method_table(counts: dict[str, DataFrame]) -> DataFrame:
    """One accuracy row per linkage method."""
    totals = {method: total_counts(frame) for method, frame in counts.items()}
    table = accuracy(union_labeled(totals, "method"))
    return table.select("method", *CLASSES, "precision", "recall", "f_measure")


def method_columns(counts: dict[str, DataFrame]) -> DataFrame:
    """The same table with a row per metric and a column per method."""
    return transposed(method_table(counts), "method", list(counts))


def fragmentation(df: DataFrame, one: str, other: str) -> DataFrame:
    """How many values of ``one`` have 1, 2, ... distinct values of ``other``."""
    per_value = df.groupBy(one, other).agg(F.count("*")).groupBy(one).agg(F.count("*").alias("ids"))
    return per_value.groupBy("ids").agg(F.count("*").alias("n"))
