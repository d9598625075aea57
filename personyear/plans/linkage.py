"""Linking the records of persons across all years of a panel."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import not_member
from ..functions.numbers import half_even_bucket
from ..operators.fuzzy import (
    BACKSTOP_FIELDS,
    BACKSTOP_THRESHOLD,
    STANDALONE_FIELDS,
    STANDALONE_THRESHOLD,
    field_agreements,
    fit_mixture,
    open_records,
    probable_links,
)
from ..operators.matching import RULES, WITHIN, cascade, numbered_once, rule_columns
from ..operators.project import fold_case
from ..session import finished, new_folder, remove

# Text columns compared without case, salary step, state without names.
FOLDED = ["name_first", "name_middle", "name_last", "name_other", "position"]
SALARY_STEP = 5000
UNLINKED_STATES = ["ND"]

# Links of a step, and the diagnosis of its fitted models per state where it has any.
Matcher = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame | None]]
LINK_COLUMNS = "index1 long, index2 long, id long, rule string, posterior double, year int"
LOG_COLUMNS = (
    "state string, year int, records long, following long, exact long, probable long, patterns long, rounds int, "
    "log_likelihood double, gain double, settled boolean, freedom int, error string"
)


def prepare(panel: DataFrame, unlinked: list[str] = UNLINKED_STATES) -> DataFrame:
    """Fold case, bucket salaries, and leave out states that publish no names."""
    kept = panel.where(not_member("state", unlinked))
    return fold_case(kept, FOLDED).withColumn("round_salary", half_even_bucket("salary", SALARY_STEP))


def by_year(panel: DataFrame, names: list[str]) -> tuple[DataFrame, list[int]]:
    """The linking columns written once by year, so each step reads only its years.

    Rebalancing makes files of even size, also where one year is large.
    """
    columns = list(dict.fromkeys([*WITHIN, "year", "index", *names]))
    spark = panel.sparkSession
    path = new_folder(spark, "linkrows")
    panel.select(*columns).hint("rebalance", "year").write.partitionBy("year").parquet(path)
    rows = spark.read.parquet(path).withColumn("id", F.lit(None).cast("long"))
    years = [row.year for row in rows.select("year").distinct().orderBy("year").collect()]
    return rows, years


@dataclass(frozen=True)
class Linked:
    """Links of all year steps, and one log row per state and step."""

    links: DataFrame
    log: DataFrame


def _year_digests(rows: DataFrame) -> dict[int, str]:
    """Per year the number of its records and a digest of all of them; a row per year."""
    digest = F.sum(F.xxhash64(*sorted(set(rows.columns) - {"id"})).cast("decimal(38,0)"))
    found = rows.groupBy("year").agg(F.count("*").alias("n"), digest.alias("digest")).collect()
    return {row.year: f"{row.n}-{row.digest}" for row in found}


def _log(left: DataFrame, right: DataFrame, links: DataFrame, fits: DataFrame | None, period: int) -> DataFrame:
    """What happened in each state of a step: records on either side, links, and the fit or its failure."""
    side = lambda df, name: df.groupBy("state").agg(F.count("*").alias(name))
    probable = F.col("rule") == "probable"
    made = links.join(right.select(F.col("index").alias("index2"), "state"), "index2").groupBy("state")
    made = made.agg(F.count_if(~probable).alias("exact"), F.count_if(probable).alias("probable"))
    log = side(left, "records").join(side(right, "following"), "state", "outer").join(made, "state", "left")
    known = ["patterns", "rounds", "log_likelihood", "gain", "settled", "freedom", "error"]
    if fits is not None:
        log = log.join(fits.select("state", *known), "state", "left")
    else:
        log = log.select("*", *[F.lit(None).alias(name) for name in known])
    counts = {name: F.coalesce(name, F.lit(0)) for name in ("records", "following", "exact", "probable")}
    log = log.withColumns({**counts, "year": F.lit(period)})
    return log.select(*[F.col(name).cast(kind) for name, kind in (column.split() for column in LOG_COLUMNS.split(", "))])


def link_years(rows: DataFrame, years: list[int], matcher: Matcher, folder: str | None = None, method: str = "") -> Linked:
    """Links of all year steps (year, index1, index2, id, rule, posterior) and their log.

    Each step matches one year with the next.  Its left side holds the records
    of the year, with the ids they got as right records of the step before, and
    the earlier records that were never linked.  Only these are carried on, as
    a written table, so a step reads its two years and the open rest.

    Every step leaves links, log and open records in a folder named by a digest of
    the method and of all records up to its following year; the open records come
    last, so a step is finished when they are.  With a ``folder`` that outlives the
    run, a later one goes on after the last finished step, a further year costs one
    step, and changed records cost the steps from their year on.
    """
    spark = rows.sparkSession
    kept = folder is not None
    folder = folder or new_folder(spark, "steps")
    # A folder of this run alone has no earlier steps to tell from these.
    digests = _year_digests(rows) if kept else dict.fromkeys(years, "")
    done = digests.get(years[0], "") if years else ""
    links, logs, before = [], [], None
    for period, following in zip(years, years[1:]):
        done = hashlib.sha256(f"{method}|{done}|{period}|{following}|{digests[following]}".encode()).hexdigest()
        step = f"{folder}/{period}-{following}-{done[:24]}"
        if not (kept and finished(spark, f"{step}/left")):
            left = rows.where(F.col("year") == years[0]) if before is None else spark.read.parquet(before)
            _run_step(rows, left, period, following, matcher, step)
        if following == period + 1:
            links.append(f"{step}/links")
            logs.append(f"{step}/log")
        if before is not None and not kept:
            remove(spark, before)
        before = f"{step}/left"
    if before is not None and not kept:
        remove(spark, before)
    read = lambda paths, schema: spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return Linked(read(links, LINK_COLUMNS), read(logs, LOG_COLUMNS))


def _run_step(rows: DataFrame, left: DataFrame, period: int, following: int, matcher: Matcher, step: str) -> None:
    """Match one year with the next and write links, log and, last, the records carried on."""
    right = rows.where(F.col("year") == following)
    never = left.where("id is null")
    if following == period + 1:
        found, fits = matcher(left, right, period)
        spark = rows.sparkSession
        found = spark.createDataFrame([], LINK_COLUMNS).unionByName(found.withColumn("year", F.lit(period)), allowMissingColumns=True)
        found.write.mode("overwrite").parquet(f"{step}/links")
        links = spark.read.schema(LINK_COLUMNS).parquet(f"{step}/links")
        _log(left, right, links, fits, period).write.mode("overwrite").parquet(f"{step}/log")
        given = links.select(F.col("index2").alias("index"), F.col("id").alias("__id"))
        right = right.join(given, "index", "left").withColumn("id", F.coalesce("id", "__id")).drop("__id")
        never = never.join(links.select(F.col("index1").alias("index")), "index", "left_anti")
    never.unionByName(right.select(*never.columns)).write.mode("overwrite").parquet(f"{step}/left")


def record_ids(links: DataFrame) -> DataFrame:
    """(index, id) of all linked records.

    A record is the right one of at most one link; as a left one it starts a
    chain exactly when the id is its own index.
    """
    later = links.select(F.col("index2").alias("index"), "id")
    first = links.where("id = index1").select(F.col("index1").alias("index"), "id")
    return later.unionByName(first)


def with_ids(panel: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Attach the linked id; a record without a link is its own person."""
    ids = record_ids(links).withColumnsRenamed({"index": "__index", "id": "__id"})
    return (
        panel.join(ids, F.col("index") == F.col("__index"), "left")
        .withColumn(name, F.coalesce("__id", "index"))
        .drop("__index", "__id")
    )


def link_deterministic(panel: DataFrame, rules: list[list[str]] = RULES, folder: str | None = None) -> Linked:
    """Links by the exact rules alone."""
    rows, years = by_year(prepare(panel), rule_columns(rules))
    numbered = numbered_once(rows)
    return link_years(rows, years, lambda left, right, _: (cascade(left, right, rules, numbered=numbered), None), folder, f"exact {rules}")


def with_posteriors(df: DataFrame, links: DataFrame) -> DataFrame:
    """Attach the match probability of the link to the year before, NULL where the record has none."""
    known = links.select(F.col("index2").alias("__index"), "posterior")
    return df.join(known, F.col("index") == F.col("__index"), "left").drop("__index")


def link_probabilistic(panel: DataFrame, folder: str | None = None, fit=fit_mixture) -> Linked:
    """Links by the probabilistic model alone."""
    names = [field.name for field in STANDALONE_FIELDS]
    rows, years = by_year(prepare(panel), names)
    agreements = field_agreements(rows, STANDALONE_FIELDS)

    def matcher(left: DataFrame, right: DataFrame, _: int) -> tuple[DataFrame, DataFrame]:
        return probable_links(left, right, STANDALONE_FIELDS, agreements, STANDALONE_THRESHOLD, fit=fit)

    return link_years(rows, years, matcher, folder, f"probable {STANDALONE_FIELDS} {STANDALONE_THRESHOLD}")


def link_ensemble(panel: DataFrame, rules: list[list[str]] = RULES, folder: str | None = None, fit=fit_mixture) -> Linked:
    """Exact rules first, then the probabilistic model on what they leave open."""
    rows, years = by_year(prepare(panel), rule_columns(rules))
    agreements, numbered = field_agreements(rows, BACKSTOP_FIELDS), numbered_once(rows)

    def matcher(left: DataFrame, right: DataFrame, period: int) -> tuple[DataFrame, DataFrame]:
        exact = cascade(left, right, rules, numbered=numbered)
        open_left, open_right = open_records(left, right, exact, period)
        probable, fits = probable_links(open_left, open_right, BACKSTOP_FIELDS, agreements, BACKSTOP_THRESHOLD, fit=fit)
        return exact.unionByName(probable, allowMissingColumns=True), fits

    return link_years(rows, years, matcher, folder, f"ensemble {rules} {BACKSTOP_FIELDS} {BACKSTOP_THRESHOLD}")


def with_labels(panel: DataFrame, links: DataFrame) -> DataFrame:
    """Attach readable ids: ``link_label`` of the link that ends in a record, ``person_label`` of the whole chain.

    A label names state, earlier year, rule and left record of a link; a chain bears
    that of its first link, a record without any link "nomatch" and its own number.
    """
    named = links.select(F.col("index1").alias("__index1"), "index2", "rule", F.col("id").alias("__id"), F.col("year").alias("__year"))
    ends = named.select(F.col("index2").alias("__end"), "__index1", F.col("rule").alias("__rule"), "__year", "__id")
    starts = named.where("__id = __index1").select("__id", F.col("rule").alias("__first_rule"), F.col("__year").alias("__first_year"))
    chained = record_ids(links).withColumnsRenamed({"index": "__record", "id": "__chain"})
    text = lambda year, rule, index: F.concat_ws("_", "state", F.col(year).cast("string"), rule, F.col(index).cast("string"))
    return (
        panel.join(ends.drop("__id"), F.col("index") == F.col("__end"), "left")
        .join(chained, F.col("index") == F.col("__record"), "left")
        .join(starts, F.col("__chain") == F.col("__id"), "left")
        .withColumn("link_label", F.when(F.col("__end").isNotNull(), text("__year", "__rule", "__index1")))
        .withColumn(
            "person_label",
            F.when(F.col("__chain").isNotNull(), text("__first_year", "__first_rule", "__chain")).otherwise(
                F.concat_ws("_", "state", F.col("year").cast("string"), F.lit("nomatch"), F.col("index").cast("string"))
            ),
        )
        .select(*panel.columns, "link_label", "person_label")
    )


def link_summary(links: DataFrame, panel: DataFrame) -> DataFrame:
    """Links per state, year step and rule."""
    states = panel.select(F.col("index").alias("index1"), "state")
    return links.join(states, "index1").groupBy("state", "year", "rule").agg(F.count("*").alias("links"))
