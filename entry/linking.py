"""Linkage queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personyear.operators import fuzzy, matching, quality
from personyear.operators.aggregate import match_rate
from personyear.operators.joins import attach
from personyear.operators.turnover import series_difference, turnover_by, turnover_counts
from personyear.operators.sets import union_labeled
from personyear.operators.windows import drop_last_period, fill_both_ways, group_index
from personyear.plans import compile as compiling
from personyear.plans import linkage
from personyear.session import written

from .panels import CUSTOMER_PANEL_SQL, LINK_PANEL_SQL, YEARS, customer_panel, link_panel, table, tidy, with_sql

LINKERS = {
    "deterministic": linkage.link_deterministic,
    "probabilistic": linkage.link_probabilistic,
    "ensemble": linkage.link_ensemble,
}
LEFT_OUT = ["NATION_2", "NATION_3"]
ID_NAMES = {"deterministic": "detid", "probabilistic": "flid", "ensemble": "ensemble_id"}

# Linking is a stage of its own: its links are written once per session and
# panel, and the queries that evaluate them read the written table.  A panel is
# known by its number of records and a digest of all of them, so that other data
# in the same folder has links of its own.
_stages: dict[tuple, linkage.Linked] = {}


def _mark(panel: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64(*panel.columns).cast("decimal(38,0)"))
    return (panel.sparkSession.sparkContext.applicationId, *panel.agg(F.count("*"), digest).first())


def run_stage(panel: DataFrame, method: str, mark: tuple | None = None) -> linkage.Linked:
    done = LINKERS[method](panel)
    _stages[method, *(mark or _mark(panel))] = done
    return done


def written_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written once, for a query that reads it several times."""
    return written(link_panel(spark, folder), "panel")


def run_links(panel: DataFrame, method: str) -> DataFrame:
    return run_stage(panel, method).links


def stages(panel: DataFrame, *methods: str) -> list[linkage.Linked]:
    """What the methods leave of a panel; those not known yet run side by side, as each has many short steps."""
    mark = _mark(panel)
    missing = [method for method in methods if (method, *mark) not in _stages]
    with ThreadPoolExecutor(max(1, len(missing))) as pool:
        run = inheritable_thread_target(panel.sparkSession)(lambda method: run_stage(panel, method, mark))
        list(pool.map(run, missing))
    return [_stages[method, *mark] for method in methods]


def stage(spark: SparkSession, folder: str, method: str) -> linkage.Linked:
    return stages(written_panel(spark, folder), method)[0]


def stage_links(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return stage(spark, folder, method).links


def linked_by(spark: SparkSession, folder: str, *methods: str) -> list[DataFrame]:
    """The panel with the ids of each method."""
    panel = written_panel(spark, folder)
    return [linkage.with_ids(panel, done.links, ID_NAMES[m]) for m, done in zip(methods, stages(panel, *methods), strict=True)]


def linked(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return linked_by(spark, folder, method)[0]


def _neighbours(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The panel as earlier and as later year; ``pair`` is the earlier one."""
    panel = link_panel(spark, folder)
    return tuple(panel.withColumn("pair", (F.col("year") - back).cast("string")) for back in (0, 1))


# ------------------------------------------------------------------ generated SQL

KEYS = matching.rule_columns(matching.RULES)


def _cascade_sql(name: str, left: str, right: str, rules: list[list[str]] = matching.RULES) -> list[str]:
    """CTEs ``{name}_m{r}`` (index1, index2, id) for each rule on two inputs."""
    columns = ", ".join(["state", *KEYS])
    ctes = [
        f"{name}_s1 AS MATERIALIZED (SELECT {columns}, index, id, 1 AS side FROM {left}"
        f" UNION ALL SELECT {columns}, index, NULL AS id, 2 AS side FROM {right})"
    ]
    for r, rule in enumerate(rules, start=1):
        keys = ", ".join(["state", *rule])
        ctes.append(
            f"{name}_m{r} AS MATERIALIZED (SELECT max(index) FILTER (side = 1) AS index1,"
            f" max(index) FILTER (side = 2) AS index2,"
            f" coalesce(max(id) FILTER (side = 1), max(index) FILTER (side = 1)) AS id FROM {name}_s{r}"
            f" GROUP BY {keys} HAVING count(*) FILTER (side = 1) = 1 AND count(*) FILTER (side = 2) = 1)"
        )
        ctes.append(
            f"{name}_s{r + 1} AS MATERIALIZED (SELECT * FROM {name}_s{r} WHERE index NOT IN"
            f" (SELECT index1 FROM {name}_m{r} UNION ALL SELECT index2 FROM {name}_m{r}))"
        )
    union = " UNION ALL ".join(
        f"SELECT '{r}' AS rule, index1, index2, id FROM {name}_m{r}" for r in range(1, len(rules) + 1)
    )
    ctes.append(f"{name}_links AS MATERIALIZED ({union})")
    return ctes


def _chain_sql() -> list[str]:
    """CTEs for all year steps, ending in ``links`` and ``ids`` (index, detid)."""
    columns = ", ".join(["state", *KEYS, "index"])
    ctes = [
        LINK_PANEL_SQL,
        f"left{YEARS[0]} AS (SELECT {columns}, CAST(NULL AS BIGINT) AS id FROM panel WHERE year = {YEARS[0]})",
    ]
    for year in YEARS[:-1]:
        right = f"right{year}"
        ctes.append(f"{right} AS (SELECT {columns} FROM panel WHERE year = {year + 1})")
        ctes += _cascade_sql(f"y{year}", f"left{year}", right)
        ctes.append(
            f"left{year + 1} AS MATERIALIZED (SELECT {columns}, id FROM left{year} WHERE id IS NULL AND index NOT IN"
            f" (SELECT index1 FROM y{year}_links)"
            f" UNION ALL SELECT {columns}, l.id FROM {right} r LEFT JOIN y{year}_links l ON r.index = l.index2)"
        )
    union = " UNION ALL ".join(
        f"SELECT CAST({year} AS BIGINT) AS year, rule, index1, index2, id FROM y{year}_links" for year in YEARS[:-1]
    )
    ctes.append(f"links AS MATERIALIZED ({union})")
    ctes.append(
        "ids AS MATERIALIZED (SELECT p.*, coalesce(l.id, p.index) AS detid FROM panel p LEFT JOIN"
        " (SELECT index2 AS index, id FROM links UNION ALL SELECT index1, id FROM links WHERE id = index1) l"
        " ON p.index = l.index)"
    )
    return ctes


def confusion_sql(source: str, official: str, constructed: str) -> list[str]:
    return [
        f"""spans AS (SELECT later, earlier FROM (SELECT year AS later, lag(year) OVER (ORDER BY year) AS earlier
  FROM (SELECT DISTINCT year FROM {source})) WHERE earlier IS NOT NULL)""",
        f"""s AS (SELECT later, {constructed} AS c,
  count(*) OVER (PARTITION BY later, {official}) AS same FROM {source} JOIN spans ON year IN (later, earlier))""",
        """k AS (SELECT *, count(*) OVER (PARTITION BY later, same, c) AS n FROM s WHERE same <= 2)""",
        """counts AS (SELECT later AS pair_year,
  count(*) FILTER (same = 2 AND n = 2) AS true_match, count(*) FILTER (same = 2 AND n <> 2) AS false_non_match,
  count(*) FILTER (same = 1 AND n = 2) AS false_match, count(*) FILTER (same = 1 AND n = 1) AS true_non_match
  FROM k GROUP BY later)""",
    ]


METRICS_SQL = """true_match / nullif(true_match + false_match, 0)::DOUBLE AS "precision",
  true_match / nullif(true_match + false_non_match, 0)::DOUBLE AS recall,
  2 * true_match / nullif(false_non_match + false_match + 2 * true_match, 0)::DOUBLE AS f_measure"""

ROUNDED = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f_measure, 6) AS f_measure'


def _all_steps(rules: list[list[str]] = matching.RULES) -> list[str]:
    """Each neighbouring pair of years for itself; a record has one number as a left and another as a right one."""
    sides = "SELECT * REPLACE (state || '|' || CAST(year - {back} AS VARCHAR) AS state, index * 2 + {back} AS index), CAST(NULL AS BIGINT) AS id FROM panel"
    return [
        LINK_PANEL_SQL,
        f"one AS ({sides.format(back=0)})",
        f"two AS ({sides.format(back=1)})",
        *_cascade_sql("c", "one", "two", rules),
    ]


# ------------------------------------------------------------------ queries

def match_rule(spark, folder):
    return matching.match_rule(*_neighbours(spark, folder), matching.RULES[0], ["state", "pair"])


def link_cascade(spark, folder):
    """Every neighbouring pair of years for itself; a record has one number as a left and another as a right one."""
    left, right = _neighbours(spark, folder)
    found = matching.cascade(
        left.withColumn("index", F.col("index") * 2), right.withColumn("index", F.col("index") * 2 + 1), within=["state", "pair"]
    )
    half = lambda name: F.floor(F.col(name) / 2).alias(name)
    return found.select("rule", half("index1"), half("index2"))


def _after_first_step(spark, folder):
    """Rows of the panel with the ids given by the 1995-1996 step."""
    panel = link_panel(spark, folder)
    links = matching.cascade(panel.where("year = 1995"), panel.where("year = 1996"))
    return matching.propagate(panel.withColumn("id", F.lit(None).cast("long")), links)


def link_candidates(spark, folder):
    left, right = matching.candidates(_after_first_step(spark, folder), 1996)
    sides = union_labeled({"left": left, "right": right}, "side")
    return tidy(sides.groupBy("side", "state", "year").agg(F.count("*").alias("n")))


def link_propagate(spark, folder):
    return _after_first_step(spark, folder).select("index", "id")


def link_deterministic(spark, folder):
    panel = written_panel(spark, folder)
    links = run_links(panel, "deterministic")
    return linkage.with_ids(panel, links, "detid").select("index", "detid")


def link_probabilistic(spark, folder):
    panel = written_panel(spark, folder)
    links = run_links(panel, "probabilistic")
    linked = linkage.with_posteriors(linkage.with_ids(panel, links, "flid"), links)
    return tidy(linked.select("index", "flid", "posterior"))


def link_ensemble(spark, folder):
    panel = written_panel(spark, folder)
    links = run_links(panel, "ensemble")
    return linkage.with_ids(panel, links, "ensemble_id").select("index", "ensemble_id")


def link_summary(spark, folder):
    links = stage_links(spark, folder, "deterministic")
    return tidy(linkage.link_summary(links, link_panel(spark, folder)))


def linkage_confusion(spark, folder):
    return tidy(quality.confusion(linked(spark, folder, "deterministic"), "source_id", "detid"))


def linkage_accuracy(spark, folder):
    counts = quality.confusion(linked(spark, folder, "deterministic"), "source_id", "detid")
    return tidy(quality.accuracy(quality.total_counts(counts)))


def accuracy_transposed(spark, folder):
    rows = linked(spark, folder, "deterministic")
    by_name = rows.withColumn("plainid", F.concat_ws("|", "state", "name_first", "name_last", "position", "NCES_leaid"))
    return tidy(
        quality.method_columns(
            {
                "Deterministic Link": quality.confusion(by_name, "source_id", "detid"),
                "Name And Place": quality.confusion(by_name, "source_id", "plainid"),
            }
        )
    )


def method_accuracy(spark, folder):
    """The accuracy table of all three linkage methods."""
    labels = {"Deterministic Link": "deterministic", "Probabilistic Link": "probabilistic", "Ensemble": "ensemble"}
    return tidy(
        quality.method_columns(
            {
                label: quality.confusion(rows, "source_id", ID_NAMES[method])
                for (label, method), rows in zip(labels.items(), linked_by(spark, folder, *labels.values()), strict=True)
            }
        )
    )


def id_fragmentation(spark, folder):
    rows = linked(spark, folder, "deterministic")
    return tidy(
        union_labeled(
            {
                "ids per official id": quality.fragmentation(rows, "source_id", "detid"),
                "official ids per id": quality.fragmentation(rows, "detid", "source_id"),
            },
            "direction",
        )
    )


def _methods(spark, folder):
    result, *others = linked_by(spark, folder, *LINKERS)
    for name, rows in zip(("flid", "ensemble_id"), others, strict=True):
        result = attach(result, rows.select("source_id", "year", name), ["source_id", "year"])
    return result


def link_methods_joined(spark, folder):
    return tidy(_methods(spark, folder).select("source_id", "year", "state", "detid", "flid", "ensemble_id"))


def _method_series(rows, methods):
    """Yearly turnover by each of the ids, unrounded."""
    series = {
        label: turnover_by(turnover_counts(rows.withColumn(name, F.col(name).cast("string")), [], name), ["year"])
        for label, name in methods
    }
    return union_labeled(series, "turnover_type")


EXACT_METHODS = (("Official ID", "source_id"), ("Deterministic", "detid"))
ALL_METHODS = (*EXACT_METHODS, ("Probabilistic", "flid"), ("Ensemble", "ensemble_id"))


def turnover_by_method(spark, folder):
    return tidy(_method_series(linked(spark, folder, "deterministic"), EXACT_METHODS))


def turnover_all_methods(spark, folder):
    """Turnover by the official id and by all three linkers; the ids differ, the records do not."""
    return tidy(_method_series(_methods(spark, folder), ALL_METHODS))


def series_gap(spark, folder):
    series = _method_series(linked(spark, folder, "deterministic"), EXACT_METHODS)
    return tidy(series_difference(series, "turnover_type", "Deterministic", "Official ID"))


def ensemble_gap(spark, folder):
    """The ensemble's yearly turnover minus that by the official id, summarised."""
    series = _method_series(linked(spark, folder, "ensemble"), (EXACT_METHODS[0], ALL_METHODS[3]))
    return tidy(series_difference(series, "turnover_type", "Ensemble", "Official ID"))


def fill_downup(spark, folder):
    gaps = customer_panel(spark, folder).select(
        "state", "id", "year", F.when(F.col("teacher") == "TRUE", F.col("position")).alias("position")
    )
    return tidy(fill_both_ways(gaps, ["state", "id"], ["year"], "position"))


def bucket_round(spark, folder):
    from personyear.functions.numbers import half_even_bucket

    orders = table(spark, folder, "orders")
    return tidy(orders.select("o_orderkey", half_even_bucket("o_totalprice", 5000).alias("bucket")))


def surrogate_key(spark, folder):
    people = link_panel(spark, folder).select("state", "index", "name_last", "name_first")
    return tidy(group_index(people, ["name_last", "name_first"], ["state"], "person").select("index", "person"))


def _name_words(spark, folder):
    words = table(spark, folder, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("v")
    )
    names = link_panel(spark, folder).select(F.col("name_last").alias("v"))
    titles = table(spark, folder, "part").select(F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("v"))
    return words.unionByName(names).unionByName(titles).distinct()


def string_similarity_join(spark, folder):
    field = fuzzy.BACKSTOP_FIELDS[1]
    return tidy(fuzzy.agreeing_values(_name_words(spark, folder), field))


def numeric_agreement(spark, folder):
    prices = table(spark, folder, "customer").select("c_acctbal")
    return tidy(fuzzy.agreeing_values(prices, fuzzy.number_field("c_acctbal", partial=True)))


def _pair_counts(spark, folder):
    left, right = _neighbours(spark, folder)
    fields = [fuzzy.BACKSTOP_FIELDS[0], fuzzy.BACKSTOP_FIELDS[1], fuzzy.Field("name_middle", partial=False)]
    agreements = fuzzy.field_agreements(link_panel(spark, folder), fields)
    return fuzzy.PairCounts(left, right, fields, agreements, ["state", "pair"])


def agreement_patterns(spark, folder):
    return tidy(fuzzy.pattern_counts(_pair_counts(spark, folder)))


def mixture_posteriors(spark, folder):
    """The fitted match probability of every agreement pattern, one model per state and pair of years."""
    scored = fuzzy.pattern_posteriors(_pair_counts(spark, folder))
    return scored.select(
        "state", "pair", "pattern", F.col("pairs").cast("long").alias("pairs"), F.round("posterior", 4).alias("posterior")
    )


def mixture_fit(spark, folder):
    """Rounds and likelihood of every model, whether it settled, and its degrees of freedom."""
    fits = fuzzy.fit_diagnosis(fuzzy.pattern_posteriors(_pair_counts(spark, folder)), ["state", "pair"])
    return tidy(fits.select("state", "pair", "patterns", "pairs", "rounds", "log_likelihood", "settled", "freedom"))


def link_log(spark, folder):
    """What happened in each state and step of the exact linking."""
    log = stage(spark, folder, "deterministic").log
    return tidy(log.select("state", "year", "records", "following", "exact", "probable", "error"))


def ensemble_log(spark, folder):
    """What happened in each state and step of the ensemble, failed fits included."""
    return tidy(stage(spark, folder, "ensemble").log)


def _scored_pairs(spark, folder):
    """Candidate pairs of parts and suppliers, scored by the quantity shipped."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("index1"), F.col("l_suppkey").alias("index2")).agg(
        F.sum("l_quantity").alias("posterior")
    )


def one_to_one_filter(spark, folder):
    pairs = _scored_pairs(spark, folder)
    best = fuzzy.best_pairs(pairs)
    single = fuzzy.drop_repeated(pairs.select("index1", "index2", "posterior"))
    return tidy(union_labeled({"best": best, "single": single}, "choice"))


def link_labels(spark, folder):
    links = stage_links(spark, folder, "deterministic")
    return linkage.with_labels(link_panel(spark, folder), links).select("index", "link_label", "person_label")


def compile_added_back(spark, folder):
    """Two states are left out of the linking and come back with ids of their own."""
    panel = link_panel(spark, folder)
    left_out = panel.where(F.col("state").isin(LEFT_OUT))
    links = linkage.link_deterministic(panel.join(left_out.select("index"), "index", "left_anti")).links
    rows = linkage.with_ids(panel.where(~F.col("state").isin(LEFT_OUT)), links, "ensemble_id")
    done = compiling.compile_links(rows, panel, official=["NATION_1", "NATION_2"], padded={"NATION_1": 6}, unlinked=LEFT_OUT)
    return tidy(done.select("index", "state", "year", "id", F.col("ensemble_id").alias("linked_id")))


def compile_linked(spark, folder):
    links = stage_links(spark, folder, "deterministic")
    rows = linkage.with_ids(link_panel(spark, folder), links, "ensemble_id")
    official = ["NATION_1", "NATION_2"]
    done = compiling.compile_links(
        rows, link_panel(spark, folder), official=official, padded={"NATION_1": 6}, unlinked=[]
    )
    return tidy(done.select("index", "state", "year", "id"))


QUERIES = {
    "match_rule": match_rule,
    "link_cascade": link_cascade,
    "link_candidates": link_candidates,
    "link_propagate": link_propagate,
    "link_deterministic": link_deterministic,
    "link_probabilistic": link_probabilistic,
    "link_ensemble": link_ensemble,
    "link_summary": link_summary,
    "linkage_confusion": linkage_confusion,
    "linkage_accuracy": linkage_accuracy,
    "accuracy_transposed": accuracy_transposed,
    "method_accuracy": method_accuracy,
    "id_fragmentation": id_fragmentation,
    "link_methods_joined": link_methods_joined,
    "turnover_by_method": turnover_by_method,
    "turnover_all_methods": turnover_all_methods,
    "series_difference": series_gap,
    "ensemble_difference": ensemble_gap,
    "fill_downup": fill_downup,
    "bucket_round": bucket_round,
    "surrogate_key": surrogate_key,
    "string_similarity_join": string_similarity_join,
    "numeric_agreement": numeric_agreement,
    "agreement_patterns": agreement_patterns,
    "mixture_posteriors": mixture_posteriors,
    "mixture_fit": mixture_fit,
    "link_log": link_log,
    "ensemble_log": ensemble_log,
    "one_to_one_filter": one_to_one_filter,
    "link_labels": link_labels,
    "compile_added_back": compile_added_back,
    "compile_linked": compile_linked,
}

METHOD_TURNOVER_SQL = [
    """seen AS (SELECT 'Official ID' AS turnover_type, source_id AS id, year FROM ids WHERE teacher = 'TRUE'
  UNION ALL SELECT 'Deterministic', CAST(detid AS VARCHAR), year FROM ids WHERE teacher = 'TRUE')""",
    """micro AS (SELECT turnover_type, year + 1 AS year,
  CASE WHEN lead(year) OVER w IS NULL OR lead(year) OVER w <> year + 1 THEN 1 ELSE 0 END AS turnover
  FROM seen WINDOW w AS (PARTITION BY turnover_type, id ORDER BY year))""",
    "series AS (SELECT turnover_type, year, avg(turnover) AS turnover FROM micro GROUP BY ALL)",
]

_FIRST_STEP_SQL = [
    LINK_PANEL_SQL,
    "one AS (SELECT *, CAST(NULL AS BIGINT) AS id FROM panel WHERE year = 1995)",
    "two AS (SELECT * FROM panel WHERE year = 1996)",
    *_cascade_sql("c", "one", "two"),
    """given AS (SELECT p.*, l.id FROM panel p LEFT JOIN (SELECT index1 AS index, id FROM c_links
  UNION ALL SELECT index2, id FROM c_links) l USING (index))""",
]

_WORDS_SQL = """words AS MATERIALIZED (SELECT DISTINCT v FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS v FROM benchmark
  UNION ALL SELECT name_last FROM panel UNION ALL SELECT lower(concat_ws(' ', p_type, p_brand)) FROM part))"""

_SCORED_SQL = """pairs AS MATERIALIZED (SELECT l_partkey AS index1, l_suppkey AS index2, sum(l_quantity) AS posterior
  FROM lineitem GROUP BY ALL)"""

# The agreement pattern of every pair of records of neighbouring years in a state.
_PAIR_PATTERNS_SQL = """
level1 AS (SELECT a.state, CAST(a.year AS VARCHAR) AS pair,
  CASE WHEN jaro_winkler_similarity(a.name_first, b.name_first) >= .92 THEN '2'
       WHEN jaro_winkler_similarity(a.name_first, b.name_first) >= .88 THEN '1' ELSE '0' END
  || CASE WHEN jaro_winkler_similarity(a.name_last, b.name_last) >= .92 THEN '2'
       WHEN jaro_winkler_similarity(a.name_last, b.name_last) >= .88 THEN '1' ELSE '0' END
  || CASE WHEN a.name_middle IS NULL OR b.name_middle IS NULL THEN '-'
       WHEN jaro_winkler_similarity(a.name_middle, b.name_middle) >= .94 THEN '2' ELSE '0' END AS pattern
  FROM panel a JOIN panel b USING (state) WHERE b.year = a.year + 1)"""


def _mixture_sql(fields: int = 3) -> list[str]:
    """The accelerated fit per state and pair of years as a recursive CTE over the pattern counts.

    A row is a pattern with the parameters of its model: share, and the chances m
    (match) and u (other) of each field and level.  Letters in front tell the stage
    of a round: t before it, a and b after one and two plain steps, c extrapolated.
    """
    cells = [(kind, f, level) for kind in "mu" for f in range(fields) for level in range(3)]
    names = ["share", *[f"{kind}{f}{level}" for kind, f, level in cells]]
    shown = lambda f, level: f"CAST(pattern[{f + 1}] = '{level}' AS INT)"
    window = "WINDOW s AS (PARTITION BY state, pair)"
    start = {"m": (0.05, 0.15, 0.80), "u": (0.80, 0.15, 0.05)}

    def logs(p: str) -> str:
        """ln of both classes' parts of a pattern's chance."""
        part = lambda kind: " + ".join(f"{shown(f, x)} * ln(greatest({p}{k}{f}{x}, 1e-12))" for k, f, x in cells if k == kind)
        return f"ln(greatest({p}share, 1e-300)) + {part('m')} AS {p}one, ln(greatest(1 - {p}share, 1e-300)) + {part('u')} AS {p}two"

    def both(p: str) -> str:
        return f"greatest({p}one, {p}two) + ln(1 + exp(-abs({p}one - {p}two))) AS {p}both"

    def likely(source: str, p: str) -> str:
        """Adds the mean log-likelihood under the parameters ``p``."""
        return (
            f"(SELECT * EXCLUDE ({p}one, {p}two, {p}both), sum(part * {p}both) OVER s AS {p}ll"
            f" FROM (SELECT *, {both(p)} FROM (SELECT *, {logs(p)} FROM {source})) {window})"
        )

    def step(source: str, p: str, q: str) -> str:
        """Adds the parameters ``q`` after one plain step from ``p``."""
        moved = [f"sum(part * g) OVER s AS {q}share"]
        for kind, f, level in cells:
            weight = "part * g" if kind == "m" else "(part - part * g)"
            total = f"sum({weight} * CAST(pattern[{f + 1}] <> '-' AS INT)) OVER s"
            hits = f"sum({weight} * {shown(f, level)}) OVER s"
            moved.append(f"CASE WHEN {total} > 0 THEN {hits} / greatest({total}, 1e-300) ELSE {p}{kind}{f}{level} END AS {q}{kind}{f}{level}")
        inner = f"(SELECT *, exp({p}one - {p}both) AS g FROM (SELECT *, {both(p)} FROM (SELECT *, {logs(p)} FROM {source})))"
        return f"(SELECT * EXCLUDE ({p}one, {p}two, {p}both, g), {', '.join(moved)} FROM {inner} {window})"

    def scaled(value, kind: str, f: int, level: int) -> str:
        of = [f"greatest({value(kind, f, x)}, 1e-12) * p{f}{x}" for x in range(3)]
        return f"{of[level]} / greatest({' + '.join(of)}, 1e-12)"

    size = lambda term: " + ".join(f"({term(n)}) * ({term(n)})" for n in names)
    change, bend = (lambda n: f"a{n} - t{n}"), (lambda n: f"b{n} - a{n} - (a{n} - t{n})")
    ahead = lambda n: f"(t{n} + 2 * len * ({change(n)}) + len * len * ({bend(n)}))"
    extrapolated = [f"least(greatest({ahead('share')}, 1e-12), 1 - 1e-12) AS cshare"]
    extrapolated += [f"{scaled(lambda k, f, x: ahead(f'{k}{f}{x}'), *cell)} AS c{cell[0]}{cell[1]}{cell[2]}" for cell in cells]
    possible = ", ".join(f"max({shown(f, x)}) OVER s AS p{f}{x}" for f in range(fields) for x in range(3))
    kept = ", ".join(f"p{f}{x}" for f in range(fields) for x in range(3))
    begun = ", ".join(f"{scaled(lambda k, f, x: str(start[k][x]), *cell)} AS t{cell[0]}{cell[1]}{cell[2]}" for cell in cells)
    first = f"(SELECT *, 0.1::DOUBLE AS tshare, {begun} FROM (SELECT *, pairs / sum(pairs) OVER s AS part, {possible} FROM counts {window}))"
    thetas = ", ".join(f"t{n}" for n in names)
    stepped = step(step("(SELECT * FROM em WHERE gain >= 1e-10 AND round < 500)", "t", "a"), "a", "b")
    length = f"(SELECT *, CASE WHEN {size(bend)} > 0 THEN greatest(1, sqrt({size(change)}) / sqrt({size(bend)})) ELSE 1 END AS len FROM {stepped})"
    ended = likely(likely(f"(SELECT *, {', '.join(extrapolated)} FROM {length})", "b"), "c")
    chosen = ", ".join(f"CASE WHEN cll >= bll THEN c{n} ELSE b{n} END" for n in names)
    full = " + ".join(f"tm{f}2" for f in range(fields)), " + ".join(f"tu{f}2" for f in range(fields))
    levels = " + ".join(f"2 * greatest({' + '.join(f'p{f}{x}' for x in range(3))} - 1, 0)" for f in range(fields))
    last = likely("(SELECT * EXCLUDE (ll) FROM em QUALIFY round = max(round) OVER (PARTITION BY state, pair))", "t")
    return [
        "counts AS (SELECT state, pair, pattern, count(*) AS pairs FROM level1 GROUP BY ALL)",
        f"""em(round, gain, ll, state, pair, pattern, pairs, part, {kept}, {thetas}) AS (
  SELECT 0, 1e300::DOUBLE, tll, state, pair, pattern, pairs, part, {kept}, {thetas} FROM {likely(first, "t")}
  UNION ALL
  SELECT round + 1, greatest(cll, bll) - ll, greatest(cll, bll), state, pair, pattern, pairs, part, {kept}, {chosen} FROM {ended})""",
        f"fitted AS (SELECT *, {full[0]} < {full[1]} AS turned, -({levels}) AS levels, {logs("t")} FROM {last})",
    ]


SQL = {
    "match_rule": with_sql(*_all_steps(matching.RULES[:1]), select="SELECT index1 // 2 AS index1, index2 // 2 AS index2 FROM c_links"),
    "link_cascade": with_sql(*_all_steps(), select="SELECT rule, index1 // 2 AS index1, index2 // 2 AS index2 FROM c_links"),
    "link_candidates": with_sql(*_FIRST_STEP_SQL, select="""
SELECT 'left' AS side, state, year, count(*) AS n FROM given WHERE year = 1996 OR (year < 1996 AND id IS NULL) GROUP BY ALL
UNION ALL SELECT 'right', state, year, count(*) FROM given WHERE year = 1997 GROUP BY ALL"""),
    "link_propagate": with_sql(*_FIRST_STEP_SQL, select="SELECT index, id FROM given"),
    "link_deterministic": with_sql(*_chain_sql(), select="SELECT index, detid FROM ids"),
    "link_summary": with_sql(*_chain_sql(), select="""
SELECT p.state, l.year, l.rule, count(*) AS links FROM links l JOIN panel p ON p.index = l.index1 GROUP BY ALL"""),
    "linkage_confusion": with_sql(*_chain_sql(), *confusion_sql("ids", "source_id", "detid"), select="SELECT * FROM counts"),
    "linkage_accuracy": with_sql(
        *_chain_sql(), *confusion_sql("ids", "source_id", "detid"),
        """total AS (SELECT CAST(sum(true_match) AS BIGINT) AS true_match, CAST(sum(false_non_match) AS BIGINT) AS false_non_match,
  CAST(sum(false_match) AS BIGINT) AS false_match, CAST(sum(true_non_match) AS BIGINT) AS true_non_match FROM counts)""",
        f"""m AS (SELECT *, {METRICS_SQL},
  false_match / nullif(false_match + true_match, 0)::DOUBLE AS a,
  false_non_match / nullif(false_non_match + true_non_match, 0)::DOUBLE AS b FROM total)""",
        select=f"""SELECT true_match, false_non_match, false_match, true_non_match, {ROUNDED},
  round(a, 6) AS false_share_of_matches, round(b, 6) AS false_share_of_non_matches FROM m"""),
    "id_fragmentation": with_sql(*_chain_sql(), select="""
SELECT 'ids per official id' AS direction, ids, count(*) AS n
FROM (SELECT source_id, count(DISTINCT detid) AS ids FROM ids GROUP BY 1) GROUP BY ALL
UNION ALL SELECT 'official ids per id', ids, count(*)
FROM (SELECT detid, count(DISTINCT source_id) AS ids FROM ids GROUP BY 1) GROUP BY ALL"""),
    "turnover_by_method": with_sql(*_chain_sql(), *METHOD_TURNOVER_SQL, select="""
SELECT turnover_type, year, round(turnover, 6) AS turnover FROM series"""),
    "series_difference": with_sql(*_chain_sql(), *METHOD_TURNOVER_SQL,
        """gaps AS (SELECT year, a.turnover - b.turnover AS gap FROM series a JOIN series b USING (year)
  WHERE a.turnover_type = 'Deterministic' AND b.turnover_type = 'Official ID')""", select="""
SELECT round(min(gap), 6) AS minimum, round(quantile_cont(gap, .25), 6) AS p25, round(quantile_cont(gap, .5), 6) AS median,
  round(avg(gap), 6) AS mean, round(quantile_cont(gap, .75), 6) AS p75, round(max(gap), 6) AS maximum
FROM gaps WHERE year <> (SELECT max(year) FROM gaps)"""),
    "fill_downup": with_sql(CUSTOMER_PANEL_SQL, select="""
SELECT state, id, year, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY state, id ORDER BY year
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(p IGNORE NULLS) OVER (PARTITION BY state, id ORDER BY year
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS position
FROM (SELECT *, CASE WHEN teacher = 'TRUE' THEN position END AS p FROM panel)"""),
    "bucket_round": "SELECT o_orderkey, round_even(o_totalprice / 5000.0, 0) * 5000.0 AS bucket FROM orders",
    "surrogate_key": with_sql(LINK_PANEL_SQL, select="""
SELECT index, dense_rank() OVER (PARTITION BY state ORDER BY name_last, name_first) AS person FROM panel"""),
    "string_similarity_join": with_sql(LINK_PANEL_SQL, _WORDS_SQL, select="""
SELECT v, w, CAST(CASE WHEN s >= .92 THEN 2 ELSE 1 END AS BIGINT) AS level FROM (
  SELECT a.v, b.v AS w, jaro_winkler_similarity(a.v, b.v) AS s FROM words a, words b) WHERE s >= .88"""),
    "numeric_agreement": """WITH p AS (SELECT DISTINCT c_acctbal AS v FROM customer)
SELECT a.v, b.v AS w, CAST(CASE WHEN abs(a.v - b.v) <= 1 THEN 2 ELSE 1 END AS BIGINT) AS level
FROM p a JOIN p b ON abs(a.v - b.v) <= 2.5""",
    "agreement_patterns": with_sql(LINK_PANEL_SQL, _PAIR_PATTERNS_SQL, select="""
SELECT state, pair, pattern, count(*) AS pairs FROM level1 GROUP BY ALL"""),
    "mixture_posteriors": "WITH RECURSIVE " + ",".join([LINK_PANEL_SQL, _PAIR_PATTERNS_SQL, *_mixture_sql()]) + """
SELECT state, pair, pattern, pairs, round(CASE WHEN turned THEN 1 - r ELSE r END, 4) AS posterior
FROM (SELECT *, 1 / (1 + exp(least(ttwo - tone, 700))) AS r FROM fitted)""",
    "mixture_fit": "WITH RECURSIVE " + ",".join([LINK_PANEL_SQL, _PAIR_PATTERNS_SQL, *_mixture_sql()]) + """
SELECT state, pair, count(*) AS patterns, sum(pairs)::BIGINT AS pairs, any_value(round)::BIGINT AS rounds,
  round(any_value(ll), 6) AS log_likelihood, any_value(gain) < 1e-10 AS settled,
  count(*) - count(DISTINCT regexp_replace(pattern, '[012]', 'x', 'g')) - 1 + any_value(levels)::BIGINT AS freedom
FROM (SELECT f.*, e.ll FROM fitted f JOIN (SELECT DISTINCT state, pair, round, ll FROM em) e USING (state, pair, round))
GROUP BY state, pair""",
    "one_to_one_filter": with_sql(_SCORED_SQL, """
best1 AS (SELECT * FROM (SELECT *, max(posterior) OVER (PARTITION BY index1) AS top FROM pairs) WHERE posterior = top
  QUALIFY count(*) OVER (PARTITION BY index1) = 1)""", """
best2 AS (SELECT * FROM (SELECT index1, index2, posterior, max(posterior) OVER (PARTITION BY index2) AS top FROM best1)
  WHERE posterior = top QUALIFY count(*) OVER (PARTITION BY index2) = 1)""", select="""
SELECT 'best' AS choice, index1, index2, posterior FROM best2
UNION ALL SELECT 'single', index1, index2, posterior FROM pairs
WHERE index1 IN (SELECT index1 FROM pairs GROUP BY 1 HAVING count(*) = 1)
  AND index2 IN (SELECT index2 FROM pairs GROUP BY 1 HAVING count(*) = 1)"""),
    "compile_linked": with_sql(*_chain_sql(), select="""
SELECT index, state, year, CASE WHEN state = 'NATION_1' AND length(source_id) < 6 THEN lpad(source_id, 6, '0')
  WHEN state IN ('NATION_1', 'NATION_2') THEN source_id ELSE CAST(detid AS VARCHAR) END AS id FROM ids"""),
}

SQL["link_log"] = with_sql(*_chain_sql(), select=" UNION ALL ".join(
    f"""SELECT coalesce(l.state, r.state) AS state, {year}::BIGINT AS year, coalesce(l.n, 0) AS records, coalesce(r.n, 0) AS following,
  coalesce(k.n, 0) AS exact, 0::BIGINT AS probable, CAST(NULL AS VARCHAR) AS error
FROM (SELECT state, count(*) AS n FROM left{year} GROUP BY 1) l FULL JOIN (SELECT state, count(*) AS n FROM right{year} GROUP BY 1) r ON l.state = r.state
LEFT JOIN (SELECT p.state, count(*) AS n FROM y{year}_links y JOIN panel p ON p.index = y.index2 GROUP BY 1) k ON k.state = coalesce(l.state, r.state)"""
    for year in YEARS[:-1]))

SQL["link_labels"] = with_sql(*_chain_sql(), select="""
SELECT p.index, CASE WHEN l.index2 IS NOT NULL THEN concat_ws('_', p.state, l.year, l.rule, l.index1) END AS link_label,
  CASE WHEN b.id IS NOT NULL THEN concat_ws('_', p.state, b.year, b.rule, b.id) ELSE concat_ws('_', p.state, p.year, 'nomatch', p.index) END AS person_label
FROM ids p LEFT JOIN links l ON l.index2 = p.index LEFT JOIN (SELECT * FROM links WHERE id = index1) b ON b.id = p.detid""")

SQL["compile_added_back"] = with_sql(*_chain_sql(), select="""
SELECT index, state, year, CASE WHEN state = 'NATION_1' AND length(source_id) < 6 THEN lpad(source_id, 6, '0')
  WHEN state IN ('NATION_1', 'NATION_2') THEN source_id WHEN state = 'NATION_3' THEN NULL ELSE CAST(detid AS VARCHAR) END AS id,
  CASE WHEN state NOT IN ('NATION_2', 'NATION_3') THEN detid END AS linked_id FROM ids""")

SQL["accuracy_transposed"] = with_sql(
    *_chain_sql(),
    "both_ids AS (SELECT *, concat_ws('|', state, name_first, name_last, position, NCES_leaid) AS plainid FROM ids)",
    *confusion_sql("both_ids", "source_id", "detid"),
    *[cte.replace("spans", "spans2").replace("counts AS", "counts2 AS").replace("k AS", "k2 AS").replace("s AS (SELECT later, plainid", "s2 AS (SELECT later, plainid").replace("FROM k ", "FROM k2 ").replace("FROM s ", "FROM s2 ")
      for cte in confusion_sql("both_ids", "source_id", "plainid")],
    "t AS (SELECT 'd' AS method, * FROM counts UNION ALL SELECT 'n', * FROM counts2)",
    """total AS (SELECT method, sum(true_match)::DOUBLE AS true_match, sum(false_non_match)::DOUBLE AS false_non_match,
  sum(false_match)::DOUBLE AS false_match, sum(true_non_match)::DOUBLE AS true_non_match FROM t GROUP BY 1)""",
    f"m AS (SELECT *, {METRICS_SQL} FROM total)",
    """long AS (UNPIVOT m ON true_match, false_non_match, false_match, true_non_match, "precision", recall, f_measure
  INTO NAME name VALUE value)""",
    select="""SELECT name, round(max(value) FILTER (method = 'd'), 6) AS "Deterministic Link",
  round(max(value) FILTER (method = 'n'), 6) AS "Name And Place" FROM long GROUP BY 1""",
)
