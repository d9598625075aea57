"""Turnover, survival and availability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from personyear.operators import survival, turnover
from personyear.operators.windows import collapse, drop_last_period
from personyear.plans import reports

from .panels import (
    CUSTOMER_ORDERS_SQL,
    CUSTOMER_PANEL_SQL,
    DISTRICT_PANEL_SQL,
    customer_orders,
    customer_panel,
    district_panel,
    tidy,
    with_sql,
)

# Parameters of the district reports on these tables.
SIZE = 8
SPAN = (1996, 2001)
LIMIT = 0.1
STEP = 0.02
# Rates of the kernel density: from, to, points of the grid.
GRID = (0.0, 1.0, 51)


def collapse_person_year(spark, folder):
    records = customer_orders(spark, folder).withColumn("price", F.col("salary"))
    kept = collapse(
        records,
        ["state", "id", "year"],
        [F.col("price"), F.col("o_orderkey")],
        totals=["salary"],
        distinct={"n_position": "position", "n_status": "status"},
    )
    return tidy(kept.drop("price"))


def turnover_micro(spark, folder):
    flags = turnover.turnover_micro(customer_panel(spark, folder), ["state"], "id", "o_orderkey")
    return tidy(flags.select("state", "id", "year", "teacher", "turnover"))


def turnover_records(spark, folder):
    """Several records of a person in one year: all but the last count as turnover."""
    flags = turnover.turnover_micro(customer_orders(spark, folder), ["state"], "id", "o_orderkey")
    return tidy(flags.select("o_orderkey", "year", "turnover"))


def turnover_by_state(spark, folder):
    counts = turnover.turnover_counts(customer_panel(spark, folder), ["state"], "id", flagged_only=False)
    return tidy(turnover.turnover_by(counts, ["year", "state"]))


def _four_ways(spark, folder):
    return reports.four_turnovers(district_panel(spark, folder), "NCES_leaid", "id")


def turnover_four_ways(spark, folder):
    return tidy(_four_ways(spark, folder))


def turnover_labels(spark, folder):
    return tidy(turnover.label_spans(_four_ways(spark, folder), ["state"], "state_fmt"))


def drop_last(spark, folder):
    counts = turnover.turnover_counts(customer_panel(spark, folder), ["state"], "id", flagged_only=False)
    return tidy(drop_last_period(turnover.turnover_by(counts, ["year", "state"], size=True), ["state"]))


def _series(spark, folder):
    return turnover.district_turnover(district_panel(spark, folder), "NCES_leaid", "id")


def district_turnover(spark, folder):
    return tidy(_series(spark, folder))


def district_turnover_table(spark, folder):
    return tidy(turnover.turnover_table(_series(spark, folder), SIZE))


def district_turnover_overall(spark, folder):
    return tidy(turnover.district_overall(_series(spark, folder), "NCES_leaid"))


def share_excluded(spark, folder):
    return tidy(turnover.share_excluded(_series(spark, folder), SIZE, SPAN, LIMIT))


def turnover_density(spark, folder):
    return tidy(turnover.turnover_density(_series(spark, folder), SIZE, SPAN, LIMIT, STEP, ["state", "year"]))


def turnover_kernel(spark, folder):
    """Density of district rates of each year, one bandwidth per state."""
    rates = _series(spark, folder).where(turnover.in_scope(1, SPAN))
    return tidy(turnover.kernel_density(rates, "turnover", ["state"], ["year"], *GRID))


def _spells(spark, folder):
    panel = customer_panel(spark, folder)
    return survival.spells(panel, survival.observation_window(panel), ["state", "id"])


def spells(spark, folder):
    return tidy(_spells(spark, folder))


def spells_any_job(spark, folder):
    panel = customer_panel(spark, folder)
    return tidy(survival.spells_any_job(panel, survival.observation_window(panel), ["state", "id"]))


def _district_spells(spark, folder):
    panel = district_panel(spark, folder)
    return survival.spells(panel, survival.observation_window(panel), ["state", "NCES_leaid", "id"])


def spells_district(spark, folder):
    return tidy(_district_spells(spark, folder).drop("state_fmt"))


def _curve(spark, folder):
    return survival.kaplan_meier(_spells(spark, folder), ["state_fmt"])


def km_curve(spark, folder):
    return tidy(_curve(spark, folder))


def km_any_job(spark, folder):
    """Survival in the records at all, whatever the job after the first year."""
    panel = customer_panel(spark, folder)
    any_job = survival.spells_any_job(panel, survival.observation_window(panel), ["state", "id"])
    return tidy(survival.kaplan_meier(any_job, ["state_fmt"]))


def km_median(spark, folder):
    return tidy(survival.median_survival(_curve(spark, folder), ["state_fmt"]))


def km_limits(spark, folder):
    limited = survival.confidence_limits(_curve(spark, folder))
    return tidy(limited.select("state_fmt", "time", "survival", "lower", "upper"))


def km_median_limits(spark, folder):
    return tidy(survival.median_limits(_curve(spark, folder), ["state_fmt"]))


def km_risk_table(spark, folder):
    return tidy(survival.risk_table(_spells(spark, folder), ["state_fmt"]))


def median_reference(spark, folder):
    medians = survival.median_survival(_curve(spark, folder), ["state_fmt"])
    return tidy(reports.with_professions(medians, "state_fmt"))


def median_vs_turnover(spark, folder):
    return tidy(
        reports.median_against_turnover(_district_spells(spark, folder), _series(spark, folder), "NCES_leaid")
    )


def availability_table(spark, folder):
    return tidy(reports.availability(customer_panel(spark, folder), ("NATION_3", 1998)))


QUERIES = {
    "turnover_by_state": turnover_by_state,
    "collapse_person_year": collapse_person_year,
    "turnover_micro": turnover_micro,
    "turnover_records": turnover_records,
    "turnover_four_ways": turnover_four_ways,
    "turnover_labels": turnover_labels,
    "drop_last_period": drop_last,
    "district_turnover": district_turnover,
    "district_turnover_table": district_turnover_table,
    "district_turnover_overall": district_turnover_overall,
    "share_excluded": share_excluded,
    "turnover_density": turnover_density,
    "turnover_kernel": turnover_kernel,
    "spells": spells,
    "spells_any_job": spells_any_job,
    "spells_district": spells_district,
    "km_curve": km_curve,
    "km_any_job": km_any_job,
    "km_median": km_median,
    "km_limits": km_limits,
    "km_median_limits": km_median_limits,
    "km_risk_table": km_risk_table,
    "median_reference": median_reference,
    "median_vs_turnover": median_vs_turnover,
    "availability_table": availability_table,
}

_LEAVES = "CASE WHEN lead(year) OVER w IS NULL OR lead(year) OVER w <> year + 1 THEN 1 ELSE 0 END"


def micro_sql(name: str, keys: str, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT *, year + 1 AS after, {_LEAVES} AS turnover
  FROM panel WHERE {where} WINDOW w AS (PARTITION BY {keys} ORDER BY year))"""


_STATE_SERIES = [
    CUSTOMER_PANEL_SQL,
    micro_sql("micro", "state, id"),
    """series AS (SELECT after AS year, state, avg(turnover) AS turnover, count(*) AS n FROM micro
  WHERE teacher = 'TRUE' GROUP BY ALL)""",
]

_FOUR_WAYS = [
    DISTRICT_PANEL_SQL,
    micro_sql("m1", "state, id", "teacher = 'TRUE'"),
    micro_sql("m2", "state, id"),
    micro_sql("m3", "NCES_leaid, state, id", "teacher = 'TRUE'"),
    micro_sql("m4", "NCES_leaid, state, id"),
    """four AS (SELECT 'Any Job District' AS turnover_type, * FROM m4 UNION ALL SELECT 'Teacher District', * FROM m3)""",
]

# A supplier serves several nations of a region in one year, so the statewide
# definitions meet several records per person and year: the last one, a
# flagged one if there is any, looks ahead.
_STATE_WAYS = """
d1 AS (SELECT state, id, year, count(*) AS n FROM panel WHERE teacher = 'TRUE' GROUP BY ALL),
e1 AS (SELECT 'Teacher State' AS turnover_type, *, year + 1 AS after, """ + _LEAVES + """ AS t FROM d1
  WINDOW w AS (PARTITION BY state, id ORDER BY year)),
d2 AS (SELECT state, id, year, count(*) FILTER (teacher = 'TRUE') AS n FROM panel GROUP BY ALL),
e2 AS (SELECT 'Any Job State' AS turnover_type, *, year + 1 AS after, """ + _LEAVES + """ AS t FROM d2
  WINDOW w AS (PARTITION BY state, id ORDER BY year)),
turns AS (
  SELECT turnover_type, after AS year, state, avg(turnover) AS turnover FROM four WHERE teacher = 'TRUE' GROUP BY ALL
  UNION ALL SELECT turnover_type, after, state, sum(n - 1 + t) / sum(n) FROM
    (SELECT * FROM e1 UNION ALL SELECT * FROM e2) WHERE n > 0 GROUP BY ALL)"""

_SERIES = [
    DISTRICT_PANEL_SQL,
    micro_sql("micro", "state, NCES_leaid, id", "teacher = 'TRUE'"),
    """full_series AS (SELECT *, max(year) OVER (PARTITION BY NCES_leaid, state) AS last FROM
  (SELECT NCES_leaid, state, after AS year, avg(turnover) AS turnover, count(*) AS n FROM micro GROUP BY ALL))""",
    "series AS (SELECT NCES_leaid, state, year, turnover, n FROM full_series WHERE year <> last)",
]

def spells_sql(panel: str, keys: str) -> list[str]:
    return [
        panel,
        "ends AS (SELECT state, min(year) AS state_start, max(year) AS state_end FROM panel GROUP BY 1)",
        f"""spell AS (SELECT *, n_years AS length, CAST(year_last < state_end AS BIGINT) AS status,
  state || ' (' || (state_start + 1) || '-' || state_end || ')' AS state_fmt FROM (
  SELECT {keys}, min(year) AS year_first, max(year) AS year_last, count(*) AS n_years
  FROM panel WHERE teacher = 'TRUE' GROUP BY ALL) JOIN ends USING (state) WHERE year_first <> state_start)""",
    ]


_KM = """
counts AS (SELECT {strata}, length AS time, CAST(sum(status) AS BIGINT) AS n_event,
  CAST(sum(1 - status) AS BIGINT) AS n_censor FROM spell GROUP BY ALL),
risk AS (SELECT *, CAST(sum(n_event + n_censor) OVER (PARTITION BY {strata} ORDER BY time DESC) AS BIGINT) AS n_risk FROM counts),
curve AS (SELECT *, product(1 - n_event / n_risk) OVER w AS survival,
  sum(CASE WHEN n_risk > n_event THEN n_event / (n_risk * (n_risk - n_event)) END) OVER w AS variance FROM risk
  WINDOW w AS (PARTITION BY {strata} ORDER BY time)),
kept AS (SELECT *, max(survival) OVER (PARTITION BY {strata}) AS top FROM curve WHERE survival < .5 + 1.5e-8),
med AS (SELECT {strata}, CASE WHEN abs(max(top) - .5) < 1.5e-8 AND count(*) FILTER (survival < top) > 0
  THEN (min(time) + min(time) FILTER (survival < top)) / 2 ELSE min(time) END AS median FROM kept GROUP BY ALL),
medians AS (SELECT s.*, CAST(median AS DOUBLE) AS median FROM (SELECT DISTINCT {strata} FROM counts) s LEFT JOIN med USING ({strata}))"""

_ANY_JOB = """
SELECT s.*, year_last - year_first + 1 AS length, state_start, state_end, CAST(year_last < state_end AS BIGINT) AS status,
  s.state || ' (' || (state_start + 1) || '-' || state_end || ')' AS state_fmt
FROM (SELECT state, id, min(year) AS year_first, max(year) AS year_last FROM (
  SELECT *, min(year) OVER (PARTITION BY state, id) AS first FROM panel)
  WHERE teacher = 'TRUE' OR year > first GROUP BY ALL) s
JOIN (SELECT state, min(year) AS state_start, max(year) AS state_end FROM panel GROUP BY 1) e ON s.state = e.state
WHERE year_first <> state_start"""

_STATE_KM = [*spells_sql(CUSTOMER_PANEL_SQL, "state, id"), _KM.format(strata="state_fmt")]

SQL = {
    "turnover_by_state": with_sql(*_STATE_SERIES, select="SELECT year, state, round(turnover, 6) AS turnover FROM series"),
    "collapse_person_year": with_sql(CUSTOMER_ORDERS_SQL, select="""
SELECT k.state, k.id, k.year, position, status, round(total, 6) AS salary, o_orderkey, n_position, n_status FROM (
  SELECT *, row_number() OVER (PARTITION BY state, id, year ORDER BY salary DESC, o_orderkey DESC) AS rn FROM pay) k
JOIN (SELECT state, id, year, sum(salary) AS total, count(DISTINCT position) AS n_position,
  count(DISTINCT status) AS n_status FROM pay GROUP BY ALL) t
ON k.state = t.state AND k.id = t.id AND k.year = t.year WHERE rn = 1"""),
    "turnover_micro": with_sql(CUSTOMER_PANEL_SQL, micro_sql("micro", "state, id"), select="""
SELECT state, id, after AS year, teacher, turnover = 1 AS turnover FROM micro"""),
    "turnover_records": with_sql(CUSTOMER_ORDERS_SQL, select=f"""
SELECT o_orderkey, year + 1 AS year, {_LEAVES} = 1 AS turnover FROM pay
WINDOW w AS (PARTITION BY state, id ORDER BY year, o_orderkey)"""),
    "turnover_four_ways": with_sql(*_FOUR_WAYS, _STATE_WAYS, select="""
SELECT turnover_type, year, state, round(turnover, 6) AS turnover FROM turns"""),
    "turnover_labels": with_sql(*_FOUR_WAYS, _STATE_WAYS, select="""
SELECT turnover_type, year, state, round(turnover, 6) AS turnover,
  state || ' (' || min(year) OVER (PARTITION BY state) || '-' || max(year) OVER (PARTITION BY state) || ')' AS state_fmt
FROM (SELECT *, max(year) OVER (PARTITION BY state) AS last FROM turns) WHERE year <> last"""),
    "drop_last_period": with_sql(*_STATE_SERIES, select="""
SELECT year, state, round(turnover, 6) AS turnover, n FROM (SELECT *, max(year) OVER (PARTITION BY state) AS last FROM series)
WHERE year <> last"""),
    "district_turnover": with_sql(*_SERIES, select="""
SELECT NCES_leaid, state, year, round(turnover, 6) AS turnover, n FROM series"""),
    "district_turnover_table": with_sql(*_SERIES, select=f"""
SELECT state, round(quantile_cont(turnover, .25), 6) AS p25, round(quantile_cont(turnover, .5), 6) AS median,
  round(quantile_cont(turnover, .75), 6) AS p75, round(avg(turnover), 6) AS mean, round(stddev_samp(turnover), 6) AS sd,
  count(*) AS n, min(year) || ':' || max(year) AS years FROM series WHERE n >= {SIZE} GROUP BY state"""),
    "district_turnover_overall": with_sql(*_SERIES, select="""
SELECT NCES_leaid, state, round(sum(turnover * n) / sum(n), 6) AS turnover,
  round(sum(n) / (max(year) - min(year) + 1), 6) AS n FROM series GROUP BY ALL"""),
    "share_excluded": with_sql(*_SERIES, select=f"""
SELECT count(*) AS n, round(avg(CAST(turnover > {LIMIT} AS INT)), 6) AS p,
  printf('%.1f%%', avg(CAST(turnover > {LIMIT} AS INT)) * 100.0) AS label
FROM series WHERE n >= {SIZE} AND year BETWEEN {SPAN[0]} AND {SPAN[1]}"""),
    "turnover_density": with_sql(*_SERIES, select=f"""
SELECT state, year, CAST(floor(turnover / {STEP}::DOUBLE) AS BIGINT) AS bin, count(*) AS n
FROM series WHERE n >= {SIZE} AND year BETWEEN {SPAN[0]} AND {SPAN[1]} AND turnover < {LIMIT} GROUP BY ALL"""),
    "turnover_kernel": with_sql(*_SERIES, f"""
rates AS (SELECT state, year, turnover AS v FROM series WHERE n >= 1 AND year BETWEEN {SPAN[0]} AND {SPAN[1]})""", """
own AS (SELECT state, year, count(*) AS n, 0.9 * pow(count(*), -0.2) * coalesce(
    CASE WHEN least(stddev_samp(v), (quantile_cont(v, .75) - quantile_cont(v, .25)) / 1.34) > 0
      THEN least(stddev_samp(v), (quantile_cont(v, .75) - quantile_cont(v, .25)) / 1.34) END,
    CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) END, CASE WHEN abs(min(v)) > 0 THEN abs(min(v)) END, 1) AS bw
  FROM rates GROUP BY ALL HAVING count(*) >= 3)""", """
sizes AS (SELECT state, year, n, avg(bw) OVER (PARTITION BY state) AS bw FROM own)""", f"""
placed AS (SELECT state, year, (least(greatest(v, {GRID[0]}), {GRID[1]}) - {GRID[0]}) / ({GRID[1]}::DOUBLE - {GRID[0]}) * {GRID[2] - 1} AS p FROM rates)""", f"""
halves AS (SELECT state, year, least(floor(p), {GRID[2] - 2}) AS i, 1 - p + least(floor(p), {GRID[2] - 2}) AS w FROM placed
  UNION ALL SELECT state, year, least(floor(p), {GRID[2] - 2}) + 1, p - least(floor(p), {GRID[2] - 2}) FROM placed)""", f"""
grid AS (SELECT j, {GRID[0]} + j * ({GRID[1]}::DOUBLE - {GRID[0]}) / {GRID[2] - 1} AS x FROM unnest(range({GRID[2]})) AS t(j))""", select=f"""
SELECT state, year, round(x, 6) AS x, round(sum(w * exp(-pow((j - i) * ({GRID[1]}::DOUBLE - {GRID[0]}) / {GRID[2] - 1} / bw, 2) / 2)) / any_value(sqrt(2 * pi()) * bw * n), 6) AS density
FROM (SELECT state, year, i, sum(w) AS w FROM halves GROUP BY ALL) JOIN sizes USING (state, year), grid WHERE w > 0 GROUP BY state, year, x"""),
    "spells": with_sql(*spells_sql(CUSTOMER_PANEL_SQL, "state, id"), select="SELECT * FROM spell"),
    "spells_any_job": with_sql(CUSTOMER_PANEL_SQL, select=_ANY_JOB),
    "spells_district": with_sql(*spells_sql(DISTRICT_PANEL_SQL, "state, NCES_leaid, id"), select="SELECT * EXCLUDE (state_fmt) FROM spell"),
    "km_curve": with_sql(*_STATE_KM, select="""
SELECT state_fmt, time, n_risk, n_event, n_censor, round(survival, 6) AS survival,
  CASE WHEN survival > 0 THEN round(survival * sqrt(variance), 6) END AS std_error FROM curve"""),
    "km_any_job": with_sql(CUSTOMER_PANEL_SQL, f"spell AS ({_ANY_JOB})", _KM.format(strata="state_fmt"), select="""
SELECT state_fmt, time, n_risk, n_event, n_censor, round(survival, 6) AS survival,
  CASE WHEN survival > 0 THEN round(survival * sqrt(variance), 6) END AS std_error FROM curve"""),
    "km_median": with_sql(*_STATE_KM, select="SELECT state_fmt, median FROM medians"),
    "km_limits": with_sql(*_STATE_KM, select="""
SELECT state_fmt, time, round(survival, 6) AS survival,
  CASE WHEN survival > 0 THEN round(survival * exp(-1.959963984540054 * sqrt(variance)), 6) END AS lower,
  CASE WHEN survival > 0 THEN round(least(survival * exp(1.959963984540054 * sqrt(variance)), 1), 6) END AS upper FROM curve"""),
    "km_median_limits": with_sql(*_STATE_KM, """
limited AS (SELECT state_fmt, time, survival, CASE WHEN survival > 0 THEN survival * exp(-1.959963984540054 * sqrt(variance)) END AS lower,
  CASE WHEN survival > 0 THEN least(survival * exp(1.959963984540054 * sqrt(variance)), 1) END AS upper FROM curve)""", """
long AS (UNPIVOT limited ON survival, lower, upper INTO NAME what VALUE value)""", """
half AS (SELECT *, max(value) OVER (PARTITION BY state_fmt, what) AS top FROM long WHERE value < .5 + 1.5e-8)""", """
times AS (SELECT state_fmt, what, CASE WHEN abs(max(top) - .5) < 1.5e-8 AND count(*) FILTER (value < top) > 0
  THEN (min(time) + min(time) FILTER (value < top)) / 2 ELSE min(time) END::DOUBLE AS at_half FROM half GROUP BY ALL)""", select="""
SELECT s.state_fmt, max(at_half) FILTER (what = 'survival') AS median, max(at_half) FILTER (what = 'lower') AS lower,
  max(at_half) FILTER (what = 'upper') AS upper
FROM (SELECT DISTINCT state_fmt FROM counts) s LEFT JOIN times USING (state_fmt) GROUP BY s.state_fmt"""),
    "km_risk_table": with_sql(*spells_sql(CUSTOMER_PANEL_SQL, "state, id"), select="""
SELECT g.state_fmt, g.time, count(*) FILTER (s.length >= g.time) AS n_risk
FROM (SELECT state_fmt, unnest(generate_series(0, max(length))) AS time FROM spell GROUP BY 1) g
JOIN spell s ON s.state_fmt = g.state_fmt GROUP BY ALL"""),
    "median_reference": with_sql(*_STATE_KM, select="SELECT 'state' AS kind, state_fmt AS label, median FROM medians UNION ALL "
        + " UNION ALL ".join(
            f"SELECT 'profession', '{name}', {value}" for name, value in reports.TENURE_BY_PROFESSION)),
    "median_vs_turnover": with_sql(
        *spells_sql(DISTRICT_PANEL_SQL, "state, NCES_leaid, id"), _KM.format(strata="NCES_leaid"), *_SERIES[1:], select="""
SELECT m.NCES_leaid, m.median, s.state, round(s.turnover, 6) AS turnover, round(s.n, 6) AS n FROM medians m JOIN (
  SELECT NCES_leaid, state, sum(turnover * n) / sum(n) AS turnover, sum(n) / (max(year) - min(year) + 1) AS n
  FROM series GROUP BY ALL) s ON m.NCES_leaid = s.NCES_leaid"""),
    "availability_table": with_sql(CUSTOMER_PANEL_SQL, select="""
SELECT state, min(year) || '-' || max(year) AS years, count(*) AS total_records,
  count(*) FILTER (teacher = 'TRUE') AS teacher_records,
  printf('%.0f%%', 100.0 * count(*) FILTER (teacher = 'TRUE') / count(*)) AS proportion_teacher
FROM panel WHERE NOT (state = 'NATION_3' AND year > 1998) GROUP BY state"""),
}
