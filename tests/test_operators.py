import random

import pytest
from pyspark.sql import functions as F

from personyear.operators import aggregate, joins, survival, turnover
from personyear.operators.quality import confusion
from personyear.operators.quantiles import numeric_summary
from personyear.operators.sets import sample_groups
from personyear.operators.windows import collapse, fill_both_ways, group_index
from personyear.sources import delimited, fixed_width


def rows(df, *names):
    return sorted((tuple(row) for row in (df.select(*names) if names else df).collect()), key=repr)


def test_null_keys_match(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    dim = spark.createDataFrame([(None, "none"), ("b", "bee")], "k string, t string")
    assert rows(joins.attach(left, dim, ["k"])) == [(1, None, "none"), (2, "a", None)]


def test_unique_and_guard(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    dim = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "k string, t string")
    assert rows(joins.attach_unique(left, dim, ["k"])) == [(1, "a", None), (2, "b", None)]
    with pytest.raises(ValueError):
        joins.attach_checked(left, dim, ["k"])


def test_pattern_matches_literals_and_rules(spark, monkeypatch):
    labels = spark.createDataFrame([("clay county",), ("bay",), ("gray county",), (None,)], "name string")
    rules = spark.createDataFrame([("county",), ("ay",), ("^.ay$",), ("g.*y",), (None,)], "rule string")
    expected = rows(joins.pattern_matches(labels, "name", rules, "rule"))
    assert expected == [
        ("bay", "^.ay$"), ("bay", "ay"), ("clay county", "ay"), ("clay county", "county"),
        ("gray county", "ay"), ("gray county", "county"), ("gray county", "g.*y"),
    ]
    monkeypatch.setattr(joins, "PATTERN_BYTES", 1)
    assert rows(joins.pattern_matches(labels, "name", rules, "rule")) == expected


def test_stitch_counts_must_agree(spark):
    with pytest.raises(ValueError):
        joins.stitch([spark.range(2).toDF("ordinal"), spark.range(3).toDF("ordinal")])


def test_collapse_totals_and_nulls_last(spark):
    data = [(1, None, None, "x"), (1, 5.0, 1.0, "y"), (2, None, None, "z")]
    df = spark.createDataFrame(data, "id int, fte double, pay double, p string")
    kept = collapse(df, ["id"], [F.col("fte")], ["pay"], {"n_p": "p"})
    assert rows(kept) == [(1, 5.0, 1.0, "y", 2), (2, None, 0.0, "z", 1)]


def test_fill_and_index(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, None), (2, 1, None)], "g int, o int, v string")
    assert rows(fill_both_ways(df, ["g"], ["o"], "v")) == [(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, None)]
    people = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "b"), ("s", None)], "state string, n string")
    assert rows(group_index(people, ["n"], ["state"], "i"), "n", "i") == [("a", 1), ("b", 2), ("b", 2), (None, 3)]


def test_turnover_gap_and_duplicates(spark):
    data = [("s", 1, 2000, "TRUE", 1), ("s", 1, 2001, "TRUE", 2), ("s", 1, 2001, "TRUE", 3), ("s", 1, 2003, "TRUE", 4)]
    df = spark.createDataFrame(data, "state string, id int, year int, teacher string, record int")
    micro = turnover.turnover_micro(df, ["state"], "id", "record")
    assert rows(micro, "record", "year", "turnover") == [
        (1, 2001, False), (2, 2002, True), (3, 2002, True), (4, 2004, True),
    ]
    rates = turnover.turnover_by(turnover.turnover_counts(df, ["state"], "id"), ["year"])
    assert rows(rates) == [(2001, 0.0), (2002, 1.0), (2004, 1.0)]


def test_kaplan_meier_fixture(spark):
    # at risk 10, 8, 7, 5; events 2, 1, 0, 5
    lengths = [(1, 1)] * 2 + [(2, 1)] + [(3, 0)] * 2 + [(4, 1)] * 5
    df = spark.createDataFrame([("a", *pair) for pair in lengths], "g string, length int, status int")
    curve = survival.kaplan_meier(df, ["g"])
    got = [(r.time, r.n_risk, r.n_event, round(r.survival, 6)) for r in curve.orderBy("time").collect()]
    assert got == [(1, 10, 2, 0.8), (2, 8, 1, 0.7), (3, 7, 0, 0.7), (4, 5, 5, 0.0)]
    assert survival.median_survival(curve, ["g"]).first().median == 4.0
    table = survival.risk_table(df, ["g"]).orderBy("time").collect()
    assert [r.n_risk for r in table] == [10, 10, 8, 7, 5]


@pytest.mark.parametrize(
    "lengths, median",
    [
        ([(1, 1), (2, 0), (2, 0)], None),
        ([(1, 1), (2, 1), (3, 0), (4, 1)], 3.0),
        ([(1, 1), (3, 1)], 2.0),
        ([(1, 1), (3, 0)], 1.0),
    ],
)
def test_median_tie_rule(spark, lengths, median):
    df = spark.createDataFrame([("a", *pair) for pair in lengths], "g string, length int, status int")
    assert survival.median_survival(survival.kaplan_meier(df, ["g"]), ["g"]).first().median == median


def test_confusion_sequence(spark):
    data = [("a", "1", 2000), ("a", "1", 2001), ("b", "2", 2000), ("b", "3", 2001), ("c", "4", 2000), ("d", "4", 2001)]
    data += [(None, "9", 2000)] * 3 + [("e", "5", 2001)]
    df = spark.createDataFrame(data, "source string, made string, year int")
    assert rows(confusion(df, "source", "made")) == [(2001, 2, 2, 2, 1)]


def test_numeric_summary_matches_percentile(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 7]) * rng.randint(1, 40))) for _ in range(999)]
    df = spark.createDataFrame(data, "g string, v double")
    expected = df.groupBy("g").agg(
        F.min("v"), F.percentile("v", 0.25), F.percentile("v", 0.5), F.round(F.avg("v"), 9), F.percentile("v", 0.75), F.max("v")
    )
    got = numeric_summary(df, "v", ["g"]).withColumn("mean", F.round("mean", 9))
    assert rows(got) == rows(expected)


def test_sample_groups_is_seeded(spark):
    df = spark.range(1000).select("id", (F.col("id") % 20).alias("g"))
    first = rows(sample_groups(df, "g", "id", 3, 7))
    assert first == rows(sample_groups(df.repartition(7), "g", "id", 3, 7))
    assert len({g for _, g in first}) <= 3 and len(first) % 50 == 0


def test_leading_lines_and_layout(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / f"{2009 + value}-{2010 + value}_{name}.csv").write_text(f'Title\nid,pay,\n{value},"5,0",\n9,NDR,\n')
    df = delimited.read_csv_below(spark, str(tmp_path), 1, na="NDR")
    assert df.columns == ["id", "pay"]
    assert rows(df) == [("1", "5,0"), ("2", "5,0"), ("9", None), ("9", None)]
    years = delimited.with_file_year(spark.read.text(str(tmp_path)), "leading").select("year").distinct()
    assert rows(years) == [(2011,), (2012,)]
    (tmp_path / "fixed.txt").write_text("ab 12tail of line\ncd\n")
    slots = fixed_width.layout([("Key", 1, 3), ("No.", 4, 2), ("Rest", 6, 4)])
    fixed = fixed_width.read_fixed_width(spark, str(tmp_path / "fixed.txt"), slots)
    assert rows(fixed) == [("ab", "12", "tail of line"), ("cd", None, None)]


def test_first_match_by_row_and_by_column(spark):
    df = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u"), ("d", "w")], "alias string, unit string")
    one = spark.createDataFrame([("a", None, 1), ("b", "x", None)], "alias string, leaid string, n int")
    two = spark.createDataFrame([("u", "18A", 7)], "unit string, leaid string, n int")
    passes = [(one, ["alias"]), (two, ["unit"])]
    by_row = joins.attach_first_match(df, passes, ["leaid", "n"], source="p").collect()
    assert {r.alias: (r.leaid, r.n, r.p) for r in by_row} == {
        "a": (None, 1, 1), "b": ("x", None, 1), "c": ("18A", 7, 2), "d": (None, None, None),
    }
    by_column = joins.attach_first_match(df, passes, ["leaid", "n"], per_column=True).collect()
    assert {r.alias: (r.leaid, r.n) for r in by_column} == {"a": ("18A", 1), "b": ("x", 7), "c": ("18A", 7), "d": (None, None)}


def test_patterns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "PATTERN_BYTES", 4)
    labels = spark.createDataFrame([("abc",), ("a.c",), ("xyz",), (None,)], "label string")
    rules = spark.createDataFrame([("b",), ("a.c",), ("^x",), ("z$",), (None,)], "pattern string")
    found = {tuple(r) for r in joins.pattern_matches(labels, "label", rules, "pattern").collect()}
    assert found == {("abc", "b"), ("abc", "a.c"), ("a.c", "a.c"), ("xyz", "^x"), ("xyz", "z$")}
    literal = {tuple(r) for r in joins.substring_matches(labels, "label", rules, "pattern").collect()}
    assert literal == {("abc", "b"), ("a.c", "a.c")}


def test_labels_not_listed_are_counted(spark):
    df = spark.createDataFrame([(1, "F"), (1, "F"), (1, "X"), (1, None), (2, "O")], "g int, s string")
    assert {tuple(r) for r in aggregate.crosstab(df, "g", "s", ["F", "O"]).collect()} == {(1, 2, 0, 2), (2, 0, 1, 0)}


def test_files_with_different_headers_below_title_lines_are_refused(spark, tmp_path):
    for name, header in (("a", "x,y,"), ("b", "y,x,")):
        (tmp_path / f"{name}.csv").write_text(f"title\n{header}\n1,2,\n")
    with pytest.raises(ValueError):
        delimited.read_csv_below(spark, str(tmp_path), skip=1)
    (tmp_path / "b.csv").write_text("title\nx,y,\n3,4,\n")
    assert sorted(map(tuple, delimited.read_csv_below(spark, str(tmp_path), skip=1).collect())) == [("1", "2"), ("3", "4")]


def test_folder_scan_leaves_out_paths(spark, tmp_path):
    for name, text in (("year=1/a.csv", "x\n1\n"), ("year=2/b.csv", "x,y\n2,3\n"), ("old/c.csv", "x\n9\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = delimited.read_csv_folder(spark, str(tmp_path), recursive=True, label="path", without="/old/")
    rows = rows.withColumn("year", delimited.path_key(rows.path, "year"))
    assert sorted((r.x, r.y or "", r.year) for r in rows.collect()) == [("1", "", "1"), ("2", "3", "2")]
