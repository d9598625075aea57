"""What linking reads and moves: one panel a query, combinations in place of records, few rows first."""

import random
from collections import Counter

from pyspark.sql import functions as F

from entry import linking
from personyear.operators import fuzzy, matching, quality
from personyear.plans import linkage
from tests.test_linking import brute_cascade, panel, person

RULES = [rule for rule in matching.RULES if "round_salary" not in rule]


def crowd(seed, first, year, n):
    """Few names, so that most combinations have several records."""
    rng = random.Random(seed)
    pick = lambda i: (i, year, rng.choice("ab"), rng.choice("wxyz"), rng.choice([None, "m"]), rng.choice("pq"), "d", "TRUE")
    return [person(*pick(i)) for i in range(first, first + n)]


def test_rules_run_over_combinations(spark, monkeypatch):
    for seed, n in ((1, 30), (2, 60), (3, 200)):
        left, right, opened = crowd(seed, 0, 2000, n), crowd(seed + 9, 1000, 2001, n), []

        def kept(df, label, opened=opened, write=matching.written):
            table = write(df, label)
            if label == "open":
                opened.append(table.count())
            return table

        monkeypatch.setattr(matching, "written", kept)
        found = matching.cascade(panel(spark, left), panel(spark, right), RULES, numbered=True).select("rule", "index1", "index2").collect()
        monkeypatch.undo()
        assert sorted(map(tuple, found)) == brute_cascade(left, right, RULES)
        # All columns of the rules but the number: state, names, position, district, teacher.
        assert opened[0] == len({(r[0], *r[3:10]) for r in left + right}) and opened[0] < 2 * n


def test_a_repeated_or_missing_index_keeps_records(spark):
    rows = crowd(4, 0, 2000, 40) + crowd(5, 100, 2001, 40)
    assert matching.numbered_once(panel(spark, rows))
    assert not matching.numbered_once(panel(spark, rows + rows[:1]))
    assert not matching.numbered_once(panel(spark, rows + [person(None, 2001, "a", "w")]))
    # A linked record takes the others of its index with it: here the "c" of state T, which leaves one "c" to link.
    twice = [person(1, 2000, "a", "w"), person(1, 2000, "c", "x", state="T"), person(2, 2000, "c", "x", position="q", state="T")]
    twice += [person(3, 2001, "a", "w"), person(4, 2001, "c", "x", position="r", state="T")]
    links = {(r.index1, r.index2) for r in linkage.link_deterministic(panel(spark, twice)).links.collect()}
    assert links == {(1, 3), (2, 4)}


def test_a_query_over_all_methods_builds_its_panel_once(spark, monkeypatch):
    built = []

    def counted(spark, folder, build=linking.link_panel):
        built.append(folder)
        return build(spark, folder)

    monkeypatch.setattr(linking, "link_panel", counted)
    for query in (linking.link_methods_joined, linking.method_accuracy, linking.turnover_all_methods):
        built.clear()
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        assert len(built) == 1


def test_fields_with_few_similar_values_are_replaced_first(spark, monkeypatch):
    rng = random.Random(6)
    lasts = ["smith", "smithe", "smiths", "smitha", "smithy"]
    rows = [person(i, 2000 + i % 2, rng.choice(["ann", "bob"]), rng.choice(lasts), salary=float(10 * rng.randint(1, 30))) for i in range(120)]
    one, two = panel(spark, rows).where("year = 2000"), panel(spark, rows).where("year = 2001")
    fields = [fuzzy.Field("name_last"), fuzzy.Field("name_first"), fuzzy.number_field("salary")]
    agreements = fuzzy.field_agreements(panel(spark, rows), fields)
    order = []

    def met(ours, similar, name, cells, meet=fuzzy.meet_similar):
        order.append(name)
        return meet(ours, similar, name, cells)

    monkeypatch.setattr(fuzzy, "meet_similar", met)
    counts = fuzzy.PairCounts(one, two, fields, agreements)
    counts.agreeing(counts.left, ("name_last", "name_first", "salary")).collect()
    assert order == ["salary", "name_first", "name_last"]
    totals = [Counter(map(tuple, fuzzy.PairCounts(one, two, fields, x).totals().collect())) for x in (dict(agreements), agreements)]
    assert totals[0] == totals[1] and len(totals[0]) > 4


def test_combinations_of_records_are_hashed_and_not_sorted(spark, monkeypatch):
    rows = panel(spark, crowd(7, 0, 2000, 40) + crowd(8, 100, 2001, 40)).withColumn("id", F.when(F.col("index") % 3 == 0, F.col("index")))
    plans, write = [], fuzzy.written

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(fuzzy, "written", kept)
    counts = fuzzy.PairCounts(rows.where("year = 2000"), rows.where("year = 2001"), fuzzy.BACKSTOP_FIELDS, {})
    assert len(plans) == 2 and not any("SortAggregate" in plan for plan in plans)
    got = {(r.name_first, r.name_last): (r.n1, tuple(r.one)) for r in counts.left.collect()}
    want = {}
    for r in rows.where("year = 2000").collect():
        n, one = want.get((r.name_first, r.name_last), (0, (-1, None)))
        want[r.name_first, r.name_last] = (n + 1, max(one, (r["index"], r.id), key=lambda pair: pair[0]))
    assert got == want


def test_a_folder_of_one_run_is_not_digested(spark, monkeypatch):
    monkeypatch.setattr(linkage, "_year_digests", None)
    rows = crowd(1, 0, 2000, 20) + crowd(2, 100, 2001, 20)
    assert linkage.link_deterministic(panel(spark, rows)).log.count() == 1


def test_link_quality_hashes_numbers_and_counts_missing_ids_as_one(spark):
    """Per pair of years: records by how many share their official id, then the constructed one, missing or not."""
    rng = random.Random(3)
    rows = [(2000 + i % 3, str(rng.randint(1, 25)), rng.choice([None, 1, 2, 3, 4, 5, 6])) for i in range(60)]
    got = quality.confusion(spark.createDataFrame(rows, "year int, official string, constructed long"), "official", "constructed")
    want = []
    for later in (2001, 2002):
        own = [r for r in rows if later - 1 <= r[0] <= later]
        same = Counter(r[1] for r in own)
        shared = Counter((same[r[1]], r[2]) for r in own)
        classes = Counter((same[r[1]], min(shared[same[r[1]], r[2]], 3)) for r in own)
        want.append((later, classes[2, 2], classes[2, 1] + classes[2, 3], classes[1, 2], classes[1, 1]))
    assert sorted(map(tuple, got.collect())) == want
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
