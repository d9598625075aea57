import itertools
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from personyear.functions.similarity import similarity
from personyear.operators import fuzzy, matching
from personyear.plans import linkage

SCHEMA = (
    "state string, year int, index long, name_first string, name_middle string, name_other string, "
    "name_last string, position string, NCES_leaid string, teacher string, salary double"
)


def person(index, year, first, last, middle=None, position="p", district="d", teacher="TRUE", salary=40000.0, state="S"):
    return (state, year, index, first, middle, None, last, position, district, teacher, salary)


def panel(spark, people):
    return spark.createDataFrame(people, SCHEMA)


def ids(df, name="pid"):
    return {row["index"]: row[name] for row in df.collect()}


def deterministic(spark, people):
    rows = panel(spark, people)
    return ids(linkage.with_ids(rows, linkage.link_deterministic(rows).links, "pid"))


def test_rule_needs_one_on_each_side(spark):
    left = panel(spark, [person(1, 2000, "a", "b"), person(2, 2000, "a", "b"), person(3, 2000, "c", "d")])
    right = panel(spark, [person(4, 2001, "a", "b"), person(5, 2001, "c", "d")])
    found = matching.match_rule(left, right, ["name_first", "name_middle", "name_last"]).collect()
    assert [tuple(row) for row in found] == [(3, 5)]


def test_states_stay_apart(spark):
    left = panel(spark, [person(1, 2000, "a", "b", state="S"), person(2, 2000, "a", "b", state="T")])
    right = panel(spark, [person(4, 2001, "a", "b", state="T")])
    assert [tuple(r) for r in matching.match_rule(left, right, ["name_first"]).collect()] == [(2, 4)]


def test_linked_then_absent_gets_a_new_id(spark):
    got = deterministic(spark, [person(i, y, "a", "b") for i, y in ((1, 2010), (2, 2011), (4, 2013))] + [person(9, 2012, "x", "y")])
    assert got[1] == got[2] == 1 and got[4] == 4


def test_never_linked_bridges_a_gap(spark):
    got = deterministic(spark, [person(1, 2010, "a", "b"), person(9, 2011, "x", "y"), person(3, 2012, "a", "b")])
    assert got[3] == 1 and got[9] == 9


def test_missing_year_links_nothing(spark):
    got = deterministic(spark, [person(1, 2010, "a", "b"), person(3, 2012, "a", "b")])
    assert got == {1: 1, 3: 3}


def test_row_order_does_not_matter(spark):
    rng = random.Random(3)
    people = [
        person(i, 2000 + i % 4, rng.choice("abc"), rng.choice("xyz"), position=rng.choice("pq"), district=rng.choice("de"))
        for i in range(120)
    ]
    first = deterministic(spark, people)
    rng.shuffle(people)
    assert deterministic(spark, people) == first


def brute_cascade(left, right, rules):
    """(rule, index1, index2) by plain loops over pairs."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    left, right = [dict(zip(names, r)) for r in left], [dict(zip(names, r)) for r in right]
    found = []
    for number, rule in enumerate(rules, 1):
        keys = ["state", *rule]
        pairs = [(a, b) for a in left for b in right if all(a[k] == b[k] for k in keys)]
        tally = {}
        for a, _ in pairs:
            key = tuple(a[k] for k in keys)
            tally[key] = tally.get(key, 0) + 1
        hits = [(a["index"], b["index"]) for a, b in pairs if tally[tuple(a[k] for k in keys)] == 1]
        found += [(str(number), *hit) for hit in hits]
        left = [a for a in left if a["index"] not in {h[0] for h in hits}]
        right = [b for b in right if b["index"] not in {h[1] for h in hits}]
    return sorted(found)


def test_cascade_against_brute_force(spark):
    rng = random.Random(11)
    rules = [rule for rule in matching.RULES if "round_salary" not in rule]
    make = lambda i, year: person(
        i, year, rng.choice("abcd"), rng.choice("wxyz"), rng.choice([None, "m"]), rng.choice("pq"), rng.choice("de"), rng.choice(["TRUE", "FALSE"])
    )
    left, right = [make(i, 2000) for i in range(80)], [make(100 + i, 2001) for i in range(80)]
    got = matching.cascade(panel(spark, left), panel(spark, right), rules).select("rule", "index1", "index2")
    assert sorted(tuple(r) for r in got.collect()) == brute_cascade(left, right, rules)


@pytest.mark.parametrize("cut", [0.88, 0.92, 0.85])
def test_similar_texts_against_all_pairs(spark, cut):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(180)}
    words |= {w + rng.choice("abz") for w in list(words)[:60]} | {"ann", "anne", "anna", "hannah", "o'neil", "oneil"}
    pairs = pd.DataFrame([(a, b) for a in words for b in words if a != b], columns=["v", "w"])
    score = similarity(pairs.v, pairs.w)
    expected = set(zip(pairs.v[score >= cut], pairs.w[score >= cut]))
    got = fuzzy.similar_texts(spark.createDataFrame([(w,) for w in words], "v string"), cut)
    found = [(r.v, r.w) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_similar_numbers_against_all_pairs(spark):
    rng = random.Random(4)
    values = {round(rng.uniform(-20, 20), 1) for _ in range(150)}
    got = fuzzy.similar_numbers(spark.createDataFrame([(x,) for x in values], "v double"), 2.5)
    assert {(r.v, r.w) for r in got.collect()} == {(a, b) for a in values for b in values if abs(a - b) <= 2.5}


def level(field, a, b):
    if a is None or b is None:
        return "-"
    if field.number:
        gap = abs(a - b)
        return "2" if gap <= field.full else "1" if field.partial and gap <= field.part else "0"
    score = 1.0 if a == b else similarity(pd.Series([a]), pd.Series([b]))[0]
    return "2" if score >= field.full else "1" if field.partial and score >= field.part else "0"


def test_patterns_and_links_against_all_pairs(spark):
    rng = random.Random(8)
    firsts, lasts = ["anna", "anne", "hanna", "bob", "bobby", None], ["smith", "smyth", "smithe", "jones", "jonas"]
    make = lambda i, year: person(i, year, rng.choice(firsts), rng.choice(lasts), salary=float(rng.choice([100, 101, 103, 200, None or 300])))
    left, right = [make(i, 2000) for i in range(40)], [make(100 + i, 2001) for i in range(40)]
    left += [person(60, 2000, "zelda", "quincy", salary=500.0), person(61, 2000, "yorick", "vance", salary=501.0)]
    right += [person(160, 2001, "zelda", "quincey", salary=500.0), person(161, 2001, "yorick", "vance", salary=502.0)]
    fields = [fuzzy.Field("name_first", full=0.92), fuzzy.Field("name_last", full=0.92), fuzzy.number_field("salary")]
    one, two = panel(spark, left), panel(spark, right)
    agreements = fuzzy.field_agreements(one.unionByName(two), fields)
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    dicts = lambda rows: [dict(zip(names, r)) for r in rows]
    pattern = {
        (a["index"], b["index"]): "".join(level(f, a[f.name], b[f.name]) for f in fields)
        for a, b in itertools.product(dicts(left), dicts(right))
    }
    expected = pd.Series(list(pattern.values())).value_counts().to_dict()
    counts = fuzzy.PairCounts(one, two, fields, agreements)
    got = {r.pattern: int(r.pairs) for r in fuzzy.pattern_counts(counts).collect()}
    assert got == expected

    # links: best right record of each left one, then best left one of each right one, no ties
    order = sorted(expected)
    posterior = fuzzy.fit_mixture(order, pd.Series([expected[p] for p in order], dtype=float).to_numpy()).posterior
    score = dict(zip(order, posterior))
    for threshold in (0.8, 0.3, 0.05):
        pairs = [(i, j, score[p]) for (i, j), p in pattern.items() if score[p] >= threshold]
        for side in (0, 1):
            best = {}
            for pair in pairs:
                best.setdefault(pair[side], []).append(pair)
            pairs = []
            for options in best.values():
                top = max(p[2] for p in options)
                tied = [p for p in options if p[2] == top]
                pairs += tied if len(tied) == 1 else []
        links, _ = fuzzy.probable_links(one, two, fields, agreements, threshold)
        assert {(r.index1, r.index2) for r in links.collect()} == {(i, j) for i, j, _ in pairs}
        table = spark.createDataFrame(
            [(i, j, float(score[p])) for (i, j), p in pattern.items() if score[p] >= threshold] or [(0, 0, 0.0)],
            "index1 long, index2 long, posterior double",
        )
        if pairs:
            assert {(r.index1, r.index2) for r in fuzzy.best_pairs(table).collect()} == {(i, j) for i, j, _ in pairs}


def test_ensemble_links_typos_one_to_one(spark):
    people = []
    for i in range(30):
        first, last = f"{chr(97 + i % 26)}lexander{i}", f"{chr(122 - i % 26)}immerman{i}"
        people.append(person(i, 2000, first, last, position=f"p{i}", salary=1000.0 * i))
        typo = last[:-3] + last[-2:] if i % 5 == 0 else last
        people.append(person(100 + i, 2001, first, typo, position=f"q{i}", salary=1000.0 * i + 300000))
    rows = panel(spark, people)
    links = linkage.link_ensemble(rows).links
    pairs = [(r.index1, r.index2) for r in links.collect()]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert all(b - a == 100 for a, b in pairs)
    assert len(pairs) >= 24
    assert linkage.with_ids(rows, links, "pid").where(F.col("pid").isNull()).count() == 0


def test_titles_with_blanks_do_not_meet_all_others(spark):
    """Candidates of multi-word values stay far from all pairs, and none is lost."""
    rng = random.Random(8)
    parts = ["grade", "teacher", "math", "aide", "bus", "special", "school", "driver", "clerk", "nurse", "5", "12", "lead", "art"]
    titles = sorted({" ".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(260)})
    values = spark.createDataFrame([(t,) for t in titles], "v string")
    candidates = fuzzy.candidate_texts(values, 0.9)
    assert candidates.count() < 0.1 * len(titles) * (len(titles) - 1) / 2
    found = {(r.v, r.w) for r in fuzzy.similar_texts(values, 0.9).collect()}
    expected = {(a, b) for a in titles for b in titles if a != b and duck_similarity(a, b) >= 0.9}
    assert found == expected


def duck_similarity(a, b, connection=duckdb.connect()):
    return connection.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
