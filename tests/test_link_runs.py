"""The mixture fit, what a step logs, and going on after a loss."""

import random

import numpy as np
import pytest
from pyspark import cloudpickle

import personyear
from personyear.operators import fuzzy
from personyear.plans import linkage
from personyear.session import new_folder
from tests.test_linking import panel, person


def plain_em(patterns, pairs, rounds):
    """Expectation and maximisation pattern by pattern; mean log-likelihood after every round."""
    pairs = [p / sum(pairs) for p in pairs]
    k = len(patterns[0])
    levels = [sorted({p[f] for p in patterns} - {"-"}) for f in range(k)]
    begin = {"m": {"0": 0.05, "1": 0.15, "2": 0.8}, "u": {"0": 0.8, "1": 0.15, "2": 0.05}}
    chance = {c: [{x: begin[c][x] / sum(begin[c][y] for y in levels[f]) for x in levels[f]} for f in range(k)] for c in "mu"}
    share, seen = 0.1, []
    for _ in range(rounds + 1):
        joint = []
        for pattern in patterns:
            odds = {"m": share, "u": 1 - share}
            for c in "mu":
                for f, mark in enumerate(pattern):
                    odds[c] *= 1 if mark == "-" else max(chance[c][f][mark], 1e-12)
            joint.append(odds)
        seen.append(sum(p * np.log(o["m"] + o["u"]) for p, o in zip(pairs, joint, strict=True)))
        weight = {c: [p * o[c] / (o["m"] + o["u"]) for p, o in zip(pairs, joint, strict=True)] for c in "mu"}
        share = sum(weight["m"])
        for c in "mu":
            for f in range(k):
                total = sum(w for w, p in zip(weight[c], patterns, strict=True) if p[f] != "-")
                chance[c][f] = {x: sum(w for w, p in zip(weight[c], patterns, strict=True) if p[f] == x) / total for x in levels[f]}
    return seen


def drawn(seed, fields=3, missing=0.1, n=4000, share=0.2):
    rng = random.Random(seed)
    counts = {}
    for _ in range(n):
        chances = (0.05, 0.1, 0.85) if rng.random() < share else (0.8, 0.12, 0.08)
        marks = "".join("-" if rng.random() < missing else rng.choices("012", chances)[0] for _ in range(fields))
        counts[marks] = counts.get(marks, 0) + 1
    patterns = sorted(counts)
    return patterns, [counts[p] for p in patterns]


@pytest.mark.parametrize("seed", range(4))
def test_fit_reaches_what_plain_steps_reach_in_fewer_rounds(seed):
    patterns, pairs = drawn(seed)
    fit = fuzzy.fit_mixture(patterns, np.array(pairs, dtype=float))
    slow = plain_em(patterns, pairs, 600)
    assert fit.settled and fit.freedom > 0
    assert fit.log_likelihood >= slow[-1] - 1e-8
    # As many plain steps as the fit took, two a round, are not as far.
    assert fit.log_likelihood >= slow[min(2 * fit.rounds, 600)] - 1e-12
    assert fit.rounds < 150


def test_flat_likelihood_ends_and_says_that_it_is_not_identified():
    """Two fields of three levels: nine patterns cannot fix nine parameters."""
    for seed in range(20):
        patterns, pairs = drawn(seed, fields=2, missing=0, share=0.5)
        fit = fuzzy.fit_mixture(patterns, np.array(pairs, dtype=float))
        assert fit.settled and fit.freedom == -1 and np.isfinite(fit.posterior).all()


@pytest.mark.parametrize(
    ("patterns", "pairs"),
    [(["22"], [5]), (["--"], [3]), (["00", "22"], [1e12, 1]), (["0-", "-2", "22"], [1, 1, 1]), (["00", "01", "10", "11"], [25] * 4)],
)
def test_degenerate_patterns_end(patterns, pairs):
    fit = fuzzy.fit_mixture(patterns, np.array(pairs, dtype=float))
    assert fit.settled and ((fit.posterior >= 0) & (fit.posterior <= 1)).all() and 0 <= fit.share <= 1


def test_rounds_are_bounded_and_told():
    patterns, pairs = drawn(1)
    fit = fuzzy.fit_mixture(patterns, np.array(pairs, dtype=float), rounds=1)
    assert (fit.rounds, fit.settled) == (1, False)


def people(states="ST", years=(2000, 2001, 2002), n=12):
    rng = random.Random(4)
    rows, index = [], 0
    for state in states:
        for i in range(n):
            first, last = f"{chr(97 + i)}lexander{i}", f"{chr(122 - i)}immerman{i}{state}"
            for year in years:
                index += 1
                typo = last[:-3] + last[-2:] if rng.random() < 0.3 else last
                rows.append(person(index, year, first, typo, position=f"p{rng.randint(0, 3)}", salary=1000.0 * i, state=state))
    return rows


def test_a_failing_state_is_a_row_of_the_log_and_stops_no_other(spark):
    rows = people("S") + [r[:2] + (r[2] + 1000, *r[3:]) for r in people("T", n=3)]
    good = linkage.link_ensemble(panel(spark, rows))

    def fit(patterns, pairs):
        if pairs.sum() <= 9:
            raise ZeroDivisionError("planted")
        return fuzzy.fit_mixture(patterns, pairs)

    bad = linkage.link_ensemble(panel(spark, rows), fit=fit)
    errors = {(r.state, r.error) for r in bad.log.where("error is not null").collect()}
    assert errors and {text for _, text in errors} == {"ZeroDivisionError: planted"}
    failed = {state for state, _ in errors}
    state_of = {r[2]: r[0] for r in rows}
    links = lambda done: {(r.index1, r.index2, r.rule) for r in done.links.collect() if state_of[r.index1] not in failed}
    assert failed == {"T"} and links(good) == links(bad) and links(good)
    log = {(r.state, r.year): r for r in good.log.collect()}
    assert set(log) == {(s, y) for s in "ST" for y in (2000, 2001)}
    assert sum(r.exact + r.probable for r in log.values()) == good.links.count()


def test_the_module_travels_with_tasks_after_its_similarity_was_used(spark):
    """As when the entry point is loaded: the package is pickled by value."""
    names = spark.createDataFrame([("martha", "marhta"), (None, "a"), ("", "")], "a string, b string")
    found = names.where("a is not null").select(fuzzy.jaro_winkler("a", "b").alias("s")).collect()
    assert [round(r.s, 4) for r in found] == [0.9611, 0.0]
    registered = "personyear" in cloudpickle.list_registry_pickle_by_value()
    cloudpickle.register_pickle_by_value(personyear)
    try:
        assert cloudpickle.dumps(lambda patterns, pairs: fuzzy.fit_mixture(patterns, pairs))
    finally:
        if not registered:
            cloudpickle.unregister_pickle_by_value(personyear)


def test_a_run_goes_on_after_the_last_finished_step(spark, monkeypatch):
    rows = panel(spark, people(years=(2000, 2001, 2002, 2003, 2004)))
    want = sorted(tuple(r) for r in linkage.link_deterministic(rows).links.collect())
    folder, ran, step = new_folder(spark, "resumed"), [], linkage._run_step

    def lost_after(limit):
        def run(rows, left, period, *rest):
            if len(ran) == limit:
                raise RuntimeError("lost")
            step(rows, left, period, *rest)
            ran.append(period)

        return run

    monkeypatch.setattr(linkage, "_run_step", lost_after(3))
    with pytest.raises(RuntimeError, match="lost"):
        linkage.link_deterministic(rows, folder=folder)
    assert ran == [2000, 2001, 2002]
    ran.clear()
    monkeypatch.setattr(linkage, "_run_step", lost_after(9))
    assert sorted(tuple(r) for r in linkage.link_deterministic(rows, folder=folder).links.collect()) == want
    assert ran == [2003]
    # A further year costs one step, other records of a year the steps from it on.
    ran.clear()
    more = people(years=(2000, 2001, 2002, 2003, 2004))
    more += [r[:1] + (2005, r[2] + 10_000, *r[3:]) for r in more if r[1] == 2004]
    longer = linkage.link_deterministic(panel(spark, more), folder=folder)
    assert ran == [2004]
    assert sorted(map(tuple, longer.links.collect())) == sorted(map(tuple, linkage.link_deterministic(panel(spark, more)).links.collect()))
    ran.clear()
    changed = [r for r in more if not (r[1] == 2003 and r[3].startswith("a"))]
    linkage.link_deterministic(panel(spark, changed), folder=folder)
    assert ran == [2002, 2003, 2004]
