"""Fills over spread keys, kernel densities and survival limits next to plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from personyear.operators import survival, turnover
from personyear.operators.windows import fill_both_ways


def plain_fill(rows):
    groups = {}
    for key, at, value in rows:
        groups.setdefault(key, []).append((at, value))
    found = []
    for key, values in groups.items():
        values.sort()
        for i, (at, value) in enumerate(values):
            before = [v for _, v in values[: i + 1] if v is not None]
            after = [v for _, v in values[i:] if v is not None]
            found.append((key, at, before[-1] if before else after[0] if after else None))
    return sorted(found, key=str)


def test_fill_of_a_key_that_lies_in_many_ranges(spark):
    rng = random.Random(6)
    rows = [(None if k == 3 else k, at, f"v{at}" if rng.random() < 0.04 else None) for k in range(40) for at in range(rng.randint(1, 9))]
    rows += [(100, at, f"h{at}" if 150 < at < 900 and rng.random() < 0.01 else None) for at in range(1200)]
    rows += [(101, at, None) for at in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = fill_both_ways(df, ["k"], ["o"], "v")
        assert sorted(map(tuple, filled.collect()), key=str) == plain_fill(rows)
        ranged = df.repartitionByRange("k", "o").withColumn("at", F.spark_partition_id())
        ranged = [r for r in ranged.groupBy("at", "k").count().collect() if r.k == 100]
        assert len(ranged) > 4 and max(r["count"] for r in ranged) < len(rows) / 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_kernel_density_is_the_sum_of_kernels(spark):
    rng = np.random.default_rng(2)
    groups = {("A", 1): rng.beta(2, 5, 60), ("A", 2): rng.beta(3, 3, 40), ("B", 1): np.full(5, 0.25), ("B", 2): np.array([0.1, 0.2])}
    rows = [(s, y, float(v)) for (s, y), values in groups.items() for v in values] + [("A", 1, None)]
    df = spark.createDataFrame(rows, "s string, y int, v double")
    points = 2001
    found = {}
    for r in turnover.kernel_density(df, "v", ["s"], ["y"], 0.0, 1.0, points).collect():
        found.setdefault((r.s, r.y), {})[round(r.x, 6)] = r.density
    assert set(found) == {("A", 1), ("A", 2), ("B", 1)}

    def rule(x):
        spread = min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) or x.std(ddof=1) or abs(x[0]) or 1
        return 0.9 * spread * len(x) ** -0.2

    width = {"A": (rule(groups["A", 1]) + rule(groups["A", 2])) / 2, "B": rule(groups["B", 1])}
    for (s, y), values in found.items():
        h, x = width[s], groups[s, y]
        for at in (0.0, 0.25, 0.5, 1.0):
            direct = np.exp(-(((at - x) / h) ** 2) / 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
            # Weights between grid points move the density by the square of the step.
            assert abs(values[at] - direct) < 2e-4 * max(1, direct)


def test_limits_of_curve_and_median(spark):
    lengths = [(t, s) for t, s in zip([1, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10], [1, 0, 1, 1, 0, 1, 1, 0, 1, 1, 0, 1], strict=True)]
    df = spark.createDataFrame([("g", t, s) for t, s in lengths] + [("h", 5, 0)], "g string, length int, status int")
    curve = survival.kaplan_meier(df, ["g"])
    rows = {(r.g, r.time): r for r in survival.confidence_limits(curve).collect()}
    alive, variance, at_risk, half = 1.0, 0.0, len(lengths), {}
    for t in sorted({t for t, _ in lengths}):
        events = sum(s for u, s in lengths if u == t)
        alive *= 1 - events / at_risk
        if at_risk > events:
            variance += events / (at_risk * (at_risk - events))
        row = rows["g", t]
        if alive > 0:
            low, high = alive * math.exp(-1.959963984540054 * variance**0.5), min(1, alive * math.exp(1.959963984540054 * variance**0.5))
            assert math.isclose(row.lower, low) and math.isclose(row.upper, high)
            for name, value in (("median", alive), ("lower", low), ("upper", high)):
                if value <= 0.5:
                    half.setdefault(name, float(t))
        else:
            assert row.lower is None and row.upper is None
            half.setdefault("median", float(t))
        at_risk -= sum(u == t for u, _ in lengths)
    found = {r.g: (r.median, r.lower, r.upper) for r in survival.median_limits(curve, ["g"]).collect()}
    assert found == {"g": (half.get("median"), half.get("lower"), half.get("upper")), "h": (None, None, None)}
