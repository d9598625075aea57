"""Probabilistic matching with partial agreement (Fellegi-Sunter model).

Nothing here compares records pair by pair.  Similar *values* of each field are
found once; records are reduced to distinct value combinations with counts; and
the number of record pairs per agreement pattern follows from joins on similar
values by inclusion and exclusion.  The mixture is fitted on the pattern counts
of each state, and one-to-one matches are read off the same counts, carrying
sums of record numbers: where the count is one, the sum is the partner.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import PREFIX_LENGTH, PREFIX_WEIGHT, jaro_winkler
from ..session import written
from .matching import LINK, WITHIN, without_linked

# Characters whose frequency among the values is measured; all others count as rarer.
MEASURED_CHARACTERS = 512
# A further occurrence of a character is as rare as one so many places down the list.
OCCURRENCE_STEP = 6
# Records of a value that meet its similar values in one place, unless this share of all records is more.
CELL_ROWS, CELL_SHARE = 1 << 14, 0.001


@dataclass(frozen=True)
class Field:
    """A compared column.

    Text agrees fully from similarity ``full`` on and partially from ``part``
    on; numbers by absolute difference of at most ``full`` or ``part``.  Without
    ``partial`` there is full agreement or none.
    """

    name: str
    partial: bool = True
    full: float = 0.94
    part: float = 0.88
    number: bool = False


def number_field(name: str, partial: bool = False, full: float = 1.0, part: float = 2.5) -> Field:
    return Field(name, partial, full, part, number=True)


# Fields and cut-offs of the two probabilistic matchers.
BACKSTOP_FIELDS = [
    Field("name_first", full=0.92, part=0.88),
    Field("name_last", full=0.92, part=0.88),
]
BACKSTOP_THRESHOLD = 0.80
STANDALONE_FIELDS = [
    Field("name_first"),
    Field("name_last"),
    Field("position"),
    number_field("salary"),
]
STANDALONE_THRESHOLD = 0.85


# ---------------------------------------------------------------- similar values


def _overlap_factors(cut: float) -> list[float]:
    """Per shared prefix length: m common characters of lengths a, b need m >= f*a*b/(a+b).

    Similarity ``cut`` with a prefix of l equal characters needs a plain Jaro
    value of (cut - .1 l) / (1 - .1 l), and Jaro is at most (m/a + m/b + 1) / 3.
    """
    factors = []
    for prefix in range(PREFIX_LENGTH + 1):
        jaro = (cut - PREFIX_WEIGHT * prefix) / (1 - PREFIX_WEIGHT * prefix)
        factors.append(3 * jaro - 1)
    if min(factors) <= 1:
        raise ValueError("the similarity cut-off is too low for an exact candidate search")
    return factors


def _by_frequency(values: DataFrame) -> str:
    """The characters of distinct values, those in most values first; a bounded list."""
    chars = values.select(F.explode(F.array_distinct(F.split("v", ""))).alias("c")).where("c <> ''")
    counted = chars.groupBy("c").agg(F.count("*").alias("n"))
    return "".join(row.c for row in counted.orderBy(F.desc("n"), "c").limit(MEASURED_CHARACTERS).collect())


def _character_tokens(value: Column, frequent: str) -> Column:
    """Characters with their occurrence number, rare ones first.

    ``frequent`` lists characters from frequent to rare as measured on the values,
    so that the blanks of titles count as what they are.
    """
    chars = F.filter(F.split(value, ""), lambda char: char != "")
    last = 10 * MEASURED_CHARACTERS

    def token(char: Column, i: Column) -> Column:
        times = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda c: c == char))
        place = F.instr(F.lit(frequent), char)
        rarity = F.when(place == 0, last).otherwise(place + OCCURRENCE_STEP * (times - 1))
        return F.struct((-rarity).alias("r"), F.concat(char, times.cast("string")).alias("t"))

    return F.transform(F.array_sort(F.transform(chars, token)), lambda pair: pair["t"])


def _signatures(tokens: Column, needed: Column) -> Column:
    """Keys on which texts meet that share at least ``needed`` tokens.

    The first two shared tokens of a text with n tokens are among its first
    n - needed + 2, the only one among all; without a need every text meets.
    """
    reach = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - needed + 2, F.lit(0)))
    twos = F.flatten(
        F.transform(
            reach,
            lambda one, i: F.transform(
                F.slice(reach, i + 2, F.size(reach)),
                lambda two: F.struct(one.alias("t1"), two.alias("t2")),
            ),
        )
    )
    ones = F.transform(tokens, lambda one: F.struct(one.alias("t1"), F.lit("").alias("t2")))
    none = F.array(F.struct(F.lit("").alias("t1"), F.lit("").alias("t2")))
    return F.when(needed >= 2, twos).when(needed == 1, ones).otherwise(none)


def similar_texts(values: DataFrame, cut: float) -> DataFrame:
    """Pairs (v, w, similarity) of different texts at least ``cut`` alike, both ways round.

    The search is exact.  For each possible length of the common beginning,
    texts meet on that beginning, their two lengths, and the two rarest
    characters shared by what follows.  The bound on shared characters is
    checked in the join, and a pair is emitted for its first two alone.
    """
    pairs = (
        candidate_texts(values, cut)
        .select("v1", "v2", jaro_winkler("v1", "v2").alias("similarity"))
        .where(F.col("similarity") >= cut)
    )
    both = F.explode(
        F.array(
            F.struct(F.col("v1").alias("v"), F.col("v2").alias("w")),
            F.struct(F.col("v2").alias("v"), F.col("v1").alias("w")),
        )
    )
    return pairs.select(both.alias("pair"), "similarity").select("pair.v", "pair.w", "similarity")


def candidate_texts(values: DataFrame, cut: float) -> DataFrame:
    """Pairs (v1, v2) that share enough characters to be ``cut`` alike; each pair once."""
    factors = F.array(*[F.lit(value) for value in _overlap_factors(cut)])
    level = F.col("prefix")
    factor = F.element_at(factors, level + 1)
    values = values.toDF("v").where("v is not null and v <> ''").distinct()
    frequent = _by_frequency(values)
    base = (
        values
        .withColumn("length", F.length("v"))
        .withColumn("prefix", F.explode(F.sequence(F.lit(0), F.least(F.lit(PREFIX_LENGTH), F.col("length")))))
        .withColumn("head", F.expr("substring(v, 1, prefix)"))
        .withColumn("tokens", _character_tokens(F.expr("substring(v, prefix + 1)"), frequent))
    )
    # The shorter (or equal) text is the left one; its partner is at most
    # length / (factor - 1) long, and the other way round.
    longest = F.floor(F.col("length") / (factor - 1) + 1e-9).cast("int")
    shortest = F.greatest(F.ceil(F.col("length") * (factor - 1) - 1e-9).cast("int"), F.lit(1))
    own, other = F.col("length"), F.col("other")

    def role(lengths: Column, a: Column, b: Column, suffix: str) -> DataFrame:
        total = F.ceil(factor * a * b / (a + b) - 1e-9).cast("int")
        return (
            base.withColumn("other", F.explode(lengths))
            .withColumn("needed", total - level)
            .select(
                "prefix", "head", "needed", a.alias("a"), b.alias("b"),
                F.col("v").alias(f"v{suffix}"), F.col("tokens").alias(f"tokens{suffix}"),
                F.explode(_signatures(F.col("tokens"), F.col("needed"))).alias("key"),
            )
            .select("*", "key.t1", "key.t2")
            .drop("key")
        )

    left = role(F.sequence(own, longest), own, other, "1").drop("needed")
    right = role(F.sequence(F.least(shortest, own), own), other, own, "2")
    shared = F.array_intersect("tokens1", "tokens2")
    next_head = lambda name: F.expr(f"substring({name}, 1, prefix + 1)")
    first = (F.col("t1") == "") | (F.get(shared, F.lit(0)) == F.col("t1"))
    second = (F.col("t2") == "") | (F.get(shared, F.lit(1)) == F.col("t2"))
    return (
        left.join(right, ["prefix", "head", "a", "b", "t1", "t2"])
        .where((F.col("a") < F.col("b")) | (F.col("v1") < F.col("v2")))
        .where((level == PREFIX_LENGTH) | (next_head("v1") != next_head("v2")))
        .where((F.size(shared) >= F.col("needed")) & first & second)
        .select("v1", "v2")
    )


def similar_numbers(values: DataFrame, reach: float) -> DataFrame:
    """Pairs (v, w) of numbers at most ``reach`` apart, by meeting in neighbouring bins."""
    numbers = values.toDF("v").where("v is not null").distinct().withColumn("bin", F.floor(F.col("v") / reach))
    near = numbers.select(
        F.col("v").alias("w"),
        F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"),
    )
    return numbers.join(near, "bin").where(F.abs(F.col("v") - F.col("w")) <= reach).select("v", "w")


def agreeing_values(values: DataFrame, field: Field) -> DataFrame:
    """(v, w, level): level 2 for full and 1 for partial agreement; others are absent."""
    if field.number:
        gap = F.abs(F.col("v") - F.col("w"))
        near = similar_numbers(values, max(field.full, field.part) if field.partial else field.full)
        return near.withColumn("level", F.when(gap <= field.full, 2).otherwise(1))
    close = similar_texts(values, field.part if field.partial else field.full)
    graded = close.select("v", "w", F.when(F.col("similarity") >= field.full, 2).otherwise(1).alias("level"))
    same = values.toDF("v").where("v is not null").distinct().select("v", F.col("v").alias("w"), F.lit(2).alias("level"))
    return graded.unionByName(same)


class Agreements(dict):
    """Agreeing values by field name; ``cells`` has, by field, the values of very many records and into how many parts these are dealt.

    ``spread`` has agreeing values per value, and the number of values less than zero: in this order a field
    comes first that makes few rows and, among such fields, tells most records apart.
    """

    def __init__(self) -> None:
        super().__init__()
        self.cells: dict[str, DataFrame] = {}
        self.spread: dict[str, tuple[float, int]] = {}


def field_agreements(panel: DataFrame, fields: list[Field]) -> Agreements:
    """Agreeing values of every field over a whole panel, found once for all years."""
    found, spark = Agreements(), panel.sparkSession
    cell = max(CELL_ROWS, math.ceil(CELL_SHARE * panel.count()))
    for field in fields:
        found[field.name] = written(agreeing_values(panel.select(field.name), field), f"agree-{field.name}")
        pairs, values = found[field.name].agg(F.count("*"), F.count_distinct("v")).first()
        found.spread[field.name] = (pairs / max(values, 1), -values)
        counted = panel.where(F.col(field.name).isNotNull()).groupBy(F.col(field.name).alias("v")).agg(F.count("*").alias("n"))
        heavy = counted.where(F.col("n") > cell).select("v", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
        # Fewer values than 1 / CELL_SHARE, as each has more than that share of the records.
        rows = heavy.collect()
        if rows:
            found.cells[field.name] = spark.createDataFrame(rows, heavy.schema)
    return found


def meet_similar(ours: DataFrame, similar: DataFrame, name: str, cells: DataFrame | None) -> DataFrame:
    """Join on ``name``, with the rows of a value in ``cells`` dealt over as many places, each with a copy of its similar values."""
    if cells is None:
        return ours.join(similar, name)
    cells = F.broadcast(cells.toDF(name, "__cells"))
    parts = F.coalesce("__cells", F.lit(1))
    dealt = ours.join(cells, name, "left").select(*ours.columns, F.pmod(F.xxhash64(*ours.columns), parts).alias("__cell"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))
    copied = similar.join(cells, name, "left").select(*similar.columns, every.alias("__cell"))
    return dealt.join(copied, [name, "__cell"]).drop("__cell")


# ---------------------------------------------------------------- pattern counts


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [part for size in range(len(names) + 1) for part in combinations(names, size)]


def _mask(names: list[str]) -> Column:
    """Bit i is set where field i is NULL."""
    bits = [F.when(F.col(name).isNull(), 1 << i).otherwise(0) for i, name in enumerate(names)]
    return reduce(lambda a, b: a + b, bits)


def _present(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in names], F.lit(True))


def _both(within: list[str], names: tuple[str, ...]) -> list[str]:
    return [*within, *names]


class PairCounts:
    """Counts of record pairs that agree on sets of fields, for one pair of periods."""

    def __init__(
        self,
        left: DataFrame,
        right: DataFrame,
        fields: list[Field],
        agreements: dict[str, DataFrame],
        within: list[str] = WITHIN,
    ):
        self.names = [field.name for field in fields]
        self.within = within
        self.agreements = agreements
        self.cells = getattr(agreements, "cells", {})
        self.spread = getattr(agreements, "spread", {})
        known = F.col("id") if "id" in left.columns else F.lit(None).cast("long")
        keys = [*within, *self.names]
        self.left = written(
            left.groupBy(*keys)
            # Numbers alone are carried, so that the aggregate is a hash aggregate.
            .agg(F.count("*").alias("n1"), F.max("index").alias("index"), F.max_by(known, "index").alias("id"))
            .select(*keys, "n1", F.struct("index", "id").alias("one"), _mask(self.names).alias("mask1")),
            "combinations",
        )
        self.right = written(
            right.groupBy(*keys)
            .agg(
                F.count("*").alias("n2"),
                F.sum(F.col("index").cast("decimal(20,0)")).cast("decimal(38,0)").alias("partner"),
            )
            .withColumn("mask2", _mask(self.names)),
            "combinations",
        )

    def agreeing(self, ours: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """Rows of ``ours`` with the right records that agree with them on all of ``names``.

        Values are replaced field by field by their similar values and then
        meet the right side, added up per value combination, in an equi join: a
        row is made per similar combination, never per pair of records.  Fields with
        few similar values come first, and from the second on only combinations
        known on the right go on, so few are left for those with many.
        """
        target = {name: f"__{name}" for name in names}
        present = self.right.where(_present(names)).select(
            *self.within, *[F.col(name).alias(target[name]) for name in names], "mask2", "n2", "partner"
        )
        order = sorted(names, key=lambda name: self.spread.get(name, (0.0, 0)))
        for i, name in enumerate(order):
            similar = self.agreements[name].select(
                F.col("v").alias(name), F.col("w").alias(target[name]), F.col("level").alias(f"level_{name}")
            )
            ours = meet_similar(ours, similar, name, self.cells.get(name))
            if 1 <= i < len(names) - 1:
                so_far = [*self.within, *[target[n] for n in order[: i + 1]]]
                ours = ours.join(present.select(*so_far).distinct(), so_far, "left_semi")
        side = present.groupBy(*self.within, *target.values(), "mask2").agg(
            F.sum("n2").alias("n2"), F.sum("partner").cast("decimal(38,0)").alias("partner")
        )
        return ours.join(side, [*self.within, *target.values()])

    def _agree_text(self, names: tuple[str, ...]) -> Column:
        """One character per field: the level, or ``*`` where anything goes."""
        marks = [F.col(f"level_{n}").cast("string") if n in names else F.lit("*") for n in self.names]
        return F.concat(*marks)

    def totals(self) -> DataFrame:
        """(within, agree, missing, pairs) for every set of agreeing fields."""
        parts = []
        for names in _subsets(self.names):
            keys = _both(self.within, names)
            ours = self.left.where(_present(names)).groupBy(*keys, "mask1").agg(F.sum("n1").alias("n1"))
            pairs = F.sum(F.col("n1").cast("decimal(19,0)") * F.col("n2").cast("decimal(18,0)"))
            parts.append(
                self.agreeing(ours, names)
                .groupBy(
                    *self.within,
                    self._agree_text(names).alias("agree"),
                    F.col("mask1").bitwiseOR(F.col("mask2")).alias("missing"),
                )
                .agg(pairs.cast("decimal(38,0)").alias("pairs"))
            )
        return reduce(lambda a, b: a.unionByName(b), parts)

    def per_combination(self, accepted: DataFrame) -> DataFrame:
        """Per left combination and accepted pattern: matching right records and their sum."""
        sets = {
            tuple(n for n, mark in zip(self.names, row.pattern) if mark in "12")
            for row in accepted.select("pattern").distinct().collect()
        }
        parts = []
        for names in _subsets(self.names):
            smaller = [part for part in sets if set(part) <= set(names)]
            if not smaller:
                continue
            rows = self.agreeing(self.left.where(_present(names)), names)
            missing = F.col("mask1").bitwiseOR(F.col("mask2"))
            marks = []
            for part in smaller:
                pattern = F.concat(
                    *[
                        F.col(f"level_{n}").cast("string")
                        if n in part
                        else F.when(missing.bitwiseAND(1 << i) > 0, "-").otherwise("0")
                        for i, n in enumerate(self.names)
                    ]
                )
                sign = F.lit((-1) ** (len(names) - len(part)))
                marks.append(F.struct(pattern.alias("pattern"), sign.alias("sign")))
            marked = rows.select(
                *self.within, "one", "n1", "n2", "partner", F.explode(F.array(*marks)).alias("mark")
            )
            parts.append(
                marked.select(
                    *self.within,
                    "one",
                    "n1",
                    "mark.pattern",
                    (F.col("n2") * F.col("mark.sign")).alias("n2"),
                    (F.col("partner") * F.col("mark.sign")).cast("decimal(38,0)").alias("partner"),
                )
            )
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        # Partitioned by combination once, for this count and the choice that follows.
        return (
            rows.join(accepted.select(*self.within, "pattern", "posterior"), [*self.within, "pattern"])
            .repartition("one")
            .groupBy("one", "n1", "posterior")
            .agg(F.sum("n2").alias("n2"), F.sum("partner").cast("decimal(38,0)").alias("partner"))
            .where("n2 > 0")
        )


def _exact_patterns(rows: pd.DataFrame, width: int) -> dict[str, Decimal]:
    """Pairs per exact pattern from the counts of agreeing sets (inclusion and exclusion).

    A pattern has one mark per field: 2, 1, 0, or - where a value is missing.
    """
    exact: dict[str, Decimal] = {}
    for agree, missing, pairs in zip(rows["agree"], rows["missing"], rows["pairs"]):
        fixed = [i for i in range(width) if agree[i] != "*"]
        for size in range(len(fixed) + 1):
            for kept in combinations(fixed, size):
                pattern = "".join(
                    agree[i] if i in kept else "-" if missing >> i & 1 else "0" for i in range(width)
                )
                sign = -1 if (len(fixed) - size) % 2 else 1
                exact[pattern] = exact.get(pattern, Decimal(0)) + sign * Decimal(pairs)
    return {pattern: pairs for pattern, pairs in exact.items() if pairs > 0}


def pattern_counts(counts: PairCounts) -> DataFrame:
    """(within, pattern, pairs): record pairs per agreement pattern, all pairs counted."""
    width = len(counts.names)
    within = counts.within

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        exact = _exact_patterns(rows, width)
        result = pd.DataFrame({"pattern": list(exact), "pairs": list(exact.values())})
        for name in within:
            result.insert(0, name, rows[name].iloc[0])
        return result[[*within, "pattern", "pairs"]]

    fields = ", ".join(f"`{name}` string" for name in within)
    return counts.totals().groupBy(*within).applyInPandas(
        fold, f"{fields}, pattern string, pairs decimal(38,0)"
    )


# ---------------------------------------------------------------- mixture model


# A fit has settled when a round adds less than this to the mean log-likelihood of a pair.
GAIN = 1e-10
ROUNDS = 500
# Chances stay this far from nothing, so that their logarithms exist.
LEAST_CHANCE = 1e-12


@dataclass(frozen=True)
class Fit:
    """A fitted mixture with its diagnosis."""

    posterior: np.ndarray  # match probability per pattern
    share: float  # of matches among all pairs
    rounds: int
    log_likelihood: float  # mean over pairs
    gain: float  # of the last round
    settled: bool
    freedom: int  # pattern shares that are free, less parameters; below 0 the model is not identified


def degrees_of_freedom(patterns: list[str]) -> int:
    """Free pattern shares (per set of missing fields one is fixed) less the free parameters."""
    missing = {tuple(mark == "-" for mark in pattern) for pattern in patterns}
    levels = [{mark for mark in marks if mark != "-"} for marks in zip(*patterns)]  # noqa: B905
    return len(patterns) - len(missing) - 1 - 2 * sum(max(len(seen) - 1, 0) for seen in levels)


def fit_mixture(patterns: list[str], pairs: np.ndarray, gain: float = GAIN, rounds: int = ROUNDS) -> Fit:
    """Fit the two-class mixture by accelerated expectation and maximisation.

    Fields are independent given the class; missing comparisons carry no
    information.  The input has at most 4^K rows.  A round takes two plain steps and
    extrapolates their squared change (the SQUAREM scheme of Varadhan and Roland); the
    extrapolation counts only where it is at least as likely as the two steps.  So the
    likelihood never falls, and the fit ends when a round adds less than ``gain``, or
    after ``rounds``, which ``settled`` tells.
    """
    marks = np.array([["012".find(mark) for mark in pattern] for pattern in patterns])
    fields = marks.shape[1]
    seen = (marks >= 0).astype(float)
    # One 0/1 column per field and level; a missing comparison is 0 in all three.
    shown = np.concatenate([marks == level for level in range(3)], axis=1).astype(float)
    same_field = np.tile(np.eye(fields), 3)
    possible = shown.any(axis=0)
    pairs = pairs / pairs.sum()

    def scaled(chances: np.ndarray) -> np.ndarray:
        """Chances of the levels of a field that occur, adding up to one."""
        chances = np.maximum(chances, LEAST_CHANCE) * possible
        return chances / np.maximum(chances @ same_field.T @ same_field, LEAST_CHANCE)

    def parted(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return theta[0], theta[1 : 1 + 3 * fields], theta[1 + 3 * fields :]

    def expected(theta: np.ndarray) -> tuple[np.ndarray, float]:
        """Posterior per pattern, and the mean log-likelihood."""
        share, match, other = parted(theta)
        logs = [shown @ np.log(np.maximum(chances, LEAST_CHANCE)) for chances in (match, other)]
        one, two = math.log(max(share, 1e-300)) + logs[0], math.log(max(1 - share, 1e-300)) + logs[1]
        both = np.logaddexp(one, two)
        return np.exp(one - both), float(pairs @ both)

    def step(theta: np.ndarray) -> np.ndarray:
        _, match, other = parted(theta)
        weight = pairs * expected(theta)[0]

        def chances(weight: np.ndarray, before: np.ndarray) -> np.ndarray:
            total = weight @ seen @ same_field
            return np.where(total > 0, weight @ shown / np.maximum(total, 1e-300), before)

        return np.concatenate(([weight.sum()], chances(weight, match), chances(pairs - weight, other)))

    def further(zero: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        change = one - zero
        bend = two - one - change
        size = math.sqrt(bend @ bend)
        length = max(1.0, math.sqrt(change @ change) / size) if size > 0 else 1.0
        share, match, other = parted(zero + 2 * length * change + length * length * bend)
        share = min(max(share, LEAST_CHANCE), 1 - LEAST_CHANCE)
        return np.concatenate(([share], scaled(match), scaled(other)))

    begun = [scaled(np.repeat(chances, fields)) for chances in ([0.05, 0.15, 0.80], [0.80, 0.15, 0.05])]
    theta = np.concatenate(([0.1], *begun))
    likelihood, gained, count = expected(theta)[1], math.inf, 0
    while count < rounds and gained >= gain:
        one = step(theta)
        two = step(one)
        options = [(expected(x)[1], x) for x in (two, further(theta, one, two))]
        reached, theta = options[1] if options[1][0] >= options[0][0] else options[0]
        gained, likelihood, count = reached - likelihood, reached, count + 1
    posterior, _ = expected(theta)
    share, match, other = parted(theta)
    if match[2 * fields :].sum() < other[2 * fields :].sum():
        posterior, share = 1 - posterior, 1 - share
    return Fit(posterior, float(share), count, likelihood, gained, gained < gain, degrees_of_freedom(patterns))


FIT_COLUMNS = {
    "share": "double", "rounds": "int", "log_likelihood": "double", "gain": "double", "settled": "boolean", "freedom": "int",
    "error": "string",
}


def pattern_posteriors(counts: PairCounts, fit=fit_mixture) -> DataFrame:
    """(within, pattern, pairs, posterior) and the fit's diagnosis, one model per ``within`` value.

    A value whose fit fails keeps its patterns, with the failure's text in ``error``
    and no posterior; all others are fitted as ever.
    """
    within, width = counts.within, len(counts.names)
    columns = [*within, "pattern", "pairs", "posterior", *FIT_COLUMNS]

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        exact = _exact_patterns(rows, width)
        patterns = sorted(exact)
        result = pd.DataFrame({"pattern": patterns, "pairs": [exact[pattern] for pattern in patterns]})
        for name in within:
            result[name] = rows[name].iloc[0]
        result[["posterior", *FIT_COLUMNS]] = None
        try:
            found = fit(patterns, np.array(result["pairs"].tolist(), dtype=float))
        except Exception as failure:  # noqa: BLE001 - one value's failure is a row of the log
            result["error"] = f"{type(failure).__name__}: {failure}"
        else:
            result["posterior"] = found.posterior
            for name in list(FIT_COLUMNS)[:-1]:
                result[name] = getattr(found, name)
        return result[columns]

    fields = ", ".join(f"`{name}` string" for name in within)
    more = ", ".join(f"{name} {kind}" for name, kind in FIT_COLUMNS.items())
    # A stated number of partitions, or the few rows would all meet in one task.
    tasks = counts.left.sparkSession.sparkContext.defaultParallelism
    return counts.totals().repartition(tasks, *within).groupBy(*within).applyInPandas(
        fitted, f"{fields}, pattern string, pairs decimal(38,0), posterior double, {more}"
    )


def fit_diagnosis(scored: DataFrame, within: list[str]) -> DataFrame:
    """One row per fitted model: patterns, pairs and the diagnosis columns."""
    first = [F.first(name).alias(name) for name in FIT_COLUMNS]
    return scored.groupBy(*within).agg(F.count("*").alias("patterns"), F.sum("pairs").cast("decimal(38,0)").alias("pairs"), *first)


# ---------------------------------------------------------------- links


def _single_best(options: DataFrame, key: str, score: str, values: list[str]) -> DataFrame:
    """Per key the values of the option with the highest score, if no other has that score.

    The largest and the smallest option among the highest scored are the same
    exactly when there is one; both come from one aggregate.
    """
    high = F.max(F.struct(score, *values)).alias("high")
    low = F.min(F.struct((-F.col(score)).alias(score), *values)).alias("low")
    same = [F.col(f"high.{name}").eqNullSafe(F.col(f"low.{name}")) for name in values]
    return (
        options.groupBy(key)
        .agg(high, low)
        .where(reduce(lambda a, b: a & b, same))
        .select(key, f"high.{score}", *[f"high.{name}" for name in values])
    )


def best_pairs(pairs: DataFrame, score: str = "posterior") -> DataFrame:
    """One-to-one choice from distinct (index1, index2, score).

    Each left record keeps its best right record, then each right record its
    best left one among those; a tie for the best drops the record.
    """
    chosen = _single_best(pairs, "index1", score, ["index2"])
    return _single_best(chosen, "index2", score, ["index1"]).select("index1", "index2", score)


def drop_repeated(pairs: DataFrame) -> DataFrame:
    """Remove every pair one of whose records occurs in another pair as well."""
    single = lambda side: pairs.groupBy(side).agg(F.count("*").alias("__n")).where("__n = 1").select(side)
    return pairs.join(single("index1"), "index1", "left_semi").join(single("index2"), "index2", "left_semi")


def probable_links(
    left: DataFrame,
    right: DataFrame,
    fields: list[Field],
    agreements: dict[str, DataFrame],
    threshold: float,
    within: list[str] = WITHIN,
    fit=fit_mixture,
) -> tuple[DataFrame, DataFrame]:
    """Links with their posterior, which is at least ``threshold`` (best partners only, no ties), and the fits' diagnosis.

    The choice is that of :func:`best_pairs`, made on value combinations: the
    members of a combination have the same partners and scores, so a
    combination of several records is a tie for each of its partners.
    """
    counts = PairCounts(left, right, fields, agreements, within)
    scored = written(pattern_posteriors(counts, fit), "patterns")
    accepted = scored.where(F.col("posterior") >= threshold)
    diagnosis = fit_diagnosis(scored, within)
    if not accepted.take(1):
        empty = left.sparkSession.createDataFrame([], "index1 long, index2 long, id long, rule string, posterior double")
        return empty, diagnosis
    options = counts.per_combination(accepted)
    first = _single_best(options, "one", "posterior", ["n2", "partner", "n1"]).where("n2 = 1")
    chosen = first.select(F.col("partner").cast("long").alias("index2"), "posterior", "n1", "one")
    second = _single_best(chosen, "index2", "posterior", ["n1", "one"]).where("n1 = 1")
    links = second.select(
        F.col("one.index").alias("index1"),
        "index2",
        F.coalesce("one.id", "one.index").alias("id"),
        F.lit("probable").alias("rule"),
        "posterior",
    )
    return written(links.select(*LINK, "posterior"), "links"), diagnosis


def open_records(left: DataFrame, right: DataFrame, links: DataFrame, period: int, year: str = "year"):
    """What the exact rules left over, the left side cut to the period itself."""
    return without_linked(left.where(F.col(year) == period), links), without_linked(right, links)
