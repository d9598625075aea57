"""One-to-one exact matching of the records of two periods.

Two frames are matched on a list of columns, NULL equal to NULL, and a key is
accepted when exactly one record on either side has it.  All functions work on
many states at once: the ``within`` columns are part of every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written

# The matching rules in the order in which they are tried.
RULES = [
    ["name_first", "name_middle", "name_other", "name_last", "position", "NCES_leaid"],
    ["name_first", "name_last", "position", "NCES_leaid"],
    ["name_first", "name_last", "position"],
    ["name_first", "name_last", "teacher"],
    ["name_first", "name_last", "NCES_leaid"],
    ["name_first", "name_last"],
    ["name_first", "round_salary", "position", "NCES_leaid"],
]

WITHIN = ["state"]
LINK = ["index1", "index2", "id", "rule"]


def rule_columns(rules: list[list[str]]) -> list[str]:
    return list(dict.fromkeys(name for rule in rules for name in rule))


def _sides(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Both periods in one frame: records and their number on either side; ``id`` is the id a left record already has."""
    known = F.col("id") if "id" in left.columns else F.lit(None).cast("long").alias("id")
    none = lambda name: F.lit(None).cast("long").alias(name)
    count = lambda n1, n2: (F.lit(n1).cast("long").alias("n1"), F.lit(n2).cast("long").alias("n2"))
    one = left.select(*names, "index", *count(1, 0), F.col("index").alias("index1"), known, none("index2"))
    two = right.select(*names, "index", *count(0, 1), none("index1"), none("id"), F.col("index").alias("index2"))
    return one.unionByName(two)


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(name).alias(name) for name in ("n1", "n2")]
    return rows.groupBy(*keys).agg(*sums, *[F.max(name).alias(name) for name in ("index1", "id", "index2")])


def _folded(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per combination of ``names``, with the index of one of its records.

    A link takes all records of its group, one on either side, so a combination is
    linked as a whole or, where it has several records of a side, not at all.  This asks for
    an index of its own for every record: else a linked record would take others with it.
    """
    return _counted(rows, names).withColumn("index", F.coalesce("index1", "index2"))


def _single_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of records alone with their key on both sides.

    A join followed by a group count would build n1 * n2 rows for a common
    name.  Counting both sides in one aggregate gives the same pairs, combines
    before the shuffle, and treats NULL keys as equal.  Numbers alone are carried,
    so that the aggregate is a hash aggregate; a group that survives has one record
    on either side, whose number and id are the maxima.
    """
    single = _counted(rows, keys).where("n1 = 1 and n2 = 1")
    return single.select("index1", "index2", F.coalesce("id", "index1").alias("id"))


def match_rule(left: DataFrame, right: DataFrame, keys: list[str], within: list[str] = WITHIN) -> DataFrame:
    """(index1, index2) of the one-to-one matches on ``keys``."""
    names = [*within, *keys]
    return _single_pairs(_sides(left, right, names), names).select("index1", "index2")


def cascade(
    left: DataFrame,
    right: DataFrame,
    rules: list[list[str]] = RULES,
    within: list[str] = WITHIN,
    numbered: bool = False,
) -> DataFrame:
    """Links found by trying the rules in order on the records still open.

    The id of a link is the id of its left record, or that record's index if
    it has none yet.  With ``numbered`` (no two records have the same index, and none
    is missing) all rules run over the distinct combinations of their columns.  Links and open records are written after the first rule,
    which takes most records, and after every third rule from then on, so that
    plans stay short and each stretch starts from the records still open.
    """
    names = [*within, *rule_columns(rules)]
    rows = _sides(left, right, names)
    if numbered:
        rows = written(_folded(rows, names), "open")
    found, stretch, start = [], [], rows
    for number, rule in enumerate(rules, start=1):
        links = _single_pairs(rows, [*within, *rule]).withColumn("rule", F.lit(str(number)))
        stretch.append(links.select(*LINK))
        last = number == len(rules)
        if number % 3 == 1 or last:
            found.append(written(reduce(lambda a, b: a.unionByName(b), stretch), "links"))
            stretch = []
            before = start
            if not last:
                rows = start = written(without_linked(start, found[-1]), "open")
            discard(before)  # its links and its open records are written
        else:
            rows = without_linked(rows, links)
    return reduce(lambda a, b: a.unionByName(b), found)


def numbered_once(rows: DataFrame) -> bool:
    """Whether every record has an index of its own."""
    repeated = rows.groupBy("index").agg(F.count("*").alias("n")).where("n > 1 or index is null")
    return not repeated.take(1)


def linked_indexes(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("index1", "index2")).alias("index"))


def without_linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Records of either side that no link uses."""
    return rows.join(linked_indexes(links), "index", "left_anti")


def candidates(rows: DataFrame, period: int, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Left: records of ``period`` and never linked earlier ones.  Right: the next period."""
    earlier = (F.col(year) < period) & F.col("id").isNull()
    return rows.where((F.col(year) == period) | earlier), rows.where(F.col(year) == period + 1)


def propagate(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Give both records of every link its id; the earliest id of a record stays."""
    ids = links.select(
        F.explode(F.array("index1", "index2")).alias("__index"), F.col("id").alias("__id")
    )
    return (
        rows.join(ids, F.col("index") == F.col("__index"), "left")
        .withColumn("id", F.coalesce("id", "__id"))
        .drop("__index", "__id")
    )
