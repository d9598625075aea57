"""Joins to reference tables in which NULL keys match NULL keys.

Small reference tables are broadcast by Spark itself, which compares their true
size with ``spark.sql.autoBroadcastJoinThreshold``; nothing here forces one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured

# Text of the patterns that are sent to every task at once.
PATTERN_BYTES = 1 << 20
# Characters that make a pattern more than a literal.
SPECIAL = r"[\\.\[\]{}()*+?^$|]"


def _pairs(keys: list[str] | dict[str, str]) -> dict[str, str]:
    return keys if isinstance(keys, dict) else {key: key for key in keys}


def _renamed(dim: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Move the key columns of the reference table out of the way."""
    moved = {right: f"__key_{right}" for right in keys.values()}
    return dim.withColumnsRenamed(moved), {left: moved[right] for left, right in keys.items()}


def same_keys(keys: dict[str, str]) -> Column:
    """All pairs equal, NULL equal to NULL; still an equi join for Spark."""
    return reduce(
        lambda a, b: a & b,
        [F.col(left).eqNullSafe(F.col(right)) for left, right in keys.items()],
    )


def attach(
    df: DataFrame,
    dim: DataFrame,
    keys: list[str] | dict[str, str],
    how: str = "left",
    keep_keys: bool = False,
) -> DataFrame:
    """Join a reference table on explicit keys.

    ``keys`` lists common names, or maps a name of ``df`` to one of ``dim``.
    With ``keep_keys`` the key columns of the reference survive as well.
    """
    named = _pairs(keys)
    side, moved = _renamed(dim, named)
    joined = df.join(side, same_keys(moved), how)
    if keep_keys:
        for right in named.values():
            name = right if right not in df.columns else f"{right}_right"
            joined = joined.withColumnRenamed(f"__key_{right}", name)
        return joined
    return joined.drop(*moved.values())


def common_columns(df: DataFrame, dim: DataFrame) -> list[str]:
    return [name for name in df.columns if name in dim.columns]


def attach_common(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join on every common column."""
    keys = common_columns(df, dim)
    if not keys:
        raise ValueError("the two frames have no common column")
    return attach(df, dim, keys)


def unique_rows(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once.

    Every other column is carried through the aggregate as the minimum, which
    is the value itself for a group of one; no group is gathered in a window.
    """
    packed = F.struct(*[F.col(name) for name in dim.columns if name not in keys] or [F.lit(1)])
    counted = dim.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(packed).alias("__row"))
    others = [f"__row.{name}" for name in dim.columns if name not in keys]
    return counted.where("__n = 1").select(*keys, *others)


def attach_unique(df: DataFrame, dim: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    """Join only where the key is unique in the reference, so no row multiplies."""
    return attach(df, unique_rows(dim, list(_pairs(keys).values())), keys)


def repeated_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    return dim.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def attach_checked(df: DataFrame, dim: DataFrame, keys: list[str] | dict[str, str]) -> DataFrame:
    """Join after proving on the reference alone that the row count cannot grow."""
    repeated = repeated_keys(dim, list(_pairs(keys).values())).take(1)
    if repeated:
        raise ValueError(f"reference key is not unique: {repeated[0].asDict()}")
    return attach(df, dim, keys)


def attach_first_match(
    df: DataFrame,
    passes: list[tuple[DataFrame, list[str] | dict[str, str]]],
    values: list[str],
    source: str | None = None,
    per_column: bool = False,
) -> DataFrame:
    """Try reference tables in order; the first that knows the row gives the values.

    Every pass is a left join; a later one only fills rows that are still open, or,
    with ``per_column``, every value that is still NULL.  ``source`` names a column
    for the number of the first pass that matched.
    """
    result = df
    for number, (dim, keys) in enumerate(passes):
        named = _pairs(keys)
        side = dim.select(
            *[F.col(right).alias(f"__key{number}_{right}") for right in named.values()],
            *[F.col(name).alias(f"__pass{number}_{name}") for name in values],
            F.lit(number + 1).alias(f"__pass{number}"),
        )
        on = {left: f"__key{number}_{right}" for left, right in named.items()}
        result = result.join(side, same_keys(on), "left").drop(*on.values())
    numbers = range(len(passes))
    chosen = {}
    for name in values:
        expression = F.coalesce(*[F.col(f"__pass{number}_{name}") for number in numbers]) if per_column else F.lit(None)
        for number in [] if per_column else reversed(numbers):
            expression = F.when(
                F.col(f"__pass{number}").isNotNull(), F.col(f"__pass{number}_{name}")
            ).otherwise(expression)
        chosen[name] = expression
    if source:
        chosen[source] = F.coalesce(*[F.col(f"__pass{number}") for number in numbers])
    return result.select("*", *[expression.alias(name) for name, expression in chosen.items()]).drop(
        *[f"__pass{number}" for number in numbers],
        *[f"__pass{number}_{name}" for number in numbers for name in values],
    )


def _texts(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(f"{name} is not null").distinct()


def substring_matches(labels: DataFrame, label: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Distinct (label, pattern) pairs where the pattern, taken as it stands, is inside the label.

    Each distinct label is cut into its substrings of the lengths that occur among
    the patterns, and these meet the patterns in an equi join.  An empty pattern is
    inside nothing.
    """
    values = _texts(labels, label, "label")
    literal = _texts(patterns, pattern, "pattern").where(F.length("pattern") > 0)
    # At most one number per text length, whatever the size of the tables.
    sizes = [row.size for row in literal.select(F.length("pattern").alias("size")).distinct().collect()]
    cut = (
        values.select("label", F.explode(F.array(*map(F.lit, sizes or [1]))).alias("size"))
        .where(F.col("size") <= F.length("label"))
        .select(
            "label",
            "size",
            F.explode(F.sequence(F.lit(1), F.length("label") - F.col("size") + 1)).alias("at"),
        )
        .select("label", F.expr("substring(label, at, size)").alias("pattern"))
        .distinct()
    )
    return cut.join(literal, "pattern").select("label", "pattern")


def pattern_matches(labels: DataFrame, label: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Distinct (label, pattern) pairs where the pattern is found inside the label.

    Patterns without special characters are literals (``substring_matches``).  True
    regular expressions must be compared with every distinct label; they are sent
    to the tasks in blocks of bounded text, so labels stay where they are whatever
    the number of patterns.  The empty expression fits every label.
    """
    rules = _texts(patterns, pattern, "pattern")
    plain = ~F.col("pattern").rlike(SPECIAL) & (F.length("pattern") > 0)
    found = substring_matches(labels, label, rules.where(plain), "pattern")
    values = _texts(labels, label, "label")
    fits = F.rlike("label", F.col("pattern"))
    for block in _pattern_blocks(rules.where(~plain)):
        sent = labels.sparkSession.createDataFrame([(text,) for text in block], "pattern string")
        found = found.unionByName(values.join(F.broadcast(sent), fits).select("label", "pattern"))
    return found


def _pattern_blocks(patterns: DataFrame) -> Iterator[list[str]]:
    """Patterns in blocks of bounded text (or one longer pattern); the driver holds one at a time."""
    block, held = [], 0
    for (text,) in patterns.select("pattern").toLocalIterator():
        if block and held + len(text) > PATTERN_BYTES:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield block


def attach_by_pattern(
    df: DataFrame, label: str, patterns: DataFrame, pattern: str
) -> DataFrame:
    """Left join on "the right column, a pattern, is found in the left column"."""
    matches = pattern_matches(df, label, patterns, pattern).withColumnsRenamed(
        {"label": "__label", "pattern": "__pattern"}
    )
    known = matches.join(patterns, F.col("__pattern") == F.col(pattern))
    return df.join(known, F.col(label) == F.col("__label"), "left").drop("__label", "__pattern")


def stitch(frames: list[DataFrame], ordinal: str = "ordinal") -> DataFrame:
    """Put numbered frames side by side, row i next to row i.

    All frames must hold the same number of rows.
    """
    counts = [frame.count() for frame in frames]
    if len(set(counts)) != 1:
        raise ValueError(f"row counts differ: {counts}")
    return reduce(lambda a, b: a.join(b, ordinal), frames)


def correct(df: DataFrame, delete: DataFrame, insert: DataFrame) -> DataFrame:
    """Remove the listed records, then add the inserted ones."""
    keys = common_columns(df, delete)
    side, moved = _renamed(delete.select(*keys), {key: key for key in keys})
    kept = df.join(side, same_keys(moved), "left_anti")
    return kept.unionByName(insert, allowMissingColumns=True)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; reference-sized tables only."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")


def classify_labels(df: DataFrame, label: str, flag: Column, name: str) -> DataFrame:
    """Evaluate a costly classifier once per distinct label and attach the result."""
    dictionary = df.select(label).distinct().withColumn(name, flag)
    return attach(df, measured(dictionary, "labels"), [label])
