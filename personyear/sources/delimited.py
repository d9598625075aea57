"""Delimited extracts: typed scans, folder unions, file-name years, leading lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import fiscal_file_year, leading_file_year, parse_money, to_number
from ..session import measured

FILE = "_metadata.file_path"
START = "_metadata.file_block_start"

TYPE_LETTERS = {
    "c": T.StringType(),
    "d": T.DoubleType(),
    "i": T.IntegerType(),
    "l": T.BooleanType(),
}


def compact_schema(names: list[str], letters: str) -> T.StructType:
    """``compact_schema(["year", "state"], "dc")``: one type letter per column."""
    if len(names) != len(letters):
        raise ValueError("one type letter per column is needed")
    return T.StructType(
        [T.StructField(name, TYPE_LETTERS[letter]) for name, letter in zip(names, letters)]
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    na: str | None = None,
    pattern: str | None = None,
    recursive: bool = False,
    encoding: str = "UTF-8",
    infer: bool = False,
) -> DataFrame:
    """Scan files that share one header; without a schema every column is text."""
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("recursiveFileLookup", recursive)
        .option("inferSchema", infer)
        .option("enforceSchema", False if schema is None else True)
    )
    if na is not None:
        reader = reader.option("nullValue", na)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file; only its first line is read."""
    return spark.read.option("header", True).csv(path).columns


def read_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Keep the wanted columns that exist, typed as ``text``, ``number`` or ``money``.

    Columns that a source lacks stay absent; a later union by name fills them.
    """
    convert = {
        "text": lambda name: F.col(name).cast("string"),
        "number": lambda name: to_number(F.col(name).cast("string")),
        "money": parse_money,
    }
    return df.select(
        *[convert[kind](name).alias(name) for name, kind in wanted.items() if name in df.columns]
    )


def first_lines(
    spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, encoding: str = "UTF-8",
    without: str | None = None,
) -> DataFrame:
    """``file, line``: the first line of every file below ``path``, found by one job.

    ``without`` leaves out files whose path fits this regular expression.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("encoding", encoding)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select(
        F.col(FILE).alias("file"), F.col(START).alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    if without is not None:
        lines = lines.where(~F.col("file").rlike(without))
    found = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    return found


def read_csv_folder(
    spark: SparkSession,
    path: str,
    pattern: str = "*.csv",
    recursive: bool = False,
    label: str | None = None,
    without: str | None = None,
    **options,
) -> DataFrame:
    """All files of a folder as one frame, although their headers differ.

    Files are grouped by header so that there is one scan per vintage, then
    united by name with NULL for columns a vintage lacks.  One job reads all
    headers; the driver holds the names of the files, as any scan of them does.
    ``without`` leaves out files whose path fits this regular expression.
    """
    lines = first_lines(spark, path, pattern, recursive, options.get("encoding", "UTF-8"), without)
    vintages = lines.groupBy("line").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    if not vintages:
        raise FileNotFoundError(f"no file matches {pattern} in {path}")
    frames = []
    for names in sorted(row.files for row in vintages):
        frame = read_csv(spark, names, **options)
        frames.append(frame if label is None else frame.withColumn(label, F.col(FILE)))
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def path_piece(path: Column, folder: bool = False) -> Column:
    """Name of a file, or of the folder it lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$" if folder else r"([^/]+)$", 1)


def path_key(path: Column, key: str) -> Column:
    """The value of a ``key=value`` folder in a path."""
    return F.nullif(F.regexp_extract(path, rf"/{key}=([^/]+)/", 1), F.lit(""))


def with_file_year(df: DataFrame, rule: str = "leading", name: str = "year", folder: bool = False) -> DataFrame:
    """Derive the spring year of every row from the name of its file or folder."""
    rules = {"fiscal": fiscal_file_year, "leading": leading_file_year}
    return df.withColumn(name, rules[rule](path_piece(F.col(FILE), folder)))


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of a file scan in file-name order, from 0.

    A split knows only its own rows.  Counting rows per split and adding up the
    counts of earlier splits gives the position without moving any row through
    one task; only one count per split meets in the final running sum.
    """
    tagged = df.select(
        "*",
        F.col(FILE).alias("__file"),
        F.col(START).alias("__start"),
        F.monotonically_increasing_id().alias("__position"),
    )
    splits = tagged.groupBy("__file", "__start").agg(
        F.min("__position").alias("__first"), F.count("*").alias("__rows")
    )
    earlier = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "__file",
        "__start",
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    return (
        tagged.join(offsets, ["__file", "__start"])
        .withColumn(name, F.col("__position") + F.col("__shift"))
        .drop("__file", "__start", "__position", "__shift")
    )


def read_csv_below(
    spark: SparkSession, path: str | list[str], skip: int, na: str | None = None
) -> DataFrame:
    """Text columns of CSV files whose header follows ``skip`` title lines.

    All files must have the same header.  Spark cannot skip lines, so lines are read as text, numbered within the
    first split of their file, and parsed once title and header are dropped.
    A trailing delimiter gives a nameless last column, which is dropped.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col(FILE).alias("__file"),
        F.col(START).alias("__start"),
        F.monotonically_increasing_id().alias("__position"),
    )
    starts = (
        lines.where(F.col("__start") == 0)
        .groupBy("__file")
        .agg(F.min("__position").alias("__first"))
    )
    # One row per file with its size on file, so that lines need not move to meet it.
    numbered = lines.join(measured(starts, "starts"), "__file").withColumn(
        "__line", F.when(F.col("__start") == 0, F.col("__position") - F.col("__first"))
    )
    headers = numbered.where(F.col("__line") == skip).select("value").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"the files must share one header line, found {[row.value for row in headers]}")
    header = headers[0].value
    names = [name.strip().strip('"') or f"__blank{i}" for i, name in enumerate(header.split(","))]
    ddl = ", ".join(f"`{name}` STRING" for name in names)
    options = {"nullValue": na} if na is not None else {}
    body = numbered.where(F.col("__line").isNull() | (F.col("__line") > skip))
    parsed = body.select(F.from_csv("value", ddl, options).alias("record"))
    return parsed.select(
        *[F.col("record").getField(name).alias(name) for name in names if not name.startswith("__blank")]
    )
