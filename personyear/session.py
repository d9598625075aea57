"""Session set-up and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "personyear", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.extraJavaOptions", "-XX:ReservedCodeCacheSize=512m")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder: on a cluster a machine-local
    folder would vanish with its machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    named = named or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="personyear-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan.

    This cuts the lineage in loops, survives the loss of executors, and gives
    the optimizer true sizes for the steps that follow.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def _located(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    files, mark = _located(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing unwritten reads any more."""
    files, folder = _located(spark, path)
    files.delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`written` returned, once nothing unwritten reads it."""
    path = getattr(table, "_written_path", None)
    if path is not None:
        remove(table.sparkSession, path)


def measured(df: DataFrame, label: str) -> DataFrame:
    """Write a table that was folded from records, so that its true size is known.

    Spark estimates an aggregate by the size of its input and would shuffle the
    records to join it.  With the size on file it broadcasts the table exactly
    when that is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return written(df, label)
