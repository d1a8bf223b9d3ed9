"""Session, table and shared-folder helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the text contracts: space and 0x09 to 0x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A broadcast side may have this many rows at most; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, a temporary one where none is configured."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="codeatlas-")
        sc.setCheckpointDir(configured)
        configured = sc.getCheckpointDir()
    return configured


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives a lost executor."""
    path = f"{shared_dir(spark)}/codeatlas/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, df: DataFrame, name: str = "rows", column: str = "uid") -> DataFrame:
    """`df` with a number that tells repeated rows apart; written, so that every reader sees the same numbers."""
    return written(spark, df.withColumn(column, F.monotonically_increasing_id()), name)


def fresh(columns: list[str], wanted: str) -> str:
    """`wanted`, with underscores behind it as long as a column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        files = df.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most `rows` rows within, so that long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; counts no more than needed."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_white_space(c: Column) -> Column:
    for ch in WHITE_SPACE:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c
