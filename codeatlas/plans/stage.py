"""Tables in the shared folder: cutting lineage in loops, and rows that meet few ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many ids are compared as literals, which prune row groups of tables sorted by them; more meet by a join.
FEW_IDS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, a temporary one where none is configured."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="codeatlas-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, without lineage, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/codeatlas/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meeting(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`rows` whose `column` is among `ids` (a DataFrame of one column): by literals if they are few, else by a semi-join."""
    few = [r[0] for r in ids.limit(FEW_IDS + 1).collect()]
    if len(few) <= FEW_IDS:
        return rows.where(F.col(column).isin(few)) if few else rows.where("false")
    return rows.join(ids.toDF(column), column, "left_semi")
