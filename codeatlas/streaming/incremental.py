"""Incremental maintenance: snapshot difference, symbol-universe delta, and a stream that applies them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of (path, content_hash) snapshots: added, changed, deleted or unchanged."""
    o, n = old.select("path", F.col("content_hash").alias("o")), new.select("path", F.col("content_hash").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def changed_names(old_symbols: DataFrame, new_symbols: DataFrame) -> DataFrame:
    """Names that only one side knows, imports and modules apart."""
    keep = ~F.col("kind").isin("use", "mod")
    o, n = (df.where(keep).select("name").distinct() for df in (old_symbols, new_symbols))
    return o.join(n, "name", "left_anti").union(n.join(o, "name", "left_anti"))


def affected_files(clean: DataFrame, names: DataFrame) -> DataFrame:
    """Clean (path, content) files that mention a changed name as a word: their references are extracted anew."""
    words = clean.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return words.join(names, "name", "left_semi").select("path").distinct()


def without_files(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path"), "path", "left_anti")


def without_dangling(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    ids = symbols.select("id")
    return refs.join(ids.withColumnRenamed("id", "source_symbol_id"), "source_symbol_id", "left_semi").join(ids.withColumnRenamed("id", "target_symbol_id"), "target_symbol_id", "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def refresh(old_files: DataFrame, old_symbols: DataFrame, new_files: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """New symbols, dirty files and files to extract again, from snapshots (path, content, content_hash)."""
    change = snapshot_difference(old_files, new_files)
    dirty = change.where("change IN ('added', 'changed')").select("path")
    gone = change.where("change <> 'unchanged'").select("path")
    symbols = without_files(old_symbols, gone).unionByName(parse(new_files.join(dirty, "path", "left_semi")), allowMissingColumns=True)
    names = changed_names(old_symbols, symbols)
    clean = new_files.join(change.where("change = 'unchanged'").select("path"), "path", "left_semi")
    again = dirty.union(affected_files(clean, names)).distinct()
    return {"change": change, "symbols": symbols, "extract": again}


def file_stream(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Applies each batch of (path, content, content_hash) Parquet files that arrive in a folder, once."""
    stream = spark.readStream.schema("path string, content string, content_hash string").parquet(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
