"""Counting operators, rankings and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeatlas.functions.text import percent, under
from codeatlas.index import CodeIndex
from codeatlas.operators.joins import PUBLIC


def counts(ix: CodeIndex) -> DataFrame:
    parts = [("files", ix.files), ("symbols", ix.symbols), ("dependencies", ix.dependencies), ("crates", ix.crates), ("functions", ix.symbols.where("kind = 'function'"))]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def refs_by_confidence(ix: CodeIndex) -> DataFrame:
    per = ix.edges.groupBy("confidence").agg(F.count("*").alias("n"))
    return per.join(per.agg(F.sum("n").alias("total")), F.lit(True)).select("confidence", "n", percent(F.col("n"), F.col("total")).alias("percent"))


def noisy_targets(ix: CodeIndex, limit: int = 10) -> DataFrame:
    return ix.linked("dst").where("confidence = 'low'").groupBy(F.col("dst_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def truncated_signatures(ix: CodeIndex) -> DataFrame:
    return ix.symbols.where(F.endswith("signature", F.lit("(")) & (F.col("kind") == "function")).agg(F.count("*").alias("n"))


def most_referenced(ix: CodeIndex, limit: int = 10, prefix: str = "", confidence: str | None = None, exclude_tests: bool = False) -> DataFrame:
    edges = ix.linked("dst")
    edges = edges.where(F.col("confidence") == confidence) if confidence else edges
    edges = edges.where("src_is_test = 0") if exclude_tests else edges
    per = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n"))
    rows = per.join(ix.nodes.where(under(F.col("path"), prefix)).select("id", "name", "path", "impl_type"), "id")
    return rows.orderBy(F.desc("n"), "name", "path", "id").limit(limit).select("id", "name", "path", "impl_type", "n")


def most_referencing(ix: CodeIndex, limit: int = 10, prefix: str = "", confidence: str | None = None, exclude_tests: bool = False) -> DataFrame:
    edges = ix.edges.where(F.col("confidence") == confidence) if confidence else ix.edges
    per = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))
    nodes = ix.nodes.where(under(F.col("path"), prefix))
    nodes = nodes.where("is_test = 0") if exclude_tests else nodes
    return per.join(nodes.select("id", "name", "path"), "id").orderBy(F.desc("n"), "name", "path", "id").limit(limit).select("id", "name", "path", "n")


def symbols_by_kind(ix: CodeIndex, prefix: str = "") -> DataFrame:
    return ix.nodes.where(under(F.col("path"), prefix)).groupBy("kind").agg(F.count("*").alias("n"))


def in_degree(ix: CodeIndex) -> DataFrame:
    """Distinct sure sources of each (name, path)."""
    return ix.linked("dst").where("confidence = 'high'").groupBy(F.col("dst_name").alias("name"), F.col("dst_path").alias("path")).agg(F.countDistinct("src").alias("n"))


def doc_coverage(ix: CodeIndex, prefix: str = "", include_private: bool = False) -> DataFrame:
    rows = ix.nodes.where(under(F.col("path"), prefix) & ~F.col("kind").isin("use", "mod", "impl", "enum_variant"))
    rows = rows if include_private else rows.where(F.col("visibility").isin(*PUBLIC))
    total = rows.groupBy("kind").agg(F.count("*").alias("total"), F.count("doc_comment").alias("documented"))
    return total.select("kind", "total", "documented", percent(F.col("documented"), F.col("total")).alias("percent"))


def largest_functions(ix: CodeIndex, limit: int = 10, prefix: str = "", exclude_tests: bool = False) -> DataFrame:
    rows = ix.nodes.where(under(F.col("path"), prefix) & (F.col("kind") == "function"))
    rows = rows.where("is_test = 0") if exclude_tests else rows
    return rows.select("id", "name", "path", (F.col("line_end") - F.col("line_start") + 1).alias("n")).orderBy(F.desc("n"), "name", "path", "id").limit(limit)


def hotspots(ix: CodeIndex, limit: int = 10, prefix: str = "", exclude_tests: bool = False) -> DataFrame:
    parts = {"referenced": most_referenced(ix, limit, prefix, "high", exclude_tests), "referencing": most_referencing(ix, limit, prefix, "high", exclude_tests), "largest": largest_functions(ix, limit, prefix, exclude_tests)}
    out = [df.select(F.lit(k).alias("section"), "name", "path", "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def boundary(ix: CodeIndex, prefix: str) -> DataFrame:
    """Per public symbol under a path: caller sites and files outside of it."""
    mine = ix.nodes.where(under(F.col("path"), prefix) & F.col("visibility").isin(*PUBLIC) & ~F.col("kind").isin("use", "mod", "impl")).select("id", "name", "path", "kind")
    outside = ix.linked("dst").where(under(F.col("dst_path"), prefix) & ~under(F.col("src_path"), prefix)).select(F.col("dst").alias("id"), "src_name", "src_path")
    per = mine.join(outside.distinct(), "id", "left").groupBy("id", "name", "path", "kind").agg(F.count("src_name").alias("sites"), F.countDistinct("src_path").alias("files"), F.slice(F.sort_array(F.collect_set("src_path")), 1, 3).alias("f"))
    return per.select("id", "name", "path", "kind", "sites", "files", F.array_join("f", ",").alias("first_files"), F.when(F.col("sites") > 0, "external").otherwise("internal").alias("use"))


def proportional_limit(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (path, line_start, ...) limited over files: one each, the rest in proportion to what is left."""
    per = W.partitionBy("path").orderBy("line_start", "id")
    sized = rows.withColumn("rank", F.row_number().over(per))
    # files are few against rows; their budget is computed on one row per file
    files = sized.groupBy("path").agg(F.count("*").alias("size"))
    totals = files.agg(F.count("*").alias("n_files"), F.sum("size").alias("n_rows"))
    budget = files.join(F.broadcast(totals), F.lit(True))
    few = F.col("n_files") >= limit
    # of more files than rows, the first ones by path get one row each
    early = files.orderBy("path").limit(limit).select("path", F.lit(1).alias("early"))
    share = F.lit(1) + F.expr(f"(size - 1) * ({limit} - n_files) div greatest(n_rows - n_files, 1)")
    budget = budget.join(early, "path", "left").select("path", F.when(F.lit(limit) >= F.col("n_rows"), F.col("size")).when(few, F.coalesce("early", F.lit(0))).otherwise(F.least("size", share)).alias("budget"))
    return sized.join(budget, "path").where("rank <= budget").drop("rank", "budget")


def overview(ix: CodeIndex, prefix: str, limit: int = 100) -> DataFrame:
    rows = ix.nodes.where(under(F.col("path"), prefix) & F.col("visibility").isin(*PUBLIC) & ~F.col("kind").isin("mod", "use", "enum_variant"))
    return proportional_limit(rows.select("id", "name", "kind", "path", "line_start"), limit)


def health(ix: CodeIndex) -> DataFrame:
    """One row per measure."""
    by = ix.edges.groupBy("confidence").agg(F.count("*").alias("n")).select(F.concat(F.lit("refs_"), "confidence").alias("what"), "n")
    return counts(ix).unionByName(by).unionByName(truncated_signatures(ix).select(F.lit("truncated_signatures").alias("what"), "n"))


def stats(ix: CodeIndex, prefix: str, tested: DataFrame) -> DataFrame:
    """Counts under a path; `tested` has the ids of functions that a test reaches."""
    rows = ix.nodes.where(under(F.col("path"), prefix))
    functions = rows.where("kind = 'function' AND is_test = 0").join(tested.select("id", F.lit(1).alias("t")), "id", "left")
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("kind_"), "kind").alias("what"), "n")
    tests = rows.where("is_test = 1").agg(F.count("*").alias("n")).select(F.lit("tests").alias("what"), "n")
    cover = functions.agg(F.count("t").alias("a"), F.count("*").alias("b")).select(F.lit("tested_percent").alias("what"), percent(F.col("a"), F.col("b")).alias("n"))
    return kinds.unionByName(tests).unionByName(cover)
