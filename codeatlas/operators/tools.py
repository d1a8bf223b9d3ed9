"""Whole questions put together from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import under
from codeatlas.index import CodeIndex
from codeatlas.operators.graph import NOT_CALLABLE, related_tests
from codeatlas.operators.joins import PUBLIC, file_symbol_counts, overlapping
from codeatlas.plans.stage import cut, meeting


def tree(ix: CodeIndex, prefix: str) -> DataFrame:
    """Files under a path with their numbers of public symbols: path, n."""
    return file_symbol_counts(ix, prefix)


def tree_totals(ix: CodeIndex, prefix: str) -> DataFrame:
    return tree(ix, prefix).agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def symbols_at(ix: CodeIndex, path: str, line: int) -> DataFrame:
    """Symbols around one line, with the first line of their documentation."""
    here = ix.spark.createDataFrame([(path, line, line)], "path string, start long, end long")
    docs = ix.nodes.where(F.col("path") == path).select("id", F.split("doc_comment", "\n")[0].alias("doc"))
    return overlapping(ix, here).join(docs, "id").select("id", "name", "impl_type", "kind", "line_start", "line_end", "signature", "doc")


def levels(ix: CodeIndex, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): ends of walks of 1 to `depth` sure references up from the ids of `start`; an id at every depth it is met at."""
    up = ix.linked("dst").where("confidence = 'high'").select("src", "dst")
    level, out = start.select("id").distinct(), None
    for d in range(1, depth + 1):
        level = cut(meeting(up, "dst", level).select(F.col("src").alias("id")).distinct())
        rows = level.select("id", F.lit(d).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        if level.isEmpty():
            break
    return out


def diff_impact(ix: CodeIndex, ranges: DataFrame, depth: int = 5, changes_only: bool = False, compact: bool = False) -> DataFrame:
    """(section, name, path, n): symbols in changed ranges (path, start, end), what depends on them, tests of them, functions without one."""
    changed = cut(overlapping(ix, ranges))
    shown = changed.where(~F.col("kind").isin("mod", "impl"))
    out = shown.select(F.lit("changed").alias("section"), "name", "path", F.col("line_start").cast("long").alias("n"))
    if changes_only:
        return out
    if not compact:
        ends = ix.nodes.select("id", "name", "path")
        down = levels(ix, changed, depth).join(ends, "id").select(F.lit("downstream").alias("section"), "name", "path", F.col("depth").cast("long").alias("n"))
        out = out.unionByName(down.distinct())
    tests = cut(related_tests(ix, changed.select(F.col("id").alias("seed"), "id"), depth))
    functions = changed.where("kind = 'function'").join(ix.symbols.where("is_test = 0").select("id"), "id", "left_semi")
    bare = functions.join(tests.select(F.col("seed").alias("id")), "id", "left_anti")
    out = out.unionByName(bare.select(F.lit("untested").alias("section"), "name", "path", F.col("line_start").cast("long").alias("n")))
    return out.unionByName(tests.select(F.lit("test").alias("section"), "name", "path", F.col("line_start").cast("long").alias("n")).distinct())


def overview_calls(ix: CodeIndex, prefix: str, most: int = 3) -> DataFrame:
    """(id, section, names): per public symbol under a path, what it calls in its own file and its first callers in other files."""
    mine = ix.nodes.where(under(F.col("path"), prefix) & F.col("visibility").isin(*PUBLIC) & ~F.col("kind").isin("mod", "use", "enum_variant")).select("id")
    calls = ix.linked("src").where("ref_kind = 'call'").where(~F.col("src_kind").isin(*NOT_CALLABLE) & ~F.col("dst_kind").isin(*NOT_CALLABLE))
    inside = calls.where((F.col("src_path") == F.col("dst_path")) & under(F.col("src_path"), prefix)).select(F.col("src").alias("id"), F.lit("same_file").alias("section"), F.col("dst_name").alias("name"))
    outside = calls.where((F.col("src_path") != F.col("dst_path")) & under(F.col("dst_path"), prefix)).select(F.col("dst").alias("id"), F.lit("callers").alias("section"), F.col("src_name").alias("name"))
    per = inside.unionByName(outside).join(mine, "id", "left_semi").groupBy("id", "section").agg(F.sort_array(F.collect_set("name")).alias("own"))
    first = F.when(F.col("section") == "callers", F.slice("own", 1, most)).otherwise(F.col("own"))
    return per.select("id", "section", F.array_join(first, ",").alias("names"))


def test_listing(tests: DataFrame, one_by_one: int = 20, by_file: int = 50) -> DataFrame:
    """(what, n) of tests (name, path): up to 20 by name, up to 50 by file, more as one number."""
    total = tests.agg(F.count("*").alias("total"))
    named = tests.join(F.broadcast(total), F.lit(True))
    names = named.where(F.col("total") <= one_by_one).groupBy(F.col("name").alias("what")).agg(F.count("*").alias("n"))
    files = named.where((F.col("total") > one_by_one) & (F.col("total") <= by_file)).groupBy(F.col("path").alias("what")).agg(F.count("*").alias("n"))
    return names.unionByName(files).unionByName(total.where(F.col("total") > by_file).select(F.lit("tests").alias("what"), F.col("total").alias("n")))
