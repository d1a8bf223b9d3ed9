"""Operators over several repositories."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeatlas.functions.text import has, split_qualified
from codeatlas.index import CodeIndex
from codeatlas.operators.joins import cross_refs, direct_callees


def cross_query(ix: CodeIndex, q: str, primary: int, limit: int = 5) -> DataFrame:
    """Name hits in every other repository, `limit` of each."""
    per = W.partitionBy("repo").orderBy(F.when(F.col("name") == q, 0).otherwise(1), "name", "path", "line_start", "id")
    rows = ix.nodes.where((F.col("repo") != primary) & has(F.col("name"), q))
    return rows.withColumn("k", F.row_number().over(per)).where(F.col("k") <= limit).select("repo", "name", "path", "line_start")


def cross_impact(ix: CodeIndex, q: str, primary: int, text: str | None = None) -> DataFrame:
    """Sure references from other repositories; with `text`, signatures that mention it of symbols of that name."""
    impl, name = split_qualified(q)
    if text is None:
        return cross_refs(ix, name, primary, impl).select(F.col("src_repo").alias("repo"), F.col("src_name").alias("name"), F.col("src_path").alias("path"), F.col("src_line_start").alias("line_start"))
    rows = ix.nodes.where((F.col("repo") != primary) & has(F.col("signature"), text) & (F.col("name") == name))
    rows = rows if impl is None else rows.where(F.col("impl_type") == impl)
    return rows.select("repo", "name", "path", "line_start").dropDuplicates(["path", "line_start"])


def shared_dependencies(users: DataFrame, least: int = 2, limit: int = 30) -> DataFrame:
    """Dependencies (repo, name) of several repositories."""
    per = users.groupBy("name").agg(F.countDistinct("repo").alias("repos")).where(F.col("repos") >= least)
    return per.orderBy(F.desc("repos"), "name").limit(limit)


def path_dependencies(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Path dependencies (repo, name, path) that are roots of registered repositories (repo, root)."""
    return deps.where("path IS NOT NULL").join(registry.select(F.col("repo").alias("target"), F.col("root").alias("path")), "path").select("repo", "name", "target")


def bridges(ix: CodeIndex, start: str, to: str, here: int, there: int) -> DataFrame:
    """Direct callees of `start` here that exist by name there, given that `to` does."""
    both_here = (F.col("src_repo") == here) & (F.col("dst_repo") == here)
    own = replace(ix, stored_nodes=ix.nodes.where(F.col("repo") == here), stored_links={"src": ix.linked("src").where(both_here)})
    other = ix.nodes.where(F.col("repo") == there).select("name").distinct()
    goal = other.where(F.col("name") == split_qualified(to)[1])
    return direct_callees(own, start).join(other, "name", "left_semi").join(goal.select(F.lit(True).alias("there")).limit(1), F.lit(True)).select("name")


def registry_upsert(registry: DataFrame, entries: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Registered repositories (name, path, git_common_dir, last_indexed), the latest per common directory."""
    latest = W.partitionBy(F.coalesce("git_common_dir", "path")).orderBy(F.desc("last_indexed"), "name", "path")
    rows = registry.unionByName(entries).withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")
    return rows if gone is None else rows.join(gone.select("path"), "path", "left_anti")
