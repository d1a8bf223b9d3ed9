"""Composite analyses of one symbol or type: references, usage, rename plans, context, similarity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import has, split_qualified, under, whole_word
from codeatlas.index import CodeIndex
from codeatlas.operators.graph import NOISY, related_tests, seeds, tested_ids
from codeatlas.operators.joins import NOT_CALLABLE, calls_by_name, implementations, unused
from codeatlas.plans.stage import meeting


def _sections(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("section"), "name", "path", F.col("line").cast("long").alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def call_sites(ix: CodeIndex, name: str, impl_type: str | None = None, exclude_tests: bool = False) -> DataFrame:
    sites = sites_of(ix, seeds(ix, name, impl_type).select("id"))
    return sites.where("is_test = 0") if exclude_tests else sites


def sites_of(ix: CodeIndex, ids: DataFrame) -> DataFrame:
    """Where the symbols of (id) are referred to: name, path, line, is_test."""
    hits = meeting(ix.linked("dst"), "dst", ids)
    return hits.select(F.col("src_name").alias("name"), F.col("src_path").alias("path"), F.coalesce("ref_line", "src_line_start").alias("line"), F.col("src_is_test").alias("is_test")).distinct()


def references(ix: CodeIndex, q: str, exclude_tests: bool = False) -> DataFrame:
    """Definitions, call sites (production and test apart), signature uses and trait impls."""
    impl, name = split_qualified(q)
    line = F.col("line_start").alias("line")
    sites = call_sites(ix, name, impl, exclude_tests)
    return _sections(
        {
            "definition": seeds(ix, name, impl).select("name", "path", line),
            "call": sites.where("is_test = 0"),
            "test_call": sites.where("is_test = 1"),
            "signature": ix.nodes.where(whole_word(F.col("signature"), name) & (F.col("name") != name)).select("name", "path", line),
            "trait_impl": implementations(ix, trait_name=name).unionByName(implementations(ix, type_name=name)).select(F.col("type_name").alias("name"), "path", line).distinct(),
        }
    )


def type_usage(ix: CodeIndex, type_name: str, prefix: str = "") -> DataFrame:
    """Where a type is returned, accepted or (with `details`) held in a struct."""
    rows = ix.nodes.where(under(F.col("path"), prefix) & whole_word(F.col("signature"), type_name) & (F.col("kind") == "function"))
    arrow = F.instr("signature", "->")
    returned = F.when(arrow > 0, F.expr("substr(signature, instr(signature, '->') + 2)"))
    accepted = F.when(arrow > 0, F.substring_index("signature", "->", 1)).otherwise(F.col("signature"))
    line = F.col("line_start").alias("line")
    parts = {"returns": rows.where(whole_word(returned, type_name)).select("name", "path", line), "accepts": rows.where(whole_word(accepted, type_name)).select("name", "path", line)}
    if "details" in ix.nodes.columns:
        parts["fields"] = ix.nodes.where((F.col("kind") == "struct") & whole_word(F.col("details"), type_name) & under(F.col("path"), prefix)).select("name", "path", line)
    return _sections(parts)


def compact_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("section", "path").agg(F.count("*").alias("n"))


def rename_plan(ix: CodeIndex, q: str) -> DataFrame:
    """How many places of each kind a rename touches."""
    impl, name = split_qualified(q)
    parts = {
        "definitions": seeds(ix, name, impl),
        "call_sites": call_sites(ix, name, impl).select("name", "path").distinct(),
        "signatures": ix.nodes.where(has(F.col("signature"), name) & (F.col("name") != name)),
        "trait_impls": ix.trait_impls.where((F.col("type_name") == name) | (F.col("trait_name") == name) | F.endswith("trait_name", F.lit("::" + name))),
        "doc_mentions": ix.nodes.where(has(F.col("doc_comment"), name)),
    }
    out = None
    for section, df in parts.items():
        rows = df.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def orphaned(ix: CodeIndex, prefix: str = "", kind: str | None = None) -> DataFrame:
    """Public, unused and untested."""
    return unused(ix, prefix, kind).join(tested_ids(ix), "id", "left_anti")


_CAPITAL = r"[A-Z][A-Za-z0-9_]*"


def similar(ix: CodeIndex, symbol_id: int, limit: int = 10, noisy: tuple[str, ...] = NOISY) -> DataFrame:
    """Functions scored by return type, receiver, parameter types and shared callees; score 2 at least."""
    me = ix.nodes.where(F.col("id") == symbol_id).first()
    if me is None:
        return ix.nodes.where("false").select("id", "name", "path", F.lit(0).alias("score"))
    returned = me.signature.partition("->")[2].strip()
    core = next((w for w in re.findall(_CAPITAL, returned) if w not in ("Result", "Option", "Vec", "Box", "Arc", "Rc")), returned)
    params = me.signature[me.signature.find("(") + 1 : me.signature.rfind(")")]
    types = [w for w in dict.fromkeys(re.findall(_CAPITAL, params)) if len(w) >= 3 and w != "Self"]
    long_type = next((w for w in types if len(w) >= 4), None)
    seed = ((F.col("path") == me.path) & (F.col("kind") == me.kind)) | (F.contains("signature", F.lit(core)) if core else F.lit(False))
    seed = seed | F.contains("signature", F.lit(long_type)) if long_type else seed
    rows = ix.nodes.where(seed & (F.col("id") != symbol_id)).select("id", "name", "path", "signature")
    score = F.when(F.contains("signature", F.lit(core)) if core else F.lit(False), 2).otherwise(0)
    if "&mut self" in me.signature:
        score = score + F.when(F.contains("signature", F.lit("&mut self")), 2).otherwise(0)
    elif "&self" in me.signature:
        score = score + F.when(F.contains("signature", F.lit("&self")), 1).otherwise(0)
    for w in types:
        score = score + F.when(F.contains(F.regexp_extract("signature", r"\((.*)\)", 1), F.lit(w)), 1).otherwise(0)
    # callees go by name, as the candidates are looked up by name
    mine = calls_by_name(ix, me.name, up=False).select("name").distinct()
    mine = mine.where(~F.col("name").isin(*noisy)) if noisy else mine
    ours = ix.linked("src").where("ref_kind = 'call'").where(~F.col("src_kind").isin(*NOT_CALLABLE) & ~F.col("dst_kind").isin(*NOT_CALLABLE))
    ours = ours.join(rows.select(F.col("name").alias("src_name")).distinct(), "src_name", "left_semi").join(mine.withColumnRenamed("name", "dst_name"), "dst_name", "left_semi")
    shared = ours.groupBy(F.col("src_name").alias("name")).agg(F.countDistinct("dst_name").alias("shared"))
    total = score + F.coalesce("shared", F.lit(0))
    return rows.join(shared, "name", "left").withColumn("score", total.cast("long")).where("score >= 2").orderBy(F.desc("score"), "name", "path", "id").limit(limit).select("id", "name", "path", "score")


def context(ix: CodeIndex, q: str, path: str | None = None) -> DataFrame:
    """Callers (production first, at most 30), callees, traits, tests and relatives of a symbol, perhaps of one file, by section."""
    impl, name = split_qualified(q)
    found = seeds(ix, name, impl)
    mine = (found if path is None else found.where(F.col("path") == path)).select("id", "path", "impl_type")
    ids = mine.select("id")
    down = meeting(ix.linked("src"), "src", ids).where("confidence = 'high'")
    callees = down.select(F.col("dst_name").alias("name"), F.col("dst_path").alias("path"), F.col("dst_line_start").alias("line")).distinct()
    up = sites_of(ix, ids).orderBy("is_test", "path", "line", "name").limit(30)
    types = mine.where("impl_type IS NOT NULL").select(F.col("impl_type").alias("type_name")).distinct()
    traits = ix.trait_impls.join(types, "type_name", "left_semi").join(ix.files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("trait_name").alias("name"), "path", F.col("line_start").alias("line"))
    there = mine.select("path", F.coalesce("impl_type", F.lit("")).alias("t")).distinct()
    related = ix.nodes.withColumn("t", F.coalesce("impl_type", F.lit(""))).join(there, ["path", "t"], "left_semi").join(ids, "id", "left_anti").orderBy("path", "line_start", "id").limit(10)
    tests = related_tests(ix, ids.select(F.lit(0).alias("seed"), "id")).select("name", "path", F.col("line_start").alias("line"))
    return _sections({"caller": up, "callee": callees, "trait": traits, "related": related.select("name", "path", F.col("line_start").alias("line")), "test": tests})


def batch_context(ix: CodeIndex, names: list[str], path: str | None = None) -> DataFrame:
    """`context` of several symbols: asked, section, name, path, line."""
    out = None
    for q in names:
        rows = context(ix, q, path).select(F.lit(q).alias("asked"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def freshness(metadata: DataFrame, commits: DataFrame, version: str) -> DataFrame:
    """Repositories (repo, commit_hash, index_version) against (repo, head): stale or not."""
    joined = metadata.join(commits, "repo", "left")
    return joined.select("repo", (~F.col("commit_hash").eqNullSafe(F.col("head")) | ~F.col("index_version").eqNullSafe(F.lit(version))).alias("stale"))


def repositories(ix: CodeIndex) -> DataFrame:
    """Per repository: crates, files, symbols, tests."""
    per = ix.nodes.groupBy("repo").agg(F.countDistinct("crate_id").alias("crates"), F.countDistinct("file_id").alias("files"), F.count("*").alias("symbols"), F.sum(F.col("is_test").cast("long")).alias("tests"))
    return per


