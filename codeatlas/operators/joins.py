"""Relational operators over symbols, edges and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeatlas.functions.text import has, is_entry_point, matches_signature, split_qualified, under
from codeatlas.index import CodeIndex
from codeatlas.plans.stage import meeting

SYMBOL = ("id", "name", "kind", "visibility", "path", "line_start", "line_end", "signature", "impl_type")
NOT_CALLABLE = ("const", "static", "enum_variant")
PUBLIC = ("public", "pub(crate)")


def by_path(ix: CodeIndex, prefix: str, include_private: bool = False) -> DataFrame:
    rows = ix.nodes.where(under(F.col("path"), prefix))
    return (rows if include_private else rows.where(F.col("visibility").isin(*PUBLIC))).select(*SYMBOL)


def by_text(ix: CodeIndex, column: str, q: str, limit: int | None = 50) -> DataFrame:
    """Literal substring on attributes, doc_comment, body, signature or details."""
    rows = ix.nodes.where(has(F.col(column), q)).select(*SYMBOL, *({column} - set(SYMBOL)))
    return rows if limit is None else rows.orderBy("name", "path", "line_start", "id").limit(limit)


def by_signature(ix: CodeIndex, wanted: str) -> DataFrame:
    return ix.nodes.where(matches_signature(F.col("signature"), wanted)).select(*SYMBOL)


def by_kind(rows: DataFrame, kind: str | None) -> DataFrame:
    return rows.where(~F.col("kind").isin("use", "mod", "enum_variant")) if kind is None else rows.where(F.lower("kind") == kind.lower())


def callees(ix: CodeIndex, name: str, path: str, exclude_tests: bool = False) -> DataFrame:
    """What (name, path) refers to with high confidence."""
    source = ix.nodes.where((F.col("name") == name) & (F.col("path") == path)).select("id")
    out = meeting(ix.linked("src"), "src", source).where("confidence = 'high'")
    if exclude_tests:
        out = out.where("dst_is_test = 0")
    return out.select("dst_name", "dst_kind", "dst_path", "dst_line_start", "dst_impl_type", "ref_kind", "ref_line").distinct()


def callers(ix: CodeIndex, name: str, path: str, exclude_tests: bool = False, confidence: str | None = None) -> DataFrame:
    target = ix.nodes.where((F.col("name") == name) & (F.col("path") == path)).select("id")
    out = meeting(ix.linked("dst"), "dst", target)
    out = out if confidence is None else out.where(F.col("confidence") == confidence)
    if exclude_tests:
        out = out.where("src_is_test = 0")
    return out.select("src_name", "src_kind", "src_path", "src_line_start", "src_impl_type", "ref_kind", "confidence", "ref_line").distinct()


def calls_by_name(ix: CodeIndex, name: str, up: bool, confidence: str | None = None, exclude_tests: bool = False) -> DataFrame:
    """Names and paths on the other end of `call` edges of a name."""
    here, there = ("dst", "src") if up else ("src", "dst")
    mine = ix.nodes.where((F.col("name") == name) & ~F.col("kind").isin(*NOT_CALLABLE)).select("id")
    out = meeting(ix.linked(here), here, mine).where("ref_kind = 'call'").where(~F.col(f"{there}_kind").isin(*NOT_CALLABLE))
    if confidence:
        out = out.where(F.col("confidence") == confidence)
    if exclude_tests:
        out = out.where(f"{there}_is_test = 0")
    return out.select(F.col(f"{there}_name").alias("name"), F.col(f"{there}_path").alias("path")).distinct()


def direct_callees(ix: CodeIndex, qualified: str, limit: int = 100) -> DataFrame:
    impl, name = split_qualified(qualified)
    mine = ix.nodes.where(F.col("name") == name)
    mine = (mine if impl is None else mine.where(F.col("impl_type") == impl)).select("id")
    return meeting(ix.linked("src"), "src", mine).where("ref_kind = 'call' AND confidence = 'high'").select(F.col("dst_name").alias("name")).distinct().orderBy("name").limit(limit)


def file_symbol_counts(ix: CodeIndex, prefix: str) -> DataFrame:
    public = ix.symbols.where(F.col("visibility").isin(*PUBLIC) & ~F.col("kind").isin("use", "mod", "impl")).select("file_id", F.col("id").alias("symbol_id"))
    files = ix.files.where(under(F.col("path"), prefix)).select(F.col("id").alias("file_id"), "path")
    return files.join(public, "file_id", "left").groupBy("path").agg(F.count("symbol_id").alias("n"))


def unreferenced(ix: CodeIndex, prefix: str = "", include_private: bool = False) -> DataFrame:
    """Symbols without any incoming edge, nor with a same-named method of the type that has a sure one."""
    rows = by_path(ix, prefix, include_private)
    alone = rows.join(ix.edges.select(F.col("dst").alias("id")), "id", "left_anti")
    covered = ix.nodes.where("impl_type IS NOT NULL").join(ix.edges.where("confidence = 'high'").select(F.col("dst").alias("id")), "id", "left_semi").select("name", "impl_type").distinct()
    return alone.join(covered, ["name", "impl_type"], "left_anti")


def unused(ix: CodeIndex, prefix: str = "", kind: str | None = None, include_private: bool = False) -> DataFrame:
    """Unreferenced symbols that are neither entry points nor variants nor impl blocks."""
    rows = unreferenced(ix, prefix, include_private).join(ix.symbols.select("id", "attributes"), "id")
    rows = rows.where(~is_entry_point(F.col("name"), F.col("attributes")) & ~F.col("kind").isin("enum_variant", "impl"))
    return (rows if kind is None else by_kind(rows, kind)).drop("attributes")


def dangling_refs(ix: CodeIndex) -> DataFrame:
    """Edges whose ends don't both exist."""
    ids = ix.symbols.select("id")
    columns = ix.edges.columns
    no_source = ix.edges.join(ids.toDF("src"), "src", "left_anti").select(columns)
    no_target = ix.edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_anti").select(columns)
    return no_source.unionByName(no_target)


def docs_of(ix: CodeIndex, dependency: str, module: str | None = None) -> DataFrame:
    dep = ix.dependencies.where(F.col("name") == dependency).select(F.col("id").alias("dependency_id"), F.col("name").alias("dependency"), "version")
    rows = ix.docs.join(dep, "dependency_id")
    return (rows if module is None else rows.where(F.col("module") == module)).select("id", "dependency", "version", "source", "module", "content")


def crate_of_files(ix: CodeIndex) -> DataFrame:
    return ix.files.join(ix.crates.select(F.col("id").alias("crate_id"), F.col("name").alias("crate")), "crate_id").select("path", "crate")


def overlapping(ix: CodeIndex, ranges: DataFrame) -> DataFrame:
    """Symbols whose lines overlap ranges (path, start, end); first row of each (path, name, line_start)."""
    hit = ix.nodes.join(ranges, "path").where("line_start <= end AND line_end >= start")
    order = W.partitionBy("path", "name", "line_start").orderBy("id")
    return hit.withColumn("k", F.row_number().over(order)).where("k = 1").select(*SYMBOL)


def resolved_dependencies(locked: DataFrame, direct: DataFrame) -> DataFrame:
    """Locked (name, version) with is_direct and features of direct (name, features)."""
    return locked.join(direct.select("name", "features", F.lit(True).alias("d")), "name", "left").select("name", "version", F.coalesce("d", F.lit(False)).alias("is_direct"), "features")


def implementations(ix: CodeIndex, trait_name: str | None = None, type_name: str | None = None) -> DataFrame:
    """Trait impls by trait (also as last path segment), by type, or both (trait exact)."""
    rows = ix.trait_impls.join(ix.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if type_name is not None:
        rows = rows.where(F.col("type_name") == type_name)
    if trait_name is not None:
        match = F.col("trait_name") == trait_name
        rows = rows.where(match if type_name is not None else match | F.endswith("trait_name", F.lit("::" + trait_name)))
    return rows.select("type_name", "trait_name", "path", "line_start", "line_end")


def cross_refs(ix: CodeIndex, name: str, primary: int, impl_type: str | None = None, limit: int = 50) -> DataFrame:
    """Sure references to a name in repositories other than the primary one."""
    target = ix.nodes.where((F.col("name") == name) & (F.col("repo") != primary))
    target = (target if impl_type is None else target.where(F.col("impl_type") == impl_type)).select("id")
    hits = meeting(ix.linked("dst"), "dst", target).where("confidence = 'high'")
    return hits.select("src_name", "src_path", "src_line_start", "src_repo", "ref_kind").distinct().orderBy("src_path", "src_line_start", "src_name", "ref_kind").limit(limit)


def symbol_exists(ix: CodeIndex, names: DataFrame) -> DataFrame:
    """Which (name) rows, `Type::method` allowed, exist; split at the first `::`."""
    at = F.instr("name", "::")
    wanted = names.select(F.col("name").alias("asked"), F.when(at > 0, F.substring_index("name", "::", 1)).alias("impl_type"), F.when(at > 0, F.expr("substr(name, instr(name, '::') + 2)")).otherwise(F.col("name")).alias("base"))
    known = ix.nodes.select(F.col("name").alias("base"), F.col("impl_type").alias("known_impl")).distinct()
    hit = wanted.join(known, "base").where("impl_type IS NULL OR impl_type = known_impl").select("asked").distinct()
    return wanted.join(hit.withColumn("found", F.lit(True)), "asked", "left").select("asked", F.coalesce("found", F.lit(False)).alias("found"))


def bridge(callers_: DataFrame, commands: DataFrame) -> DataFrame:
    """invoke('x') in (id, body) rows to (id, name) commands; the smallest command id of a name wins."""
    asked = callers_.select(F.col("id").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(r"""invoke(?:<[^>]*>)?\(\s*['"]([A-Za-z0-9_]+)['"]"""), F.lit(1))).alias("name")).distinct()
    return asked.join(commands.groupBy("name").agg(F.min("id").alias("dst")), "name").select("src", "dst", F.lit("call").alias("kind"), F.lit("high").alias("confidence"))
