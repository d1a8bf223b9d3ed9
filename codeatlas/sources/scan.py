"""Source trees as DataFrames and the text of documentation pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.text import fnv1a

#: Directories that are never walked, and the extensions of source files.
PRUNED = ("target", "node_modules", "dist", ".next", "build", ".nuxt", ".output", "__pycache__", "venv", "env")
EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py")
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def is_source(path: Column) -> Column:
    """A source file outside pruned, hidden and egg-info directories."""
    pruned = "|".join(d.replace(".", r"\.") for d in PRUNED)
    return extension(path).isin(*EXTENSIONS) & ~path.rlike(rf"(^|/)({pruned}|\.[^/]+|[^/]*\.egg-info)/")


def scan(spark: SparkSession, root: str, extra_prune: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, content_hash) of all source files under a root; paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = root.rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    out = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content")).where(is_source(F.col("path")))
    for d in extra_prune:
        out = out.where(~F.col("path").rlike(rf"(^|/){d}/"))
    return with_hash(out)


def with_hash(files: DataFrame) -> DataFrame:
    """Adds the 64-bit FNV-1a content hash."""
    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fnv1a(t or ""))

    return files.withColumn("content_hash", digest(F.col("content")))


def crate_layout(files: DataFrame) -> DataFrame:
    """Files of the standard crate directories."""
    return files.where(F.col("path").rlike(r"(^|/)(src|tests|benches|examples)/"))


def html_text(html: Column) -> Column:
    """Readable text of a page: no script, style or head, from "Expand description" or else <main> on, six entities decoded in turn."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    marked = F.contains(out, F.lit("Expand description"))
    out = F.when(marked, F.regexp_replace(out, r"(?s)^.*?(?=Expand description)", "")).otherwise(F.regexp_replace(out, r"(?s)^.*?(?=<main)", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " ")
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(out)


def link_index(pages: DataFrame) -> DataFrame:
    """(page_id, text, href): first .html link of each text."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(<a\s[^>]*href="[^"]*"[^>]*>[^<]*)</a>'), F.lit(1))).alias("pos", "a"))
    parts = links.select("page_id", "pos", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("a", r">([^<]*)$", 1)).alias("text"))
    return parts.where(F.endswith("href", F.lit(".html"))).groupBy("page_id", "text").agg(F.min_by("href", "pos").alias("href"))


#: Where documentation of a dependency comes from, best first.
DOC_SOURCES = ("docs.rs", "crates.io", "github")


def remote_docs(raw: DataFrame, most: int = 8000) -> DataFrame:
    """(dependency, version, source, content) of fetched (dep, version, source, body) rows: the best source with a text, at most `most` bytes."""
    rank = F.array_position(F.array(*[F.lit(x) for x in DOC_SOURCES]), F.lower("source"))
    useful = raw.where((F.trim(F.coalesce("body", F.lit(""))) != "") & (rank > 0))
    best = useful.groupBy("dep", "version").agg(F.min(F.struct(rank.alias("rank"), "source", "body")).alias("b"))
    return best.select(F.col("dep").alias("dependency"), "version", "b.source", _cut_bytes(F.col("b.body"), most).alias("content"))


def _cut_bytes(c: Column, most: int) -> Column:
    """At most `most` bytes, cut between characters."""
    whole = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(whole, "\ufffd+$", ""))


def rustdoc_docs(files: DataFrame, summary: int = 4000, module: int = 8000) -> DataFrame:
    """(crate, module, content) of rustdoc JSON text in (crate, json): the crate's own docs with its modules, then each module.

    Items are `id -> {name, docs, inner}`; an item whose inner value is a module has its items there.
    Modules of less than three lines are left out. Ids are numbers or strings.
    """
    schema = "root string, index map<string, struct<name:string, docs:string, inner:struct<module:struct<items:array<string>>>>>"
    doc = files.select("crate", F.from_json("json", schema).alias("j")).select("crate", "j.root", "j.index")
    items = doc.select("crate", "root", F.explode("index").alias("id", "item"))
    child = items.select("crate", F.col("id").alias("parent"), F.posexplode("item.inner.module.items").alias("pos", "id"))
    known = items.select("crate", "id", F.col("item.name").alias("name"), F.col("item.inner.module").isNotNull().alias("is_module"))
    listed = child.join(known, ["crate", "id"]).groupBy("crate", "parent").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "is_module"))).alias("own"))
    rows = items.where("item.inner.module IS NOT NULL").join(listed.withColumnRenamed("parent", "id"), ["crate", "id"], "left")
    own = F.coalesce("own", F.array().cast("array<struct<pos:int,name:string,is_module:boolean>>"))
    names = lambda keep: F.transform(F.filter(own, keep), lambda x: F.concat(F.lit("- "), x["name"]))
    part = lambda title, keep: F.when(F.size(names(keep)) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(names(keep), "\n")))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("item.name")), "item.docs", part("Modules", lambda x: x["is_module"]), part("Items", lambda x: ~x["is_module"]))
    is_root = F.col("id") == F.col("root")
    kept = rows.select("crate", is_root.alias("is_root"), F.col("item.name").alias("name"), body.alias("body")).where(F.col("is_root") | (F.size(F.split("body", "\n")) > 2))
    return kept.select("crate", F.when(F.col("is_root"), "").otherwise(F.col("name")).alias("module"), F.when(F.col("is_root"), _cut_bytes(F.col("body"), summary)).otherwise(_cut_bytes(F.col("body"), module)).alias("content"))
