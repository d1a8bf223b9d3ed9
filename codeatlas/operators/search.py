"""Search: phrase-prefix full text, substring fallbacks, fuzzy suggestions, ranking and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeatlas.functions.text import ascii_fold, first_line_with, fold, fts_safe, has, phrase_prefix, qualified, split_qualified, string_literal_with, under
from codeatlas.index import CodeIndex
from codeatlas.operators.joins import PUBLIC, by_kind, by_path, by_signature, by_text
from codeatlas.plans.stage import cut, meeting

ORDER = ("name", "path", "line_start", "id")
COLUMNS = ("id", "name", "kind", "path", "line_start", "signature", "impl_type")


def search_symbols(ix: CodeIndex, q: str, limit: int = 50) -> DataFrame:
    """Phrase-prefix hits, then name substrings; exact names first."""
    rows = ix.nodes
    if not q.strip():
        return rows.where("false").select(*COLUMNS, F.lit(0).alias("source"))
    substring = has(F.col("name"), q)
    if not fts_safe(q):
        hit = rows.where(substring).withColumn("source", F.lit(1))
    else:
        fields = ("name",) if len(q.encode()) <= 5 else ("name", "signature", "doc_comment")
        full = phrase_prefix(F.col(fields[0]), q)
        for f in fields[1:]:
            full = full | phrase_prefix(F.col(f), q)
        fallback = substring if not (len(q.encode()) >= 3 and len(q) < 3) else F.lit(False)
        hit = rows.withColumn("source", F.when(full, 0).when(fallback, 1)).where("source IS NOT NULL")
    return hit.orderBy(F.when(F.col("name") == q, 0).otherwise(1), "source", *ORDER).limit(limit).select(*COLUMNS, "source")


def search_docs(ix: CodeIndex, q: str, limit: int = 20) -> DataFrame:
    rows = ix.docs.join(ix.dependencies.select(F.col("id").alias("dependency_id"), F.col("name").alias("dependency")), "dependency_id")
    hit = rows.where(phrase_prefix(F.col("content"), q)) if fts_safe(q) else rows.where("false")
    return hit.orderBy("dependency", "module", "id").limit(limit).select("id", "dependency", "source", "module")


def search_docs_content(ix: CodeIndex, dependency: str, q: str, limit: int = 10) -> DataFrame:
    rows = ix.docs.join(ix.dependencies.where(F.col("name") == dependency).select(F.col("id").alias("dependency_id"), F.col("name").alias("dependency")), "dependency_id")
    return rows.where(has(F.col("content"), q)).orderBy("module", "id").limit(limit).select("id", "dependency", "source", "module")


def suggest(ix: CodeIndex, q: str, limit: int = 3) -> DataFrame:
    """Nearest (name, impl_type) by edit distance, within max(2, 2/5 of the length)."""
    impl, name = split_qualified(q)
    most = max(2, len(name.encode()) * 2 // 5)
    rows = ix.nodes.select("name", "impl_type").distinct()
    near = F.levenshtein(fold(F.col("name")), F.lit(ascii_fold(name)))
    if impl is not None:
        far = F.when(F.col("impl_type").isNull(), 10).otherwise(F.levenshtein(fold(F.col("impl_type")), F.lit(ascii_fold(impl))))
        near, most = near + far, max(2, len(q.encode()) * 2 // 5)
    return rows.withColumn("distance", near).where(F.col("distance") <= most).orderBy("distance", "name", "impl_type").limit(limit)


def resolve(ix: CodeIndex, q: str) -> DataFrame:
    """The first tier with rows: (type, method), exact name, full text."""
    impl, name = split_qualified(q)
    tiers = []
    if impl is not None:
        tiers.append(ix.nodes.where((F.col("name") == name) & (F.col("impl_type") == impl)).select(*COLUMNS, F.lit(0).alias("tier")))
    tiers.append(ix.nodes.where(F.col("name") == q).select(*COLUMNS, F.lit(1).alias("tier")))
    tiers.append(search_symbols(ix, q).select(*COLUMNS, F.lit(2).alias("tier")))
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    best = rows.agg(F.min("tier").alias("best"))
    return rows.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def ranked(ix: CodeIndex, rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first min(4 * limit, 200) rows, by in-degree and name, cut at `limit`."""
    limit = max(limit, 1)
    early = cut(rows.orderBy(*ORDER).limit(min(4 * limit, 200)))
    # only the few early rows' references are counted: those of all symbols of their names and paths
    names = ix.nodes.join(F.broadcast(early.select("name", "path").distinct()), ["name", "path"], "left_semi").select("id")
    degree = meeting(ix.linked("dst"), "dst", names).where("confidence = 'high'").groupBy(F.col("dst_name").alias("name"), F.col("dst_path").alias("path")).agg(F.countDistinct("src").alias("refs"))
    return early.join(degree, ["name", "path"], "left").withColumn("refs", F.coalesce("refs", F.lit(0))).orderBy(F.desc("refs"), *ORDER).limit(limit)


def query(ix: CodeIndex, q: str, scope: str = "symbols", kind: str | None = None, attribute: str | None = None, signature: str | None = None, path: str | None = None, limit: int | None = 50) -> DataFrame:
    """Symbol, file, doc or text search; the seed is the most selective filter given. The files scope takes limit None for all."""
    if scope == "docs":
        return search_docs(ix, q)
    if scope == "files":
        rows = ix.files.where(has(F.col("path"), q if q != "*" else ""))
        rows = (rows if path is None else rows.where(under(F.col("path"), path))).select("path").orderBy("path")
        return rows if limit is None else rows.limit(limit)
    if scope == "doc_comments":
        rows = by_text(ix, "doc_comment", q, None)
    elif scope in ("bodies", "strings"):
        return body_search(ix.nodes, q, scope == "strings", path, limit)
    elif scope == "all":
        both = search_symbols(ix, q, limit).select(F.lit("symbol").alias("what"), "name", "path")
        docs = search_docs(ix, q).select(F.lit("doc").alias("what"), F.col("dependency").alias("name"), F.col("module").alias("path"))
        return both.unionByName(docs)
    elif scope != "symbols":
        raise ValueError(f"unknown scope {scope!r}")
    elif attribute is not None:
        rows = by_text(ix, "attributes", attribute, None)
    elif q and q != "*":
        rows = search_symbols(ix, q)
    elif path is not None:
        rows = by_path(ix, path)
    elif signature is not None:
        rows = by_signature(ix, signature)
    elif kind is not None:
        rows = ix.nodes
    else:
        rows = ix.nodes.where("false")
    rows = rows.select(*COLUMNS)
    if path is not None:
        rows = rows.where(F.startswith("path", F.lit(path)))
    if signature is not None:
        rows = rows.where(F.col("id").isNotNull()).join(by_signature(ix, signature).select("id"), "id", "left_semi")
    return ranked(ix, by_kind(rows, kind), limit)


def body_search(rows: DataFrame, q: str, literals: bool = False, path: str | None = None, limit: int = 50) -> DataFrame:
    """Rows with `body` that hold q, with the first line or string literal that does."""
    if path is not None:
        rows = rows.where(under(F.col("path"), path))
    if q == "*":
        return rows.where(F.col("visibility").isin(*PUBLIC) & F.col("body").isNotNull()).orderBy(*ORDER).limit(limit).select("id", "name", "path", F.lit("").alias("snippet"))
    snippet = string_literal_with(F.col("body"), q) if literals else first_line_with(F.col("body"), q)
    return rows.where(has(F.col("body"), q)).withColumn("snippet", snippet).where("snippet IS NOT NULL").orderBy(*ORDER).limit(limit).select("id", "name", "path", "snippet")


def topic_sections(docs: DataFrame, topic: str, before: int = 2, after: int = 4) -> DataFrame:
    """(id, section, first, last, text): lines around each mention, overlapping or touching windows merged."""
    lines = docs.select("id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    hits = lines.where(has(F.col("line"), topic)).select("id", F.greatest(F.col("pos") - before, F.lit(0)).alias("first"), (F.col("pos") + after).alias("last"))
    w = W.partitionBy("id").orderBy("first", "last")
    gap = F.col("first") > F.lag("last").over(w) + 1
    runs = hits.withColumn("section", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "section").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n")
    return spans.join(docs.select("id", "content"), "id").select("id", "section", "first", F.least("last", F.size(F.split("content", "\n")) - 1).alias("last"), text.alias("text"))


def did_you_mean(ix: CodeIndex, q: str, limit: int = 3) -> DataFrame:
    """Up to `limit` distinct qualified names: of the symbols that `resolve` finds, else the nearest by edit distance."""
    name = qualified(F.col("impl_type"), F.col("name"))
    found = resolve(ix, q).groupBy(name.alias("suggestion")).agg(F.min(F.struct(*ORDER)).alias("first")).orderBy("first").limit(limit).select("suggestion")
    return found if not found.isEmpty() else suggest(ix, q, limit).select(name.alias("suggestion"))
