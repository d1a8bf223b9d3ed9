"""CodeIndex: the tables of a code index as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.adapter import BASE, VIEWS

#: Fixed value lists of the data model.
SYMBOL_KINDS = ("function", "struct", "enum", "enum_variant", "trait", "impl", "use", "mod", "const", "static", "type_alias", "macro", "union", "interface", "class")
VISIBILITIES = ("public", "pub(crate)", "restricted", "private")
#: What `linked` fills in for each end of an edge.
LINKED = ("name", "kind", "path", "line_start", "impl_type", "is_test", "repo")
REF_KINDS, CONFIDENCES = ("call", "type_ref"), ("high", "low")


@dataclass
class CodeIndex:
    """Tables of one or more repositories; `repo` tells them apart.

    symbols: id, file_id, name, kind, visibility, line_start, line_end, signature, doc_comment, attributes, impl_type, is_test
    refs: source_symbol_id, target_symbol_id, kind, confidence, ref_line (a multiset)
    """

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    trait_impls: DataFrame
    crates: DataFrame
    crate_deps: DataFrame
    dependencies: DataFrame
    docs: DataFrame
    stored_nodes: DataFrame | None = None
    stored_links: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def nodes(self) -> DataFrame:
        """Symbols with path, crate and repository."""
        if self.stored_nodes is not None:
            return self.stored_nodes
        files = self.files.select(F.col("id").alias("file_id"), "path", "crate_id")
        crates = self.crates.select(F.col("id").alias("crate_id"), "repo")
        return self.symbols.join(files, "file_id").join(crates, "crate_id")

    @cached_property
    def edges(self) -> DataFrame:
        return self.refs.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), F.col("kind").alias("ref_kind"), "confidence", "ref_line")

    def linked(self, side: str) -> DataFrame:
        """Edges with both ends filled in (src_name, dst_path, ...), for questions about ids of one side."""
        if side in self.stored_links:
            return self.stored_links[side]
        return self.edges.join(self.ends("src", *LINKED), "src").join(self.ends("dst", *LINKED), "dst")

    def ends(self, side: str, *columns: str) -> DataFrame:
        """Nodes renamed for one end of an edge: `src_name`, `src_path`, ... joined by `src`."""
        return self.nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def derived_index(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The index derived from the tables of `sf_dir`."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    sizes = {t: tables[t] for t in ("orders", "customer", "supplier")}
    out = {}
    for name, sql in VIEWS.items():
        used = {t: df for t, df in tables.items() if t in sql or t in sizes and f"FROM {t}" in sql}
        for t in sorted(used, key=len, reverse=True):
            sql = _bind(sql, t)
        out[name] = spark.sql(sql, **used)
    return CodeIndex(out["files"], out["symbols"], out["symbol_refs"], out["trait_impls"], out["crates"], out["crate_deps"], out["dependencies"], out["docs"])


def _bind(sql: str, name: str) -> str:
    """Puts a DataFrame parameter where `name` is a table, so that no session-wide view is made."""
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {name} ", f"{word} {{{name}}} ").replace(f"{word} {name})", f"{word} {{{name}}})")
        if sql.endswith(f"{word} {name}"):
            sql = sql[: -len(name)] + f"{{{name}}}"
    return sql
