"""A stored code index: Parquet tables of one snapshot after the other in a folder.

A snapshot is written to a folder of its own and counts only once its commit marker exists, which is
created last and never replaced, so readers see a whole index or the one before, and of two writers of
one snapshot one fails. Besides the tables of the model a snapshot holds `nodes` (symbols with path,
crate and repository) sorted by name, and the references with both ends filled in twice, sorted by
target and by source, so that questions about few symbols read few row groups and join nothing.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.adapter import BASE
from codeatlas.index import CodeIndex, derived_index
from codeatlas.plans.stage import shared_folder

TABLES = ("files", "symbols", "refs", "trait_impls", "crates", "crate_deps", "dependencies", "docs")


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed snapshots, oldest first."""
    fs, at = _file_system(spark, f"{path}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []


def write_index(ix: CodeIndex, path: str) -> int:
    """Writes a snapshot and commits it; crate_deps and trait_impls without repeats, references as they are."""
    spark = ix.spark
    version = (versions(spark, path) or [0])[-1] + 1
    folder = f"{path}/v{version}"
    parts = {t: getattr(ix, t) for t in TABLES}
    parts["crate_deps"] = ix.crate_deps.distinct()
    keys = ["type_name", "trait_name", "file_id"]
    parts["trait_impls"] = ix.trait_impls.groupBy(*keys).agg(F.min(F.struct("line_start", "line_end")).alias("at")).select(*keys, "at.line_start", "at.line_end")
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    read = lambda t: spark.read.parquet(f"{folder}/{t}")
    plain = CodeIndex(*(read(t) for t in TABLES))
    plain.nodes.repartitionByRange("name", "id").sortWithinPartitions("name", "id").write.mode("overwrite").parquet(f"{folder}/nodes")
    linked = CodeIndex(*(read(t) for t in TABLES), stored_nodes=read("nodes")).linked("dst")
    for side, other in (("dst", "src"), ("src", "dst")):
        linked.repartitionByRange(side, other, "ref_line").sortWithinPartitions(side).write.mode("overwrite").parquet(f"{folder}/by_{side}")
        linked = read(f"by_{side}")
    fs, marker = _file_system(spark, f"{path}/commits/{version}")
    fs.create(marker, False).close()
    return version


def open_index(spark: SparkSession, path: str, version: int | None = None) -> CodeIndex:
    """A committed snapshot, the latest unless told."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no index at {path}")
    folder = f"{path}/v{known[-1] if version is None else version}"
    read = lambda t: spark.read.parquet(f"{folder}/{t}")
    return CodeIndex(*(read(t) for t in TABLES), stored_nodes=read("nodes"), stored_links={s: read(f"by_{s}") for s in ("src", "dst")})


def without_files(ix: CodeIndex, paths: DataFrame) -> CodeIndex:
    """`ix` without the files of (path), their symbols and impls, and references from or to them."""
    gone = ix.files.join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    symbols = ix.symbols.join(gone, "file_id", "left_anti")
    lost = ix.symbols.join(gone, "file_id", "left_semi").select("id")
    refs = ix.refs.join(lost.toDF("source_symbol_id"), "source_symbol_id", "left_anti").join(lost.toDF("target_symbol_id"), "target_symbol_id", "left_anti")
    files = ix.files.join(paths.select("path"), "path", "left_anti")
    return CodeIndex(files, symbols, refs.select(ix.refs.columns), ix.trait_impls.join(gone, "file_id", "left_anti").select(ix.trait_impls.columns), ix.crates, ix.crate_deps, ix.dependencies, ix.docs)


def merged(ix: CodeIndex, part: CodeIndex) -> CodeIndex:
    """`ix` with the rows of `part`, which replace files of the same path and crates, dependencies and docs of the same id."""
    base = without_files(ix, part.files)
    out = {t: getattr(base, t).unionByName(getattr(part, t)) for t in TABLES}
    for t in ("crates", "dependencies", "docs"):
        out[t] = getattr(base, t).join(getattr(part, t).select("id"), "id", "left_anti").unionByName(getattr(part, t))
    return CodeIndex(**out)


_stored: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the tables' files."""
    state = []
    for t in BASE:
        fs, at = _file_system(spark, f"{sf_dir}/{t}.parquet")
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(state)))


def stored_index(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The index derived from the tables of `sf_dir`, written once per application and state of the tables."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir, _state(spark, sf_dir))
    if key not in _stored:
        path = f"{shared_folder(spark)}/codeatlas/index-{abs(hash(key)):x}"
        if not versions(spark, path):
            write_index(derived_index(spark, sf_dir), path)
        _stored[key] = path
    return open_index(spark, _stored[key])
