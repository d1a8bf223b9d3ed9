"""Registered queries over the derived index, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.adapter import oracle
from codeatlas.index import CodeIndex
from codeatlas.operators import aggregates as A
from codeatlas.operators import audits as C
from codeatlas.operators import crossrepo as K
from codeatlas.operators import diffs as D
from codeatlas.operators import graph as G
from codeatlas.operators import joins as J
from codeatlas.operators import scoring as R
from codeatlas.operators import search as S
from codeatlas.operators import tools as T
from codeatlas.sources.scan import html_text
from codeatlas.store import stored_index, without_files
from codeatlas.streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, build: Callable[[CodeIndex], DataFrame], sql: str | None = None, recursive: str = "") -> None:
    QUERIES[key] = lambda spark, sf_dir: build(stored_index(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[key] = oracle(sql, recursive)


PUB = "visibility IN ('public', 'pub(crate)')"
SYM = "id, name, kind, visibility, path, line_start, line_end, signature, impl_type"

# Sources of the derived model
register("SRC_nodes", lambda ix: ix.nodes.select("id", "name", "kind", "path", "line_start", "line_end", "repo"), "SELECT id, name, kind, path, line_start, line_end, repo FROM nodes")
register("SNK2_trait_impls_distinct", lambda ix: ix.trait_impls.groupBy("type_name", "trait_name", "file_id").agg(F.min("line_start").alias("line_start")), "SELECT type_name, trait_name, file_id, min(line_start) AS line_start FROM trait_impls GROUP BY ALL")

# Predicates and projections
register("P2_attribute_search", lambda ix: J.by_text(ix, "attributes", "Derive(", None).select("id", "name", "attributes"), "SELECT id, name, attributes FROM nodes WHERE contains(lower(attributes), 'derive(')")
register("P2_doc_comment_search", lambda ix: J.by_text(ix, "doc_comment", "sym_42 ").select("id", "name", "path"), "SELECT id, name, path FROM nodes WHERE contains(lower(doc_comment), 'sym_42 ') ORDER BY name, path, line_start, id LIMIT 50")
register("P2_signature_search", lambda ix: J.by_text(ix, "signature", "result<type_7>").select("id", "name", "path"), "SELECT id, name, path FROM nodes WHERE contains(lower(signature), 'result<type_7>') ORDER BY name, path, line_start, id LIMIT 50")
register("P4_path_prefix", lambda ix: J.by_path(ix, "crates/NATION_6/src/"), f"SELECT {SYM} FROM nodes WHERE starts_with(lower(path), 'crates/nation_6/src/') AND {PUB}")
register("P6_kind_filter", lambda ix: J.by_kind(ix.nodes, "STRUCT").select("id", "name"), "SELECT id, name FROM nodes WHERE lower(kind) = 'struct'")
register("P8_entry_points", lambda ix: ix.nodes.where(J.is_entry_point(F.col("name"), F.col("attributes"))).select("id", "name"), "SELECT id, name FROM nodes WHERE name = 'main' OR list_contains(string_split(coalesce(attributes, ''), ', '), 'test')")
register("P11_whole_word", lambda ix: ix.nodes.where(C.whole_word(F.col("signature"), "Type_7")).select("id", "signature"), r"SELECT id, signature FROM nodes WHERE regexp_matches(signature, '(^|[^A-Za-z0-9_])Type_7($|[^A-Za-z0-9_])')")
register("P12_signature_match", lambda ix: J.by_signature(ix, "Result<Type_2>").select("id", "signature"), r"SELECT id, signature FROM nodes WHERE contains(signature, 'Result<Type_2>') OR regexp_matches(signature, 'Result<Type_2[,>]') OR list_has_any(regexp_split_to_array(signature, '[^A-Za-z0-9_]+'), ['x']) OR len(list_filter(regexp_split_to_array(signature, '[^A-Za-z0-9_]+'), lambda w: ends_with(w, 'Result') OR ends_with(w, 'Type_2'))) > 0")
register("P15_truncated_signatures", lambda ix: A.truncated_signatures(ix), "SELECT count(*) AS n FROM symbols WHERE ends_with(signature, '(') AND kind = 'function'")
register("P17_file_scope", lambda ix: S.query(ix, "F12", scope="files", path="crates/", limit=1000), "SELECT path FROM files WHERE contains(lower(path), 'f12') AND starts_with(path, 'crates/') ORDER BY path LIMIT 1000")
register("P17_file_scope_unlimited", lambda ix: S.query(ix, "F12", scope="files", path="crates/", limit=None), "SELECT path FROM files WHERE contains(lower(path), 'f12') AND starts_with(path, 'crates/') ORDER BY path")


def _doc_bodies(ix: CodeIndex) -> DataFrame:
    return ix.docs.select("id", F.lit("doc").alias("name"), "source", F.col("content").alias("body"), F.col("module").alias("path"), F.lit(0).alias("line_start"), F.lit("public").alias("visibility"))


register("P18_body_scope", lambda ix: S.body_search(_doc_bodies(ix), "license", limit=200).select("id", "snippet"), r"SELECT id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: contains(lower(x), 'license'))[1] AS snippet FROM docs WHERE contains(lower(content), 'license') ORDER BY module, id LIMIT 200")
register("P19_string_literals", lambda ix: S.body_search(_doc_bodies(ix), "a", literals=True, limit=200).select("id", "snippet"), r"""SELECT id, substr(list_filter(regexp_extract_all(content, '"((?:[^"\\]|\\.)+)"', 1), lambda x: contains(lower(x), 'a'))[1], 1, 100) AS snippet FROM docs WHERE contains(lower(content), 'a') AND len(list_filter(regexp_extract_all(content, '"((?:[^"\\]|\\.)+)"', 1), lambda x: contains(lower(x), 'a'))) > 0 ORDER BY module, id LIMIT 200""")

def _odd_names(ix: CodeIndex) -> CodeIndex:
    """The index with names that full text can't take."""
    return replace(ix, stored_nodes=ix.nodes.withColumn("name", F.concat(F.replace("name", F.lit("_"), F.lit("-")), F.lit("%"))))


# Full text
TOK = r"concat(' ', trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
register("F1_search_symbols", lambda ix: S.search_symbols(ix, "sym_12").select("id", "name", "path", "source"), f"""SELECT id, name, path, source FROM (SELECT *, CASE WHEN contains({TOK.format('name')}, ' sym 12') OR contains({TOK.format('signature')}, ' sym 12') OR contains({TOK.format('doc_comment')}, ' sym 12') THEN 0 WHEN contains(lower(name), 'sym_12') THEN 1 END AS source FROM nodes) WHERE source IS NOT NULL ORDER BY CASE WHEN name = 'sym_12' THEN 0 ELSE 1 END, source, name, path, line_start, id LIMIT 50""")
register("F2_short_query", lambda ix: S.search_symbols(ix, "ym_7").select("id", "name", "source"), f"""SELECT id, name, source FROM (SELECT *, CASE WHEN contains({TOK.format('name')}, ' ym 7') THEN 0 WHEN contains(lower(name), 'ym_7') THEN 1 END AS source FROM nodes) WHERE source IS NOT NULL ORDER BY source, name, path, line_start, id LIMIT 50""")
register("F3_unsafe_query", lambda ix: S.search_symbols(_odd_names(ix), "sym-1%").select("id", "name"), "SELECT id, replace(name, '_', '-') || '%' AS name FROM nodes WHERE contains(lower(replace(name, '_', '-') || '%'), 'sym-1%') ORDER BY CASE WHEN replace(name, '_', '-') || '%' = 'sym-1%' THEN 0 ELSE 1 END, 2, path, line_start, id LIMIT 50")
register("F5_search_docs", lambda ix: S.search_docs(ix, "the th").select("id", "dependency", "module"), f"SELECT d.id, p.name AS dependency, module FROM docs d JOIN dependencies p ON p.id = d.dependency_id WHERE contains({TOK.format('content')}, ' the th') ORDER BY p.name, module, d.id LIMIT 20")
register("F6_search_docs_content", lambda ix: S.search_docs_content(ix, "dep_3", "the").select("id", "module"), "SELECT d.id, module FROM docs d JOIN dependencies p ON p.id = d.dependency_id WHERE p.name = 'dep_3' AND contains(lower(content), 'the') ORDER BY module, d.id LIMIT 10")
register("F7_suggest", lambda ix: S.suggest(ix, "sim_421"), "SELECT name, impl_type, levenshtein(lower(name), 'sim_421') AS distance FROM (SELECT DISTINCT name, impl_type FROM nodes) WHERE levenshtein(lower(name), 'sim_421') <= 2 ORDER BY distance, name, impl_type NULLS FIRST LIMIT 3")
register("F8_resolve", lambda ix: S.resolve(ix, "sym_42").select("id", "name", "impl_type", "tier"), f"""SELECT id, name, impl_type, tier FROM (
 SELECT id, name, impl_type, 1 AS tier FROM nodes WHERE name = 'sym_42'
 UNION ALL SELECT id, name, impl_type, 2 FROM nodes WHERE contains(lower(name), 'sym_42')) QUALIFY tier = min(tier) OVER ()""")
register("F8_resolve_method", lambda ix: S.resolve(ix, "Type_0::sym_1169").select("id", "name", "impl_type", "tier"), "SELECT id, name, impl_type, 0 AS tier FROM nodes WHERE name = 'sym_1169' AND impl_type = 'Type_0'")
register("F9_did_you_mean", lambda ix: S.did_you_mean(ix, "sim_421"), "SELECT CASE WHEN impl_type IS NULL THEN name ELSE impl_type || '::' || name END AS suggestion FROM (SELECT DISTINCT name, impl_type FROM nodes) WHERE levenshtein(lower(name), 'sim_421') <= 2 ORDER BY levenshtein(lower(name), 'sim_421'), name, impl_type NULLS FIRST LIMIT 3")
register("F10_topic_sections", lambda ix: S.topic_sections(ix.docs, "token").select("id", "section", "first", "last"), """SELECT id, section, min(f) AS first, least(max(l), max(n) - 1) AS last FROM (
 SELECT *, sum(gap) OVER (PARTITION BY id ORDER BY f, l ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM (
  SELECT *, CASE WHEN f > lag(l) OVER (PARTITION BY id ORDER BY f, l) + 1 THEN 1 ELSE 0 END AS gap FROM (
   SELECT id, greatest(pos - 3, 0) AS f, pos + 3 AS l, n FROM (SELECT id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos, len(lines) AS n FROM (SELECT id, string_split(content, chr(10)) AS lines FROM docs)) WHERE contains(lower(line), 'token')))) GROUP BY id, section""")
DEGREE = "deg AS (SELECT t.name, t.path, count(DISTINCT src) AS refs FROM edges JOIN nodes t ON t.id = dst WHERE confidence = 'high' GROUP BY t.name, t.path)"
register("F11_ranked_query", lambda ix: S.query(ix, "*", path="crates/nation_7/", limit=20).select("id", "name", "refs"), f"""SELECT e.id, e.name, coalesce(refs, 0) AS refs FROM (SELECT * FROM nodes WHERE starts_with(lower(path), 'crates/nation_7/') AND {PUB} AND kind NOT IN ('use', 'mod', 'enum_variant') ORDER BY name, path, line_start, id LIMIT 80) e LEFT JOIN deg ON deg.name = e.name AND deg.path = e.path ORDER BY 3 DESC, e.name, e.path, e.line_start, e.id LIMIT 20""", DEGREE)

# Joins
register("J2_callees", lambda ix: J.callees(ix, "sym_42", _path_of(ix)), "SELECT DISTINCT t.name AS dst_name, t.kind AS dst_kind, t.path AS dst_path, t.line_start AS dst_line_start, t.impl_type AS dst_impl_type, ref_kind, ref_line FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.name = 'sym_42' AND s.path = (SELECT min(path) FROM nodes WHERE name = 'sym_42') AND confidence = 'high'")
register("J3_callers", lambda ix: J.callers(ix, "sym_42", _path_of(ix)), "SELECT DISTINCT s.name AS src_name, s.kind AS src_kind, s.path AS src_path, s.line_start AS src_line_start, s.impl_type AS src_impl_type, ref_kind, confidence, ref_line FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE t.name = 'sym_42' AND t.path = (SELECT min(path) FROM nodes WHERE name = 'sym_42')")
register("J4_callers_by_name", lambda ix: J.calls_by_name(ix, "sym_42", up=True), "SELECT DISTINCT s.name, s.path FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE t.name = 'sym_42' AND ref_kind = 'call' AND s.kind NOT IN ('const', 'static', 'enum_variant') AND t.kind NOT IN ('const', 'static', 'enum_variant')")
register("J4_callees_by_name", lambda ix: J.calls_by_name(ix, "sym_42", up=False, confidence="high"), "SELECT DISTINCT t.name, t.path FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.name = 'sym_42' AND ref_kind = 'call' AND confidence = 'high' AND s.kind NOT IN ('const', 'static', 'enum_variant') AND t.kind NOT IN ('const', 'static', 'enum_variant')")
register("J5_direct_callees", lambda ix: J.direct_callees(ix, "sym_7"), "SELECT DISTINCT t.name FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.name = 'sym_7' AND ref_kind = 'call' AND confidence = 'high' ORDER BY 1 LIMIT 100")
register("J6_file_symbol_counts", lambda ix: J.file_symbol_counts(ix, "crates/"), f"SELECT path, count(s.id) AS n FROM files f LEFT JOIN symbols s ON s.file_id = f.id AND {PUB} AND s.kind NOT IN ('use', 'mod', 'impl') WHERE starts_with(path, 'crates/') GROUP BY path")
UNREF = f"unref AS (SELECT * FROM nodes n WHERE {PUB} AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = n.id) AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes o ON o.id = e.dst WHERE e.confidence = 'high' AND o.name = n.name AND o.impl_type = n.impl_type))"
register("J7_unreferenced", lambda ix: J.unreferenced(ix).select("id", "name", "path"), "SELECT id, name, path FROM unref", UNREF)
register("C9_unused", lambda ix: J.unused(ix).select("id", "name", "path"), "SELECT id, name, path FROM unref WHERE name <> 'main' AND coalesce(attributes, '') <> 'test' AND kind NOT IN ('enum_variant', 'impl')", UNREF)
register("J9_dangling_refs", lambda ix: J.dangling_refs(replace(ix, symbols=ix.symbols.where("kind <> 'const'"))), "SELECT src, dst, ref_kind, confidence, ref_line FROM edges WHERE src NOT IN (SELECT id FROM symbols WHERE kind <> 'const') OR dst NOT IN (SELECT id FROM symbols WHERE kind <> 'const')")
register("J10_docs_by_module", lambda ix: J.docs_of(ix, "dep_3", "en").select("id", "version"), "SELECT d.id, p.version FROM docs d JOIN dependencies p ON p.id = d.dependency_id WHERE p.name = 'dep_3' AND module = 'en'")
register("J11_file_crates", lambda ix: J.crate_of_files(ix), "SELECT f.path, c.name AS crate FROM files f JOIN crates c ON c.id = f.crate_id")


register("J12_overlapping", lambda ix: J.overlapping(ix, ix.files.select("path", F.lit(30).cast("long").alias("start"), F.lit(95).cast("long").alias("end"))).select("id", "name", "path"), "SELECT min(n.id) AS id, n.name, n.path FROM nodes n JOIN files f ON f.id = n.file_id WHERE line_start <= 95 AND line_end >= 30 GROUP BY n.name, n.path, line_start")
register("J13_dependencies", lambda ix: J.resolved_dependencies(ix.dependencies.select("name", "version"), ix.docs.where("module = 'en'").select(F.concat(F.lit("dep_"), "dependency_id").alias("name"), F.col("source").alias("features")).distinct()), "SELECT p.name, version, f.features IS NOT NULL AS is_direct, f.features FROM dependencies p LEFT JOIN (SELECT DISTINCT dependency_id, source AS features FROM docs WHERE module = 'en') f ON p.name = 'dep_' || f.dependency_id")
register("J16_implementations_of_trait", lambda ix: J.implementations(ix, trait_name="trait_7"), "SELECT type_name, trait_name, path, line_start, line_end FROM trait_impls t JOIN files f ON f.id = t.file_id WHERE trait_name = 'trait_7' OR ends_with(trait_name, '::trait_7')")
register("C5_implementations_of_type", lambda ix: J.implementations(ix, type_name="Type_9"), "SELECT type_name, trait_name, path, line_start, line_end FROM trait_impls t JOIN files f ON f.id = t.file_id WHERE type_name = 'Type_9'")
register("J17_cross_refs", lambda ix: J.cross_refs(ix, "sym_42", 0), "SELECT DISTINCT s.name AS src_name, s.path AS src_path, s.line_start AS src_line_start, s.repo AS src_repo, ref_kind FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE t.name = 'sym_42' AND t.repo <> 0 AND confidence = 'high' ORDER BY 2, 3, 1, 5 LIMIT 50")
register("K6_symbol_exists", lambda ix: J.symbol_exists(ix, ix.spark.createDataFrame([("sym_1",), ("Type_3::sym_3",), ("nope",)], "name string")), "SELECT asked, CASE WHEN contains(asked, '::') THEN EXISTS (SELECT 1 FROM nodes WHERE name = split_part(asked, '::', 2) AND impl_type = split_part(asked, '::', 1)) ELSE EXISTS (SELECT 1 FROM nodes WHERE name = asked) END AS found FROM (VALUES ('sym_1'), ('Type_3::sym_3'), ('nope')) v(asked)")


def _path_of(ix: CodeIndex, name: str = "sym_42") -> str:
    return ix.nodes.where(F.col("name") == name).agg(F.min("path")).first()[0]


# Aggregates and rankings
register("A1_counts", A.counts, "SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'dependencies', count(*) FROM dependencies UNION ALL SELECT 'crates', count(*) FROM crates UNION ALL SELECT 'functions', count(*) FROM symbols WHERE kind = 'function'")
register("A2_refs_by_confidence", A.refs_by_confidence, "SELECT confidence, count(*) AS n, CAST(floor(count(*) * 100 / (SELECT count(*) FROM edges)) AS BIGINT) AS percent FROM edges GROUP BY confidence")
register("A3_noisy_targets", A.noisy_targets, "SELECT name, count(*) AS n FROM edges JOIN nodes ON id = dst WHERE confidence = 'low' GROUP BY name ORDER BY 2 DESC, 1 LIMIT 10")
register("A4_most_referenced", lambda ix: A.most_referenced(ix, 20, exclude_tests=True), "SELECT n.id, n.name, n.path, n.impl_type, count(DISTINCT src) AS n FROM edges JOIN nodes n ON n.id = dst JOIN symbols s ON s.id = src WHERE s.is_test = 0 GROUP BY n.id, n.name, n.path, n.impl_type ORDER BY 5 DESC, 2, 3, 1 LIMIT 20")
register("A5_most_referencing", lambda ix: A.most_referencing(ix, 20, confidence="high"), "SELECT n.id, n.name, n.path, count(DISTINCT dst) AS n FROM edges JOIN nodes n ON n.id = src WHERE confidence = 'high' GROUP BY n.id, n.name, n.path ORDER BY 4 DESC, 2, 3, 1 LIMIT 20")
register("A6_symbols_by_kind", lambda ix: A.symbols_by_kind(ix, "crates/nation_6"), "SELECT kind, count(*) AS n FROM nodes WHERE starts_with(path, 'crates/nation_6') GROUP BY kind")
register("A7_in_degree", A.in_degree, "SELECT name, path, refs AS n FROM deg", DEGREE)
register("A9_doc_coverage", A.doc_coverage, f"SELECT kind, count(*) AS total, count(doc_comment) AS documented, CAST(floor(count(doc_comment) * 100 / count(*)) AS BIGINT) AS percent FROM nodes WHERE {PUB} AND kind NOT IN ('use', 'mod', 'impl', 'enum_variant') GROUP BY kind")
register("A14_boundary", lambda ix: A.boundary(ix, "crates/nation_6/"), f"""SELECT m.id, m.name, m.path, m.kind, count(o.name) AS sites, count(DISTINCT o.path) AS files, coalesce(array_to_string(list_sort(list(DISTINCT o.path) FILTER (o.path IS NOT NULL))[1:3], ','), '') AS first_files, CASE WHEN count(o.name) > 0 THEN 'external' ELSE 'internal' END AS use
 FROM (SELECT * FROM nodes WHERE starts_with(path, 'crates/nation_6/') AND {PUB} AND kind NOT IN ('use', 'mod', 'impl')) m LEFT JOIN (SELECT DISTINCT dst, s.name, s.path FROM edges JOIN nodes s ON s.id = src WHERE NOT starts_with(s.path, 'crates/nation_6/')) o ON o.dst = m.id GROUP BY m.id, m.name, m.path, m.kind""")
register("A16_distinct_names", lambda ix: ix.nodes.select("name", "impl_type").distinct(), "SELECT DISTINCT name, impl_type FROM nodes")
register("T1_largest_functions", lambda ix: A.largest_functions(ix, 15), "SELECT id, name, path, line_end - line_start + 1 AS n FROM nodes WHERE kind = 'function' ORDER BY 4 DESC, 2, 3, 1 LIMIT 15")
register("T2_overview", lambda ix: A.overview(ix, "crates/nation_6/src/", 150).select("id", "path"), f"""SELECT id, path FROM (SELECT *, CASE WHEN 150 >= n_rows THEN size WHEN n_files >= 150 THEN CASE WHEN f_rank <= 150 THEN 1 ELSE 0 END ELSE least(size, 1 + ((size - 1) * (150 - n_files)) // greatest(n_rows - n_files, 1)) END AS budget FROM (
 SELECT id, path, row_number() OVER (PARTITION BY path ORDER BY line_start, id) AS rank, count(*) OVER (PARTITION BY path) AS size, count(*) OVER () AS n_rows, dense_rank() OVER (ORDER BY path) AS f_rank, (SELECT count(DISTINCT path) FROM nodes WHERE starts_with(path, 'crates/nation_6/src/') AND {PUB} AND kind NOT IN ('mod', 'use', 'enum_variant')) AS n_files
 FROM nodes WHERE starts_with(path, 'crates/nation_6/src/') AND {PUB} AND kind NOT IN ('mod', 'use', 'enum_variant'))) WHERE rank <= budget""")
register("T7_hotspots", lambda ix: A.hotspots(ix, 5), """SELECT * FROM (SELECT 'referenced' AS section, n.name, n.path, count(DISTINCT src) AS n FROM edges JOIN nodes n ON n.id = dst WHERE confidence = 'high' GROUP BY n.id, n.name, n.path ORDER BY 4 DESC, 2, 3, n.id LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'referencing', n.name, n.path, count(DISTINCT dst) FROM edges JOIN nodes n ON n.id = src WHERE confidence = 'high' GROUP BY n.id, n.name, n.path ORDER BY 4 DESC, 2, 3, n.id LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'largest', name, path, line_end - line_start + 1 FROM nodes WHERE kind = 'function' ORDER BY 4 DESC, 2, 3, id LIMIT 5)""")
register("C13_health", A.health, "SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'dependencies', count(*) FROM dependencies UNION ALL SELECT 'crates', count(*) FROM crates UNION ALL SELECT 'functions', count(*) FROM symbols WHERE kind = 'function' UNION ALL SELECT 'refs_' || confidence, count(*) FROM edges GROUP BY confidence UNION ALL SELECT 'truncated_signatures', count(*) FROM symbols WHERE ends_with(signature, '(') AND kind = 'function'")

# Graph walks
WALK = "walk AS (SELECT id, name, path, 0 AS depth, name AS via, is_test FROM nodes WHERE name = 'sym_42' UNION SELECT s.id, s.name, s.path, w.depth + 1, w.via || ' -> ' || s.name, s.is_test FROM walk w JOIN edges e ON e.dst = w.id AND e.confidence = 'high' JOIN nodes s ON s.id = e.src WHERE w.depth < {})"
register("G1_impact", lambda ix: G.impact(ix, "sym_42", depth=3), "SELECT DISTINCT name, path, depth, via, is_test FROM walk WHERE depth > 0 ORDER BY depth, name, path, via, is_test LIMIT 100", WALK.format(3))
register("G2_related_tests", lambda ix: G.related_tests(ix, G.seeds(ix, "sym_42").select(F.lit(0).alias("seed"), "id")).drop("seed"), "SELECT DISTINCT n.name, n.path, n.line_start FROM walk w JOIN nodes n ON n.id = w.id WHERE w.depth > 0 AND n.is_test = 1", WALK.format(5))
DEPS = "up AS (SELECT target_crate_id AS id, 0 AS depth FROM crate_deps WHERE target_crate_id = 3 UNION SELECT d.source_crate_id, u.depth + 1 FROM up u JOIN crate_deps d ON d.target_crate_id = u.id WHERE u.depth < 10)"
register("G3_crate_dependents", lambda ix: G.crate_dependents(ix, "nation_3"), "SELECT DISTINCT c.id, c.name, c.path FROM up JOIN crates c USING (id) WHERE c.id <> 3", DEPS)
register("G4_direct_crate_dependents", lambda ix: G.crate_dependents(ix, "nation_3", transitive=False), "SELECT DISTINCT c.id, c.name, c.path FROM crate_deps d JOIN crates c ON c.id = d.source_crate_id WHERE d.target_crate_id = 3")
SURE = "sure AS (SELECT DISTINCT s.name || chr(1) || s.path AS a, t.name || chr(1) || t.path AS b, t.name AS bn, s.name AS an FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE confidence = 'high')"
SHORTEST = f"""{SURE}, fw AS (SELECT DISTINCT name || chr(1) || path AS b, 0 AS depth FROM nodes WHERE name = 'sym_4' UNION SELECT e.b, f.depth + 1 FROM fw f JOIN sure e ON e.a = f.b WHERE f.depth < 10),
 dist AS (SELECT b, min(depth) AS depth FROM fw GROUP BY b), goal AS (SELECT b, depth FROM dist WHERE split_part(b, chr(1), 1) = 'sym_2500' ORDER BY depth, b LIMIT 1),
 back AS (SELECT b, depth FROM goal UNION ALL SELECT p.a, p.depth FROM (SELECT k.b AS at, min(e.a) AS a, k.depth - 1 AS depth FROM dist k JOIN sure e ON e.b = k.b JOIN dist j ON j.b = e.a AND j.depth = k.depth - 1 GROUP BY k.b, k.depth) p JOIN back ON back.b = p.at)"""
register("G5_call_path", lambda ix: G.call_path(ix, "sym_4", "sym_2500"), "SELECT CAST(depth AS INT) AS step, split_part(b, chr(1), 1) AS name, split_part(b, chr(1), 2) AS path FROM back", SHORTEST)
WALKS = f"""{SURE}, bk AS (SELECT DISTINCT name || chr(1) || path AS node, 0 AS d FROM nodes WHERE name = 'sym_2500' UNION SELECT e.a, k.d + 1 FROM bk k JOIN sure e ON e.b = k.node WHERE k.d < 7 AND e.an <> 'sym_2500'), near AS (SELECT node, min(d) AS d FROM bk GROUP BY node),
 wk AS (SELECT DISTINCT name || chr(1) || path AS at, [name || chr(1) || path] AS walk, name AS via, 0 AS hops, false AS hit FROM nodes WHERE name = 'sym_4' UNION ALL SELECT e.b, list_append(w.walk, e.b), w.via || ' -> ' || e.bn, w.hops + 1, e.bn = 'sym_2500' FROM wk w JOIN sure e ON e.a = w.at JOIN near n ON n.node = e.b AND n.d <= 7 - w.hops - 1 WHERE NOT w.hit AND w.hops < 7 AND NOT list_contains(w.walk, e.b))"""
register("G6_all_paths", lambda ix: G.all_paths(ix, "sym_4", "sym_2500", depth=7), "SELECT CAST(hops AS INT) AS hops, via FROM wk WHERE hit ORDER BY hops, via, array_to_string(walk, ',') LIMIT 5", WALKS)
TREE = """tr AS (SELECT ['sym_42'] AS branch, 'sym_42' AS at, 0 AS depth, true AS open UNION SELECT list_append(b.branch, n.t), n.t, b.depth + 1, NOT list_contains(b.branch, n.t) FROM tr b JOIN (SELECT DISTINCT s.name AS s, t.name AS t FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE ref_kind = 'call' AND confidence = 'high' AND s.kind NOT IN ('const', 'static', 'enum_variant') AND t.kind NOT IN ('const', 'static', 'enum_variant') AND s.name <> t.name) n ON n.s = b.at WHERE b.open AND b.depth < 2)"""
register("G8_call_tree", lambda ix: G.call_tree(ix, "sym_42"), "SELECT CAST(depth AS INT) AS depth, array_to_string(branch, ' > ') AS branch FROM tr", TREE)
NEIGH = """dn AS (SELECT DISTINCT s.name AS a, t.name AS b FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE ref_kind = 'call' AND confidence = 'high' AND s.kind NOT IN ('const', 'static') AND t.kind NOT IN ('const', 'static')),
 nb AS (SELECT 'down' AS direction, 'sym_42' AS name, 0 AS depth UNION ALL SELECT 'up', 'sym_42', 0 UNION SELECT direction, CASE WHEN direction = 'down' THEN b ELSE a END, depth + 1 FROM nb JOIN dn ON (direction = 'down' AND a = name) OR (direction = 'up' AND b = name) WHERE depth < 2)"""
register("G7_neighborhood", lambda ix: G.neighborhood(ix, "sym_42"), "SELECT direction, name, min(depth) AS depth FROM nb WHERE name <> 'sym_42' GROUP BY direction, name", NEIGH)
NAMES = "dn AS (SELECT DISTINCT s.name AS a, t.name AS b FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE ref_kind = 'call' AND confidence = 'high'), fr AS (SELECT 'sym_42' AS name, 0 AS depth UNION SELECT b, depth + 1 FROM fr JOIN dn ON a = name WHERE depth < 1), fm AS (SELECT name, min(depth) AS depth FROM fr GROUP BY name)"
register("G9_graph_export", lambda ix: G.graph_export(ix, "sym_42"), "SELECT a AS source, b AS target, depth FROM fm JOIN dn ON a = name", NAMES)
register("G9_graph_summary", lambda ix: G.graph_summary(G.graph_export(ix, "sym_42")), "SELECT 'edges' AS what, count(*) AS n FROM (SELECT DISTINCT a, b FROM fm JOIN dn ON a = name) UNION ALL SELECT 'nodes', count(*) FROM (SELECT a FROM fm JOIN dn ON a = name UNION SELECT b FROM fm JOIN dn ON a = name) UNION ALL SELECT 'roots', count(*) FROM (SELECT a FROM fm JOIN dn ON a = name EXCEPT SELECT b FROM fm JOIN dn ON a = name) UNION ALL SELECT 'leaves', count(*) FROM (SELECT b FROM fm JOIN dn ON a = name EXCEPT SELECT a FROM fm JOIN dn ON a = name)", NAMES)
FILEDEP = "SELECT DISTINCT s.path AS source, t.path AS target FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE confidence = 'high' AND starts_with(s.path, 'crates/nation_6/') AND s.path <> t.path"
register("G11_file_dependencies", lambda ix: G.file_dependencies(ix, "crates/nation_6/"), FILEDEP)
register("G10_file_graph_dot", lambda ix: G.dot(G.file_dependencies(ix, "crates/nation_6/"), "crates/nation_6/"), f"""SELECT DISTINCT '  "' || substr(source, 17) || '" -> "' || CASE WHEN starts_with(target, 'crates/nation_6/') THEN substr(target, 17) ELSE target END || '";' AS line FROM ({FILEDEP})""")
register("G12_crate_graph", G.crate_graph, "SELECT c.name, coalesce(string_agg(DISTINCT t.name, ',' ORDER BY t.name), '') AS depends_on, c.id NOT IN (SELECT target_crate_id FROM crate_deps) AS is_root, count(t.name) = 0 AS is_leaf FROM crates c LEFT JOIN crate_deps d ON d.source_crate_id = c.id LEFT JOIN crates t ON t.id = d.target_crate_id GROUP BY c.id, c.name")
register("G13_crate_impact", lambda ix: G.crate_impact(ix, "sym_42"), "SELECT c.name AS crate, c.path, CASE WHEN min(depth) = 0 THEN 'defines' ELSE 'depends' END AS role FROM up JOIN crates c USING (id) GROUP BY c.name, c.path", "up AS (SELECT DISTINCT crate_id AS id, 0 AS depth FROM nodes WHERE name = 'sym_42' UNION SELECT d.source_crate_id, u.depth + 1 FROM up u JOIN crate_deps d ON d.target_crate_id = u.id WHERE u.depth < 10)")
register("G14_impact_summary", lambda ix: G.impact_summary(G.impact(ix, "sym_42", depth=3, limit=None)), "SELECT depth, path, count(DISTINCT name) AS names, CAST(sum(is_test) AS BIGINT) AS tests FROM (SELECT DISTINCT name, path, depth, via, is_test FROM walk WHERE depth > 0) GROUP BY depth, path", WALK.format(3))
register("G15_test_impact", lambda ix: G.related_tests(ix, G.seeds(ix, "sym_7").unionByName(G.seeds(ix, "sym_8")).select(F.col("id").alias("seed"), "id"), 3), "SELECT DISTINCT seed, n.name, n.path, n.line_start FROM tw JOIN nodes n USING (id) WHERE depth > 0 AND n.is_test = 1", "tw AS (SELECT id AS seed, id, 0 AS depth FROM nodes WHERE name IN ('sym_7', 'sym_8') UNION SELECT w.seed, e.src, w.depth + 1 FROM tw w JOIN edges e ON e.dst = w.id AND e.confidence = 'high' WHERE w.depth < 3)")
TESTED = "te AS (SELECT e.dst AS id, 1 AS depth FROM symbols s JOIN edges e ON e.src = s.id AND e.confidence = 'high' WHERE s.is_test = 1 UNION SELECT e.dst, t.depth + 1 FROM te t JOIN edges e ON e.src = t.id AND e.confidence = 'high' WHERE t.depth < 5), hit AS (SELECT DISTINCT n.name, n.impl_type FROM te JOIN nodes n USING (id)), ok AS (SELECT id FROM nodes n WHERE EXISTS (SELECT 1 FROM hit h WHERE h.name = n.name AND (n.impl_type IS NULL OR h.impl_type = n.impl_type)))"
register("A11_untested", lambda ix: G.untested(ix).select("id", "name", "path"), "SELECT id, name, path FROM nodes WHERE kind = 'function' AND is_test = 0 AND id NOT IN (SELECT id FROM ok)", TESTED)
register("A10_stats", lambda ix: A.stats(ix, "crates/", G.tested_ids(ix)), "SELECT 'kind_' || kind AS what, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'tests', count(*) FROM nodes WHERE is_test = 1 UNION ALL SELECT 'tested_percent', CAST(floor(count(*) FILTER (id IN (SELECT id FROM ok)) * 100 / count(*)) AS BIGINT) FROM nodes WHERE kind = 'function' AND is_test = 0", TESTED)
register("C10_orphaned", lambda ix: C.orphaned(ix).select("id", "name"), "SELECT id, name FROM unref WHERE name <> 'main' AND coalesce(attributes, '') <> 'test' AND id NOT IN (SELECT id FROM ok)", f"{UNREF}, {TESTED}")

# Composite analyses
SITES = "SELECT DISTINCT s.name, s.path, coalesce(ref_line, s.line_start) AS line, s.is_test FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE t.name = 'sym_42'"
register("C6_references", lambda ix: C.references(ix, "sym_42"), f"""SELECT 'definition' AS section, name, path, line_start AS line FROM nodes WHERE name = 'sym_42' UNION ALL SELECT CASE WHEN is_test = 1 THEN 'test_call' ELSE 'call' END, name, path, line FROM ({SITES})
 UNION ALL SELECT 'signature', name, path, line_start FROM nodes WHERE regexp_matches(signature, '(^|[^A-Za-z0-9_])sym_42($|[^A-Za-z0-9_])') AND name <> 'sym_42'""")
register("C7_type_usage", lambda ix: C.type_usage(ix, "Type_7"), """SELECT 'returns' AS section, name, path, line_start AS line FROM nodes WHERE kind = 'function' AND regexp_matches(split_part(signature, '->', 2), '(^|[^A-Za-z0-9_])Type_7($|[^A-Za-z0-9_])')
 UNION ALL SELECT 'accepts', name, path, line_start FROM nodes WHERE kind = 'function' AND regexp_matches(split_part(signature, '->', 1), '(^|[^A-Za-z0-9_])Type_7($|[^A-Za-z0-9_])')""")
register("A13_compact_usage", lambda ix: C.compact_usage(C.type_usage(ix, "Type_7")), """SELECT section, path, count(*) AS n FROM (SELECT 'returns' AS section, path FROM nodes WHERE kind = 'function' AND regexp_matches(split_part(signature, '->', 2), '(^|[^A-Za-z0-9_])Type_7($|[^A-Za-z0-9_])')
 UNION ALL SELECT 'accepts', path FROM nodes WHERE kind = 'function' AND regexp_matches(split_part(signature, '->', 1), '(^|[^A-Za-z0-9_])Type_7($|[^A-Za-z0-9_])')) GROUP BY section, path""")
register("C8_rename_plan", lambda ix: C.rename_plan(ix, "sym_42"), f"""SELECT 'definitions' AS section, count(*) AS n FROM nodes WHERE name = 'sym_42' UNION ALL SELECT 'call_sites', count(*) FROM (SELECT DISTINCT name, path FROM ({SITES})) UNION ALL SELECT 'signatures', count(*) FROM nodes WHERE contains(lower(signature), 'sym_42') AND name <> 'sym_42'
 UNION ALL SELECT 'trait_impls', count(*) FROM trait_impls WHERE type_name = 'sym_42' OR trait_name = 'sym_42' OR ends_with(trait_name, '::sym_42') UNION ALL SELECT 'doc_mentions', count(*) FROM nodes WHERE contains(lower(doc_comment), 'sym_42')""")
register("C12_similar", lambda ix: C.similar(ix, 45), """SELECT id, name, path, CAST(score AS BIGINT) AS score FROM (
 SELECT n.id, n.name, n.path, CASE WHEN contains(n.signature, core) THEN 2 ELSE 0 END + CASE WHEN contains(regexp_extract(n.signature, '\\((.*)\\)', 1), param) THEN 1 ELSE 0 END + coalesce(shared, 0) AS score
 FROM nodes n, (SELECT id AS me, path AS p, kind AS k, regexp_extract(split_part(signature, '->', 2), 'Type_[0-9]+') AS core, regexp_extract(split_part(signature, '->', 1), 'Type_[0-9]+') AS param FROM nodes WHERE id = 45) m
 LEFT JOIN (SELECT s, count(DISTINCT t) AS shared FROM nm WHERE t IN (SELECT t FROM nm WHERE s = 'sym_45') GROUP BY s) h ON h.s = n.name
 WHERE n.id <> 45 AND ((n.path = p AND n.kind = k) OR contains(n.signature, core) OR contains(n.signature, param))) WHERE score >= 2 ORDER BY score DESC, name, path, id LIMIT 10""",
 "nm AS (SELECT DISTINCT s.name AS s, t.name AS t FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE ref_kind = 'call' AND s.kind NOT IN ('const', 'static', 'enum_variant') AND t.kind NOT IN ('const', 'static', 'enum_variant'))")
register("C1_context", lambda ix: C.context(ix, "sym_42"), f"""SELECT 'caller' AS section, name, path, line FROM (SELECT * FROM ({SITES}) ORDER BY is_test, path, line, name LIMIT 30)
 UNION ALL SELECT DISTINCT 'callee', t.name, t.path, t.line_start FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.name = 'sym_42' AND confidence = 'high'
 UNION ALL SELECT 'trait', trait_name, path, line_start FROM trait_impls i JOIN files f ON f.id = i.file_id WHERE type_name IN (SELECT impl_type FROM nodes WHERE name = 'sym_42')
 UNION ALL SELECT 'related', name, path, line_start FROM (SELECT * FROM nodes n WHERE name <> 'sym_42' AND EXISTS (SELECT 1 FROM nodes m WHERE m.name = 'sym_42' AND m.path = n.path AND coalesce(m.impl_type, '') = coalesce(n.impl_type, '')) ORDER BY path, line_start, id LIMIT 10)
 UNION ALL SELECT DISTINCT 'test', n.name, n.path, n.line_start FROM walk w JOIN nodes n ON n.id = w.id WHERE w.depth > 0 AND n.is_test = 1""", WALK.format(5))
register("C3_tree", lambda ix: T.tree(ix, "crates/nation_6/"), f"SELECT path, count(s.id) AS n FROM files f LEFT JOIN symbols s ON s.file_id = f.id AND {PUB} AND s.kind NOT IN ('use', 'mod', 'impl') WHERE starts_with(path, 'crates/nation_6/') GROUP BY path")
register("A8_tree_totals", lambda ix: T.tree_totals(ix, "crates/nation_6/"), f"SELECT count(DISTINCT path) AS files, count(s.id) AS symbols FROM files f LEFT JOIN symbols s ON s.file_id = f.id AND {PUB} AND s.kind NOT IN ('use', 'mod', 'impl') WHERE starts_with(path, 'crates/nation_6/')")
register("C4_symbols_at", lambda ix: T.symbols_at(ix, _path_of(ix), 50), "SELECT min(id) AS id, name, any_value(impl_type) AS impl_type, any_value(kind) AS kind, line_start, any_value(line_end) AS line_end, any_value(signature) AS signature, any_value(doc_comment) AS doc FROM nodes WHERE path = (SELECT min(path) FROM nodes WHERE name = 'sym_42') AND line_start <= 50 AND line_end >= 50 GROUP BY name, path, line_start")
register("C2_overview_calls", lambda ix: T.overview_calls(ix, "crates/nation_6/src/"), f"""SELECT id, section, array_to_string(CASE WHEN section = 'callers' THEN names[1:3] ELSE names END, ',') AS names FROM (SELECT id, section, list_sort(list(DISTINCT name)) AS names FROM (
 SELECT CASE WHEN s.path = t.path THEN s.id ELSE t.id END AS id, CASE WHEN s.path = t.path THEN 'same_file' ELSE 'callers' END AS section, CASE WHEN s.path = t.path THEN t.name ELSE s.name END AS name FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE ref_kind = 'call' AND s.kind NOT IN ('const', 'static', 'enum_variant') AND t.kind NOT IN ('const', 'static', 'enum_variant'))
 WHERE id IN (SELECT id FROM nodes WHERE starts_with(path, 'crates/nation_6/src/') AND {PUB} AND kind NOT IN ('mod', 'use', 'enum_variant')) GROUP BY id, section)""")


def _changes(ix: CodeIndex) -> DataFrame:
    """A diff of one file, as the ranges it touches."""
    path = _path_of(ix)
    diff = f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,3 +1,90 @@ fn\n+x\n@@ -200 +180,40 @@\n+y\n"
    return D.hunk_ranges(ix.spark.createDataFrame([(1, diff)], "id long, text string")).select("path", "start", "end")


CHANGED = "ch AS (SELECT min(id) AS id, name, path, line_start FROM nodes WHERE path = (SELECT min(path) FROM nodes WHERE name = 'sym_42') AND ((line_start <= 90 AND line_end >= 1) OR (line_start <= 219 AND line_end >= 180)) GROUP BY name, path, line_start), lv AS (SELECT id AS seed, id, 0 AS depth FROM ch UNION SELECT w.seed, e.src, w.depth + 1 FROM lv w JOIN edges e ON e.dst = w.id AND e.confidence = 'high' WHERE w.depth < 4)"
register("C14_diff_impact", lambda ix: T.diff_impact(ix, _changes(ix), depth=4), """SELECT 'changed' AS section, name, path, line_start AS n FROM ch
 UNION ALL SELECT DISTINCT 'downstream', name, path, CAST(depth AS BIGINT) FROM lv JOIN nodes USING (id) WHERE depth > 0
 UNION ALL SELECT 'untested', n.name, n.path, n.line_start FROM ch JOIN nodes n USING (id) WHERE n.kind = 'function' AND n.is_test = 0 AND ch.id NOT IN (SELECT seed FROM lv JOIN nodes t ON t.id = lv.id AND t.is_test = 1 WHERE depth > 0 AND lv.id <> lv.seed)
 UNION ALL SELECT DISTINCT 'test', t.name, t.path, t.line_start FROM lv JOIN nodes t ON t.id = lv.id AND t.is_test = 1 WHERE depth > 0 AND lv.id <> lv.seed""", CHANGED)
register("C19_repositories", C.repositories, "SELECT repo, count(DISTINCT crate_id) AS crates, count(DISTINCT file_id) AS files, count(*) AS symbols, CAST(sum(is_test) AS BIGINT) AS tests FROM nodes GROUP BY repo")

# Several repositories: regions stand for repositories
register("K2_cross_query", lambda ix: K.cross_query(ix, "sym_42", 0), "SELECT repo, name, path, line_start FROM nodes WHERE repo <> 0 AND contains(name, 'sym_42') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN name = 'sym_42' THEN 0 ELSE 1 END, name, path, line_start, id) <= 5")
register("K3_cross_impact", lambda ix: K.cross_impact(ix, "sym_42", 0, "db: &type"), "SELECT repo, name, path, line_start FROM nodes WHERE repo <> 0 AND name = 'sym_42' AND contains(lower(signature), 'db: &type')")
register("A15_shared_dependencies", lambda ix: K.shared_dependencies(ix.nodes.where("impl_type IS NOT NULL").select("repo", F.col("impl_type").alias("name"))), "SELECT impl_type AS name, count(DISTINCT repo) AS repos FROM nodes WHERE impl_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo) >= 2 ORDER BY 2 DESC, 1 LIMIT 30")
register("K5_bridges", lambda ix: K.bridges(ix, "sym_1020", "sym_100", 0, 1), "SELECT DISTINCT t.name FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.name = 'sym_1020' AND s.repo = 0 AND t.repo = 0 AND ref_kind = 'call' AND confidence = 'high' AND t.name IN (SELECT name FROM nodes WHERE repo = 1) AND EXISTS (SELECT 1 FROM nodes WHERE repo = 1 AND name = 'sym_100')")

# The stored index
register("SNK1_stored_symbols", lambda ix: ix.symbols.select("id", "file_id", "name", "kind", "is_test"), "SELECT id, file_id, name, kind, is_test FROM symbols")
register("SNK4_stored_refs", lambda ix: ix.linked("src").groupBy("src", "dst", "ref_kind", "confidence", "ref_line", "src_name", "dst_path").agg(F.count("*").alias("n")), "SELECT src, dst, ref_kind, confidence, ref_line, s.name AS src_name, t.path AS dst_path, count(*) AS n FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst GROUP BY ALL")
register("SNK6_without_a_folder", lambda ix: A.counts(without_files(ix, ix.files.where(F.startswith("path", F.lit("crates/nation_6/"))).select("path"))).unionByName(without_files(ix, ix.files.where(F.startswith("path", F.lit("crates/nation_6/"))).select("path")).refs.agg(F.count("*").alias("n")).select(F.lit("refs").alias("what"), "n")), """SELECT 'files' AS what, count(*) AS n FROM files WHERE NOT starts_with(path, 'crates/nation_6/') UNION ALL SELECT 'symbols', count(*) FROM nodes WHERE NOT starts_with(path, 'crates/nation_6/') UNION ALL SELECT 'dependencies', count(*) FROM dependencies UNION ALL SELECT 'crates', count(*) FROM crates
 UNION ALL SELECT 'functions', count(*) FROM nodes WHERE kind = 'function' AND NOT starts_with(path, 'crates/nation_6/') UNION ALL SELECT 'refs', count(*) FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE NOT starts_with(s.path, 'crates/nation_6/') AND NOT starts_with(t.path, 'crates/nation_6/')""")


# Texts of diffs, pages and rules, made from the tables
def _diffs(ix: CodeIndex) -> DataFrame:
    """A diff per crate: crate 0 has none, odd crates touch Rust files, every third has unsafe code, every fourth unwraps."""
    c = F.col("id")
    suffix = F.when(c % 2 == 1, ".rs").otherwise(".py")
    body = F.concat(F.lit("+pub fn added() {\n"), F.when(c % 3 == 0, "+    unsafe { go() }\n").otherwise(""), F.when(c % 4 == 3, "+    x.unwrap();\n").otherwise(""), F.lit("+}\n"))
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/"), "name", suffix, F.lit("\n@@ -1,2 +"), (c + 1).cast("string"), F.lit(",7 @@ fn\n"), body)
    return ix.crates.select("id", F.when(c == 0, "").otherwise(text).alias("text"))


register("D1_hunk_ranges", lambda ix: D.hunk_ranges(_diffs(ix)), "SELECT id, name || CASE WHEN id % 2 = 1 THEN '.rs' ELSE '.py' END AS path, id + 1 AS start, id + 7 AS end FROM crates WHERE id > 0")
register("D4_critique", lambda ix: D.critique(_diffs(ix)), "SELECT id, name || '.rs' AS path, id + 2 AS line_no, 'unsafe_without_safety_comment' AS rule, 'warning' AS severity FROM crates WHERE id % 2 = 1 AND id % 3 = 0")
register("D5_gate_scan", lambda ix: D.gate_scan(_diffs(ix)), "SELECT id, id = 0 AS empty, CASE WHEN id > 0 THEN 1 ELSE 0 END::BIGINT AS files, (id % 2)::BIGINT AS rust_files, (id % 2)::BIGINT AS public_items, CASE WHEN id % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS unwraps, CASE WHEN id % 2 = 1 AND id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS unsafe_uses FROM crates")


def _requests(ix: CodeIndex) -> DataFrame:
    c = F.col("id")
    given = lambda k, yes: F.when(c % k < k - 1, yes).otherwise("none")
    return ix.crates.select(
        "id", F.when(c % 5 == 0, "a speedup").otherwise("a change").alias("task"), given(6, "a plan").alias("plan"), given(7, "std docs").alias("docs_verified"), given(3, "impact").alias("impact_checked"),
        given(8, "tests").alias("tests_run"), F.when(c % 10 == 0, "measured").alias("performance_evidence"), F.when(c % 9 == 0, "checked").alias("safety_notes"),
    )


register("C18_quality_gate", lambda ix: D.quality_gate(_requests(ix), D.gate_scan(_diffs(ix))), """SELECT id, CASE WHEN len(b) > 0 THEN 'BLOCKED' WHEN len(w) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, array_to_string(list_concat(b, w), '; ') AS reasons FROM (SELECT id, list_filter([
 CASE WHEN id % 2 = 1 AND id % 6 = 5 THEN 'no plan' END, CASE WHEN id % 2 = 1 AND id % 7 = 6 THEN 'no docs verified' END, CASE WHEN id % 2 = 1 AND id % 8 = 7 THEN 'no tests run' END, CASE WHEN id % 4 = 3 THEN 'unwrap outside tests' END,
 CASE WHEN id % 2 = 1 AND id % 3 = 0 AND id % 9 <> 0 THEN 'unsafe without safety notes' END, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'performance claim without evidence' END], lambda x: x IS NOT NULL) AS b,
 list_filter([CASE WHEN id % 2 = 1 AND id % 3 = 2 THEN 'public items without impact check' END, CASE WHEN id = 0 THEN 'no changes' END], lambda x: x IS NOT NULL) AS w FROM crates)""")


def _rules(ix: CodeIndex) -> DataFrame:
    triggers = F.when(F.col("id") % 4 != 3, F.array(F.lit("Error"), F.concat(F.lit("error handling "), "name")))
    return ix.crates.select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "Error").otherwise("style").alias("category"), triggers.alias("triggers"), F.concat(F.lit("errors of "), "name").alias("summary"))


register("R1_score_rules", lambda ix: R.score_rules(_rules(ix), "error").select("pos", "score"), "SELECT id AS pos, CAST(2 + CASE WHEN id % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN id % 4 <> 3 THEN 50 ELSE 0 END AS BIGINT) AS score FROM crates")
register("R3_within_budget", lambda ix: R.within_budget(R.top(R.score_rules(_rules(ix), "error"), 10), R.token_estimate(["category", "summary"]), 130).select("pos", "spent"), """SELECT pos, CAST(spent AS BIGINT) AS spent FROM (SELECT pos, sum((88 + strlen(category) + strlen(summary) + 3) // 4) OVER (ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS spent FROM (
 SELECT id AS pos, CASE WHEN id % 3 = 0 THEN 'Error' ELSE 'style' END AS category, 'errors of ' || name AS summary, 2 + CASE WHEN id % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN id % 4 <> 3 THEN 50 ELSE 0 END AS score FROM crates ORDER BY score DESC, pos LIMIT 10)) WHERE spent <= 130""")


def _snapshots(ix: CodeIndex) -> tuple[DataFrame, DataFrame]:
    old = ix.files.where("id % 5 <> 0").select("path", F.col("crate_id").cast("string").alias("content_hash"))
    return old, ix.files.where("id % 7 <> 0").select("path", F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("crate_id").cast("string")).alias("content_hash"))


register("I1_snapshot_difference", lambda ix: I.snapshot_difference(*_snapshots(ix)), "SELECT path, CASE WHEN id % 5 = 0 THEN 'added' WHEN id % 7 = 0 THEN 'deleted' WHEN id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM files WHERE id % 5 <> 0 OR id % 7 <> 0")
register("I4_changed_names", lambda ix: I.changed_names(ix.nodes.where("repo <> 0"), ix.nodes.where("repo <> 1")), "SELECT name FROM nodes WHERE kind NOT IN ('use', 'mod') GROUP BY name HAVING count(*) FILTER (repo <> 0) = 0 OR count(*) FILTER (repo <> 1) = 0")
register("K4_path_dependencies", lambda ix: K.path_dependencies(ix.files.select(F.col("crate_id").alias("repo"), F.col("path").alias("name"), F.substring_index("path", "/", 2).alias("path")).where("path <> 'crates/nation_6'"), ix.crates.select(F.col("id").alias("repo"), F.col("path").alias("root"))), "SELECT f.crate_id AS repo, f.path AS name, c.id AS target FROM files f JOIN crates c ON c.id = f.crate_id WHERE c.path <> 'crates/nation_6'")


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))


QUERIES["SRC16_html_text"] = _page_texts
ORACLE_SQL["SRC16_html_text"] = r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g') AS h FROM pages),
 m AS (SELECT page_id, CASE WHEN instr(h, 'Expand description') > 0 THEN substr(h, instr(h, 'Expand description')) WHEN instr(h, '<main') > 0 THEN substr(h, instr(h, '<main')) ELSE h END AS h FROM c)
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' ')) AS text FROM m"""
