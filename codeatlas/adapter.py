"""The code index derived from the TPC-H-like tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "crates": "SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS name, concat('crates/', lower(n_name)) AS path, CAST(n_regionkey AS BIGINT) AS repo FROM nation",
    "crate_deps": """SELECT CAST(a.n_nationkey AS BIGINT) AS source_crate_id, CAST(b.n_nationkey AS BIGINT) AS target_crate_id
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey AND a.n_nationkey - b.n_nationkey <= 5""",
    "files": """SELECT c_custkey AS id, concat('crates/', lower(n_name), CASE WHEN c_custkey % 7 = 0 THEN '/tests/' ELSE '/src/' END,
        lower(c_mktsegment), '/f', CAST(c_custkey AS STRING), '.rs') AS path, CAST(c_nationkey AS BIGINT) AS crate_id
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "symbols": """SELECT id, file_id, name, kind, visibility, line_start, line_start + span AS line_end, signature, impl_type, is_test,
        CASE WHEN is_test = 1 THEN 'test' WHEN id % 11 = 0 THEN 'derive(Debug, Clone)' END AS attributes,
        CASE WHEN id % 4 <> 0 THEN concat('Handles ', name, ' for ', kind, ' items') END AS doc_comment
        FROM (SELECT o_orderkey AS id, o_custkey AS file_id, concat('sym_', CAST(o_orderkey % 5000 AS STRING)) AS name,
            CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'struct' WHEN '4' THEN 'trait' WHEN '5' THEN 'const' ELSE 'function' END AS kind,
            CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'pub(crate)' ELSE 'private' END AS visibility,
            1 + 40 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS line_start,
            CAST(floor(o_totalprice) AS BIGINT) % 60 AS span,
            concat('pub fn sym_', CAST(o_orderkey % 5000 AS STRING), '(db: &Type_', CAST(o_custkey % 50 AS STRING), ') -> Result<Type_', CAST(o_orderkey % 30 AS STRING), '>') AS signature,
            CASE WHEN o_orderkey % 3 = 0 THEN concat('Type_', CAST(o_custkey % 50 AS STRING)) END AS impl_type,
            CASE WHEN o_orderkey % 10 = 0 AND substr(o_orderpriority, 1, 1) IN ('1', '3') THEN 1 ELSE 0 END AS is_test
            FROM orders) t""",
    "symbol_refs": """SELECT l_orderkey AS source_symbol_id, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM orders) AS target_symbol_id,
        CASE l_linestatus WHEN 'O' THEN 'call' ELSE 'type_ref' END AS kind, CASE l_returnflag WHEN 'R' THEN 'low' ELSE 'high' END AS confidence,
        CAST(l_linenumber AS BIGINT) AS ref_line FROM lineitem""",
    "trait_impls": """SELECT DISTINCT concat('Type_', CAST(p_partkey % 50 AS STRING)) AS type_name,
        CASE WHEN p_size % 2 = 0 THEN concat('trait_', CAST(p_size AS STRING)) ELSE concat('core::trait_', CAST(p_size AS STRING)) END AS trait_name,
        p_partkey % (SELECT count(*) FROM customer) AS file_id, CAST(p_size AS BIGINT) AS line_start, CAST(p_size + 9 AS BIGINT) AS line_end FROM part""",
    "dependencies": "SELECT s_suppkey AS id, concat('dep_', CAST(s_suppkey AS STRING)) AS name, concat('1.', CAST(s_nationkey AS STRING), '.0') AS version, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS is_direct FROM supplier",
    "docs": "SELECT doc_id AS id, doc_id % (SELECT count(*) FROM supplier) AS dependency_id, source, text AS content, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS module FROM documents",
}

BASE = ("nation", "customer", "orders", "lineitem", "part", "supplier", "documents")

#: Common table expressions for DuckDB; `nodes` is symbols with their file, crate and repository.
NODES = "SELECT s.*, f.path, f.crate_id, c.repo FROM symbols s JOIN files f ON f.id = s.file_id JOIN crates c ON c.id = f.crate_id"
EDGES = "SELECT source_symbol_id AS src, target_symbol_id AS dst, kind AS ref_kind, confidence, ref_line FROM symbol_refs"


def oracle(body: str, recursive: str = "") -> str:
    """`body` with the derived index in front, for DuckDB."""
    views = ",\n".join(f"{k} AS ({v})" for k, v in (VIEWS | {"nodes": NODES, "edges": EDGES}).items())
    return f"WITH RECURSIVE {views}{', ' + recursive if recursive else ''}\n{body}"
