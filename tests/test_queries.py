"""Registered queries against their SQL in DuckDB, on the derived index."""

from collections import Counter

import duckdb

from codeatlas.adapter import BASE
from codeatlas.index import derived_index
from codeatlas.operators import search
from codeatlas.plans.queries import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"


def by_sql(key, sf_dir=TABLES):
    with duckdb.connect() as db:
        for t in BASE:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        return Counter(db.execute(ORACLE_SQL[key]).fetchall())


def test_overlaps_of_all_files(spark):
    rows = QUERIES["J12_overlapping"](spark, TABLES).collect()
    assert Counter(map(tuple, rows)) == by_sql("J12_overlapping")
    nodes = derived_index(spark, TABLES).nodes.where("line_start <= 95 AND line_end >= 30")
    assert {r.path for r in rows} == {r.path for r in nodes.select("path").distinct().collect()}


def test_file_scope_without_a_limit(spark):
    ix = derived_index(spark, TABLES)
    assert search.query(ix, "*", scope="files", limit=None).count() == ix.files.count() > 50
    larger = "/root/testdata/sf0.1"
    rows = QUERIES["P17_file_scope_unlimited"](spark, larger).collect()
    assert Counter(map(tuple, rows)) == by_sql("P17_file_scope_unlimited", larger) and len(rows) == 1111


ROWS = ("C1_context", "C12_similar", "C14_diff_impact", "C18_quality_gate", "D1_hunk_ranges", "D4_critique", "D5_gate_scan", "F9_did_you_mean", "G1_impact", "G8_call_tree", "G10_file_graph_dot", "I1_snapshot_difference", "J9_dangling_refs", "R1_score_rules", "R3_within_budget", "SNK6_without_a_folder", "SRC16_html_text", "T2_overview")


def test_queries_equal_their_sql(spark):
    """With rows on both sides: SQL values by name, as the columns' order is free."""
    for key in ROWS:
        df = QUERIES[key](spark, TABLES)
        columns = sorted(df.columns)
        with duckdb.connect() as db:
            for t in (*BASE, "pages"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TABLES}/{t}.parquet')")
            found = db.execute(ORACLE_SQL[key])
            names = [d[0] for d in found.description]
            want = Counter(tuple(row[names.index(c)] for c in columns) for row in found.fetchall())
        assert Counter(map(tuple, df.select(*columns).collect())) == want and want, key
