"""The stored index: snapshots, commits, removal and replacement of files; rendering and small parsers."""

import pytest
from pyspark.sql import functions as F

from codeatlas.index import derived_index
from codeatlas.operators import aggregates, diffs, graph, scoring, tools
from codeatlas.render import markdown
from codeatlas.sources import manifests, scan
from codeatlas.store import TABLES, merged, open_index, stored_index, versions, without_files, write_index

SF = "/root/testdata/sf0.001"


def test_snapshots_are_whole(spark, tmp_path):
    path, ix = f"file://{tmp_path}/index", derived_index(spark, SF)
    with pytest.raises(ValueError):
        open_index(spark, path)
    assert write_index(ix, path) == 1
    first = open_index(spark, path)
    for t in TABLES:
        assert getattr(first, t).count() == getattr(ix, t).count() > 0
    assert sorted(map(tuple, first.linked("src").select("src", "dst_name").collect())) == sorted(map(tuple, ix.linked("dst").select("src", "dst_name").collect()))
    gone = ix.files.where("id % 2 = 0").select("path")
    assert write_index(without_files(first, gone), path) == 2 and versions(spark, path) == [1, 2]
    assert open_index(spark, path, 1).files.count() == ix.files.count() > open_index(spark, path).files.count()
    # a snapshot without its commit is not seen
    spark.range(1).write.parquet(f"{path}/v3/files")
    assert versions(spark, path) == [1, 2]


def test_files_come_and_go_with_their_references(spark):
    ix = stored_index(spark, SF)
    some = ix.files.orderBy("id").limit(3)
    left = without_files(ix, some.select("path"))
    known = left.symbols.select("id")
    refs = left.refs
    assert refs.join(known, refs.source_symbol_id == known.id, "left_anti").isEmpty() and refs.join(known, refs.target_symbol_id == known.id, "left_anti").isEmpty()
    assert 0 < refs.count() < ix.refs.count()
    ids = some.select(F.col("id").alias("file_id"))
    part = type(ix)(some, ix.symbols.join(ids, "file_id", "left_semi").select(ix.symbols.columns), ix.refs.limit(0), ix.trait_impls.limit(0), ix.crates.limit(2), ix.crate_deps.limit(0), ix.dependencies.limit(1), ix.docs.limit(1))
    again = merged(ix, part)
    assert (again.files.count(), again.symbols.count(), again.crates.count(), again.docs.count()) == (ix.files.count(), ix.symbols.count(), ix.crates.count(), ix.docs.count())


def test_the_stored_index_is_reused(spark):
    a, b = stored_index(spark, SF), stored_index(spark, SF)
    assert a.nodes.inputFiles() == b.nodes.inputFiles()


def test_gate_rules_one_by_one(spark):
    """Plan, docs, tests, unwrap, unsafe and unproven speed block; public edits and empty diffs warn."""
    rust = "diff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/src/x.rs\n@@ -1 +1,3 @@\n+{}\n"
    cases = {
        1: (rust.format("let a = 1;"), {}, "PASS"), 2: (rust.format("let a = 1;"), {"plan": "n/a"}, "BLOCKED"), 3: (rust.format("let a = 1;"), {"docs_verified": None}, "BLOCKED"),
        4: (rust.format("let a = 1;"), {"tests_run": "not run"}, "BLOCKED"), 5: (rust.format("a.unwrap();"), {}, "BLOCKED"), 6: (rust.format("unsafe { b() }"), {}, "BLOCKED"), 7: (rust.format("unsafe { b() }"), {"safety_notes": "checked"}, "PASS"),
        8: (rust.format("let a = 1;"), {"task": "a speedup"}, "BLOCKED"), 9: (rust.format("let a = 1;"), {"plan": "Optimise it", "performance_evidence": "measured"}, "PASS"),
        10: (rust.format("pub fn f() {}"), {"impact_checked": ""}, "WARN"), 11: (rust.format("pub fn f() {}"), {}, "PASS"), 12: ("", {"plan": ""}, "WARN"), 13: (rust.replace(".rs", ".py").format("x"), {"plan": None, "tests_run": None}, "PASS"),
    }
    fields = ["task", "plan", "docs_verified", "impact_checked", "tests_run", "performance_evidence", "safety_notes"]
    good = dict(zip(fields, ["change it", "a plan", "std docs", "impact f", "cargo test", None, None], strict=True))
    requests = spark.createDataFrame([(k, *(good | given).values()) for k, (_, given, _) in cases.items()], "id long, " + ", ".join(f"{f} string" for f in fields))
    scans = diffs.gate_scan(spark.createDataFrame([(k, d) for k, (d, *_) in cases.items()], "id long, text string"))
    assert {r.id: r.verdict for r in diffs.quality_gate(requests, scans).collect()} == {k: v for k, (*_, v) in cases.items()}


def test_large_diffs_are_errors(spark):
    with pytest.raises(Exception, match="too large"):
        diffs.hunk_lines(spark.createDataFrame([(1, "x" * 100)], "id long, text string"), most=50).collect()


def test_page_and_rustdoc_texts(spark):
    pages = spark.createDataFrame([("junk <p>Expand description</p> a &amp;lt; b<script>x</script>",), ("<head>t</head>x<main>y &nbsp;z</main>",), (None,)], "h string")
    assert [r.t for r in pages.select(scan.html_text(F.col("h")).alias("t")).collect()] == ["Expand description a < b", "y  z", None]
    json = '{"root": 0, "index": {"0": {"name": "demo", "docs": "About é", "inner": {"module": {"items": [1, 2]}}}, "1": {"name": "io", "docs": "Reads.", "inner": {"module": {"items": [3]}}}, "2": {"name": "run", "docs": null, "inner": {"function": {}}}, "3": {"name": "read", "docs": "", "inner": {"function": {}}}, "4": {"name": "tiny", "docs": null, "inner": {"module": {"items": []}}}}}'
    got = {r.module: r.content for r in scan.rustdoc_docs(spark.createDataFrame([("demo", json)], "crate string, json string")).collect()}
    assert got == {"": "# demo\nAbout é\n## Modules\n- io\n## Items\n- run", "io": "# io\nReads.\n## Items\n- read"}
    short = scan.rustdoc_docs(spark.createDataFrame([("demo", json)], "crate string, json string"), summary=14).where("module = ''").first().content
    assert short == "# demo\nAbout "


def test_remote_docs_and_small_files(spark):
    raw = spark.createDataFrame([("a", "1", "github", "readme"), ("a", "1", "crates.io", "é" * 5000), ("a", "1", "docs.rs", " "), ("b", "1", "elsewhere", "x")], "dep string, version string, source string, body string")
    assert [(r.dependency, r.source, len(r.content)) for r in scan.remote_docs(raw).collect()] == [("a", "crates.io", 4000)]
    assert manifests.npm_members('{"workspaces": {"packages": ["packages/*", "./app"]}}', ["packages/a", "packages/a/b", "app", "x"]) == ["app", "packages/a"]
    assert manifests.registry('[[repos]]\nname = "n"\npath = "/p"\n')[0] == {"name": "n", "path": "/p", "git_remote": None, "git_common_dir": None, "last_indexed": None}


def test_null_triggers_and_notes(spark):
    rules = spark.createDataFrame([(1, "p", "errors", None, "about errors"), (2, "q", None, ["errors"], None)], "pos long, id string, category string, triggers array<string>, summary string")
    assert {r.pos: r.score for r in scoring.score_rules(rules, "errors").collect()} == {1: 5 + 2 + 20, 2: 10 + 30}
    notes = spark.createDataFrame([("ab", None), ("ab", "note")], "c string, note string")
    assert [r.t for r in notes.select(scoring.token_estimate(["c"], note="note").alias("t")).collect()] == [(90 + 3) // 4, (90 + 17 + 4 + 3) // 4]


def test_log_lines_keep_file_marks(spark):
    log = "commit abcdef1\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+a\n c\n-b"
    assert [r.line for r in diffs.log_diffs(spark.createDataFrame([(1, log)], "id long, text string")).orderBy("seq").collect()] == ["--- a/x", "+++ b/x", "@@ -1 +1 @@", "+a", "-b"]


def test_listing_report_and_markdown(spark):
    tests = spark.createDataFrame([(f"t{k}", f"f{k % 3}") for k in range(30)], "name string, path string")
    assert sum(r.n for r in tools.test_listing(tests).collect()) == 30 and tools.test_listing(tests).count() == 3
    assert tools.test_listing(tests.limit(4)).count() == 4 and tools.test_listing(tests.unionByName(tests)).first().n == 60
    rows = spark.createDataFrame([("a", "p", 1, "x -> a", 0)] + [(f"b{k}", "q", 2, f"x -> b{k}", 0) for k in range(7)], "name string, path string, depth int, via string, is_test int")
    report = {(r.section, r.what): r.n for r in graph.impact_report(rows, tests.limit(1)).collect()}
    assert report == {("symbol", "x -> a"): 1, ("file", "q"): 7, ("test", "t0"): 1}
    assert "| t0 | f0 |" in markdown(tests.orderBy("name"), "Tests", 2) and "More than 2" in markdown(tests, "Tests", 2) and "No results" in markdown(tests.limit(0), "Tests")


def test_limits_over_many_files(spark):
    rows = spark.createDataFrame([(k, f"f{k % 10}", k) for k in range(30)], "id long, path string, line_start long")
    assert sorted(r.path for r in aggregates.proportional_limit(rows, 4).collect()) == ["f0", "f1", "f2", "f3"]
    assert aggregates.proportional_limit(rows, 100).count() == 30
