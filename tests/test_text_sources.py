"""Parsers, manifests, diffs, scorers and incremental refresh on small texts."""

from pyspark.sql import functions as F

from codeatlas.functions import text as T
from codeatlas.operators import diffs as D
from codeatlas.operators import scoring as R
from codeatlas.operators.search import topic_sections
from codeatlas.sources import manifests as M
from codeatlas.sources import parse as P
from codeatlas.sources import scan as S
from codeatlas.streaming import incremental as I

RUST = '''/// Doubles.
#[inline]
pub fn double(x: i32) -> i32 { helper(x) }
fn helper(x: i32) -> i32 { let s = "} fn not_me() {"; x * 2 }
#[derive(Debug, thiserror::Error)]
pub enum Kind { Alpha, Beta(i32) }
pub struct Store { kind: Kind }
impl Store {
    pub(crate) fn get(&self) -> Kind { self.load() }
    fn load(&self) -> Kind { Kind::Alpha }
}
impl Clone for Store { fn clone(&self) -> Self { todo!() } }
'''


def test_rust_symbols():
    got = {(s["name"], s["kind"]): s for s in P.rust_symbols("src/lib.rs", RUST)}
    assert ("not_me", "function") not in got
    assert got["double", "function"]["doc_comment"] == "Doubles." and got["double", "function"]["attributes"] == "inline"
    assert (got["double", "function"]["line_start"], got["double", "function"]["line_end"]) == (3, 3)
    assert got["get", "function"]["impl_type"] == "Store" and got["get", "function"]["visibility"] == "pub(crate)"
    assert got["Beta", "enum_variant"]["impl_type"] == "Kind" and ("Clone for Store", "impl") in got
    impls = {(i["type_name"], i["trait_name"]) for i in P.rust_impls(list(got.values()))}
    assert {("Store", "Clone"), ("Kind", "Debug"), ("Kind", "Error"), ("Kind", "Display")} <= impls


def test_typescript_symbols():
    code = "export class Box {\n  private open(): void { helper(); }\n}\nexport const add = (a: number) => {\n  return a;\n};\nenum E { A, B = 2 }\nimport { x } from './y';\n"
    got = {(s["name"], s["kind"]): s for s in P.ts_symbols("src/a.test.ts", code)}
    assert got["open", "function"]["impl_type"] == "Box" and got["open", "function"]["visibility"] == "private"
    assert ("add", "function") in got and ("A", "enum_variant") in got and got["Box", "class"]["is_test"] == 1


def test_python_symbols_and_edges(spark):
    code = "class A:\n    def run(self):\n        return self.step()\n    def step(self):\n        return helper()\n\ndef helper():\n    return missing()\n"
    files = spark.createDataFrame([("a.py", code), ("bad.py", "def ("), ("empty.py", None)], "path string, content string")
    symbols = P.with_ids(P.parse_symbols(files)).cache()
    names = {r.id: r.name for r in symbols.collect()}
    edges = {(names[r.source_symbol_id], names[r.target_symbol_id], r.confidence) for r in P.resolve_edges(symbols, P.extract_refs(files)).collect()}
    assert edges == {("run", "step", "high"), ("step", "helper", "high")}


def test_imports(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("src/b/index.ts",)], "path string")
    imports = spark.createDataFrame([("src/a/y.ts", "./x"), ("src/a/y.ts", "../b"), ("src/a/y.ts", "./no")], "path string, module string")
    assert {(r.module, r.file) for r in P.resolve_imports(imports, files).collect()} == {("./x", "src/a/x.ts"), ("../b", "src/b/index.ts")}


def test_manifests(spark):
    assert M.cargo_toml('[dependencies]\na = "1"\nb = {version = "2", features = ["x"]}') == [{"name": "a", "version": "1"}, {"name": "b", "version": "2", "path": None, "features": "x"}]
    assert M.requirement("foo[bar]>=1.2; python_version<'3'") == {"name": "foo", "version": ">=1.2"}
    assert M.tsconfig('{// c\n"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"]},}}')["baseUrl"] == "src"
    ws = M.workspace_members('[workspace.dependencies]\ns = {version = "1", features = ["a"]}', {"m": '[dependencies]\ns = {workspace = true, features = ["b"]}'})
    assert ws[0]["version"] == "1" and ws[0]["features"] == "a,b"
    rows = M.dependencies(spark.createDataFrame([("r", "x/package.json", '{"dependencies": {"q": "^1"}}'), ("r", "bad/package.json", "{")], "repo string, path string, content string")).collect()
    assert [(r.name, r.version) for r in rows] == [("q", "^1")]


DIFF = "diff --git a/src/x.rs b/src/x.rs\n--- a/src/x.rs\n+++ b/src/x.rs\n@@ -1,2 +1,4 @@\n context\n+unsafe { go() }\n+let a: Box<u8> = v.unwrap();\n-old\n@@ -9 +12 @@\n+pub fn new() {}\n@@ -20,2 +30,0 @@\n"


def test_diffs(spark):
    d = spark.createDataFrame([(1, DIFF)], "id long, text string")
    assert [(r.path, r.start, r.end) for r in D.hunk_ranges(d).orderBy("start").collect()] == [("src/x.rs", 1, 4), ("src/x.rs", 12, 12)]
    assert [(r.line_no, r.rule) for r in D.critique(d).collect()] == [(2, "unsafe_without_safety_comment"), (3, "box_of_copy_primitive")]
    scan = D.gate_scan(d)
    assert scan.first()[1:] == (1, 1, 1, 1)
    asked = spark.createDataFrame([(1, "", "d", "i", "none", "", "")], "id long, plan string, docs_verified string, impact_checked string, tests_run string, performance_evidence string, safety_notes string")
    assert D.quality_gate(asked, scan).first().verdict == "BLOCKED"


def test_blame_and_log(spark):
    sha = "a" * 40
    blame = spark.createDataFrame([(1, f"{sha} 1 1 2\nauthor Ann\nauthor-time 86400\nsummary s\n\tx\n{sha} 2 2\n\ty")], "id long, text string")
    assert [(r.author, r.lines, r.percent, r.latest) for r in D.blame_summary(D.blame_lines(blame)).collect()] == [("Ann", 2, 100, "1970-01-02")]
    log = spark.createDataFrame([(1, "h1\nAnn\n2024-01-01\nsub\nbody\x00h2\nBob\n2024-01-02\nsub2\n")], "id long, text string")
    assert [(r.commit, r.subject) for r in D.log_entries(log).collect()] == [("h1", "sub"), ("h2", "sub2")]


def test_scores(spark):
    rules = spark.createDataFrame([("r1", 0, "errors", ["unwrap", "panic"], "avoid unwrap"), ("r2", 1, "style", ["name"], "naming")], "id string, pos int, category string, triggers array<string>, summary string")
    scored = R.score_rules(rules, "unwrap")
    assert [(r.id, r.score) for r in scored.collect()] == [("r1", 10 + 2 + 30)]
    over = spark.createDataFrame([("r1", "demoted", None)], "id string, severity string, note string")
    assert R.adjust_style(scored, over).first().score == 21
    assert R.within_budget(rules.withColumn("score", F.lit(1)), F.lit(6), 10).count() == 1


def test_topic_sections_merge(spark):
    text = "\n".join("topic" if i in (3, 8, 30) else "x" for i in range(40))
    rows = topic_sections(spark.createDataFrame([(1, text)], "id long, content string"), "Topic").orderBy("first").collect()
    assert [(r.first, r.last) for r in rows] == [(1, 12), (28, 34)]


def test_functions(spark):
    assert T.fnv1a("hello") == "a430d84680aabd0b" and T.base_name("A::b::c") == "b::c" and T.split_qualified("A::b::c") == ("A::b", "c")
    row = spark.createDataFrame([("handle-queries x", "pub fn a(b: Vec<Type_1>)")], "t string, s string")
    assert row.where(T.phrase_prefix(F.col("t"), "handle quer")).count() == 1 and row.where(T.phrase_prefix(F.col("t"), "uer")).count() == 0
    assert row.where(T.phrase_prefix(F.col("t"), "_")).count() == 0 and row.where(T.whole_word(F.col("s"), "Type")).count() == 0
    page = spark.createDataFrame([("<html><head>h</head><main>a &lt;b&gt; <script>s</script><p>c</p></main>",)], "html string")
    assert page.select(S.html_text(F.col("html"))).first()[0] == "a <b> c"


def test_incremental(spark):
    old = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "f()\ng()"), ("c.py", "")], "path string, content string")
    new = spark.createDataFrame([("a.py", "def f(): pass\ndef g(): pass"), ("b.py", "f()\ng()"), ("d.py", "x = 1")], "path string, content string")
    old, new = S.with_hash(old), S.with_hash(new)
    out = I.refresh(old, P.parse_symbols(old), new, P.parse_symbols)
    assert {r.path: r.change for r in out["change"].collect()} == {"a.py": "changed", "b.py": "unchanged", "c.py": "deleted", "d.py": "added"}
    assert {r.path for r in out["extract"].collect()} == {"a.py", "b.py", "d.py"}


def test_file_stream(spark, tmp_path):
    S.with_hash(spark.createDataFrame([("a.py", "x = 1")], "path string, content string")).write.parquet(str(tmp_path / "in"))
    seen = []
    I.file_stream(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, _: seen.extend(r.path for r in df.collect())).awaitTermination(60)
    assert seen == ["a.py"]
