"""Graph walks on small indexes, against plain Python."""

import random

import pytest

from codeatlas.index import CodeIndex
from codeatlas.operators import graph as G
from codeatlas.operators import joins as J


def index(spark, edges, tests=(), impls=None, n=None):
    names = sorted({x for e in edges for x in e[:2]} | set(tests)) if n is None else list(range(n))
    impls = impls or {}
    symbols = [(i, 0, f"f{i}", "function", "public", i * 10 + 1, i * 10 + 5, f"fn f{i}()", impls.get(i), int(i in tests), None, None) for i in names]
    one = spark.createDataFrame([(0, "src/lib.rs", 0)], "id long, path string, crate_id long")
    refs = [(a, b, "call", "high", 1) for a, b in edges]
    return CodeIndex(
        one,
        spark.createDataFrame(symbols, "id long, file_id long, name string, kind string, visibility string, line_start long, line_end long, signature string, impl_type string, is_test int, attributes string, doc_comment string"),
        spark.createDataFrame(refs, "source_symbol_id long, target_symbol_id long, kind string, confidence string, ref_line long"),
        spark.createDataFrame([], "type_name string, trait_name string, file_id long, line_start long, line_end long"),
        spark.createDataFrame([(0, "c", "", 0)], "id long, name string, path string, repo long"),
        spark.createDataFrame([], "source_crate_id long, target_crate_id long"),
        spark.createDataFrame([], "id long, name string, version string, is_direct int"),
        spark.createDataFrame([], "id long, dependency_id long, source string, content string, module string"),
    )


def test_diamond(spark):
    ix = index(spark, [(1, 0), (2, 0), (3, 1), (3, 2)])
    rows = {(r.name, r.depth, r.via) for r in G.impact(ix, "f0").collect()}
    assert rows == {("f1", 1, "f0 -> f1"), ("f2", 1, "f0 -> f2"), ("f3", 2, "f0 -> f1 -> f3"), ("f3", 2, "f0 -> f2 -> f3")}


def test_cycle_ends(spark):
    ix = index(spark, [(0, 1), (1, 2), (2, 0)])
    assert {r.name for r in G.impact(ix, "f0", depth=4).collect()} == {"f0", "f1", "f2"}


def test_many_callers_are_limited(spark):
    assert G.impact(index(spark, [(i, 0) for i in range(1, 111)]), "f0").count() == 100


def test_unknown_symbol(spark):
    assert G.impact(index(spark, [(1, 0)]), "nope").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_matches_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(15), rng.randrange(15)) for _ in range(25)}
    got = {(r.seed, r.id): r.depth for r in G.reach(spark.createDataFrame(list(edges), "src long, dst long"), spark.createDataFrame([(0, 0), (1, 3)], "seed long, id long"), 4).collect()}
    want = {}
    for s, start in ((0, 0), (1, 3)):
        level, want[s, start] = {start}, 0
        for d in range(1, 5):
            level = {b for a, b in edges if a in level and (s, b) not in want}
            want |= {(s, b): d for b in level}
    assert got == want


def test_call_path(spark):
    ix = index(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)])
    assert [r.name for r in G.call_path(ix, "f0", "f4").orderBy("step").collect()] == ["f0", "f1", "f2", "f4"]
    assert [r.via for r in G.all_paths(ix, "f0", "f4").collect()] == ["f0 -> f1 -> f2 -> f4", "f0 -> f3 -> f2 -> f4"]


def test_untested_counts_methods_by_type(spark):
    ix = index(spark, [(9, 0)], tests=(9,), n=10, impls={0: "T", 1: "T"})
    assert {r.id for r in G.untested(ix).collect()} == set(range(1, 9))


def test_unreferenced(spark):
    ix = index(spark, [(1, 0), (2, 1)])
    assert [r.name for r in J.unreferenced(ix).collect()] == ["f2"]
