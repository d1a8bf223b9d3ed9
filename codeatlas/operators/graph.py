"""Walks over the reference graph: level-synchronous DataFrame loops.

Every loop writes its levels as tables to the shared folder, so a lost executor costs a reread and not
the whole walk. A level of few ids is looked up by literals, which prune the row groups of references
sorted by that end; a larger one by a join. Names and paths come with the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import base_name, split_qualified, under
from codeatlas.index import CodeIndex
from codeatlas.plans.stage import cut, meeting

NOT_CALLABLE = ("const", "static", "enum_variant")
#: Names that say little about a function that calls them.
NOISY = (
    "new", "from", "into", "default", "clone", "build", "init", "fmt", "write", "writeln", "display", "format", "push", "pop", "insert", "remove", "get", "set", "clear",
    "contains", "extend", "with_capacity", "capacity", "retain", "iter", "into_iter", "collect", "map", "filter", "len", "is_empty", "to_string", "to_owned", "as_str",
    "as_ref", "as_mut", "unwrap", "expect", "ok", "err", "borrow", "borrow_mut", "deref", "deref_mut",
)


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for df in levels[1:]:
        out = out.unionByName(df)
    return out


def seeds(ix: CodeIndex, name: str, impl_type: str | None = None) -> DataFrame:
    rows = ix.nodes.where(F.col("name") == name)
    return rows if impl_type is None else rows.where(F.col("impl_type") == impl_type)


def impact(ix: CodeIndex, name: str, impl_type: str | None = None, depth: int = 5, limit: int | None = 100) -> DataFrame:
    """Who depends on a symbol, one row per path of names: name, path, depth, via, is_test.

    Levels come in the order of the result, so the walk ends once `limit` distinct rows exist.
    """
    up = ix.linked("dst").where("confidence = 'high'").select("src", "dst", F.col("src_name").alias("name"), F.col("src_path").alias("path"), F.col("src_is_test").alias("is_test"))
    level = cut(seeds(ix, name, impl_type).select("id", F.col("name").alias("via")))
    levels, found = [], 0
    for d in range(1, depth + 1):
        edges = meeting(up, "dst", level.select("id").distinct())
        step = level.toDF("dst", "before").join(edges, "dst")
        whole = cut(step.select(F.col("src").alias("id"), "name", "path", F.lit(d).alias("depth"), F.concat("before", F.lit(" -> "), "name").alias("via"), "is_test").distinct())
        rows = whole.drop("id").distinct()
        level = whole.select("id", "via")
        n = rows.count()
        levels.append(rows)
        found += n
        if not n or limit is not None and found >= limit:
            break
    out = _union(levels)
    return out if limit is None else out.orderBy("depth", "name", "path", "via", "is_test").limit(limit)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth): what each seed of `start` (seed, id) reaches along (src, dst), at its least depth."""
    seen = level = cut(start.select("seed", "id", F.lit(0).alias("depth")).dropDuplicates(["seed", "id"]))
    edges = edges.select("src", "dst")
    for d in range(1, depth + 1):
        step = level.select("seed", F.col("id").alias("src")).join(meeting(edges, "src", level.select("id").distinct()), "src").select("seed", F.col("dst").alias("id")).distinct()
        level = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(d).alias("depth")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def related_tests(ix: CodeIndex, start: DataFrame, depth: int = 5) -> DataFrame:
    """Tests that reach the ids of `start` (seed, id) within `depth` sure references: seed, name, path, line_start."""
    up = ix.linked("dst").where("confidence = 'high'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(up, start, depth).where("depth > 0")
    return found.join(ix.nodes.where("is_test = 1").select("id", "name", "path", "line_start"), "id").select("seed", "name", "path", "line_start").distinct()


def tested_ids(ix: CodeIndex, depth: int = 5) -> DataFrame:
    """Ids that some test reaches: one closure down from all tests, lifted to (name, impl_type).

    Tests are looked up by name and type; a symbol without a type stands for all of its name.
    """
    tests = ix.symbols.where("is_test = 1").select(F.lit(0).alias("seed"), "id")
    down = ix.linked("src").where("confidence = 'high'").select("src", "dst")
    hops = reach_after_one(down, tests, depth)
    hit = ix.nodes.join(hops, "id", "left_semi")
    names, typed = hit.select("name").distinct(), hit.where("impl_type IS NOT NULL").select("name", "impl_type").distinct()
    free = ix.nodes.where("impl_type IS NULL").join(names, "name", "left_semi")
    return free.select("id").unionByName(ix.nodes.join(typed, ["name", "impl_type"], "left_semi").select("id"))


def reach_after_one(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Ids at the end of a walk of 1 to `depth` edges (a start counts only if a walk returns to it)."""
    first = start.select("seed", F.col("id").alias("src")).join(edges.select("src", "dst").distinct(), "src").select("seed", F.col("dst").alias("id")).distinct()
    return reach(edges, first, depth - 1).select("id").distinct()


def untested(ix: CodeIndex, prefix: str = "", kind: str = "function", depth: int = 5) -> DataFrame:
    rows = ix.nodes.where(under(F.col("path"), prefix) & (F.lower("kind") == kind.lower()) & (F.col("is_test") == 0))
    return rows.join(tested_ids(ix, depth), "id", "left_anti").select("id", "name", "path", "impl_type")


def crate_dependents(ix: CodeIndex, crate: str, transitive: bool = True, depth: int = 10) -> DataFrame:
    up = ix.crate_deps.select(F.col("target_crate_id").alias("src"), F.col("source_crate_id").alias("dst"))
    start = ix.crates.where(F.col("name") == crate).select(F.col("id").alias("seed"), "id")
    found = reach(up, start, depth if transitive else 1).where("id <> seed").select("id").distinct()
    return ix.crates.join(found, "id", "left_semi").select("id", "name", "path")


def _node(side: str) -> Column:
    """A node of call paths: name and path, in the order of the pair."""
    return F.concat_ws("\u0001", f"{side}name", f"{side}path")


def _sure(ix: CodeIndex, side: str, exclude_tests: bool) -> DataFrame:
    """Sure references as (a, b, name of b) between nodes of call paths, for lookups by one side's name."""
    links = ix.linked(side).where("confidence = 'high'")
    links = links.where("src_is_test = 0 AND dst_is_test = 0") if exclude_tests else links
    return links.select(_node("src_").alias("a"), _node("dst_").alias("b"), "src", "dst", F.col("dst_name").alias("bn"), F.col("src_name").alias("an"))


def call_path(ix: CodeIndex, start: str, to: str, depth: int = 10, exclude_tests: bool = False) -> DataFrame:
    """The shortest path from a symbol to a name over sure references: step, name, path.

    Nodes are (name, path); of several parents the smallest (name, path) is kept.
    """
    impl, name = split_qualified(start)
    edges = _sure(ix, "src", exclude_tests).where("a <> b").select("a", "b")
    begin = seeds(ix, name, impl)
    begin = begin.where("is_test = 0") if exclude_tests else begin
    seen = level = cut(begin.select(_node("").alias("b"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("a")).distinct())
    goal, none = base_name(to), ix.spark.createDataFrame([], "step int, name string, path string")
    for d in range(1, depth + 1):
        step = meeting(edges, "a", level.select("b")).join(seen.select("b"), "b", "left_anti")
        level = cut(step.groupBy("b").agg(F.min("a").alias("a")).select("b", F.lit(d).alias("depth"), "a"))
        seen = seen.unionByName(level)
        if level.isEmpty():
            return none
        hit = level.where(F.substring_index("b", "\u0001", 1) == goal)
        if not hit.isEmpty():
            break
    else:
        return none
    # walk the parents back: one row per level
    at = hit.orderBy("b").limit(1).select("depth", "b", "a")
    steps = [at]
    for _ in range(d):
        at = cut(at.select(F.col("a").alias("b")).join(seen, "b").select("depth", "b", "a"))
        steps.append(at)
    parts = F.split("b", "\u0001")
    return _union(steps).select(F.col("depth").alias("step"), parts[0].alias("name"), parts[1].alias("path"))


def all_paths(ix: CodeIndex, start: str, to: str, depth: int = 10, limit: int = 5) -> DataFrame:
    """The `limit` shortest simple paths of names: hops, via.

    First every node's distance to the goal is found, backwards; then walks go on only where the goal is
    within the hops left. Walks end at the goal.
    """
    impl, name = split_qualified(start)
    goal = base_name(to)
    sure = _sure(ix, "dst", False)
    ends = ix.nodes.where(F.col("name") == goal).select(F.lit(0).alias("seed"), _node("").alias("id")).distinct()
    back = reach(sure.where(F.col("an") != goal).select(F.col("b").alias("src"), F.col("a").alias("dst")), ends, depth).select(F.col("id").alias("node"), F.col("depth").alias("left"))
    near = sure.join(back.toDF("a", "a_left"), "a", "left_semi").join(back.toDF("b", "b_left"), "b")
    edges = cut(near.select("a", "b", "bn", "b_left").distinct())
    level = cut(seeds(ix, name, impl).select(_node("").alias("a"), "name").distinct().select("a", F.array("a").alias("walk"), F.col("name").alias("via")))
    done, found = [], 0
    for d in range(1, depth + 1):
        step = level.join(edges.where(F.col("b_left") <= depth - d), "a").where(~F.array_contains("walk", F.col("b")))
        step = cut(step.select("b", F.array_append("walk", F.col("b")).alias("walk"), F.concat("via", F.lit(" -> "), "bn").alias("via"), (F.col("bn") == goal).alias("hit")))
        hits = step.where("hit").select(F.lit(d).alias("hops"), "via", F.array_join("walk", ",").alias("walk"))
        done.append(hits)
        found += hits.count()
        level = step.where("NOT hit").select(F.col("b").alias("a"), "walk", "via")
        if found >= limit or level.isEmpty():
            break
    return _union(done).orderBy("hops", "via", "walk").limit(limit).select("hops", "via")


def _names(ix: CodeIndex, way: str, exclude_tests: bool = False, kinds: tuple[str, ...] = ("const", "static")) -> DataFrame:
    """Sure calls between names, (src, dst) in the direction of the walk."""
    links = ix.linked("src" if way == "down" else "dst").where("ref_kind = 'call' AND confidence = 'high'")
    if kinds:
        links = links.where(~F.col("src_kind").isin(*kinds) & ~F.col("dst_kind").isin(*kinds))
    links = links.where("src_is_test = 0 AND dst_is_test = 0") if exclude_tests else links
    a, b = ("src_name", "dst_name") if way == "down" else ("dst_name", "src_name")
    return links.select(F.col(a).alias("src"), F.col(b).alias("dst"))


def neighborhood(ix: CodeIndex, name: str, direction: str = "both", depth: int = 2, noisy: tuple[str, ...] = NOISY) -> DataFrame:
    """(direction, name, depth) around a name: callees down, callers up, first-seen depth per name; not through noisy names."""
    out = []
    for way in ("down", "up"):
        if direction not in (way, "both"):
            continue
        pairs = _names(ix, way)
        if noisy:
            pairs = pairs.where(~F.col("dst").isin(*noisy))
        start = ix.spark.createDataFrame([(0, name)], "seed int, id string")
        found = reach(pairs, start, depth).where("depth > 0")
        out.append(found.select(F.lit(way).alias("direction"), F.col("id").alias("name"), "depth").where(F.col("name") != name))
    return _union(out)


def call_tree(ix: CodeIndex, name: str, direction: str = "down", depth: int = 2, exclude_tests: bool = False, noisy: tuple[str, ...] = NOISY) -> DataFrame:
    """(depth, branch) of the tree of calls: a branch is the names from the root; a name met on its own branch has no children."""
    pairs = _names(ix, "down" if direction == "down" else "up", exclude_tests, NOT_CALLABLE)
    pairs = pairs.where((F.col("src") != F.col("dst")) & ~F.col("dst").isin(*noisy)) if noisy else pairs.where("src <> dst")
    level = ix.spark.createDataFrame([(0, [name], name, True)], "depth int, branch array<string>, at string, open boolean")
    levels = [level]
    for d in range(1, depth + 1):
        live = level.where("open")
        step = live.join(meeting(pairs, "src", live.select("at").distinct()), F.col("at") == F.col("src")).select("branch", "dst").distinct()
        level = cut(step.select(F.lit(d).alias("depth"), F.array_append("branch", F.col("dst")).alias("branch"), F.col("dst").alias("at"), (~F.array_contains("branch", F.col("dst"))).alias("open")))
        levels.append(level)
        if level.isEmpty():
            break
    return _union(levels).select("depth", F.array_join("branch", " > ").alias("branch"))


def graph_export(ix: CodeIndex, name: str, depth: int = 2, direction: str = "down") -> DataFrame:
    """Edges (source, target, depth) below (or above) a symbol, by least depth of the end that the walk comes from."""
    pairs = _names(ix, direction, kinds=())
    found = reach(pairs, ix.spark.createDataFrame([(0, name)], "seed int, id string"), depth - 1)
    at, to = ("source", "target") if direction == "down" else ("target", "source")
    return found.select(F.col("id").alias("src"), "depth").join(meeting(pairs, "src", found.select("id")).distinct(), "src").select(F.col("src").alias(at), F.col("dst").alias(to), "depth")


def graph_summary(edges: DataFrame) -> DataFrame:
    """Numbers of nodes, edges, roots and leaves of (source, target) edges."""
    pairs = edges.select("source", "target").distinct()
    s, t = pairs.select(F.col("source").alias("n")).distinct(), pairs.select(F.col("target").alias("n")).distinct()
    rows = {"nodes": s.union(t).distinct(), "edges": pairs, "roots": s.join(t, "n", "left_anti"), "leaves": t.join(s, "n", "left_anti")}
    return _union([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in rows.items()])


def dot(edges: DataFrame, prefix: str = "") -> DataFrame:
    """One DOT line per edge; a common path prefix is left out."""
    if prefix:
        short = lambda c: F.when(F.startswith(c, F.lit(prefix)), F.expr(f"substr({c}, {len(prefix) + 1})")).otherwise(F.col(c)).alias(c)
        edges = edges.select(short("source"), short("target"))
    return edges.select(F.format_string('  "%s" -> "%s";', "source", "target").alias("line")).distinct()


def file_dependencies(ix: CodeIndex, prefix: str, confidence: str | None = "high") -> DataFrame:
    links = ix.linked("src")
    ends = links if confidence is None else links.where(F.col("confidence") == confidence)
    return ends.where(under(F.col("src_path"), prefix) & (F.col("src_path") != F.col("dst_path"))).select(F.col("src_path").alias("source"), F.col("dst_path").alias("target")).distinct()


def crate_graph(ix: CodeIndex) -> DataFrame:
    """Crates with their direct dependencies and whether they are roots or leaves."""
    targets = ix.crates.select(F.col("id").alias("target_crate_id"), F.col("name").alias("t"))
    out = ix.crate_deps.join(targets, "target_crate_id").groupBy(F.col("source_crate_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("depends_on"))
    used = ix.crate_deps.select(F.col("target_crate_id").alias("id")).distinct().withColumn("used", F.lit(True))
    return ix.crates.join(out, "id", "left").join(used, "id", "left").select("name", F.coalesce("depends_on", F.lit("")).alias("depends_on"), F.col("used").isNull().alias("is_root"), F.col("depends_on").isNull().alias("is_leaf"))


def crate_impact(ix: CodeIndex, name: str) -> DataFrame:
    """Crates that define a name and the crates that depend on them: crate, path, role."""
    home = ix.nodes.where(F.col("name") == name).select(F.col("crate_id").alias("id")).distinct()
    up = ix.crate_deps.select(F.col("target_crate_id").alias("src"), F.col("source_crate_id").alias("dst"))
    found = reach(up, home.select(F.lit(0).alias("seed"), "id"), 10)
    return found.join(ix.crates.select("id", "name", "path"), "id").select(F.col("name").alias("crate"), "path", F.when(F.col("depth") == 0, "defines").otherwise("depends").alias("role"))


def dependents_by_segment(crates: DataFrame) -> DataFrame:
    """Crates (crate, path, role) that depend on others, counted by the first segment of their path."""
    return crates.where("role = 'depends'").groupBy(F.substring_index("path", "/", 1).alias("segment")).agg(F.count("*").alias("n"))


def impact_summary(rows: DataFrame) -> DataFrame:
    """Impact rows by depth and file: n_names, n_tests."""
    return rows.groupBy("depth", "path").agg(F.countDistinct("name").alias("names"), F.sum(F.col("is_test").cast("long")).alias("tests"))


def impact_report(rows: DataFrame, tests: DataFrame, summary: bool = True, most: int = 5) -> DataFrame:
    """(section, depth, what, n): impact rows by depth, levels from 2 on with more than `most` rows as counts per file, then tests not named yet."""
    sizes = rows.groupBy("depth").agg(F.count("*").alias("size"))
    folded = (F.col("depth") >= 2) & (F.col("size") > most) & F.lit(summary)
    sized = rows.join(F.broadcast(sizes), "depth")
    files = sized.where(folded).groupBy("depth", "path").agg(F.count("*").alias("n")).select(F.lit("file").alias("section"), "depth", F.col("path").alias("what"), "n")
    single = sized.where(~folded).select(F.lit("symbol").alias("section"), "depth", F.col("via").alias("what"), F.lit(1).cast("long").alias("n"))
    left = tests.join(rows.select("name").distinct(), "name", "left_anti").select(F.lit("test").alias("section"), F.lit(0).alias("depth"), F.col("name").alias("what"), F.lit(1).cast("long").alias("n")).distinct()
    return files.unionByName(single).unionByName(left)
