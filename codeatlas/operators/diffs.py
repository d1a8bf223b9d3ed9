"""Diff, blame, log and status text as rows, detectors over hunks, and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_lines(rows: DataFrame, column: str = "text") -> DataFrame:
    """(id, pos, line) of (id, text) rows."""
    return rows.select("id", F.posexplode(F.split(column, "\n")).alias("pos", "line"))


def _fill(value, keep: str = "id"):  # noqa: ANN001, ANN202
    return F.last(value, ignorenulls=True).over(W.partitionBy(keep).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))


def hunk_ranges(diffs: DataFrame) -> DataFrame:
    """(id, path, start, end) of the new side of each hunk of (id, text) unified diffs."""
    rows = text_lines(diffs)
    named = F.when(F.startswith("line", F.lit("+++ b/")), F.expr("substr(line, 7)")).when(F.startswith("line", F.lit("+++ ")), F.lit(""))
    head = r"^@@ .*?\+(\d+)(?:,(\d+))? @@"
    hunks = rows.withColumn("path", _fill(named)).where(F.col("line").rlike(head) & (F.coalesce("path", F.lit("")) != ""))
    n = F.regexp_extract("line", head, 2)
    sized = hunks.select("id", "path", F.regexp_extract("line", head, 1).cast("long").alias("start"), F.when(n == "", F.lit(1)).otherwise(n.cast("long")).alias("n"))
    return sized.where("n > 0").select("id", "path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def hunk_lines(diffs: DataFrame, suffix: str = ".rs", most: int = 16 << 20) -> DataFrame:
    """(id, path, hunk, seq, line_no, text, is_added): added and context lines with their new numbers.

    A diff of more than `most` bytes is an error, never an empty result.
    """
    sized = F.when(F.octet_length("text") > most, F.raise_error(F.concat(F.lit("diff "), F.col("id").cast("string"), F.lit(" is too large")))).otherwise(F.col("text"))
    rows = text_lines(diffs.select("id", sized.cast("string").alias("text")))
    named = F.when(F.startswith("line", F.lit("+++ b/")), F.expr("substr(line, 7)")).when(F.startswith("line", F.lit("+++ ")), F.lit(""))
    head = r"^@@ .*?\+(\d+)"
    rows = rows.withColumns({"path": _fill(named), "is_head": F.col("line").rlike(head)})
    rows = rows.withColumn("hunk", F.sum(F.col("is_head").cast("int")).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("start", _fill(F.when(F.col("is_head"), F.regexp_extract("line", head, 1).cast("long"))))
    first = F.substring("line", 1, 1)
    body = rows.where(~F.col("is_head") & (F.col("hunk") > 0) & first.isin("+", " ") & ~F.startswith("line", F.lit("+++ ")) & F.endswith("path", F.lit(suffix)))
    seq = F.row_number().over(W.partitionBy("id", "hunk").orderBy("pos"))
    return body.withColumn("seq", seq).select("id", "path", "hunk", "seq", (F.col("start") + F.col("seq") - 1).alias("line_no"), F.expr("substr(line, 2)").alias("text"), (first == "+").alias("is_added"))


def critique(diffs: DataFrame) -> DataFrame:
    """Findings (id, path, line_no, rule, severity) over added Rust lines."""
    lines = hunk_lines(diffs)
    hunk = W.partitionBy("id", "hunk").orderBy("seq")
    before = F.lag("text").over(hunk)
    safety = F.max(F.contains("text", F.lit("# Safety"))).over(hunk.rowsBetween(-20, -1))
    lines = lines.withColumns({"before": before, "documented": F.coalesce(safety, F.lit(False))}).where("is_added")
    code = F.trim("text")
    bare = lines.where(code.rlike(r"\bunsafe\s*\{") & ~F.coalesce(F.contains("before", F.lit("// SAFETY:")), F.lit(False)))
    undocumented = lines.where(code.rlike(r"^pub(\([^)]*\))? unsafe fn ") & ~F.col("documented"))
    boxed = lines.withColumn("m", F.explode(F.regexp_extract_all("text", F.lit(r"\bBox<\s*(?:[iu](?:8|16|32|64|128|size)|f32|f64|bool|char)\s*>"), F.lit(0))))
    uninit = lines.where(code.rlike(r"\bmem::uninitialized\b"))
    parts = [(bare, "unsafe_without_safety_comment", "warning"), (undocumented, "unsafe_fn_without_safety_section", "warning"), (boxed, "box_of_copy_primitive", "warning"), (uninit, "mem_uninitialized", "error")]
    out = None
    for df, rule, severity in parts:
        rows = df.select("id", "path", "line_no", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("id", "path", "line_no", "rule")


def gate_scan(diffs: DataFrame) -> DataFrame:
    """Per diff: touched files and Rust files, new public items, unwrap( calls outside tests, unsafe uses; all diffs have a row."""
    rows = text_lines(diffs)
    named = F.when(F.startswith("line", F.lit("+++ b/")), F.expr("substr(line, 7)"))
    touched = rows.select("id", named.alias("path")).where("path IS NOT NULL").groupBy("id").agg(F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.endswith("path", F.lit(".rs")), F.col("path"))).alias("rust_files"))
    lines = hunk_lines(diffs)
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"/\*.*?\*/", " "), r'"(?:[^"\\]|\\.)*"', '""'), "//.*", "")
    lines = lines.withColumn("code", code)
    hunk = W.partitionBy("id", "path", "hunk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    depth = F.sum(F.length("code") - F.length(F.replace(F.col("code"), F.lit("{"), F.lit(""))) - F.length("code") + F.length(F.replace(F.col("code"), F.lit("}"), F.lit("")))).over(hunk)
    opens = F.col("code").rlike(r"^\s*(pub )?mod tests?\b")
    lines = lines.withColumn("depth", depth)
    entered = F.last(F.when(opens, F.col("depth")), ignorenulls=True).over(hunk)
    in_test = (F.coalesce(F.col("depth") >= entered, F.lit(False))) | F.col("path").rlike(r"(^|/)tests/")
    added = lines.withColumn("in_test", in_test).where("is_added")
    counted = added.groupBy("id").agg(
        F.count_if(F.col("code").rlike(r"^\s*pub (fn|struct|enum|trait|const|type|mod|use) ") & ~F.col("in_test")).alias("public_items"),
        F.count_if(F.contains("code", F.lit("unwrap(")) & ~F.col("in_test")).alias("unwraps"),
        F.count_if(F.col("code").rlike(r"\bunsafe\b")).alias("unsafe_uses"),
    )
    out = diffs.select("id", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty")).join(touched, "id", "left").join(counted, "id", "left")
    return out.fillna(0, ["files", "rust_files", "public_items", "unwraps", "unsafe_uses"])


#: What says that there is no evidence, and what claims performance in a task or plan.
NO_EVIDENCE = ("", "none", "n/a", "na", "not run", "not applicable")
PERFORMANCE = ("performance", "speed", "faster", "latency", "throughput", "optimize", "optimise", "benchmark")


def has_evidence(column: str):  # noqa: ANN201
    return ~F.lower(F.trim(F.coalesce(column, F.lit("")))).isin(*NO_EVIDENCE)


def quality_gate(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """(id, verdict, reasons) of requests (id, task, plan, docs_verified, impact_checked, tests_run, performance_evidence, safety_notes).

    Rust diffs need a plan, verified docs and tests; public edits without impact and empty diffs only warn.
    """
    rows = requests.join(scans, "id", "left").fillna(0, ["files", "rust_files", "public_items", "unwraps", "unsafe_uses"]).fillna(True, ["empty"])
    rust = F.col("rust_files") > 0
    claim = F.lower(F.concat_ws(" ", F.coalesce("task", F.lit("")), F.coalesce("plan", F.lit(""))))
    claims = F.exists(F.array(*[F.lit(w) for w in PERFORMANCE]), lambda w: F.contains(claim, w))
    blocked = F.array_compact(
        F.array(
            F.when(rust & ~has_evidence("plan"), "no plan"),
            F.when(rust & ~has_evidence("docs_verified"), "no docs verified"),
            F.when(rust & ~has_evidence("tests_run"), "no tests run"),
            F.when(F.col("unwraps") > 0, "unwrap outside tests"),
            F.when((F.col("unsafe_uses") > 0) & ~has_evidence("safety_notes"), "unsafe without safety notes"),
            F.when(claims & ~has_evidence("performance_evidence"), "performance claim without evidence"),
        )
    )
    warned = F.array_compact(
        F.array(F.when((F.col("public_items") > 0) & ~has_evidence("impact_checked"), "public items without impact check"), F.when(F.col("empty"), "no changes"))
    )
    verdict = F.when(F.size(blocked) > 0, "BLOCKED").when(F.size(warned) > 0, "WARN").otherwise("PASS")
    return rows.select("id", verdict.alias("verdict"), F.array_join(F.concat(blocked, warned), "; ").alias("reasons"))


def blame_lines(blames: DataFrame) -> DataFrame:
    """(id, commit, author, date, summary) per line of porcelain blame text."""
    rows = text_lines(blames).withColumn("commit", _fill(F.when(F.col("line").rlike("^[0-9a-f]{40} "), F.substring("line", 1, 40))))
    # a commit's header appears once; later lines of the commit take it from there
    def header(tag: str):  # noqa: ANN202
        own = F.when(F.startswith("line", F.lit(tag + " ")), F.expr(f"substr(line, {len(tag) + 2})"))
        return F.max(own).over(W.partitionBy("id", "commit"))

    rows = rows.withColumns({"author": header("author"), "time": header("author-time"), "summary": header("summary")}).where(F.startswith("line", F.lit("\t")))
    return rows.select("id", "commit", "author", F.date_format(F.timestamp_seconds(F.col("time").cast("long")), "yyyy-MM-dd").alias("date"), "summary")


def blame_summary(lines: DataFrame) -> DataFrame:
    """Lines and share per author, with the latest date."""
    per = lines.groupBy("id", "author").agg(F.count("*").alias("lines"), F.max("date").alias("latest"))
    total = F.sum("lines").over(W.partitionBy("id"))
    return per.select("id", "author", "lines", F.floor(F.col("lines") * 100 / total).cast("long").alias("percent"), "latest")


def log_entries(logs: DataFrame) -> DataFrame:
    """(id, n, commit, author, date, subject, body) of NUL-separated log blocks."""
    blocks = logs.select("id", F.posexplode(F.filter(F.split("text", "\u0000"), lambda b: F.trim(b) != "")).alias("n", "block"))
    parts = F.split(F.ltrim("block"), "\n")
    return blocks.select("id", "n", F.get(parts, 0).alias("commit"), F.get(parts, 1).alias("author"), F.get(parts, 2).alias("date"), F.get(parts, 3).alias("subject"), F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "\n").alias("body"))


def log_diffs(logs: DataFrame, most: int = 60) -> DataFrame:
    """(id, commit, seq, line): changed and hunk lines of each commit of a log with diffs, at most `most` each."""
    rows = text_lines(logs).withColumn("commit", _fill(F.when(F.col("line").rlike("^commit [0-9a-f]{7,40}"), F.expr("substr(line, 8)"))))
    kept = rows.where("commit IS NOT NULL" ).where(F.col("line").rlike(r"^(\+|-|@@)"))
    return kept.withColumn("seq", F.row_number().over(W.partitionBy("id", "commit").orderBy("pos"))).where(F.col("seq") <= most).select("id", "commit", "seq", "line")


def status_paths(statuses: DataFrame) -> DataFrame:
    return text_lines(statuses).where(F.length("line") >= 4).select("id", F.expr("substr(line, 4)").alias("path"))
