"""Benchmark decontamination by template windows (DataFrame functions only).

Texts are canonicalised: numbers, units after numbers and names (capitalised words inside a
sentence) are marked as typed slots, letters are lower-cased and punctuation is dropped. A window is
WINDOW consecutive tokens, where a slot's token is its type alone; a window with fewer than LITERALS
tokens that are no slots keeps the values as well, so it only meets its equal. Windows of documents
meet the windows of benchmark items by hash and are compared token by token. Along each alignment of
a document with an item the slots must be consistent: one benchmark value always stands against the
same document value and the other way round; windows with a slot that isn't consistent count only if
they are equal with their values. A document is contaminated by an item if COVERAGE of the item's
windows are found in it. An item of fewer than WINDOW tokens has no window; it contaminates a
document one line of which, or all of which, has the item's tokens with their values and no others.

The benchmark's windows are broadcast only if they have at most BROADCAST_ROWS rows; else the join
shuffles by the hash. Items without tokens, empty and null ones match nothing; null and empty
documents are clean. Ties between items go to the smallest id; items with a null id contaminate but
are named last, as null. Repeated rows are judged each by its own text, whatever their ids. Extra
columns are ignored; empty tables give an empty or an all-clean result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import fresh, maybe_broadcast, numbered, table, written

WINDOW, LITERALS, COVERAGE = 5, 3, 0.5
NUMBER, UNIT, NAME = "", "", ""
UNITS = "km|cm|mm|m|kg|mg|g|ml|cl|l|ms|s|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|met(?:er|re)s?|kilomet(?:er|re)s?|miles?|feet|ft|inch(?:es)?|lbs?|pounds?|ounces?|oz|dollars?|euros?|cents?|percent|degrees?|usd|eur|mph|kmh|kwh|kw|w|v|a|hz|%|€|\\$"
_DIGITS = r"[0-9]+(?:[.,:/][0-9]+)*"


#: What stands between tokens: ASCII other than letters and digits, and common typographic marks.
SEPARATOR = r"\x00-/:-@\[-`{-\x7f\u00a0\u00ab\u00bb\u2010-\u2027\u3000-\u3003"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;:] .)\p{Ll}\p{L}*"


def may_have_slots(text: Column) -> Column:
    return text.rlike(f"[0-9{NUMBER}-{NAME}]") | text.rlike(_NAME)


def canonical_tokens(text: Column) -> Column:
    """The tokens of a text; a slot begins with its type's mark and goes on with its value.

    Texts without a digit or name, most of them, only need splitting.
    """
    plain = F.translate(text, NUMBER + UNIT + NAME, "")
    measured = F.regexp_replace(plain, rf"(?<![\p{{L}}\p{{N}}])({_DIGITS}) ?({UNITS})(?![\p{{L}}\p{{N}}])", f" {NUMBER}$1 {UNIT}$2 ")
    counted = F.regexp_replace(measured, rf"(?<![\p{{L}}\p{{N}}{NUMBER}.,:/])({_DIGITS})(?![\p{{L}}\p{{N}}])", f" {NUMBER}$1 ")
    marked = F.regexp_replace(counted, _NAME, f"{NAME}$0")
    slotted = F.split(F.lower(marked), rf"(?:[{SEPARATOR}](?![0-9]))+|\s+")
    return F.array_remove(F.when(may_have_slots(text), slotted).otherwise(F.split(F.lower(text), f"[{SEPARATOR}]+")), "")


def slot_type(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return F.when(first.between(NUMBER, NAME), first).otherwise(token)


def is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).between(NUMBER, NAME)


def window_hashes(tokens: Column, types: Column, literal: Column) -> Column:
    """The hash of each window of a token array: of its types, or of the whole tokens where few are literal.

    `types` and `literal` (1 for tokens that are no slots) are null for texts without slots. All three
    have to be columns, not expressions, which would be computed again for every window.
    """
    span = F.sequence(F.lit(0), F.size(tokens) - WINDOW)
    whole = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)])
    many = lambda i: sum((F.get(literal, i + k) for k in range(WINDOW)), F.lit(0)) >= LITERALS
    typed = F.transform(span, lambda i: F.when(many(i), F.xxhash64(*[F.get(types, i + k) for k in range(WINDOW)])).otherwise(whole(i)))
    return F.when(F.size(tokens) >= WINDOW, F.when(types.isNotNull(), typed).otherwise(F.transform(span, whole)))


def windows(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, at, hash) of every window of (id, text) rows; nulls for texts without one."""
    text = F.coalesce("text", F.lit(""))
    tokens = rows.select(id_col, may_have_slots(text).alias("slots"), canonical_tokens(text).alias("t"))
    kinds = tokens.select(
        id_col,
        "t",
        F.when(F.col("slots"), F.transform("t", slot_type)).alias("types"),
        F.when(F.col("slots"), F.transform("t", lambda t: F.when(is_slot(t), 0).otherwise(1))).alias("literal"),
    )
    hashes = window_hashes(F.col("t"), F.col("types"), F.col("literal"))
    return kinds.select(id_col, hashes.alias("hashes")).select(id_col, F.posexplode_outer("hashes").alias("at", "hash"))


def with_windows(rows: DataFrame, places: DataFrame, id_col: str, name: str) -> DataFrame:
    """`places` (id, at, ...) with the tokens of their windows as column `name`."""
    others = [c for c in places.columns if c != id_col]
    lists = places.groupBy(id_col).agg(F.collect_list(F.struct(*others)).alias("places"))
    tokens = rows.select(id_col, "text").join(lists, id_col).select(id_col, "places", canonical_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    # the generator between keeps the tokens from being computed once per place
    each = tokens.select(id_col, "tokens", F.explode("places").alias("p"))
    return each.select(id_col, *[F.col("p")[c].alias(c) for c in others], F.slice("tokens", F.col("p.at") + 1, WINDOW).alias(name))


def alike(d: Column, b: Column) -> Column:
    """Whether two windows are equal by types, or with their values where few tokens are literal."""
    many = F.size(F.filter(b, lambda t: ~is_slot(t))) >= LITERALS
    return F.when(many, F.transform(d, slot_type) == F.transform(b, slot_type)).otherwise(d == b)


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, at, d, item, q, b) of equal template windows of (uid, text) and (item, text) rows, and the number of windows per item."""
    own = with_windows(items, windows(items, "item").where("hash IS NOT NULL"), "item", "b")
    own = written(spark, own.withColumnRenamed("at", "q"), "item_windows")
    met = written(spark, windows(docs, "uid").join(maybe_broadcast(own.select("hash", "item", "q", "b")), "hash").select("uid", "at", "item", "q", "b"), "met")
    return written(spark, with_windows(docs, met, "uid", "d").where(alike(F.col("d"), F.col("b"))), "matches"), own.groupBy("item").agg(F.countDistinct("q").alias("windows"))


def short_matches(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(uid, item) of items without a window that are one line of a document or all of it; None without such items."""
    tokens = lambda c: canonical_tokens(F.coalesce(c, F.lit("")))
    short = items.select("item", tokens("text").alias("t")).where((F.size("t") > 0) & (F.size("t") < WINDOW)).select("item", F.xxhash64("t").alias("hash"), F.col("t").alias("b"))
    if short.isEmpty():
        return None
    lines = F.array_union(F.array("text"), F.split("text", "\n"))
    # a line of fewer than WINDOW tokens, whatever their length
    few = docs.where("text IS NOT NULL").select("uid", F.explode(lines).alias("line")).select("uid", tokens("line").alias("t")).where((F.size("t") > 0) & (F.size("t") < WINDOW))
    return few.withColumn("hash", F.xxhash64("t")).join(maybe_broadcast(short), "hash").where(F.col("t") == F.col("b")).select("uid", "item").distinct()


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(uid, item, coverage): the items found in each document, one row per pair; rows (uid, text) and (item, text) have unique numbers."""
    found, sizes = matches(spark, docs, items)
    on = ["uid", "item", "shift"]
    aligned = found.withColumn("shift", F.col("at") - F.col("q"))
    slots = (
        aligned.select(*on, "q", F.explode(F.arrays_zip("d", "b")).alias("x"))
        .where(is_slot(F.col("x.b")))
        .select(*on, "q", F.col("x.d").alias("d"), F.col("x.b").alias("b"))
        .distinct()
    )
    values = slots.select(*on, "d", "b").distinct()
    split = values.groupBy(*on, "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    merged = values.groupBy(*on, "d").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    doubtful = slots.join(split, [*on, "b"], "left_semi").select(*on, "q").union(slots.join(merged, [*on, "d"], "left_semi").select(*on, "q")).distinct()
    consistent = aligned.join(doubtful.withColumn("doubt", F.lit(True)), [*on, "q"], "left").where("doubt IS NULL OR d = b")
    share = consistent.groupBy("uid", "item").agg(F.countDistinct("q").alias("n")).join(maybe_broadcast(sizes), "item")
    out = share.select("uid", "item", (F.col("n") / F.col("windows")).alias("coverage")).where(F.col("coverage") >= coverage)
    short = short_matches(docs, items)
    return out if short is None else out.unionByName(short.withColumn("coverage", F.lit(1.0)))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id and coverage of the best item, n_items."""
    rows = numbered(spark, docs.select("doc_id", "text"), "documents")
    items = numbered(spark, benchmark.select("item_id", "text"), "items", "item")
    leaks = contamination(spark, rows.select("uid", "text"), items.select("item", "text"), coverage).join(maybe_broadcast(items.select("item", "item_id")), "item")
    best = F.min(F.struct((-F.col("coverage")).alias("c"), F.col("item_id").isNull().alias("unnamed"), "item_id"))
    hits = leaks.groupBy("uid").agg(best.alias("best"), F.countDistinct("item").alias("n"))
    return rows.select("uid", "doc_id").join(hits, "uid", "left").select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.col("best.item_id").alias("item_id"),
        F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
    )


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item."""
    uid = fresh(docs.columns, "uid")
    rows = numbered(spark, docs, "documents", uid)
    items = numbered(spark, benchmark.select("item_id", "text"), "items", "item")
    leaks = contamination(spark, rows.select(F.col(uid).alias("uid"), "text"), items.select("item", "text"), coverage).select(F.col("uid").alias(uid)).distinct()
    return rows.join(leaks, uid, "left_anti").select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
