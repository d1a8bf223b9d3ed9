"""Keyword scorers over corpora of rules, examples and decisions, and budgeted prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def terms(q: str) -> list[str]:
    return q.lower().split()


def _per_term(q: str, weights: dict[str, int], lists: dict[str, int]) -> Column:
    score = F.lit(0)
    for t in terms(q):
        for column, w in weights.items():
            score = score + F.when(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(t)), w).otherwise(0)
        for column, w in lists.items():
            score = score + F.size(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(t)))) * w  # noqa: B023
    return score


def score_rules(rules: DataFrame, q: str) -> DataFrame:
    """(pos, category, triggers, summary): terms in category 5, each trigger 10, summary 2; the whole query 20 and 30."""
    whole = " ".join(terms(q))
    score = _per_term(q, {"category": 5, "summary": 2}, {"triggers": 10})
    score = score + F.when(F.lower(F.coalesce("category", F.lit(""))) == whole, 20).otherwise(0) + F.size(F.filter(F.coalesce("triggers", F.array().cast("array<string>")), lambda x: F.lower(x) == whole)) * 30
    return rules.withColumn("score", score.cast("long")).where("score > 0")


def adjust_style(scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Project overrides (id, severity, note): ignored rules go, demoted halve, elevated double."""
    joined = scored.join(overrides.select("id", "severity", "note"), "id", "left").where("severity IS NULL OR severity <> 'ignored'")
    changed = F.when(F.col("severity") == "demoted", F.expr("score div 2")).when(F.col("severity") == "elevated", F.col("score") * 2).otherwise(F.col("score"))
    return joined.withColumn("score", changed).where("score > 0")


def token_estimate(columns: list[str], project: Column | None = None, note: str | None = None) -> Column:
    """A quarter of the bytes of the columns and of what is written around them, rounded up."""
    size = F.lit(88)
    for c in columns:
        size = size + F.octet_length(F.coalesce(c, F.lit("")))
    if project is not None:
        size = size + F.when(project, 28 + F.octet_length("id")).otherwise(0)
    if note is not None:
        size = size + F.coalesce(17 + F.octet_length(note), F.lit(0))
    return F.floor((size + 3) / 4).cast("long")


def top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "pos").limit(limit)


def within_budget(scored: DataFrame, cost: Column, budget: int) -> DataFrame:
    """The longest prefix by (score desc, pos) whose costs fit the budget; for ranked, already limited rows."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "pos").rowsBetween(W.unboundedPreceding, 0)
    return scored.withColumn("spent", F.sum(cost).over(order)).where(F.col("spent") <= budget)


def score_examples(rows: DataFrame, q: str) -> DataFrame:
    whole = " ".join(terms(q))
    score = _per_term(q, {"category": 5, "description": 2}, {"triggers": 10})
    score = score + F.when(F.lower(F.coalesce("category", F.lit(""))) == whole, 20).otherwise(0) + F.size(F.filter(F.coalesce("triggers", F.array().cast("array<string>")), lambda x: F.lower(x) == whole)) * 30
    return rows.withColumn("score", score.cast("long")).where("score > 0")


def score_decisions(rows: DataFrame, q: str) -> DataFrame:
    whole = " ".join(terms(q))
    score = _per_term(q, {"title": 10, "context": 5, "decision": 5, "consequences": 2, "alternatives": 2}, {})
    score = score + F.when(F.lower("title") == whole, 30).otherwise(0) + F.when(F.lower("status") == whole, 20).otherwise(0)
    return rows.withColumn("score", score.cast("long")).where("score > 0")


def matching_failures(rows: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Known failures any trigger term of which occurs in the text."""
    hay = F.lit(text.lower())
    return rows.where(F.exists("trigger_terms", lambda t: F.contains(hay, F.lower(t)))).orderBy("pos").limit(limit)


def style_errors(axioms: DataFrame, universal: DataFrame, version: int) -> DataFrame:
    """Problems of a project's own rules (id): wrong version, prefix, repeats, shadowing."""
    out = axioms.where(~F.startswith("id", F.lit("project_"))).select("id", F.lit("prefix").alias("problem"))
    out = out.unionByName(axioms.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem")))
    out = out.unionByName(axioms.join(universal.select("id"), "id", "left_semi").select("id", F.lit("shadows").alias("problem")))
    return out if version == 1 else out.unionByName(axioms.sparkSession.createDataFrame([("", "version")], "id string, problem string"))


def decision_errors(rows: DataFrame) -> DataFrame:
    bad_date = F.expr("try_to_date(date, 'yyyy-MM-dd') IS NULL") | ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")
    out = rows.where(~F.startswith("id", F.lit("decision_"))).select("id", F.lit("prefix").alias("problem"))
    out = out.unionByName(rows.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem")))
    return out.unionByName(rows.where(bad_date).select("id", F.lit("date").alias("problem")))
