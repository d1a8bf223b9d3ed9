"""Importance resampling: keep documents in proportion to how much likelier the target makes them.

Both sides are bag models over hashed word unigrams and bigrams with BUCKETS buckets. The raw model
counts all rows; the target model counts a bounded sample of at most TARGET_ROWS rows whose label is
good. A document's log weight is the sum over its n-grams of log p_target - log p_raw; adding a
Gumbel draw (a hash of the id and the seed) and taking the k largest keys samples k documents without
replacement in proportion to their weights. k is the labelled share of good documents times the
number of rows. The k-th key is found exactly by histograms refined until one bin holds few rows.

Null and empty texts have no n-grams and log weight 0. Equal keys are ordered by id, a null id last,
and of fully repeated rows any come first, so exactly k rows are kept. Labels of unknown documents are ignored, as are null
labels; without any good label the weights are 0 and the sample is uniform. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import table, written
from codeatlas.llm.textkernel import mix, words

BUCKETS = 1 << 15
TARGET_ROWS = 20_000
SMOOTHING = 0.5
FEW = 10_000


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, buckets, bounds): the n-gram buckets of rows i to j, as `words` gives words."""
    for i, j, got, bounds in words(column):
        pair = mix(got[:-1] * np.uint64(3) + got[1:]) if len(got) > 1 else got[:0]
        single = (got >> np.uint64(49)).astype(np.int32)
        double = np.full(len(got), -1, dtype=np.int32)
        double[: len(pair)] = (pair >> np.uint64(49)).astype(np.int32)
        last = bounds[1:][np.diff(bounds) > 0] - 1
        double[last] = -1  # a document's last word starts no bigram
        yield i, j, np.stack([single, double], axis=1).reshape(-1), bounds * 2


COUNTS = "bucket int, raw long, target long"


def model(spark: SparkSession, docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            good = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for i, j, got, bounds in features(b.column(0)):
                raw += np.bincount(got[got >= 0], minlength=BUCKETS)
                mine = np.repeat(good[i:j], np.diff(bounds))
                target += np.bincount(got[mine & (got >= 0)], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counts = np.zeros((BUCKETS, 2))
    for r in flagged.mapInArrow(run, COUNTS).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        counts[r.bucket] = r.raw, r.target
    if not counts[:, 1].any():
        return np.zeros(BUCKETS)
    p = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)
    return np.log(p[:, 1]) - np.log(p[:, 0])


def threshold(rows: DataFrame, k: int, columns: list[str], few: int = FEW) -> list:
    """Values of the k-th row by numeric columns, all descending; exact, by refining histograms of one after the other."""
    column, *rest = columns
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        if low == high:
            return [low, *(threshold(inside, k - above, rest, few) if rest else [])]
        if inside.limit(few + 1).count() <= few:
            return list(sorted(map(tuple, inside.select(*columns).collect()), reverse=True)[k - above - 1])
        width = (float(high) - float(low)) / 1024
        bin_of = F.least(F.lit(1023), F.floor((F.col(column).cast("double") - float(low)) / width))
        bins = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                low, high = bins[b][1], bins[b][2]
                break
            above += bins[b][0]


SCORED = "uid long, doc_id long, n_features long, log_weight double"


OUT = ("doc_id", "n_features", "log_weight", "key")


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, n_features, log_weight, key, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_number = docs.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text")
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = judged.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if share is None:
        n_good, n_all = judged.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
        share = n_good / n_all if n_all else 0.5
    sample = good.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(TARGET_ROWS)
    ratio = spark.sparkContext.broadcast(np.append(model(spark, docs, sample), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, weight = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows)
            for i, j, got, bounds in features(b.column(2)):
                running = np.concatenate([[0.0], np.cumsum(ratio.value[got])])
                present = np.concatenate([[0], np.cumsum(got >= 0)])
                weight[i:j], count[i:j] = np.diff(running[bounds]), np.diff(present[bounds])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count), pa.array(np.round(weight, 6))], ["uid", "doc_id", "n_features", "log_weight"])

    draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit("gumbel"), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.col("log_weight") - F.log(-F.log(draw))
    # columns that all descend: the key, then smaller ids first with null ids last, then the row number
    scored = written(spark, with_number.mapInArrow(run, SCORED).withColumns({"key": key, "by_id": F.coalesce((-F.lit(1).cast("long") - F.col("doc_id")), F.lit(-(1 << 63))), "by_row": -F.col("uid")}), "scored")
    k = round(share * scored.count())
    if k == 0:
        return scored.select(*OUT, F.lit(False).alias("kept"))
    last = threshold(scored, k, ["key", "by_id", "by_row"])
    kept = F.struct("key", "by_id", "by_row") >= F.struct(*[F.lit(v).cast(t) for v, t in zip(last, ("double", "long", "long"), strict=True)])
    return scored.select(*OUT, kept.alias("kept"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
