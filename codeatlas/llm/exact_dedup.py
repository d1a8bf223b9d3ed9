"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

1. One scan counts the rows of each hash of a normalised text (map-side combined).
2. The directory starts with one bucket and doubles: a bucket of more distinct hashes than the
   capacity is split by one more bit of the hash until it fits or the directory has `max_depth` bits.
   It works on a histogram of distinct hashes by their low `max_depth` bits, so the driver holds at
   most 2**max_depth numbers whatever the corpus. Runs of buckets of about equal size get an owner.
3. Rows are dealt to the owner tasks with their texts. An owner sorts its key range by hash and
   text: equal hashes form a chain, whose links are told apart by the bytes of the texts, so texts
   that merely collide stay apart. Each row takes its link's outcome there, and the index entries
   (id, hash, digest, bucket, outcome) go to the shared folder, owner by owner.
4. Hashes of more than 1 / HOT_LINKS of all rows, at most HOT_LINKS of them, have no owner: their
   chains are combined on the map side, and rows look them up by a broadcast of a few rows each.

Null texts count as empty; white-space-only and empty texts are equal to each other. Exactly one row
of a group stays: ties on length go to the smallest id, a null id last, and of fully repeated rows any
one. keep_id is the id of the row that stays (null if that is null). An empty table gives an empty
result. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeatlas.llm.common import table, without_white_space, written

#: At most so many links have more than 1 / HOT_LINKS of all rows each.
HOT_LINKS = 1000


def directory(histogram: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """(low bits, local depth, entries) of each bucket after doubling and splitting.

    `histogram` counts entries by their low `max_depth` bits.
    """
    buckets = {(0, 0): dict(histogram)}
    depth = 0
    while depth < max_depth and any(sum(b.values()) > capacity for (_, d), b in buckets.items() if d == depth):
        depth += 1
        for (bits, local), own in list(buckets.items()):
            if local == depth - 1 and sum(own.values()) > capacity:
                del buckets[bits, local]
                for side in (0, 1):
                    prefix = bits | side << local
                    buckets[prefix, depth] = {k: n for k, n in own.items() if k & ((1 << depth) - 1) == prefix}
    return sorted((bits, local, sum(own.values())) for (bits, local), own in buckets.items())


def owners(split: list[tuple[int, int, int]], tasks: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, owner) of a directory: each slot's bucket, and runs of buckets of about equal size."""
    depth = max(d for _, d, _ in split)
    share = max(1, -(-sum(n for *_, n in split) // tasks))
    out, seen = [], 0
    for bucket, (bits, local, n) in enumerate(split):
        out += [(slot, bucket, seen // share) for slot in range(bits, 1 << depth, 1 << local)]
        seen += n
    return out


def exact_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, max_depth: int = 14, hot_links: int = HOT_LINKS
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256, bucket."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = text.select("id", without_white_space(F.col("t")).alias("norm"), F.char_length("t").cast("long").alias("n")).withColumn("h", F.xxhash64("norm"))
    hashes = written(spark, rows.groupBy("h").agg(F.count("*").alias("rows")), "hashes")
    total = hashes.agg(F.sum("rows")).first()[0] or 0
    low = F.col("h").bitwiseAND(F.lit((1 << max_depth) - 1))
    split = directory({r.low: r.n for r in hashes.groupBy(low.alias("low")).agg(F.count("*").alias("n")).collect()}, capacity, max_depth)
    depth = max(d for _, d, _ in split)
    slots = spark.createDataFrame(owners(split, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "slot long, bucket int, owner int")
    hot = hashes.where(F.col("rows") * hot_links > total).select("h")
    numbers = rows.withColumns({"uid": F.monotonically_increasing_id(), "slot": F.col("h").bitwiseAND(F.lit((1 << depth) - 1))}).join(F.broadcast(slots), "slot")

    link = W.partitionBy("owner", "h", "norm")
    best = link.orderBy(F.desc("n"), F.asc_nulls_last("id"), "uid")
    owned = numbers.join(F.broadcast(hot), "h", "left_anti").repartition("owner")
    owned = owned.select("id", "bucket", "norm", F.first("id").over(best).alias("keep"), F.count("*").over(link).alias("size"), (F.row_number().over(best) == 1).alias("kept"))
    index = written(spark, owned.select("id", "keep", "size", "kept", F.sha2("norm", 256).alias("digest"), "bucket"), "buckets")

    spread = written(spark, numbers.join(F.broadcast(hot), "h", "left_semi").select("id", "uid", "n", "h", "bucket", F.sha2("norm", 256).alias("digest")), "hot_rows")
    links = rows.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("size")).select("h", F.sha2("norm", 256).alias("digest"), "size")
    order = F.struct((-F.col("n")).alias("m"), F.col("id").isNull().alias("unnamed"), "id", "uid")
    chosen = spread.groupBy("h", "digest").agg(F.min(order).alias("best")).join(links, ["h", "digest"])
    looked = spread.join(F.broadcast(chosen), ["h", "digest"]).select("id", F.col("best.id").alias("keep"), "size", (F.col("uid") == F.col("best.uid")).alias("kept"), "digest", "bucket")
    return index.unionByName(looked).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"), "bucket"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("bucket")


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-len, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
