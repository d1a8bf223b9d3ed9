"""Line dedup over content-defined chunks of lines.

1. From every line (ends stripped, blank lines left out) the shortest chunk of two lines and
   MIN_WORDS words or more is taken, to every line the shortest one that ends there, and each line
   of LONG_LINE words. Boundaries depend on content only and so survive shifts. These chunks cover
   every passage that two documents share, wherever it starts and ends in each of them.
2. Chunks whose hash occurs in two documents at least are looked up in the texts and compared byte
   by byte. The first occurrence (smallest id, then position) stays, every other one is removed with
   its line ends. A line's first occurrence of all is never removed, so no content is lost.

Null texts stay null, empty ones empty. Very long texts are one row each, as they came. Repeated
rows are documents of their own only if their ids differ: of equal ids, each row loses what its id
loses; a null id loses nothing. An empty table gives an empty result. Extra columns are kept by
`dedup_lines` and may have any name; its own two come last, with an underscore behind where taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import fresh, table, written

MIN_WORDS, LONG_LINE = 20, 50
BLANKS = " \t\r\x0b\x0c"
#: Chunks with more occurrences than all / HOT are looked up by a broadcast of at most HOT rows.
HOT = 1000
#: Bytes of chunks in one Arrow batch, about.
BATCH = 1 << 24

CHUNKS = "doc_id long, first int, last int, hash long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shortest(words: list[int]) -> set[tuple[int, int]]:
    """(first, last) of the shortest chunks from and to each line, of two lines and MIN_WORDS words at least."""
    out: set[tuple[int, int]] = set()
    total = [0, *accumulate(words)]
    last = 0
    for first in range(len(words) - 1):
        last = max(last, first + 1)
        while last < len(words) and total[last + 1] - total[first] < MIN_WORDS:
            last += 1
        if last == len(words):
            break
        out.add((first, last))
    first = 0
    for last in range(1, len(words)):
        while first + 1 < last and total[last + 1] - total[first + 1] >= MIN_WORDS:
            first += 1
        if total[last + 1] - total[first] >= MIN_WORDS:
            out.add((first, last))
    return out


def chunks_of(text: str) -> Iterator[tuple[int, int, int]]:
    """(first, last, hash) of the chunks and the long lines of a text; blank lines count only in the line numbers."""
    at, hashes, words = [], bytearray(), []
    for k, line in enumerate(text.split("\n")):
        bare = line.strip(BLANKS).encode()
        if bare:
            at.append(k)
            hashes += xxhash.xxh3_64_digest(bare)
            words.append(len(bare.split()))
    for i, j in shortest(words) | {(i, i) for i, n in enumerate(words) if n >= LONG_LINE}:
        yield at[i], at[j], _signed(xxhash.xxh3_64_intdigest(bytes(hashes[8 * i : 8 * j + 8])))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, hash) of the chunks of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        for b in batches:
            out = [(doc, *x) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in chunks_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, CHUNKS)


TEXTS = "doc_id long, first int, last int, hash long, chunk binary"


def chunk_texts(docs_with_spans: DataFrame) -> DataFrame:
    """The bytes of each span of (doc_id, text, spans) rows, line by line without white space at the ends and blank lines."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], ["doc_id", "first", "last", "hash", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for doc, text, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                lines = [x.strip(BLANKS) for x in text.split("\n")]
                for s in spans:
                    part = "\n".join(filter(None, lines[s["first"] : s["last"] + 1])).encode()
                    out.append((doc, s["first"], s["last"], s["hash"], part))
                    size += len(part)
                    if size >= BATCH:
                        yield batch(out)
                        out, size = [], 0
            yield batch(out)

    return docs_with_spans.mapInArrow(run, TEXTS)


def looked_up(rows: DataFrame, classes: DataFrame, on: list[str], total: int) -> DataFrame:
    """`rows` inner join `classes` (unique by `on`, with their size in `n`), classes of many rows apart."""
    hot, cold = classes.where(F.col("n") * HOT > total).drop("n"), classes.where(F.col("n") * HOT <= total).drop("n")
    by_hot = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return by_hot.unionByName(rest)


def removals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): line spans to remove, from (doc_id, text) rows."""
    chunks = written(spark, chunk_rows(docs), "chunks")
    total = chunks.count()
    occurring = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("hash", "n")
    shared = looked_up(chunks, written(spark, occurring, "occurring"), ["hash"], total).distinct()
    spans = shared.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "hash")).alias("spans"))
    with_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    texts = chunk_texts(with_text.join(spans, "doc_id").select("doc_id", "text", "spans"))
    # grouping by the bytes themselves separates chunks whose hashes merely collide
    marked = written(spark, texts.withColumn("digest", F.sha2("chunk", 256)), "chunk_texts")
    first = marked.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "first")).alias("keep"), F.min("digest").alias("digest"), F.max("doc_id").alias("b"))
    keep = first.where("keep.doc_id <> b").select("hash", "digest", "n", F.col("keep.doc_id").alias("k_doc"), F.col("keep.first").alias("k_first"))
    hit = looked_up(marked.drop("chunk"), written(spark, keep, "kept"), ["hash", "digest"], total)
    return hit.where("doc_id <> k_doc OR first <> k_first").select("doc_id", "first", "last").distinct()


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with repeated chunks removed from `text`, and lines_in and lines_removed added behind."""
    names: list[str] = []
    for wanted in ("gone", "id", "left", "lines_in", "lines_removed"):
        names.append(fresh([*docs.columns, *names], wanted))
    span, key, left, lines_in, lines_removed = names
    gone = removals(spark, docs).groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(span))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists(span, lambda g: (i >= g["first"]) & (i <= g["last"])))
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = joined.withColumn(left, F.when(F.col(span).isNotNull(), kept)).withColumns(
        {
            lines_in: size,
            lines_removed: F.when(F.col(left).isNull(), F.lit(0)).otherwise(size - F.size(left)).cast("long"),
            "text": F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
        }
    )
    return out.select(*docs.columns, lines_in, lines_removed)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
