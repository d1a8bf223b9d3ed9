"""Best-fit packing by bin completion over the histogram of lengths.

A document is its token ids and a final end id. Documents longer than the capacity are cut into
pieces of the capacity, the last one shorter; all others stay whole. Since only lengths matter for
packing, the plan is made on the histogram of piece lengths, which has at most `capacity` entries
whatever the corpus: the largest length left opens a sequence, a branch-and-bound over undominated
fillings (larger items first, best-fit as the first incumbent, pruned by the waste still possible)
completes it, and the pattern found is used as often as the histogram allows, which uses some length
up, so there are at most `capacity` patterns. Pieces are numbered per length by (task, order in the
task) and look their place up in the plan.

The search of one pattern ends after NODES nodes with the best filling found. The plan needs at least
ceil(tokens / capacity) sequences, and `excess` tells by how many it misses that bound.

Null texts are empty documents: one piece holding the end id. An empty table gives no pieces. Ties
between equal lengths are dealt in scan order, frozen by a written table; repeated ids each give
their own pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeatlas.llm.common import table, written

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task remembers; beyond it the memory is emptied.
CACHE_WORDS = 800_000
#: Nodes of the search for one filling.
NODES = 4000


TAIL = ".,!?;:"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes as they are, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of white-space-free words as little-endian bytes, by `tokenizers`.

    The tokenizer drops white space before it merges, and neither its normaliser nor its split
    looks across white space, so a text's ids are those of its words in order. A word of Latin
    letters with a tail of punctuation is split there as the tokenizer would and its letters go to
    the model's merges directly; every other word takes the whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.parts: dict[str, bytes] = {"": b""}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS or len(self.parts) > CACHE_WORDS:
            self.clear()
            self.parts = {"": b""}
        text = word.decode()
        core = text.rstrip(TAIL)
        if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
            core, tail = core.lower(), text[len(core) :]
            got = self.parts.get(core)
            if got is None:
                spelled = core if core.isascii() else "".join(self.alphabet[b] for b in core.encode())
                got = self.parts[core] = np.array([t.id for t in self.merge(spelled)], dtype="<u4").tobytes()
            end = self.parts.get(tail)
            if end is None:
                end = self.parts[tail] = self.whole(tail)
            got += end
        else:
            got = self.whole(text)
        self[word] = got
        return got

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of (doc_id, text) rows with their number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, words, seen = TaskContext.get().partitionId(), WordIds(tokenizer_path), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = words.ids(text or "") + end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, a // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            names = [c.split()[0] for c in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """The filling that takes the largest item that still fits, again and again."""
    out: list[int] = []
    for x in lengths:
        times = min(left[x], room // x)
        out += [x] * times
        room -= x * times
    return out


def undominated(filling: list[int], room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """`filling` with items exchanged for larger unused ones that fit in the waste, until none does.

    A filling in which one item can give way to a larger one is dominated by the one after the exchange.
    """
    used: dict[int, int] = {}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    waste = room - sum(filling)
    ascending = lengths[::-1]
    while waste:
        best = None
        for y in (0, *used):
            k = bisect_right(ascending, y + waste) - 1
            while k >= 0 and ascending[k] > y and used.get(ascending[k], 0) >= left[ascending[k]]:
                k -= 1
            if k >= 0 and ascending[k] > y and (best is None or ascending[k] - y > best[1] - best[0]):
                best = (y, ascending[k])
        if best is None:
            break
        y, x = best
        used[x] = used.get(x, 0) + 1
        if y:
            used[y] -= 1
            if not used[y]:
                del used[y]
        waste -= x - y
    return sorted((x for x, n in used.items() for _ in range(n)), reverse=True)


def complete(counts: np.ndarray, capacity: int, largest: int, slack: int, nodes: int = NODES) -> list[int]:
    """The best filling found around one item of length `largest`, largest items first.

    Branch and bound: the best-fit filling, freed of dominating exchanges, is the first incumbent.
    Each node takes the largest item that still fits or skips that length; a branch is cut when even
    using all that fits can't beat the incumbent. A filling that does is freed of dominating exchanges
    before it becomes the incumbent. Stops at waste 0; after half of the nodes also at `slack`, the
    waste that the remaining sequences can afford without needing one more than the bound.
    """
    room = capacity - largest
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1]]
    left = {x: int(counts[x]) - (x == largest) for x in lengths}
    lengths = [x for x in lengths if left[x]]
    best = undominated(best_fit(room, lengths, left), room, lengths, left)
    best_sum, budget = sum(best), nodes
    # stack of (index into lengths, chosen, sum)
    stack: list[tuple[int, tuple[int, ...], int]] = [(0, (), 0)]
    descending = -np.array(lengths)
    suffix = np.cumsum([x * left[x] for x in lengths][::-1])[::-1] if lengths else np.empty(0)
    while stack and budget and best_sum < room:
        if budget < nodes // 2 and room - best_sum <= slack:
            break
        budget -= 1
        i, chosen, total = stack.pop()
        if total > best_sum:
            best = undominated(list(chosen), room, lengths, left)
            best_sum = sum(best)
        free = room - total
        if i < len(lengths) and lengths[i] > free:
            i = int(np.searchsorted(descending, -free))
        if i >= len(lengths) or total + min(free, int(suffix[i])) <= best_sum:
            continue
        x = lengths[i]
        used = sum(1 for c in chosen if c == x)
        stack.append((i + 1, chosen, total))
        if used < left[x]:
            stack.append((i, (*chosen, x), total + x))
    return best


def excess(patterns: list[tuple[list[int], int]], capacity: int = CAPACITY) -> int:
    """By how many sequences a plan misses the bound of its total length."""
    total = sum(sum(filling) * times for filling, times in patterns)
    return sum(times for _, times in patterns) - -(-total // capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, times) that use up the histogram."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    total = int((counts * np.arange(capacity + 1)).sum())
    slack = -total % capacity
    out = []
    top = capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        filling = [top, *complete(counts, capacity, top, slack)]
        need: dict[int, int] = {}
        for x in filling:
            need[x] = need.get(x, 0) + 1
        times = min(int(counts[x]) // k for x, k in need.items())
        slack = max(0, slack - times * (capacity - sum(filling)))
        for x, k in need.items():
            counts[x] -= k * times
        out.append((filling, times))


def lookup(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, rank): which sequence and offset a rank of a length gets."""
    rows, ranks, first = [], {}, 0
    for filling, times in patterns:
        offset = 0
        slots: dict[int, list[int]] = {}
        for x in filling:
            slots.setdefault(x, []).append(offset)
            offset += x
        for x, at in slots.items():
            for s in at:
                rows.append((x, ranks.get(x, 0), first, s))
                ranks[x] = ranks.get(x, 0) + times
        first += times
    rows.sort()
    length, rank, seq, offset = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((),) * 4))
    return {"key": (length << 44) | rank, "length": length, "rank": rank, "seq": seq, "offset": offset}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of (doc_id, text) rows with their sequence and offset."""
    pieces = written(spark, cut_pieces(docs, tokenizer_path, capacity), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = spark.sparkContext.broadcast(lookup(plan(histogram, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = at.value
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), (b["before"] + b["nth"]).to_numpy(np.int64)
            i = np.searchsorted(p["key"], (length << 44) | rank, "right") - 1
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "start": b["start"], "length": length, "ids_crc32": b["ids_crc32"], "sequence_id": p["seq"][i] + rank - p["rank"][i], "offset": p["offset"][i]})

    return pieces.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInPandas(place, PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
