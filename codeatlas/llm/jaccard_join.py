"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its n-word shingles. Two documents link when their Jaccard similarity is at
least PERCENT / 100; the result gives each document its component under links.

1. Documents with the same set form a class; everything below works on classes, so groups of
   copies, however large, cost no pairs. A class is named by a 128-bit hash and the size of the set
   and numbered when the classes are written.
2. A sketch of SKETCH counters over all shingles tells frequent shingles from rare ones (more than
   FREQUENT standard deviations above the mean counter). It fixes the global order: rare shingles
   first, each kind by hash. The order and the kinds affect cost only, never the result.
3. Each class indexes a prefix of its ordered shingles: single shingles for rare ones, pairs of
   shingles of one group (CLASSES hash groups) for frequent ones. The prefix is extended until the
   shingles it indexes number one more than a partner may miss, where g frequent shingles of one
   group count g - 1, so linked classes share a signature. Sets of at most SMALL shingles use one
   group; those around SMALL index both ways.
4. Each class is indexed once. First only signatures travel, cut to CUT bits and as differences, to
   find those of more than one class; a filter of them, of FILTER_PER bits for each and at most
   FILTER_MOST, goes back. Other signatures have no pair, and their rows go no further. Beyond that
   size the filter lets more rows pass, never fewer.
5. Index rows are dealt by ranges of (signature, size, class), so that a hot signature spreads over
   tasks. Groups of up to WHOLE rows are compared on the spot by size and by vectors of counts of
   their shingles in bins (the L1 distance of the vectors is at most the size of the symmetric
   difference); rows without a possible partner go. What is left of a group is named by its members:
   signatures of the same members give the same pairs, so one of them stays. Larger groups and those
   cut by a range border keep all their rows and the signature as their name.
6. Groups are dealt by ranges of (group, component, size, class) and cut into tiles of TILE rows. In
   STARS rounds each row proposes its nearest partners of another component in its own tile and, where
   a group has several tiles, the hub: the row nearest to the majority vector of a tile, which is the
   original if the others are edited copies of it. Each class has its best untried proposal verified,
   and links are joined to components. Then all pairs of classes that are still in different
   components are compared by sharper vectors, tile against tile, so no link is lost and neither one
   task's memory nor its time follows a group.
7. Proposals are compared by the sharper vectors (and for large sets by vectors of WIDE counts) under
   the same bound, then verified on the texts.

Joins of texts, vectors and members sort and merge at every size, so that shuffles grow with the input.

Null and blank texts have an empty set and link with nothing, not even each other. Repeated ids
are rows of their own, also with different texts. A null id is no smallest id: a component of null
ids only has a null id. Texts of fewer words than n give their whole sequence as one shingle. Very
long texts are hashed in slices. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import discard, fresh, numbered, small_batches, small_enough, table, written
from codeatlas.llm.components import connected_components
from codeatlas.llm.textkernel import mix, shingle_sets

SKETCH, BLOCK = 1 << 20, 1 << 14
FREQUENT = 8.0
CLASSES, SMALL = 32, 64
#: Bins of the vectors of index rows, of the sharper vectors, and of the vectors of sets of LARGE shingles or more.
FINE, SHARP, WIDE, LARGE = 128, 512, 1024, 400
#: Rows of one signature compared as soon as they meet; rows of a tile; proposals of a row.
WHOLE, TILE, TOP = 256, 1024, 3
#: Rounds of proposals before all pairs of different components are compared.
STARS = 2
#: Bits of the filter that spares most texts the shuffle, of fixed size; and those of one of its rows.
FILTER, FILTER_ROW = 1 << 26, 1 << 15
#: Signatures of one chunk of index rows; bits of signatures that are told apart to find shared ones; ranges they are dealt to, at most.
CHUNK, CUT, RANGES = 1 << 16, 40, 1024
#: Bits of the filter of shared signatures for each of them, and at most in all (both as powers of two).
FILTER_PER, FILTER_MOST = 5, 28
#: Names that a task remembers having given.
SEEN = 200_000
#: Keys of more than 1 / HOT of all rows, at most HOT of them, are joined by broadcast.
HOT = 1000
#: Groups of several tiles, up to which their hubs are broadcast.
HUBS = 50_000
U = np.uint64


def bins(own: np.ndarray) -> np.ndarray:
    """Six numbers: 16 counts of one byte (at most 255), then FINE counts modulo 4 in Gray code.

    The Hamming distance of Gray codes is the circular distance of the counts, at most their difference.
    """
    wide = np.minimum(np.bincount((own >> U(60)).astype(np.int64), minlength=16), 255).astype(np.uint8)
    fine = np.bincount((own >> U(50)).astype(np.int64) & FINE - 1, minlength=FINE).astype(np.uint8) & 3
    fine ^= fine >> 1
    bits = np.stack([fine & 1, fine >> 1]).reshape(-1)
    return np.concatenate([wide, np.packbits(bits)]).view("<i8")


def second_name(n: np.ndarray, v: list[np.ndarray]) -> np.ndarray:
    """The second half of set names, from sizes and the numbers of `bins`."""
    h = mix(n.astype(np.uint64))
    for x in v:
        h = mix(h * U(3) + x.view(np.uint64))
    return h.view(np.int64)


def set_name(own: np.ndarray, vector: np.ndarray) -> tuple[int, int]:
    """128-bit name of a sorted distinct shingle set, as two signed numbers."""
    a = mix(np.array([np.add.reduce(mix(own))], dtype=np.uint64) + U(len(own)))
    return int(a.view(np.int64)[0]), int(second_name(np.array([len(own)]), [vector[k : k + 1] for k in range(len(vector))])[0])


SCAN = "doc_id long, n_shingles long, c1 long, c2 long, block int, counts binary"
SCAN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _batch(schema: str, kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])


def scan(docs: DataFrame, n: int) -> DataFrame:
    """Size and name of every row's set, and, with a block, each task's counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype="<u4")
        for b in batches:
            sizes, c1, c2 = [], [], []
            for _, own in shingle_sets(b.column(1), n):
                np.add.at(counts, (own & U(SKETCH - 1)).astype(np.int64), 1)
                x, y = set_name(own, bins(own))
                sizes.append(len(own))
                c1.append(x)
                c2.append(y)
            yield _batch(SCAN, SCAN_TYPES, [b.column(0), sizes, c1, c2, pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())])
        if counts.any():
            blocks = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, BLOCK)]
            yield _batch(SCAN, SCAN_TYPES, [*(pa.nulls(len(blocks), pa.int64()) for _ in range(4)), range(len(blocks)), blocks])

    return docs.mapInArrow(run, SCAN)


def frequent_buckets(scanned: DataFrame) -> np.ndarray:
    """Which sketch counters stand out, over the shingles of all rows; SKETCH booleans."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])
                part = np.frombuffer(zlib.decompress(counts), dtype="<u4").astype("<i8")
                total = total + part if block == now else part
                now = block
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    partial = scanned.where("block IS NOT NULL").select("block", "counts")
    counts = np.zeros(SKETCH)
    for r in partial.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary").collect():
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, dtype="<i8")
    mean = counts.mean()
    return counts > mean + FREQUENT * math.sqrt(mean) + 4


def signatures(own: np.ndarray, frequent: np.ndarray, percent: int, groups: int) -> np.ndarray:
    """Signatures of one sorted shingle set, frequent flags given per shingle, for one way of grouping."""
    size = len(own)
    needed = size - -(-percent * size // 100) + 1
    rare = own[~frequent]
    if len(rare) >= needed:
        return mix(rare[:needed])
    needed -= len(rare)
    common = own[frequent]
    group = (mix(common) % U(groups)).astype(np.int64)
    # an indexed shingle counts unless it is the first of its group
    seen: set[int] = set()
    stop = 0
    for stop, g in enumerate(group.tolist(), 1):  # noqa: B007
        if g in seen:
            needed -= 1
            if not needed:
                break
        seen.add(g)
    out = [mix(rare)]
    common, group = common[:stop], group[:stop]
    for g in seen:
        mine = mix(common[group == g])
        if len(mine) > 1:
            i, j = np.triu_indices(len(mine), 1)
            out.append(mix(mine[i] * U(3) + mine[j] + U(groups)))
    return np.concatenate(out)


VECTOR = [f"v{k}" for k in range(2 + FINE // 32)]
ROW_NAMES = ["sig", "c1", "n", *VECTOR]
ROWS = "sig long, c1 long, n int, " + ", ".join(f"{v} long" for v in VECTOR)


INDEX_NAMES = ["sigs", "counts", "sizes", "c1", "vectors"]
INDEX = ", ".join(f"{c} binary" for c in INDEX_NAMES)


def index_chunks(spark: SparkSession, docs: DataFrame, classes: DataFrame, n: int, percent: int, flags: np.ndarray) -> DataFrame:
    """Classes in chunks of about CHUNK signatures: all signatures, and of each class their number, its size, name and vector."""
    shared = spark.sparkContext.broadcast(np.packbits(flags))
    firsts = id_filter(spark, classes.where("rep IS NOT NULL").select("rep"))
    least = -(-percent // (100 - percent))  # smaller sets link with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flagged = np.unpackbits(shared.value).astype(bool)
        done: set[tuple[int, int]] = set()
        sigs: list[np.ndarray] = []
        rows: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            sizes, c1, vectors = zip(*rows, strict=True)
            parts = (np.concatenate(sigs), np.array([len(x) for x in sigs], "<i4"), np.array(sizes, "<i4"), np.array(c1, "<i8"), np.stack(vectors))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], INDEX_NAMES)

        for b in batches:
            b = b.filter(pa.array(in_filter(firsts, b.column(1)) | b.column(2).to_numpy(zero_copy_only=False)))
            for _, own in shingle_sets(b.column(0), n):
                if len(own) < least:
                    continue
                vector = bins(own)
                name = set_name(own, vector)
                if name in done:
                    continue
                if len(done) >= SEEN:
                    done.clear()
                done.add(name)
                hot = flagged[(own & U(SKETCH - 1)).astype(np.int64)]
                ways = [g for g, use in ((1, len(own) * percent <= SMALL * 100), (CLASSES, len(own) * 100 >= SMALL * percent)) if use]
                sigs.append(np.unique(np.concatenate([signatures(own, hot, percent, g) for g in ways])))
                rows.append((len(own), name[0], vector))
                size += len(sigs[-1])
                if size >= CHUNK:
                    yield packed()
                    sigs.clear()
                    rows.clear()
                    size = 0
        if size:
            yield packed()

    return with_slots(docs).mapInArrow(run, INDEX)


def coded(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return zlib.compress(np.diff(numbers, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def decoded(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def shared_signatures(spark: SparkSession, index: DataFrame) -> DataFrame:
    """(total, numbers): the first CUT bits of signatures of more than one class, by ranges.

    A chunk sends each of its signatures once, with a last bit that says whether several of its classes have it.
    """
    ranges = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                own, times = np.unique(np.frombuffer(x.as_buffer(), dtype=np.uint64) >> U(64 - CUT), return_counts=True)
                at = (own * U(ranges) >> U(CUT)).astype(np.int32)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                own = own << U(1) | (times > 1)
                yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array([coded(y) for y in np.split(own, starts[1:])], pa.binary())], ["at", "numbers"])

    def met(parts: list[np.ndarray]) -> pa.RecordBatch:
        own = np.sort(np.concatenate(parts))
        value = own >> U(1)
        again = np.concatenate([[False], value[1:] == value[:-1]]) | (own & U(1) == 1)
        value = np.unique(value[again])
        return pa.RecordBatch.from_arrays([pa.array([len(value)], pa.int64()), pa.array([coded(value)], pa.binary())], ["total", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at != now and parts:
                    yield met(parts)
                    parts = []
                now = at
                parts.append(decoded(x))
        if parts:
            yield met(parts)

    dealt = index.select("sigs").mapInArrow(sent, "at int, numbers binary").repartition("at").sortWithinPartitions("at")
    return written(spark, dealt.mapInArrow(run, "total long, numbers binary"), "shared")


def signature_filter(spark: SparkSession, shared: DataFrame):  # noqa: ANN201
    """(bitmap, bits to shift a signature by for its slot) of the signatures of `shared_signatures`."""
    total = shared.agg(F.sum("total")).first()[0] or 0
    size = min(max(total.bit_length() + FILTER_PER, 16), FILTER_MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(1).to_pylist():
                slots = (decoded(x) >> U(CUT - size)).astype(np.int64)
                if len(slots):
                    first = int(slots[0]) >> 3
                    bits = np.zeros(((int(slots[-1]) >> 3) - first + 1) * 8, dtype=np.uint8)
                    bits[slots - first * 8] = 1
                    piece = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([piece], pa.binary())], ["first", "piece"])

    bits = np.zeros((1 << size) >> 3, dtype=np.uint8)
    for r in shared.mapInArrow(run, "first long, piece binary").collect():
        piece = np.frombuffer(zlib.decompress(r.piece), dtype=np.uint8)
        bits[r.first : r.first + len(piece)] |= piece
    return spark.sparkContext.broadcast(bits.tobytes()), 64 - size


def index_rows(index: DataFrame, shared, shift: int) -> DataFrame:  # noqa: ANN001
    """One row for each class and signature that passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                sig, counts, sizes, c1, vectors = (np.frombuffer(b.column(c)[k].as_buffer(), dtype=t) for c, t in enumerate(("<u8", "<i4", "<i4", "<i8", "<i8")))
                keep = np.flatnonzero(in_filter(shared, sig >> U(shift)))
                own = np.repeat(np.arange(len(counts)), counts)[keep]
                vectors = vectors.reshape(-1, len(VECTOR))[own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[keep].view(np.int64), c1[own], sizes[own], *vectors.T)], ROW_NAMES)

    return index.mapInArrow(run, ROWS)


SHARPS = [f"w{k}" for k in range(SHARP // 32)]


def passing(one: list[np.ndarray], two: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (i of one, j of two) of (size, v0 .., perhaps w0 ..) pass the bounds, and their distance by the finer vector.

    inter / union >= p means |a ^ b| <= (1 - p) / (1 + p) * (|a| + |b|).
    """
    last = 1 + len(VECTOR)
    na, nb = one[0][i], two[0][j]
    ok = np.flatnonzero(np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb))
    i, j, most = i[ok], j[ok], (100 - percent) * (na[ok] + nb[ok])
    fine = sum(np.bitwise_count((one[k][i] ^ two[k][j]).view(np.uint64)).astype(np.int64) for k in range(3, last))
    keep = fine * (100 + percent) <= most
    ok, i, j, most, fine = ok[keep], i[keep], j[keep], most[keep], fine[keep]
    va, vb = (np.stack([c[1][k], c[2][k]], axis=1).view(np.uint8).astype(np.int16) for c, k in ((one, i), (two, j)))
    keep = np.abs(va - vb).sum(axis=1) * (100 + percent) <= most
    ok, i, j, most, fine = ok[keep], i[keep], j[keep], most[keep], fine[keep]
    if len(one) > last and len(ok):
        sharp = sum(np.bitwise_count((one[k][i] ^ two[k][j]).view(np.uint64)).astype(np.int64) for k in range(last, len(one)))
        keep = sharp * (100 + percent) <= most
        ok, fine = ok[keep], fine[keep]
    return ok, fine


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(b.num_columns)]


def grouped(batches: Iterator[pa.RecordBatch], whole: int, key: int = 0) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Blocks (columns, starts of groups, whether each is whole) of rows sorted by column `key`.

    A group is whole if it has at most `whole` rows and is neither the task's first nor its last one,
    of which other tasks may have a part. Other groups come in parts of at most a batch.
    """
    carry: list[np.ndarray] | None = None
    first = broken = None
    for b in batches:
        cols = _columns(b)
        if carry is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
        k = cols[key]
        if not len(k):
            continue
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        if first is None:
            first = broken = k[0]
        last = int(starts[-1])
        if len(k) - last > whole:
            broken = k[last]
        stop = len(k) if k[last] == broken else last
        carry = None if stop == len(k) else [c[last:] for c in cols]
        if stop:
            own = starts[starts < stop]
            yield [c[:stop] for c in cols], own, (np.diff(own, append=stop) <= whole) & (k[own] != first) & (k[own] != broken)
    if carry is not None:
        yield carry, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=bool)


def close_ones(cols: list[np.ndarray], starts: np.ndarray, use: np.ndarray, percent: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the passing pairs of rows of one group, for groups in `use` of at most `most` rows; cols: size, v0 ..."""
    sizes = np.diff(starts, append=len(cols[0]))
    few = use & (sizes > 1) & (sizes <= most)
    end = np.repeat(np.where(few, starts + sizes, -1), sizes)
    i = np.flatnonzero(end >= 0)
    for d in range(1, int(sizes[few].max()) if few.any() else 0):
        i = i[i + d < end[i]]
        ok, far = passing(cols, cols, i, i + d, percent)
        if len(ok):
            yield i[ok], i[ok] + d, far


LIVE_NAMES = ["g", "c1", "c2", "n"]
LIVE = ", ".join(f"{c} long" for c in LIVE_NAMES)


def live_rows(index: DataFrame, percent: int, most: int = WHOLE) -> DataFrame:
    """Index rows that may have a partner, grouped by their members or, where a group isn't seen whole, by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for cols, starts, whole in grouped(batches, most):
            sig, c1, n = cols[:3]
            sizes = np.diff(starts, append=len(sig))
            live = np.repeat(~whole, sizes)
            for i, j, _ in close_ones(cols[2:], starts, whole, percent, most):
                live[i] = live[j] = True
            c2 = second_name(n, cols[3:])
            named = mix(c1.view(np.uint64) ^ mix(c2.view(np.uint64) + n.astype(np.uint64)))
            sets = mix(np.add.reduceat(np.where(live, named, U(0)), starts)).view(np.int64)
            fresh = ~whole
            for k in np.flatnonzero(whole & np.logical_or.reduceat(live, starts)).tolist():
                g = int(sets[k])
                if g not in done:
                    if len(done) >= SEEN:
                        done.clear()
                    done.add(g)
                    fresh[k] = True
            keep = live & np.repeat(fresh, sizes)
            if keep.any():
                g = np.where(np.repeat(whole, sizes), np.repeat(sets, sizes), sig)
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (g, c1, c2, n)], LIVE_NAMES)

    return index.repartitionByRange("sig", "n", "c1").sortWithinPartitions("sig", "n", "c1").mapInArrow(run, LIVE)


def nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance): of pairs taken both ways, those of the `top` nearest i of each j."""
    i, j, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
    order = np.lexsort((i, far, j))
    first = np.concatenate([[0], np.flatnonzero(np.diff(j[order])) + 1])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    keep = order[rank < top]
    return i[keep], j[keep], far[keep]


def proposals(rows: DataFrame, percent: int, top: int | None, vectors: list[str], most: int = WHOLE, size: int = TILE) -> DataFrame:
    """Pairs of classes of one tile and different components, and the rows of tiles of groups that may have others.

    `rows` has (g, root, n, cid) and `vectors`. With `top`, each row only proposes its nearest ones.
    """
    names = ["kind", "a", "b", "far", "g", "tile", "root", "n", *vectors]
    schema = "kind string, " + ", ".join(f"{c} long" for c in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tile = TaskContext.get().partitionId() << 32

        def pairs(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray, far: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok = cols[1][i] != cols[1][j]
            i, j, far = i[ok], j[ok], far[ok]
            if top is not None and len(i):
                i, j, far = nearest(i, j, far, top)
            if len(i):
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(i)), pa.array(cols[3][i]), pa.array(cols[3][j]), pa.array(far), *([none] * (len(names) - 4))], names)

        def inside(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            i, j = np.triu_indices(len(part[0]), 1)
            keep = part[1][i] != part[1][j]
            i, j = i[keep], j[keep]
            ok, far = passing([part[2], *part[4:]], [part[2], *part[4:]], i, j, percent)
            yield from pairs(part, i[ok], j[ok], far)

        def cut(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """One tile of a group that has others or may have them."""
            nonlocal tile
            tile += 1
            yield from inside(part)
            none = pa.nulls(len(part[0]), pa.int64())
            row = [pa.array(["row"] * len(part[0])), pa.array(part[3]), none, none, pa.array(part[0]), pa.array(np.full(len(part[0]), tile)), pa.array(part[1]), pa.array(part[2]), *(pa.array(c) for c in part[4:])]
            yield pa.RecordBatch.from_arrays(row, names)
            votes = [np.unpackbits(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(c) for c in part[6 : 4 + len(VECTOR)]]
            middle = {"g": int(part[0][0]), "tile": tile, **{v: int(np.packbits(x).view("<i8")[0]) for v, x in zip(VECTOR[2:], votes, strict=True)}}
            yield pa.RecordBatch.from_arrays([pa.array(["middle"]), *(pa.array([middle.get(c)], pa.int64()) for c in names[1:])], names)

        kept: list[np.ndarray] | None = None
        for cols, starts, whole in grouped(batches, size):
            found = list(close_ones([cols[2], *cols[4:]], starts, whole, percent, most))
            if found:
                yield from pairs(cols, *(np.concatenate(x) for x in zip(*found, strict=True)))
            ends = np.append(starts[1:], len(cols[0]))
            for k in np.flatnonzero(~whole | (ends - starts > most)).tolist():
                part = [c[starts[k] : ends[k]] for c in cols]
                if whole[k]:
                    yield from inside(part)
                    continue
                if kept is not None and kept[0][0] != part[0][0]:
                    yield from cut(kept)
                    kept = None
                kept = part if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, part, strict=True)]
                while kept is not None and len(kept[0]) >= size:
                    yield from cut([c[:size] for c in kept])
                    kept = [c[size:] for c in kept] if len(kept[0]) > size else None
        if kept is not None:
            yield from cut(kept)

    order = ["g", "root", "n", "cid"]
    return rows.select(*order, *vectors).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def hub_pairs(spark: SparkSession, found: DataFrame, percent: int) -> DataFrame:
    """(b, a, far): each row of a group of several tiles with the group's hub, if they pass the bounds."""
    fine = VECTOR[2:]
    middle = found.where("kind = 'middle'").groupBy("g").agg(F.count("*").alias("tiles"), F.min_by(F.struct(*fine), "tile").alias("m"))
    middle = written(spark, middle.where("tiles > 1").select("g", *[F.col(f"m.{v}").alias(f"m_{v}") for v in fine]), "middles")
    # one row of at least a tile of rows each: where they are few, a group's rows stay where they are
    few = small_enough(middle, HUBS)
    at_hand = F.broadcast if few else lambda df: df
    rows = found.where("kind = 'row'").select("g", F.col("a").alias("cid"), "root", "n", *fine)

    def apart(other: str):  # noqa: ANN202
        return sum((F.bit_count(F.col(v).bitwiseXOR(F.col(f"{other}_{v}"))) for v in fine), F.lit(0)).cast("long")

    hub = rows.join(at_hand(middle), "g").groupBy("g").agg(F.min(F.struct(apart("m").alias("far"), "cid", "root", "n", *fine)).alias("h"))
    hub = hub.select("g", F.col("h.cid").alias("a"), F.col("h.root").alias("h_root"), F.col("h.n").alias("h_n"), *[F.col(f"h.{v}").alias(f"h_{v}") for v in fine])
    near = rows.join(at_hand(hub), "g").where("root <> h_root").withColumn("far", apart("h"))
    fits = (F.least("n", "h_n") * 100 >= percent * F.greatest("n", "h_n")) & (F.col("far") * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("h_n")))
    return near.where(fits).select(F.col("cid").alias("b"), "a", "far")


def across_tiles(spark: SparkSession, found: DataFrame, percent: int, vectors: list[str]) -> DataFrame:
    """(a, b) of the passing pairs of different components in different tiles of one group."""
    tiles = found.where("kind = 'row'").groupBy("g", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("root_low"), F.max("root").alias("root_high"))
    tiles = written(spark, tiles, "tiles")
    other = tiles.select("g", *[F.col(c).alias("o_" + c) for c in ("tile", "low", "high", "root_low", "root_high")])
    one_root = (F.col("root_low") == F.col("root_high")) & (F.col("o_root_low") == F.col("o_root_high")) & (F.col("root_low") == F.col("o_root_low"))
    met = tiles.join(other, "g").where("tile < o_tile").where((F.col("high") * 100 >= percent * F.col("o_low")) & (F.col("o_high") * 100 >= percent * F.col("low")) & ~one_root)
    met = written(spark, met.select(F.col("tile").alias("t"), F.col("o_tile").alias("u")), "tile_pairs")
    if met.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    rows = found.where("kind = 'row'").select("tile", F.col("a").alias("cid"), "root", "n", *vectors)
    sides = [rows.join(met.withColumn("tile", F.col(at)), "tile").select("t", "u", F.lit(side).alias("side"), "cid", "root", "n", *vectors) for side, at in ((0, "t"), (1, "u"))]

    def compared(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        one, two = ([c[cols[2] == side] for c in cols[3:]] for side in (0, 1))
        for a in range(0, len(one[0]), 256):
            part = [c[a : a + 256] for c in one]
            i, j = (x.reshape(-1) for x in np.indices((len(part[0]), len(two[0]))))
            keep = part[1][i] != two[1][j]
            i, j = i[keep], j[keep]
            ok, _ = passing(part[2:], two[2:], i, j, percent)
            if len(ok):
                yield pa.RecordBatch.from_arrays([pa.array(part[0][i[ok]]), pa.array(two[0][j[ok]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            cols = _columns(b)
            bounds = np.concatenate([[0], np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1, [len(cols[0])]])
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                part = [c[s:e] for c in cols]
                if not len(part[0]):
                    continue
                if kept is not None and (kept[0][0] != part[0][0] or kept[1][0] != part[1][0]):
                    yield from compared(kept)
                    kept = None
                kept = part if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, part, strict=True)]
        if kept is not None:
            yield from compared(kept)

    return sides[0].unionByName(sides[1]).repartition("t", "u").sortWithinPartitions("t", "u", "side").mapInArrow(run, "a long, b long")


def id_filter(spark: SparkSession, ids: DataFrame):  # noqa: ANN201
    """A bitmap of hashed ids (a DataFrame of one column), of fixed size whatever their number; only spares rows the way to a join."""
    slot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER))
    rows = ids.select(slot.alias("s")).groupBy((F.col("s") / FILTER_ROW).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("s") % FILTER_ROW).alias("bits")).collect()
    bits = np.zeros((FILTER // FILTER_ROW, FILTER_ROW // 8), dtype=np.uint8)
    for r in rows:
        bits[r.row] = np.frombuffer(r.bits, dtype=np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def in_filter(shared, slots: pa.Array | np.ndarray) -> np.ndarray:  # noqa: ANN001
    at = (slots if isinstance(slots, np.ndarray) else slots.to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.frombuffer(shared.value, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def with_slots(docs: DataFrame) -> DataFrame:
    """(text, slot of the id in `id_filter`, whether there is no id)."""
    return docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).alias("slot"), F.col("doc_id").isNull().alias("unnamed"))


FEATURES = ", ".join(f"{w} long" for w in (*VECTOR, *SHARPS)) + ", wide binary"


def features(own: np.ndarray) -> tuple:
    """Counts of SHARP bins modulo 4 in Gray code, as `bins` has FINE, and counts of WIDE bins for sets of LARGE shingles or more."""
    fine = np.bincount((own >> U(30)).astype(np.int64) & SHARP - 1, minlength=SHARP).astype(np.uint8) & 3
    fine ^= fine >> 1
    wide = np.minimum(np.bincount((own >> U(20)).astype(np.int64) & WIDE - 1, minlength=WIDE), 255).astype(np.uint8).tobytes() if len(own) >= LARGE else b""
    return (*np.packbits(np.stack([fine & 1, fine >> 1]).reshape(-1)).view("<i8").tolist(), wide)


def of_classes(spark: SparkSession, docs: DataFrame, wanted: DataFrame, n: int, with_text: bool) -> DataFrame:
    """One row of each class of `wanted`: (cid, text), or (cid, n_shingles, v0 .., w0 .., wide) with the numbers of `bins` and `features`."""
    shared = id_filter(spark, wanted.where("rep IS NOT NULL").select("rep").distinct())
    schema = "c1 long, c2 long, n_shingles long, " + ("text string" if with_text else FEATURES)
    kinds = [pa.int64()] * 3 + ([pa.string()] if with_text else [pa.int64()] * (len(VECTOR) + len(SHARPS)) + [pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in batches:
            b = b.filter(pa.array(in_filter(shared, b.column(1)) | b.column(2).to_numpy(zero_copy_only=False)))
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                rows, use = [], []
                for k, own in shingle_sets(part.column(0), n):
                    vector = bins(own)
                    name = set_name(own, vector)
                    if not len(own) or name in done:
                        continue
                    if len(done) >= SEEN:
                        done.clear()
                    done.add(name)
                    use.append(k)
                    rows.append((*name, len(own), *(() if with_text else (*vector.tolist(), *features(own)))))
                if rows:
                    text = [part.column(0).take(pa.array(use))] if with_text else []
                    yield _batch(schema, kinds, [*(list(c) for c in zip(*rows, strict=True)), *text])

    named = with_slots(docs).mapInArrow(run, schema)
    on = ["c1", "c2", "n_shingles"]
    out = ["text"] if with_text else ["n_shingles", *VECTOR, *SHARPS, "wide"]
    return written(spark, named.hint("merge").join(wanted.select(*on, "cid"), on).dropDuplicates(on).select("cid", *out), "class_texts" if with_text else "class_vectors")


def close_pairs(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) class pairs, those that pass the bound by sharper vectors."""

    m = len(SHARPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(4 + m).to_numpy()
            most = (100 - percent) * (na + nb)
            far = sum(np.bitwise_count((b.column(3 + k).to_numpy() ^ b.column(5 + m + k).to_numpy()).view(np.uint64)).astype(np.int64) for k in range(m))
            keep = far * (100 + percent) <= most
            large = np.flatnonzero(keep & (na >= LARGE) & (nb >= LARGE))
            if len(large):
                x, y = (np.frombuffer(b"".join(b.column(k).take(pa.array(large)).to_pylist()), dtype=np.uint8).reshape(-1, WIDE).astype(np.int16) for k in (3 + m, 5 + 2 * m))
                keep[large] = np.abs(x - y).sum(axis=1) * (100 + percent) <= most[large]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    names = ["n_shingles", *SHARPS, "wide"]
    one, two = (vectors.select(F.col("cid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in names]) for x in ("a", "b"))
    both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")
    return both.select("a", "b", *[f"{x}_{c}" for x in ("a", "b") for c in names]).mapInArrow(run, "a long, b long")


def verified(spark: SparkSession, pairs: DataFrame, vectors: DataFrame, docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """Of (a, b) class pairs, those that link; texts are fetched for pairs that pass the vectors."""
    pairs = written(spark, close_pairs(pairs, vectors, percent), "close")
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    texts = of_classes(spark, docs, written(spark, wanted.hint("merge").join(ids, "cid", "left_semi"), "chosen"), n, with_text=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for (_, x), (_, y) in zip(shingle_sets(b.column(2), n), shingle_sets(b.column(3), n), strict=True):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter) and inter > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    both = pairs.hint("merge").join(texts.toDF("a", "ta"), "a").hint("merge").join(texts.toDF("b", "tb"), "b")
    links = written(spark, both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "links")
    discard(spark, texts)
    return links


def open_members(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """`members` with their component, of the groups whose members are in different ones; others have no pair left."""
    if roots is None:
        return members.withColumn("root", F.col("cid"))
    rooted = members.hint("merge").join(roots.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
    return rooted.hint("merge").join(mixed, "g", "left_semi")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_classes(spark: SparkSession, members: DataFrame, vectors: DataFrame, docs: DataFrame, wanted: DataFrame, n: int, percent: int, whole: int = WHOLE, tile: int = TILE) -> DataFrame:
    """(id, root) of the classes that link with others."""
    links = tried = roots = None
    for _ in range(STARS):
        found = written(spark, proposals(written(spark, open_members(members, roots), "open"), percent, TOP, VECTOR, whole, tile), "found")
        offers = found.where("kind = 'pair'").select("b", "a", "far").unionByName(hub_pairs(spark, found, percent))
        if tried is not None:
            offers = offers.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(tried.toDF("x", "y"), ["x", "y"], "left_anti").select("b", "a", "far")
        best = offers.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        some = written(spark, ordered(best).distinct(), "some")
        now = verified(spark, some, vectors, docs, wanted, n, percent)
        links, tried = (now, some) if links is None else (links.unionByName(now), tried.unionByName(some))
        roots = written(spark, connected_components(spark, links), "roots")
        discard(spark, found)
    sharper = open_members(members, roots).hint("merge").join(vectors.select("cid", *SHARPS), "cid")
    found = written(spark, proposals(written(spark, sharper, "open"), percent, None, [*VECTOR, *SHARPS], whole, tile), "found")
    left = ordered(found.where("kind = 'pair'").select("a", "b").unionByName(across_tiles(spark, found, percent, [*VECTOR, *SHARPS]))).distinct()
    more = verified(spark, written(spark, left.join(tried, ["a", "b"], "left_anti"), "left"), vectors, docs, wanted, n, percent)
    if more.isEmpty():
        return roots
    return written(spark, connected_components(spark, links.unionByName(more)), "roots")


def similar_documents(spark: SparkSession, docs: DataFrame, n: int = 3, percent: int = 90, whole: int = WHOLE, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    on = ["c1", "c2", "n_shingles"]
    with small_batches(spark):
        scanned = written(spark, scan(docs, n), "sets")
        sets = scanned.where("block IS NULL").select("doc_id", *on)
        classes = sets.where("n_shingles > 0").groupBy(*on).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        classes = written(spark, classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        index = written(spark, index_chunks(spark, docs, classes, n, percent, frequent_buckets(scanned)), "index")
        with small_batches(spark, 16):
            shared = shared_signatures(spark, index)
            rows = written(spark, index_rows(index, *signature_filter(spark, shared)), "index_rows")
        discard(spark, index, shared)
        live = live_rows(rows, percent, whole).dropDuplicates(LIVE_NAMES).withColumnRenamed("n", "n_shingles")
        members = written(spark, live.hint("merge").join(classes.select(*on, "cid"), on).select("g", F.col("n_shingles").alias("n"), "cid"), "live")
        discard(spark, rows)
        wanted = written(spark, classes.join(members.select("cid").distinct(), "cid", "left_semi"), "wanted")
        vectors = of_classes(spark, docs, wanted, n, with_text=False)
        members = written(spark, members.hint("merge").join(vectors.select("cid", *VECTOR), "cid"), "members")
        roots = linked_classes(spark, members, vectors, docs, wanted, n, percent, whole, tile)
        named = written(spark, classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left"), "named")
        least = written(spark, named.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("classes")), "least")
        total = sets.count()
        # components of very many classes are looked up by a broadcast of at most HOT rows
        large = least.where(F.col("classes") * HOT > total).select("root", F.col("component").alias("large"))
        least = least.where(F.col("classes") * HOT <= total).drop("classes")
        named = named.join(F.broadcast(large.withColumn("is_large", F.lit(True))), "root", "left")
        small = named.where("is_large IS NULL").join(least, "root", "left").select(*on, F.coalesce("component", "rep").alias("component"), "copies")
        component = written(spark, small.unionByName(named.where("is_large").select(*on, F.col("large").alias("component"), "copies")), "components")
        discard(spark, vectors, members)
    hot = component.where(F.col("copies") * HOT > total).drop("copies")
    cold = component.where(F.col("copies") * HOT <= total).drop("copies")
    near = sets.join(F.broadcast(hot.withColumn("is_hot", F.lit(True)).withColumnRenamed("component", "hot")), on, "left")
    rest = near.where("is_hot IS NULL").join(cold, on, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return rest.unionByName(near.where("is_hot").select("doc_id", "n_shingles", F.col("hot").alias("component_id")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each component, the row of the smallest doc_id (a null one last), with all its columns.

    Rows are told apart by a number of their own, so repeated ids are no trouble, and of fully
    repeated rows one stays. Rows without words are nobody's copies and all stay.
    """
    uid = fresh(docs.columns, "uid")
    rows = numbered(spark, docs, "documents", uid)
    groups = similar_documents(spark, rows.select(F.col(uid).alias("doc_id"), "text"), n, percent)
    placed = groups.join(rows.select(F.col(uid).alias("doc_id"), F.col("doc_id").alias("own_id")), "doc_id")
    order = F.struct(F.col("own_id").isNull().alias("unnamed"), "own_id", "doc_id")
    stay = placed.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias(uid))
    return rows.join(stay, uid, "left_semi").select(docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark, table(spark, sf_dir, "documents"))
