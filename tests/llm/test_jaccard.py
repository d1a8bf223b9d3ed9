"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest

from codeatlas.llm import jaccard_join as J
from codeatlas.llm.components import connected_components
from codeatlas.llm.jaccard_join import similar_documents

DOCS = "doc_id long, text string"


def brute(rows, n, percent):
    """{row number: (set size, smallest id of the component)}."""
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else []))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(rows)):
        for b in range(k):
            inter = len(sets[k] & sets[b])
            if inter and 100 * inter >= percent * len(sets[k] | sets[b]):
                x, y = find(k), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def result(spark, rows, *args, **kw):
    got = similar_documents(spark, spark.createDataFrame(rows, DOCS), *args, **kw).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    return sorted(map(tuple, got), key=key), sorted(brute(rows, args[0], args[1]), key=key)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    common = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 40, 120, 300, 700]))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "a"), (i + 4, "A"), (i + 5, "a b")]


def test_three_words_match_brute_force(spark):
    # repeated ids with different texts, and null ids, are rows of their own
    rows = corpus(1)
    rows += [(3, rows[40][1]), (3, rows[50][1] + " x"), (None, rows[60][1]), (None, "nobody else has this text at all"), (None, None), rows[70], rows[70]]
    got, want = result(spark, rows, 3, 90)
    assert got == want


def test_five_words_in_small_tiles(spark):
    """Groups far larger than a tile: near copies of one text that don't all link with each other."""
    rng = random.Random(2)
    base = ["b%d" % k for k in range(90)]
    rows = corpus(2)
    for k in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = "v%d" % rng.randrange(60)
        rows.append((1000 + k, " ".join(copy)))
    got, want = result(spark, rows, 5, 80, whole=3, tile=8)
    assert got == want


def test_large_group_of_near_copies(spark):
    """More than two thousand near copies: one component, whatever the tiles."""
    rng = random.Random(4)
    base = ["c%d" % k for k in range(60)]
    rows = [(k, " ".join([*base[: (at := rng.randrange(60))], "n%d" % k, *base[at + 1 :]])) for k in range(2300)]
    rows += [(5000 + k, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(900)) for _ in range(60))) for k in range(50)]
    got = similar_documents(spark, spark.createDataFrame(rows, DOCS), 3, 80).collect()
    assert len(got) == 2350 and all(r.component_id == (0 if r.doc_id < 5000 else r.doc_id) for r in got)


def test_extra_columns_and_long_texts(spark):
    long = " ".join("l%d" % (k % 5000) for k in range(120_000))
    rows = [(1, long, 7, 7, "x"), (2, long + " end", 8, 8, "y"), (3, "short text here", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c1 long, cid long, component_id string")
    assert {(r.doc_id, r.component_id) for r in similar_documents(spark, df).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_empty(spark):
    assert similar_documents(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_rows_of_lone_signatures_stay(spark, monkeypatch):
    """Only rows of signatures of more than one text are dealt out; copies have one text."""
    texts = [" ".join("u%d_%d" % (k, w) for w in range(200)) for k in range(40)]
    rows = [*enumerate(texts), *enumerate(texts[:10], 100), (200, texts[0] + " end")]
    counts, live_rows = [], J.live_rows
    monkeypatch.setattr(J, "live_rows", lambda index, *args: counts.append(index.count()) or live_rows(index, *args))
    got = {r.doc_id: r.component_id for r in similar_documents(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i for i in range(40)} | {100 + i: i for i in range(10)} | {200: 0}
    # about 20 rows of each of the two texts that link, of some 800 in all
    assert 2 <= counts[0] <= 60


def test_small_chunks_and_full_filter(spark, monkeypatch):
    """Signatures met across many chunks; a filter too small to tell any apart only costs time."""
    monkeypatch.setattr(J, "CHUNK", 50)
    monkeypatch.setattr(J, "FILTER_MOST", 8)
    got, want = result(spark, corpus(6), 3, 90)
    assert got == want


def test_coded_numbers():
    for x in ([], [7], [0, 1, 1 << 40, (1 << 41) - 1], [5, 5, 6]):
        assert J.decoded(J.coded(np.array(x, dtype=np.uint64))).tolist() == x


def test_chain_components(spark):
    edges = [(k, k + 1) for k in range(12)] + [(20, 21), (21, 20), (5, 5)]
    got = {r.id: r.root for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(13)} | {20: 20, 21: 20}
