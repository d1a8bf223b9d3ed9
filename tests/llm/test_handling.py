"""Nulls, empty tables, ties, repeated rows, long texts and clashing columns; brute-force versions."""

import hashlib
import itertools
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeatlas.llm import chat_format, decontamination, exact_dedup, importance, language_id, line_dedup, packing, token_count, url_filter

DOCS = "doc_id long, text string"
CLASH = "doc_id long, text string, uid long, id long, gone string, lines_in long, left long, h long, norm string, hash long, item long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return frame(spark, [(*r, 7, 8, "g", 9, 10, 11, "n", 12, 13) for r in rows], CLASH)


@pytest.mark.parametrize("links", [exact_dedup.HOT_LINKS, 1])
def test_exactly_one_row_of_a_group_stays(spark, links):
    rows = [(6, "c"), (6, "c  "), (7, "c"), (None, "c"), (1, "a b"), (1, "a b"), (None, "q"), (2, "x" * 300_000), (3, "x" * 300_000 + " "), (4, None), (5, " \n"), (8, "")]
    got = exact_dedup.exact_duplicates(spark, clashing(spark, rows), capacity=2, max_depth=3, hot_links=links).collect()
    assert len(got) == len(rows) and len({r.bucket for r in got}) > 1
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for digest, members in by_digest.items():
        mine = [r for r in got if r.text_sha256 == digest]
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert len(mine) == len(members) and {r.group_size for r in mine} == {len(members)} and {r.keep_id for r in mine} == {best[0]}
        assert [r.doc_id for r in mine if r.kept] == [best[0]]


def test_conversations_with_null_and_large_ids(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (2**53, 0, "user", "x"), (2**53 + 1, 0, "user", "y"), (5, None, None, None), (5, 1, "assistant", "<|im_end|>"), (5, 1, "assistant", "<|im_end|>")]
    parts = F.array(F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast(k).alias(c) for c, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", parts.alias("parts"), F.lit(1).alias("segment"))
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_messages(df)).collect()}
    assert set(got) == {None, 2**53, 2**53 + 1, 5} and got[None].n_turns == 2
    assert got[5].n_turns == 3 and got[5].loss_chars == 20 and got[5].loss_sha256 == hashlib.sha256(b"<|im_end|>" * 2).hexdigest()
    assert got[5].turns_sha256 == hashlib.sha256(b"\n\n" + b"assistant\n<|im_end|>\n" * 2).hexdigest()
    assert chat_format.digest_conversations(chat_format.format_messages(df.where("false"))).count() == 0


def test_attachments_reach_the_output(spark):
    parts = [{"type": "text", "text": "<|image_1|>"}, {"type": "image", "ref": "a", "width": 28, "height": 28}, {"type": "document", "ref": "b", "pages": 2}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    segments = chat_format.format_messages(df)
    row = chat_format.digest_conversations(segments).first()
    assert (row.n_attachments, row.expanded_tokens, row.n_turns) == (2, 4 + 1024, 2)
    segment = segments.orderBy("turn").first().segment
    content = segment[segment.index("\n") + 1 : -len("<|im_end|>\n")]
    assert chat_format.content_parts(content) == [{"type": "text", "text": "<|image_1|>"}, {"type": "image", "number": 1}, {"type": "document", "number": 2}]


def test_line_dedup_keeps_clashing_columns(spark):
    shared = " ".join(f"w{k}" for k in range(60))
    got = line_dedup.dedup_lines(spark, clashing(spark, [(1, shared), (2, "x\n" + shared), (2, "x\n" + shared), (None, shared), (4, "y" * 500_000)]))
    assert got.columns[-2:] == ["lines_in_", "lines_removed"] and got.columns[:-2] == [c.split()[0] for c in CLASH.split(", ")]
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.text[:3], r.lines_removed) for r in rows) == [(0, "w0 ", 0), (1, "w0 ", 0), (2, "x", 1), (2, "x", 1), (4, "yyy", 0)]


def plain_tokens(text):
    """Tokens of lower-case texts without names, units and marks but digits: (is slot, value)."""
    return [(t[0].isdigit(), t) for t in (text or "").split()]


def brute_contamination(docs, items):
    out = []
    for _, text in docs:
        d, hits = plain_tokens(text), []
        for item, question in items:
            b = plain_tokens(question)
            if 0 < len(b) < 5:
                if any(plain_tokens(x) == b for x in [text or "", *(text or "").split("\n")]):
                    hits.append((-1.0, item))
                continue
            found = set()
            for shift in range(-len(b), len(d)):
                pairs, at = set(), []
                for q in range(len(b) - 4):
                    w, v = b[q : q + 5], d[q + shift : q + shift + 5] if q + shift >= 0 else []
                    few = sum(not s for s, _ in w) < 3
                    if len(v) == 5 and (w == v if few else [t if not s else 0 for s, t in w] == [t if not s else 0 for s, t in v]):
                        at.append((q, w, v))
                        pairs |= {(x[1], y[1]) for x, y in zip(w, v, strict=True) if x[0]}
                bad = {p for p in pairs if sum(p[0] == o[0] for o in pairs) > 1 or sum(p[1] == o[1] for o in pairs) > 1}
                found |= {q for q, w, v in at if w == v or not any((x[1], y[1]) in bad for x, y in zip(w, v, strict=True) if x[0])}
            if len(b) >= 5 and len(found) / (len(b) - 4) >= 0.5:
                hits.append((-len(found) / (len(b) - 4), item))
        out.append((bool(hits), min(hits, key=lambda h: (h[0], h[1] is None, h[1] or 0))[1] if hits else None, len(hits)))
    return out


def test_windows_of_a_long_text_with_slots_cost_its_length(spark):
    """A window's hash takes five tokens; types computed again per window would make 10^10 steps here."""
    n = 20_000
    rows = frame(spark, [(1, " ".join(f"w{i % 977}x {i}" for i in range(n))), (2, "plain words only here now")])
    got = {r.doc_id: r for r in decontamination.windows(rows, "doc_id").groupBy("doc_id").agg(F.count("hash").alias("n"), F.max("at").alias("last")).collect()}
    assert (got[1].n, got[1].last) == (2 * n - 4, 2 * n - 5)
    assert (got[2].n, got[2].last) == (1, 0)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") * 3 if rng.random() < 0.7 else str(rng.randrange(10, 16))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 4, 6, 9, 15])))) for k in range(25)] + [(None, "zzz yyy xxx www vvv uuu"), (90, None), (91, "")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 30)))) for k in range(80)]
    for k in range(120):
        own = (rng.choice(items)[1] or "").split()
        own = [t if rng.random() < 0.85 else (str(rng.randrange(10, 16)) if t[0].isdigit() else t) for t in own]
        docs.append((rng.randrange(60), " ".join([word() for _ in range(3)]) + rng.choice([" ", "\n"]) + " ".join(own) + rng.choice(["", "\n", " aaa bbb"])))
    docs += [(300, None), (301, ""), (302, "zzz yyy xxx www vvv uuu"), (302, "nothing at all here"), (None, "zzz yyy xxx www vvv uuu")]
    got = decontamination.decontaminate(spark, clashing(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0)
    want = [(i, *w) for (i, _), w in zip(docs, brute_contamination(docs, items), strict=True)]
    assert sorted(((r.doc_id, r.contaminated, r.item_id, r.n_items) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.contaminated for r in got) > 30


def test_short_and_number_heavy_items_are_found(spark):
    docs = [(1, "Calculate 3 + 4"), (2, "so\nCalculate 3 + 4.\nok"), (3, "Calculate 3 + 5"), (4, "1 2 3 4 5 6 7 8"), (5, "1 2 3 4 9 6 7 8")]
    items = [(1, "Calculate 3 + 4"), (2, "1 2 3 4 5 6 7 8")]
    got = {r.doc_id: r.item_id for r in decontamination.decontaminate(spark, frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: None, 4: 2, 5: None}
    none = frame(spark, [], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.decontaminate(spark, frame(spark, docs), none).collect())
    assert decontamination.decontaminate(spark, frame(spark, []), none).count() == 0


def test_importance_weights_equal_brute_force(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("abcd") * 2 for _ in range(rng.randrange(12)))) for k in range(60)] + [(70, None), (None, "aa bb"), (None, "aa bb"), (5, "aa"), (5, "aa")]
    labels = [(k, k % 2, 0) for k in range(40)]
    rows = importance.resample(spark, clashing(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int")).collect()
    grams = []
    for _, text in docs:
        got = [b for _, _, x, _ in importance.features(pa.array([text], pa.string())) for b in x.tolist() if b >= 0]
        w = (text or "").split()
        assert len(got) == max(0, 2 * len(w) - 1)
        grams.append(got)
    raw, target = [0] * importance.BUCKETS, [0] * importance.BUCKETS
    for (i, _), g in zip(docs, grams, strict=True):
        for b in g:
            raw[b] += 1
            target[b] += i is not None and i < 40 and i % 2 == 1
    size = importance.SMOOTHING * importance.BUCKETS
    weight = lambda b: math.log((target[b] + 0.5) / (sum(target) + size)) - math.log((raw[b] + 0.5) / (sum(raw) + size))
    want = sorted((i or -1, len(g), round(sum(map(weight, g)), 4)) for (i, _), g in zip(docs, grams, strict=True))
    got = sorted((r.doc_id or -1, r.n_features, round(r.log_weight, 4)) for r in rows)
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 for x, y in zip(got, want, strict=True))
    kept = [r for r in rows if r.kept]
    assert len(kept) == round(len(docs) * 0.5) and min(r.key for r in kept) >= max(r.key for r in rows if not r.kept)
    assert importance.resample(spark, frame(spark, []), frame(spark, [], "doc_id long, quality int, toxic int")).count() == 0


def test_thresholds_are_exact(spark):
    rows = [(float(k % 7), -(k % 50), -k) for k in range(5000)]
    df = spark.createDataFrame(rows, "key double, by_id long, by_row long")
    want = sorted(rows, reverse=True)
    for k in (1, 700, 4999):
        assert tuple(importance.threshold(df, k, ["key", "by_id", "by_row"], few=40)) == want[k - 1]


def fewest(lengths, capacity):
    """The fewest bins, by search over all ways."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[k]:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room - lengths[k]])
        go(k + 1, [*bins, capacity - lengths[k]])

    go(0, [])
    return best


def test_small_packings_need_hardly_more_than_the_fewest():
    rng = random.Random(1)
    more = []
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(9)]
        patterns = packing.plan({x: lengths.count(x) for x in lengths}, 20)
        used = sorted(x for filling, times in patterns for x in filling * times)
        assert used == sorted(lengths) and all(sum(f) <= 20 for f, _ in patterns) and packing.excess(patterns, 20) >= 0
        more.append(sum(t for _, t in patterns) - fewest(lengths, 20))
    assert max(more) <= 1 and sum(more) <= 3


def test_exchanges_remove_domination():
    lengths, left = [9, 7, 5, 3, 2], {9: 1, 7: 1, 5: 2, 3: 1, 2: 4}
    assert packing.undominated([5, 2], 10, lengths, left) in ([7, 3], [5, 3, 2], [5, 5])
    for room, filling in itertools.product(range(2, 20), ([], [2], [3, 2], [5])):
        if sum(filling) <= room:
            out = packing.undominated(filling, room, lengths, left)
            assert sum(filling) <= sum(out) <= room and all(out.count(x) <= left[x] for x in out)


def test_packing_of_nothing_and_of_repeats(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(spark, frame(spark, []), path).count() == 0
    rows = packing.pack(spark, clashing(spark, [(1, "same words"), (1, "same words"), (None, None)]), path).collect()
    assert [r.doc_id for r in rows].count(1) == 2 and sum(r.length for r in rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_language_predictions_over_spark(spark):
    rng = random.Random(0)
    words = {"en": "the and of with that thing".split(), "de": "der und die nicht schön groß".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.choice([5, 40, 3000]))), x) for i, x in enumerate(["en", "de"] * 90)]
    rows += [(500, None, "en"), (501, "12 !", "de"), (None, "der und die", None), (3, rows[3][1], rows[3][2])]
    df = frame(spark, rows, DOCS + ", lang string").select("*", F.lit("x").alias("score"))
    got = language_id.identify(df).collect()
    truth = {i: x for i, _, x in rows[:180]}
    assert len(got) == len(rows) and all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert {r.lang_pred for r in got if r.doc_id in (500, 501)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    # labels of held-out rows change nothing
    swapped = df.withColumn("lang", F.when(F.expr(language_id.LEARNABLE), F.col("lang")).otherwise("en"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert [(r.lang_pred, r.score) for r in sorted(language_id.identify(swapped).collect(), key=key)] == [(r.lang_pred, r.score) for r in sorted(got, key=key)]
    assert language_id.identify(frame(spark, [], DOCS + ", lang string")).count() == 0


def test_token_counts_over_spark(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 60_000)]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_count.count_tokens(clashing(spark, rows), path).collect())
    counter = token_count.Counter(token_count.sentencepiece_vocabulary(path))
    assert got == sorted((i or 0, counter.text(t or "")[0]) for i, t in rows)
    assert token_count.count_tokens(frame(spark, []), path).count() == 0


def test_url_ties_repeats_and_empty(spark):
    rules = frame(spark, [("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("b.a.org", "", "block"), ("org", "/x/yy", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.a.org/x/yy", 0), (1, "http://b.a.org/x/yy", 0), (2, "http://A.org/x", 0), (3, "http://" + "c." * 20_000 + "org/x/yy", 0)], "page_id long, url string, rule long")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    # of equal length, the longer host decides; of equal rules, allow
    assert got == [(1, "org/x/yy", "allow"), (1, "org/x/yy", "allow"), (2, "a.org/x", "allow"), (3, "org/x/yy", "allow")]
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0 and url_filter.filter_urls(pages, rules.where("false")).count() == 4


def test_stages_handle_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text), (1, text), (1, "other words entirely in this row of the table"), (2, text + " more"), (None, text), (3, None), (None, "")]
    for df in (clashing(spark, rows), frame(spark, rows), frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns
            left = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in out.collect())
            if df.columns == ["doc_id", "text"] and name == "near_duplicates" and len(left):
                assert left == [(0, ""), (1, "other wor"), (1, text[:9]), (3, "")]
            elif name == "decontamination":
                assert len(left) == df.count()
