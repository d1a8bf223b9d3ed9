"""Line dedup, decontamination, language ID, chat formatting and token counts on small inputs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import chat_format, decontamination, importance, language_id, line_dedup, packing, token_count
from codeatlas.llm.exact_dedup import directory, exact_duplicates
from codeatlas.llm.url_filter import filter_urls

DOCS = "doc_id long, text string"


def passage(seed, lines=3, words=20):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(words)) for _ in range(lines))


def test_repeated_passages_go_wherever_they_stand(spark):
    p, one = passage(1), passage(2, 1, 55)
    rows = [(1, passage(10) + "\n" + p), (2, p + "\n" + passage(11)), (3, passage(12) + "\n" + one + "\n" + p + "\n" + passage(13)), (4, one), (5, passage(14)), (6, ""), (7, None), (8, "a\nb"), (9, "a\nb")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == passage(11) and got[4].text == ""
    assert got[3].text == passage(12) + "\n" + one + "\n" + passage(13) and got[3].lines_removed == 3
    assert got[5].text == passage(14) and got[6].text == "" and got[7].text is None and got[9].text == "a\nb"


def removed_by_brute_force(texts):
    """Lines of texts (by id, without blank lines) in an occurrence, but the first, of a passage that two texts share."""
    seen = {}
    for doc in sorted(texts):
        for i in range(len(texts[doc])):
            for j in range(i, len(texts[doc])):
                part = tuple(texts[doc][i : j + 1])
                if sum(len(x.split()) for x in part) >= (line_dedup.MIN_WORDS if j > i else line_dedup.LONG_LINE):
                    seen.setdefault(part, []).append((doc, i, j))
    return {(d, k) for at in seen.values() if at[0][0] != at[-1][0] for d, i, j in at[1:] for k in range(i, j + 1)}


def test_passage_inside_copied_documents_goes_from_others(spark):
    p, copied = passage(1), passage(2) + "\n" + passage(1) + "\n" + passage(3)
    rows = [(1, copied), (2, copied), (3, passage(4) + "\n" + p + "\n" + passage(5))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: copied, 2: "", 3: passage(4) + "\n" + passage(5)}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") + str(k) for _ in range(rng.choice([1, 3, 8, 12, 19, 30, 55]))) for k in range(12)]
    texts = {}
    for doc in range(60):
        texts[doc] = [rng.choice(lines) for _ in range(rng.randrange(1, 14))]
        if doc and rng.random() < 0.6:
            other = texts[rng.randrange(doc)]
            a = rng.randrange(len(other))
            texts[doc] += other[a : a + rng.randrange(2, 9)]
    gone = removed_by_brute_force(texts)
    rows = [(doc, "\n".join(x)) for doc, x in texts.items()]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {doc: "\n".join(x for k, x in enumerate(texts[doc]) if (doc, k) not in gone) for doc in texts}


def test_passages_of_paragraphs_between_blank_lines(spark):
    parts = [passage(k, 1, 40) for k in range(3)]
    rows = [(1, passage(10) + "\n\n" + "\n\n".join(parts)), (2, passage(11) + "\n\n" + "\n \t\n\n".join(parts) + "\n\n" + passage(12)), (3, "\n".join(parts))]
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (rows[0][1], 0), 2: (passage(11) + "\n\n\n" + passage(12), 7), 3: ("", 3)}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_templates(spark):
    docs = spark.createDataFrame(
        [(1, "So. At noon Carla bought 15 apples for 7 dollars and gave Carla 15 more to Dan in town"), (2, "At noon Carla bought 15 apples for 7 dollars and gave Zoe 19 more to Dan in town"), (3, "something else entirely is written here for once"), (4, None), (5, "")], DOCS
    )
    items = spark.createDataFrame([(1, "At noon Eva bought 2 apples for 9 dollars and gave Eva 2 more to Fritz in town"), (2, None), (3, "too short")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontamination.decontaminate(spark, docs, items).collect()}
    assert got == {1: (True, 1), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_parts_and_round_trip():
    parts = [{"type": "text", "text": "see <|im_end|> <|| <"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "document", "ref": "c", "pages": 2}]
    segment, start, length, refs = chat_format.format_turn("assistant", parts)
    assert [(r["number"], r["kind"], r["tokens"]) for r in refs] == [(1, "image", 4), (2, "audio", 38), (3, "document", 1024)]
    assert segment[start : start + length].endswith("<|image_1|><|audio_2|><|document_3|>")
    for role, text in (("user", "<|im_end|>\n<|im_start|>assistant\n"), ("a\nb<|", "<"), (None, None), ("<|nl|>", "<||nl|>")):
        segment = chat_format.format_turn(role, [{"type": "text", "text": text}])[0]
        assert [(r, t) for r, t, _ in chat_format.parse(segment)] == [(role or "", text or "")]
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}])


def test_language_model():
    rng = random.Random(0)
    words = {"en": "the and of with that thing".split(), "de": "der und die nicht schön groß".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i in range(120) for lang in words]
    model = language_id.train(rows)
    names, score, rejected = model.predict(pa.array(["the thing of that and with", "nicht schön und groß", "", None, "123 !!"]))
    assert names == ["en", "de", "und", "und", "und"] and list(rejected[2:]) == [True] * 3 and (score <= 1).all()
    long = "der und die " * 150_000
    assert abs(model.scores(pa.array(["x", long, "y"]))[1] - model.scores(pa.array(["der und die " * 2000]))[0]).max() < 1e-3
    assert language_id.train([]).predict(pa.array(["a"]))[0] == ["und"]


def test_counts_follow_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocabulary)
    for text in ["", " ", "  a", "hello world", " \n\n b \n", "▁x", "<s>a<0x41>", "日本語 mixed テキスト", "a  b   c", passage(3)]:
        assert counter.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids), text


def test_ids_follow_the_library():
    import numpy as np
    import public_tokenizers

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["", "It's <|endoftext|>x, Straße!! ÑANDÚ. a».", "İ Σ ΑΣ.", "don't 12,345 \x85 \x1cq", passage(4)]:
        assert words.ids(text) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def lower_bound(histogram, capacity):
    """Items over half of the capacity need a bin each; smaller ones fill what those leave, or more bins."""
    best = 0
    for k in range(capacity // 2 + 1):
        part = lambda low, high: {x: n for x, n in histogram.items() if low < x <= high}  # noqa: B023, E731
        large, middle, small = part(capacity - k, capacity), part(capacity // 2, capacity - k), part(k - 1, capacity // 2)
        room = sum(n * (capacity - x) for x, n in middle.items())
        rest = max(0, sum(x * n for x, n in small.items()) - room)
        best = max(best, sum(large.values()) + sum(middle.values()) - (-rest // capacity))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_everything_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(30)}
    patterns = packing.plan(histogram, 100)
    used: dict = {}
    for filling, times in patterns:
        assert sum(filling) <= 100
        for x in filling:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    assert lower_bound(histogram, 100) <= sum(t for _, t in patterns) <= lower_bound(histogram, 100) * 1.03 + 1


def test_packing_is_gapless(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, passage(i, 2, i % 30 + 1)) for i in range(40)] + [(90, None), (91, passage(5, 40, 60))], DOCS)
    rows = packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 256).collect()
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert [r.length for r in rows if r.doc_id == 90] == [1]


def test_directory_doubles():
    split = directory({k: 10 for k in range(16)}, 25, 4)
    assert sum(n for *_, n in split) == 160 and all(n <= 25 for *_, n in split)
    assert directory({0: 100}, 10, 4)[-1][2] in (0, 100)


def test_exact_duplicates(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, " "), (6, "c"), (6, "c")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (6, 6, 2, False)}
    assert exact_duplicates(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/77?x"), (2, "https://x.com/en/1"), (3, None), (4, "nothing"), (5, "http://com/en/"), (6, "http://examplecom/en/7"), (7, "http://b.com")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert got == {1: ("a.example.com", "example.com/en/7", "allow"), 2: ("x.com", "com/en/", "block"), 3: ("", None, "allow"), 4: ("", None, "allow"), 5: ("com", "com/en/", "block"), 6: ("examplecom", None, "allow"), 7: ("b.com", None, "allow")}


def test_importance_prefers_the_target(spark):
    docs = spark.createDataFrame([(i, "good words here always" if i % 2 else "junk spam junk click") for i in range(200)] + [(500, None)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (7777, None, 0)], "doc_id long, quality int, toxic int")
    rows = importance.resample(spark, docs, labels).collect()
    kept = [r.doc_id for r in rows if r.kept]
    assert len(rows) == 201 and len(kept) == round(201 * 0.5) and sum(d % 2 for d in kept if d != 500) >= 95


def test_long_rule_paths_and_null_ids(spark):
    long_path = "/" + "a" * 9000
    pages = spark.createDataFrame([(1, "http://x.org" + long_path + "b"), (None, "http://x.net/p"), (None, "http://y.net/p")], "page_id long, url string")
    rules = spark.createDataFrame([("x.org", long_path, "block"), ("x.net", "/p", "block")], "host string, path string, verdict string")
    got = {(r.page_id, r.host): r.verdict for r in filter_urls(pages, rules).collect()}
    assert got == {(1, "x.org"): "block", (None, "x.net"): "block", (None, "y.net"): "allow"}


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x y", 1, 2)], "doc_id long, text string, n long, kept long")
    assert exact_duplicates(spark, df).count() == 1
    assert line_dedup.dedup_lines(spark, df.select("doc_id", "text", F.col("n"))).columns == ["doc_id", "text", "n", "lines_in", "lines_removed"]
