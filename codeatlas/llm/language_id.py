"""Language ID: averaged hashed subword embeddings with a linear softmax.

Features are byte n-grams (2 to 4 bytes of UTF-8, A-Z lower-cased, digits, ASCII punctuation and
white space as one blank), hashed into BUCKETS embedding rows. A text's vector is the mean of its
n-grams' rows, and a linear softmax over it gives the language. Embeddings and weights are trained
by mini-batch stochastic gradient descent in numpy, on segments of a bounded sample of labelled
rows: about PER_LANGUAGE texts of each of at most MAX_LANGUAGES languages, chosen by a hash of the
id. A part of the sample, not used for the descent, sets the temperature of the softmax and the
rejection threshold: a text is rejected if its score is below what all but REJECT of the
calibration texts reach, at most MOST, or if it has no letter.

Since the model is linear, the trained rows are multiplied by the weights once; predicting a text
is a sum of a few numbers per n-gram over the whole text, whatever its length, in slices.

Null texts and texts without a letter get `und` with score 0 and are rejected. Rows without a label
are predicted like all others and never learnt from. Repeated rows give equal predictions; extra
columns are ignored. An empty table gives an empty result; without any labelled text every
prediction is `und`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import table
from codeatlas.llm.textkernel import slices, string_buffers

BUCKETS = 1 << 16
DIM = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 400
MAX_LANGUAGES = 200
#: Of a training text, so many bytes are learnt from at most, as segments spread over all of it.
SEGMENT, SEGMENTS = 300, 8
REJECT, MOST = 0.002, 0.5
FOLDS = 5
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each n-gram of folded bytes; the last n - 1 positions have none."""
    h = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
    for t in range(n):
        h = h * np.uint32(0x01000193) + data[t : t + len(h)]
    h = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return (h ^ h >> np.uint32(15)) & np.uint32(BUCKETS - 1)


def segment_grams(data: bytes) -> np.ndarray:
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    return np.concatenate([grams(folded, n) for n in GRAMS])


class Model:
    """Per-bucket logits, bias, temperature and rejection threshold."""

    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.bias, self.temperature, self.threshold = languages, bias, 1.0, 0.0
        self.logits = np.vstack([logits, np.zeros((1, logits.shape[1]))]).astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated probabilities of every row's whole text."""
        off, raw = string_buffers(column)
        total = np.zeros((len(off) - 1, len(self.languages)))
        count = np.zeros(len(off) - 1)
        for i, j in slices(off):
            step = 1 << 20
            for a in range(int(off[i]), int(off[j]), step):
                # a row longer than a slice goes on in the next step, with the bytes its n-grams share
                b = min(a + step, int(off[j])) if j == i + 1 else int(off[j])
                tail = min(b + max(GRAMS) - 1, int(off[j]))
                data, cuts = _FOLD[raw[a:tail]], np.clip(off[i : j + 1], a, b) - a
                for n in GRAMS:
                    got = grams(data, n)[: b - a]
                    if not len(got):
                        continue
                    for k in range(1, n):
                        at = off[i + 1 : j + 1] - a - k
                        got[at[(at >= 0) & (at < len(got))]] = BUCKETS
                    full = np.flatnonzero(np.diff(cuts) > 0)
                    starts = np.minimum(cuts[full], len(got) - 1)
                    use = cuts[full] < len(got)
                    total[i + full[use]] += np.add.reduceat(self.logits[got], starts[use], axis=0)
                    count[i + full[use]] += np.add.reduceat((got < BUCKETS).astype(np.float64), starts[use])
                if b == int(off[j]):
                    break
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of every row."""
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False), dtype=bool)
        if not self.languages or not len(letters):
            return [UNDETERMINED] * len(letters), np.zeros(len(letters)), np.ones(len(letters), dtype=bool)
        p = self.scores(column)
        best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
        return names, score, ~letters | (score < self.threshold)


def train(rows: list[tuple[int, str, str]], epochs: int = 4, batch: int = 64, rate: float = 1.0, seed: int = 7) -> Model:
    """A model from (doc_id, text, lang) rows."""
    languages = sorted({lang for _, _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    descent, calibration = [], []
    for doc, text, lang in sorted(rows):
        data = text.encode()
        if not data.strip():
            continue
        if zlib.crc32(f"c{doc}".encode()) % 5 == 0:
            calibration.append((text, lang))
            continue
        starts = range(0, len(data), SEGMENT)
        for s in list(starts)[:: max(1, -(-len(starts) // SEGMENTS))]:
            g = segment_grams(data[s : s + SEGMENT])
            if len(g):
                descent.append((g, languages.index(lang)))
    rows_e = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.5, (DIM, len(languages))), np.zeros(len(languages))
    # every language weighs the same
    share = np.bincount([y for _, y in descent], minlength=len(languages))
    weight = len(descent) / np.maximum(share, 1) / len(languages)
    steps = epochs * -(-len(descent) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(descent))
        for at in range(0, len(order), batch):
            now = rate * (1 - step / steps)
            step += 1
            part = [descent[k] for k in order[at : at + batch]]
            flat = np.concatenate([g for g, _ in part])
            lens = np.array([len(g) for g, _ in part])
            y = np.array([k for _, k in part])
            mean = np.add.reduceat(rows_e[flat], np.cumsum(lens) - lens, axis=0) / lens[:, None]
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(y)
            back = (p @ weights.T) * 10
            weights -= now * mean.T @ p
            bias -= now * 0.1 * p.sum(axis=0)
            each = np.repeat(back / lens[:, None], lens, axis=0)
            used, inverse = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, each[:, d], len(used)) for d in range(DIM)], axis=1)
            rows_e[used] -= now * grad * 10
    model = Model(languages, rows_e @ weights, bias)
    if calibration:
        column, truth = pa.array([t for t, _ in calibration]), np.array([languages.index(x) for _, x in calibration])
        loss = {}
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
            model.temperature = t
            loss[t] = -np.log(np.maximum(model.scores(column)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = min(loss, key=loss.get)
        model.threshold = min(MOST, float(np.quantile(model.scores(column).max(axis=1), REJECT)))
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, learnable: str | None = None) -> list[tuple[int, str, str]]:
    """About `per_language` labelled rows of each language, chosen by a hash of the id."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    if learnable is not None:
        rows = rows.where(learnable)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    picked = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    # of a long text, the executors cut out the segments to learn from
    size = F.char_length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.substring(F.col("text"), (i * (size - SEGMENT) / (SEGMENTS - 1)).cast("int") + 1, F.lit(SEGMENT)))
    text = F.when(size <= SEGMENT * SEGMENTS, F.col("text")).otherwise(F.array_join(pieces, " "))
    return [(r.doc_id, r.text, r.lang) for r in picked.select("doc_id", text.alias("text"), "lang").limit(2 * per_language * len(counts)).collect()]


LEARNABLE = f"crc32(cast(doc_id AS string)) % {FOLDS} <> 0"
PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, rejected = shared.value.predict(b.column(1))
            out = [held_out(i) if i is not None else False for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PREDICTIONS)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the learnable rows' sample and predicts every row."""
    return predict(docs, train(sample(docs, learnable=LEARNABLE)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is not rejected, with all their columns."""
    model = train(sample(docs, learnable=LEARNABLE))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(~shared.value.predict(pa.array(text, pa.string()))[2])

    return docs.where(accepted(F.col("text")))
