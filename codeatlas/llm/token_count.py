"""Count-only Viterbi over a unigram vocabulary.

The text is cut as the `tokenizers` library's Metaspace step cuts it (spaces become U+2581, one is
put in front, each begins a word), and words are cut again at line feeds, which no piece contains.
An Aho-Corasick automaton enumerates the vocabulary matches that end at each position; dynamic
programming carries the best score and the number of pieces of that best path. The tie rule is the
library's: candidates are met by ascending start, and only a strictly better score replaces one. A
character without a piece of its own scores `min score - 10` and counts its UTF-8 bytes (byte
fallback). Scores are whole numbers here, so sums are exact.

Null and empty texts have 0 tokens and score 0. Very long texts are worked off word by word. Repeated
rows each give a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import table

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a model file in id order; its scores are taken as unigram scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """(pieces, score) of words, remembered for up to CACHE_WORDS words."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self[""] = (0, 0.0)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > CACHE_WORDS:
            self.clear()
            self[""] = (0, 0.0)
        got = self[word] = self.viterbi(word)
        return got

    def viterbi(self, word: str) -> tuple[int, float]:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best = None
            single = False
            for length, own in ending[end]:  # longest first: ascending starts
                start = end + 1 - length
                single |= length == 1
                value = score[start] + own
                if best is None or value > best:
                    best, pieces = value, count[start] + 1
            if not single:
                value = score[end] + self.unknown
                if best is None or value > best:
                    best, pieces = value, count[end] + len(word[end].encode())
            score[end + 1], count[end + 1] = best, pieces
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE_MARK)
        if not marked.startswith(SPACE_MARK):
            marked = SPACE_MARK + marked
        words = marked.replace(SPACE_MARK, " " + SPACE_MARK).replace("\n", " \n ").split(" ")
        got = [self[w] for w in words]
        return sum(g[0] for g in got), sum(g[1] for g in got)


COUNTS = "doc_id long, n_tokens long, score double"


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sentencepiece_vocabulary(model_path))
        for batch in batches:
            got = [counter.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
