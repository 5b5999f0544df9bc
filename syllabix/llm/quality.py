"""Quality classifier: supervised subword embeddings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from math import exp
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.llm.common import active, map_batches
from syllabix.llm.training import Sample, labelled_sample

# Scores of words of usual length remembered per Python worker; at this number the memory is emptied.
MAX_REMEMBERED, USUAL_LENGTH = 250_000, 64
# A word that repeats the one before adds this feature so many times.
REPEAT, REPEAT_TIMES = "\x00repeat", 16


@dataclass(frozen=True)
class Settings:
    """Hashed vectors and training; the sample bounds are ``per_class`` and ``max_chars``."""

    buckets: int = 1 << 16
    dimensions: int = 16
    grams: tuple[int, int] = (3, 4)
    epochs: int = 5
    rate: float = 0.5
    seed: int = 7
    per_class: int = 2_500
    max_chars: int = 20_000


@dataclass(frozen=True, eq=False)
class Model:
    """A learned classifier, folded for scoring.

    The output is linear in the averaged vectors, so one number per bucket (its vector
    times the difference of the two output rows) scores a document.
    """

    bucket_scores: np.ndarray
    bias: float
    grams: tuple[int, int]


def feature_hashes(word: str, grams: tuple[int, int]) -> list[int]:
    """Hashes of the word and of the character n-grams of the marked word."""
    marked = f"<{word}>"
    found = [crc32(marked.encode("utf-8"), 1)]
    if marked.isascii():
        plain = marked.encode("ascii")
        for n in range(grams[0], grams[1] + 1):
            found += [crc32(plain[i : i + n]) for i in range(len(plain) - n + 1)]
    else:
        for n in range(grams[0], grams[1] + 1):
            found += [crc32(marked[i : i + n].encode("utf-8")) for i in range(len(marked) - n + 1)]
    return found


def word_counts(text: str) -> tuple[list[str], int]:
    """Words of a text, and how many of them repeat the word before."""
    words = text.split()
    return words, sum(map(eq, words, islice(words, 1, None)))


def train(sample: Sample, settings: Settings) -> Model:
    """Bucket vectors and a two-class softmax by stochastic gradient descent, one document a step.

    A class that the sample lacks is never predicted; without any documents every score
    is the prior, or 0.5.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.dimensions)) / settings.dimensions
    output = np.zeros((2, settings.dimensions))
    bias = np.zeros(2)
    remembered: dict[str, np.ndarray] = {}

    def buckets_of(word: str) -> np.ndarray:
        if word not in remembered:
            hashes = np.array(feature_hashes(word, settings.grams), dtype=np.int64)
            remembered[word] = (hashes % settings.buckets).astype(np.int32)
        return remembered[word]

    documents = []
    for text in sample.texts:
        words, repeats = word_counts(text)
        if words:
            repeated = np.full(repeats * REPEAT_TIMES, crc32(REPEAT.encode("utf-8")) % settings.buckets, np.int32)
            found, counts = np.unique(np.concatenate([repeated, *map(buckets_of, words)]), return_counts=True)
            documents.append((found, counts / counts.sum()))
        else:
            documents.append((np.empty(0, np.int32), np.empty(0)))
    remembered.clear()
    steps, step = settings.epochs * max(1, len(documents)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(documents)):
            found, share = documents[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[found]
            logits = output @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[sample.labels[i]] -= 1
            back = error @ output
            output -= rate * np.outer(error, mean)
            bias -= rate * error * 0.1
            # The mean spreads its gradient thinly over many buckets; the factor keeps steps of useful size.
            vectors[found] -= (rate * min(len(found), 64)) * share[:, None] * back
    scores = vectors @ (output[1] - output[0])
    return Model(scores, float(bias[1] - bias[0]), settings.grams)


class WordScores(dict):
    """Per word, the sum of its bucket scores and their number, as one complex number."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self._scores, self._size = model, model.bucket_scores.tolist(), len(model.bucket_scores)
        self._repeat = REPEAT_TIMES * complex(self._scores[crc32(REPEAT.encode("utf-8")) % self._size], 1)

    def __missing__(self, word: str) -> complex:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        hashes = feature_hashes(word, self.model.grams)
        found = complex(sum(self._scores[h % self._size] for h in hashes), len(hashes))
        if len(word) <= USUAL_LENGTH:
            self[word] = found
        return found

    def of(self, text: str) -> float:
        """Probability of label 1."""
        words, repeats = word_counts(text)
        total = sum(map(self.__getitem__, words), repeats * self._repeat)
        logit = self.model.bias + (total.real / total.imag if total.imag else 0.0)
        return 1 / (1 + exp(-max(-700.0, min(700.0, logit))))


@lru_cache(maxsize=1)
def _word_scores(model: Model) -> WordScores:
    return WordScores(model)


def _score(columns: dict[str, list], broadcast) -> dict[str, list]:
    of = active(_word_scores(broadcast.value)).of
    return {"id": columns["id"], "score": [of(t) for t in columns["text"]]}


def score_quality(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: label 1 likelier) of every whole text.

    A missing text counts as empty; an empty text gets the score of the output's bias.
    Missing identifiers and repeated rows are scored row by row, other columns are not
    read, an empty table gives no rows. The model sent to the tasks has one number per
    bucket. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_batches(rows, _score, f"id {kind}, score double", shared).withColumnRenamed("id", doc_id)


def quality_classifier(
    docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings(),
    label: str = "quality", text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Learn from the labelled rows that ``usable`` admits, score every document."""
    sample = labelled_sample(docs, labels, label, usable, settings.per_class, settings.max_chars, text, doc_id)
    return score_quality(docs, train(sample, settings), text, doc_id)
