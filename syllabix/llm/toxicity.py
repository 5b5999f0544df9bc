"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from math import exp, expm1, log1p

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.llm.common import active, append_column, map_batches, unused_name
from syllabix.llm.training import Sample, labelled_sample

_SENTENCES = re.compile(r"[^.!?\n]+[.!?\n]*").finditer
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*").findall
# Characters of a word's beginning that stand for words of one stem.
PREFIX = 4
# Words of usual length remembered per Python worker; at this number the memory is emptied.
MAX_REMEMBERED, USUAL_LENGTH = 250_000, 64


@dataclass(frozen=True)
class Settings:
    """Training; the sample bounds are ``per_class`` and ``max_chars``."""

    per_class: int = 2_500
    max_chars: int = 20_000
    min_documents: int = 4
    rounds: int = 200
    rate: float = 0.1
    penalty: float = 2e-4
    start: float = -6.0
    floor: float = 0.5


@dataclass(frozen=True, eq=False)
class Model:
    """Logit of a sentence: ``bias`` plus the weights of the features of its distinct words."""

    weights: dict[str, float]
    bias: float


def features(word: str) -> tuple[str, str]:
    """The word itself and its beginning."""
    return word, word[:PREFIX] + "*"


def softplus(z: float) -> float:
    return z + log1p(exp(-z)) if z > 0 else log1p(exp(z))


def sentences(text: str) -> list[tuple[int, str]]:
    """Start and text of every sentence that has a word."""
    return [(m.start(), m.group()) for m in _SENTENCES(text) if _WORDS(m.group())]


def train(sample: Sample, settings: Settings) -> Model:
    """Sentence weights from document labels.

    A document is positive with probability 1 - prod(1 - p) over its sentences. Weights
    are evidence for label 1 and never negative; features of fewer than ``min_documents``
    distinct sample texts have none. Documents weigh as their class does among all
    labelled rows, and a feature gets weight only if it moves more than the share
    ``penalty`` of that mass (L1). Features that reach ``floor`` are then fitted again
    without the penalty. Full gradient steps scaled per weight (Adam). A sample of one
    label alone predicts that label, an empty one predicts 0.
    """
    texts = dict(zip(sample.texts, sample.labels, strict=True))
    numbers: dict[str, int] = {}
    seen = array("i")
    word, sentence, document = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        of_text: set[int] = set()
        for _, found in sentences(text):
            mine = sorted({f for w in set(_WORDS(found.lower())) for f in features(w)})
            placed = [numbers.setdefault(f, len(numbers)) for f in mine]
            word.extend(placed)
            sentence.extend(repeat(len(document), len(placed)))
            document.append(d)
            of_text.update(placed)
        seen.extend(repeat(0, len(numbers) - len(seen)))
        for f in of_text:
            seen[f] += 1
    names = [f for f, n in zip(numbers, seen, strict=True) if n >= settings.min_documents]
    place = np.full(len(numbers), -1, np.int32)
    place[[numbers[f] for f in names]] = np.arange(len(names), dtype=np.int32)
    del numbers
    word, sentence, document = (np.frombuffer(a, np.int32) if a else np.empty(0, np.int32) for a in (word, sentence, document))
    kept = place[word] >= 0
    word, sentence = place[word[kept]], sentence[kept]
    y = np.array(list(texts.values()), dtype=float)
    positives = y.sum()
    if not positives or positives == len(y):
        return Model({}, 30.0 if positives else -30.0)
    share = sample.positive_share
    importance = np.where(y == 1, share / positives, (1 - share) / (len(y) - positives))

    def climb(weight: np.ndarray, word: np.ndarray, sentence: np.ndarray, penalty: float) -> np.ndarray:
        weight = weight.copy()
        first, second = np.zeros_like(weight), np.zeros_like(weight)
        for step in range(1, settings.rounds + 1):
            z = np.bincount(sentence, weight[word], len(document)) + weight[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.bincount(document, np.logaddexp(0, z), len(y))  # -log of "no sentence is toxic"
            # Derivative of the log-likelihood by a sentence's logit.
            pull = np.where(y == 1, 1 / np.expm1(np.clip(none, 1e-6, 50)), -1.0) * importance
            slope = pull[document] * p
            gradient = np.append(np.bincount(word, slope[sentence], len(weight) - 1) - penalty, slope.sum())
            gradient[:-1][(weight[:-1] == 0) & (gradient[:-1] < 0)] = 0
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            weight += settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
            weight[:-1] = np.maximum(weight[:-1], 0)
        return weight

    weight = climb(np.append(np.zeros(len(names)), settings.start), word, sentence, settings.penalty)
    weight[:-1][weight[:-1] < settings.floor] = 0
    chosen = weight[:-1] > 0
    weight = climb(weight, word[chosen[word]], sentence[chosen[word]], 0.0)
    return Model({names[i]: float(weight[i]) for i in np.flatnonzero(chosen)}, float(weight[-1]))


class WordWeights(dict):
    """Weight by word, the sum over its features."""

    def __init__(self, model: Model):
        super().__init__()
        self.bias, self._weights = model.bias, model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        found = sum(self._weights.get(f, 0.0) for f in features(word))
        if len(word) <= USUAL_LENGTH:
            self[word] = found
        return found


def score_text(text: str, weights: WordWeights, threshold: float | None) -> tuple[float, list[tuple[int, int, float]]]:
    """Document score, and start, length and score of the sentences that reach ``threshold``."""
    none, spans, weight = 0.0, [], weights.__getitem__
    for start, sentence in ((m.start(), m.group()) for m in _SENTENCES(text)):
        words = _WORDS(sentence.lower())
        if not words:
            continue
        part = softplus(weights.bias + sum(map(weight, set(words))))
        none += part
        if threshold is not None and -expm1(-part) >= threshold:
            spans.append((start, len(sentence), -expm1(-part)))
    return -expm1(-none), spans


@lru_cache(maxsize=1)
def _word_weights(model: Model) -> WordWeights:
    return WordWeights(model)


def _score(columns: dict[str, list], broadcast, threshold: float | None) -> dict[str, list]:
    weights = active(_word_weights(broadcast.value))
    scored = [score_text(t, weights, threshold) for t in columns["text"]]
    names = ("start", "length", "score")
    return {
        "id": columns["id"],
        "score": [s for s, _ in scored],
        "sentences": [[dict(zip(names, span, strict=True)) for span in spans] for _, spans in scored],
    }


def score_toxicity(
    docs: DataFrame, model: Model, threshold: float | None = 0.3, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and the offending ``sentences`` of every whole text.

    ``sentences`` lists start, length (in characters) and score of sentences that reach
    ``threshold`` on their own; none are listed without a threshold. A missing text
    counts as empty; a text without words has no sentence and scores 0. Missing
    identifiers and repeated rows are scored row by row, other columns are not read, an
    empty table gives no rows. The model sent to the tasks is bounded by the training
    sample. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"id {kind}, score double, sentences array<struct<start: int, length: int, score: double>>"
    return map_batches(rows, _score, schema, shared, threshold).withColumnRenamed("id", doc_id)


def _scores(texts: list[str | None], broadcast) -> list[float]:
    weights = active(_word_weights(broadcast.value))
    return [score_text(t or "", weights, None)[0] for t in texts]


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below ``threshold``; scored as in ``score_toxicity``, no shuffle."""
    score = unused_name(docs, "_toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = append_column(docs, score, "double", _scores, text, shared)
    return scored.filter(F.col(score) < threshold).drop(score)


def toxicity(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings(),
    threshold: float | None = 0.3, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Learn from the rows of ``labelled`` whose labels ``usable`` admits, score every row of ``docs``."""
    sample = labelled_sample(labelled, labels, label, usable, settings.per_class, settings.max_chars, text, doc_id)
    return score_toxicity(docs, train(sample, settings), threshold, text, doc_id)
