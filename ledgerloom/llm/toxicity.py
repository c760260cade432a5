"""Toxicity by multiple-instance learning: sentences score, a document is toxic if any of them is."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 4000
#: Words that the model may use: those that tell the labels apart best.
FEATURES = 4000
#: A word must be in so many of the sample's documents, and tell the labels apart by so many standard deviations.
LEAST_DOCUMENTS, LEAST_SCORE = 4, 4.0
#: Steps of gradient descent, and the weight of the squared word weights in the loss.
STEPS, PENALTY = 100, 0.02
#: From this score on a document counts as toxic.
THRESHOLD = 0.3

# Ends of sentences become line ends, other bytes that are not of words blanks; A-Z become a-z.
_BYTES = bytes(
    0x0A if b in b".!?\n"
    else b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)
_SENTENCE = re.compile(r"[^.!?\n]+")


def sentences_of(text: str | None) -> list[list[bytes]]:
    """The sentences that have words, each as its words."""
    if not text:
        return []
    return [words for line in text.encode().translate(_BYTES).split(b"\n") if (words := line.split())]


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its first 4 to 7 characters, so that forms of a word that the sample lacks count too."""
    text = word.decode()
    return [word] + [b"^" + text[:length].encode() for length in range(4, 8) if len(text) >= length]


class _Features(dict):
    """The features of the words met so far."""

    def __missing__(self, word: bytes) -> list[bytes]:
        found = self[word] = features_of(word)
        return found


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Noisy-or of sentences: a sentence is toxic with the logistic probability of its words' weights plus a bias, a
    document unless none of its sentences is."""

    bias: float = -8.0
    weights: dict[bytes, float] = field(default_factory=dict)
    _known: dict[bytes, frozenset[bytes]] = field(default_factory=dict, repr=False)

    def _features(self, word: bytes) -> frozenset[bytes]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 500_000:
                self._known.clear()
            found = self._known[word] = frozenset(f for f in features_of(word) if f in self.weights)
        return found

    def sentence_scores(self, text: str | None) -> list[float]:
        scores = []
        for words in sentences_of(text):
            found = set().union(*map(self._features, words))
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return scores

    @staticmethod
    def combine(scores: list[float]) -> float:
        return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for p in scores))

    def worst(self, text: str, scores: list[float]) -> tuple[int, int]:
        """Start and end (code points) of the sentence with the highest score, the first of several."""
        at = max(range(len(scores)), key=lambda i: (scores[i], -i))
        spans = [m.span() for m in _SENTENCE.finditer(text) if sentences_of(m[0])]
        return spans[at]


def _useful(sample: list[tuple[list[list[bytes]], int]], known_features: _Features) -> list[bytes]:
    """The features that differ most in how many toxic and other documents they are in."""
    inside: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]
    for sentences, label in sample:
        inside[label].update({f for words in sentences for w in set(words) for f in known_features[w]})
        totals[label] += 1
    clean, toxic = max(1, totals[0]), max(1, totals[1])

    def weight(word: bytes) -> float:
        n0, n1 = inside[0][word], inside[1][word]
        pooled = (n0 + n1) / (clean + toxic)
        spread = math.sqrt(pooled * (1 - pooled) * (1 / clean + 1 / toxic)) or 1.0
        return abs(n1 / toxic - n0 / clean) / spread

    known = [w for w in inside[0].keys() | inside[1].keys() if inside[0][w] + inside[1][w] >= LEAST_DOCUMENTS]
    scored = [(-score, w) for w in known if (score := weight(w)) >= LEAST_SCORE]
    return [w for _, w in sorted(scored)[:FEATURES]]


def fit(sample: list[tuple[str | None, int]]) -> Model:
    """A model of the labelled texts, by gradient descent on the documents' log-likelihood. Without both labels the
    model knows no words."""
    read = [(sentences_of(text), label) for text, label in sample]
    read = [(sentences, label) for sentences, label in read if sentences]
    if len({label for _, label in read}) < 2:
        return Model()
    cache = _Features()
    words = {w: i for i, w in enumerate(_useful(read, cache))}
    of_sentence, of_word, of_document = [], [], []
    for document, (sentences, _) in enumerate(read):
        for sentence in sentences:
            for feature in {f for w in sentence for f in cache[w]}:
                if feature in words:
                    of_sentence.append(len(of_document))
                    of_word.append(words[feature])
            of_document.append(document)
    sent, word, doc = (np.array(x, np.int64) for x in (of_sentence, of_word, of_document))
    label = np.array([y for _, y in read])
    v = np.zeros(len(words) + 1)  # the last is the bias
    v[-1] = -8.0
    first, second = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, STEPS + 1):
        z = v[-1] + np.bincount(sent, v[word], len(doc))
        p = _sigmoid(z)
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(read))  # log P(no sentence is toxic)
        clear = np.exp(none)
        by_none = np.where(label == 1, clear / np.maximum(1 - clear, 1e-9), -1.0) / len(read)
        by_z = -by_none[doc] * p
        gradient = np.append(np.bincount(word, by_z[sent], len(words)), by_z.sum())
        gradient[:-1] += PENALTY / len(words) * v[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.98 * second + 0.02 * gradient * gradient
        rate = 0.25 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        v -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
    kept = {w: float(v[i]) for w, i in words.items() if abs(v[i]) > 0.05}
    return Model(float(v[-1]), kept)


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> Model:
    """Fit on at most SAMPLE documents of each label, chosen by a hash of the id among the rows where `fold` holds.

    `labels` has doc_id and toxic; rows with another value than 0 or 1 are left out. Only texts and labels are read.
    """
    marked = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    if fold is not None:
        marked = marked.where(fold)
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = (
        marked.where("toxic = 1").orderBy(*order).limit(SAMPLE)
        .unionByName(marked.where("toxic = 0").orderBy(*order).limit(SAMPLE))
        .withColumnRenamed("doc_id", "_id")
    )
    # At most 2 * SAMPLE rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = rows.select("doc_id", "text", "toxic").toArrow()
    sample = sorted(
        zip(found["doc_id"].to_pylist(), found["text"].to_pylist(), found["toxic"].to_pylist()),
        key=lambda row: (row[0], row[1] or "", row[2]),
    )
    return fit([(text, int(label)) for _, text, label in sample])


def toxicity(text: Column, model: Model) -> Column:
    """A struct for each text: `score` (0 to 1), `n_sentences`, and start and end of the most toxic sentence (code
    points; null where the score is below THRESHOLD). Null and empty texts, and texts without words, score 0."""
    kind = pa.struct(
        [("score", pa.float64()), ("n_sentences", pa.int64()), ("worst_start", pa.int32()), ("worst_end", pa.int32())]
    )

    @F.arrow_udf("struct<score:double,n_sentences:long,worst_start:int,worst_end:int>")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            text = text.as_py()
            scores = model.sentence_scores(text)
            total = model.combine(scores) if scores else 0.0
            span = model.worst(text, scores) if scores and total >= THRESHOLD else (None, None)
            out.append(
                {"score": total, "n_sentences": len(scores), "worst_start": span[0], "worst_end": span[1]}
            )
        return pa.array(out, kind)

    return score(text)
