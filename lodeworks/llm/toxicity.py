"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only bags have labels. A sentence's probability is the logistic of a bias plus the weights of
its words, a word's weight being the sum over its features: the word itself and its character 3- to 5-grams, ends marked. A
document's probability is the noisy-or of its sentences, 1 - prod(1 - p). The document likelihood is maximised over the
feature weights, so blame falls on the sentences that explain the labels, and the fitted sentence probabilities then locate
the offending sentences of any document.

The fit takes at most ``PER_CLASS`` labelled rows of each label value (smallest hashed ids among ids whose crc32 mod 5 is not 0),
whole texts of any length. Executors count in how many of them each feature stands; of the features that ``MIN_DOCS`` of them hold, the
``MOST_FEATURES`` whose document frequencies differ most between the labels (log odds times the root of the count) take part. Then executors
turn each text into the numbers of its sentences' features, and only those reach the driver. Scores cover every sentence of every
text; labels, language, source and id are no inputs. The fitted table of at most ``MOST_FEATURES`` weights travels with the tasks.

Defined results: a null or empty text has no sentence and scores 0; a null id is held out iff crc32 of the empty text mod 5
is 0, which it is, and rows that repeat an id are scored each; without usable labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, labelled_sample, materialize, text_bytes

PER_CLASS, MIN_DOCS, MOST_FEATURES = 3000, 4, 3000
STEPS, RATE, DECAY, START = 250, 0.1, 1e-4, -6.0
REMEMBERED = 300_000

_ENDS = b".!?\n"
_TABLE = bytes(
    46 if b in _ENDS else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words, and b"." where a sentence ends."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def features(word: bytes) -> list[str]:
    """The word and its character 3- to 5-grams, ends marked."""
    marked = f"^{word.decode()}$"
    return [marked, *{marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)} - {marked}]


class WordWeights(dict):
    """word -> sum of its features' weights, filled on demand; NaN for the sentence end."""

    def __init__(self, weights: dict[str, float]):
        super().__init__({b".": math.nan})
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        value = sum([get(f, 0.0) for f in features(word)])
        if len(self) < REMEMBERED:
            self[word] = value
        return value


@dataclass
class Model:
    """Feature weights and a bias."""

    bias: float = -50.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.words = WordWeights(self.weights)

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def sentences(self, text: bytes) -> np.ndarray:
        """The probability of each sentence that has a word, in order."""
        found = tokens(text)
        if not found:
            return np.empty(0)
        value = np.fromiter(map(self.words.__getitem__, found), float, len(found))
        end = np.isnan(value)
        number = np.cumsum(end)[~end]
        words = np.bincount(number)
        sums = np.bincount(number, value[~end])[words > 0]
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))

    def score(self, text: bytes) -> float:
        """The noisy-or of the sentences."""
        return noisy_or(self.sentences(text))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum()))


def spans(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that have a word, in the order of ``Model.sentences``."""
    flat, out, begin = text.translate(_TABLE), [], 0
    for part in flat.split(b"."):
        if part.strip():
            out.append((begin, begin + len(part)))
        begin += len(part) + 1
    return out


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts -> (feature, clean, toxic): how many documents of each label hold it, a row for each feature that the task meets."""
    held = [Counter(), Counter()]
    of_word: dict[bytes, list[str]] = {}
    for batch in batches:
        for part in chunks(batch):
            for text, label in zip(text_bytes(part.column("text")), part.column("label").to_pylist()):
                own: set[str] = set()
                for w in set(tokens(text)) - {b"."}:
                    own.update(of_word[w] if w in of_word else of_word.setdefault(w, features(w)))
                held[label].update(own)
                if len(of_word) > REMEMBERED:
                    of_word.clear()
    names = list(held[0] | held[1])
    for begin in range(0, len(names), 50_000):
        some = names[begin : begin + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": some, "clean": pa.array([held[0][x] for x in some], pa.int64()), "toxic": pa.array([held[1][x] for x in some], pa.int64())})


def choose(counted: DataFrame, clean: int, toxic: int) -> list[str]:
    """The features that take part, from (feature, clean, toxic) of any number of tasks and the number of documents of each label."""
    each = counted.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= MIN_DOCS)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    worth = each.withColumn("worth", F.abs(odds) * F.sqrt(F.col("c") + F.col("t"))).where("worth > 0")
    return [r["feature"] for r in worth.orderBy(F.col("worth").desc(), "feature").limit(MOST_FEATURES).select("feature").collect()]


def numbered_bags(place: dict[str, int]):
    """Labelled texts -> (doc_id, label, plain, features, lengths): how many sentences have none of the features, and the features' numbers
    of the others, one sentence after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for doc, label, text in zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist(), text_bytes(part.column("text"))):
                    plain, found, lengths, own, length = 0, array("i"), array("i"), [], 0
                    for w in [*tokens(text), b"."]:
                        if w != b".":
                            length += 1
                            if w not in words:
                                words[w] = tuple(place[f] for f in features(w) if f in place)
                            own += words[w]
                            continue
                        if own:
                            found.extend(own)
                            lengths.append(len(own))
                        plain += bool(length and not own)
                        own, length = [], 0
                    rows.append((doc, label, plain, found.tobytes(), lengths.tobytes()))
                    if len(words) > REMEMBERED:
                        words.clear()
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "label", "plain", "features", "lengths"])

    return run


def fit(names: list[str], y: np.ndarray, plain: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Maximum likelihood of the noisy-or model by Adam over all bags at once; a bag is its sentences' feature numbers and their counts."""
    if len(set(y.tolist())) < 2:
        return Model()
    lengths = np.concatenate([b for _, b in bags])
    feature = np.concatenate([a for a, _ in bags])
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    document = np.repeat(np.arange(len(bags)), [len(b) for _, b in bags])
    parameters = np.zeros(len(names) + 1)
    parameters[-1] = START
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    squash = lambda z: np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-12)
    for step in range(1, STEPS + 1):
        p0 = squash(parameters[-1])
        p = squash(parameters[-1] + np.bincount(sentence, parameters[feature], minlength=len(document)))
        clean = np.exp(np.bincount(document, np.log1p(-p), minlength=len(y)) + plain * np.log1p(-p0))
        blame = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0) * weight
        slope = blame[document] * p  # of the log likelihood by each sentence's logit
        gradient = np.append(np.bincount(feature, slope[sentence], minlength=len(names)), slope.sum() + (blame * plain).sum() * p0)
        gradient[:-1] -= DECAY * parameters[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        parameters += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(float(parameters[-1]), {f: float(v) for f, v in zip(names, parameters)})


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``labels.toxic`` from a bounded sample of labelled texts."""
    sample = materialize(labelled_sample(docs, labels, "toxic", PER_CLASS), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model()
    names = choose(sample.select("text", "label").mapInArrow(count_features, "feature string, clean long, toxic long"), sizes[0], sizes[1])
    place = {f: i for i, f in enumerate(names)}
    bags = sample.mapInArrow(numbered_bags(place), "doc_id long, label int, plain long, features binary, lengths binary")
    rows = sorted(bags.collect(), key=lambda r: r["doc_id"])  # 2 * PER_CLASS rows of numbers at most
    numbers = lambda x: np.frombuffer(bytes(x), np.int32)
    y, plain = np.array([r["label"] for r in rows], float), np.array([r["plain"] for r in rows], float)
    return fit(names, y, plain, [(numbers(r["features"]), numbers(r["lengths"])) for r in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, worst_sentence (its number among those with a word; null if none)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            for part in chunks(batch):
                scores, worst = [], []
                for text in text_bytes(part.column("text")):
                    p = fitted.sentences(text)
                    scores.append(noisy_or(p))
                    worst.append(int(p.argmax()) if len(p) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(worst, pa.int32())], ["doc_id", "score", "worst_sentence"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst_sentence int")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence")


def toxic_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence, begin, end (bytes), probability and text of every sentence at or over the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, i, a, b, float(p), text[a:b].decode())
                for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")))
                for i, ((a, b), p) in enumerate(zip(spans(text), held.value.sentences(text)))
                if p >= threshold
            ]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "sentence", "begin", "end", "probability", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence int, begin long, end long, probability double, text string")
