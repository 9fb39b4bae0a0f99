"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence s has p(s) = sigmoid(b + sum of the weights of its distinct
features: words, and the stems that are the first four or five letters of longer words);
the document's score is the noisy-or 1 - (1 - p0) * prod(1 - p(s)), where p0 takes up labels that no sentence
explains.  b, p0 and the weights are learned together from document labels alone, by full-batch Adam with a
soft threshold on the weights (an L1 penalty), and so tell which sentences offend.

Null and empty texts have no sentence and score p0.  Without both label values to learn from, each text scores the
share of toxic labels seen (0 if none).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import give_back, held_out, short_batches, table

#: Labelled documents that the classifier is fitted on at most; they are the first by a hash of the id.
MOST_TAUGHT = 3000
#: Characters of all these texts together at most; the driver holds no more.  Where they hold more, the longest are left out.
TAUGHT_CHARS = 64 << 20
#: Documents of the sample that must hold a feature before it gets a weight.
LEAST_DOCS = 4
#: Hashed counters that pass over the features of too few documents.
COUNTERS = 1 << 22
STEPS, RATE, PENALTY = 160, 0.15, 2e-4
#: The contract's cut for a document, and ours for naming a sentence.
CUT, SENTENCE_CUT = 0.3, 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


STEMS = (4, 5)


def features(words: list[str]) -> set[str]:
    """The distinct words, and the stems, each with a star."""
    out = set(words)
    for n in STEMS:
        out |= {w[:n] + "*" for w in out if len(w) > n and w[-1] != "*"}
    return out


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    noise: float


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-x))


def loss(theta: np.ndarray, y: np.ndarray, doc: np.ndarray, sent: np.ndarray, word: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean log loss of the noisy-or and its gradient.

    doc has the document of each sentence; sent and word have the sentence and the word of each feature.
    """
    logit = np.clip(np.bincount(sent, theta[word], minlength=len(doc)) + theta[-2], -30, 30)
    p, noise = sigmoid(logit), sigmoid(theta[-1])
    left = np.bincount(doc, -np.logaddexp(0, logit), minlength=len(y)) + np.log1p(-noise)  # log of 1 - score
    score = np.clip(-np.expm1(left), 1e-6, 1 - 1e-9)
    # d loss / d(-left): positives pull it up by (1 - score) / score, negatives push it down by 1
    pull = np.where(y > 0, -(1 - score) / score, 1.0) / len(y)
    at = pull[doc] * p if len(doc) else np.zeros(0)
    slope = np.concatenate((np.bincount(word, at[sent], minlength=len(theta) - 2), [at.sum(), pull.sum() * noise]))
    return float(-np.where(y > 0, np.log(score), left).mean()), slope


def fit(texts: list[str | None], labels: list[int]) -> Model:
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -30.0, float(y.mean()) if len(y) else 0.0)
    # two looks at the texts: the words as such are never all held
    counts = np.zeros(COUNTERS, np.uint16)
    for t in texts:
        counts[np.unique([crc32(w.encode("utf-8", "surrogatepass")) % COUNTERS for w in features(WORD.findall((t or "").lower()))]).astype(np.int64)] += 1
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update(w for w in features(WORD.findall((t or "").lower())) if counts[crc32(w.encode("utf-8", "surrogatepass")) % COUNTERS] >= LEAST_DOCS)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCS))}
    del seen, counts
    words, sizes, docs = array("i"), array("i"), array("i")
    for i, t in enumerate(texts):
        for s in SENTENCE.findall((t or "").lower()):
            held = sorted(vocabulary[w] for w in features(WORD.findall(s)) if w in vocabulary)
            words.extend(held)
            sizes.append(len(held))
            docs.append(i)
    doc, flat = np.frombuffer(docs, np.int32), range(len(docs))
    sent = np.repeat(np.arange(len(flat), dtype=np.int32), np.frombuffer(sizes, np.int32))
    word = np.frombuffer(words, np.int32)
    # theta: the words' weights, the sentence bias, the logit of p0
    theta = np.zeros(len(vocabulary) + 2)
    theta[-2], theta[-1] = -5.0, np.log(y.mean() / (1 - y.mean())) - 0.5
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, slope = loss(theta, y, doc, sent, word)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        scale = rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        theta -= scale * first / (1 - 0.9**step)
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(0, np.abs(theta[:-2]) - np.minimum(scale[:-2] * PENALTY, 0.5))
        theta[-2] = min(theta[-2], -4.0)
    return Model({w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 0.05}, float(theta[-2]), float(sigmoid(theta[-1])))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_TAUGHT, chars: int = TAUGHT_CHARS) -> DataFrame:
    """(id, label, text): at most `most` labelled documents of `chars` characters together, one row an id.

    The ids are chosen first, by a hash, from those of the label table that docs hold (the greatest label of a repeated
    id counts, and the least of its texts), so that only the chosen texts leave the scan.  Of the chosen texts the shortest
    come first until `chars` is reached, so a very long one is left out alone and takes no other with it.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), "toxic").where("id is not null and toxic is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("label"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    chosen = known.join(own.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    rows = own.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumn("own", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    size = F.sum("own").over(Window.orderBy("own", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("chars", size).where(F.col("chars") <= chars).select("id", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TAUGHT) -> Model:
    """The model from the bounded `sample`, which the driver gets."""
    rows = sample(docs, labels, most).toPandas().sort_values("id")
    model = fit(rows.text.tolist(), rows.label.tolist())
    del rows
    give_back()
    return model


def judged(text: str | None, model: Model) -> tuple[float, list[dict]]:
    """The score, and the offending sentences as start, end (characters) and score."""
    lower = (text or "").lower()
    text_length = len(text or "")
    rest = float(np.log1p(-sigmoid(model.bias)))
    left = float(np.log1p(-min(model.noise, 1 - 1e-9)))
    offending = []
    if model.weights.keys().isdisjoint(features(WORD.findall(lower))):
        return float(-np.expm1(left + rest * sum(1 for _ in SENTENCE.finditer(lower)))), offending
    for s in SENTENCE.finditer(lower):
        held = model.weights.keys() & features(WORD.findall(s[0]))
        if held:
            logit = model.bias + sum(model.weights[w] for w in sorted(held))
            left -= float(np.logaddexp(0, logit))
            if (p := float(sigmoid(logit))) >= SENTENCE_CUT:
                offending.append({"start": min(s.start(), text_length), "end": min(s.end(), text_length), "score": p})
        else:
            left += rest
    return float(-np.expm1(left)), offending


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> struct(score, offending).  The model's words come from the bounded sample."""
    short_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, score: double>>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame([judged(x, held.value) for x in series], columns=["score", "offending"])

    return score


def assess(docs: DataFrame, model: Model, text: str = "text") -> Column:
    return scorer(docs.sparkSession, model)(F.col(text))


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they were, that score less than the cut."""
    rows = docs.select(F.struct("*").alias("row"), assess(docs, model).alias("judged"))
    return rows.where(F.col("judged.score") < cut).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), assess(docs, model).alias("judged"))
    return found.select("doc_id", "held_out", "judged.score", F.when(F.col("judged.score") >= CUT, 1).otherwise(0).alias("predicted"), "judged.offending")
