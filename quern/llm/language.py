"""Language ID by rank-order profiles.

Each language's profile holds its most frequent character n-grams (one to three letters, words framed by a blank)
in order of frequency.  A text's own n-grams are ranked likewise, and the language whose profile has them least
out of place wins: the distance of an n-gram is the difference of its two ranks, or RANKS where the profile lacks it.

Null texts and texts without a letter are `und` with score 0.  Texts with a null language teach nothing.  Ties of
frequency go to the smaller n-gram, ties of distance to the first language by name.  With no labelled text at all
every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, blocks, held_out, short_batches, table

#: N-grams in a profile, and of a text that are compared.
RANKS = 300
#: Distinct counted n-grams that a training task holds before it passes its counts on.
HELD = 2_000_000
BLANK = 32
#: Stands between texts that are counted together; no n-gram may hold it.
BETWEEN = 1
PART = (1 << 21) - 1


class Profiles(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # [gram, language], RANKS where the profile lacks it


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def framed(text: str) -> np.ndarray:
    """The code points of the lower-cased letters; each other run is one blank, also before and after."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.concatenate(([BLANK], np.where(letters()[code], code, BLANK), [BLANK]))
    blank = code == BLANK
    return code[~(blank & np.concatenate(([False], blank[:-1])))]


def ngrams(code: np.ndarray) -> np.ndarray:
    """All n-grams of one to three code points, each as one integer; single blanks are left out."""
    if len(code) < 3:
        return np.empty(0, np.int64)
    two = (code[:-1] << 21) | code[1:]
    return np.concatenate((code[code != BLANK], two, (two[:-1] << 21) | code[2:]))


def within(grams: np.ndarray) -> np.ndarray:
    """Which n-grams lie within one text."""
    return (grams & PART != BETWEEN) & (grams >> 21 & PART != BETWEEN) & (grams >> 42 != BETWEEN)


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams and their counts; a table is used where the alphabet is small."""
    alphabet = np.flatnonzero(np.bincount(code))
    k = len(alphabet)
    if k**3 > max(1 << 20, 2 * len(code)) or len(code) < 3:
        grams, counts = np.unique(ngrams(code), return_counts=True)
        return grams[real := within(grams)], counts[real]
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(k)
    code = place[code]
    two = code[:-1] * k + code[1:]
    grams, counts = [], []
    for width, codes in ((1, code), (2, two), (3, two[:-1] * k + code[2:])):
        n = np.bincount(codes, minlength=1)
        found = np.flatnonzero(n)
        gram, rest = np.zeros(len(found), np.int64), found
        for i in range(width):
            gram |= alphabet[rest % k] << (21 * i)
            rest = rest // k
        real = (gram != BLANK) & within(gram)
        grams.append(gram[real])
        counts.append(n[found][real])
    return np.concatenate(grams), np.concatenate(counts)


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        grams, where = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
        return grams, np.bincount(where, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

    def out() -> Iterator[dict]:
        for lang in list(held):
            grams, counts = merged(lang)
            for i in range(0, len(grams), 50_000):
                yield {"lang": pa.array([lang] * len(grams[i : i + 50_000])), "gram": pa.array(grams[i : i + 50_000]), "n": pa.array(counts[i : i + 50_000])}
        held.clear()

    for langs, texts in blocks(batches):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(framed(text))
        for lang, codes in by.items():
            held.setdefault(lang, []).append(counted(np.concatenate([x for c in codes for x in (c, [BETWEEN])])))
            if len(held[lang]) > 8:
                held[lang] = [merged(lang)]
        if sum(len(g) for x in held.values() for g, _ in x) > HELD:
            yield from out()
    yield from out()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> Profiles:
    """The profiles of all languages of docs, from every text.

    The counts are summed map-side first, then by (language, n-gram).  The driver gets the `ranks` most frequent
    n-grams of each language and of each of 16 parts of the n-grams: 16 x ranks rows a language at most.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = arrow_map(rows, count_task, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= ranks).select("lang", "gram", "n").toPandas()
    top = top.sort_values(["lang", "n", "gram"], ascending=[True, False, True])
    top["r"] = top.groupby("lang").cumcount()
    top = top[top.r < ranks]
    languages = sorted(top.lang.unique())
    grams = np.unique(top.gram.to_numpy(np.int64))
    table_ = np.full((len(grams), len(languages)), ranks, np.int64)
    table_[np.searchsorted(grams, top.gram), [languages.index(x) for x in top.lang]] = top.r
    return Profiles(languages, grams, table_)


def judged(text: str | None, profiles: Profiles, ranks: int = RANKS) -> tuple[str, float]:
    """(language, score); the score is 1 less the mean distance over the greatest one."""
    if not text or not profiles.languages:
        return "und", 0.0
    grams, counts = np.unique(ngrams(framed(text)), return_counts=True)
    if not len(grams):
        return "und", 0.0
    order = np.argsort(-counts, kind="stable")[:ranks]
    own = grams[order]
    at = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    known = profiles.grams[at] == own
    apart = np.where(known[:, None] & (profiles.ranks[at] < ranks), np.abs(profiles.ranks[at] - np.arange(len(own))[:, None]), ranks).sum(axis=0)
    best = int(np.argmin(apart))
    return profiles.languages[best], float(1 - apart[best] / (ranks * len(own)))


def predictor(spark: SparkSession, profiles: Profiles):
    """A column function: text -> struct(lang_pred, score).  The profiles are RANKS numbers a language."""
    short_batches(spark)
    held = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame([judged(x, held.value) for x in series], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> Column:
    return predictor(docs.sparkSession, profiles)(F.col(text))


def keep_known(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of docs, all columns as they were, whose text is in a learned language: those that are not `und`."""
    judged_ = docs.select(F.struct("*").alias("row"), identify(docs, profiles).alias("judged"))
    return judged_.where(F.col("judged.lang_pred") != "und").select("row.*")


def taught(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(taught(docs))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs, profiles).alias("judged"))
    return found.select("doc_id", "held_out", "judged.lang_pred", "judged.score")
