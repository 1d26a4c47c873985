"""Reading level of each document from the acquisition grades of its words.

Fitting, over a bounded number of graded texts (``MOST_GRADED``, the ones with the smallest id hash):

1. Each text's level is the share of its graders' votes. A word's distribution over levels is the share of each level's
   texts that use it, so length and the number of texts of a level don't matter. Its *acquisition grade* is the mean of that
   distribution; words spread over all levels (function words, menus, log lines, quoted items) say nothing and stay unknown.
2. A text's features are quantiles and mean of the acquisition grades of its known words, each occurrence counted.
3. For each step from level ``k - 1`` to ``k`` a logistic curve over these features is calibrated on the graded texts.

The level of a document is 1 plus the number of steps that are more likely taken than not. Every document is read whole; one
pass, no shuffle. The word grades that are broadcast are bounded by the vocabulary of at most ``MOST_GRADED`` texts; all its
informative words count.

Defined cases: null, empty and wordless texts have no level (null); so have texts with fewer than ``LEAST_KNOWN`` known words,
as there is nothing to estimate from; null grades are no votes, graders' differences are averaged; without any grades no text has a
level; repeated labels count as votes.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweb.session import checkpointed

LEVELS = 5
#: Graded texts that a model is fitted on, at most.
MOST_GRADED = 20_000
#: Graded texts that must use a word, and known words that a text must have.
LEAST_TEXTS, LEAST_KNOWN = 4, 5
#: A word is known if the entropy of its distribution over levels is below this share of the largest.
INFORMATIVE = 0.85
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Word grades are kept in 250 steps, one byte each; 0 is an unknown word.
STEPS = 250
#: Texts whose histograms are described at a time.
ROWS = 2048
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class ReadingModel:
    codes: dict[str, int]  # word -> 1 .. STEPS
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # per step between levels: bias and weights

    def histogram(self, text: str) -> np.ndarray:
        """Occurrences of known words by grade step."""
        words = words_of(text)
        return np.bincount(np.frombuffer(bytes(map(self.codes.get, words, itertools.repeat(0))), np.uint8), minlength=STEPS + 1)[1:]

    def levels(self, texts: list[str | None]) -> list[int | None]:
        """The levels of some texts, described together."""
        if not len(self.weights):
            return [None] * len(texts)
        counts = np.zeros((len(texts), STEPS), np.int64)
        for i, text in enumerate(texts):
            if text:
                counts[i] = self.histogram(text)
        x = (features(counts) - self.center) / self.scale
        steps = (self.weights[:, :1] + self.weights[:, 1:] @ x.T > 0).sum(axis=0)
        return [1 + int(n) if k else None for n, k in zip(steps, counts.sum(axis=1) >= LEAST_KNOWN)]


_GRADES = 1 + (np.arange(STEPS) + 0.5) * (LEVELS - 1) / STEPS


def features(counts: np.ndarray) -> np.ndarray:
    """Quantiles and mean of the grades, for each row of histograms."""
    total = counts.sum(axis=1, keepdims=True)
    running = counts.cumsum(axis=1)
    quantiles = [_GRADES[np.minimum((running < np.maximum(total * q, 1e-9)).sum(axis=1), STEPS - 1)] for q in QUANTILES]
    return np.column_stack([*quantiles, (counts * _GRADES).sum(axis=1) / np.maximum(total[:, 0], 1)])


def word_grades(rows: DataFrame) -> DataFrame:
    """``word, n_texts, grade`` of the informative words of :func:`graded` rows."""

    @F.pandas_udf("array<string>")
    def vocabulary(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(words_of(t))) for t in texts], dtype=object)

    levels = range(1, LEVELS + 1)
    total = rows.agg(*[F.coalesce(F.sum(F.col("votes")[k - 1]), F.lit(0.0)) for k in levels]).first()
    uses = rows.select(F.explode(vocabulary("text")).alias("word"), "votes").groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"), *[F.sum(F.col("votes")[k - 1]).alias(f"v{k}") for k in levels])
    shares = uses.where(F.col("n_texts") >= LEAST_TEXTS).select("word", "n_texts", *[((F.col(f"v{k}") + 0.02) / F.lit(total[k - 1] + 1)).alias(f"s{k}") for k in levels])
    whole = sum((F.col(f"s{k}") for k in levels), F.lit(0.0))
    p = shares.select("word", "n_texts", *[(F.col(f"s{k}") / whole).alias(f"p{k}") for k in levels])
    entropy = -sum((F.col(f"p{k}") * F.log(F.col(f"p{k}")) for k in levels), F.lit(0.0))
    return p.where(entropy <= INFORMATIVE * math.log(LEVELS)).select("word", "n_texts", sum((F.col(f"p{k}") * k for k in levels), F.lit(0.0)).alias("grade"))


def code_of(grade: float) -> int:
    """A grade as one of ``STEPS`` codes."""
    return 1 + min(STEPS - 1, int((grade - 1) / (LEVELS - 1) * STEPS))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias first) by Newton steps with a ridge; ``y`` are shares of votes."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def graded(documents: DataFrame, record: str, text: str, labels: DataFrame, label_record: str, grade: str, most: int = MOST_GRADED) -> DataFrame:
    """``record, text, votes`` of at most ``most`` graded documents; ``votes`` are the shares of the levels."""
    valid = labels.where(F.col(label_record).isNotNull() & F.col(grade).between(1, LEVELS)).select(F.col(label_record).alias("record"), F.col(grade).alias("g"))
    shares = [(F.sum(F.when(F.col("g") == k, 1).otherwise(0)) / F.count(F.lit(1))).alias(f"v{k}") for k in range(1, LEVELS + 1)]
    votes = valid.groupBy("record").agg(*shares)
    votes = votes.orderBy(F.xxhash64("record"), "record").limit(most).select("record", F.array(*[f"v{k}" for k in range(1, LEVELS + 1)]).alias("votes"))
    rows = documents.select(F.col(record).alias("record"), F.col(text).alias("text")).where(F.length("text") > 0)
    return rows.join(F.broadcast(votes), "record")  # ``most`` rows of 60 bytes


def fit_documents(documents: DataFrame, record: str, text: str, labels: DataFrame, label_record: str, grade: str, most: int = MOST_GRADED) -> ReadingModel:
    """The model of the graded documents, fitted on at most ``most`` texts; the driver gets
    their words' counts and their features, never the texts."""
    rows = checkpointed(graded(documents, record, text, labels, label_record, grade, most))

    codes = {r["word"]: code_of(r["grade"]) for r in word_grades(rows).collect()}  # bounded by the texts' vocabulary
    model = ReadingModel(codes, np.zeros(len(QUANTILES) + 1), np.ones(len(QUANTILES) + 1), np.zeros((0, len(QUANTILES) + 2)))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def described(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            out: list = []
            for at in range(0, len(column), ROWS):
                counts = np.array([shared.value.histogram(t) for t in column.iloc[at : at + ROWS]]).reshape(-1, STEPS)
                known = counts.sum(axis=1) >= LEAST_KNOWN
                out.extend(f.tolist() if k else None for f, k in zip(features(counts), known))
            yield pd.Series(out, dtype=object)

    known = rows.select(described("text").alias("x"), "votes").where("x is not null").collect()
    if known:
        x, y = np.array([r["x"] for r in known]), np.array([r["votes"] for r in known])
        calibrate(model, x, y)
    return model


def calibrate(model: ReadingModel, x: np.ndarray, votes: np.ndarray) -> None:
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - model.center) / model.scale
    model.weights = np.array([_logistic(z, votes[:, k:].sum(axis=1)) for k in range(1, LEVELS)])


def with_levels(documents: DataFrame, text: str, model: ReadingModel, least_words: int = 0, name: str = "level") -> DataFrame:
    """``documents`` with the column ``name``: 1 to 5, or null; null too below ``least_words`` words between white space."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def estimate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for column in texts:
            out: list = []
            for at in range(0, len(column), ROWS):
                texts = column.iloc[at : at + ROWS]
                out.extend(model.levels([t if t and (not least_words or len(t.split(None, least_words)) >= least_words) else None for t in texts]))
            yield pd.Series(out, dtype="Int32")

    return documents.withColumn(name, estimate(F.col(text)))
