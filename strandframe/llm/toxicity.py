"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resting
from .learn import Linear, label_model, platt

#: Documents with labels from which voters are found and models fitted, at most; taken by a hash of doc_id.
SAMPLE = 12_000
#: Voters of each kind, at most, and the lengths of word beginnings that patterns are made of.
VOTERS, STEMS = 60, (4, 5, 6, 7)
#: A document is labelled 1 from this score on.
THRESHOLD = 0.3
#: Documents that a word or pattern must be in to become a voter.
SUPPORT = 3

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def stems_of(words: set[str]) -> set[str]:
    """Beginnings of words, marked by a hyphen, for the pattern voters."""
    return {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word and stem, by label, of a partition."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.as_py() or "")
            counts[y].update(words)
            counts[y].update(stems_of(words))
    keys = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(keys), 20_000):
        part = keys[at: at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[y][k] for k in part], pa.int64()) for y in (1, 0)]], ["key", "ones", "zeros"])


def mine(sampled: DataFrame, ones: int, zeros: int, most: int = VOTERS) -> tuple[list[str], list[str]]:
    """Words and stems that occur far oftener with label 1 than with 0: at 5 times the odds or more, by a z-score."""
    found = sampled.select(F.col("text"), F.col("y")).mapInArrow(resting(_counting), "key string, ones long, zeros long")
    found = found.groupBy("key").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).where(F.col("a") >= SUPPORT)
    odds = F.log((F.col("a") + 0.5) / (F.lit(max(1, ones)) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(max(1, zeros)) - F.col("b") + 0.5))
    z = F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = found.withColumn("odds", odds).withColumn("z", z).where((F.col("odds") >= float(np.log(5))) & (F.col("z") > 1.5))
    stem = F.col("key").endswith("-")
    kinds = [found.where(~stem if k == 0 else stem).orderBy(F.round("z", 9).desc(), "key").limit(most).select("key") for k in (0, 1)]
    words, stems = ([r["key"] for r in k.collect()] for k in kinds)  # ``most`` rows each
    return words, stems


@dataclass
class Model:
    lexicon: dict[str, int]
    stems: dict[str, int]
    linear: Linear
    calibration: tuple[float, float]
    accuracies: np.ndarray
    correlations: np.ndarray

    def features(self, words: set[str]) -> np.ndarray:
        """Which voters fire, how many words do so, and whether any does."""
        x = np.zeros(len(self.lexicon) + len(self.stems) + 3)
        hits = words & self.lexicon.keys()
        for w in hits:
            x[self.lexicon[w]] = 1
        n = 0
        for w in words:
            fired = [self.stems[s] for k in STEMS if len(w) > k and (s := w[:k] + "-") in self.stems]
            if fired:
                x[fired] = 1
                n += 1
        x[-3:] = np.log1p(len(hits)), np.log1p(n), bool(hits or n)
        return x

    def score(self, text: str) -> float:
        logit = float(self.linear.logit(self.features(words_of(text))[None, :])[0])
        return float(1 / (1 + np.exp(-np.clip(self.calibration[0] * logit + self.calibration[1], -35, 35))))


def train(words: list[str], stems: list[str], featured: Callable[[Model], tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model whose voters are ``words`` and ``stems``; featured: gives the features of the labelled documents."""
    lexicon = {k: i for i, k in enumerate(words)}
    model = Model(lexicon, {k: len(lexicon) + i for i, k in enumerate(stems)}, Linear(), (1.0, 0.0), np.zeros(0), np.zeros((0, 0)))
    x, y = featured(model)
    prior = float(np.clip(y.mean(), 0.01, 0.5))
    # every voter says 1 where it fires and else abstains; one more, and its silence, says 0 where none fires
    votes = np.hstack([x[:, :-3], np.where(x[:, -1:] > 0, 0.0, -1.0)])
    posterior, model.accuracies, model.correlations = label_model(votes, prior, np.where(x[:, -1] > 0, 0.7, 0.05))
    model.linear.fit(x, posterior)
    model.calibration = platt(model.linear.logit(x), y)
    return model


def _scoring(model: Model | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") if model else prior for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), *batch.columns[1:]], ["score", *batch.schema.names[1:]])

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, usable: Column) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents, the first by a hash of doc_id; ids are chosen before texts are read."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    return picked.join(F.broadcast(ids), "doc_id")  # at most ``most`` rows


def _featuring(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(words_of(t.as_py() or "")).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *batch.columns[1:]], ["x", *batch.schema.names[1:]])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """The model and the share of label 1; None if the usable labels are not of both kinds.

    Voters are counted and features made by executors; the driver gets the voters and a vector per sampled document.
    """
    picked = sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, "toxic", SAMPLE, ~held_out(F.col("doc_id"))).select("text", "y", "doc_id")
    n = {r["y"]: r["count"] for r in picked.groupBy("y").count().collect()}  # two rows at most
    if len(n) < 2:
        return None, float(n.get(1, 0) > 0)

    def featured(model: Model) -> tuple[np.ndarray, np.ndarray]:
        rows = picked.mapInArrow(resting(_featuring(model)), "x binary, y int, doc_id long").toPandas().sort_values(["doc_id", "x"], kind="stable")
        return np.array([np.frombuffer(x, np.float32) for x in rows["x"]], dtype=float).reshape(len(rows), -1), rows["y"].to_numpy(dtype=float)

    return train(*mine(picked, n[1], n[0]), featured), n[1] / (n[0] + n[1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs (doc_id, text)``.

    Null texts are empty; rows without id are scored (and not held out); equal rows are each returned. Documents
    missing from ``labels``, null labels and labels other than 0 and 1 teach nothing. Without usable labels of both
    kinds, all get the share of label 1 (0 without any). No rows give no rows.
    """
    model, prior = fit(docs, labels)
    picked = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    scored = picked.mapInArrow(resting(_scoring(model, prior)), "score double, doc_id long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
