"""Quality classifier by co-training: text content and page metadata teach each other with confident pseudo-labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import resting, staged
from .learn import Linear, platt, sigmoid

#: Labelled documents that the models are fitted on, at most; taken by a hash of doc_id. All others take part without label.
LABELLED = 8_000
#: Rounds of co-training, and the confidence that a pseudo-label needs.
ROUNDS, CONFIDENT = 3, 0.95
#: Weight of all pseudo-labels of a view together, as a share of that of the labels, at most.
SHARE = 0.5
#: Rows that sums of moments go to before the driver adds them up.
SLOTS = 8
#: Dimensions of the hashed shapes of words.
HASHED = 256
#: Documents with a combined score below this are rejected.
REJECT = 0.5

_SHAPE = re.compile(r"\d+")


def _shape(word: str) -> str:
    """What a word looks like, not which it is: its kind of letters and its outer symbols."""
    core = word.strip("|#%&*$!<>{}[]=_~^.,;:?\"'()-/\\")
    kind = "0" if not core else "A" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() else "a" if core.isalpha() else "a0" if core.isalnum() else "x"
    at = word.find(core) if core else len(word)
    return f"{word[:at][:2]}{kind}{word[at + len(core):][:3]}"


_UPPER = re.compile(r"[^A-ZÄÖÜÉÈÊÇÑÍÓ]+")
_SIGNS = ".,|#%&*$!"


def content(text: str) -> np.ndarray:
    """The text view: shares of word shapes (hashed), repeats, lengths and variety of words, shares of kinds of letters and signs."""
    words = text.split()
    x = np.zeros(HASHED + 9 + len(_SIGNS))
    n, size = len(words), max(1, len(text))
    if n:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        for w, c in counts.items():
            x[crc32(_shape(w).encode()) % HASHED] += c
        x[:HASHED] = np.sqrt(x[:HASHED] / n)
        x[HASHED: HASHED + 6] = (len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
                                 sum(map(len, words)) / n / 10, min(n, 50) / 50, len(counts) / np.sqrt(n) / 10)
    kinds = [text.count(c) / size for c in _SIGNS]
    x[HASHED + 6:] = len("".join(_UPPER.split(text))) / size, sum(map(str.isalpha, text)) / size, sum(kinds[2:]) > 0.02, *np.sqrt(kinds)
    return x


def metadata(lines: list[int], n_chars: int | None, lang: str | None, source: str | None) -> np.ndarray:
    """The page view, which sees no letter of the text: the page's size, language and source, and the sizes of its lines."""
    size = n_chars if n_chars is not None and n_chars >= 0 else sum(lines)
    tongue = [float(lang == x) for x in ("en", "de", "fr", "es")]
    of = np.zeros(16)
    of[crc32((source or "").encode()) % 16] = 1
    return np.array([np.log1p(size), np.log1p(len(lines)), np.log1p(max(lines)), np.log1p(np.mean(lines)), np.log1p(min(lines)), np.std(lines) / (1 + np.mean(lines)), lines.count(0) / len(lines), *tongue, *of])


@dataclass
class Model:
    views: list[Linear]
    calibration: list[tuple[float, float]]
    offset: float

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of each view, and of both: their log odds summed, less the prior's once."""
        logits = [a * m.logit(x) + b for m, (a, b), x in zip(self.views, self.calibration, views, strict=True)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(logits[0] + logits[1] - self.offset)


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of (x, 1, y): what a least-squares fit needs of any number of rows."""
    z = np.hstack([x, np.ones((len(x), 1)), y[:, None]])
    return z.T @ z


def fitted(sums: np.ndarray, penalty: float = 1.0) -> Linear:
    """The linear model of least squares on standardised features, from ``moments``."""
    n = max(sums[-2, -2], 1e-9)
    m = Linear()
    m.mean = sums[:-2, -2] / n
    m.scale = np.sqrt(np.maximum(np.diag(sums)[:-2] / n - m.mean**2, 0)) + 1e-6
    inner = (sums[:-2, :-2] - n * np.outer(m.mean, m.mean)) / np.outer(m.scale, m.scale)
    share = sums[-2, -1] / n
    w = np.linalg.solve(inner + penalty * np.eye(len(m.mean)), (sums[:-2, -1] - n * m.mean * share) / m.scale)
    m.w = np.append(w, share - 0.5)
    return m


def train(labelled: list[np.ndarray], y: np.ndarray, given: Callable[[Model], list[np.ndarray]]) -> Model:
    """Co-training: each round, each view labels what it is sure of among all documents, for the other.

    given: sums of moments, per view, of the documents that the other view of a model is sure of. A fifth of the labelled
    rows is kept from the fit and calibrates the views.
    """
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    held = aside if aside.any() and y[aside].min() < y[aside].max() else ~aside
    known = [moments(x[~aside], y[~aside]) for x in labelled]
    share = float(np.clip(y[held].mean(), 0.01, 0.99))
    extra = [np.zeros_like(k) for k in known]
    for i in range(ROUNDS + 1):
        views = [fitted(k + e * min(SHARE, SHARE * k[-2, -2] / max(e[-2, -2], 1e-9))) for k, e in zip(known, extra, strict=True)]
        model = Model(views, [platt(m.logit(x[held]), y[held]) for m, x in zip(views, labelled, strict=True)], float(np.log(share / (1 - share))))
        if i < ROUNDS:
            extra = given(model)
    return model


def _stack(rows: list[np.ndarray]) -> np.ndarray:
    return np.stack(rows) if rows else np.zeros((0, 1))


def _read(column: pa.Array) -> np.ndarray:
    return _stack([np.frombuffer(x, "<f4").astype(float) for x in column.to_pylist()])


def _featuring(names: list[str], keeps: list[str]):
    """The columns ``keeps`` of a batch, then the features of both views as bytes."""
    at = {c: names.index(c) if c in names else None for c in ("text", "n_chars", "lang", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for text, size, lang, source in zip(*[[None] * len(batch) if i is None else batch.column(i).to_pylist() for i in at.values()], strict=True):
                a.append(content(text or "").astype("<f4").tobytes())
                b.append(metadata(list(map(len, (text or "").split("\n"))), size, lang, source).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keeps], pa.array(a, pa.binary()), pa.array(b, pa.binary())], [*keeps, *VIEWS])

    return run


#: Columns of the features of both views in staged tables.
VIEWS = ["_text_view", "_metadata_view"]


def _whole(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that views are made of in the types that they have in ``documents``."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in docs.columns])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of both views, staged."""
    whole = _whole(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = StructType([StructField("doc_id", LongType()), *[StructField(c, BinaryType()) for c in VIEWS]])
    return staged(whole.mapInArrow(resting(_featuring(whole.columns, ["doc_id"])), schema), "features")


def _giving(model: Model, used: np.ndarray):
    """Rows (slot, view, moments as bytes) of a task: of the documents not in ``used`` that the other view is sure of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray | None] = [None, None]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            free = ~np.isin(np.array([-1 if i is None else i for i in ids], np.int64), used) if len(ids) else np.zeros(0, bool)
            if not free.any():
                continue
            views = [_read(batch.column(i).filter(pa.array(free))) for i in (1, 2)]
            scores = model.score(views)[:2]
            for v in (0, 1):
                p = scores[1 - v]
                sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
                m = moments(views[v][sure], (p[sure] >= 0.5).astype(float))
                sums[v] = m if sums[v] is None else sums[v] + m
        slot = TaskContext.get().partitionId() % SLOTS
        rows = [(slot, v, s.tobytes()) for v, s in enumerate(sums) if s is not None]
        yield pa.RecordBatch.from_pydict({"slot": [r[0] for r in rows], "view": [r[1] for r in rows], "sums": [r[2] for r in rows]}, _SUMS)

    return run


_SUMS = pa.schema([("slot", pa.int32()), ("view", pa.int32()), ("sums", pa.binary())])


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for v, s in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            s = np.frombuffer(s.as_py())
            sums[v] = sums[v] + s if v in sums else s
    yield pa.RecordBatch.from_pydict({"slot": [0] * len(sums), "view": list(sums), "sums": [s.tobytes() for s in sums.values()]}, _SUMS)


def fit(table: DataFrame, labels: DataFrame) -> Model | None:
    """The model, from a table (doc_id, features of both views); None if the labels are not of both kinds.

    Labels come from LABELLED documents at most; pseudo-labels from all others, as sums of moments that executors make.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("_labelled"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_labelled").isNotNull())
    ids = ids.groupBy("_labelled").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_labelled"), "_labelled").limit(LABELLED)
    views = table.select(F.col("doc_id").cast("long").alias("doc_id"), *VIEWS)
    rows = views.join(F.broadcast(ids), F.col("doc_id") == F.col("_labelled")).select("doc_id", "y", *VIEWS).toPandas().sort_values(["doc_id", VIEWS[0]], kind="stable")  # at most LABELLED documents
    y = rows["y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    labelled = [_stack([np.frombuffer(x, "<f4").astype(float) for x in rows[c]]) for c in VIEWS]
    used = np.unique(rows["doc_id"].to_numpy(dtype=np.int64))

    def given(model: Model) -> list[np.ndarray]:
        parts = views.mapInArrow(resting(_giving(model, used)), "slot int, view int, sums binary")
        added = parts.repartition(SLOTS, "slot").mapInArrow(resting(_adding), "slot int, view int, sums binary").collect()  # SLOTS rows a view
        sums = [np.zeros((x.shape[1] + 2,) * 2) for x in labelled]
        for r in sorted(added, key=lambda r: (r["view"], bytes(r["sums"]))):
            sums[r["view"]] += np.frombuffer(r["sums"]).reshape(sums[r["view"]].shape)
        return sums

    return train(labelled, y, given)


def _scored(model: Model | None, batch: pa.RecordBatch) -> list[np.ndarray]:
    """Scores of both views and of both together, from the last two columns of a batch."""
    n = len(batch)
    return list(model.score([_read(batch.column(batch.num_columns - 2)), _read(batch.column(batch.num_columns - 1))])) if model and n else [np.full(n, 1.0)] * 3


def _scoring(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s, pa.float64()) for s in _scored(model, batch)]], ["doc_id", "text_score", "metadata_score", "quality_score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, metadata_score, quality_score (1: good) and keep for each row of ``docs``.

    Null texts are empty and judged as such; null or missing n_chars count as the text's length, null or missing lang and
    source as none; equal rows are each returned. Without labels of both kinds all are kept. No rows give no rows.
    """
    table = featured(docs)
    scored = table.mapInArrow(resting(_scoring(fit(table, labels))), "doc_id long, text_score double, metadata_score double, quality_score double")
    return scored.withColumn("keep", F.col("quality_score") >= REJECT)


def _filtering(model: Model | None, names: list[str]):
    made = _featuring(names, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in made(batches):
            good = batch.filter(pa.array(_scored(model, batch)[2] >= REJECT)) if len(batch) else batch
            yield pa.RecordBatch.from_arrays(good.columns[:-2], good.schema.names[:-2])

    return run


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected. Features are made twice, for the fit and here: staging whole rows with
    them would keep a copy of the corpus in the shared folder."""
    table, whole = featured(docs), _whole(docs)
    return whole.mapInArrow(resting(_filtering(fit(table, labels), whole.columns)), whole.schema)
