"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of a text (lengths, shares of kinds of characters, repetition of words and lines) are standardised and mapped
to cosines of random projections, which approximate a Gaussian kernel. Each partition of the labelled rows adds up its part
of the normal equations; only these sums reach the driver. A separate fold of the labels gives the isotonic calibration.

Labels of fold 0 (crc32 of the id as text, modulo 5) are held out and never read for fitting; fold 1 calibrates, the rest
fit. At most MAX_TRAIN labelled rows are used, by a hash of the id. Several labels of one id are averaged; null labels are
ignored; a null id counts as fold 0. Null and empty texts get the score of an empty text; very long ones are read whole, one at
a time. Without any labels every score is 0.5; an empty table of documents gives an empty table. Inputs of a score are the text's statistics alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of_batches, materialize, plain_names

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
FEATURES, RIDGE, SEED = 256, 1e-3, 20240501
MAX_TRAIN, FIT_PARTS = 200_000, 32
#: Raw scores are put into so many bins for the calibration.
BINS = 500
ACCEPT = 0.3
N_STATS = 14

_CLASS = np.zeros((256, 7))
for _i in range(256):
    _c = chr(_i)
    _k = 6 if _i > 127 else 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() else 3 if _c in ".," else 4 if _c in " \t\r" else 4 if _c == "\n" else 5
    _CLASS[_i, _k] = 1


def statistics(text: str) -> np.ndarray:
    """N_STATS numbers that describe a text."""
    raw = text.encode()
    if not raw:
        return np.zeros(N_STATS)
    lower, upper, digits, stops, blanks, symbols, _ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    most = max(Counter(words).values(), default=0)
    filled = [x for x in lines if x]
    return np.array([
        math.log1p(len(raw)), math.log1p(len(words)), len(text) / n, upper / max(1.0, lower + upper), digits / len(raw), stops / n, blanks / len(raw),
        symbols / len(raw), math.log1p(symbols), len(set(words)) / n, math.log1p(n) * (1 - len(set(words)) / n), most / n, 1 - len(set(filled)) / max(1, len(filled)), len(filled) / n,
    ])


def fold_of(key: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 for null."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS, F.lit(0)).cast("int")


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `stats` (array of double) in place of the text, and of any column of that name."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "stats")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            stats = np.concatenate([statistics(column[i].as_py() or "") for i in range(len(column))] or [np.zeros(0)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * N_STATS, pa.int32()), pa.array(stats))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + [lists], batch.schema.names[: len(kept)] + ["stats"])

    bytes_of_batches(docs.sparkSession)
    own = plain_names(docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")))
    return own.mapInArrow(run, ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)] + ["stats array<double>"])).toDF(*[f.name for f in kept], "stats")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray]  # raw scores and what they are calibrated to

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / math.sqrt(stats.shape[1]), (stats.shape[1], FEATURES))
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ w + rng.uniform(0, 2 * math.pi, FEATURES)
        return np.hstack([np.cos(z) * math.sqrt(2 / FEATURES), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.weights is None else self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, N_STATS))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours: the non-decreasing steps closest to y, as points to interpolate between."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        pools.append([yi * wi, wi, xi * wi])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def fit(described: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """described: doc_id and stats; labels: doc_id and the label, 0 or 1."""
    own = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    own = own.filter(fold_of(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = own.count()
    if n > MAX_TRAIN:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < MAX_TRAIN)
    rows = materialize(described.select("doc_id", "stats").join(own, "doc_id").withColumn("fold", fold_of(F.col("doc_id"))))
    at = [F.col("stats")[i] for i in range(N_STATS)]
    moments = rows.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at], F.avg("y"), F.count_if(F.col("fold") == CALIBRATION), F.count("*")).first()
    if not moments[-1]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), None, (np.array([0.5]), np.array([0.5])))
    model = Model(np.array(moments[:N_STATS]), np.maximum(np.array(moments[N_STATS : 2 * N_STATS]), 1e-6), None, (np.array([0.5]), np.array([0.5])))
    calibrates = F.col("fold") == CALIBRATION if 0 < moments[-2] < moments[-1] else F.lit(True)
    fits = ~calibrates if 0 < moments[-2] < moments[-1] else F.lit(True)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for part in parts:
            z = model.lift(_matrix(part["stats"]))
            total += z.T @ np.hstack([z, part["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.filter(fits).select("stats", "y").coalesce(FIT_PARTS).mapInPandas(sums, "sums binary").collect()
    total = sum(np.frombuffer(p["sums"]).reshape(FEATURES + 1, FEATURES + 2) for p in parts)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * max(1.0, total[-1, -2]) * np.eye(FEATURES + 1) / FEATURES, total[:, -1])
    raw = _applied(rows.filter(calibrates), model, model.raw, "raw").withColumn("bin", F.floor(F.col("raw") * BINS))
    bins = raw.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.steps = isotonic(*(np.array([b[c] for b in bins], float) for c in ("x", "y", "n")))
    return model


def _applied(described: DataFrame, model: Model, function, name: str) -> DataFrame:  # noqa: ANN001
    @F.pandas_udf("double")
    def apply(stats: pd.Series) -> pd.Series:
        return pd.Series(function(_matrix(stats)))

    return described.withColumn(name, apply("stats"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """docs' columns without the text, and score and predicted; all rows stay."""
    described = materialize(describe(docs))
    model = fit(described, labels, label)
    out = _applied(described, model, model.score, "score").drop("stats")
    return out.withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones; all columns stay. The model is fitted first, so that each text is read once more only."""
    model = fit(describe(docs.select("doc_id", "text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            if len(column):
                scores = model.score(np.stack([statistics(column[i].as_py() or "") for i in range(len(column))]))
                yield batch.filter(pa.array(scores >= ACCEPT))

    at, own = docs.columns.index("text"), plain_names(docs)
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
