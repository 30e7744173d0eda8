"""Linear text classifier on hashed n-grams, trained in epochs.

Rows of hashed n-grams are made in the JVM and written once.  In an epoch every task
runs over its rows in small steps of gradient descent from the common weights; the
changes of the tasks are averaged by their numbers of rows, per weight, which is all
that travels.  After each epoch the macro F1 on the validation rows is taken, the best
weights are kept, and training ends when ``patience`` epochs brought nothing better.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.build import with_class_weight
from tidemark.operators.tfidf import list_slices, with_terms, with_words
from tidemark.session import materialise

BITS, NGRAMS = 16, (1, 2)
STEP_ROWS = 16  # rows of one step of gradient descent


def hashed_rows(df: DataFrame, text_col: str, bits: int = BITS, ngrams: tuple[int, int] = NGRAMS) -> DataFrame:
    """``df`` with ``indices`` and ``counts`` of the hashed n-grams of the text.  A null or
    empty text has none."""
    terms = with_terms(with_words(df, text_col), ngrams)
    counted = HashingTF(numFeatures=1 << bits, inputCol="_terms", outputCol="_tf").transform(terms)
    parts = counted.withColumn("_s", F.unwrap_udt("_tf"))
    return parts.select(*df.columns, F.col("_s.indices").alias("indices"), F.col("_s.values").alias("counts"))


def cells(indices: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of sparse rows: 1 + ln(count), rows of norm one."""
    row = np.repeat(np.arange(len(indices)), np.diff(indices.offsets.to_numpy()))
    x = 1.0 + np.log(counts.flatten().to_numpy(zero_copy_only=False))
    norm = np.sqrt(np.bincount(row, x * x, len(indices)))
    return row, indices.flatten().to_numpy(), x / norm[row]


def margins(indices: pa.Array, counts: pa.Array, w: np.ndarray) -> np.ndarray:
    """Margins of sparse rows; the last weight is the intercept."""
    row, at, x = cells(indices, counts)
    return np.bincount(row, w[at] * x, len(indices)) + w[-1]


def epoch(rows: DataFrame, w: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one pass of all tasks over their ``rows`` (indices, counts, y, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = w.copy(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = dict(zip(batch.schema.names, batch.slice(at, STEP_ROWS).columns))
                row, feature, x = cells(part["indices"], part["counts"])
                y, c = part["y"].to_numpy(), part["weight"].to_numpy()
                z = np.bincount(row, own[feature] * x, len(y)) + own[-1]
                pull = rate * c * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y)
                np.subtract.at(own, feature, pull[row] * x)
                own[-1] -= pull.mean()
                n += len(z)
        moved = np.flatnonzero(own != w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(moved, -1)), pa.array(np.append((own - w)[moved] * n, float(n)))], names=["at", "value"])

    sums = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = w.copy()
    n = float(sums.loc[sums["at"] == -1, "value"].sum())
    change = sums[sums["at"] >= 0]
    out[change["at"].to_numpy()] += change["value"].to_numpy() / max(n, 1.0)
    return out


def macro_f1(rows: DataFrame, w: np.ndarray) -> float:
    """Macro F1 of ``margin > 0`` on ``rows``, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(4, np.int64)
        for batch in chain.from_iterable(map(list_slices, batches)):
            part = dict(zip(batch.schema.names, batch.columns))
            pred = margins(part["indices"], part["counts"], w) > 0
            seen += np.bincount(2 * part["y"].to_numpy().astype(int) + pred, minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4)), pa.array(seen)], names=["cell", "n"])

    n = {r["cell"]: r["n"] for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    tn, fp, fn, tp = (n.get(i, 0) for i in range(4))
    scores = [2 * hit / max(1, 2 * hit + fp + fn) for hit in (tn, tp)]
    return sum(scores) / 2


@dataclass(frozen=True)
class HashedClassifier:
    weights: np.ndarray
    bits: int
    ngrams: tuple[int, int]
    history: tuple[float, ...]  # macro F1 on the validation rows after each epoch

    def score(self, df: DataFrame, text_col: str = "prompt", out: str = "margin") -> DataFrame:
        """``df`` with the margin of the second class in ``out``."""
        w = self.weights

        @F.pandas_udf("double")
        def margin(indices: pd.Series, values: pd.Series) -> pd.Series:
            if not len(indices):
                return pd.Series([], dtype=float)
            rows = pa.RecordBatch.from_arrays([pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["indices", "counts"])
            return pd.Series(np.concatenate([margins(*part.columns, w) for part in list_slices(rows)]))

        rows = hashed_rows(df, text_col, self.bits, self.ngrams)
        return rows.withColumn(out, margin("indices", "counts")).select(*[c for c in df.columns if c != out], out)

    @staticmethod
    def logits(margin: Column) -> Column:
        """Logits of both classes whose softmax is the logistic function of the margin."""
        return F.array(-margin / 2, margin / 2)


def fit_hashed_classifier(
    train: DataFrame, val: DataFrame, text_col: str = "prompt", labels: Sequence[int] = (0, 1), bits: int = BITS,
    ngrams: tuple[int, int] = NGRAMS, rate: float = 2.0, epochs: int = 20, patience: int = 4,
) -> HashedClassifier:
    """Logistic loss with balanced class weights; the epoch of best macro F1 on ``val``."""

    def prepared(df: DataFrame) -> DataFrame:
        y = (F.col("label") == labels[1]).cast("double").alias("y")
        weighted = with_class_weight(df.select(text_col, "label"), labels).withColumnRenamed("weight", "_c")
        return materialise(hashed_rows(weighted, text_col, bits, ngrams).select("indices", "counts", y, F.col("_c").cast("double").alias("weight")))

    rows, held = prepared(train), prepared(val)
    w = np.zeros((1 << bits) + 1)
    best, chosen, history = -1.0, w, []
    for i in range(epochs):
        w = epoch(rows, w, rate / (1.0 + 0.2 * i))
        history.append(macro_f1(held, w))
        if history[-1] > best:
            best, chosen = history[-1], w
        elif i - int(np.argmax(history)) >= patience:
            break
    return HashedClassifier(chosen, bits, ngrams, tuple(history))
