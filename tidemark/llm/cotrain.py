"""Document quality by co-training.

Two views of a document: its text (frequencies of bytes and of hashed words,
repetition) and the page's metadata (language, source, length and layout).  Each
view has a logistic regression.  Over some rounds, each view labels the documents
of an unlabelled pool of which it is surest, in the proportion of the classes, and
hands them to the *other* view as training rows.  How sure is sure enough is read off
labelled rows that no fit has seen: at least ``PRECISION`` of the answers from
there on are right; a view that never gets there teaches nothing.  On the same rows the
views are calibrated, and their calibrated log-odds weighted and added.

The fit uses at most ``LABELLED`` labelled rows and ``POOL`` unlabelled ones, those
of least hash: documented bounds of the fit alone.  Features are computed in Arrow
batches; only those of the bounded samples reach the driver.  Scoring covers all
documents in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import worker_cache
from tidemark.llm.words import Hasher, word_chunks

LABELLED, POOL, ROUNDS, PER_ROUND, PRECISION = 5_000, 5_000, 4, 400, 0.99
THRESHOLD = 0.25  # rejected are only documents that are clearly bad
WORD_BUCKETS, STATS = 256, 6
SOURCES, LANGS, LAYOUT = 64, 16, 6
META = ("lang", "source", "n_chars")


def text_view(h: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text features and the layout part of the metadata features of one document."""
    counts = np.bincount(raw, minlength=256)
    n, size = max(1, len(raw)), max(1, len(h))
    buckets = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=WORD_BUCKETS)
    again = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    stats = [np.log1p(len(h)), n / size, len(np.unique(h)) / size, again, buckets.max() / size, float(len(h) == 0)]
    text = np.concatenate([np.sqrt(counts / n), np.sqrt(buckets / size), stats])
    lines = int(counts[10]) + 1
    chars = len(raw) - int(counts[128:192].sum())
    layout = np.array([np.log1p(chars), np.log1p(lines), np.log1p(chars / lines), len(raw) / max(1, chars), np.log1p(len(h) / lines), float(chars == 0)])
    return text, layout


def meta_view(layout: np.ndarray, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """A null language or source is a value of its own; a null length is flagged."""
    out = np.zeros(LANGS + SOURCES + 2)
    out[zlib.crc32(repr(lang).encode()) % LANGS] = 1
    out[LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[-2] = np.log1p(max(0, n_chars or 0))
    out[-1] = n_chars is None
    return np.concatenate([out, layout])


def batch_views(columns: Sequence[pa.Array], hasher: Hasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, text features, metadata features) of the columns text, lang, source, n_chars."""
    text, lang, source, n_chars = columns
    rest = [c.to_pylist() for c in (lang, source, n_chars)]
    for lo, hi, h, at, _, _, part in word_chunks(text, hasher):
        first = 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(text.slice(lo, hi - lo)), 0).to_numpy()
        for i in range(hi - lo):
            words, layout = text_view(h[at[i] : at[i + 1]], part[first : first + sizes[i]])
            first += sizes[i]
            yield lo + i, words, meta_view(layout, *[c[lo + i] for c in rest])


def view_columns(docs: DataFrame, text_col: str) -> list:
    """Text and metadata as typed columns; a metadata column that is absent is null."""
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(f"_{c}") for c in META]
    return [F.col(text_col).cast("string").alias("_text"), *meta]


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> Logistic:
    """L2-regularised logistic regression by accelerated gradient steps."""
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = (x - mean.astype(np.float32)) / scale.astype(np.float32)
    y = y.astype(np.float32)
    n = len(z)
    w, b = np.zeros(z.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):  # largest eigenvalue: the step size
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * max(np.linalg.norm(z @ v) ** 2 / n, 1.0) + penalty)
    last_w, last_b = w.copy(), b
    for t in range(steps):
        ahead_w, ahead_b = w + np.float32(t / (t + 3)) * (w - last_w), b + t / (t + 3) * (b - last_b)
        error = sigmoid(z @ ahead_w + ahead_b) - y
        last_w, last_b = w, b
        w, b = ahead_w - np.float32(rate) * (error @ z / n + penalty * ahead_w), ahead_b - rate * float(error.mean())
    return Logistic(mean, scale, w.astype(float), b)


@dataclass
class Model:
    """Both views, the calibration of each (slope, offset) and the weights of both in
    the final log-odds (text view, metadata view, offset)."""

    views: tuple[Logistic, Logistic] | None
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combination: tuple[float, float, float]
    exchanged: int = 0

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        if self.views is None:
            return np.full((len(text), 3), sigmoid(np.array(self.combination[2])))
        logits = [s * m.logits(x) + o for m, x, (s, o) in zip(self.views, (text, meta), self.calibration)]
        both = self.combination[0] * logits[0] + self.combination[1] * logits[1] + self.combination[2]
        return np.stack([sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(both)], axis=1)


def newton(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic weights of few columns, targets drawn in from 0 and 1, with a ridge
    towards ``start``, so that separable rows don't drive them off."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta, ridge = start.copy(), 0.5 * np.eye(len(start))
    for _ in range(50):
        p = sigmoid(x @ theta)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - target) + ridge @ (theta - start))
        theta = theta - move / max(1.0, np.abs(move).max())
    return theta


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset."""
    slope, offset = newton(np.stack([np.clip(logits, -15, 15), np.ones(len(logits))], axis=1), y, np.array([1.0, 0.0]))
    return float(max(slope, 0.0)), float(offset)


def sure_from(confidence: np.ndarray, right: np.ndarray) -> float:
    """Least confidence from which on at least ``PRECISION`` of 20 or more held-out
    answers are right; above 1 if there is none: the view then teaches nothing."""
    order = np.argsort(-confidence, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((share >= PRECISION) & (np.arange(1, len(order) + 1) >= 20))
    return float(confidence[order[good[-1]]]) if len(good) else 2.0


def co_train(views: Sequence[np.ndarray], y: np.ndarray, pool: Sequence[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Fits both views; a fifth of the labelled rows is kept for the calibration.
    Fewer than 20 rows, or of one class only, give a constant: the smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 20 or min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return Model(None, ((1.0, 0.0), (1.0, 0.0)), (0.0, 0.0, prior))
    rows = [(v[~held], y[~held]) for v in views]
    free = np.ones(len(pool[0]), bool)
    exchanged = 0
    for _ in range(rounds):
        models = [fit_logistic(*r) for r in rows]
        if not free.any():
            break
        given = []
        for k in (0, 1):
            p, known = sigmoid(models[k].logits(pool[k])), sigmoid(models[k].logits(views[k][held]))
            chosen = []
            for value, sure, seen, part in ((1.0, p, known, share), (0.0, 1 - p, 1 - known, 1 - share)):
                least = sure_from(seen[seen > 0.5], y[held][seen > 0.5] == value)
                order = np.argsort(-np.where(free, sure, -1.0), kind="stable")[: max(1, int(PER_ROUND * part))]
                chosen += [(i, value) for i in order if free[i] and sure[i] >= least]
            given.append(chosen)
        for k in (0, 1):
            told = given[1 - k]
            if told:
                at = np.array([i for i, _ in told])
                rows[k] = (np.concatenate([rows[k][0], pool[k][at]]), np.concatenate([rows[k][1], [v for _, v in told]]))
                exchanged += len(told)
        taken = [i for chosen in given for i, _ in chosen]
        if not taken:
            break
        free[taken] = False
    models = [fit_logistic(*r) for r in rows]
    raw = [m.logits(v[held]) for m, v in zip(models, views)]
    scales = tuple(calibrated(r, y[held]) for r in raw)
    x = np.stack([*[np.clip(s * r + o, -15, 15) for r, (s, o) in zip(raw, scales)], np.ones(int(held.sum()))], axis=1)
    weights = newton(x, y[held], np.array([0.5, 0.5, 0.0]))
    return Model(tuple(models), scales, (float(max(weights[0], 0.0)), float(max(weights[1], 0.0)), float(weights[2])), exchanged)


def sample_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of the documents in ``ids`` (bounded) by id; of repeated ids, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = worker_cache("hasher", Hasher)
        for batch in batches:
            found = list(batch_views(batch.columns[-4:], hasher))
            blobs = [[v[k].astype("<f4").tobytes() for v in found] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(b, pa.binary()) for b in blobs]], ["id", "t", "m"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *view_columns(docs, text_col))
    found = rows.join(F.broadcast(ids.select("id")), "id", "semi").mapInArrow(run, "id long, t binary, m binary")
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in found.collect():
        if r["id"] not in out or (r["t"], r["m"]) < out[r["id"]]:
            out[r["id"]] = (bytes(r["t"]), bytes(r["m"]))
    return {k: (np.frombuffer(t, "<f4"), np.frombuffer(m, "<f4")) for k, (t, m) in out.items()}


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    labelled: int = LABELLED, pool: int = POOL,
) -> Model:
    """Model from the bounded samples.  Null ids and null labels are left out; a
    document with several labels takes the largest."""
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    given = given.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    given = given.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "semi")
    chosen = given.orderBy(F.xxhash64("id"), "id").limit(labelled).collect()
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["id"],) for r in chosen], "id long")
    others = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").join(F.broadcast(known), "id", "anti")
    free = [r["id"] for r in others.orderBy(F.xxhash64("id"), "id").limit(pool).collect()]
    unlabelled = spark.createDataFrame([(i,) for i in free], "id long")
    features = sample_features(docs, known.unionAll(unlabelled).distinct(), id_col, text_col)
    rows = [r for r in chosen if r["id"] in features]
    rest = sorted(set(free) & features.keys())

    def stacked(ids: list[int], k: int) -> np.ndarray:
        width = (256 + WORD_BUCKETS + STATS, LANGS + SOURCES + 2 + LAYOUT)[k]
        return np.stack([features[i][k] for i in ids]) if ids else np.zeros((0, width), np.float32)

    y = np.array([r["y"] for r in rows], float)
    ids = [r["id"] for r in rows]
    return co_train([stacked(ids, 0), stacked(ids, 1)], y, [stacked(rest, 0), stacked(rest, 1)])


def score(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of every row, with ``text_probability``,
    ``meta_probability``, ``quality_probability`` and ``accepted``.

    Null and empty texts are scored as texts without bytes.  Repeated rows get equal
    scores.  Columns in ``keep`` that are called as the results are replaced."""
    results = ("text_probability", "meta_probability", "quality_probability")
    keep = [c for c in keep if c not in (*results, "accepted")]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    schema = docs.select(*kept).schema
    views = view_columns(docs, text_col)
    # a text that is kept goes to the workers once, and is the view's text, too
    once = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == StringType() else None
    given = docs.select(*kept, *(views if once is None else views[1:]))
    for c in results:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = worker_cache("hasher", Hasher)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.columns[: len(keep)]
                texts = part.column(len(keep) if once is None else once)
                found = list(batch_views([texts, *part.columns[-3:]], hasher))
                p = model.probabilities(np.stack([f[1] for f in found]), np.stack([f[2] for f in found]))
                yield pa.RecordBatch.from_arrays(own + [pa.array(p[:, k]) for k in range(3)], part.schema.names[: len(keep)] + list(results))

    scored = given.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
    return scored.withColumn("accepted", F.col("quality_probability") >= threshold)
