"""TF-IDF on word 1-3-grams and the linear SVM on top of it.

The vocabulary takes two passes.  The first keeps, in each task, a summary of the
heaviest n-grams (Misra-Gries, on 64-bit hashes in sorted arrays, so it is merged
batch by batch with a few array operations): a kept count is too low by at most the
task's stated error.  Summaries add up, and so do their errors; n-grams whose count
plus error reaches the last wanted count are the candidates.  The second pass counts
the candidates and their texts exactly.  The long tail of rare n-grams is never
shuffled.  With the vocabulary, weighting a text is a per-row JVM expression, and the
SVM is fitted by passes over the sparse rows whose sums meet per term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_accents
from tidemark.functions.vectors import total
from tidemark.operators.build import with_class_weight
from tidemark.operators.matrix import literal_array
from tidemark.operators.profile import WORD
from tidemark.session import materialise

SUMMARY = 500_000  # n-grams that a task's summary keeps between batches: 8 MB
MAX_SUMMARY = 4_000_000
CANDIDATES = 500_000  # hashes that travel to the tasks
CELLS = 500_000  # words, or entries of sparse rows, that a task works on at once


def with_words(df: DataFrame, text_col: str = "prompt", accents: bool = True) -> DataFrame:
    """Add ``_words``: lower-cased words of two characters or more."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    plain = strip_accents(text) if accents else text
    return df.withColumn("_words", F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)))


def with_terms(
    df: DataFrame, ngrams: tuple[int, int] = (1, 3), only: Sequence[str] | None = None
) -> DataFrame:
    """Replace ``_words`` by ``_terms``, their n-grams; with ``only``, the n-grams
    made of those words alone (a null word makes every n-gram with it null)."""
    out = df
    if only is not None:
        # as one SQL text: words hold no quotes, and a hash set tests them
        names = ",".join(f"'{w}'" for w in only)
        out = out.withColumn("_words", F.expr(f"transform(_words, w -> CASE WHEN w IN ({names}) THEN w END)"))
    out = out.withColumn("_g1", F.col("_words"))
    for n in range(2, ngrams[1] + 1):
        after = F.slice("_words", F.lit(n), F.greatest(F.size("_words"), F.lit(0)))
        out = out.withColumn(
            f"_g{n}", F.zip_with(f"_g{n - 1}", after, lambda a, b: F.concat(a, F.lit(" "), b))
        )
    sizes = range(ngrams[0], ngrams[1] + 1)
    terms = F.array_compact(F.concat(*[f"_g{n}" for n in sizes]))
    return out.withColumn("_terms", terms).drop("_words", *[f"_g{n}" for n in range(1, ngrams[1] + 1)])


def frequent_words(words: DataFrame, max_features: int) -> list[str] | None:
    """Words that terms of the vocabulary can consist of, or None for all.

    An n-gram is no more frequent than any of its words.  With at least
    ``max_features`` words in the corpus, the vocabulary's last count is at least
    that of the word at this rank, so rarer words occur in none of its terms.
    The long tail of rare n-grams is then never built nor shuffled."""
    counts = exploded(words, "_words").groupBy("term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("term")).limit(2 * max_features).collect()
    if len(top) < max_features:
        return None
    floor = top[max_features - 1]["n"]
    if len(top) == 2 * max_features and top[-1]["n"] == floor:
        return None  # too many ties at this count to list
    return [r["term"] for r in top if r["n"] >= floor]


def exploded(df: DataFrame, col: str) -> DataFrame:
    """One ``term`` per row.  The outer form keeps Spark from inferring a size
    filter, which would be pushed down and compute the array a second time."""
    return df.select(F.explode_outer(col).alias("term")).where(F.col("term").isNotNull())


def term_counts(terms: DataFrame) -> DataFrame:
    return exploded(terms, "_terms").groupBy("term").agg(F.count("*").alias("corpus_count"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def list_slices(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose lists, in the first column, hold about ``limit`` entries
    together; a row is never cut.  Working arrays are as large as a slice, whatever the
    size of a batch."""
    limit = limit or CELLS
    limits = batch.column(0).offsets.to_numpy()
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def hashed_ngrams(words: pa.ListArray, ngrams: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For each size n: n, the hashes of the n-grams of a batch of word lists, the place
    of their first word, and the words."""
    limits = words.offsets.to_numpy()
    flat = words.values.slice(limits[0], limits[-1] - limits[0])
    limits = limits - limits[0]
    coded = flat.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)) if len(flat) else np.zeros(0, np.uint64)
    first = known[coded.indices.to_numpy()] if len(flat) else known
    end = np.repeat(limits[1:], np.diff(limits))
    h = mixed(first)
    for n in range(1, ngrams[1] + 1):
        if n > 1:  # the words from each place on, by one more
            h = mixed(h[: max(0, len(first) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + first[n - 1 :] + np.uint64(n))
        if n >= ngrams[0]:
            place = np.flatnonzero(np.arange(len(h)) + n <= end[: len(h)])
            yield n, h[place], place, flat


def folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``counts`` per distinct key, keys ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def summary(words: DataFrame, ngrams: tuple[int, int], size: int) -> tuple[DataFrame, int]:
    """``hash, n``: merged summary of the n-grams of ``_words``, and its error: a true
    count lies between ``n`` and ``n`` + error, also that of an n-gram not listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, error = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in chain.from_iterable(map(list_slices, batches)):
            new = [h for _, h, _, _ in hashed_ngrams(batch.column(0), ngrams)]
            keys, counts = folded(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(sum(map(len, new)), np.int64)]))
            if len(keys) > 2 * size:
                cut = np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]  # the largest count beyond ``size``
                kept = counts > cut
                keys, counts, error = keys[kept], counts[kept] - cut, error + int(cut)
        if error:
            keys, counts = np.append(keys, np.uint64(0)), np.append(counts, -error)  # as a count below zero
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=["hash", "n"])

    parts = words.mapInArrow(run, "hash long, n long")
    merged = parts.groupBy("hash", (F.col("n") < 0).alias("_error")).agg(F.sum("n").alias("n"))
    merged = materialise(merged)
    error = merged.where("_error").agg(F.sum("n")).first()[0]
    return merged.where("NOT _error").select("hash", "n"), -int(error or 0)


def candidate_hashes(words: DataFrame, max_features: int, ngrams: tuple[int, int], size: int = SUMMARY) -> np.ndarray | None:
    """Hashes that hold all of the ``max_features`` most frequent n-grams, ties included;
    None if they are too many to list (then nothing stands out of the tail)."""
    while True:
        counts, error = summary(words, ngrams, size)
        top = counts.orderBy(F.desc("n")).limit(max_features).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
        least = top["n"] if top["k"] == max_features else 0
        if least > error or not error:
            found = counts.where(F.col("n") + error >= least)
            rows = found.limit(CANDIDATES + 1).toPandas()["hash"].to_numpy(np.int64)
            if len(rows) <= CANDIDATES:
                return np.sort(rows.view(np.uint64))
        if not error or size >= MAX_SUMMARY:
            return None
        size = min(4 * size, MAX_SUMMARY)


def candidate_counts(words: DataFrame, wanted: np.ndarray, ngrams: tuple[int, int]) -> DataFrame:
    """``term, corpus_count, docs``: exact counts of the n-grams whose hash is ``wanted``, and of
    the texts that hold them.  A task counts by hash and spells each n-gram once; tasks
    meet by the n-gram itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all, n_docs, term = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64), np.full(len(wanted), None, object)
        for batch in chain.from_iterable(map(list_slices, batches)):
            limits = batch.column(0).offsets.to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(limits))
            for n, h, place, flat in hashed_ngrams(batch.column(0), ngrams):
                at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, int)
                at, place = at[hit], place[hit]
                n_all += np.bincount(at, minlength=len(wanted))
                both = np.unique(at * np.int64(max(1, batch.num_rows)) + owner[place])
                n_docs += np.bincount(both // max(1, batch.num_rows), minlength=len(wanted))
                new, first = np.unique(at, return_index=True)
                lacks = np.array([t is None for t in term[new]], bool)
                for i, p in zip(new[lacks], place[first[lacks]]):
                    term[i] = " ".join(flat.slice(p, n).to_pylist())
        some = np.flatnonzero(n_all)
        yield pa.RecordBatch.from_arrays([pa.array(term[some].tolist(), pa.string()), pa.array(n_all[some]), pa.array(n_docs[some])], names=["term", "n", "d"])

    parts = words.mapInArrow(run, "term string, n long, d long")
    return parts.groupBy("term").agg(F.sum("n").alias("corpus_count"), F.sum("d").alias("docs"))


@dataclass(frozen=True)
class TfIdf:
    vocabulary: tuple[str, ...]
    idf: np.ndarray
    ngrams: tuple[int, int] = (1, 3)
    accents: bool = True

    def transform(self, df: DataFrame, text_col: str = "prompt", out: str = "tfidf") -> DataFrame:
        """Add ``out``: struct(indices, weights), L2-normalised, no shuffle."""
        terms = with_terms(with_words(df, text_col, self.accents), self.ngrams)
        counted = CountVectorizerModel.from_vocabulary(list(self.vocabulary), "_terms", "_tf").transform(terms)
        parts = counted.withColumn("_s", F.unwrap_udt("_tf")).withColumn("_idf", literal_array(self.idf))
        raw = F.zip_with(
            "_s.indices", "_s.values", lambda i, tf: (F.lit(1.0) + F.log(tf)) * F.get("_idf", i)
        )
        weighed = parts.withColumn("_w", raw).withColumn(
            "_norm", F.sqrt(total(F.transform("_w", lambda w: w * w)))
        )
        unit = F.transform("_w", lambda w: F.when(F.col("_norm") > 0, w / F.col("_norm")).otherwise(w))
        packed = F.struct(F.col("_s.indices").alias("indices"), unit.alias("weights"))
        return weighed.withColumn(out, packed).select(*df.columns, out)


def fit_tfidf(
    df: DataFrame,
    text_col: str = "prompt",
    max_features: int = 10_000,
    ngrams: tuple[int, int] = (1, 3),
    accents: bool = True,
) -> TfIdf:
    """Vocabulary: the most frequent terms of the corpus (ties by term).
    idf = ln((1 + rows) / (1 + rows with the term)) + 1."""
    words = with_words(df, text_col, accents).select("_words")
    rows = df.count()
    wanted = candidate_hashes(words, max_features, ngrams)
    if wanted is not None:
        counts = candidate_counts(words, wanted, ngrams)
        top = counts.orderBy(F.desc("corpus_count"), F.asc("term")).limit(max_features).collect()
        docs = {r["term"]: r["docs"] for r in top}
        vocabulary = sorted(docs)
    else:  # ties without end at the last place: count every n-gram
        only = frequent_words(words, max_features) if ngrams[0] == 1 and ngrams[1] > 1 else None
        terms = with_terms(words, ngrams, only)
        top = term_counts(terms).orderBy(F.desc("corpus_count"), F.asc("term")).limit(max_features)
        vocabulary = sorted(r["term"] for r in top.collect())
        counted = CountVectorizerModel.from_vocabulary(vocabulary, "_terms", "_tf").transform(terms)
        found = counted.select(Summarizer.metrics("numNonZeros").summary(F.col("_tf")).alias("s")).first()["s"]
        docs = dict(zip(vocabulary, found["numNonZeros"].toArray()))
    if not vocabulary:
        raise ValueError("No terms in the training texts")
    idf = np.log((1.0 + rows) / (1.0 + np.array([docs[t] for t in vocabulary], float))) + 1.0
    return TfIdf(tuple(vocabulary), idf, ngrams, accents)


def tfidf_terms(df: DataFrame, model: TfIdf, id_col: str, text_col: str = "prompt") -> DataFrame:
    """Long form: (id, term, weight)."""
    names = F.split(F.lit("\x1f".join(model.vocabulary)), "\x1f")
    rows = model.transform(df.select(id_col, text_col), text_col).select(
        id_col, F.explode_outer(F.arrays_zip("tfidf.indices", "tfidf.weights")).alias("e")
    ).where("e IS NOT NULL")
    return rows.withColumn("_v", names).select(
        id_col, F.get("_v", F.col("e.indices")).alias("term"), F.col("e.weights").alias("weight")
    )


@dataclass(frozen=True)
class TfIdfSvm:
    tfidf: TfIdf
    coefficients: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, text_col: str = "prompt") -> DataFrame:
        """Add ``score`` (margin) and ``pred`` (margin > 0)."""
        rows = self.tfidf.transform(df, text_col).withColumn("_c", literal_array(self.coefficients))
        products = F.zip_with("tfidf.indices", "tfidf.weights", lambda i, w: w * F.get("_c", i))
        scored = rows.withColumn("score", total(products) + F.lit(float(self.intercept)))
        return scored.withColumn("pred", (F.col("score") > 0).cast("int")).drop("tfidf", "_c")


def hinge_parts(rows: DataFrame, w: np.ndarray, direction: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """One pass over the sparse rows (indices, weights, y: +1 or -1, weight).

    Sum of weight * max(0, 1 - y m)^2 over the margins m of ``w`` and its gradient; with
    ``direction``, the second derivative along it instead (and the number of rows that
    count).  The last coefficient is the intercept.  A task adds up its rows; the
    tasks' sums meet per coefficient."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, out = 0.0, np.zeros(size)
        for batch in chain.from_iterable(map(list_slices, batches)):
            part = dict(zip(batch.schema.names, batch.columns))
            length = np.diff(part["indices"].offsets.to_numpy())
            at, x = part["indices"].flatten().to_numpy(), part["weights"].flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), length)
            y, c = part["y"].to_numpy(), part["weight"].to_numpy()
            slack = 1.0 - y * (np.bincount(row, w[at] * x, batch.num_rows) + w[-1])
            active = slack > 0
            if direction is None:
                value += float((c * np.where(active, slack, 0.0) ** 2).sum())
                pull = np.where(active, -2.0 * c * y * slack, 0.0)
            else:
                value += float(active.sum())
                along = np.bincount(row, direction[at] * x, batch.num_rows) + direction[-1]
                pull = np.where(active, 2.0 * c * along, 0.0)
            out[:-1] += np.bincount(at, pull[row] * x, size - 1)
            out[-1] += pull.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append(value, out))], names=["at", "value"])

    parts = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    sums = np.zeros(size + 1)
    for r in parts.collect():  # one row a coefficient
        sums[r["at"] + 1] = r["value"]
    return float(sums[0]), sums[1:]


def fit_squared_hinge(rows: DataFrame, size: int, cost: float = 1.0, tolerance: float = 1e-8, max_iter: int = 100) -> np.ndarray:
    """Weights and intercept that minimise |w|^2 / 2 + cost * sum of weight * squared hinge,
    the intercept being one more weight: a trust-region Newton method.

    ``rows`` (indices, weights, y, weight) should be stored.  Each step solves the Newton
    equation within the region by conjugate gradients; every product with the second
    derivative is one pass.  Ends when the gradient has fallen to ``tolerance`` of its
    first norm."""
    w = np.zeros(size + 1)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = hinge_parts(rows, w)
        return 0.5 * float(w @ w) + cost * value, w + cost * gradient

    f, g = at(w)
    start = radius = float(np.linalg.norm(g))
    for _ in range(max_iter):
        norm = float(np.linalg.norm(g))
        if norm <= tolerance * max(start, 1e-300):
            break
        # conjugate gradients for H s = -g inside the region
        s, r = np.zeros_like(w), -g
        d, rr = r.copy(), float(r @ r)
        curve = np.zeros_like(w)  # H s
        for _ in range(50):
            if np.sqrt(rr) <= min(0.1, np.sqrt(norm / start)) * norm:
                break
            hd = d + cost * hinge_parts(rows, w, d)[1]
            alpha = rr / float(d @ hd)
            if np.linalg.norm(s + alpha * d) >= radius:
                sd, dd, ss = float(s @ d), float(d @ d), float(s @ s)
                alpha = (-sd + np.sqrt(sd * sd + dd * (radius * radius - ss))) / dd
                s, curve = s + alpha * d, curve + alpha * hd
                break
            s, curve = s + alpha * d, curve + alpha * hd
            r = r - alpha * hd
            new = float(r @ r)
            d, rr = r + (new / rr) * d, new
        promised = -float(g @ s) - 0.5 * float(s @ curve)
        f_new, g_new = at(w + s)
        ratio = (f - f_new) / promised if promised > 0 else 0.0
        length = float(np.linalg.norm(s))
        radius = 0.25 * length if ratio < 0.25 else max(radius, 2.0 * length) if ratio > 0.75 else radius
        if ratio > 1e-4:
            w, f, g = w + s, f_new, g_new
        elif radius < 1e-12 * max(1.0, float(np.linalg.norm(w))):
            break  # at the precision of the sums
    return w


def fit_tfidf_svm(
    train: DataFrame, text_col: str = "prompt", max_features: int = 10_000,
    ngrams: tuple[int, int] = (1, 3), max_iter: int = 100, cost: float = 1.0,
    labels: Sequence[int] = (0, 1), tolerance: float = 1e-4,
) -> TfIdfSvm:
    """Linear SVM of squared hinge loss with balanced class weights on TF-IDF rows."""
    model = fit_tfidf(train, text_col, max_features, ngrams)
    weighted = with_class_weight(train.select(text_col, "label"), labels)
    rows = model.transform(weighted, text_col).select(
        "tfidf.indices", "tfidf.weights", F.when(F.col("label") == labels[1], 1.0).otherwise(-1.0).alias("y"), F.col("weight").cast("double")
    )
    w = fit_squared_hinge(materialise(rows), len(model.vocabulary), cost, tolerance, max_iter)
    return TfIdfSvm(model, w[:-1], float(w[-1]))
