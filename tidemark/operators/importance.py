"""Feature importance of a random forest whose trees are never held as a whole.

What Spark's forest does, for tables whose trees the driver could not hold: up to ``BINS``
quantile bins a feature, a Poisson bootstrap, the root of the features tried at each node,
Gini gain of weighted rows, nodes that stop when they are pure, gain nothing or are
``depth`` deep, and subtrees of one prediction taken together.  Rows are binned to a byte a
feature and sent to tasks as compressed blocks, once a task; a task grows its trees one
after another, level by level, and returns each tree's importances only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
PARTS = 4  # tasks for each core that the session has
BLOCK_ROWS = 100_000


def bin_ends(df: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """The greatest value of each bin but the last: all values of a feature with at most
    ``BINS``, else its approximate quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * len(cols)
        for batch in batches:
            seen = [s if len(s) > BINS else np.union1d(s, c.to_numpy(zero_copy_only=False))[: BINS + 1] for s, c in zip(seen, batch.columns)]
        rows = [(i, s.tolist()) for i, s in enumerate(seen) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.list_(pa.float64()))], ["feature", "some"])

    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    told = values.mapInArrow(few, "feature int, some array<double>").select("feature", F.explode("some").alias("v")).distinct()
    distinct = told.groupBy("feature").agg(F.slice(F.array_sort(F.collect_set("v")), 1, BINS + 1).alias("some"))  # BINS + 1 values a task at most
    known = {r["feature"]: np.array(r["some"]) for r in distinct.collect()}
    shares = [i / BINS for i in range(1, BINS)]
    cuts = values.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in cols], *[F.max(c).alias(f"_most_{c}") for c in cols]).first()
    out = []
    for i, c in enumerate(cols):
        ends = known[i] if len(known[i]) <= BINS else np.unique(cuts[c])
        out.append(ends[ends < cuts[f"_most_{c}"]])
    return out


def binned(df: DataFrame, cols: Sequence[str], label: str, ends: Sequence[np.ndarray]) -> DataFrame:
    """Blocks (task, place, n, rows) of binned rows, feature by feature, and their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = [np.searchsorted(e, c.to_numpy(zero_copy_only=False)).astype(np.uint8) for e, c in zip(ends, part.columns)]
                rows.append(part.columns[-1].to_numpy(zero_copy_only=False).astype(np.uint8))
                blob = pa.compress(np.stack(rows).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((task, pa.int32()), (place, pa.int32()), (part.num_rows, pa.int32()), (blob, pa.binary()))], ["task", "place", "n", "rows"])
                place += 1

    return df.select(*[F.col(c).cast("double").alias(c) for c in cols], label).mapInArrow(run, "task int, place int, n int, rows binary")


def gini(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    share = one / (zero + one)
    return 2.0 * share * (1.0 - share)


def best_splits(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, drawn: np.ndarray, one: np.ndarray, feats: np.ndarray, weights: Sequence[float]):
    """(gain, feature, bin) of the best split of each node, whose rows are ``rows`` (``node``
    ascends): of its features ``feats`` in order, the first bin of most gain; 0 if none gains.
    ``drawn`` is how often a row counts, ``one`` whether its label is 1."""
    m = len(feats)
    ones, every = (np.bincount(node, v, m) for v in (drawn * one, drawn))
    zeros = every - ones
    whole = gini(zeros * weights[0], ones * weights[1])
    best, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
    head = (one << 16) | drawn
    for slot in feats.T:
        packed = np.sort(((node * BINS + bins[slot[node], rows]) << 17) | head)
        key = packed >> 17
        last = np.append(key[1:] != key[:-1], True)
        count = packed & 0xFFFF
        left, left_one = np.cumsum(count)[last], np.cumsum(count * ((packed >> 16) & 1))[last]
        key = key[last]
        at = key // BINS
        before = np.append(0, np.cumsum(every)[:-1])[at], np.append(0, np.cumsum(ones)[:-1])[at]
        left, left_one = left - before[0], left_one - before[1]
        parts = left < every[at]  # not the node's last bin
        key, at, left, left_one = (v[parts] for v in (key, at, left, left_one))
        if not len(key):
            continue
        l0, l1 = (left - left_one) * weights[0], left_one * weights[1]
        r0, r1 = (zeros[at] - left + left_one) * weights[0], (ones[at] - left_one) * weights[1]
        total = l0 + l1 + r0 + r1
        gain = whole[at] - (l0 + l1) / total * gini(l0, l1) - (r0 + r1) / total * gini(r0, r1)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        most = np.maximum.reduceat(gain, starts)
        where = np.minimum.reduceat(np.where(gain == np.repeat(most, np.diff(np.append(starts, len(at)))), np.arange(len(at)), len(at)), starts)
        own = at[starts]
        better = most > best[own] + 1e-15
        own, where = own[better], where[better]
        best[own], feature[own], cut[own] = most[better], slot[own], key[where] % BINS
    return best, feature, cut


def tried_features(rng: np.random.Generator, m: int, width: int, tried: int) -> np.ndarray:
    """``tried`` of ``width`` features for each of ``m`` nodes, in a reservoir's order, which
    decides between features of equal gain."""
    out = np.tile(np.arange(tried), (m, 1))
    for i in range(tried, width):
        place = rng.integers(0, i + 1, m)
        taken = np.flatnonzero(place < tried)
        out[taken, place[taken]] = i
    return out


def tree_importance(bins: np.ndarray, one: np.ndarray, weights: Sequence[float], rng: np.random.Generator, depth: int, tried: int) -> np.ndarray:
    """The importances, of sum 1, of one tree on a bootstrap of rows: ``bins`` (features x rows)
    and whether a label is 1; all 0 if the root isn't split."""
    width = len(bins)
    drawn = np.minimum(rng.poisson(1.0, bins.shape[1]), 0xFFFF)
    rows = np.flatnonzero(drawn)
    drawn, one = drawn[rows], one[rows].astype(np.int64)
    node = np.zeros(len(rows), np.int64)
    levels = []  # of each level: gains of its nodes, features, their predictions, and those of leaves: -1, -1
    for _ in range(depth + 1):
        m = int(node[-1]) + 1 if len(node) else 0
        if not m:
            break
        ones, every = (np.bincount(node, v, m) for v in (drawn * one, drawn))
        zeros, told = (every - ones) * weights[0], ones * weights[1]
        gain, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        mixed = (zeros > 0) & (told > 0) if len(levels) < depth else np.zeros(m, bool)
        held = mixed[node]
        rows, drawn, one, node = (v[held] for v in (rows, drawn, one, node))
        if len(node):
            number = np.cumsum(mixed) - 1
            feats = tried_features(rng, int(mixed.sum()), width, tried)
            gain[mixed], feature[mixed], cut[mixed] = best_splits(bins, rows, number[node], drawn, one, feats, weights)
            held = feature[node] >= 0
            rows, drawn, one, node = (v[held] for v in (rows, drawn, one, node))
            inner = np.cumsum(feature >= 0) - 1  # an inner node's children are 2 i and 2 i + 1 of the next level
            node = 2 * inner[node] + (bins[feature[node], rows] > cut[node])
            order = np.argsort(node, kind="stable")
            rows, drawn, one, node = (v[order] for v in (rows, drawn, one, node))
        levels.append((gain * (zeros + told), feature, told > zeros))
    out = np.zeros(width)
    below = None  # of the level below: whether a node is a leaf now, and its prediction
    for gain, feature, says in reversed(levels):
        leaf, inner = feature < 0, np.flatnonzero(feature >= 0)
        if len(inner):
            low, high = (below[0][i::2] for i in (0, 1))
            leaf[inner] = low & high & (below[1][::2] == below[1][1::2])
            says = says.copy()
            says[inner] = np.where(leaf[inner], below[1][::2], says[inner])
            np.add.at(out, feature[~leaf], gain[~leaf])
        below = leaf, says
    return out / out.sum() if out.sum() > 0 else out


def forest_importance(df: DataFrame, cols: Sequence[str], label: str, weights: Sequence[float], trees: int, seed: int, depth: int) -> np.ndarray:
    """Mean importances of ``trees`` trees on the rows of ``df``, labelled 0 or 1 and without
    nulls.  A task holds all rows, a byte a feature."""
    parts = max(1, min(trees, PARTS * df.sparkSession.sparkContext.defaultParallelism))
    width, tried = len(cols), int(np.ceil(np.sqrt(len(cols))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for n, rows in zip(batch.column(1).to_pylist(), batch.column(2)):
                blocks.append(np.frombuffer(pa.decompress(rows.as_buffer(), n * (width + 1), codec="zstd", asbytes=True), np.uint8).reshape(width + 1, n))
        if part is None:
            return
        data = np.concatenate(blocks, axis=1)
        blocks.clear()
        for tree in range(part, trees, parts):
            found = tree_importance(data[:-1], data[-1], weights, np.random.default_rng([seed, tree]), depth, tried)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([found.tolist()], pa.list_(pa.float64()))], ["tree", "found"])

    blocks = binned(df, cols, label, bin_ends(df, cols))
    sent = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, "part")
    sent = sent.sortWithinPartitions("task", "place").select("part", "n", "rows")
    found = sorted((r["tree"], r["found"]) for r in sent.mapInArrow(run, "tree int, found array<double>").collect())
    total = np.sum([f for _, f in found], axis=0)
    return total / total.sum() if total.sum() > 0 else total
