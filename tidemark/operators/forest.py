"""Isolation forest at any sample size.

Every random choice is drawn from the seed, the tree and the number of the node (the
root is 1, the children of i are 2i and 2i + 1), so it doesn't matter where and in
which order nodes are grown.  A forest of few sampled rows is grown tree by tree in
parallel tasks, kept as arrays and travels to the scoring tasks.  Beyond
``MAX_MODEL_ROWS`` sampled rows the same forest is grown level by level: least and
greatest values per node come from sums of per-task parts, the cuts of a level are
joined to the rows, and a node that has come down to ``LOCAL_ROWS`` rows is finished in
one task.  That forest stays a table of subtrees; scored rows go through the upper
cuts by joins and meet the subtree they fall into, dealt by count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import small_table
from tidemark.operators.neighbours import matrix, meet
from tidemark.operators.quantiles import quantile_value
from tidemark.operators.sampling import sample_exact, with_cuts
from tidemark.session import materialise

AUTO_SAMPLES = 256
MAX_TREES = 10_000
MAX_MODEL_ROWS = 4_000_000  # trees x rows per tree of a forest that travels to the tasks
LOCAL_ROWS = 50_000  # rows of a node that one task finishes
KEPT_ROWS = 200_000  # trees x rows per tree of a forest that is worth keeping for one use
TASK_VALUES = 48_000_000  # values of training and scored rows that a task can hold
BATCH_ROWS = 20_000_000  # sampled rows, and scored rows x trees, handled at once
ARRAYS = "feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
MASK = (1 << 64) - 1


def expected_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def drawn(seed: int, tree: int, node: int, i: int) -> float:
    """Uniform number in [0, 1) of a node; ``i`` tells its draws apart."""
    z = (seed * 0x9E3779B97F4A7C15 + tree * 0xC2B2AE3D27D4EB4F + node * 0x165667B19E3779F9 + i * 0xD1342543DE82EF95) & MASK
    for _ in range(2):
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        z ^= z >> 31
    return (z >> 11) / (1 << 53)


def tree_features(seed: int, tree: int, width: int, share: float) -> np.ndarray:
    """The features that a tree may cut, ascending."""
    return np.sort(np.random.default_rng([seed, tree]).choice(width, max(1, int(share * width)), replace=False))


def chosen_cut(seed: int, tree: int, node: int, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, float] | None:
    """Feature and value that part a node of these least and greatest values; None if
    all of its rows agree."""
    varied = features[high[features] > low[features]]
    if not len(varied):
        return None
    j = int(varied[int(drawn(seed, tree, node, 0) * len(varied))])
    return j, float(low[j] + drawn(seed, tree, node, 1) * (high[j] - low[j]))


def depth_of(node: int) -> int:
    return int(node).bit_length() - 1


def grow_tree(x: np.ndarray, copies: np.ndarray, features: np.ndarray, seed: int, tree_id: int, root: int, limit: int) -> dict[str, list]:
    """Random splits until a node is pure, single or at the depth limit."""
    tree: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "path")}

    def add() -> int:
        for column, blank in zip(tree.values(), (-1, 0.0, -1, -1, 0.0)):
            column.append(blank)
        return len(tree["path"]) - 1

    waiting = [(add(), root, np.arange(len(x)))]
    while waiting:
        at, node, rows = waiting.pop()
        depth, n = depth_of(node), int(copies[rows].sum())
        part = x[rows]
        found = chosen_cut(seed, tree_id, node, features, part.min(axis=0), part.max(axis=0)) if n > 1 and depth < limit else None
        if found is None:
            tree["path"][at] = float(depth + expected_path(n))
            continue
        tree["feature"][at], tree["cut"][at] = found
        goes_left = part[:, found[0]] <= found[1]
        for side, mask, child in (("left", goes_left, 2 * node), ("right", ~goes_left, 2 * node + 1)):
            tree[side][at] = place = add()
            waiting.append((place, child, rows[mask]))
    return tree


def path_lengths(x: np.ndarray, t: Mapping[str, np.ndarray]) -> np.ndarray:
    """Depth at which each row of ``x`` ends in a tree, with the expected rest."""
    node = np.zeros(len(x), dtype=np.int64)
    active = np.flatnonzero(t["feature"][node] >= 0)
    while len(active):
        at = node[active]
        goes_left = x[active, t["feature"][at]] <= t["cut"][at]
        node[active] = np.where(goes_left, t["left"][at], t["right"][at])
        active = active[t["feature"][node[active]] >= 0]
    return t["path"][node]


def arrays_of(row) -> dict[str, np.ndarray]:
    kinds = {"feature": np.int64, "cut": float, "left": np.int64, "right": np.int64, "path": float}
    return {k: np.asarray(row[k], dtype=t) for k, t in kinds.items()}


@dataclass(frozen=True)
class IsolationForest:
    trees: tuple[dict, ...]
    samples: int
    offset: float = 0.5

    def isolation(self, x: np.ndarray) -> np.ndarray:
        norm = float(expected_path(self.samples)) or 1.0
        depth = sum((path_lengths(x, t) for t in self.trees), np.zeros(len(x)))
        return np.power(2.0, -depth / (len(self.trees) * norm)) - self.offset

    def score(self, df: DataFrame, col: str = "features", out: str = "if_score") -> DataFrame:
        """Higher is more anomalous; zero is the model's own threshold."""
        return score_all(df, [self], col, "_if").withColumn(out, F.get("_if", F.lit(0))).drop("_if")


def score_many(df: DataFrame, forests: Sequence[IsolationForest | StoredForest], col: str = "features", out: str = "if_score") -> DataFrame:
    """One row per row of ``df`` and forest: its columns, ``model`` (place in ``forests``) and ``out``.

    Forests that differ in their threshold are run once; those that travel to the
    tasks share Arrow passes of at most ``MAX_MODEL_ROWS`` sampled rows."""
    raw = {id(f.trees): f for f in forests if isinstance(f, IsolationForest)}
    passes: list[list[int]] = [[]]
    for key, f in raw.items():
        if passes[-1] and sum(len(raw[k].trees) * raw[k].samples for k in passes[-1]) + len(f.trees) * f.samples > MAX_MODEL_ROWS:
            passes.append([])
        passes[-1].append(key)
    parts = []
    for keys in filter(None, passes):
        place = {key: i for i, key in enumerate(keys)}
        mine = [(n, place[id(f.trees)], f.offset) for n, f in enumerate(forests) if isinstance(f, IsolationForest) and id(f.trees) in place]
        scored = materialise(score_all(df, [replace(raw[k], offset=0.0) for k in keys], col, "_raw"))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), (F.get("_raw", F.lit(i)) - F.lit(float(o))).alias(out)) for n, i, o in mine]))
        parts.append(scored.withColumn("_each", each).select(*df.columns, "_each.*"))
    alike: dict[int, list[int]] = {}  # forests that differ in their threshold only
    for n, f in enumerate(forests):
        if isinstance(f, StoredForest):
            alike.setdefault(id(f.batches), []).append(n)
    for mine in alike.values():
        scored = materialise(replace(forests[mine[0]], offset=0.0).score(df, col, "_raw"))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), (F.col("_raw") - F.lit(float(forests[n].offset))).alias(out)) for n in mine]))
        parts.append(scored.withColumn("_each", each).select(*df.columns, "_each.*"))
    return reduce(DataFrame.unionByName, parts)


def score_all(df: DataFrame, forests: Sequence[IsolationForest], col: str, out: str) -> DataFrame:
    """``df`` with the scores of several forests as an array, in one Arrow pass."""

    @F.pandas_udf("array<double>")
    def isolation(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(batch.to_numpy()).astype(np.float64)
        return pd.Series(list(np.stack([f.isolation(x) for f in forests], axis=1)))

    return df.withColumn(out, isolation(F.col(col)))


@dataclass(frozen=True)
class StoredForest:
    """A forest that no task holds as a whole: per batch of trees their numbers, the cuts
    (tree, node, feature, cut) of each upper level, and the subtrees (key, arrays)."""

    batches: tuple[tuple[list[int], list[DataFrame], DataFrame], ...]
    count: int
    samples: int
    offset: float = 0.5

    def score(self, df: DataFrame, col: str = "features", out: str = "if_score") -> DataFrame:
        """As ``IsolationForest.score``."""
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
        given = rows.select(F.col("_row").alias("row"), F.col(col).cast("array<double>").alias("x"))
        step = max(1, BATCH_ROWS // max(1, rows.count()))
        depths = []
        for trees, levels, subtrees in self.batches:
            for at in range(0, len(trees), step):
                some = F.array(*[F.lit(t) for t in trees[at : at + step]])
                pairs = given.withColumn("tree", F.explode(some)).withColumn("node", F.lit(1).cast("long"))
                pairs = reduce(moved, levels, pairs)
                visits = pairs.select("row", F.col("x").alias("q"), node_key().alias("key"), "node")
                found = meet(visits, subtrees, "key", ended, "row long, depth double")
                depths.append(materialise(found.groupBy("row").agg(F.sum("depth").alias("depth"))))
        norm = float(expected_path(self.samples)) or 1.0
        whole = reduce(DataFrame.unionByName, depths).groupBy("row").agg(F.sum("depth").alias("depth"))
        value = F.pow(F.lit(2.0), -F.col("depth") / F.lit(self.count * norm)) - F.lit(self.offset)
        scores = whole.select("row", value.alias(out))
        return rows.join(scores, rows["_row"] == scores["row"], "left").drop("_row", "row")


def node_key():
    return F.concat_ws(":", "tree", "node")


def ended(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Depth of each visit in its subtree; a node that got no sampled rows is an end."""
    n = asked.num_rows
    if not n:
        depth = np.zeros(0)
    elif held.num_rows:
        depth = path_lengths(matrix(asked["q"], n), arrays_of(held.to_pylist()[0]))
    else:
        depth = np.array([float(depth_of(i)) for i in asked["node"].to_pylist()])
    return pa.table({"row": asked["row"], "depth": pa.array(depth, pa.float64())})


def moved(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (tree, node, x) of a cut node in the child they belong to."""
    known = pairs.join(cuts, ["tree", "node"], "left")
    child = F.col("node") * 2 + F.when(F.get("x", F.col("feature")) <= F.col("cut"), 0).otherwise(1)
    return known.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(child)).drop("feature", "cut")


def tree_samples(df: DataFrame, id_col: str, col: str, rows: int, trees: int, per_tree: int, seed: int) -> DataFrame:
    """(tree, _id, x): ``per_tree`` distinct rows of each tree, or all.

    One rule at every size: each row belongs to one tree; a tree takes its own rows in
    the order of a hash, then, if they are too few, the others in the order of their
    own hash.  Where every tree has enough of its own, the others aren't looked at."""
    base = df.select(F.col(id_col).cast("string").alias("_id"), F.col(col).alias("x"))
    whose = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(trees)).cast("int")
    pair = F.concat_ws(":", "tree", "_id")
    own = base.withColumn("tree", whose).withColumn("_pair", pair)
    first = sample_exact(own, "_pair", per_tree, ["tree"], seed, prefix=3).select("tree", "_id", "x")
    sizes = own.groupBy("tree").count()
    if sizes.where(F.col("count") >= per_tree).count() == trees:
        return first
    others = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(F.col("tree") != whose).withColumn("_pair", pair)
    missing = with_cuts(others, "_pair", [lambda size: F.greatest(F.lit(0), size - F.lit(rows - min(rows, per_tree)))], ["tree"], seed, prefix=3)
    return first.unionByName(missing.where(F.col("_key") <= F.col("cut_0")).select("tree", "_id", "x"))


def repeats(per_tree: int, rows: int, seed: int):
    """How often a row of a bootstrap sample is drawn, given that it is: a Poisson
    number of mean ``per_tree / rows`` above zero, from the hash of tree and row."""
    mean = per_tree / rows
    share, upto, out = mean / np.expm1(mean), 0.0, F.lit(1)
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("repeats"), "tree", "_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    for m in range(1, 16):
        upto += share
        share *= mean / (m + 1)
        out = out + (u >= F.lit(float(upto))).cast("int")
    return out


@dataclass(frozen=True)
class Sample:
    """How the rows of each tree are drawn."""

    trees: int
    per_tree: int
    bootstrap: bool

    def distinct(self, rows: int) -> int:
        """Distinct rows of a tree, of ``rows``."""
        return max(1, round(-rows * np.expm1(-self.per_tree / rows))) if self.bootstrap else self.per_tree

    def take(self, df: DataFrame, id_col: str, col: str, rows: int, seed: int) -> DataFrame:
        """``tree, x, copies``."""
        found = tree_samples(df, id_col, col, rows, self.trees, self.distinct(rows), seed)
        copies = repeats(self.per_tree, rows, seed) if self.bootstrap else F.lit(1)
        return found.select("tree", F.col("x").cast("array<double>").alias("x"), copies.alias("copies"))


def structures(df: DataFrame, col: str, settings: Sequence[Mapping]) -> tuple[int, int, dict, list]:
    """Rows and width of ``df``, the forests (sample, share of features) that ``settings`` need,
    numbered, and the one of each setting."""
    n = df.count()
    if n == 0:
        raise ValueError("No rows to fit on")
    width = len(df.select(col).first()[0])
    wanted, keys = {}, []
    for s in settings:
        trees, samples = s.get("trees", 300), s.get("max_samples", "auto")
        if not 0 < trees <= MAX_TREES:
            raise ValueError(f"1 to {MAX_TREES} trees are supported, not {trees}")
        per_tree = min(AUTO_SAMPLES, n) if samples == "auto" else max(1, int(samples * n)) if isinstance(samples, float) else min(int(samples), n)
        key = (Sample(trees, per_tree, bool(s.get("bootstrap", False))), float(s.get("max_features", 1.0)))
        wanted.setdefault(key, len(wanted))
        keys.append(key)
    return n, width, wanted, keys


def fit_isolation_forests(df: DataFrame, id_col: str, col: str, settings: Sequence[Mapping], seed: int = 42) -> list[IsolationForest | StoredForest]:
    """One forest for each of ``settings`` (trees, max_samples, max_features, bootstrap,
    contamination; see ``fit_isolation_forest``).  Settings that differ in the share of
    outliers only are one forest; all forests that fit into tasks are grown in one job."""
    n, width, wanted, keys = structures(df, col, settings)
    small = {k: i for k, i in wanted.items() if k[0].trees * k[0].per_tree <= MAX_MODEL_ROWS}
    forests = grow_small(df, id_col, col, small, n, width, seed) if small else {}
    for key in wanted:
        if key not in forests:
            forests[key] = grow_large(df, id_col, col, *key, n, width, seed)
    raw = {k: replace(f, offset=0.0) for k, f in forests.items()}
    out, scores = [], {}
    for s, key in zip(settings, keys):
        share, forest = s.get("contamination", "auto"), forests[key]
        if share != "auto":
            if key not in scores:
                scores[key] = materialise(raw[key].score(df.select(col), col).select("if_score"))
            forest = replace(forest, offset=quantile_value(scores[key], "if_score", 1.0 - float(share)))
        out.append(forest)
    return out


def forest_scores(train: DataFrame, df: DataFrame, id_col: str, col: str, settings: Sequence[Mapping], out: str = "score", seed: int = 42) -> DataFrame:
    """``score_many`` of the forests of ``settings`` fitted on ``train``.  Forests of more than
    ``KEPT_ROWS`` sampled rows are not kept: where tasks can hold the rows, these are scored as
    the trees grow."""
    from tidemark.operators.forest_scores import UNIT, depth_sums

    n, width, wanted, keys = structures(train, col, settings)
    large = [k for k in wanted if k[0].trees * k[0].per_tree > KEPT_ROWS]
    if not large or (n + max(n, df.count())) * width > TASK_VALUES:
        return score_many(df, fit_isolation_forests(train, id_col, col, settings, seed), col, out)
    value = lambda i: F.pow(F.lit(2.0), -F.col(f"d{i}") / F.lit(UNIT * large[i][0].trees * (float(expected_path(large[i][0].per_tree)) or 1.0)))
    rows = materialise(df.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.select("row", F.col(col).alias("x"))
    if any(s.get("contamination", "auto") != "auto" for s, key in zip(settings, keys) if key in large):  # their own scores too, below 0
        asked = asked.unionAll(train.select((-1 - F.monotonically_increasing_id()).alias("row"), F.col(col).alias("x")))
    base = train.select(F.col(id_col).cast("string").alias("row"), F.col(col).alias("x"))
    sums = depth_sums(base, asked, large, n, width, seed)
    scores = materialise(sums.select("row", *[value(i).alias(f"s{i}") for i in range(len(large))]))
    own = scores.where("row < 0")
    each, offsets = [], {}
    for model, (s, key) in enumerate(zip(settings, keys)):
        if key not in large:
            continue
        i, share = large.index(key), s.get("contamination", "auto")
        if (i, share) not in offsets:
            offsets[i, share] = 0.5 if share == "auto" else quantile_value(own, f"s{i}", 1.0 - float(share))
        each.append(F.struct(F.lit(model).alias("model"), (F.col(f"s{i}") - F.lit(float(offsets[i, share]))).alias(out)))
    parts = [rows.join(scores, "row").withColumn("_each", F.explode(F.array(*each))).select(*df.columns, "_each.*")]
    small = [(model, s) for model, (s, key) in enumerate(zip(settings, keys)) if key not in large]
    if small:
        found = score_many(df, fit_isolation_forests(train, id_col, col, [s for _, s in small], seed), col, out)
        number = F.element_at(F.array(*[F.lit(m) for m, _ in small]), F.col("model") + 1)
        parts.append(found.withColumn("model", number))
    return reduce(DataFrame.unionByName, parts)


def grow_small(df: DataFrame, id_col: str, col: str, wanted: Mapping[tuple, int], n: int, width: int, seed: int) -> dict:
    """Forests of which each tree's sample fits in a task."""
    drawn_samples = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in wanted))}
    parts = [s.take(df, id_col, col, n, seed).withColumn("sample", F.lit(i)) for s, i in drawn_samples.items()]
    by_number = {i: (s, [(f, number) for (t, f), number in wanted.items() if t == s]) for s, i in drawn_samples.items()}

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sample, tree = int(key[0]), int(key[1])
        s, shares = by_number[sample]
        x, copies = np.stack(group["x"].to_numpy()).astype(np.float64), group["copies"].to_numpy()
        limit = int(np.ceil(np.log2(max(s.per_tree, 2))))
        grown = [(number, tree, grow_tree(x, copies, tree_features(seed, tree, width, share), seed, tree, 1, limit)) for share, number in shares]
        return pd.DataFrame([{"forest": number, "tree": t, **arrays} for number, t, arrays in grown])

    grown = reduce(DataFrame.unionByName, parts).groupBy("sample", "tree").applyInPandas(grow, f"forest int, tree int, {ARRAYS}").orderBy("forest", "tree").toArrow()
    owner = grown["forest"].to_numpy()
    columns = {c: grown[c].combine_chunks() for c in ("feature", "cut", "left", "right", "path")}
    tree = lambda i: arrays_of({c: a[i].values.to_numpy() for c, a in columns.items()})
    return {key: IsolationForest(tuple(tree(int(i)) for i in np.flatnonzero(owner == number)), key[0].per_tree) for key, number in wanted.items()}


def partial_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tree, node, low, high``: least and greatest values of the rows of a task."""
    seen: dict[tuple[int, int], list[np.ndarray]] = {}

    def told() -> pa.RecordBatch:
        keys = list(seen)
        cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64())]
        cols += [pa.array([seen[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(cols, names=["tree", "node", "low", "high"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        order = np.lexsort((node, tree))
        starts = np.flatnonzero(np.append(True, (np.diff(tree[order]) != 0) | (np.diff(node[order]) != 0)))
        low, high = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)
        for t, i, a, b in zip(tree[order][starts].tolist(), node[order][starts].tolist(), low, high):
            held = seen.get((t, i))
            seen[t, i] = [a, b] if held is None else [np.minimum(held[0], a), np.maximum(held[1], b)]
        if len(seen) > 10_000:
            yield told()
            seen.clear()
    if seen:
        yield told()


def grow_large(df: DataFrame, id_col: str, col: str, sample: Sample, share: float, n: int, width: int, seed: int) -> StoredForest:
    """A forest grown level by level, in batches of trees; see the module's docstring."""
    limit = int(np.ceil(np.log2(max(sample.per_tree, 2))))
    step = max(1, BATCH_ROWS // sample.per_tree)
    drawn_rows = sample.take(df, id_col, col, n, seed)
    batches = []

    def cuts_of(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for tree, node, ranges in zip(pdf["tree"], pdf["node"], pdf["ranges"]):
                low, high = np.zeros(width), np.zeros(width)
                for r in ranges:
                    low[r["feature"]], high[r["feature"]] = r["low"], r["high"]
                found = chosen_cut(seed, int(tree), int(node), tree_features(seed, int(tree), width, share), low, high)
                if found is not None:
                    out.append((tree, node, *found))
            yield pd.DataFrame(out, columns=["tree", "node", "feature", "cut"])

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(key[0]), int(key[1])
        x, copies = np.stack(group["x"].to_numpy()).astype(np.float64), group["copies"].to_numpy()
        return pd.DataFrame([{"key": f"{tree}:{node}", **grow_tree(x, copies, tree_features(seed, tree, width, share), seed, tree, node, limit)}])

    for at in range(0, sample.trees, step):
        trees = list(range(at, min(sample.trees, at + step)))
        base = materialise(drawn_rows.where(F.col("tree").between(trees[0], trees[-1])).withColumn("node", F.lit(1).cast("long")))
        rows, levels, ends = base, [], []
        for level in range(limit + 1):
            here = rows.where(F.col("node") >= F.lit(1 << level))
            sizes = materialise(here.groupBy("tree", "node").agg(F.sum("copies").cast("long").alias("n"), F.count("*").alias("rows")).where(F.col("rows") > LOCAL_ROWS))
            if sizes.isEmpty():
                break
            cuts = None
            if level < limit:
                wide = here.join(small_table(sizes.select("tree", "node")), ["tree", "node"], "semi").select("tree", "node", "x")
                parts = wide.mapInArrow(partial_ranges, "tree int, node long, low array<double>, high array<double>")
                each = parts.select("tree", "node", F.posexplode(F.arrays_zip("low", "high")).alias("feature", "r"))
                each = each.groupBy("tree", "node", "feature").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
                whole = each.groupBy("tree", "node").agg(F.collect_list(F.struct("feature", "low", "high")).alias("ranges"))  # one entry a feature
                cuts = materialise(whole.mapInPandas(cuts_of, "tree int, node long, feature int, cut double"))
                rows = moved(rows, small_table(cuts))
                levels.append(small_table(cuts))
            stuck = sizes if cuts is None else sizes.join(cuts, ["tree", "node"], "anti")
            ends.append(stuck.select("tree", "node", "n"))
        closed = small_table(materialise(reduce(DataFrame.unionByName, ends))) if ends else None
        open_ = rows if closed is None else rows.join(closed, ["tree", "node"], "anti")
        subtrees = open_.groupBy("tree", "node").applyInPandas(finish, f"key string, {ARRAYS}")
        if closed is not None:  # many rows that no cut parts: one leaf
            leaf = F.length(F.bin("node")) - 1
            path = leaf + expected_path_column(F.col("n"))
            one = lambda v, t: F.array(F.lit(v)).cast(f"array<{t}>")
            leaves = closed.select(node_key().alias("key"), one(-1, "int").alias("feature"), one(0.0, "double").alias("cut"), one(-1, "int").alias("left"), one(-1, "int").alias("right"), F.array(path).alias("path"))
            subtrees = subtrees.unionByName(leaves)
        batches.append((trees, levels, materialise(subtrees)))
    return StoredForest(tuple(batches), sample.trees, sample.per_tree)


def expected_path_column(n):
    """``expected_path`` of a count above two."""
    return 2.0 * (F.log(n - 1.0) + F.lit(float(np.euler_gamma))) - 2.0 * (n - 1.0) / n


def fit_isolation_forest(
    df: DataFrame,
    id_col: str,
    col: str = "features",
    trees: int = 300,
    max_samples: str | int | float = "auto",
    max_features: float = 1.0,
    bootstrap: bool = False,
    contamination: str | float = "auto",
    seed: int = 42,
) -> IsolationForest | StoredForest:
    """Forest of ``trees`` trees on ``max_samples`` rows each (``auto``: 256; a share of the
    table; a number), cut along ``max_features`` of the features.  With ``bootstrap`` as
    many rows are drawn with replacement.  ``contamination`` is the share of outliers
    that sets the threshold; ``auto``: the score 0.5."""
    one = {"trees": trees, "max_samples": max_samples, "max_features": max_features, "bootstrap": bootstrap, "contamination": contamination}
    return fit_isolation_forests(df, id_col, col, [one], seed)[0]
