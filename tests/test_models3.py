"""Trees that are grown in tasks and never held as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest, forest_scores, importance, matrix


def brute_tree(bins, one, drawn, weights, pick, depth, level=0):
    """(importances, prediction, whether a leaf) of the node of all rows given, node by node."""
    out, n = np.zeros(len(bins)), [(drawn * (one == k)).sum() * weights[k] for k in (0, 1)]
    gini = lambda v: 1 - sum((x / sum(v)) ** 2 for x in v)
    best = (1e-15, None, None)
    if min(n) > 0 and level < depth:
        for f in pick:
            for cut in np.unique(bins[f])[:-1]:
                sides = [[(drawn * (one == k) * side).sum() * weights[k] for k in (0, 1)] for side in (bins[f] <= cut, bins[f] > cut)]
                gain = gini(n) - sum(sum(s) / sum(n) * gini(s) for s in sides)
                if gain > best[0] + 1e-12:
                    best = gain, f, cut
    if best[1] is None:
        return out, n[1] > n[0], True
    gain, f, cut = best
    parts = [brute_tree(bins[:, side], one[side], drawn[side], weights, pick, depth, level + 1) for side in (bins[f] <= cut, bins[f] > cut)]
    if parts[0][2] and parts[1][2] and parts[0][1] == parts[1][1]:
        return out, parts[0][1], True
    out[f] = gain * sum(n)
    return out + parts[0][0] + parts[1][0], None, False


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_a_tree_equals_brute_force(depth):
    rng = np.random.default_rng(depth)
    bins = rng.integers(0, 9, (3, 300)).astype(np.uint8)
    one = ((bins[0] > 4) ^ (rng.random(300) < 0.25)).astype(np.uint8)
    got = importance.tree_importance(bins, one, (0.7, 1.4), np.random.default_rng(8), depth, 3)
    drawn = np.random.default_rng(8).poisson(1.0, 300)
    kept = drawn > 0
    want = brute_tree(bins[:, kept], one[kept], drawn[kept], (0.7, 1.4), range(3), depth)[0]
    assert want.sum() > 0 and np.allclose(got, want / want.sum())


def test_forests_of_both_kinds_agree(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 3).selectExpr("double(id % 17) AS a", "rand(1) AS b", "rand(2) AS c", "int(id % 17 > 8 OR rand(3) > 0.9) AS label")
    df = df.withColumn("same", F.col("a")).withColumn("flat", F.lit(2.0))
    cols = ["a", "b", "c", "same", "flat"]
    told = lambda: {r["feature"]: r["importance"] for r in matrix.rf_importance(df, cols, trees=60).collect()}
    ours = told() if monkeypatch.setattr(matrix, "FOREST_ROWS", 0) is None else {}
    monkeypatch.setattr(matrix, "FOREST_ROWS", 10**9)
    theirs = told()
    assert sum(ours.values()) == pytest.approx(1.0) and all(abs(ours[c] - theirs[c]) < 0.05 for c in cols) and ours["flat"] == 0


def test_trees_of_large_tables_stay_out_of_the_driver(spark, monkeypatch):
    """The driver fits no forest there; tasks return one row a tree, however they are dealt."""
    monkeypatch.setattr(matrix, "FOREST_ROWS", 100)
    monkeypatch.setattr(matrix, "RandomForestClassifier", None)
    df = spark.createDataFrame([(i % 2, float(i % 7), float(i % 2)) for i in range(140)], "label int, a double, b double")
    one = matrix.rf_importance(df, ["a", "b"], trees=7).collect()
    monkeypatch.setattr(importance, "PARTS", 100)
    assert one[0]["feature"] == "b" and matrix.rf_importance(df, ["a", "b"], trees=7).collect() == one
    with pytest.raises(ValueError):
        matrix.rf_importance(df.withColumn("a", F.when(F.col("a") > 1, F.col("a"))), ["a", "b"], trees=2)


def test_hashes_go_on_as_in_spark(spark):
    ids = [None, "", "é", *["abcdefghij"[: n % 10] * 1 + "x" * n for n in range(70)], "-12", "4294967296"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, v string").select("i", F.xxhash64(F.lit(7), F.lit("t")).alias("b"), F.xxhash64(F.lit(7), F.lit("t"), "v").alias("h"))
    rows = sorted(df.collect())
    got = forest_scores.Hashes([None if v is None else v.encode() for v in ids]).after(rows[0]["b"]).view(np.int64)
    assert got.tolist() == [r["h"] for r in rows]


def test_scores_of_forests_that_are_not_kept(spark, monkeypatch):
    """The same as of forests that are: samples of a share or a number, with repeats, equal rows
    and features that don't vary; and no forest is grown for them."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 5)), 2)
    x[:, 3], x[50:90] = 1.0, x[50]
    x[100:200, :2] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    train, val = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    keys = ("trees", "max_samples", "max_features", "bootstrap", "contamination")
    settings = [dict(zip(keys, v)) for v in [(9, 0.8, 0.8, False, "auto"), (14, 0.8, 1.0, True, 0.03), (9, 20, 1.0, False, "auto")]]
    want = forest.score_many(val, forest.fit_isolation_forests(train, "id", "x", settings), "x", "score")
    told = lambda df: {(r["id"], r["model"]): r["score"] for r in df.collect()}
    want, grown = told(want), []
    small = forest.grow_small
    monkeypatch.setattr(forest, "KEPT_ROWS", 200)
    monkeypatch.setattr(forest, "grow_small", lambda *a: grown.append(a[3]) or small(*a))
    monkeypatch.setattr(forest, "grow_large", None)
    got = told(forest.forest_scores(train, val, "id", "x", settings))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert [s.per_tree for s, _ in grown[0]] == [20] and len(grown) == 1
