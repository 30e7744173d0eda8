"""Neighbour search, forests, vocabulary and SVM by their large-table paths."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, forest, neighbours, tfidf


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def clustered(n, seed=1, centres=60, d=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, d))[rng.integers(0, centres, n)] * 20 + rng.normal(size=(n, d))


def brute_nearest(x, asked, k, p, itself):
    out = {}
    for i, q in enumerate(asked):
        diff = np.abs(x - q)
        d = diff.sum(1) if p == 1 else np.sqrt((diff**2).sum(1))
        if itself:
            d[i] = np.inf
        out[i] = np.sort(d)[:k]
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_search_through_several_levels(spark, monkeypatch, p):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "VISITORS", 100)
    x = clustered(900)
    x[100:300] = x[3]  # many copies of one row
    rows = points(spark, x)
    tree = neighbours.blocks(rows, p, 2)
    assert tree.depth > 1 and tree.reach.agg(F.sum("n")).first()[0] == 900
    found = collections.defaultdict(list)
    for r in tree.search(rows.select(F.col("id").alias("row"), "x"), 2, True).collect():
        found[r["row"]].append(r["distance"])
    want = brute_nearest(x, x, 2, p, True)
    assert all(sorted(found[i]) == pytest.approx(list(want[i])) for i in want)
    new = clustered(40, seed=9)
    found = collections.defaultdict(list)
    for r in tree.search(points(spark, new).withColumnRenamed("id", "row"), 2, False).collect():
        found[r["row"]].append(r["distance"])
    want = brute_nearest(x, new, 2, p, False)
    assert all(sorted(found[i]) == pytest.approx(list(want[i])) for i in want)


def test_search_groups_and_plan(spark, monkeypatch):
    """Equi-joins only, and no group above the stated sizes but for the spread of a hash."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "VISITORS", 100)
    seen = []

    def spied(visits, members, key, fn, schema, plain=neighbours.meet):
        parts = F.ceil(F.count("*") / neighbours.VISITORS)
        visits = visits.cache()
        sizes = visits.join(visits.groupBy(key).agg(parts.alias("parts")), key)
        sizes = sizes.groupBy(key, F.pmod(F.xxhash64("row"), F.col("parts"))).count()
        seen.append((sizes.agg(F.max("count")).first()[0] or 0, members.groupBy(key).count().agg(F.max("count")).first()[0] or 0))
        return plain(visits, members, key, fn, schema)

    monkeypatch.setattr(neighbours, "meet", spied)
    x = clustered(1000, centres=3)
    x[:400] = x[0]
    rows = points(spark, x)
    out = neighbours.blocks(rows, 2, 1).search(rows.select(F.col("id").alias("row"), "x"), 1, True)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 1000 and len(seen) > 4
    assert max(v for v, _ in seen) < 160 and max(m for _, m in seen) < 2 * 64


def test_search_work_grows_slower_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 128)
    work = []
    for n in (500, 2000, 8000):
        rows = points(spark, clustered(n, centres=200, d=3))
        tree = neighbours.blocks(rows, 2, 5)
        met = tree.visits(rows.select(F.col("id").alias("row"), "x"), 5, True).join(tree.reach, "block")
        work.append(met.agg(F.sum("n")).first()[0])
    assert work[1] < 8 * work[0] and work[2] < 8 * work[1]  # 16 if every pair were compared


def test_novelty_equals_brute_force_for_both_metrics(spark):
    x, new = clustered(150, centres=5), np.vstack([clustered(20, seed=5, centres=5), np.full((1, 4), 200.0)])
    for p in (1, 2):
        model, _ = neighbours.fit_lof(points(spark, x), "id", "x", k=8, p=p)
        got = [r["s"] for r in model.score(points(spark, new), "x", "s").orderBy("id").collect()]
        dist = lambda a, b: np.abs(a[:, None] - b[None]).sum(2) if p == 1 else np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))  # noqa: B023, E731
        own = dist(x, x)
        np.fill_diagonal(own, np.inf)
        near = np.argsort(own, axis=1, kind="stable")[:, :8]
        far = np.take_along_axis(own, near, 1)
        density = 1 / (np.maximum(far, far[:, -1][near]).mean(1) + 1e-10)
        d = dist(new, x)
        nn = np.argsort(d, axis=1, kind="stable")[:, :8]
        reach = np.maximum(np.take_along_axis(d, nn, 1), far[:, -1][nn]).mean(1)
        assert got == pytest.approx(list(density[nn].mean(1) * (reach + 1e-10) - 1.5))


# --- forests


@pytest.mark.parametrize("samples, bootstrap", [(0.8, False), (200, True)])
def test_level_by_level_forest_equals_the_local_one(spark, monkeypatch, samples, bootstrap):
    x = clustered(600, centres=6, d=5)
    x[:250] = x[0]  # rows that no cut parts
    x[:, 4] = 1.0  # a feature without values to cut
    df = points(spark, x).repartition(5)
    args = {"trees": 7, "max_samples": samples, "bootstrap": bootstrap, "max_features": 0.8}
    local = forest.fit_isolation_forest(df, "id", "x", **args)
    monkeypatch.setattr(forest, "MAX_MODEL_ROWS", 10)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 40)
    monkeypatch.setattr(forest, "BATCH_ROWS", 4 * local.samples)
    stored = forest.fit_isolation_forest(df, "id", "x", **args)
    assert isinstance(stored, forest.StoredForest) and len(stored.batches) == 2 and all(levels for _, levels, _ in stored.batches)
    more = points(spark, np.vstack([x, clustered(50, seed=4, centres=9, d=5)]))
    scores = [[r["if_score"] for r in m.score(more, "x").orderBy("id").collect()] for m in (local, stored)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-12) and len(set(scores[0])) > 100


def test_one_sampling_rule_at_every_size(spark):
    """A tree's rows are its own first, then others: with fewer trees than rows allow, and with more."""
    df = spark.range(500).select("id", F.array(F.rand(1)).alias("features"))
    for trees, per_tree in ((4, 50), (20, 100), (3, 900)):
        picked = collections.defaultdict(set)
        for r in forest.tree_samples(df, "id", "features", 500, trees, per_tree, 42).collect():
            assert r["_id"] not in picked[r["tree"]]
            picked[r["tree"]].add(r["_id"])
        assert {t: len(v) for t, v in picked.items()} == {t: min(500, per_tree) for t in range(trees)}
        owners = {r["i"]: r["t"] for r in df.select(F.col("id").cast("string").alias("i"), F.pmod(F.xxhash64(F.lit(42), F.col("id").cast("string")), F.lit(trees)).alias("t")).collect()}
        for t, ids in picked.items():
            own = {i for i, o in owners.items() if o == t}
            assert ids <= own or own <= ids


def test_bootstrap_draws_as_many_rows(spark):
    df = spark.range(3000).select("id", F.array(F.rand(1)).alias("x"))
    s = forest.Sample(3, 2400, True).take(df, "id", "x", 3000, 7).groupBy("tree").agg(F.sum("copies").alias("n"), F.max("copies").alias("m")).collect()
    assert len(s) == 3 and all(abs(r["n"] - 2400) < 150 and 3 <= r["m"] < 12 for r in s)


def test_forests_of_a_grid_share_their_work(spark):
    df = points(spark, clustered(300, centres=4))
    settings = [{"trees": 6, "max_samples": m, "max_features": f, "contamination": c} for m in ("auto", 0.5) for f, c in ((0.8, "auto"), (1.0, 0.1))]
    many = forest.fit_isolation_forests(df, "id", "x", settings)
    for s, model in zip(settings, many):
        one = forest.fit_isolation_forest(df, "id", "x", **s)
        assert one.offset == model.offset and all((a["cut"] == b["cut"]).all() for a, b in zip(one.trees, model.trees))


# --- vocabulary and SVM


def corpus(spark, n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)] + ["", "a b", "twice twice twice"]
    return spark.createDataFrame([(t,) for t in texts], "prompt string"), texts


def exact_counts(texts):
    total, docs = collections.Counter(), collections.Counter()
    for t in texts:
        w = [x for x in t.split() if len(x) > 1]
        grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        total.update(grams)
        docs.update(set(grams))
    return total, docs


@pytest.mark.parametrize("summary", [120, 500_000])
def test_vocabulary_from_summaries_is_exact(spark, monkeypatch, summary):
    df, texts = corpus(spark)
    total, docs = exact_counts(texts)
    monkeypatch.setattr(tfidf, "SUMMARY", summary)
    words = tfidf.with_words(df).select("_words").repartition(4)
    for k in (20, 5000):
        want = sorted(total, key=lambda t: (-total[t], t))[:k]
        model = tfidf.fit_tfidf(df, max_features=k)
        assert list(model.vocabulary) == sorted(want)
        assert model.idf == pytest.approx([np.log((1 + len(texts)) / (1 + docs[t])) + 1 for t in sorted(want)])
    counts, error = tfidf.summary(words, (1, 3), summary)
    assert error == 0 or summary == 120
    kept = {r["hash"]: r["n"] for r in counts.collect()}
    assert sum(total.values()) >= sum(kept.values()) and error <= sum(total.values()) / summary + 4


def test_ties_at_the_last_place_go_by_term(spark, monkeypatch):
    texts = [f"bb{i:03d} aa{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string")
    total, _ = exact_counts(texts)
    want = sorted(sorted(total, key=lambda t: (-total[t], t))[:50])
    assert list(tfidf.fit_tfidf(df, max_features=50).vocabulary) == want
    monkeypatch.setattr(tfidf, "CANDIDATES", 100)  # too many to list
    assert tfidf.candidate_hashes(tfidf.with_words(df).select("_words"), 50, (1, 3)) is None
    assert list(tfidf.fit_tfidf(df, max_features=50).vocabulary) == want


def test_squared_hinge_reaches_the_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * (rng.random((300, 12)) < 0.4)
    y = np.where(x[:, 0] - x[:, 1] + rng.normal(size=300) * 0.7 > 0.2, 1.0, -1.0)
    c = np.where(y > 0, 0.7, 1.9)
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], float(s), float(k)) for r, s, k in zip(x, y, c)]
    df = spark.createDataFrame(rows, "indices array<int>, weights array<double>, y double, weight double").repartition(4)
    for cost in (0.1, 5.0):
        got = tfidf.fit_squared_hinge(df, 12, cost)
        xx, w = np.hstack([x, np.ones((300, 1))]), np.zeros(13)
        for _ in range(200):  # Newton steps with halving, dense
            slack = 1 - y * (xx @ w)
            act = slack > 0
            g = w - 2 * cost * xx.T @ (c * y * np.where(act, slack, 0))
            h = np.eye(13) + 2 * cost * (xx[act].T * c[act]) @ xx[act]
            step, t = np.linalg.solve(h, g), 1.0
            f = lambda v: 0.5 * v @ v + cost * (c * np.maximum(0, 1 - y * (xx @ v)) ** 2).sum()  # noqa: B023, E731
            while f(w - t * step) > f(w) and t > 1e-12:
                t /= 2
            w = w - t * step
        assert np.abs(g).max() < 1e-8 and np.abs(got - w).max() < 1e-6


def test_svm_on_held_out_texts(spark):
    rng = random.Random(11)
    say = lambda good: " ".join(rng.choices(["thanks", "please", "help", "weather", "garden"] if good else ["ignore", "override", "secret", "prompt", "garden"], k=6) + rng.choices(["the", "a", "of", "and", "to"], k=6))
    rows = [(say(i % 4 > 0), int(i % 4 == 0)) for i in range(400)]
    train, test = (spark.createDataFrame(r, "prompt string, label int") for r in (rows[:300], rows[300:]))
    out = tfidf.fit_tfidf_svm(train).predict(test).select(F.lit("svm").alias("method"), "label", "pred")
    scores = evaluate.summary_scores(out, ["method"]).first().asDict()
    assert scores["macro_f1"] > 0.95


def test_lists_are_worked_on_in_bounded_slices(spark):
    import pyarrow as pa

    lists = [[f"w{i}{j}" for j in range(i * 7 % 40)] for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), pa.array(range(200))], ["words", "id"]).slice(3)
    parts = list(tfidf.list_slices(batch, 90))
    assert all(len(p.column(0).flatten()) <= 90 for p in parts) and len(parts) > 30
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([batch]).to_pylist()
    one = lambda b: np.sort(np.concatenate([h for _, h, _, _ in tfidf.hashed_ngrams(b.column(0), (1, 3))]))
    assert (np.sort(np.concatenate([one(p) for p in parts])) == one(batch)).all()
    long = list(tfidf.list_slices(batch, 5))  # a row is never cut
    assert sum(p.num_rows for p in long) == batch.num_rows


@pytest.mark.parametrize("p", [1, 2])
def test_search_in_a_grid_equals_the_plain_one(spark, monkeypatch, p):
    """Rows that no tree parts are met in cells, each row sent once for a cell."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((700, 24)), 2)
    x[600:650] = x[:50]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    rows = points(spark, x)
    tree, used = neighbours.blocks(rows, p, 6), []
    plain = neighbours.Blocks.search_grid
    monkeypatch.setattr(neighbours.Blocks, "search_grid", lambda *a: used.append(a[3:]) or plain(*a))
    got = sorted(map(tuple, tree.search(rows.select(F.col("id").alias("row"), "x"), 6, True).collect()))
    i, near, d = neighbours.nearest(x, np.arange(700), x, np.arange(700), 6, p)
    assert used == [(700, 700)] and got == sorted(zip(i.tolist(), near.tolist(), d.tolist()))


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_within_a_bound(p):
    rng = np.random.default_rng(2)
    for scale in (1e-6, 1.0, 1e6, 1e18):
        x, y = scale * (3 + rng.random((40, 10))), scale * (3 + rng.random((900, 10)))
        y[5] = y[6] = x[0]
        i, near, d = neighbours.nearest(x, np.full(40, -1), y, np.arange(900), 7, p)
        bound = d.reshape(40, 7)[:, -1] * rng.choice([1.0, 1.2], 40)
        bound[3] = np.nan
        a, b, c = neighbours.nearest_within(x, np.full(40, -1), y, np.arange(900), 7, p, bound)
        assert sorted(zip(a.tolist(), b.tolist(), c.tolist())) == sorted(zip(i.tolist(), near.tolist(), d.tolist()))


def test_stored_forests_are_scored_once_for_all_thresholds(spark, monkeypatch):
    df = points(spark, clustered(120, centres=4))
    monkeypatch.setattr(forest, "MAX_MODEL_ROWS", 100)
    settings = [{"trees": 4, "max_samples": 60, "contamination": c} for c in ("auto", 0.05, 0.1)]
    calls, plain = [], forest.StoredForest.score
    monkeypatch.setattr(forest.StoredForest, "score", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    forests = forest.fit_isolation_forests(df, "id", "x", settings)
    assert len(calls) == 1  # on the training rows
    got = {(r["id"], r["model"]): r["s"] for r in forest.score_many(df, forests, "x", "s").collect()}
    assert len(calls) == 2 and len(got) == 360
    for n, f in enumerate(forests):
        assert {i: got[i, n] for i in range(120)} == {r["id"]: pytest.approx(r["s"]) for r in f.score(df, "x", "s").collect()}
