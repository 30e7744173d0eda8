"""Quantiles by selection, subword counts and networks from tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.catalog.models import vectors
from tidemark.functions.features import text_features
from tidemark.functions.subword import PieceTrie, subword_counter
from tidemark.operators import anomaly, matrix, network, profile, quantiles, text_model
from tidemark.operators.forest import fit_isolation_forest
from tidemark.operators.neighbours import fit_lof
from tidemark.operators.profile import boxplot_stats
from tidemark.plans.selection import candidate_scores

# --- quantiles


def test_order_of_keys():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 2.5, 1e300, np.inf])
    keys = quantiles.ordered(x)
    assert (np.diff(keys[[i for i in range(len(x)) if i != 4]].astype(object)) > 0).all() and keys[4] == keys[5]
    assert [quantiles.doubled(int(k)) for k in keys] == x.tolist()


@pytest.mark.parametrize("cells", [64, 500_000])
def test_selection_equals_numpy(spark, monkeypatch, cells):
    """Columns with ties, signs, huge and tiny values, nulls; groups with null and of one row."""
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = np.random.default_rng(3)
    n = 3000
    data = {"a": rng.normal(size=n) * 1e-3, "b": rng.integers(-3, 4, n).astype(float), "c": np.exp(rng.normal(size=n) * 40) * rng.choice([-1, 1], n)}
    groups = rng.choice(["x", "y", None], n).tolist()
    groups[0] = "single"
    rows = [(g, *[None if rng.random() < 0.1 and g == "y" else float(data[k][i]) for k in "abc"], None) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, e double").repartition(5)
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    for by in (["g"], []):
        got = quantiles.selected_quantiles(df, ["a", "b", "c", "e"], probs, by).collect()
        assert len(got) == (4 if by else 1)
        for r in got:
            mine = [row for row in rows if not by or row[0] == r["g"]]
            for i, c in enumerate("abc", 1):
                want = np.quantile([row[i] for row in mine if row[i] is not None], probs)
                assert r[c] == pytest.approx(list(want), rel=1e-12, abs=0)
            assert r["e"] is None
    assert quantiles.selected_quantiles(df.limit(0), ["a"], [0.5], ["g"]).count() == 0
    assert quantiles.selected_quantiles(df, ["a"], [0.5], ["a"], max_ranks=20) is None


def test_quantile_paths_agree(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 7).alias("g"), (F.rand(4) * 100 - 50).alias("x"))
    probs = [i / 50 for i in range(51)]
    read = lambda **kw: {r["g"]: r["x"] for r in quantiles.exact_quantiles(df, ["x"], probs, ["g"], **kw).collect()}
    plain, selected = read(), read(max_distinct=1)
    monkeypatch.setattr(quantiles, "SELECTED", 10)  # too many groups: running counts
    for other in (selected, read(max_distinct=1), read(max_distinct=1, max_window_rows=1)):
        assert other.keys() == plain.keys() and all(other[g] == pytest.approx(plain[g], rel=1e-12) for g in plain)


def test_boxplot_of_many_values(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).alias("label"), F.pow(F.rand(1), F.lit(-0.5)).alias("x"))
    few = boxplot_stats(df, "x").orderBy("label").collect()
    monkeypatch.setattr(profile, "exact_quantiles", lambda *a: quantiles.exact_quantiles(*a, max_distinct=1))
    many = boxplot_stats(df, "x").orderBy("label").collect()
    assert few == many and all(r["outliers"] > 0 for r in many)


# --- subwords


def greedy(word, vocabulary, continued="##"):
    at = n = 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if (continued if at else "") + word[at:e] in vocabulary]
        if not ends:
            return 1
        at, n = ends[0], n + 1
    return n


def test_trie_equals_greedy_longest_match():
    rng = random.Random(1)
    for continued in ("##", ""):
        for _ in range(1500):
            letters = "abc"[: rng.randint(1, 3)]
            vocabulary = {(continued if rng.random() < 0.6 else "") + "".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
            trie = PieceTrie(vocabulary, continued)
            for _ in range(20):
                word = "".join(rng.choices(letters, k=rng.randint(0, 12)))
                assert trie.count(word) == greedy(word, vocabulary, continued), (vocabulary, word)
    assert PieceTrie(["a", "##a"]).count("a" * 100) == 100 and PieceTrie(["a", "##a"]).count("a" * 101) == 1
    assert PieceTrie(["a", "##", "#"]).count("##") == 1 and PieceTrie([]).count("x") == 1


def test_subword_counts_of_texts(spark):
    pieces = ["un", "##aff", "##able", "want", "##ed", "!", ",", "東", "cafe", "a", "##b"]
    vocabulary = spark.createDataFrame([(p,) for p in pieces] + [(None,), ("",)], "piece string")
    texts = {"Unaffable wanted!": 6, "unaffableX,": 2, "東京 café": 3, "": 0, "  \n": 0, "ab abb abc": 6, "a" * 300: 1, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for specials in (0, 2):
        counter = subword_counter(vocabulary, specials=specials)
        got = {r["t"]: r["n"] for r in df.select("t", counter(F.col("t")).alias("n")).collect()}
        assert got == {t: None if n is None else n + specials for t, n in texts.items()}
    feats = text_features(df.where("t IS NOT NULL"), "train", "t", count_tokens=subword_counter(vocabulary))
    for r in feats.collect():
        words = len(r["t"].split())
        assert r["token_count"] == texts[r["t"]]
        assert r["token_word_ratio"] == r["token_count"] / max(words, 1) and r["over_128_tokens"] == 0


# --- networks


def toy_network(spark):
    rng = np.random.default_rng(0)
    sizes, kinds = [5, 7, 3, 7, 5], ["relu", "elu", "gelu", "linear"]
    layers = [(rng.normal(size=(b, a)), rng.normal(size=b), k, None) for a, b, k in zip(sizes, sizes[1:], kinds)]
    values, layout = network.network_tables(spark, layers)
    norm = [(0, p, i, 0, float(v)) for p in network.BATCH_NORM for i, v in enumerate(rng.random(7) + 0.5)]
    return layers, values.unionAll(spark.createDataFrame(norm, network.VALUES)), layout, norm


def test_network_from_tables_equals_numpy(spark):
    from math import erf

    layers, values, layout, norm = toy_network(spark)
    x = np.random.default_rng(1).normal(size=(40, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    loaded = network.load_network(values.repartition(7), layout.repartition(3))
    got = np.array([r["xhat"] for r in anomaly.reconstruct(df, loaded).orderBy("id").collect()])
    gamma, beta, mean, var = (np.array([v for _, q, _, _, v in norm if q == p]) for p in network.BATCH_NORM)
    h = (x @ layers[0][0].T + layers[0][1] - mean) / np.sqrt(var + 1e-5) * gamma + beta
    h = np.maximum(h, 0) @ layers[1][0].T + layers[1][1]
    h = np.where(h > 0, h, np.exp(h) - 1) @ layers[2][0].T + layers[2][1]
    h = h * 0.5 * (1 + np.vectorize(erf)(h / np.sqrt(2)))
    assert got == pytest.approx(h @ layers[3][0].T + layers[3][1])


def test_faulty_networks_are_refused(spark):
    _, values, layout, _ = toy_network(spark)
    relaid = lambda c, v, layer=1: layout.withColumn(c, F.when(F.col("layer") == layer, F.lit(v)).otherwise(F.col(c)))
    bad = [
        (values.where("NOT (layer = 2 AND part = 'bias')"), layout, "no bias"),
        (values.where("NOT (layer = 2 AND row = 0 AND col = 0 AND part = 'weight')"), layout, "isn't 7 x 3"),
        (values.where("NOT (part = 'var')"), layout, "no var"),
        (values.unionAll(values.where("layer = 0 AND part = 'bias'")), layout, "bias of layer 0"),
        (values.withColumn("value", F.when(F.col("layer") == 3, F.lit(float("nan"))).otherwise(F.col("value"))), layout, "finite"),
        (values.withColumn("part", F.when(F.col("part") == "gamma", "delta").otherwise(F.col("part"))), layout, "unknown part delta"),
        (values, relaid("outputs", 4), "takes 3 inputs, layer 1 gives 4"),
        (values, relaid("activation", "swish"), "unknown activation swish"),
        (values, relaid("layer", 9), "layers are"),
        (values, layout.limit(0), "layers are"),
        (values, relaid("outputs", 50_000_000), "larger than"),
    ]
    for v, l, words in bad:
        with pytest.raises(ValueError, match=words):
            network.load_network(v, l)


def test_network_of_fitted_components(spark, small):
    rows = vectors(spark, small).withColumnRenamed("embedding", "x")
    pca = matrix.fit_pca(rows, "x", 12)
    loaded = network.load_network(*network.network_tables(spark, network.coder_of(pca)))
    both = anomaly.reconstruct(anomaly.reconstruct_linear(rows, pca, out="plain"), loaded)
    away = both.select(F.array_max(F.zip_with("plain", "xhat", lambda a, b: F.abs(a - b))).alias("d")).agg(F.max("d")).first()[0]
    assert away < 1e-9


# --- detector search


def test_candidates_equal_single_fits(spark):
    """Shared trees, searches and passes give each candidate the scores of its own fit."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 3)) * [1, 2, 3]
    df = spark.createDataFrame([(i, v.tolist(), int(i % 9 == 0)) for i, v in enumerate(x)], "id long, features array<double>, label int")
    train, val = df.where("id < 110"), df.where("id >= 110")
    forests = [{"trees": 5, "max_samples": m, "bootstrap": b, "contamination": c} for m, b, c in (("auto", True, "auto"), (0.5, False, 0.1), (0.5, False, "auto"))]
    lofs = [{"k": k, "p": p, "contamination": c} for k, p, c in ((5, 2, "auto"), (12, 2, 0.1), (5, 1, "auto"))]
    got = {}
    for r in candidate_scores(train, val, "id", "features", forests, lofs).collect():
        got.setdefault((r["run"], r["params"]), []).append((r["label"], round(r["score"], 9)))
    assert len(got) == 6
    for run, params in enumerate(forests + lofs):
        model = fit_isolation_forest(train, "id", **params) if "trees" in params else fit_lof(train, "id", **params)[0]
        want = [(r["label"], round(r["s"], 9)) for r in model.score(val, "features", "s").collect()]
        assert sorted(got[run, str(params)]) == sorted(want), params


# --- classifiers


def test_hashed_classifier_learns_from_text(spark):
    rng = random.Random(11)
    common, kinds = ["the", "a", "of", "and", "to", "garden"], (["thanks", "please", "help"], ["ignore", "override", "secret"])
    say = lambda bad: " ".join(rng.choices(common, k=12) + rng.choices(kinds[bad], k=2))
    rows = [(i, say(int(i % 5 == 0)), int(i % 5 == 0)) for i in range(500)] + [(900, None, 0), (901, "", 0)]
    df = spark.createDataFrame(rows, "row_id long, prompt string, label int").repartition(4)
    train, val, test = df.where("row_id % 10 < 7"), df.where("row_id % 10 IN (7, 8)"), df.where("row_id % 10 = 9 OR row_id IN (500, 900, 901)")
    test = test.unionAll(df.where("row_id % 10 = 5 AND row_id > 400"))
    model = text_model.fit_hashed_classifier(train.where("row_id % 20 <> 5"), val.unionAll(df.where("row_id % 20 = 5")))
    assert max(model.history) == model.history[int(np.argmax(model.history))] > 0.95 and len(model.history) < 20
    scored = model.score(test.withColumn("margin", F.lit("clash"))).collect()
    assert sum((r["margin"] > 0) == (r["label"] == 1) for r in scored) >= 0.95 * len(scored)
    again = text_model.fit_hashed_classifier(train.where("row_id % 20 <> 5"), val.unionAll(df.where("row_id % 20 = 5")))
    assert np.allclose(again.weights, model.weights)
    blank = [r["margin"] for r in scored if not r["prompt"]]
    assert len(blank) == 2 and blank[0] == blank[1] == pytest.approx(model.weights[-1])


def test_text_classifier_beats_share_and_blocklist(spark):
    board = {r["method"]: r for r in QUERIES["compare_classifiers"](spark, "/root/testdata/sf0.01").collect()}
    assert board["text_classifier"]["macro_f1"] > max(0.5, board["keyword_blocklist"]["macro_f1"])
    assert board["tfidf_svm"]["macro_f1"] > 0.5


def test_importances_are_stable_between_batch_sizes(spark):
    df = spark.range(600).selectExpr("double(id % 17) AS a", "rand(1) AS b", "rand(2) AS c", "int(id % 17 > 8 OR rand(3) > 0.9) AS label")
    one, two = ({r["feature"]: r["importance"] for r in matrix.rf_importance(df, ["a", "b", "c"], trees=60, batch=n).collect()} for n in (60, 20))
    assert sum(one.values()) == pytest.approx(1.0) and all(abs(one[c] - two[c]) < 0.05 for c in one) and one["a"] == max(one.values())


def test_importance_keeps_the_nodes_of_rows_between_levels(spark, monkeypatch):
    made, plain = [], matrix.RandomForestClassifier
    monkeypatch.setattr(matrix, "RandomForestClassifier", lambda **k: made.append(plain(**k)) or made[-1])
    df = spark.createDataFrame([(i % 2, float(i % 7), float(i % 2)) for i in range(40)], "label int, a double, b double")
    top = matrix.rf_importance(df, ["a", "b"], trees=4, batch=2).first()
    assert top["feature"] == "b" and len(made) == 2 and all(f.getCacheNodeIds() for f in made)
