"""Harmonising, cleaning, build and sampling on fixtures, and their large-input paths."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import build, clean, harmonise, sampling
from tidemark.operators.harmonise import SourceConfig
from tidemark.plans.corpus import cleaned_corpus
from tidemark.sources import readers, writers


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def sources(spark):
    return [
        (spark.createDataFrame([(" a ", "harmful"), ("b", "unharmful"), ("c", None), (None, "harmful")],
                               "prompt string, verdict string"),
         SourceConfig("words", "prompt", "verdict", "harmful", "unharmful")),
        (spark.createDataFrame([("b", True), ("x\r\ny", False), ("x  y", False)], "prompt string, bad boolean"),
         SourceConfig("flags", "prompt", "bad", True, False)),
        (spark.createDataFrame([("z", 1), ("z", 1), ("", 0), ("w", 7)], "Prompt string, label int"),
         SourceConfig("ints", "Prompt", "label", 1, 0)),
    ]


def test_merge_and_clean(sources):
    merged = harmonise.merge_sources(sources)
    assert merged.columns == ["prompt", "label", "source_dataset"]
    assert merged.count() == 3 + 3 + 3  # unknown and null labels are gone
    cleaned = rows_of(cleaned_corpus(sources))
    # "b" conflicts; "x y" and "z" are deduplicated; empty and null prompts dropped
    assert cleaned == [("a", 1, "words"), ("x y", 0, "flags"), ("z", 1, "ints")]
    summary = {r["metric"]: r["value"] for r in clean.cleaning_summary(merged).collect()}
    assert summary["original_rows"] == 9 and summary["cleaned_rows"] == 3
    assert summary["conflicting_prompt_count"] == 1 and summary["label_1_count"] == 2
    out = cleaned_corpus(sources)
    assert out.where("prompt IS NULL").count() == 0
    assert out.count() == out.distinct().count()
    assert rows_of(clean.clean(out)) == cleaned


def test_clean_without_broadcast(sources, monkeypatch):
    want = rows_of(cleaned_corpus(sources))
    monkeypatch.setattr(clean, "BROADCAST_DIGESTS", -1)
    assert rows_of(cleaned_corpus(sources)) == want


def test_summary_of_sources(sources):
    got = {r["dataset"]: r for r in harmonise.source_summary(
        harmonise.merge_sources(sources), [c for _, c in sources]).collect()}
    assert got["ints"]["rows_kept"] == 3 and got["ints"]["prompt_column_used"] == "Prompt"


def test_benign_words(spark):
    words = ["0", " Benign", "FALSE", "ham", "1", "yes", None, "other", "n", "T"]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(harmonise.parse_benign(F.col("v"))).collect()]
    assert got == [True, True, True, True, False, False, False, False, True, False]


def test_validation(spark):
    df = spark.createDataFrame([("",), ("a",), ("a" * 20000,), ("a" * 20001,), (None,)], "prompt string")
    good, bad = harmonise.split_valid(df)
    assert good.count() == 2 and bad.count() == 3


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "Hello ", 1), (1, "hello", 0), (2, "abcd", 0), (4, " longer", 1)],
                               "row_id long, text string, label int")
    kept = build.clean_short(build.dedup_normalized(df))
    assert rows_of(kept) == [(1, "hello", 0), (4, "longer", 1)]


def ranked(ids, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def test_exact_samples_and_splits(spark):
    # a third of the rows in one class, and one row in another
    df = spark.range(3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") == 5, 2).when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"),
    )
    by = {c: [i for i in range(3000) if (2 if i == 5 else int(i % 3 == 0)) == c] for c in (0, 1, 2)}
    got = rows_of(build.balance_classes(df, cap=100).select("label", "row_id"))
    assert got == sorted([(c, i) for c in by for i in ranked(by[c])[:100]], key=repr)

    parts = build.stratified_split(df)
    assert parts.count() == 3000
    for c, ids in by.items():
        held = -(-len(ids) * 3 // 10)
        test = -(-held // 2)
        want = ranked(ids)
        for name, chosen in (("train", want[: len(ids) - held]), ("val", want[len(ids) - held : len(ids) - test]),
                             ("test", want[len(ids) - test :])):
            found = parts.where(f"split = '{name}' AND label = {c}").select("row_id")
            assert sorted(r[0] for r in found.collect()) == sorted(chosen)


def test_samples_with_many_strata(spark):
    """More strata than may be broadcast: the cuts are joined instead."""
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 40).alias("label"))
    tagged = sampling.with_cuts(df, "row_id", [lambda n: F.least(F.lit(4), n)], ["label"], max_strata=3)
    got = tagged.where("_key <= cut_0").select("label", "row_id")
    want = [(c, i) for c in range(40) for i in ranked([i for i in range(600) if i % 40 == c])[:4]]
    assert rows_of(got) == sorted(want, key=repr)


def test_sampling_edges(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    assert sampling.sample_exact(df, "row_id", 9).count() == 5
    assert sampling.sample_exact(df, "row_id", 0).count() == 0
    assert sampling.sample_exact(df.where("row_id < 0"), "row_id", 3).count() == 0


def test_weights_of_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    got = {r["label"]: r["weight"] for r in build.class_weights(df).collect()}
    assert got == {0: 1.0, 1: 2.0}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("a", 0)], "prompt string, label int")
    dup = {r["scope"]: r["duplicates"] for r in clean.duplicate_counts(df).collect()}
    assert dup == {"duplicate_rows": 1, "duplicate_prompts": 2}
    missing = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in clean.missing_summary(df).collect()}
    assert missing == {"prompt": (0, 0.0), "label": (1, 25.0)}
    assert rows_of(clean.label_conflicts(df)) == [("a", 2)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("multi\nline \"quoted\", comma", 1), ("plain", 0)], "prompt string, label int")
    path = str(tmp_path / "t.csv")
    writers.write_csv(df, path)
    assert rows_of(readers.read_table(spark, path, df.schema)) == rows_of(df)
    assert readers.load_prompts(spark, path).columns == ["text", "label"]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.txt")
    with pytest.raises(ValueError):
        readers.as_prompts(df.drop("label"))
    splits = df.withColumn("split", F.when(F.col("label") == 1, "train").otherwise("test"))
    writers.write_splits(splits, str(tmp_path / "s"))
    assert readers.load_split(spark, str(tmp_path / "s"), "train").count() == 1
    both = readers.read_many(spark, {"a": path, "b": path})
    assert both.groupBy("split").count().count() == 2


def test_row_ids_follow_content(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    ids = [r["row_id"] for r in build.assign_row_id(df).collect()]
    assert ids[0] == ids[2] != ids[1]
