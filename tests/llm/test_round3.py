"""Piece tables, multiset hashes and ns-bounds against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest_llm import ODD, prose
from tidemark.llm import multiset_hash, ns_bounds, piece_table
from tidemark.llm.multiset_hash import Sketcher, from_hex, likeness, minus, plus, to_hex

LONG = prose(5, 200_000)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def middle(doc_id, text):
    """Output, form, prefix and middle length by the definition."""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, "plain", None, None
    x, y, z = text[:a], text[a:b], text[b:]
    out = f"<S>{z}<P>{x}<M>{y}" if h4 % 100 < 20 else f"<P>{x}<S>{z}<M>{y}"
    return out, "spm" if h4 % 100 < 20 else "psm", a, b - a


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("<PSM>é😀 \nab") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*ODD, "<P>", "a<S>b", "<M", "P>", "<P", *made, LONG]


def test_fill_in_middle_equals_definition(frame):
    rows = list(enumerate(texts())) + [(None, "a null id"), (7, "again"), (7, "again"), (-5, "negative id")]
    out = piece_table.fill_in_middle(frame(rows).withColumn("form", F.lit("clash")).withColumn("lang", F.lit("en")))
    assert out.columns == ["doc_id", "text", "lang", "n", "form", "pieces", "prefix_chars", "middle_chars", "fim_text"]
    got = Counter((r["doc_id"], r["text"], r["n"], r["fim_text"], r["form"], r["prefix_chars"], r["middle_chars"]) for r in out.collect())
    assert got == Counter((i, t, len(t or ""), *middle(i, t or "")) for i, t in rows)
    back = piece_table.restored(out.select("doc_id", F.col("text").alias("given"), "fim_text", "form"))
    assert back.where("NOT (text <=> coalesce(given, ''))").count() == 0
    assert {"psm", "spm", "plain"} == {r["form"] for r in out.select("form").distinct().collect()}
    digest = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in piece_table.summary(frame(rows)).collect()}
    assert digest == {(i, sha(middle(i, t or "")[0]), sha(t or "")) for i, t in rows}
    assert piece_table.summary(frame([])).count() == 0


def test_restore_refuses_what_lacks_sentinels(frame):
    df = frame([("no sentinel", "psm"), ("<P>a<M>b<S>c", "psm"), ("<S>z<P>x<M>y", "spm"), ("as it is", "plain"), (None, "psm")], "fim_text string, form string")
    got = [r["text"] for r in piece_table.restored(df).collect()]
    assert got == [None, None, "xyz", "as it is", None]


def test_cut_splits_anywhere(spark):
    table = F.array(piece_table.piece(0, F.lit(0), F.lit(5)), piece_table.piece(1, F.lit(0), F.lit(3)))
    for at in range(9):
        row = spark.range(1).select(piece_table.cut(table, F.lit(at)).alias("p"), F.lit("abcde").alias("t"))
        parts = row.first()["p"]
        assert len(parts) == 3 and sum(p["length"] for p in parts) == 8
        assert row.select(piece_table.spelled(F.col("p"), F.col("t")).alias("s")).first()["s"] == "abcde<P>"
        lengths = [p["length"] for p in parts]
        assert at in (lengths[0], lengths[0] + lengths[1])


def plain_vector(lines):
    """Sum over paragraphs by the definition, pair by pair."""
    total, sketcher = Sketcher().vector(None), Sketcher()
    for line in lines:
        total = plus(total, sketcher.vector(line))
    return total


def test_multiset_hash_is_homomorphic():
    s, rng = Sketcher(), random.Random(1)
    lines = [prose(i, rng.randint(0, 30)) for i in range(12)] + ["", "", "one", "ÀÉ 😀"]
    whole = s.document("\n".join(lines))
    rng.shuffle(lines)
    assert to_hex(s.document("\n".join(lines))) == to_hex(whole) == to_hex(plain_vector(lines))
    less = s.document("\n".join(lines[1:]))
    assert np.array_equal(minus(whole, s.vector(lines[0])), less) and np.array_equal(plus(less, s.vector(lines[0])), whole)
    assert to_hex(s.document(None)) == to_hex(s.document("")) == multiset_hash.ZERO
    different = ["a", "a\na", "a\n", "\n", "b", "a b", "b a", "a  b", "A b"]
    assert len({to_hex(s.document(t)) for t in different}) == len(different)


def test_long_texts_hash_as_their_words(monkeypatch):
    """Runs of bytes, with words and lines across their borders, change nothing."""
    rng = random.Random(2)
    text = "".join(rng.choice(["ab ", "c\n", "déf ", "\n\n", "x" * 40 + " ", " "]) for _ in range(3000))
    want = Sketcher().document(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(multiset_hash, "CHUNK", size)
        assert np.array_equal(Sketcher().document(text), want)
    monkeypatch.undo()
    pairs = Counter()
    for line in text.split("\n"):
        words = line.split()
        pairs.update(zip(words, words[1:]) if len(words) > 1 else [tuple(words)] if words else [])
    found = np.concatenate(list(Sketcher().pairs(text.encode())))
    assert sorted(Counter(found.tolist()).values()) == sorted(pairs.values())


def test_likeness_estimates_common_pairs():
    s = Sketcher()
    for share in (0.0, 0.25, 0.5, 0.75, 0.95):
        found = []
        for seed in range(40):
            a, b = prose(seed, 400).split(), prose(1000 + seed, 400).split()
            keep = int(400 * share)
            x, y = s.document(" ".join(a)), s.document(" ".join(a[:keep] + b[keep:]))
            found.append(likeness(x, y))
        assert abs(np.mean(found) - share) < 0.05
        assert np.std(found) < 0.12
    assert likeness(x, x) == 1.0 and likeness(s.document(""), x) == 0.0 and likeness(s.document("\n"), s.document("")) == 0.0


def brute_report(rows):
    """Edited texts and fingerprints of whole texts, one after another."""
    s = Sketcher()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        x, y, z = s.document(text), s.document(edited), s.document(after)
        out.append((i, len(text), sha(edited), to_hex(x), to_hex(y), likeness(x, y), likeness(x, z)))
    return out


def test_edit_report_equals_brute_force(spark, frame):
    rng = random.Random(8)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, "no id either"), (4, "tie one"), (4, "tie two\nand more words")]
    rows += [(10, "one hot row, again and again\nwith lines")] * 400 + [(None, None)] * 50
    rng.shuffle(rows)
    for n in (rows, rows[:1], rows[:2], []):
        df = frame(n, "doc_id long, text string").withColumn("bucket", F.lit("clash")).repartition(5)
        got = [tuple(r) for r in multiset_hash.edit_report(df).collect()]
        assert Counter(got) == Counter(brute_report(n)), len(n)
    dealt, parts = multiset_hash.ranges(frame(rows), 8)
    sizes = dealt.groupBy("bucket").count().collect()
    assert parts == 8 and max(r["count"] for r in sizes) < 0.4 * len(rows)  # the hot row is half of all


def test_combined_fingerprints(spark, frame):
    rows = [(1, "a b c\nd e"), (1, "d e"), (2, None), (3, "x\ny"), (None, "null group")]
    prints = multiset_hash.fingerprints(frame(rows).withColumn("fingerprint", F.lit(1)))
    got = {r["doc_id"]: r["fingerprint"] for r in multiset_hash.combined(prints, ["doc_id"]).collect()}
    s = Sketcher()
    want = {1: "a b c\nd e\nd e", 2: None, 3: "x\ny", None: "null group"}
    assert got == {k: to_hex(s.document(v)) for k, v in want.items()}
    pair = multiset_hash.with_likeness(prints.withColumn("other", F.lit(got[1])), "fingerprint", "other").orderBy("doc_id").collect()
    assert [round(r["likeness"], 6) for r in pair if r["doc_id"] == 2] == [0.0]
    assert from_hex(got[1]).nbytes == multiset_hash.BYTES


def brute_clusters(x, centres, rounds):
    for n in range(rounds + 1):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if n < rounds:
            centres = centres.copy()
            for j in range(len(centres)):
                if (own == j).any():
                    centres[j] = x[own == j].sum(axis=0) // (own == j).sum()
    return own, d[np.arange(len(x)), own], centres


def vectors(n, seed=0, size=8, spread=3.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, size)) * spread
    return middles[rng.integers(0, 12, n)] + rng.normal(size=(n, size)) * 0.3


def test_clusters_equal_brute_force(spark):
    for seed, rounds in ((0, 3), (1, 6), (2, 0)):
        x = vectors(3000, seed)
        x[10:400] = x[5]  # copies, ties
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        df = df.withColumn("cluster", F.lit("clash")).withColumn("k0", F.lit(9)).repartition(6)
        found = ns_bounds.cluster(df, "vec_id", "embedding", size=8, k=16, rounds=rounds)
        assert found.rows.columns == ["vec_id", "k0", "cluster", "distance"]
        order = sorted(range(len(x)), key=lambda i: sha(f"1:{i}"))
        whole = np.floor(64 * x).astype(np.int64)
        own, d, centres = brute_clusters(whole, whole[order[:16]], rounds)
        got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.rows.collect()}
        assert got == {i: (int(c), int(s)) for i, (c, s) in enumerate(zip(own, d))}
        assert np.array_equal(found.centres, centres)
        told = found.summary().collect()
        assert sum(r["cluster_inertia"] for r in told) == told[0]["inertia"] == d.sum()
    # bounds spare most distances once the centroids settle
    assert len(ns_bounds.cluster(df, "vec_id", "embedding", size=8, rounds=8).computed) == 8


def test_bounds_spare_distances(spark):
    x = vectors(4000, 7)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    spent = ns_bounds.cluster(df, "vec_id", "embedding", size=8, k=16, rounds=6).computed
    assert spent[0] == 4000 * 16 and max(spent[2:]) < 0.5 * spent[0]


def test_total_displacement_is_tighter_than_summed_drifts():
    """A centroid that goes there and back loosens nothing."""
    a, b = np.zeros((1, 2), np.int64), np.full((1, 2), 50, np.int64)
    moved = ns_bounds.displacements([a, b, a])
    assert moved[0, 0] == 0.0 and moved[1, 0] > 70 and moved[2, 0] == 0.0
    x = np.array([[1, 0], [9, 9]], np.int64)
    history = [np.array([[0, 0], [10, 10]]), np.array([[3, 3], [10, 10]]), np.array([[0, 0], [10, 10]])]
    state, n = ns_bounds.assign(x, ns_bounds.fresh(2, 2), history[:1])
    state = ns_bounds.State(state.cluster, state.known, state.when)
    again, n = ns_bounds.assign(x, state, history)  # not looked at in the round between
    assert n == 0 and again.cluster.tolist() == [0, 1]


def test_clusters_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<double>"
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    good = [(10, [0.5, -0.5]), (10, [0.5, -0.5]), (10, [9.0, 9.0]), (None, [0.0, 0.0])]
    run = lambda rows, k: ns_bounds.cluster(spark.createDataFrame(rows, kinds), "vec_id", "embedding", size=2, k=k)
    assert run(odd, 3).rows.count() == 0 and run([], 3).summary().count() == 0
    found = run(odd + good, 16)
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in found.rows.collect()) == [(0, 0), (10, 0), (10, 0), (10, 0)]
    assert len(found.centres) == 4
    whole = np.floor(64 * np.array([g[1] for g in good])).astype(np.int64).tolist()
    start = sorted(zip([sha(f"1:{g[0] or ''}") for g in good], whole))
    own, d, centres = brute_clusters(np.array(whole), np.array([c for _, c in start[:2]]), 3)
    got = run(odd + good, 2)
    assert np.array_equal(got.centres, centres) and sum(r["distance"] for r in got.rows.collect()) == d.sum()


def test_decontamination_keys_rows_by_their_text(spark, frame):
    """Rows without an id, and rows that share one, are judged by their own text."""
    from tidemark.llm import decontaminate

    item = prose("leak", 12)
    docs = frame([(1, f"x y {item}"), (1, "three clean words"), (None, item), (None, "clean"), (2, None), (3, item), (3, item)])
    items = frame([(9, item)], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == Counter([(1, 14, 12, True), (1, 3, 0, False), (None, 12, 12, True), (None, 1, 0, False), (2, 0, 0, False), (3, 12, 12, True), (3, 12, 12, True)])
    left = decontaminate.without_benchmark(docs.withColumn("text_key", F.lit("clash")), items)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, "three clean words"), (None, "clean"), (2, None)])
    assert left.columns == ["doc_id", "text", "text_key"]


def test_word_ids_equal_the_library(monkeypatch):
    """Words of every kind, with memories that hold almost nothing."""
    from tidemark.llm import sentencepiece_codec, token_output
    from tidemark.llm.queries import PIECE_MODEL, WORD_MODEL, vocabulary

    rng = random.Random(5)
    signs = "abcxyzAÉéßÿÀÞ×÷0123'.,*#<|>&%$-_~ \n\t ̈́ﬁΣσİ"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [prose(i, 300) for i in range(20)]
    with open(vocabulary(WORD_MODEL), encoding="utf-8") as f:
        words = token_output.Vocabulary(f.read(), 2)
    monkeypatch.setattr(token_output, "GENERATION", 2000)
    for at in range(0, len(made), 64):
        part = made[at : at + 64]
        raw = words.encode([t.encode() for t in part])
        assert [np.frombuffer(r, "<u2").tolist() for r in raw] == [words.library.encode(t, add_special_tokens=False).ids for t in part]
        assert words.size <= 2000
    with open(vocabulary(PIECE_MODEL), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    memory = sentencepiece_codec.Memory(codec)
    monkeypatch.setattr(sentencepiece_codec, "GENERATION", 2000)
    for t in made:
        assert [i for s in sentencepiece_codec.stretches(t) for i in memory[s]] == codec.library.encode(t)
        memory.check()
        assert memory.size <= 2000


def test_repeats_around_a_common_line(frame):
    """Pairs that share a lead-in and a line of 440 documents, fifty equal words and more in all."""
    from tidemark.llm import suffix_dedup

    line = prose("line", 40)
    docs = [(i, f"{prose(f'before{i}', 25)} {line} {prose(f'after{i}', 25)}") for i in range(400)]
    for k in range(20):
        lead = prose(f"lead{k}", 12)
        docs += [(1000 + 2 * k + j, f"{prose(f'x{k}{j}', 20)} {lead} {line} {prose(f'y{k}{j}', 20)}") for j in (0, 1)]
    docs += [(2000 + j, f"{prose(f'u{j}', 20)} {line} {prose('tail', 11)} {prose(f'v{j}', 20)}") for j in (0, 1)]  # to the right, too
    got = {r["doc_id"]: r for r in suffix_dedup.passage_summary(frame(docs)).collect()}
    for k in range(20):
        for j in (0, 1):
            r = got[1000 + 2 * k + j]
            assert r["partner"] == 1000 + 2 * k + (1 - j) and r["spans"] == "20:72" and r["n_words"] == 52, (k, j, r)
    assert [got[2000 + j]["spans"] for j in (0, 1)] == ["20:71", "20:71"]
    assert not any(got[i]["repeated"] for i in range(400))
