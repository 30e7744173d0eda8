"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in
lower case.  A window is ``WINDOW`` consecutive words of a benchmark item; an item
of fewer words is one window.  The corpus is scanned twice: once to count the
words that items hold (summed per task before the shuffle), once to store the
postings (document, position) of each window's two rarest words only.  Shifted by
the word's offset in the item, the list of the rarest words gives the places where
an item may begin; it is intersected with that of the second rarest.  What survives
is checked against the postings of all item words in the documents that are left:
runs of fitting words that are as long as a window are phrase matches.  Two shifted
places that differ by at most ``SLOP`` words are a proximity match.

A document is known by the digest of its text: rows of one id may differ, rows
without an id have words too, and copies are matched once.

Everything runs in DataFrame expressions.  Benchmark tables are broadcast after
their rows were counted, and joined by shuffle beyond the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, broadcast_if_small, stored

WINDOW, SLOP = 10, 5
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
BENCHMARK_ROWS = 400_000  # short rows: some tens of MB


def words(text: Column) -> Column:
    """Words in their own case; null for a null text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, t, w``: lowered words of the items that have any; items of equal words
    share ``t``."""
    texts = items.select(F.col(item_col).alias("item_id"), F.transform(words(F.col(text_col).cast("string")), ascii_lower).alias("w"))
    return texts.where(F.size("w") > 0).select("item_id", F.xxhash64(F.array_join("w", " ")).alias("t"), "w")


def text_key(text: Column) -> Column:
    """What a text is known by here; null for a null text."""
    return F.unhex(F.md5(text.cast("string")))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``text_key, pos, term`` of every word of ``terms`` (word, term) in the texts (text_key, text)."""
    each = docs.select("text_key", F.posexplode(words(F.col("text"))).alias("pos", "raw"))
    return each.withColumn("word", ascii_lower(F.col("raw"))).join(terms, "word").select("text_key", "pos", "term").distinct()


def benchmark_hits(
    docs: DataFrame, items: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP,
) -> dict[str, DataFrame]:
    """Matches of the benchmark in the texts of ``docs``, by ``text_key``.

    ``phrases``: text_key, t, start, n (words, from 0): runs of ``n`` words of an item
    that hold a window, or several that overlap; ``near``: text_key, t of every
    proximity match; ``items``: t, item_id.  Null and empty texts have no words and
    no matches; rows of equal text have the same ones."""
    listed = stored(item_words(items, item_col, item_text_col), "items")
    texts = listed.select("t", "w").distinct()
    flat = stored(texts.select("t", F.size("w").alias("length"), F.posexplode("w").alias("o", "word")).withColumn("term", F.xxhash64("word")), "item-words")
    terms = stored(flat.select("word", "term").distinct(), "terms")
    docs = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    small = broadcast_if_small(terms, BENCHMARK_ROWS)

    seen = docs.select(F.explode(words(F.col("text"))).alias("raw")).select(ascii_lower(F.col("raw")).alias("word"))
    counts = stored(seen.join(small, "word").groupBy("term").agg(F.count("*").alias("count")), "term-counts")

    # the two rarest words of each window; a window with a word that never occurs can't match
    counted = flat.join(broadcast_if_small(counts, BENCHMARK_ROWS), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    last = F.greatest(F.lit(0), F.col("length") - window)
    held = counted.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("o") - (window - 1)), F.least("o", last))))
    in_window = Window.partitionBy("t", "k")
    ranked = held.withColumn("rarity", F.row_number().over(in_window.orderBy("count", "term", "o"))).withColumn("least", F.min("count").over(in_window))
    rare = stored(ranked.where("least > 0 AND rarity <= 2").select("t", "length", "o", "term", "word", "rarity").distinct(), "rare-words")
    rare_terms = broadcast_if_small(stored(rare.select("word", "term").distinct(), "rare-terms"), BENCHMARK_ROWS)
    known = docs.select(text_key(F.col("text")).alias("text_key"), "text")
    lists = stored(postings(known, rare_terms), "postings")

    def shifted(rarity: int) -> DataFrame:
        """Places ``at`` where an item would begin in a document, by one word of each window."""
        mine = broadcast_if_small(rare.where(F.col("rarity") == rarity).select("term", "t", "length", "o"), BENCHMARK_ROWS)
        return lists.join(mine, "term").select("text_key", "t", "length", "o", (F.col("pos") - F.col("o")).alias("at"))

    first, second = shifted(1), shifted(2)
    # equal places, or places in the same or the next stretch of ``slop`` + 1 words
    cell = F.floor(F.col("at") / (slop + 1))
    left = first.withColumn("cell", cell)
    right = second.select("text_key", "t", F.col("o").alias("o2"), F.col("at").alias("other"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    # two words, which one window can hold: a word that is rare in two windows doesn't meet itself
    pair = (F.col("o") != F.col("o2")) & (F.abs(F.col("o") - F.col("o2")) < window)
    both = left.join(right, ["text_key", "t", "cell"]).where(pair & (F.abs(F.col("at") - F.col("other")) <= slop))
    both = stored(both.groupBy("text_key", "t", "at").agg(F.max((F.col("at") == F.col("other")).cast("int")).alias("exact")), "item-places")
    single = first.where("length = 1").select("text_key", "t", "at")
    maybe = both.where("exact = 1").select("text_key", "t", "at").unionByName(single).distinct()

    wanted = maybe.join(broadcast_if_small(flat.select("t", "length", "o", "term"), BENCHMARK_ROWS), "t")
    wanted = wanted.withColumn("pos", (F.col("at") + F.col("o")).cast("int")).where("pos >= 0")
    left_docs = stored(maybe.select("text_key").distinct(), "matched-documents")
    again = known.join(broadcast_if_small(left_docs), "text_key", "semi")
    there = postings(again, small)
    fitting = wanted.join(there, ["text_key", "pos", "term"]).select("text_key", "t", "at", "length", "o")
    run = F.col("o") - F.row_number().over(Window.partitionBy("text_key", "t", "at").orderBy("o"))
    runs = fitting.withColumn("run", run).groupBy("text_key", "t", "at", "length", "run").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    whole = runs.where(F.col("n") >= F.least(F.lit(window), F.col("length")))
    phrases = stored(whole.select("text_key", "t", (F.col("at") + F.col("o")).alias("start"), "n"), "phrases")
    near = both.select("text_key", "t").unionByName(single.select("text_key", "t")).distinct()
    return {"phrases": phrases, "near": near, "items": listed.select("t", "item_id")}


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items``
    (item ids as sorted strings), ``n_near`` (items with a proximity match) and
    ``contaminated``.  ``n_hit`` counts the words inside any occurrence.  Rows that
    repeat an id, or have none, are judged by their own text."""
    hits = benchmark_hits(docs, items, text_col, item_col, item_text_col, window, slop)
    listed = broadcast_if_small(hits["items"], BENCHMARK_ROWS)
    # covered words of a document: union of its spans, each counted beyond the furthest end before it
    order = Window.partitionBy("text_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits["phrases"].select("text_key", "start", "n").distinct()
    end = F.col("start") + F.col("n")
    before = F.coalesce(F.max(end).over(order), F.lit(0))
    new = spans.select("text_key", F.greatest(F.lit(0), end - F.greatest("start", before)).alias("new"))
    covered = new.groupBy("text_key").agg(F.sum("new").cast("long").alias("n_hit"))
    found = hits["phrases"].select("text_key", "t").distinct().join(listed, "t")
    names = found.groupBy("text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = hits["near"].join(listed, "t").groupBy("text_key").agg(F.countDistinct("item_id").alias("n_near"))
    per_doc = covered.join(names, "text_key").join(near, "text_key", "full")
    size = F.size(F.coalesce(words(F.col(text_col).cast("string")), F.array().cast("array<string>")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), size.cast("long").alias("n_words"))
    out = rows.join(broadcast_if_small(stored(per_doc, "hit-texts"), BENCHMARK_ROWS), "text_key", "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item; null texts hold none."""
    leaks = stored(benchmark_hits(docs, items, text_col, **kw)["phrases"].select("text_key").distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks, BENCHMARK_ROWS), text_key(F.col(text_col)) == leaks["text_key"], "anti")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM s),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT p.doc_id, p.i, v.n, v.item_id FROM p CROSS JOIN (SELECT DISTINCT n FROM v) k
      JOIN v ON v.n = k.n AND v.g = array_to_string(p.w[p.i:p.i + k.n - 1], ' ')
      WHERE p.i + k.n - 1 <= len(p.w)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
a AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM h GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)
"""
