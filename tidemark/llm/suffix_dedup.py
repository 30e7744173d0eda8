"""Repeated passages by a sparse suffix array.

Of each text only the suffixes at content-selected positions are kept: word
positions whose 12-word hash is the least of a window of 24.  Equal passages of
35 words or more select equal positions in them.  Suffixes whose first 12 words
occur once in the corpus are dropped after a pre-aggregated count.  The others are
range-partitioned and sorted by their next ``LENGTH`` words, then by document and
position, so that a passage shared by most documents spreads over partitions.
Neighbours of other documents are compared: the common words to the right and to
the left of the position give the match.  Intervals of ``LENGTH`` words or more are
united, which gives whole passages of any length.

Around a line that very many documents share, the order by the words to the right can
part two documents that agree on the words to the left.  A suffix whose farthest
compared neighbours still agree with it on so many words that a match could lie beyond
them, and that has no match as long as a comparison can find, is crowded.  For crowded
suffixes, and only for them, each window of ``LENGTH`` words that holds the position is
grouped by its hash over all documents, with pre-aggregated least and greatest document.
Equal windows thus always meet, however many suffixes stand between them.

Partition borders are compared from the few rows that each partition has at its
ends; these are as many as there are partitions, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import broadcast_if_small, stored
from tidemark.llm.words import Hasher, shingles, word_chunks

LENGTH, GRAM, SPAN, NEAREST = 50, 12, 24, 4
LEFT = SPAN - 1


def minimisers(h: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least ``gram``-word hash of every window of ``span``
    of them (the leftmost of equal ones); a short text has one window."""
    g = shingles(h, gram)
    if not len(g):
        return np.zeros(0, np.int64), g
    span = min(span, len(g))
    windows = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return at, g[at]


def anchors(docs: DataFrame, id_col: str, text_col: str, gram: int, span: int) -> DataFrame:
    """``h, doc_id, pos`` of the selected positions of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, h, at, *_ in word_chunks(batch.column(1), hasher):
                found = [minimisers(h[a:b], gram, span) for a, b in zip(at[:-1], at[1:])]
                size = [len(p) for p, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([g for _, g in found]).view(np.int64)),
                        pa.array(np.repeat(ids[lo:hi], size)),
                        pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)),
                    ],
                    ["h", "doc_id", "pos"],
                )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "h long, doc_id long, pos int")


def suffixes(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``doc_id, pos, right, left``: word codes (four bytes, big-endian) from each wanted
    position on, and before it, the nearest first.  ``wanted``: doc_id, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, places = batch.column(0).to_pylist(), batch.column(2)
            for lo, hi, h, at, *_ in word_chunks(batch.column(1), hasher):
                out: list[tuple] = []
                codes = (h >> np.uint64(32)).astype(">u4")
                for i in range(lo, hi):
                    own = codes[at[i - lo] : at[i - lo + 1]]
                    back = own[::-1]
                    for p in sorted(set(places[i].as_py())):
                        if p < len(own):
                            n = len(own) - p
                            out.append((ids[i], p, own[p : p + length].tobytes(), back[n : n + LEFT].tobytes()))
                yield pa.RecordBatch.from_pydict(
                    dict(zip(("doc_id", "pos", "right", "left"), map(list, zip(*out)))) if out else {c: [] for c in ("doc_id", "pos", "right", "left")},
                    pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("right", pa.binary()), ("left", pa.binary())]),
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "doc_id long, pos int, right binary, left binary")


def codes_of(blobs: list[bytes], width: int, fill: int) -> np.ndarray:
    """Matrix of codes; ``fill`` beyond the end of a text, which must match nothing."""
    joined = b"".join(b.ljust(4 * width, b"\0") for b in blobs)
    out = np.frombuffer(joined, ">u4").reshape(len(blobs), width).astype(np.int64)
    ends = np.array([len(b) // 4 for b in blobs])
    out[np.arange(width)[None, :] >= ends[:, None]] = fill
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def neighbour_matches(rows: pd.DataFrame, length: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Intervals of sorted suffixes that a neighbour of another document repeats
    (``doc_id, start, end, partner``), and which rows are crowded."""
    n = len(rows)
    ids, pos = rows["doc_id"].to_numpy(), rows["pos"].to_numpy().astype(np.int64)
    blobs = list(rows["right"]), list(rows["left"])
    # what lies beyond a text's end differs between the two sides of a comparison
    sides = [[codes_of(b, w, fill) for b, w in zip(blobs, (length, LEFT))] for fill in (-1, -2)]
    new = np.concatenate([[True], ids[1:] != ids[:-1]]) if n else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    pairs = [(np.arange(n), first[run] - 1)]  # the last suffix of another document before it
    pairs += [(np.arange(d, n), np.arange(n - d)) for d in range(1, NEAREST + 1)]
    i = np.concatenate([p[0] for p in pairs])
    j = np.concatenate([p[1] for p in pairs])
    ends = np.append(first[1:], n)[run]  # the first suffix of another document after it
    back = np.flatnonzero(ends < n)
    i, j = np.concatenate([i, back]), np.concatenate([j, ends[back]])
    good = (j >= 0) & (ids[i] != ids[np.maximum(j, 0)])
    i, j = i[good], j[good]
    out, whole = [], np.zeros(n, bool)
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        right, left = (common_words(sides[0][k][a], sides[1][k][b]) for k in (0, 1))
        hit = right + left >= length
        a, b, right, left = a[hit], b[hit], right[hit], left[hit]
        most = (right == length) & (left == LEFT)
        whole[a[most]] = whole[b[most]] = True
        for x, y in ((a, b), (b, a)):
            out.append(pd.DataFrame({"doc_id": ids[x], "start": pos[x] - left, "end": pos[x] + right, "partner": ids[y]}))
    crowded = np.zeros(n, bool)
    here = np.arange(n)
    for far in (np.maximum(here - NEAREST, 0), np.minimum(here + NEAREST, n - 1)):
        # the outermost suffix compared on this side, or the last one at hand
        crowded |= common_words(sides[0][0], sides[0][0][far]) >= length - LEFT if n else crowded
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc_id", "start", "end", "partner")})
    return pd.concat(out or [empty]).drop_duplicates(), crowded & ~whole


def window_matches(crowded: DataFrame, length: int) -> DataFrame:
    """``doc_id, start, end, partner``: windows of ``length`` words around the positions of
    ``crowded`` (doc_id, pos, right, left), with at least one word to the left, that
    another document has."""
    l = F.col("l")  # noqa: E741
    held = (F.length("left") >= 4 * l) & (F.length("right") >= 4 * (length - l))
    key = F.xxhash64("l", F.substring("left", 1, 4 * l), F.substring("right", 1, 4 * (length - l)))
    each = crowded.withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(LEFT)))).where(held)
    each = stored(each.select("doc_id", (F.col("pos") - l).cast("long").alias("start"), key.alias("key")), "crowded-windows")
    shared = each.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    partner = F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    return each.join(stored(shared, "shared-windows"), "key").select("doc_id", "start", (F.col("start") + length).alias("end"), partner.alias("partner"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, start, end, partner, earlier``: word intervals (from 0, end exclusive) of
    at least ``length`` words that also stand in document ``partner``, and whether
    that is an earlier document (smaller id).

    ``length`` must be 35 or more.  Words are runs without ASCII white space, A-Z in
    lower case.  Repeats within one document do not count.  Null and empty texts and
    null ids have no passages; rows of equal id are one document."""
    if length < GRAM + SPAN - 1:
        raise ValueError(f"passages of less than {GRAM + SPAN - 1} words may hold no selected position")
    spark = docs.sparkSession
    every = stored(anchors(docs, id_col, text_col, GRAM, SPAN), "anchors")
    counts = every.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # stored: both sides of the join are then shuffled for it alone, and a passage of
    # most documents is a skewed partition that Spark splits
    several = stored(counts.select("h"), "repeated-anchors")
    places = stored(every.join(several, "h").groupBy("doc_id").agg(F.collect_set("pos").alias("places")), "anchor-places")
    near = docs.join(broadcast_if_small(places.select(F.col("doc_id").alias(id_col))), id_col, "semi")
    kept = suffixes(near, places, id_col, text_col, length)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(n, "right", "doc_id", "pos").sortWithinPartitions("right", "doc_id", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if before is None else pd.concat([before, batch], ignore_index=True)
            found, crowded = neighbour_matches(rows, length)
            yield found.assign(part=part, edge=0, pos=0, right=b"", left=b"")
            full = rows[crowded].assign(part=part, edge=3, start=0, end=0, partner=0)
            yield full[["doc_id", "start", "end", "partner", "part", "edge", "pos", "right", "left"]]
            # the last suffixes, and one of another document, meet the next batch
            other = np.flatnonzero(rows["doc_id"].to_numpy() != rows["doc_id"].iloc[-1])
            tail = rows.iloc[sorted({*range(max(0, len(rows) - NEAREST), len(rows)), *other[-1:]})]
            before = tail.reset_index(drop=True)
            if head is None:
                other = np.flatnonzero(rows["doc_id"].to_numpy() != rows["doc_id"].iloc[0])
                head = rows.iloc[sorted({*range(min(NEAREST, len(rows))), *other[:1]})]
        if before is not None:
            edge = pd.concat([head.assign(edge=1), before.assign(edge=2)]).assign(part=part, start=0, end=0, partner=0)
            yield edge[["doc_id", "start", "end", "partner", "part", "edge", "pos", "right", "left"]]

    schema = "doc_id long, start long, end long, partner long, part int, edge int, pos int, right binary, left binary"
    sorted_rows = stored(ranged.mapInPandas(run, schema), "suffix-matches")
    found = sorted_rows.where("edge = 0").select("doc_id", "start", "end", "partner")
    # a few rows a partition
    edges = sorted_rows.where("edge IN (1, 2)").select("part", "edge", "doc_id", "pos", "right", "left").toPandas()
    if len(edges):
        edges = edges.sort_values(["right", "doc_id", "pos"], kind="stable").drop_duplicates(["doc_id", "pos"])
        more, _ = neighbour_matches(edges.reset_index(drop=True), length)
        if len(more):
            found = found.unionByName(spark.createDataFrame(more.astype("int64")).select("doc_id", "start", "end", "partner"))
    crowded = sorted_rows.where("edge = 3").select("doc_id", "pos", "right", "left").distinct()
    found = found.unionByName(window_matches(crowded, length))
    return found.withColumn("earlier", F.col("partner") < F.col("doc_id")).distinct()


def united(found: DataFrame) -> DataFrame:
    """``doc_id, start, end`` with overlapping and touching intervals united."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.select("doc_id", "start", "end", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)).alias("new"))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).select("doc_id", "start", "end")


def passage_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_passages, n_words`` repeated elsewhere,
    ``n_removable`` (words that an earlier document has), ``spans`` ("start:end" of
    whole passages), ``partner`` (the least document found to share one) and
    ``repeated``."""
    found = stored(repeated_passages(docs, id_col, text_col, length), "passages")
    size = F.sum(F.col("end") - F.col("start"))
    whole = united(found.select("doc_id", "start", "end"))
    text = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"))
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", text.alias("t")))), lambda x: x["t"]), ",")
    per_doc = whole.groupBy("doc_id").agg(F.count("*").alias("n_passages"), size.alias("n_words"), spans.alias("spans"))
    removable = united(found.where("earlier").select("doc_id", "start", "end")).groupBy("doc_id").agg(size.alias("n_removable"))
    partner = found.groupBy("doc_id").agg(F.min("partner").alias("partner"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(per_doc.join(removable, "doc_id", "left").join(partner, "doc_id"), "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_passages", "n_words", "n_removable")]
    return rows.select("doc_id", *zero, F.coalesce("spans", F.lit("")).alias("spans"), "partner", F.col("spans").isNotNull().alias("repeated"))
