"""b-bit MinHash near-duplicate detection.

A document's set holds its distinct 5-word shingles.  One Arrow pass computes 128
minima; 120 of them form 24 bands of 5 (a pair at the threshold of 0.85 misses
all bands with a probability below 1e-6), and the low 2 bits of all are packed
into four longs.  Documents with equal sets collapse to one representative.  In
each band bucket the members meet one pivot, a different one in each band; a pair
goes on if the collision-corrected similarity, estimated by counting agreeing
bits, is within five standard deviations of the threshold.  Such pairs give
clusters, in which links are confirmed on full sets.

Clusters are cut into blocks of about ``BLOCK`` documents which share a few
pivots.  Blocks run as separate groups and report a spanning set of links, not
pairs.  Documents that are then not in their cluster's main component are
compared, block by block, with all other documents of the cluster; so a link
found by no pivot isn't lost, and a group of copies costs about its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, components, stored
from tidemark.llm.words import Hasher, mixed, shingle_set, word_chunks

WORDS, PERCENT = 5, 85
MINIMA, ROWS, BANDS, BITS = 128, 5, 24, 2
BLOCK, SHARED = 1024, 24
SLACK = 5.0  # standard deviations of the estimate


def signature_columns(sets: list[np.ndarray]) -> dict[str, list]:
    """Set identity (two longs), band keys and packed low bits for each set."""
    rng = np.random.default_rng(20_24)
    mul = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
    add = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
    minima = np.full((len(sets), MINIMA), 0xFFFFFFFF, np.uint32)
    ids = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            ids[i] = s.sum(), np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(minima[i], (x[None, at : at + 1024] * mul + add).min(axis=1), out=minima[i])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(sets), mixed(np.array([b + 1], np.uint64))[0])
        for r in range(ROWS):
            acc = mixed(acc ^ minima[:, b * ROWS + r].astype(np.uint64))
        keys[:, b] = acc
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    each = 64 // BITS
    packed = np.zeros((len(sets), MINIMA // each), np.uint64)
    for k in range(MINIMA):
        packed[:, k // each] |= low[:, k] << np.uint64(BITS * (k % each))
    return {"s1": ids[:, 0].view(np.int64), "s2": ids[:, 1].view(np.int64), "bands": list(keys.view(np.int64)), "bits": list(packed.view(np.int64))}


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, h, at, *_ in word_chunks(batch.column(1), hasher):
                sets = [shingle_set(h[a:b], WORDS) for a, b in zip(at[:-1], at[1:])]
                cols = signature_columns(sets)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(lo, hi - lo), "n_shingles": [len(s) for s in sets], **cols},
                    pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]),
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def estimated_similarity(a: Column, b: Column) -> Column:
    """Share of agreeing low bits, corrected for agreement by chance."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / F.lit(float(MINIMA)) - chance) / (1.0 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    chance = 1.0 / (1 << BITS)
    agree = percent / 100 + (1 - percent / 100) * chance
    return (agree - SLACK * (agree * (1 - agree) / MINIMA) ** 0.5 - chance) / (1 - chance)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, shingles`` (sorted longs as bytes) of the documents in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, h, at, *_ in word_chunks(batch.column(1), hasher):
                sets = [shingle_set(h[a:b], WORDS).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(broadcast_if_small(wanted), "doc_id", "semi").mapInArrow(run, "doc_id long, shingles binary")


class Sets:
    """Intersections of many sets with one, over the shingles that several hold."""

    def __init__(self, blobs: list[bytes]) -> None:
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[code]
        # by shingle: the documents that hold it; by document: its shared shingles
        code, owner = place[code[keep]], owner[keep]
        order = np.argsort(code, kind="stable")
        self.by_code, self.code_at = owner[order], np.searchsorted(code[order], np.arange(shared.sum() + 1))
        self.code, self.doc_at = code, np.searchsorted(owner, np.arange(len(sets) + 1))

    def common(self, i: int) -> np.ndarray:
        """Size of the intersection of set ``i`` with every set."""
        mine = self.code[self.doc_at[i] : self.doc_at[i + 1]]
        first, size = self.code_at[mine], self.code_at[mine + 1] - self.code_at[mine]
        if not len(mine):
            return np.zeros(len(self.size), np.int64)
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return np.bincount(self.by_code[index], minlength=len(self.size))

    def linked(self, i: int, percent: int) -> np.ndarray:
        both = self.common(i)
        return (100 * both >= percent * (self.size + self.size[i] - both)) & (self.size > 0) & (self.size[i] > 0)


def spanning_links(ids: np.ndarray, sets: Sets, percent: int, group: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what can be joined: each of ``pivots`` is compared with all;
    documents already in its group, given in ``group``, need no comparison."""
    group, links = group.copy(), []
    for i in pivots:
        if (group == group[i]).all():
            continue
        for j in np.flatnonzero(sets.linked(i, percent) & (group != group[i])):
            if group[j] != group[i]:
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Null and empty texts have no shingles and are linked with nothing.  A row with
    a null id is linked with nothing: its component is null and it is kept.  Rows
    of equal id are one node if their sets are equal or none has a smaller twin.
    Other columns of ``docs`` are not read.  An empty table gives an empty one."""
    sigs = stored(signatures(docs, id_col, text_col), "minhash-signatures")
    usable = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    reps = stored(
        usable.join(classes, ["s1", "s2"]).where("doc_id = rep").select("doc_id", "bands", "bits"), "minhash-representatives"
    )

    bands = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    # a different, but reproducible pivot in each band: the member of the least salted hash
    ranked = F.struct(F.xxhash64("doc_id", "band").alias("order"), F.col("doc_id").alias("id"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min(ranked).alias("pivot")).where("n > 1")
    met = bands.join(buckets.select("key", F.col("pivot.id").alias("pivot")), "key").where("doc_id <> pivot")
    pairs = met.select(F.least("doc_id", "pivot").alias("u"), F.greatest("doc_id", "pivot").alias("v")).distinct()
    u = reps.select(F.col("doc_id").alias("u"), F.col("bits").alias("bits_u"))
    v = reps.select(F.col("doc_id").alias("v"), F.col("bits").alias("bits_v"))
    near = pairs.join(u, "u").join(v, "v").where(estimated_similarity(F.col("bits_u"), F.col("bits_v")) >= least_estimate(percent))
    clusters = stored(components(near.select("u", "v"), "minhash-clusters"), "minhash-clusters")

    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    order = F.struct(F.xxhash64("node", F.lit("pivot")).alias("order"), F.col("node").alias("id"))
    large = sizes.where(F.col("n") > block)
    members = clusters.join(sizes, "component").select(
        F.col("node").alias("doc_id"), "component", F.ceil(F.col("n") / block).cast("int").alias("blocks")
    )
    members = stored(members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "minhash-members")
    # pivots that all blocks of a large cluster share: the least SHARED of it, found by pre-aggregation
    lists = clusters.join(large, "component").groupBy("component", F.pmod(F.xxhash64("node"), F.lit(SHARED)).alias("part"))
    shared = lists.agg(F.min(order).alias("p"), F.first("n").alias("n")).select(
        F.col("p.id").alias("doc_id"), "component", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("block")
    )
    sets = stored(full_sets(docs, members.select("doc_id"), id_col, text_col), "minhash-sets").dropDuplicates(["doc_id", "shingles"])
    placed = members.select("doc_id", "component", "block").unionByName(shared.select("doc_id", "component", F.col("block").cast("int"))).distinct()

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        found = spanning_links(ids, Sets(list(pdf["shingles"])), percent, np.arange(len(ids)), np.arange(len(ids)))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    first = stored(sets.join(placed, "doc_id").groupBy("component", "block").applyInPandas(within, "u long, v long"), "minhash-links")
    joined = components(first, "minhash-first")
    links = first
    if not large.isEmpty():
        links = first.unionAll(missed_links(members, joined, sets, percent))
        joined = components(links, "minhash-all")
    joined = stored(joined, "minhash-components")

    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("class"))
    rows = sigs.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class"))).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def missed_links(members: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the documents of large clusters that are outside the cluster's
    main component and all others of the cluster, in cells of two blocks."""
    now = members.where("blocks > 1").join(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left")
    now = stored(now.withColumn("part", F.coalesce("part", "doc_id")), "minhash-open")
    parts = now.groupBy("component", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    split = now.join(main, "component")
    outside = split.where("part <> main")
    # the rest, few as a rule, in fewer blocks of their own
    rest = outside.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rests"))
    row = outside.join(rest, "component").withColumn("rest", F.pmod(F.xxhash64("doc_id"), F.col("rests")).cast("int"))
    row = row.select("doc_id", "component", "part", F.lit(True).alias("asks"), "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    col = split.join(rest, "component").select(
        "doc_id", "component", "part", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"), "block"
    )

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        # a document that asks and also stands in the other block is there twice, as one group
        group = np.unique(pdf["part"].to_numpy(), return_inverse=True)[1]
        found = spanning_links(pdf["doc_id"].to_numpy(), Sets(list(pdf["shingles"])), percent, group, np.flatnonzero(pdf["asks"].to_numpy()))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    both = row.unionByName(col).join(sets, "doc_id")
    return stored(both.groupBy("component", "rest", "block").applyInPandas(cell, "u long, v long"), "minhash-missed")
