"""Scores of large isolation forests, tree by tree and without the forests.

Trees whose samples are a share of the table are as large as the table, and a forest is some
hundred times that.  Where a task can hold the training and the scored rows, each once, it
draws a tree's rows, grows the tree level by level, takes all rows down the same levels, adds
their depths and forgets the tree.  The draws are those of ``forest``: the same rows, cuts and
depths, so the same scores.  Trees of one number share their rows' hashes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forest

PARTS = 2  # tasks for each core that the session has
BLOCK_ROWS = 20_000
UNIT = 1 << 32  # depths are added as multiples of its inverse, in any order the same
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Hashes:
    """Spark's ``xxhash64`` of strings, or of nulls, that goes on from a hash."""

    def __init__(self, ids: Sequence[bytes | None]) -> None:
        self.n, self.groups = len(ids), {}
        sizes = np.array([-1 if i is None else len(i) for i in ids])
        for size in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == size)
            self.groups[size] = at, np.frombuffer(b"".join(ids[i] for i in at), np.uint8).reshape(len(at), size)

    def after(self, start: int) -> np.ndarray:
        begin = np.uint64(start & forest.MASK)
        out = np.full(self.n, begin)
        for size, (at, raw) in self.groups.items():
            words = lambda lo, hi, kind: np.ascontiguousarray(raw[:, lo:hi]).view(kind).astype(np.uint64)
            one, done = np.full(len(at), begin), size // 32 * 32
            if done:
                lanes = [one + P1 + P2, one + P2, one, one - P1]
                for lo in range(0, done, 32):
                    w = words(lo, lo + 32, "<u8")
                    lanes = [turned(v + w[:, i] * P2, 31) * P1 for i, v in enumerate(lanes)]
                h = turned(lanes[0], 1) + turned(lanes[1], 7) + turned(lanes[2], 12) + turned(lanes[3], 18)
                for v in lanes:
                    h = (h ^ (turned(v * P2, 31) * P1)) * P1 + P4
            else:
                h = one + P5
            h = h + np.uint64(size)
            for lo in range(done, size - size % 8, 8):
                h = turned(h ^ (turned(words(lo, lo + 8, "<u8")[:, 0] * P2, 31) * P1), 27) * P1 + P4
            done = size - size % 8
            if size - done >= 4:
                h = turned(h ^ (words(done, done + 4, "<u4")[:, 0] * P1), 23) * P2 + P3
                done += 4
            for lo in range(done, size):
                h = turned(h ^ (raw[:, lo].astype(np.uint64) * P5), 11) * P1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[at] = h ^ (h >> np.uint64(32))
        return out


def drawn_rows(key: np.ndarray, own: np.ndarray, per_tree: int) -> np.ndarray:
    """Rows of a tree: its ``own`` in the order of ``key``, then the others; as ``forest.tree_samples``."""
    kept = []
    for rows, n in ((np.flatnonzero(own), per_tree), (np.flatnonzero(~own), per_tree - int(own.sum()))):
        if n >= len(rows):
            kept.append(rows)
        elif n > 0:
            kept.append(rows[key[rows] <= np.partition(key[rows], n - 1)[n - 1]])
    return np.sort(np.concatenate(kept))


def copies_of(u: np.ndarray, mean: float) -> np.ndarray:
    """How often each row is drawn; as ``forest.repeats``."""
    share, upto, out = mean / np.expm1(mean), 0.0, np.ones(len(u), np.int64)
    for m in range(1, 16):
        upto += share
        share *= mean / (m + 1)
        out += u >= upto
    return out


def draws(seed: int, tree: int, node: np.ndarray, i: int) -> np.ndarray:
    """``forest.drawn`` of many nodes."""
    z = np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xC2B2AE3D27D4EB4F + i * 0xD1342543DE82EF95) & forest.MASK) + node * np.uint64(0x165667B19E3779F9)
    for _ in range(2):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) / (1 << 53)


def varied_of(x: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Nodes x features: whether a node's rows differ there.  Two rows tell most of it."""
    varied = x[rows[starts]][:, features] != x[rows[ends - 1]][:, features]
    for i in np.flatnonzero(~varied.all(axis=1) & (ends - starts > 2)):
        for at in range(starts[i], ends[i], BLOCK_ROWS):
            varied[i] |= (x[rows[at : min(ends[i], at + BLOCK_ROWS)]][:, features] != x[rows[starts[i]], features]).any(axis=0)
            if varied[i].all():
                break
    return varied


def add_depths(out: np.ndarray, asked: np.ndarray, x: np.ndarray, rows: np.ndarray, copies: np.ndarray, features: np.ndarray, seed: int, tree: int, limit: int) -> None:
    """Grows a tree on ``rows`` of ``x`` and adds the depth of each row ``asked``, in units."""
    node, number = np.zeros(len(rows), np.int64), np.ones(1, np.uint64)  # sampled rows by node
    place, at = np.arange(len(asked)), np.zeros(len(asked), np.int64)  # asked rows on their way
    for depth in range(limit + 1):
        m = len(number)
        starts, ends = np.searchsorted(node, np.arange(m)), np.searchsorted(node, np.arange(m), "right")
        size = np.bincount(node, copies, m).astype(np.int64)
        path = np.rint((depth + forest.expected_path(size)) * UNIT).astype(np.int64)
        cut_here = np.flatnonzero((size > 1) & (ends - starts > 1)) if depth < limit else np.zeros(0, np.int64)
        varied = varied_of(x, rows, starts[cut_here], ends[cut_here], features)
        kinds = varied.sum(axis=1)
        cut_here, varied, kinds = cut_here[kinds > 0], varied[kinds > 0], kinds[kinds > 0]
        feature, cut, child = np.full(m, -1), np.zeros(m), np.zeros(m, np.int64)
        if len(cut_here):
            wanted = (draws(seed, tree, number[cut_here], 0) * kinds).astype(np.int64)
            feature[cut_here] = features[(np.cumsum(varied, axis=1) > wanted[:, None]).argmax(axis=1)]
            child[cut_here] = 2 * np.arange(len(cut_here))
            held = feature[node] >= 0
            rows, copies, node = rows[held], copies[held], node[held]
            value = x[rows, feature[node]]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            low, high = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
            cut[cut_here] = low + draws(seed, tree, number[cut_here], 1) * (high - low)
            node = child[node] + ~(value <= cut[node])
            order = np.argsort(node, kind="stable")
            rows, copies, node = rows[order], copies[order], node[order]
            number = np.repeat(number[cut_here] * np.uint64(2), 2)
            number[1::2] += np.uint64(1)
        ended = feature[at] < 0
        out[place[ended]] += path[at[ended]]
        place, at = place[~ended], at[~ended]
        if not len(place):
            break
        f = feature[at]
        at = child[at] + ~(asked[place, f] <= cut[at])


def blocks(df: DataFrame, seed: int, wholes: Sequence[int], kind: int) -> DataFrame:
    """Blocks of rows (row, x): their names, whose tree each is, of every number of trees in
    ``wholes``, and the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = [None if i is None else i.encode() for i in part.column(0).to_pylist()]
                told = b"".join(struct.pack("<i", -1 if i is None else len(i)) + (i or b"") for i in ids)
                whose = np.stack([part.column(1 + k).to_numpy() for k in range(len(wholes))]).astype("<i4").tobytes() if wholes else b""
                x = part.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                single = x.astype("<f4")
                x = single if np.array_equal(single, x) else x.astype("<f8")
                raw = [pa.compress(v, codec="zstd", asbytes=True) for v in (told, whose, x.tobytes())]
                cols = [(kind, pa.int32()), (task, pa.int32()), (place, pa.int32()), (part.num_rows, pa.int32()), (len(told), pa.int32()), (x.dtype.itemsize, pa.int32())]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in cols], *[pa.array([v], pa.binary()) for v in raw]], BLOCK_NAMES)
                place += 1

    text = F.col("row").cast("string").alias("_id")
    mine = [F.pmod(F.xxhash64(F.lit(seed), text), F.lit(t)).cast("int").alias(f"_w{t}") for t in wholes]
    return df.select(text, *mine, F.col("x").cast("array<double>").alias("_x")).mapInArrow(run, BLOCK_KIND)


BLOCK_KIND = "kind int, task int, place int, n int, size int, width int, ids binary, whose binary, x binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK_KIND.split(", ")]


def unpacked(row: dict, width: int, wholes: int) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    n, told, ids, at = row["n"], pa.decompress(row["ids"], row["size"], codec="zstd", asbytes=True) if row["size"] else b"", [], 0
    for _ in range(n):
        (size,) = struct.unpack_from("<i", told, at)
        ids.append(None if size < 0 else told[at + 4 : at + 4 + size])
        at += 4 + max(0, size)
    whose = np.frombuffer(pa.decompress(row["whose"], 4 * n * wholes, codec="zstd", asbytes=True), "<i4").reshape(wholes, n) if wholes else np.zeros((0, n), np.int32)
    x = np.frombuffer(pa.decompress(row["x"], n * width * row["width"], codec="zstd", asbytes=True), f"<f{row['width']}").reshape(n, width)
    return ids, whose, x.astype(np.float64)


def depth_sums(train: DataFrame, asked: DataFrame, wanted: Sequence[tuple], n: int, width: int, seed: int) -> DataFrame:
    """``row, d0, d1, ...``: for the rows of ``asked`` (row: long, x) the sum of depths in each forest
    of ``wanted`` (sample, share of features), in units, on the ``n`` rows of ``train`` (row: string, x)."""
    spark = train.sparkSession
    trees = max(s.trees for s, _ in wanted)
    parts = max(1, min(trees, PARTS * spark.sparkContext.defaultParallelism))
    wholes = sorted({s.trees for s, _ in wanted})
    starts = {r["tree"]: r["h"] for r in spark.range(trees).select(F.col("id").cast("int").alias("tree"), F.xxhash64(F.lit(seed), F.lit("repeats"), F.col("id").cast("int")).alias("h")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {0: [], 1: []}
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                held[row["kind"]].append(unpacked(row, width, len(wholes) if row["kind"] == 0 else 0))
        if part is None or not held[1]:
            return
        ids = [i for b in held[0] for i in b[0]]
        whose, x = np.concatenate([b[1] for b in held[0]], axis=1), np.concatenate([b[2] for b in held[0]])
        rows, asked_x = np.array([int(i) for b in held[1] for i in b[0]], np.int64), np.concatenate([b[2] for b in held[1]])
        held.clear()
        hashes, sums = Hashes(ids), np.zeros((len(wanted), len(rows)), np.int64)
        for tree in range(part, trees, parts):
            begin = f"{seed}:{tree}".encode()
            key = np.frombuffer(b"".join(hashlib.md5(begin if i is None else begin + b":" + i).digest()[:8] for i in ids), ">u8").astype(np.uint64)
            u = (hashes.after(starts[tree]) & np.uint64(0xFFFFFFFF)) / float(1 << 32)
            samples = {}
            for i, (sample, share) in enumerate(wanted):
                if tree >= sample.trees:
                    continue
                if sample not in samples:
                    mine = drawn_rows(key, whose[wholes.index(sample.trees)] == tree, sample.distinct(n))
                    samples[sample] = mine, copies_of(u[mine], sample.per_tree / n) if sample.bootstrap else np.ones(len(mine), np.int64)
                limit = int(np.ceil(np.log2(max(sample.per_tree, 2))))
                add_depths(sums[i], asked_x, x, *samples[sample], forest.tree_features(seed, tree, width, share), seed, tree, limit)
        for at in range(0, len(rows), BLOCK_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(v[at : at + BLOCK_ROWS]) for v in (rows, *sums)], ["row", *names])

    names = [f"d{i}" for i in range(len(wanted))]
    sent = blocks(train, seed, wholes, 0).unionAll(blocks(asked, seed, [], 1))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, "part").sortWithinPartitions("kind", "task", "place")
    found = sent.mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
