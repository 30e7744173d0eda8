"""Lloyd's clustering with ns-bounds.

Every vector carries a distance to each centroid, exact when it was last evaluated,
and the round of that evaluation.  The history of the centroids is kept.  In a later
round a stored distance is loosened by the norm of the total displacement of that
centroid since then, one vector norm between two kept centroids, which is never more
than the sum of its per-round drifts.  If the loosened distance to the own centroid
stays below the loosened distances to all others, the vector keeps its cluster and
none of its distances is computed; otherwise the own distance and those of the
centroids that aren't ruled out are computed exactly, in integers.

Vectors and bounds are one table, read and written once a round without a shuffle;
what meets per round are the sums of a task's clusters.  Centroids, their history and
displacements (k x rounds rows) are all that travels to tasks or driver.  A round's
table is written to the shared folder, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import stored

SLACK = 1e-6  # relative: covers stored 32-bit distances and the rounding of roots
LIMIT = 1 << 27  # largest component: squared distances then fit in 64 bits
ROWS = 4096


def integer_components(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of every component as a long; null unless there are ``size``
    components and none is null or non-finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    small = F.forall(whole, lambda x: F.abs(x) <= LIMIT)
    checked = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a scaled component exceeds {LIMIT}")).cast("array<long>"))
    return F.when(sound, checked)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``c`` (paired), integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass
class State:
    """What a batch of vectors carries: cluster, and for each centroid the distance at
    its last evaluation and the round of it (-1: never)."""

    cluster: np.ndarray
    known: np.ndarray
    when: np.ndarray


def fresh(n: int, k: int) -> State:
    return State(np.full(n, -1, np.int32), np.zeros((n, k)), np.full((n, k), -1, np.int16))


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[round, centroid]: norm of the total displacement of each centroid from that
    round to the last one."""
    now = history[-1].astype(float)
    return np.array([np.sqrt(((now - old) ** 2).sum(axis=1)) for old in history])


def assign(x: np.ndarray, state: State, history: list[np.ndarray]) -> tuple[State, int]:
    """Clusters of the rows of ``x`` (integers) under the last centroids of ``history``,
    ties to the smaller number, and the number of distances computed."""
    centres = history[-1]
    n, k = len(x), len(centres)
    this = len(history) - 1
    cluster, known, when = state.cluster.copy(), state.known.copy(), state.when.copy()
    moved = displacements(history)
    drift = moved[np.maximum(when, 0), np.arange(k)]
    slack = SLACK * (known + drift + 1)
    lower = np.where(when < 0, 0.0, known - drift - slack)
    rows = np.arange(n)
    upper = np.where(cluster < 0, np.inf, known[rows, cluster] + (drift + slack)[rows, cluster])
    others = lower.copy()
    others[rows[cluster >= 0], cluster[cluster >= 0]] = np.inf
    failed = np.flatnonzero(others.min(axis=1, initial=np.inf) <= upper)
    computed = 0
    if len(failed):
        # the own distance first: with it most of the others are ruled out
        own = np.full(len(failed), np.inf)
        exact = np.full((len(failed), k), np.iinfo(np.int64).max)
        has = np.flatnonzero(cluster[failed] >= 0)
        f, c = failed[has], cluster[failed[has]]
        d = squared(x[f], centres[c])
        exact[has, c] = d
        own[has] = np.sqrt(d)
        known[f, c], when[f, c] = own[has], this
        computed += len(f)
        for j in range(k):
            todo = np.flatnonzero((lower[failed, j] <= own * (1 + SLACK)) & (cluster[failed] != j))
            f = failed[todo]
            d = squared(x[f], centres[None, j])
            exact[todo, j] = d
            known[f, j], when[f, j] = np.sqrt(d), this
            computed += len(f)
        cluster[failed] = exact.argmin(axis=1)  # the first of equal ones
    return State(cluster, known, when), computed


@dataclass
class Clustering:
    """``rows``: the columns of the input, ``cluster`` and ``distance`` (squared), under
    the last ``centres``.  ``computed``: distances evaluated in each assignment."""

    rows: DataFrame
    centres: np.ndarray
    computed: list[int]

    def summary(self) -> DataFrame:
        """``cluster, size, cluster_inertia, inertia, centroid_sha256`` (of the centroid's
        decimal components, joined by commas): one row a cluster that has rows."""
        sums = self.rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("d")).collect()
        whole = sum(r["d"] for r in sums)
        digest = {j: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for j, c in enumerate(self.centres)}
        told = [(r["cluster"], r["n"], r["d"], whole, digest[r["cluster"]]) for r in sums]
        kinds = "cluster int, size long, cluster_inertia long, inertia long, centroid_sha256 string"
        return self.rows.sparkSession.createDataFrame(told, kinds)


def first_centres(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:id``, in this order; of rows of one
    id the vector decides.  A null id is hashed as an empty one."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    return np.array([r["_x"] for r in rows.select(key.alias("_key"), "_x").orderBy("_key", "_x").limit(k).collect()], np.int64)


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    limits = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(limits, pa.array(values.ravel(), kind))


def cluster(
    vectors: DataFrame, id_col: str, vector_col: str, size: int = 64, k: int = 16, rounds: int = 3,
    scale: int = 64, seed: str = "1",
) -> Clustering:
    """Clusters the rows of ``vectors`` that have exactly ``size`` components, none null or
    non-finite, taken as integers floor(scale * x).

    Each of ``rounds`` rounds assigns every vector to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and replaces each centroid that
    has vectors by their componentwise floor(sum / count); a last assignment follows.
    Repeated rows count as often as they stand; with fewer than ``k`` vectors there
    are fewer centroids, with none no rows.  A scaled component above 2**27 is an
    error.  Other columns are kept but for the vector; ``cluster`` and ``distance``
    are replaced."""
    names = [c for c in vectors.columns if c not in ("cluster", "distance", vector_col)]
    x = integer_components(F.col(vector_col), size, scale).cast("array<int>").alias("_x")
    given = vectors.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(id_col).alias("_id"), x)
    start = stored(given.where("_x IS NOT NULL"), "cluster-vectors")
    history = [first_centres(start, k, seed).reshape(-1, size)]
    k = len(history[0])
    start = start.drop("_id")
    keys = [f"k{i}" for i in range(len(names))]
    names_back = dict(zip(keys, names))
    kept = start.select(*keys).schema.fields
    finished = StructType(kept + StructType.fromDDL("cluster int, distance long").fields)
    if k == 0:
        empty = vectors.sparkSession.createDataFrame([], finished)
        return Clustering(empty.withColumnsRenamed(names_back), history[0], [0] * (rounds + 1))
    carried = "_cluster int, _known array<float>, _when array<smallint>, _part binary"
    between = StructType(start.schema.fields + StructType.fromDDL(carried).fields)

    def assigned(past: list[np.ndarray], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = {f: c for f, c in zip(batch.schema.names, batch.slice(at, ROWS).columns)}
                    x = matrix(part["_x"], size, np.int64)
                    state = fresh(len(x), k)
                    if "_cluster" in part:
                        state = State(part["_cluster"].to_numpy(), matrix(part["_known"], k, float), matrix(part["_when"], k, np.int16))
                    state, n = assign(x, state, past)
                    kept = [part[f] for f in keys]
                    if last:
                        d = squared(x, past[-1][state.cluster])
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(state.cluster, pa.int32()), pa.array(d)], names=finished.names)
                        continue
                    sums = [np.append(x[mine].sum(axis=0), mine.sum()) for mine in (state.cluster == j for j in range(k))]
                    told: list[bytes | None] = [None] * len(x)
                    told[0] = np.concatenate([[n], *sums]).astype("<i8").tobytes()  # of the slice, in its first row
                    more = [pa.array(state.cluster, pa.int32()), lists(state.known, pa.float32()), lists(state.when, pa.int16()), pa.array(told, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*kept, part["_x"], *more], names=between.names)

        return run

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + k * (size + 1), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sums += np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "value"])

    table, computed = start, []
    for _ in range(rounds):
        table = stored(table.mapInArrow(assigned(list(history), False), between), "cluster-round")
        parts = table.where("_part IS NOT NULL").select("_part").mapInArrow(gathered, "at long, value long")
        totals = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("at").collect()
        flat = [int(r["value"]) for r in totals]
        computed.append(flat[0])
        now = history[-1].copy()
        for j in range(k):
            *sums, count = flat[1 + j * (size + 1) : 1 + (j + 1) * (size + 1)]
            if count:
                now[j] = [s // count for s in sums]
        history.append(now)
        table = table.drop("_part")
    rows = stored(table.mapInArrow(assigned(list(history), True), finished), "clusters")
    return Clustering(rows.withColumnsRenamed(names_back), history[-1], computed)


def summary(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    found = cluster(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")), "vec_id", "embedding")
    each = F.broadcast(found.summary().drop("size"))  # one row a cluster
    return found.rows.join(each, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(size: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
c0 AS (SELECT c, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (
  SELECT w, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), w) - 1 AS c FROM v QUALIFY c < {k}))"""]  # fmt: skip
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (SELECT r, c, d FROM (SELECT r, c, sum((t.x - c{n}.x) * (t.x - c{n}.x))::BIGINT AS d FROM t JOIN c{n} USING (i) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM t JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS (SELECT c{n}.c, i, CASE WHEN n IS NULL THEN c{n}.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    last = rounds
    steps.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{last} JOIN v USING (r) JOIN h USING (c)"""
