"""Exact top-k inner products by term-at-a-time accumulation.

A vector is a sparse row: its terms are the components that aren't zero.  The
queries and the candidates are dealt into cells of at most about ``QUERY_ROWS`` x
``CANDIDATE_ROWS`` rows.  In a cell, each term's postings (the candidates that
have it, with their weights) are scattered into dense score arrays of the
queries that have it; a partial selection keeps the k best of the cell, and one
grouped ranking merges the cells.  A cell's memory is fixed; the number of cells
grows with the tables, and no side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_ROWS, CANDIDATE_ROWS = 2048, 4096


def integer_weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a long; null for a vector that is
    null or holds a null or non-finite component."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(sound, whole)


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Scores of all queries (rows) and candidates, one term at a time."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)

    def postings(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size = np.array([len(r) for r in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), size)
        term = np.concatenate([np.arange(n) for n in size]) if len(rows) else np.zeros(0, int)
        weight = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        some = weight != 0
        owner, term, weight = owner[some], term[some], weight[some]
        order = np.argsort(term, kind="stable")
        terms, at = np.unique(term[order], return_index=True)
        return {int(t): (owner[o], weight[o]) for t, o in zip(terms, np.split(order, at[1:]))}

    asked, held = postings(queries), postings(candidates)
    for term, (rows, q) in asked.items():
        if term not in held:
            continue
        cols, w = held[term]
        if 2 * len(cols) > len(candidates):  # a dense list: one row of weights, zeros included
            full = np.zeros(len(candidates), np.int64)
            full[cols] = w
            for r, x in zip(rows, q):
                scores[r] += x * full
        else:
            for r, x in zip(rows, q):
                scores[r, cols] += x * w
    return scores


def top_k(
    queries: DataFrame, candidates: DataFrame, id_col: str, weights_col: str, k: int = 5,
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """``query_id, rank, <id>, score``: the k candidates of highest inner product of
    each query, its own id excepted, ties to the smaller id.

    ``weights_col`` holds arrays of long; missing components count as zero, rows
    with a null array or id take no part, a query with fewer than k candidates
    gets all.  Repeated ids are ranked as rows of their own; equal (id, score) rows
    then take ranks in any order, which can't be told apart."""
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(weights_col).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")
    c = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(weights_col).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")
    rows = max(1, -(-q.count() // query_rows))
    cols = max(1, -(-c.count() // candidate_rows))
    q = q.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(rows))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    c = c.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(cols))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    keys = [F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "id", "w"]

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id", kind="stable")
        ids = held["id"].to_numpy()
        scores = accumulate(list(asked["w"]), list(held["w"]))
        out = []
        for own, row in zip(asked["id"], scores):
            there = np.flatnonzero(ids != own)
            found = row[there]
            if len(found) > k:
                least = np.partition(found, len(found) - k)[len(found) - k]
                sure = np.flatnonzero(found > least)
                chosen = np.concatenate([sure, np.flatnonzero(found == least)[: k - len(sure)]])  # ties: smaller ids come first
            else:
                chosen = np.arange(len(found))
            out.append(pd.DataFrame({"query_id": own, "id": ids[there[chosen]], "score": found[chosen]}))
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []})
        return pd.concat(out or [empty]).astype("int64")

    found = q.select(*keys).groupBy("r", "c").cogroup(c.select(*keys).groupBy("r", "c")).applyInPandas(cell, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def sql(k: int = 5, every: int = 50) -> str:
    return f"""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM t q JOIN t c ON q.i = c.i
  WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""
