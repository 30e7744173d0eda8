"""Exact linear-interpolated quantiles whose memory does not grow with the data.

Beyond a bound on distinct values the wanted ranks are found by selection: doubles are
read as 64-bit integers of the same order, a first pass counts them by their leading
bits, and each later pass counts only the values in the ranges that hold a wanted rank,
by further bits, for all columns and groups at once.  A range whose values are all
equal is done.  Nothing is sorted, and what is counted at a time is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.common import WINDOW_ROWS, null_safe_join, running_totals, small_table
from tidemark.session import materialise

# ``percentile`` keeps one entry per distinct value; this many fit any executor.
BUFFER_VALUES = 1_000_000
SELECTED = 100_000  # ranks (groups x columns x quantiles) searched by selection
CELLS = 500_000  # counters of one pass, in each task and on the driver
TOP = 1 << 63


def interpolate(low: Column, high: Column, position: Column) -> Column:
    fraction = position - F.floor(position)
    return F.when(low == high, low).otherwise(low + (high - low) * fraction)


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-TOP)).view(np.uint64)


def doubled(key: int) -> float:
    """The double of an ``ordered`` integer."""
    bits = key ^ TOP if key & TOP else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def folded(code: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts, least and greatest keys per code."""
    if not len(code):
        return code, n, low, high
    order = np.argsort(code, kind="stable")
    code, n, low, high = code[order], n[order], low[order], high[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[starts], np.add.reduceat(n, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)


def counted(rows: DataFrame, width: int, cells: dict[tuple[int, int], np.ndarray], first: dict[tuple[int, int], int], used: int, step: int) -> DataFrame:
    """``code, n, low, high``: values of ``rows`` (gid, v0, v1, ...) per cell and next ``step``
    bits.  ``cells``: prefixes of ``used`` bits, ascending, of each (group, column), numbered
    from ``first``; code = number * 2**step + bits.  Keys are told as signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for batch in batches:
            gid, parts = batch.column(0).to_numpy(), [held]
            for c in range(width):
                col = batch.column(1 + c)
                valid = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
                keys, own = ordered(col.to_numpy(zero_copy_only=False)[valid].astype(np.float64)), gid[valid]
                for g in np.unique(own):
                    prefixes = cells.get((int(g), c))
                    if prefixes is None:
                        continue
                    mine = keys[own == g]
                    lead = mine >> np.uint64(64 - used) if used else np.zeros(len(mine), np.uint64)
                    at = np.minimum(np.searchsorted(prefixes, lead), len(prefixes) - 1)
                    inside = prefixes[at] == lead
                    mine, at = mine[inside], at[inside]
                    bits = (mine >> np.uint64(64 - used - step)) & np.uint64((1 << step) - 1)
                    code = ((first[int(g), c] + at) << step) + bits.astype(np.int64)
                    parts.append(folded(code, np.ones(len(code), np.int64), mine, mine))
            held = list(folded(*[np.concatenate(x) for x in zip(*parts)]))
        signed = [(k ^ np.uint64(TOP)).view(np.int64) for k in held[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held[:2], *signed)], names=["code", "n", "low", "high"])

    parts = rows.mapInArrow(run, "code long, n long, low long, high long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def selected_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], max_ranks: int = SELECTED) -> DataFrame | None:
    """As ``exact_quantiles``, by selection; None if there are too many groups for it."""
    cols, by = list(cols), list(by)
    sizes = df.groupBy(*by).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)])
    groups = sizes.limit(max_ranks // (2 * len(cols) * len(probs)) + 2).collect()
    if 2 * len(groups) * len(cols) * len(probs) > max_ranks and len(groups) > 1:
        return None
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)]
    if by:
        table = [(*[r[b] for b in by], g) for g, r in enumerate(groups)]
        schema = T.StructType([*df.select(*by).schema.fields, T.StructField("_gid", T.LongType())])
        tagged = null_safe_join(df.select(*by, *values), F.broadcast(df.sparkSession.createDataFrame(table, schema)), by)
    else:
        tagged = df.select(F.lit(0).cast("long").alias("_gid"), *values)
    rows = materialise(tagged.select("_gid", *[f"_v{i}" for i in range(len(cols))]))

    positions = {(g, c): [p * (r[f"_n{c}"] - 1) for p in probs] for g, r in enumerate(groups) for c in range(len(cols)) if r[f"_n{c}"]}
    found: dict[tuple[int, int, int], float] = {}
    # (group, column, prefix) -> wanted ranks as (rank in the table, rank in the cell)
    open_ = {(*k, 0): sorted({(f(p), f(p)) for p in at for f in (floor, ceil)}) for k, at in positions.items()}
    used = 0
    while open_:
        step = max(1, min(16, 64 - used, (CELLS // len(open_)).bit_length() - 1))
        listed = sorted(open_)
        cells: dict[tuple[int, int], list[int]] = {}
        first: dict[tuple[int, int], int] = {}
        for number, (g, c, prefix) in enumerate(listed):
            first.setdefault((g, c), number)
            cells.setdefault((g, c), []).append(prefix)
        told: dict[int, list] = {}
        arrays = {k: np.array(v, np.uint64) for k, v in cells.items()}
        for r in counted(rows, len(cols), arrays, first, used, step).orderBy("code").collect():
            told.setdefault(r["code"] >> step, []).append(r)
        used, narrowed = used + step, {}
        for number, cell in enumerate(listed):
            waiting, upto = open_[cell], 0
            for r in told[number]:
                here = [(rank, at - upto) for rank, at in waiting if upto <= at < upto + r["n"]]
                if here and r["low"] == r["high"]:
                    value = doubled(r["low"] + TOP)
                    found.update({(cell[0], cell[1], rank): value for rank, _ in here})
                elif here:
                    narrowed[cell[0], cell[1], (cell[2] << step) | (r["code"] & ((1 << step) - 1))] = here
                upto += r["n"]
        open_ = narrowed

    def between(g: int, c: int, position: float) -> float:
        low, high = found[g, c, floor(position)], found[g, c, ceil(position)]
        return low if low == high else low + (high - low) * (position - floor(position))

    out = [(*[r[b] for b in by], *[[between(g, c, p) for p in positions[g, c]] if (g, c) in positions else None for c in range(len(cols))]) for g, r in enumerate(groups)]
    kinds = [*df.select(*by).schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in cols]]
    return df.sparkSession.createDataFrame(out, T.StructType(kinds))


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    bounded: bool = False,
    max_distinct: int = BUFFER_VALUES,
    max_window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per group with an array of quantiles under each column's name.

    ``bounded`` promises few distinct values (text lengths, flags).  Otherwise
    their number is estimated first; beyond ``max_distinct`` the ranks are selected, or,
    for very many groups, (group, column, value, count) rows are searched by running count.
    """
    cols, by, probs = list(cols), list(by), [float(p) for p in probs]
    if not bounded:
        seen = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
        bounded = sum(seen[c] for c in cols) <= max_distinct  # all columns share one row of buffers
    if bounded:
        lits = F.array(*[F.lit(p) for p in probs])
        return df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), lits).alias(c) for c in cols])

    chosen = selected_quantiles(df, cols, probs, by)
    if chosen is not None:
        return chosen
    # too many groups: running counts over (group, column, value) rows
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*").where(F.col("_v").isNotNull())
    groups = [*by, "_col"]
    counts = materialise(long.groupBy(*groups, "_v").agg(F.count("*").alias("_c")))
    run = running_totals(counts, groups, "_v", ["_c"], max_window_rows=max_window_rows)
    sizes = counts.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    run = null_safe_join(run, small_table(sizes), groups)
    picks = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("_n") - 1)
        for name, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("upto__c") > rank, F.col("_v"))).alias(f"_{name}{i}"))
    found = run.groupBy(*groups, "_n").agg(*picks)
    values = F.array(
        *[
            interpolate(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.lit(p) * (F.col("_n") - 1))
            for i, p in enumerate(probs)
        ]
    )
    found = found.select(*by, "_col", values.alias("_values"))
    return found.groupBy(*by).agg(
        *[F.first(F.when(F.col("_col") == c, F.col("_values")), ignorenulls=True).alias(c) for c in cols]
    )


def quantile_value(df: DataFrame, col: str, prob: float, **kw) -> float | None:
    """A single quantile as a fitted number (None on an empty table)."""
    row = exact_quantiles(df, [col], [prob], **kw).first()
    return row[col][0] if row and row[col] else None
