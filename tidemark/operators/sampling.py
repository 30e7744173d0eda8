"""Exact, reproducible samples and splits by rank of a salted hash.

Rows are ordered by ``md5(seed:id)`` within their stratum.  Instead of sorting
rows, the key at each wanted rank is searched: one aggregate over hash prefixes
finds the prefix that holds the rank, and only the rows of that prefix (about
one in a million) are ranked.  Afterwards membership is a comparison of the
row's own key with the cut key, so texts are never sorted or shuffled, and a
stratum with most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import SMALL_ROWS, null_safe_join, small_table, windowed

PREFIX = 5  # hex digits: 16^5 histogram cells per stratum
NOTHING, EVERYTHING = "", "g"  # below and above every hex key


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def rank_cuts(
    df: DataFrame,
    id_col: str,
    ranks: Sequence[Callable[[Column], Column]],
    by: Sequence[str] = (),
    seed: int = 42,
    prefix: int = PREFIX,
) -> DataFrame:
    """Per stratum the keys ``cut_0, cut_1, ...`` such that exactly ``ranks[i](n)``
    of its n rows have a key ``<= cut_i``.  ``id_col`` must be unique."""
    by = list(by)
    keyed = df.select(*by, order_key(id_col, seed).alias("_key")).withColumn(
        "_prefix", F.substring("_key", 1, prefix)
    )
    cells = keyed.groupBy(*by, "_prefix").agg(F.count("*").alias("_cell"))
    run = cells.withColumns(
        {
            "_upto": F.sum("_cell").over(windowed(by, F.col("_prefix"))),
            "_n": F.sum("_cell").over(windowed(by)),
        }
    )
    wanted = F.array(
        *[F.struct(F.lit(i).alias("i"), r(F.col("_n")).cast("bigint").alias("rank")) for i, r in enumerate(ranks)]
    )
    run = run.withColumn("_cut", F.explode(wanted)).withColumns(
        {"_i": F.col("_cut.i"), "_rank": F.col("_cut.rank")}
    )
    # outside 1..n-1 no search is needed; keep one row per (stratum, cut)
    trivial = run.where((F.col("_rank") <= 0) | (F.col("_rank") >= F.col("_n"))).groupBy(*by, "_i").agg(
        F.when(F.max("_rank") <= 0, NOTHING).otherwise(EVERYTHING).alias("_cut_key")
    )
    inner = run.where(
        (F.col("_rank") > 0)
        & (F.col("_rank") < F.col("_n"))
        & (F.col("_rank") <= F.col("_upto"))
        & (F.col("_rank") > F.col("_upto") - F.col("_cell"))
    ).select(*by, "_i", "_prefix", (F.col("_rank") - F.col("_upto") + F.col("_cell")).alias("_need"))
    ranked = null_safe_join(keyed, small_table(inner), [*by, "_prefix"]).withColumn(
        "_rn", F.row_number().over(windowed([*by, "_prefix", "_i"], F.col("_key")))
    )
    searched = ranked.where(F.col("_rn") == F.col("_need")).select(*by, "_i", F.col("_key").alias("_cut_key"))
    cuts = trivial.select(*by, "_i", "_cut_key").unionByName(searched)
    return cuts.groupBy(*by).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_cut_key"))).alias(f"cut_{i}") for i in range(len(ranks))]
    )


def with_cuts(df, id_col, ranks, by=(), seed=42, prefix: int = PREFIX, max_strata: int = SMALL_ROWS) -> DataFrame:
    """``df`` with its order key ``_key`` and the cut keys of its stratum."""
    cuts = small_table(rank_cuts(df, id_col, ranks, by, seed, prefix), max_strata)
    keyed = df.withColumn("_key", order_key(id_col, seed))
    if by:
        return null_safe_join(keyed, cuts, list(by))
    row = cuts.first()
    keys = [row[f"cut_{i}"] if row else NOTHING for i in range(len(ranks))]
    return keyed.withColumns({f"cut_{i}": F.lit(k) for i, k in enumerate(keys)})


def _without_cuts(df: DataFrame, count: int) -> DataFrame:
    return df.drop("_key", *[f"cut_{i}" for i in range(count)])


def sample_exact(
    df: DataFrame, id_col: str, n: int, by: Sequence[str] = (), seed: int = 42, prefix: int = PREFIX
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, per stratum if ``by`` is given."""
    tagged = with_cuts(df, id_col, [lambda size: F.least(F.lit(n), size)], by, seed, prefix)
    return _without_cuts(tagged.where(F.col("_key") <= F.col("cut_0")), 1)


def share_ranks(fractions: Mapping[str, float]) -> list[Callable[[Column], Column]]:
    """Ranks that end each part but the last.

    The held-out rows after part i are the ceiling of their share, as in a
    sequence of two-way splits that round the held-out side up."""
    names = list(fractions)

    def rank_after(i: int) -> Callable[[Column], Column]:
        def rank(size: Column) -> Column:
            left = size
            for j in range(i + 1):
                rest = sum(fractions[m] for m in names[j + 1 :])
                share = rest / (rest + fractions[names[j]])
                left = F.ceil(F.round(left * F.lit(share), 9))
            return size - left

        return rank

    return [rank_after(i) for i in range(len(names) - 1)]


def split_by_rank(
    df: DataFrame,
    id_col: str,
    fractions: Mapping[str, float],
    by: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: the parts of ``fractions`` in order, exact per stratum."""
    names = list(fractions)
    ranks = share_ranks(fractions)
    tagged = with_cuts(df, id_col, ranks, by, seed)
    split = F.lit(names[-1])
    for i in reversed(range(len(ranks))):
        split = F.when(F.col("_key") <= F.col(f"cut_{i}"), names[i]).otherwise(split)
    return _without_cuts(tagged.withColumn("split", split), len(ranks))
