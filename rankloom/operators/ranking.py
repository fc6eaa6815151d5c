"""Window, ranking and limit operators.

Top-N per group is the hot path of every digest. With a literal N Spark adds
a partial ``WindowGroupLimit`` before the exchange, so at most N rows per group
and map partition cross the network. With a per-group N (a column) whose largest
value is known, that value is such a literal. Without it we rank in two phases:
first inside ``(group, salt)`` buckets, then inside the group on the survivors.
That is exact (a row outside its bucket's top N cannot be in the group's top N)
and keeps one hot group from landing whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 64


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row per key by ``order`` (insert-or-ignore, first write wins)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n, rank_col: str = "rank",
                    salt_on: Sequence[str] | None = None,
                    salt_buckets: int = DEFAULT_SALT_BUCKETS, most: int | None = None) -> DataFrame:
    """Rows ranked 1..n per group (``row_number``), ``rank_col`` = position.

    ``order`` must be total (end it in a unique column) so results are stable.
    ``n`` is an int or a Column evaluated per row (e.g. a profile setting);
    ``most`` is a value that such a column never exceeds.
    """
    order_cols = _cols(order)
    if isinstance(n, int):
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
    limit = n
    if most is not None:  # one exchange, of at most ``most`` rows per group and map partition
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= most)
                .filter(F.col(rank_col) <= limit))
    if salt_on:
        salt_src = _cols(salt_on)
    else:  # any deterministic spread of the group's rows works; hash the atomic columns
        salt_src = [F.col(f.name) for f in df.schema.fields
                    if f.dataType.typeName() not in ("map", "array", "struct")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    local = salted.withColumn("_rn1", F.row_number().over(w1)).filter(F.col("_rn1") <= limit)
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)
    return (local.withColumn(rank_col, F.row_number().over(w2))
            .filter(F.col(rank_col) <= limit).drop("_salt", "_rn1"))


SORTS = {
    # sort menu, each with a discovered_at tie; unknown key = discovered.
    "score": lambda parity: [F.col("score").desc_nulls_last(), F.col("discovered_at").desc_nulls_last()],
    "posted": lambda parity: [
        (F.col("date_posted") if parity else F.col("date_posted").try_cast("date")).desc_nulls_last(),
        F.col("discovered_at").desc_nulls_last()],
    "discovered": lambda parity: [F.col("discovered_at").desc_nulls_last()],
}


def sort_columns(key: str | None, parity: bool = False, tiebreak: str = "job_url") -> list[Column]:
    cols = SORTS.get(key or "", SORTS["discovered"])(parity)
    return cols + [F.col(tiebreak).asc()]
