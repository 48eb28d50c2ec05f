"""Ordering without hot tasks: top-k, first-per-key, exact numbering of whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          rank_name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group.

    ``row_number() <= k`` is planned with a window group limit, so a map task sends at most
    ``k`` rows of a group and a hot group never reaches one task whole.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The row with the smallest ``order`` value of every key; ``order`` is unique.

    Keys are reduced to one long on the map side, and the wide rows are then fetched by
    that unique value: a key that holds a third of the table costs one partial aggregate.
    """
    winners = df.groupBy(*keys).agg(F.min(order).alias("__first")).select("__first")
    return df.join(winners, F.col(order) == F.col("__first"), "left_semi")


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    seq: str,
    name: str = "position",
    bucket: int = BUCKET,
    fine: Sequence[Column] | None = None,
) -> DataFrame:
    """Exact 1-based position of every row in its group, however large the group is.

    ``order`` lists (column, descending) with few distinct values per group, such as a score
    to one decimal or a day; ``seq`` is the unique last key. Rows are counted per (group,
    order values, block of ``seq``), the counts are accumulated, and only blocks of at most
    ``bucket`` sequence values are sorted. With ``fine``, rows of equal order values are
    sorted by those columns instead (an hour as the order value, the exact time as the fine
    one), and ``seq`` is not used.
    """
    order_cols = [c for c, _ in order]
    block = F.lit(0) if fine else F.floor(F.col(seq) / bucket)
    blocked = df.withColumn("__block", block.cast("long"))
    cell = [*group, *order_cols, "__block"]
    sort = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in order]
    counts = blocked.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*sort, F.col("__block")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        *[F.col(c).alias(f"__k_{c}") for c in cell],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    condition = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in cell]
    local = Window.partitionBy(*cell).orderBy(*(fine or [F.col(seq)]))
    placed = blocked.withColumn("__row", F.row_number().over(local)).join(starts, condition)
    return placed.withColumn(
        name, (F.col("__start") + F.col("__row")).cast("long")
    ).drop("__block", "__row", "__start", *[f"__k_{c}" for c in cell])


def capped(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of every group plus a flag that says the cap was reached.

    The count is a separate partial aggregate; the rows go through the group limit.
    """
    totals = df.groupBy(*group).agg((F.count(F.lit(1)) >= limit).alias("cap_reached"))
    return top_k(df, group, order, limit, "source_rank").join(totals, list(group))
