"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.session import durable_cut

DEFAULT_SALTS = 8


def salt_count(df: DataFrame) -> int:
    """Number of salts, from the session (``talentmesh.join.salts``)."""
    return int(df.sparkSession.conf.get("talentmesh.join.salts", str(DEFAULT_SALTS)))


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join in which every key of ``many`` is spread over ``salts`` tasks.

    ``spread`` decides the salt of a row of ``many`` (deterministic, so that a lost task is
    recomputed alike); rows of ``few`` are repeated once per salt. AQE may still split
    further. ``how`` may be inner, left or left_semi / left_anti seen from ``many``.
    """
    n = salts or salt_count(many)
    if n <= 1:
        return many.join(few, list(on), how)
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.lit(n)), F.lit(0))
    left = many.withColumn("__salt", salt)
    every = F.array(*[F.lit(i).cast("long") for i in range(n)])
    right = few.withColumn("__salt", F.explode(every))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


DEFAULT_ROWS = 1_000_000
MOST_SALTS = 1_024


def rows_a_task(df: DataFrame) -> int:
    """Rows of one key that a task may take, from the session (``talentmesh.join.rows``)."""
    return int(df.sparkSession.conf.get("talentmesh.join.rows", str(DEFAULT_ROWS)))


def heavy_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with more rows than a task may take, with the ``__salts`` that split them evenly.

    Rows are counted by key on the map side first. At most one key for every full task is kept,
    so the table is smaller than ``df`` by that factor.
    """
    most = rows_a_task(df)
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    return counted.select(*on, F.least(F.ceil(F.col("__n") / most), F.lit(MOST_SALTS)).cast("int").alias("__salts"))


def balanced_join(
    many: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str | Column], how: str = "inner",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which only keys that need it are split, each by its own number of salts.

    ``heavy`` is the stored result of :func:`heavy_keys`, of ``many`` or of the rows it was made
    from. Keys that it does not name are joined as they are; ``few`` is repeated for the others.
    ``how`` may be inner, left or left_semi / left_anti seen from ``many``.
    """
    heavy = durable_cut(heavy_keys(many, on)) if heavy is None else heavy
    if heavy.isEmpty():
        return many.join(few, list(on), how)
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), salts.cast("long")), F.lit(0)).cast("int")
    left = many.join(heavy, list(on), "left").withColumn("__salt", salt).drop("__salts")
    right = few.join(heavy, list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")
