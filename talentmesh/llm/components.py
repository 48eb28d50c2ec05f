"""Connected components by alternating stars, over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmesh.llm.common import stable


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its larger ones."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(u, v): every linked node but the smallest of its component, with that smallest one.

    ``links`` has long columns u and v in any order, repeats and loops allowed. The number of
    rounds grows with the logarithm of the longest path; each ends in the shared folder, and
    the driver sees a count and a checksum a round.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = stable(links, name), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")).head()
        if state == before or not state["n"]:
            return links
        before = state
        links = stable(_small_star(_large_star(links)), name)
