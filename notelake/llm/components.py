"""Connected components of a link table, by alternating large and small stars.

Every round is two groupings and joins over the links; nothing is gathered on
the driver but a count and a checksum per round. A hub with many neighbours is
pre-aggregated (min) before the shuffle; the minima are written, so that the
join has two exchanges of its own and AQE may split the hub in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import keep


def _star(links: DataFrame, both: bool) -> DataFrame:
    """One star round. both: over all neighbours (large star), else over the smaller ones (small star)."""
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = keep(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    moved = near.join(least, "a")
    if both:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), any direction, repeats and loops allowed. Returns (node, root), root the smallest node reached; unlinked nodes are absent."""
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    links = keep(links, "links")
    mark = _mark(links)
    while mark[0]:
        links = keep(_star(_star(links, True), False), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
