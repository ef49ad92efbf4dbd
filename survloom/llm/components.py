"""Connected components of a link table by alternating star contraction.

Only minima per node are aggregated, so a node with very many links never has them
gathered in one place; joins on such a node are split by adaptive execution. Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survloom.settings import staged


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns (node, root) for every node with a link; the root is the smallest node.

    Null ends, self links and repeated links are ignored. No links give no rows.
    """
    ends = (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = staged(links.filter(F.col(a) != F.col(b)).select(*ends).distinct(), "links")
    digest = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = current.agg(*digest).first()
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = _smallest_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "links")
        smallest = _smallest_neighbour(large)
        joined = large.join(smallest, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(small.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = small.agg(*digest).first()
        current = small
        if after == before:
            break
        before = after
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
