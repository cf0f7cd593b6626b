"""Connected components of edges by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node), for the nodes of edges (a, b).

    Each round links every node's larger neighbours to its smallest one, then every node's
    smaller neighbours; what is left is written, so a round reads a table and no lineage
    grows. A node with many neighbours is met by sums and joins only, never gathered.
    Loops and NULLs are left out; no edges give an empty result.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = written(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(high.alias("a"), low.alias("b"))
        .distinct(),
        "edges",
    )
    state = digest(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).union(least)
        now = written(small.distinct(), "edges")
        before, state = state, digest(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def digest(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed), F.sum(F.col("a").cast("decimal(38,0)"))).first())
