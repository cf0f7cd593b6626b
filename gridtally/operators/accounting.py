"""Stored bytes per site, type, group, step and scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import exact_sum, first_of_each
from ..functions.predicates import accounting_rows, not_null
from ..schema import BUCKET_LEVELS, BUCKET_VALUE, bucket_tree_ddl

# Document fields behind the bucket levels.
LEVEL_FIELDS = ["site", "datatype", "datatype_grouped", "prod_step", "scope"]


def site_accounting(
    documents: DataFrame, start: str, end: str, *, keys_per_level: int | None = None
) -> DataFrame:
    """Bytes per five-level group.

    With ``keys_per_level`` each level keeps that many of its last keys in key order
    under each parent. A level ranks the distinct keys, not the groups, in salted parts
    first.
    """
    bound = [F.lit(t).cast("timestamp_ntz") for t in (start, end)]
    names = [name for _, name in BUCKET_LEVELS]
    groups = (
        documents.where(accounting_rows(*bound))
        .select(*[F.col(f).alias(n) for f, n in zip(LEVEL_FIELDS, names)], "bytes")
        .where(not_null(*names))
        .groupBy(*names)
        .agg(exact_sum("bytes").cast("double").alias("bytes"))
    )
    kept = groups if keys_per_level is None else last_keys(groups, names, keys_per_level)
    return kept.withColumn("datetime", F.lit(start).cast("timestamp_ntz")).select(
        "datetime", *names, "bytes"
    )


def last_keys(groups: DataFrame, names: list[str], n: int) -> DataFrame:
    """The groups of which every key is among the last n distinct ones under its parent.

    A group stands for a node of each level, its keys up to there. The nodes of all levels
    are made distinct, ranked under their parents and met by the groups together, so the
    groups are computed once and the number of shuffles does not follow the levels.
    """
    levels = len(names)
    path = [F.when(F.lit(i) <= F.col("depth"), F.col(c)).otherwise("") for i, c in enumerate(names)]
    node = [f"node_{i}" for i in range(levels)]
    nodes = groups.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumns(
        dict(zip(node, path, strict=True))
    )
    # The node's largest bytes say nothing new, but both readers of the groups then share one shuffle.
    distinct = nodes.groupBy("depth", *node).agg(F.max("bytes").alias("most"))
    parent = [f"parent_{i}" for i in range(levels - 1)]
    above = {c: F.when(F.lit(i) < F.col("depth"), F.col(node[i])).otherwise("") for i, c in enumerate(parent)}
    keys = distinct.withColumns({**above, "key": F.get(F.array(*node), F.col("depth"))})
    last = first_of_each(keys, ["depth", *parent], F.desc("key"), "key", n).select("depth", *node, "most")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("depth", *node)]
    mine = nodes.alias("a").join(last.alias("b"), [*same, F.col("a.bytes") <= F.col("b.most")], "left_semi")
    met = mine.groupBy(*names, "bytes").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.col("met") == levels).drop("met")


def flatten_buckets(answers: DataFrame, json_col: str, start: str) -> DataFrame:
    """Rows of a nested bucket answer kept as JSON text."""
    tree = F.from_json(json_col, bucket_tree_ddl())
    df = answers.select(F.explode(tree["responses"]).alias("node"))
    df = df.select(F.col("node.aggregations").alias("node"))
    for field, name in BUCKET_LEVELS:
        taken = [c for c in df.columns if c != "node"]
        df = df.select(*taken, F.explode(F.col("node")[field]["buckets"]).alias("node"))
        df = df.select(*taken, F.col("node.key").alias(name), "node")
    names = [name for _, name in BUCKET_LEVELS]
    return df.select(
        F.lit(start).cast("timestamp_ntz").alias("datetime"),
        *names,
        F.col("node")[BUCKET_VALUE]["value"].alias("bytes"),
    )
