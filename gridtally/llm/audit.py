"""What each of several filters removes, in every order in which they may be applied.

Each document fails some of the filters: a row of a mask matrix with 0 where it fails and
infinity where it passes. Each order is a column of a matrix with the step of every filter,
which is the inverse of the order's permutation. Their min-plus product is the step at
which a document goes in that order: the smallest step among the filters that it fails.
Documents with equal masks go together, so all is added up by part and mask first; what is
left is at most 2^5 rows for a part, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = re.compile(rb"[^A-Z]+")
#: The bit of a failed filter in a mask.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}

COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def text_mask(text: str) -> int:
    """The filters that the text fails by itself, all but E, as bits."""
    raw = text.encode()
    words = raw.split()
    mask = 0
    if len(words) < LEAST_WORDS:
        mask |= BIT["A"]
    if 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words):
        mask |= BIT["B"]
    if 100 * len(CAPITALS.sub(b"", raw)) > MOST_CAPITALS_PERCENT * len(text):
        mask |= BIT["C"]
    if SYMBOLS.search(raw):
        mask |= BIT["D"]
    return mask


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and the text's 128-bit hash in two numbers, for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value.as_py() or "" for value in batch.column(2)]
            digests = b"".join(xxhash.xxh3_128_digest(t.encode()) for t in texts)
            halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([text_mask(t) for t in texts], pa.int32()),
                pa.array(halves[:, 0]),
                pa.array(halves[:, 1]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "h1", "h2"])

    part = F.coalesce(F.col("lang"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, "text").mapInArrow(
        judge, "doc_id long, part string, mask int, h1 long, h2 long"
    )


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits), n, good, toxic: documents that fail just these filters.

    Texts are equal when their 128-bit hashes are. Rows are added up by document, then by
    text, before any of them meet: of a group of copies no task sees more than one row for
    each document in its share of the input, and one for each task in the last step.
    """
    judged = (
        labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
        .where(F.col("doc_id").isNotNull())
    )
    text = ("h1", "h2")
    kind = ("part", "mask", "good", "toxic")
    rows = (
        masks(docs)
        .groupBy("doc_id", *text, "part", "mask")
        .agg(F.count("*").alias("n"))
        .join(judged, "doc_id", "left")
        .na.fill(0, ["good", "toxic"])
    )
    numbered = F.col("doc_id").isNotNull()
    # The smallest doc_id of a text, part and label, with its rows: all others have a smaller one.
    first = F.min(F.when(numbered, F.struct("doc_id", "n")))
    alike = rows.groupBy(*text, *kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(numbered, F.col("n")).otherwise(0)).alias("numbered"), first.alias("first")
    )
    least = alike.groupBy(*text).agg(F.min("first.doc_id").alias("least"))
    copies = F.col("numbered") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = alike.join(least, list(text)).select(
        *kind,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("copy"), (F.col("n") - copies).alias("n")),
                F.struct(F.lit(BIT["E"]).alias("copy"), copies.alias("n")),
            )
        ).alias("s"),
    )
    n = F.col("s.n")
    return (
        split.where(n > 0)
        .groupBy("part", F.col("mask").bitwiseOR(F.col("s.copy")).alias("mask"))
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * F.col("good")).alias("good"),
            F.sum(n * F.col("toxic")).alias("toxic"),
        )
    )


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of the filters, and for every mask and order the step that removes it.

    Steps count from 0; what fails nothing has the step after the last.
    """
    orders = np.array(list(permutations(range(filters))))
    steps = np.argsort(orders, axis=1).T.astype(float)
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    mask = np.where(fails, 0.0, np.inf)
    product = np.min(mask[:, :, None] + steps[None, :, :], axis=1)
    return orders, np.minimum(product, filters).astype(np.int64)


def audited(counts: pd.DataFrame) -> pd.DataFrame:
    """The audit of one part from its rows of :func:`mask_counts`, at most one for each mask."""
    filters = len(FILTERS)
    orders, steps = removal_steps(filters)
    every = np.arange(len(orders))
    mask = counts["mask"].to_numpy()
    weight = {name: counts[name].to_numpy(np.int64) for name in ("n", "good", "toxic")}
    removed = {name: np.zeros((len(orders), filters + 1), np.int64) for name in weight}
    redundant = np.zeros((len(orders), filters), np.int64)
    for i, m in enumerate(mask.tolist()):
        for name, w in weight.items():
            np.add.at(removed[name], (every, steps[m]), w[i])
        fails = (m >> orders) & 1
        later = np.arange(filters)[None, :] > steps[m][:, None]
        redundant += fails * later * weight["n"][i]
    alone = np.array([weight["n"][mask == 1 << f].sum() for f in range(filters)], np.int64)
    here = removed["n"][:, :filters]
    total = np.zeros(filters, np.int64)
    np.add.at(total, orders, here)
    shape = (len(orders), filters)
    columns = {
        "kept": weight["n"].sum() - np.cumsum(here, axis=1),
        "removed": here,
        "redundant": redundant,
        "unique_fails": alone[orders],
        "good_lost": removed["good"][:, :filters],
        "toxic_lost": removed["toxic"][:, :filters],
        "shapley": total[orders],
    }
    names = np.array(["".join(FILTERS[f] for f in order) for order in orders])
    return pd.DataFrame(
        {
            "part": counts["part"].iloc[0],
            "filter_order": np.repeat(names, filters),
            "step": np.broadcast_to(np.arange(1, filters + 1, dtype=np.int32), shape).ravel(),
        }
        | {name: columns[name].ravel() for name in COUNTS}
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of what each filter removes, per part (language), order of filters and step.

    Columns part, filter_order, step (1 to 5) and the long counts of ``COUNTS``. The filters
    are those of :func:`text_mask`; E fails for a text that a smaller doc_id has as well. A
    NULL or empty text is empty; equal empty texts are copies. A NULL lang is the part ''.
    A NULL doc_id is neither smaller nor larger than another: E never fails for it. Rows
    that repeat doc_id and text all count and have no smaller doc_id for that. A document is
    good or toxic if any of its labels says so; documents without labels are neither. Other
    columns of both tables are not read, so their names do not matter. An empty table gives
    an empty result.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return mask_counts(docs, labels).groupBy("part").applyInPandas(audited, schema)


AUDIT_SQL = r"""
WITH judged AS (
    SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS body,
           regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marked AS (
    SELECT t.part, COALESCE(j.good, 0) AS good, COALESCE(j.toxic, 0) AS toxic,
           len(words) < 200 AS a,
           100 * len(list_distinct(words)) < 50 * len(words) AS b,
           100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS c,
           regexp_matches(body, '[#$%&*|]') AS d,
           COALESCE(t.doc_id > MIN(t.doc_id) OVER (PARTITION BY body), FALSE) AS e
    FROM texts t LEFT JOIN judged j ON j.doc_id = t.doc_id
), alike AS (
    SELECT part, a, b, c, d, e, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic
    FROM marked GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letters p JOIN letters q ON q.x <> p.x
    JOIN letters r ON r.x NOT IN (p.x, q.x)
    JOIN letters s ON s.x NOT IN (p.x, q.x, r.x)
    JOIN letters t ON t.x NOT IN (p.x, q.x, r.x, s.x)
), fails AS (
    SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'],
                          lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c
                                      WHEN 'D' THEN d ELSE e END) AS failed
    FROM alike
), placed AS (
    SELECT f.part, o.filter_order, f.n, f.good, f.toxic, f.failed,
           COALESCE(list_min(list_transform(f.failed, lambda x: strpos(o.filter_order, x))), 6) AS gone
    FROM fails f CROSS JOIN orders o
), steps AS (
    SELECT part, filter_order, s.step, filter_order[s.step] AS letter,
           SUM(CASE WHEN gone > s.step THEN n ELSE 0 END) AS kept,
           SUM(CASE WHEN gone = s.step THEN n ELSE 0 END) AS removed,
           SUM(CASE WHEN gone < s.step AND list_contains(failed, filter_order[s.step]) THEN n ELSE 0 END) AS redundant,
           SUM(CASE WHEN len(failed) = 1 AND list_contains(failed, filter_order[s.step]) THEN n ELSE 0 END) AS unique_fails,
           SUM(CASE WHEN gone = s.step THEN good ELSE 0 END) AS good_lost,
           SUM(CASE WHEN gone = s.step THEN toxic ELSE 0 END) AS toxic_lost
    FROM placed CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
    GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(SUM(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps
"""
