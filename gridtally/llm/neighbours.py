"""Nearest neighbours by cosine from one-bit codes of randomly rotated vectors.

A vector of length one is rotated at random and each component replaced by its sign: one
bit. With f, the inner product of the rotated vector and its code (scaled to length one),
the inner product of code and rotated query divided by f estimates the cosine, and the
error is below EPSILON * sqrt((1 - f^2) / f^2 / (d - 1)) with high probability. Vectors whose
estimate plus that bound reaches the k-th exact score found so far are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import written

EPSILON = 1.9
#: Vectors and queries that one task holds, about.
VECTOR_BLOCK = 25_000
QUERY_BLOCK = 10_000
#: Vectors and queries multiplied at once.
TILE = 8_192
QUERY_TILE = 256


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for each dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings their largest component near one.

    That is exact and changes no cosine, but squares of very small or large ones stay in range.
    """
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -power)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, the correction 1 / f and the error bound of unit vectors."""
    d = rotated.shape[1]
    f = np.abs(rotated).sum(axis=1) / np.sqrt(d)
    bound = EPSILON * np.sqrt(np.maximum(0.0, 1 / (f * f) - 1) / max(1, d - 1))
    return np.packbits(rotated >= 0, axis=1), 1 / f, bound


def signs(codes: np.ndarray, d: int) -> np.ndarray:
    """Codes as vectors of length one."""
    return (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, from the original vectors."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def once(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids with one vector each, the smallest of those that share an id."""
    order = np.lexsort([*vectors.T[::-1], ids])
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def search(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, vec_id, score): the k nearest of each query among these vectors."""
    d = vectors.shape[1]
    turn = rotation(d)
    codes, correction, bound = encode(unit(vectors) @ turn)
    rotated = (unit(queries) @ turn).astype(np.float32)
    slack = 1e-4  # of the estimates, which are single precision
    out = []
    for q0 in range(0, len(queries), QUERY_TILE):
        tile = slice(q0, q0 + QUERY_TILE)
        own = query_ids[tile]
        best = np.full((len(own), k), -np.inf)
        rows: list[list[np.ndarray]] = []
        for v0 in range(0, len(ids), TILE):
            part = slice(v0, v0 + TILE)
            guess = (rotated[tile] @ signs(codes[part], d).T) * correction[part].astype(np.float32)
            guess[own[:, None] == ids[part][None, :]] = -np.inf
            upper = guess + (bound[part] + slack).astype(np.float32)
            # The k best estimates first: their exact scores are what the others must reach.
            near = np.argpartition(-guess, min(k, guess.shape[1] - 1), axis=1)[:, : k]
            q, c = np.repeat(np.arange(len(own)), near.shape[1]), near.ravel()
            score = np.where(
                ids[part][c] == own[q], -np.inf, cosines(vectors[part][c], queries[tile][q])
            ).reshape(len(own), -1)
            floor = np.maximum(best[:, -1], -np.inf)
            if score.shape[1] >= k:
                floor = np.maximum(floor, np.sort(score, axis=1)[:, -k])
            q, c = np.nonzero((upper >= floor[:, None] - slack) & np.isfinite(guess))
            exact = cosines(vectors[part][c], queries[tile][q])
            good = exact >= floor[q]
            q, c, exact = q[good], c[good], exact[good]
            rows.append([q, ids[part][c], exact])
            q, v, s = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort([v, -s, q])
            q, v, s = q[order], v[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            top = rank < k
            rows = [[q[top], v[top], s[top]]]
            best = np.full((len(own), k), -np.inf)
            best[q[top], rank[top]] = s[top]
        if rows:
            q, v, s = rows[0]
            out.append((own[q], v, s))
    return out


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query, all if there are fewer.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the
    query's own id; ties go to the smaller vec_id. Vectors that are NULL, empty, zero or
    hold NULL or non-finite components, and rows with a NULL vec_id, take no part.
    Repeated rows count once; of different vectors with one id the smallest counts. Vectors
    meet those of their own dimension only. An empty table gives an empty result.

    Each task takes a block of vectors and a block of queries, both of bounded size, and
    returns k rows for each query at most; the best of those are the result.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    rows = written(
        vectors.where(usable).select(
            F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), F.size("embedding").alias("d")
        ),
        "vectors",
    )
    n = rows.count()
    groups = max(1, -(-n // VECTOR_BLOCK))
    blocks = max(1, -(-n // every // QUERY_BLOCK))
    # Both sides' keys must have one type, or equal numbers go to different tasks.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    everyone = rows.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = rows.where(F.col("vec_id") % every == 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), block.alias("block")
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            ids, values = once(left.column("vec_id").to_numpy(), matrix(left.column("embedding"), d))
            query_ids, queries = once(right.column("vec_id").to_numpy(), matrix(right.column("embedding"), d))
            found = search(ids, scaled(values), query_ids, scaled(queries), k)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    keys = ["d", "part", "block"]
    met = (
        everyone.groupBy(*keys)
        .cogroup(asking.groupBy(*keys))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
