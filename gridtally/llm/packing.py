"""Best-fit packing of token pieces by large-item matching, over lengths instead of items.

How items pack depends on their lengths alone, so the driver sees only how many pieces
have each length: at most ``capacity`` numbers. It matches lengths above a third of the
capacity in pairs (no sequence holds three of them), longest first, each with the longest
partner that fits; shorter ones then fill the gaps, longest first, each into the smallest
gap that holds it. The result is a plan of ranges: pieces number k to k + n of a length go
to such sequences at such a place. Pieces are numbered within their length in parallel
and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import written
from gridtally.llm.tokens import encoder, id_cache

#: Pieces that one task numbers, about.
NUMBERED = 100_000
#: The column of a document's place in the order of its table, in pieces that have one.
ORDER = "_order"
#: So many low bits of it are within one range that a task numbers.
RANGE_BITS = 16


def stored_order(docs: DataFrame) -> Column:
    """A bigint in the order of the files of ``docs``, as Spark names them, and of their rows.

    A table that is not read from files has the order of its partitions.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    task, part = (F.regexp_extract(name, r"^part-(\d+)-.*?(?:-c(\d+))?\.", i) for i in (1, 2))
    number = [F.coalesce(n.try_cast("bigint"), F.lit(0).cast("bigint")) for n in (task, part)]
    return F.shiftleft(number[0], 44) + F.shiftleft(number[1], 34) + F.col("_metadata.row_index")


def token_pieces(
    docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, ordered: bool = False
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, and ``ORDER`` where it is asked for. The first
    piece takes what the full ones leave. A NULL text counts as empty; every row of ``docs``
    gives a piece at least.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, cache = encoder(path), id_cache(path)
        for batch in batches:
            where, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = ours.id_bytes(text.as_py() or "", cache) + tail
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                for i in range(len(edges) - 1):
                    a, b = edges[i], edges[i + 1]
                    where.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(where, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    *[c.take(pa.array(where, pa.int64())) for c in batch.columns[2:]],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", ORDER][: 5 + ordered],
            )

    order = [stored_order(docs).alias(ORDER)] if ordered else []
    return docs.select("doc_id", "text", *order).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + f", {ORDER} long" * ordered
    )


class Bins:
    """Runs of equally filled sequences by the gap they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.runs:
                insort(self.gaps, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, n))

    def new(self, n: int) -> int:
        self.made += n
        return self.made - n

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The run with the smallest gap that holds the length: gap, first, n."""
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, n = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.gaps[at]
        return gap, first, n


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Ranges (length, k, sequence, per sequence, offset), and the number of sequences.

    Piece k + i of the length goes to sequence + i // per, at offset + (i % per) * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    bins = Bins(capacity)

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        plan.append((length, used[length], first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for partner in large:
            if not left[length]:
                break
            if partner > min(length, capacity - length) or not left[partner]:
                continue
            if partner == length:
                pairs = left[length] // 2
                if pairs:
                    first = bins.new(pairs)
                    place(length, 2 * pairs, first, 2, 0)
                    bins.add(capacity - 2 * length, first, pairs)
                continue
            pairs = min(left[length], left[partner])
            first = bins.new(pairs)
            place(length, pairs, first, 1, 0)
            place(partner, pairs, first, 1, length)
            bins.add(capacity - length - partner, first, pairs)
        if left[length]:
            alone = left[length]
            first = bins.new(alone)
            place(length, alone, first, 1, 0)
            bins.add(capacity - length, first, alone)
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            found = bins.take(length)
            if found is None:
                n = -(-left[length] // (capacity // length))
                found = capacity, bins.new(n), n
            gap, first, n = found
            per = gap // length
            full = min(n, left[length] // per)
            rest = 0 if full == n else left[length] - full * per
            if full:
                place(length, full * per, first, per, capacity - gap)
                bins.add(gap - per * length, first, full)
            if rest:
                rest = min(rest, per)
                place(length, rest, first + full, per, capacity - gap)
                bins.add(gap - rest * length, first + full, 1)
                full += 1
            bins.add(gap, first + full, n - full)
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    return rows, bins.made


def best_fit_packing(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any columns).

    Every row gets a place; lengths run from 1 to ``capacity`` (others raise). Repeated
    rows are separate items. Places in a sequence are gapless from 0. An empty table gives
    an empty result. Columns named sequence_id or offset are replaced. ``pieces`` is read
    three times and should be a stored table.

    Where there is a column ``ORDER``, pieces of a length take their places in its order, and
    sequences are numbered in the order of their first pieces. It is not returned.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    plan, _ = packing_plan(counts, capacity)
    salts = max(16, sum(counts.values()) // NUMBERED)
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    order = [ORDER] if ORDER in columns else []
    salt = F.shiftright(ORDER, RANGE_BITS) if order else F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))
    salted = pieces.withColumn("_salt", salt)
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = W.partitionBy("length", "_salt").orderBy(*order, "doc_id", "piece")
    numbered = salted.withColumn("_row", F.row_number().over(within)).join(starts, ["length", "_salt"])
    k = (F.col("_before") + F.col("_row") - 1).alias("_k")
    ready = numbered.select(*columns, k)
    at = len(columns)
    length_at = columns.index("length")
    keys = (plan[:, 0] << 44) + plan[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            row = plan[np.searchsorted(keys, (length << 44) + number, side="right") - 1]
            i = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:at],
                    pa.array(row[:, 2] + i // row[:, 3], pa.int64()),
                    pa.array(row[:, 4] + i % row[:, 3] * length, pa.int64()),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ready.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")
    return sequences_in_order(placed) if order else placed


def sequences_in_order(placed: DataFrame) -> DataFrame:
    """Placed pieces with their sequences numbered anew, by ``ORDER`` of the piece at offset 0."""
    placed = written(placed, "placed")
    heads = placed.where(F.col("offset") == 0).select(
        F.shiftright(ORDER, RANGE_BITS).alias("_range"), ORDER, "piece", F.col("sequence_id").alias("_old")
    )
    # A row for each range of the order: of the files, and of every 65,536 rows in one.
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        heads.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    own = F.row_number().over(W.partitionBy("_range").orderBy(ORDER, "piece", "_old")) - 1
    numbers = heads.withColumn("_own", own).join(starts, "_range").select("_old", (F.col("_before") + F.col("_own")).alias("_new"))
    return (
        placed.join(numbers, placed["sequence_id"] == numbers["_old"])
        .withColumn("sequence_id", F.col("_new"))
        .select(*[c for c in placed.columns if c != ORDER])
    )


def packed_documents(docs: DataFrame, path: str, *, capacity: int = 2048, ordered: bool = False) -> DataFrame:
    """Pieces of all documents with their places, tokenised once; ``ordered``: in the order of ``docs``."""
    pieces = written(token_pieces(docs, path, capacity=capacity, ordered=ordered), "pieces")
    return best_fit_packing(pieces, capacity=capacity)
