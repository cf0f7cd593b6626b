"""Tokens of one text under two vocabularies, cut into groups that begin and end together.

Both token sequences cover the same bytes, so a token is a range of them, and the ranges of
a whole batch of texts are two sorted lists of ends. Every token points to the token of the
other sequence that reaches farthest to the right among those it overlaps; the last token
of a group points to itself. Following pointers by doubling (each round replaces a pointer
by its pointer's pointer) ends at the group's last token after as many rounds as the
logarithm of its longest chain, and that token labels the group.

Linked id pairs are counted by documents over the whole corpus. Most occurrences belong to
frequent pairs, whose counts every task has in a table of bounded size. The others are
joined with the full counts, as one row for each text and pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import written
from gridtally.llm.pieces import BLANK
from gridtally.llm.tokens import NotSplittable, encoder

#: Pairs whose counts every task has (twelve bytes each). It bounds the broadcast and only
#: affects speed: pairs beyond it are joined.
TABLE_PAIRS = 500_000
#: Bytes of packed ids that are aligned in one go, unless one text has more.
BATCH_BYTES = 1_000_000
#: Pairs that a task counts before it hands its counts on.
COUNTED_PAIRS = 500_000
#: Runs between blanks whose byte-level ids a worker keeps; beyond them it starts over.
CACHE_RUNS = 150_000

ROW = "_alignment_row"


class ByteVocabulary:
    """Ids of a byte-level vocabulary, and the bytes of each."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        if not self.encoder.ranks:
            raise ValueError("a plain byte-level vocabulary is needed")
        self.cache = self.encoder.id_cache(CACHE_RUNS)
        self.size = max(self.encoder.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, number in self.encoder.ranks.items():
            self.bytes[number] = token
        self.opens = np.array([token[:1] == b" " for token in self.bytes])

    def ids(self, text: str) -> np.ndarray:
        """Ids of a blank and the text; strings of added tokens are plain text.

        Tokens are pieces of the text's bytes, so they add up to it.
        """
        runs = text.split(" ")
        parts = list(map(self.cache.get, runs))
        if None in parts:
            try:
                new = self.encoded(list(dict.fromkeys(run for run, part in zip(runs, parts) if part is None)))
            except NotSplittable:
                return np.array(self.encoder.merge(" " + text), "<u4")
            parts = [new[run] if part is None else part for run, part in zip(runs, parts)]
            self.keep(new)
        return np.frombuffer(b"".join(parts), "<u4")

    def encoded(self, runs: list[str]) -> dict[str, bytes]:
        """Each run's packed ids, from one call: a run holds no blank, so a token that begins with one opens a run."""
        if any(not run or run[0].isspace() for run in runs):
            raise NotSplittable
        ids = np.array(self.encoder.merge(" " + " ".join(runs)), "<u4")
        cuts = (4 * np.append(np.flatnonzero(self.opens[ids]), len(ids))).tolist()
        packed = ids.tobytes()
        return dict(zip(runs, (packed[a:b] for a, b in pairwise(cuts)), strict=True))

    def keep(self, new: dict[str, bytes]) -> None:
        """Kept up to the cache's limit; where they do not fit beside the others, it starts over."""
        if len(self.cache) + len(new) > self.cache.limit:
            self.cache.clear()
        self.cache.update(islice(((run, ids) for run, ids in new.items() if len(run) <= 64), self.cache.limit))


class PieceBytes:
    """Ids of a piece vocabulary that begins a text with a blank, and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = pieces.vocab_size()
        self.bytes = [
            bytes([int(name[1:-1], 16)]) if pieces.is_byte(i) else name.replace(BLANK, " ").encode()
            for i, name in enumerate(pieces.id_to_piece(list(range(self.size))))
        ]

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of the text; None where they do not add up to a blank and the text."""
        ids = self.library.encode(text)
        if b"".join(map(self.bytes.__getitem__, ids)) != (" " + text).encode():
            return None
        return np.array(ids, "<u4")


_SIDES: dict[tuple, ByteVocabulary | PieceBytes] = {}


def sides(first: str, second: str) -> tuple[ByteVocabulary, PieceBytes]:
    """Both vocabularies, one of each per worker process."""
    for kind, path in ((ByteVocabulary, first), (PieceBytes, second)):
        if (kind, path) not in _SIDES:
            _SIDES[kind, path] = kind(path)
    return _SIDES[ByteVocabulary, first], _SIDES[PieceBytes, second]


def narrow(size: int) -> str:
    """The smallest number type that holds ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A written table: a number for each row, doc_id, and both id sequences as packed numbers.

    Texts that are NULL or empty have none, nor have those whose tokens do not add up to a
    blank and the text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(first, second)
        small = narrow(one.size), narrow(two.size)
        for batch in batches:
            packed: tuple[list[bytes], list[bytes]] = ([], [])
            for value in batch.column(1):
                text = value.as_py()
                ids = two.ids(text) if text else None
                both = (one.ids(text), ids) if ids is not None else (np.zeros(0, "<u4"),) * 2
                for out, side, dtype in zip(packed, both, small):
                    out.append(side.astype(dtype).tobytes())
            columns = [batch.column(0), *(pa.array(p, pa.binary()) for p in packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b"])

    rows = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, a binary, b binary")
    return written(rows.select(F.monotonically_increasing_id().alias(ROW), "*"), "tokenised")


class Aligned:
    """Groups and links of several texts at once; texts meet at common ends, so none mixes."""

    def __init__(self, a: list[bytes], b: list[bytes], one: ByteVocabulary, two: PieceBytes, lengths):
        self.one, self.two, self.n = one, two, len(a)
        self.ids = [np.frombuffer(b"".join(x), narrow(s.size)).astype(np.int64) for x, s in ((a, one), (b, two))]
        sizes = [np.dtype(narrow(s.size)).itemsize for s in (one, two)]
        self.counts = [np.array([len(r) // z for r in x], np.int64) for x, z in ((a, sizes[0]), (b, sizes[1]))]
        self.doc = [np.repeat(np.arange(self.n), c) for c in self.counts]
        self.ends = [np.cumsum(width[i]) for width, i in zip(lengths, self.ids)]

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """Each token's group as the place of the group's last B token, by pointer doubling."""
        ea, eb = self.ends
        na = len(ea)
        to_b = np.searchsorted(eb, ea, "left")
        to_a = np.searchsorted(ea, eb, "left")
        own = np.arange(len(eb))
        last = ea[to_a] == eb if na else np.zeros(0, bool)
        successor = np.concatenate([na + to_b, np.where(last, na + own, to_a)])
        while True:
            further = successor[successor]
            if np.array_equal(further, successor):
                break
            successor = further
        return successor[:na] - na, successor[na:] - na

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of A and of B, one for each pair of tokens whose ranges overlap."""
        ea, eb = self.ends
        starts = np.concatenate([[0], ea[:-1]]) if len(ea) else ea
        low = np.searchsorted(eb, starts, "right")
        many = np.searchsorted(eb, ea, "left") - low + 1
        a = np.repeat(np.arange(len(ea)), many)
        within = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        return a, np.repeat(low, many) + within

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair as one number, and occurrences: one row for each text and pair."""
        a, b = self.links()
        pair = self.ids[0][a] * self.two.size + self.ids[1][b]
        space = np.uint64(self.one.size * self.two.size)
        key, times = np.unique(self.doc[0][a].astype(np.uint64) * space + pair.astype(np.uint64), return_counts=True)
        return (key // space).astype(np.int64), (key % space).astype(np.int64), times

    def groups(self, a: np.ndarray, b: np.ndarray) -> Iterator[memoryview]:
        """Each text's groups as ids: A's joined by commas, a bar, B's; groups by semicolons.

        All are written one behind the other, and each text has its part of these bytes.
        """
        last = b == np.arange(len(b))
        of_b = np.cumsum(last) - last
        number = of_b[a], of_b
        made = np.count_nonzero(last)
        before_b = np.concatenate([[0], np.cumsum(np.bincount(number[1], minlength=made))])
        before_a = np.concatenate([[0], np.cumsum(np.bincount(number[0], minlength=made))])
        codes = np.empty(len(a) + len(b), np.int64)
        for place, first, ids, mine in (
            (np.arange(len(a)) + before_b[number[0]], 0, self.ids[0], number[0]),
            (np.arange(len(b)) + before_a[number[1] + 1], 2 * self.one.size, self.ids[1], number[1]),
        ):
            closing = np.append(mine[1:] != mine[:-1], True) if len(mine) else np.zeros(0, bool)
            codes[place] = first + 2 * ids + closing
        written = written_ids(self.one.size, self.two.size).take(pa.array(codes))
        _, offsets, data = written.buffers()
        text = memoryview(data or b"")
        tokens = np.append(0, np.cumsum(self.counts[0] + self.counts[1]))
        for start, end in pairwise(np.frombuffer(offsets, "<i8")[tokens].tolist()):
            yield text[start : max(start, end - 1)]


_WRITTEN: dict[tuple[int, int], pa.Array] = {}


def written_ids(*sizes: int) -> pa.Array:
    """Each id of A followed by a comma or a bar, then each of B by a comma or a semicolon."""
    if sizes not in _WRITTEN:
        ids = (f"{i}{sign}" for size, signs in zip(sizes, (",|", ",;")) for i in range(size) for sign in signs)
        _WRITTEN[sizes] = pa.array(ids, pa.large_string())
    return _WRITTEN[sizes]


def aligned(batch: pa.RecordBatch, first: str, second: str, lengths) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """The batch in slices of bounded size, each with its alignment."""
    one, two = sides(first, second)
    a, b = batch.column("a"), batch.column("b")
    start = size = 0
    for i in range(batch.num_rows):
        size += len(a[i].as_buffer()) + len(b[i].as_buffer())
        if size >= BATCH_BYTES or i + 1 == batch.num_rows:
            rows = batch.slice(start, i + 1 - start)
            yield rows, Aligned(rows.column("a").to_pylist(), rows.column("b").to_pylist(), one, two, lengths())
            start, size = i + 1, 0


def token_lengths(first: str, second: str) -> Callable[[], list[np.ndarray]]:
    """How to get the bytes of each id of both vocabularies."""
    kept: list[np.ndarray] = []

    def lengths() -> list[np.ndarray]:
        if not kept:
            kept.extend(np.array(list(map(len, side.bytes)), np.int64) for side in sides(first, second))
        return kept

    return lengths


def pair_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """pair and n, the documents that hold it linked; summed in each task before the shuffle."""
    lengths = token_lengths(first, second)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate([p for p, _ in kept]), return_inverse=True)
            return pair, np.bincount(at, np.concatenate([n for _, n in kept])).astype(np.int64)

        def out(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for _, texts in aligned(batch, first, second, lengths):
                pair, n = np.unique(texts.pairs()[1], return_counts=True)
                kept.append((pair, n))
                size += len(pair)
                if size > COUNTED_PAIRS:
                    kept = [added()]
                    size = len(kept[0][0])
                    if size > COUNTED_PAIRS // 2:
                        yield out(*kept.pop())
                        size = 0
        if kept:
            yield out(*added())

    return rows.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def marked_best(counts: DataFrame, second_size: int) -> DataFrame:
    """pair, n and best: no pair of the same A id has a larger n. Ties are all best.

    An A id has as many pairs as the second vocabulary has ids at most.
    """
    a = F.floor(F.col("pair") / F.lit(second_size)).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned_groups(
    docs: DataFrame, first: str, second: str, *, table_pairs: int = TABLE_PAIRS
) -> DataFrame:
    """Groups and links of the tokens of two vocabularies, for every whole text.

    ``first`` is a byte-level vocabulary, applied to a blank and the text; ``second`` a piece
    vocabulary that begins a text with a blank itself. Returns doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose pair has the largest count of its A id), count_sum (counts
    added over links), groups_sha256 of the groups' ids: one row for each row of ``docs``.
    A repeated row is a document of its own, in counts too. NULL and empty texts, and those
    whose tokens do not add up to a blank and the text, have zeros and an empty string. A
    NULL doc_id stays NULL. Ties in counts are all best. Other columns are not read, so
    their names do not matter. An empty table gives an empty result.
    """
    rows = tokenised(docs, first, second)
    size = sides(first, second)[1].size
    counts = written(marked_best(pair_counts(rows, first, second), size), "pairs")
    frequent = counts.orderBy(F.desc("n"), "pair").limit(table_pairs).toArrow().sort_by("pair")
    table = [frequent.column(c).to_numpy() for c in ("pair", "n", "best")]
    table[1] = table[1] * 2 + table[2]
    shared = docs.sparkSession.sparkContext.broadcast(table[:2])
    lengths = token_lengths(first, second)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            for slice_, texts in aligned(batch, first, second, lengths):
                ga, gb = texts.labels()
                doc, pair, times = texts.pairs()
                at = np.searchsorted(known, pair)
                hit = np.zeros(len(pair), bool)
                inside = at < len(known)
                hit[inside] = known[at[inside]] == pair[inside]
                value = values[at[hit]]
                n = texts.n

                def added(weights, of=doc[hit]):
                    return pa.array(np.bincount(of, weights, n).astype(np.int64))

                sums = np.zeros(n, np.int64)
                np.add.at(sums, doc[hit], times[hit] * (value >> 1))
                missed = ~hit
                cuts = np.searchsorted(doc[missed], np.arange(n + 1)).astype(np.int32)
                fields = [pa.array(pair[missed]), pa.array(times[missed].astype(np.int64))]
                misses = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(fields, ["pair", "times"]))
                last_b = np.bincount(texts.doc[1][gb == np.arange(len(gb))], minlength=n).astype(np.int64)
                links = np.bincount(doc, times, n).astype(np.int64)
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in texts.groups(ga, gb)]
                columns = {
                    ROW: slice_.column(ROW),
                    "doc_id": slice_.column("doc_id"),
                    "n_a": pa.array(texts.counts[0]),
                    "n_b": pa.array(texts.counts[1]),
                    "n_groups": pa.array(last_b),
                    "n_links": pa.array(links),
                    "n_best": added(times[hit] * (value & 1)),
                    "count_sum": pa.array(sums),
                    "groups_sha256": pa.array(digests, pa.string()),
                    "misses": misses,
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(
        rows.mapInArrow(
            score,
            f"{ROW} long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
            "count_sum long, groups_sha256 string, misses array<struct<pair:long,times:long>>",
        ),
        "scored",
    )
    rare = (
        scored.select(ROW, F.inline("misses"))
        .join(counts, "pair")
        .groupBy(ROW)
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    return scored.join(rare, ROW, "left").select(
        "doc_id",
        *("n_a", "n_b", "n_groups", "n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
