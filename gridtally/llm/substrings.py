"""Exact substring deduplication from fixed-block anchors.

Every run of 20 words holds a whole block of 10 that starts at a multiple of 10 in its
document. Those blocks are the index; each rolling window of 10 words of every document
probes it. A probe that meets a block elsewhere is an anchor, and only the 20-word windows
around anchors are compared in full: the later ones of equal windows, joined where they
overlap, are the later copies of the maximal exact repeats.

Probes and windows travel as blobs, one for each chunk and bucket of hashes, in which hashes,
places and ids are stored byte by byte. A chunk that holds a hash several times
sends two of them at most, so what a task receives of one hash grows with the number of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import written
from gridtally.llm.words import dealt, split_words, windows, word_hashes

WINDOW = 20
#: Probes that are sorted at once and that a task of the index holds, about; bytes of
#: text that a task of the comparison holds, about.
CHUNK = 800_000
BUCKET = 2_000_000
TEXTS = 8_000_000
#: Inner ids of rows without a doc_id begin here: after all others.
NO_ID = 1 << 62
#: Bits that tell texts of one doc_id apart, where some doc_id has several.
TIE_BITS = 24

FLAG, PROBE, TEXT = 0, 1, 2
SCHEMA = "kind int, bucket long, dest long, hashes binary, places binary, ids binary, counts binary"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def by_byte(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: like bytes compress together."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_bytes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(blob, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def destination(ids: np.ndarray, parts: int) -> np.ndarray:
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


class Rows:
    """Collects rows of SCHEMA."""

    def __init__(self):
        self.rows: list[tuple] = []

    def places(
        self, kind: int, bucket: int, dest: int, hashes: np.ndarray, ids: np.ndarray, at: np.ndarray
    ) -> None:
        """One row of entries (hash, id, place), in order of id and place."""
        order = np.lexsort([at, ids])
        ids, at = ids[order], at[order].astype(np.uint32)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        names = np.diff(ids[first], prepend=0)
        counts = np.diff(np.r_[first, len(ids)]).astype(np.uint32)
        blob = by_byte(hashes[order]) if len(hashes) else b""
        self.rows.append((kind, bucket, dest, blob, by_byte(at), by_byte(names), by_byte(counts)))

    def spread(self, kind: int, ids: np.ndarray, at: np.ndarray, parts: int, buckets: int) -> None:
        """Entries without hashes, one row for each destination of their ids."""
        if not len(ids):
            return
        dest = destination(ids, parts)
        order = np.argsort(dest, kind="stable")
        edges = np.flatnonzero(np.r_[True, dest[order][1:] != dest[order][:-1], True])
        none = np.zeros(0, np.uint64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = order[a:b]
            where = int(dest[mine[0]])
            self.places(kind, where % buckets, where, none, ids[mine], at[mine])

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in NAMES]
        kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def entries(table: pa.Table, kind: int, hashes: type | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and places of all rows of a kind."""
    chosen = table.filter(pc.equal(table.column("kind"), kind)) if table.num_rows else table
    found, ids, at = [], [], []
    for h, p, i, c in zip(*(chosen.column(n).to_pylist() for n in NAMES[3:]), strict=True):
        if hashes is not None:
            found.append(from_bytes(h, hashes))
        at.append(from_bytes(p, np.uint32))
        names = np.cumsum(from_bytes(i, np.int64))
        ids.append(np.repeat(names, from_bytes(c, np.uint32)))
    if not at:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(ids), np.concatenate(at)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True]) if len(sorted_values) else np.zeros(1, np.int64)


def anchors(hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Which entries have a hash that occurs twice, once at least as an indexed block.

    An indexed block is a probe as well, so it takes another occurrence to make two.
    """
    order = np.argsort(hashes, kind="stable")
    edges = runs(hashes[order])
    counts = np.diff(edges)
    if not len(counts):
        return np.zeros(0, bool)
    indexed = np.add.reduceat((at[order] % block == 0).astype(np.int64), edges[:-1]) > 0
    out = np.empty(len(hashes), bool)
    out[order] = np.repeat(indexed & (counts > 1), counts)
    return out


def probes(docs: DataFrame, block: int, buckets: int, parts: int) -> DataFrame:
    """PROBE rows by bucket of hash, and FLAG rows of anchors that a chunk shows by itself."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, np.ndarray]] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            h = np.concatenate([w for _, w in waiting])
            sizes = [len(w) for _, w in waiting]
            ids = np.repeat(np.array([i for i, _ in waiting], np.int64), sizes)
            at = np.concatenate([np.arange(n, dtype=np.int64) for n in sizes])
            rows = Rows()
            here = anchors(h, at, block)
            rows.spread(FLAG, ids[here], at[here], parts, buckets)
            # Of an anchor's hash two entries are enough for others, one of them a block.
            seen = np.flatnonzero(here)
            order = seen[np.lexsort([at[seen] % block != 0, h[seen]])]
            edges = runs(h[order])[:-1] if len(order) else np.zeros(0, np.int64)
            keep = ~here
            keep[order[edges]] = True
            keep[order[edges + 1]] = True
            h, ids, at = h[keep], ids[keep], at[keep]
            order, edges = dealt(h, buckets)
            # With the bits that a bucket stands for, 32 are enough to find anchors: one that
            # is none only adds windows to compare, about one for ten thousand probes.
            short = (h // np.uint64(buckets)).astype(np.uint32)
            for b in np.flatnonzero(np.diff(edges)):
                mine = order[edges[b] : edges[b + 1]]
                rows.places(PROBE, int(b), 0, short[mine], ids[mine], at[mine])
            waiting.clear()
            return rows.batch()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                if len(words) >= 2 * block:
                    waiting.append((doc, windows(word_hashes(words), block)))
                    total += len(words)
                    if total >= CHUNK:
                        total = 0
                        yield chunk()
        if waiting:
            yield chunk()

    return docs.mapInArrow(send, SCHEMA)


def met(sent: DataFrame, block: int, buckets: int, parts: int) -> DataFrame:
    """FLAG rows by destination: the anchors of all chunks."""

    def meet(table: pa.Table) -> pa.Table:
        rows = Rows()
        h, ids, at = entries(table, PROBE, np.uint32)
        here = anchors(h, at, block)
        rows.spread(FLAG, ids[here], at[here], parts, buckets)
        own = pa.Table.from_batches([rows.batch()])
        passed = table.filter(pc.equal(table.column("kind"), FLAG))
        return pa.concat_tables([own, passed.cast(own.schema)])

    return sent.groupBy("bucket").applyInArrow(meet, SCHEMA)


def text_row(bucket: int, dest: int, ids: list[int], texts: list[bytes], squeeze: zstandard.ZstdCompressor) -> tuple:
    """Texts of one destination in one blob: together they compress better than alone."""
    sizes = np.array([len(t) for t in texts], np.uint32)
    blob = squeeze.compress(b"".join(texts))
    return TEXT, bucket, dest, blob, by_byte(sizes), by_byte(np.array(ids, np.int64)), b""


def texts_of(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Ids and texts of the TEXT rows."""
    grow = zstandard.ZstdDecompressor()
    columns = (table.column(n).to_pylist() for n in ("kind", "hashes", "places", "ids"))
    for kind, blob, sizes, ids in zip(*columns, strict=True):
        if kind == TEXT:
            raw, at = grow.decompress(blob), 0
            for doc, size in zip(from_bytes(ids, np.int64).tolist(), from_bytes(sizes, np.uint32).tolist(), strict=True):
                yield doc, raw[at : at + size]
                at += size


def packed_texts(docs: DataFrame, parts: int) -> DataFrame:
    """TEXT rows by destination, one for each batch and destination."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            dest = destination(ids, parts)
            order = np.argsort(dest, kind="stable")
            edges = runs(dest[order])
            rows = Rows()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = order[a:b].tolist()
                texts = [(batch.column(1)[k].as_py() or "").encode() for k in mine]
                rows.rows.append(text_row(0, int(dest[mine[0]]), ids[mine].tolist(), texts, squeeze))
            yield rows.batch()

    return docs.mapInArrow(pack, SCHEMA)


def by_id(ids: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], at[order]
    edges = runs(ids)
    return {int(ids[a]): at[a:b].astype(np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True)} if len(ids) else {}


def later(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first of their hash, and which start after it."""
    order = np.lexsort([at, ids, hashes])
    edges = runs(hashes[order])
    first = np.zeros(len(hashes), bool)
    if not len(order):
        return first, first.copy()
    first[order[edges[:-1]]] = True
    lead = np.repeat(order[edges[:-1]], np.diff(edges))
    late = np.zeros(len(hashes), bool)
    late[order] = (ids[order] != ids[lead]) | (at[order] != at[lead])
    return first, late


def around_anchors(texts: DataFrame, flags: DataFrame, window: int, buckets: int, parts: int) -> DataFrame:
    """PROBE rows of the full windows around anchors, FLAG rows of those that a task shows to be
    later, and TEXT rows of their documents."""
    block = window // 2

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = Rows()
        _, ids, at = entries(right, FLAG, None)
        wanted = by_id(ids, at)
        names, found, places, texts = [], [], [], []
        for doc, text in texts_of(left):
            if doc not in wanted:
                continue
            h = windows(word_hashes(text.split()), window)
            if not len(h):
                continue
            anchor = wanted[doc]
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, np.clip(anchor - block + 1, 0, len(h)), 1)
            np.add.at(step, np.clip(anchor + 1, 0, len(h)), -1)
            near = np.flatnonzero(np.cumsum(step[:-1]))
            if len(near):
                names.append(np.full(len(near), doc, np.int64))
                found.append(h[near])
                places.append(near)
                texts.append(text)
        if names:
            where = left.column("dest")[0].as_py()
            docs = [int(n[0]) for n in names]
            rows.rows.append(text_row(where % buckets, where, docs, texts, zstandard.ZstdCompressor(level=3)))
            h, ids, at = map(np.concatenate, (found, names, places))
            first, late = later(h, ids, at)
            rows.spread(FLAG, ids[late], at[late], parts, buckets)
            h, ids, at = h[first], ids[first], at[first]
            order, edges = dealt(h, buckets)
            for b in np.flatnonzero(np.diff(edges)):
                mine = order[edges[b] : edges[b + 1]]
                rows.places(PROBE, int(b), 0, h[mine], ids[mine], at[mine])
        return pa.Table.from_batches([rows.batch()])

    return texts.groupBy("dest").cogroup(flags.groupBy("dest")).applyInArrow(compare, SCHEMA)


def repeats(sent: DataFrame, buckets: int, parts: int) -> DataFrame:
    """FLAG rows of all windows that are later than an equal one, and the TEXT rows."""

    def compare(table: pa.Table) -> pa.Table:
        rows = Rows()
        h, ids, at = entries(table, PROBE, np.uint64)
        _, late = later(h, ids, at)
        rows.spread(FLAG, ids[late], at[late], parts, buckets)
        own = pa.Table.from_batches([rows.batch()])
        passed = table.filter(pc.not_equal(table.column("kind"), PROBE))
        return pa.concat_tables([own, passed.cast(own.schema)])

    return sent.groupBy("bucket").applyInArrow(compare, SCHEMA)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def cut(found: DataFrame, window: int) -> DataFrame:
    """doc, whole_sha256, n_removed, kept_sha256 and kept (words) of documents with repeats."""

    def apply(table: pa.Table) -> pa.Table:
        _, ids, at = entries(table, FLAG, None)
        wanted = by_id(ids, at)
        out: dict[tuple[int, str], tuple[int, str, str]] = {}
        for doc, text in texts_of(table):
            if doc not in wanted:
                continue
            words = text.split()
            step = np.zeros(len(words) + 1, np.int64)
            late = wanted[doc][wanted[doc] + window <= len(words)]
            np.add.at(step, late, 1)
            np.add.at(step, late + window, -1)
            covered = np.cumsum(step[:-1]) > 0
            kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            out[doc, digest(words)] = int(covered.sum()), digest(kept), b" ".join(kept).decode()
        keys, values = list(out), list(out.values())
        return pa.table(
            [
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([v[0] for v in values], pa.int64()),
                pa.array([v[1] for v in values], pa.string()),
                pa.array([v[2] for v in values], pa.string()),
            ],
            names=["doc", "whole_sha256", "n_removed", "kept_sha256", "kept"],
        )

    return found.groupBy("dest").applyInArrow(
        apply, "doc long, whole_sha256 string, n_removed long, kept_sha256 string, kept string"
    )


def whole(docs: DataFrame) -> DataFrame:
    """doc, doc_id, n_words and whole_sha256 of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_words(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([digest(w) for w in words], pa.string()),
                ],
                names=["doc", "doc_id", "n_words", "whole_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(of, f"doc long, doc_id {kind}, n_words long, whole_sha256 string")


def repeated_passages(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Documents that lose words: the frame that ``cut`` returns.

    A word goes if some window of ``window`` words that covers it also starts earlier: in a
    document with a smaller doc_id, or earlier in its own. See ``substring_dedup``.
    """
    if window % 2 or window < 2:
        raise ValueError("the window must be an even number of words")
    texts = numbered(docs).select("doc", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // 6 // BUCKET)
    parts = max(64, size // TEXTS)
    flags = met(probes(texts, window // 2, buckets, parts), window // 2, buckets, parts)
    sent = around_anchors(packed_texts(texts, parts), flags, window, buckets, parts)
    return cut(repeats(sent, buckets, parts), window)


def numbered(docs: DataFrame) -> DataFrame:
    """doc, text, doc_id: ``doc`` is an inner id, one for each distinct doc_id and text, in order of doc_id.

    It is the doc_id itself where every one has a single text. Else the text's hash stands in
    its low bits, so that texts of one doc_id are documents of their own. Rows without a
    doc_id come last, told apart by 62 bits of the hash. Where doc_ids leave no room for
    that, the sorted pairs of doc_id and hash are numbered and joined.
    """
    number, text_hash = F.col("doc_id").cast("long"), F.xxhash64("text")
    none = F.lit(NO_ID) + F.shiftrightunsigned(text_hash, 2)
    ids = docs.select(number.alias("number"), text_hash.alias("hash")).where(F.col("number").isNotNull())
    several = ids.groupBy("number").agg((F.min("hash") != F.max("hash")).alias("several"))
    facts = several.agg(F.min("number"), F.max("number"), F.max("several")).first()
    least, most, tie = facts[0] or 0, facts[1] or 0, TIE_BITS if facts[2] else 0
    if most - least < NO_ID >> tie and (tie or -NO_ID <= least <= most < NO_ID):
        low = text_hash.bitwiseAND(F.lit((1 << tie) - 1))
        inner = F.shiftleft(number - least, tie) + low if tie else number
        return docs.select(F.coalesce(inner, none).alias("doc"), "text", "doc_id")
    order = written(ids.distinct().orderBy("number", "hash").select("*", F.monotonically_increasing_id().alias("place")), "ids")
    keyed = docs.select(number.alias("number"), text_hash.alias("hash"), "text", "doc_id").join(order, ["number", "hash"], "left")
    return keyed.select(F.coalesce("place", F.lit(NO_ID) + F.shiftrightunsigned("hash", 2)).alias("doc"), "text", "doc_id")


def substring_dedup(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, one row for each row of ``docs``.

    Words are what stands between ASCII white space. A NULL or empty text, and one shorter
    than the window, loses nothing. Rows with one doc_id and the same text are one document:
    they get the same result and do not remove each other's words. Different texts of one
    doc_id are documents in the order of their hashes. doc_id must be a whole number; rows
    without one come after all others, in the order of their texts' hashes. Other columns
    are not read; an empty table gives an empty result.
    """
    found = repeated_passages(docs, window=window).drop("kept")
    rows = whole(numbered(docs)).join(found, ["doc", "whole_sha256"], "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
