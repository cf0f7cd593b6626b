"""Exact token ids and counts of whole texts through tables of pre-token lengths.

A byte-level BPE splits a text into pre-tokens and merges within each, so equal
pre-tokens have equal ids wherever they stand. Texts are cut at single spaces first: a
space before a character that is no white space always starts a pre-token, and what
follows up to the next such space is a whole number of pre-tokens. Such a run is the key
of both tiers. A text where a space is followed by white space or by its end, or that
holds the string of an added token, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table and documents whose runs are counted to fill it. They
#: bound the broadcast and only affect speed: a run that is not in it is encoded.
TABLE_ENTRIES = 65_536
TABLE_DOCUMENTS = 2_000
#: Entries that a worker keeps beside the table; beyond them it starts over.
CACHE_ENTRIES = 400_000


class NotSplittable(Exception):
    """The run starts with white space or is empty; the text must be encoded whole."""


class Cache(dict):
    """Run to value; a missing run is encoded and kept, up to a number of entries."""

    def __init__(self, encode, first: dict, limit: int):
        super().__init__(first)
        self.encode, self.first, self.limit = encode, first, limit + len(first)

    def __missing__(self, run: str):
        if not run or run[0].isspace():
            raise NotSplittable
        value = self.encode(" " + run)
        if len(self) >= self.limit:
            self.clear()
            self.update(self.first)
        if len(run) <= 64:
            self[run] = value
        return value


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others for the characters from 256 on, in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes to id if the file is a plain byte-level BPE whose ids follow its merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and not spec.get("normalizer")
        and not spec.get("truncation")
        and not spec.get("padding")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
    )
    if not plain:
        return None
    alphabet = byte_alphabet()
    ranks = {}
    for token, number in model["vocab"].items():
        if all(c in alphabet for c in token):
            ranks[bytes(alphabet[c] for c in token)] = number
    last = -1
    for merge in model["merges"]:
        pair = "".join(merge.split(" ") if isinstance(merge, str) else merge)
        number = model["vocab"][pair]
        if number <= last:
            return None
        last = number
    return ranks


class Encoder:
    """Ids and counts as the tokenizer's own library gives them."""

    PATTERN = (
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    )

    def __init__(self, path: str):
        self.ranks = self.added = None
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = pieces.encode
            return
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.library = path, None
        self.whole = self.by_library
        self.added = [token["content"] for token in spec.get("added_tokens", ())]
        self.ranks = byte_level_ranks(spec)
        if self.ranks:
            import tiktoken

            self.merge = tiktoken.Encoding(
                "byte_level",
                pat_str=self.PATTERN,
                mergeable_ranks=self.ranks,
                special_tokens={},
            ).encode_ordinary

    def by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def splits(self, text: str) -> bool:
        return bool(self.ranks) and not any(token in text for token in self.added)

    def id_bytes(self, text: str, cache: Cache) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.splits(text):
            return packed(self.whole(text))
        head, *runs = text.split(" ")
        try:
            return packed(self.merge(head)) + b"".join(map(cache.__getitem__, runs))
        except NotSplittable:
            return packed(self.merge(text))

    def count(self, text: str, cache: Cache) -> int:
        if not self.splits(text):
            return len(self.whole(text))
        head, *runs = text.split(" ")
        try:
            return len(self.merge(head)) + sum(map(cache.__getitem__, runs))
        except NotSplittable:
            return len(self.merge(text))

    def id_cache(self, limit: int = CACHE_ENTRIES) -> Cache:
        return Cache(lambda run: packed(self.merge(run)), {}, limit)

    def length_cache(self, first: dict[str, int], limit: int = CACHE_ENTRIES) -> Cache:
        return Cache(lambda run: len(self.merge(run)), first, limit)


def packed(ids: list[int]) -> bytes:
    from array import array

    out = array("I", ids)
    assert out.itemsize == 4
    return out.tobytes()


_ENCODERS: dict[str, Encoder] = {}
_CACHES: dict[tuple, Cache] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_cache(path: str) -> Cache:
    key = (path, "ids")
    if key not in _CACHES:
        _CACHES[key] = encoder(path).id_cache()
    return _CACHES[key]


def frequent_lengths(
    docs: DataFrame,
    path: str,
    *,
    entries: int = TABLE_ENTRIES,
    sample: int = TABLE_DOCUMENTS,
) -> tuple[str, bytes]:
    """The compact table: runs joined by NUL, and one length byte for each.

    It holds the most frequent runs of about ``sample`` documents drawn from all of them.
    Both numbers bound it whatever the size of the corpus; no result depends on what it
    holds. Lengths above 255 are left out.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split(" ")[1:])
        ours = encoder(path)
        rows = []
        for run, n in seen.most_common(entries):
            if run and not run[0].isspace() and "\0" not in run and len(run) <= 64:
                length = len(ours.merge(" " + run))
                if length < 256:
                    rows.append((run, n, length))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int32()),
            ],
            names=["run", "n", "length"],
        )

    if not encoder(path).ranks:
        return "", b""
    share = sample / max(1, docs.count())
    chosen = docs.where(F.rand(7) < share).where(F.col("text").isNotNull()).select("text")
    rows = (
        chosen.mapInArrow(runs, "run string, n long, length int")
        .groupBy("run", "length")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "run")
        .limit(entries)
        .collect()
    )
    return "\0".join(r.run for r in rows), bytes(r.length for r in rows)


def token_counts(
    docs: DataFrame,
    path: str,
    *,
    limit: int = 1024,
    table: tuple[str, bytes] | None = None,
) -> DataFrame:
    """Tokens of every whole text, by a broadcast table and worker caches.

    Returns doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), one row
    for each row of ``docs``, repeated rows included. A NULL or empty text has none. A
    NULL doc_id stays NULL. Other columns of ``docs`` are not read. An empty table gives
    an empty result. There is no shuffle: texts stay where they are read.
    """
    words, lengths = table if table is not None else frequent_lengths(docs, path)
    shared = docs.sparkSession.sparkContext.broadcast((words, lengths))
    key = (path, zlib.crc32(words.encode() + lengths), "lengths")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = encoder(path)
        if key not in _CACHES:
            for old in [k for k in _CACHES if k[-1] == "lengths"]:
                del _CACHES[old]
            names, sizes = shared.value
            first = dict(zip(names.split("\0"), sizes, strict=True)) if sizes else {}
            _CACHES[key] = ours.length_cache(first)
        cache = _CACHES[key]
        for batch in batches:
            counts = [ours.count(t.as_py(), cache) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )

