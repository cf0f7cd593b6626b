"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The library merges adjacent symbols, best score first and leftmost among equals, as long
as their concatenation is a piece. Its result is the only sequence of tokens in which the
two tokens of every adjacent pair, merged anew from their characters, come out as they
are: the first merge across a border would already happen in the pair alone. So an encoder
may guess tokens from left to right (the longest piece first), check each new pair, and
take back the last token where no guess fits. A position that was taken back is no border
of the result whatever came before it; a bit per position remembers it.

Pieces are looked up by Aho-Corasick in one pass over the reversed text, which gives the
longest piece that starts at each position. Pairs are checked by merging their characters.

A text is cut where two characters meet that no piece holds side by side, as nothing is
merged there: first before blanks that follow something else, which is such a place in the
usual vocabularies, then anywhere. What lies between two cuts is encoded once and kept by
the worker, as is what lies between two blanks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
#: Entries that a worker keeps: words and other parts, runs between cuts, pairs of tokens.
CACHE_ENTRIES = 600_000
CACHE_RUNS = 50_000
CACHE_PAIRS = 200_000
#: Bytes of ids in a batch handed back to Spark, unless one text has more.
BATCH_BYTES = 8_000_000


class PartIds(dict):
    """Part of a text to its packed ids; a missing part is encoded and kept.

    Half of the entries at most are new. When these are full they become the old ones, of which
    those that are asked for again are kept: frequent parts are never encoded anew.
    """

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.half = encode, max(1, entries // 2)
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
            if len(part) > 64:
                return ids
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Fitting(dict):
    """(left, guess) to the longest start of ``guess`` that may follow ``left``; None if there is none."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, pair: tuple[str, str]) -> str | None:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        token = self[pair] = self.find(*pair)
        return token


class PieceVocabulary:
    """Pieces with scores and ids, and the ways to encode and decode with them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i
            for i in range(self.library.vocab_size())
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))
        ]
        if any(self.library.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces are not supported")
        names = self.library.id_to_piece(plain)
        self.ids = dict(zip(names, plain, strict=True))
        self.scores = dict(zip(names, map(self.library.get_score, plain), strict=True))
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(self.library.is_byte, self.byte_ids)):
            raise ValueError("a vocabulary with byte pieces is needed")
        self.finder = ahocorasick.Automaton()
        for name in names:
            self.finder.add_word(name[::-1], len(name))
        self.finder.make_automaton()
        self.beside = {pair for name in names for pair in zip(name, name[1:])}
        self.cut = all(left == BLANK for left, right in self.beside if right == BLANK)
        self.parts = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if self.cut else "(?s).+")
        self.fitting = Fitting(self.find_fitting)
        self.shorter: dict[str, str] = {}
        self.kept = PartIds(self.part_ids)
        self.kept_words = PartIds(self.word_ids)
        self.kept_runs = PartIds(self.run_ids, CACHE_RUNS)

    def merged(self, text: str) -> list[str]:
        """The characters of a short text, merged best score first, leftmost among equals."""
        symbols = list(text)
        while True:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens may stand side by side; an empty left one is the text's start."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def find_fitting(self, left: str, guess: str | None) -> str | None:
        while guess is not None and not self.fits(left, guess):
            guess = self.next_shorter(guess)
        return guess

    def next_shorter(self, token: str) -> str | None:
        """The longest piece, or else the character, that the token starts with; None for a character."""
        known = self.shorter.get(token)
        if known is None and len(token) > 1:
            ends = (e for e in range(len(token) - 1, 0, -1) if e == 1 or token[:e] in self.ids)
            known = self.shorter[token] = token[: next(ends)]
        return known

    def longest(self, text: str) -> dict[int, int]:
        """Length of the longest piece that starts at a position, by the position's distance from the end.

        The finder reports the longest of several matches first, so in reverse it is kept.
        """
        return dict(list(self.finder.iter(text[::-1]))[::-1])

    def tokens(self, text: str) -> list[str]:
        """The tokens of a normalised text, by backtracking."""
        last = len(text) - 1
        if last < 0:
            return []
        lengths = self.longest(text)
        fitting = self.fitting
        failed = bytearray(last // 8 + 1)
        left, at = "", 0
        chosen = []
        guess: str | None = text[: lengths.get(last, 1)]
        while True:
            token = fitting[left, guess]
            if token is not None:
                end = at + len(token)
                if end > last:
                    break
                if failed[end >> 3] >> (end & 7) & 1:
                    guess = self.next_shorter(token)
                else:
                    chosen.append(left)
                    left, at = token, end
                    guess = text[at : at + lengths.get(last - at, 1)]
                    continue
            else:
                guess = None
            while guess is None:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(left)
                guess = self.next_shorter(left)
                left = chosen.pop()
        chosen += (left, token)
        return chosen[1:]

    def part_ids(self, part: str) -> bytes:
        """The part's ids as packed 32-bit numbers, from the runs between its cuts."""
        beside = self.beside
        if beside.issuperset(zip(part, part[1:])):
            return self.run_ids(part)
        cuts = [i for i, pair in enumerate(zip(part, part[1:]), 1) if pair not in beside]
        runs = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]
        return b"".join(map(self.kept_runs.__getitem__, runs))

    def run_ids(self, run: str) -> bytes:
        tokens = self.tokens(run)
        try:
            return array("I", map(self.ids.__getitem__, tokens)).tobytes()
        except KeyError:
            known = ((self.ids[t],) if t in self.ids else [self.byte_ids[b] for b in t.encode()] for t in tokens)
            return array("I", chain.from_iterable(known)).tobytes()

    def word_ids(self, word: str) -> bytes:
        return self.part_ids(BLANK + word)

    def packed(self, normalised: str) -> bytes:
        """The ids of a normalised text as packed 32-bit numbers.

        Where every blank stands alone before something else, the parts are the words with their blanks.
        """
        if self.cut and normalised[:1] == BLANK and normalised[-1] != BLANK and BLANK * 2 not in normalised:
            return b"".join(map(self.kept_words.__getitem__, normalised[1:].split(BLANK)))
        return b"".join(map(self.kept.__getitem__, self.parts.findall(normalised)))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin or end ids."""
        return np.frombuffer(self.packed(self.library.normalize(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library puts it together."""
        return self.library.decode(ids)


_VOCABULARIES: dict[str, PieceVocabulary] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """One per worker process, kept between its tasks."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = PieceVocabulary(path)
    return _VOCABULARIES[path]


def piece_codes(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Ids of every whole text, and the text that they decode to.

    Returns doc_id, ids (array of int) and decoded (string), one row for each row of
    ``docs``, repeated rows included. A NULL or empty text has no ids and decodes to an
    empty one. A NULL doc_id stays NULL. Other columns are not read, so their names do not
    matter. An empty table gives an empty result. Nothing is shuffled. A text without cuts
    is encoded in one run whose time grows with its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = vocabulary(path)
        for batch in batches:
            ids: list[bytes] = []
            decoded: list[str] = []
            start = size = 0
            for i, value in enumerate(batch.column(1)):
                mine = ours.packed(ours.library.normalize(value.as_py() or ""))
                ids.append(mine)
                decoded.append(ours.decode(np.frombuffer(mine, "<u4").tolist()))
                size += len(mine)
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    cuts = np.cumsum([0, *map(len, ids)]) // 4
                    numbers = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), numbers)
                    columns = [batch.column(0).slice(start, len(ids)), lists, pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])
                    ids, decoded, start, size = [], [], i + 1, 0

    return docs.select("doc_id", text).mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")
