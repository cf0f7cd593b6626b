"""Quality rules on how well a public vocabulary fits a text.

Characters per token, the share of byte-fallback tokens and the entropy of the tokens are
measured by a SentencePiece vocabulary, word by word, and held against two kinds of bands:
fixed ones that go by the text's main script, and narrower ones that the table itself gives
for each language and script.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import written

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LETTER = re.compile(r"[^\W\d_]")
KEPT_WORDS = 300_000
#: A language and script has bands of its own from so many different texts that pass the base rules.
LEAST_TEXTS = 30
#: They reach from the quartiles as far as this many times the distance between these, and
#: this share of the median at least.
REACH, LEAST_REACH = 2.0, 0.04
#: Quartiles are those of values rounded to this.
STEP = 0.002


@dataclass(frozen=True)
class Band:
    """Accepted values; entropy is in bits and holds for the 50 words and more that the base
    rules ask for."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]


#: First code point of a range, and its script, in order; 'other' covers what lies between.
RANGES = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "other"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0780, "other"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x32000, "other"),
]

#: Latin: over the documents of sf0.1 clean texts begin at 1.654 characters per token, and
#: words of random letters end at 1.644. Other: what the vocabulary has mostly bytes for is noise to it.
BANDS = {
    "latin": Band((1.65, 7.0), 0.05, (3.5, 14.0)),
    "greek": Band((0.7, 5.0), 0.2, (3.0, 14.0)),
    "cyrillic": Band((1.1, 6.0), 0.05, (3.5, 14.0)),
    "hebrew": Band((0.6, 4.0), 0.2, (3.0, 14.0)),
    "arabic": Band((0.6, 4.0), 0.2, (3.0, 14.0)),
    "indic": Band((0.4, 4.0), 0.7, (3.0, 14.0)),
    "thai": Band((0.4, 4.0), 0.5, (3.0, 14.0)),
    "hangul": Band((0.3, 3.0), 0.8, (3.0, 14.0)),
    "kana": Band((0.3, 3.0), 0.6, (3.0, 14.0)),
    "han": Band((0.3, 3.0), 0.7, (3.0, 14.0)),
    "other": Band((0.25, 7.0), 0.5, (2.5, 14.0)),
}


def script(text: str) -> str:
    """The script of most letters; 'other' without letters, of equal ones the first by name."""
    if text.isascii():
        return "latin" if LETTER.search(text) else "other"
    counts: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            counts[next(name for first, name in reversed(RANGES) if ord(char) >= first)] += n
    return min(counts, key=lambda name: (-counts[name], name), default="other")


class Pieces(dict):
    """UTF-8 word to its ids, as bytes of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.vocabulary.get_piece_size()
        self.is_byte = np.array([self.vocabulary.is_byte(i) for i in range(size)])

    def __missing__(self, word: bytes) -> bytes:
        value = np.array(self.vocabulary.encode(word.decode()), dtype=np.uint32).tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_PIECES: dict[str, Pieces] = {}


def fertility(words: list[bytes], chars: int, pieces: Pieces) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share and entropy in bits; 0s without any."""
    ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), dtype=np.uint32)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    values, counts = np.unique(ids, return_counts=True)
    share = counts / len(ids)
    entropy = float(-(share * np.log2(share)).sum())
    byte_share = float(counts[pieces.is_byte[values]].sum()) / len(ids)
    return len(ids), chars / len(ids), byte_share, max(0.0, entropy)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def measures(text: str, pieces: Pieces, bands: dict[str, Band]) -> tuple:
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    main = script(text)
    n_tokens, per_token, byte_share, entropy = fertility(words, chars, pieces)
    band = bands[main]
    kept = (
        not failed
        and band.chars_per_token[0] <= per_token <= band.chars_per_token[1]
        and byte_share <= band.byte_share
        and band.entropy[0] <= entropy <= band.entropy[1]
    )
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept,
        main, n_tokens, per_token, byte_share, entropy,
    )


COLUMNS = [
    ("n_words", "long", pa.int64()),
    ("word_chars", "long", pa.int64()),
    ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()),
    ("n_repeat_words", "long", pa.int64()),
    ("base_failed", "boolean", pa.bool_()),
    ("kept", "boolean", pa.bool_()),
    ("script", "string", pa.string()),
    ("n_tokens", "long", pa.int64()),
    ("chars_per_token", "double", pa.float64()),
    ("byte_share", "double", pa.float64()),
    ("entropy", "double", pa.float64()),
]


def bands_of_table(measured: DataFrame) -> DataFrame:
    """lang, script and the limits that the table's own texts give for them.

    Equal measures count once, so copies of a text do not narrow the bands. Counts of rounded
    values are made before the quartiles, which are exact over them.
    """
    names = ("chars_per_token", "entropy")
    texts = measured.where(~F.col("base_failed")).select("lang", "script", "n_tokens", *names).distinct()
    steps = [F.struct(F.lit(n).alias("name"), F.round(F.col(n) / STEP).cast("long").alias("step")) for n in names]
    counted = (
        texts.select("lang", "script", F.explode(F.array(*steps)).alias("at"))
        .groupBy("lang", "script", "at.name", "at.step")
        .agg(F.count("*").alias("n"))
    )
    quartiles = counted.groupBy("lang", "script", "name").agg(
        F.sum("n").alias("n"), F.expr(f"transform(percentile(step, array(0.25, 0.5, 0.75), n), q -> q * {STEP}D)").alias("q")
    )
    reach = F.greatest(REACH * (F.col("q")[2] - F.col("q")[0]), LEAST_REACH * F.col("q")[1])
    ends = F.struct((F.col("q")[0] - reach).alias("low"), (F.col("q")[2] + reach).alias("high"))
    return (
        quartiles.where(F.col("n") >= LEAST_TEXTS)
        .groupBy("lang", "script")
        .agg(*[F.max(F.when(F.col("name") == n, ends)).alias(f"{n}_band") for n in names])
    )


def fertility_rules(docs: DataFrame, path: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """doc_id and ``COLUMNS``, one row for each row of ``docs``, repeated rows included.

    Kept is what passes the base rules, the bands of its script, and those that all texts of
    its lang and script give: quartiles of characters per token and of entropy, ``REACH``
    times their distance to either side. NULL is a lang of its own, and so are all rows where
    there is no such column. A lang and script with fewer than ``LEAST_TEXTS`` different
    texts has the script's bands alone.

    A NULL or empty text has no words, fails the base rules and is not kept; its figures are
    0 and its script 'other'. Other columns are not read; an empty table gives an empty
    result. Texts are read once; their measures are written.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _PIECES:
            _PIECES[path] = Pieces(path)
        for batch in batches:
            rows = [measures(text.as_py() or "", _PIECES[path], bands) for text in batch.column(1)]
            columns = [pa.array([row[i] for row in rows], arrow) for i, (_, _, arrow) in enumerate(COLUMNS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *columns], names=["doc_id", "lang", *(c[0] for c in COLUMNS)]
            )

    schema = ", ".join(f"{name} {sql}" for name, sql, _ in COLUMNS)
    measured = written(
        docs.select("doc_id", F.col("text"), lang.cast("string").alias("lang")).mapInArrow(
            measure, f"doc_id {kind}, lang string, {schema}"
        ),
        "fertility",
    )
    own = bands_of_table(measured).withColumnsRenamed({"lang": "_lang", "script": "_script"})
    fits = F.lit(True)
    for name in ("chars_per_token", "entropy"):
        band = F.col(f"{name}_band")
        fits &= band.isNull() | F.col(name).between(band["low"], band["high"])
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("script") == F.col("_script"))
    return (
        measured.join(F.broadcast(own), same, "left")
        .withColumn("kept", F.col("kept") & fits)
        .select("doc_id", *(c[0] for c in COLUMNS))
    )
