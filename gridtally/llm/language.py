"""Language identification as a mixture of languages in each document.

A word is drawn by one of the document's languages, in proportions that
expectation-maximisation estimates; a language gives a word the likelihood of its
character trigrams. The languages with the largest proportions are tried in growing sets,
for as long as the likelihood less a penalty for each language grows, and the best set is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import shielded

UND = "und"
#: Bound of the training sample: about so many documents of each language.
TRAIN_PER_LANGUAGE = 3_000
#: Trigrams are counted in so many buckets; the model has that many rows at any size.
BUCKETS = 1 << 15
#: A language's likelihood of a word, relative to the best one, is this at least.
FLOOR = 1e-4
#: Rounds of expectation-maximisation.
STEPS = 8
#: Words kept by a worker, and words (times languages) of a chunk.
KEPT_WORDS = 300_000
CHUNK = 2_000_000

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for NULL."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(padded[i : i + 3].encode()) % BUCKETS for i in range(len(padded) - 2)]


def learn(docs: DataFrame, *, per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probabilities of trigram buckets (buckets x languages).

    Learns from texts and languages of documents that are not held out: a sample by a hash
    of the id of about ``per_language`` for each language, all of them where there are fewer.
    """
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(per_language / n))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {name: np.zeros(BUCKETS, np.int64) for name in languages}
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                for word in WORD.findall(text.lower()):
                    if word not in seen:
                        if len(seen) > KEPT_WORDS:
                            seen.clear()
                        seen[word] = buckets(word)
                    found += seen[word]
                if found:
                    of[lang] += np.bincount(found, minlength=BUCKETS)
        for name, counts in of.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = (
        sample.select("text", "lang")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros((BUCKETS, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    column = np.array([place[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
    counts[rows.column("bucket").to_numpy(), column] = rows.column("n").to_numpy()
    smoothed = counts + 0.1
    return languages, np.log(smoothed / smoothed.sum(axis=0))


class Words(dict):
    """Word to its row of relative likelihoods, or -1 if it has no letter."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model
        self.rows = np.zeros((0, model.shape[1]))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = -1
            return -1
        at = len(self.rows) + len(self.new)
        self.new.append(word)
        self[word] = at
        return at

    def likelihoods(self) -> np.ndarray:
        if not self.model.shape[1]:
            self.new = []
        elif self.new:
            of = [buckets(word) for word in self.new]
            starts = np.cumsum([0, *map(len, of)])[:-1]
            logs = np.add.reduceat(self.model[np.concatenate(of)], starts, axis=0)
            logs -= logs.max(axis=1, keepdims=True)
            self.rows = np.concatenate([self.rows, np.maximum(np.exp(logs), FLOOR)])
            self.new = []
        return self.rows

    def shrink(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()
            self.rows = self.rows[:0]


def expectation_maximisation(
    p: np.ndarray, times: np.ndarray, starts: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log likelihoods, over the allowed languages.

    ``p`` has a row for each distinct word of a document, ``times`` its count, ``starts``
    each document's first row.
    """
    lengths = np.diff([*starts, len(p)])
    words = np.add.reduceat(times, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        joint = p * np.repeat(share, lengths, axis=0)
        joint *= (times / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / words[:, None]
    mixed = (p * np.repeat(share, lengths, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(mixed) * times, starts)


def infer(p: np.ndarray, times: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of each document over its selected languages, 0 for all others.

    The set grows by the next largest proportion until the penalised likelihood falls.
    """
    n = p.shape[1]
    words = np.add.reduceat(times, starts)
    full, _ = expectation_maximisation(p, times, starts, np.ones((len(starts), n)))
    order = np.argsort(-full, axis=1, kind="stable")
    lengths = np.diff([*starts, len(p)])
    best = np.full(len(starts), -np.inf)
    chosen = np.zeros_like(full)
    growing = np.arange(len(starts))
    for size in range(1, n + 1):
        rows = np.isin(np.repeat(np.arange(len(starts)), lengths), growing) if len(growing) < len(starts) else slice(None)
        begin = np.cumsum([0, *lengths[growing]])[:-1]
        allowed = np.zeros((len(growing), n))
        np.put_along_axis(allowed, order[growing, :size], 1.0, axis=1)
        share, fit = expectation_maximisation(p[rows], times[rows], begin, allowed)
        value = fit - penalty * size * np.log(words[growing] + 1)
        better = value > best[growing]
        growing = growing[better]
        if not len(growing):
            break
        best[growing] = value[better]
        chosen[growing] = share[better]
    return chosen


_WORDS: dict[int, Words] = {}
MIXTURE = "_mixture"


def with_mixture(docs: DataFrame, languages: list[str], model: np.ndarray, *, penalty: float = 1.0) -> DataFrame:
    """All columns of ``docs``, and a last one, a struct of lang_pred, score and languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    digest = zlib.crc32(model.tobytes()) * 31 + len(languages)
    most = max(1, CHUNK // max(1, len(languages)))
    docs = docs.drop(MIXTURE)
    text_at = docs.columns.index("text")

    def chunk(texts: list[list[int]], words: Words) -> list[tuple[str, float, str]]:
        rows = words.likelihoods()
        out = [(UND, 0.0, "")] * len(texts)
        keys, counts, owners = [], [], []
        for i, found in enumerate(texts):
            at, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            n, at = n[at >= 0], at[at >= 0]
            if len(at):
                keys.append(at)
                counts.append(n)
                owners.append(i)
        if owners and languages:
            starts = np.cumsum([0, *map(len, keys)])[:-1]
            times = np.concatenate(counts).astype(float)
            shares = infer(rows[np.concatenate(keys)], times, starts, penalty)
            for i, share in zip(owners, shares, strict=True):
                top = int(share.argmax())
                order = np.argsort(-share, kind="stable")
                mix = ",".join(f"{languages[k]}:{share[k]:.3f}" for k in order if share[k] > 0)
                out[i] = languages[top], min(1.0, float(share[top])), mix
        words.shrink()
        return out

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _WORDS:
            _WORDS.clear()
            _WORDS[digest] = Words(shared.value)
        words = _WORDS[digest]
        for batch in batches:
            out: list[tuple[str, float, str]] = []
            waiting: list[list[int]] = []
            size = 0
            for text in batch.column(text_at):
                waiting.append([words[w] for w in WORD.findall((text.as_py() or "").lower())])
                size += len(waiting[-1])
                if size >= most:
                    out += chunk(waiting, words)
                    waiting, size = [], 0
            if waiting:
                out += chunk(waiting, words)
            parts = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.string())]
            mixture = pa.StructArray.from_arrays(parts, names=["lang_pred", "score", "languages"])
            yield pa.RecordBatch.from_arrays([*batch.columns, mixture], names=[*batch.schema.names, MIXTURE])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predict, f"{schema}, {MIXTURE} struct<lang_pred:string,score:double,languages:string>")


def language_mixture(
    docs: DataFrame, languages: list[str], model: np.ndarray, *, penalty: float = 1.0
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: one row for each row of ``docs``.

    ``lang_pred`` is the selected language with the largest proportion (of equal ones, the
    first by name), ``score`` that proportion, ``languages`` all selected ones as
    name:proportion. A NULL text, one without letters, or a model without languages gives
    ``und``, score 0 and an empty list. A NULL doc_id is not held out. lang and source are not
    read. An empty table gives an empty result.
    """
    rows = with_mixture(docs.select("doc_id", held_out().alias("held_out"), "text"), languages, model, penalty=penalty)
    return rows.select("doc_id", "held_out", f"{MIXTURE}.*")


def in_known_language(docs: DataFrame, *, least: float = 0.3) -> DataFrame:
    """The rows, with all columns, that a learned language fills to ``least`` of the words.

    Rows without letters, and texts of many languages of which none has that share, go; a
    text half in one language and half in another stays. The model is learned from
    ``docs``; where no row has a language, none can be told and every row with letters
    stays. Repeated rows are judged alike, a tie of two shares is no matter here, names of
    other columns do not matter, and an empty table gives an empty result.
    """
    rows = shielded(docs, ["doc_id", "text", "lang"])
    languages, model = learn(rows)
    if not languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    mixture = with_mixture(rows, languages, model)
    known = (F.col(f"{MIXTURE}.lang_pred") != UND) & (F.col(f"{MIXTURE}.score") >= least)
    return mixture.where(known).select(*rows.columns).toDF(*docs.columns)
