"""Piece codes, alignment of two tokenizers and the filter audit against plain Python and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import sentencepiece
from compare import connect, difference
from gridtally.llm import alignment, queries
from gridtally.llm.alignment import aligned_groups
from gridtally.llm.audit import COUNTS, FILTERS, filter_audit, removal_steps
from gridtally.llm.pieces import PartIds, PieceVocabulary, piece_codes
from test_llm import AWKWARD, BYTE_BPE, PIECES, SMALL, prose, table
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def plain_bytes():
    made = Tokenizer.from_file(BYTE_BPE)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def vocabulary():
    return PieceVocabulary(PIECES)


STRANGE = ["a▁b", "▁", "\0x", "<0x0A><unk></s><s>", "\n\n\n x", " " * 37 + "z", "ﬁ​‮", "é́", "\U0010ffff"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def code_row(pieces, text):
    ids = pieces.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids))


def test_piece_codes_of_real_texts(spark, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_piece_codes"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
        d: code_row(pieces, t) for d, t in texts.items()
    }


def test_piece_codes_of_awkward_rows(spark, pieces):
    texts = AWKWARD + STRANGE
    rows = piece_codes(table(spark, texts), PIECES).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in rows} == {
        i: (pieces.encode(t or ""), pieces.decode(pieces.encode(t or ""))) for i, t in enumerate(texts)
    }
    repeated = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]
    clash = spark.createDataFrame([(*r, "x", 3) for r in repeated], "doc_id long, text string, ids string, decoded int")
    assert sorted(map(tuple, piece_codes(clash, PIECES).select("doc_id", "decoded").collect()), key=repr) == sorted(
        [(1, "a b"), (1, "a b"), (None, "a b"), (None, "")], key=repr
    )
    empty = piece_codes(table(spark, ["x"]).limit(0), PIECES)
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "decoded"]


def test_backtracking_equals_the_library_on_random_texts(vocabulary, pieces):
    rng = random.Random(5)
    names = list(vocabulary.ids)
    made = []
    for _ in range(1500):
        made.append("".join(rng.choice(names) for _ in range(rng.randint(1, 12))))
        made.append("".join(rng.choice("abeinrst ▁\n") for _ in range(rng.randint(1, 40))))
        made.append("".join(chr(rng.choice([rng.randint(32, 767), rng.randint(0x400, 0x9FFF), 32, 10, 0])) for _ in range(30)))
        made.append(" ".join(rng.choice(names) + " " * rng.randint(0, 9) for _ in range(rng.randint(1, 9))))
    assert [vocabulary.encode(t) for t in made] == [pieces.encode(t) for t in made]


def test_backtracking_without_cuts_equals_the_library(vocabulary, pieces):
    rng = random.Random(6)
    whole = PieceVocabulary(PIECES)
    whole.parts = re.compile("(?s).+")
    for text in (prose(3, 400), " ".join(rng.choice(list(whole.ids)) for _ in range(500)), "ab " * 300):
        assert whole.encode(text) == pieces.encode(text)


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "ab" * 50_000, "\n" * 100_000, "ababc" * 20_000])
def test_long_runs_take_linear_time(vocabulary, pieces, text):
    started = time.perf_counter()
    ids = vocabulary.encode(text)
    assert time.perf_counter() - started < 3
    assert ids == pieces.encode(text)


def brute_alignment(texts, plain_bytes, pieces):
    """Everything by loops over bytes: owners of each byte, links by owners, cuts by ends."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    docs = []
    for text in texts:
        a = plain_bytes.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        ta = [bytes(byte_of[c] for c in plain_bytes.id_to_token(i)) for i in a]
        tb = [
            bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in b)
        ]
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            docs.append(None)
            continue
        own = [[k for k, t in enumerate(side) for _ in t] for side in (ta, tb)]
        links = sorted(set(zip(*own)))
        groups, na, nb = [], 0, 0
        sums = [np.cumsum([*map(len, side)]).tolist() for side in (ta, tb)]
        for cut in sorted(set(sums[0]) & set(sums[1])):
            ka, kb = sums[0].index(cut, na) + 1, sums[1].index(cut, nb) + 1
            groups.append(",".join(map(str, a[na:ka])) + "|" + ",".join(map(str, b[nb:kb])))
            na, nb = ka, kb
        docs.append((a, b, [(a[i], b[j]) for i, j in links], groups))
    counts = Counter(p for d in docs if d for p in set(d[2]))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = d
        out.append((
            len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
            sum(counts[p] for p in links), sha(";".join(groups)),
        ))
    return out


def byte_characters():
    """The stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def alignment_rows(rows):
    fields = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return {r.doc_id: tuple(r[f] for f in fields) for r in rows}


def test_alignment_of_real_texts(spark, plain_bytes, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(texts, brute_alignment(list(texts.values()), plain_bytes, pieces), strict=True))
    assert alignment_rows(queries.QUERIES["op12_aligned_groups"](spark, SMALL).collect()) == want


@pytest.mark.parametrize("table_pairs", [1, 40, 500_000])
def test_alignment_with_a_small_table_and_awkward_rows(spark, plain_bytes, pieces, table_pairs):
    texts = AWKWARD + STRANGE + [prose(i, 40, 30) for i in range(20)]
    want = dict(enumerate(brute_alignment(texts, plain_bytes, pieces)))
    rows = aligned_groups(table(spark, texts), BYTE_BPE, PIECES, table_pairs=table_pairs)
    assert alignment_rows(rows.collect()) == want


def test_alignment_of_repeated_rows_clashing_names_and_nothing(spark, plain_bytes, pieces):
    texts = ["one two", "one two", "one two three", None, ""]
    want = brute_alignment(texts, plain_bytes, pieces)
    rows = spark.createDataFrame(
        [(i, t, "x", 1, "y") for i, t in zip([1, 1, None, None, 4], texts)],
        "doc_id long, text string, a string, pair int, _alignment_row string",
    )
    got = aligned_groups(rows, BYTE_BPE, PIECES).drop("doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert aligned_groups(rows.limit(0), BYTE_BPE, PIECES).count() == 0


def brute_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in labels:
        good[d] |= q == 1
        toxic[d] |= t == 1
    rows = []
    for d, text, lang in docs:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", body)) > 3 * len(body) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", body) else set()
        fails |= {"E"} if d is not None and first[body] < d else set()
        rows.append((lang or "", fails, good[d] if d is not None else 0, toxic[d] if d is not None else 0))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations(FILTERS):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                before = [r for r in rows if r[0] == part and f in r[1] and r[1] & set(order[: step - 1])]
                alone = [r for r in rows if r[0] == part and r[1] == {f}]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(before), len(alone), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_audit_against_sql(spark, sf):
    where = f"/root/testdata/{sf}"
    made = queries.QUERIES["op13_filter_audit"](spark, where)
    assert difference(made, connect(where), queries.ORACLE_SQL["op13_filter_audit"]) is None


def test_audit_of_awkward_rows(spark):
    rng = random.Random(3)
    texts = [None, "", "", "A B C", "a # b", prose(1, 300, 5), prose(2, 300, 9000), prose(2, 300, 9000), "é" * 70]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (3, 0, 0), (None, 1, 1), (99, 1, 1), (5, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, mask string, n int")
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, lang string")
    assert audit_rows(filter_audit(docs, marks)) == brute_audit(rows, labels)
    assert audit_rows(filter_audit(docs, marks.limit(0))) == brute_audit(rows, [])
    assert filter_audit(docs.limit(0), marks).count() == 0


def test_removal_steps_are_the_first_failing_filter_of_each_order():
    orders, steps = removal_steps(4)
    for m in range(16):
        for o, order in enumerate(orders.tolist()):
            assert steps[m, o] == next((i for i, f in enumerate(order) if m >> f & 1), 4)



def test_frequent_parts_are_encoded_once_and_kept_parts_are_bounded():
    """A part that comes again and again stays while thousands of others pass."""
    asked = []

    def encode(part):
        asked.append(part)
        return part.encode()

    kept = PartIds(encode, 100)
    for i in range(5000):
        assert kept["often"] == b"often"
        assert kept[f"rare {i}"] == f"rare {i}".encode()
    assert asked.count("often") == 1
    assert len(kept) + len(kept.old) <= 100


def test_a_full_cache_of_the_alignment_starts_over():
    side = alignment.ByteVocabulary(BYTE_BPE)
    assert side.cache.limit == alignment.CACHE_RUNS == 150_000
    side.cache.limit = 2
    for i in range(5):
        assert side.ids(f"word{i} and more").tolist() == side.encoder.merge(f" word{i} and more")
        assert len(side.cache) <= 2


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 12))) for _ in range(n))


def test_new_runs_of_a_text_are_encoded_in_one_call():
    side = alignment.ByteVocabulary(BYTE_BPE)
    merge, asked = side.encoder.merge, []

    def counted(text):
        asked.append(text)
        return merge(text)

    side.encoder.merge = counted
    try:
        for text in (words(1, 300), words(1, 300) + " " + words(2, 300), words(2, 300)):
            assert side.ids(text).tolist() == merge(" " + text)
    finally:
        side.encoder.merge = merge
    assert len(asked) == 2


def test_pieces_of_new_words_take_no_longer_than_the_library(pieces):
    """Words that no cache knows cost little more than the library's own call for the whole text."""
    side = alignment.PieceBytes(PIECES)
    ours = theirs = float("inf")
    for seed in range(5):
        text = words(seed, 20_000)
        started = time.process_time()
        want = pieces.encode(text)
        theirs = min(theirs, time.process_time() - started)
        started = time.process_time()
        got = side.ids(text)
        ours = min(ours, time.process_time() - started)
        assert got.tolist() == want
    assert ours < 2 * theirs
