"""The ten operators against plain Python, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtally.llm import queries
from gridtally.llm.graph import components
from gridtally.llm.jaccard import jaccard_components, one_of_each, prefix_length
from gridtally.llm.language import WORD, in_known_language, language_mixture, learn
from gridtally.llm.licenses import PHRASES, license_scan
from gridtally.llm.mixing import in_mixed_order, pfair_mix
from gridtally.llm.neighbours import nearest
from gridtally.llm.packing import best_fit_packing, packed_documents, packing_plan
from gridtally.llm.private import all_spans, hinted, masked, normalised, personal_data, redacted
from gridtally.llm.quality import fertility_rules
from gridtally.llm.substrings import substring_dedup
from gridtally.llm.tokens import token_counts

SMALL = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string"


def table(spark, texts, *, lang="en", source="a"):
    rows = [(i, t, lang, source, len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed: int, n: int, words: int = 300) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


AWKWARD = [
    None, "", " ", "\n\t ", "a", "a  b", " a b ", "x y z", "tab\tnew\nline end ", "🙂 ß é", "don't  we'll",
    "<|endoftext|> a <|endoftext|>", prose(1, 12_000), prose(2, 60), prose(2, 60), "a b c d", "A B C D", "a" * 70_000,
]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def check_packing(rows, texts, library, capacity=2048):
    by_doc = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert i == 0 or r.length == capacity
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_packing_real_and_awkward(spark, real, awkward, empty, library):
    rows = queries.QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    made = check_packing(rows, {d: r.text for d, r in real.items()}, library)
    assert made <= -(-sum(r.length for r in rows) // 2048) + 1
    check_packing(packed_documents(awkward, BYTE_BPE).collect(), dict(enumerate(AWKWARD)), library)
    assert packed_documents(empty, BYTE_BPE).count() == 0


def test_packing_repeated_rows_and_clashing_columns(spark):
    pieces = spark.createDataFrame([(1, 0, 700, 9), (1, 0, 700, 9), (None, 0, 700, 9), (2, 0, 648, 9)],
                                   "doc_id long, piece int, length long, offset int")
    rows = best_fit_packing(pieces).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert len({r.sequence_id for r in rows}) == 2
    with pytest.raises(ValueError, match="from 1 to"):
        best_fit_packing(spark.createDataFrame([(1, 0, 3000)], "doc_id long, piece int, length long"))


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 200))
    counts = Counter(rng.integers(1, capacity + 1, 500).tolist())
    plan, made = packing_plan(counts, capacity)
    content = defaultdict(list)
    large = Counter()
    for length, n in counts.items():
        mine = [r for r in plan.tolist() if r[0] == length]
        edges = [r[1] for r in mine] + [n]
        assert edges[0] == 0 and edges == sorted(edges)
        for (_, k, first, per, offset), end in zip(mine, edges[1:], strict=True):
            for i in range(end - k):
                content[first + i // per].append((offset + i % per * length, length))
                large[first + i // per] += 3 * length > capacity
    assert set(content) == set(range(made)) and max(large.values()) <= 2
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity


def brute_repeats(texts):
    seen, out = set(), {}
    for doc, text in texts:
        words = WORDS.findall(text or "")
        covered = [False] * len(words)
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                covered[p : p + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, c in zip(words, covered, strict=True) if not c)
        out[doc] = len(words), sum(covered), hashlib.sha256(kept.encode()).hexdigest()
    return out


def test_substrings_against_every_window(spark, real, empty):
    passage, other = prose(7, 45), prose(8, 20)
    texts = [None, "", prose(9, 19), prose(10, 20), prose(10, 20), other, f"x {other} y", f"{other} {other}",
             *[f"{prose(20 + i, i * 3)} {passage} {prose(60 + i, 25)}" for i in range(12)], "z " * 100, "z " * 30,
             prose(11, 9000) + " " + passage]
    rows = substring_dedup(table(spark, texts)).collect()
    expected = brute_repeats(enumerate(texts))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == expected
    rows = queries.QUERIES["op2_fixed_block_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_repeats(
        sorted((d, r.text) for d, r in real.items())
    )
    assert substring_dedup(empty).count() == 0


def test_substrings_null_and_repeated_ids(spark):
    text = prose(5, 40)
    docs = spark.createDataFrame([(3, text), (3, text), (None, text)], "doc_id int, text string")
    rows = sorted((r.doc_id or 99, r.n_removed) for r in substring_dedup(docs).collect())
    assert rows == [(3, 0), (3, 0), (99, 40)]


def test_token_counts(spark, real, awkward, empty, library):
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    rows = queries.QUERIES["op3_token_counts"](spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {d: size(r.text) for d, r in real.items()}
    for r in token_counts(awkward, BYTE_BPE).collect():
        text = AWKWARD[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), size(text))
        assert r.over_limit == (r.n_tokens > 1024)
    # No table at all, and one that cannot hold anything, change nothing.
    assert [r.n_tokens for r in token_counts(awkward, BYTE_BPE, table=("", b"")).collect()] == [size(t) for t in AWKWARD]
    assert token_counts(empty, BYTE_BPE).count() == 0


def test_token_counts_by_sentencepiece(awkward):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts(awkward, PIECES).collect()
    assert [r.n_tokens for r in rows] == [len(whole.encode(t or "")) for t in AWKWARD]


def brute_base(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    found = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {p + i for p in range(len(words) - 2) if found[tuple(words[p : p + 3])] > 1 for i in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), failed)


def test_fertility_rules(spark, real, awkward, empty):
    for rows, texts in (
        (queries.QUERIES["op4_tokeniser_fertility"](spark, SMALL).collect(), {d: r.text for d, r in real.items()}),
        (fertility_rules(awkward, PIECES).collect(), dict(enumerate(AWKWARD))),
    ):
        assert len(rows) == len(texts)
        for r in rows:
            assert brute_base(texts[r.doc_id]) == (
                r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
            )
            assert not (r.base_failed and r.kept)
    assert fertility_rules(empty, PIECES).count() == 0


def test_fertility_bands(spark):
    rng = np.random.default_rng(3)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x13A0, 0x13F0, 6)) for _ in range(80))
    hashes = " ".join("".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(80))
    dull = " ".join(f"the {'a' * i}" for i in range(1, 40))
    clean = " ".join(rng.choice("the house on a hill was built by people who came from the sea and never went back".split(), 120))
    rows = fertility_rules(table(spark, [noise, hashes, dull, clean]), PIECES).orderBy("doc_id").collect()
    assert [r.script for r in rows] == ["other", "latin", "latin", "latin"]
    assert rows[0].byte_share > 0.5 and rows[1].chars_per_token < 2
    assert rows[3].byte_share == 0 and rows[3].chars_per_token > 2


def test_neighbours_of_many_blocks(spark, monkeypatch):
    from gridtally.llm import neighbours

    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    vectors = np.random.default_rng(6).standard_normal((1_000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in nearest(frame).collect():
        found[r.query_id].add(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    best = {q: set(np.argsort(-(unit @ unit[q]))[1:6].tolist()) for q in range(0, 1000, 50)}
    assert set(found) == set(best) and all(len(v) == 5 for v in found.values())
    assert sum(len(best[q] & found[q]) for q in best) >= 0.95 * 5 * len(best)


def test_fertility_rejects_noise(spark):
    rng = np.random.default_rng(4)
    words = """the house on a hill was built by people who came from sea and never went back because their
    children had found work in small towns where every winter brought snow rain long nights stories songs""".split()
    clean = [" ".join(rng.choice(words, 150)) for _ in range(60)]
    scrambled = [" ".join("".join(rng.permutation(list(w))) for w in rng.choice([w for w in words if len(w) > 3], 150)) for _ in range(4)]
    code = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    base64 = [" ".join("".join(rng.choice(code, 64)) for _ in range(80)) for _ in range(4)]
    fallback = [" ".join("".join(chr(c) for c in rng.integers(0x13A0, 0x13F0, 6)) for _ in range(80)) for _ in range(4)]
    texts = [*clean, *scrambled, *base64, *fallback]
    rows = fertility_rules(table(spark, texts), PIECES).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in rows)
    assert sum(r.kept for r in rows[:60]) >= 58 and not any(r.kept for r in rows[60:])
    # Copies of one text, however many, leave the bands of the others as they are.
    copies = fertility_rules(table(spark, texts + clean[:1] * 300), PIECES).orderBy("doc_id").collect()
    assert [r.kept for r in copies[: len(rows)]] == [r.kept for r in rows]
    few = fertility_rules(table(spark, [clean[0], base64[0], fallback[0]]).drop("lang"), PIECES).orderBy("doc_id").collect()
    assert [r.kept for r in few] == [True, False, False]



def test_neighbours_recall_ties_and_unusable_rows(spark, empty):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((2_000, 32)).astype(np.float32)
    vectors[100:140] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5050, []), (5100, [0.0] * 32), (5150, [float("nan")] * 32), (None, [1.0] * 32), (5200, [None] * 32)]
    frame = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in nearest(frame).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 2000, 50))
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    hits = 0
    for q, got in found.items():
        scores = exact @ exact[q]
        scores[q] = -9
        best = np.lexsort([np.arange(len(scores)), -np.round(scores, 12)])[:5]
        hits += len(set(best) & {v for v, _ in got})
        assert all(abs(scores[v] - s) < 1e-12 for v, s in got)
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert hits >= 0.95 * 5 * len(found)
    assert [v for v, _ in found[0]] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:1] + rows[1:4], "vec_id long, embedding array<float>")
    assert nearest(few).count() == 3
    assert nearest(few.limit(0)).count() == 0


def test_language_held_out_accuracy(spark, real):
    rows = queries.QUERIES["op6_language_mixture"](spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and sum(r.lang_pred == docs[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_and_awkward_rows(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn(docs)
    of = {k: next(r.text for r in docs.where(f"lang = '{k}' and n_chars > 1500").limit(1).collect()) for k in ("en", "de")}
    half = " ".join(of["en"].split()[:120] + of["de"].split()[:120])
    row = language_mixture(table(spark, [half]), *model).first()
    assert {part.split(":")[0] for part in row.languages.split(",")} == {"en", "de"} and 0.3 < row.score < 0.7
    rows = language_mixture(awkward, *model).collect()
    letters = [any(c.isalpha() for w in WORD.findall(t or "") for c in w) for t in AWKWARD]
    assert [r.lang_pred != "und" for r in rows] == letters and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_mixture(empty, *model).count() == 0
    assert learn(empty)[0] == []
    assert {r.lang_pred for r in language_mixture(awkward, *learn(empty)).collect()} == {"und"}
    kept = in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def brute_places(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc by cc by 4.0 MIT License the mit license", "cc-by\ncc by-sa", "gnu general public license",
    "GNU General  Public\nLicense version 3; Apache License, Version 2.0", "the license of the software is free",
    "Permission granted is hereby of charge free", "ccby cc  BY É cc", None, "", "---",
]


def test_license_scan(spark, real, awkward, empty):
    scan = license_scan(table(spark, NOTICES)).orderBy("doc_id").collect()
    assert [r.labels for r in scan][:3] == ["mit", "bsd", "cc-by,mit"]
    assert scan[0].base_labels == "" and 0 < scan[0].score <= 1 and scan[6].labels == scan[7].labels == ""
    for rows, texts in (
        (scan, dict(enumerate(NOTICES))),
        (license_scan(awkward).collect(), dict(enumerate(AWKWARD))),
        (queries.QUERIES["op7_license_scan"](spark, SMALL).collect(), {d: r.text for d, r in real.items()}),
    ):
        assert len(rows) == len(texts)
        for r in rows:
            assert brute_places(texts[r.doc_id]) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert license_scan(empty).count() == 0


def test_every_notice_of_a_file_is_found(spark):
    from gridtally.llm.licenses import TEMPLATES

    notice = {name: text for name, text, _ in TEMPLATES}
    others = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    around = " ".join(f"{w} q" for w in others * 3)
    files = [["mit", "apache"], ["mit", "bsd", "isc"], ["mit", "apache", "bsd", "mpl"], list(notice)]
    texts = [" and then ".join(notice[n] for n in names) for names in files]
    texts += [f"{around} {notice[n]} {around}" for n in notice]
    rows = license_scan(table(spark, texts)).orderBy("doc_id").collect()
    expected = [set(names) for names in files] + [{n} for n in notice]
    for r, names in zip(rows, expected, strict=True):
        # A share-alike notice holds the key phrase of the plain one.
        extra = {"cc-by"} if "cc-by-sa" in names else set()
        assert names <= set(r.labels.split(",")) <= names | extra and r.score == 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TRICKY = [
    "a@b.c@d.e x@y z@@q.w.e .@-.- 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111-1111 1111 1111 4 + +1 (2) 345.678-90123 +12",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 +1 555 123 4567 5555555555554444", "é@é.com é a@é.com 🙂 a@b.co", "+" * 50 + "1" * 40,
]


def test_plain_personal_data(spark, real, awkward, empty):
    for rows, texts in (
        (personal_data(table(spark, TRICKY)).collect(), dict(enumerate(TRICKY))),
        (personal_data(awkward).collect(), dict(enumerate(AWKWARD))),
        (queries.QUERIES["op8_disguised_personal_data"](spark, SMALL).collect(), {d: r.text for d, r in real.items()}),
    ):
        assert len(rows) == len(texts)
        for r in rows:
            expected = brute_spans(texts[r.doc_id])
            assert r.plain == expected and r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
            kinds = Counter(s.split(":")[0] for s in expected.split(",") if s)
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in BASE)
            assert set(expected.split(",")) <= set(r.spans.split(",")) | {""}
    assert personal_data(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail joe [at] example [dot] com now", [("joe [at] example [dot] com", "email")]),
        ("jane at mail dot example dot org.", [("jane at mail dot example dot org", "email")]),
        ("x@y.com and jοe@exаmple.com", [("x@y.com", "email"), ("jοe@exаmple.com", "email")]),
        ("plus one five five five one two three four five six seven", [("plus one five five five one two three four five six seven", "phone")]),
        ("ip one nine two dot one six eight dot one dot one.", [("one nine two dot one six eight dot one dot one", "ip")]),
        ("at 192[.]168[.]1[.]1 and +１ ５５５ １２３ ４５６７", [("192[.]168[.]1[.]1", "ip"), ("+１ ５５５ １２３ ４５６７", "phone")]),
        ("we met at noon. dot the i's; one, two, three, four, five", []),
        ("look at the dot on page 3 at example.com", []),
    ],
)
def test_disguised_personal_data(text, found):
    spans = all_spans(text)[1]
    assert [(text[a:b], kind) for a, b, kind in spans] == found
    hidden = masked(text, spans)
    assert all(part not in hidden for part, _ in found) and hidden.count("[") >= len(found)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call +49 one five one 2345678", [("+49 one five one 2345678", "phone")]),
        ("card 4111 one one 1111 one one 1111, 1", []),
        ("card 4111 one one one one 1111 one one 11", [("4111 one one one one 1111 one one 11", "card")]),
        ("Plus 49 170 1234567", [("Plus 49 170 1234567", "phone")]),
        ("(plus 49 170 1234567)", [("plus 49 170 1234567", "phone")]),
        ("jane [  at\t] x.com", [("jane [  at\t] x.com", "email")]),
        ("jane.doe   AT   mail.example.com", [("jane.doe   AT   mail.example.com", "email")]),
    ],
)
def test_disguises_that_the_quick_test_must_let_through(text, found):
    assert [(text[a:b], kind) for a, b, kind in all_spans(text)[1]] == found


def test_quick_test_is_wider_than_the_transducers():
    parts = """one Two 3 49 4111 plus PLUS más dot DOT . point at AT chez @ _at_ _AT_ [ ] ( ) { < > &#64; %40 jane jane.doe x.com
    x com , - ſix fünf ät %2e &period; oh""".split()
    rng, changed = np.random.default_rng(8), 0
    for _ in range(20_000):
        text = "".join(p + rng.choice(["", " ", "  ", "\t", " \t"]) for p in rng.choice(parts, 9))
        if normalised(text).text != text:
            changed += 1
            assert hinted(text), text
    assert changed > 1_000


def test_alignment_covers_the_source():
    text = "А at B dot com, one two three four, ＡＢ [at] c [dot] d​."
    aligned = normalised(text)
    assert len(aligned.text) == len(aligned.starts) == len(aligned.ends)
    assert aligned.starts == sorted(aligned.starts) and all(a < b for a, b in zip(aligned.starts, aligned.ends, strict=True))


def test_redaction_keeps_rows_and_columns(spark, awkward):
    out = redacted(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    row = redacted(table(spark, ["write a@b.com or +1 (743) 555-3824", None])).orderBy("doc_id").collect()
    assert row[0].text == "write [EMAIL] or [PHONE]" and row[0].n_chars == len(row[0].text) and row[1].text is None


def test_mix_deviates_by_less_than_a_block(spark):
    rows = [(i, "x" * 10, None, s, 10) for s, n in (("a", 3000), ("b", 700), (None, 150), ("c", 30)) for i in range(n)]
    docs = spark.createDataFrame([(k, *r[1:], "x", "y") for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, slot string, weight string")
    mixed = pfair_mix(docs, block=10, period=100).collect()
    assert len(mixed) == len(rows) and len({r.doc_id for r in mixed}) == len(rows)
    weight = {r.source: r.weight for r in mixed}
    assert abs(sum(weight.values()) - 1) < 1e-9
    slots = {(r.source, r.block): r.slot for r in mixed}
    assert len(set(slots.values())) == len(slots)
    for (source, block), slot in slots.items():
        before, after = weight[source] * slot - block, weight[source] * (slot + 1) - (block + 1)
        assert -1 < before < 1 and -1 < after < 1
    assert pfair_mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [40, 1200])
def test_mix_of_many_sources_follows_the_target_weights(spark, n):
    rows = [(f"s{i}", 4 if n < 100 else 1) for i in range(n - 1)] + [("big", 6_000 if n < 100 else 150_000)]
    docs = spark.createDataFrame([(s, k) for s, k in rows], "source string, k long").selectExpr(
        "source", "explode(sequence(1, k)) AS j", "'xxxxxxxxxx' AS text").selectExpr(
        "cast(hash(source, j) as long) * 1000003 + j AS doc_id", "source", "text")
    mixed = pfair_mix(docs, block=10).select("source", "block", "slot", "weight").collect()
    mass = {s: k**0.5 for s, k in rows}
    target = {s: m / sum(mass.values()) for s, m in mass.items()}
    weight = {r.source: r.weight for r in mixed}
    assert len(mixed) == sum(k for _, k in rows) and len({r.slot for r in mixed}) == len(mixed)
    assert set(weight) == set(target) and abs(sum(weight.values()) - 1) < 1e-6
    assert max(abs(weight[s] - target[s]) for s in target) < 0.002
    for r in mixed:
        assert abs(r.weight * r.slot - r.block) < 3


def test_mix_order_nulls_and_too_many_sources(spark, awkward):
    assert in_mixed_order(awkward).columns == awkward.columns and in_mixed_order(awkward).count() == len(AWKWARD)
    docs = table(spark, [None, "", "x"]).selectExpr("doc_id", "text", "cast(doc_id as string) AS source")
    assert pfair_mix(docs, period=3).count() == 3
    with pytest.raises(Exception, match="more than 2 sources"):
        pfair_mix(docs, period=2).collect()


def brute_components(texts):
    sets = {}
    for doc, text in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(seed, base, n):
    rng = np.random.default_rng(seed)
    words = base.split()
    for at in rng.integers(0, len(words), n):
        words[at] = f"e{rng.integers(1e9)}"
    return " ".join(words)


def test_jaccard_components(spark, real, awkward, empty):
    base, passage = prose(31, 200, 10**6), prose(32, 60, 10**6)
    family = [edited(i, base, i % 7) for i in range(60)]
    sharing = [f"{prose(100 + i, 30, 10**6)} {passage} {prose(200 + i, 10, 10**6)}" for i in range(30)]
    texts = [*family, *sharing, *AWKWARD, base.upper(), "a B c d", base + " tail"]
    rows = jaccard_components(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(enumerate(texts))
    rows = queries.QUERIES["op10_signature_tree_join"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(
        [(d, r.text) for d, r in real.items()]
    )
    assert jaccard_components(empty).count() == 0


def test_jaccard_links_of_documents_without_id(spark):
    base, other = prose(61, 120, 10**6), prose(62, 120, 10**6)
    rows = [(None, base)] * 5 + [(2, edited(1, base, 1)), (None, other), (None, edited(2, other, 1)), (7, edited(3, other, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted((r.doc_id or 0, r.component_id) for r in jaccard_components(docs).collect())
    assert found == [(0, 2)] * 5 + [(0, 7)] * 2 + [(2, 2), (7, 7)]
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [2, 7]
    # A row without id comes first, so that it stands for its text and that of row 1.
    docs = spark.createDataFrame([(None, base), (1, base), (2, edited(1, base, 1))], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in jaccard_components(docs).collect()} == {1}
    none = spark.createDataFrame([(None, other), (None, edited(2, other, 1))], "doc_id long, text string")
    assert [r.component_id for r in jaccard_components(none).collect()] == [None, None] and one_of_each(none).count() == 1


def test_jaccard_with_groups_cut_into_blocks(spark, monkeypatch):
    from gridtally.llm import jaccard

    base = prose(41, 120, 10**6)
    texts = [edited(i, base, 1 + i % 4) for i in range(150)]
    monkeypatch.setattr(jaccard, "GROUP", 20)
    monkeypatch.setattr(jaccard, "FAMILY", 3_000)
    rows = jaccard_components(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(enumerate(texts))


def test_one_of_each_group(spark):
    base = prose(51, 80)
    rows = [(5, base), (5, base), (3, base + " x"), (None, base), (5, "other text here now"), (7, None), (8, ""), (9, "other text here now")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _id string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(
        [(3, base + " x"), (5, "other text here now"), (7, ""), (8, "")]
    )


def test_prefix_length_is_the_smallest_that_must_share():
    for n in range(1, 300):
        least = min(x for x in range(n + 1) if 100 * x >= 80 * n)
        assert prefix_length(n) == n - least + 1


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(edges.limit(0)).count() == 0
