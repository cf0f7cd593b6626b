"""Texts and rows that earlier versions lost, cut short or took too long for."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from gridtally.llm import language, neighbours, private
from gridtally.llm.jaccard import one_of_each
from gridtally.llm.mixing import in_mixed_order
from gridtally.llm.substrings import numbered, substring_dedup
from test_llm import brute_repeats, prose

N = 100_000
SLOW = {
    "blanks after a number": "word 1," + " " * N + "x",
    "blanks": "a" + " " * N + "b",
    "blanks after a name": "jane.doe" + " " * N + "at x.org",
    "written dots": "a dot " * (N // 6),
    "numbers and dots": "1 dot " * (N // 6),
    "brackets": "a (at) " * (N // 7),
    "open brackets": "a [" + " \t" * (N // 2),
    "dots": "a." * (N // 2),
    "digits": "1" * N,
    "digits and commas": "1, " * (N // 3),
    "spoken": "one two " * (N // 8),
    "signs": "@" * N,
    "pluses": "+1" + " " * N + "+",
    "names and hosts": "x at a dot b " * (N // 13),
    "host of many labels": "x at " + "a dot " * (N // 6),
    "ats": "at " * (N // 3),
    "at signs": "a@a dot " * (N // 8),
}


@pytest.mark.parametrize("name", SLOW)
def test_long_texts_take_linear_time(name):
    text = SLOW[name]
    started = time.process_time()
    private.hinted(text)
    middle = time.process_time()
    private.normalised(text)
    assert middle - started < 1
    assert time.process_time() - middle < 2


#: One pattern for a whole address with written dots: slow on long rows of them, but plain.
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]+(?:{private.WRITTEN_DOT}[A-Za-z0-9_%+-]+)*)"
    rf"(?: +(?:at|arroba|chez|ät) +|@)(?P<host>{private.LABEL}(?:(?:{private.WRITTEN_DOT}|\.){private.LABEL})*"
    rf"{private.WRITTEN_DOT}(?:{'|'.join(private.ENDINGS)}))(?![A-Za-z0-9-])",
    re.I,
)


def plain_addresses(text):
    return [
        (*m.span(), private.DOT_WORD.sub(".", m["name"]) + "@" + private.DOT_WORD.sub(".", m["host"]))
        for m in ADDRESS.finditer(text)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_written_addresses_equal_one_pattern(seed):
    rng = random.Random(seed)
    parts = [" at ", " dot ", "@", "a", "b-c", "com", "org", ".", " . ", "  dot  ", " ", "x.y", "_", "AT", " Dot ", "at", ",", "  at "]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(3, 16)))
        assert list(private.written_emails(text)) == plain_addresses(text), text


#: What may stand between spoken digits, with everything that can be given back.
LOOSE = r"(?:[ \t]*[,()-][ \t]*[()-]?[ \t]*|[ \t]+)"


def plain_transducers():
    out = []
    for pattern, to in private.TRANSDUCERS:
        if to is private.written_emails:
            out.append((ADDRESS, lambda m: plain_addresses(m[0])[0][2] if plain_addresses(m[0]) else m[0]))
        else:
            out.append((re.compile(pattern.pattern.replace(private.BETWEEN, LOOSE), pattern.flags), to))
    return out


def slow_spans(text):
    """Spans from a rewrite that keeps a list of (character, start, end) and rebuilds it for each pattern."""
    cells = [(c, i, i + 1) for i, c in enumerate(text)]
    for pattern, to in plain_transducers():
        now, out, last = "".join(c for c, _, _ in cells), [], 0
        for m in pattern.finditer(now):
            new = to(m)
            if m.end() > m.start() and new != m[0]:
                out += cells[last : m.start()]
                out += [(c, cells[m.start()][1], cells[m.end() - 1][2]) for c in new]
                last = m.end()
        cells = out + cells[last:]
    now = "".join(c for c, _, _ in cells)
    plain = private.plain_spans(text)
    found = []
    for a, b, kind in private.plain_spans(now):
        x, y = cells[a][1], cells[b - 1][2]
        same = [p for p in plain if p[2] == kind and p[0] < y and x < p[1]]
        if text[x:y] != now[a:b] and not same:
            found.append((x, y, kind))
    return private.in_order(plain + found)


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_a_slow_plain_transducer(seed):
    rng = random.Random(seed)
    parts = """jane doe x.com example org (at) [dot] { at } &#64; %40 @ . + plus one two three four five six seven eight
    nine zero oh 49 170 1234567 4111 1111 192 168 0 1 dot punkt point at chez , - ( ) аеора ０１２ ① _at_ jane.doe a@b.org""".split()
    for _ in range(1500):
        text = "".join(p + rng.choice(["", " ", " ", "  ", "\t"]) for p in rng.choices(parts, k=rng.randint(4, 18)))
        assert private.all_spans(text)[1] == slow_spans(text), text


def many_languages(spark, words, n=8, each=80):
    """Documents of invented languages with letters of their own, and a text of equal parts of six."""
    rng = random.Random(3)
    letters = ["".join(chr(0x61 + (7 * k + i) % 26) for i in range(4)) + chr(0x3B1 + k) for k in range(n)]
    word = lambda k: "".join(rng.choices(letters[k], k=rng.randint(3, 7)))
    rows = [(k * each + i, " ".join(word(k) for _ in range(60)), f"l{k}") for k in range(n) for i in range(each)]
    mixed = " ".join(word(k) for _ in range(words) for k in range(min(6, n)))
    schema = "doc_id long, text string, lang string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(1, mixed, None)], schema)


def test_a_text_in_six_languages_has_six(spark):
    train, mixed = many_languages(spark, 60)
    languages, model = language.learn(train)
    row = language.language_mixture(mixed, languages, model).first()
    parts = dict(p.split(":") for p in row.languages.split(","))
    assert set(parts) == {f"l{k}" for k in range(6)}
    assert all(abs(float(x) - 1 / 6) < 0.05 for x in parts.values())
    assert row.score < 0.25


def plain_mixture(counts, rows, penalty):
    """Proportions of one document by loops, over all sets that the rule visits."""
    n, words = len(next(iter(rows.values()))), sum(counts.values())

    def run(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(n)]
        for _ in range(language.STEPS):
            new = [0.0] * n
            for w, times in counts.items():
                total = sum(rows[w][k] * share[k] for k in range(n))
                for k in range(n):
                    new[k] += times * rows[w][k] * share[k] / total
            share = [x / words for x in new]
        return share, sum(t * np.log(sum(rows[w][k] * share[k] for k in range(n))) for w, t in counts.items())

    full, _ = run(range(n))
    order = sorted(range(n), key=lambda k: -full[k])
    best, chosen = -np.inf, None
    for size in range(1, n + 1):
        share, fit = run(order[:size])
        value = fit - penalty * size * np.log(words + 1)
        if value <= best:
            break
        best, chosen = value, share
    return chosen


def test_mixtures_equal_plain_loops(spark):
    train, mixed = many_languages(spark, 4, n=5, each=40)
    languages, model = language.learn(train)
    rng = random.Random(8)
    texts = [r.text for r in train.collect()]
    made = [" ".join(rng.sample(rng.choice(texts).split(), 12) + rng.sample(rng.choice(texts).split(), rng.randint(1, 9))) for _ in range(25)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*made, "x", mixed.first().text])], "doc_id long, text string")
    for r in language.language_mixture(docs.join(docs.select("doc_id"), "doc_id"), languages, model).collect():
        text = docs.where(docs.doc_id == r.doc_id).first().text
        counts = Counter(language.WORD.findall(text.lower()))
        rows = {}
        for w in counts:
            logs = model[language.buckets(w)].sum(axis=0)
            rows[w] = np.maximum(np.exp(logs - logs.max()), language.FLOOR).tolist()
        share = plain_mixture(counts, rows, 1.0)
        assert r.lang_pred == languages[int(np.argmax(share))]
        assert r.score == pytest.approx(max(share), abs=1e-9)


def test_without_languages_rows_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123 ...", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.in_known_language(docs).collect()) == [1, 4]
    assert language.in_known_language(docs.limit(0)).count() == 0




def test_rows_without_an_id_lose_repeated_words_only(spark):
    a, b, c = prose(31, 60, 9000), prose(32, 60, 9000), prose(33, 60, 9000)
    shared = prose(34, 30, 9000)
    rows = [(1, a), (None, a), (None, b), (None, f"{c} {shared}"), (2, shared), (None, b)]
    got = sorted(((r.doc_id or 99, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(1, 60, 0), (99, 60, 60), (99, 60, 0), (99, 60, 0), (99, 90, 30), (2, 30, 0)])


@pytest.mark.parametrize("base", [0, 1 << 61])
def test_texts_of_one_id_are_documents_of_their_own(spark, base):
    a, b, shared = prose(41, 60, 9000), prose(42, 60, 9000), prose(43, 30, 9000)
    rows = [(base + 5, a), (base + 5, b), (base + 5, a), (base + 7, f"{a} {shared}"), (base + 9, f"{shared} x"), (-base - 3, f"y {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(docs).collect())
    assert got == sorted([(base + 5, 60, 0), (base + 5, 60, 60), (base + 5, 60, 0), (base + 7, 90, 60), (base + 9, 31, 30), (-base - 3, 61, 0)])
    ids = [r.doc for r in numbered(docs).collect()]
    assert len(set(ids)) == 5


def test_large_ids_are_compared_as_others(spark):
    texts = [prose(50 + i % 3, 70, 9000) for i in range(6)]
    ids = [-(1 << 63), -5, 0, 7, (1 << 62) + 3, (1 << 63) - 1]
    rows = substring_dedup(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_repeats(zip(ids, texts))


def test_rows_without_shingles_stay_and_ties_have_an_order(spark):
    text, other = prose(61, 60), prose(62, 60)
    rows = [(None, None, "x"), (None, None, "y"), (None, "", "z"), (None, "", "w"), (7, text, "s1"), (7, text, "s2"), (9, text, "s0"),
            (11, other, "q"), (None, other, "p"), (12, " \n", "r"), (12, " \n", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _ in range(2):
        got = sorted(map(tuple, one_of_each(docs.repartition(3)).collect()), key=repr)
        assert got == sorted([*rows[:5], rows[7], rows[9], rows[10]], key=repr)


def test_names_of_other_columns_do_not_matter(spark):
    names = "_place _mix_x _mixture _llm_text_hash _llm_mark lang_pred root n `a.b` _id"
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names.split())
    rows = [(i, prose(i, 80, 4000), "en", "s", *["v"] * 10) for i in range(12)] + [(20, prose(3, 80, 4000), "en", "s", *["v"] * 10)]
    docs = spark.createDataFrame(rows, schema)
    for stage, n in ((language.in_known_language, 13), (one_of_each, 12), (in_mixed_order, 13)):
        out = stage(docs)
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) == n and all(set(r[4:]) == {"v"} for r in found)


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200, 5e-320])
def test_vectors_of_any_size_are_searched(spark, scale):
    rng = np.random.default_rng(4)
    base = np.rint(rng.standard_normal((60, 8)) * 50)
    rows = [(i, [float(x) * scale for x in v]) for i, v in enumerate(base)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=3).collect()
    unit = base / np.sqrt((base * base).sum(axis=1, keepdims=True))
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -np.inf)
    assert len(got) == 18
    for r in got:
        order = np.lexsort([np.arange(60), -cosine[r.query_id]])
        assert r.score == pytest.approx(cosine[r.query_id][order[r["rank"] - 1]], abs=1e-9 if scale != 5e-320 else 0.02)
