"""Personal data in plain and in disguised form, with offsets into the original text.

Transducers rewrite a text step by step and carry for every character of the result the
span of the source it came from: look-alike characters become ASCII, entities and written
"at" and "dot" become signs, spelled digits become digits. Identifiers that appear in the
rewritten text only are reported at their source spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing
# but the time that long runs take.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards so that long words cost linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand: leftmost and without overlap for each kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [(a, b, "email") for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                spans.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                spans.append((*m.span(), "phone"))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass
class Aligned:
    """A rewritten text; character i came from source[starts[i]:ends[i]]."""

    text: str
    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, text: str) -> Aligned:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Aligned:
        """Replaces all matches; what stands for a match has the span of all of it."""
        return self.replaced((*m.span(), to(m)) for m in pattern.finditer(self.text))

    def replaced(self, changes: Iterable[tuple[int, int, str]]) -> Aligned:
        """The same for (start, end, new text) in order."""
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        last = 0
        for a, b, new in changes:
            if new == self.text[a:b] or a == b:
                continue
            parts += (self.text[last:a], new)
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            last = b
        if not last:
            return self
        parts.append(self.text[last:])
        return Aligned("".join(parts), starts + self.starts[last:], ends + self.ends[last:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


#: Letters that look like ASCII ones: Cyrillic, then Greek, beside their look-alikes.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ",
        "ABESIJKMHOPCTYXaesijopcyxdhqwgABEZHIKMNOPTYXaikvoptux",
        strict=True,
    )
)
#: Characters without width, dashes, spaces and dots of other scripts.
MARKS = {
    **dict.fromkeys("­​‌‍⁠﻿", ""),
    **dict.fromkeys("‐‑‒–—−", "-"),
    **dict.fromkeys("     　", " "),
    **dict.fromkeys("․。ꓸ", "."),
}


def compatible(first: int, last: int) -> dict[str, str]:
    """Characters of a range whose compatibility form is one printable ASCII character."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(first, last + 1)}
    return {c: f for c, f in forms.items() if len(f) == 1 and "!" <= f <= "~"}


#: Other digits, circled and mathematical letters and digits, small and full-width forms.
CHARACTERS = (
    LOOKALIKES
    | MARKS
    | {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966) for d in range(10)}
    | compatible(0x2070, 0x209C)
    | compatible(0x2460, 0x24E9)
    | compatible(0xFE50, 0xFF5E)
    | compatible(0x1D400, 0x1D7FF)
)
LOOKALIKE = re.compile("[" + "".join(map(re.escape, CHARACTERS)) + "]")

ENTITY = re.compile(r"&(?:#64|#x40|commat|#46|#x2e|period);|%40", re.I)
OPEN, CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
AT, DOT = r"(?:at|@|arroba|chez|ät)", r"(?:dot|\.|punkt|punto|point)"
AT_IN_BRACKETS = re.compile(rf"(?<=[A-Za-z0-9]){OPEN}{AT}{CLOSE}(?=[A-Za-z0-9])", re.I)
DOT_IN_BRACKETS = re.compile(rf"(?<=[A-Za-z0-9]){OPEN}{DOT}{CLOSE}(?=[A-Za-z0-9])", re.I)
MARKED = re.compile(r"(?<=[A-Za-z0-9])(?: +@ +|_at_)(?=[A-Za-z0-9])", re.I)
#: name at host dot tld, the dots being written; or dotted names, "at" and a dotted host.
LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*"
WRITTEN_DOT = r"(?: +(?:dot|punkt|punto|point) +| +\. +)"
#: Last labels that count where the signs are words.
ENDINGS = """com net org edu gov mil int info biz io ai co me app dev xyz name online
uk us ca au nz ie de fr es it nl be ch at se no dk fi pl cz pt gr ru ua jp cn kr in br mx ar
cl za eu""".split()
#: From the sign on; the name before it is read backwards, so that long rows of written dots
#: take linear time. A run of blanks counts from its first one.
WRITTEN_HOST = re.compile(
    rf"(?:(?<! ) ++(?:at|arroba|chez|ät) ++|@)(?P<host>{LABEL}(?:(?:{WRITTEN_DOT}|\.){LABEL})*"
    rf"{WRITTEN_DOT}(?:{'|'.join(ENDINGS)}))(?![A-Za-z0-9-])",
    re.I,
)
DOTTED_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9]+[._%+-][A-Za-z0-9._%+-]*[A-Za-z0-9]|[A-Za-z]+[0-9]+)"
    rf"(?P<at> +(?:at|arroba|chez|ät) +)(?P<host>{LABEL}(?:\.{LABEL})*\.[A-Za-z]{{2,}})(?![A-Za-z0-9-])",
    re.I,
)
DOT_WORD = re.compile(WRITTEN_DOT, re.I)

#: Digits as words: English, then German, French and Spanish.
DIGIT_WORDS = {
    **dict.fromkeys("zero oh null cero zéro".split(), "0"),
    **dict.fromkeys("one eins ein un une uno".split(), "1"),
    **dict.fromkeys("two zwei zwo deux dos".split(), "2"),
    **dict.fromkeys("three drei trois tres".split(), "3"),
    **dict.fromkeys("four vier quatre cuatro".split(), "4"),
    **dict.fromkeys("five fünf cinq cinco".split(), "5"),
    **dict.fromkeys("six sechs seis".split(), "6"),
    **dict.fromkeys("seven sieben sept siete".split(), "7"),
    **dict.fromkeys("eight acht huit ocho".split(), "8"),
    **dict.fromkeys("nine neun neuf nueve".split(), "9"),
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "punkt": ".", "point": ".", "punto": "."}
DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9]+)"
SIGN = "(?:" + "|".join(sorted(SIGN_WORDS, key=len, reverse=True)) + ")"
#: What follows is neither blank nor sign, so nothing is given back.
BETWEEN = r"(?>[ \t]*+[,()-][ \t]*+(?:[()-][ \t]*+)?+|[ \t]++)"
#: Four spoken digits or more in a row; a plus may lead, dots may stand between.
SPOKEN = re.compile(
    rf"(?<!\w)(?:(?:plus|más|\+)(?:{BETWEEN})?)?{DIGIT}(?!\w)(?:{BETWEEN}(?:{SIGN}{BETWEEN})?{DIGIT}(?!\w)){{3,}}",
    re.I,
)
SPOKEN_PART = re.compile(rf"{SIGN}|{DIGIT}|\+", re.I)
NUMBER_DOT = re.compile(r"(?<=[0-9])(?: +(?:dot|punkt|punto|point) +)(?=[0-9])", re.I)
PLUS_WORD = re.compile(r"(?<!\w)(?:plus|más) +(?=[0-9])", re.I)

#: Parts that a match of the transducers below must hold. The first transducer that changes
#: a text sees it as it stands, so a text without any of these has nothing to undo.
HINTS = (
    ENTITY,
    re.compile(rf"[\[({{<][ \t]*(?:{AT}|{DOT})[ \t]*[\])}}>]", re.I),
    re.compile(r" @ |_at_", re.I),
    # written_emails and NUMBER_DOT; DOTTED_EMAIL; PLUS_WORD.
    re.compile(r" (?:dot|punkt|punto|point|\.) ", re.I),
    re.compile(rf" (?:at|arroba|chez|ät) +{LABEL}(?:\.{LABEL})*\.[A-Za-z]{{2}}", re.I),
    re.compile(r"(?:plus|más) +[0-9]", re.I),
    # SPOKEN from the sign before its second number.
    re.compile(rf"[ \t,()-]{DIGIT}(?!\w)(?:{BETWEEN}(?:{SIGN}{BETWEEN})?{DIGIT}(?!\w)){{2}}", re.I),
)


def hinted(text: str) -> bool:
    """False only where no transducer changes the text; a quick test that most texts fail."""
    if not text.isascii() and not CHARACTERS.keys().isdisjoint(text):
        return True
    return any(hint.search(text) for hint in HINTS)


def spoken(m: re.Match) -> str:
    parts = SPOKEN_PART.findall(m[0])
    if all(p[0].isdigit() or p == "+" for p in parts):
        return m[0]
    return "".join(SIGN_WORDS.get(p.lower()) or DIGIT_WORDS.get(p.lower()) or p for p in parts)


NAME = LOCAL - {"."}
DOTS = ("dot", "punkt", "punto", "point", ".")


def before_dot(text: str, end: int) -> int:
    """Where a written dot that ends at ``end`` begins; ``end`` if none does."""
    at = end
    while at and text[at - 1] == " ":
        at -= 1
    if at == end:
        return end
    for word in DOTS:
        start = at - len(word)
        if start > 0 and text[start:at].lower() == word and text[start - 1] == " ":
            while start and text[start - 1] == " ":
                start -= 1
            return start
    return end


def name_start(text: str, end: int, least: int) -> int:
    """Where the longest name that ends at ``end`` begins: runs of its characters with written
    dots between them, of which only the first may hold plain dots. ``end`` if there is none."""
    start = end
    while True:
        at = start
        while at > least and text[at - 1] in NAME:
            at -= 1
        if at > least and text[at - 1] == ".":
            while at > least and text[at - 1] in LOCAL:
                at -= 1
            return at
        dot = before_dot(text, at)
        if at == start or dot == at or dot <= least or text[dot - 1] not in LOCAL:
            return at
        start = dot


def written_emails(text: str) -> Iterator[tuple[int, int, str]]:
    """name at host dot tld, the dots being written, as an address."""
    end = 0
    m = WRITTEN_HOST.search(text)
    while m:
        start = name_start(text, m.start(), end)
        if start < m.start() and (start == 0 or text[start - 1] not in LOCAL):
            name, host = DOT_WORD.sub(".", text[start : m.start()]), DOT_WORD.sub(".", m["host"])
            end = m.end()
            yield start, end, f"{name}@{host}"
            m = WRITTEN_HOST.search(text, end)
        else:
            # A sign without a name may be a label of the host before the next one.
            m = WRITTEN_HOST.search(text, m.start() + 1)


#: The transducers in the order in which they run.
TRANSDUCERS: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
    (LOOKALIKE, lambda m: CHARACTERS[m[0]]),
    (ENTITY, lambda m: "@" if m[0].lower() in ("&#64;", "&#x40;", "&commat;", "%40") else "."),
    (AT_IN_BRACKETS, lambda m: "@"),
    (DOT_IN_BRACKETS, lambda m: "."),
    (MARKED, lambda m: "@"),
    (WRITTEN_HOST, written_emails),
    (DOTTED_EMAIL, lambda m: f"{m['name']}@{m['host']}"),
    (SPOKEN, spoken),
    (NUMBER_DOT, lambda m: "."),
    (PLUS_WORD, lambda m: "+"),
]


def normalised(text: str) -> Aligned:
    aligned = Aligned.of(text)
    for pattern, to in TRANSDUCERS:
        if to is written_emails:
            aligned = aligned.replaced(written_emails(aligned.text))
        else:
            aligned = aligned.rewrite(pattern, to)
    return aligned


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows; none overlaps a plain one of its kind."""
    if not hinted(text):
        return []
    aligned = normalised(text)
    if aligned.text == text:
        return []
    found: list[Span] = []
    taken = {kind: sorted((a, b) for a, b, k in plain if k == kind) for kind in KINDS}
    for start, end, kind in plain_spans(aligned.text):
        a, b = aligned.source(start, end)
        if text[a:b] == aligned.text[start:end]:
            continue
        near = taken[kind]
        at = bisect_left(near, (a, b))
        if any(x < b and a < y for x, y in near[max(0, at - 1) : at + 1]):
            continue
        found.append((a, b, kind))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans; those and the disguised ones. By start, then kind."""
    plain = plain_spans(text)
    return plain, in_order(plain + disguised_spans(text, plain))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email to n_phone, base_sha256, spans, plain.

    ``plain`` are the identifiers as they stand (counted and digested), ``spans`` those and the disguised ones,
    both as kind:start:end (code points, end exclusive) by start, then kind, joined by commas.
    A NULL or empty text has none; repeated rows have the same; other columns are not read; an
    empty table gives an empty result. Whole texts are searched. There is no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(text.as_py() or "") for text in batch.column(1)]
            counts = [[sum(s[2] == k for s in plain) for plain, _ in found] for k in KINDS]
            lists = [listed(plain) for plain, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists], pa.string()),
                    pa.array([listed(spans) for _, spans in found], pa.string()),
                    pa.array(lists, pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "plain"],
            )

    schema = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col("text")).mapInArrow(
        search, f"doc_id {kind}, {schema}, base_sha256 string, spans string, plain string"
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    parts: list[str] = []
    at = end = 0
    for a, b, kind in spans:
        if a >= end:
            parts += (text[at:a], f"[{kind.upper()}]")
        end = max(end, b)
        at = end
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All columns, with personal data in text replaced by [EMAIL], [IP], [CARD], [PHONE].

    Every row stays; a NULL text stays NULL; n_chars, where there is such a column, is the new length.
    """
    columns = docs.columns

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: t if t is None else masked(t, all_spans(t)[1]))

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
