"""Personal data: identifiers in plain and in disguised form, with spans in the source text.

Plain identifiers are found by four patterns. Disguised ones are found in a normalised text.
Small transducers follow each other: look-alike characters, invisible characters, character
references, bracketed dots, letters and signs set apart by blanks, at/dot disguises, spelled
digits with multipliers, and letters that stand for digits. Each reads what the one before it
wrote, and every character remembers which source characters it stands for, so that each span
found in the end maps back exactly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end: they sort as results are ordered

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile("[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def find_plain(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, in result order.

    Linear in the text: an address is grown from its @ instead of tried from every letter.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at != -1:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, 0, done))
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _look_alikes() -> dict[int, str]:
    out = {}
    pairs = {
        "аɑα": "a", "ЬƄ": "b", "сϲ": "c", "ԁ": "d", "еҽ": "e", "ғ": "f", "ɡ": "g", "һ": "h", "іıɩ": "i", "јϳ": "j", "кκ": "k",
        "ӏⅼ": "l", "ⅿ": "m", "ո": "n", "оοօ": "o", "рρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υս": "u", "ѵν": "v",
        "ԝѡ": "w", "хχ": "x", "уγ": "y", "ᴢ": "z", "АΑ": "A", "ВΒ": "B", "СϹ": "C", "ЕΕ": "E", "НΗ": "H", "ІΙ": "I", "Ј": "J",
        "КΚ": "K", "Μ": "M", "М": "M", "Ν": "N", "ОΟ": "O", "РΡ": "P", "Ѕ": "S", "ТΤ": "T", "ХΧ": "X", "УΥ": "Y", "Ζ": "Z",
        "․‧。": ".", "‐‑‒–—−﹣": "-", "    ": " ", "﹫": "@", "﹢": "+",
    }
    for many, one in pairs.items():
        out |= {ord(c): one for c in many}
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full width
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        out |= {zero + k: str(k) for k in range(10)}
    out |= {0x2460 + k: str(k + 1) for k in range(9)} | {0x24EA: "0"}
    for k, c in enumerate("0123456789"):
        out |= {ord("⁰¹²³⁴⁵⁶⁷⁸⁹"[k]): c, ord("₀₁₂₃₄₅₆₇₈₉"[k]): c}
    return out


LOOK_ALIKES = _look_alikes()
_INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile("[" + re.escape("".join(map(chr, LOOK_ALIKES)) + _INVISIBLE) + "]")
_DIGIT_WORDS = {
    w: str(k)
    for k, ws in enumerate(
        ("zero oh null cero zéro", "one eins uno", "two zwei dos deux zwo", "three drei tres trois", "four vier cuatro quatre",
         "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")
    )
    for w in ws.split()
}
_WORD_ALT = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3, "tripel": 3}
_DIGIT = rf"(?:(?:(?:{'|'.join(_TIMES)})\s+)?(?:{_WORD_ALT})(?![^\W\d_])|[0-9]+)"
_DOT = r"(?:\s+-\s?(?:dot|punkt|punto)\s?-\s+|\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\s*_dot_\s*)"
_AT = r"(?:\s+-\s?at\s?-\s+|\s*[\[({<]\s*(?:at|@|arroba)\s*[\])}>]\s*|\s+(?:at|arroba)\s+|\s*_at_\s*|\s+@\s+)"
_HARD_AT = r"(?:\s+-\s?at\s?-\s+|\s*[\[({<]\s*(?:at|@|arroba)\s*[\])}>]\s*|\s*_at_\s*)"
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:" + _DOT + r"[A-Za-z0-9_%+-]{1,64}){0,3}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
#: Where both at and dot are mere words, the last label must be one of these: prose has such words too.
_TOP = r"(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|co|app|dev|me|tv|eu|uk|us|ca|au|de|at|ch|fr|es|it|nl|be|pt|pl|se|no|dk|fi|ie|ru|ua|jp|cn|in|br|mx|ar|nz|za|example|test|invalid|local)(?![A-Za-z0-9-])"
#: An address whose at sign is in brackets, or whose at is a word and at least one dot is disguised too.
_ADDRESS = re.compile(
    rf"{_NAME}(?:{_HARD_AT}{_LABEL}(?:(?:{_DOT}|\.){_LABEL})+|(?:{_AT}|@){_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,4}}{_DOT}{_TOP}|{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}\.{_TOP}|\s+@\s+{_LABEL}(?:\.{_LABEL})+)",
    re.IGNORECASE,
)
_ADDRESS_HINTS = ("dot", "punkt", "punto", "arroba", "_at_", " @ ", "@\n", "\n@", "[", "(", "{", "<")
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|arroba|dot|punkt|punto|point|\.)\s*[\])}>]", re.IGNORECASE)
_DOT_RE, _AT_RE = re.compile(_DOT, re.IGNORECASE), re.compile(_AT, re.IGNORECASE)
_SEP = rf"(?:[\s,()]+|\s*[-]\s*|{_DOT}|\.)"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|más|mas)\s+|\+\s*)?{_DIGIT}(?:{_SEP}{_DIGIT}){{3,}}", re.IGNORECASE)
_SPELLED_WORDS = frozenset(_DIGIT_WORDS) | frozenset(_TIMES) | {"dot", "punkt", "punto", "(dot)", "[dot]", "{dot}"}
_SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_WORD_ALT})(?![^\W\d_])|dot|punkt|punto", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?:plus|más|mas)\s+|\+\s*|{_DOT}|\.|{_DIGIT}|[\s,()-]+", re.IGNORECASE)


class Normalised:
    """A text and, for each of its characters, the source characters [first, last) it stands for."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.first, self.last, at = [], [], [], 0
        for start, end, new in edits:
            parts += text[at:start], new
            self.first += [*range(at, start), *[start] * len(new)]
            self.last += [*range(at + 1, start + 1), *[end] * len(new)]
            at = end
        parts.append(text[at:])
        self.first += range(at, len(text))
        self.last += range(at + 1, len(text) + 1)
        self.text = "".join(parts)

    def then(self, edits: list[tuple[int, int, str]]) -> Normalised:
        """What a further transducer makes of this text, mapped to the same source."""
        new = Normalised(self.text, edits)
        new.first, new.last = [self.first[k] for k in new.first], [self.last[k - 1] for k in new.last]
        return new

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.first[start], self.last[end - 1]


def _address_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ADDRESS.finditer(text):
        at = max(_AT_RE.finditer(m[0]), key=lambda x: len(x[0]), default=None)
        for x in _DOT_RE.finditer(m[0]):
            if not (at and x.start() < at.end() and at.start() < x.end()):
                yield m.start() + x.start(), m.start() + x.end(), "."
        if at:
            yield m.start() + at.start(), m.start() + at.end(), "@"


def _digit_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED.finditer(text):
        if not (_SPELLED_HINT.search(m[0])):
            continue
        new = []
        for x in _SPELLED_PART.finditer(m[0]):
            part = x[0].strip().lower()
            times, _, word = part.rpartition(" ")
            if part in _DIGIT_WORDS:
                new.append(_DIGIT_WORDS[part])
            elif times.strip() in _TIMES:
                new.append(_DIGIT_WORDS[word] * _TIMES[times.strip()])
            elif part.isdigit():
                new.append(part)
            elif part[:1] == "+" or part[:2] in ("pl", "má", "ma"):
                new.append("+")
            elif part == "." or any(c in part for c in "dp"):
                new.append(".")
        yield m.start(), m.end(), "".join(new)


_REFERENCE = re.compile(r"&#(?:x([0-9a-f]{2})|([0-9]{2,3}));|&(commat|period|plus|hyphen|lowbar);|(?<=[a-z0-9])%(40|2e|2b|2d)(?=[a-z0-9])", re.IGNORECASE)
_NAMED = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "lowbar": "_"}


def _reference_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Character references and percent codes of printable ASCII."""
    for m in _REFERENCE.finditer(text):
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else ord(_NAMED[m[3].lower()]) if m[3] else int(m[4], 16)
        if 33 <= code < 127:
            yield m.start(), m.end(), chr(code)


_HELD_DOT = re.compile(r"(?<=[0-9])\s?[\[({<]\s?(?:\.|dot|punkt|punto)\s?[\])}>]\s?(?=[0-9])", re.IGNORECASE)


def _held_dot_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Dots in brackets between digits."""
    for m in _HELD_DOT.finditer(text):
        yield m.start(), m.end(), "."


_LETTERS_APART = re.compile(r"(?<!\S)(?:[A-Za-z0-9._%+-] ){2,}@(?: [A-Za-z0-9.-]){4,}(?!\S)")
_SIGNS_APART = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} ?@ ?{_LABEL}(?: ?\. ?{_LABEL})*? \. ?{_TOP}", re.IGNORECASE)
_LETTER_AT = re.compile(rf"(?<=[A-Za-z0-9])[\[({{](?:a|ä|at)[\])}}](?={_LABEL}(?:\.{_LABEL})*\.{_TOP})", re.IGNORECASE)


def _apart_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Blanks between the letters of an address, and around its signs; an a in brackets for the at sign."""
    done = 0
    for m in sorted([*_LETTERS_APART.finditer(text), *_SIGNS_APART.finditer(text)], key=lambda m: (m.start(), -m.end())):
        if m.start() >= done:
            done = m.end()
            yield from ((m.start() + k, m.start() + k + 1, "") for k, c in enumerate(m[0]) if c == " ")


def _letter_at_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _LETTER_AT.finditer(text):
        yield m.start(), m.end(), "@"


_ONE_OR_ZERO = str.maketrans("lIOo", "1100")
_LETTER_DIGITS = re.compile(
    r"(?<![A-Za-z0-9.])(?:\+[0-9lIOo](?:[ ().-]{0,2}[0-9lIOo]){9,14}|[0-9lIOo](?:[ -]?[0-9lIOo]){13,18}|[0-9lIOo]{1,3}(?:\.[0-9lIOo]{1,3}){3})(?![A-Za-z0-9])"
)


def _letter_digit_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Letters that look like 1 or 0, in an identifier of which each group (of an IP, half) has true digits."""
    for m in _LETTER_DIGITS.finditer(text):
        groups = [g for g in re.split("[ ().+-]+", m[0]) if g] if m[0].count(".") != 3 else [m[0]]
        letters = sum(map(m[0].count, "lIOo"))
        if letters and 2 * letters <= sum(map(str.isalnum, m[0])) and all(any("0" <= c <= "9" for c in g) for g in groups):
            yield from ((m.start() + k, m.start() + k + 1, c.translate(_ONE_OR_ZERO)) for k, c in enumerate(m[0]) if c in "lIOo")


_LETTER_BY_DIGIT = re.compile(r"[0-9][ .-]?[lIOo]|[lIOo][ .-]?[0-9]")
_APART = str.maketrans(dict.fromkeys("-,.()", " "))


def _has_digit_words(low: str) -> bool:
    """Whether four words in a row can be digits, spelled or not, and dots; one at least spelled or a dot."""
    words = low.translate(_APART).split()
    if _SPELLED_WORDS.isdisjoint(words):
        return False
    run = 0
    for w in words:
        run = run + 1 if w in _SPELLED_WORDS or "0" <= w[0] <= "9" or w[0] in "+([{<_" else 0
        if run > 3:
            return True
    return False


def normalise(text: str) -> Normalised | None:
    """The text without its disguises; None where there are none."""
    odd = not text.isascii() and bool(_ODD.search(text))
    plain = text.translate(LOOK_ALIKES) if odd else text
    now = Normalised(plain, []) if odd else None

    def apply(edits: Iterator[tuple[int, int, str]]) -> None:
        nonlocal now
        apart, end = [], 0
        for e in sorted(edits):
            if e[0] >= end:
                apart.append(e)
                end = e[1]
        if apart:
            now = (now or Normalised(plain, [])).then(apart)

    read = lambda: now.text if now else plain
    if odd:  # what is invisible goes first, so that it hides no other disguise
        apply((m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", plain))
    if "&#" in plain or "%" in plain or "&" in plain and ";" in plain:
        apply(_reference_edits(read()))
    low = read().lower()
    bracketed = any(map(low.__contains__, _ADDRESS_HINTS[8:]))
    if bracketed:
        apply(_held_dot_edits(read()))
        apply(_letter_at_edits(read()))
    if " @" in low or "@ " in low or " ." in low and "@" in low:
        apply(_apart_edits(read()))
    if any(map(low.__contains__, _ADDRESS_HINTS[:8])) or bracketed and _BRACKETED.search(low):
        apply(_address_edits(read()))
    if _has_digit_words(low):
        apply(_digit_edits(read()))
    if _LETTER_BY_DIGIT.search(read()):
        apply(_letter_digit_edits(read()))
    return now


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and plain and disguised ones together; both in result order.

    A disguised span is left out where a plain one of its kind holds it whole.
    """
    base = find_plain(text)
    norm = normalise(text)
    if norm is None:
        return base, base
    more = set()
    starts = {k: [s for s in base if s[1] == k] for k in range(4)}
    for start, kind, end in find_plain(norm.text):
        s, e = norm.source(start, end)
        own = starts[kind]
        k = bisect_left(own, (s + 1,))
        if not (k and own[k - 1][2] >= e):
            more.add((s, kind, e))
    return base, sorted({*base, *more})


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_<kind> of the plain spans, n_added, base_sha256 and spans (see `find_all`).

    Offsets are code points, ends exclusive. A null or empty text has no spans: counts 0,
    the hash of an empty string, and an empty string. Rows are judged alone, so null ids and
    repeated rows come out as they went in; an empty table gives an empty one; other columns are
    ignored. One pass, no shuffle; memory is one Arrow batch.
    """
    bound_batches(docs.sparkSession)
    names = [id_col, *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], [], []]
            hashes, spans = [], []
            for t in batch.column(1):
                base, every = find_all(t.as_py() or "")
                kinds = [s[1] for s in base]
                for k in range(4):
                    counts[k].append(kinds.count(k))
                counts[4].append(len(every) - len(base))
                hashes.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(every))
            new = [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names)

    slim = docs.select(F.col(id_col), F.col(text).alias("_text"))
    schema = slim.drop("_text").schema
    for name in names[1:6]:
        schema = schema.add(name, "long")
    return slim.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def redact(docs: DataFrame, text: str = "text", mark: str = "<{kind}>") -> DataFrame:
    """`docs` with every span of `find_all` replaced by a mark; overlapping spans become one.

    All columns, rows and repeats stay; a null text stays null.
    """
    bound_batches(docs.sparkSession)
    at, schema = docs.columns.index(text), docs.schema

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, done = [], 0
        for start, kind, end in find_all(value)[1]:
            if start >= done:
                out += value[done:start], mark.format(kind=KINDS[kind])
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t.as_py()) for t in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)
