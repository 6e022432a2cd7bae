"""PII detection through disguises, with the offsets of the source text.

Three transducers are applied in turn: homoglyphs, wide forms and invisible characters become plain
characters; spelled digits become digits; written-out "at" and "dot" become @ and full stops. Each keeps
the edits it made, so a span found in the normalised text maps back to the source characters it came from.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Letters that look like Latin ones. Wide and mathematical forms come from their compatibility decomposition.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "·": ".", "﹫": "@",
}
_INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]))


def _single(c: str) -> str | None:
    """What stands for c, if that is something else."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded != c and len(folded) == 1 and folded.isascii() else None


_TABLE = {ord(c): plain for c in map(chr, [*range(0x80, 0x3100), *range(0xA600, 0xAC00), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]) if (plain := _single(c))} | {ord(c): "" for c in _INVISIBLE}
_STRANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_TABLE)) + "]")

_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SPELLED = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r")(?!\w)", re.I)
#: At least three spelled digits or digit groups in a row, one of them spelled, with no more than a mark or plus between.
_RUN = re.compile(rf"(?:(?<!\w)(?:{'|'.join(sorted(_DIGITS, key=len, reverse=True))})(?!\w)|(?<![^\W\d_])\d+(?![^\W\d_]))(?:[ \t]{{0,2}}[-.,/()]?[ \t]{{0,2}}(?:(?<!\w)(?:{'|'.join(sorted(_DIGITS, key=len, reverse=True))})(?!\w)|\d+(?![^\W\d_]))){{2,}}", re.I)
_AT = re.compile(r"[ \t]*(?:[\[({<]{1,2}[ \t]*(?:at|@|arroba|ät)[ \t]*[\])}>]{1,2}|(?:_|-)at(?:_|-))[ \t]*", re.I)
_DOT = re.compile(r"[ \t]*[\[({<]{1,2}[ \t]*(?:dot|\.|punkt|punto|point)[ \t]*[\])}>]{1,2}[ \t]*", re.I)
#: Bare words count only where the whole address is written out: name at host dot tld.
_WORDED = re.compile(r"(?<![\w.%+-])[\w.%+-]+((?:[ \t]+at[ \t]+)|@|[ \t]+@[ \t]+)[a-z0-9-]+((?:[ \t]+dot[ \t]+|\.)[a-z0-9-]+)*(?:[ \t]+dot[ \t]+|\.)[a-z]{2,24}(?!\w)", re.I)
_INNER_AT, _INNER_DOT = re.compile(r"[ \t]+(?:at|@)[ \t]+", re.I), re.compile(r"[ \t]+dot[ \t]+", re.I)
_ONE = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
#: For RE2, over a column: texts with a spelled digit before another digit, as every run has, and texts that need any of this at all.
_QUICK_SPELLED = rf"(?i){_ONE}[ \t,./()-]+(?:{_ONE}|\p{{Nd}})"
_QUICK = rf"(?i:[@\p{{Nd}}]|[\[({{<][ \t]*(?:at|arroba|ät|dot|\.|punkt|punto|point)|[_-]at[_-]|[ \t]dot[ \t]|{_QUICK_SPELLED[4:]})|[" + "".join(rf"\x{{{c:x}}}" for c in sorted(_TABLE)) + "]"
_PAIR = re.compile(rf"(?<!\w){_ONE}[ \t,./()-]+(?:{_ONE}|\d)", re.I)

#: Where numbers of eight digits and more may stand; the patterns below only look there.
_NUMERIC = re.compile(r"[+(0-9][0-9 ().+-]{6,}")
_EMAIL_HOST = re.compile(r"@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}(?![\w-])", re.I | re.A)
_IBAN = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
_NUMBERS = {
    "ipv4": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", re.A),
    "card": re.compile(r"(?<![\w.])(?:\d[ -]?){12,18}\d(?!\w)", re.A),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}(?![\w-])", re.A),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.%+-")


def _matches(plain: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all candidates, by kind in order of precedence."""
    at = plain.find("@")
    while at >= 0:
        a = at
        while a and plain[a - 1] in _LOCAL:
            a -= 1
        while a < at and not plain[a].isalnum():
            a += 1
        if a < at and (m := _EMAIL_HOST.match(plain, at)):
            yield "email", a, m.end()
        at = plain.find("@", at + 1)
    areas = [(m.start(), m.end()) for m in _NUMERIC.finditer(plain)]
    if areas:
        for m in _NUMBERS["ipv4"].finditer(plain) if plain.count(".") >= 3 else ():
            yield "ipv4", m.start(), m.end()
    for m in _IBAN.finditer(plain):
        yield "iban", m.start(), m.end()
    for kind in ("card", "ssn", "phone"):
        for a, b in areas:
            for m in _NUMBERS[kind].finditer(plain, a, min(b + 2, len(plain))):
                yield kind, m.start(), m.end()


class Edits:
    """The replacements that one transducer made: source span (a, b) became the target span (x, y)."""

    def __init__(self) -> None:
        self.a: list[int] = []
        self.b: list[int] = []
        self.x: list[int] = []
        self.y: list[int] = []

    def apply(self, text: str, changes: list[tuple[int, int, str]]) -> str:
        out, last, shift = [], 0, 0
        for a, b, new in changes:
            out += [text[last:a], new]
            self.a.append(a)
            self.b.append(b)
            self.x.append(a + shift)
            self.y.append(a + shift + len(new))
            shift += len(new) - (b - a)
            last = b
        return "".join([*out, text[last:]]) if changes else text

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a target span; an edit that it touches comes whole."""
        k = bisect_right(self.y, start)  # the first edit that ends behind start
        if k < len(self.x) and self.x[k] <= start:
            first = self.a[k]
        else:
            first = start - self.y[k - 1] + self.b[k - 1] if k else start
        k = bisect_left(self.x, end) - 1  # the last edit that starts before end
        if k >= 0 and self.y[k] >= end and self.y[k] > self.x[k]:
            last = self.b[k]
        else:
            last = end - self.y[k] + self.b[k] if k >= 0 else end
        return first, last


def normalise(text: str, spelled: bool | None = None) -> tuple[str, list[Edits]]:
    """The text in plain spelling, and the edits of each transducer in turn.

    spelled: whether a spelled digit comes before another digit in the text as it is, where that is known.
    """
    trail = []

    def step(text: str, changes: list[tuple[int, int, str]]) -> str:
        if not changes:
            return text
        edits = Edits()
        trail.append(edits)
        return edits.apply(text, changes)

    if not text.isascii():
        text = step(text, [(m.start(), m.end(), _TABLE[ord(m[0])]) for m in _STRANGE.finditer(text)])
        if trail:
            spelled = None  # known of the disguised text only
    changes = []
    for m in _RUN.finditer(text) if (_PAIR.search(text) if spelled is None else spelled) else ():
        digits = list(_SPELLED.finditer(text, m.start(), m.end()))
        if len(digits) < 3:
            continue
        for k, d in enumerate(digits):
            # blanks between two spelled digits go, so that they make one number
            end = d.end()
            if k + 1 < len(digits) and not text[end : digits[k + 1].start()].strip(" \t"):
                end = digits[k + 1].start()
            changes.append((d.start(), end, _DIGITS[d[0].lower()]))
    text = step(text, changes)
    low = text.lower()
    bracket = any(c in text for c in "[({<")
    changes = [(m.start(), m.end(), "@") for m in _AT.finditer(text)] if bracket or "_at_" in low or "-at-" in low or "_at-" in low or "-at_" in low else []
    changes += [(m.start(), m.end(), ".") for m in _DOT.finditer(text)] if bracket else []
    changes.sort()
    text = step(text, [c for k, c in enumerate(changes) if not k or c[0] >= changes[k - 1][1]])
    changes = []
    worded = " dot" in text.lower() or "\tdot" in text.lower() or " @" in text or "@ " in text or "\t@" in text or "@\t" in text
    for m in _WORDED.finditer(text) if worded else ():
        if "dot" not in m[0].lower() and not m[1].strip() == "@":
            continue  # "look at example.com" is no address
        at = list(_INNER_AT.finditer(text, m.start(), m.end()))[:1]
        dots = list(_INNER_DOT.finditer(text, m.start(), m.end()))
        if at or "@" in m[0]:
            changes += [(x.start(), x.end(), "@") for x in at] + [(x.start(), x.end(), ".") for x in dots]
    return step(text, sorted(changes)), trail


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    if kind == "ipv4":
        return all(int(x) < 256 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        marked = found.startswith("+") or "(" in found or re.search(r"\d[ .-]\d", found)
        return bool(marked) and 8 <= len(digits) <= 15 and not re.fullmatch(r"\d{4}[.-]\d\d[.-]\d\d|\d\d[.-]\d\d[.-]\d{4}", found) or not marked and 9 <= len(digits) <= 12
    if kind == "iban":
        moved = re.sub(r"\s", "", found)
        moved = moved[4:] + moved[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    return True


def detect(text: str, spelled: bool | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of the identifiers of a text; start and end count its characters.

    Kinds are tried in order; a later one does not overlap an earlier one.
    """
    plain, trail = normalise(text, spelled)
    taken: list[tuple[int, int]] = []
    found = []
    for kind, a, b in _matches(plain):
        if not _valid(kind, plain[a:b]):
            continue
        k = bisect_left(taken, (b, -1))
        if k and taken[k - 1][1] > a:
            continue
        taken.insert(k, (a, b))
        start, end = a, b
        for edits in reversed(trail):
            start, end = edits.back(start, end)
        found.append((kind, start, end, plain[a:b]))
    return sorted(found, key=lambda x: (x[1], x[2]))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, source, value, disguised): each identifier, where it stands in the text,
    how it is written there and what it says.

    Null and empty texts have none; a null doc_id is reported as such, repeated rows are reported each, and
    further columns are ignored. Spans of a document don't overlap.
    """
    names = ["doc_id", "kind", "start", "end", "source", "value", "disguised"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            suspects = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(1), _QUICK), False)))
            spelled = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(1), _QUICK_SPELLED), False))
            for k in suspects.tolist():
                text, doc = batch.column(1)[k].as_py(), batch.column(0)[k].as_py()
                rows += [(doc, kind, a, b, text[a:b], value, text[a:b] != value) for kind, a, b, value in detect(text, bool(spelled[k]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, start long, end long, source string, value string, disguised boolean")
