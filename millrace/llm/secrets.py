"""Secret scans: values in credential contexts, rated by the least cost at which they are guessed.

A dynamic program over the value finds the cheapest segmentation into dictionary words (also capitalised,
in leet spelling or reversed), dates, repeats, sequences, keyboard walks and spans tried by brute force.
Costs are decimal logarithms of guesses and add up; each segment costs SEGMENT more, and a value that takes
10 ** CEILING guesses or more counts as that many.

The dictionary is WORDS and the DICTIONARY most frequent words of the corpus, counted over all of its texts
except in credential contexts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 0.3
#: From here on a value is a secret; below it is a placeholder or prose.
SECRET_FROM = 6.0
STRONG_FROM = 10.0
CEILING = 40.0
MASK = "[SECRET]"
#: Words taken from the corpus: those of LETTERS letters, by their number of occurrences.
DICTIONARY, LETTERS = 50_000, (3, 24)
_KEYS = r"passwords?|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?key|credentials?|bearer"
#: For RE2 and Java, to tell quickly which texts need the full pattern.
_QUICK = rf"(?i)(?:{_KEYS})"
_KEY = re.compile(_QUICK)
#: A name and what is set to it; the name is possessive, so that the search stays linear.
_CONTEXT = r"(?i)(?<![a-z0-9_-])([a-z0-9_-]++)[\"']?[ \t]*+(?:=>|:=|[:=])[ \t]*+(?:\"([^\"\n]++)\"|'([^'\n]++)'|([^\s\"',;<>]++))"
_ASSIGNED = re.compile(_CONTEXT)
#: Values that name a secret and do not hold it: templates, variables, attributes and calls.
_REFERENCE = re.compile(r"\$\{?\w+\}?|\$\([^)]*\)|\{\{.*\}\}|\{\w*\}|%\w+%|%\(\w+\)s|[a-z_]+(?:\.[a-z_]+)+(?:[\[(].*)?|[a-z_]+(?:\.[a-z_]+)*[\[(].*", re.I | re.A)

WORDS = (
    "password 123456 qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football baseball superman batman "
    "iloveyou trustno1 access hello secret test guest root changeme default example sample dummy user username pass passwd temp temporary "
    "foobar foo bar none null true false yes no redacted hidden your my the and for with from this that here token key value string "
    "insert replace placeholder todo unknown required optional empty field enter type please set not set must should can forgot reset "
    "love life money house home work world time day night week month year spring summer autumn winter monday tuesday wednesday thursday "
    "friday saturday sunday january february march april may june july august september october november december red green blue black "
    "white yellow orange purple silver gold star moon sun sky fire water earth wind stone tree flower river ocean mountain cat dog bird "
    "fish horse lion tiger bear wolf eagle snake computer internet server system network database private public production staging "
    "development service account client session cookie bearer basic auth oauth api access refresh config configuration environment "
    "variable correct horse battery staple apple banana cherry coffee cheese pizza chocolate cookie summer2020 michael jennifer jordan "
    "charlie thomas robert daniel andrew joshua matthew jessica ashley nicole hunter ranger buster soccer hockey killer george harley "
    "maggie pepper ginger cheese killer matrix mustang corvette ferrari porsche mercedes yankees cowboys lakers liverpool chelsea arsenal"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(dict.fromkeys(WORDS))))}
#: The longest date, or word of the dictionary.
_LONGEST = max(LETTERS[1], 10)
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "0": "o", "1": "i", "!": "i", "$": "s", "5": "s", "7": "t"})
_ROWS = ["`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./"]
_SHIFT = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_AT = {c: (x + y * 0.5, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row) if c != " "}
_DATE = re.compile(r"(?:19|20)\d\d([-/._ ]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._ ]?)(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _next_to(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def brute_cost(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def word_cost(s: str, ranks: dict[str, int] = RANK) -> float | None:
    """The cost of a dictionary word in any of its disguises."""
    low = s.lower()
    best = None
    for form, extra in ((low, 0.0), (low[::-1], log10(2)), (low.translate(_LEET), 0.6)):
        if form in ranks:
            capitals = sum(c.isupper() for c in s)
            shape = 0.0 if not capitals else log10(2) if s[0].isupper() and capitals == 1 or capitals == len(s) else log10(2) * min(capitals, len(s) - capitals) + log10(2)
            cost = log10(ranks[form] + 1) + extra + shape
            best = cost if best is None else min(best, cost)
    return best


def _unshifted(s: str) -> str:
    """The keys of a text: small letters, and the marks that share a key with digits and others."""
    low = s.lower()
    return low.translate(_SHIFT) if len(low) == len(s) else s


def pattern_costs(s: str, i: int, keys: str | None = None, ranks: dict[str, int] = RANK, most: float = CEILING) -> Iterator[tuple[int, float]]:
    """(end, cost) of the words, dates, sequences and keyboard walks that start at i and cost most at most; all ends of each."""
    keys = _unshifted(s) if keys is None else keys
    for j in range(i + 2, min(len(s), i + _LONGEST) + 1):
        if (cost := word_cost(s[i:j], ranks)) is not None:
            yield j, cost
    for j in range(i + 4, min(len(s), i + 10) + 1):
        if m := _DATE.fullmatch(s, i, j):
            yield j, log10(365 * 60) + (log10(4) if m[1] or m[2] else 0) if j - i > 4 else log10(60)
    if i + 1 < len(s):
        step = ord(s[i + 1]) - ord(s[i])
        if abs(step) in (1, 2) and s[i].isalnum():
            j = i + 2
            while j < len(s) and ord(s[j]) - ord(s[j - 1]) == step and s[j].isalnum():
                j += 1
                yield j, log10(60) + log10(j - i)
        j, turns, before = i + 1, 0, None
        while j < len(keys) and _next_to(keys[j - 1], keys[j]):
            way = (_AT[keys[j]][0] - _AT[keys[j - 1]][0], _AT[keys[j]][1] - _AT[keys[j - 1]][1])
            turns += way != before
            before = way
            j += 1
            if turns * log10(4.6) > most:
                break
            if j - i >= 3:
                yield j, log10(47) + log10(j - i) + turns * log10(4.6)


def _extent(s: str, i: int, unit: int) -> int:
    """How far from i on characters equal those a unit further, that unit included."""
    n = len(s) - unit
    at, step = i, 64
    while at < n and s[at : min(at + step, n)] == s[at + unit : min(at + step, n) + unit]:
        at = min(at + step, n)
        step *= 2
    lo, hi = at, min(at + step, n)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if s[at:middle] == s[at + unit : middle + unit] else (lo, middle - 1)
    return lo + unit - i


def repeats(s: str, i: int) -> Iterator[tuple[int, int]]:
    """(end, unit) of the repeats that start at i: whole numbers of a unit, two at least.

    Ends that cannot matter are left out: those so far from the end of a run that no segment which begins there
    reaches beyond it, and units longer than any word that repeat a shorter one.
    """
    n = len(s)
    run = 0  # the longest, and its unit
    period = 1
    for unit in range(1, min(_LONGEST, (n - i) // 2) + 1):
        if s[i : i + unit] != s[i + unit : i + 2 * unit]:
            continue
        size = _extent(s, i, unit)
        if size > run:
            run, period = size, unit
        for k in range(max(2, (size - _LONGEST - unit) // unit), size // unit + 1):
            yield i + k * unit, unit
    unit = _LONGEST + 1
    if n - i < 2 * unit:
        return
    head = s[i : i + 8]
    at = s.find(head, i + unit)
    while 0 <= at and 2 * at - i <= n:
        unit = at - i
        # within a run only multiples of its period match, but near its end
        if unit + 8 < run - period:
            at = s.find(head, max(i + run - period - 8, at + 1))
            continue
        if s[i:at] == s[at : at + unit]:
            size = _extent(s, i, unit)
            if size > run:
                run, period = size, unit
            for k in range(max(2, (size - _LONGEST - unit) // unit), size // unit + 1):
                yield i + k * unit, unit
        at = s.find(head, at + 1)


class Guesses:
    """Guess costs by one dictionary; those of short values are kept."""

    def __init__(self, ranks: dict[str, int] = RANK) -> None:
        self.ranks, self.known = ranks, {}

    def cost(self, s: str) -> float:
        """Decimal logarithm of the guesses that the cheapest segmentation of s takes, CEILING at most."""
        if (known := self.known.get(s)) is not None:
            return known
        # the cheapest way to each place: by whole segments, or in a span tried by brute force
        n, keys = len(s), _unshifted(s)
        ways: list[dict[int, float]] = [{0: 0.0}, {}]
        heap = [(0.0, 0, 0)]
        out = CEILING

        def offer(cost: float, at: int, spelled: int) -> None:
            if cost < ways[spelled].get(at, CEILING):
                ways[spelled][at] = cost
                heappush(heap, (cost, at, spelled))

        while heap:
            cost, at, spelled = heappop(heap)
            if at == n:
                out = cost
                break
            if cost > ways[spelled][at]:
                continue
            if spelled:
                offer(cost + brute_cost(s[at]), at + 1, 1)
                offer(cost, at, 0)
                continue
            offer(cost + SEGMENT, at, 1)
            for end, more in pattern_costs(s, at, keys, self.ranks, CEILING - cost):
                offer(cost + more + SEGMENT, end, 0)
            for end, unit in repeats(s, at):
                # a unit has a segment at least
                if cost + SEGMENT + log10((end - at) // unit) < CEILING:
                    offer(cost + self.cost(s[at : at + unit]) + log10((end - at) // unit) + SEGMENT, end, 0)
        if n <= 64:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[s] = out
        return out


def guess_cost(s: str) -> float:
    return Guesses().cost(s)


def findings(text: str, guesses: Guesses) -> Iterator[tuple[int, int, str, float, bool]]:
    """(start, end, context, cost, whether it is a mere reference) of each credential value in a text."""
    for m in _ASSIGNED.finditer(text):
        if key := _KEY.search(m[1]):
            group = next(g for g in (2, 3, 4) if m[g] is not None)
            yield m.start(group), m.end(group), key[0], guesses.cost(m[group]), _REFERENCE.fullmatch(m[group]) is not None


def ranked_words(docs: DataFrame, size: int = DICTIONARY, vocabulary: str | None = None) -> dict[str, int]:
    """The dictionary: WORDS, then the `size` most frequent words of the texts outside credential contexts, small
    letters throughout; equally frequent ones by their letters.

    vocabulary: a file of a public tokenizer (a base64 token and its rank a line), whose words rank by it too.
    """
    text = F.when(F.col("text").rlike(_QUICK), F.regexp_replace("text", _CONTEXT, " ")).otherwise(F.col("text"))
    words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(*LETTERS))
    counted = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    ranks = dict(RANK)
    for k, row in enumerate(counted.select("w").toArrow().column(0).to_pylist()):
        ranks[row] = min(ranks.get(row, k + 1), k + 1)
    if vocabulary:
        with open(vocabulary, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                word = base64.b64decode(token).decode("utf-8", "replace").strip().lower()
                if word.isalpha() and LETTERS[0] <= len(word) <= LETTERS[1]:
                    ranks[word] = min(ranks.get(word, int(rank) + 1), int(rank) + 1)
    return ranks


def _suspects(column: pa.Array) -> np.ndarray:
    return np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(column, _QUICK), False)))


def scan(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, start, end, context, value, log10_guesses, verdict) of each value in a credential context.

    start and end count characters of the text. verdict: reference for a template, variable, attribute or call;
    else strong from 10 ** 10 guesses, secret from 10 ** 6, and placeholder. ranks: the dictionary, by default
    `ranked_words` of docs. Null and empty texts have none; a null doc_id is reported as such; repeated
    rows are reported each; a value may have any length. Further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranked_words(docs) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "context", "value", "log10_guesses", "verdict"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        guesses = None
        for batch in batches:
            rows = []
            for k in _suspects(batch.column(1)):
                guesses = guesses or Guesses(held.value)
                text, doc = batch.column(1)[int(k)].as_py(), batch.column(0)[int(k)].as_py()
                for a, b, context, cost, reference in findings(text, guesses):
                    rows.append((doc, a, b, context.lower(), text[a:b], cost, "reference" if reference else "strong" if cost >= STRONG_FROM else "secret" if cost >= SECRET_FROM else "placeholder"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, context string, value string, log10_guesses double, verdict string")


def masked(text: str, guesses: Guesses, secret_from: float = SECRET_FROM) -> str:
    out, last = [], 0
    for a, b, _, cost, reference in findings(text, guesses):
        if cost >= secret_from and not reference:
            out += [text[last:a], MASK]
            last = b
    return "".join([*out, text[last:]]) if out else text


def mask_secrets(docs: DataFrame, secret_from: float = SECRET_FROM, ranks: dict[str, int] | None = None) -> DataFrame:
    """docs with every secret value replaced by [SECRET], all rows and columns kept; n_chars, where there is
    one, is counted anew for the texts that change. References are left as they are.

    Null and empty texts, a null doc_id and repeated rows stay as they are; an extra column of any name is kept.
    """
    place = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(ranked_words(docs) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = None
        for batch in batches:
            column = batch.column(place)
            suspects = _suspects(column)
            if len(suspects):
                guesses = guesses or Guesses(held.value)
                chosen = np.zeros(len(column), bool)
                chosen[suspects] = True
                new = [masked(t, guesses, secret_from) for t in column.take(pa.array(suspects)).to_pylist()]
                changed = pc.replace_with_mask(column, pa.array(chosen), pa.array(new, column.type))
                columns = batch.columns
                columns[place] = changed
                if "n_chars" in batch.schema.names:
                    at = batch.schema.names.index("n_chars")
                    sizes = np.asarray(pc.utf8_length(changed.take(pa.array(suspects)))).astype(np.int64)
                    same = np.asarray(pc.equal(changed.take(pa.array(suspects)), column.take(pa.array(suspects))))
                    chosen[suspects[same]] = False
                    columns[at] = pc.replace_with_mask(columns[at], pa.array(chosen), pa.array(sizes[~same]).cast(columns[at].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
