"""Text functions as column expressions; only quick tests, entities, NFC and exact case folding need Python."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html import entities

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Letters of a script as a Java character class. Letters outside every class count as Other.
SCRIPTS = {
    "Latin": "A-Za-z\\x{C0}-\\x{24F}", "Devanagari": "\\x{900}-\\x{97F}", "Bengali": "\\x{980}-\\x{9FF}", "Gurmukhi": "\\x{A00}-\\x{A7F}", "Gujarati": "\\x{A80}-\\x{AFF}",
    "Odia": "\\x{B00}-\\x{B7F}", "Tamil": "\\x{B80}-\\x{BFF}", "Telugu": "\\x{C00}-\\x{C7F}", "Kannada": "\\x{C80}-\\x{CFF}", "Malayalam": "\\x{D00}-\\x{D7F}",
}

#: language -> script whose letters its text should mostly have
INDIC = dict(zip("as bn gu hi kn ml mr or pa ta te".split(), "Bengali Bengali Gujarati Devanagari Kannada Malayalam Devanagari Odia Gurmukhi Tamil Telugu".split()))
LATIN = {code: "Latin" for code in ("en", "fr", "de", "es")}

#: Invisible characters that are counted one by one when they are removed.
COUNTED = ["200B", "FEFF", *(f"202{c}" for c in "ABCDE"), *(f"206{c}" for c in "6789")]
_JOINERS = "[\\x{200C}\\x{200D}]"
_ZERO_WIDTH = "[" + "".join(f"\\x{{{c}}}" for c in COUNTED) + "]"
_CONTROL = f"[[\\p{{Cc}}\\p{{Cf}}\\x{{FFFD}}]&&[^\\n\\t\\x{{200C}}\\x{{200D}}]]"
_OTHER_CONTROL = f"[[\\p{{Cc}}\\p{{Cf}}]&&[^\\n\\t\\x{{200C}}\\x{{200D}}{''.join(f'\\x{{{c}}}' for c in COUNTED)}]]"

#: A class that has all of _CONTROL, in few ranges.
_MAY_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\xAD\\x{600}-\\x{10FFFF}]"

#: What operation_counts counts.
_COUNTED = "[[\\p{Cc}\\p{Cf}\\x{FFFD}]&&[^\\n\\t]]"

_OCTET = "(?:1?\\d{1,2}|2[0-4]\\d|25[0-5])"
#: kind -> (pattern, mask), in the order in which they are applied: each sees what the one before left
MASKS = {
    "email": ("(?U)(?<![\\w+.-])([\\w+.-]+)@([\\w-]+[.])+[\\w-]+", "[EMAIL]"),
    "ipv4": (f"(?U)(?<!\\d){_OCTET}(?:[.]{_OCTET}){{3}}(?!\\d)", "[IP_ADDRESS]"),
    "phone": ("(?U)(?<!\\w)\\+{0,1}\\d[() \\d-]{7,}\\d(?!\\w)", "[PHONE]"),
    "url": ("(?U)(?:http|https)://[^'\"<>\\s]+", "[URL]"),
}
#: kind -> what any text has that its pattern matches, found in less time: a part of the text, or a pattern
MAY_HOLD_PART = {"email": "@", "url": "://"}
MAY_HOLD = {"ipv4": "(?U)\\d[.]\\d", "phone": "(?U)\\d[() \\d-]{7,}\\d"}
REPEATED_RUN = "(?d)(.)\\1{11}"
MARKUP = "<[^>]{1,120}>"
PLACEHOLDER = "(?U)\\{\\w*\\}|%\\d*\\$?[A-Za-z]|&[A-Za-z][0-9A-Za-z]+;"


#: Characters that entities or composition may change: ampersands, marks, what composes with or decomposes into others
#: (ranges with small gaps between them), and what the JVM does not know. Below U+0300 there is only the ampersand.
_BEYOND = "[&\\x{300}-\\x{10FFFF}]"
_OPEN = "[&\\p{M}\\p{Cn}" + "".join(f"\\x{{{r}}}" if "-" not in r else "\\x{{{}}}-\\x{{{}}}".format(*r.split("-")) for r in (
    "374 37E 387 958-95F 9DC-9DF A33-A36 A59-A5E B5C-B5D F43 F4D F52 F57 F5C F69 1161-1175 11A8-11C2 1F71-1F7D 1FBB-1FBE 1FC9-1FCB 1FD3 1FDB 1FE3 1FEB-1FEF 1FF9-2001 "
    "2126-212B 2329-232A 2ADC F900-FAD9 FB1D-FB1F FB2A-FB4E 1D15E-1D164 1D1BB-1D1C0 2F800-2FA1D").split()) + "]"  # fmt: skip
_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _resolve(match: re.Match) -> str:
    found = match[0]
    return html.unescape(found) if found[1] == "#" else entities.html5.get(found[1:], found)


def unescape(text: str, closed: bool = False) -> str:
    """Entities resolved once. closed: only those that end in a semicolon; else as HTML reads them, also &amp without one."""
    return _CLOSED.sub(_resolve, text) if closed else html.unescape(text)


def _composed(text: str | None, closed: bool) -> tuple[str, int] | None:
    if text is None:
        return None
    raw = unescape(text, closed)
    plain = unicodedata.normalize("NFC", raw)
    return plain, int(plain != raw)


# UDFs by row: a worker holds 100 texts at a time, where an Arrow batch has 10,000 of any length
_RESULT = StructType([StructField("plain", StringType()), StructField("changed", LongType())])
_composed_html = F.udf(lambda t: _composed(t, False), _RESULT, useArrow=False)
_composed_closed = F.udf(lambda t: _composed(t, True), _RESULT, useArrow=False)
_nfc = F.udf(lambda t: None if t is None else unicodedata.normalize("NFC", t), StringType(), useArrow=False)


#: What every text has that normalize() changes, and every text with a mark or character that operation_counts counts. RE2
#: takes it in one pass, while each of Java's patterns takes longer by itself. Of what is beyond U+0300 only dashes, quotation
#: marks and the euro are left out.
_MAY_CHANGE = (
    "[&\\x00-\\x09\\x0B-\\x1F\\x7F-\\x9F\\xAD\\x{300}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{20AB}\\x{20AD}-\\x{10FFFF}]"
    "|  | \\n|\\n |\\n\\n\\n|\\A[ \\n\\xA0]|[ \\n\\xA0]\\z"
)
#: What every text has that a mask is set in. Digits newer than RE2's tables are all beyond U+FFFF.
_ANY_DIGIT = "\\p{Nd}\\x{10000}-\\x{10FFFF}"
_MAY_MASK = f"@|://|[{_ANY_DIGIT}][.][{_ANY_DIGIT}]|[{_ANY_DIGIT}][() {_ANY_DIGIT}-]{{7,}}[{_ANY_DIGIT}]"


@F.arrow_udf(BooleanType())
def may_change(text: pa.Array) -> pa.Array:
    return pc.match_substring_regex(text, _MAY_CHANGE)


@F.arrow_udf(BooleanType())
def _may_mask(text: pa.Array) -> pa.Array:
    return pc.match_substring_regex(text, _MAY_MASK)


def may_hold_any(text: Column) -> Column:
    """The quick test of all masks together. A mask that is set brings none of what it looks for into a text."""
    return _may_mask(text) | ~F.is_valid_utf8(text)


def _stays(text: Column) -> Column:
    """Whether a text is known to stay as it is; not those with broken bytes, which Java reads as U+FFFD."""
    return ~may_change(text) & F.is_valid_utf8(text)


def _open(text: Column) -> Column:
    """The text where entities or composition may change it, else null: only such texts are sent to Python."""
    return F.when(may_change(text) & text.rlike(_BEYOND) & text.rlike(_OPEN), text)


def composed(text: Column, closed: bool = False) -> Column:
    """(plain, changed): entities resolved once, then composed; changed is 1 where composition changed what the entities left."""
    found = (_composed_closed if closed else _composed_html)(_open(text))
    return F.struct(F.coalesce(found["plain"], text).alias("plain"), F.coalesce(found["changed"], F.lit(0).cast("long")).alias("changed"))


def unescape_nfc(text: Column, closed: bool = False) -> Column:
    """Entities resolved once, then composed."""
    return F.coalesce((_composed_closed if closed else _composed_html)(_open(text))["plain"], text)


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(_open(text)), text)


@F.pandas_udf(StringType())
def casefold_key(text: pd.Series) -> pd.Series:
    """White space folded to one space, case folded, stripped: exact for all of Unicode."""
    return pd.Series([None if t is None else " ".join(t.split()).casefold() for t in text], dtype=object)


def bound(text: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text that is computed once, however often f names it."""
    return F.get(F.transform(F.array(text), lambda x: f(x)), F.lit(0))


def _tidied(text: Column) -> Column:
    """tidy(), each pattern of which runs only where a search for bytes, or for a class that has all it matches, finds something."""
    # only what changes is matched: a single blank and a bare line end stay as they are
    steps = [
        (lambda x: x.rlike(_MAY_CONTROL), _CONTROL, ""),
        (lambda x: x.contains("\t") | x.contains("  "), "\\t[ \\t]*| [ \\t]+", " "),
        (lambda x: x.contains(" \n") | x.contains("\n "), " \\n ?|\\n ", "\n"),
        (lambda x: x.contains("\n\n\n"), "\\n{3,}", "\n\n"),
        (lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike("(?U)\\s"), "(?U)^\\s+|\\s+$", ""),
    ]
    out = F.coalesce(text, F.lit(""))
    for test, pattern, by in steps:
        out = bound(out, lambda x, test=test, pattern=pattern, by=by: F.when(test(x), F.regexp_replace(x, pattern, by)).otherwise(x))
    return out


def tidy(text: Column) -> Column:
    """What is left of composed text without control characters, with its blanks and lines folded."""
    return F.coalesce(F.when(_stays(text), text).otherwise(_tidied(text)), F.lit(""))


def normalize(text: Column, composed: bool = False, closed: bool = False) -> Column:
    """Entities, composition, tidying. composed: the text is known to have no entities and to be composed; closed: see unescape."""
    return F.coalesce(F.when(_stays(text), text).otherwise(_tidied(text if composed else unescape_nfc(text, closed))), F.lit(""))


def operation_counts(plain: Column, changed: Column, side: str) -> Column:
    """map of what normalisation does to a text, with the side before each kind; kinds that don't occur are left out.

    plain is the text with entities resolved and composed, changed whether composition changed it.
    """
    plain = F.coalesce(plain, F.lit(""))
    counts = {
        "unicode_nfc_changed": changed,
        "indic_joiner_preserved": F.regexp_count(plain, F.lit(_JOINERS)),
        "replacement_character_removed": F.regexp_count(plain, F.lit("\\x{FFFD}")),
        "other_control_removed": F.regexp_count(plain, F.lit(_OTHER_CONTROL)),
    } | {f"removed_U+{c.zfill(4)}": F.regexp_count(plain, F.lit(f"\\x{{{c}}}")) for c in COUNTED}
    # few texts have any of them, and each is a pass over the text
    some = (changed > 0) | (~_stays(plain) & plain.rlike(_COUNTED))
    return F.when(some, sparse_map({f"{side}_{k}": c for k, c in counts.items()})).otherwise(F.create_map().cast("map<string,bigint>"))


def sparse_map(counts: dict[str, Column]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("long").alias("value")) for k, c in counts.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def letters(text: Column) -> Column:
    """Number of letters; combining marks are none."""
    return F.length(F.regexp_replace(text, "\\P{L}+", ""))


def script_letters(text: Column, script: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^[\\p{{L}}&&[{SCRIPTS[script]}]]]+", ""))


def script_ratio(text: Column, script: str, total: Column | None = None) -> Column:
    """Share of the letters that belong to the script; 0 where there are none. total: the letters, where they are counted."""
    total = letters(text) if total is None else total
    return F.when(total > 0, script_letters(text, script) / total).otherwise(F.lit(0.0))


def expected_ratio(text: Column, language: Column, registry: dict[str, str], total: Column | None = None) -> Column:
    """script_ratio for the script of the row's language, null for languages without one."""
    out = None
    for script in dict.fromkeys(registry.values()):
        test = language.isin([code for code, s in registry.items() if s == script])
        out = F.when(test, script_ratio(text, script, total)) if out is None else out.when(test, script_ratio(text, script, total))
    return F.lit(None).cast("double") if out is None else out


def may_hold(text: Column, kind: str) -> Column:
    """The quick test of a mask."""
    return text.contains(MAY_HOLD_PART[kind]) if kind in MAY_HOLD_PART else text.rlike(MAY_HOLD[kind])


def masked(text: Column, kind: str) -> Column:
    """The text with one mask set; most texts have nothing to mask and are only looked at by the quick test."""
    pattern, mask = MASKS[kind]
    return F.when(may_hold(text, kind), F.regexp_replace(text, pattern, mask)).otherwise(text)


def masks_in(text: Column, kind: str) -> Column:
    """How often masked() would set the mask."""
    return F.when(may_hold(text, kind), F.regexp_count(text, F.lit(MASKS[kind][0]))).otherwise(F.lit(0))


def mask_pii(text: Column) -> Column:
    for kind in MASKS:
        text = bound(text, lambda x, kind=kind: masked(x, kind))
    return text


def mask_counts(text: Column) -> dict[str, Column]:
    """kind -> number of masks set, each counted on what the earlier kinds left."""
    out = {}
    for kind, (pattern, mask) in MASKS.items():
        out[kind] = masks_in(text, kind)
        text = F.regexp_replace(text, pattern, mask)
    return out


def key_of(text: Column, exact: bool = False) -> Column:
    """casefold_key in built-in functions: the same wherever lower case differs from folding by ß alone. exact: the UDF."""
    if exact:
        return casefold_key(text)
    return folded(F.regexp_replace(F.regexp_replace(text, "(?U) \\s+|[\\s&&[^ ]]\\s*", " "), "^ | $", ""))


def folded(text: Column) -> Column:
    """The case of key_of alone: its words are those of the key, whatever white space is between them."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def text_digest(language: Column, *texts: Column, exact: bool = False) -> Column:
    """SHA-256 over the language and the keys of the texts, separated by NUL."""
    keys = [key_of(t, exact) for t in texts]
    return F.sha2(F.concat_ws("\0", language, *keys), 256)


def words(text: Column) -> Column:
    """Spans without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)\\S+"), F.lit(0))


def key_words(text: Column) -> Column:
    """The words of the key."""
    return F.filter(F.split(key_of(text), " "), lambda x: x != "")


def gram_starts(w: Column, n: int = 13) -> Column:
    """Where the word n-grams of an array of words begin, from 1: fewer words are one gram, none have none."""
    return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))))


def gram_words(w: Column, at: Column, n: int = 13) -> list[Column]:
    """The words of the gram that begins at a place from 1, null beyond the last. A slice would copy all words each time."""
    return [F.get(w, at + (j - 1)) for j in range(n)]


def word_grams(text: Column, n: int = 13) -> Column:
    """Distinct word n-grams of the key; shorter texts have one, all their words; empty ones none."""
    grams = lambda w: F.array_distinct(F.transform(gram_starts(w, n), lambda i: F.concat_ws(" ", *gram_words(w, i, n))))
    # the lambda binds the words: they are split once for a row, not once for a gram
    return F.get(F.transform(F.array(key_words(text)), grams), F.lit(0))


def placeholders(text: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))


def first_language(columns: list[Column], registry: dict[str, str], fixed: str | None = None) -> Column:
    """The first column that is not empty, else the fixed language, in small letters; unknown where the registry lacks it."""
    found = F.lower(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(fixed or "")))
    return F.when(found.isin(list(registry)), found).otherwise(F.lit("unknown"))
