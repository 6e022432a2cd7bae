"""Site template removal.

Each page's elements are hashed from the leaves up, with white space folded; the pages of a host that hold
a subtree are counted in Spark; a subtree of many of the host's pages is part of its template and is deleted, the
outermost first. Between the two readings of the pages only hashes are shuffled. A host has a bounded
number of template subtrees, since each is on a fixed share of its pages; as long as those of all hosts are
few they are broadcast, and the pages aren't shuffled; else they are joined to the pages by host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.store import own, replacing, stash
from millrace.llm.tokens import U, mix

MIN_PAGES = 5
MIN_SHARE = 0.01
#: Template subtrees of all hosts that are sent to every executor, as 8 bytes each; more are joined by host.
BROADCAST_SUBTREES = 2_000_000
#: Subtrees with less text and markup than this are too common to tell anything, such as <br> or <b></b>.
MIN_CHARS = 12

#: A tag ends before the next < that is in no quotes, so no text is read twice however broken it is.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|</([a-zA-Z][^\s/<>]*+)[^<>]*+>|<([a-zA-Z][^\s/<>]*+)((?:[^\"'<>]|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp".split())
#: A start tag of these closes an open one of the others, as browsers do.
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_NEVER = frozenset(("html", "body", "head"))
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def subtrees(html: str, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the elements of a page, in order of their ends; html, head and body are left out,
    and elements of fewer than min_chars characters.

    End tags that nothing opened are passed over; what is left open ends with its parent. The content of
    script, style and the like is text.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[str, int, list[str]]] = [("", 0, [])]
    open_of: dict[str, int] = {}
    at = 0

    def close(end: int) -> None:
        name, start, parts = stack.pop()
        open_of[name] -= 1
        digest = xxhash.xxh3_64_intdigest("\x01".join(parts))
        if name not in _NEVER and end - start >= min_chars:
            found.append((start, end, digest))
        stack[-1][2].append(f"{digest:x}")

    def text(a: int, b: int) -> None:
        if b > a and (folded := _SPACE.sub(" ", html[a:b]).strip()):
            stack[-1][2].append(folded)

    match = _TAG.search(html, 0)
    while match:
        text(at, match.start())
        at = match.end()
        if ends := match[1]:
            ends = ends.lower()
            if open_of.get(ends):
                while stack[-1][0] != ends:
                    close(match.start())
                close(at)
        elif name := match[2]:
            name = name.lower()
            if (closes := _CLOSES.get(name)) and stack[-1][0] in closes:
                close(match.start())
            attributes = _SPACE.sub(" ", match[3]).strip()
            if name in _VOID or attributes.endswith("/"):
                stack[-1][2].append(f"<{name} {attributes}>")
            else:
                stack.append((name, match.start(), [f"<{name} {attributes}>"]))
                open_of[name] = open_of.get(name, 0) + 1
                if name in _RAW:
                    stop = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(html, at)
                    inner = stop.start() if stop else len(html)
                    text(at, inner)
                    at = stop.end() if stop else len(html)
                    close(at)
        match = _TAG.search(html, at)
    text(at, len(html))
    while len(stack) > 1:
        close(len(html))
    return found


def without(html: str, template: list[tuple[int, int, int]]) -> tuple[str, int]:
    """The page without the outermost of these subtrees, and their number."""
    cut = sorted((a, -b) for a, b, _ in template)
    out, last, number = [], 0, 0
    for a, b in cut:
        if a >= last:
            out.append(html[last:a])
            last, number = -b, number + 1
    return "".join([*out, html[last:]]), number


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, host = [], []
            for k, html in enumerate(batch.column(1).to_pylist()):
                some = {_signed(h) for _, _, h in subtrees(html, min_chars)}
                page.extend(some)
                host.extend([k] * len(some))
            yield pa.record_batch([batch.column(0).take(pa.array(host, pa.int64())), pa.array(page, pa.int64())], ["_host", "_hash"])

    return run


def host_of(url: str = "url"):
    """The host of a url in small letters; empty for null and for strings without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), _HOST, 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_host, _hash): the subtrees of at least min_chars characters on at least min_pages pages and on at least
    min_share of the host's."""
    hosted = pages.where(host_of() != "").select(F.xxhash64(host_of()).alias("_host"), F.coalesce("html", F.lit("")).alias("html"))
    totals = hosted.groupBy("_host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    counts = hosted.mapInArrow(_hashes(min_chars), "_host long, _hash long").groupBy("_host", "_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    return counts.join(totals, "_host").where(F.col("_n") >= F.lit(min_share) * F.col("_pages")).select("_host", "_hash")


def _key(host: np.ndarray | int, hashes: np.ndarray) -> np.ndarray:
    return mix(mix(hashes) ^ np.asarray(host).astype(np.int64).view(U))


def remove_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_up_to: int = BROADCAST_SUBTREES, min_chars: int = MIN_CHARS) -> DataFrame:
    """pages with html freed of its host's template, and removed, the number of subtrees deleted.

    A host of fewer than min_pages pages has no template, nor have pages without a readable host in their
    url (null urls too). Null html stays null, empty html empty, and removed is 0. Repeated rows are pages
    each. Elements of fewer than min_chars characters, such as <br> or <b></b>, tell nothing of a template and are
    only deleted inside larger ones. A column named removed is replaced; all others are kept, whatever their names.
    """
    pages = replacing(pages, ["removed"])
    found = stash(templates(pages, min_pages, min_share, min_chars), "templates")
    columns = pages.columns
    place, extra = columns.index("html"), len(columns)
    of_host = own("of")
    hosted = pages.withColumn(of_host, F.when(host_of() != "", F.xxhash64(host_of())))
    if found.count() <= broadcast_up_to:
        held = found.toArrow()
        keys = pages.sparkSession.sparkContext.broadcast(np.sort(_key(np.asarray(held["_host"]), np.asarray(held["_hash"]).view(U))))
        rows = hosted

        def template_of(row: pa.Scalar, hashes: np.ndarray) -> np.ndarray:
            wanted = _key(row.as_py(), hashes)
            at = np.minimum(np.searchsorted(keys.value, wanted), max(len(keys.value) - 1, 0))
            return keys.value[at] == wanted if len(keys.value) else np.zeros(len(hashes), bool)
    else:
        lists = found.groupBy(F.col("_host").alias(of_host)).agg(F.collect_list("_hash").alias(own("hashes")))
        joined = hosted.where(F.col(of_host).isNotNull()).join(lists, of_host, "left").select(*columns, F.col(own("hashes")).alias(of_host))
        rows = joined.unionByName(hosted.where(F.col(of_host).isNull()).withColumn(of_host, F.lit(None).cast("array<long>")))

        def template_of(row: pa.Scalar, hashes: np.ndarray) -> np.ndarray:
            return np.isin(hashes, np.asarray(row.values).view(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, of = batch.column(place), batch.column(extra)
            removed = np.zeros(len(html), np.int64)
            change = np.flatnonzero(np.asarray(pc.and_(of.is_valid(), html.is_valid())))
            new = []
            for k in change.tolist():
                text = html[k].as_py()
                parts = subtrees(text, min_chars)
                if parts:
                    is_template = template_of(of[k], np.array([h for _, _, h in parts], U))
                    text, removed[k] = without(text, [p for p, t in zip(parts, is_template) if t])
                new.append(text)
            chosen = np.zeros(len(html), bool)
            chosen[change] = True
            arrays = batch.columns[:extra]
            arrays[place] = pc.replace_with_mask(html, pa.array(chosen), pa.array(new, html.type))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed)], [*columns, "removed"])

    return rows.mapInArrow(run, StructType([*pages.schema.fields, StructField("removed", LongType())]))
