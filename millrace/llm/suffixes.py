"""Suffix-array deduplication: the passages of at least LENGTH words that other documents hold as well.

Sorting all suffixes of a corpus is done shard by shard. Winnowed anchors (runs of GRAM words with the
least hash in a window) are in every passage of LENGTH words, wherever it occurs; anchors of one document
only are dropped. Each remaining anchor is sent, with the words around it, to the shard of its hash, and
the suffixes whose first LENGTH words it is the anchor of are sorted there: each suffix in one place. The suffix sort is a
mergesort whose comparisons find the common extension of two suffixes by binary search on prefix
polynomial hashes; neighbours with a common extension of LENGTH words are compared word by word.

An anchor of more than CROWD occurrences is no shard: its suffixes are grouped over all tasks by a 128-bit
hash of their first LENGTH words, which finds the same passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import broadcast_if_small, stash
from millrace.llm.tokens import FOLD, U, WORD, Words, grams, mix, tokenize

LENGTH = 50
#: Occurrences of an anchor whose contexts, of half a kilobyte each, are sorted in one task.
CROWD = 20_000
#: Beyond this size of the table of shared anchors the texts are shuffled to it, once.
BROADCAST_BYTES = 64 << 20
_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 1 << 64)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many hashes, the place of the least one (the first, of equal ones)."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = U(max(20, len(g).bit_length()))
    low = (U(1) << bits) - U(1)
    key = (g & ~low) | np.arange(len(g), dtype=U)
    size = 1
    while size * 2 <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = window - size
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & low).astype(np.int64)


class SuffixSort:
    """Sorts suffixes of one array of words by hash-compared extensions of at most limit words."""

    def __init__(self, words: np.ndarray, limit: int) -> None:
        self.words, self.limit = words, limit
        n = len(words)
        power = np.ones(n + 1, U)
        np.cumprod(np.full(n, _P, U), out=power[1:])
        self.inverse = np.ones(n + 1, U)
        np.cumprod(np.full(n, _PINV, U), out=self.inverse[1:])
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(words * power[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of words, limit at most, that the suffixes at x and y have in common."""
        size = np.zeros(len(x), np.int64)
        step = 1 << (self.limit.bit_length() - 1)
        while step:
            longer = np.minimum(size + step, self.limit)
            same = (longer > size) & (self.hash(x, longer) == self.hash(y, longer))
            size = np.where(same, longer, size)
            step >>= 1
        return size

    def before(self, x: np.ndarray, y: np.ndarray, if_equal: np.ndarray) -> np.ndarray:
        size = self.extension(x, y)
        equal = size >= self.limit
        at = np.where(equal, 0, size)
        return np.where(equal, if_equal, self.words[x + at] < self.words[y + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The stable order of the suffixes within their groups; group is sorted. Each merge finds the place of
        an element by a binary search in the other run."""
        n = len(start)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        count = np.diff(np.append(first, n))
        width = 1
        while (alive := count > width).any():
            at = np.repeat(first[alive], count[alive])
            size = np.repeat(count[alive], count[alive])
            place = np.arange(len(at)) - np.repeat(np.cumsum(count[alive]) - count[alive], count[alive])
            run = place // width
            other = run ^ 1
            lo = np.minimum(other * width, size)
            hi = np.minimum((other + 1) * width, size)
            base = lo.copy()
            mine = start[order[at + place]]
            left = run % 2 == 0
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                theirs = start[order[at[open_] + mid]]
                # a left element comes before equal ones of the right run
                goes_before = self.before(theirs, mine[open_], ~left[open_])
                lo[open_] = np.where(goes_before, mid + 1, lo[open_])
                hi[open_] = np.where(goes_before, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            target = (run - run % 2) * width + (place - run * width) + (lo - base)
            moved = order[at + place]
            order[at + target] = moved
            width *= 2
        return order


def _prepare(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document of at least length words: a key of its text, its first and last word, its anchors."""
        for batch in batches:
            for words in tokenize(batch.column(1)):
                counts = words.counts()
                keep = np.flatnonzero(counts >= length)
                if not len(keep):
                    continue
                g, at = grams(words, gram)
                first = np.searchsorted(at, words.ptr[:-1])
                rows = []
                for d in keep.tolist():
                    a, b = int(words.ptr[d]), int(words.ptr[d + 1])
                    text = words.data[words.docs[d] : words.docs[d + 1]]
                    some = g[first[d] : first[d] + b - a - gram + 1]
                    place = np.unique(winnow(some, length - gram + 1))
                    digest = xxhash.xxh3_128_intdigest(text.tobytes())
                    bytes_before = words.docs[d]
                    chars = np.cumsum((text & 0xC0) != 0x80)
                    begin, end = int(words.start[a] - bytes_before), int(words.end[b - 1] - bytes_before)
                    rows.append((digest.to_bytes(16, "big"), int(chars[begin]) - 1, int(chars[end - 1]), some[place].view(np.int64), place))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(keep + words.row)),
                        pa.array([r[0] for r in rows], pa.binary()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "begin", "end", "anchor", "at"],
                )

    return run


def _anchored(words: Words, length: int, gram: int, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per document with anchors in the list: its number, whether each of its anchors is in the list, their places, the
    first and last window of each, their hashes, and the number of characters up to each byte."""
    g, at = grams(words, gram)
    first = np.searchsorted(at, words.ptr[:-1])
    for d in np.flatnonzero(words.counts() >= length).tolist():
        if not lists[words.row + d].is_valid:
            continue
        a, b = int(words.ptr[d]), int(words.ptr[d + 1])
        owner = winnow(g[first[d] : first[d] + b - a - gram + 1], length - gram + 1)
        # the windows of an anchor are consecutive
        places, lo = np.unique(owner, return_index=True)
        hi = np.append(lo[1:], len(owner)) - 1
        shared = np.isin(places, np.asarray(lists[words.row + d].values))
        chars = np.cumsum((words.data[words.docs[d] : words.docs[d + 1]] & 0xC0) != 0x80)
        yield d, shared, places, lo, hi, g[first[d] + places].view(np.int64), chars


def _windows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each suffix of a crowded anchor, two hashes of its first words, and where they stand."""
        for batch in batches:
            for words in tokenize(batch.column(1)):
                sums = [SuffixSort(h, length) for h in (words.hash, mix(words.hash ^ U(0x9FB21C651E98DF25)))]
                docs, rows = [], []
                for d, shared, _, lo, hi, _, chars in _anchored(words, length, gram, batch.column(2)):
                    spans = hi[shared] - lo[shared] + 1
                    if not len(spans):
                        continue
                    start = int(words.ptr[d]) + np.repeat(lo[shared] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
                    before = words.docs[d]
                    size = np.full(len(start), length)
                    rows.append([*(mix(s.hash(start, size)).view(np.int64) for s in sums), chars[words.start[start] - before] - 1, chars[words.end[start + length - 1] - before - 1]])
                    docs.append(np.full(len(start), words.row + d))
                if rows:
                    h, h2, start, end = (np.concatenate(c) for c in zip(*rows))
                    yield pa.record_batch([pa.array(h), pa.array(h2), batch.column(0).take(pa.array(np.concatenate(docs))), pa.array(start), pa.array(end)], ["h", "h2", "doc_id", "start", "end"])

    return run


def _contexts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each shared anchor of a text, the words that the suffixes it is the anchor of reach."""
        for batch in batches:
            for words in tokenize(batch.column(1)):
                rows = []
                for d, shared, places, lo, hi, hashes, chars in _anchored(words, length, gram, batch.column(2)):
                    a, lo_byte = int(words.ptr[d]), int(words.docs[d])
                    for k in np.flatnonzero(shared).tolist():
                        x, y = int(words.start[a + lo[k]]), int(words.end[a + hi[k] + length - 1])
                        rows.append((int(hashes[k]), words.row + d, int(places[k] - lo[k]), int(places[k] - hi[k]), int(chars[x - lo_byte]) - 1, words.data[x:y].tobytes().decode()))
                if rows:
                    anchor, row, most, least, base, text = zip(*rows)
                    yield pa.record_batch(
                        [pa.array(anchor, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(most, pa.int64()), pa.array(least, pa.int64()), pa.array(base, pa.int64()), pa.array(text, pa.string())],
                        ["anchor", "doc_id", "most", "least", "base", "context"],
                    )

    return run


def _sort_shard(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        table = table.sort_by([("anchor", "ascending")])
        anchor, doc, most, least, base = (np.asarray(table[c].combine_chunks()) for c in ("anchor", "doc_id", "most", "least", "base"))
        text = table["context"].combine_chunks()
        del table
        # whole groups of anchors at a time, as long as they are small
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + 12_000, side="right")) - 1)
            a, b = int(edge[i]), int(edge[j])
            yield from _sort_groups(anchor[a:b], doc[a:b], most[a:b], least[a:b], base[a:b], text.slice(a, b - a), length, gram)
            i = j

    return run


def _sort_groups(anchor: np.ndarray, doc: np.ndarray, ahead: np.ndarray, nearest: np.ndarray, base: np.ndarray, text: pa.Array, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    parts = list(tokenize(text))
    words = np.concatenate([p.hash for p in parts])
    first = np.concatenate(([0], np.cumsum(np.concatenate([p.counts() for p in parts]))))[:-1]
    reach = length - gram + 1
    # the suffixes that start `back` words before the anchor
    number = ahead - nearest + 1
    context = np.repeat(np.arange(len(anchor)), number)
    back = nearest[context] + np.arange(len(context)) - np.repeat(np.cumsum(number) - number, number)
    group = np.unique(anchor, return_inverse=True)[1][context] * reach + back
    order = np.argsort(group, kind="stable")
    context, back, group = context[order], back[order], group[order]
    start = first[context] + ahead[context] - back
    if not len(start):
        return
    sorter = SuffixSort(words, length)
    order = sorter.sort(start, group)
    context, back, start = context[order], back[order], start[order]
    near = np.flatnonzero(group[1:] == group[:-1])
    near = near[sorter.extension(start[near], start[near + 1]) >= length]
    for k in range(length):  # verified word by word
        near = near[words[start[near] + k] == words[start[near + 1] + k]]
    joined = np.zeros(len(start), bool)
    joined[near + 1] = True
    head = np.flatnonzero(~joined)
    owner = doc[context]
    several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
    flagged = np.flatnonzero(np.repeat(several, np.diff(np.append(head, len(start)))))
    if not len(flagged):
        return
    most, least = np.full(len(anchor), -1), np.full(len(anchor), reach)
    np.maximum.at(most, context[flagged], back[flagged])
    np.minimum.at(least, context[flagged], back[flagged])
    hit = np.flatnonzero(most >= 0)
    from_word, to_word = ahead[hit] - most[hit], ahead[hit] - least[hit] + length - 1
    begin, end = np.empty(len(hit), np.int64), np.empty(len(hit), np.int64)
    done = 0
    for p in parts:
        upto = int(np.searchsorted(hit, p.row + len(p.ptr) - 1))
        chars = np.concatenate(([0], np.cumsum((p.data & 0xC0) != 0x80)))
        for k in range(done, upto):
            d = int(hit[k]) - p.row
            zero = chars[p.docs[d]]
            begin[k] = chars[p.start[p.ptr[d] + from_word[k]]] - zero
            end[k] = chars[p.end[p.ptr[d] + to_word[k]]] - zero
        done = upto
    yield pa.record_batch([pa.array(doc[hit]), pa.array(begin + base[hit]), pa.array(end + base[hit])], ["doc_id", "start", "end"])


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, end): the maximal stretches of text, in characters, that runs of length words make
    up which another document holds word for word (letter case and marks aside).

    Stretches that touch or overlap are one. Documents of fewer than length words, null and empty texts
    have none. Rows with a null doc_id are left out; rows that repeat a doc_id are one document. Repeats
    within one document don't count. Further columns are ignored.
    """
    gram = length // 2 + 1
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    prepared = stash(docs.mapInArrow(_prepare(length, gram), "doc_id long, text_key binary, begin long, end long, anchor array<long>, at array<long>"), "anchors")
    # equal texts are sorted once
    equal = prepared.groupBy("text_key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    member = prepared.select("doc_id", "text_key", "begin", "end").distinct().join(equal, "text_key")
    member = stash(member, "members")
    firsts = member.where("doc_id = _first").select("doc_id", "text_key")
    spread = prepared.join(firsts, ["doc_id", "text_key"], "left_semi").select("doc_id", F.explode(F.arrays_zip("anchor", "at")).alias("_a")).select(F.col("_a.anchor").alias("anchor"), "doc_id", F.col("_a.at").alias("at"))
    # anchors of two documents at least; counted before they are shuffled
    several = spread.groupBy("anchor").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi")
    anchors = stash(several.select("anchor", (F.col("_n") > CROWD).alias("_crowd")), "shared-anchors")
    shared = spread.join(broadcast_if_small(anchors), "anchor")
    wanted = stash(shared.groupBy("doc_id").agg(F.collect_set(F.when(~F.col("_crowd"), F.col("at"))).alias("_at"), F.collect_set(F.when(F.col("_crowd"), F.col("at"))).alias("_crowded")), "shared")
    texts = docs.join(broadcast_if_small(wanted, BROADCAST_BYTES), "doc_id")
    contexts = texts.where(F.size("_at") > 0).select("doc_id", "text", "_at").mapInArrow(_contexts(length, gram), "anchor long, doc_id long, most long, least long, base long, context string")
    found = contexts.repartition("anchor").mapInArrow(_sort_shard(length, gram), "doc_id long, start long, end long")
    # what the first of equal texts repeats, and the whole of them, holds for all
    others = member.where("doc_id <> _first").select("_first", F.col("doc_id").alias("_copy"))
    if anchors.where("_crowd").limit(1).count():
        windows = stash(texts.where(F.size("_crowded") > 0).select("doc_id", "text", "_crowded").mapInArrow(_windows(length, gram), "h long, h2 long, doc_id long, start long, end long"), "windows")
        again = windows.groupBy("h", "h2").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo <> _hi").select("h", "h2")
        found = found.unionByName(windows.join(again, ["h", "h2"], "left_semi").select("doc_id", "start", "end"))
    found = stash(found, "found")
    copied = found.join(others, found["doc_id"] == others["_first"]).select(F.col("_copy").alias("doc_id"), "start", "end")
    whole = member.where("_first <> _last").select("doc_id", F.col("begin").alias("start"), "end")
    spans = found.unionByName(copied).unionByName(whole)
    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    ahead = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col("start") <= ahead, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL for `repeated_passages` over documents: all windows of so many words, those of two documents, islands."""
    capitals = "".join(map(chr, FOLD))
    inside = WORD.pattern[:-1]
    outside = inside.replace("[", "[^", 1)
    return f"""
WITH t AS (SELECT DISTINCT doc_id, translate(text, '{capitals}', '{capitals.translate(FOLD)}') AS f FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT doc_id, regexp_extract_all(f, '{inside}+') AS w, regexp_extract_all(f, '{outside}+') AS s, regexp_matches(f, '^{inside}') AS at_once FROM t),
l AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: length(x))) AS n,
    unnest(list_resize(list_transform(CASE WHEN at_once THEN list_prepend('', s) ELSE s END, lambda x: length(x)), len(w))) AS gap
  FROM a WHERE len(w) >= {length}),
p AS (SELECT doc_id, i, n, sum(gap) OVER x + sum(n) OVER x - n AS start FROM l WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {length - 1}), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM a WHERE len(w) >= {length})),
many AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT g.doc_id, x.start, y.start + y.n AS stop FROM g JOIN many USING (g) JOIN p x ON x.doc_id = g.doc_id AND x.i = g.i JOIN p y ON y.doc_id = g.doc_id AND y.i = g.i + {length - 1}),
o AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end" FROM q GROUP BY doc_id, island"""
