"""Benchmark decontamination by greedy string tiling.

A document scan keeps, for each document, the seeds (runs of min_match words) that a fixed-size filter of
the benchmark's seeds lets through; an equi-join on the seed hash finds the (document, item) pairs, and
running Karp-Rabin greedy string tiling measures how much of the item the document covers, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import broadcast_if_small, own, stash
from millrace.llm.tokens import U, grams, mix, tokenize

MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of the seed filter: 32 for each benchmark word, and no more than this. Beyond, it lets more through.
FILTER_BITS = 1 << 28


def greedy_string_tiling(text: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (text start, item start, length): longest matches first, none overlapping another on either side.

    Running Karp-Rabin: at each search length s, hashes of unmarked runs of s words of the text are looked
    up among those of the item; a hit is verified word by word and extended. A match far above s restarts
    the search from its length; else the matches are marked in order of falling length (ties: first in the
    text, then in the item) and s is halved, down to min_match.
    """
    n, m = len(text), len(item)
    marked_t, marked_i = np.zeros(n, bool), np.zeros(m, bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(min_match, m // 2)
    power = np.concatenate((np.ones(1, U), np.cumprod(np.full(max(n, m), 0x9E3779B97F4A7C15, U))))

    def runs(words: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < s:
            return np.zeros(0, U), np.zeros(0, np.int64)
        blocked = np.concatenate(([0], np.cumsum(marked)))
        at = np.flatnonzero(blocked[s:] == blocked[:-s])
        total = np.concatenate((np.zeros(1, U), np.cumsum(words * power[: len(words)])))
        return (total[at + s] - total[at]) * power[max(n, m) - at], at

    while True:
        found: list[tuple[int, int, int]] = []
        h_i, at_i = runs(item, marked_i, s)
        h_t, at_t = runs(text, marked_t, s)
        order = np.argsort(h_i, kind="stable")
        h_i, at_i = h_i[order], at_i[order]
        lo, hi = np.searchsorted(h_i, h_t, "left"), np.searchsorted(h_i, h_t, "right")
        longest = 0
        for k in np.flatnonzero(hi > lo):
            a = int(at_t[k])
            for b in map(int, at_i[lo[k] : hi[k]]):
                if a and b and not marked_t[a - 1] and not marked_i[b - 1] and text[a - 1] == item[b - 1]:
                    continue  # part of a longer match that starts before
                size = 0
                while a + size < n and b + size < m and not marked_t[a + size] and not marked_i[b + size] and text[a + size] == item[b + size]:
                    size += 1
                if size >= s:
                    found.append((a, b, size))
                    longest = max(longest, size)
        if longest > 2 * s:
            s = longest
            continue
        for a, b, size in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            free = ~(marked_t[a : a + size] | marked_i[b : b + size])
            if free.all():
                marked_t[a : a + size] = marked_i[b : b + size] = True
                tiles.append((a, b, size))
        # what overlapped a longer tile is found again in a later round of the same or a shorter length
        if any((~(marked_t[a : a + z] | marked_i[b : b + z])).any() and _longest_free(marked_t, marked_i, a, b, z) >= s for a, b, z in found):
            continue
        if s == min_match:
            return tiles
        s = max(min_match, s // 2)


def _longest_free(marked_t: np.ndarray, marked_i: np.ndarray, a: int, b: int, size: int) -> int:
    free = ~(marked_t[a : a + size] | marked_i[b : b + size])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _filter_slots(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(seeds + U(k)) % U(bits)).astype(np.int64) for k in range(3)]


def _scan(filter_: bytes, bits: int, min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(filter_, np.uint8)).view(bool)
        for batch in batches:
            ids = batch.column(0)
            for words in tokenize(batch.column(1)):
                g, at = grams(words, min_match)
                first, second, third = _filter_slots(g, bits)
                hit = table[first]
                hit &= table[second]
                hit &= table[third]
                hit = np.flatnonzero(hit)
                if not len(hit):
                    continue
                owner = np.searchsorted(words.ptr, at[hit], side="right") - 1
                docs = np.unique(owner)
                yield pa.record_batch(
                    [
                        ids.take(pa.array(docs + words.row)),
                        pa.array([words.hash[words.ptr[d] : words.ptr[d + 1]].view(np.int64) for d in docs], pa.list_(pa.int64())),
                        pa.array([np.unique(g[hit[owner == d]]).view(np.int64) for d in docs], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "_words", "_seeds"],
                )

    return run


def _items(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in tokenize(batch.column(1)):
                n = len(words.ptr) - 1
                g, at = grams(words, min_match)
                owner = np.searchsorted(words.ptr, at, side="right") - 1
                yield pa.record_batch(
                    [
                        batch.column(0).slice(words.row, n),
                        pa.array([words.hash[words.ptr[d] : words.ptr[d + 1]].view(np.int64) for d in range(n)], pa.list_(pa.int64())),
                        pa.array([np.unique(g[owner == d]).view(np.int64) for d in range(n)], pa.list_(pa.int64())),
                    ],
                    ["item_id", "_item_words", "_item_seeds"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) of each pair whose tiles cover at least
    the given share of the item's words.

    Items of fewer than min_match words are matched as a whole only by documents that hold a seed of theirs,
    and so by none; such items, empty and null texts match nothing. Rows with a null doc_id or item_id are
    left out. Repeated rows of a document or item count once. All other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    items = stash(
        benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").mapInArrow(_items(min_match), "item_id long, _item_words array<long>, _item_seeds array<long>").dropDuplicates(["item_id", "_item_words"]),
        "items",
    )
    seeds = items.select("item_id", F.explode("_item_seeds").alias("_seed"))
    n_seeds = seeds.count()
    bits = int(min(FILTER_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(32 * max(n_seeds, 1)))))))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.unique(np.concatenate(_filter_slots(np.asarray(batch.column(0)).view(U), bits)))
            at, first = np.unique(got >> 5, return_index=True)
            value = np.bitwise_or.reduceat(1 << (got & 31), first) if len(got) else got
            yield pa.record_batch([pa.array(at), pa.array(value)], ["_at", "_bits"])

    packed = np.zeros(bits // 8, np.uint8)
    found_bits = seeds.select("_seed").mapInArrow(slots, "_at long, _bits long").groupBy("_at").agg(F.bit_or("_bits").alias("_bits"))
    for part in found_bits.toArrow().to_batches():
        at, value = np.asarray(part.column(0)), np.asarray(part.column(1))
        for byte in range(4):
            packed[at * 4 + byte] = (value >> (8 * byte)) & 0xFF
    # packed is little-endian by bit; unpackbits reads big-endian
    packed = np.packbits(np.unpackbits(packed, bitorder="little"))
    handle = spark.sparkContext.broadcast(packed.tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(handle.value, bits, min_match)(batches)

    hits = stash(docs.mapInArrow(scan, "doc_id long, _words array<long>, _seeds array<long>"), "hits")
    pairs = (
        hits.select("doc_id", F.explode("_seeds").alias("_seed"))
        .distinct()
        .join(broadcast_if_small(seeds), "_seed")
        .select("doc_id", "item_id")
        .distinct()
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            d, i = batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist()
            for k in range(batch.num_rows):
                text = np.asarray(batch.column("_words")[k].values).view(U)
                item = np.asarray(batch.column("_item_words")[k].values).view(U)
                tiles = greedy_string_tiling(text, item, min_match)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(item):
                    rows.append((d[k], i[k], len(item), covered, len(tiles), covered / len(item)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, [pa.int64()] * 5 + [pa.float64()])], ["doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage"])

    found = (
        hits.select("doc_id", "_words")
        .join(pairs, "doc_id")
        .join(broadcast_if_small(items.select("item_id", "_item_words")), "item_id")
        .select("doc_id", "item_id", "_words", "_item_words")
        .mapInArrow(measure, "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double")
    )
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "covered_words", "tiles", "item_words")).alias("_m")).select("doc_id", "item_id", "_m.item_words", "_m.covered_words", "_m.tiles", "_m.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows whose doc_id contamination() reports; rows with a null doc_id, and null and empty
    texts, stay. Rows that repeat a doc_id share its fate. All columns are kept, whatever their names."""
    bad = contamination(docs, benchmark, min_match, coverage).select(F.col("doc_id").alias(own("bad"))).distinct()
    return docs.join(bad, docs["doc_id"] == bad[own("bad")], "left_anti")
