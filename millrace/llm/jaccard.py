"""N-gram Jaccard join by parity sketches.

The set of a document's n-gram hashes is XORed into a sketch of parts x BITS bits: each n-gram flips one
bit. Two sketches differ in no more bits than the sets differ in n-grams, so for similar sets few parts
differ, and by the pigeonhole principle some part is equal. A part's word is kept as an XOR of one random
number for each set bit, which is a hash of the word; an equi-join on (size band, part, word) gives the
candidate pairs, and each is verified on the full sets.

A band holds the sizes lo .. 2 lo, and a set is entered in the band below as well if it can pair with one
there. With D the largest difference that two sets of a band may have at the threshold, some of D + 1 parts
are equal. Larger sets do with fewer: so many that a pair at that largest difference has MEET equal parts
that hold n-grams on average, which misses it with probability below exp(-MEET), and nearer pairs far less
often.

Parts of sets of up to EXACT_TO n-grams would be empty, and equal for no reason, or hold one n-gram. There
each n-gram is a part of its own, and the pigeonhole is exact: of two sets at the threshold, some n-gram is
among the rarest n - ceil(threshold n) + 1 of either. Rarest is by counts over the whole corpus in 2**RARE_BITS
hashed counters; any order would do, this one keeps the buckets small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, factorial, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import broadcast_if_small, own, stash
from millrace.llm.tokens import FOLD, U, WORD, gram_sets, mix, tokenize

N, THRESHOLD = 2, 0.7
BITS = 1024
MEET = 12.0
EXACT_TO = 63
RARE_BITS = 20
#: Parts of fewer n-grams are little evidence, such as a frequent one alone; the most that still gives MEET.
LEAST_GRAMS = (3, 2)
#: Pairs verified in one cell; a group of candidates with more is dealt over a grid of cells.
CELL_PAIRS = 1_000_000
#: Sets of a bucket that meet in one task; those of a larger one are dealt over a grid of tasks.
CROWD = 4_000
_FLUSH = 1 << 20
#: Bits of the filter of the part words that occur in two sets: 32 for each, and no more than this. Beyond, it
#: lets words through that occur once, and the buckets drop them.
FILTER_BITS = 1 << 28
#: Earlier part words of a set that a bucket row tells of, in 32 bits each.
BEFORE = 4
#: Sets of up to this size carry a sketch of 256 bits into the buckets: their parts are small, so many
#: meet by chance, and the Hamming distance of the whole sketches refutes nearly all of these at once.
CARRY_TO = 364


@cache
def parts_of_band(band: int, threshold: float) -> tuple[int, int]:
    """(parts, least n-grams in a part that counts) for sets of 2**band .. 2**(band + 1) - 1 n-grams."""
    largest = (2 << band) - 1
    differ = floor(largest * (1 - threshold) / threshold + 1e-9)
    parts = differ + 1
    # parts that no difference hits, and that hold enough n-grams of a set of the smallest size
    for least in LEAST_GRAMS:
        m = 8
        while m < parts:
            mean = (1 << band) / m
            held = 1 - exp(-mean) * sum(mean**k / factorial(k) for k in range(least))
            if m * exp(-differ / m) * held >= MEET:
                return m, least
            m += max(1, m // 50)
    return parts, 1


def _rarest(keys: np.ndarray, ptr: np.ndarray, threshold: float, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of the rarest n-grams of the sets that pair with one of EXACT_TO n-grams at most."""
    sizes = np.diff(ptr)
    needed = np.ceil(sizes * threshold - 1e-9).astype(np.int64)
    chosen = (sizes > 0) & (needed <= EXACT_TO)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    used = chosen[owner]
    owner, keys = owner[used], keys[used]
    order = np.lexsort((keys, rare[keys.view(np.int64) & ((1 << RARE_BITS) - 1)], owner))
    owner, keys = owner[order], keys[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    good = rank <= (sizes - needed)[owner]
    return owner[good], mix(keys[good] + U(0x3C79AC492BA7B653))


def _signatures(keys: np.ndarray, ptr: np.ndarray, band: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of each part that counts; band: of each document, -1 for none."""
    sizes = np.diff(ptr)
    table = np.array([parts_of_band(b, threshold) for b in range(int(band.max(initial=0)) + 1)], np.int64)
    parts, least = table[np.maximum(band, 0), 0], table[np.maximum(band, 0), 1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    used = band[owner] >= 0
    owner, keys = owner[used], keys[used]
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, U)
    # the bit grows with the hash, so sorted hashes come part by part
    bit = ((keys >> U(16)) * (parts[owner] * BITS).astype(U)) >> U(32)
    part = bit // U(BITS)
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))))
    word = np.bitwise_xor.reduceat(mix(bit + U(0x5851F42D4C957F2D)), first)
    count = np.diff(np.append(first, len(keys)))
    owner, part = owner[first], part[first]
    place = (band[owner].astype(U) << U(40)) | part
    good = (count >= least[owner]) & (word != 0)
    return owner[good], mix(word[good] ^ mix(place[good]))


def _set_keys(keys: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(keys + U(0x2545F4914F6CDD1D)))))
    return mix((total[ptr[1:]] - total[ptr[:-1]]) ^ mix(np.diff(ptr).astype(U))).view(np.int64)


def _whole_sketches(keys: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of 1 .. CARRY_TO n-grams, and the parity of their sets on 256 bits as 4 words each."""
    sizes = np.diff(ptr)
    small = np.flatnonzero((sizes > 0) & (sizes <= CARRY_TO))
    if not len(small):
        return small, np.zeros((0, 4), U)
    used = np.repeat((sizes > 0) & (sizes <= CARRY_TO), sizes)
    bit = mix(keys[used] + U(0x9E6C63D0876A9A47)) >> U(56)
    first = np.concatenate(([0], np.cumsum(sizes[small])[:-1]))
    one = U(1) << (bit & U(63))
    return small, np.stack([np.bitwise_xor.reduceat(np.where(bit >> U(6) == U(lane), one, U(0)), first) for lane in range(4)], axis=1)


def _small_grams(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of the partition's small sets hold n-grams of each counter."""
        total = np.zeros(1 << RARE_BITS, np.int64)
        for batch in batches:
            for words in tokenize(batch.column(0)):
                keys, ptr = gram_sets(words, n)
                sizes = np.diff(ptr)
                used = np.repeat(np.ceil(sizes * threshold - 1e-9) <= EXACT_TO, sizes)
                np.add.at(total, keys[used].view(np.int64) & ((1 << RARE_BITS) - 1), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


def _sketch(n: int, threshold: float, handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = handle.value
        for batch in batches:
            for words in tokenize(batch.column(1)):
                keys, ptr = gram_sets(words, n)
                sizes = np.diff(ptr)
                band = np.where(sizes > EXACT_TO, np.floor(np.log2(np.maximum(sizes, 1))), -1).astype(np.int64)
                # a set pairs with one of the band below if threshold times its size lies there
                least = np.ceil(sizes * threshold - 1e-9)
                below = np.where((band > 0) & (least < (1 << np.maximum(band, 0))) & ((1 << np.maximum(band, 0)) > EXACT_TO + 1), band - 1, -1)
                all_sigs = _rarest(keys, ptr, threshold, rare), _signatures(keys, ptr, band, threshold), _signatures(keys, ptr, below, threshold)
                owner, sig = (np.concatenate(x) for x in zip(*all_sigs))
                order = np.argsort(owner, kind="stable")
                at = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
                small, whole = _whole_sketches(keys, ptr)
                width = np.zeros(len(sizes) + 1, np.int32)
                width[small + 1] = 32
                yield pa.record_batch(
                    [
                        batch.column(0).slice(words.row, len(sizes)),
                        pa.array(_set_keys(keys, ptr)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sig[order].view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.cumsum(width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(whole).tobytes())]),
                    ],
                    ["doc_id", "set_key", "n", "sigs", "whole"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part words of a partition that occur twice at least, and how often."""
    held = [np.asarray(b.column(0)) for b in batches]
    if held:
        sig = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1])))
        count = np.diff(np.append(first, len(sig)))
        again = np.flatnonzero(count > 1)
        yield pa.record_batch([pa.array(sig[first[again]]), pa.array(count[again])], ["sig", "count"])


def _slots(sig: np.ndarray, bits: int) -> np.ndarray:
    return (mix(sig.view(U)) % U(bits)).astype(np.int64)


def _word_filter(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table with the bits of all repeated part words set, and its number of bits."""
    n = repeated.count()
    bits = int(min(FILTER_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(32 * max(n, 1)))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slots(np.asarray(batch.column(0)), bits))
            at, first = np.unique(slot >> 5, return_index=True)
            value = np.bitwise_or.reduceat(1 << (slot & 31), first) if len(slot) else slot
            yield pa.record_batch([pa.array(at), pa.array(value)], ["at", "bits"])

    packed = np.zeros(bits // 32, np.uint32)
    for part in repeated.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        packed[np.asarray(part.column(0))] = np.asarray(part.column(1)).astype(np.uint32)
    return packed, bits


def _bucket_rows(handle, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part word of a set that the filter lets through, with the BEFORE that went before it."""
        table = handle.value
        for batch in batches:
            lists = batch.column("sigs")
            offset = np.asarray(lists.offsets).astype(np.int64)
            sig = np.asarray(lists.values)[offset[0] : offset[-1]]
            slot = _slots(sig, bits)
            keep = np.flatnonzero((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1)
            owner = np.searchsorted(offset - offset[0], keep, side="right") - 1
            sig = sig[keep]
            before = np.zeros((len(sig), BEFORE), np.uint32)
            mark = (sig.view(U) >> U(32)).astype(np.uint32) | np.uint32(1)
            for k in range(1, BEFORE + 1):
                same = owner[k:] == owner[:-k]
                before[k:, k - 1][same] = mark[:-k][same]
            row = pa.array(owner)
            yield pa.record_batch(
                [pa.array(sig), batch.column("set_key").take(row), batch.column("n").take(row).cast(pa.int32()), batch.column("whole").take(row), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * BEFORE), len(sig), [None, pa.py_buffer(before.tobytes())]).cast(pa.binary())],
                ["sig", "set_key", "n", "whole", "before"],
            )

    return run


def _bucket_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of different sets in each bucket of the partition whose carried sketches allow it.

        side is -1, or the side of a grid's cell that a set stands on: its pairs are with those of the other side.
        """
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        sig, key, size, side = (np.asarray(table[c].combine_chunks()) for c in ("sig", "set_key", "n", "side"))
        marks = table["before"].cast(pa.large_binary()).combine_chunks()
        whole = table["whole"].cast(pa.large_binary()).combine_chunks()
        del table
        # singletons go first: they are most
        order = np.argsort(sig)
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        order = order[np.lexsort((key[order], sig[order]))]
        if not len(order):
            return
        s, k = sig[order], key[order]
        order = order[np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))]
        sig, key, size, side, whole = sig[order], key[order], size[order], side[order], whole.take(pa.array(order))
        marks = np.frombuffer(marks.take(pa.array(order)).buffers()[2], np.uint32).reshape(-1, BEFORE)
        offset = np.frombuffer(whole.buffers()[1], np.int64)[: len(order) + 1]
        bits = np.frombuffer(whole.buffers()[2] or b"", U).reshape(-1, 4) if offset[-1] else np.zeros((1, 4), U)
        row = offset[:-1] // 32
        carried = np.diff(offset) == 32
        row[~carried] = 0
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        run_size = np.diff(np.append(first, len(sig)))
        left = np.repeat(first + run_size, run_size) - np.arange(len(sig)) - 1  # partners after each in its bucket
        upto_pairs = np.cumsum(left)
        share = (1 - threshold) / (1 + threshold)
        done = 0
        while done < len(sig):
            so_far = upto_pairs[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(upto_pairs, so_far + _FLUSH, side="right")))
            span = left[done:upto]
            if span.any():
                a = np.repeat(np.arange(done, upto), span)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(span) - span, span)
                good = (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9) & ((side[a] < 0) | (side[a] != side[b]))
                a, b = a[good], b[good]
                apart = np.bitwise_count(bits[row[a]] ^ bits[row[b]]).sum(axis=1, dtype=np.int64)
                good = ~(carried[a] & carried[b]) | (apart <= share * (size[a] + size[b]) + 1e-9)
                a, b = a[good], b[good]
                # a pair that shares an earlier word has been in that word's bucket
                fresh = np.ones(len(a), bool)
                for i in range(BEFORE):
                    for j in range(BEFORE):
                        fresh &= (marks[a, i] != marks[b, j]) | (marks[a, i] == 0)
                pair = np.stack((key[a[fresh]], key[b[fresh]]), axis=1)
                if len(pair):
                    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                    pair = pair[np.concatenate(([True], (pair[1:] != pair[:-1]).any(axis=1)))]
                    yield pa.record_batch([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])
            done = upto

    return run


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are (a, null, text) for the text of a set and (a, b, null) for a pair; all of a cell are here.

        A text is filed under the key of its own set: where a doc_id is repeated, other texts may come along.
        """
        sets: dict[int, np.ndarray] = {}
        pairs: list[np.ndarray] = []
        for batch in batches:
            a, b = np.asarray(batch.column(0)), batch.column(1)
            is_text = np.asarray(b.is_null())
            where = np.flatnonzero(is_text)
            if len(where):
                for words in tokenize(batch.column(2).take(pa.array(where))):
                    keys, ptr = gram_sets(words, n)
                    for d, key in enumerate(_set_keys(keys, ptr).tolist()):
                        sets[key] = keys[ptr[d] : ptr[d + 1]].copy()
            where = np.flatnonzero(~is_text)
            if len(where):
                pairs.append(np.stack((a[where], np.asarray(b.take(pa.array(where)))), axis=1))
        for some in pairs:
            jac = np.empty(len(some))
            for k, (x, y) in enumerate(some.tolist()):
                s, t = sets[x], sets[y]
                if len(s) > len(t):
                    s, t = t, s
                if len(s) < threshold * len(t) - 1e-9:
                    jac[k] = 0
                    continue
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum())
                jac[k] = both / (len(s) + len(t) - both)
            good = jac >= threshold - 1e-12
            yield pa.record_batch([pa.array(some[good, 0].copy()), pa.array(some[good, 1].copy()), pa.array(jac[good])], ["a", "b", "jaccard"])

    return run


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, set_key, n) puts documents of equal n-gram sets under one key;
    pairs (a, b, jaccard) has each pair of different sets at the threshold or above, a < b."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    rare = np.zeros(1 << RARE_BITS, np.int64)
    # a set of n-grams is no larger than its text
    for part in docs.where(F.length("text") > 0).select("text").mapInArrow(_small_grams(n, threshold), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
        rare[np.asarray(part.column(0))] = np.asarray(part.column(1))
    sketched = stash(docs.mapInArrow(_sketch(n, threshold, spark.sparkContext.broadcast(rare)), "doc_id long, set_key long, n long, sigs array<long>, whole binary").where("n > 0"), "sketches")
    members = sketched.select("doc_id", "set_key", "n")
    # of equal sets one is sketched into the buckets
    firsts = members.groupBy("set_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    more = members.join(firsts, "set_key").where("doc_id <> _first").select("doc_id", "set_key").distinct()
    unlike = sketched.join(broadcast_if_small(stash(more, "more")), ["doc_id", "set_key"], "left_anti")
    words = unlike.select(F.explode("sigs").alias("sig")).repartition("sig")
    repeated = stash(words.mapInArrow(_repeated, "sig long, count long"), "repeated")
    packed, bits = _word_filter(repeated.select("sig"))
    handle = spark.sparkContext.broadcast(packed)
    buckets = unlike.select("set_key", "n", "sigs", "whole").mapInArrow(_bucket_rows(handle, bits), "sig long, set_key long, n int, whole binary, before binary")
    crowds = stash(repeated.where(F.col("count") > CROWD).select("sig", F.ceil(F.col("count") / F.lit(float(CROWD))).cast("int").alias("_grid")), "crowds")
    # a crowded bucket's sets stand in rows and columns of a grid; two meet in one of its cells
    dealt = buckets.join(broadcast_if_small(crowds), "sig", "left").withColumn("_grid", F.coalesce("_grid", F.lit(1))).withColumn("_row", F.pmod("set_key", "_grid").cast("int"))
    dealt = dealt.withColumn("_column", F.explode(F.expr("sequence(0, _grid - 1)")))
    alone = F.col("_grid") == 1
    dealt = dealt.select(
        F.when(alone, F.col("sig")).otherwise(F.xxhash64("sig", F.least("_row", "_column"), F.greatest("_row", "_column"))).alias("sig"),
        "set_key", "n", "whole", "before",
        F.when(F.col("_row") == F.col("_column"), -1).otherwise(F.col("_row")).alias("side"),
    )
    candidates = stash(dealt.repartition("sig").mapInArrow(_bucket_pairs(threshold), "a long, b long").distinct(), "candidates")

    # pairs that share their smallest neighbour are verified together, so a text is sent to few cells
    lead = candidates.groupBy("b").agg(F.min("a").alias("_lead")).withColumnRenamed("b", "_b")
    led = candidates.join(lead, F.col("a") == F.col("_b"), "left").select("a", "b", F.coalesce("_lead", "a").alias("_lead"))
    led = stash(led, "led")
    crowds = led.groupBy("_lead").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_PAIRS).select(F.col("_lead").alias("_crowd"), F.ceil(F.sqrt(F.col("_n") / F.lit(float(CELL_PAIRS)))).alias("_side"))
    side = F.coalesce("_side", F.lit(1))
    celled = led.join(broadcast_if_small(stash(crowds, "crowds")), F.col("_lead") == F.col("_crowd"), "left").select("a", "b", F.xxhash64("_lead", F.pmod("a", side), F.pmod("b", side)).alias("_cell"))
    needed = celled.select(F.explode(F.array("a", "b")).alias("_key"), "_cell").groupBy("_key").agg(F.collect_set("_cell").alias("_cells"))
    holders = needed.join(members.groupBy("set_key").agg(F.min("doc_id").alias("_doc")), F.col("_key") == F.col("set_key")).select("_key", "_doc", "_cells")
    texts = docs.join(broadcast_if_small(stash(holders, "holders")), docs["doc_id"] == F.col("_doc"))
    texts = texts.select(F.explode("_cells").alias("_cell"), F.col("_key").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    both = texts.unionByName(celled.withColumn("text", F.lit(None).cast("string"))).repartition("_cell").select("a", "b", "text")
    return members, both.mapInArrow(_verify(n, threshold), "a long, b long, jaccard double")


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, set_id, links) of each document that is similar to another: their sets of word
    n-grams have a Jaccard similarity of at least threshold.

    links is the number of documents that it is similar to, class_id the smallest doc_id of those that
    similar pairs connect with it, set_id the smallest doc_id of those with the same set of n-grams. All links
    count; copies are not expanded into pairs. `set_pairs` has the pairs.

    A text of fewer than n words has one n-gram, all its words. Texts without words (null, empty, only
    marks) are similar to nothing, not even to each other. Rows with a null doc_id are left out; rows that
    repeat a doc_id with the same text count once, with different texts as documents of their own. Further
    columns are ignored.
    """
    members, pairs = similar_sets(docs, n, threshold)
    members, pairs = members.select("doc_id", "set_key").distinct(), stash(pairs.select("a", "b"), "pairs")
    sizes = stash(members.groupBy("set_key").agg(F.count("*").alias("_size"), F.min("doc_id").alias("set_id")), "sets")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.select(F.col("set_key").alias("b"), "_size"), "b").groupBy(F.col("a").alias("set_key")).agg(F.sum("_size").alias("_near"))
    roots = components(pairs).withColumnRenamed("node", "set_key")
    known = sizes.join(near, "set_key", "left").join(roots, "set_key", "left").where("_size > 1 or _near > 0")
    known = stash(known.select("set_key", "set_id", F.coalesce("root", "set_key").alias("_root"), (F.col("_size") - 1 + F.coalesce("_near", F.lit(0))).alias("links")), "known")
    known = known.join(known.groupBy("_root").agg(F.min("set_id").alias("class_id")), "_root")
    return members.join(known, "set_key").select("doc_id", "class_id", "set_id", "links")


def set_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(set_a, set_b, jaccard), set_a < set_b: the pairs of similar sets, by the set_id of `similar_documents`."""
    members, pairs = similar_sets(docs, n, threshold)
    ids = stash(members.groupBy("set_key").agg(F.min("doc_id").alias("_id")), "sets")
    found = pairs.join(ids.select(F.col("set_key").alias("a"), F.col("_id").alias("_x")), "a").join(ids.select(F.col("set_key").alias("b"), F.col("_id").alias("_y")), "b")
    return found.select(F.least("_x", "_y").alias("set_a"), F.greatest("_x", "_y").alias("set_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for edges (a, b).

    Alternates the large-star and small-star steps until the edges are stars; the number of rounds grows
    with the logarithm of the largest component.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node move to its smallest neighbour, itself included
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        # small star: a node and its smaller neighbours move to the smallest of these
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b")
        edges = stash(small.unionByName(low.select("a", F.col("_m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the smallest doc_id of each group of documents that similar pairs connect; the others go.

    Documents that are similar to nothing stay, those of a null doc_id and those without words too. Rows
    that repeat a doc_id share its fate. All columns are kept, whatever their names.
    """
    members, pairs = similar_sets(docs, n, threshold)
    roots = components(pairs.select("a", "b"))
    grouped = members.join(roots, members["set_key"] == roots["node"], "left").select("doc_id", F.coalesce("root", "set_key").alias("_group"))
    firsts = grouped.groupBy("_group").agg(F.min("doc_id").alias("_first"))
    # a row for each document that goes
    gone = grouped.join(firsts, "_group").where("doc_id <> _first").select(F.col("doc_id").alias(own("gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own("gone")], "left_anti")


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for `similar_documents` with bigrams, over documents: an exact self-join on the n-grams."""
    assert n == 2
    capitals = "".join(map(chr, FOLD))
    return f"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(text, '{capitals}', '{capitals.translate(FOLD)}'), '{WORD.pattern}') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, s.n::DOUBLE / (p.n + q.n - s.n) AS jaccard FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE s.n::DOUBLE / (p.n + q.n - s.n) >= {threshold} - 1e-12),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, least(doc_id, min(b) FILTER (WHERE jaccard = 1)) AS set_id, count(*) AS links
FROM links JOIN classes ON a = doc_id GROUP BY doc_id, class_id"""
