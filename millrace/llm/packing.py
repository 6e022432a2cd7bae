"""Lexical retrieval packing: windows filled with BM25 neighbours.

The seeds are a stated query set: the documents whose id is divisible by EVERY. Each seed is scored with BM25
against all documents of its language, on an inverted index that is built shard by shard where the documents
lie; a document is taken by the seed that scores it highest, so no document is used twice, and the documents
of a seed fill its windows greedily, by falling score.

Terms are words hashed into a fixed number of buckets, so the table of document frequencies, counted over
the whole corpus, has a bounded size. Impacts of postings are integers of IMPACT_BITS bits; their sums are
exact in whatever order they are made, so the result depends neither on shards nor on partitions. Terms that
many documents hold are scored as a matrix product, the others through their postings. A seed's scores are
divided by the length of its vector of term weights, which leaves the order of its neighbours as it is and
makes long and short seeds comparable.

Seeds are sent to the index in blocks of bounded size, each a pass over the index; the documents are never
shuffled, only a row of numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import prefix_sums, stash
from millrace.llm.tokens import U, mix, tokenize

WINDOW = 8192
EVERY = 100
TERM_BITS = 21
SHARD_WORDS = 1_000_000
K1, B = 1.2, 0.75
#: Integer sums of DENSE impacts of so many bits stay below 2**24 and are exact in single precision.
IMPACT_BITS, DENSE = 12, 4096
#: Terms in a larger share of the documents are scored as a matrix product.
DENSE_SHARE = 0.05
#: Terms of the seeds in one block, and scores of seeds and documents in one product.
BLOCK_TERMS, AT_ONCE = 3_000_000, 500_000
#: The documents of a seed are packed in pieces of so many windows.
CHUNK = 64
SCHEMA = "lang string, seed long, chunk long, window long, doc_ids array<long>, starts array<long>, ends array<long>, n_words long"


def bm25_weights(tf: np.ndarray, length: np.ndarray, idf: np.ndarray, average: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def inverse_frequency(df: np.ndarray, rows: int) -> np.ndarray:
    return np.log1p((rows - df + 0.5) / (df + 0.5))


def impacts(weights: np.ndarray, rows: int) -> np.ndarray:
    """Weights as integers from 1 to 2**IMPACT_BITS - 1; the largest weight that a corpus of so many rows allows is the largest."""
    most = inverse_frequency(np.float64(1), max(rows, 1)) * (K1 + 1)
    return np.clip(np.rint(weights * (((1 << IMPACT_BITS) - 1) / most)), 1, (1 << IMPACT_BITS) - 1)


def _inverted(terms: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms, the first posting of each and the end, the documents and the weights of the postings."""
    order = np.argsort(terms, kind="stable")
    vocabulary, first = np.unique(terms[order], return_index=True)
    return vocabulary, np.append(first, len(terms)), owner[order], weights[order]


def greedy_windows(rest: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Members of window after window: of what is left, in order, all that fit as they come."""
    waiting = np.arange(len(rest))
    while len(waiting):
        members, left, near = [], window, waiting
        while len(near):
            k = int(np.searchsorted(np.cumsum(rest[near]), left, side="right"))
            members.append(near[:k])
            left -= int(rest[near[:k]].sum())
            near = near[k:]
            near = near[rest[near] <= left]
        members = np.concatenate(members)
        yield members
        waiting = waiting[~np.isin(waiting, members, assume_unique=True)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its length in words, and its hashed terms and their counts as packed arrays."""
    buckets = U(64 - TERM_BITS)
    for batch in batches:
        for words in tokenize(batch.column(2)):
            n = len(words.ptr) - 1
            key = (words.owner().astype(U) << U(TERM_BITS)) | (words.hash >> buckets)
            key, count = np.unique(key, return_counts=True)
            at = np.searchsorted(key, np.arange(n + 1, dtype=U) << U(TERM_BITS))
            term = (key & U((1 << TERM_BITS) - 1)).astype("<u4")
            tie = np.concatenate((np.zeros(1, U), np.cumsum(mix(key & U((1 << TERM_BITS) - 1)) * count.astype(U))))
            yield pa.record_batch(
                [batch.column(0).slice(words.row, n), batch.column(1).slice(words.row, n), pa.array(words.counts()), pa.array((tie[at[1:]] - tie[at[:-1]]).view(np.int64)), _binaries(term, at), _binaries(count.astype("<u4"), at)],
                ["doc_id", "lang", "n", "tie", "terms", "tfs"],
            )


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of documents in one array, and the offsets."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), "<u4").astype(np.int64), np.concatenate(([0], np.cumsum([len(x) // 4 for x in held]))).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << TERM_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_ragged(batch.column(0))[0], minlength=1 << TERM_BITS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["term", "df"])


class Scorer:
    """What a shard needs of the whole corpus, and the seeds of one block by language."""

    def __init__(self, df: np.ndarray, rows: int, average: float, seeds: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.idf, self.rows, self.average, self.seeds = inverse_frequency(df, rows), rows, average, seeds
        often = np.flatnonzero(df > DENSE_SHARE * rows)
        often = np.sort(often[np.lexsort((often, -df[often]))[:DENSE]])
        self.dense = np.full(1 << TERM_BITS, -1, np.int16)
        self.dense[often] = np.arange(len(often))
        self.n_dense = len(often)

    def best(self, lang: str | None, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document of a shard the seed that scores it highest (of equal ones the smallest id), and the
        score; 0 where no seed shares a term."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), np.diff(ptr))
        weight = impacts(bm25_weights(tf, sizes[owner], self.idf[terms], self.average), self.rows)
        column = self.dense[terms]
        common = column >= 0
        matrix = np.zeros((self.n_dense, n), np.float32)
        matrix[column[common], owner[common]] = weight[common]
        vocabulary, first, posting, impact = _inverted(terms[~common], weight[~common], owner[~common])
        ids, wanted, at = self.seeds[lang]
        found, score = np.zeros(n, np.int64), np.zeros(n)
        step = max(8, AT_ONCE // n)
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            some = wanted[at[lo] : at[hi]]
            seed = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            length = np.sqrt(np.bincount(seed, self.idf[some] ** 2, minlength=hi - lo))
            column = self.dense[some]
            asked = np.zeros((hi - lo, self.n_dense), np.float32)
            asked[seed[column >= 0], column[column >= 0]] = 1
            some, seed = some[column < 0], seed[column < 0]
            total = (asked @ matrix).astype(np.float64)
            if len(vocabulary):
                place = np.minimum(np.searchsorted(vocabulary, some), len(vocabulary) - 1)
                there = vocabulary[place] == some
                place, seed = place[there], seed[there]
                span = first[place + 1] - first[place]
                row = np.repeat(first[place] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                total += np.bincount(np.repeat(seed, span) * n + posting[row], impact[row], minlength=(hi - lo) * n).reshape(hi - lo, n)
            total /= length[:, None]
            top = total.argmax(axis=0)
            its = total[top, np.arange(n)]
            better = its > score
            found[better], score[better] = ids[lo + top[better]], its[better]
        return found, score


def _answers(handle, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = handle.value
        pool: dict[str | None, list[pa.Table]] = {}
        size: dict[str | None, int] = {}

        def answered(lang: str | None) -> pa.RecordBatch:
            shard = pa.concat_tables(pool.pop(lang)).combine_chunks()
            size.pop(lang)
            terms, ptr = _ragged(shard["terms"])
            found, score = scorer.best(lang, np.asarray(shard["n"]), terms, _ragged(shard["tfs"])[0], ptr)
            uid = shard["uid"].combine_chunks()
            return pa.record_batch([uid.chunk(0) if isinstance(uid, pa.ChunkedArray) else uid, pa.array(found, mask=score == 0), pa.array(score)], ["uid", "seed", "score"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                if lang not in scorer.seeds:
                    continue
                its = pa.table(batch).filter(pa.array([x == lang for x in langs]))
                pool.setdefault(lang, []).append(its)
                size[lang] = size.get(lang, 0) + int(np.asarray(its["n"]).sum())
                if size[lang] >= shard_words:
                    yield answered(lang)
        for lang in list(pool):
            yield answered(lang)

    return run


def nearest_seeds(docs: DataFrame, every: int = EVERY, shard_words: int = SHARD_WORDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(uid, doc_id, lang, n, tie, seed, score): for each document with words the seed of its language that
    scores it highest. A seed has itself, at a score of 1e9; a document that shares no term with one has null."""
    spark = docs.sparkSession
    plain = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "lang", "text").mapInArrow(_index, "doc_id long, lang string, n long, tie long, terms binary, tfs binary").where("n > 0")
    indexed = stash(plain.withColumn("uid", F.monotonically_increasing_id()), "terms")
    is_seed = F.pmod("doc_id", F.lit(every)) == 0
    known = indexed.agg(F.count("*"), F.sum("n"), F.sum(F.when(is_seed, F.octet_length("terms") / 4))).first()
    rows, average = known[0], (known[1] or 1) / max(known[0], 1)
    counted = indexed.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 << TERM_BITS, np.float32)
    df[np.asarray(counted["term"])] = np.asarray(counted["df"])
    blocks = max(1, int(-(-(known[2] or 0) // block_terms)))
    read = indexed.select("uid", "lang", "n", "terms", "tfs")
    passes = []
    for k in range(blocks):
        some = indexed.where(is_seed & (F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k)).select("doc_id", "lang", "terms").toArrow().sort_by("doc_id")
        seeds, langs = {}, np.array([x or "" if x is None else f"={x}" for x in some["lang"].to_pylist()], object)
        for key in dict.fromkeys(langs.tolist()):
            its = some.take(pa.array(np.flatnonzero(langs == key)))
            seeds[key[1:] if key else None] = (np.asarray(its["doc_id"]), *_ragged(its["terms"]))
        handle = spark.sparkContext.broadcast(Scorer(df, rows, average, seeds))
        passes.append(stash(read.mapInArrow(_answers(handle, shard_words), "uid long, seed long, score double"), f"answers-{k}"))
        handle.destroy()
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    if blocks > 1:
        found = found.where(F.col("seed").isNotNull()).groupBy("uid").agg(F.min(F.struct((-F.col("score")).alias("s"), "seed")).alias("m")).select("uid", "m.seed", (-F.col("m.s")).alias("score"))
    found = indexed.where(~is_seed).select("uid", "doc_id", "lang", "n", "tie").join(found, "uid", "left")
    itself = indexed.where(is_seed).select("uid", "doc_id", "lang", "n", "tie", F.col("doc_id").alias("seed"), F.lit(1e9).alias("score"))
    return found.withColumn("score", F.coalesce("score", F.lit(0.0))).unionByName(itself)


def _fill(window: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        lang, seed, chunk = (group[c][0].as_py() for c in ("lang", "seed", "chunk"))
        group = group.sort_by([("score", "descending"), ("doc_id", "ascending"), ("n", "ascending"), ("tie", "ascending"), ("uid", "ascending")])
        ids, sizes = np.asarray(group["doc_id"]), np.asarray(group["n"])
        last = (sizes - 1) // window * window
        made = [([int(ids[d])], [a], [a + window]) for d in np.flatnonzero(last) for a in range(0, int(last[d]), window)]
        made += [(ids[m].tolist(), last[m].tolist(), sizes[m].tolist()) for m in greedy_windows(sizes - last, window)]
        k = len(made)
        return pa.table(
            {
                "lang": pa.array([lang] * k, pa.string()),
                "seed": pa.array([seed] * k, pa.int64()),
                "chunk": pa.array([chunk] * k, pa.int64()),
                "window": pa.array(range(k), pa.int64()),
                "doc_ids": pa.array([x[0] for x in made], pa.list_(pa.int64())),
                "starts": pa.array([x[1] for x in made], pa.list_(pa.int64())),
                "ends": pa.array([x[2] for x in made], pa.list_(pa.int64())),
                "n_words": pa.array([sum(x[2]) - sum(x[1]) for x in made], pa.int64()),
            }
        )

    return run


def pack_by_retrieval(docs: DataFrame, window: int = WINDOW, every: int = EVERY, shard_words: int = SHARD_WORDS, block_terms: int = BLOCK_TERMS, chunk: int = CHUNK) -> DataFrame:
    """(lang, seed, chunk, window, doc_ids, starts, ends, n_words): the words starts[i] .. ends[i] of doc_ids[i]
    make up the window. Every word of every document is in exactly one window.

    A document longer than the window fills windows of its own; its last piece joins others as a document does.
    The documents of a seed come by falling score, the seed first, and are cut into chunks of `chunk` windows'
    words; in each, a window takes all that still fit, in that order. Documents that share no term with a seed
    of their language, as where there is none, have the seed null and go by id.

    Rows with a null doc_id, and texts without words (null, empty, only marks), are in none. Rows that
    repeat a doc_id are packed as documents of their own. A null language is a language. Ties go to the
    smaller doc_id. Further columns are ignored.
    """
    keys = ("_lang", "_seed")
    order = [F.col("score").desc(), *map(F.col, ("doc_id", "n", "tie", "uid"))]
    keyed = nearest_seeds(docs, every, shard_words, block_terms).withColumn("_rest", F.pmod(F.col("n") - 1, F.lit(window)) + 1)
    keyed = keyed.withColumn("_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).withColumn("_seed", F.coalesce(F.col("seed").cast("string"), F.lit("")))
    # a seed may have any share of all documents
    placed = prefix_sums(keyed, "_rest", "_words", order, keys).withColumn("chunk", F.floor(F.col("_words") / F.lit(chunk * window)).cast("long"))
    return placed.select(*keys, "lang", "seed", "chunk", "doc_id", "n", "tie", "uid", "score").groupBy(*keys, "chunk").applyInArrow(_fill(window), SCHEMA)
