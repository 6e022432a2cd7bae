"""Tokenizer fertility: words and tokens by language, corpus replication, candidate search, BPE."""

from __future__ import annotations

import heapq
import random
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import settled

LANGUAGES = ("English", "Hindi", "Telugu", "Marathi")
ENGLISH_LIMIT = 1.2
TARGET_WORDS = 90_000
VOCABULARY, SPECIAL_PIECES = 10_000, 4
APPENDICES = "See also|Notes|References|External links|इन्हें भी देखें|सन्दर्भ|बाहरी कड़ियाँ|हेही पहा|संदर्भ|बाह्य दुवे|ఇవి కూడా చూడండి|మూలాలు|బయటి లింకులు"


def truncate_extract(text: Column, composed: bool = False) -> Column:
    """The lines of an extract, composed, before its first appendix heading, without heading fences and empty lines.

    composed: the text is known to be composed, and no Python is needed.
    """
    lines = F.transform(F.split(F.coalesce(text if composed else T.nfc(text), F.lit("")), "\\r\\n|\\r|\\n"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))
    stop = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"(?iu)^==\\s*({APPENDICES})\\s*==$"), i)), lambda i: i.isNotNull())
    kept = F.when(F.size(stop) > 0, F.slice(lines, F.lit(1), F.coalesce(F.array_min(stop), F.lit(0)))).otherwise(lines)
    bare = F.filter(F.transform(kept, lambda x: F.regexp_replace(x, "^=+\\s*|\\s*=+$", "")), lambda x: x != "")
    return F.concat(F.array_join(bare, "\n"), F.lit("\n"))


def word_stats(docs: DataFrame, language: str = "lang", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(language, words, chars, unique_words) and, with a count of tokens for each text, tokens and ratio.

    Distinct words are counted exactly, by word first, so a frequent word is combined before the shuffle.
    """
    per_text = [F.length(text).alias("_c"), *([tokens.alias("_t")] if tokens is not None else [])]
    # a first row without a word stands for the text itself, so that one pass gives all
    rows = docs.select(language, F.array_insert(T.words(F.col(text)), 1, F.lit(None).cast("string")).alias("_w"), *per_text).select(language, F.posexplode("_w").alias("_i", "_w"), *[c for c in (("_c", "_t") if tokens is not None else ("_c",))])
    whole = lambda c: F.sum(F.when(F.col("_i") == 0, F.col(c))).alias(c)
    by_word = rows.groupBy(language, "_w").agg(F.count("*").alias("_n"), *[whole(c) for c in (("_c", "_t") if tokens is not None else ("_c",))])
    is_word = F.col("_w").isNotNull()
    sums = [F.coalesce(F.sum(F.when(is_word, F.col("_n"))), F.lit(0)).cast("long").alias("words"), F.sum("_c").cast("long").alias("chars"), F.count("_w").alias("unique_words")]
    out = by_word.groupBy(language).agg(*sums, *([F.sum("_t").cast("long").alias("tokens")] if tokens is not None else []))
    return out.withColumn("ratio", F.col("tokens") / F.col("words")) if tokens is not None else out


def spread(metrics: DataFrame, ratio: str = "ratio") -> DataFrame:
    """(highest, lowest, spread, total, score): the score is 1000 over the spread, and infinite without one."""
    out = metrics.agg(F.max(ratio).alias("highest"), F.min(ratio).alias("lowest"), F.sum(ratio).alias("total"))
    out = out.withColumn("spread", F.col("highest") - F.col("lowest"))
    return out.withColumn("score", F.when(F.col("spread") == 0, F.lit(float("inf"))).otherwise(1000.0 / F.nullif("spread", F.lit(0.0))))


def repeats(words: Column, weight: Column) -> Column:
    """How often a language's text is repeated to make up its weight of the corpus, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(TARGET_WORDS)) / words * weight, 0).cast("long"))


def replicate(lines: DataFrame, weights: DataFrame, language: str = "lang") -> DataFrame:
    """lines repeated by the weight (language, weight) of their language and its number of words."""
    totals = lines.groupBy(language).agg(F.sum(F.size(T.words(F.col("text")))).alias("_n"))
    times = totals.join(F.broadcast(weights), language).select(language, repeats(F.col("_n"), F.col("weight")).alias("_r"))
    return lines.join(F.broadcast(times), language).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_r"))).drop("_r")


def candidates(seed: int = 20260717) -> list[dict[str, float]]:
    """10 set allocations, then 38 drawn with a seeded generator."""
    some = [(e, 1.0, 1.0, 1.0) for e in (4.0, 6.0, 8.0, 10.0, 12.0)]
    some += [(8.0, 1.4, 1.4, 1.4), (10.0, 1.5, 2.0, 1.5), (12.0, 2.0, 2.0, 2.0), (10.0, 1.0, 2.5, 1.5), (10.0, 1.5, 1.5, 2.5)]
    draw = random.Random(seed)
    english, others = (4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0), (0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0)
    for _ in range(38):
        some.append((draw.choice(english), draw.choice(others), draw.choice(others), draw.choice(others)))
    return [dict(zip(LANGUAGES, x)) for x in some]


def candidate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, w) for k, w in enumerate(candidates())], "trial long, weights map<string,double>")


def objective(ratios: Column, english: str = "English") -> Column:
    """A struct that orders trials: compliant ones first, then excess, spread, highest, total."""
    values = F.map_values(ratios)
    excess = F.greatest(F.lit(0.0), ratios[english] - ENGLISH_LIMIT)
    return F.struct(
        (excess > 1e-12).alias("violates"), excess.alias("excess"), (F.array_max(values) - F.array_min(values)).alias("spread"), F.array_max(values).alias("highest"),
        F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


def select_trial(trials: DataFrame, english: str = "English") -> DataFrame:
    """The best of the trials (trial, ratios); the first of equals."""
    ranked = trials.withColumn("_o", objective(F.col("ratios"), english))
    best = ranked.agg(F.min_by(F.struct("trial", "ratios", "_o"), F.struct("_o", "trial")).alias("b"))
    return best.select("b.trial", "b._o.violates", "b._o.spread", "b._o.highest", "b._o.total")


def bpe_pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) of neighbouring symbols, for (symbols array, freq): one step of training."""
    pairs = F.expr("transform(sequence(1, greatest(size(symbols) - 1, 1)), i -> struct(get(symbols, i - 1) as l, get(symbols, i) as r))")
    exploded = words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "freq")
    return exploded.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("freq").alias("n"))


def bpe_merges(words: list[tuple[list[str], int]], merges: int) -> list[tuple[str, str]]:
    """Greedy merges over word frequencies; of equally frequent pairs the smaller one first."""
    return bpe_train(words, merges)[0]


def bpe_train(words: Iterable[tuple[Sequence[str], int]], merges: int) -> tuple[list[tuple[str, str]], list[int | None]]:
    """The merges of bpe_merges, and how many symbols each word has in the end; None where encode_word must tell, since a
    pair came up in it again after it had been merged, or one of its pairs was merged twice.

    Symbols are numbers in one array, where a merged one covers the cell behind it. Counts are kept from merge to merge:
    only the places of the merged pair are read again, and of each only the pairs to its left and right change.
    """
    names: list[str] = []
    number: dict[str, int] = {}
    cells, starts, ends, freqs = array("i"), array("q"), array("q"), array("q")
    for symbols, freq in words:
        freqs.append(freq)
        starts.append(len(cells))
        for s in symbols:
            k = number.get(s)
            if k is None:
                k = number[s] = len(names)
                names.append(s)
            cells.append(k)
        ends.append(len(cells))
    kind = "i" if len(cells) < 1 << 31 else "q"
    # the cell before and behind each; -1 at the edges of a word
    behind, before, owner = array(kind, range(1, len(cells) + 1)), array(kind, range(-1, len(cells) - 1)), array("i", bytes(4 * len(cells)))
    counts: dict[int, int] = {}
    where: dict[int, array] = {}
    for w, (start, end) in enumerate(zip(starts, ends)):
        if start == end:
            continue
        freq = freqs[w]
        behind[end - 1], before[start], owner[start] = -1, -1, w
        left = cells[start]
        for k in range(start + 1, end):
            owner[k] = w
            right = cells[k]
            pair = left << 32 | right
            if pair in counts:
                counts[pair] += freq
                where[pair].append(k - 1)
            else:
                counts[pair] = freq
                where[pair] = array(kind, (k - 1,))
            left = right
    sizes: list[int | None] = [end - start for start, end in zip(starts, ends)]
    alive: dict[int, int] = {pair: len(places) for pair, places in where.items()}
    queue = [(-n, (names[pair >> 32], names[pair & 0xFFFFFFFF]), pair) for pair, n in counts.items()]
    heapq.heapify(queue)
    learned: list[tuple[str, str]] = []
    known: dict[int, array] = {}  # the words in which a pair was merged
    doubtful: set[int] = set()
    while queue and len(learned) < merges:
        n, best, pair = heapq.heappop(queue)
        if not alive.get(pair) or counts[pair] != -n:
            continue  # an entry of before a change
        learned.append(best)
        if pair in known:
            doubtful.update(known[pair])
        merged_in = known.setdefault(pair, array("i"))
        a, b, whole = pair >> 32, pair & 0xFFFFFFFF, "".join(best)
        c = number.get(whole)
        if c is None:
            c = number[whole] = len(names)
            names.append(whole)
        changed: set[int] = set()
        places = where.pop(pair)
        del alive[pair], counts[pair]
        # from left to right in each word: of overlapping pairs the first is merged
        for k in sorted(places):
            if cells[k] != a:
                continue
            j = behind[k]
            if j < 0 or cells[j] != b:
                continue
            w = owner[k]
            freq = freqs[w]
            i, m = before[k], behind[j]
            if i >= 0:
                old, new = cells[i] << 32 | a, cells[i] << 32 | c
                if old != pair:
                    counts[old] -= freq
                    alive[old] -= 1
                    changed.add(old)
                if new in known:
                    doubtful.add(w)
                if new in counts:
                    counts[new] += freq
                    alive[new] += 1
                    where[new].append(i)
                else:
                    counts[new], alive[new], where[new] = freq, 1, array(kind, (i,))
                changed.add(new)
            if m >= 0:
                old, new = b << 32 | cells[m], c << 32 | cells[m]
                if old != pair:
                    counts[old] -= freq
                    alive[old] -= 1
                    changed.add(old)
                if new in known:
                    doubtful.add(w)
                if new in counts:
                    counts[new] += freq
                    alive[new] += 1
                    where[new].append(k)
                else:
                    counts[new], alive[new], where[new] = freq, 1, array(kind, (k,))
                changed.add(new)
                before[m] = k
            cells[k], cells[j] = c, -1
            behind[k] = m
            sizes[w] -= 1
            merged_in.append(w)
        for x in changed:
            if alive.get(x):
                heapq.heappush(queue, (-counts[x], (names[x >> 32], names[x & 0xFFFFFFFF]), x))
            elif x in alive:
                del alive[x], counts[x], where[x]
    for w in doubtful:
        sizes[w] = None
    return learned, sizes


def search(word_counts: DataFrame, trials: DataFrame, vocabulary_size: int) -> DataFrame:
    """(trial, ratios): each candidate's merges are learned on the weighted words and measured on the plain ones.

    As in the trainer, the vocabulary holds the special pieces and the single symbols besides the merges.
    word_counts (language, word, freq) is a vocabulary, not a corpus: it is written to the shared folder once and read by
    each trial, a task of its own.
    """
    vocabulary = settled(word_counts.select("language", "word", "freq"))
    files = vocabulary.inputFiles()
    weights_of = {r.trial: dict(r.weights) for r in trials.select("trial", "weights").collect()}  # a row for each candidate

    def one(weights: dict[str, float]) -> dict[str, float]:
        table = pa.concat_tables([pq.read_table(path, filesystem=system) for system, path in map(FileSystem.from_uri, files)])
        table = table.filter(pc.is_in(table["language"], pa.array(list(weights))))
        if not len(table):
            return {}
        # words are numbers in their order, and text only once: a worker holds little besides its training
        words = table["word"].combine_chunks().unique().to_pylist()
        place = {w: k for k, w in enumerate(sorted(words))}
        codes = np.fromiter((place[w] for batch in table["word"].chunks for w in batch.to_pylist()), "int64", len(table))
        words = list(place)
        del place
        freq, language = table["freq"].to_numpy(), np.array(table["language"].to_pylist(), dtype=object)
        of = np.array([weights[x] for x in language], dtype="float64")
        total = np.zeros(len(words), "int64")
        np.add.at(total, codes, (freq * of * 1000).round().astype("int64"))
        merges = max(0, vocabulary_size - SPECIAL_PIECES - len({"▁"}.union(*words)))
        learned, sizes = bpe_train((("▁" + w, int(n)) for w, n in zip(words, total)), merges)
        ranks = {pair: k for k, pair in enumerate(learned)}
        size = np.array([len(encode_word(w, ranks)) if n is None else n for w, n in zip(words, sizes)], dtype="int64")
        n = size[codes] * freq
        return {x: int(n[language == x].sum()) / int(freq[language == x].sum()) for x in weights if (language == x).any()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trial in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([trial], pa.int64()), pa.array([list(one(weights_of[trial]).items())], pa.map_(pa.string(), pa.float64()))], ["trial", "ratios"])

    spark = word_counts.sparkSession
    # a trial for each task
    tasks = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in weights_of], max(1, len(weights_of))), "trial long")
    found = tasks.mapInArrow(run, "trial long, ratios map<string,double>").collect()
    return spark.createDataFrame(found, "trial long, ratios map<string,double>")


def encode_word(word: str, merges: dict[tuple[str, str], int]) -> list[str]:
    symbols = ["▁", *word]
    while len(symbols) > 1:
        rank, k = min((merges.get(p, len(merges)), k) for k, p in enumerate(zip(symbols, symbols[1:])))
        if rank == len(merges):
            break
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols


def count_tokens(merges: dict[tuple[str, str], int]):
    """An Arrow UDF that counts the tokens of texts; each distinct word is encoded once in a task."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                n = 0
                for w in (t or "").split():
                    if w not in known:
                        known[w] = len(encode_word(w, merges))
                    n += known[w]
                out.append(n)
            yield pd.Series(out, dtype="int64")

    return run


def verify_metrics(published: DataFrame, computed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(language, field): what differs between two tables (language, words, tokens, ratio)."""
    both = published.alias("p").join(computed.alias("c"), "language", "full_outer")
    tests = [F.when(~F.coalesce(F.abs(F.col(f"p.{f}") - F.col(f"c.{f}")) <= tolerance, F.lit(False)), F.lit(f)) for f in ("words", "tokens", "ratio")]
    return both.select("language", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("field"))
