"""Learned decision lists: ordered threshold rules over text statistics.

The statistics are Spark expressions. Sequential covering learns on the driver from a sample of labelled
documents of a bounded size: a rule is grown on two thirds of what is not yet covered, condition by
condition by information gain, and pruned on the rest; it is kept while it is right more often than not
there. The list becomes one ordered conditional expression over the statistics of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import replacing

SAMPLE_PER_CLASS = 3000
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 48
#: Pruned rules must be right on at least this share of the pruning set that they cover.
LEAST_PRECISION = 0.7
STATISTICS = ("n_chars", "n_words", "mean_word", "distinct_words", "capitals", "digits", "symbols", "bars", "exclaims", "top_word", "lines")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, then STATISTICS as doubles) for each row; null and empty texts have zeros.

    Shares are of the characters (capitals, digits, symbols, bars, exclaims) or of the words
    (distinct_words; top_word: the repetitions of neighbouring words).
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    base = docs.select("doc_id", text.alias("_t"), words.alias("_w"))
    n = F.length("_t").cast("double")
    k = F.size("_w").cast("double")
    of_chars = lambda kept: F.when(n > 0, (n - F.length(F.regexp_replace("_t", kept, "")).cast("double")) / n).otherwise(0.0)
    bare = F.transform("_w", lambda w: F.lower(w))
    return base.select(
        "doc_id",
        n.alias("n_chars"),
        k.alias("n_words"),
        F.when(k > 0, n / k).otherwise(0.0).alias("mean_word"),
        F.when(k > 0, F.size(F.array_distinct(bare)) / k).otherwise(0.0).alias("distinct_words"),
        of_chars(r"\p{Lu}+").alias("capitals"),
        of_chars(r"\p{Nd}+").alias("digits"),
        of_chars(r"[#$%&*@^~<>{}\[\]\\+=_]+").alias("symbols"),
        of_chars(r"\|+").alias("bars"),
        of_chars(r"!+").alias("exclaims"),
        F.when(k > 1, F.aggregate(F.zip_with(F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), "_w", lambda a, b: a.eqNullSafe(b)), F.lit(0.0), lambda s, e: s + e.cast("double")) / (k - 1)).otherwise(0.0).alias("top_word"),
        (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("\n"), F.lit("")))).cast("double").alias("lines"),
    )


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.cut if self.above else x[self.name] < self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.cut!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Condition, ...]:
    """Conditions by the information gained about bad, until none of the good is covered."""
    covered = np.ones(len(bad), bool)
    chosen: list[Condition] = []
    while len(chosen) < MAX_CONDITIONS and (covered & ~bad).any():
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        best, best_gain = None, 1e-9
        before = log2(p0 / (p0 + n0)) if p0 else 0.0
        for name in x:
            values = np.unique(x[name][covered])
            if len(values) > CUTS:
                values = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="lower"))
            for cut in values[1:]:
                high = covered & (x[name] >= cut)
                p, n = int((high & bad).sum()), int((high & ~bad).sum())
                for above, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                    if pp:
                        gain = pp * (log2(pp / (pp + nn)) - before)
                        if gain > best_gain:
                            best, best_gain = Condition(name, above, float(cut)), gain
        if best is None:
            break
        chosen.append(best)
        covered &= best.holds(x)
    return tuple(chosen)


def _prune(conditions: tuple[Condition, ...], x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix with the best (covered bad - covered good) / covered; the shorter one of equals."""
    best, best_worth = Rule((), 0.0), -2.0
    for k in range(1, len(conditions) + 1):
        rule = Rule(conditions[:k], 0.0)
        held = rule.holds(x)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth + 1e-12:
            best, best_worth = Rule(conditions[:k], (p + 1) / (p + n + 2)), worth
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11) -> list[Rule]:
    """Ordered rules for bad documents; whatever none of them covers is good."""
    r = np.random.default_rng(seed)
    left = np.arange(len(bad))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and bad[left].any():
        mixed = r.permutation(left)
        grow, prune = mixed[: -(-len(mixed) * 2 // 3)], mixed[-(-len(mixed) * 2 // 3) :]
        if not bad[grow].any():
            break
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not conditions:
            break
        rule = _prune(conditions, {k: v[prune] for k, v in x.items()}, bad[prune]) if len(prune) else Rule(conditions, 1.0)
        if not rule.conditions or rule.precision < LEAST_PRECISION:
            break
        rules.append(rule)
        left = left[~rule.holds({k: v[left] for k, v in x.items()})]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[Rule]:
    """Rules learned from at most per_class labelled documents of each class, chosen by a hash of doc_id.

    Null ids and labels are left out, and documents that are labelled both good and bad; a label that is repeated
    counts once. Of the rows that repeat a doc_id the text that comes first in order is taken. Without documents of
    both classes there are no rules.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    picked = pa.concat_tables([known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).toArrow() for q in (0, 1)])
    rows = spark.createDataFrame(picked.to_pandas() if picked.num_rows else [], "doc_id long, quality int")
    # no more than 2 * per_class rows
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = statistics(texts).join(F.broadcast(rows), "doc_id").toArrow().sort_by("doc_id")
    bad = np.asarray(sample["quality"]) == 0
    if not bad.any() or bad.all():
        return []
    return learn({s: np.asarray(sample[s]) for s in STATISTICS}, bad)


def rule_expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, as an ordered conditional; 0 where none does."""
    out = None
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule.conditions:
            test = test & ((F.col(c.name) >= c.cut) if c.above else (F.col(c.name) < c.cut))
        out = F.when(test, k + 1) if out is None else out.when(test, k + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule, reason, good) for every row of docs: the first rule that holds, what it says, and
    whether none does. Null and empty texts are judged by their zeros; null doc_ids and repeated rows are
    judged like any; further columns are ignored."""
    texts = [str(r) for r in rules]
    reasons = F.array(F.lit(None).cast("string"), *map(F.lit, texts))
    return replacing(statistics(docs), ["rule"]).select("doc_id", rule_expression(rules).alias("rule")).select("doc_id", "rule", F.get(reasons, F.col("rule")).alias("reason"), (F.col("rule") == 0).alias("good"))
