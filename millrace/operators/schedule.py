"""Two-source mixture schedules with exact totals, and their no-repeat draws, as DataFrames over steps."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCES = ("fineweb", "indic")
#: Third seeds of the generators of patterns and permutations.
PATTERN, PERMUTATION = 0x5037, 0xA771


@dataclass(frozen=True)
class Plan:
    """Tokens of a run, where the mixture changes, and the first source's share before and after."""

    total_tokens: int
    shift_tokens: int
    block_size: int
    batch: int
    before: Fraction = Fraction(1, 2)
    after: Fraction = Fraction(4, 5)
    transition_tokens: int = 0
    mode: str = "hard"

    def __post_init__(self) -> None:
        step = self.block_size * self.batch
        if self.mode not in ("hard", "linear"):
            raise ValueError("a schedule is hard or linear")
        if min(self.total_tokens, self.block_size, self.batch) <= 0 or not 0 < self.shift_tokens < self.total_tokens:
            raise ValueError("sizes must be positive, and the shift inside the run")
        if self.total_tokens % step or self.shift_tokens % step:
            raise ValueError("the run and the shift must be whole steps")
        for share in (self.before, self.after):
            if not 0 <= share <= 1 or (share * self.batch).denominator != 1:
                raise ValueError("a share must give a whole number of sequences in a batch")
        if self.mode == "linear":
            if self.transition_tokens <= 0 or self.transition_tokens % step or self.transition_tokens // step % 2:
                raise ValueError("the transition must be a positive even number of steps")
            if self.start < 0 or self.end > self.steps:
                raise ValueError("the transition doesn't fit inside the run")

    @property
    def steps(self) -> int:
        return self.total_tokens // (self.block_size * self.batch)

    @property
    def shift(self) -> int:
        return self.shift_tokens // (self.block_size * self.batch)

    @property
    def window(self) -> int:
        return self.transition_tokens // (self.block_size * self.batch) if self.mode == "linear" else 0

    @property
    def start(self) -> int:
        return self.shift - self.window // 2

    @property
    def end(self) -> int:
        return self.shift + self.window // 2


def _allocated(plan: Plan, k: Column) -> Column:
    """Sequences of the first source in the first k steps of the transition: a quadratic, rounded half up, in integers."""
    n, delta = plan.window, plan.after - plan.before
    # batch * (before * k + delta * k^2 / (2 n)) over one denominator
    bottom = 2 * n * plan.before.denominator * delta.denominator
    linear = plan.batch * plan.before.numerator * 2 * n * delta.denominator
    square = plan.batch * delta.numerator * plan.before.denominator
    top = F.lit(linear) * k + F.lit(square) * k * k
    return _div(2 * top + bottom, 2 * bottom)


def _div(top: Column, bottom: int) -> Column:
    """Integer division of whole numbers, towards minus infinity."""
    rest = F.pmod(top, F.lit(bottom))
    return ((top - rest) / F.lit(bottom)).cast("long")


def step_counts(spark: SparkSession, plan: Plan) -> DataFrame:
    """(step, fineweb, indic): sequences of each source in each step."""
    step = F.col("id")
    first = F.when(step < plan.start, int(plan.before * plan.batch)).otherwise(int(plan.after * plan.batch))
    if plan.window:
        inside = (step >= plan.start) & (step < plan.end)
        k = step - plan.start
        first = F.when(inside, _allocated(plan, k + 1) - _allocated(plan, k)).otherwise(first)
    return spark.range(plan.steps).select(step.alias("step"), first.cast("long").alias("fineweb")).withColumn("indic", F.lit(plan.batch) - F.col("fineweb"))


def phases(spark: SparkSession, plan: Plan) -> DataFrame:
    """(step, phase) for every step."""
    step = F.col("id")
    if plan.mode == "hard":
        label = F.when(step < plan.shift, "pre_shift").otherwise("post_shift")
    else:
        label = F.when(step < plan.start, "pre_transition").when(step < plan.end, "linear_transition").otherwise("post_transition")
    return spark.range(plan.steps).select(step.alias("step"), label.alias("phase"))


def totals(counts: DataFrame, block_size: int) -> DataFrame:
    """(source, sequences, tokens) over all steps."""
    by_source = counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("n")) for s in SOURCES])).alias("c"))
    return by_source.groupBy("c.source").agg(F.sum("c.n").alias("sequences")).withColumn("tokens", F.col("sequences") * block_size)


def draw_bases(spark: SparkSession, plan: Plan) -> DataFrame:
    """(step, source, base): draws of each source before each step, in closed form, without a window."""
    step = F.col("step")
    before, after = int(plan.before * plan.batch), int(plan.after * plan.batch)
    first = F.least(step, F.lit(plan.start)) * before + F.greatest(step - plan.end, F.lit(0)) * after
    if plan.window:
        first = first + _allocated(plan, F.least(F.greatest(step - plan.start, F.lit(0)), F.lit(plan.window)))
    bases = spark.range(plan.steps).select(F.col("id").alias("step")).withColumn("_first", first.cast("long"))
    pairs = F.array(F.struct(F.lit("fineweb").alias("source"), F.col("_first").alias("base")), F.struct(F.lit("indic").alias("source"), (step * plan.batch - F.col("_first")).alias("base")))
    return bases.select("step", F.explode(pairs).alias("p")).select("step", "p.source", "p.base")


def local_draws(spark: SparkSession, plan: Plan, steps: tuple[int, int], ranks: int, micro_steps: int, seed: int = 0) -> DataFrame:
    """(step, position, micro_step, rank, slot, source, draw_ordinal) of the steps from .. to - 1.

    The order of the sources in a batch is a hash of seed, step and position: exact counts, native order.
    """
    if plan.batch % (ranks * micro_steps):
        raise ValueError("the batch must divide over ranks and micro-steps")
    slots = plan.batch // (ranks * micro_steps)
    counts = step_counts(spark, plan).where(F.col("step").between(steps[0], steps[1] - 1))
    rows = counts.select("step", "fineweb", F.explode(F.sequence(F.lit(0), F.lit(plan.batch - 1))).alias("position"))
    mixed = F.row_number().over(Window.partitionBy("step").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "step", "position")), "position"))
    rows = rows.withColumn("source", F.when(mixed <= F.col("fineweb"), "fineweb").otherwise("indic"))
    nth = F.row_number().over(Window.partitionBy("step", "source").orderBy("position")) - 1
    position = F.col("position")
    return (
        rows.withColumn("_nth", nth)
        .join(draw_bases(spark, plan), ["step", "source"])
        .select(
            "step",
            position.cast("long").alias("position"),
            F.floor(position / (ranks * slots)).alias("micro_step"),
            (F.floor(position / slots) % ranks).alias("rank"),
            (position % slots).cast("long").alias("slot"),
            "source",
            (F.col("base") + F.col("_nth")).alias("draw_ordinal"),
        )
    )


def exact_patterns(counts: DataFrame, seed: int) -> DataFrame:
    """(step, pattern): the order of source numbers in each step, by the numpy generator seeded with seed, step and PATTERN."""

    def run(batches):
        for frame in batches:
            rows = []
            for step, first, second in frame[["step", "fineweb", "indic"]].itertuples(index=False):
                pattern = np.repeat(np.array([0, 1], np.int8), [first, second])
                np.random.default_rng(np.random.SeedSequence([seed, int(step), PATTERN])).shuffle(pattern)
                rows.append((int(step), pattern.astype(int).tolist()))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["step", "pattern"])

    return counts.mapInPandas(run, "step long, pattern array<int>")


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """(step, source, n); an unknown source number is an error."""
    number = F.col("number")
    named = F.when(number == 0, "fineweb").when(number == 1, "indic").otherwise(F.raise_error(F.concat(F.lit("unknown source "), number.cast("string"))))
    return patterns.select("step", F.explode("pattern").alias("number")).groupBy("step", named.alias("source")).agg(F.count("*").alias("n"))


def permutation_constants(size: int, seed: int, passes: int) -> list[tuple[int, int, int]]:
    """(pass, a, b) of the affine permutations of a pool: a is coprime to the size."""
    if size <= 1:
        raise ValueError("a pool must have two blocks at least")
    out = []
    for number in range(passes):
        words = np.random.SeedSequence([seed, number, PERMUTATION]).generate_state(2, dtype=np.uint64)
        a = int(words[0] % np.uint64(size)) or 1
        while gcd(a, size) > 1:
            a = (a + 1) % size or 1
        out.append((number, a, int(words[1] % np.uint64(size))))
    return out


def even_constants(size: int, passes: int) -> list[tuple[int, int, int]]:
    """(pass, a, b) without a generator: a is the first number from a share of the size that is coprime to it."""
    out = []
    for number in range(passes):
        a = size * (number + 1) // (passes + 1) + 1
        while gcd(a, size) > 1:
            a += 1
        out.append((number, a, size * (number + 1) // 3 % size))
    return out


def permuted(draws: DataFrame, size: int, seed: int, last_ordinal: int, ordinal: str = "draw_ordinal", constants: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """draws with pass and block_id: within a pass every block is drawn once. constants: in place of those of the seed."""
    spark = draws.sparkSession
    table = spark.createDataFrame(constants or permutation_constants(size, seed, last_ordinal // size + 1), "pass long, _a long, _b long")
    o = F.col(ordinal)
    return draws.withColumn("pass", F.floor(o / F.lit(size))).join(F.broadcast(table), "pass").withColumn("block_id", F.pmod(F.col("_a") * F.pmod(o, F.lit(size)) + F.col("_b"), F.lit(size))).drop("_a", "_b")


def learning_rate(step: Column, total: int, warmup: int, floor: float) -> Column:
    """Linear warm-up, then a cosine that ends at floor."""
    progress = F.least(F.greatest((step - warmup) / float(max(total - warmup, 1)), F.lit(0.0)), F.lit(1.0))
    cosine = 0.5 * (1.0 + F.cos(F.lit(np.pi) * progress))
    return F.when(step < warmup, F.greatest(step, F.lit(1)) / float(max(warmup, 1))).otherwise(floor + (1.0 - floor) * cosine)


def blend(spark: SparkSession, start: dict[str, Fraction], end: dict[str, Fraction], steps: int, batch: int) -> DataFrame:
    """(step, lane, n): a linear blend between the mixtures of several lanes; the largest remainders close each step."""
    lanes = [(k, float(start[k]), float(end[k])) for k in start]
    table = spark.createDataFrame(lanes, "lane string, _from double, _to double")
    middle = (F.col("id") + 0.5) / float(steps)
    wanted = spark.range(steps).withColumnRenamed("id", "id").crossJoin(F.broadcast(table)).withColumn("_w", (F.col("_from") + (F.col("_to") - F.col("_from")) * middle) * batch)
    per_step = Window.partitionBy("id")
    floored = wanted.withColumn("_f", F.floor("_w")).withColumn("_left", F.lit(batch) - F.sum("_f").over(per_step))
    rank = F.row_number().over(per_step.orderBy(F.desc(F.round(F.col("_w") - F.col("_f"), 9)), "lane"))
    return floored.withColumn("_r", rank).select(F.col("id").alias("step"), "lane", (F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("n"))


def boundary_steps(plan: Plan) -> list[int]:
    """The steps beside a change of the mixture, which are always logged and evaluated."""
    edges = {plan.shift, plan.start, plan.end}
    return sorted({e + d for e in edges for d in (-1, 0, 1) if 0 <= e + d < plan.steps})


def metric_records(spark: SparkSession, plan: Plan, blocks: tuple[int, int], log_every: int, eval_every: int) -> DataFrame:
    """What a run's log says of each step besides model values: (step, tokens, phase, transition_mode, fineweb_share,
    indic_share, fineweb_step_tokens, indic_step_tokens, max_source_pass_seen, logged, evaluated).

    step counts finished steps, from 1. blocks: the training sequences of the two pools; the pass is the highest
    that either has been drawn in, from 0. Steps beside a change of the mixture are always logged and evaluated.
    """
    done = F.col("step") + 1
    counts = step_counts(spark, plan).join(phases(spark, plan), "step")
    after = draw_bases(spark, plan).groupBy("step").agg(*[F.max(F.when(F.col("source") == s, F.col("base"))).alias(f"_{s}") for s in SOURCES])
    passes = F.greatest(*[F.floor(F.greatest(F.col(f"_{s}") + F.col(s) - 1, F.lit(0)) / F.lit(n)) for s, n in zip(SOURCES, blocks)])
    beside = F.col("step").isin(boundary_steps(plan))
    every = lambda n: (done % n == 0) if n > 0 else F.lit(False)
    return counts.join(after, "step").select(
        done.alias("step"), (done * plan.batch * plan.block_size).alias("tokens"), "phase", F.lit(plan.mode).alias("transition_mode"),
        *[(F.col(s) / F.lit(plan.batch)).alias(f"{s}_share") for s in SOURCES], *[(F.col(s) * plan.block_size).alias(f"{s}_step_tokens") for s in SOURCES],
        passes.alias("max_source_pass_seen"), (every(log_every) | beside | (done == plan.steps)).alias("logged"), (every(eval_every) | beside).alias("evaluated"),
    )
