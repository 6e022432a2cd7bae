"""Metric series around a transition: windows, baselines, peaks, recovery, gates and the comparison of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAD_LIMIT, LOSS_LIMIT, RECOVERY_LIMIT, MATERIAL = 2.5, 1.15, 500, 0.10
CONFIG_KEYS = (
    "block_size", "data_seed", "expected_source_totals", "fineweb_manifest", "global_batch_sequences", "indic_manifest", "learning_rate",
    "min_learning_rate", "seed", "shift_tokens", "total_tokens", "warmup_fraction", "weight_decay",
)


def _nan() -> Column:
    return F.lit(float("nan"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """NaN where either side isn't finite or the bottom is 0."""
    return F.when(finite(top) & finite(bottom) & (bottom != 0), top / F.nullif(bottom, F.lit(0.0))).otherwise(_nan())


def training_rows(records: DataFrame, latest: bool = False) -> DataFrame:
    """The rows with a loss and a gradient norm. latest: of repeated steps, the last tokens count wins."""
    rows = records.where(F.col("loss").isNotNull() & F.col("grad").isNotNull())
    if latest:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("tokens")))).where("_r = 1").drop("_r")
    return rows


def window_rows(records: DataFrame, start: int, end: int, width: int) -> DataFrame:
    return records.where((F.col("step") > start - width) & (F.col("step") <= end + width))


def summarize(records: DataFrame, start: int, end: int, total: int, width: int, by: list[str] | None = None) -> DataFrame:
    """One row for each arm: baselines before the transition, peaks and recovery after it, and the gate.

    Two aggregations over one scan: the recovery test needs the baselines.
    """
    by = by or []
    near = records.where((F.col("step") > start - width) & (F.col("step") <= min(end + width, total)))
    before, after = F.col("step") <= start, F.col("step") > start
    base = near.groupBy(*by).agg(
        *[F.coalesce(F.median(F.when(before, F.col(c))), _nan()).alias(f"baseline_{c}") for c in ("grad", "loss")],
        *[F.coalesce(F.max(F.when(after, F.col(c))), _nan()).alias(f"peak_{c}") for c in ("grad", "loss")],
    )
    joined = near.join(F.broadcast(base), by) if by else near.crossJoin(F.broadcast(base))
    calm = after & (F.col("step") >= end) & (F.col("grad") <= GRAD_LIMIT * F.col("baseline_grad")) & (F.col("loss") <= LOSS_LIMIT * F.col("baseline_loss"))
    names = ["baseline_grad", "baseline_loss", "peak_grad", "peak_loss"]
    out = joined.groupBy(*by, *names).agg(F.min(F.when(calm, F.col("step"))).alias("recovered_at"))
    out = out.withColumn("grad_multiplier", safe_ratio(F.col("peak_grad"), F.col("baseline_grad"))).withColumn("loss_multiplier", safe_ratio(F.col("peak_loss"), F.col("baseline_loss")))
    out = out.withColumn("recovery_steps", F.when(F.col("recovered_at").isNotNull(), F.greatest(F.col("recovered_at") - F.lit(end), F.lit(0))).cast("long"))
    sound = finite(F.col("baseline_grad")) & finite(F.col("baseline_loss")) & finite(F.col("peak_grad")) & finite(F.col("peak_loss"))
    within = lambda c, limit: ~F.isnan(c) & (F.col(c) <= limit)
    gate = sound & within("grad_multiplier", GRAD_LIMIT) & within("loss_multiplier", LOSS_LIMIT) & F.coalesce(F.col("recovery_steps") <= RECOVERY_LIMIT, F.lit(False))
    return out.withColumn("passes", gate).drop("recovered_at")


def compare(hard: DataFrame, linear: DataFrame, matched: bool, material: float = MATERIAL) -> DataFrame:
    """One row: how far the linear arm lowers the spikes, and whether it is preferred."""
    keep = ["grad_multiplier", "loss_multiplier", "passes"]
    both = hard.select(*[F.col(c).alias(f"hard_{c}") for c in keep]).crossJoin(linear.select(*[F.col(c).alias(f"linear_{c}") for c in keep]))
    cut = {k: 1.0 - safe_ratio(F.col(f"linear_{k}_multiplier"), F.col(f"hard_{k}_multiplier")) for k in ("grad", "loss")}
    both = both.withColumns({f"{k}_reduction": c for k, c in cut.items()})
    enough = lambda c: ~F.isnan(c) & (F.col(c) >= material)
    better = (~F.col("hard_passes") & F.col("linear_passes")) | enough("grad_reduction") | enough("loss_reduction")
    return both.withColumn("linear_preferred", F.lit(matched) & better)


def config_mismatches(hard: DataFrame, linear: DataFrame, keys: tuple[str, ...] = CONFIG_KEYS) -> DataFrame:
    """(key): the keys at which two (key, value) configurations differ; missing on both sides is equal."""
    a, b = hard.where(F.col("key").isin(*keys)), linear.where(F.col("key").isin(*keys))
    joined = a.select("key", F.col("value").alias("_a")).join(b.select("key", F.col("value").alias("_b")), "key", "full_outer")
    return joined.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("key")


def whole_batches(sequences: DataFrame, number: str, batch: int, most: int | None = None) -> DataFrame:
    """The first sequences, numbered from 0, that make up whole batches: of all, or of the first `most`."""
    n = sequences.count()
    return sequences.where(F.col(number) < min(n, n if most is None else most) // batch * batch)


def weighted_loss(records: DataFrame, loss: str, weight: str, by: list[str]) -> DataFrame:
    """Mean loss weighted by tokens, and its perplexity with the loss capped at 20."""
    out = records.groupBy(*by).agg((F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias("loss"))
    return out.withColumn("perplexity", F.when(F.isnan("loss"), _nan()).otherwise(F.exp(F.least(F.col("loss"), F.lit(20.0)))))


def abort_gates(series: DataFrame, step: str, grad: str, width: int, by: list[str]) -> DataFrame:
    """(by, step, rolling_median, warns, stops): warns after 10 steps above twice the median of the steps before,
    stops above four times it."""
    order = Window.partitionBy(*by).orderBy(step)
    rows = series.withColumn("rolling_median", F.expr(f"percentile({grad}, 0.5) over (partition by {', '.join(by)} order by {step} rows between {width} preceding and 1 preceding)"))
    high = F.coalesce(F.col(grad) > 2 * F.col("rolling_median"), F.lit(False))
    rows = rows.withColumn("_high", high).withColumn("_block", F.sum(F.when(high, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.when(F.col("_high"), 1).otherwise(0)).over(Window.partitionBy(*by, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("warns", run >= 10).withColumn("stops", F.coalesce(F.col(grad) > 4 * F.col("rolling_median"), F.lit(False))).select(*by, step, "rolling_median", "warns", "stops")


def loss_gate(series: DataFrame, step: str, loss: str, baseline: str, by: list[str], limit: float = LOSS_LIMIT, run: int = 50) -> DataFrame:
    """(by, step, stops): the loss has been above limit times its baseline for `run` steps."""
    order = Window.partitionBy(*by).orderBy(step)
    high = F.coalesce(F.col(loss) > limit * F.col(baseline), F.lit(False))
    rows = series.withColumn("_high", high).withColumn("_block", F.sum(F.when(high, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.when(F.col("_high"), 1).otherwise(0)).over(Window.partitionBy(*by, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stops", length >= run).select(*by, step, "stops")


def arms(modes: list[str]) -> tuple[int, int]:
    """The places of the hard and the linear arm of two; an error where they are not one of each."""
    if sorted(modes) != ["hard", "linear"]:
        raise ValueError("a comparison takes one hard arm and one linear arm")
    return modes.index("hard"), modes.index("linear")


def comparison(hard: DataFrame, linear: DataFrame, mismatches: DataFrame, material: float = MATERIAL) -> dict:
    """The document of a comparison: two summaries of one row each, what their configurations differ in, the decision."""
    differ = sorted(r["key"] for r in mismatches.collect())  # a row for each key of a configuration
    found = compare(hard, linear, not differ, material).first()
    return {
        "hard": hard.first().asDict(), "linear": linear.first().asDict(), "matched_configuration": not differ, "configuration_mismatches": differ,
        "linear_gradient_peak_reduction": found["grad_reduction"], "linear_loss_peak_reduction": found["loss_reduction"], "material_reduction_threshold": material, "warm_transition_preferred": found["linear_preferred"],
    }
