"""Checks of a curriculum: budgets, phases, caps, floors, bands and acceptance, over small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranges import average_ranks
from millrace.session import settled

EFFORT_EDGES = {"E0": 128, "E1": 512, "E2": 2048, "E3": 32768}
LENGTH_EDGES = {"8K": 8192, "16K": 16384, "32K": 32768, "64K": 65536, "128K": 131072, "256K": 262144}


def lane_closure(lanes: DataFrame, total: float) -> DataFrame:
    """(lane, total, closes) for lanes (lane, unique, replay, anneal, total, share): the parts make up the lane, the share its total."""
    near = lambda a, b: F.abs(a - b) < 1e-6 * F.greatest(F.abs(b), F.lit(1.0))
    parts = F.col("unique") + F.col("replay") + F.col("anneal")
    return lanes.select("lane", "total", (near(parts, F.col("total")) & near(F.col("share") * total, F.col("total"))).alias("closes"))


def phase_closure(mixture: DataFrame, phases: DataFrame, main: DataFrame) -> DataFrame:
    """(lane, planned, allocated, gap): the shares (phase, lane, share) of the phases' sizes against each lane's main run."""
    planned = mixture.join(F.broadcast(phases), "phase").groupBy("lane").agg(F.sum(F.col("share") * F.col("size")).alias("planned"))
    return planned.join(F.broadcast(main), "lane").select("lane", "planned", "allocated", (F.col("planned") - F.col("allocated")).alias("gap"))


def band(value: Column, edges: dict[str, int], beyond: str = "over") -> Column:
    """The first band whose upper edge is not below the value."""
    out = None
    for name, edge in edges.items():
        out = F.when(value <= edge, name) if out is None else out.when(value <= edge, name)
    return out.otherwise(beyond)


def band_shares(rows: DataFrame, value: Column, weight: Column, edges: dict[str, int]) -> DataFrame:
    """(band, rows, weight, share)."""
    per = rows.select(band(value, edges).alias("band"), weight.alias("_w")).groupBy("band").agg(F.count("*").alias("rows"), F.sum("_w").cast("long").alias("weight"))
    # one row for each band
    return per.withColumn("share", F.col("weight") / F.sum("weight").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def over_cap(rows: DataFrame, family: str, tokens: str, cap: float) -> DataFrame:
    """(family, tokens, share) of the families with more than their share."""
    per = rows.groupBy(family).agg(F.sum(tokens).cast("long").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("_all"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("_all")).where(F.col("share") > cap).drop("_all")


def passes_over_cap(sources: DataFrame, cap: float = 2.0, exception: float = 4.0) -> DataFrame:
    """(source, passes) of the sources drawn more often than allowed; sources marked exempt have the higher cap."""
    passes = F.col("drawn") / F.col("unique")
    return sources.select("source", passes.alias("passes"), F.when(F.col("exempt"), exception).otherwise(cap).alias("_cap")).where("passes > _cap").drop("_cap")


def protected_floor(rows: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(class, share, floor, met) for rows (class, tokens)."""
    per = rows.agg(F.sum("tokens").alias("_all"), *[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("tokens"))), F.lit(0)).alias(c) for c in floors])
    entries = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(c) / F.col("_all")).alias("share"), F.lit(f).alias("floor")) for c, f in floors.items()])
    return per.select(F.explode(entries).alias("e")).select("e.*", (F.col("e.share") >= F.col("e.floor")).alias("met"))


def cut_at(rows: DataFrame, n: int, score: str, key: str, at_once: int = 200_000) -> tuple | None:
    """(score, key) of the n-th row by falling score, then key; None where there are fewer or n is 0.

    Each round counts the rows above the edges of a few hundred ranges and goes on in the one that holds the n-th
    row, so that no task sorts all rows; ranges of one score go on by key.
    """
    if n <= 0:
        return None
    some, column, falling = rows.select(score, key).where(F.col(score).isNotNull()), score, True
    while True:
        size = some.count()
        if size < n:
            return None
        if size <= at_once:
            row = some.orderBy(F.desc(score), key).limit(n).agg(F.min_by(F.struct(score, key), F.struct(F.col(score), -F.col(key))).alias("r")).first()["r"]
            return row[0], row[1]
        edges = sorted(set(some.agg(F.percentile_approx(column, [k / 256 for k in range(1, 256)], 2560).alias("e")).first()["e"]), reverse=falling)
        if len(edges) == 1 and falling and some.where(F.col(score) != edges[0]).limit(1).count() == 0:
            column, falling = key, False  # one score: the keys decide
            continue
        before = (lambda e: F.col(column) > e) if falling else (lambda e: F.col(column) < e)
        counts = some.agg(*[F.count_if(before(e)).alias(f"e{k}") for k, e in enumerate(edges)]).first()
        inside = max((k for k in range(len(edges)) if counts[k] < n), default=None)
        if inside is None:
            some = some.where(before(edges[0]))
            continue
        n -= counts[inside]
        here = some.where(F.col(column) == edges[inside])
        held = here.count()
        if held >= n:
            some = here
            continue
        n -= held
        some = some.where(~before(edges[inside]) & (F.col(column) != edges[inside]))
        if inside + 1 < len(edges):
            some = some.where(before(edges[inside + 1]))


def select_best(rows: DataFrame, key: str, score: str, group: str, keep: float, least: int, never: DataFrame | None = None) -> DataFrame:
    """rows kept by a selector: at least `least` of each group, then by score, `keep` of all; the keys of never are no
    candidates. Ties go by key, a whole number; rows without a score are only kept as those of their group. rows are
    written to the shared folder once and read by several jobs, so they should be narrow.
    """
    rows = settled(rows if never is None else rows.join(never.select(key).distinct(), key, "left_anti"))
    # Spark keeps the first few of each group before the shuffle
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    sure = rows.withColumn("_rank", rank).where(F.col("_rank") <= least).drop("_rank")
    rest = rows.join(sure.select(key), key, "left_anti")
    total, held = rows.count(), sure.count()
    last = cut_at(rest, int(total * keep) - held, score, key)
    if last is None:
        return sure if int(total * keep) <= held else sure.unionByName(rest.select(*sure.columns))
    return sure.unionByName(rest.where((F.col(score) > last[0]) | ((F.col(score) == last[0]) & (F.col(key) <= last[1]))).select(*sure.columns))


def lane_drift(before: DataFrame, after: DataFrame, limit: float = 0.01) -> DataFrame:
    """(lane, drift, within) for shares (lane, share) before and after a selector, or at two phase boundaries."""
    both = before.select("lane", F.col("share").alias("_a")).join(after.select("lane", F.col("share").alias("_b")), "lane", "full_outer")
    drift = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return both.select("lane", drift.alias("drift"), (F.abs(drift) <= limit + 1e-12).alias("within"))


def tier_accounting(rows: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(tier, tokens, share, target) for rows (tier, tokens)."""
    per = rows.groupBy("tier").agg(F.sum("tokens").cast("long").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("_all"))
    target = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return per.crossJoin(F.broadcast(total)).select("tier", "tokens", (F.col("tokens") / F.col("_all")).alias("share"), target[F.col("tier")].alias("target"))


def teacher_gate(rows: DataFrame, cap: float = 0.25) -> DataFrame:
    """(teacher, share, within) of the synthetic rows (teacher, tokens): no single teacher makes more than the cap."""
    per = rows.groupBy("teacher").agg(F.sum("tokens").alias("_t"))
    total = per.agg(F.sum("_t").alias("_all"))
    share = F.col("_t") / F.col("_all")
    return per.crossJoin(F.broadcast(total)).select("teacher", share.alias("share"), (share <= cap).alias("within"))


def audit_gate(rows: DataFrame, least: float = 0.05) -> DataFrame:
    """(language, audited, met) for rows (language, tokens, audited): the audited share of each language's tokens."""
    share = F.sum(F.when(F.col("audited"), F.col("tokens")).otherwise(0)) / F.sum("tokens")
    return rows.groupBy("language").agg(share.alias("audited")).withColumn("met", F.col("audited") >= least)


def anneal_reserve(rows: DataFrame, targets: dict[str, float], excluded: list[str], verified_least: float = 0.70) -> DataFrame:
    """(component, tokens, share, target, verified_share, verified_enough) of rows (component, tokens, verified, status).

    Rows of an excluded status are no part of the reserve. verified_share is that of the whole reserve.
    """
    some = rows.where(~F.coalesce(F.col("status").isin(excluded), F.lit(False)))
    per = some.groupBy("component").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum(F.when(F.col("verified"), F.col("tokens")).otherwise(0)).alias("_v"))
    total = per.agg(F.sum("tokens").alias("_all"), F.sum("_v").alias("_ok"))
    target = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    share = F.col("_ok") / F.col("_all")
    return per.crossJoin(F.broadcast(total)).select("component", "tokens", (F.col("tokens") / F.col("_all")).alias("share"), target[F.col("component")].alias("target"), share.alias("verified_share"), (share >= verified_least).alias("verified_enough"))


def label_shares(rows: DataFrame, label: str, weight: str, targets: dict[str, float]) -> DataFrame:
    """(label, weight, share, target, gap) of labelled rows: difficulty bands, effort bands, sub-lanes."""
    per = rows.groupBy(F.col(label).alias("label")).agg(F.sum(weight).cast("long").alias("weight"))
    total = per.agg(F.sum("weight").alias("_all"))
    target = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col("label")]
    share = F.col("weight") / F.col("_all")
    return per.crossJoin(F.broadcast(total)).select("label", "weight", share.alias("share"), target.alias("target"), (share - target).alias("gap"))


def long_share(rows: DataFrame, length: Column, edge: int = 8192, limit: float = 0.02) -> DataFrame:
    """(traces, over, share, within): the share of traces above an edge."""
    out = rows.agg(F.count("*").alias("traces"), F.count_if(length > edge).alias("over")).withColumn("share", F.col("over") / F.col("traces"))
    return out.withColumn("within", F.col("share") <= limit)


def pool_ratio(lanes: DataFrame, least: float = 1.5) -> DataFrame:
    """(lane, ratio, admitted) for (lane, candidates, required, declared): a pool is large enough or its factor declared."""
    ratio = F.col("candidates") / F.nullif("required", F.lit(0))
    return lanes.select("lane", ratio.alias("ratio"), (F.coalesce(ratio >= least, F.lit(False)) | F.col("declared")).alias("admitted"))


def regressions(pillars: DataFrame, points: float = 1.5, relative: float = 0.03) -> DataFrame:
    """(pillar, drop, limit, within) for (pillar, before, after): the stricter of a drop in points and a relative one."""
    drop, limit = F.col("before") - F.col("after"), F.least(F.lit(points), F.col("before") * relative)
    return pillars.select("pillar", drop.alias("drop"), limit.alias("limit"), (drop <= limit).alias("within"))


#: Licences of sources that may be trained on, and how texts name them; one that is not recognised is unresolved.
LICENCES = {
    "mit": r"(?i)\bMIT License\b|\bLicen[sc]ed under (?:the )?MIT\b", "apache-2.0": r"(?i)\bApache(?: License)?,? (?:Version )?2\.0\b", "bsd": r"(?i)\bBSD(?:-[23]-Clause| License)",
    "gpl": r"(?i)\bGNU (?:Affero |Lesser )?General Public License\b|\bA?GPL(?:v[23]|-[23])", "cc-by-nc": r"(?i)\bCC[ -]BY[ -](?:NC|ND)|Attribution-Non", "cc-by": r"(?i)\bCC[ -]BY\b|Creative Commons Attribution",
    "reserved": r"(?i)\ball rights reserved\b",
}


def licence_of(text: Column) -> Column:
    """The first licence that a text names; null where it names none."""
    out = None
    for name, pattern in LICENCES.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def loss_mask(turns: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """(role, turns, words, trained_words): user and tool turns are read, not learned."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")).cast("long")
    trained = F.when(F.col(role).isin("user", "tool"), F.lit(0).cast("long")).otherwise(n)
    return turns.groupBy(role).agg(F.count("*").alias("turns"), F.sum(n).alias("words"), F.sum(trained).alias("trained_words"))


def incomplete(rows: DataFrame, required: list[str]) -> DataFrame:
    """(field, missing): the admission fields that rows lack."""
    per = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in required])
    return per.select(F.explode(entries).alias("e")).select("e.*").where("missing > 0")


def geometric_mean(scores: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.exp(F.sum(F.col(weight) * F.ln(value)) / F.sum(weight)).alias("geometric_mean"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(rho): the correlation of average ranks of the rows that have both values."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_a"), F.col(y).alias("_b"))
    return average_ranks(average_ranks(both, "_a", "_x"), "_b", "_y").agg(F.corr("_x", "_y").alias("rho"))


def accept_budget(pillars: DataFrame, gain: float = 0.01, least: int = 4) -> DataFrame:
    """(mean_gain, better, accepted) for (pillar, before, after)."""
    rel = F.col("after") / F.col("before") - 1
    out = pillars.agg(F.avg(rel).alias("mean_gain"), F.count_if(rel > 0).alias("better"))
    return out.withColumn("accepted", (F.col("mean_gain") >= gain) & (F.col("better") >= least))


def shortfall(inventory: DataFrame) -> DataFrame:
    """(lane, missing) for (lane, target, available)."""
    return inventory.select("lane", F.greatest(F.col("target") - F.col("available"), F.lit(0.0)).alias("missing"))
