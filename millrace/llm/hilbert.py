"""Sharding along a Hilbert curve over metadata columns.

Each column becomes an integer of BITS bits that keeps its order: its values' places in the counted
distribution, so that cells hold like numbers of rows. The curve index of the cell is found by an
automaton: at each level the cell's next bits and the state give the next digit of the index and the next
state. Cells in curve order are cut into runs of a target size; a cell above the target is cut by id.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.store import broadcast_if_small, own, prefix_sums, replacing, stash

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
TARGET_CHARS = 64_000_000
#: Tasks that write shards; more shards than these are dealt to them in runs.
PARTITIONS = 10_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a point on the Hilbert curve: Skilling's transform, for tests and to derive the automaton."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ t) >> level & 1)
    return index


@cache
def automaton(n: int) -> tuple[list[int], list[int]]:
    """(digits, next states), both at state * 2**n + corner; state 0 is the start.

    A state is the way in which the curve runs through a cube: after Gray-coding, a signed permutation of
    the axes. States are told apart by the digits of the corners of a cube and of its sub-cubes.
    """
    corners = [tuple(c >> (n - 1 - i) & 1 for i in range(n)) for c in range(1 << n)]

    # the state of a cube that a path of corners leads to, seen by the order of its corners below
    def order(path: tuple[tuple[int, ...], ...]) -> tuple[int, ...]:
        bits = len(path) + 1
        base = [sum(p[i] << (bits - 1 - k) for k, p in enumerate(path)) for i in range(n)]
        return tuple(hilbert_index(tuple(b | c for b, c in zip(base, corner)), bits) % (1 << n) for corner in corners)

    known, paths, digits, following = {order(()): 0}, [()], [], []
    at = 0
    while at < len(paths):
        path = paths[at]
        digits += order(path)
        for corner in corners:
            sub = (*path, corner)
            key = order(sub)
            if key not in known:
                known[key] = len(paths)
                paths.append(sub)
            following.append(known[key])
        at += 1
    return digits, following


def curve_column(cells: list[Column], bits: int) -> Column:
    """The curve index of integer columns of so many bits each, as an expression of built-in functions."""
    n = len(cells)
    digits, following = automaton(n)
    digit_of, next_of = F.array(*map(F.lit, digits)), F.array(*map(F.lit, following))

    def step(state: Column, level: Column) -> Column:
        corner = F.lit(0)
        for c in cells:
            corner = corner * 2 + (F.floor(c / F.pow(F.lit(2.0), level)).cast("int") % 2)
        place = state["s"] * (1 << n) + corner
        return F.struct(
            F.get(next_of, place).alias("s"),
            (state["d"] * (1 << n) + F.get(digit_of, place)).alias("d"),
        )

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*[F.lit(float(k)) for k in range(bits - 1, -1, -1)]), start, step, lambda state: state["d"])


def _bins(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, bin): the share of rows with a smaller value, in steps of 2**-bits; null counts as smallest.

    The sums run over one row for each distinct value, not over the rows of docs.
    """
    counts = docs.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    total = docs.count()
    return prefix_sums(counts, "_n", "_before", [F.col("_v").asc_nulls_first()]).select("_v", F.floor(F.col("_before") * (1 << bits) / F.lit(total)).cast("int").alias("_bin"))


def hilbert_shards(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, target_chars: int = TARGET_CHARS, partitions: int = PARTITIONS) -> DataFrame:
    """docs with hilbert (the curve index of its cell) and shard; each shard lies whole in one partition, in
    curve order, and up to `partitions` shards have one each; more are dealt to that many, in runs.

    Shards are numbered along the curve. A run of cells is cut where target_chars is reached; a cell with
    more is cut into that many shards by doc_id modulo their number (a null doc_id counts as 0). Null
    values of a dimension come before all others; null and empty texts have a size of 0. Repeated rows
    share a cell. Columns of the names hilbert and shard are replaced; all others are kept, whatever their names.
    """
    docs = replacing(docs, ["hilbert", "shard"])
    # only the dimensions, the id and the size of the text: the text itself moves once, at the end
    cells = docs
    grid = [own(f"b{k}") for k in range(len(dimensions))]
    for k, name in enumerate(dimensions):
        value = own(f"v{k}")
        table = stash(_bins(docs, name, bits).select(F.col("_v").alias(value), F.col("_bin").alias(grid[k])), f"bins-{k}")
        cells = cells.join(broadcast_if_small(table), cells[name].eqNullSafe(F.col(value))).drop(value)
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    # at most 2 ** (bits * dimensions) cells; the curve is followed once for each, not for each row
    per_cell = cells.groupBy(*grid).agg(F.sum(size).alias("_size")).withColumn("_curve", curve_column([F.col(g) for g in grid], bits))
    before = Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(target_chars)))
    # a large cell has shards of its own; the cells between two of them are cut by their running size
    planned = (
        per_cell.withColumn("_parts", parts.cast("long"))
        .withColumn("_large", (F.col("_parts") > 1).cast("int"))
        .withColumn("_stretch", F.sum("_large").over(before.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("_large"))
        .withColumn("_ahead", F.coalesce(F.sum("_size").over(Window.partitionBy("_stretch").orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_run", F.when(F.col("_large") == 1, F.lit(0)).otherwise(F.floor(F.col("_ahead") / F.lit(target_chars))).cast("long"))
    )
    runs = planned.groupBy("_stretch", "_run").agg(F.max("_parts").alias("_parts"))
    numbered = runs.select("_stretch", "_run", F.coalesce(F.sum("_parts").over(Window.orderBy("_stretch", "_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    parts, first = own("parts"), own("from")
    table = stash(planned.join(numbered, ["_stretch", "_run"]).select(*[F.col(g).alias(own(f"c{k}")) for k, g in enumerate(grid)], F.col("_curve").alias("hilbert"), F.col("_parts").alias(parts), F.col("_from").alias(first)), "cells")
    same = F.lit(True)
    for k, g in enumerate(grid):
        same = same & (cells[g] == F.col(own(f"c{k}")))
    placed = (
        cells.join(broadcast_if_small(table), same)
        .withColumn("shard", F.col(first) + F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.col(parts)))
        .select(*docs.columns, "hilbert", "shard")
    )
    shards = int(table.agg(F.max(F.col(first) + F.col(parts))).first()[0] or 1)
    tasks = min(shards, partitions)
    return placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "hilbert", "doc_id")


def write_shards(sharded: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Write what hilbert_shards returned, a folder a shard, under path/shards, and the least and largest value of
    each dimension in each shard under path/ranges."""
    sharded.write.partitionBy("shard").parquet(f"{path}/shards")
    spark = sharded.sparkSession
    edges = [e for d in dimensions for e in (F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}"), F.count_if(F.col(d).isNull()).alias(f"nulls_{d}"))]
    spark.read.parquet(f"{path}/shards").groupBy("shard").agg(*edges, F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/ranges")


def read_box(spark: SparkSession, path: str, **box: tuple) -> DataFrame:
    """The rows whose dimensions lie in the given closed intervals; only shards that may hold such rows are read.

    The folders are chosen by the table of ranges, in the plan: its rows are joined to the partition column, whose
    values prune the scan.
    """
    inside, possible = F.lit(True), F.lit(True)
    for name, (low, high) in box.items():
        inside = inside & F.col(name).between(low, high)
        possible = possible & (F.col(f"min_{name}") <= F.lit(high)) & (F.col(f"max_{name}") >= F.lit(low))
    chosen = spark.read.parquet(f"{path}/ranges").where(possible).select("shard")
    return spark.read.parquet(f"{path}/shards").join(broadcast_if_small(chosen), "shard", "left_semi").where(inside)


def oracle(dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, target_chars: int = TARGET_CHARS) -> str:
    """DuckDB SQL for hilbert_shards over documents."""
    n = len(dimensions)
    digits, following = automaton(n)
    bins = ", ".join(
        f"d{k} AS (SELECT {c} AS v, CAST(floor(coalesce(sum(n) OVER (ORDER BY {c} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} / sum(n) OVER ()) AS INTEGER) AS b "
        f"FROM (SELECT {c}, count(*) AS n FROM documents GROUP BY ALL))"
        for k, c in enumerate(dimensions)
    )
    joins = " ".join(f"JOIN d{k} ON t.{c} IS NOT DISTINCT FROM d{k}.v" for k, c in enumerate(dimensions))
    corner = "0"
    for k in range(n):
        corner = f"({corner}) * 2 + (b{k} >> (level - 1)) % 2"
    cells = ", ".join(f"d{k}.b AS b{k}" for k in range(n))
    grid = ", ".join(f"b{k}" for k in range(n))
    return (
        f"WITH RECURSIVE {bins}, t AS (SELECT * FROM documents), placed AS (SELECT t.*, {cells} FROM t {joins}), "
        f"cell AS (SELECT {grid}, sum(coalesce(length(text), 0)) AS size FROM placed GROUP BY {grid}), "
        f"walk AS (SELECT {grid}, size, 0 AS state, CAST(0 AS BIGINT) AS h, {bits} AS level FROM cell UNION ALL "
        f"SELECT {grid}, size, ({following})[state * {1 << n} + {corner} + 1], h * {1 << n} + ({digits})[state * {1 << n} + {corner} + 1], level - 1 FROM walk WHERE level > 0), "
        f"c0 AS (SELECT {grid}, h AS hilbert, size, greatest(1, CAST(ceil(size / {target_chars}) AS BIGINT)) AS parts FROM walk WHERE level = 0), "
        "c1 AS (SELECT *, CASE WHEN parts > 1 THEN 1 ELSE 0 END AS large FROM c0), "
        "c2 AS (SELECT *, sum(large) OVER (ORDER BY hilbert ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 2 - large AS stretch FROM c1), "
        "c3 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stretch ORDER BY hilbert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM c2), "
        f"c4 AS (SELECT *, CASE WHEN large = 1 THEN 0 ELSE CAST(floor(ahead / {target_chars}) AS BIGINT) END AS run FROM c3), "
        "r AS (SELECT stretch, run, coalesce(sum(p) OVER (ORDER BY stretch, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT stretch, run, max(parts) AS p FROM c4 GROUP BY stretch, run)) "
        "SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars, c4.hilbert, CAST(r.first + coalesce(p.doc_id, 0) % c4.parts AS BIGINT) AS shard "
        f"FROM placed p JOIN c4 USING ({grid}) JOIN r USING (stretch, run)"
    )
