"""Token streams packed into fixed blocks and shards, with exact totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.curate import ordered_digests
from millrace.operators.ranges import ROWS, ranks_within, sums_before


@dataclass(frozen=True)
class Pool:
    block_size: int
    target_tokens: int
    eval_tokens: int
    shard_sequences: int

    def __post_init__(self) -> None:
        if self.block_size <= 0 or self.shard_sequences <= 0 or self.target_tokens <= 0:
            raise ValueError("sizes must be positive")
        if self.target_tokens % self.block_size or self.eval_tokens % self.block_size or self.eval_tokens < 0:
            raise ValueError("targets must be whole blocks")
        if self.eval_tokens >= self.target_tokens:
            raise ValueError("nothing is left to train on")

    @property
    def train_blocks(self) -> int:
        return (self.target_tokens - self.eval_tokens) // self.block_size


def token_offsets(docs: DataFrame, order: str, n_tokens: str, rows: int = ROWS) -> DataFrame:
    """docs with start: the tokens of all documents before it in the given order, which is unique."""
    return sums_before(docs, order, n_tokens, "start", rows).withColumn("start", F.col("start").cast("long"))


def accept(offsets: DataFrame, n_tokens: str, target: int) -> DataFrame:
    """offsets with accepted: how many tokens of a document still fit under the target, the last perhaps in part."""
    return offsets.withColumn("accepted", F.greatest(F.least(F.lit(target) - F.col("start"), F.col(n_tokens)), F.lit(0)).cast("long"))


def slices(offsets: DataFrame, tokens: str, n_tokens: str, pool: Pool) -> DataFrame:
    """(block_id, position, part): the accepted tokens of each document, cut at the edges of blocks: a row for each
    document and block, not for each token."""
    some = accept(offsets, n_tokens, pool.target_tokens).where("accepted > 0")
    size, start, end = F.lit(pool.block_size), F.col("start"), F.col("start") + F.col("accepted")
    first, last = F.floor(start / size), F.floor((end - 1) / size)

    def cut(block: Column) -> Column:
        lo, hi = F.greatest(block * size, start), F.least((block + 1) * size, end)
        return F.struct(block.alias("block_id"), lo.alias("position"), F.slice(tokens, (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    return some.select(F.explode(F.transform(F.sequence(first, last), cut)).alias("s")).select("s.*")


def blocks(parts: DataFrame, pool: Pool) -> DataFrame:
    """(block_id, shard_id, split, token_ids): each block is put together from its slices, in order."""
    held = parts.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("_p"))
    return held.select(
        "block_id",
        F.floor(F.col("block_id") / F.lit(pool.shard_sequences)).alias("shard_id"),
        F.when(F.col("block_id") < pool.train_blocks, "train").otherwise("eval").alias("split"),
        F.flatten(F.transform("_p", lambda x: x["part"])).alias("token_ids"),
    )


def shard_totals(packed: DataFrame) -> DataFrame:
    """(shard_id, sequences, tokens, sha256): the digest is over the tokens of the shard's blocks in order, as text.

    A shard's blocks pass through the hash as a stream; no row holds more than a block.
    """
    rows = packed.select("shard_id", "block_id", F.concat_ws(",", F.transform("token_ids", lambda x: x.cast("string"))).alias("_t"))
    totals = packed.groupBy("shard_id").agg(F.count("*").alias("sequences"), F.sum(F.size("token_ids")).cast("long").alias("tokens"))
    return totals.join(ordered_digests(rows, "shard_id", ["block_id"], "_t", ","), "shard_id")


def shards_of(cumulative: DataFrame, sequences: DataFrame) -> DataFrame:
    """sequences (seq) with the shard that holds each and its place there, for shards (shard_id, sequences) of any sizes."""
    ends = F.sum("sequences").over(Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, 0))
    # a row for each shard
    table = cumulative.select("shard_id", (ends - F.col("sequences")).alias("_from"), ends.alias("_to"))
    joined = sequences.join(F.broadcast(table), (F.col("seq") >= F.col("_from")) & (F.col("seq") < F.col("_to")))
    return joined.withColumn("place", F.col("seq") - F.col("_from")).drop("_from", "_to")


def check_filled(packed: DataFrame, pool: Pool) -> int:
    """The number of tokens packed; an error where the source ran out before the target."""
    n = packed.agg(F.coalesce(F.sum(F.size("token_ids")), F.lit(0))).first()[0]
    if n < pool.target_tokens:
        raise ValueError(f"the source ran out: {n} of {pool.target_tokens} tokens")
    return n


def interleave(docs: DataFrame, split: str, key: str, seed: int = 0) -> DataFrame:
    """docs with place, from 1: splits take turns in an order drawn for each round, and drop out as they end.

    Each split is shuffled by a hash of the seed and the key; equal keys hash alike and go by the key. A place is
    counted from the sizes of the splits, of which there are few: rows of earlier rounds, then earlier turns of its own.
    """
    hashed = docs.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), split, F.col(key).cast("string"))))
    ranked = ranks_within(hashed, split, "_hash", key, "_round").drop("_hash")
    sizes = {r[0]: r[1] for r in docs.groupBy(split).count().collect()}  # a row for each split
    turn = lambda name: F.md5(F.concat_ws("|", F.lit(seed), name, F.col("_round").cast("string")))
    earlier, ahead = F.lit(0).cast("long"), F.lit(0).cast("long")
    mine = F.struct(turn(F.col(split)).alias("h"), F.col(split).alias("s"))
    for name, n in sizes.items():
        earlier = earlier + F.least(F.lit(n), F.col("_round") - 1)
        theirs = F.struct(turn(F.lit(name)).alias("h"), F.lit(name).alias("s"))
        ahead = ahead + F.when((F.col("_round") <= n) & (theirs < mine), 1).otherwise(0)
    return ranked.withColumn("place", (earlier + ahead + 1).cast("long")).drop("_round")


def shuffled(docs: DataFrame, key: str, seed: int, label: str | None = None) -> DataFrame:
    """docs in a full, repeatable shuffle by key; with a column label where one is given, as a stream of one language has."""
    if label is not None:
        docs = docs.withColumn("label", F.lit(label))
    return docs.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)


def fetch(draws: DataFrame, packed: DataFrame) -> DataFrame:
    """draws with the tokens of their blocks: an equi-join on the block."""
    return draws.join(packed.select("block_id", "token_ids"), "block_id")


def compatible(a: dict, b: dict, block_size: int, keys: tuple[str, ...] = ("tokenizer_fingerprint", "tokenizer_vocab_size", "eos_token_id", "block_size")) -> None:
    """An error where two pools can't be drawn from together."""
    different = [k for k in keys if a.get(k) != b.get(k)]
    if different or a.get("block_size") != block_size:
        raise ValueError(f"pools differ in {', '.join(different) or 'block_size'}")


def with_defaults(manifest: dict) -> dict:
    """A pool manifest with what older ones lack filled in."""
    out = dict(manifest)
    for split in ("train", "eval"):
        if out.get(f"{split}_tokens") is None and out.get(f"{split}_sequences") is not None:
            out[f"{split}_tokens"] = out[f"{split}_sequences"] * out["block_size"]
    return out
