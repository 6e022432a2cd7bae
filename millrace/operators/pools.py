"""Pools of token blocks: the tokenizer's checks and fingerprint, tokenising, packing, shards and the manifest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import packing as P
from millrace.sources import io


@dataclass(frozen=True)
class Tokenizer:
    """encode makes an array of token ids of a text column; the rest describes the vocabulary."""

    name: str
    encode: Callable[[Column], Column]
    vocabulary: dict[str, int]
    special_tokens: dict[str, str] = field(default_factory=dict)
    added: dict[str, int] = field(default_factory=dict)
    end_id: int | None = None
    padding_id: int | None = None


def checked(tokenizer: Tokenizer, expected_size: int, allow_mismatch: bool = False) -> Tokenizer:
    """The tokenizer, with its padding token set, if it has an end-of-document token and the expected vocabulary."""
    if tokenizer.end_id is None:
        raise ValueError("documents need an end token")
    size = len(tokenizer.vocabulary | tokenizer.added)
    if size != expected_size and not allow_mismatch:
        raise ValueError(f"the vocabulary has {size} entries, not {expected_size}")
    return tokenizer if tokenizer.padding_id is not None else replace(tokenizer, padding_id=tokenizer.end_id)


def fingerprint(tokenizer: Tokenizer) -> str:
    """SHA-256 over the canonical description: the class, the vocabulary by id, special and added tokens."""
    by_id = lambda entries: sorted(([k, v] for k, v in entries.items()), key=lambda x: x[1])
    description = {"class": tokenizer.name, "vocab": by_id(tokenizer.vocabulary), "special_tokens": tokenizer.special_tokens, "added_vocab": by_id(tokenizer.added)}
    return hashlib.sha256(json.dumps(description, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def vocabulary_fingerprint(vocabulary: DataFrame, name: str, special_tokens: dict[str, str], added: dict[str, int]) -> DataFrame:
    """(sha256): the same for a vocabulary (id, piece), which is a table of bounded size."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda x: F.concat(F.lit("["), _quoted(x["piece"]), F.lit(","), x["id"].cast("string"), F.lit("]")))
    rest = json.dumps({"special_tokens": special_tokens, "added_vocab": sorted(([k, v] for k, v in added.items()), key=lambda x: x[1])}, ensure_ascii=False, separators=(",", ":"))
    text = F.concat(F.lit('{"class":' + json.dumps(name, ensure_ascii=False) + ',"vocab":['), F.array_join(entries, ","), F.lit("]," + rest[1:]))
    return vocabulary.agg(F.sha2(text, 256).alias("sha256"))


def _quoted(c: Column) -> Column:
    """A string as JSON: that of an array of one string without its brackets."""
    return F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")


def tokenized(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """docs that are not blank, with tokens, the end-of-document id behind them, and n, their number."""
    some = docs.where(F.col(text).rlike("(?U)\\S"))
    return some.withColumn("tokens", F.concat(tokenizer.encode(F.col(text)), F.array(F.lit(tokenizer.end_id)))).withColumn("n", F.size("tokens").cast("long"))


def shard_records(packed: DataFrame) -> DataFrame:
    """(shard_id, sequences, tokens, sha256): the digest is over the shard's token ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, digest, sequences, tokens = None, None, 0, 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([shard], pa.int64()), pa.array([sequences], pa.int64()), pa.array([tokens], pa.int64()), pa.array([digest.hexdigest()])], ["shard_id", "sequences", "tokens", "sha256"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is None or key != shard:
                    if digest is not None:
                        yield out()
                    shard, digest, sequences, tokens = key, hashlib.sha256(), 0, 0
                raw = np.asarray(ids.values).astype("<u4")
                digest.update(raw.tobytes())
                sequences, tokens = sequences + 1, tokens + len(raw)
        if digest is not None:
            yield out()

    rows = packed.repartition("shard_id").sortWithinPartitions("shard_id", "block_id").select("shard_id", "token_ids")
    return rows.mapInArrow(run, "shard_id long, sequences long, tokens long, sha256 string")


def pool_counts(offsets: DataFrame, pool: P.Pool, label: str) -> DataFrame:
    """(metric, key, n) of the documents and tokens that a pool takes, in all and by label, and of its sequences.

    An error where the documents end before the target.
    """
    some = P.accept(offsets, "n", pool.target_tokens).where("accepted > 0")
    per = some.groupBy(F.col(label).alias("key")).agg(F.count("*").alias("documents"), F.sum("accepted").alias("tokens"))
    filled = F.when(F.sum("tokens") == pool.target_tokens, F.sum("tokens")).otherwise(F.raise_error(F.concat(F.lit("the source ran out at "), F.coalesce(F.sum("tokens"), F.lit(0)).cast("string"), F.lit(f" of {pool.target_tokens} tokens"))))
    one = lambda metric, n: F.struct(F.lit(metric).alias("metric"), F.lit("").alias("key"), n.cast("long").alias("n"))
    total = per.agg(F.sum("documents").alias("d"), filled.alias("t")).select(
        F.explode(
            F.array(
                one("documents_consumed", F.col("d")), one("actual_tokens", F.col("t")), one("train_tokens", F.lit(pool.target_tokens - pool.eval_tokens)), one("eval_tokens", F.lit(pool.eval_tokens)),
                one("train_sequences", F.lit(pool.train_blocks)), one("total_sequences", F.lit(pool.target_tokens // pool.block_size)), one("eval_sequences", F.lit(pool.eval_tokens // pool.block_size)),
            )
        ).alias("e")
    ).select("e.*")
    by_label = per.select("key", F.explode(F.array(F.struct(F.lit("per_split_documents").alias("metric"), F.col("documents").alias("n")), F.struct(F.lit("per_split_tokens").alias("metric"), F.col("tokens").alias("n")))).alias("e"))
    return total.unionByName(by_label.select("e.metric", "key", "e.n"))


def prepare_pool(docs: DataFrame, order: str, label: str, tokenizer: Tokenizer, pool: P.Pool, path: str, expected_size: int, allow_mismatch: bool = False, overwrite: bool = False, **about) -> dict:
    """Tokenise documents in an order, pack them into blocks up to the target and write path/blocks, a folder a shard,
    and path/manifest, which is also returned. about: what the manifest says of the source, such as source_name.

    A path that is not empty is an error unless it may be overwritten, and so is a source that ends too early.
    """
    tokenizer = checked(tokenizer, expected_size, allow_mismatch)
    offsets = P.token_offsets(tokenized(docs.select(order, label, "text"), tokenizer), order, "n")
    counts = pool_counts(offsets, pool, label).collect()  # a row for each label and total; fails before anything is written
    packed = P.blocks(P.slices(offsets, "tokens", "n", pool), pool)
    packed.repartition("shard_id").sortWithinPartitions("shard_id", "block_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("shard_id").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    shards = shard_records(spark.read.parquet(f"{path}/blocks")).orderBy("shard_id").collect()  # a row for each shard
    if sum(s["tokens"] for s in shards) != pool.target_tokens:
        raise ValueError("the shards do not make up the target")
    manifest: dict = {
        "format_version": 2, "dtype": "uint32", "block_size": pool.block_size, "target_tokens": pool.target_tokens, "eos_token_id": tokenizer.end_id,
        "tokenizer_class": tokenizer.name, "tokenizer_vocab_size": len(tokenizer.vocabulary | tokenizer.added), "tokenizer_fingerprint": fingerprint(tokenizer),
        "per_split_documents": {}, "per_split_tokens": {}, "shards": [{"file": f"shard_id={s['shard_id']}", "sequences": s["sequences"], "tokens": s["tokens"], "sha256": s["sha256"]} for s in shards],
        **{k: about.get(k) for k in ("source_name", "dataset_id", "dataset_config", "dataset_revision_requested", "dataset_revision_resolved", "tokenizer_name_or_path", "tokenizer_revision", "seed", "document_sampling")},
    }
    for row in counts:
        if row["key"]:
            manifest[row["metric"]][row["key"]] = row["n"]
        else:
            manifest[row["metric"]] = row["n"]
    io.write_document(spark, manifest, f"{path}/manifest", overwrite)
    return manifest


def index_of_pools(manifests: dict[str, dict]) -> dict:
    """The document that names the pools of a run: where each lies, its fingerprint and its sequences."""
    return {name: {k: m.get(k) for k in ("source_name", "tokenizer_fingerprint", "train_sequences", "eval_sequences", "block_size")} for name, m in sorted(manifests.items())}
