"""Streaming counterparts of the cleaner's state: seen digests, and the first target of each source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import text as T
from millrace.operators.curate import LANGUAGES, Limits, evaluate_pairs, evaluate_text


def _once(kept: DataFrame, event_time: str | None, delay: str) -> DataFrame:
    if event_time is None:
        return kept.dropDuplicates(["digest"])
    return kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def clean_stream(rows: DataFrame, limits: Limits, text: str = "text", languages: tuple[str, ...] = LANGUAGES, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Accepted rows of a stream, each digest once.

    Without an event time the digests seen are kept for ever, as in batch. With one, a digest is remembered
    for the delay only, and a later copy passes: bounded state, weaker.
    """
    return _once(evaluate_text(rows, limits, text, languages).where(F.size("reasons") == 0), event_time, delay)


def clean_pair_stream(rows: DataFrame, limits: Limits, score: str | None = None, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """As `clean_stream`, for pairs."""
    return _once(evaluate_pairs(rows, limits, score=score).where(F.size("reasons") == 0), event_time, delay)


def _remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first = state.get[0] if state.exists else None
    held = pd.concat(list(frames)).sort_values("ordinal")
    if first is None:
        first = held["target"].iloc[0]
        state.update((first,))
    yield pd.DataFrame({"ordinal": held["ordinal"], "many": held["target"] != first})


def many_targets_stream(rows: DataFrame, ordinal: str, limits: Limits) -> DataFrame:
    """(ordinal, many) of each pair of a stream: whether its target differs from the first target of its source.

    The first target of a source is state that is kept for ever, as in batch; rows of one micro-batch go by ordinal.
    """
    decided = evaluate_pairs(rows, limits)
    keyed = decided.select("resolved", F.sha2(T.key_of(F.col("masked_src"), limits.exact_keys), 256).alias("source"), F.sha2(T.key_of(F.col("masked_tgt"), limits.exact_keys), 256).alias("target"), F.col(ordinal).cast("long").alias("ordinal"))
    return keyed.groupBy("resolved", "source").applyInPandasWithState(_remember, "ordinal long, many boolean", "first string", "append", GroupStateTimeout.NoTimeout)
