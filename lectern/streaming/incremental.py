"""Streaming forms: an index that follows a folder of passages, and the circuit breaker on a stream of answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.retrieval import breaker_step
from ..operators.store import Snapshots, replace_chunks


def breaker_stream(events: DataFrame) -> DataFrame:
    """events(source, seq, ts_ms, outcome) as a stream -> (source, seq, allowed, state), with state kept by source."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, -1)
        out = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            streak, until, allowed = breaker_step(streak, until, e.ts_ms, e.outcome)
            out.append((key[0], e.seq, allowed, "open" if until >= 0 else "closed"))
        state.update((streak, until))
        yield pd.DataFrame(out, columns=["source", "seq", "allowed", "state"])

    return events.groupBy("source").applyInPandasWithState(step, "source string, seq long, allowed boolean, state string", "streak int, until long", "append", GroupStateTimeout.NoTimeout)


def follow_passages(passages: DataFrame, store: Snapshots, checkpoint: str):
    """Starts a query that replaces each batch's manifestations in the store's chunks; it stops when input is used up.

    A manifestation arrives whole in one batch; of rows that repeat a passage the greatest stays. Only the touched
    buckets of the table are written.
    """

    def put(batch: DataFrame, _: int) -> None:
        value = F.struct(*[c for c in batch.columns if c not in ("manifestation_id", "ordinal")])
        newest = batch.groupBy("manifestation_id", "ordinal").agg(F.max(value).alias("v")).select("manifestation_id", "ordinal", "v.*").select(*batch.columns)
        if store.has("chunks"):
            store.change({"chunks": newest.select("manifestation_id")}, lambda _, old: replace_chunks(old, newest))
        else:
            store.commit(keys={"chunks": "manifestation_id"}, chunks=newest)

    return passages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
