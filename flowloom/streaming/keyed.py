"""Streaming forms of the keyed operators; each ends, over the same rows, with what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "user_id bigint, session bigint, events bigint, first_sequence bigint, last_sequence bigint, duration_us bigint"
STATE = "session bigint, events bigint, first_sequence bigint, last_sequence bigint, first_us bigint, last_us bigint"


def idle_sessions(events: DataFrame, idle: int) -> DataFrame:
    """user_id, session, events, first_sequence, last_sequence, duration_us of sessions in update mode: a pause of ``idle``
    microseconds or more closes one. Rows of a key arrive in the order of the log over batches; within one they are sorted."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        session, n, first, last, a, b = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        out = []
        for s, us in rows[["event_id", "us"]].itertuples(index=False):
            if n and us - b >= idle:
                out.append((key[0], session, n, first, last, b - a))
                session, n = session + 1, 0
            if not n:
                first, a = s, us
            n, last, a, b = n + 1, s, min(a, us), max(b, us) if n else us
        state.update((int(session), int(n), int(first), int(last), int(a), int(b)))
        out.append((key[0], session, n, first, last, b - a))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")])

    return events.select("user_id", "event_id", "us").groupBy("user_id").applyInPandasWithState(run, SESSION, STATE, "update", GroupStateTimeout.NoTimeout)


def keep_last(events: DataFrame, key: str) -> DataFrame:
    """key, event_id, type: the last row of each (key, type) so far, in update mode: state keeps the greatest sequence."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        best = max(int(rows["event_id"].max()), state.get[0] if state.exists else -1)
        state.update((best,))
        yield pd.DataFrame([(k[0], k[1], best)], columns=[key, "event_type", "event_id"])

    return events.select(key, "event_type", "event_id").groupBy(key, "event_type").applyInPandasWithState(run, f"{key} bigint, event_type string, event_id bigint", "event_id bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "update") -> None:
    """Processes what there is, each batch written under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
