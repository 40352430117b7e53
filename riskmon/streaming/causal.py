"""Structured Streaming twin of the past-only entity features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "event_id long, key string, t long, prior_count int, hours_since_previous float, prior_amount_mean float, amount_to_prior_mean float, late boolean"
STATE = "n long, total double, last long"


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Features of a key's new rows; rows of one time do not see each other.

    A row earlier than the key's last time is marked late and changes nothing. A
    time must not be split over micro-batches.
    """
    n, total, last = state.get if state.exists else (0, 0.0, None)
    rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
    out = []
    for t, same in rows.groupby("t", sort=True):
        late = last is not None and t < last
        mean = total / n if n else None
        for r in same.itertuples(index=False):
            known = mean is not None and not late
            ratio = r.amount / mean if known and mean != 0 and pd.notna(r.amount) else None
            out.append((r.event_id, key[0], t, 0 if late else n, (t - last) / 3600 if known else None, mean if known else None, ratio, late))
        if not late:
            n, total, last = n + len(same), total + float(same["amount"].fillna(0).sum()), int(t)
    state.update((n, total, last))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    yield frame.astype({"prior_count": "int32", "hours_since_previous": "float32", "prior_amount_mean": "float32", "amount_to_prior_mean": "float32"})


def causal_stream(rows: DataFrame) -> DataFrame:
    """`rows` is a stream of event_id, key, t, amount; equals the batch features of a completed stream."""
    return rows.groupBy("key").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


BUFFER = STATE + ", times array<long>, ids array<long>, amounts array<double>"


def close_times(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Features of a key's rows whose time the watermark has passed; the others wait in the state.

    Once a time is passed all its rows are there, in whichever micro-batches they came,
    so rows of one time do not see each other and no order is asked for.
    """
    n, total, last, times, ids, amounts = state.get if state.exists else (0, 0.0, None, [], [], [])
    waiting = [pd.DataFrame({"t": list(times), "event_id": list(ids), "amount": list(amounts)})]
    if not state.hasTimedOut:
        waiting += [part[["t", "event_id", "amount"]] for part in parts]
    rows = pd.concat([w for w in waiting if len(w)]).astype({"t": "int64", "event_id": "int64", "amount": "float64"}).sort_values(["t", "event_id"])
    now = state.getCurrentWatermarkMs()
    done, rest = rows[rows["t"] * 1000 < now], rows[rows["t"] * 1000 >= now]
    out = []
    for t, same in done.groupby("t", sort=True):
        mean = total / n if n else None
        for r in same.itertuples(index=False):
            ratio = r.amount / mean if mean and pd.notna(r.amount) else None
            out.append((r.event_id, key[0], t, n, (t - last) / 3600 if n else None, mean, ratio, False))
        n, total, last = n + len(same), total + float(same["amount"].fillna(0).sum()), int(t)
    state.update((n, total, last, rest["t"].tolist(), rest["event_id"].tolist(), rest["amount"].tolist()))
    if len(rest):
        state.setTimeoutTimestamp(max(int(rest["t"].min()) * 1000, now + 1))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    yield frame.astype({"prior_count": "int32", "hours_since_previous": "float32", "prior_amount_mean": "float32", "amount_to_prior_mean": "float32"})


def ordered_causal_stream(rows: DataFrame, lateness: str) -> DataFrame:
    """Features of a stream of event_id, key, t, amount that is out of order by at most `lateness`.

    They come out when the watermark passes their time and equal the batch features of
    all rows that were not late, whose split `streaming.late` makes.
    """
    timed = rows.withColumn("event_time", F.timestamp_seconds("t")).withWatermark("event_time", lateness)
    return timed.groupBy("key").applyInPandasWithState(close_times, OUTPUT, BUFFER, "append", GroupStateTimeout.EventTimeTimeout)
