"""The action policy as a stream: hysteresis in keyed state, and a timer for labels that never come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream string, batch int, label_status string, action string, action_evidence string"
STATE = "batches array<int>, warned array<boolean>, deadlines array<long>, last_primary boolean, last_mature int"
# Actions and their evidence.
STALE = "Labels are stale beyond the configured maturity delay"
TWICE = "Primary performance guardrail breached in two mature batches"
DRIFTED, FAILED = "Critical data or prediction drift", "Critical mature-label performance breach"
PERSISTED, NOTHING = "Warning persisted for two consecutive batches", "No sustained or critical guardrail breach"


def decide(row, warned_before: bool, primary_before: bool) -> tuple[str, str]:
    """Action and evidence of one batch, given whether the batch before warned and the mature one before breached."""
    warned = "warning" in (row.drift_severity, row.performance_severity)
    critical = [text for text, level in ((DRIFTED, row.drift_severity), (FAILED, row.performance_severity)) if level == "critical"]
    if row.label_status == "stale":
        return "investigate", STALE
    if row.primary_critical and primary_before:
        return "retrain_evaluation_required", TWICE
    if critical:
        return "investigate", "; ".join(critical)
    if warned and warned_before:
        return "investigate", PERSISTED
    return "continue_monitoring", NOTHING


def policy(delay_ms: int):
    """The state function: batches of a stream in the order of their numbers, and a stale record where `delay_ms` passed without labels."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batches, warned, deadlines, primary, mature = state.get if state.exists else ([], [], [], None, None)
        known = dict(zip(list(batches), zip(list(warned), list(deadlines))))
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            for row in rows.sort_values("batch").itertuples(index=False):
                before = known.get(row.batch - 1, (False, 0))[0]
                out.append((key[0], row.batch, row.label_status, *decide(row, bool(before), bool(primary))))
                waits = row.label_status == "pending"
                deadline = int(row.batch_time.timestamp() * 1000) + delay_ms if waits else 0
                known[row.batch] = ("warning" in (row.drift_severity, row.performance_severity), deadline)
                if row.label_status == "mature" and (mature is None or row.batch > mature):
                    primary, mature = bool(row.primary_critical), row.batch
        now = state.getCurrentWatermarkMs()
        for batch in sorted(known):
            if 0 < known[batch][1] < now:
                out.append((key[0], batch, "stale", "investigate", STALE))
                known[batch] = (known[batch][0], 0)
        # Batches that still wait for labels, and the latest, whose warning the next one needs.
        known = {b: v for b, v in known.items() if v[1] or b == max(known)}
        state.update((list(known), [v[0] for v in known.values()], [v[1] for v in known.values()], primary, mature))
        if waiting := [v[1] for v in known.values() if v[1]]:
            state.setTimeoutTimestamp(max(min(waiting), now + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"batch": "int32"})

    return advance


def action_stream(batches: DataFrame, delay_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Actions of a stream of (stream, batch, batch_time, drift_severity, performance_severity, primary_critical, label_status).

    Batches of one stream have to arrive in the order of their numbers; one that is
    pending may come again as mature. The actions are those of `monitoring.actions`. A
    pending batch whose labels have not come when the watermark is `delay_seconds` past
    its time gives a further record of status stale.
    """
    held = batches.withWatermark("batch_time", lateness)
    return held.groupBy("stream").applyInPandasWithState(policy(delay_seconds * 1000), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
