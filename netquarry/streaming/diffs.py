"""Snapshot differences over a stream of snapshots: what batch diffs give for two dates, as each new state arrives.

State is kept for each (device, stanza, element): its latest attributes. A newer state gives the changed attributes; a
state older than the one kept is late and gives nothing. Elements that fall silent lose their state when the watermark is KEPT_MS past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "device string, stanza string, element string, ts timestamp, change string, attr string, old string, new string"
STATE = "ts double, attrs string"
#: How long in event time a state is kept after its last change: 30 days.
KEPT_MS = 30 * 24 * 3600 * 1000


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import json

    if state.hasTimedOut:
        state.remove()
        return
    seen, attrs = (None, None) if not state.exists else state.get
    known = json.loads(attrs) if attrs else None
    out = []
    rows = pd.concat(list(frames)).sort_values(["ts", "attr"])
    for ts, snapshot in rows.groupby("ts", sort=True):
        at = ts.timestamp()
        if seen is not None and at <= seen:
            continue
        now = {a: None if pd.isna(v) else v for a, v in zip(snapshot["attr"], snapshot["val"], strict=True)}
        if known is None:
            out.append((*key, ts, "Addition", None, None, None))
        else:
            for a in sorted(known.keys() | now.keys()):
                if a not in now:
                    out.append((*key, ts, "Deletion", a, known[a], None))
                elif a not in known:
                    out.append((*key, ts, "Addition", a, None, now[a]))
                elif known[a] != now[a]:
                    out.append((*key, ts, "Modification", a, known[a], now[a]))
        seen, known = at, now
    state.update((seen, json.dumps(known)))
    state.setTimeoutTimestamp(int(max(seen * 1000, state.getCurrentWatermarkMs())) + KEPT_MS)
    yield pd.DataFrame(out, columns=["device", "stanza", "element", "ts", "change", "attr", "old", "new"]).astype({"ts": "datetime64[ns]"})


def stream_diffs(snapshots: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Changes of a streaming table (device, stanza, element, ts, attr, val); all attributes of a state share its ts and arrive together."""
    keyed = snapshots.withWatermark("ts", lateness).groupBy("device", "stanza", "element")
    return keyed.applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def change_counts(snapshots: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """window, stanza, elements (about how many different ones), rows: what arrived in each window of time, of a streaming table."""
    return snapshots.withWatermark("ts", lateness).groupBy(F.window("ts", window), "stanza").agg(F.approx_count_distinct("element").alias("elements"), F.count("*").alias("rows"))
