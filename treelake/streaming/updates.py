"""Ref updates as a stream: compare-and-set, monotonic times and fast refusals, with one state row for each ref."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "ref string, event_id long, t long, outcome string, tip string"
STATE = "tip string, t long"


def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Outcome of each update (event_id, t, kind, expected, checksum) of a ref, in event order.

    An update whose time lies before the tip's is late; equal passes. One that expects another tip than there is (null: none; `*`: any) is refused.
    `delete` drops the tip (its time stays as the floor). What comes again after a restart has an old time or expects an old tip, so replays change nothing.
    """
    tip, floor = state.get if state.exists else (None, None)
    pdf = pd.concat(frames).sort_values("event_id", kind="stable")
    outcomes, tips = [], []
    expected = [None if x is None or x != x else x for x in pdf["expected"]] if "expected" in pdf else ["*"] * len(pdf)
    for t, kind, checksum, wanted in zip(pdf["t"].tolist(), pdf["kind"], pdf["checksum"], expected, strict=True):
        if floor is not None and t < floor:
            outcomes.append("late")
        elif wanted != "*" and wanted != tip:
            outcomes.append("refused")
        else:
            tip, floor = (None if kind == "delete" else checksum), t
            outcomes.append("deleted" if tip is None else "set")
        tips.append(tip)
    state.update((tip, floor))
    yield pd.DataFrame({"ref": key[0], "event_id": pdf["event_id"], "t": pdf["t"], "outcome": outcomes, "tip": tips})


def apply_updates(updates: DataFrame) -> DataFrame:
    """Decisions for a streaming frame (ref, event_id, t, kind, checksum and, if tips are to be compared, expected); state grows with the refs, not with the updates."""
    return updates.groupBy("ref").applyInPandasWithState(decide, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(updates: DataFrame, checkpoint: str, sink) -> None:
    """Process what there is and stop; the checkpoint makes a later run go on from there. sink(batch, id) must be idempotent by id."""
    apply_updates(updates).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
