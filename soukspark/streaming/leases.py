"""The queue's rules as state: commands on a row, applied in the order of their time by one writer a row.

Commands: ``id, ts, action (add, claim, complete, reject, release), worker``. Out: one row a command, with the row's
state after it and whether it took effect.
"""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from soukspark.config import LEASE_HOURS

STATE = "state string, worker string, since timestamp, attempts int"
OUT = "id long, ts timestamp, action string, worker string, ok boolean, state string, attempts int"


def step(state: tuple | None, action: str, worker: str, ts, hours: int = LEASE_HOURS) -> tuple[tuple | None, bool]:
    """The state after a command, and whether it took effect."""
    if state is None:
        return (("pending", None, None, 0), True) if action == "add" else (None, False)
    name, owner, since, attempts = state
    if action == "claim":
        free = name == "pending" or name == "claimed" and since < ts - timedelta(hours=hours)
        return (("claimed", worker, ts, attempts + 1), True) if free else (state, False)
    if name == "claimed" and owner == worker:
        if action in ("complete", "reject"):
            return ("done" if action == "complete" else "rejected", owner, since, attempts), True
        if action == "release":
            return ("pending", None, None, attempts), True
    return state, False


def apply(commands: DataFrame) -> DataFrame:
    """Works on streams. Rows of one key come in the order of ``ts`` within a batch."""

    def of(key, frames, state):
        held = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values(["ts", "action"], kind="stable").itertuples():
            held, ok = step(held, r.action, r.worker, r.ts.to_pydatetime())
            rows.append((key[0], r.ts, r.action, r.worker, ok, held[0] if held else None, held[3] if held else None))
        if held is not None:
            state.update(held)
        yield pd.DataFrame(rows, columns=["id", "ts", "action", "worker", "ok", "state", "attempts"]).astype({"attempts": "Int32"})

    return commands.groupBy("id").applyInPandasWithState(of, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
