"""The team overview over a stream of changes: each change takes a conversation's old count back and adds the new one."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOVES = "id bigint, agent_id bigint, status string, move int"
#: Conversations of a bucket have one state, so that a call of Python handles many of them.
BUCKETS = 1024
_STATE = "ids array<bigint>, seqs array<bigint>, agents array<bigint>, statuses array<string>, dues array<bigint>"


def overview_moves(changes: DataFrame, keep_closed: timedelta | None = None, watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(id, agent_id, status, move): +1 where a conversation enters a group of the overview and -1 where it leaves it.

    ``changes``: a stream of id, agent_id (null for nobody), status, seq, at (timestamp). The state of a conversation
    is its last change. What comes late, with a ``seq`` not above the last one's, is left out, so a change that is
    delivered twice counts once. Statuses other than pending and closed count as active. With ``keep_closed`` a closed
    conversation leaves the overview and the state so long after its last change, by the stream's watermark;
    without it states stay. Sums of moves are the counts at any time. States are held and rewritten by ``buckets`` of
    ids, a number that a stream keeps: take more for more than some ten million conversations.
    """
    kept_ms = None if keep_closed is None else int(keep_closed.total_seconds() * 1000)

    def rank(agent: int | None, status: str) -> tuple:
        return agent is None, agent or 0, status

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # id: seq, agent, status, and when a closed one goes.
        last = {i: change for i, *change in zip(*state.get, strict=True)} if state.exists else {}
        before: dict[int, list | None] = {}
        reached = state.getCurrentWatermarkMs() if kept_ms is not None else 0
        gone: set[int] = set()
        for b in [] if state.hasTimedOut else batches:
            for i, seq, agent, status, at in zip(b["id"].tolist(), b["seq"].tolist(), b["agent"].tolist(), b["status"].tolist(), b["ms"].tolist(), strict=True):
                old, agent = last.get(i), int(agent) if agent else None
                # Of changes with one seq in a batch one counts, whatever their order.
                if old is None or seq > old[0] or (i in before and seq == old[0] and rank(agent, status) < rank(*old[1:3])):
                    before.setdefault(i, old)
                    last[i] = [seq, agent, status, max(at + kept_ms, reached + 1) if kept_ms is not None and status == "closed" else None]
        out = []
        for i, old in before.items():
            if old:
                out.append((i, old[1], old[2], -1))
            out.append((i, last[i][1], last[i][2], 1))
        if kept_ms is not None:
            gone = {i for i, c in last.items() if c[3] is not None and c[3] <= reached}
            out += [(i, last[i][1], last[i][2], -1) for i in gone]
        last = {i: c for i, c in last.items() if i not in gone}
        if not last:
            if state.exists:
                state.remove()
        else:
            if before or gone:
                state.update((list(last), *map(list, zip(*last.values(), strict=True))))
            dues = [c[3] for c in last.values() if c[3] is not None]
            if dues:
                state.setTimeoutTimestamp(max(min(dues), reached + 1))
        if out:
            yield pd.DataFrame({"id": pd.Series([x[0] for x in out], dtype="int64"), "agent_id": pd.Series([x[1] for x in out], dtype="Int64"), "status": [x[2] for x in out], "move": pd.Series([x[3] for x in out], dtype="int32")})

    group = F.when(F.col("status").isin("pending", "closed"), F.col("status")).otherwise("active")
    rows = changes.where("id IS NOT NULL AND seq IS NOT NULL").select("id", "agent_id", group.alias("status"), "seq", "at")
    timed = GroupStateTimeout.NoTimeout if keep_closed is None else GroupStateTimeout.EventTimeTimeout
    if keep_closed is not None:
        rows = rows.withWatermark("at", watermark)
    # Agents go to Python as texts and times as whole milliseconds, so that none becomes a float next to nulls.
    rows = rows.select("id", "seq", F.coalesce(F.col("agent_id").cast("string"), F.lit("")).alias("agent"), "status", F.coalesce(F.unix_millis(F.col("at").cast("timestamp")), F.lit(0)).alias("ms"), "at", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(step, MOVES, _STATE, "append", timed)


def overview(moves: DataFrame) -> DataFrame:
    """agent_id, active, pending, closed from moves; agents without any conversation are left out."""
    n = lambda s: F.sum(F.when(F.col("status") == s, F.col("move")).otherwise(0)).alias(s)
    return moves.groupBy("agent_id").agg(n("active"), n("pending"), n("closed")).where("active + pending + closed > 0")
