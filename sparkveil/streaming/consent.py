"""Consent as a stream: withdrawals that arrive while events flow block what follows them and reopen what is finished.

Changes and events of a subject meet in keyed state. An event is blocked if the newest change at or before its
time is a withdrawal. It is decided when it arrives, by the changes known then; a change that arrives later and
alters the decision gives the event again, with the next revision. After the horizon, told by event-time timers,
finished events are forgotten and of the changes before it only the newest is kept.

Many subjects share a key, and their rows and state are worked on as columns: the calls of a micro-batch are
bounded by the number of keys, and what a call does grows with its rows and the state of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A subject's events are dealt over so many keys, each with all its changes, so that one busy subject is no single task.
SPREAD = 8
#: Keys that (subject, part) is hashed to.
KEYS = 256
OUTPUT = "subject string, event string, at timestamp, blocked boolean, revision int"
_STATE = "changes binary, done binary"
_CHANGES = pa.schema([("subject", pa.string()), ("at", pa.int64()), ("withdrawn", pa.bool_())])
_DONE = pa.schema([("subject", pa.string()), ("at", pa.int64()), ("event", pa.string()), ("blocked", pa.bool_()), ("revision", pa.int32())])


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(body).read_pandas()


def _in_order(changes: pd.DataFrame) -> pd.DataFrame:
    """Changes by subject and time, one per time: of changes at one time, a withdrawal wins."""
    return changes.sort_values(["subject", "at", "withdrawn"], ignore_index=True).drop_duplicates(["subject", "at"], keep="last", ignore_index=True)


def _blocked(changes: pd.DataFrame, events: pd.DataFrame) -> np.ndarray:
    """Per event, whether its subject's newest change at or before its time is a withdrawal."""
    n = len(changes)
    if not n or not len(events):
        return np.zeros(len(events), bool)
    subject, _ = pd.factorize(np.concatenate([changes["subject"].to_numpy(object), events["subject"].to_numpy(object)]))
    at = np.concatenate([changes["at"].to_numpy(np.int64), events["at"].to_numpy(np.int64)])
    order = np.lexsort((np.arange(len(at)) >= n, at, subject))  # at one time, changes come first
    newest = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))
    change = order[np.maximum(newest, 0)]
    known = (newest >= 0) & (subject[change] == subject[order])
    withdrawn = np.append(changes["withdrawn"].to_numpy(bool), np.zeros(len(events), bool))
    out = np.empty(len(order), bool)
    out[order] = known & withdrawn[change]
    return out[n:]


def _forget(changes: pd.DataFrame, done: pd.DataFrame, limit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What may still matter after `limit`: later events, later changes and each subject's newest change before them."""
    old = changes["at"] <= limit
    newest = old & ~changes["subject"].where(old).duplicated(keep="last")  # changes are in order of time
    return changes[~old | newest].reset_index(drop=True), done[done["at"] > limit].reset_index(drop=True)


def _decider(horizon_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State of one key: changes by time, and the events decided within the horizon."""
        changes, done = map(_unpacked, state.get) if state.exists else (_CHANGES.empty_table().to_pandas(), _DONE.empty_table().to_pandas())
        out = []
        if state.hasTimedOut:
            changes, done = _forget(changes, done, (state.getCurrentWatermarkMs() - horizon_ms) * 1000)
        else:
            rows = pd.concat(list(batches), ignore_index=True)
            change = rows["withdrawn"].notna()
            if change.any():
                new = rows.loc[change, ["subject", "at_us", "withdrawn"]].rename(columns={"at_us": "at"}).astype({"withdrawn": bool})
                changes = _in_order(pd.concat([changes, new], ignore_index=True) if len(changes) else new)
                now = _blocked(changes, done)
                altered = now != done["blocked"].to_numpy(bool)
                if altered.any():
                    done["blocked"], done["revision"] = now, (done["revision"] + altered).astype("int32")
                    out.append(done[altered])
            if not change.all():
                decided = rows.loc[~change, ["subject", "at_us", "event"]].rename(columns={"at_us": "at"})
                decided = decided.assign(blocked=_blocked(changes, decided), revision=np.int32(0))
                done = pd.concat([done, decided], ignore_index=True) if len(done) else decided
                out.append(decided)
        if not len(changes) and not len(done):
            state.remove()
        else:
            state.update((_packed(changes, _CHANGES), _packed(done, _DONE)))
            _wake(state, changes, done, horizon_ms)
        for rows in out:
            yield rows[["subject", "event"]].assign(at=pd.to_datetime(rows["at"], unit="us"), blocked=rows["blocked"], revision=rows["revision"])

    return run


def _wake(state: GroupState, changes: pd.DataFrame, done: pd.DataFrame, horizon_ms: int) -> None:
    """One timer per key: when the oldest entry that may be dropped passes the horizon. A subject's first change may only go after its second."""
    times = np.concatenate([done["at"].to_numpy(np.int64), changes.loc[changes["subject"].duplicated(), "at"].to_numpy(np.int64)])
    if len(times):
        state.setTimeoutTimestamp(max(-(-int(times.min()) // 1000) + horizon_ms, state.getCurrentWatermarkMs() + 1))


def decide(
    stream: DataFrame, subject: str, event: str, event_time: str, withdrawn: Column, horizon: str = "30 days", spread: int = SPREAD,
    keys: int = KEYS,
) -> DataFrame:
    """(subject, event, at, blocked, revision) per event and again per change of its decision.

    `withdrawn` is true for withdrawals, false for consent given, NULL for rows that change nothing; a change is an
    event too. Changes up to `horizon` late reopen what they concern. A key's state is read and written whole in
    every micro-batch that has rows for it; `keys` bounds how much that is.
    """
    part = F.pmod(F.xxhash64(event), F.lit(spread))
    rows = stream.select(
        F.col(subject).cast("string").alias("subject"), F.col(event).cast("string").alias("event"), F.col(event_time).cast("timestamp").alias("at"),
        withdrawn.cast("boolean").alias("withdrawn"), part.cast("int").alias("part"),
    ).where("at IS NOT NULL AND subject IS NOT NULL").withWatermark("at", horizon)
    own = F.struct("part", "event", F.lit(None).cast("boolean").alias("withdrawn"))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda p: F.struct(p.alias("part"), F.col("event"), F.col("withdrawn")))
    dealt = rows.select("subject", "at", F.explode(F.when(F.col("withdrawn").isNull(), F.array(own)).otherwise(F.concat(everywhere, F.array(own)))).alias("r"))
    key = F.pmod(F.xxhash64("subject", "r.part"), F.lit(keys))
    keyed = dealt.select(key.cast("int").alias("key"), "subject", "at", F.unix_micros("at").alias("at_us"), F.col("r.event").alias("event"), F.col("r.withdrawn").alias("withdrawn"))
    length = int(stream.sparkSession.sql(f"SELECT timestampdiff(MILLISECOND, timestamp'2000-01-01', timestamp'2000-01-01' + INTERVAL {horizon}) AS ms").first().ms)
    return keyed.groupBy("key").applyInPandasWithState(_decider(length), OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision of every event: (user_id, id, at, blocked, revision)."""
    newest = F.max_by(F.struct("at", "blocked", "revision"), "revision")
    return decisions.groupBy("subject", "event").agg(newest.alias("d")).select(
        F.col("subject").alias("user_id"), F.col("event").alias("id"), "d.at", "d.blocked", "d.revision"
    )
