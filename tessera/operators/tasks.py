"""Ingestion tasks as an append-only event log: sequences, state folds, leases, listings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOWED = {
    "pending": ("running", "cancelled", "failed"),
    "running": ("succeeded", "failed", "cancelling", "pending"),
    "cancelling": ("cancelled", "succeeded", "failed"),
    "failed": ("pending",),
    "succeeded": (),
    "cancelled": (),
}
TERMINAL, ACTIVE = ("succeeded", "failed", "cancelled"), ("running", "cancelling")
LEASE_SECONDS, HEARTBEAT_SECONDS, MAX_ATTEMPTS = 90, 10, 3


def can_move(src: Column, dst: Column) -> Column:
    """Whether the transition is legal; staying is."""
    pairs = [f"{a}>{b}" for a, to in ALLOWED.items() for b in to]
    return F.concat_ws(">", src, dst).isin(pairs) | ((src == dst) & src.isin(*ALLOWED))


def sequenced(events: DataFrame, key: str, *order: str) -> DataFrame:
    """events with seq, 1..n without gaps within each key."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def after(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("seq") > seq)


def next_sequence(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def intervals(events: DataFrame, key: str, at: str = "at", order: str = "seq") -> DataFrame:
    """events with finished_at: where the key's next stage begins."""
    return events.withColumn("finished_at", F.lead(at).over(Window.partitionBy(key).orderBy(order)))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("r")).select(key, "r.*")


def idempotent(tasks: DataFrame, *keys: str, first: str) -> DataFrame:
    """The earliest task of each idempotency key; later ones get it."""
    return tasks.groupBy(*keys).agg(F.min(first).alias(first))


def select_tasks(tasks: DataFrame, kind: str | None = None, status: str | None = None, owner_id: str | None = None, idempotency_key: str | None = None) -> DataFrame:
    for name, value in (("kind", kind), ("status", status), ("owner_id", owner_id), ("idempotency_key", idempotency_key)):
        if value is not None:
            tasks = tasks.where(F.col(name) == value)
    return tasks


def page(rows: DataFrame, created: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc(created), key).offset(offset).limit(limit)


def backlog(tasks: DataFrame, cap: int, status: Column) -> DataFrame:
    """One row: pending tasks, counted up to the cap."""
    return tasks.where(status).limit(cap).agg(F.count("*").alias("backlog"))


def public_view(tasks: DataFrame) -> DataFrame:
    return tasks.drop("worker_id", "version", "idempotency_key", "context")


def retry_delay(backoff: Column, attempts: Column) -> Column:
    return backoff * F.pow(F.lit(2.0), attempts - 1)


def after_failure(retriable: Column, attempts: Column, most: Column) -> Column:
    return F.when(retriable & (attempts < most), "pending").otherwise("failed")


def error_kind(status: Column) -> Column:
    """Of an HTTP status; null is a network error."""
    return F.when(status.isNull() | (status >= 500) | status.isin(408, 429), "retriable").otherwise("fatal")


def sweep(tasks: DataFrame, now: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Stale active tasks with their new status; tasks: task_id, status, heartbeat_at, started_at, updated_at, attempts,
    max_attempts."""
    alive = F.coalesce("heartbeat_at", "started_at", "updated_at")
    stale = F.col("status").isin(*ACTIVE) & (alive < now - F.make_interval(secs=F.lit(lease_seconds)))
    new = F.when(F.col("status") == "cancelling", "cancelled").when(F.col("attempts") < F.col("max_attempts"), "pending").otherwise("failed")
    return tasks.where(stale).withColumn("new_status", new)


START = {"status": "pending", "attempts": 0, "version": 0, "worker": None, "stage": None, "progress": 0.0, "started_at": None, "finished_at": None, "stages": 0, "ignored": 0}


def fold(events: Iterable[dict], state: dict | None = None) -> dict:
    """State of a task after its events (type, at, worker, stage, progress) in order, from a state that earlier ones left.
    Moves that the table forbids, and those of a worker that no longer owns the task, change nothing."""
    s = dict(state or START)
    for e in events:
        kind, at, worker = e["type"], e["at"], e.get("worker")
        owned = worker is None or worker == s["worker"]
        if kind == "claim":
            if s["status"] != "pending":
                s["ignored"] += 1
                continue
            s.update(status="running", worker=worker, attempts=s["attempts"] + 1, started_at=at if s["started_at"] is None else s["started_at"], version=s["version"] + 1)
        elif kind == "heartbeat":
            s["ignored"] += not owned
        elif kind == "stage":
            if not owned or s["status"] != "running":
                s["ignored"] += 1
                continue
            s.update(stage=e.get("stage"), stages=s["stages"] + 1, version=s["version"] + 1)
        elif kind == "progress":
            if owned:
                s["progress"] = min(1.0, max(0.0, float(e.get("progress") or 0)))
        elif kind == "handoff":
            if owned and s["status"] == "running":
                s.update(status="pending", worker=None, attempts=s["attempts"] - 1, version=s["version"] + 1)
        elif kind == "cancel":
            to = {"running": "cancelling", "pending": "cancelled"}.get(s["status"])
            if to:
                s.update(status=to, version=s["version"] + 1, finished_at=at if to == "cancelled" else None)
        elif kind == "retry":
            if s["status"] == "failed":
                s.update(status="pending", worker=None, attempts=0, finished_at=None, version=s["version"] + 1)
                s["stage"] = s["stage"] if e.get("keep_stage", True) else None
        else:
            if kind not in ALLOWED.get(s["status"], ()) or not owned:
                s["ignored"] += 1
                continue
            s.update(status=kind, version=s["version"] + 1, worker=None if kind in (*TERMINAL, "pending") else s["worker"])
            if kind in TERMINAL:
                s["finished_at"] = at
                s["progress"] = 1.0 if kind == "succeeded" else s["progress"]
    return s


STATE = "task_id string, status string, attempts int, version int, worker string, stage string, progress double, started_at timestamp, finished_at timestamp, stages int, ignored int"


#: Events of which a task makes objects at a time.
EVENTS = 10_000
_FOLDED = pa.schema([("task_id", pa.string()), ("status", pa.string()), ("attempts", pa.int32()), ("version", pa.int32()), ("worker", pa.string()), ("stage", pa.string()), ("progress", pa.float64()), ("started_at", pa.timestamp("us", "UTC")), ("finished_at", pa.timestamp("us", "UTC")), ("stages", pa.int32()), ("ignored", pa.int32())])


def _folded(batches):
    """Rows of events, a task's together and in order, as a row of state a task; a log may go over batches."""
    key, state, out = None, None, []

    def done():
        return pa.RecordBatch.from_pylist(out, _FOLDED)

    for whole in batches:
        for a in range(0, whole.num_rows, EVENTS):
            batch = whole.slice(a, EVENTS)
            ids, *columns = (batch.column(n).to_pylist() for n in batch.schema.names)
            names = batch.schema.names[1:]
            log = [dict(zip(names, r)) for r in zip(*columns)]
            cuts = [0, *(j for j in range(1, len(ids)) if ids[j] != ids[j - 1]), len(ids)]
            for b, c in zip(cuts, cuts[1:]):
                if state is not None and ids[b] != key:
                    out.append({"task_id": key, **state})
                    state = None
                key, state = ids[b], fold(log[b:c], state)
            if len(out) >= EVENTS:
                yield done()
                out = []
    if state is not None:
        out.append({"task_id": key, **state})
    yield done()


def fold_tasks(events: DataFrame) -> DataFrame:
    """One row of state a task from events (task_id, seq, type, at, worker, stage, progress): whole partitions of tasks are
    folded, not a group at a time; no log is held."""
    rest = [c for c in events.columns if c not in ("task_id", "seq")]
    logs = events.select(F.col("task_id").cast("string"), "seq", *rest).repartition("task_id").sortWithinPartitions("task_id", F.asc_nulls_last("seq"))
    logs = logs.select("task_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), *(c for c in rest if c != "at"))
    return logs.mapInArrow(_folded, STATE)


def stateful_fold(stream: DataFrame) -> DataFrame:
    """The same fold over a stream of events: a row for each task that a micro-batch touches."""
    import json

    def run(key, batches: Iterator[pd.DataFrame], state):
        log = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.assign(at=pdf["at"].astype(str)).astype(object)
            log += pdf.where(pdf.notna(), None).to_dict("records")
        log.sort(key=lambda e: e["seq"])
        state.update((json.dumps(log),))
        s = fold(log)
        yield pd.DataFrame([{"task_id": key[0], "status": s["status"], "attempts": s["attempts"], "version": s["version"]}])

    return stream.groupBy("task_id").applyInPandasWithState(run, "task_id string, status string, attempts int, version int", "log string", "update", "NoTimeout")
