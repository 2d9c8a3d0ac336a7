"""A queue's worker as a stateful stream: events of jobs in, states of jobs out.

One transition rule, `step`, says what an event does to a job. `states` folds a table of events by
it; `state_stream` keeps each job's state in Spark's state store and gives out every change, with
a timer for the heartbeat: a running job whose last sign is older than the timeout counts as
failed once the watermark has passed. `handled` is the work itself: leased jobs go through the
handler of their type and come back as events.

Defined cases: events of a job count by time, then by event number; events that don't fit the
state (a lease of a running job, a heartbeat of another worker, anything before the job is
enqueued) change nothing; null times and unknown kinds change nothing; a job without a handler fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EVENT = "job_id long, event_no long, ts timestamp, kind string, worker string, max_retries int, progress int, error string"
STATE = "status string, retry_count int, max_retries int, progress int, locked_by string, error string, beat_ms long, started_ms long, finished_ms long"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
TIMED_OUT = "Worker heartbeat timed out"
TIMEOUT_S = 120
RETRIES = 2


def _failed(job: dict, ms: int, error: str | None) -> dict:
    again = job["retry_count"] < job["max_retries"]
    free = job | {"error": error, "locked_by": None, "beat_ms": ms}
    return free | ({"status": "pending", "retry_count": job["retry_count"] + 1} if again else {"status": "failed", "finished_ms": ms})


def step(job: dict | None, event: dict) -> dict | None:
    """The job after an event (kind, ms and what the kind brings); None is a job that isn't enqueued yet."""
    kind, ms = event["kind"], event["ms"]
    if job is None:
        fresh = {"status": "pending", "retry_count": 0, "max_retries": RETRIES if event.get("max_retries") is None else event["max_retries"], "progress": 0}
        return dict.fromkeys(FIELDS) | fresh if kind == "enqueue" else None
    match kind, job["status"]:
        case "lease", "pending":
            return job | {"status": "running", "locked_by": event.get("worker"), "beat_ms": ms, "started_ms": job["started_ms"] or ms}
        case "heartbeat", "running" if event.get("worker") == job["locked_by"]:
            return job | {"beat_ms": ms, "progress": job["progress"] if event.get("progress") is None else event["progress"]}
        case "success", "running":
            return job | {"status": "success", "progress": 100, "locked_by": None, "error": None, "beat_ms": ms, "finished_ms": ms}
        case ("failure" | "timeout"), "running":
            return _failed(job, ms, TIMED_OUT if kind == "timeout" else event.get("error"))
        case "retry", "failed":
            return dict.fromkeys(FIELDS) | {"status": "pending", "retry_count": 0, "max_retries": job["max_retries"], "progress": 0}
        case "cancel", "pending":
            return job | {"status": "cancelled", "finished_ms": ms}
    return job


def _late(job: dict | None, ms: int, timeout_ms: int) -> bool:
    return job is not None and job["status"] == "running" and ms - job["beat_ms"] > timeout_ms


def _events(frame: pd.DataFrame) -> list[dict]:
    frame = frame[frame["ts"].notna()].sort_values(["ts", "event_no"])
    ms = frame["ts"].astype("datetime64[ms]").astype("int64")
    plain = frame.astype(object).where(frame.notna(), None).to_dict("records")
    return [e | {"ms": int(t), "max_retries": None if e.get("max_retries") is None else int(e["max_retries"]), "progress": None if e.get("progress") is None else int(e["progress"])} for e, t in zip(plain, ms, strict=True)]


def _changes(job: dict | None, events: Iterable[dict], timeout_ms: int) -> Iterator[dict]:
    """The job after each event or timeout that changed it."""
    for e in events:
        if _late(job, e["ms"], timeout_ms):
            job = step(job, {"kind": "timeout", "ms": job["beat_ms"] + timeout_ms})
            yield job
        after = step(job, e)
        if after != job:
            job = after
            yield job


def states(events: DataFrame, now: str | None = None, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """job_id and its state after all its events. now: a time up to which heartbeats are asked for, as 'yyyy-mm-dd hh:mm:ss' in UTC."""
    until = None if now is None else int(pd.Timestamp(now).value // 1_000_000)
    given = {"kind": "string", "worker": "string", "max_retries": "int", "progress": "int", "error": "string"}
    columns = ["job_id", "ms", *[c for c in given if c in events.columns]]
    out = pa.schema([("job_id", pa.int64()), *[(f, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]) for f, kind in (x.split() for x in STATE.split(", "))]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True))
        ended: list[dict] = []
        for key, mine in groupby(rows, itemgetter(0)):
            job = None
            for job in _changes(None, (dict(zip(columns, row, strict=True)) for row in mine), 1000 * timeout_s):
                pass
            if until is not None and _late(job, until, 1000 * timeout_s):
                job = step(job, {"kind": "timeout", "ms": job["beat_ms"] + 1000 * timeout_s})
            if job:
                ended.append({"job_id": key} | job)
            if len(ended) == 10_000:
                yield pa.RecordBatch.from_pylist(ended, out)
                ended = []
        yield pa.RecordBatch.from_pylist(ended, out)

    # Spark brings a job's events together and in order; tasks go through many jobs one event at a time
    narrow = events.where("ts is not null").select(F.col("job_id").cast("long").alias("job_id"), F.unix_millis("ts").alias("ms"), "ts", "event_no", *[F.col(c).cast(given[c]).alias(c) for c in columns[2:]])
    ordered = narrow.repartition("job_id").sortWithinPartitions("job_id", "ts", F.asc_nulls_last("event_no"))
    return ordered.select(*columns).mapInArrow(fold, f"job_id long, {STATE}")


class _Jobs(StatefulProcessor):
    def __init__(self, timeout_ms: int, schema: StructType) -> None:
        self.timeout_ms, self.schema = timeout_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", self.schema)

    def _load(self) -> dict | None:
        held = self.job.get() if self.job.exists() else None
        return None if held is None else dict(zip(FIELDS, held, strict=True))

    def _store(self, key, changes: list[dict]) -> Iterator[pd.DataFrame]:
        if not changes:
            return
        job = changes[-1]
        self.job.update(tuple(job[f] for f in FIELDS))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job["status"] == "running":
            self.handle.registerTimer(job["beat_ms"] + self.timeout_ms + 1)
        out = pd.DataFrame([{"job_id": key[0], "change_no": i} | c for i, c in enumerate(changes)])
        for c in ("retry_count", "max_retries", "progress", "beat_ms", "started_ms", "finished_ms"):
            out[c] = out[c].astype("Int64")
        yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        yield from self._store(key, list(_changes(self._load(), _events(frame), self.timeout_ms)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._load()
        if _late(job, expiredTimerInfo.getExpiryTimeInMs(), self.timeout_ms):
            yield from self._store(key, [step(job, {"kind": "timeout", "ms": job["beat_ms"] + self.timeout_ms})])

    def close(self) -> None:
        pass


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_stream(events: DataFrame, timeout_s: int = TIMEOUT_S, late: str = "0 seconds") -> DataFrame:
    """A stream of job_id, change_no (within its batch) and the state after each change. The session's state store must be RocksDB (see `STORE`)."""
    rows = events.withWatermark("ts", late)
    out = StructType.fromDDL(f"job_id long, change_no long, {STATE}")
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(1000 * timeout_s, StructType.fromDDL(STATE)), outputStructType=out, outputMode="Update", timeMode="EventTime")


Handler = Callable[[Row], dict | None]


def handled(jobs: DataFrame, handlers: Mapping[str, Handler], worker: str) -> DataFrame:
    """job_id, kind ('success' or 'failure'), worker, error, result (JSON): what the handlers make of leased jobs (job_id, job_type, payload), each by its type's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                try:
                    if job["job_type"] not in handlers:
                        raise LookupError(f"No handler registered for job_type={job['job_type']}")
                    out.append((job["job_id"], "success", worker, None, json.dumps(handlers[job["job_type"]](Row(**job)) or {}, sort_keys=True)))
                except Exception as e:  # a job that fails is a result
                    out.append((job["job_id"], "failure", worker, str(e), None))
            yield pd.DataFrame(out, columns=["job_id", "kind", "worker", "error", "result"])

    return jobs.select("job_id", "job_type", "payload").mapInPandas(run, "job_id long, kind string, worker string, error string, result string")


def latest(changes: DataFrame, order: str = "batch") -> DataFrame:
    """The last state of each job among the changes of a stream, batches in order."""
    last = F.max(F.struct(order, "change_no", *FIELDS)).alias("s")
    return changes.groupBy("job_id").agg(last).select("job_id", *[F.col(f"s.{f}").alias(f) for f in FIELDS])
