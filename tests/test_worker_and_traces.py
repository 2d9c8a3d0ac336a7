import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.plans.ask import Answer
from lodestone.storage import fresh_path
from lodestone.streaming import traces, worker
from lodestone.streaming.events import file_stream

T0 = datetime(2024, 1, 1)


def event(job, no, s, kind, worker_="w", retries=None, progress=None, error=None):
    return (job, no, T0 + timedelta(seconds=s), kind, worker_, retries, progress, error)


def table(spark, events):
    return spark.createDataFrame(events, worker.EVENT)


def ended(df):
    return {r["job_id"]: r.asDict() for r in df.collect()}


LIFE = [
    event(1, 1, 0, "enqueue"), event(1, 2, 5, "lease"), event(1, 3, 60, "heartbeat", progress=40), event(1, 4, 100, "success"),
    event(2, 1, 0, "enqueue", retries=1), event(2, 2, 5, "lease"), event(2, 3, 10, "failure", error="bad"), event(2, 4, 20, "lease"), event(2, 5, 30, "failure", error="worse"),
    event(3, 1, 0, "enqueue"), event(3, 2, 5, "lease"), event(3, 3, 126, "heartbeat"),
    event(4, 1, 0, "enqueue"), event(4, 2, 5, "cancel"), event(4, 3, 6, "lease"),
    event(5, 1, 0, "enqueue", retries=0), event(5, 2, 5, "lease"), event(5, 3, 6, "failure", error="x"), event(5, 4, 7, "retry"), event(5, 5, 8, "lease", "v"), event(5, 6, 9, "heartbeat", "w", progress=50),
    event(6, 1, 3, "lease"), event(7, 1, 0, "enqueue"), event(7, 2, 0, "lease"), (7, 3, None, "success", "w", None, None, None), event(7, 4, 1, "no such kind"),
]


def test_transitions(spark):
    got = ended(worker.states(table(spark, LIFE)))
    assert {j: (s["status"], s["retry_count"], s["progress"], s["locked_by"], s["error"]) for j, s in got.items()} == {
        1: ("success", 0, 100, None, None),
        2: ("failed", 1, 0, None, "worse"),
        3: ("pending", 1, 0, None, worker.TIMED_OUT),  # 121 seconds without a sign
        4: ("cancelled", 0, 0, None, None),
        5: ("running", 0, 0, "v", None),  # another worker's heartbeat doesn't count
        7: ("running", 0, 0, "w", None),
    }
    assert got[5]["finished_ms"] is None and got[2]["finished_ms"] is not None
    later = ended(worker.states(table(spark, LIFE), now="2024-01-01 01:00:00"))
    assert (later[7]["status"], later[7]["retry_count"], later[5]["status"]) == ("pending", 1, "failed")
    assert ended(worker.states(table(spark, []))) == {}


def test_a_lease_holds_for_the_timeout_exactly(spark):
    on_time = [event(1, 1, 0, "enqueue"), event(1, 2, 0, "lease"), event(1, 3, 120, "success")]
    assert ended(worker.states(table(spark, on_time)))[1]["status"] == "success"


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", worker.STORE)
    rng = random.Random(5)
    kinds = ["enqueue", "lease", "heartbeat", "success", "failure", "retry", "cancel", "lease", "lease"]
    events = [event(rng.randrange(12), i, i * 20, rng.choice(kinds), error="e") for i in range(300)] + [event(99, 1000, 300 * 20 + 5000, "enqueue")]
    source, out, checkpoint = str(tmp_path / "in"), fresh_path(spark, "states"), fresh_path(spark, "checkpoint")

    def run(part):
        table(spark, part).coalesce(1).write.mode("append").parquet(source)
        changes = worker.state_stream(file_stream(spark, source, worker.EVENT))
        def put(rows, batch):
            rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

        changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(events[:120])
    run(events[120:])
    now = str(T0 + timedelta(seconds=300 * 20 + 5000))
    wanted = ended(worker.states(table(spark, events), now=now))
    got = ended(worker.latest(spark.read.parquet(out)))
    assert {j: {f: s[f] for f in worker.FIELDS} for j, s in got.items()} == {j: {f: s[f] for f in worker.FIELDS} for j, s in wanted.items()}
    assert {s["status"] for s in wanted.values()} >= {"pending", "failed"}


def test_handlers(spark):
    def count(job):
        return {"n": len(job.payload)}

    def fail(job):
        raise ValueError("broken " + job.payload)

    jobs = spark.createDataFrame([(1, "count", "abc"), (2, "fail", "x"), (3, "other", "y")], "job_id long, job_type string, payload string")
    got = {r["job_id"]: (r["kind"], r["error"], r["result"]) for r in worker.handled(jobs, {"count": count, "fail": fail}, "w").collect()}
    assert got == {1: ("success", None, '{"n": 3}'), 2: ("failure", "broken x", None), 3: ("failure", "No handler registered for job_type=other", None)}


def span(trace, s, order, name, ms=5):
    return (trace, "span", T0 + timedelta(seconds=s), order, name, "success", ms, None, None, None, None)


@pytest.fixture
def sink(spark):
    return traces.TraceSink(spark, fresh_path(spark, "traces"), 4)


def lines(sink):
    return sorted((r["trace_id"], r["span_order"], r["span_type"], r["latency_ms"]) for r in sink.spans().collect())


def test_a_batch_replayed_leaves_its_rows_once(spark, sink):
    first = spark.createDataFrame([span(1, 1, 1, "route"), span(1, 2, None, "sql", -4), span(1, 3, None, "answer"), span(2, 1, None, "route"), span(1, 9, 1, "late route"), (None, "span", T0, 1, "x", "s", 1, None, None, None, None)], traces.EVENT)
    sink.write(first, 0)
    once = lines(sink)
    assert once == [(1, 1, "route", 5), (1, 2, "sql", 0), (1, 3, "answer", 5), (2, 1, "route", 5)]
    sink.write(first, 0)
    assert lines(sink) == once
    sink.write(spark.createDataFrame([span(1, 1, 1, "route"), span(1, 7, None, "more"), span(3, 1, 4, "fourth")], traces.EVENT), 1)
    assert lines(sink) == [*once[:3], (1, 4, "more", 5), once[3], (3, 4, "fourth", 5)]


def test_headers_and_spans_joined(spark, sink):
    answer = Answer("success", "DATA", "ALLOW", evidence=["a", "b"], spans=[("sql", "success", 7), ("retrieval", "failed", 3)])
    sink.write(traces.events_of(spark, 1, 8, "how much?", answer, T0), 0)
    sink.write(spark.createDataFrame([(2, "start", T0, None, None, None, 0, 9, "open", None, None), span(5, 0, 1, "orphan")], traces.EVENT), 1)
    got = {r["trace_id"]: r for r in sink.joined().collect()}
    assert (got[1]["status"], got[1]["route"], got[1]["question"], got[1]["answer"], got[1]["latency_ms"], got[1]["n_spans"], got[1]["span_ms"]) == ("success", "DATA", "how much?", "a\nb", 10, 2, 10)
    assert [s["span_type"] for s in got[1]["spans"]] == ["sql", "retrieval"]
    assert (got[2]["status"], got[2]["n_spans"]) == ("running", None)
    assert (got[5]["status"], got[5]["n_spans"]) == (None, 1)
    assert traces.TraceSink(spark, fresh_path(spark, "none")).joined().count() == 0


def test_stream_into_the_sink(spark, sink, tmp_path):
    source, checkpoint = str(tmp_path / "in"), fresh_path(spark, "checkpoint")
    for part in ([span(1, 1, None, "a"), span(2, 1, None, "b")], [span(1, 2, None, "c")]):
        spark.createDataFrame(part, traces.EVENT).coalesce(1).write.mode("append").parquet(source)
        sink.stream(file_stream(spark, source, traces.EVENT), checkpoint).awaitTermination()
    assert lines(sink) == [(1, 1, "a", 5), (1, 2, "c", 5), (2, 1, "b", 5)]


def test_jobs_are_folded_in_one_pass_over_a_task(spark):
    lives = [event(j, 10 * j + i, i, kind) for j in range(300) for i, kind in enumerate(["enqueue", "lease", "success"][: 1 + j % 3])]
    found = worker.states(table(spark, lives))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # a frame for each job
    assert {j: s["status"] for j, s in ended(found).items()} == {j: ["pending", "running", "success"][j % 3] for j in range(300)}
