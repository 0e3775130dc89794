"""Streams from files that arrive in and out of order, and restarts from a checkpoint."""

import json
import os
from datetime import datetime, timedelta

import pytest

from corpusgraph.streaming import joins, retries

START = datetime(2024, 1, 1)


def at(minutes):
    return (START + timedelta(minutes=minutes)).isoformat()


def arrive(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.json")
    os.utime(f"{folder}/{name}.json", (1_700_000_000 + int(name), 1_700_000_000 + int(name)))


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_stream_stream_join(spark, tmp_path):
    arrive(f"{tmp_path}/l", "1", [{"k": "a", "asked": at(0)}, {"k": "b", "asked": at(1)}, {"k": "c", "asked": at(2)}])
    arrive(f"{tmp_path}/l", "2", [{"k": "z", "asked": at(200)}])
    arrive(f"{tmp_path}/l", "3", [{"k": "z", "asked": at(400)}])
    arrive(f"{tmp_path}/r", "1", [{"k": "b", "answered": at(90), "n": 1}])
    arrive(f"{tmp_path}/r", "2", [{"k": "a", "answered": at(5), "n": 2}, {"k": "y", "answered": at(201), "n": 3}])
    arrive(f"{tmp_path}/r", "3", [{"k": "z", "answered": at(401), "n": 4}])
    left, right = read(spark, f"{tmp_path}/l", "k string, asked timestamp"), read(spark, f"{tmp_path}/r", "k string, answered timestamp, n int")
    out = joins.joined(left, right, "k", "asked", "answered", "30 minutes", "120 minutes", "left")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # b's answer came too long after; the last question may still be answered, and the answer is there
    assert got == {("a", 2), ("b", None), ("c", None), ("z", None), ("z", 4)}
    batch = joins.joined(spark.read.schema("k string, asked timestamp").json(f"{tmp_path}/l"), spark.read.schema("k string, answered timestamp, n int").json(f"{tmp_path}/r"), "k", "asked", "answered", "30 minutes", how="left")
    assert {(r.k, r.n) for r in batch.collect()} == got


def test_late_rows(spark, tmp_path):
    arrive(f"{tmp_path}/in", "1", [{"id": 1, "ts": at(0)}, {"id": 2, "ts": at(60)}, {"id": 3, "ts": at(1)}])
    arrive(f"{tmp_path}/in", "2", [{"id": 4, "ts": at(50)}, {"id": 5, "ts": at(49)}, {"id": 6, "ts": None}])
    run = lambda: joins.split_late(read(spark, f"{tmp_path}/in", "id int, ts timestamp"), "ts", "10 minutes", f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    run()
    arrive(f"{tmp_path}/in", "3", [{"id": 7, "ts": at(55)}, {"id": 8, "ts": at(100)}])
    arrive(f"{tmp_path}/in", "4", [{"id": 9, "ts": at(89)}, {"id": 10, "ts": at(90)}])
    run()
    ids = lambda kind: sorted(r.id for r in spark.read.schema("id int, ts timestamp, batch int").parquet(f"{tmp_path}/out/{kind}").collect())
    assert ids("on_time") == [1, 2, 3, 4, 7, 8, 10] and ids("late") == [5, 6, 9]
    # a batch that runs again splits by the batches before it alone
    assert joins.mark_before(spark, f"{tmp_path}/out/marks", 1) == START + timedelta(minutes=60)
    assert joins.mark_before(spark, f"{tmp_path}/nothing", 1) is None


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_retries(spark, tmp_path, rocks):
    e = lambda k, event, m: {"paper_key": k, "event": event, "ts": at(m)}

    def run():
        stream = read(spark, f"{tmp_path}/in", "paper_key string, event string, ts timestamp")
        out = retries.deliveries(stream, most=3, wait=60)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.paper_key, r.action, r.attempt, int((r.at - START).total_seconds() // 60)) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive(f"{tmp_path}/in", "1", [e("a", "new", 0), e("b", "new", 0), e("b", "new", 0), e("c", "done", 0)])
    arrive(f"{tmp_path}/in", "2", [e("a", "failed", 1), e("b", "done", 1)])
    assert run() == [("a", "deliver", 1, 0), ("b", "deliver", 1, 0)]
    # another run from the checkpoint: nothing is repeated, and what was due comes
    arrive(f"{tmp_path}/in", "3", [e("d", "new", 3)])
    assert run() == [("a", "deliver", 1, 0), ("a", "deliver", 2, 2), ("b", "deliver", 1, 0), ("d", "deliver", 1, 3)]
    arrive(f"{tmp_path}/in", "4", [e("a", "failed", 4), e("d", "failed", 4), e("d", "release", 4), e("b", "new", 4)])
    arrive(f"{tmp_path}/in", "5", [e("x", "new", 20)])
    arrive(f"{tmp_path}/in", "6", [e("y", "new", 21), e("d", "failed", 21)])
    arrive(f"{tmp_path}/in", "7", [e("a", "failed", 22)])
    arrive(f"{tmp_path}/in", "8", [e("x", "done", 60)])
    got = run()
    assert [r for r in got if r[0] == "a"] == [("a", "deliver", 1, 0), ("a", "deliver", 2, 2), ("a", "deliver", 3, 6), ("a", "give_up", 3, 22)]
    assert [r for r in got if r[0] == "d"] == [("d", "deliver", 1, 3), ("d", "released", 1, 4)]
    assert [r[1:] for r in got if r[0] == "b"] == [("deliver", 1, 0), ("deliver", 1, 4)]
