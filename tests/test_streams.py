"""Pushed rows as a stream with restarts, and chunks cut by a timer."""

import time

import pyarrow as pa
import pytest

from chronoloom.operators import folds
from chronoloom.sources.push import Producer, PushReader, pushed_stream
from chronoloom.streaming import ingest

SCHEMA = "producer string, packet_seq bigint, rows bigint, note string"


def rows(first, n, weight=3):
    return pa.table({"packet_seq": pa.array(range(first, first + n), pa.int64()), "rows": pa.array([weight + i % 4 for i in range(first, first + n)], pa.int64())})


def run(spark, spool, out):
    stream = ingest.chunked(pushed_stream(spark, spool, SCHEMA, progress=f"{out}/progress", files_per_producer=2), ["producer"], "packet_seq", ["rows"], max_rows=20)
    query = stream.writeStream.foreachBatch(ingest.write_once(f"{out}/rows")).option("checkpointLocation", f"{out}/offsets").start()
    try:
        query.processAllAvailable()
        return [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_two_producers_and_a_restart(spark, tmp_path):
    spool, out = str(tmp_path / "spool"), str(tmp_path / "out")
    fast, slow = Producer(spool, "fast"), Producer(spool, "slow")
    for i in range(7):
        fast.push(rows(i * 10, 10))
    slow.push(rows(0, 5))
    (tmp_path / "spool" / "slow" / "000000000009.arrow").write_bytes(b"behind a gap")
    batches = run(spark, spool, out)
    assert len(batches) == 4
    fast = Producer(spool, "fast")
    assert fast.push(rows(70, 10)) == 7 and slow.push(rows(5, 5)) == 1 and slow.push(rows(10, 5)) == 2
    more = run(spark, spool, out)
    assert more and min(more) > max(batches)
    assert run(spark, spool, out) == []
    got = spark.read.parquet(f"{out}/rows")
    assert got.groupBy("producer").count().orderBy("producer").collect() == [("fast", 80), ("slow", 15)]
    plain = got.drop("chunk", "late", "batch")
    want = folds.chunks(plain, ["producer"], ["packet_seq"], ["rows"], max_rows=20)
    pick = lambda df: sorted(tuple(r) for r in df.select("producer", "packet_seq", "rows", "chunk").collect())
    assert pick(got) == pick(want) and not got.where("late or note is not null").count()


def test_admission_goes_on_from_what_was_planned(tmp_path):
    spool = str(tmp_path / "spool")
    a = Producer(spool, "a")
    for i in range(5):
        a.push(rows(i, 1))
    reader = PushReader(spool, str(tmp_path / "progress"), 2, None)
    first = reader.latestOffset()
    assert first == {"a": 2} and [(p.first, p.end) for p in reader.partitions({}, first)] == [(0, 2)]
    again = PushReader(spool, str(tmp_path / "progress"), 2, None)
    assert again.latestOffset() == {"a": 4} and reader.latestOffset() == {"a": 4}
    assert again.partitions({"a": 2}, {"a": 2}) == [] and PushReader(str(tmp_path / "none"), None, 2, None).latestOffset() == {}


def test_batches_follow_bytes_not_files(tmp_path):
    """a backlog of many small files is one batch, dealt to several tasks; a file above the bound still goes alone."""
    spool = str(tmp_path / "spool")
    for name, n in (("a", 300), ("b", 3)):
        made = Producer(spool, name)
        for i in range(n):
            made.push(rows(i, 1))
    size = (tmp_path / "spool" / "a" / "000000000000.arrow").stat().st_size
    reader = PushReader(spool, None, None, None)
    assert reader.latestOffset() == {"a": 300, "b": 3}
    assert [(p.producer, p.first, p.end) for p in reader.partitions({"a": 10}, {"a": 300, "b": 3})] == [("a", 10, 266), ("a", 266, 300), ("b", 0, 3)]
    few = PushReader(spool, None, None, None, n_bytes=2 * size)
    assert few.latestOffset() == {"a": 2, "b": 2}
    few.partitions({}, {"a": 2, "b": 2})
    assert few.latestOffset() == {"a": 4, "b": 3} and PushReader(spool, None, None, None, n_bytes=1).latestOffset() == {"a": 1, "b": 1}


@pytest.mark.parametrize("typed", [True, False])
def test_a_silent_streams_chunk_is_cut(spark, tmp_path, typed):
    """Two rows, silence, two rows: without the timer all four would share a chunk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spool, out = str(tmp_path / "spool"), str(tmp_path / "out")
    made, busy = Producer(spool, "quiet"), Producer(spool, "ended")
    stream = pushed_stream(spark, spool, SCHEMA)
    options = {"max_rows": 1000, "idle_ms": 1500, "control": "note"}
    chunked = ingest.idle_chunked(stream, ["producer"], "packet_seq", ["rows"], **options) if typed else ingest.chunked(stream, ["producer"], "packet_seq", ["rows"], **options)
    query = chunked.writeStream.foreachBatch(ingest.write_once(f"{out}/rows")).option("checkpointLocation", f"{out}/offsets").trigger(processingTime="200 milliseconds").start()
    try:
        made.push(rows(0, 2))
        busy.push(rows(0, 1))
        busy.push(pa.table({"packet_seq": pa.array([1], pa.int64()), "note": ["CLEAN"]}))
        deadline = time.time() + 60
        read = lambda: spark.read.parquet(f"{out}/rows")
        seen = 0
        while time.time() < deadline and seen < 4:
            time.sleep(0.5)
            seen = read().count() if (tmp_path / "out" / "rows").exists() and list((tmp_path / "out" / "rows").glob("*/*.parquet")) else 0
        time.sleep(5)
        if typed:
            cut = read().where("idle_cut").collect()
            assert [(r.producer, r.chunk, r.packet_seq, r.late) for r in cut] == [("quiet", 0, None, False)]
        made.push(rows(2, 2))
        busy.push(rows(2, 1))
        time.sleep(6)
        while time.time() < deadline and read().where("packet_seq is not null").count() < 7:
            time.sleep(0.5)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = read().where("packet_seq is not null")
    assert [(r.packet_seq, r.chunk) for r in got.where("producer = 'quiet'").orderBy("packet_seq").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert [(r.packet_seq, r.chunk, r.late) for r in got.where("producer = 'ended'").orderBy("packet_seq").collect()] == [(0, 0, False), (1, None, False), (2, None, True)]


def test_gates_of_payloads_and_observations(spark, tmp_path):
    from chronoloom.plans.verify import OBSERVATION_DOMAINS, VALUE_COLUMNS

    registry = spark.createDataFrame([("e", "k", "integer", True, True)], "schema_id string, key string, type string, required boolean, closed boolean")
    columns = "schema_id string, payload string, kind string, name string, value_type string, applies_to string, provenance string, status string, value_i64 bigint, value_u64 bigint, value_f64 double, value_str string"
    good = ("e", '{"k":1}', "time", "t", "int64", "unknown", "device_provided", "assumed", 5, None, None, None)
    gate = ingest.row_gate(ingest.payload_gate(registry, ["schema_id"], "payload"), ingest.observation_gate(OBSERVATION_DOMAINS, VALUE_COLUMNS))
    write = ingest.write_once(str(tmp_path / "rows"), gate)
    write(spark.createDataFrame([good], columns), 0)
    for bad in [(*good[:1], '{"j":1}', *good[2:]), (*good[:2], "place", *good[3:]), (*good[:8], None, *good[9:])]:
        with pytest.raises(ValueError, match="contract"):
            write(spark.createDataFrame([good, bad], columns), 1)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1
