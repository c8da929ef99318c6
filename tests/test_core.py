"""Registered queries against DuckDB, edge cases of the operators, byte formats and streams."""

import collections
import json
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoloom import queries
from chronoloom.functions import canonical, scalars
from chronoloom.operators import catalog, checks, folds, profile
from chronoloom.streaming import ingest

SF = "/root/testdata/sf0.001"
SLOW = {"verified_fleet", "damaged_fleet", "recorded_values"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, collections.Counter(zip(*[map(repr, table.column(n).to_pylist()) for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_profile_edges(spark):
    series = {"a": [10, 11, 12, 13], "b": [0, 1, 2, 1.5, 3], "c": [7, 7, 7], "d": [5]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i bigint, v double")
    got = {r.k: r for r in profile.series_profile(df, ["k"], "i", "v").collect()}
    assert got["a"].strictly_increasing and got["a"].distinct_steps == 1 and got["a"].backward_positions == []
    assert not got["b"].non_decreasing and got["b"].backward_positions == [2] and got["b"].step_min == -0.5
    assert got["c"].non_decreasing and not got["c"].strictly_increasing
    assert got["d"].non_decreasing and got["d"].strictly_increasing and got["d"].distinct_steps == 0 and got["d"].step_min is None
    many = spark.createDataFrame([("x", i, float(-i)) for i in range(50)], "k string, i bigint, v double")
    one = profile.series_profile(many, ["k"], "i", "v").first()
    assert one.n_backward == 49 and one.backward_positions == list(range(20))
    assert profile.series_profile(df.limit(0), ["k"], "i", "v").count() == 0


def test_chunk_edges(spark):
    df = spark.createDataFrame([("s", i, w, float(i)) for i, w in enumerate([3, 3, 9, 1, 1])], "k string, i bigint, w bigint, t double")
    of = lambda **kw: [r.chunk for r in folds.chunks(df, ["k"], ["i"], ["w"], time="t", **kw).orderBy("i").collect()]
    assert of(max_rows=6) == [0, 0, 1, 2, 2]  # a row that is too heavy is alone
    assert of(max_rows=0) == [0] * 5
    assert of(max_rows=0, max_age=0) == [0, 1, 2, 3, 4]
    assert of(max_rows=0, max_age=2) == [0, 0, 0, 1, 1]
    assert [r.mark for r in folds.periodic_marks(df, ["k"], ["i"], "t", 0).collect()] == [False] * 5


def test_dense_keys_of_empty_packets(spark):
    parents = spark.createDataFrame([(1, 0), (2, 2), (3, None)], "p bigint, n int")
    assert sorted(tuple(r) for r in checks.expected_dense_keys(parents, ["p"], "n", "i").collect()) == [(2, 0), (2, 1)]
    none = checks.multiset_difference(checks.expected_dense_keys(parents, ["p"], "n", "i"), spark.createDataFrame([(2, 0), (2, 0), (9, 1)], "p bigint, i int"), ["p", "i"])
    assert {tuple(r) for r in none.collect()} == {(2, 0, 0, 1), (2, 1, 1, 0), (9, 1, 0, 1)}


def test_integers_and_paths(spark):
    texts = ["0", "-0", "01", "+1", "-1", "1\n", " 1", "9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616", "1.0", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.i, r.u) for r in df.select("t", scalars.int64(F.col("t")).alias("i"), scalars.uint64(F.col("t")).alias("u")).collect()}
    assert {t for t, (i, _) in got.items() if i is not None} == {"0", "-1", "9223372036854775807"}
    assert {t for t, (_, u) in got.items() if u is not None} == {"0", "9223372036854775807", "9223372036854775808", "18446744073709551615"}
    bad = {"a//b": "empty_or_traversal_segment", "a/./b": "empty_or_traversal_segment", "../a": "empty_or_traversal_segment", "/a": "absolute", "a\\b": "illegal_character", " a": "empty_or_padded", "": "empty_or_padded", "a/b.c": None}
    df = spark.createDataFrame([(t,) for t in bad], "t string")
    assert {r.t: r.e for r in df.select("t", scalars.path_error(F.col("t")).alias("e")).collect()} == bad


def test_known_answers(spark):
    assert canonical.crc32c_bytes(b"123456789") == 0xE3069283
    assert canonical.write({"\U00010000": 1, "￿": 2, "b": [True, None, "é\n\u0007"], "a": {}}) == '{"a":{},"b":[true,null,"é\\n\\u0007"],"\U00010000":1,"￿":2}'
    df = spark.createDataFrame([('{"b": 1, "a": "x"}',), ("[1.5]",), ("NaN",), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(canonical.canonical_json("t")).collect()] == ['{"a":"x","b":1}', None, None, None, None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**63 - 1), st.binary(max_size=40)), max_size=6), st.integers(0, 3))
def test_frames_round_trip_and_torn_tail(packets, cut):
    import struct

    data = b"".join(struct.pack(canonical.HEADER, canonical.MAGIC, s, len(p)) + p + struct.pack("<I", canonical.crc32c_bytes(p)) for s, p in packets)
    assert [(f["packet_seq"], f["payload"]) for f in canonical.frames(data)] == packets
    if packets and cut:
        torn = canonical.frames(data[:-cut])
        assert torn[-1]["error"] == "torn_payload" and len(torn) == len(packets)


def test_frames_of_many_logs_are_checked_together(spark, tmp_path, monkeypatch):
    import struct

    made = lambda s, p: struct.pack(canonical.HEADER, canonical.MAGIC, s, len(p)) + p + struct.pack("<I", canonical.crc32c_bytes(p))
    bad = made(2, b"xyz")[:-1] + b"\x00"
    logs, calls, many = [made(1, b"a") + bad + made(3, b"b"), b"", made(4, b"") + b"torn", made(5, b"c" * 3000), b"\x00" * 40], [], canonical.crc32c_many
    monkeypatch.setattr(canonical, "crc32c_many", lambda payloads: calls.append(1) or many(payloads))
    got = [[(f["at"], f["packet_seq"], f["error"]) for f in found] for found in canonical.frames_of(logs)]
    header = canonical.HEADER_BYTES
    assert got == [[(0, 1, None), (header + 5, None, "bad_crc")], [], [(0, 4, None), (header + 4, None, "torn_header")], [(0, 5, None)], [(0, None, "bad_magic")]]
    assert len(calls) == 1
    # One file of one row group: its frames are made by more than the task that reads it.
    spark.range(1000).selectExpr("id AS event_id", "string(id) AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = entry.queries()["payload_frames"](spark, str(tmp_path))
        assert found.select(F.spark_partition_id()).distinct().count() > 1 and found.where("payload = string(event_id) AND packet_seq = event_id").count() == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8))
def test_canonical_round_trip(value):
    text = canonical.write(value)
    assert canonical.parse(text) == value and canonical.write(json.loads(text)) == text


def test_outcome_reasons_in_order(spark):
    log = [(1, 0, "ABORTED", "COMPLETED"), (1, 1, "UNCLASSIFIED", "ABORTED"), (1, 2, "COMPLETED", "UNCLASSIFIED"), (1, 3, "COMPLETED", "ABORTED"), (1, 4, "ABORTED", "TECHNICAL_FAILURE")]
    df = spark.createDataFrame(log, "s bigint, i bigint, f string, t string").withColumn("sealed", F.lit("COMPLETED"))
    got = folds.effective_outcome(df, ["s"], "i", "f", "t", "sealed").first()
    assert got.outcome == "ABORTED" and got.accepted == 1
    assert [r.reason for r in got.rejected] == ["TARGET_COMPLETED", "STALE_FROM", "TRANSITION_NOT_PERMITTED", "TRANSITION_NOT_PERMITTED"]


def test_upsert_and_refresh(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    a = spark.createDataFrame([("x", 1), ("y", 1)], "session_id string, v int")
    catalog.upsert(a, path, "session_id")
    catalog.upsert(spark.createDataFrame([("y", 2)], "session_id string, v int"), path, "session_id")
    assert {(r.session_id, r.v) for r in spark.read.parquet(path).collect()} == {("x", 1), ("y", 2)}
    catalog.refresh(spark, {"t": a}, path + "2")
    assert catalog.read(spark, f"{path}2", "t").count() == 2


def test_stream_continues_and_accounts(spark, tmp_path):
    schema = "stream string, seq bigint, w bigint, status string"
    parts = [[("a", 0, 2, None), ("a", 1, 2, None), ("b", 0, 9, None)], [("a", 2, 2, None), ("b", 1, 1, None), ("b", 2, 0, "CLEAN")], [("a", 3, 2, None), ("b", 3, 1, None)]]
    folder, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: ingest.file_stream(spark, f"file://{folder}", "*.parquet", spark.createDataFrame([], schema).schema)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        ingest.ingest(ingest.chunked(stream(), ["stream"], "seq", ["w"], max_rows=4, control="status"), out, f"file://{tmp_path}/cp")
    written = spark.read.parquet(out)
    assert {(r.stream, r.seq): (r.chunk, r.late) for r in written.collect()} == {("a", 0): (0, False), ("a", 1): (0, False), ("a", 2): (1, False), ("a", 3): (1, False), ("b", 0): (0, False), ("b", 1): (1, False), ("b", 2): (None, False), ("b", 3): (None, True)}
    totals = {r.stream: r for r in ingest.accounting(written, ["stream"]).collect()}
    assert totals["b"].submitted == 3 and totals["b"].written == 2 and totals["b"].dropped == 1 and totals["b"].accounted and totals["a"].n_chunks == 2


def test_stream_contract_stops_a_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", 1), ("a", 1)], "k string, seq bigint").coalesce(1).write.parquet(folder)
    stream = ingest.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
    with pytest.raises(Exception, match="breaks the contract"):
        ingest.ingest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", lambda b: checks.duplicate_keys(b, ["k", "seq"]))
    assert not os.path.exists(f"{tmp_path}/out")


def test_windows_and_fan_in(spark):
    both = ingest.fan_in({"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([(2,)], "b int")})
    assert {(r.stream_id, r.a, r.b) for r in both.collect()} == {("x", 1, None), ("y", None, 2)}
    events = spark.read.parquet(f"{SF}/events.parquet")
    made = ingest.rate_by_window(events, "ts", ["event_type"], "1 day", "1 hour")
    assert made.agg(F.sum("n")).first()[0] == events.count()


NS = 1787923530123456789


def test_folds_keep_nanoseconds_beside_nulls(spark):
    df = spark.createDataFrame([("s", 0, NS, 1, 9), ("s", 1, None, None, 9), ("s", 2, NS + 7, 3, 9), ("s", 3, NS + 8, 1, 9)], "k string, i bigint, t bigint, w bigint, chunk int")
    got = folds.chunks(df, ["k"], ["i"], ["w"], max_rows=4, max_age=8, time="t").orderBy("i").collect()
    assert [(r.t, r.w, r.chunk) for r in got] == [(NS, 1, 0), (None, None, 0), (NS + 7, 3, 0), (NS + 8, 1, 1)]
    marks = folds.periodic_marks(df, ["k"], ["i"], "t", 8).orderBy("i").collect()
    assert [(r.t, r.mark) for r in marks] == [(NS, True), (None, False), (NS + 7, False), (NS + 8, True)]
    edges = folds.debounced(df, ["k"], ["i"], "w", "t", 5).orderBy("i").collect()
    assert [r.edge for r in edges] == [False, True, True, False] or [r.edge for r in edges][0] is False


def test_stream_cuts_like_the_batch(spark, tmp_path):
    rows = [("a", i, NS + 3 * i if i % 5 else None, i % 3 if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, seq bigint, t bigint, w bigint")
    for part in range(4):
        df.where(f"seq div 10 = {part}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = ingest.file_stream(spark, f"file://{tmp_path}/in", "*.parquet", df.schema)
    made = ingest.chunked(stream, ["k"], "seq", ["w"], max_rows=7, max_age=10, time="t")
    ingest.ingest(made, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    want = folds.chunks(df, ["k"], ["seq"], ["w"], max_rows=7, max_age=10, time="t")
    as_set = lambda d: {(r.seq, r.t, r.w, r.chunk) for r in d.collect()}
    assert as_set(spark.read.parquet(f"file://{tmp_path}/out")) == as_set(want)


def test_terminations(spark):
    rows = [("a", 0, False, None), ("a", None, False, "CLEAN"), ("b", 0, False, None), ("c", None, False, "CLEAN"), ("c", None, True, None)]
    df = spark.createDataFrame(rows, "k string, chunk bigint, late boolean, status string")
    assert {r.k: r.status for r in ingest.terminations(df, ["k"], "status").collect()} == {"a": "CLEAN", "b": "DISCONNECTED", "c": "FAILED"}


def test_null_keys_equal_each_other(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k bigint, d string")
    right = spark.createDataFrame([(None, "y"), (2, "q"), (3, "w")], "k bigint, d string")
    assert {r.k for r in checks.orphans(left, right, ["k"]).collect()} == {1}
    assert {(r.k, r.side) for r in checks.presence(left, right, ["k"]).collect()} == {(1, "left_only"), (3, "right_only")}
    assert {(r.k, r.problem) for r in checks.sealed_mismatch(left, right, ["k"], "d").collect()} == {(1, "missing"), (2, "hash_mismatch"), (3, "unexpected")}
    sizes = spark.createDataFrame([(None, 2), (1, 0), (2, 1)], "k bigint, n bigint")
    assert {(r.k, r.expected, r.actual) for r in checks.row_totals(sizes, right, ["k"], "n").collect()} == {(None, 2, 1)}
    assert [r.matched for r in checks.unmatched_strict(left, right.select("k", F.col("d").alias("e")), ["k"]).orderBy("k").collect()] == [True, False, True]
    asked = spark.createDataFrame([(None, 5), (1, 5), (1, None)], "k bigint, t bigint")
    replies = spark.createDataFrame([(None, 5), (None, 7), (1, 9)], "k bigint, at bigint")
    assert {(r.k, r.t, r.reply) for r in checks.interval_match(asked, replies, ["k"], "t", "at", F.lit(3)).collect()} == {(None, 5, 5), (1, 5, None), (1, None, None)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70) | st.integers(0, 3000).map(lambda n: bytes(range(256)) * (n // 256) + bytes(n % 256)), max_size=6))
def test_checksums_of_many_equal_one_by_one(payloads):
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ canonical.POLYNOMIAL if crc & 1 else crc >> 1
        return crc ^ 0xFFFFFFFF

    assert canonical.crc32c_many(payloads).tolist() == [plain(p) for p in payloads]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 9) | st.just(2**62), st.integers(0, 9), st.none() | st.integers(-5, 60)), max_size=40), st.integers(-1, 14), st.none() | st.integers(0, 20), st.lists(st.integers(1, 7), max_size=12))
def test_chunks_by_runs_equal_chunks_by_rows(rows, max_rows, max_age, cuts):
    step, state, want = folds.chunk_step(max_rows, max_age, 2), None, []
    for row in rows:
        state, chunk = step(state, row)
        want.append(chunk)
    held, got, at = folds._Chunker(max_rows, max_age, 2), [], 0
    for size in [*cuts, len(rows)]:
        part, at = rows[at : at + size], at + size
        weights = np.array([[min(r[k] or 0, max(max_rows, 0) + 1) for r in part] for k in (0, 1)], np.int64).reshape(2, len(part))
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(weights, axis=1)], axis=1)
        timed = np.array([r[2] is not None for r in part], bool)
        times = np.array([r[2] or 0 for r in part], np.int64)
        got += held.take(sums, *((times, timed) if max_age is not None else (None, None))).tolist()
    assert got == want


def test_sealed_files_that_repeat_meet_in_pairs(spark, duck):
    """two listed and three found files of one name make six pairs, as in the query's full join; null names meet nothing there."""
    listed = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), (None, "x"), ("d", None)]
    found = [("a", "x"), ("a", "z"), ("a", "z"), ("c", "x"), ("c", "x"), (None, "x"), ("d", "x")]
    sides = [spark.createDataFrame(side, "k string, d string") for side in (listed, found)]
    got = collections.Counter(tuple(r) for r in checks.sealed_mismatch(*sides, ["k"], "d", nulls_meet=False).collect())
    values = [", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in row)})" for row in side) for side in (listed, found)]
    sql = f"""WITH s(k, h) AS (VALUES {values[0]}), a(k, h) AS (VALUES {values[1]})
    SELECT k, CASE WHEN a.h IS NULL THEN 'missing' WHEN s.h IS NULL THEN 'unexpected' ELSE 'hash_mismatch' END FROM s FULL JOIN a USING (k) WHERE a.h IS DISTINCT FROM s.h"""
    assert got == collections.Counter(duck.execute(sql).fetchall()) and got[("a", "hash_mismatch")] == 5
