"""Live ingest as Structured Streaming: fan-in, chunking with state, exact accounting, and a sink that writes a batch once.

Packets arrive as rows of several sources. Each stream's rows are numbered into chunks by the greedy rule of the batch
operator, with the sums of the open chunk as state. A control row ends a stream; what comes after it is kept apart as late and never
written, so that for every stream submitted = written + dropped can be measured, not derived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checks import observation_errors
from ..operators.folds import chunk_step
from ..operators.payloads import payload_findings


def fan_in(sources: dict[str, DataFrame]) -> DataFrame:
    """One stream of all sources, with ``stream_id``. Names are unique by construction; columns missing in one are null."""
    named = [df.withColumn("stream_id", F.lit(name)) for name, df in sorted(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def chunked(packets: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str], *, max_rows: int, max_age: float | None = None, time: str | None = None, control: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Rows with ``chunk`` and ``late``; works on streams and, as one batch, on tables.

    :param control: column that is not null in the row that ends a stream; that row is passed on, rows after it are late.
    :param idle_ms: an open chunk whose stream has been silent for so long is cut: the next row begins a new one. Only for
        queries that run on; with this a query that takes what is there and stops would never stop.

    Rows of a key are taken in the order of ``order`` within a micro-batch; a source must deliver them in order across batches. The state of a
    key is a few numbers.
    """
    # pandas has no integers with nulls: 64-bit columns cross as text and come back as they were.
    longs = [f.name for f in packets.schema.fields if isinstance(f.dataType, T.LongType)]
    texts = packets.withColumns({c: F.col(c).cast("string") for c in longs})
    schema = T.StructType([*texts.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("late", T.BooleanType())])
    step, names, needs = chunk_step(max_rows, max_age, len(weights)), schema.names, [*weights, *([time] if time else [])]
    fraction = time is not None and isinstance(packets.schema[time].dataType, (T.DoubleType, T.FloatType))
    held_state = f"chunk long, sums array<long>, since {'double' if fraction else 'long'}, full boolean, closed boolean"
    number = lambda column, v: None if v is None or v != v else int(v) if column in longs else v

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, closed = None, False
        if held.exists:
            chunk, sums, since, full, closed = held.get
            state = (chunk, list(sums), since, full) if sums is not None else None
        if held.hasTimedOut:
            if state is not None:
                held.update((state[0], state[1], state[2], True, closed))
            return
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.iloc[sorted(range(len(rows)), key=[(v is not None, v or 0) for v in (number(order, x) for x in rows[order])].__getitem__)]
        chunks, late = [], []
        controls = rows[control] if control else [None] * len(rows)
        for ends, *values in zip(controls, *(rows[n] for n in needs), strict=True):
            late.append(closed)
            if closed or ends is not None and ends == ends:
                closed = True
                chunks.append(None)
                continue
            state, chunk = step(state, [number(n, v) for n, v in zip(needs, values, strict=True)])
            chunks.append(chunk)
        held.update((*(state or (0, None, None, False)), closed))
        if idle_ms is not None and not closed:
            held.setTimeoutDuration(idle_ms)
        rows = rows.assign(chunk=pd.array(chunks, dtype="Int64"), late=late)
        yield rows[names]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    made = texts.groupBy(*keys).applyInPandasWithState(run, schema, held_state, "append", timeout)
    return made.withColumns({c: F.col(c).cast("bigint") for c in longs})


class _IdleChunks(StatefulProcessor):
    """Chunks of one stream: the open chunk's sums as typed state, and a timer that cuts it when the stream is silent."""

    def __init__(self, step: Callable, keys: Sequence[str], order: str, needs: Sequence[str], control: str | None, idle_ms: int, names: Sequence[str]):
        self.step, self.keys, self.order, self.needs, self.control, self.idle_ms, self.names = step, keys, order, needs, control, idle_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "chunk long, sums array<long>, since double, full boolean, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        state, closed = None, False
        if self.open.exists():
            chunk, sums, since, full, closed = self.open.get()
            state = (chunk, list(sums), since, full) if sums is not None else None if chunk == 0 and not full else (chunk, None, None, full)
        for row in sorted(rows, key=lambda r: (r[self.order] is not None, r[self.order] or 0)):
            late, chunk = closed, None
            if closed or self.control and row[self.control] is not None:
                closed = True
            else:
                state, chunk = self.step(state, [row[n] for n in self.needs])
            yield Row(**(row.asDict() | {"chunk": chunk, "late": late, "idle_cut": False}))
        chunk, sums, since, full = state or (0, None, None, False)
        self.open.update((chunk, sums, None if since is None else float(since), full, closed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not closed and sums is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        chunk, sums, since, full, closed = self.open.get()
        if sums is not None and not full and not closed:
            self.open.update((chunk, list(sums), since, True, closed))
            yield Row(**(dict.fromkeys(self.names) | dict(zip(self.keys, key, strict=True)) | {"chunk": chunk, "late": False, "idle_cut": True}))

    def close(self) -> None:
        pass


def idle_chunked(packets: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str], *, max_rows: int, idle_ms: int, max_age: float | None = None, time: str | None = None, control: str | None = None) -> DataFrame:
    """:func:`chunked` for a query that runs on, with typed state and a timer for each stream, and ``idle_cut``.

    A chunk that is open when its stream has been silent for ``idle_ms`` is cut at that time: one row with the stream's keys, the
    number of the chunk and ``idle_cut`` tells it at once, and the stream's next row begins a new chunk. Other columns of that row
    are null; it is no packet. A full chunk, and one of a stream that has ended, is not cut again. Integers cross as integers.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    schema = T.StructType([*packets.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("late", T.BooleanType()), T.StructField("idle_cut", T.BooleanType())])
    needs = [*weights, *([time] if time else [])]
    processor = _IdleChunks(chunk_step(max_rows, max_age, len(weights)), list(keys), order, needs, control, idle_ms, packets.columns)
    return packets.groupBy(*keys).transformWithState(processor, schema, "append", "ProcessingTime")


def write_once(path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each micro-batch is a partition of its number, so a batch that runs again replaces itself.

    :param check: gives the violating rows of a batch; any such row stops the query before it is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if check is not None and not check(batch).isEmpty():
                raise ValueError(f"batch {number} breaks the contract of its rows")
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return write


def row_gate(*checks: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One check for :func:`write_once` from several, each a function from rows to those that break it; any broken rule stops the batch."""
    return lambda batch: reduce(DataFrame.unionByName, [check(batch).select(F.lit(i).alias("check")) for i, check in enumerate(checks)])


def payload_gate(registry: DataFrame, keys: Sequence[str], payload: str) -> Callable[[DataFrame], DataFrame]:
    """Rows whose payload breaks its schema: what is not declared is not written (see :func:`.payloads.payload_findings`)."""
    return lambda batch: payload_findings(batch, registry, keys, payload)


def observation_gate(domains: dict[str, Sequence[str]], value_columns: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Observation rows that verification would find: the same rule at the time of writing."""
    return lambda batch: batch.withColumn("error", observation_errors(batch, domains, value_columns)).where("error is not null")


def ingest(stream: DataFrame, path: str, checkpoint: str, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take all that is there now, write it and stop; the next call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(write_once(path, check)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def accounting(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, submitted, written, dropped, n_chunks, accounted) measured from the rows that :func:`chunked` passed on."""
    made = written.groupBy(*keys).agg(F.count("*").alias("submitted"), F.count_if(F.col("chunk").isNotNull()).alias("written"), F.count_if("late").alias("dropped"), F.count_distinct("chunk").alias("n_chunks"), F.count_if(F.col("chunk").isNull() & ~F.col("late")).alias("ends"))
    return made.withColumn("submitted", F.col("submitted") - F.col("ends")).drop("ends").withColumn("accounted", F.expr("submitted = written + dropped"))


def terminations(written: DataFrame, keys: Sequence[str], control: str) -> DataFrame:
    """(keys, status): how each stream ended: what its end row says; FAILED where rows came after it; DISCONNECTED without one."""
    ends = F.max(F.when(F.col("chunk").isNull() & ~F.col("late"), F.col(control)))
    made = written.groupBy(*keys).agg(ends.alias("said"), F.bool_or("late").alias("overrun"))
    return made.select(*keys, F.when(F.col("overrun"), "FAILED").otherwise(F.coalesce("said", F.lit("DISCONNECTED"))).alias("status"))


def rate_by_window(packets: DataFrame, time: str, keys: Sequence[str], window: str, lateness: str) -> DataFrame:
    """(keys, window start, n) in event time; a window closes when no row of it can come any more within ``lateness``."""
    rows = packets.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", window).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, *, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; the number of files a batch is the back-pressure."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
