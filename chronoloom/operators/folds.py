"""Ordered folds: state machines over the records of a session or stream.

Short logs (annotations, lifecycle records of a session) fold in an array expression. Series without a bound are sorted
inside their partition and folded with one state a key in memory, whatever the length of a series: chunks a chunk at a
time, other states row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The downgrades that an annotation may make.
PERMITTED = (("COMPLETED", "ABORTED"), ("COMPLETED", "TECHNICAL_FAILURE"), ("UNCLASSIFIED", "ABORTED"), ("UNCLASSIFIED", "TECHNICAL_FAILURE"))
#: The transitions of a session's life.
LIFECYCLE = (("ALLOCATED", "RECORDING"), ("ALLOCATED", "FINALIZING"), ("RECORDING", "FINALIZING"), ("FINALIZING", "CLOSED"))


def pair_in(a: Column, b: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return F.concat_ws(">", a, b).isin(*[f"{x}>{y}" for x, y in pairs])


def effective_outcome(records: DataFrame, keys: Sequence[str], position: str, source: str, target: str, sealed: str, *, pairs: Sequence[tuple[str, str]] = PERMITTED, forbidden: str = "COMPLETED") -> DataFrame:
    """(keys, sealed, outcome, accepted, rejected): annotations applied in file order to the sealed outcome.

    Refused, in this order of reasons: a target that may not be made, a source that is not the running outcome, a
    transition that is not permitted. A refused record leaves the outcome as it is. ``rejected`` lists (position, reason).
    """
    log = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(source).alias("f"), F.col(target).alias("t"))))
    grouped = records.groupBy(*keys).agg(F.min_by(sealed, position).alias("sealed"), log.alias("log"))
    allowed = ", ".join(f"'{x}>{y}'" for x, y in pairs)
    fold = f"""aggregate(log, struct(sealed as outcome, 0L as accepted, cast(array() as array<struct<at:bigint,reason:string>>) as rejected),
      (acc, x) -> transform(array(case when x.t = '{forbidden}' then 'TARGET_COMPLETED' when not (x.f <=> acc.outcome) then 'STALE_FROM'
          when concat(x.f, '>', x.t) in ({allowed}) then null else 'TRANSITION_NOT_PERMITTED' end),
        r -> struct(if(r is null, x.t, acc.outcome) as outcome, acc.accepted + if(r is null, 1L, 0L) as accepted,
          if(r is null, acc.rejected, concat(acc.rejected, array(struct(cast(x.at as bigint) as at, r as reason)))) as rejected))[0])"""
    return grouped.withColumn("r", F.expr(fold)).select(*keys, "sealed", "r.outcome", "r.accepted", "r.rejected")


def last_record(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the last record of each key, by position."""
    return df.groupBy(*keys).agg(*[F.max_by(c, position).alias(c) for c in columns])


def invalid_transitions(df: DataFrame, keys: Sequence[str], position: str, state: str, pairs: Sequence[tuple[str, str]] = LIFECYCLE) -> DataFrame:
    """Records whose state may not follow the one before."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(position))
    return df.withColumn("from_state", before).where(F.col("from_state").isNotNull() & ~pair_in(F.col("from_state"), F.col(state), pairs))


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], needs: Sequence[str], start: Callable[[], object], step: Callable, added: str) -> DataFrame:
    """Rows with the column ``added`` (name and type) that ``step(state, values) -> (state, made)`` gives in the order of each key.

    ``values`` are those of ``needs``, as Python values, None for null. Each key's rows arrive sorted in one stream of batches;
    what is held is a batch and the state of the key at hand. All other columns pass as they are. A column named like the
    added one is replaced.
    """
    name, kind = added.split()
    df = df.drop(name)
    schema, at = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields]), df.columns.index
    arrow = {"long": pa.int64(), "boolean": pa.bool_()}[kind]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            made = []
            named = zip(*(batch.column(at(k)).to_pylist() for k in keys), strict=True)
            values = zip(*(batch.column(at(n)).to_pylist() for n in needs), strict=True)
            for key, value in zip(named, values, strict=True):
                if key != last:
                    last, state = key, start()
                state, result = step(state, value)
                made.append(result)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def chunk_step(max_rows: int, max_age: float | None, n_weights: int) -> Callable:
    """Step of greedy chunking over (weights, time): a chunk is cut before a row that would take any weight's sum over ``max_rows``.

    A row that is too heavy alone is a chunk of its own. With ``max_age`` a chunk also ends with the row at which it
    is so old. ``max_rows`` of 0 or less sets no bound on rows. A null weight counts as 0, a null time has no age. State:
    (chunk, sums, first time, full).
    """

    def step(state, values):
        chunk, sums, since, full = state or (0, None, None, False)
        add, time = [int(w or 0) for w in values[:n_weights]], values[n_weights] if len(values) > n_weights else None
        if sums is not None and (full or max_rows > 0 and any(s + a > max_rows for s, a in zip(sums, add, strict=True))):
            chunk, sums = chunk + 1, None
        if sums is None:
            sums, since = [0] * len(add), None
        since = time if since is None else since
        sums = [s + a for s, a in zip(sums, add, strict=True)]
        full = max_age is not None and time is not None and time - since >= max_age
        return (chunk, sums, since, full), chunk

    return step


def _runs(batch: pa.RecordBatch, keys: Sequence[int]) -> np.ndarray:
    """Places where a run of rows with equal keys begins, nulls being equal, and the number of rows at the end."""
    edge = np.zeros(batch.num_rows + 1, bool)
    edge[[0, -1]] = True
    for k in keys:
        column = batch.column(k)
        here, before = column.slice(1), column.slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        edge[1:-1] |= differ | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
    return np.flatnonzero(edge)


class _Chunker:
    """Greedy chunking of one key's rows in runs: a step finds the end of a chunk in sums over the run, so steps are as many as chunks.

    Agrees with :func:`chunk_step` for weights that are not negative.
    """

    def __init__(self, max_rows: int, max_age: float | None, n_weights: int):
        self.max_rows, self.max_age = max_rows, max_age
        self.chunk, self.sums, self.since, self.full = -1, np.zeros(n_weights, np.int64), None, True

    def take(self, sums: np.ndarray, times: np.ndarray | None, timed: np.ndarray | None) -> np.ndarray:
        """Chunks of the next rows; ``sums`` are running sums of their weights, one row more than there are rows."""
        n = sums.shape[1] - 1
        out, at = np.empty(n, np.int64), 0
        while at < n:
            fresh = self.full
            if fresh:
                self.chunk, self.since, self.full = self.chunk + 1, None, False
                self.sums[:] = 0
            end = n
            if self.max_rows > 0:
                # The first row of a chunk is in it, however heavy.
                ends = [int(np.searchsorted(p[1:], self.max_rows - s + p[at], "right")) for p, s in zip(sums, self.sums.tolist(), strict=True)]
                end = min([n, *(max(e, at + fresh) for e in ends)])
            cut = end < n
            if times is not None and end > at:
                here, known = times[at:end], timed[at:end]
                if self.since is None and known.any():
                    self.since = here[known.argmax()]
                if self.since is not None:
                    old = known & (here - self.since >= self.max_age)
                    if old.any():
                        end, cut = at + int(old.argmax()) + 1, True
            out[at:end] = self.chunk
            self.sums += sums[:, end] - sums[:, at]
            self.full, at = cut, end
        return out


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Sequence[str], *, max_rows: int, max_age: float | None = None, time: str | None = None) -> DataFrame:
    """Rows with ``chunk``, from 0 in each key, by greedy chunking at row boundaries (see :func:`chunk_step`).

    Weights are not negative; ``time`` is a number. Rows stay in Arrow batches; Python takes a step for each chunk.
    """
    df = df.drop("chunk")
    schema, at = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())]), df.columns.index
    key_at, weight_at, time_at = [at(k) for k in keys], [at(w) for w in weights], at(time) if time and max_age is not None else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.zeros((len(weight_at), batch.num_rows + 1), np.int64)
            for row, w in zip(sums, weight_at, strict=True):
                # A weight above the bound fills a chunk, whatever it is: cut down, sums stay in 64 bits.
                whole = pc.fill_null(batch.column(w).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                if (whole < 0).any():
                    raise ValueError("a weight of a chunk is negative")
                np.cumsum(np.minimum(whole, max(max_rows, 0) + 1), out=row[1:])
            times = timed = None
            if time_at is not None:
                column = batch.column(time_at)
                timed = column.is_valid().to_numpy(zero_copy_only=False)
                times = pc.fill_null(column, pa.scalar(0, column.type)).to_numpy(zero_copy_only=False)
            made, edges = np.empty(batch.num_rows, np.int64), _runs(batch, key_at)
            for first, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = tuple(batch.column(k)[first].as_py() for k in key_at)
                if held is None or key != last:
                    last, held = key, _Chunker(max_rows, max_age, len(weight_at))
                made[first:end] = held.take(sums[:, first : end + 1], *(x if x is None else x[first:end] for x in (times, timed)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def periodic_marks(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, interval: float) -> DataFrame:
    """Rows with ``mark``: true at the first row and whenever ``interval`` or more has passed since the last mark.

    An interval of 0 or less sets no marks, and neither does a row without a time.
    """

    def step(last, values):
        due = interval > 0 and values[0] is not None and (last is None or values[0] - last >= interval)
        return (values[0] if due else last), due

    return fold_rows(df, keys, order, [time], lambda: None, step, "mark boolean")


def debounced(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, time: str, hold: float) -> DataFrame:
    """Rows with ``edge``: true where the level changes more than ``hold`` after the last accepted edge.

    Null is a level of its own; a row without a time is no edge once one has been accepted.
    """

    def step(state, values):
        now, at = values
        before, last = state or (now, None)
        edge = now != before and (last is None or at is not None and at - last > hold)
        return (now, at if edge else last), edge

    return fold_rows(df, keys, order, [level, time], lambda: None, step, "edge boolean")
