"""Rows that producers push, as a stream: a spool of numbered Arrow files for each producer, with admission by producer.

A producer appends files to its own folder of the spool; a file appears only when whole and its number is its place. An
offset is the number of files taken of each producer, so several producers make one query without waiting for each other, and
a batch that runs again reads the same files. A batch takes at most ``bytes_per_producer`` of each, or ``files_per_producer`` files
where that is given: a fast producer does not crowd out a slow one, and what waits stays in the spool. Batches follow from the
size of a backlog, not from how many small files it came in.

    spark.dataSource.register(PushedPackets)
    spark.readStream.format("pushed_packets").schema(schema).option("spool", path).option("progress", file).load()
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of files that a batch takes of one producer, one file at least.
BYTES_PER_PRODUCER = 8 << 20
#: Files of a producer that one task reads.
FILES_PER_TASK = 256


def _files(folder: str) -> int:
    """Files of a producer that follow each other from number 0; what stands behind a gap is not there yet."""
    numbers = sorted(int(n.removesuffix(".arrow")) for n in os.listdir(folder) if n.endswith(".arrow") and n.removesuffix(".arrow").isdigit())
    return next((i for i, n in enumerate(numbers) if i != n), len(numbers))


class Producer:
    """One producer of a spool; each producer is one process, which goes on after its last file when it starts again."""

    def __init__(self, spool: str, name: str):
        self.folder = os.path.join(spool.removeprefix("file://"), name)
        os.makedirs(self.folder, exist_ok=True)
        self.next = _files(self.folder)

    def push(self, rows: pa.Table) -> int:
        """Append rows as one file; gives its number."""
        part = os.path.join(self.folder, f"{uuid.uuid4().hex}.part")
        with pa.OSFile(part, "wb") as out, pa.ipc.new_stream(out, rows.schema) as stream:
            stream.write_table(rows)
        os.rename(part, os.path.join(self.folder, f"{self.next:012d}.arrow"))
        self.next += 1
        return self.next - 1


@dataclass
class PushedFiles(InputPartition):
    producer: str
    first: int
    end: int


class PushReader(DataSourceStreamReader):
    def __init__(self, spool: str, progress: str | None, limit: int | None, schema: T.StructType, n_bytes: int = BYTES_PER_PRODUCER):
        self.spool, self.progress, self.limit, self.schema, self.n_bytes = spool.removeprefix("file://"), progress and progress.removeprefix("file://"), limit, schema, n_bytes
        self.at: dict[str, int] = {}
        # What an earlier run has planned: a query that starts again admits from there, not all that waits at once.
        if self.progress and os.path.exists(self.progress):
            with open(self.progress) as source:
                self.at = json.load(source)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        there = {name: _files(os.path.join(self.spool, name)) for name in sorted(os.listdir(self.spool))} if os.path.isdir(self.spool) else {}
        return self.at | {name: max(self.at.get(name, 0), self._admitted(name, self.at.get(name, 0), n)) for name, n in there.items()}

    def _admitted(self, name: str, first: int, n: int) -> int:
        """Files of a producer that the next batch ends before, of ``n`` that are there."""
        if self.limit is not None:
            return min(n, first + self.limit)
        end, left = first, self.n_bytes
        while end < n and (left := left - os.stat(os.path.join(self.spool, name, f"{end:012d}.arrow")).st_size) >= 0:
            end += 1
        return min(n, max(end, first + 1))

    def partitions(self, start: dict, end: dict) -> list[PushedFiles]:
        self.at = {name: max(n, self.at.get(name, 0)) for name, n in end.items()}
        if self.progress:
            part = f"{self.progress}.{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(part), exist_ok=True)
            with open(part, "w") as out:
                json.dump(self.at, out)
            os.replace(part, self.progress)
        return [PushedFiles(name, first, min(first + FILES_PER_TASK, n)) for name, n in sorted(end.items()) for first in range(start.get(name, 0), n, FILES_PER_TASK)]

    def read(self, partition: PushedFiles) -> Iterator[pa.RecordBatch]:
        fields = [f for f in self.schema.fields if f.name != "producer"]
        for number in range(partition.first, partition.end):
            with pa.OSFile(os.path.join(self.spool, partition.producer, f"{number:012d}.arrow")) as source, pa.ipc.open_stream(source) as stream:
                for batch in stream:
                    made = {"producer": pa.array([partition.producer] * batch.num_rows, pa.string())}
                    for f in fields:
                        kind = to_arrow_type(f.dataType)
                        made[f.name] = batch.column(f.name).cast(kind) if f.name in batch.schema.names else pa.nulls(batch.num_rows, kind)
                    yield pa.RecordBatch.from_arrays([made[n] for n in self.schema.names], names=self.schema.names)

    def commit(self, end: dict) -> None:
        """Files stay in the spool: it is the record of what was pushed."""


class PushedPackets(DataSource):
    """Options: ``spool``; ``progress``, a file of this query beside its checkpoint; ``files_per_producer`` or ``bytes_per_producer``. A column ``producer`` is filled in."""

    @classmethod
    def name(cls) -> str:
        return "pushed_packets"

    def schema(self) -> str:
        raise ValueError("pushed_packets needs the schema of its rows")

    def streamReader(self, schema: T.StructType) -> PushReader:  # noqa: N802
        files = self.options.get("files_per_producer")
        return PushReader(self.options["spool"], self.options.get("progress"), int(files) if files else None, schema, int(self.options.get("bytes_per_producer", BYTES_PER_PRODUCER)))


def pushed_stream(spark: SparkSession, spool: str, schema: T.StructType | str, *, progress: str | None = None, files_per_producer: int | None = None, bytes_per_producer: int = BYTES_PER_PRODUCER) -> DataFrame:
    """The rows of all producers of a spool as one stream."""
    spark.dataSource.register(PushedPackets)
    reader = spark.readStream.format("pushed_packets").schema(schema).option("spool", spool).option("bytes_per_producer", bytes_per_producer)
    reader = reader if files_per_producer is None else reader.option("files_per_producer", files_per_producer)
    return (reader.option("progress", progress) if progress else reader).load()
