"""An index from packet numbers to the bytes of their frames, kept beside the payload logs, and reads of single frames."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import HEADER, HEADER_BYTES, MAGIC, crc32c_many
from .logs import open_input

#: Logs that one task reads.
FILES_PER_TASK = 128
#: Frames whose checksums are computed together.
_TOGETHER = 256


def frame_places(uri: str) -> Iterator[tuple[int | None, int, int | None, str | None]]:
    """(packet number, offset, payload bytes, error) of the frames of a log; what stops the reading is a last row with an error.

    The log is read once from its start, a group of frames at a time.
    """
    with open_input(uri) as source:
        size, at, error = source.size(), 0, None
        while at < size and error is None:
            group: list[tuple[int, int, bytes, int]] = []
            while at < size and error is None and len(group) < _TOGETHER:
                head = source.read(HEADER_BYTES)
                if len(head) < HEADER_BYTES:
                    error = "torn_header"
                    break
                magic, seq, length = struct.unpack(HEADER, head)
                if magic != MAGIC or at + HEADER_BYTES + length + 4 > size:
                    error = "bad_magic" if magic != MAGIC else "torn_payload"
                    break
                group.append((seq, at, source.read(length), struct.unpack("<I", source.read(4))[0]))
                at += HEADER_BYTES + length + 4
            sums = crc32c_many([payload for _, _, payload, _ in group]).tolist()
            for (seq, place, payload, stored), found in zip(group, sums, strict=True):
                if stored != found:
                    at, error = place, "bad_crc"
                    break
                yield seq, place, len(payload), None
        if error:
            yield None, at, None, error


def frame_table(files: DataFrame, keys: Sequence[str], *, uri: str = "uri") -> DataFrame:
    """(keys, uri, packet_seq, at, n_bytes, error) of the frames of the logs in ``files``; a task reads a log from its start, as frames have no marks to begin at."""
    named = files.where(F.col(uri).isNotNull()).select(*keys, F.col(uri).alias("uri"))
    schema = T.StructType([*named.schema.fields, *T._parse_datatype_string("packet_seq bigint, at bigint, n_bytes bigint, error string").fields])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, where in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                held: list[tuple] = []
                for found in frame_places(where):
                    held.append(found)
                    if len(held) == 65536:
                        yield made(batch, row, held)
                        held = []
                if held:
                    yield made(batch, row, held)

    def made(batch: pa.RecordBatch, row: int, held: list[tuple]) -> pa.RecordBatch:
        front = [c.take(pa.array([row] * len(held))) for c in batch.columns]
        seq, at, length, error = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*front, pa.array(seq, pa.int64()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(error, pa.string())], names=schema.names)

    # A row names a whole log: a number of tasks of our own, as Spark would put the small rows into one.
    return named.repartition(named.count() // FILES_PER_TASK + 1, "uri").mapInArrow(read, schema)


def write_frame_index(files: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write the index of the frames of ``files``: (keys, packet_seq, uri, at, n_bytes, n_frames), one row a number.

    Of frames that repeat a number the first counts, in the order of files and offsets; ``n_frames`` says how many there are. Rows lie in
    ranges of keys and numbers, so that a lookup reads the files and row groups that can hold them.
    """
    good = frame_table(files, keys).where("error is null")
    first = good.groupBy(*keys, "packet_seq").agg(F.min(F.struct("uri", "at", "n_bytes")).alias("f"), F.count("*").alias("n_frames"))
    order = [*keys, "packet_seq"]
    first.select(*order, "f.*", "n_frames").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


@F.arrow_udf(T.BinaryType())
def payload_at(uri: pa.Array, at: pa.Array, n_bytes: pa.Array) -> pa.Array:
    """Payload of the frame at an offset of a log, read alone; null where its bytes are no longer a whole frame of that length."""
    payloads: list[bytes | None] = []
    stored: list[int] = []
    opened, name = None, None
    for where, place, length in zip(uri.to_pylist(), at.to_pylist(), n_bytes.to_pylist(), strict=True):
        payload, crc = None, 0
        if where is not None and place is not None and length is not None:
            if where != name:
                if opened is not None:
                    opened.close()
                opened, name = open_input(where), where
            opened.seek(place)
            data = opened.read(HEADER_BYTES + length + 4)
            if len(data) == HEADER_BYTES + length + 4 and struct.unpack_from(HEADER, data)[::2] == (MAGIC, length):
                payload, crc = data[HEADER_BYTES:-4], struct.unpack("<I", data[-4:])[0]
        payloads.append(payload)
        stored.append(crc)
    if opened is not None:
        opened.close()
    found = crc32c_many([p or b"" for p in payloads]).tolist()
    return pa.array([p if p is not None and c == s else None for p, c, s in zip(payloads, found, stored, strict=True)], pa.binary())


def lookup_frames(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` (keys, packet_seq, more) with at, n_bytes, n_frames and payload; null where the index has no such number."""
    index = spark.read.parquet(path)
    met = wanted.join(index, [*keys, "packet_seq"], "left")
    # Frames of one log are read one after another.
    met = met.sortWithinPartitions("uri", "at")
    return met.withColumn("payload", payload_at(F.col("uri"), F.col("at"), F.col("n_bytes"))).drop("uri")
