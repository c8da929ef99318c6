"""Token ids as binary files: frequency-ranked ids, byte-aligned lengths, control bytes kept apart.

A file holds blocks. A block is ``MAGIC``, four little-endian u64 (documents, values, control bytes, data bytes),
then the document ids (i64), their null flags (u8), the values per document (i64), the control bytes and the data
bytes. A value is the rank of a token id by falling frequency, in 1 to 4 little-endian bytes; four 2-bit lengths
(less one) share a control byte, lowest bits first. The 256 most frequent ids so take one byte each. ``ranks.ids``
beside the files holds the token id of every rank as little-endian u32.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, open_filesystem, publish

MAGIC = b"CLTOKEN1"
HEADER = struct.Struct("<8s4Q")
#: Value lengths of each control byte: the table that decoding looks up.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2)[None, :] & 3).astype(np.uint8) + 1
#: Pieces remembered by a worker before it starts over.
CACHE = 300_000
#: Characters of texts that are encoded at once, about: each distinct piece is looked up once in them.
UNIT = 4 << 20
#: Bytes of ids a file holds before the next one begins.
FILE_BYTES = 64 << 20
#: White space besides the plain space and line feed.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Marks of pieces, characters that no cut text holds: start of a text, start of a later piece, end of a text, a lone stop.
HEAD, CUT, END, STOP = "\x00", "\x01", "\x02", "\x03"
_MARKED = re.compile("[\x00-\x03]")
#: One mark between a letter and a space: a token piece of its own, as letters and marks are never joined.
_STOP = re.compile("[.,;:!?](?<=[A-Za-z\xdf-\xf6\xf8-\xff].)(?=[ \n])")
#: Pieces that are encoded in one go.
TOGETHER = 60
_ENCODERS: dict = {}


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is known to encode the pieces between lone spaces each for itself.

    So do byte-level pair encodings that cut words by the usual pattern, put no space in front and do not rewrite texts.
    """
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    cut = made.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    bare = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in made.get("added_tokens") or [])
    return plain and bare and made.get("normalizer") is None and (made.get("model") or {}).get("type") == "BPE"


class PieceEncoder:
    """Encodes whole texts piece by piece, each distinct piece once.

    Byte-level pre-tokenisation never joins text across a single space or line feed between two other characters, so
    the pieces between such places encode alone. A piece keeps what stands in front of it: a space (not written), a line feed
    or the start of the text. Pieces without white space are learned in long lines and told apart by their tokens' lengths.
    With any other tokenizer a text is one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cuts = Tokenizer.from_file(path), splits_at_spaces(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.token_bytes = np.zeros(size, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)  # byte-level tokens have a character for each byte
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known when there was too much of it

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        known, width, apart = self.known, self.kind.itemsize, []
        words = []
        for piece in pieces:
            if piece[:1] in ("\n", HEAD, STOP, ""):
                apart.append((piece, piece.lstrip(HEAD + STOP)))
            elif not piece.isalnum() and (" " in piece or "\n" in piece or _OTHER_SPACE.search(piece)):
                apart.append((piece, " " + piece))
            else:
                words.append(piece)
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            line = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
            sizes = np.fromiter(map(len, some if line.isascii() else map(str.encode, some)), np.int64, len(some)) + 1
            ends, reached = np.cumsum(sizes), np.cumsum(self.token_bytes[ids])
            last = np.searchsorted(reached, ends)
            if not len(ids) or reached[-1] != ends[-1] or (reached[last] != ends).any():
                apart += [(p, " " + p) for p in some]
                continue
            packed, stops = ids.tobytes(), ((last + 1) * width).tolist()
            known.update(zip(some, map(packed.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        for at in range(0, len(apart), 10_000):
            some = apart[at : at + 10_000]
            known.update(zip([p for p, _ in some], self._each([t for _, t in some]), strict=True))

    def cut(self, text: str) -> str | None:
        """The text with its pieces marked, a mark of its start in front and of its end behind; None where it cannot be cut."""
        if not self.cuts or _MARKED.search(text):
            return None
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or _OTHER_SPACE.search(text):
            return f"{HEAD}{_LONE_SPACE.sub(CUT, text)}{CUT}{END}"
        text = _STOP.sub(CUT + STOP + "\\g<0>", text)
        return f"{HEAD}{text.replace(' ', CUT).replace(chr(10), CUT + chr(10))}{CUT}{END}"

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` behind; ids of each text)."""
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        end, marked, whole = np.array([end_id], self.kind).tobytes(), [self.cut(t) for t in texts], []
        for i, m in enumerate(marked):
            if m is None:
                marked[i] = f"{HEAD}{i}{END}"  # no piece of a cut text looks like this
                whole.append(marked[i])
                self.known[marked[i]] = self._each([texts[i]])[0] + end
        pieces = pc.split_pattern(pa.array(marked, pa.large_string()), CUT)
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        known[END] = end
        fresh = list(filterfalse(known.__contains__, names))
        if self.before:
            old = list(filter(self.before.__contains__, fresh))
            known.update(zip(old, map(self.before.__getitem__, old), strict=True))
            fresh = list(filterfalse(self.before.__contains__, fresh))
        self._learn(fresh)
        found = [known[name] for name in names]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        flat, at = np.frombuffer(b"".join(found), self.kind), coded.indices.to_numpy()
        lengths = sizes[at]
        stops = np.cumsum(lengths)
        kind = np.int32 if len(flat) + stops[-1] < 1 << 31 else np.int64
        places = np.repeat(((np.cumsum(sizes) - sizes)[at] - stops + lengths).astype(kind), lengths)
        places += np.arange(len(places), dtype=kind)
        of_text = np.concatenate([[0], stops])[pieces.offsets.to_numpy()]
        for name in whole:
            del known[name]
        return flat[places], np.diff(of_text)


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Drop the tokenizers of this process and the pieces they have learned."""
    _ENCODERS.clear()


def units(sizes: list[int]) -> Iterator[slice]:
    """Slices of texts of these sizes, about ``UNIT`` characters each, of one text at least."""
    first = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= UNIT:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def encoded(batches: Iterable[pa.RecordBatch], tool: PieceEncoder, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, ids of all texts, ids of each text) of units of the batches (document id, text).

    Workers outlive their tasks: what Arrow has kept of a unit's memory is given back after each.
    """
    for batch in batches:
        for some in units(pc.utf8_length(batch.column(1)).to_pylist()):
            rows = batch.slice(some.start, some.stop - some.start)
            ids, counts = tool.encode(rows.column(1).to_pylist(), end_id)
            pa.default_memory_pool().release_unused()
            yield rows.column(0), ids, counts


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of u32 values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    starts, out = ends - size, np.zeros(n, np.uint32)
    for byte in range(4):
        at = np.flatnonzero(size > byte)
        if not len(at):
            break
        out[at] |= data[starts[at] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def pack_block(ids: list[int | None], counts: np.ndarray, values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    head = HEADER.pack(MAGIC, len(ids), len(values), len(control), len(data))
    plain = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
    missing = np.array([i is None for i in ids], np.uint8).tobytes()
    return b"".join([head, plain, missing, counts.astype("<i8").tobytes(), control, data])


def blocks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, values per document, values) of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, n_control, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no token block at byte {at}")
        at += HEADER.size
        take = lambda kind, count: np.frombuffer(content, kind, count, at)
        ids = take("<i8", docs).tolist()
        at += 8 * docs
        ids = [None if gone else i for i, gone in zip(ids, take(np.uint8, docs).tolist(), strict=True)]
        at += docs
        counts = take("<i8", docs)
        at += 8 * docs
        control = take(np.uint8, n_control)
        at += n_control
        values = decode_values(control, take(np.uint8, n_data), n)
        at += n_data
        yield ids, counts, values


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(counts)
    return zip((ends - counts).tolist(), ends.tolist(), strict=True)


def write_token_files(
    docs: DataFrame,
    uri: str,
    tokenizer_path: str,
    end_id: int,
    *,
    order: list[Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of whole texts, each followed by ``end_id``, to token files under ``uri``.

    :param order: sort columns of the documents across the files; by default ``id_col``. Ties go by a hash of the
        text. Nulls come first.

    A null text is empty: its document holds ``end_id`` alone. A null id is kept as null. Repeated rows are each
    written. An empty table gives no token file. One pass tokenises and counts, a second ranks and packs; each file
    is written by one task, holds about ``FILE_BYTES`` of ids or one unit of texts, and appears only when whole, so lost
    tasks are simply run again. Any tokenizer file will do; those that :func:`splits_at_spaces` knows are fast.
    """
    spark = docs.sparkSession
    keys = order or [F.col(id_col)]
    named = [k.alias(f"o{i}") for i, k in enumerate(keys)]
    cols = [f"o{i}" for i in range(len(keys))]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *named)
    dealt = rows.repartitionByRange(*cols).sortWithinPartitions(*cols, F.xxhash64("t")).select("id", "t")

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen, width, number = np.zeros(1 << 16, np.int64), tool.kind.itemsize, 0
        schema = pa.schema([("id", pa.int64()), ("ids", pa.large_binary())])

        def frames() -> Iterator[bytes]:
            nonlocal seen
            for names, ids, counts in encoded(batches, tool, end_id):
                found = np.bincount(ids)
                if len(found) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(found) - len(seen), np.int64)])
                seen[: len(found)] += found
                stops = np.concatenate([[0], np.cumsum(counts)]) * width
                coded = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(ids)])
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(pa.record_batch([names, coded], schema=schema))
                frame = out.getvalue().to_pybytes()
                yield struct.pack("<Q", len(frame)) + frame, len(ids) * width

        def chunks(held: bytes, size: int) -> Iterator[bytes]:
            """Frames from ``held`` on until a file is full; what comes next is left in ``after``."""
            nonlocal after
            while held is not None:
                yield held
                held, more = next(source, (None, 0))
                if size + more > FILE_BYTES:
                    break
                size += more
            after = (held, more) if held is not None else None

        source = frames()
        after = next(source, None)
        while after is not None:
            publish(f"{uri}/raw/{part:07d}-{number:05d}.ids", chunks(*after))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([0])], names=["part", "token", "n"])
            number += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), -1)), pa.array(used), pa.array(seen[used])], names=["part", "token", "n"])

    counted = materialize(dealt.mapInArrow(tokenise, "part bigint, token bigint, n bigint"), "token-counts")
    # One row per id of the vocabulary at most, whatever the input.
    ranked = counted.where("part < 0").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token")
    by_rank = np.array([r.token for r in ranked.collect()], np.int64)
    publish(f"{uri}/ranks.ids", [by_rank.astype("<u4").tobytes()])
    if not len(by_rank):
        return
    rank_of = np.zeros(int(by_rank.max()) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_filesystem(uri)
        kind, written = encoder(tokenizer_path).kind, []
        for part, number in (p for b in batches for p in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            raw, done = f"{base}/raw/{part:07d}-{number:05d}.ids", f"{part:07d}-{number:05d}.tok"
            if filesystem.get_file_info(raw).type.name != "File":
                continue  # packed by an earlier attempt

            def packed(raw: str = raw) -> Iterator[bytes]:
                with filesystem.open_input_stream(raw) as source:
                    while head := source.read(8):
                        frame = pa.ipc.open_stream(source.read(struct.unpack("<Q", head)[0])).read_next_batch()
                        _, stops, data = frame.column(1).buffers()
                        counts = np.diff(np.frombuffer(stops, np.int64, frame.num_rows + 1)) // kind.itemsize
                        yield pack_block(frame.column(0).to_pylist(), counts, rank_of[np.frombuffer(data, kind, int(counts.sum()))])

            publish(f"{uri}/{done}", packed())
            filesystem.delete_file(raw)
            written.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.int64())], names=["part"])

    files = counted.where("part >= 0").select("part", F.col("token").alias("number"))
    files.repartition(files.count(), "part", "number").mapInArrow(pack, "part bigint").count()


def _scan(spark: SparkSession, uri: str, row, schema: str) -> DataFrame:
    """Rows that ``row(ids of a document)`` makes, with part, place in the part and ``within`` (ids before it there)."""
    filesystem, base = open_filesystem(uri)
    with filesystem.open_input_stream(f"{base}/ranks.ids") as source:
        by_rank = np.frombuffer(source.read(), "<u4")
    names = ["part", "place", "doc_id", "within", "n_tokens", *[f.split()[0] for f in schema.split(", ")]]
    full = f"part bigint, place bigint, doc_id bigint, within bigint, n_tokens bigint, {schema}"
    if not any(f.path.endswith(".tok") for f in filesystem.get_file_info(fs.FileSelector(base))):
        return spark.createDataFrame([], full)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()  # reading needs none, and the worker lives on
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rpartition("/")[2]
                part, place, within = int(name[:7]) * 100_000 + int(name[8:13]), 0, 0
                for ids, counts, values in blocks(memoryview(content.as_buffer())):
                    tokens = by_rank[values]
                    made = [row(tokens[a:b]) for a, b in _slices(counts)]
                    before = within + np.cumsum(counts) - counts
                    cols = [np.full(len(ids), part), place + np.arange(len(ids)), pa.array(ids, pa.int64()), before, counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*cols, *zip(*made, strict=True)]], names=names)
                    place, within = place + len(ids), within + int(counts.sum())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(uri).select("path", "content")
    return files.mapInArrow(decode, full)


def _started(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, in file order."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per file.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """(part, place, doc_id, n_tokens, tokens ARRAY<BIGINT>, start), one row per document."""
    return _started(_scan(spark, uri, lambda t: (t.astype(np.int64),), "tokens array<bigint>"))


def digest_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksums of the ids as little-endian u32, read from the files."""
    rows = _scan(spark, uri, lambda t: (zlib.crc32(t.astype("<u4").tobytes()),), "ids_crc32 bigint")
    # The digests are small and are used twice: for the rows and for the totals of the files.
    return _started(materialize(rows, "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32")
