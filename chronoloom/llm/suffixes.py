"""Repeated byte strings across documents, by column-wise construction of a suffix order of many texts.

Only strings of ``length`` bytes matter, so texts are cut where that loses nothing: every window of ``length`` bytes is
assigned to the lowest hash among its grams (its key), and a run of neighbouring windows with one key is a segment.
Equal windows have equal keys, so a key seen once is unique and segments are compared only under their own key.

The segments of a task form a collection. Its suffix order is built column by column: every round puts one
symbol in front of every text, finds the places of the new suffixes from the symbol and the place of the suffix they
extend (the LF mapping of the collection's Burrows-Wheeler transform), merges them into the sorted arrays in one sequential
pass, and updates the common prefixes of new neighbours. A window is repeated if it shares its whole length with a neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

LENGTH = 400
GRAM = 64
#: Bytes a symbol; a text of bytes is so many texts of symbols, one for each phase. Divides LENGTH.
SYMBOL = 16
#: Bytes a collection, about.
COLLECTION = 1 << 20
#: Rows of a batch of segments.
ROWS = 20_000
#: Different segments under one key beyond which its windows are compared by hash, spread over all tasks.
HOT_SEGMENTS = 2000
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place, alike for like bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(key, segment hash, first window, windows, whether its key occurs in it twice) of the runs of a text."""
    if len(data) < length:
        return
    width = length - gram + 1
    grams = gram_hashes(np.frombuffer(data, np.uint8), gram)
    keys = sliding_min(grams, width)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    digest, kept, signed = xxhash.xxh3_64_intdigest, keys[starts].view(np.int64).tolist(), grams.view(np.int64)
    for key, start, size in zip(kept, starts.tolist(), sizes.tolist(), strict=True):
        for at in range(start, start + size, width):
            n = min(width, start + size - at)
            twice = np.count_nonzero(signed[at : at + n + width - 1] == key) > 1
            yield key, digest(data[at : at + n + length - 1]) - (1 << 63), at, n, twice


def _ranks(data: np.ndarray, symbol: int) -> np.ndarray:
    """An id, from 1, of the ``symbol`` (a power of two, 8 at least) bytes at each place; equal ids for equal bytes only."""
    n = len(data) - symbol + 1
    x = np.zeros(n + symbol - 8, np.uint64)
    for i in range(8):
        x = (x << np.uint64(8)) | data[i : i + len(x)]
    have = 8
    while True:
        ids = np.unique(x, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        if have == symbol:
            return ids
        x = (ids[:-have] << np.uint64(32)) | ids[have:]
        have *= 2


class Collection:
    """Suffix order of many texts of symbols, grown by one symbol in front of each text a round.

    ``order`` holds, sorted, the first symbol of each suffix and the place of what follows it; ``where`` its place in the
    symbols and ``common`` the symbols it shares with the suffix before it, ``cap`` at most. The first places are the
    ends of the texts, symbol 0.
    """

    def __init__(self, symbols: np.ndarray, stride: int, starts: np.ndarray, lengths: np.ndarray, cap: int):
        self.symbols, self.stride, self.cap = symbols, stride, cap
        self.starts, self.lengths = starts, lengths
        m = len(starts)
        self.order = np.arange(m, dtype=np.uint64)
        self.where = np.full(m, -1, np.int32)
        self.common = np.zeros(m, np.uint8)
        self.place = np.arange(m, dtype=np.int64)
        self.left = np.zeros(len(symbols), np.uint8)  # symbols to the end of the text, cap at most
        for back in range(int(lengths.max(initial=0))):
            on = lengths > back
            self.left[starts[on] + stride * (lengths[on] - 1 - back)] = min(back + 1, cap)

    def build(self) -> None:
        by_length = np.argsort(-self.lengths, kind="stable")
        self.starts, self.lengths = self.starts[by_length], self.lengths[by_length]
        active = np.searchsorted(-self.lengths, -np.arange(int(self.lengths.max(initial=0))), "left")
        for back, m in enumerate(active.tolist()):
            self._insert(m, self.starts[:m] + self.stride * (self.lengths[:m] - 1 - back))

    def _insert(self, m: int, at: np.ndarray) -> None:
        low = np.uint64(0xFFFFFFFF)
        keys = (self.symbols[at] << np.uint64(32)) | self.place[:m].astype(np.uint64)
        by_key = np.argsort(keys)
        keys = keys[by_key]
        before = np.searchsorted(self.order, keys)
        n = len(self.order)
        new = before + np.arange(m)
        shift = np.cumsum(np.bincount(before, minlength=n + 1)[:n])
        old = np.arange(n) + shift
        order, where, common = np.empty(n + m, np.uint64), np.empty(n + m, np.int32), np.empty(n + m, np.uint8)
        order[old], where[old], common[old] = self.order, self.where, self.common
        order[new], where[new] = keys, at[by_key]
        touched = np.zeros(n + m + 1, bool)
        touched[new] = touched[new + 1] = True
        changed = np.flatnonzero(touched[: n + m])
        common[changed] = self._shared(order[changed - 1], order[changed])
        self.order, self.where, self.common = order + shift.astype(np.uint64)[(order & low).astype(np.int64)], where, common
        self.place[by_key] = new

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols of neighbours, from their first symbols and the places, before the merge, of the rests."""
        out = np.zeros(len(a), np.uint8)
        same = np.flatnonzero((a >> np.uint64(32) == b >> np.uint64(32)) & (b >> np.uint64(32) > 0))
        low = np.uint64(0xFFFFFFFF)
        first, last = (a[same] & low).astype(np.int64), (b[same] & low).astype(np.int64)
        rest = self.common[last].copy()
        near = np.flatnonzero(last - first > 1)
        for step in range(1, 6):
            near = near[(last[near] - first[near] > step) & (rest[near] > 0)]
            rest[near] = np.minimum(rest[near], self.common[last[near] - step])
        far = near[(last[near] - first[near] > 6) & (rest[near] > 0)]
        if len(far):
            x, y = self.where[first[far]].astype(np.int64), self.where[last[far]].astype(np.int64)
            most = np.where((x < 0) | (y < 0), 0, np.minimum(self.left[x], self.left[y]))
            most = np.minimum(most, rest[far])
            met, going = np.zeros(len(far), np.uint8), np.flatnonzero(most > 0)
            while len(going):
                step = self.stride * met[going].astype(np.int64)
                going = going[self.symbols[x[going] + step] == self.symbols[y[going] + step]]
                met[going] += 1
                going = going[met[going] < most[going]]
            rest[far] = met
        out[same] = np.minimum(rest.astype(np.int64) + 1, self.cap)
        return out


def repeated_windows(texts: list[bytes], length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each text, whether the ``length`` bytes at each place occur at another place of any of the texts."""
    if length % symbol:
        symbol = next(s for s in (8, 1) if length % s == 0)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts) + bytes(length + 8), np.uint8)
    symbols = _ranks(data, symbol) if symbol >= 8 else data.astype(np.uint64) + np.uint64(1)
    windows = np.maximum(sizes - length + 1, 0)
    phase, owner = np.tile(np.arange(symbol), len(texts)), np.repeat(np.arange(len(texts)), symbol)
    count = np.maximum(windows[owner] - phase + symbol - 1, 0) // symbol
    on = count > 0
    cap = length // symbol
    built = Collection(symbols, symbol, offsets[owner][on] + phase[on], count[on] + cap - 1, cap)
    built.build()
    full = built.common == cap
    full[:-1] |= full[1:]
    hit = np.zeros(len(data), bool)
    hit[built.where[full & (built.where >= 0)]] = True
    return [hit[o : o + w] for o, w in zip(offsets, windows, strict=True)]


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _text_id(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(text, start, n, key, segment, twice): the segments of each text; copies of a text give the same rows again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text", "key", "segment", "start", "n", "twice"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)
        rows: list[tuple] = []
        for batch in batches:
            for value in batch.column(0):
                data = value.as_buffer().to_pybytes()
                if len(data) >= length:
                    name = _text_id(data)[:16]
                    for found in segments(data, length, gram):
                        rows.append((name, *found))
                        if len(rows) == ROWS:
                            yield pack(rows)
                            rows = []
        if rows:
            yield pack(rows)

    return docs.select("body").mapInArrow(run, "text binary, key bigint, segment bigint, start bigint, n int, twice boolean")


def _packed(docs: DataFrame, length: int) -> DataFrame:
    """(text, packed): each different text once, compressed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = [x for v in batch.column(0) if len(x := v.as_buffer().to_pybytes()) >= length]
            columns = [pa.array([_text_id(x)[:16] for x in bodies], pa.binary()), pa.array([tool.compress(x) for x in bodies], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "packed"])

    return docs.select("body").mapInArrow(run, "text binary, packed binary").groupBy("text").agg(F.first("packed").alias("packed"))


def _cut(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(key, segment, n, hot, bytes) of the ``wanted`` (key, segment, n, hot, text, start)."""
    listed = wanted.groupBy("text").agg(F.collect_list(F.struct("key", "segment", "n", "hot", "start")).alias("wants"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        names, kinds = ["key", "segment", "n", "hot", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            for packed, wants in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, w = tool.decompress(packed), wants.values
                key, segment, n, hot, start = (w.field(i).to_pylist() for i in range(5))
                cuts = [data[s : s + k + length - 1] for s, k in zip(start, n, strict=True)]
                for at in range(0, len(cuts), 2000):
                    part = slice(at, at + 2000)
                    yield pa.RecordBatch.from_arrays([pa.array(c[part], k) for c, k in zip([key, segment, n, hot, cuts], kinds, strict=True)], names=names)

    joined = texts.join(listed, "text").select("packed", "wants")
    return joined.mapInArrow(run, "key bigint, segment bigint, n int, hot boolean, bytes binary")


def _compare(cut: DataFrame, length: int, symbol: int) -> DataFrame:
    """(key, segment, first, end): runs of repeated windows inside segments, from collections of whole keys."""

    def solve(held: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        rows = [(k, s, a, b) for (k, s), hit in zip(held, repeated_windows(list(held.values()), length, symbol), strict=True) for a, b in _spans(hit)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "segment", "first", "end"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, last = 0, None
        for batch in batches:
            for key, segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= COLLECTION:
                    yield solve(held)
                    held, size = {}, 0
                last = key
                if (key, segment) not in held:
                    held[key, segment] = data
                    size += len(data)
        if held:
            yield solve(held)

    dealt = cut.select("key", "segment", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, segment bigint, first bigint, end bigint")


def _compare_hot(cut: DataFrame, length: int) -> DataFrame:
    """The same for keys of very many different segments: each window is a row of its own, known by 128 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - length + 1
                names = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                columns = [pa.array([key] * n, pa.int64()), pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(names, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "segment", "first", "window"])

    rows = materialize(cut.mapInArrow(run, "key bigint, segment bigint, first bigint, window binary"), "suffix-windows")
    # As many rows as windows under hot keys; counts are gathered before they are shuffled.
    often = rows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(often, "window").select("key", "segment", "first", (F.col("first") + 1).alias("end"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(text, spans): for each text of ``body`` with repeats, the byte spans [first, end) that repeated strings cover.

    ``text`` is the first 16 bytes of the text's SHA-256. Spans may touch or overlap.
    """
    runs = materialize(_runs(docs, length, gram), "suffix-runs")
    twice = F.max(F.col("twice").cast("int")).alias("inside")
    seen = runs.groupBy("key").agg(F.count("*").alias("total"), twice).where("total > 1 or inside = 1").select("key", "inside")
    known = materialize(runs.join(seen, "key").groupBy("key", "segment", "n").agg(F.count("*").alias("c"), F.max("inside").alias("inside"), F.min(F.struct("text", "start")).alias("at")), "suffix-segments")
    kinds = known.groupBy("key").agg(F.count("*").alias("different"), F.max("inside").alias("inside")).where("different > 1 or inside = 1")
    wanted = known.join(kinds.select("key", (F.col("different") > hot_segments).alias("hot")), "key")
    cut = materialize(_cut(wanted.select("key", "segment", "n", "hot", "at.text", "at.start"), _packed(docs, length), length), "suffix-bytes")
    found = _compare(cut.where("not hot"), length, symbol)
    hot = cut.where("hot")
    if not hot.isEmpty():
        found = found.unionByName(_compare_hot(hot.select("key", "segment", "bytes"), length))
    whole = known.where("c > 1").select("key", "segment", F.lit(0).cast("bigint").alias("first"), F.col("n").cast("bigint").alias("end"))
    found = found.join(known.where("c > 1").select("key", "segment"), ["key", "segment"], "left_anti").unionByName(whole)
    places = runs.join(found, ["key", "segment"]).select("text", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end") - 1 + length).alias("end"))
    return places.groupBy("text").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans that touch or overlap."""
    out: list[list[int]] = []
    for first, end in spans:
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, removed, kept): each text without the bytes that repeated strings cover.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in ``docs``, the same text
    included; strings never reach across texts and are judged before anything is removed. ``removed`` lists the
    maximal spans [first, end), ``kept`` is BINARY (a cut may fall inside a character). Null texts are empty. Every
    row gives a row, repeated rows count as copies of each other. Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    spans = repeated_spans(rows, length=length, **options)
    named = rows.withColumn("text", F.substring(F.unhex(F.sha2("body", 256)), 1, 16))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            lists, kept, sizes = [], [], []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = merged([(s["first"], s["end"]) for s in found or []])
                edges = [0, *[x for s in gone for x in s], len(data)]
                lists.append([{"first": a, "end": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(data))
            count = pa.array(map(len, lists), pa.int64())
            gone = pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), gone, count, pa.array(lists, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    joined = named.join(spans, "text", "left").select("id", "body", "spans")
    out = joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<first:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
