"""SimHash near-duplicates found through a Gray-order hierarchical index.

Fingerprints that must be compared are dealt to the same bucket; inside a bucket they are sorted by Gray rank,
so neighbours differ in few bits, and a tree is laid over the order. A node keeps the bits on which all codes
below it agree (its masked pattern). Two groups whose patterns already differ in too many common bits are
dropped whole; differences found higher up are carried down and only bits new to a level are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, star_components
from .storage import fresh_name, materialize, measured

SEED = 42
FANOUT = 8
FRONTIER = 1 << 16
#: Bits of a parity sketch, by which candidates are told apart before their shingles are compared.
PARITY = 512
#: Hashes of the texts whose shingles are compared that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Tables whose buckets give the pairs that are verified first; all tables serve after them.
FOREST_TABLES = 8
_ONES = np.uint64(0x0101010101010101)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle; a shorter text has one shingle, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -width]])
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in cuts), np.uint64, len(starts))


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(n, lanes): the hashes themselves, then remixed copies of them."""
    if lanes == 1:
        return hashes[:, None]
    x = hashes[:, None] + np.arange(lanes, dtype=np.uint64)[None, :] * _STEP
    x[:, 1:] ^= x[:, 1:] >> np.uint64(30)
    x[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(27)
    x[:, 1:] *= np.uint64(0x94D049BB133111EB)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
    return x


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` words whose bits are set where over half of the hashes have them; zero for no hashes.

    Eight counters of one byte share a word, so rows are summed 255 at a time.
    """
    n = len(hashes)
    if not n:
        return np.zeros(lanes, np.uint64)
    counts = np.zeros((lanes, 8, 8), np.int64)
    for at in range(0, n, 255 * 512):
        x = _lanes(hashes[at : at + 255 * 512], lanes)
        full = -len(x) % 255 if len(x) > 255 else 0
        if full:
            x = np.concatenate([x, np.zeros((full, lanes), np.uint64)])
        x = x.reshape(-1, 255 if len(x) > 255 else len(x), lanes)
        for bit in range(8):
            packed = ((x >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)
            counts[:, :, bit] += packed.view(np.uint8).reshape(-1, lanes, 8).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > n).reshape(lanes, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, *, width: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """(``id_col``, ``fingerprint`` big-endian BINARY, ``text_hash``) of whole texts; a null text counts as empty.

    :param once: a shingle that a text repeats counts once.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = batch.column(1).cast(pa.binary()), []
            for t in texts:
                hashes = shingle_hashes(t.as_py() or b"", width)
                codes.append(fingerprint(np.unique(hashes) if once else hashes, lanes).astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), batch.column(2)], names=["id", "fingerprint", "text_hash"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), _text_hash(text_col).alias("text_hash"))
    return source.mapInArrow(run, f"id {kind}, fingerprint binary, text_hash bigint").withColumnRenamed("id", id_col)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Positions of the (n, lanes) codes in order of their rank in the reflected Gray code."""
    rank, carry = np.empty_like(codes), np.zeros(len(codes), bool)
    for lane in range(codes.shape[1]):
        x = codes[:, lane].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(shift)
        x = np.where(carry, ~x, x)
        rank[:, lane], carry = x, (x & np.uint64(1)).astype(bool)
    return np.lexsort(rank.T[::-1])


class Labels:
    """Union of array positions by smallest label."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def settle(self) -> None:
        while True:
            up = self.of[self.of]
            if np.array_equal(up, self.of):
                return
            self.of = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            self.settle()


def link_bucket(codes: np.ndarray, limit: int, known: np.ndarray | None = None) -> np.ndarray:
    """Smallest-position labels of (n, lanes) codes, linked where ``limit`` or fewer bits differ.

    :param known: labels of links already found. Pairs of nodes that lie in one component as a whole are dropped, so a dense
        group costs about its size and not its square.
    """
    order = gray_order(codes)
    levels = [(np.full_like(codes, ~np.uint64(0)), codes[order])]
    while len(levels[-1][0]) > 1:
        mask, bits = levels[-1]
        cuts = np.arange(0, len(mask), FANOUT)
        ones = np.bitwise_and.reduceat(bits & mask, cuts, axis=0)
        zeros = np.bitwise_and.reduceat(~bits & mask, cuts, axis=0)
        levels.append((ones | zeros, ones))
    labels = Labels(len(codes))
    if known is not None:
        labels.of = known.copy()

    def whole() -> list[np.ndarray]:
        """For each level the component of every node, -1 for nodes of several."""
        found = [labels.of[order]]
        while len(found[-1]) > 1:
            cuts = np.arange(0, len(found[-1]), FANOUT)
            low, high = np.minimum.reduceat(found[-1], cuts), np.maximum.reduceat(found[-1], cuts)
            found.append(np.where(low == high, low, -1))
        return found

    steps = np.array([(i, j) for i in range(FANOUT) for j in range(FANOUT)])
    stack, groups = [(len(levels) - 1, np.zeros((1, 2), np.int64), np.zeros(1, np.int64))], whole()
    while stack:
        level, pairs, found = stack.pop()
        apart = (groups[level][pairs[:, 0]] != groups[level][pairs[:, 1]]) | (groups[level][pairs[:, 0]] < 0)
        pairs, found = pairs[apart], found[apart]
        if not len(pairs):
            continue
        if level == 0:
            labels.join(order[pairs[:, 0]], order[pairs[:, 1]])
            labels.settle()
            groups = whole()
            continue
        if len(pairs) * len(steps) > FRONTIER and len(pairs) > 1:
            half = len(pairs) // 2
            stack += [(level, pairs[half:], found[half:]), (level, pairs[:half], found[:half])]
            continue
        mask, bits = levels[level - 1]
        known_bits = levels[level][0][pairs[:, 0]] & levels[level][0][pairs[:, 1]]
        below = (pairs[:, None, :] * FANOUT + steps[None, :, :]).reshape(-1, 2)
        parent = np.repeat(np.arange(len(pairs)), len(steps))
        keep = (below[:, 0] <= below[:, 1]) & (below[:, 1] < len(mask))
        if level == 1:
            keep &= below[:, 0] < below[:, 1]
        below, parent = below[keep], parent[keep]
        fresh = mask[below[:, 0]] & mask[below[:, 1]] & ~known_bits[parent]
        total = found[parent] + popcount((bits[below[:, 0]] ^ bits[below[:, 1]]) & fresh)
        near = total <= limit
        if near.any():
            stack.append((level - 1, below[near], total[near]))
    labels.settle()
    return labels.of


def exact_masks(lanes: int, limit: int) -> np.ndarray:
    """(tables, lanes) bits of the bucket keys under which any two codes within ``limit`` bits meet at least once.

    The bits are cut into limit + 2 blocks; at least two of them are untouched, so there is a table for every
    pair of blocks.
    """
    blocks = limit + 2
    owner = np.arange(64 * lanes) * blocks // (64 * lanes)
    return np.stack([np.packbits((owner == i) | (owner == j)).view(">u8").astype(np.uint64) for i in range(blocks) for j in range(i)])


def sampled_masks(lanes: int, bits: int, tables: int) -> np.ndarray:
    """(tables, lanes) of ``bits`` bit positions each, dealt from shuffled positions of a fixed seed.

    All positions serve in about as many tables, so no pair depends on a few that serve in many.
    """
    draw, masks, deck = np.random.default_rng(SEED), [], np.empty(0, np.int64)
    for _ in range(tables):
        if len(deck) < bits:
            deck = draw.permutation(64 * lanes)
        on = np.zeros(64 * lanes, np.uint8)
        on[deck[:bits]] = 1
        deck = deck[bits:]
        masks.append(np.packbits(on).view(">u8").astype(np.uint64))
    return np.stack(masks)


def bucket_keys(codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(n, tables) hashes of the bits that each mask leaves of a code, and of the number of the table."""
    out = np.empty((len(codes), len(masks)), np.int64)
    for t, mask in enumerate(masks):
        x = np.full(len(codes), t + 1, np.uint64)
        for lane in range(codes.shape[1]):
            x = (x ^ (codes[:, lane] & mask[lane])) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
        out[:, t] = x.view(np.int64)
    return out


def first_table(codes: np.ndarray, others: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The first of the tables in which each code has the key of its other, 0 if there is none."""
    found = np.zeros(len(codes), np.int64)
    for at in range(0, len(codes), 4096):
        found[at : at + 4096] = np.argmin(((codes[at : at + 4096] ^ others[at : at + 4096])[:, None, :] & masks).any(axis=2), axis=1)
    return found


def _codes(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(len(values), -1)


def tables_for(similarity: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` sampled bits after which a pair of that Jaccard similarity was met with chance ``recall``."""
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(math.log(1 - recall) / math.log1p(-(same**bits)))


def _halvings(sizes: np.ndarray) -> np.ndarray:
    """How often a set of that size is halved until less than ``PARITY`` of it are expected."""
    return np.maximum(np.frexp(np.asarray(sizes, np.float64))[1] - (PARITY.bit_length() - 1), 0)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """The size of a set of hashes, and two sketches of it: the parities of how many hashes fall on each of ``PARITY`` bits.

    The first is of the hashes left by so many halvings as the size asks for, the second of those left by one more, so
    that sets of up to twice the size have a sketch of the same halvings.
    """
    level, words = int(_halvings(len(hashes))), [np.array([len(hashes)], np.uint64)]
    for halved in (level, level + 1):
        left = hashes[hashes <= np.uint64((1 << (64 - halved)) - 1)] & np.uint64(PARITY - 1)
        odd = np.bincount(left.astype(np.int64), minlength=PARITY) & 1
        words.append(np.packbits(odd.astype(np.uint8)).view(np.uint64))
    return np.concatenate(words)


def maybe_similar(a: np.ndarray, b: np.ndarray, similarity: float, deviations: float = 4.0) -> np.ndarray:
    """Whether the sets behind rows of parity sketches can have that Jaccard similarity.

    Sizes give how many elements may be in one set alone. No more bits than that can differ, and no more than so many
    standard deviations above the mean: certain for sets that are not halved, short of a chance of 1 in 30,000 for others.
    """
    sizes = np.stack([a[:, 0], b[:, 0]]).astype(np.float64)
    alone = sizes.sum(axis=0) * (1 - similarity) / (1 + similarity)
    levels = _halvings(sizes)
    level, half = levels.max(axis=0), PARITY // 64
    sketch = lambda x, own: np.where((own == level)[:, None], x[:, 1 : 1 + half], x[:, 1 + half :])
    odd = popcount(sketch(a, levels[0]) ^ sketch(b, levels[1]))
    share = 0.5**level
    mean_count = alone * share
    even = np.exp(-2 * mean_count / PARITY)
    mean, variance = PARITY / 2 * (1 - even), PARITY / 4 * (1 - even**2) - share * mean_count * even**2
    most = np.minimum(alone, mean + deviations * np.sqrt(np.maximum(variance, 0)))
    return (sizes.min(axis=0) >= similarity * sizes.max(axis=0) - 1e-9) & (odd <= most + 1e-9)


def near_links(codes: DataFrame, limit: int, *, key_bits: int | None = None, tables: int = 0) -> DataFrame:
    """(u, v): links that connect what differs in ``limit`` or fewer bits, of the distinct column ``fingerprint``.

    Each bucket gives a spanning forest, never all of its pairs. With ``key_bits`` None the buckets are
    lossless (:func:`exact_masks`); otherwise ``tables`` sampled keys deal the fingerprints.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _codes(batch.column(0))
            keys = bucket_keys(words, exact_masks(words.shape[1], limit) if key_bits is None else sampled_masks(words.shape[1], key_bits, tables))
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), batch.column(0)], names=["key", "fingerprint"])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words in _whole_runs(batches):
            ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            labels = Labels(len(keys))
            run = np.repeat(ends, ends - starts)
            for step in range(1, FANOUT * 4):
                left = np.flatnonzero(np.arange(len(keys)) + step < run)
                if not len(left):
                    break
                left = left[popcount(words[left] ^ words[left + step]) <= limit]
                labels.join(left, left + step)
            labels.settle()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > FANOUT * 4:
                    labels.of[a:b] = a + link_bucket(words[a:b], limit, labels.of[a:b] - a)
            moved = np.flatnonzero(labels.of != np.arange(len(keys)))
            if len(moved):
                pack = lambda at: pa.array([x.tobytes() for x in words[at].astype(">u8")], pa.binary())
                yield pa.RecordBatch.from_arrays([pack(moved), pack(labels.of[moved])], names=["u", "v"])

    dealt = codes.select("fingerprint").mapInArrow(deal, "key bigint, fingerprint binary")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(link, "u binary, v binary").distinct()


def _dealt(codes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(key, both): the columns (fingerprint, component, sketch) of ``codes``, joined, under every bucket key of their ``loose`` group.

    Codes of two groups are never within the limit. Apart from each other they keep their places in a bucket when another
    group is done, and a bucket grows with its group, not with the table. The last 16 bits of a key are the table's number.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.ascontiguousarray(_codes(batch.column(0))[:, : masks.shape[1]])
            keys = (bucket_keys(words, masks) ^ batch.column(1).to_numpy()[:, None]) & ~0xFFFF | np.arange(len(masks))
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), batch.column(0)], names=["key", "both"])

    named = F.unhex(F.lpad(F.hex(F.xxhash64("component")), 16, "0"))
    rows = codes.select(F.concat("fingerprint", named, "sketch").alias("both"), F.xxhash64("loose")).mapInArrow(deal, "key bigint, both binary")
    return rows.repartition("key").sortWithinPartitions("key")


def _open_buckets(batches: Iterable[pa.RecordBatch], lanes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, components, sketches, end of the bucket and table of each code) of the buckets with several components, each in Gray order."""
    for keys, both in _whole_runs(batches):
        order = gray_order(np.concatenate([keys.view(np.uint64)[:, None], both[:, :lanes]], axis=1))
        # The key leads the rank, so buckets stay together; only whether two keys are equal matters.
        keys, both = keys[order], both[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        sizes, parts = np.diff(np.append(starts, len(keys))), both[:, lanes]
        several = np.minimum.reduceat(parts, starts) != np.maximum.reduceat(parts, starts) if len(starts) else np.empty(0, bool)
        if several.any():
            stay, sizes = np.repeat(several, sizes), sizes[several]
            both, table = both[stay], keys[stay] & 0xFFFF
            yield np.ascontiguousarray(both[:, :lanes]), both[:, lanes], np.ascontiguousarray(both[:, lanes + 1 :]), np.repeat(np.cumsum(sizes), sizes), table


def _packed_words(words: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in words.astype(">u8")], pa.binary())


def forest_pairs(codes: DataFrame, limit: int, similarity: float, masks: np.ndarray) -> DataFrame:
    """(u, v): pairs up to ``FANOUT`` places apart in a bucket that would connect what :func:`cross_pairs` can find there.

    A pair whose ends other pairs of the bucket connect already is left out, so rows grow with the codes and not with their
    pairs. What is left out for a pair that does not verify is found by :func:`cross_pairs` later.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, parts, sketch, run, _ in _open_buckets(batches, masks.shape[1]):
            labels, left = Labels(len(words)), np.arange(len(words))
            for step in range(1, FANOUT + 1):
                left = left[left + step < run[left]]
                at = left[(parts[left] != parts[left + step]) & (labels.of[left] != labels.of[left + step])]
                at = at[popcount(words[at] ^ words[at + step]) <= limit]
                at = at[maybe_similar(sketch[at], sketch[at + step], similarity)]
                if len(at):
                    ends = np.sort(np.stack([labels.of[at], labels.of[at + step]]), axis=0)
                    at = at[np.unique(ends, axis=1, return_index=True)[1]]
                    labels.join(at, at + step)
                    yield pa.RecordBatch.from_arrays([_packed_words(words[at]), _packed_words(words[at + step])], names=["u", "v"])

    pairs = _dealt(codes, masks).mapInArrow(compare, "u binary, v binary")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def cross_pairs(codes: DataFrame, limit: int, similarity: float, low: int, high: int, masks: np.ndarray) -> DataFrame:
    """(u, v): pairs ``low`` to ``high`` - 1 places apart in a bucket that differ in ``limit`` or fewer bits, whose parity
    sketches allow that similarity, and which lie in two components.

    A pair comes from the first table that has it in a bucket, and its places there stay, so over all ranges it is made once.
    A row with null v names a code of a bucket that holds pairs further apart.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, parts, sketch, run, table in _open_buckets(batches, masks.shape[1]):
            left = np.arange(len(words))
            for step in range(low, high):
                left = left[left + step < run[left]]
                if not len(left):
                    break
                at = left[parts[left] != parts[left + step]]
                at = at[popcount(words[at] ^ words[at + step]) <= limit]
                at = at[maybe_similar(sketch[at], sketch[at + step], similarity)]
                at = at[first_table(words[at], words[at + step], masks) == table[at]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([_packed_words(words[at]), _packed_words(words[at + step])], names=["u", "v"])
            ends, sizes = np.unique(run, return_counts=True)
            far = ends[sizes > high] - 1
            if len(far):
                yield pa.RecordBatch.from_arrays([_packed_words(words[far]), pa.nulls(len(far), pa.binary())], names=["u", "v"])

    pairs = _dealt(codes, masks).mapInArrow(compare, "u binary, v binary")
    one = F.when(F.col("v").isNull(), F.col("u")).otherwise(F.least("u", "v"))
    return pairs.select(one.alias("u"), F.when(F.col("v").isNotNull(), F.greatest("u", "v")).alias("v")).distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, *, width: int, text_col: str = "text") -> DataFrame:
    """(fingerprint, shingles, sketch) of one text for each of ``nodes`` (fingerprint, text_hash), ``n_nodes`` of them.

    ``shingles`` are distinct numbers of 32 bits; two shingles of a pair of texts share one by chance about once in 4,000
    pairs of texts of 1,000 words. ``sketch`` is their :func:`parity_sketch`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sketches = [], []
            for t in batch.column(1).cast(pa.binary()):
                hashes = np.unique(shingle_hashes(t.as_py() or b"", width))
                sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                sketches.append(parity_sketch(hashes).astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], names=["fingerprint", "shingles", "sketch"])

    few = F.broadcast(nodes) if n_nodes <= BROADCAST_ROWS else nodes  # a row is a hash and a fingerprint
    texts = docs.select(_text_hash(text_col).alias("text_hash"), F.col(text_col).alias("t")).join(few, "text_hash")
    made = texts.select("fingerprint", "t").mapInArrow(run, "fingerprint binary, shingles array<int>, sketch binary")
    return made.dropDuplicates(["fingerprint"])


def similar_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``links`` (u, v) whose shingles have that Jaccard similarity or more."""
    side = lambda node, name: sets.select(F.col("fingerprint").alias(node), F.col("shingles").alias(name))
    both = links.join(side("u", "a"), "u").join(side("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    found = both.select("u", "v", shared.alias("shared"), (F.size("a") + F.size("b")).alias("sizes"))
    return found.where(F.col("shared") >= similarity * (F.col("sizes") - F.col("shared")) - 1e-9).select("u", "v")


def _verified(docs: DataFrame, distinct: DataFrame, links: DataFrame, limit: int, *, lanes: int, key_bits: int | None, tables: int, width: int, similarity: float, text_col: str) -> DataFrame:
    """(fingerprint, component) of what pairs of that similarity or more connect, of all pairs within ``limit`` bits in a bucket.

    A forest of likely pairs of some tables is verified first. Where that leaves several components of what the index
    has linked, pairs between them are verified, near ones in Gray order before those 16 times as far apart, until no
    pair of a bucket is left; pairs inside a component would add nothing and are not made.
    """
    masks = exact_masks(lanes, limit) if key_bits is None else sampled_masks(lanes, key_bits, tables)
    loose = connected_components(links, "simhash-loose").select(F.col("node").alias("fingerprint"), F.col("component").alias("loose"))
    nodes, state = measured(loose.join(distinct, "fingerprint").select("fingerprint", "loose", "text_hash"), "simhash-nodes")
    sets = materialize(shingle_sets(docs, nodes.select("fingerprint", "text_hash"), state["rows"], width=width, text_col=text_col), "shingle-sets")
    sketched = nodes.join(sets.select("fingerprint", "sketch"), "fingerprint").withColumn("component", F.col("fingerprint"))
    tried = materialize(forest_pairs(sketched, limit, similarity, masks[:FOREST_TABLES]), "simhash-forest")
    fresh, parts, parted, active, low, high = tried, nodes.select("fingerprint", "loose", F.col("fingerprint").alias("component")), False, None, 1, 16
    while True:
        sure = similar_links(fresh, sets, similarity)
        if parted:  # before that each code is its own component
            of = lambda node, name: parts.select(F.col("fingerprint").alias(node), F.col("component").alias(name))
            sure = sure.join(of("u", "a"), "u").join(of("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        sure, state = measured(sure.where("u != v").distinct(), "simhash-sure")
        if state["rows"]:
            joined = star_components(sure, "simhash-parts").select(F.col("node").alias("component"), F.col("component").alias("now"))
            parts = parts.join(joined, "component", "left").select("fingerprint", "loose", F.coalesce("now", "component").alias("component"))
            parts, parted = materialize(parts, "simhash-parted"), True
        several = parts.groupBy("loose").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("loose")
        open_ = parts.join(several if active is None else several.join(active, "loose"), "loose", "left_semi").join(sets.select("fingerprint", "sketch"), "fingerprint")
        pairs = cross_pairs(open_, limit, similarity, low, high, masks)
        met, state = measured(pairs, "simhash-met", far=F.count_if(F.col("v").isNull()))
        fresh, more = measured(met.where("v is not null").join(tried, ["u", "v"], "left_anti"), "simhash-more")
        if not more["rows"] and not state.get("far"):
            return parts.select("fingerprint", "component")
        far = met.where("v is null").select(F.col("u").alias("fingerprint"))
        # Whole groups stay: what connects two codes may lie in other buckets.
        active = materialize(nodes.join(far, "fingerprint", "left_semi").select("loose").distinct(), "simhash-active")
        low, high = high, high * 16


def _whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, codes) pieces of a sorted stream, cut only between different keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, words = batch.column(0).to_numpy(), _codes(batch.column(1))
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and cut == 0 and held[-1][0][-1] == keys[-1]:
            held.append((keys, words))
            continue
        held.append((keys[:cut], words[:cut]))
        yield np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held])
        held = [(keys[cut:], words[cut:])]
    if held:
        yield np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held])


def _grouped(docs: DataFrame, *, width: int = 5, lanes: int = 4, limit: int = 46, key_bits: int | None = 20, similarity: float = 0.8, recall: float = 0.9, verify: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of the documents, (fingerprint, first, text_hash, component), (component, component_id): see :func:`near_duplicates`."""
    coded = materialize(fingerprints(docs, width=width, lanes=lanes, id_col=id_col, text_col=text_col, once=verify), "fingerprints")
    distinct = coded.groupBy("fingerprint").agg(F.min(id_col).alias("first"), F.min("text_hash").alias("text_hash"))
    tables = 0 if key_bits is None else tables_for(similarity, key_bits, recall)
    links = near_links(distinct, limit, key_bits=key_bits, tables=tables)
    if verify:
        groups = _verified(docs, distinct, links, limit, lanes=lanes, key_bits=key_bits, tables=tables, width=width, similarity=similarity, text_col=text_col)
    else:
        groups = connected_components(links, "simhash-links").select(F.col("node").alias("fingerprint"), "component")
    owner = distinct.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = owner.groupBy("component").agg(F.min("first").alias("component_id"))
    return coded, owner, least


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    lanes: int = 4,
    limit: int = 46,
    key_bits: int | None = 20,
    similarity: float = 0.8,
    recall: float = 0.9,
    verify: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(``id_col``, fingerprint hex string, component_id): the group of each document.

    :param width: words a shingle; repeats count.
    :param lanes: 64-bit words a fingerprint.
    :param limit: fingerprints in at most so many differing bits link; groups are what links reach.
    :param key_bits: bits a sampled bucket key, ``None`` for lossless buckets (small limits only).
    :param similarity, recall: with sampled keys, the tables suffice to meet a pair of this Jaccard similarity
        with this chance.
    :param verify: repeats of a shingle count once, and only pairs whose sets of shingles have the Jaccard similarity
        ``similarity`` or more link. Fingerprints that are equal count as one text.

    component_id is the smallest id reachable, the document's own included. Null and empty texts, and texts
    without words, have the fingerprint zero and link like any other. Repeated rows each keep their row. A null
    id takes part; a group of null ids alone has a null component_id. Other columns are ignored.
    """
    coded, owner, least = _grouped(docs, width=width, lanes=lanes, limit=limit, key_bits=key_bits, similarity=similarity, recall=recall, verify=verify, id_col=id_col, text_col=text_col)
    names = owner.join(least, "component").select("fingerprint", "component_id")
    return coded.join(names, "fingerprint").select(id_col, F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are the first of their group, one row each.

    Of rows that share an id, the one whose text hashes lowest stays. Columns are those of ``docs``. Rows with a
    null id are kept: they cannot be told apart by id.
    """
    _, _, least = _grouped(docs, id_col=id_col, text_col=text_col, **options)
    stay = least.select(F.col("component_id").alias(id_col)).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(stay, id_col, "left_semi")
    order, copy = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)), fresh_name(docs, "copy")
    kept = kept.withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1).drop(copy)
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
