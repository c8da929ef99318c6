"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

A hash orders all shingles at random. Test items are partitioned by their number of distinct shingles; the signature of an
item is its lowest hashes, as many as its partition asks for, and the signature of a document its hashes in those cells of
the hash range that hold a hash of an item's signature, so that small items, whose lowest hashes lie anywhere, cost no more
than their own cells. A document that holds the share ``containment`` of an item misses so few of the item's
shingles that it must hold a number of the item's signature that follows from its size and partition; what holds fewer
is no candidate. Unlike in bands of a Jaccard threshold this does not depend on the document's length: a match of 20
shingles in a text of 5,000 has a Jaccard similarity of 0.003 and would be lost. Candidates are verified by the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh_name, materialize

WIDTH = 5
CONTAINMENT = 0.8
#: Bytes of sketches, of item shingles or of candidates that are broadcast at most, about.
BROADCAST_BYTES = 32 << 20
#: Cells of the hash range that signatures are marked in: 16 for each hash of an item's signature, between these powers of two.
#: Beyond, cells fill up and let more hashes of documents through; none is lost.
LEAST_CELLS, MOST_CELLS = 12, 18
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space, A-Z in lower case; null and empty texts have none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lower, "[ \t\n\u000b\f\r]+"), lambda w: w != "")


def _places(word_list: Column, width: int) -> Column:
    """First places of the shingles, from 0: one for a text of 1 to ``width`` words, none for no words."""
    return F.when(F.size(word_list) > 0, F.sequence(F.lit(0), F.greatest(F.size(word_list) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_strings(text: Column, width: int = WIDTH) -> Column:
    """Shingles as strings, in order; fewer words than ``width`` give one shingle, the whole."""
    return _bound(words(text), lambda w: F.transform(_places(w, width), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The MinHash order of the shingles: a hash of the words' hashes at each place."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return _bound(hashed, lambda h: F.transform(_places(h, width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))


def sketches(items: DataFrame, containment: float, width: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, id, n, need, shingle, hash, in_sketch): the shingles of each item, which of them are its sketch, and how many of it a match holds.

    ``item`` is never null: a row without an id is an item of its own, told apart by its text.

    The sketch length is set by the partition, the next power of two of the item's size n: of n shingles a match
    misses (1 - containment) * n at most, so of one more than that share of the partition's bound it holds all but those.
    """
    text = F.col(text_col)
    both = F.arrays_zip(shingle_strings(text, width).alias("shingle"), shingle_hashes(text, width).alias("hash"))
    item = F.coalesce(F.concat(F.lit("id:"), F.col(item_col).cast("string")), F.concat(F.lit("row:"), row_key(item_col, text_col)))
    rows = items.select(item.alias("item"), F.col(item_col).alias("id"), F.explode(both).alias("z")).select("item", "id", "z.shingle", "z.hash")
    rows = rows.groupBy("item", "shingle").agg(F.min("hash").alias("hash"), F.min("id").alias("id"))
    gathered = rows.groupBy("item").agg(F.min("id").alias("id"), F.array_sort(F.collect_list(F.struct("hash", "shingle"))).alias("all"))
    gathered = gathered.withColumn("n", F.size("all")).withColumn("bound", F.pow(F.lit(2.0), F.ceil(F.log2("n"))))
    length = (F.floor(F.lit(1 - containment + 1e-9) * F.col("bound")) + 1).cast("int")
    need = F.least(length, F.col("n")) - F.floor(F.lit(1 - containment + 1e-9) * F.col("n"))
    parts = gathered.select("item", "id", "n", length.alias("length"), F.greatest(need, F.lit(1)).cast("int").alias("need"), F.posexplode("all").alias("place", "z"))
    return parts.select("item", "id", "n", "need", "z.shingle", "z.hash", (F.col("place") < F.col("length")).alias("in_sketch"))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id or have none."""
    return F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def _sent(df: DataFrame) -> DataFrame:
    """Broadcast where the bytes of the rows are known to be few; else Spark shuffles both sides of the join."""
    text = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"), F.lit(32))
    size = df.agg(F.coalesce(F.sum(text.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def in_cells(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for every hash in the column ``hash`` of ``wanted`` and for few others: whether the hash's cell has one.

    The cells are bits of at most 4,096 numbers, gathered by the driver and folded to one array; the test is a lookup without a join.
    """
    cells = min(max(math.ceil(math.log2(16 * wanted.count() + 1)), LEAST_CELLS), MOST_CELLS)
    cell = lambda h: F.shiftrightunsigned(h, 64 - cells)
    marked = wanted.select(cell(F.col("hash")).alias("cell")).groupBy(F.shiftright("cell", 6).alias("place"))
    held = {r.place: r.bits for r in marked.agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS INT))")).alias("bits")).collect()}
    table = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(1 << (cells - 6)))), ",").cast("array<bigint>")
    return lambda h: F.getbit(F.get(table, F.shiftright(cell(h), 6).cast("int")), cell(h).bitwiseAND(F.lit(63)).cast("int")) == 1


def matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    containment: float = CONTAINMENT,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(key, id, item_id, n_shingles, n_found, containment): the items of which a text holds the asked share.

    Whole texts count. Items and texts without words match nothing; an item of fewer words than ``width`` matches
    a text that is that item. Null ids take part, each item without an id for itself; repeated rows count once; an
    item_id of several rows is the union of its texts. Empty tables give an empty result. Other columns are ignored.
    """
    known = materialize(sketches(items, containment, width, item_col, item_text_col), "benchmark-shingles")
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    wanted = known.where("in_sketch").select("hash", "item", "need")
    below = F.filter(shingle_hashes(F.col("t"), width), in_cells(wanted))
    found = rows.select("key", F.explode(F.array_distinct(below)).alias("hash"))
    hits = found.join(_sent(wanted), "hash").groupBy("key", "item", "need").agg(F.count_distinct("hash").alias("hits"))
    pairs = materialize(hits.where("hits >= need").select("key", "item"), "benchmark-candidates")
    both = F.explode(F.arrays_zip(shingle_strings(F.col("t"), width).alias("shingle"), shingle_hashes(F.col("t"), width).alias("hash"))).alias("z")
    again = rows.join(_sent(pairs.select("key").distinct()), "key").select("key", "id", both).select("key", "id", "z.hash", "z.shingle")
    held = again.join(_sent(known.select("hash", "shingle", "item", F.col("id").alias("named"), "n")), ["hash", "shingle"]).select("key", "id", "item", "named", "n", "shingle").distinct()
    counted = held.join(pairs, ["key", "item"], "left_semi").groupBy("key", "id", "item", "named", "n").agg(F.count("*").alias("n_found"))
    share = F.col("n_found") / F.col("n")
    named = counted.select("key", "id", F.col("named").alias(item_col), F.col("n").cast("bigint").alias("n_shingles"), "n_found", share.alias("containment"))
    return named.where(F.col("containment") >= containment)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment), one row for each document and item that match."""
    found = matches(docs, items, id_col=id_col, item_col=item_col, **options)
    return found.select(F.col("id").alias(id_col), item_col, "n_shingles", "n_found", "containment").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no item, with their columns."""
    key = fresh_name(docs, "key")
    found = matches(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(found, key, "left_anti").select(docs.columns)


ORACLE_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[j:j + {WIDTH - 1}], ' ') FOR j IN range(1, greatest(len(w) - {WIDTH - 2}, 2))]) AS s FROM d WHERE len(w) > 0),
js AS (SELECT DISTINCT item_id, unnest([array_to_string(w[j:j + {WIDTH - 1}], ' ') FOR j IN range(1, greatest(len(w) - {WIDTH - 2}, 2))]) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM js GROUP BY item_id)
SELECT doc_id, item_id, cast(any_value(n) AS BIGINT) AS n_shingles, cast(count(*) AS BIGINT) AS n_found, count(*) / any_value(n) AS containment
FROM ds JOIN js USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= {CONTAINMENT}
"""
