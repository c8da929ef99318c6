"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Time is cut into slots, one block of documents each, and ``period`` slots make a period in which a source of integer
weight a gets a blocks (the weights add up to the period). Block j of a source (from 0) is released at
floor(j * period / a) and due at ceil((j + 1) * period / a). In every slot the released block that is due first runs.
As all weights are whole in a period, one period is scheduled and then repeats, so at any time a source has
received less than one block more or less than its weight asks for, as long as all sources last. A source that
has run out leaves its slots empty; the others keep their proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

PERIOD = 1024
BLOCK_DOCS = 16


def _source(source_col: str) -> Column:
    """The source as a join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def source_sizes(docs: DataFrame, *, source_col: str = "source") -> DataFrame:
    """(mix_source, n): documents of each source."""
    return docs.groupBy(_source(source_col).alias("mix_source")).agg(F.count("*").alias("n"))


def flattened_weights(sizes: DataFrame) -> DataFrame:
    """(mix_source, weight BIGINT): 1000 times the square root of each source's documents, rounded down.

    Between one share a source and shares by size; a usual choice where small sources should be seen more often.
    """
    return sizes.select("mix_source", F.floor(F.sqrt("n") * 1000).cast("bigint").alias("weight"))


def period_shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(mix_source, share INT, period INT): whole slots of a period by largest remainders, one at least.

    One row a source; a period grows to four slots a source where there are many.
    """
    # The tables here hold a row for each source, never one for each document.
    everything = Window.partitionBy()
    base = weights.where("weight > 0").withColumn("sources", F.count("*").over(everything)).withColumn("total", F.sum("weight").over(everything))
    base = base.withColumn("period", F.greatest(F.lit(period), F.col("sources") * 4).cast("bigint"))
    spare = (F.col("period") - F.col("sources")) * F.col("weight").cast("decimal(38,0)")
    base = base.withColumn("floor", F.expr("1 + cast((period - sources) * cast(weight as decimal(20,0)) div total as bigint)"))
    base = base.withColumn("rest", spare % F.col("total"))
    order = Window.partitionBy().orderBy(F.desc("rest"), "mix_source")
    base = base.withColumn("place", F.row_number().over(order)).withColumn("given", F.sum("floor").over(everything))
    share = F.col("floor") + (F.col("place") <= F.col("period") - F.col("given")).cast("int")
    return base.select("mix_source", share.cast("int").alias("share"), F.col("period").cast("int").alias("period"))


def period_table(shares: DataFrame) -> DataFrame:
    """(mix_source, share, period, turn, at): the slot in a period of each source's turn, by earliest deadline first."""
    listed = shares.agg(F.array_sort(F.collect_list(F.struct("mix_source", "share"))).alias("s"), F.max("period").alias("period"))
    released = "acc.done[i] < x.share and (acc.done[i] * cast(period as bigint)) div x.share <= t"
    due = "((acc.done[i] + 1) * cast(period as bigint) + x.share - 1) div x.share"
    pick = f"array_min(transform(s, (x, i) -> if({released}, struct({due} as due, i as i), null))).i"
    step = f"transform(array({pick}), p -> struct(transform(acc.done, (n, i) -> if(i = p, n + 1, n)) as done, concat(acc.picks, array(p)) as picks))[0]"
    begin = "struct(transform(s, x -> 0) as done, cast(array() as array<int>) as picks)"
    run = F.expr(f"aggregate(sequence(0, period - 1), {begin}, (acc, t) -> {step}, acc -> acc.picks)")
    slots = listed.where("period is not null").select("s", "period", F.posexplode(run).alias("at", "i"))
    slots = slots.select(F.expr("s[i].mix_source").alias("mix_source"), F.expr("s[i].share").alias("share"), "period", "at")
    turn = F.row_number().over(Window.partitionBy("mix_source").orderBy("at")) - 1
    return slots.withColumn("turn", turn)


def _numbered(docs: DataFrame, sizes: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Add ``mix_source`` and ``mix_number``, the place of a document in its source by the MD5 of its id.

    A source of n documents is cut into about sqrt(n) ranges of hashes, so that neither a range nor the list of
    ranges is large, whatever share of all rows the source holds.
    """
    keyed = docs.withColumn("mix_source", _source(source_col)).withColumn("mix_hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.join(sizes.select("mix_source", F.ceil(F.sqrt("n")).cast("bigint").alias("mix_ranges")), "mix_source")
    high = F.conv(F.substring("mix_hash", 1, 8), 16, 10).cast("bigint")
    keyed = keyed.withColumn("mix_range", F.shiftright(high * F.col("mix_ranges"), 32))
    # Dealt by both columns: a source that holds a third of all rows is spread over all tasks.
    keyed = keyed.repartition("mix_source", "mix_range")
    counts = keyed.groupBy("mix_source", "mix_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_range")) - F.col("n")
    counts = counts.select("mix_source", "mix_range", before.alias("mix_before"))
    order = Window.partitionBy("mix_source", "mix_range").orderBy("mix_hash", id_col)
    keyed = keyed.withColumn("mix_place", F.row_number().over(order)).join(counts, ["mix_source", "mix_range"])
    return keyed.withColumn("mix_number", F.col("mix_before") + F.col("mix_place") - 1).drop("mix_hash", "mix_ranges", "mix_range", "mix_place", "mix_before")


def schedule(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_place``.

    :param weights: (``source``, ``weight`` > 0); sources it does not name are not mixed and drop out. By default
        :func:`flattened_weights` of ``docs``.
    :param block_docs: documents a block; the last block of a source may be shorter.

    Every document of a weighted source gets one slot: mix_block counts the blocks of its source from 0, release
    and deadline are its block's window, mix_slot the slot it runs in, mix_place its place in the block. Sorted by
    slot and place the rows are the mixture. Null sources form a source of their own; rows with one id keep the
    order of their hash. Repeated rows each take a place. Columns of ``docs`` named like the added ones, or like one that
    is used on the way (they begin with ``mix_``), are replaced. An empty table gives an empty result.
    """
    shown = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]
    docs = docs.drop(*shown, *[f"mix_{n}" for n in ("source", "number", "hash", "ranges", "range", "before", "share", "period", "turn", "at")])
    # One row a source: written, so that the documents are counted once and Spark knows how small the table is.
    sizes = materialize(source_sizes(docs, source_col=source_col), "mix-sources")
    if weights is None:
        weights = flattened_weights(sizes)
    else:
        weights = weights.groupBy(_source("source").alias("mix_source")).agg(F.floor(F.sum("weight") * 1000).cast("bigint").alias("weight"))
    # A period's slots: bounded by the period and the number of sources, not by the documents.
    table = materialize(period_table(period_shares(weights, period)), "mix-period")
    table = table.select("mix_source", *[F.col(c).alias(f"mix_{c}") for c in ("share", "period", "turn", "at")])
    shares = table.select("mix_source", "mix_share").distinct()
    rows = _numbered(docs, sizes, id_col, source_col).join(shares, "mix_source")
    rows = rows.withColumn("mix_block", F.expr(f"mix_number div {block_docs}")).withColumn("mix_place", (F.col("mix_number") % block_docs).cast("int"))
    rows = rows.withColumn("mix_turn", (F.col("mix_block") % F.col("mix_share")).cast("int")).drop("mix_share").join(table, ["mix_source", "mix_turn"])
    slot = F.expr("(mix_block div mix_share) * mix_period + mix_at")
    release = F.expr("(mix_block * mix_period) div mix_share")
    deadline = F.expr("((mix_block + 1) * mix_period + mix_share - 1) div mix_share")
    rows = rows.withColumn("mix_release", release).withColumn("mix_deadline", deadline).withColumn("mix_slot", slot)
    return rows.select(*docs.columns, *shown)


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, with the columns of ``docs``; written files keep the order."""
    names = docs.columns
    return schedule(docs, weights, id_col=id_col, **options).orderBy("mix_slot", "mix_place").select(*names)


ORACLE_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT coalesce('s' || source, 'null') AS k, source, cast(floor(sqrt(n) * 1000) AS BIGINT) AS weight FROM n),
b AS (SELECT *, count(*) OVER () AS sources, sum(weight) OVER () AS total, greatest({PERIOD}, 4 * count(*) OVER ()) AS period FROM w),
f AS (SELECT *, 1 + (period - sources) * weight // total AS base, (period - sources) * weight % total AS rest FROM b),
a AS (SELECT k, source, period, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= period - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM f),
l AS (SELECT list(cast(share AS BIGINT) ORDER BY k) AS shares, list(k ORDER BY k) AS ks, max(cast(period AS BIGINT)) AS period FROM a),
r AS (
  SELECT cast(-1 AS BIGINT) AS t, [cast(0 AS BIGINT) FOR x IN shares] AS done, cast(0 AS BIGINT) AS pick, shares, ks, period FROM l
  UNION ALL
  SELECT t + 1, [done[i] + (CASE WHEN i = p THEN 1 ELSE 0 END) FOR i IN range(1, len(shares) + 1)], p, shares, ks, period FROM (
    SELECT *, list_min([CASE WHEN done[i] < shares[i] AND done[i] * period // shares[i] <= t + 1
      THEN ((done[i] + 1) * period + shares[i] - 1) // shares[i] * 100000 + i END FOR i IN range(1, len(shares) + 1)]) % 100000 AS p FROM r
  ) WHERE t + 1 < period
),
s AS (SELECT ks[pick] AS k, t AS at_slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn, shares[pick] AS share, period FROM r WHERE t >= 0),
d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS k,
  row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS number FROM documents),
e AS (SELECT doc_id, d.source, d.k, number // {BLOCK_DOCS} AS block, number % {BLOCK_DOCS} AS place, cast(share AS BIGINT) AS share FROM d JOIN a ON a.k = d.k)
SELECT doc_id, source, cast(block AS BIGINT) AS block, cast(block * period // e.share AS BIGINT) AS release,
  cast(((block + 1) * period + e.share - 1) // e.share AS BIGINT) AS deadline,
  cast(block // e.share * period + at_slot AS BIGINT) AS slot, cast(place AS INTEGER) AS place
FROM e JOIN s ON s.k = e.k AND s.turn = e.block % e.share
"""
