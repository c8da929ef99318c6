"""Importance resampling of documents towards a target corpus, by hashed word n-grams.

A document's features are its runs of 1 to 3 words, hashed to ``BUCKETS`` buckets. A bucket's gain is the log ratio of its
smoothed shares in the target and in the documents; a document's weight is the sum over its features. Adding Gumbel
noise to the weights and taking the highest draws without replacement in proportion to the exponents of the weights.

Higher-order functions make one array of buckets of each document, which is written once. Counting adds it up inside each task
and shuffles a total for each bucket; scoring looks each bucket up in an array literal of all gains, without a join and
without a row for each feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh_name, materialize

#: Fixed values of the feature hash and the draw.
BUCKETS = 10_000
LONGEST = 3
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Accuracy of the quantile that bounds from below the scores which are sorted: an error of one rank in so many.
ACCURACY = 1000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case and all other letters as they are; null has none."""
    text = F.coalesce(text, F.lit(""))
    # Lower case is the same for a text of ASCII alone, and much cheaper than a map of characters.
    plain = F.octet_length(text) == F.char_length(text)
    # Splitting between words takes an eighth of the time of extracting them: a match copies the text.
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL)), BETWEEN), "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def feature_buckets(found: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to 3 words: the CRC-32 of the run's bytes, modulo the number of buckets; repeats count."""
    hashed = lambda runs: F.transform(runs, lambda run: (F.crc32(run) % buckets).cast("int"))

    def extended(runs: Column, w: Column, length: int) -> Column:
        """Runs of one word more than ``runs``, which have ``length`` words."""
        left = F.greatest(F.size(w) - length, F.lit(0))
        return F.zip_with(F.slice(runs, F.lit(1), left), F.slice(w, F.lit(length + 1), left), lambda run, word: F.concat(run, F.lit(" "), word))

    def from_length(w: Column, runs: Column, length: int) -> Column:
        if length == LONGEST:
            return hashed(runs)
        return F.concat(hashed(runs), _let(extended(runs, w, length), lambda longer: from_length(w, longer, length + 1)))

    return _let(found, lambda w: from_length(w, w, 1))


def bucketed(docs: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` without its text, with ``n_words`` and the array ``buckets``."""
    both = _let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), feature_buckets(w, buckets).alias("buckets")))
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_words", "buckets")]
    made = fresh_name(docs, "made")
    return docs.select(*kept, both.alias(made)).select(*kept, f"{made}.n_words", f"{made}.buckets")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): features in each bucket; tasks add up their own rows, at most one total a bucket and task is shuffled."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket in thousandths of the natural log ratio of its smoothed shares; one number for each bucket."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    # One row a bucket: a window over all of them holds BUCKETS rows, whatever the corpus.
    whole = Window.partitionBy()
    total = lambda c: F.sum(c).over(whole).cast("double")
    ratio = ((F.col("t") + 1).cast("double") * (total("s") + buckets)) / ((F.col("s") + 1).cast("double") * (total("t") + buckets))
    return [r.gain for r in both.select("bucket", F.floor(F.log(ratio) * 1000).cast("bigint").alias("gain")).orderBy("bucket").collect()]


def weight(buckets: Column, gain: list[int]) -> Column:
    """Sum of the gains of an array of buckets; 0 for an empty one."""
    # A literal of one text, which Spark folds to one array: not one expression for each bucket.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, b + 1))


def gumbel(id_col: Column, seed: int = 42) -> Column:
    """Gumbel noise of a row in thousandths, from the SHA-256 of the seed and its id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("bigint")


def _ranked(rows: DataFrame, wanted: int) -> DataFrame:
    """``rows`` with ``rank`` of the ``wanted`` highest, null for the rest; columns ``doc``, ``score``, ``open``.

    Rows are dealt out by ranges of the order; a place is the place in its range plus the rows of the ranges before,
    so no task sorts more than one range.
    """
    rank = F.lit(None).cast("bigint")
    eligible = rows.where("open")
    if wanted < 1:
        return rows.withColumn("rank", rank)
    share = 1 - wanted / eligible.count() - 2 / ACCURACY
    # The quantile is off by one rank in ACCURACY at most, so that all of the wanted lie at or above it.
    low = eligible.agg(F.percentile_approx("score", max(share, 0.0), ACCURACY)).first()[0] if share > 0 else None
    high = F.col("open") if low is None else F.col("open") & (F.col("score") >= low)
    order = [F.desc("score"), F.asc_nulls_first("doc")]
    part = fresh_name(rows, "part")
    tall = materialize(rows.where(high).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "resampling-ranges")
    before = F.sum("n").over(Window.orderBy(part)) - F.col("n")
    # One row a range.
    ahead = tall.groupBy(part).agg(F.count("*").alias("n")).select(part, before.alias("ahead"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col("ahead")
    drawn = tall.join(F.broadcast(ahead), part).withColumn("rank", place).drop(part, "ahead")
    return drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(rows.where(~high).withColumn("rank", rank))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``, all BIGINT but the id.

    :param target: the texts whose distribution the draw leans to.
    :param percent: of N rows of at least ``min_words`` words, floor(percent * N / 100) are drawn; ``rank`` counts them
        from the highest score, ties by the smaller id, and is null for all others.

    Null and empty texts have no features and weight 0. Rows that repeat an id each keep their row, draw the same noise
    and count on their own; a null id hashes as empty and ranks first among ties. Empty tables, of documents or of the
    target, give counts of zero: every bucket then has the smoothed share. Other columns play no part.
    """
    rows = bucketed(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), buckets=buckets)
    rows = materialize(rows, "resampling-buckets")
    wish = bucketed(target.select(F.col(target_text).alias("text")), buckets=buckets)
    gain = gains(bucket_counts(rows), bucket_counts(wish), buckets)
    made = weight(F.col("buckets"), gain)
    scored = rows.select("doc", (F.col("n_words") >= min_words).alias("open"), F.size("buckets").cast("bigint").alias("n_features"), made.alias("weight"))
    scored = materialize(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc"), seed)), "resampling-scores")
    wanted = scored.where("open").count() * percent // 100
    return _ranked(scored, wanted).select(F.col("doc").alias(id_col), "n_features", "weight", "score", "rank")


ORACLE_SQL = rf"""
WITH poly AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b::UINTEGER] || [x::UINTEGER FOR x IN range(8)], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UINTEGER) ELSE a >> 1 END) AS r FROM range(256) v(b))),
w AS (SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT side, doc_id, array_to_string(w[i:i + k - 1], ' ') AS f FROM w, range(1, 4) l(k), unnest(range(1, len(w) - k + 2)) u(i)),
g AS (SELECT f, [('0x' || h)::UINTEGER FOR h IN regexp_extract_all(hex(encode(f)), '..')] AS bytes FROM (SELECT DISTINCT f FROM f)),
h AS (SELECT f, xor(list_reduce([4294967295::UINTEGER] || bytes, lambda a, v: xor(a >> 8, poly.t[(xor(a, v) & 255) + 1])), 4294967295::UINTEGER)::BIGINT % {BUCKETS} AS bucket FROM g, poly),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN h USING (f) GROUP BY bucket),
e AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n)::DOUBLE + {BUCKETS})) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM n),
x AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN h USING (f) JOIN e USING (bucket) WHERE side = 'd' GROUP BY doc_id),
y AS (SELECT doc_id, len(w) >= 20 AS open, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM w LEFT JOIN x USING (doc_id) WHERE side = 'd'),
z AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY open ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (open) OVER () * 5 // 100 AS wanted FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= wanted THEN place END::BIGINT AS rank FROM z
"""
