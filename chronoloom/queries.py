"""Registered queries over the test tables, with their DuckDB text.

The tables play the model's parts: a user's events are a stream of packets (event_id the packet number, ts the arrival),
orders and lineitem packets and samples, conversations a dense key set, embeddings fixed-width values. IDs in the
docstrings are those of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import canonical, scalars
from .operators import catalog, chains, checks, folds, payloads, profile, refs, verdict
from .plans.verify import ORIGIN_FIELDS, Fleet
from .sources import frames, logs, push, recordings, synthetic
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "packet_range_by_stream"
STREAM = ["user_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of the tables it names as arguments."""

    def put(function: Callable) -> Callable:
        tables = function.__code__.co_varnames[: function.__code__.co_argcount]
        QUERIES[function.__name__] = lambda spark, sf_dir: function(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return put


@query("""
WITH s AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n_rows, bool_and(coalesce(step > 0, true)) AS increasing FROM s GROUP BY user_id
""")
def packet_range_by_stream(events):
    """AGG-01, AGG-02, WIN-01: range of packet numbers of each stream in row order."""
    return checks.packet_range(events, STREAM, "event_id", "event_id")


@query("""
SELECT user_id, event_id, value, before FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before
""")
def strictly_increasing_steps(events):
    """WIN-01, WIN-05: rows whose value does not exceed the one before."""
    return checks.not_increasing(events, STREAM, "event_id", "value").select("user_id", "event_id", "value", "before")


@query("""
WITH s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, min(event_id) AS at, arg_min(before, event_id) AS before, arg_min(value, event_id) AS value FROM s WHERE value <= before GROUP BY user_id
""")
def first_violation(events):
    """WIN-10, FLT-02: only the first such row of each stream."""
    return checks.first_not_increasing(events, STREAM, "event_id", "value")


@query("""
SELECT user_id, before AS after, event_id - before - 1 AS missing FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id - before > 1
""")
def sequence_gaps(events):
    """Gaps of the packet counter; reported, never judged."""
    return checks.sequence_gaps(events, STREAM, "event_id")


@query("""
WITH c AS (SELECT user_id, event_type, min(event_id) AS f, max(event_id) AS l, min(event_id) % 97 AS chunk_id FROM events GROUP BY user_id, event_type),
o AS (SELECT *, lag(chunk_id) OVER (PARTITION BY user_id ORDER BY event_type) AS pc,
  last_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM c)
SELECT user_id, event_type, chunk_id, coalesce(chunk_id <= pc, false) AS id_order, coalesce(f <= pl, false) AS range_order FROM o WHERE coalesce(chunk_id <= pc, false) OR coalesce(f <= pl, false)
""")
def chain_order(events):
    """WIN-02: chunks whose id or packet range does not come after the chunk before."""
    chunks = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"), F.max("event_id").alias("l"), (F.min("event_id") % 97).alias("chunk_id"))
    return checks.chain_order(chunks, STREAM, "event_type", "chunk_id", "f", "l").select("user_id", "event_type", "chunk_id", "id_order", "range_order")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus <> 'F') USING (l_orderkey)")
def orphan_children(lineitem, orders):
    """JOIN-02, JOIN-03: child rows without a parent."""
    parents = orders.where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return checks.orphans(lineitem.select("l_orderkey", "l_linenumber"), parents, ["l_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, n AS parent_size FROM lineitem JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) USING (l_orderkey) WHERE l_linenumber - 1 >= n OR l_linenumber - 1 < 0
""")
def index_out_of_range(lineitem):
    """JOIN-04, FLT-03: sample index outside 0..size-1 of its packet."""
    sizes = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("i"))
    return checks.index_out_of_range(rows, sizes, ["l_orderkey"], "i", "n").select("l_orderkey", "l_linenumber", "parent_size")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_sample_keys(lineitem):
    """AGG-05, SET-05: keys that occur more than once."""
    return checks.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"])


@query("""
WITH p AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, unnest(range(0, n)) AS turn FROM p), a AS (SELECT conv_id, CASE WHEN turn % 7 = 6 THEN turn - 1 ELSE turn END AS turn FROM conversations WHERE turn % 5 <> 3),
w AS (SELECT conv_id, turn, count(*) AS want FROM e GROUP BY ALL), h AS (SELECT conv_id, turn, count(*) AS have FROM a GROUP BY ALL)
SELECT conv_id, turn, greatest(coalesce(want, 0) - coalesce(have, 0), 0) AS n_missing, greatest(coalesce(have, 0) - coalesce(want, 0), 0) AS n_extra
FROM w FULL JOIN h USING (conv_id, turn) WHERE coalesce(want, 0) <> coalesce(have, 0)
""")
def dense_key_difference(conversations):
    """JOIN-06, JOIN-07, SET-03, AGG-04: expected dense keys against the keys there, as multisets."""
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    actual = conversations.where("turn % 5 != 3").select("conv_id", F.expr("if(turn % 7 = 6, turn - 1, turn)").alias("turn"))
    return checks.multiset_difference(checks.expected_dense_keys(sizes, ["conv_id"], "n", "turn"), actual, ["conv_id", "turn"])


@query("""
WITH w AS (SELECT o_orderkey, cast(sum(o_custkey % 5) AS BIGINT) AS expected FROM orders GROUP BY 1), h AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, expected, coalesce(n, 0) AS actual FROM w LEFT JOIN h ON l_orderkey = o_orderkey WHERE expected <> coalesce(n, 0)
""")
def expected_row_totals(orders, lineitem):
    """AGG-06: totals of declared sizes against rows."""
    parents = orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("n"))
    return checks.row_totals(parents, lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "n")


@query("SELECT vec_id, cast(channel AS INTEGER) AS channel FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS channel FROM embeddings) WHERE channel >= 60 OR channel % 16 = 5")
def channel_membership(embeddings):
    """JOIN-05: samples of channels that the descriptor does not list."""
    samples = embeddings.select("vec_id", F.posexplode("embedding").alias("channel", "value"))
    channels = embeddings.sparkSession.range(60).where("id % 16 != 5").select(F.col("id").cast("int").alias("channel"))
    return checks.membership(samples, channels, [], "channel").select("vec_id", "channel")


@query("SELECT vec_id, cast(channel - 1 AS INTEGER) AS channel, cast(embedding[channel] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS channel FROM embeddings)")
def dense_to_sparse(embeddings):
    """PRJ-04: fixed-width values as one row a channel."""
    return embeddings.select("vec_id", F.posexplode("embedding").alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT vec_id, len(embedding)::INTEGER AS width, embedding[1]::DOUBLE AS first_value, embedding[64]::DOUBLE AS last_value FROM embeddings")
def sparse_to_dense(embeddings):
    """PRJ-04 back: sparse samples gathered by channel; the result's ends and width."""
    sparse = embeddings.select("vec_id", F.posexplode("embedding").alias("channel", "value"))
    dense = sparse.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("v"))
    return dense.select("vec_id", F.size("v").alias("width"), F.col("v")[0].cast("double").alias("first_value"), F.col("v")[63].cast("double").alias("last_value"))


@query("""
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 9 <> 4) d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL
""")
def two_way_presence(documents, labels):
    """JOIN-10, JOIN-14, SET-02: keys on one side only."""
    return checks.presence(documents.where("doc_id % 9 != 4"), labels, ["doc_id"])


@query("""
WITH s AS (SELECT url, md5(html) AS h FROM pages WHERE page_id % 11 <> 0), a AS (SELECT url, CASE WHEN page_id % 13 = 0 THEN 'x' ELSE md5(html) END AS h FROM pages WHERE page_id % 17 <> 0)
SELECT url, CASE WHEN a.h IS NULL THEN 'missing' WHEN s.h IS NULL THEN 'unexpected' ELSE 'hash_mismatch' END AS problem FROM s FULL JOIN a USING (url) WHERE a.h IS DISTINCT FROM s.h
""")
def sealed_file_set(pages):
    """JOIN-08, JOIN-09, JOIN-10, JOIN-15: listed digests against the files there."""
    digest = F.md5(F.col("html").cast("binary"))
    sealed = pages.where("page_id % 11 != 0").select("url", digest.alias("h"))
    actual = pages.where("page_id % 17 != 0").select("url", F.when(F.col("page_id") % 13 == 0, "x").otherwise(digest).alias("h"))
    return checks.sealed_mismatch(sealed, actual, ["url"], "h", nulls_meet=False)


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus, o_orderkey IS NOT NULL AS matched FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 10 <> 3) ON l_orderkey = o_orderkey
""")
def strict_payload_join(lineitem, orders):
    """JOIN-01: join in which every left row must find its match."""
    right = orders.where("o_custkey % 10 != 3").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return checks.unmatched_strict(lineitem.select("l_orderkey", "l_linenumber"), right, ["l_orderkey"])


@query("""
WITH e AS (SELECT *, sha256(props) AS h FROM events), l AS (SELECT user_id, event_id, h, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS p FROM e)
SELECT user_id, event_id, h AS sha256, p AS expected_prev FROM l
""")
def hash_chain(events):
    """WIN-03, SCA-01, SCA-23: hash of each record and the hash it must name."""
    return chains.link(events, STREAM, "event_id", "props").select("user_id", "event_id", "sha256", "expected_prev")


@query("""
WITH e AS (SELECT user_id, event_id, sha256(props) AS h FROM events),
l AS (SELECT user_id, event_id, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS want FROM e),
b AS (SELECT *, CASE WHEN event_id % 41 = 7 THEN 'forged' ELSE want END AS prev FROM l),
c AS (SELECT *, max(CASE WHEN prev <> want THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS broken FROM b)
SELECT user_id, event_id FROM c WHERE broken = 0
""")
def chain_valid_prefix(events):
    """WIN-03, WIN-04, SRC-09, SRC-14: records before the first break of a chain."""
    linked = chains.link(events, STREAM, "event_id", "props")
    prev = F.when(F.col("event_id") % 41 == 7, "forged").otherwise(F.col("expected_prev"))
    marked = linked.withColumn("bad", prev != F.col("expected_prev"))
    return chains.valid_prefix(marked, STREAM, "event_id", "bad").select("user_id", "event_id")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def content_hash(documents):
    """SCA-01: SHA-256 and length in bytes of whole contents."""
    body = F.col("text").cast("binary")
    return documents.select("doc_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("n_bytes"))


_OUTCOME = """CASE event_id % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'ABORTED' WHEN 2 THEN 'TECHNICAL_FAILURE' ELSE 'UNCLASSIFIED' END"""
_FROM = """CASE WHEN event_id % 3 = 0 THEN 'COMPLETED' WHEN event_id % 3 = 1 THEN 'UNCLASSIFIED' ELSE 'ABORTED' END"""


@query(f"""
WITH RECURSIVE a AS (SELECT user_id, event_id, {_FROM} AS f, {_OUTCOME} AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  CASE WHEN user_id % 2 = 0 THEN 'COMPLETED' ELSE 'UNCLASSIFIED' END AS sealed FROM events),
r AS (SELECT DISTINCT user_id, sealed, sealed AS outcome, cast(0 AS BIGINT) AS n, cast(0 AS BIGINT) AS accepted, cast(0 AS BIGINT) AS c, cast(0 AS BIGINT) AS s, cast(0 AS BIGINT) AS p FROM a
  UNION ALL
  SELECT r.user_id, r.sealed, CASE WHEN ok THEN t ELSE outcome END, r.n + 1, accepted + ok::BIGINT, c + (t = 'COMPLETED')::BIGINT, s + (t <> 'COMPLETED' AND f <> outcome)::BIGINT, p + (t <> 'COMPLETED' AND f = outcome AND NOT ok)::BIGINT
  FROM r JOIN (SELECT * FROM a) a ON a.user_id = r.user_id AND a.n = r.n + 1,
  LATERAL (SELECT t <> 'COMPLETED' AND f = outcome AND f IN ('COMPLETED', 'UNCLASSIFIED') AND t IN ('ABORTED', 'TECHNICAL_FAILURE') AS ok))
SELECT user_id, sealed, outcome, accepted, c AS target_completed, s AS stale_from, p AS not_permitted FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
""")
def outcome_fold(events):
    """WIN-06, FLT-15, FLT-23: annotations applied in order, with three reasons of refusal."""
    records = events.select("user_id", "event_id", F.expr(_FROM).alias("f"), F.expr(_OUTCOME).alias("t"), F.expr("if(user_id % 2 = 0, 'COMPLETED', 'UNCLASSIFIED')").alias("sealed"))
    made = folds.effective_outcome(records, STREAM, "event_id", "f", "t", "sealed")
    count = lambda reason: F.size(F.filter("rejected", lambda x: x["reason"] == reason)).cast("bigint")
    return made.select("user_id", "sealed", "outcome", "accepted", count("TARGET_COMPLETED").alias("target_completed"), count("STALE_FROM").alias("stale_from"), count("TRANSITION_NOT_PERMITTED").alias("not_permitted"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_state(events):
    """AGG-08, AGG-20: the last record of each log by position."""
    return folds.last_record(events, STREAM, "event_id", ["event_type", "value"])


@query("""
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state FROM events)
SELECT * FROM s WHERE from_state IS NOT NULL AND (from_state || '>' || event_type) NOT IN ('view>click', 'click>purchase', 'view>view', 'click>view')
""")
def transition_validity(events):
    """WIN-07, SNK-08: records whose state may not follow the one before."""
    pairs = (("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"))
    return folds.invalid_transitions(events.select("user_id", "event_id", "event_type"), STREAM, "event_id", "event_type", pairs)


@query("""
WITH s AS (SELECT user_id, event_id, cast(value AS DECIMAL(18,2)) AS v, row_number() OVER w - 2 AS pos, cast(value AS DECIMAL(18,2)) - lag(cast(value AS DECIMAL(18,2))) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS n, arg_min(v, event_id)::DOUBLE AS first_value, arg_max(v, event_id)::DOUBLE AS last_value, min(v)::DOUBLE AS min_value, max(v)::DOUBLE AS max_value,
  bool_and(coalesce(step >= 0, true)) AS non_decreasing, bool_and(coalesce(step > 0, true)) AS strictly_increasing, count(DISTINCT step) AS distinct_steps, min(step)::DOUBLE AS step_min, max(step)::DOUBLE AS step_max,
  cast(count(*) FILTER (step < 0) AS BIGINT) AS n_backward, array_to_string(list_slice(list(pos ORDER BY pos) FILTER (step < 0), 1, 20), ',') AS backward_positions FROM s GROUP BY user_id
""")
def series_profile(events):
    """AGG-09, WIN-05, SCA-22: description of a series in one pass."""
    exact = events.select("user_id", "event_id", F.col("value").cast("decimal(18,2)").alias("v"))
    made = profile.series_profile(exact, STREAM, "event_id", "v")
    plain = {c: F.col(c).cast("double") for c in ("first_value", "last_value", "min_value", "max_value", "step_min", "step_max")}
    return made.withColumns(plain).withColumn("backward_positions", F.array_join("backward_positions", ","))


@query("""
SELECT user_id, count(*) AS n, CASE WHEN max(ts) > min(ts) THEN (count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) END AS rate FROM events GROUP BY user_id
""")
def arrival_rate(events):
    """AGG-10: packets a second between the first and the last arrival."""
    at = scalars.epoch_micros(F.col("ts"))
    made = events.groupBy("user_id").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    return made.select("user_id", "n", profile.arrival_rate(F.lit(0), (F.col("b") - F.col("a")) / 1000000, F.col("n")).alias("rate"))


@query("""
SELECT user_id, event_id, 'value' AS name, 'float64' AS value_type, cast(NULL AS BIGINT) AS value_i64, value AS value_f64 FROM events
UNION ALL SELECT user_id, event_id, 'k', 'int64', cast(json_extract_string(props, '$.k') AS BIGINT), NULL FROM events
""")
def typed_observation_unpivot(events):
    """SRC-44: columns as typed observation rows."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events.select("user_id", "event_id", F.explode(F.array(
        F.struct(F.lit("value").alias("name"), F.lit("float64").alias("value_type"), F.lit(None).cast("bigint").alias("value_i64"), F.col("value").alias("value_f64")),
        F.struct(F.lit("k").alias("name"), F.lit("int64").alias("value_type"), k.alias("value_i64"), F.lit(None).cast("double").alias("value_f64")))).alias("o"))
    return rows.select("user_id", "event_id", "o.*")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'value_type' WHEN event_type NOT IN ('view', 'click') THEN 'kind' WHEN event_id % 7 = 0 THEN 'name'
  WHEN (event_id % 3 = 0)::INTEGER + (event_id % 2 = 0)::INTEGER <> 1 OR event_id % 2 <> 0 THEN 'value' END AS error FROM events
""")
def exactly_one_value(events):
    """FLT-01, FLT-21: validity of typed observation rows."""
    rows = events.select("event_id", F.col("event_type").alias("kind"), F.expr("if(event_id % 7 = 0, '', 'n')").alias("name"), F.expr("if(event_id % 5 = 0, 'text', 'float64')").alias("value_type"),
        F.expr("if(event_id % 3 = 0, event_id, null)").alias("value_i64"), F.expr("if(event_id % 2 = 0, value, null)").alias("value_f64"))
    return rows.select("event_id", checks.observation_errors(rows, {"kind": ["view", "click"]}, {"int64": "value_i64", "float64": "value_f64"}).alias("error"))


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#0*[1-9][0-9]{0,2}') AS ok, regexp_full_match(replace(c_name, 'Customer#000000', 'P'), 'P[0-9]{3,6}') AS pseudonym FROM customer")
def identifier_pattern(customer):
    """SCA-13: identifiers of a fixed form."""
    return customer.select("c_custkey", F.col("c_name").rlike(r"\ACustomer#0*[1-9][0-9]{0,2}\z").alias("ok"), scalars.is_pseudonym(F.replace("c_name", F.lit("Customer#000000"), F.lit("P"))).alias("pseudonym"))


_PATH = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN replace(url, '/', '\\') WHEN 3 THEN url || ' ' WHEN 4 THEN replace(replace(url, '://', '/'), '//', '/') ELSE '..' END"


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS p FROM pages)
SELECT page_id, CASE WHEN p = '' OR p <> trim(p) THEN 'empty_or_padded' WHEN contains(p, '\\') THEN 'illegal_character' WHEN starts_with(p, '/') THEN 'absolute'
  WHEN len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) > 0 THEN 'empty_or_traversal_segment' END AS error FROM p
""")
def path_safety(pages):
    """SCA-11: why a relative path is not safe."""
    path = F.expr(_PATH.replace("'\\'", "'\\\\'"))
    return pages.select("page_id", scalars.path_error(path).alias("error"))


@query("""
SELECT event_id, epoch_us(ts) * 1000 AS ns, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS text, CASE WHEN event_id % 3 = 1 THEN NULL ELSE epoch_us(ts) * 1000 END AS parsed FROM events
""")
def ns_roundtrip(events):
    """SCA-06, SCA-24, FLT-19: nanoseconds as canonical decimal text and back; other spellings are refused."""
    ns = scalars.epoch_ns(F.col("ts"))
    text = F.expr("case event_id % 3 when 0 then text when 1 then concat('0', text) else text end")
    rows = events.select("event_id", ns.alias("ns")).withColumn("text", F.col("ns").cast("string"))
    return rows.select("event_id", "ns", "text", scalars.int64(text).alias("parsed"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN cast(18446744073709551615 AS DECIMAL(20,0)) ELSE cast(p_partkey AS DECIMAL(20,0)) END AS value FROM part
""")
def unsigned_domain(part):
    """SCA-06: unsigned 64-bit values, the largest included, one more refused."""
    text = F.expr("case p_partkey % 3 when 0 then '18446744073709551616' when 1 then '18446744073709551615' else cast(p_partkey as string) end")
    return part.select("p_partkey", scalars.uint64(text).alias("value"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, cast(json_extract_string(props, '$.k') AS BIGINT) + 1 AS a, event_id % 13 AS b, cast(1 AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, a AS sa, b AS sb, c AS sc, cast(0 AS BIGINT) AS chunk FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN x THEN e.a ELSE sa + e.a END, CASE WHEN x THEN e.b ELSE sb + e.b END, CASE WHEN x THEN e.c ELSE sc + e.c END, chunk + x::BIGINT
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT sa + e.a > 150 OR sb + e.b > 150 OR sc + e.c > 150 AS x))
SELECT user_id, event_id, chunk FROM r
""")
def chunking_by_rows(events):
    """WIN-08, STR-04: greedy chunks at packet boundaries under three counters."""
    rows = events.select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("a"), (F.col("event_id") % 13).alias("b"), F.lit(1).cast("bigint").alias("c"))
    return folds.chunks(rows, STREAM, ["event_id"], ["a", "b", "c"], max_rows=150).select("user_id", "event_id", "chunk")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS since, cast(0 AS BIGINT) AS chunk, false AS done FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, s, chunk + done::BIGINT, e.t - s >= 3600000000 * 24 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT CASE WHEN done THEN e.t ELSE since END AS s))
SELECT user_id, event_id, chunk FROM r
""")
def chunking_by_age(events):
    """WIN-08: chunks that end once they are a day old."""
    rows = events.select("user_id", "event_id", scalars.epoch_micros(F.col("ts")).alias("t"), F.lit(1).alias("one"))
    return folds.chunks(rows, STREAM, ["event_id"], ["one"], max_rows=0, max_age=24 * 3_600_000_000, time="t").select("user_id", "event_id", "chunk")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS last, true AS mark FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - last >= 7200000000 THEN e.t ELSE last END, e.t - last >= 7200000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, mark FROM r
""")
def periodic_marks(events):
    """WIN-09, WIN-12: a mark whenever two hours have passed since the last."""
    rows = events.select("user_id", "event_id", scalars.epoch_micros(F.col("ts")).alias("t"))
    return folds.periodic_marks(rows, STREAM, ["event_id"], "t", 7_200_000_000).select("user_id", "event_id", "mark")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value > 50 AS lv, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, lv, cast(NULL AS BIGINT) AS last, false AS edge FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.lv, CASE WHEN x THEN e.t ELSE last END, x FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT e.lv <> r.lv AND (last IS NULL OR e.t - last > 3600000000) AS x))
SELECT user_id, event_id, edge FROM r
""")
def debounce(events):
    """WIN-11: edges of a level, held for an hour after each accepted one."""
    rows = events.select("user_id", "event_id", (F.col("value") > 50).alias("level"), scalars.epoch_micros(F.col("ts")).alias("t"))
    return folds.debounced(rows, STREAM, ["event_id"], "level", "t", 3_600_000_000).select("user_id", "event_id", "edge")


@query("""
SELECT v.event_id, v.user_id, epoch_us(v.ts) AS t, min(epoch_us(c.ts)) AS reply FROM events v LEFT JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR
WHERE v.event_type = 'view' GROUP BY ALL
""")
def ping_reply_match(events):
    """JOIN-12: the first reply of the same stream within six hours, or none."""
    rows = events.select("event_id", "user_id", "event_type", scalars.epoch_micros(F.col("ts")).alias("t"))
    pings = rows.where("event_type = 'view'").select("event_id", "user_id", "t")
    return checks.interval_match(pings, rows.where("event_type = 'click'").select("user_id", F.col("t").alias("at")), STREAM, "t", "at", F.lit(6 * 3_600_000_000))


@query("""
WITH m AS (SELECT v.user_id, v.event_id, count(c.event_id) AS n FROM events v LEFT JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' GROUP BY ALL)
SELECT user_id, count(*) AS attempted, cast(count(*) FILTER (n = 0) AS BIGINT) AS lost FROM m GROUP BY user_id
""")
def lost_pings(events):
    """AGG-17: pings and those without a reply within an hour."""
    rows = events.select("event_id", "user_id", "event_type", scalars.epoch_micros(F.col("ts")).alias("t"))
    pings = rows.where("event_type = 'view'").select("event_id", "user_id", "t")
    met = checks.interval_match(pings, rows.where("event_type = 'click'").select("user_id", F.col("t").alias("at")), STREAM, "t", "at", F.lit(3_600_000_000))
    return met.groupBy("user_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("reply").isNull()).alias("lost"))


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events
""")
def latest_prior_event(events):
    """As-of: the last purchase before each event."""
    prior = checks.latest_before(events, STREAM, ["event_id"], F.when(F.col("event_type") == "purchase", F.col("value")))
    return events.select("user_id", "event_id", prior.alias("prior"))


@query("""
WITH s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, value, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS place FROM s WHERE value <= before QUALIFY place <= 3
""")
def topk_evidence(events):
    """AGG-16, SRT-05, SRT-07: the first three violations of each stream."""
    found = checks.not_increasing(events, STREAM, "event_id", "value")
    return checks.first_evidence(found, STREAM, ["event_id"], 3).select("user_id", "event_id", "value", "place")


@query("""
WITH f AS (SELECT user_id, cast(1 + event_id % 8 AS INTEGER) AS condition FROM events WHERE event_id % 37 = 0), u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT user_id, cast(n AS INTEGER) AS condition FROM u, range(1, 9) t(n))
SELECT user_id, count(*) AS n_conditions, cast(count(*) FILTER ((user_id, condition) IN (SELECT (user_id, condition) FROM f)) AS BIGINT) AS n_failed, count(*) FILTER ((user_id, condition) IN (SELECT (user_id, condition) FROM f)) = 0 AS is_completed FROM c GROUP BY user_id
""")
def condition_rollup(events):
    """FLT-11, AGG-14, VER: eight conditions of each session and their verdict."""
    found = events.where("event_id % 37 = 0").select("user_id", (1 + F.col("event_id") % 8).cast("int").alias("condition"))
    return verdict.completed(verdict.conditions(events, found, "user_id", range(1, 9)), "user_id", 8)


@query("""
WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P' OR o_orderkey % 2 = 0) AS submitted, count(*) FILTER (o_orderstatus <> 'P') AS written, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS dropped, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 4 END) AS n_chunks FROM orders GROUP BY 1)
SELECT *, submitted = written + dropped AS accounted FROM o
""")
def accounting_identity(orders):
    """AGG-11, AGG-12, STR-08: measured totals of each stream and whether they add up; a row that is neither written nor late ends a stream."""
    rows = orders.select("o_custkey", F.expr("if(o_orderstatus != 'P', o_orderkey % 4, null)").alias("chunk"), F.expr("o_orderstatus = 'P' and o_orderkey % 2 = 0").alias("late"))
    return ingest.accounting(rows, ["o_custkey"])


@query("""
WITH s AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 10 <> 0),
f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 13 <> 0)
SELECT c_custkey, 'not_in_stored' AS kind, NULL::VARCHAR AS field, NULL::VARCHAR AS stored, NULL::VARCHAR AS fresh FROM f ANTI JOIN s USING (c_custkey)
UNION ALL SELECT c_custkey, 'not_in_fresh', NULL, NULL, NULL FROM s ANTI JOIN f USING (c_custkey)
UNION ALL SELECT c_custkey, 'field_differs', 'c_mktsegment', s.c_mktsegment, f.c_mktsegment FROM s JOIN f USING (c_custkey) WHERE s.c_mktsegment IS DISTINCT FROM f.c_mktsegment
UNION ALL SELECT c_custkey, 'field_differs', 'c_nationkey', s.c_nationkey::VARCHAR, f.c_nationkey::VARCHAR FROM s JOIN f USING (c_custkey) WHERE s.c_nationkey IS DISTINCT FROM f.c_nationkey
""")
def registry_reconcile(customer):
    """JOIN-13: a stored catalogue against a fresh one, presence and fields."""
    stored = customer.where("c_custkey % 10 != 0")
    fresh = customer.where("c_custkey % 13 != 0").withColumns({"c_mktsegment": F.expr("if(c_custkey % 7 = 0, 'CHANGED', c_mktsegment)"), "c_nationkey": F.expr("if(c_custkey % 11 = 0, null, c_nationkey)")})
    return catalog.reconcile(stored, fresh, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'SEALED' WHEN s IN ('CLOSED', 'FINALIZING') THEN 'INTERRUPTED_FINALIZATION' WHEN s = 'RECORDING' THEN 'INTERRUPTED_RECORDING' WHEN s = 'ALLOCATED' THEN 'ALLOCATED_ONLY' ELSE 'UNREADABLE' END AS state
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'RECORDING' ELSE 'ALLOCATED' END END AS s FROM orders)
""")
def classify_state(orders):
    """FLT-12: structural state of a package."""
    terminal = F.expr("case o_orderstatus when 'F' then 'CLOSED' when 'O' then if(o_orderkey % 2 = 0, 'RECORDING', 'ALLOCATED') end")
    return orders.select("o_orderkey", verdict.structural_state(F.col("o_totalprice") > 300000, terminal).alias("state"))


@query("SELECT DISTINCT event_type AS schema_id FROM events WHERE event_id % 3 = 0 EXCEPT SELECT event_type FROM events WHERE event_type IN ('click')")
def referenced_schema_ids(events):
    """AGG-07, SET-02: ids in use without a snapshot."""
    used = events.where("event_id % 3 = 0").select(F.col("event_type").alias("schema_id")).distinct()
    return checks.orphans(used, events.where("event_type = 'click'").select(F.col("event_type").alias("schema_id")), ["schema_id"])


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS findings, cast(count(DISTINCT event_type) AS BIGINT) AS n FROM events WHERE value > 60 GROUP BY user_id")
def distinct_findings(events):
    """AGG-13, AGG-18: the set of findings of each session, sorted."""
    return verdict.finding_sets(events.where("value > 60"), "user_id", "event_type")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (value > 60) AS n_high, count(*) FILTER (event_type = 'view' AND value < 5) AS n_low_views FROM events GROUP BY user_id
""")
def finding_tallies(events):
    """AGG-19: how many findings of each kind a session has."""
    return verdict.tallies(events, "user_id", {"n_errors": F.expr("event_type = 'error'"), "n_high": F.expr("value > 60"), "n_low_views": F.expr("event_type = 'view' and value < 5")})


@query("""
WITH f AS (SELECT user_id, cast(1 + event_id % 8 AS INTEGER) AS condition, upper(event_type) AS finding FROM events WHERE value > 60),
k AS (SELECT user_id, condition, finding, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT user_id, list({'condition': condition, 'finding': finding, 'n': n} ORDER BY condition, finding) AS found FROM k GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, found IS NULL AS is_completed, '{"user_id":' || user_id || ',"completed":' || (found IS NULL)::VARCHAR || ',"failed_conditions":' || CASE WHEN found IS NULL THEN '[]' ELSE to_json(list_sort(list_distinct([x.condition FOR x IN found])))::VARCHAR END
  || ',"findings":' || CASE WHEN found IS NULL THEN '[]' ELSE to_json(found)::VARCHAR END || '}' AS report FROM u LEFT JOIN l USING (user_id)
""")
def session_reports(events):
    """SNK-24: a JSON report of the findings of each session."""
    found = events.where("value > 60").select("user_id", (1 + F.col("event_id") % 8).cast("int").alias("condition"), F.upper("event_type").alias("finding"))
    return verdict.reports(events, found, "user_id", range(1, 9))


@query("""
WITH p AS (SELECT event_id, event_type AS schema_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN replace(replace(props, ': ', ': "'), '}', '"}') WHEN 2 THEN replace(props, '}', ', "z": null}') WHEN 3 THEN '{}' WHEN 4 THEN '[1]' END AS payload FROM events),
r(schema_id, key, type, required, closed) AS (VALUES ('click', 'k', 'integer', true, true), ('view', 'k', 'number', true, true), ('view', 'z', 'null', false, true), ('purchase', 'k', 'string', false, false), ('signup', NULL, NULL, false, true)),
s AS (SELECT schema_id, bool_or(closed) AS closed FROM r GROUP BY schema_id),
o AS (SELECT p.*, s.closed, json_type(payload) = 'OBJECT' AS is_object FROM p JOIN s USING (schema_id)),
m AS (SELECT event_id, schema_id, closed, unnest(json_keys(payload)) AS key, payload FROM o WHERE is_object),
t AS (SELECT *, CASE json_type(json_extract(payload, '$.' || key)) WHEN 'UBIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' END AS have FROM m)
SELECT event_id, schema_id, 'unknown_schema' AS finding, NULL::VARCHAR AS key FROM p ANTI JOIN s USING (schema_id)
UNION ALL SELECT event_id, schema_id, 'not_an_object', NULL FROM o WHERE NOT coalesce(is_object, false)
UNION ALL SELECT event_id, o.schema_id, 'missing_key', r.key FROM o JOIN r ON r.schema_id = o.schema_id AND r.required WHERE is_object AND NOT list_contains(json_keys(payload), r.key)
UNION ALL SELECT event_id, schema_id, 'undeclared_key', t.key FROM t ANTI JOIN r USING (schema_id, key) WHERE closed
UNION ALL SELECT event_id, t.schema_id, 'wrong_type', t.key FROM t JOIN r USING (schema_id, key) WHERE type <> have AND NOT (type = 'number' AND have = 'integer')
""")
def event_payload_findings(events):
    """FLT-14, EXT-04, SNK-11: payloads of events against a registry of schemas by event type."""
    rules = [("click", "k", "integer", True, True), ("view", "k", "number", True, True), ("view", "z", "null", False, True), ("purchase", "k", "string", False, False), ("signup", None, None, False, True)]
    registry = events.sparkSession.createDataFrame(rules, "schema_id string, key string, type string, required boolean, closed boolean")
    payload = F.expr("""case event_id % 6 when 0 then props when 1 then replace(replace(props, ': ', ': "'), '}', '"}') when 2 then replace(props, '}', ', "z": null}') when 3 then '{}' when 4 then '[1]' end""")
    rows = events.select("event_id", F.col("event_type").alias("schema_id"), payload.alias("payload"))
    return payloads.payload_findings(rows, registry, ["schema_id"], "payload").drop("payload")


@query("""
WITH c AS (SELECT user_id, event_id // 512 AS chunk_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL),
p AS (SELECT user_id, event_id // 512 AS chunk_id, event_id AS packet_seq, row_number() OVER (PARTITION BY user_id, event_id // 512 ORDER BY event_id) - 1 AS row_index, 1 + event_id % 3 AS n FROM events),
r AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END AS user_id, event_id - CASE event_id % 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN event_id % 41 = 0 THEN 1000000 ELSE 0 END AS packet_seq, cast(event_id % 4 AS INTEGER) AS sample FROM events),
x AS (SELECT r.*, p.chunk_id AS at_chunk, p.row_index AS at_row, n, EXISTS (SELECT 1 FROM c WHERE c.user_id = r.user_id) AS known, EXISTS (SELECT 1 FROM c WHERE c.user_id = r.user_id AND r.packet_seq BETWEEN lo AND hi) AS inside FROM r LEFT JOIN p USING (user_id, packet_seq)),
y AS (SELECT *, CASE WHEN NOT known THEN 'no_stream' WHEN NOT inside THEN 'no_chunk' WHEN at_chunk IS NULL THEN 'no_packet' WHEN sample < 0 OR sample >= n THEN 'no_sample' END AS problem FROM x)
SELECT event_id, user_id, packet_seq, sample, CASE WHEN problem IS NULL THEN at_chunk END AS chunk_id, CASE WHEN problem IS NULL THEN at_row END AS row_index, problem FROM y
""")
def raw_references(events):
    """JOIN-18: pointers of events to raw rows, and those that dangle."""
    packets = events.select("user_id", F.expr("event_id div 512").alias("chunk_id"), F.col("event_id").alias("packet_seq"), (1 + F.col("event_id") % 3).alias("n_samples"))
    packets = packets.withColumn("row_index", (F.row_number().over(Window.partitionBy("user_id", "chunk_id").orderBy("packet_seq")) - 1).cast("bigint"))
    ranges = packets.groupBy("user_id", "chunk_id").agg(F.min("packet_seq").alias("first_seq"), F.max("packet_seq").alias("last_seq"))
    asked = events.select("event_id", F.expr("if(event_id % 50 = 0, -1L, user_id)").alias("user_id"), F.expr("event_id - if(event_id % 3 = 1, 1, 0) + if(event_id % 41 = 0, 1000000, 0)").alias("packet_seq"), (F.col("event_id") % 4).cast("int").alias("sample"))
    return refs.resolve(asked, ranges, packets, ["event_id"], ["user_id"], sample="sample")


@query("""
WITH o AS (SELECT c_custkey, list_value('recording', 'replay', 'synthetic')[1 + c_custkey % 3] AS kind, c_custkey % 5 = 0 AS no_session, c_custkey % 7 = 0 AS no_sha, c_custkey % 11 = 0 AS no_tool, c_custkey % 4 = 0 AS no_seed FROM customer),
m AS (SELECT c_custkey, kind, concat_ws(',', CASE WHEN kind = 'replay' AND no_session THEN 'source_session_id' END, CASE WHEN kind = 'replay' AND no_sha THEN 'source_manifest_sha256' END, CASE WHEN kind = 'replay' AND no_tool THEN 'replay_tool_version' END, CASE WHEN kind = 'synthetic' AND no_seed THEN 'generator_seed' END) AS missing FROM o)
SELECT * FROM m WHERE missing <> ''
""")
def origin_provenance(customer):
    """FLT-17: origins that do not say what their kind must say."""
    rows = customer.select("c_custkey", F.expr("element_at(array('recording', 'replay', 'synthetic'), cast(1 + c_custkey % 3 as int))").alias("kind"), F.expr("if(c_custkey % 5 = 0, null, c_name)").alias("source_session_id"), F.expr("if(c_custkey % 7 = 0, null, sha2(c_name, 256))").alias("source_manifest_sha256"), F.expr("if(c_custkey % 11 = 0, null, '1')").alias("replay_tool_version"), F.expr("if(c_custkey % 4 = 0, null, c_custkey)").alias("generator_seed"))
    missing = checks.implication_errors([(F.col("kind") == kind, fields) for kind, fields in ORIGIN_FIELDS.items()])
    return rows.select("c_custkey", "kind", F.array_join(missing, ",").alias("missing")).where("missing != ''")


@query("SELECT p_partkey, format('{:06d}', p_partkey) AS chunk, 'payloads/' || format('{:06d}', p_partkey) || '.bin' AS payload_path, 'packets/' || format('{:06d}', p_partkey) || '.arrow' AS packets_path, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS stem, replace(lower(p_brand), '_', '') AS label FROM part")
def derived_names(part):
    """PRJ-03, SCA-18, SCA-19: names derived from ids and labels."""
    path = lambda kind: scalars.artifact_path(F.lit(kind), F.col("p_partkey"))
    return part.select("p_partkey", F.format_string("%06d", "p_partkey").alias("chunk"), path("payloads").alias("payload_path"), path("packets").alias("packets_path"), scalars.file_stem(F.col("p_name")).alias("stem"), scalars.label_key(F.col("p_brand")).alias("label"))


@query("SELECT event_id, '{\"event\":' || event_id || ',\"name\":\"' || event_type || '\",\"user\":' || user_id || '}' AS canonical, sha256('{\"event\":' || event_id || ',\"name\":\"' || event_type || '\",\"user\":' || user_id || '}') AS record_sha256 FROM events")
def canonical_records(events):
    """SCA-02, SCA-03, SCA-04, SCA-05: records in canonical form and their hash."""
    raw = F.format_string('{"user": %d, "name": "%s", "event" : %d}', "user_id", "event_type", "event_id")
    rows = events.select("event_id", canonical.canonical_json(raw).alias("canonical"))
    return rows.withColumn("record_sha256", F.sha2(F.col("canonical").cast("binary"), 256))


@query("""
WITH poly AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b::UINTEGER] || [x::UINTEGER FOR x IN range(8)], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160::UINTEGER) ELSE a >> 1 END) AS r FROM range(256) v(b))),
e AS (SELECT event_id, props, [('0x' || h)::UINTEGER FOR h IN regexp_extract_all(hex(encode(props)), '..')] AS bytes FROM events)
SELECT event_id, event_id AS packet_seq, props AS payload, xor(list_reduce([4294967295::UINTEGER] || bytes, lambda a, v: xor(a >> 8, poly.t[(xor(a, v) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS crc32c, NULL::VARCHAR AS error FROM e, poly
""")
def payload_frames(events):
    """SCA-07, SCA-08, SRC-07, SNK-02: frames of payload bytes with their CRC-32C, cut again."""
    # A file of few row groups is read by as few tasks; frames are made and cut by all.
    framed = events.select("event_id", "props").repartition("event_id", "props").select("event_id", canonical.frame(F.col("event_id"), F.col("props").cast("binary")).alias("data"))
    return framed.select("event_id", F.explode(canonical.parse_frames(F.col("data"))).alias("f")).select("event_id", "f.packet_seq", F.col("f.payload").cast("string").alias("payload"), "f.crc32c", "f.error")


def _fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, or in a temporary one where the session names none (tests)."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"chronoloom-{name}-")


def log_line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09 to SRC-16, SCA-03, SCA-09, SCA-10: a log for each user with planted bad lines, read by ranges of bytes, and what is wrong with each line."""
    out = _fresh_folder(spark, "logs")
    tails = F.create_map(*[x for i, t in enumerate(["}", "}", " }", "", "]", "}}"]) for x in (F.lit(i), F.lit(t).cast("binary"))])
    kind = (F.col("event_id") % 6).cast("int")
    start = F.when(kind == 1, F.lit(b"\xff\xfe")).otherwise(F.lit(b""))
    line = F.concat(start, F.concat(F.lit('{"event":"'), F.col("event_id").cast("string"), F.lit('","name":"'), F.col("event_type"), F.lit('"')).cast("binary"), tails[kind])
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("value"))
    files = logs.write_logs(lines, ["user_id"], ["event_id"], "value", out)
    read = logs.log_lines(files, ["user_id"], base="base", range_bytes=4096)
    return read.select("user_id", "line_no", "offset", F.octet_length("line").cast("bigint").alias("n_bytes"), "torn", canonical.record_error(F.col("line")).alias("error"))


QUERIES["log_line_errors"] = log_line_errors
ORACLE_SQL["log_line_errors"] = """
WITH e AS (SELECT user_id, event_id, event_id % 6 AS kind, strlen('{"event":"' || event_id || '","name":"' || event_type || '"') + list_value(1, 3, 2, 0, 1, 2)[1 + event_id % 6] AS n_bytes FROM events)
SELECT user_id, row_number() OVER w - 1 AS line_no, cast(sum(n_bytes + 1) OVER w - n_bytes - 1 AS BIGINT) AS "offset", n_bytes, false AS torn,
  list_value(NULL, 'not_utf8', 'not_canonical', 'not_parseable', 'not_parseable', 'not_parseable')[1 + kind] AS error
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
"""


def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01 to STR-08, WIN-08: the events taken in as a stream, chunked with state, written once and read back."""
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.file_stream(spark, sf_dir, "events.parquet", schema).select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("a"), (F.col("event_id") % 13).alias("b"), F.lit(1).cast("bigint").alias("c"))
    out = _fresh_folder(spark, "streamed")
    made = ingest.chunked(stream, STREAM, "event_id", ["a", "b", "c"], max_rows=150)
    ingest.ingest(made, f"{out}/rows", f"{out}/offsets")
    return spark.read.parquet(f"{out}/rows").select("user_id", "event_id", "chunk")


QUERIES["streamed_chunks"] = streamed_chunks
ORACLE_SQL["streamed_chunks"] = ORACLE_SQL["chunking_by_rows"]


def _event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: a session for each user, the event's number, time, value and properties."""
    arrival = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("utc_ns")
    kinds = F.element_at(F.array(*map(F.lit, synthetic.DAMAGE)), (F.col("user_id") % len(synthetic.DAMAGE) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", F.format_string("user_%d", "user_id").alias("session_id"), F.lit("events").alias("stream_id"), F.col("event_id").alias("packet_seq"), (F.col("event_id") * 1000).alias("monotonic_ns"), arrival, "value", F.col("props").cast("binary").alias("payload"), kinds.alias("damage"))
    return rows.withColumns({"outcome": F.lit("COMPLETED"), "close_status": F.lit("CLEAN")})


def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: a payload log for each user in which some numbers are framed twice, its index, and every number looked up in it."""
    out = _fresh_folder(spark, "frames").removeprefix("file://")

    def write_log(table):
        table = table.sort_by("event_id")
        user, pairs = table["user_id"][0].as_py(), []
        for number, text in zip(table["event_id"].to_pylist(), table["props"].to_pylist(), strict=True):
            pairs += [(number, text.encode()), (number, b"again")] if number % 10 == 0 else [(number, text.encode())]
        return {f"{user}.bin": recordings.frame_log([n for n, _ in pairs], [p for _, p in pairs])}, {"user_id": user, "uri": f"file://{out}/{user}.bin"}

    import pyarrow as pa

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "props")
    users = events.select("user_id").distinct().count()
    recordings.write_groups(events, ["user_id"], users, write_log, pa.schema([("user_id", pa.int64()), ("uri", pa.string())]), out).write.parquet(f"file://{out}/.files")
    frames.write_frame_index(spark.read.parquet(f"file://{out}/.files"), ["user_id"], f"file://{out}/.index")
    wanted = events.select("user_id", F.explode(F.array(F.col("event_id"), F.col("event_id") + 10_000_000)).alias("packet_seq"))
    made = frames.lookup_frames(spark, f"file://{out}/.index", wanted, ["user_id"])
    return made.select("user_id", "packet_seq", "at", "n_bytes", "n_frames", F.col("payload").cast("string").alias("payload"))


QUERIES["frame_lookup"] = frame_lookup
ORACLE_SQL["frame_lookup"] = """
WITH e AS (SELECT user_id, event_id, props, strlen(props) AS n, CASE WHEN event_id % 10 = 0 THEN 25 ELSE 0 END AS more FROM events)
SELECT user_id, event_id AS packet_seq, cast(sum(n + 20 + more) OVER (PARTITION BY user_id ORDER BY event_id) - n - 20 - more AS BIGINT) AS at, n AS n_bytes, CASE WHEN more > 0 THEN 2 ELSE 1 END::BIGINT AS n_frames, props AS payload FROM e
UNION ALL SELECT user_id, event_id + 10000000, NULL, NULL, NULL, NULL FROM e
"""


def pushed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-31, STR-01 to STR-05: a producer for each type of event pushes files, and one query takes them in batches of some MB of each, in chunks of 100."""
    out = _fresh_folder(spark, "pushed")
    spool = f"{out}/spool".removeprefix("file://")

    def push_file(key, table):
        import pyarrow as pa

        producer = push.Producer(spool, key[0].as_py())
        producer.next = key[1].as_py()
        producer.push(table.sort_by("event_id").select(["event_id"]))
        return pa.table({"n": [table.num_rows]})

    events = table(spark, sf_dir, "events").select("event_type", F.expr("event_id div 2048").alias("file"), "event_id")
    # Numbers of files follow each other, whatever the numbers of events; one row for each file is numbered, not the events.
    files = events.select("event_type", "file").distinct().withColumn("number", F.row_number().over(Window.partitionBy("event_type").orderBy("file")) - 1)
    events = events.join(files, ["event_type", "file"]).select("event_type", F.col("number").alias("file"), "event_id")
    events.groupBy("event_type", "file").applyInArrow(push_file, "n bigint").agg(F.sum("n")).collect()
    stream = push.pushed_stream(spark, spool, "producer string, event_id bigint", progress=f"{out}/progress").withColumn("one", F.lit(1).cast("bigint"))
    made = ingest.chunked(stream, ["producer"], "event_id", ["one"], max_rows=100)
    query = made.writeStream.foreachBatch(ingest.write_once(f"{out}/rows")).option("checkpointLocation", f"{out}/offsets").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{out}/rows").select("producer", "event_id", "chunk", "late")


QUERIES["pushed_chunks"] = pushed_chunks
ORACLE_SQL["pushed_chunks"] = "SELECT event_type AS producer, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS chunk, false AS late FROM events"


def verified_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC, SNK, FLT, JOIN and VER on packages: the events of each user recorded as a session, written, read and judged."""
    root = _fresh_folder(spark, "fleet")
    return Fleet(spark, recordings.write_package_rows(_event_packets(spark, sf_dir), root, chunk_packets=4096)).verdicts()


QUERIES["verified_fleet"] = verified_fleet
ORACLE_SQL["verified_fleet"] = "SELECT DISTINCT 'user_' || user_id AS session_id, cast(8 AS BIGINT) AS n_conditions, cast(0 AS BIGINT) AS n_failed, true AS is_completed FROM events"


def damaged_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER-1 to VER-8, FLT, JOIN: a session for each user, damaged as the user's number says, and which conditions then fail."""
    root = _fresh_folder(spark, "damaged")
    rows = _event_packets(spark, sf_dir).withColumns({"outcome": F.expr("if(damage = 'aborted', 'ABORTED', 'COMPLETED')"), "close_status": F.expr("if(damage = 'unclean', 'FAILED', 'CLEAN')")})
    files = recordings.write_package_rows(rows, root, chunk_packets=4096)
    damaged = synthetic.damaged_rows(files, rows.select("session_id", "stream_id", "damage").distinct(), f"{root}/damaged")
    return Fleet(spark, damaged).conditions().select("session_id", F.col("condition").cast("int").alias("condition"), "ok")


QUERIES["damaged_fleet"] = damaged_fleet
ORACLE_SQL["damaged_fleet"] = f"""
WITH broken(kind, condition) AS (VALUES {", ".join(f"({i}, {c})" for i, kind in enumerate(synthetic.DAMAGE) for c in synthetic.DAMAGE[kind])}),
s AS (SELECT DISTINCT 'user_' || user_id AS session_id, user_id % {len(synthetic.DAMAGE)} AS kind FROM events)
SELECT session_id, cast(c AS INTEGER) AS condition, NOT EXISTS (SELECT 1 FROM broken b WHERE b.kind = s.kind AND b.condition = c) AS ok FROM s, range(1, 9) t(c)
"""


def recorded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01 to SRC-07, SRT-03, SET-06, SNK-01 to SNK-03: what was recorded of the events, read back from artifacts of all four kinds."""
    root = _fresh_folder(spark, "replay")
    files = recordings.write_package_rows(_event_packets(spark, sf_dir), root, chunk_packets=4096)
    fleet, key = Fleet(spark, files), ["session_id", "stream_id", "chunk_id", "packet_seq"]
    samples = fleet.rows("samples_dense", ["packet_seq", "values"]).select(*key, F.col("values")[0].alias("value"))
    counters = fleet.rows("observations", ["packet_seq", "value_type", "value_u64"]).where("value_type = 'uint64'").select(*key, F.col("value_u64").cast("bigint").alias("counter"))
    payloads = fleet.rows("payload_frames", ["packet_seq", "payload"]).select(*key, F.col("payload").cast("string").alias("payload"))
    made = fleet.rows("packets", ["packet_seq", "row_index", "host_arrival_utc_ns"]).join(samples, key).join(counters, key).join(payloads, key)
    return made.select(*key, "row_index", "host_arrival_utc_ns", "value", "counter", "payload")


QUERIES["recorded_values"] = recorded_values
ORACLE_SQL["recorded_values"] = """
SELECT 'user_' || user_id AS session_id, 'events' AS stream_id, chunk AS chunk_id, event_id AS packet_seq, row_number() OVER (PARTITION BY user_id, chunk ORDER BY event_id) - 1 AS row_index,
  epoch_ns(ts) AS host_arrival_utc_ns, value::FLOAT AS value, event_id AS counter, props AS payload
FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id // 4096) - 1 AS chunk FROM events)
"""


def publish_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-26, JOIN-19: a file for each part, some with a link or a copy under a marked name beside it, and the links that are residue."""
    root = _fresh_folder(spark, "residue").removeprefix("file://")

    def place(batches):
        import os

        for batch in batches:
            for key in batch["p_partkey"].tolist():
                path = f"{root}/sessions/s{key % 10}/raw/{key}.json"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                for name in {0: [path], 1: [path, f"{path}.tmp"], 2: [f"{path}.tmp"]}.get(key % 4, [path]):
                    with open(name, "w") as out:
                        out.write("{}")
                if key % 4 == 3 and not os.path.exists(f"{path}.tmp"):
                    os.link(path, f"{path}.tmp")
            yield batch

    table(spark, sf_dir, "part").select("p_partkey").mapInPandas(place, "p_partkey bigint").count()
    return Fleet(spark, root).residue()


QUERIES["publish_residue"] = publish_residue
ORACLE_SQL["publish_residue"] = "SELECT 's' || p_partkey % 10 AS session_id, 'raw/' || p_partkey || '.json.tmp' AS path, 'raw/' || p_partkey || '.json' AS published FROM part WHERE p_partkey % 4 = 3"
