"""Prefix trie of conversations by heavy paths: which opening turns conversations share, and what sharing them saves.

A turn is hashed where it is read, and texts go no further. A node is a distinct sequence of first turns; its key is the
exclusive or of two 64-bit hashes of each turn with its place, so that keys of all prefixes of a conversation are running values.

Sums over subtrees go by heavy paths: every node has one heavy child, that with the most members, and the tree falls into
paths of heavy edges. Each path ends in a leaf, and the leaf's smallest member walks the whole path, so paths are found by
a join of such members with the light nodes, without chasing pointers. A step into a light child halves the members at least;
a path is thus at a level (light edges above it) of at most the logarithm of their number. Level by level from the
deepest, suffix sums along the paths give the sums of their nodes, and the sum of a path's top goes to its parent's path.

Long conversations, and long paths, are cut into blocks of ``2 ** BLOCK_BITS`` places: inside a block by a window, and a
second window over one row a block carries on what the blocks before it add up to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, scratch

BLOCK_BITS = 12
#: Ids of members that are joined to one text before a task puts the texts together.
ID_BITS = 10
#: Turns of the group's first conversation that another may begin with.
MOST_SHARED = 8
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _blocked(rows: DataFrame, keys: list[str], block: Column, order: list[Column], values: dict[str, tuple[str, str]], *, descending: bool = False) -> DataFrame:
    """``rows`` with running values over all rows of ``keys``: new column -> (SQL aggregate, SQL of the value).

    ``block`` must not fall along the order (not rise, if ``descending``). Only keys with several blocks have carried values.
    """
    rows = rows.withColumn("block", block)
    spread = rows.select(*keys, "block", *[F.expr(v).alias(f"{c}_own") for c, (_, v) in values.items()])
    sums = spread.groupBy(*keys, "block").agg(*[F.expr(f"{f}({c}_own)").alias(f"{c}_sum") for c, (f, _) in values.items()])
    along = Window.partitionBy(*keys).orderBy(F.desc("block") if descending else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "block", *[F.expr(f"{f}({c}_sum)").over(along).alias(f"{c}_before") for c, (f, _) in values.items()])
    carried = carried.where(" or ".join(f"{c}_before is not null" for c in values))
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = rows.select("*", *[F.expr(f"{f}({v})").over(inside).alias(c) for c, (f, v) in values.items()])
    made = made.join(carried, [*keys, "block"], "left")
    add = lambda c, f: F.expr(f"{c} ^ coalesce({c}_before, 0)" if f == "bit_xor" else f"{c} + coalesce({c}_before, 0)")
    return made.select(*[c for c in rows.columns if c != "block"], *[add(c, f).alias(c) for c, (f, _) in values.items()])


def ordered_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, n_bytes): turns of each conversation from place 0, with the SHA-256 of role and text.

    Null turns come first; turns of one number, repeated rows among them, stand in the order of their digests. A null
    role or text is empty. Rows without a conversation's id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    rows = materialize(rows, "trie-turns")
    # Before all blocks of numbered turns, whatever their numbers.
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62)))
    placed = _blocked(rows, ["conv"], block, [F.asc("turn"), F.asc("digest")], {"upto": ("sum", "1L")})
    return placed.select("conv", (F.col("upto") - 1).alias("place"), "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group of five: (conv, depth, digest, n_bytes), and (conv, length) of all.

    Conversation c begins with the first h = crc32(c) % 9 turns of c - c % 5, all if that has fewer and none if it does not
    exist, and goes on with its own turns after its first h.
    """
    turns = materialize(turns, "trie-places")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % (MOST_SHARED + 1)).alias("h"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", taken)
    convs = materialize(convs.withColumn("length", F.expr("taken + greatest(n - h, 0)")).select("conv", "base", "h", "taken", "length"), "trie-members")
    # At most MOST_SHARED turns meet the conversations of a group: five of them, nine about zero.
    heads = turns.where(F.col("place") < MOST_SHARED).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "taken"), "base").where("place < taken")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where("place >= h").withColumn("place", F.expr("taken + place - h"))
    columns = ["conv", (F.col("place") + 1).alias("depth"), "digest", "n_bytes"]
    return heads.select(*columns).unionByName(own.select(*columns)), convs.select("conv", "length")


def prefix_walks(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, n_bytes): the node of each prefix of each conversation, and the node above it."""
    rows = turns.withColumns({f"a{i}": F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)})
    made = _blocked(rows.drop("digest"), ["conv"], F.shiftright(F.col("depth"), BLOCK_BITS), [F.asc("depth")], {f"k{i}": ("bit_xor", f"a{i}") for i in (1, 2)})
    return made.select("conv", "depth", *KEY, *[F.expr(f"k{i} ^ a{i}").alias(f"p{i}") for i in (1, 2)], "n_bytes")


def _nodes(walks: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node: key, parent's key, depth, smallest member, members, bytes of the last text, children, heavy child."""
    count = F.count("*").alias("n_convs")
    nodes = walks.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), count, *[F.max(c).alias(c) for c in ("depth", *PARENT, "n_bytes")])
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    root = members.agg(F.min("conv").alias("conv_id"), count).where("n_convs > 0")
    root = root.select(*map(zero, KEY), "conv_id", "n_convs", zero("depth"), *[F.lit(None).cast("bigint").alias(c) for c in PARENT], zero("n_bytes"))
    nodes = materialize(nodes.unionByName(root), "trie-nodes")
    # The most members, then the smallest member; ~x falls as x rises, and has no overflow.
    largest = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("first"), *KEY))
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    children = children.toDF(*KEY, "n_children", "heavy")
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = materialize(nodes, "trie-children")
    # A node with very many children is met once by each of them: skewed on one side only, which adaptive execution splits.
    above = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    light = F.coalesce((F.col("chosen.k1") != F.col("k1")) | (F.col("chosen.k2") != F.col("k2")), F.lit(False))
    linked = nodes.drop("heavy").join(above, PARENT, "left").withColumn("light", light).drop("chosen")
    return materialize(linked, "trie-linked")


def _paths(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path`` (smallest member of the leaf in which the heavy path ends), its ``level`` and ``top``, the depth of its first node."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    down = walks.select(F.col("conv").alias("path"), "depth", *KEY).join(leaves, "path", "left_semi")
    tops = down.join(nodes.where("light").select(*KEY), KEY).groupBy("path").agg(F.max("depth").alias("top"), F.count("*").cast("int").alias("level"))
    paths = materialize(leaves.join(tops, "path", "left").na.fill(0), "trie-paths")
    spine = down.join(paths, "path").where("depth >= top").select("path", "top", "level", *KEY)
    # The one path without a light edge begins at the root, which no walk lists.
    zero = F.lit(0).cast("bigint")
    spine = spine.unionByName(paths.where("level = 0").select("path", "top", "level", zero.alias("k1"), zero.alias("k2")))
    return nodes.join(spine, KEY)


def _subtree_sums(tree: DataFrame) -> DataFrame:
    """``tree`` with ``n_leaves`` and ``saved_tokens`` of each node's subtree, by rounds over the levels from the deepest."""
    spark, folder = tree.sparkSession, scratch(tree.sparkSession, "trie-levels")
    tree = tree.withColumns({"own_leaves": (F.col("n_children") == 0).cast("bigint"), "own_saved": (F.col("n_convs") - 1) * F.col("n_bytes")})
    tree.write.partitionBy("level").parquet(f"{folder}/tree")
    tree = spark.read.schema(tree.schema).parquet(f"{folder}/tree")
    deepest, rounds, attached = tree.agg(F.max("level")).first()[0], [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = tree.where(F.col("level") == level).drop("level")
        if attached is not None:
            rows = rows.join(attached, KEY, "left")
            rows = rows.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("own_leaves", "own_saved")}).drop("more_own_leaves", "more_own_saved")
        sums = {"n_leaves": ("sum", "own_leaves"), "saved_tokens": ("sum", "own_saved")}
        done = _blocked(rows, ["path"], F.shiftright(F.col("depth"), BLOCK_BITS), [F.desc("depth")], sums, descending=True)
        done = materialize(done, "trie-round")
        rounds.append(done)
        attached = done.where("depth = top").groupBy(*PARENT).agg(F.sum("n_leaves").alias("more_own_leaves"), F.sum("saved_tokens").alias("more_own_saved")).toDF(*KEY, "more_own_leaves", "more_own_saved")
    return reduce(DataFrame.unionByName, rounds) if rounds else tree.withColumns({c: F.lit(0).cast("bigint") for c in ("n_leaves", "saved_tokens")})


def _ends(walks: DataFrame, members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined to texts of a range of ids each; a digest takes one text after another, so a task reads a row for each
    range and holds none of them.
    """
    ends = walks.join(members.select("conv", F.col("length").alias("depth")), ["conv", "depth"], "left_semi").select(*KEY, "conv")
    zero = F.lit(0).cast("bigint")
    ends = ends.unionByName(members.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv"))
    texts = ends.groupBy(*KEY, F.shiftright("conv", ID_BITS).alias("span")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))

    def digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            made = []
            for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"], strict=True):
                if (k1, k2) == at:
                    state.update(f",{ids}".encode())
                    continue
                if at is not None:
                    made.append((*at, state.hexdigest()))
                at, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(made, columns=[*KEY, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "span").select(*KEY, "ids").mapInPandas(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, from the empty one at depth 0.

    :param turns: (``conv`` BIGINT, ``depth`` from 1, ``digest`` of the turn, ``n_bytes`` of its text).
    :param members: (``conv``, ``length``): all conversations once, also those without turns.
    :return: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); ``conv_id`` is the smallest
        member, so the sequence is the first ``depth`` turns of that conversation. No conversations give no rows.
    """
    walks = materialize(prefix_walks(turns), "trie-walks")
    nodes = _nodes(walks, members)
    made = _subtree_sums(_paths(walks, nodes)).join(_ends(walks, members), KEY, "left")
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return made.select(*[F.col(c).cast("bigint").alias(c) for c in numbers], F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


ORACLE_SQL = """
WITH poly AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b::UINTEGER] || [x::UINTEGER FOR x IN range(8)], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UINTEGER) ELSE a >> 1 END) AS r FROM range(256) v(b))),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, [('0x' || x)::UINTEGER FOR x IN regexp_extract_all(hex(encode(c::VARCHAR)), '..')] AS bytes FROM o GROUP BY c),
h AS (SELECT c, n, c - c % 5 AS base, xor(list_reduce([4294967295::UINTEGER] || bytes, lambda a, v: xor(a >> 8, poly.t[(xor(a, v) & 255) + 1])), 4294967295::UINTEGER)::BIGINT % 9 AS h FROM n, poly),
m AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN n b ON b.c = h.base),
r AS (SELECT m.c, place + 1 AS depth, role, text FROM m JOIN o ON o.c = m.base AND place < taken UNION ALL SELECT m.c, taken + place - h + 1, role, text FROM m JOIN o ON o.c = m.c AND place >= h),
w AS MATERIALIZED (SELECT c, depth, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY depth) AS key, octet_length(encode(text)) AS n_bytes FROM r
  UNION ALL SELECT c, 0, []::STRUCT(role VARCHAR, text VARCHAR)[], 0 FROM m),
e AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS length FROM w) WHERE depth = length GROUP BY key),
t AS MATERIALIZED (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes FROM w GROUP BY key, depth),
k AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM t WHERE depth > 0 GROUP BY ALL),
x AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM t LEFT JOIN k USING (key)),
s AS (SELECT key[1:d] AS key, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved FROM x, unnest(range(0, depth + 1)) u(d) GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM x JOIN s USING (key, depth) LEFT JOIN e USING (key) LEFT JOIN t p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.key = x.key[1:x.depth - 1]
"""
