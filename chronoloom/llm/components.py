"""Connected components of a link table, distributed, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, measured


def _lowest(links: DataFrame) -> DataFrame:
    """(u, v, m): the links with the smallest node that u or its neighbours hold."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    return _lowest(_both_ways(links)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    starred = _lowest(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    # A union would plan, and run, all that lies below it twice.
    way = F.explode(F.array(*[F.struct(F.col(node).alias("u"), F.col("m").alias("v")) for node in ("v", "u")]))
    return starred.select(way.alias("way")).select("way.u", "way.v").where("u != v").distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that occurs in ``links``.

    :param links: two columns ``u`` and ``v`` of one orderable type. Loops and repeats are harmless,
        rows with a null end are ignored. An empty table gives an empty result.

    The component is the smallest node. Every node first takes the smallest of its neighbours and itself as its label, which
    collapses a dense group to its few labels; only links between labels go into the rounds. Each round shuffles those
    twice; the number of rounds grows with the logarithm of the longest chain. Rounds are written to the shared folder, so no
    lineage piles up, and only a count and a checksum reach the driver.
    """
    return star_components(materialize(links.where("u is not null and v is not null and u != v").distinct(), name), name)


def star_components(links: DataFrame, name: str = "components") -> DataFrame:
    """:func:`connected_components` of links that are written already and have no loops, repeats and null ends."""
    labels = materialize(_both_ways(links).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), name)
    of = lambda end, named: labels.select(F.col("node").alias(end), F.col("label").alias(named))
    edges = links.join(of("u", "a"), "u").join(of("v", "b"), "v").where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    (edges, state), seen = measured(edges, name, mark=mark), None
    while state["rows"] and state != seen:
        seen = state
        edges, state = measured(_small_star(_large_star(edges)), name, mark=mark)
    found = edges.select(F.col("u").alias("label"), F.col("v").alias("component"))
    return labels.join(found, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
