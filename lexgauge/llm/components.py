"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgauge.session import materialize


def _smallest(links: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, written so that the next join can split a hot node."""
    return materialize(links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them; links run from larger to smaller."""
    least = _smallest(links)
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (u, v) with the smallest node they reach, as (node, root).

    Alternating large and small stars: every round writes its links to the
    shared folder, and the rounds end when the links stay as they are.  The
    number of rounds grows with the logarithm of the number of nodes.  Links
    from a node to itself and repeated links change nothing; the roots have
    no row.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    current = materialize(ordered.distinct())
    state = _state(current)
    while state[0]:
        following = materialize(_small_star(materialize(_large_star(current).distinct())).distinct())
        new_state = _state(following)
        current = following
        if new_state == state:
            break
        state = new_state
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free digest; equal links have equal states."""
    mark = F.xxhash64("u", "v")
    return tuple(
        links.agg(
            F.count("*"), F.coalesce(F.sum(mark.cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.bit_xor(mark), F.lit(0))
        ).first()
    )
