"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize

#: Links of a task in the rounds of linked(): few links take few tasks, however many partitions a shuffle has.
TASK_LINKS = 10_000


def _hang_higher(links: DataFrame) -> DataFrame:
    """Links (u > v): every neighbour above a node is hung on the least of the node and its neighbours."""
    ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("least"))
    return ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _hang_lower(links: DataFrame) -> DataFrame:
    """Links (u > v): a node and its neighbours below it are hung on the least of these."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    moved = links.join(least, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def linked(links: DataFrame) -> DataFrame:
    """(u, v) -> id, component for every id with a link to another: the smallest id that links reach.

    Links are hung on smaller nodes until every component is a star on its least node. A hub's links leave it in the
    first round, least nodes are found by aggregates that combine before the shuffle, and the rounds grow with the
    logarithm of the longest path. Each round is checkpointed, in a task for every TASK_LINKS links; only a count and a
    checksum come to the driver. Links of an id to itself and null ends are ignored.
    """
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while known != (known := links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()):
        if not known[0]:
            break
        tasks = -(-known[0] // TASK_LINKS)
        links = materialize(_hang_lower(_hang_higher(links.coalesce(tasks))).coalesce(tasks))
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id) and (u, v) -> id, component; an id without a link is its own component."""
    return nodes.select("id").join(linked(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
