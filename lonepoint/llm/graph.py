"""Connected components of a graph of links, by alternating large and small stars, and groups of rows in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node that it reaches) for every node that has a link to another.

    Nodes are of any type with an order. Each round is two joins on the nodes and is written to the shared folder, so
    neither links nor components come to the driver; only their number and a checksum do. The number of rounds grows with the
    logarithm of the nodes. A node with very many links is split by the skew join, as both sides are shuffled for it alone.
    """
    now = stored(_larger_first(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links", narrow=True)
    before = _checksum(now)
    while True:
        # Large star: a link to v goes to v's smallest neighbour instead. Only nodes with a smaller neighbour have one that counts,
        # and these are written first, so that the join shuffles both its sides and can split a node of very many links.
        least = stored(now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m"), "least", narrow=True)
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small star: what is left of a node's smaller neighbours is linked to the smallest of them.
        least_seen, least = least, large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        new = stored(_larger_first(small), "links", narrow=True)
        discard(now)
        discard(least_seen)
        now, after = new, _checksum(new)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after


def _larger_first(links: DataFrame) -> DataFrame:
    return links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).head())


def distinct_buckets(members: DataFrame, weight: str, most_rows: int, most_weight: int) -> DataFrame:
    """Buckets with two members or more, of those with the same members one: key and blocks, the number of blocks that hold at
    most about most_rows members and most_weight of their weight each. members: key, h1 and h2 (a member), weight."""
    sums = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"), F.bit_xor(F.xxhash64("h1", "h2")).alias("f1"), F.bit_xor(F.xxhash64("h2", "h1")).alias("f2")
    ).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / most_rows), F.ceil(F.col("w") / most_weight), F.lit(1)).cast("int")
    return sums.groupBy("n", "f1", "f2").agg(F.min("key").alias("key"), F.max("w").alias("w")).select("key", blocks.alias("blocks"))


def block_of(h1: int, h2: int, blocks: int) -> int:
    """The block of a member, by its own hash."""
    return ((h1 ^ (h2 >> 7)) & 0x7FFFFFFFFFFFFFFF) % blocks


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal values in the first so many columns; rows come sorted by them, and a group is bounded."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
