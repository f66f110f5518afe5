"""Joins of co-resident points by p-stable hashing, and detectors that take collisions for neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonepoint.functions.lsh import table_hashes, table_keys
from lonepoint.functions.vectors import euclidean
from lonepoint.operators.counts import grouped, pure_outliers
from lonepoint.params import LshParams, Params


def keys(points: DataFrame, lsh: LshParams, dims: int) -> DataFrame:
    """id, tbl and key."""
    return points.select("id", F.posexplode(table_keys(F.col("values"), lsh, dims)).alias("tbl", "key"))


def buckets(points: DataFrame, lsh: LshParams, dims: int) -> DataFrame:
    """tbl, key and n, the points of each bucket."""
    return keys(points, lsh, dims).groupBy("tbl", "key").agg(F.count("*").alias("n"))


def group_pairs(points: DataFrame, p: Params, lsh: LshParams, dims: int, verify: bool) -> DataFrame:
    """Pairs of groups of equal points that share a bucket, each once: in the first table where they do, so that nothing needs a distinct.

    x is in the same or a later slide; with verify only pairs within the radius. Rows carry numbers only (x_gid, x_slide_no, x_w and
    the same of q, values for verify): a group's points are for the caller to join. Keys meet as 64-bit hashes.
    """
    groups = grouped(points, p.slide)
    cols = ["gid", "slide_no", "w", *(["values"] if verify else [])]
    names = [f"k{i}" for i in range(lsh.tables)]
    hashed = groups.select(*cols, *(h.alias(n) for h, n in zip(table_hashes(F.col("values"), lsh, dims), names, strict=True)))
    t = F.floor((F.col("slide_no") - 1) / p.n).cast("long")
    tables = F.posexplode(F.array(*names)).alias("tbl", "key")

    def side(name: str, times: Column) -> DataFrame:
        return hashed.select(*(F.col(c).alias(f"{name}_{c}") for c in (*cols, *names)), times.alias("t"), tables)

    x = side("x", F.array(t, t - 1) if p.n > 1 else F.array(t)).withColumn("t", F.explode("t"))
    q = side("q", t)
    # Before the join's other condition, as most pairs that share a bucket share several.
    first = F.lit(None).cast("int")
    for i in reversed(range(lsh.tables)):
        first = F.when(F.col(f"x_k{i}") == F.col(f"q_k{i}"), F.lit(i)).otherwise(first)
    gap = F.col("x_slide_no") - F.col("q_slide_no")
    found = x.join(q, ["t", "tbl", "key"]).filter((gap >= 0) & (gap < p.n) & (first == F.col("tbl")))
    found = found.select(*(f"{n}_{c}" for n in ("x", "q") for c in cols))
    return found.filter(euclidean("x_values", "q_values", dims) <= p.radius) if verify else found


def candidates(points: DataFrame, p: Params, lsh: LshParams, dims: int, verify: bool = False) -> DataFrame:
    """Ordered pairs id, nbr_id of different co-resident points that share a bucket, and their distance d."""
    groups = grouped(points, p.slide)
    side = lambda n: groups.select(F.col("gid").alias(f"{n}_gid"), F.col("ids").alias(f"{n}_ids"), F.col("values").alias(f"{n}_v"))
    found = group_pairs(points, p, lsh, dims, verify).select("x_gid", "q_gid").join(side("x"), "x_gid").join(side("q"), "q_gid")
    found = found.select(euclidean("x_v", "q_v", dims).alias("d"), F.explode("x_ids").alias("x_id"), "q_ids")
    # Within a slide the groups meet in both orders, and the order of ids gives one of them.
    met = found.select("d", "x_id", F.explode("q_ids").alias("q_id")).filter(F.col("x_id") > F.col("q_id"))
    both = F.array(F.struct(F.col("x_id").alias("id"), F.col("q_id").alias("nbr_id")), F.struct(F.col("q_id").alias("id"), F.col("x_id").alias("nbr_id")))
    return met.select(F.explode(both).alias("p"), "d").select("p.*", "d")


def lsh_pure_outliers(points: DataFrame, p: Params, lsh: LshParams, dims: int, verify: bool = False) -> DataFrame:
    """Pure outliers where collisions (verify: collisions within the radius) are the neighbours."""
    return pure_outliers(points, p, dims, group_pairs(points, p, lsh, dims, verify))
