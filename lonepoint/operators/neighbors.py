"""Similarity joins of co-resident points.

Residents are at most n - 1 slides apart, so a bucket of n slides and the one before it hold all earlier partners of a
point; with cells of the radius' width in up to CELL_DIMS dimensions these are equality keys, and a range join is a hash or
sort-merge join with the distance as residual. Buckets hold at most a window of points, so no task's work
grows with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.functions.vectors import euclidean, slide_number
from lonepoint.params import Params

#: From two columns (or their names) and the dimensions to the distance.
Distance = Callable[[str, str, int], Column]

#: Dimensions that make cells; more would multiply the probes by two each.
CELL_DIMS = 2
#: Cells are this many radii wide, so that what lies within the radius is in one or two cells of a dimension; and a little more than the radius is
#: probed, so that rounding can't put a neighbour beyond them.
WIDTH, MARGIN = 2, 1e-9


def with_slide(points: DataFrame, slide: int) -> DataFrame:
    return points.withColumn("slide_no", slide_number("id", slide))


def earlier_pairs(points: DataFrame, p: Params, dims: int, radius: float | None = None, keep: tuple[str, ...] = ("id",), cell_dims: int | None = None, distance: Distance = euclidean) -> DataFrame:
    """Each point (x_...) with those of its own slide and up to n - 1 slides before (q_...) within the radius, itself included.

    points has slide_no, values and the columns in keep. d is the distance: any function of two columns and the dimensions. Cells need one
    that is never less than the difference of two points in one coordinate, as all norms are; for another give cell_dims 0.
    """
    r = p.radius if radius is None else radius
    used = CELL_DIMS if cell_dims is None else cell_dims
    used = used if dims <= 8 else 0  # one thin slice of many dimensions prunes little
    bucket = F.floor((F.col("slide_no") - 1) / p.n).cast("long")
    cell = lambda v: F.floor(v / (WIDTH * r)).cast("long")
    axes = [F.col("values")[i] for i in range(min(dims, used))]
    cols = [*dict.fromkeys((*keep, "slide_no", "values"))]
    # A row for each bucket and each cell that the ball reaches into.
    x = points.select(*(F.col(c).alias(f"x_{c}") for c in cols), *(F.sequence(cell(v - r * (1 + MARGIN)), cell(v + r * (1 + MARGIN))).alias(f"c{i}") for i, v in enumerate(axes)), F.explode(F.array(bucket, bucket - 1) if p.n > 1 else F.array(bucket)).alias("t"))
    for i in range(len(axes)):
        x = x.withColumn(f"c{i}", F.explode(f"c{i}"))
    q = points.select(*(F.col(c).alias(f"q_{c}") for c in cols), bucket.alias("t"), *(cell(v).alias(f"c{i}") for i, v in enumerate(axes)))
    gap = F.col("x_slide_no") - F.col("q_slide_no")
    joined = x.join(q, ["t", *(f"c{i}" for i in range(len(axes)))])
    return joined.filter((gap >= 0) & (gap < p.n)).withColumn("d", distance("x_values", "q_values", dims)).filter(F.col("d") <= r)


def pairs(points: DataFrame, p: Params, dims: int, radius: float | None = None, **options) -> DataFrame:
    """Ordered pairs of different co-resident points within the radius: id, nbr_id, slide_no, nbr_slide, d."""
    found = earlier_pairs(with_slide(points, p.slide), p, dims, radius, **options).filter(F.col("x_id") > F.col("q_id"))
    return _both(found)


def _both(found: DataFrame) -> DataFrame:
    a = F.struct(F.col("x_id").alias("id"), F.col("q_id").alias("nbr_id"), F.col("x_slide_no").alias("slide_no"), F.col("q_slide_no").alias("nbr_slide"))
    b = F.struct(F.col("q_id").alias("id"), F.col("x_id").alias("nbr_id"), F.col("q_slide_no").alias("slide_no"), F.col("x_slide_no").alias("nbr_slide"))
    return found.select(F.explode(F.array(a, b)).alias("p"), "d").select("p.*", "d")


def all_resident_pairs(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """Ordered pairs of different co-resident points at any distance; as many as points x window."""
    s = with_slide(points, p.slide)
    found = earlier_pairs(s, Params(p.window, p.slide, 1.7e308, p.k), dims, cell_dims=0).filter(F.col("x_id") > F.col("q_id"))
    return _both(found)


def nearest(pairs_: DataFrame, limit: int) -> DataFrame:
    """The first so many neighbours of each id by distance, then id, with their rank from 1."""
    order = Window.partitionBy("id").orderBy("d", "nbr_id")
    return pairs_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def nearest_centre(points: DataFrame, centres: DataFrame, dims: int, within: float, bucket: int) -> DataFrame:
    """The nearest centre of the same or the bucket before by distance, then id, and whether it lies within the radius.

    points and centres: id, values, slide_no; buckets count slides. A point without a centre there has null.
    """
    t = F.floor((F.col("slide_no") - 1) / bucket).cast("long")
    x = points.select("id", "values", "slide_no", F.explode(F.array(t, t - 1)).alias("t"))
    c = centres.select(F.col("id").alias("centre_id"), F.col("values").alias("centre"), F.col("slide_no").alias("centre_slide"), t.alias("t"))
    met = x.join(c, "t").filter((F.col("centre_slide") <= F.col("slide_no")) & (F.col("slide_no") - F.col("centre_slide") < bucket))
    d = euclidean("values", "centre", dims)
    best = met.groupBy("id").agg(F.min(F.struct(d.alias("d"), "centre_id")).alias("b"))
    return points.select("id").join(best, "id", "left").select("id", "b.centre_id", F.col("b.d").alias("d"), (F.col("b.d") <= within).alias("inside"))


def equal_points(points: DataFrame) -> DataFrame:
    """For each point how many points have its value, itself included, and the smallest of their ids.

    The join's keys are more than those of the aggregate, so that both sides are shuffled for it and a value that very many points have
    can be split.
    """
    hashed = points.withColumn("h", F.xxhash64("values"))
    groups = points.groupBy("values").agg(F.count("*").alias("n_refs"), F.min("id").alias("first_id")).withColumn("h", F.xxhash64("values"))
    return hashed.join(groups, ["h", "values"]).select("id", "n_refs", "first_id")


def neighbour_sets(found: DataFrame) -> DataFrame:
    """id, before and after: the ordered distinct ids of the neighbours in earlier slides, and in the own or later ones, from pairs()."""
    ids = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("nbr_id"))))
    return found.groupBy("id").agg(ids(F.col("nbr_slide") < F.col("slide_no")).alias("before"), ids(F.col("nbr_slide") >= F.col("slide_no")).alias("after"))


def same_centre(a: Column, b: Column) -> Column:
    """-1, 0 or 1: the order of two centres by their coordinates, the first that differs deciding; 0 where they are the same centre."""
    return F.when(a == b, 0).when(a < b, -1).otherwise(1)
