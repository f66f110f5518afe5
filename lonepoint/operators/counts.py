"""Neighbour counts over count-based sliding windows, and what follows from them.

Points of one slide with equal values have equal counts, so counting joins distinct (slide, values) with their numbers:
copies of a hot value never meet each other one by one. A group has at most a slide of points and carries their ids, so
that results come back to points without another join on values. After the pairs there is one aggregation by group; window sums
are arithmetic over its 2n - 1 numbers, unrolled into generated code while these are few.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonepoint.operators.neighbors import earlier_pairs, pairs, with_slide
from lonepoint.params import Params

#: Slides of a window up to which sums are unrolled.
UNROLLED_SLIDES = 24


def grouped(points: DataFrame, slide: int) -> DataFrame:
    """slide_no, values, gid (the smallest id), w (the number of points) and ids, at most a slide of them."""
    groups = with_slide(points, slide).groupBy("slide_no", "values").agg(F.collect_list("id").alias("ids"))
    return groups.select("slide_no", "values", F.array_min("ids").alias("gid"), F.size("ids").cast("long").alias("w"), "ids")


def _credited(found: DataFrame) -> DataFrame:
    """Neighbours that each group gets from pairs of groups: gid, o (the other slide minus the own one), n. A point is no neighbour of itself."""
    gap = F.col("x_slide_no") - F.col("q_slide_no")
    own = F.struct(F.col("x_gid").alias("gid"), (-gap).cast("int").alias("o"), (F.col("q_w") - (F.col("x_gid") == F.col("q_gid")).cast("int")).alias("n"))
    other = F.struct(F.col("q_gid").alias("gid"), gap.cast("int").alias("o"), F.col("x_w").alias("n"))
    # Within a slide the join meets both orders already.
    both = F.when(gap == 0, F.array(own)).otherwise(F.array(own, other))
    return found.select(F.explode(both).alias("c")).select("c.*")


class Spread:
    """A group's neighbours by slide, from n - 1 slides before its own (place 0) to n - 1 after it (place 2n - 2)."""

    def __init__(self, p: Params):
        self.n, self.width = p.n, 2 * p.n - 1
        self.unrolled = p.n <= UNROLLED_SLIDES

    def aggregate(self, credited: DataFrame) -> DataFrame:
        """gid and the numbers: columns c0, c1, ... or an array c."""
        if self.unrolled:
            place = F.col("o") + (self.n - 1)
            return credited.groupBy("gid").agg(*(F.sum(F.when(place == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(self.width)))
        per = credited.groupBy("gid", "o").agg(F.sum("n").alias("n")).groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("o", "n"))).alias("m"))
        all_ = F.transform(F.sequence(F.lit(1 - self.n), F.lit(self.n - 1)), lambda o: F.coalesce(F.try_element_at("m", o), F.lit(0)).cast("long"))
        return per.select("gid", all_.alias("c"))

    def sums(self, first: int, step: int, length: int, grow: int, many: int) -> Column:
        """An array of `many` sums: the i-th of length + i * grow numbers from place first + i * step."""
        if many <= 0:
            return F.array().cast("array<long>")
        if self.unrolled:
            spans = [(first + i * step, length + i * grow) for i in range(many)]
            return F.array(*(reduce(add, (F.col(f"c{k}") for k in range(at, at + size)), F.lit(0).cast("long")) for at, size in spans))
        total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, v: s + v)
        return F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: total(F.slice("c", i * step + first + 1, i * grow + length)))

    def each(self) -> Column:
        return self.sums(0, 1, 1, 0, self.width)

    def ends(self) -> Column:
        """Counts at the ends of the batches slide_no to slide_no + n - 1."""
        return self.sums(0, 1, self.n, 0, self.n)

    def after_expiry(self) -> Column:
        """Counts in the batches slide_no + 1 to slide_no + n - 1 when the oldest slide has gone and the new one has not come."""
        return self.sums(1, 1, self.n - 1, 0, self.n - 1)

    def later(self) -> Column:
        """Neighbours of the own slide, of it and the next one, and so on."""
        return self.sums(self.n - 1, 0, 1, 1, self.n)

    def live_before(self) -> Column:
        """Neighbours of earlier slides that are still resident at the ends of the batches slide_no to slide_no + n - 1."""
        return F.concat(self.sums(0, 1, self.n - 1, -1, self.n - 1), F.array(F.lit(0).cast("long")))

    def before(self) -> Column:
        return self.sums(0, 0, self.n - 1, 0, 1)[0] if self.n > 1 else F.lit(0).cast("long")


def group_counts(points: DataFrame, p: Params, dims: int, found: DataFrame | None = None) -> DataFrame:
    """gid, slide_no, w, ids and the numbers of Spread. Every group meets itself, so none is missing."""
    groups = grouped(points, p.slide)
    found = earlier_pairs(groups, p, dims, keep=("gid", "w")) if found is None else found
    return Spread(p).aggregate(_credited(found)).join(groups.select("gid", "slide_no", "w", "ids"), "gid")


def last_batch(points: DataFrame, slide: int) -> Column:
    """The number of batches, as a scalar of the plan."""
    return with_slide(points, slide).agg(F.max("slide_no")).scalar()


def window_sums(points: DataFrame, p: Params, dims: int, found: DataFrame | None = None) -> DataFrame:
    """slide_no, w, ids and cnt: an array with the counts at the ends of batches slide_no to the last one lived in."""
    lived = F.least(F.lit(p.n), last_batch(points, p.slide) - F.col("slide_no") + 1).cast("int")
    return group_counts(points, p, dims, found).select("slide_no", "w", "ids", F.slice(Spread(p).ends(), 1, lived).alias("cnt"))


def slide_counts(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, nbr_slide and n, for the slides in which a point has neighbours."""
    found = group_counts(points, p, dims).select("slide_no", "ids", F.posexplode(Spread(p).each()).alias("i", "n")).filter("n > 0")
    return found.select(F.explode("ids").alias("id"), (F.col("slide_no") + F.col("i") - (p.n - 1)).alias("nbr_slide"), "n")


def window_counts(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, batch and cnt, zeros included."""
    found = window_sums(points, p, dims).select("slide_no", "ids", F.posexplode("cnt").alias("i", "cnt"))
    return found.select(F.explode("ids").alias("id"), (F.col("slide_no") + F.col("i")).alias("batch"), "cnt")


def window_outliers(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id and batch of every outlier at the end of a batch."""
    return window_counts(points, p, dims).filter(F.col("cnt") < p.k).select("id", "batch")


def outliers_per_window(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """batch, residents and outliers, from groups alone: no point is looked at."""
    groups = window_sums(points, p, dims).select("slide_no", "w", F.posexplode("cnt").alias("i", "cnt"))
    return groups.groupBy((F.col("slide_no") + F.col("i")).alias("batch")).agg(F.sum("w").alias("residents"), F.sum(F.when(F.col("cnt") < p.k, F.col("w")).otherwise(0)).alias("outliers"))


def pure_outliers(points: DataFrame, p: Params, dims: int, found: DataFrame | None = None) -> DataFrame:
    """id of the points that are outliers in every window that they live in."""
    return window_sums(points, p, dims, found).filter(F.array_max("cnt") < p.k).select(F.explode("ids").alias("id"))


def safe_inliers(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id and the first batch from which its neighbours of the same or later slides make it an inlier for good."""
    at = F.array_position(F.transform(Spread(p).later(), lambda v: v >= p.k), True)
    groups = group_counts(points, p, dims).select("slide_no", "ids", at.alias("at")).filter("at > 0")
    return groups.select(F.explode("ids").alias("id"), (F.col("slide_no") + F.col("at") - 1).cast("long").alias("safe_from"))


def arrival_counts(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id and a, the neighbours already resident on arrival. Within a slide the order of ids decides, so single points meet there."""
    found = pairs(points, p, dims).filter(F.col("nbr_id") < F.col("id")).groupBy("id").agg(F.count("*").alias("a"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("a", F.lit(0)).alias("a"))


def post_expiry_counts(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, batch after the own one, and cnt, the neighbours left when the oldest slide has expired and the new one has not come."""
    lived = F.least(F.lit(p.n - 1), last_batch(points, p.slide) - F.col("slide_no")).cast("int")
    groups = group_counts(points, p, dims).select("slide_no", "ids", F.slice(Spread(p).after_expiry(), 1, lived).alias("after"))
    found = groups.select("slide_no", "ids", F.posexplode("after").alias("i", "cnt"))
    return found.select(F.explode("ids").alias("id"), (F.col("slide_no") + F.col("i") + 1).alias("batch"), "cnt")


def before_and_after(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, preceding (neighbours of earlier slides) and succeeding (of the same or later slides)."""
    s = Spread(p)
    return group_counts(points, p, dims).select(F.explode("ids").alias("id"), s.before().alias("preceding"), s.later()[p.n - 1].alias("succeeding"))


def live_preceding_counts(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, batch and n, the neighbours of earlier slides that are resident at the end of each batch lived in."""
    lived = F.least(F.lit(p.n), last_batch(points, p.slide) - F.col("slide_no") + 1).cast("int")
    groups = group_counts(points, p, dims).select("slide_no", "ids", F.slice(Spread(p).live_before(), 1, lived).alias("live"))
    found = groups.select("slide_no", "ids", F.posexplode("live").alias("i", "n"))
    return found.select(F.explode("ids").alias("id"), (F.col("slide_no") + F.col("i")).alias("batch"), "n")


def oldest_preceding(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, the smallest id of its neighbours in earlier slides, and when that one expires."""
    found = pairs(points, p, dims).filter(F.col("nbr_slide") < F.col("slide_no"))
    return found.groupBy("id").agg(F.min("nbr_id").alias("oldest")).withColumn("expires", F.col("oldest") + p.window + 1)


def assignments(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, n_inlier and n_outlier: verdicts on arrival, after each expiry and at the end of each batch."""
    s, last = Spread(p), last_batch(points, p.slide)
    ends = F.slice(s.ends(), 1, F.least(F.lit(p.n), last - F.col("slide_no") + 1).cast("int"))
    after = F.slice(s.after_expiry(), 1, F.least(F.lit(p.n - 1), last - F.col("slide_no")).cast("int"))
    groups = group_counts(points, p, dims).select("ids", F.concat(ends, after).alias("cnt"))
    inlier = F.size(F.filter("cnt", lambda v: v >= p.k))
    judged = groups.select(F.explode("ids").alias("id"), inlier.alias("i"), (F.size("cnt") - inlier).alias("o"))
    found = judged.join(arrival_counts(points, p, dims), "id")
    now = (F.col("a") >= p.k).cast("int")
    return found.select("id", (F.col("i") + now).cast("long").alias("n_inlier"), (F.col("o") + 1 - now).cast("long").alias("n_outlier"))


def lifecycle(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id, ever_in and ever_out, over the counts on arrival, after expiry and at the end of batches."""
    return assignments(points, p, dims).select("id", (F.col("n_inlier") > 0).alias("ever_in"), (F.col("n_outlier") > 0).alias("ever_out"))


def lifecycle_counts(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """only_in, only_out and both."""
    i, o = F.col("ever_in"), F.col("ever_out")
    return lifecycle(points, p, dims).agg(F.count_if(i & ~o).alias("only_in"), F.count_if(o & ~i).alias("only_out"), F.count_if(i & o).alias("both"))


def percentages(counts: DataFrame) -> DataFrame:
    """Shares in percent, with one decimal."""
    total = F.col("only_in") + F.col("only_out") + F.col("both")
    return counts.select(*(F.round(F.try_divide(F.col(c) * 100.0, total), 1).alias(f"{c}_pct") for c in ("only_in", "only_out", "both")))


def core_points(points: DataFrame, p: Params, dims: int) -> DataFrame:
    """id and n of the points with at least k neighbours within half the radius on arrival: they would start a cluster."""
    near = pairs(points, p, dims, radius=p.radius / 2).filter(F.col("nbr_id") < F.col("id"))
    return near.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= p.k)
