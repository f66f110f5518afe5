"""Command line: detect outliers in a file of points, or compare two files of ids.

python -m lonepoint.cli detect --algorithm MCOD --W 1000 --slide 100 --R 0.5 --k 5 --datafile points.txt --outliersFile out
python -m lonepoint.cli compare --baselineFile exact --testFile approximate
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonepoint.operators import counts, lsh_join, sets
from lonepoint.params import LshParams, Params
from lonepoint.sources import points as source
from lonepoint.streaming import replay

ALGORITHMS = ("MCOD", "ApproxMCOD", "LSHOD", "ApproxMCLSHOD")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lonepoint")
    sub = top.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect", help="ids of the points that are outliers in every window")
    d.add_argument("--algorithm", choices=ALGORITHMS, required=True)
    d.add_argument("--W", type=int, required=True)
    d.add_argument("--slide", type=int, required=True)
    d.add_argument("--R", type=float, required=True)
    d.add_argument("--k", type=int, required=True)
    d.add_argument("--pdLimit", type=int, help="ApproxMCOD: unclustered points that are searched")
    d.add_argument("--arFactor", type=float, default=0.0, help="ApproxMCOD: width of the ring, in radii")
    d.add_argument("--datafile", required=True)
    d.add_argument("--containsClass", action="store_true", help="the last field of each line is a class")
    d.add_argument("--outliersFile")
    d.add_argument("--oneFile", action="store_true", help="one task writes all ids to one file")
    d.add_argument("--seed", type=int, default=1)
    d.add_argument("--exactLifecycle", action="store_true", help="report the three lifecycle counts as well")
    c = sub.add_parser("compare", help="recall and precision of one file of ids against another")
    c.add_argument("--baselineFile", required=True)
    c.add_argument("--testFile", required=True)
    return top


def approximate(points: DataFrame, p: Params, pd_limit: int | None, ring: float, seed: int) -> DataFrame:
    """Rows of the approximate detector, for points as one stream."""
    detector = replay.MicroClusters(p, pd_limit=p.window if pd_limit is None else pd_limit, ring=ring, seed=seed)
    return replay.replay(points.select(F.lit("all").alias("stream_id"), "id", "values"), detector)


def detect(spark: SparkSession, points: DataFrame, algorithm: str, p: Params, pd_limit: int | None = None, ring: float = 0.0, seed: int = 1) -> DataFrame:
    """id of pure outliers by one of ALGORITHMS, with the hash families' usual numbers of tables and hashes."""
    dims = source.dimensions(points)
    if dims < 0:
        return points.select("id").limit(0)
    if algorithm == "MCOD":
        return counts.pure_outliers(points, p, dims)
    if algorithm == "LSHOD":
        return lsh_join.lsh_pure_outliers(points, p, LshParams(10, 4, p.radius, seed), dims)
    if algorithm == "ApproxMCLSHOD":
        return lsh_join.lsh_pure_outliers(points, p, LshParams(10, 5, 1.5 * p.radius, seed), dims, verify=True)
    if algorithm == "ApproxMCOD":
        return approximate(points, p, pd_limit, ring, seed).filter("kind = 'outlier'").select("id")
    raise ValueError(f"unknown algorithm {algorithm}; known: {', '.join(ALGORITHMS)}")


def peak_mb(spark: SparkSession) -> float:
    """The most memory that the heap of the driver's JVM has had in use, by pools."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return sum(b.getPeakUsage().getUsed() for b in beans if b.getType().toString().startswith("Heap")) / (1 << 20)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lonepoint").getOrCreate()
    if a.command == "compare":
        r = sets.accuracy(source.read_ids(spark, a.baselineFile), source.read_ids(spark, a.testFile)).head()
        for name in ("recall", "precision", "f1"):
            print(f"{name}: {'undefined' if r[name] is None else f'{r[name]:.2f} %'}")
        print(f"common: {r.n_common} of {r.n_base} in the baseline, {r.n_test} in the test")
        return 0
    p = Params(a.W, a.slide, a.R, a.k)
    begun = time.time()
    pts = source.read_csv(spark, a.datafile, a.containsClass).persist()
    rows = approximate(pts, p, a.pdLimit, a.arFactor, a.seed).persist() if a.algorithm == "ApproxMCOD" else None
    found = (detect(spark, pts, a.algorithm, p, a.pdLimit, a.arFactor, a.seed) if rows is None else rows.filter("kind = 'outlier'").select("id")).persist()
    if a.outliersFile:
        source.write_ids(found, a.outliersFile, a.oneFile)
    n, total = found.count(), pts.count()
    print(f"points: {total}")
    print(f"pure outliers: {n}" + (f" ({100 * n / total:.1f} %)" if total else ""))
    if a.exactLifecycle and total:
        c = counts.lifecycle_counts(pts, p, source.dimensions(pts))
        r, s = c.head(), counts.percentages(c).head()
        print(f"only inlier: {r.only_in} ({s.only_in_pct} %), only outlier: {r.only_out} ({s.only_out_pct} %), both: {r['both']} ({s.both_pct} %)")
    # A plan of joins searches once for each point; the stateful detector counts its searches, those of dissolved clusters among them.
    queries = total if rows is None else rows.agg(F.coalesce(F.sum("queries"), F.lit(0))).head()[0]
    print(f"range queries: {queries}")
    took = 1000 * (time.time() - begun)
    print(f"time: {took:.0f} ms" + (f", {took / max(1, -(-total // p.slide)) * 100:.0f} ms for 100 slides" if total else ""))
    print(f"peak memory: {peak_mb(spark):.0f} MB")
    return 0


if __name__ == "__main__":
    sys.exit(main())
