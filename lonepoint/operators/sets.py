"""Comparison of id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common(baseline: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of the baseline whose id the test has; repeats in the baseline stay."""
    return baseline.join(test.select("id").distinct(), "id", "left_semi")


def accuracy(baseline: DataFrame, test: DataFrame) -> DataFrame:
    """n_base, n_test, n_common and recall, precision and f1 in percent; null where undefined."""
    b = baseline.groupBy("id").agg(F.count("*").alias("b"))
    t = test.groupBy("id").agg(F.count("*").alias("t"))
    both = b.join(t, "id", "full")
    found = both.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_base"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_test"), F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("b"))), F.lit(0)).alias("n_common")
    )
    recall, precision = (F.try_divide(F.col("n_common") * 100.0, F.col(c)) for c in ("n_base", "n_test"))
    f1 = F.try_divide(F.col("n_common") * 200.0, F.col("n_base") + F.col("n_test"))
    return found.select("*", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement, those that come first in an order drawn by a linear congruence of the id: the same on every run."""
    drawn = F.pmod((F.col("id") + seed) * F.lit(48271), F.lit(2147483647))
    return df.orderBy(drawn, "id").limit(n)
