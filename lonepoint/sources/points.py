"""Points in arrival order: id (dense from 1) and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonepoint.plans.storage import checkpointed


def points(df: DataFrame, id_: Column, values: list[Column], *keep: Column) -> DataFrame:
    """From a table with an order column; NaN has no distance, so it is an error, as is null."""
    made = [v.cast("double") for v in values]
    bad = reduce(lambda a, b: a | b, (v.isNull() | F.isnan(v) for v in made))
    return df.select(id_.cast("long").alias("id"), F.when(bad, _bad()).otherwise(F.array(*made)).alias("values"), *keep)


def checked(values: Column) -> Column:
    bad = values.isNull() | F.exists(values, lambda v: v.isNull() | F.isnan(v))
    return F.when(bad, _bad()).otherwise(values)


def _bad() -> Column:
    return F.raise_error(F.lit("a point has a null or NaN value"))


def dimensions(df: DataFrame) -> int:
    """Of all points; -1 for no points, an error where they differ."""
    low, high = df.agg(F.min(F.size("values")), F.max(F.size("values"))).head()
    if low is None:
        return -1
    if low != high:
        raise ValueError(f"points have {low} to {high} dimensions")
    return low


def ranked(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """A dense rank from 1 by a total order: a range-partitioned sort, and offsets by partition, so that no task gets all rows.

    The sorted rows are checkpointed, as numbers and offsets must see the same partitions. The driver gets a number for each partition.
    """
    mono = F.monotonically_increasing_id()
    held = checkpointed(df.orderBy(*order).withColumn("_lp_mono", mono))
    part, place = F.shiftright("_lp_mono", 33), F.col("_lp_mono").bitwiseAND((1 << 33) - 1)
    counts = held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(counts, key=lambda r: r.p):
        offsets[r.p] = total
        total += r.n
    table = F.broadcast(df.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "_lp_p long, _lp_base long"))
    return held.join(table, part == F.col("_lp_p")).select(*df.columns, (place + F.col("_lp_base") + 1).alias(name))


def read_csv(spark: SparkSession, path: str, contains_class: bool = False, check_ragged: bool = True) -> DataFrame:
    """Lines of numbers without a header, the last field dropped unread where it is a class; ids follow the order of the lines.

    Malformed numbers, NaN and lines of different lengths are errors, as is a missing file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    fields = F.slice(fields, 1, F.greatest(F.size(fields) - 1, F.lit(0))) if contains_class else fields
    parsed = lines.select("f", "b", "m", F.transform(fields, lambda x: F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double"))).alias("values"))
    out = ranked(parsed, "f", "b", "m").select("id", checked(F.col("values")).alias("values"))
    if check_ragged:
        dimensions(out)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A line for each point, in order of id, over as many files as there are partitions (their names keep the order)."""
    df.orderBy("id").select(F.concat_ws(",", F.transform("values", lambda v: v.cast("string")))).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One integer a line; a blank or malformed line is an error."""
    value = F.trim("value")
    return spark.read.text(path).select(F.coalesce(value.try_cast("long"), F.raise_error(F.concat(F.lit("not an id: "), value)).cast("long")).alias("id"))


def write_ids(ids: DataFrame, path: str, one_file: bool = False) -> None:
    """Ascending and unique, one a line, in sorted parts whose names keep the order; one_file has one task write all, for tools that read a file."""
    out = ids.select("id").distinct().orderBy("id")
    (out.coalesce(1) if one_file else out).select(F.col("id").cast("string")).write.mode("overwrite").text(path)
