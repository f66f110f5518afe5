"""The same detectors over unbounded streams.

Order comes from the ids, not from time: ids of a stream go up by one, and a gap or a late point is an error. A stream has no end
of file, so a row whose values are null closes its stream: the short last slide is judged, and the residents.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.plans.storage import shared_folder
from lonepoint.streaming.detectors import NUMBERS
from lonepoint.streaming.replay import FIELDS, Run


def detect(points: DataFrame, detector) -> DataFrame:
    """points: a streaming frame with stream_id, id and values. Appends rows of replay.FIELDS when outliers leave and slides end."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else None
        one = Run(detector, key[0], kept)
        incoming = pd.concat(list(frames)).sort_values("id")
        rows: list[tuple] = []
        for id_, values in zip(incoming["id"], incoming["values"], strict=True):
            if values is None:
                rows += one.finish()
                one = Run(detector, key[0])
            else:
                rows += one.push(int(id_), [float(v) for v in values])
        state.update((pickle.dumps(one.state),))
        out = pd.DataFrame(rows, columns=["stream_id", "kind", "id", *NUMBERS])
        yield out.astype({c: "Int64" for c in ("id", *NUMBERS)})

    return points.groupBy("stream_id").applyInPandasWithState(run, FIELDS, "state binary", "append", "NoTimeout")


def run_over_files(points: DataFrame, detector, files: int = 4) -> DataFrame:
    """The whole way through Structured Streaming: points written in so many stretches of their ids, each one micro-batch of as many files as
    its tasks write, the streams closed by a last one, and what the detector appends written to a sink of files and read from it. The query
    stops after each stretch and goes on from its checkpoint with the next."""
    spark = points.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    inner = points.select(F.col("stream_id").cast("string").alias("stream_id"), "id", "values")
    last = inner.groupBy("stream_id").agg(F.max("id").alias("last"))
    part = F.least(F.floor((F.col("id") - 1) * files / F.col("last")), F.lit(files - 1))
    inner.join(last, "stream_id").select("stream_id", "id", "values", part.cast("int").alias("part")).write.partitionBy("part").parquet(f"{at}/all")
    cut = spark.read.schema("stream_id string, id long, values array<double>, part int").parquet(f"{at}/all")
    close = last.select("stream_id", (F.col("last") + 1).alias("id"), F.lit(None).cast("array<double>").alias("values"))
    for k in range(files + 1):
        some = cut.filter(F.col("part") == k).drop("part") if k < files else close
        some.write.parquet(f"{at}/in/{k:05d}")
        stream = spark.readStream.schema(inner.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        q = detect(stream, detector).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(FIELDS).parquet(f"{at}/out")
