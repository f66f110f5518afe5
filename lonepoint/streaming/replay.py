"""Stateful detection over many streams, in batch: each stream in order of its ids, with the window as the only state.

A stream is sequential by nature and is one task's work; streams run in parallel. What can be said declaratively is better asked from
operators.counts, which cuts a stream into buckets of a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.streaming.detectors import NUMBERS, BoundedLsh, Exact, MicroClusters

#: kind is "outlier", with a point's id, or "slide", with the slide's number and its figures.
FIELDS = "stream_id string, kind string, id long, " + ", ".join(f"{c} long" for c in NUMBERS)


def numbered(points: DataFrame) -> DataFrame:
    """stream_id, id and values: ids from 1 in each stream, in the order of the ids given."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("id"))
    return points.select("stream_id", rank.cast("long").alias("id"), "values")


class Run:
    """One stream through a detector: points in, rows out; a slide is stepped when it is complete."""

    def __init__(self, detector, stream: str, state: dict | None = None):
        self.detector, self.stream = detector, stream
        self.state = state or {"at": 0, "slide": 0, "ids": [], "values": [], "own": detector.start()}

    def push(self, id_: int, values: list[float]) -> Iterator[tuple]:
        s = self.state
        if id_ != s["at"] + 1:
            raise ValueError(f"stream {self.stream}: id {id_} after {s['at']}")
        if s["values"] and len(values) != len(s["values"][0]):
            raise ValueError(f"stream {self.stream}: {len(values)} values after {len(s['values'][0])}")
        s["at"] = id_
        s["ids"].append(id_)
        s["values"].append(values)
        if len(s["ids"]) == self.detector.params.slide:
            yield from self._step()

    def _step(self) -> Iterator[tuple]:
        s = self.state
        gone, numbers = self.detector.step(s["own"], s["ids"], np.array(s["values"], float))
        s["slide"] += 1
        s["ids"], s["values"] = [], []
        for i in gone:
            yield (self.stream, "outlier", i, *[None] * len(NUMBERS))
        yield (self.stream, "slide", s["slide"], *(numbers.get(c) for c in NUMBERS))

    def finish(self) -> Iterator[tuple]:
        """A last slide that is short, and the residents' verdicts."""
        if self.state["ids"]:
            yield from self._step()
        for i in self.detector.finish(self.state["own"]):
            yield (self.stream, "outlier", i, *[None] * len(NUMBERS))


def replay(points: DataFrame, detector) -> DataFrame:
    """FIELDS for points with stream_id, id (from 1 without gaps) and values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * (3 + len(NUMBERS))
            types = [pa.string(), pa.string(), *[pa.int64()] * (1 + len(NUMBERS))]
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["stream_id", "kind", "id", *NUMBERS])

        now: Run | None = None
        for batch in batches:
            rows: list[tuple] = []
            for stream, id_, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.stream != stream:
                    if now is not None:
                        rows += now.finish()
                    now = Run(detector, stream)
                rows += now.push(id_, values)
            yield made(rows)
        if now is not None:
            yield made(list(now.finish()))

    ordered = points.select(F.col("stream_id").cast("string").alias("stream_id"), "id", "values").repartition("stream_id").sortWithinPartitions("stream_id", "id")
    return ordered.mapInArrow(run, FIELDS)


__all__ = ["FIELDS", "BoundedLsh", "Exact", "MicroClusters", "Run", "numbered", "replay"]
