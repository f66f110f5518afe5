"""Token ids packed into sequences of one length (operator 4).

Documents are split into pieces of at most one sequence, without loss. Best-fit-decreasing puts the pieces, the longest first, each
into the open sequence with the least room that still holds it; a segment tree over capacities finds that sequence in logarithmic
time. Sequences are written as matrices of ids, with the cumulative lengths of their segments and position numbers that
begin anew with each segment, as attention over packed segments needs them.

Documents are dealt by a hash of the row to partitions and sorted there, so the packing depends on the rows and the number of
partitions alone; a retried task packs the same again. Only rows whose id more than REPEATED rows have are dealt on by where they come from,
so that no task gets all rows of a text that very many repeat. Each task packs stretches of BLOCK_TOKENS, so its memory is
bounded, and a stretch leaves less than a sequence's room unused besides what best fit can't fill. A document of any length is
many pieces of full sequences and one rest. Ids take two bytes where the vocabulary allows, else four; little-endian.

Defined results: documents without tokens (null or empty) have one segment of just the end mark where one is asked for,
else none; repeated rows are packed each; null ids stay null in the segments' lists. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import bpe, common

LENGTH, MATRIX_ROWS, BLOCK_TOKENS, REPEATED = 2048, 64, 1 << 20, 4096


class CapacityTree:
    """Room left, 0 to `most`, with the open bins that have it; the smallest room of at least a size is found along one path."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.any = [0] * (2 * self.leaves)  # bins below each node
        self.bins: dict[int, list[int]] = {}

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.any[i] += by
            i //= 2

    def add(self, room: int, bin_: int) -> None:
        self.bins.setdefault(room, []).append(bin_)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The open bin with the least room that holds size, and that room; it is no longer open."""
        i = size + self.leaves
        if not self.any[i]:
            # Up to the first node whose right sibling has bins, then down to its leftmost.
            while True:
                if i == 1:
                    return None
                if i % 2 == 0 and self.any[i + 1]:
                    i += 1
                    break
                i //= 2
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        bin_ = self.bins[room].pop()
        self._count(room, -1)
        return bin_, room


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """The items of each bin, by their place in sizes. Sizes are 1 to most; equal sizes keep their order."""
    tree, bins = CapacityTree(most), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        found = tree.take(size)
        if found is None:
            bins.append([item])
            room, bin_ = most - size, len(bins) - 1
        else:
            bin_, room = found[0], found[1] - size
            bins[bin_].append(item)
        if room:
            tree.add(room, bin_)
    return bins


def position_kind(length: int) -> np.dtype:
    return np.dtype("<u2" if length <= 1 << 16 else "<u4")


FIELDS = "part int, matrix int, n_rows int, length int, id_bytes int, ids binary, positions binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, piece_no array<array<int>>, n_tokens long"
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("matrix", pa.int32()), ("n_rows", pa.int32()), ("length", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
     ("cu_seqlens", pa.list_(pa.list_(pa.int32()))), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("piece_no", pa.list_(pa.list_(pa.int32()))), ("n_tokens", pa.int64())]
)


def matrices(rows: Iterator[tuple[int | None, np.ndarray]], part: int, length: int, pad: int, id_bytes: int) -> Iterator[dict]:
    """Packed matrices from (document id, ids) in order."""
    kind = np.dtype("<u2" if id_bytes == 2 else "<u4")
    number = 0

    def dealt(pieces: list[tuple[int | None, int, np.ndarray]]) -> Iterator[dict]:
        nonlocal number
        bins = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for at in range(0, len(bins), MATRIX_ROWS):
            some = bins[at : at + MATRIX_ROWS]
            ids, positions = np.full((len(some), length), pad, kind), np.zeros((len(some), length), position_kind(length))
            ends, docs, numbers = [], [], []
            for r, items in enumerate(some):
                place, cu = 0, [0]
                for i in items:
                    x = pieces[i][2]
                    ids[r, place : place + len(x)] = x
                    positions[r, place : place + len(x)] = np.arange(len(x))
                    place += len(x)
                    cu.append(place)
                ends.append(cu)
                docs.append([pieces[i][0] for i in items])
                numbers.append([pieces[i][1] for i in items])
            yield {"part": part, "matrix": number, "n_rows": len(some), "length": length, "id_bytes": id_bytes, "ids": ids.tobytes(), "positions": positions.tobytes(), "cu_seqlens": ends, "doc_ids": docs, "piece_no": numbers, "n_tokens": sum(c[-1] for c in ends)}
            number += 1

    pieces, held = [], 0
    for doc, ids in rows:
        for k, at in enumerate(range(0, len(ids), length)):
            pieces.append((doc, k, ids[at : at + length]))
            held += len(pieces[-1][2])
            if held >= BLOCK_TOKENS:
                yield from dealt(pieces)
                pieces, held = [], 0
    yield from dealt(pieces)


def unpack(matrix: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Document id, number of the piece and ids of each segment of a matrix."""
    kind = np.dtype("<u2" if matrix["id_bytes"] == 2 else "<u4")
    ids = np.frombuffer(bytes(matrix["ids"]), kind).reshape(matrix["n_rows"], matrix["length"])
    for row, cu, docs, numbers in zip(ids, matrix["cu_seqlens"], matrix["doc_ids"], matrix["piece_no"], strict=True):
        for a, b, doc, k in zip(cu[:-1], cu[1:], docs, numbers, strict=True):
            yield doc, k, row[a:b]


def pack(docs: DataFrame, path: str, pattern: str, end_id: int | None, parts: int | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 16) -> DataFrame:
    """A row for each matrix: its ids (n_rows x length, padded by the end mark or 0), positions (two bytes each, four where a sequence has over 65536), cu_seqlens, the
    documents and piece numbers of the segments. end_id closes each document; None: nothing does. parts: partitions; by default
    the session's number of shuffle partitions."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    text = common.text_of(docs, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), common.row_hash(text).alias("th"), text.alias("text"))
    salt = F.lit(0)
    often = narrow.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > REPEATED).select(F.col("id").alias("again"))
    often = common.stored(often, "often", narrow=True)
    if not often.isEmpty():
        narrow = narrow.join(often, F.col("id").eqNullSafe(F.col("again")), "left").select("id", "th", "text", (F.col("again").isNotNull() | F.col("id").isNull()).alias("many"))
        salt = F.when(F.col("many"), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(0)
    dealt = narrow.repartition(parts, F.xxhash64("id", "th", salt)).sortWithinPartitions("id", "th").select(F.spark_partition_id().alias("part"), "id", "text")
    id_bytes = 2 if vocabulary <= 1 << 16 else 4
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(ranks.value, pattern)
        number = [0]

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for part, doc, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    number[0] = part
                    yield doc, np.array(codec.encode(x or "") + tail, np.uint32)

        for m in matrices(rows(), 0, length, end_id or 0, id_bytes):
            m["part"] = number[0]
            yield pa.RecordBatch.from_pylist([m], schema=_SCHEMA)

    return dealt.mapInArrow(run, FIELDS)


def write(packed: DataFrame, to: str) -> None:
    """The matrices as Parquet, a folder for each part, for readers that map ids and cu_seqlens without this package."""
    packed.write.partitionBy("part").mode("overwrite").parquet(to)
