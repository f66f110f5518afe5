"""Exact dedup by Patricia tries (operator 7).

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Rows are dealt by length and
content hash, and each task inserts the full byte strings that it gets into a compressed radix trie whose terminal
nodes keep the row that stays. A first trie in each scan task joins the copies that the task meets, so that a group
with a third of all rows crosses the shuffle as one row for each scan task. A trie beyond its budget of bytes spills
its heaviest subtree to a file of the task and goes on; spilled subtrees are read back one after the other.

Tries settle which texts are equal. The rows then find their class by length and SHA-256; the tries have compared all
strings under one digest, and raise an error if two different ones should ever share it.

Defined results: a null text counts as empty, and all empty texts are one group. Null ids lose against any other
when code points tie. Repeated rows are members like any other and all carry the flags of their id: where rows of the
id that stays repeat, each of them is kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common

#: The six characters that comparison ignores.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of strings that a trie holds before it spills.
TRIE_BYTES = 96 << 20
#: Bytes of strings in the trie of a scan task before it hands on what it has.
SCAN_BYTES = 48 << 20

#: Stands for a null id, so that any other is smaller.
NO_ID = (1 << 63) - 1


def better(a: list, b: list) -> list:
    """The values of a terminal node: [minus code points, id, count]."""
    return [*min((a[0], a[1]), (b[0], b[1])), a[2] + b[2]]


class Node:
    """A compressed edge (label) with its children by first byte, and the value of the string that ends here."""

    __slots__ = ("kids", "label", "value")

    def __init__(self, label: bytes, value: list | None = None):
        self.label, self.value, self.kids = label, value, {}


class PatriciaTrie:
    """A radix trie over byte strings with bounded memory; items() yields each distinct string once with its joined value."""

    def __init__(self, budget: int = TRIE_BYTES, join=better):
        self.root, self.budget, self.join = Node(b""), budget, join
        self.held = 0
        self.out: dict[int, tuple] = {}  # first byte after the root's label: its spill file

    def insert(self, key: bytes, value: list) -> None:
        if self.out and len(key) > 0 and (spill := self.out.get(key[0])):
            pickle.dump((key, value), spill[0])
            return
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                node.value = value if node.value is None else self.join(node.value, value)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], value)
                self.held += n - at + 200
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            same = _common(label, key, at)
            upper = Node(label[:same])
            kid.label = label[same:]
            upper.kids[kid.label[0]] = kid
            node.kids[key[at]] = upper
            self.held += 200
            node, at = upper, at + same
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Move the heaviest subtree of the root to a file; later strings that begin like it follow."""
        if not self.root.kids:
            return
        first = max(self.root.kids, key=lambda b: _weight(self.root.kids[b]))
        file = tempfile.TemporaryFile()
        top = self.root.kids.pop(first)
        for key, value in _walk(top, b""):
            pickle.dump((key, value), file)
        self.out[first] = (file,)
        self.held = sum(_weight(k) for k in self.root.kids.values())

    def items(self) -> Iterator[tuple[bytes, list]]:
        yield from _walk(self.root, b"")
        self.root = Node(b"")
        for first, (file,) in self.out.items():
            file.seek(0)
            prefix, rest = None, PatriciaTrie(self.budget, self.join)
            # A subtree hangs from one edge. Its strings lose the bytes that they all share, so that the next trie's root branches.
            for key, _ in _loaded(file):
                prefix = key if prefix is None else prefix[: _common(prefix, key, 0)]
            file.seek(0)
            for key, value in _loaded(file):
                rest.insert(key[len(prefix or b"") :], value)
            file.close()
            yield from (((prefix or b"") + key, value) for key, value in rest.items())
        self.out = {}


def _loaded(file) -> Iterator[tuple[bytes, list]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _common(a: bytes, b: bytes, at: int) -> int:
    """Bytes that a shares with b from at on, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _weight(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        total += len(x.label) + 200
        todo += x.kids.values()
    return total


def _walk(node: Node, before: bytes) -> Iterator[tuple[bytes, list]]:
    todo = [(node, before)]
    while todo:
        x, prefix = todo.pop()
        key = prefix + x.label
        if x.value is not None:
            yield key, x.value
        todo += [(k, key) for k in x.kids.values()]


def normalise(raw: bytes) -> bytes:
    return raw.translate(None, SPACES)


def code_points(raw: bytes) -> int:
    """Of UTF-8: bytes that don't continue a character."""
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))


_MEMBER = pa.schema([("doc_id", pa.int64()), ("cp", pa.int64()), ("len", pa.int64()), ("sha", pa.binary())])
_TEXTS = pa.schema([("len", pa.int64()), ("h", pa.int64()), ("key", pa.binary()), ("neg", pa.int64()), ("best", pa.int64()), ("n", pa.int64())])
_CLASSES = pa.schema([("len", pa.int64()), ("sha", pa.binary()), ("best", pa.int64()), ("n", pa.int64())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, cps, lens, shas = [], [], [], []
        for doc, raw in _rows(batch):
            key = normalise(raw or b"")
            ids.append(doc)
            cps.append(code_points(raw or b""))
            lens.append(len(key))
            shas.append(hashlib.sha256(key).digest())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(cps, pa.int64()), pa.array(lens, pa.int64()), pa.array(shas, pa.binary())], schema=_MEMBER)


def _batched(rows: Iterator[list], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most so many bytes in their binary columns, beside single rows that have more."""
    columns, held = [[] for _ in schema], 0
    for row in rows:
        for c, v in zip(columns, row, strict=True):
            c.append(v)
            held += len(v) if isinstance(v, bytes) else 8
        if held >= most:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns, held = [[] for _ in schema], 0
    if columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _scan_tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the copies within a stretch of this task's rows."""

    def rows() -> Iterator[list]:
        trie = PatriciaTrie(budget=1 << 62)
        for batch in batches:
            for doc, raw in _rows(batch):
                trie.insert(normalise(raw or b""), [-code_points(raw or b""), NO_ID if doc is None else doc, 1])
                if trie.held > SCAN_BYTES:
                    yield from dealt(trie)
                    trie = PatriciaTrie(budget=1 << 62)
        yield from dealt(trie)

    def dealt(trie: PatriciaTrie) -> Iterator[list]:
        for key, value in trie.items():
            yield [len(key), int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big", signed=True), key, *value]

    return _batched(rows(), _TEXTS)


def _class_tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[list]:
        trie = PatriciaTrie()
        for batch in batches:
            for key, *value in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                trie.insert(key, value)
        for key, (_, best, n) in trie.items():
            yield [len(key), hashlib.sha256(key).digest(), best, n]

    return _batched(rows(), _CLASSES)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct normalised texts: len (bytes), sha, best (id of the row that stays; the largest long for null) and n (rows)."""
    common.prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text"))
    dealt = texts.mapInArrow(_scan_tries, "len long, h long, key binary, neg long, best long, n long").repartition("len", "h")
    return dealt.mapInArrow(_class_tries, "len long, sha binary, best long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found = common.stored(classes(docs, id_col, text_col), "classes", narrow=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text"))
    members = texts.mapInArrow(_members, "doc_id long, cp long, len long, sha binary")
    # A digest of two different strings would be two classes: the join below would then multiply rows, so this fails instead.
    groups = found.filter("n > 1").groupBy("len", "sha").agg(
        F.min("best").alias("best"), F.sum("n").alias("n"), F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).alias("clash")
    )
    groups = groups.filter(F.col("clash").isNull()).drop("clash")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).when(F.col("best") != NO_ID, F.col("best"))
    return members.join(groups, ["len", "sha"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
