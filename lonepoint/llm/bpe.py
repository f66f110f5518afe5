"""Byte-level BPE encoding and decoding (operator 3).

tiktoken encodes each text by a local rank file, whose path is a parameter; the driver reads it (about 1 MB, bounded by
the vocabulary) and broadcasts the bytes. Long texts are first cut at safe boundaries, where no match of the
pattern can cross, so that each call has bounded work: before white space that follows other characters, and, in a
stretch without such a place, between whole matches. A single match of extreme length goes to the merge loop directly,
as the library's regular expression engine overflows on long runs of white space. The places are safe for SAFE_PATTERN; long texts by any
other pattern are encoded a match at a time, which is slower and needs no such place. Decoding joins the raw bytes of the ids.

Defined results: null and empty texts have no ids and decode to nothing; strings of special tokens are ordinary text;
repeated rows, null ids and extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common

#: Code points above which a text is cut, about how many a part has, and above which a match is merged by itself.
LONG, PART, HUGE = 60_000, 30_000, 20_000
#: Fixed value: the pattern of which no match has white space after another character, so that a text can be cut before white space that
#: follows other characters.
SAFE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")

_encodings: dict[str, object] = {}


class Codec:
    """Encodes and decodes by one rank file and pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.match, self.safe = regex.compile(pattern), pattern == SAFE_PATTERN
        self.names = [str(i) for i in range(max(table.values(), default=0) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        if not self.safe:
            for m in self.match.finditer(text):
                if m.end() > m.start():
                    out += self.encoding._encode_single_piece(m.group())
            return out
        for part, whole in self.parts(text):
            out += self.encoding._encode_single_piece(part) if whole else self.encoding.encode_ordinary(part)
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in parts; whether a part is a single match of the pattern."""
        at, end = 0, len(text)
        while at < end:
            cut = _SAFE.search(text, min(at + PART, end))
            to = cut.start() if cut else end
            if to - at <= LONG:
                yield text[at:to], False
            else:
                yield from self.by_match(text[at:to])
            at = to

    def by_match(self, text: str) -> Iterator[tuple[str, bool]]:
        """For a stretch without a safe place: its matches, the short ones together."""
        start = 0
        for m in self.match.finditer(text):
            if m.end() - m.start() > HUGE:
                if m.start() > start:
                    yield text[start : m.start()], False
                yield m.group(), True
                start = m.end()
            elif m.start() - start > PART and not m.group()[0].isspace() and not text[m.start() - 1].isspace():
                yield text[start : m.start()], False
                start = m.start()
        if start < len(text):
            yield text[start:], False

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def codec(ranks: bytes, pattern: str) -> Codec:
    """One for each worker process."""
    key = hashlib.sha1(ranks + pattern.encode()).hexdigest()
    if key not in _encodings:
        _encodings[key] = Codec(ranks, pattern)
    return _encodings[key]


#: Columns that transcode() can add: type, and the value from the codec, the ids and the text.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda c, ids, raw: ids),
    "n_tokens": ("long", pa.int64(), lambda c, ids, raw: len(ids)),
    "decoded": ("binary", pa.binary(), lambda c, ids, raw: raw),
    "ids_sha256": ("string", pa.string(), lambda c, ids, raw: hashlib.sha256(" ".join([c.names[i] for i in ids]).encode()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda c, ids, raw: hashlib.sha256(raw).hexdigest()),
}


def transcode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded"), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep and those named in outputs: the ids of each whole text and what they decode to, or their digests."""
    spark = docs.sparkSession
    common.prepare(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), common.text_of(docs, text_col).alias("text"))
    fields = ", ".join([*(f"k{i} {dict(inner.dtypes)[f'k{i}']}" for i in range(len(keep))), *(f"{n} {OUTPUTS[n][0]}" for n in outputs)])
    decodes = any(n.startswith("decoded") for n in outputs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            # Few rows at a time: ids take many times the bytes of their text.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made: list[list] = [[] for _ in outputs]
                for text in part.column(len(keep)).to_pylist():
                    ids = c.encode(text or "")
                    raw = c.decode(ids) if decodes else b""
                    for column, n in zip(made, outputs, strict=True):
                        column.append(OUTPUTS[n][2](c, ids, raw))
                yield pa.record_batch([*part.columns[: len(keep)], *(pa.array(v, OUTPUTS[n][1]) for v, n in zip(made, outputs, strict=True))], names=[*part.schema.names[: len(keep)], *outputs])

    out = inner.mapInArrow(run, fields)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *outputs)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """tokens with the raw bytes of an array of ids in one more column."""
    spark = tokens.sparkSession
    common.prepare(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def raw(ids):
        c = codec(ranks.value, pattern)
        return ids.map(lambda x: b"" if x is None else c.decode([int(i) for i in x]))

    return tokens.withColumn(to, raw(F.col(ids_col)))
