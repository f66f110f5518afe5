"""Line dedup: fuzzy lines over all documents (operator 1).

Lines are compared in normal form: lower case, ASCII punctuation left out, digits as 0, white space as single spaces. Equal
forms are one line. Others are near when their 64-bit SimHash over distinct words differs in at most DISTANCE bits and their edit
similarity (1 - Levenshtein distance / longer length, in code points) is SIMILARITY or more. Of each group of lines
connected by equal or near, one occurrence stays: that in the document with the smallest id, and there the first.
All other occurrences go from the texts.

Lines within the distance agree in r of DISTANCE + r blocks of bits (pigeonhole); Tables takes the least r that keeps buckets small for
the number of lines, and all choices find the same pairs. The first pass carries hashes only. It deals them by r - 1 blocks, a table for each choice of these; a task sorts
its rows by one block more, compares within these small buckets, and keeps the hashes that have another within the distance. Of each pair the
lowest r - 1 blocks that agree name the one table that it belongs to. The second pass carries the texts of these lines alone. Large buckets are dealt
over blocks of members, pairs of which are tasks of bounded memory. A task searches its lines group by group and verifies a pair only if it joins a
new line to the group, so n near lines give n - 1 links.

Defined results: lines with an empty normal form are kept and never compared. Null texts stay null. Null ids come after
all others. Repeated rows (equal id and text) are one document: they keep the same lines. A text of which every line
goes becomes empty. Empty tables give an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common
from lonepoint.llm.graph import block_of, components, groups
from lonepoint.llm.textvec import Words, blocks, mix

DISTANCE, SIMILARITY = 6, 0.8
#: Lines in a bucket of r blocks on average, up to which more bits don't pay; members and bytes of a block.
BUCKET, BLOCK_ROWS, BLOCK_BYTES = 1024, 1024, 4 << 20
#: Hashes that a group of the first pass has, about; one of how many lines shows which are larger; rows of that list that may be broadcast; hashes
#: of a bucket from which it is compared as a matrix.
GROUP_ROWS, SAMPLE, MOST_BROADCAST, MATRIX = 1 << 18, 16, 100_000, 96
NO_ID = (1 << 63) - 1

_DELETE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD = bytes.maketrans(b"123456789\t\x0b\x0c\r", b"0" * 9 + b"    ")


def normal_lines(text: bytes) -> list[bytes]:
    """The normal form of each line."""
    low = text.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
    # Most lines have single spaces already.
    return [b" ".join(x.split()) if b"  " in x or x[:1] == b" " or x[-1:] == b" " else x for x in low.translate(_FOLD, _DELETE).split(b"\n")]


#: Each bit of a byte as a byte of its own, so that eight counters are added at once.
_SPREAD = np.array([sum((v >> b & 1) << 8 * b for b in range(8)) for v in range(256)], np.uint64)


def simhash(lines: list[bytes]) -> np.ndarray:
    """64 bits for each line: the majority of the hash bits of its distinct words; 0 for a line without words.

    Each word counts once: else a line's frequent words, which long lines of a language share, would settle all bits.
    """
    w = Words(lines)
    # Line and 40 bits of the word in one number, so that one sort finds the distinct words of all lines.
    key = np.sort(w.doc.astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    line = (key >> np.uint64(40)).astype(np.int64)
    hashes = mix((key & np.uint64((1 << 40) - 1)) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(lines), np.uint64)
    counts = np.bincount(line, minlength=len(lines))
    some = counts > 0
    if some.any():
        # A counter of one byte holds 255 words; longer lines are added up by stretches.
        starts, counts = np.searchsorted(line, np.flatnonzero(some)), counts[some]
        pieces = -(-counts // 255)
        head = np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = np.repeat(starts, pieces) + 255 * (np.arange(len(head)) - head)
        sums = np.add.reduceat(_SPREAD[hashes.view(np.uint8)].reshape(-1, 8), cuts, axis=0).view(np.uint8).reshape(-1, 64)
        if len(cuts) > len(starts):
            sums = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums.astype(np.int32) > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class Tables:
    """Blocks of bits such that two numbers within the distance agree in at least r of distance + r blocks. A table is a choice of r - 1 of all
    blocks but the last; a pair belongs to that of the lowest r - 1 blocks in which it agrees."""

    def __init__(self, lines: int, distance: int = DISTANCE):
        self.distance = distance
        for r in range(2, 6):
            m = distance + r
            if lines / 2 ** (64 * r / m) <= BUCKET:
                break
        edges = [64 * i // m for i in range(m + 1)]
        self.r, self.blocks = r, [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(m)]
        self.chosen = list(combinations(range(m - 1), r - 1))

    def mask(self, table: int) -> int:
        return sum(self.blocks[i] for i in self.chosen[table])

    def owns(self, table: int, differ: np.ndarray) -> np.ndarray:
        """Whether pairs belong to the table, from the bits in which they differ."""
        out, last = np.ones(differ.shape, bool), self.chosen[table][-1]
        for i in range(last + 1):
            same = (differ & np.uint64(self.blocks[i])) == 0
            out &= same if i in self.chosen[table] else ~same
        return out

    def near(self, table: int, sims: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which of these hashes are in a pair within the distance that belongs to the table. group: numbers, equal ones side by side; pairs are sought
        within runs of equal ones, in which all hashes agree in the table's blocks (or they belong to no pair of it)."""
        found = np.zeros(len(sims), bool)
        run = np.concatenate([np.zeros(1, np.int64), np.cumsum(group[1:] != group[:-1])])[: len(sims)].astype(np.uint64)
        # Repeats of a hash in a group come together, and the first of them stands for all.
        order = np.argsort(mix(sims ^ mix(run + np.uint64(1))))
        s, g = sims[order], run[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        if self.chosen[table] == tuple(range(self.r - 1)):  # equal hashes agree in all blocks
            twice = ~new
            twice[:-1] |= ~new[1:]
            found[order[twice]] = True
        place = np.flatnonzero(new)
        s, g = s[place], g[place]
        hit = np.zeros(len(s), bool)
        for i in range(self.chosen[table][-1] + 1, len(self.blocks)):
            self._within(table, s, g, self.blocks[i], hit)
        # Repeats of a hash share what was found of the first.
        found[order] |= hit[np.cumsum(new) - 1]
        return found

    def _within(self, table: int, s: np.ndarray, g: np.ndarray, block: int, hit: np.ndarray) -> None:
        """Mark the hashes of pairs of one group that agree in one more block."""
        low, wide = np.uint64((block & -block).bit_length() - 1), np.uint64(block.bit_count())
        bucket = g << wide | (s & np.uint64(block)) >> low
        # Bucket and place in one number, which sorts faster than places by bucket.
        bits = np.uint64(max(1, len(s)).bit_length())
        if int(bucket.max(initial=0)).bit_length() + int(bits) <= 64:
            packed = np.sort(bucket << bits | np.arange(len(s), dtype=np.uint64))
            order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            k = packed >> bits
        else:
            order = np.argsort(bucket, kind="stable")
            k = bucket[order]
        x = s[order]
        edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        sizes = np.diff(edges)
        mine = np.zeros(len(x), bool)
        # Small buckets all at once: each hash with the next one of its bucket, the one after it, and so on.
        left = np.repeat(np.where(sizes < MATRIX, edges[1:], edges[:-1]), sizes) - np.arange(len(x))  # places up to the bucket's end
        at = np.flatnonzero(left > 1)
        for step in range(1, MATRIX):
            at = at[left[at] > step] if step > 1 else at
            if not len(at):
                break
            differ = x[at] ^ x[at + step]
            close = np.flatnonzero(np.bitwise_count(differ) <= self.distance)
            if len(close):
                pair = at[close][self.owns(table, differ[close])]
                mine[pair] = mine[pair + step] = True
        for a, b in zip(edges[:-1][sizes >= MATRIX].tolist(), edges[1:][sizes >= MATRIX].tolist(), strict=True):
            for i in range(a, b, 512):
                for j in range(i, b, 4096):
                    rows, columns = np.nonzero(np.bitwise_count(x[i : min(i + 512, b), None] ^ x[None, j : min(j + 4096, b)]) <= self.distance)
                    rows, columns = rows + i, columns + j
                    apart = rows < columns
                    rows, columns = rows[apart], columns[apart]
                    own = self.owns(table, x[rows] ^ x[columns])
                    mine[rows[own]] = mine[columns[own]] = True
        hit[order] |= mine


def _middles(a: str | list[str], b: str | list[str]) -> tuple:
    """Both without the beginning and the end that they share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    return a[: len(a) - low], b[: len(b) - low]


def edit_distance(a: str | list[str], b: str | list[str]) -> int:
    """Levenshtein distance of strings or lists by Myers' bit vectors, in Python's integers of any length."""
    a, b = _middles(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    all_bits, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = all_bits, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & all_bits
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & all_bits
        mh = mh << 1 & all_bits
        plus = mh | ~(xv | ph) & all_bits
        minus = ph & xv
    return score


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity is at least so much. Bounds that settle most pairs come before the distance itself."""
    allowed = (1 - least) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    a, b = _middles(a, b)
    if max(len(a), len(b)) <= allowed:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= allowed:
        return True
    # A word changed, added or taken away is no more edits than the longest one has characters, and a space.
    if edit_distance(x, y) * (1 + max(map(len, (*x, *y)))) <= allowed:
        return True
    return edit_distance(a, b) <= allowed


_LINES = "id long, th long, pos int, more array<int>, h1 long, h2 long, sim long, len int"


def _line_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different normal form of a document's lines: its first place and the others, 128 bits of the form's hash, its SimHash and length."""
    for batch in batches:
        ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, part in blocks([x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]):
            i_, t_, p_, m_, lines = [], [], [], [], []
            for k, text in enumerate(part, at):
                forms: dict[bytes, int] = {}
                for pos, line in enumerate(normal_lines(text)):
                    if line:
                        row = forms.setdefault(line, len(lines))
                        if row == len(lines):
                            i_.append(ids[k])
                            t_.append(ths[k])
                            p_.append(pos)
                            m_.append(None)
                            lines.append(line)
                        elif m_[row] is None:
                            m_[row] = [pos]
                        else:
                            m_[row].append(pos)
            digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(i_, pa.int64()), pa.array(t_, pa.int64()), pa.array(p_, pa.int32()), pa.array(m_, pa.list_(pa.int32())), pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), pa.array(simhash(lines).view(np.int64)), pa.array([len(x) for x in lines], pa.int32())],
                names=["id", "th", "pos", "more", "h1", "h2", "sim", "len"],
            )


def _candidates(tables: Tables):
    """The hashes of each table that have another within the distance, from rows of group and hash, sorted by group; the low byte of a group is the table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def dealt(parts: list[pa.RecordBatch], whole: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            """What the complete groups give, and the rest."""
            table = pa.Table.from_batches(parts).combine_chunks()
            group, sim = (table.column(i).to_numpy() for i in range(2))
            end = len(group) if whole else int(np.searchsorted(group, group[-1]))
            group, sim = group[:end], sim[:end].view(np.uint64)
            which = group & 255
            found = [(t, np.unique(sim[rows][tables.near(t, sim[rows], group[rows])])) for t in np.unique(which).tolist() for rows in [np.flatnonzero(which == t)]]
            of = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x), t, np.int32) for t, x in found)])
            out = pa.record_batch([pa.array(of, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in found)]).view(np.int64))], names=["t", "sim"])
            return out, table.slice(end).to_batches()

        rows, most = 0, GROUP_ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows > most:
                    out, held = dealt(held, False)
                    rows = sum(b.num_rows for b in held)
                    most = rows + GROUP_ROWS
                    yield out
        if held:
            yield dealt(held, True)[0]

    return run


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate lines of each document with their buckets, a row for each pair of blocks."""
    names = ["key", "bi", "bj", "h1", "h2", "block", "sim", "line"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    rows: list[tuple] = []
    held = 0

    def dealt() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for raw, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = normal_lines(raw or b"")
            for x in wanted:
                line = lines[x["pos"]].decode("utf-8", "surrogatepass")
                for b in x["buckets"]:
                    k, mine = b["blocks"], block_of(x["h1"], x["h2"], b["blocks"])
                    for other in range(k):
                        rows.append((b["key"], min(mine, other), max(mine, other), x["h1"], x["h2"], mine, x["sim"], line))
                        held += len(line) + 100
            if held > 4 << 20:
                yield dealt()
                rows, held = [], 0
    yield dealt()


def _links(tables: Tables, least: float):
    def verified(group: list[tuple]) -> Iterator[tuple]:
        key, bi, bj = group[0][:3]
        # In order of the hashes, and each found line linked to the first of its group, which is the smallest.
        unique = sorted({r[3:5]: r for r in group}.values(), key=lambda r: r[3:5])
        n = len(unique)
        sims = np.array([r[6] for r in unique], np.int64).view(np.uint64)
        block = np.array([r[5] for r in unique])
        fresh = np.ones(n, bool)
        for i in range(n):
            if not fresh[i]:
                continue
            fresh[i] = False
            todo = [i]
            while todo:
                at = todo.pop()
                differ = sims ^ sims[at]
                # A pair belongs to one table, and so to one bucket.
                near = np.flatnonzero(fresh & (np.bitwise_count(differ) <= tables.distance))
                near = near[tables.owns(key & 255, differ[near])]
                if bi != bj:
                    near = near[block[near] != block[at]]
                for j in near.tolist():
                    if similar(unique[at][7], unique[j][7], least):
                        fresh[j] = False
                        todo.append(j)
                        yield (*unique[i][3:5], *unique[j][3:5])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for group in groups(batches, 3) for x in verified(group)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["a1", "a2", "b1", "b2"])

    return run


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, least: float = SIMILARITY) -> DataFrame:
    """id (the largest long for null), th and drops, the places of the lines that go, for the documents that lose lines."""
    spark = docs.sparkSession
    common.prepare(spark)
    text = common.text_of(docs, text_col)
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), common.row_hash(text).alias("th"), text.alias("text"))
    lines = common.stored(narrow.mapInArrow(_line_rows, _LINES), "lines")
    place = F.struct("id", "th", "pos")
    # The smallest place by numbers alone, which aggregates by hashing: the order of id and then text is one decimal; equal ones have the same place.
    order = F.col("id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.pmod("th", F.lit(10**18)).cast("decimal(19,0)")
    ordered = lines.withColumn("o", order.cast("decimal(38,0)"))
    unique = ordered.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("th", "o").alias("th"), F.min_by("pos", "o").alias("pos"), F.count("*").alias("n"), F.min("sim").alias("sim"), F.min("len").alias("len"), F.max(F.col("more").isNotNull()).alias("again"))
    unique = common.stored(unique.select("h1", "h2", place.alias("first"), "n", "sim", "len", "again"), "unique")

    # First pass: hashes only. A key is the hash of a table's bits; its low byte is the table.
    tables = Tables(unique.count(), distance)
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    low = lambda h, t: h.bitwiseAND(F.lit(-256)).bitwiseOR(t)
    key_of = lambda t: low(F.xxhash64(F.lit(t), F.col("sim").bitwiseAND(signed(tables.mask(t)))), F.lit(t).cast("long"))
    hashed = unique.select("h1", "sim", F.explode(F.array(*(key_of(t) for t in range(len(tables.chosen))))).alias("key"))
    # How many blocks a large group gets is estimated from a sample; the pairs found don't depend on it.
    seen = hashed.filter(F.pmod("h1", F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    large = common.stored(seen.filter(F.col("n") * SAMPLE > GROUP_ROWS).select("key", F.ceil(F.col("n") * SAMPLE / GROUP_ROWS).cast("int").alias("k")), "large", narrow=True)
    count = large.count()
    dealt = hashed.select(F.col("key").alias("g"), "sim")
    if count:
        sized = hashed.join(F.broadcast(large) if count <= MOST_BROADCAST else large, "key", "left")
        mine = F.pmod(F.shiftright("h1", 8), F.col("k")).cast("int")
        paired = sized.withColumn("mine", mine).withColumn("other", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("k") - 1), F.array(F.lit(-1)))))
        pair = low(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")), F.col("key").bitwiseAND(F.lit(255)))
        dealt = paired.select(F.when(F.col("k").isNull(), F.col("key")).otherwise(pair).alias("g"), "sim")
    dealt = dealt.repartition("g").sortWithinPartitions("g")
    near = common.stored(dealt.mapInArrow(_candidates(tables), "t int, sim long").distinct(), "near", narrow=True)

    # Second pass: the texts of the lines that the first has found.
    keys = F.element_at(F.array(*(key_of(t) for t in range(len(tables.chosen)))), F.col("t") + 1)
    weighed = near.join(unique.select("h1", "h2", "first", "sim", "len"), "sim").select("h1", "h2", "first", "sim", "len", keys.alias("key"))
    weighed = common.stored(weighed, "weighed", narrow=True)
    blocks_ = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("len") / BLOCK_BYTES), F.lit(1)).cast("int")
    kept = weighed.groupBy("key").agg(F.count("*").alias("n"), blocks_.alias("blocks")).filter("n > 1").select("key", "blocks")
    listed = weighed.join(kept, "key").groupBy("h1", "h2", "first", "sim").agg(F.collect_list(F.struct("key", "blocks")).alias("buckets"))
    wanted = listed.groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h1", "h2", "sim", "buckets")).alias("wanted"))
    texts = narrow.join(wanted, ["id", "th"]).select("text", "wanted").mapInArrow(_texts, "key long, bi int, bj int, h1 long, h2 long, block int, sim long, line string")
    texts = texts.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    links = texts.mapInArrow(_links(tables, least), "a1 long, a2 long, b1 long, b2 long")
    edges = common.stored(links.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b")), "edges", narrow=True)
    parts = components(edges).select("node.h1", "node.h2", F.struct("component.h1", "component.h2").alias("root"))

    # The occurrence that stays, for lines that have others: equal ones or near ones.
    grouped = unique.select("h1", "h2", "first").join(parts, ["h1", "h2"])
    least_place = common.stored(grouped.groupBy("root").agg(F.min("first").alias("stays")), "stays", narrow=True)
    fuzzy = grouped.join(least_place, "root").select("h1", "h2", F.col("stays").alias("near_stays"))
    settled = unique.join(fuzzy, ["h1", "h2"], "left").filter((F.col("n") > 1) | F.col("again") | F.col("near_stays").isNotNull()).select("h1", "h2", F.coalesce("near_stays", "first").alias("stays"))
    # Written, so that the join shuffles both its sides for itself and can split a line that very many documents have.
    settled = common.stored(settled, "settled", narrow=True)
    # Of a document that has the occurrence that stays, only the others go.
    more = F.coalesce("more", F.array().cast("array<int>"))
    gone = lines.join(settled, ["h1", "h2"]).select("id", "th", F.when(place == F.col("stays"), more).otherwise(F.concat(F.array("pos"), more)).alias("gone"))
    return common.stored(gone.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("drops")).filter(F.size("drops") > 0), "drops", narrow=True)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """docs with the texts that stay; counts adds _lp_lines and _lp_removed, the numbers of lines before and removed."""
    drops = dropped_lines(docs, id_col, text_col, **options).select(F.col("id").alias("_lp_id"), F.col("th").alias("_lp_th"), F.col("drops").alias("_lp_drops"))
    keyed = docs.withColumns({"_lp_i": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_lp_h": common.row_hash(common.text_of(docs, text_col))})
    joined = keyed.join(drops, (F.col("_lp_i") == F.col("_lp_id")) & (F.col("_lp_h") == F.col("_lp_th")), "left")
    text, drops = F.col(text_col).cast("string"), F.col("_lp_drops")
    # The lines are bound to a name, so that they are cut once.
    kept = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drops), lambda i: F.get(ls, i)), "\n")
    whole = F.when(drops.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n", -1)), kept)[0])
    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    told = [lines.alias("_lp_lines"), F.when(drops.isNull(), 0).otherwise(F.size(drops)).cast("long").alias("_lp_removed")] if counts else []
    return joined.select(*(whole.alias(c) if c == text_col else F.col(c) for c in docs.columns), *told)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, text, n_lines and n_removed."""
    out = dedup_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), counts=True, **options)
    return out.select("doc_id", "text", F.col("_lp_lines").alias("n_lines"), F.col("_lp_removed").alias("n_removed"))
