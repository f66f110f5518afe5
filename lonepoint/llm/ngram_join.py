"""N-gram Jaccard join by MinHash banding (operator 9).

A text is the set of its shingles of five words ([^\\x20\\x09-\\x0D]+; a text of fewer words has one shingle of all of
them). Texts with equal sets are one class, found by a 128-bit fingerprint. bands() chooses bands and rows so that a pair
at the threshold meets in some band with the target recall. Classes are shuffled on their band hashes; buckets with the
same members count once. A pair is then verified on the full sets of 64-bit shingle hashes, in the first of its
common buckets only, so no pair counts twice and none needs a global distinct.

A bucket that is large by rows or by shingles is dealt over blocks, and each pair of blocks is a task of bounded
memory. Tasks count links and hand on a spanning forest of them, never the pairs, so a group of n near copies gives n rows
for each task. Links between classes carry the numbers of their members; copies are not expanded into pairs.

Defined results: texts without words (null, empty, white space) link with nothing and are classes of their own. Null ids
(and the largest long) come after all others as representatives. Repeated rows are copies of each other. Extra columns are ignored. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common
from lonepoint.llm.graph import block_of, components, distinct_buckets, groups
from lonepoint.llm.textvec import Words, blocks, mix

WORDS, SIMILARITY, RECALL, MAX_HASHES, SEED = 5, (4, 5), 0.999, 160, 7
#: Members and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
NO_ID = (1 << 63) - 1


def bands(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows of a band: the most rows for which the bands needed for the recall take at most so many hashes."""
    best = (1, 1)
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        count = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if count * rows <= most:
            best = (count, rows)
    return best


def sets_of(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and the place of each text's first."""
    hashes, where = Words(texts).shingles(n)
    order = np.lexsort((hashes, where))
    hashes, where = hashes[order], where[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (where[1:] != where[:-1])
    hashes, where = hashes[new], where[new]
    return hashes, np.searchsorted(where, np.arange(len(texts) + 1))


class Signer:
    """Band keys and fingerprints of shingle sets."""

    def __init__(self, count: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.count, self.rows = count, rows
        self.a = rng.integers(0, 1 << 63, count * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count * rows, np.uint64)

    def sign(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sets that aren't empty: keys (sets x bands) and the two halves of the fingerprint."""
        starts = first[:-1][np.diff(first) > 0]
        keys = np.zeros((len(starts), self.count), np.uint64)
        if not len(starts):
            return keys, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for band in range(self.count):
            key = np.full(len(starts), band + 1, np.uint64)
            for row in range(self.rows):
                i = band * self.rows + row
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * self.a[i] + self.b[i], starts))
            keys[:, band] = key
        mixed = mix(hashes ^ np.uint64(0x6A09E667F3BCC909))
        f1 = np.add.reduceat(mixed, starts)
        f2 = np.add.reduceat(mix(mixed + np.uint64(0x3C6EF372FE94F82B)), starts)
        return keys, f1, f2


_SIGNED = "id long, th long, n long, h1 long, h2 long, keys array<long>"


def _signatures(signer: Signer, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for at, part in blocks(texts):
                hashes, first = sets_of(part, n)
                keys, f1, f2 = signer.sign(hashes, first)
                sizes = np.diff(first)
                some = sizes > 0
                own = batch.slice(at, len(part))
                halves = []
                for f in (f1, f2):
                    column = np.zeros(len(part), np.int64)
                    column[some] = f.view(np.int64)
                    halves.append(pa.array(column, mask=~some))
                offsets = np.concatenate([[0], np.cumsum(some * signer.count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
                yield pa.record_batch([own.column(0), own.column(1), pa.array(sizes), *halves, lists], names=["id", "th", "n", "h1", "h2", "keys"])

    return run


def _members(n: int):
    """Rows of a task's groups from texts with their buckets: key, the pair of blocks, the member's block, the member, its size, its buckets by band and its set."""
    names = ["key", "bi", "bj", "h1", "h2", "block", "size", "buckets", "shingles"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            rest = [batch.column(i).to_pylist() for i in range(1, 5)]
            for at, part in blocks(texts):
                hashes, first = sets_of(part, n)
                for i in range(len(part)):
                    h1, h2, size, buckets = (c[at + i] for c in rest)
                    shingles = hashes[first[i] : first[i + 1]].tobytes()
                    own = np.zeros(max((b["j"] for b in buckets), default=-1) + 1, np.int64)
                    for b in buckets:
                        own[b["j"]] = b["key"]
                    for b in buckets:
                        k, mine = b["blocks"], block_of(h1, h2, b["blocks"])
                        for other in range(k):
                            rows.append((b["key"], min(mine, other), max(mine, other), h1, h2, mine, size, own.tobytes(), shingles))
                            held += len(shingles) + 300
                        if held > 8 << 20:
                            yield _as_batch(rows, names, types)
                            rows, held = [], 0
        if rows:
            yield _as_batch(rows, names, types)

    return run


def _as_batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: by products of columns for shingles that many sets have, by pairs for the others."""
    n = len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    counts = np.bincount(column, minlength=len(values))
    out = np.zeros(n * n, np.float64)
    dense = counts * counts > n * n / 16
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    # Rare shingles: step k pairs each of a shingle's sets with the k-th after it.
    rare = (counts > 1) & ~dense
    keep = rare[column]
    c, r = column[keep], row[keep]
    for k in range(1, int(counts[rare].max(initial=0))):
        same = c[:-k] == c[k:]
        if not same.any():
            break
        out += np.bincount(r[:-k][same] * n + r[k:][same], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    wide = np.flatnonzero(dense & (counts > 1))
    place = np.full(len(values), -1)
    place[wide] = np.arange(len(wide))
    spot, take = place[column], place[column] >= 0
    for at in range(0, len(wide), 2048):
        inside = take & (spot >= at) & (spot < at + 2048)
        m = np.zeros((n, min(2048, len(wide) - at)), np.float32)
        m[row[inside], spot[inside] - at] = 1
        out += m @ m.T
    return out


def _links(similarity: tuple[int, int]):
    num, den = similarity

    def verified(rows: list[tuple]) -> Iterator[tuple]:
        key, bi, bj = rows[0][:3]
        # In order of the fingerprints, so that links lead to the smallest of a group: components() bears large stars around small nodes.
        unique = sorted({r[3:5]: r for r in rows}.values(), key=lambda r: r[3:5])
        n = len(unique)
        if n < 2:
            return
        sets = [np.frombuffer(r[8], np.uint64) for r in unique]
        sizes = np.array([len(s) for s in sets], np.int64)
        buckets = [np.frombuffer(r[7], np.int64) for r in unique]
        width = max(map(len, buckets))
        table = np.zeros((n, width), np.int64)
        for i, b in enumerate(buckets):
            table[i, : len(b)] = b
        if n == 2:
            shared = np.array([[0, np.intersect1d(*sets, assume_unique=True).size]] * 2, float)
        else:
            shared = overlaps(sets)
        union = sizes[:, None] + sizes[None, :] - shared
        linked = shared * den >= num * union
        if bi != bj:
            block = np.array([r[5] for r in unique])
            linked &= block[:, None] != block[None, :]
        linked = np.triu(linked, 1)
        # A pair belongs to the first bucket that both have.
        for band in range(int(np.flatnonzero(table[0] == key)[0])):
            if linked.any():
                linked &= ~((table[:, band][:, None] == table[:, band][None, :]) & (table[:, band] != 0)[:, None])
        if not linked.any():
            return
        linked |= linked.T
        members = np.array([r[6] for r in unique], np.int64)
        links = linked @ members
        seen = np.zeros(n, bool)
        for i in np.flatnonzero(links).tolist():
            root = unique[i][3:5]
            if not seen[i]:
                seen[i] = True
                todo = [i]
                while todo:
                    near = linked[todo.pop()] & ~seen
                    seen |= near
                    for j in np.flatnonzero(near).tolist():
                        yield (*unique[j][3:5], *root, 0)
                        todo.append(j)
            yield (*root, None, None, int(links[i]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["a1", "a2", "b1", "b2", "n"], [pa.int64()] * 5
        rows: list[tuple] = []
        for group in groups(batches, 3):
            rows += verified(group)
            if len(rows) > 20_000:
                yield _as_batch(rows, names, types)
                rows = []
        yield _as_batch(rows, names, types)

    return run


class Join:
    """texts: id, th, h1, h2 by row (id: the largest long for null). classes: h1, h2, rep and rep_th (the row that stands for the
    class), size, links (other rows linked directly) and class_id (the smallest id that links reach)."""

    def __init__(self, texts: DataFrame, classes: DataFrame):
        self.texts, self.classes = texts, classes


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> Join:
    spark = docs.sparkSession
    common.prepare(spark)
    text = common.text_of(docs, text_col)
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), common.row_hash(text).alias("th"), text.alias("text"))
    count, rows = bands(similarity[0] / similarity[1], recall)
    signed = common.stored(narrow.mapInArrow(_signatures(Signer(count, rows), n), _SIGNED), "signed")
    least = F.min(F.struct("id", "th")).alias("rep")
    classes = signed.filter("n > 0").groupBy("h1", "h2").agg(least, F.count("*").alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = common.stored(classes.select("h1", "h2", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"), "size", "n", "keys"), "classes")

    banded = classes.select("h1", "h2", "n", F.posexplode("keys").alias("j", "key"))
    kept = distinct_buckets(banded, "n", BLOCK_ROWS, BLOCK_SHINGLES)
    listed = banded.join(kept, "key").groupBy("h1", "h2").agg(F.collect_list(F.struct("j", "key", "blocks")).alias("buckets"))
    listed = listed.join(classes.select("h1", "h2", "rep", "rep_th", "size"), ["h1", "h2"])
    found = narrow.join(listed, (F.col("id") == F.col("rep")) & (F.col("th") == F.col("rep_th"))).select("text", "h1", "h2", "size", "buckets")
    members = found.mapInArrow(_members(n), "key long, bi int, bj int, h1 long, h2 long, block int, size long, buckets binary, shingles binary")
    dealt = members.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    links = common.stored(dealt.mapInArrow(_links(similarity), "a1 long, a2 long, b1 long, b2 long, n long"), "verified", narrow=True)

    amounts = links.filter("b1 is null").groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("n").alias("links"))
    edges = links.filter("b1 is not null").select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b"))
    parts = components(edges).select("node.h1", "node.h2", F.struct("component.h1", "component.h2").alias("root"))
    grouped = classes.select("h1", "h2", "rep").join(parts, ["h1", "h2"])
    least = common.stored(grouped.groupBy("root").agg(F.min("rep").alias("class_id")), "least", narrow=True)
    reach = grouped.join(least, "root").select("h1", "h2", "class_id")
    out = classes.drop("keys", "n").join(amounts, ["h1", "h2"], "left").join(reach, ["h1", "h2"], "left")
    out = out.select("h1", "h2", "rep", "rep_th", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("class_id", "rep").alias("class_id"))
    return Join(signed.select("id", "th", "h1", "h2"), common.stored(out, "reach", narrow=True))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id that links reach), n_links (other rows linked directly), kept."""
    j = join(docs, **options)
    # Only classes of more than one row or with links say something new; a null fingerprint finds none.
    told = j.classes.filter("size > 1 or links > 0").select("h1", "h2", "class_id", "links")
    doc = F.when(F.col("id") != NO_ID, F.col("id"))
    joined = j.texts.join(told, ["h1", "h2"], "left").select(doc.alias("doc_id"), F.when(F.col("class_id").isNull() | (F.col("class_id") == NO_ID), doc).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns as they are, that stay: of each group of linked ones the row with the smallest id.

    Of repeated rows (equal id and text) one stays, that with the smallest hash of its columns; maps don't count for it.
    """
    j = join(docs, id_col, text_col, **options)
    told = j.classes.filter("size > 1 or links > 0").select("h1", "h2", "rep", "rep_th", (F.col("rep") == F.col("class_id")).alias("first"))
    stays = F.col("first") & (F.col("id") == F.col("rep")) & (F.col("th") == F.col("rep_th"))
    verdict = j.texts.join(told, ["h1", "h2"]).groupBy(F.col("id").alias("_lp_id"), F.col("th").alias("_lp_th")).agg(F.max(stays).alias("_lp_stays"), F.count("*").alias("_lp_n"))
    # Rows that go, and those that stay once but are there several times.
    verdict = common.stored(verdict.filter("not _lp_stays or _lp_n > 1"), "verdict", narrow=True)
    keyed = docs.withColumns({"_lp_i": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_lp_h": common.row_hash(common.text_of(docs, text_col))})
    on = (F.col("_lp_i") == F.col("_lp_id")) & (F.col("_lp_h") == F.col("_lp_th"))
    out = keyed.join(verdict, on, "left_anti").select(*docs.columns)
    again = verdict.filter("_lp_stays")
    if again.isEmpty():
        return out
    names = [f"c{i}" for i in range(len(docs.columns))]
    hashed = F.xxhash64(*(F.col(c) for c, t in docs.dtypes if "map<" not in t))
    repeated = keyed.join(again, on, "left_semi").groupBy("_lp_i", "_lp_h").agg(F.min_by(F.struct(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True))), hashed).alias("r"))
    return out.unionByName(repeated.select(*(F.col(f"r.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True))))
