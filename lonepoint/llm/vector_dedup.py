"""Embedding near-dedup by a robust-pruned flat graph (operator 10).

Vectors are compared only under equal labels. Equal vectors are one point with a number of members. Each label's points are dealt
to cells around centres from a bounded sample, each point to that of its nearest centre; a cell of more than twice SHARD points
is several blocks, by hash. A block builds its graph: each point is linked to the neighbours that robust pruning leaves of
its nearest CANDIDATES, both ways. A range-expanding greedy search for each of its points starts at the block's medoids and at
the point's own links, walks the graph to the query's region with a beam and then grows over all neighbours that are within the
range or near it.

Links between blocks are found without a graph: a point also goes to each pair of its block and another one whose cell can hold
a vector within the threshold of it. That is so unless the point lies farther than the threshold's angle from the plane between
the two centres, so no link is lost, however dense a group is and however many centres it has. A pair of blocks is a task of
bounded memory, which compares all that it got of one with all of the other. Vectors without clusters lie near most of these
planes, and then the pairs of blocks are nearly all there are: the price is quadratic in a label.

What is found is verified by cosine in double precision. A pair of points is in one pair of blocks only, so it counts once. Tasks
hand on counts and a spanning forest, never the pairs. Centres are made in tasks, those of all labels in one job. audit() measures recall against brute force for stated queries (ids
divisible by 100) over all rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing. Vectors of different dimensions under one label link with nothing of another dimension. Repeated ids are rows
of their own: copies of a vector link with each other. Null ids (and the largest long) are members, but never the smallest id unless all are.
Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common
from lonepoint.llm.graph import components, groups

THRESHOLD = 0.93
#: Points of a block, about; nearest points that pruning chooses from; links it leaves; its slack; beam of the greedy walk and points it walks from at once; medoids.
SHARD, CANDIDATES, DEGREE, ALPHA, BEAM, STEP, MEDOIDS = 1500, 40, 24, 1.15, 16, 6, 8
#: Below the threshold by this much, a point still carries the search on.
SLACK = 0.12
#: Vectors of a label from which its centres are taken, at most, and centres of a label, at most: cells with more points are several blocks. Bytes
#: of centres that one pass over the points broadcasts, at most; labels whose centres take more go over their points in passes of their own.
CENTRE_SAMPLE, MOST_CENTRES, CENTRE_BYTES, MOST_PARTS, SEED = 1 << 15, 4096, 32 << 20, 20_000, 11
#: Rows that dealing points to pairs of blocks makes at once; cosines nearer to the threshold than this are computed again from the vectors as they are.
DEALT_ROWS, UNSURE = 50_000, 1e-9
NO_ID = (1 << 63) - 1


def _unit(vectors: list, dims: int) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(-1, dims)
    # Scaled first, so that squares neither vanish nor overflow.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(raw: Iterable[bytes], dims: int) -> list[np.ndarray]:
    """Vectors from their bytes, of floats where these say all, else of doubles."""
    return [np.frombuffer(v, np.float64 if len(v) == 8 * dims else np.float32).astype(np.float64) for v in raw]


def _usable(vector) -> bool:
    return vector is not None and len(vector) > 0 and all(v is not None for v in vector) and bool(np.isfinite(v := np.asarray(vector, float)).all()) and bool((v != 0).any())


_POINTS = "id long, label string, d int, usable boolean, h1 long, h2 long, v binary"


def _points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their vector as bytes (see _vectors), and 128 bits of the hash of label and vector; without these where it can't link."""
    import hashlib

    for batch in batches:
        ids, vectors, labels = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for i, v, label in zip(ids, vectors, labels, strict=True):
            if label is None or not _usable(v):
                rows.append((i, label, None, False, None, None, None))
                continue
            x = np.asarray(v, np.float64) + 0.0  # -0.0 is 0.0
            raw = x.tobytes()
            digest = hashlib.blake2b(f"{label}\0".encode() + raw, digest_size=16).digest()
            h1, h2 = np.frombuffer(digest, np.int64).tolist()
            with np.errstate(over="ignore", under="ignore"):
                short = x.astype(np.float32)
            rows.append((i, label, len(v), True, h1, h2, short.tobytes() if (short == x).all() else raw))
        types = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        names = ["id", "label", "d", "usable", "h1", "h2", "v"]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def centres_of(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 6) -> np.ndarray:
    """k-means on the sphere from spread-out starts; equal points give fewer centres."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def _nearest(x: np.ndarray, part: np.ndarray, most: int) -> np.ndarray:
    """For each point its nearest ones of a part, itself perhaps among them, in no order."""
    m = min(most, len(part))
    out = np.empty((len(x), m), np.int64)
    for i in range(0, len(x), 512):
        out[i : i + 512] = part[np.argpartition(-(x[i : i + 512] @ x[part].T), m - 1, axis=1)[:, :m]]
    return out


def _pruned(x: np.ndarray, rows: np.ndarray, these: np.ndarray, degree: int, alpha: float) -> list[list[int]]:
    """What robust pruning leaves of each row's candidates, at most `degree`, the nearest first. A point's own place and repeats are no candidates."""
    out: list[list[int]] = []
    for i in range(0, len(rows), 128):
        row, near = rows[i : i + 128], these[i : i + 128]
        own = 2 - 2 * np.einsum("bd,bmd->bm", x[row], x[near])
        own[near == row[:, None]] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        points = x[near]
        between = alpha * (2 - 2 * (points @ points.transpose(0, 2, 1)))
        alive, keep, count = np.isfinite(own), np.zeros(own.shape, bool), np.zeros(len(row), np.int64)
        for j in range(near.shape[1]):
            chosen = alive[:, j] & (count < degree)
            keep[:, j] = chosen
            count += chosen
            alive &= ~(chosen[:, None] & (between[:, j] <= own))
        out += [n[k].tolist() for n, k in zip(near, keep, strict=True)]
    return out


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[list[int]]:
    """For each point the neighbours left of its nearest candidates: a candidate goes if one already chosen is nearer to it, by the
    slack, than the point is; then links both ways, pruned again where they are too many. Distances are squared chords."""
    n = len(x)
    if n < 2:
        return [[] for _ in range(n)]
    rows = np.arange(n)
    near = _pruned(x, rows, _nearest(x, rows, candidates + 1), degree - degree // 4, alpha)
    # And of ever smaller random parts: the nearest points of a dense group are all its own, and only the sparser parts lead out of
    # it and into it.
    order = np.random.default_rng(SEED).permutation(n)
    sparse = [_nearest(x, np.sort(order[: n // k]), most) for k, most in ((4, candidates // 4), (16, candidates // 8), (64, candidates // 8)) if n // k >= 2 and most]
    wide = _pruned(x, rows, np.concatenate(sparse, axis=1), degree // 3, alpha) if sparse else near
    out = [list(dict.fromkeys(a + b)) for a, b in zip(near, wide, strict=True)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, links in enumerate(out):
        for j in links:
            back[j].append(i)
    for i in range(n):
        both = list(dict.fromkeys(out[i] + back[i]))
        out[i] = both if len(both) <= 2 * degree else list(dict.fromkeys(_pruned(x, rows[i : i + 1], np.array([both]), degree, alpha)[0] + back[i][:degree]))
    return out


def padded(links: list) -> np.ndarray:
    """Adjacency lists as rows of one length, filled up with the point itself."""
    width = max((len(v) for v in links), default=0)
    out = np.repeat(np.arange(len(links))[:, None], max(1, width), axis=1)
    for i, v in enumerate(links):
        out[i, : len(v)] = v
    return out


def range_search(x: np.ndarray, links: np.ndarray, starts: np.ndarray, query: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """The points within the threshold of the query that the search meets. links: padded adjacency lists."""
    seen, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
    seen[starts] = True
    score = x[starts] @ query
    found = [starts[score >= threshold]]
    wide = starts[score >= threshold - slack]
    pool, values = starts, score
    while True:
        # Walk on from the best of the beam that weren't walked from yet, several at once; within the range or near it everything is
        # walked from, beyond the beam.
        order = np.argsort(-values, kind="stable")[:beam]
        pool, values = pool[order], values[order]
        todo = np.concatenate([pool[~done[pool]][:STEP], wide])
        todo = todo[~done[todo]]
        if not len(todo):
            break
        done[todo] = True
        new = links[todo].ravel()
        new = new[~seen[new]]
        seen[new] = True
        new = np.unique(new)
        score = x[new] @ query
        found.append(new[score >= threshold])
        wide = new[score >= threshold - slack]
        pool, values = np.concatenate([pool, new]), np.concatenate([values, score])
    return np.concatenate(found)


def medoids(x: np.ndarray, k: int = MEDOIDS, seed: int = SEED) -> np.ndarray:
    """The points nearest to the centre of all and to the centres of k parts."""
    middle = x.mean(0, keepdims=True)
    return np.unique(np.concatenate([(x @ middle.T).argmax(0), (x @ centres_of(x, k, seed, 2).T).argmax(0)]))


class Blocks:
    """Centres by label and dimension with the number of blocks of each one's cell; deals vectors to pairs of blocks."""

    def __init__(self, centres: dict[tuple[str, int], np.ndarray], threshold: float):
        self.centres, self.sin = centres, np.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else np.inf
        self.several: dict[tuple[str, int], np.ndarray] = {k: np.ones(len(c), np.int64) for k, c in centres.items()}

    def cells(self, label: str, d: int, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        c = self.centres[label, d]
        return np.concatenate([(x[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(x), 1024)])

    def of(self, label: str, d: int, x: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, their own block, and a block that may hold something within the threshold of them; each row with its own block as well."""
        c = self.centres.get((label, d))
        if c is None:
            yield np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            return
        several = self.several[label, d]
        first, cell_of = np.cumsum(several) - several, np.repeat(np.arange(len(c)), several)
        step = max(1, min(1024, DEALT_ROWS // len(cell_of)))
        for i in range(0, len(x), step):
            score = x[i : i + step] @ c.T
            cell = score.argmax(1)
            # How far the point lies from the plane between its centre and each other one, times the distance of these.
            above = score.max(1)[:, None] - score
            apart = np.sqrt(np.maximum(0.0, ((c * c).sum(1)[cell][:, None] + (c * c).sum(1)[None] - 2 * c[cell] @ c.T)))
            reached = above <= self.sin * apart + 1e-6 if np.isfinite(self.sin) else np.ones(above.shape, bool)
            row, block = np.nonzero(reached[:, cell_of])
            own = first[cell] + h[i : i + step] % several[cell]
            yield row + i, own[row], block


def _dealt(blocks, names: list[str]):
    """Points with a row for each pair of blocks: s1 and s2 are the pair, the smaller first, own is the point's own block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = blocks.value
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(names)}
            v, h1 = cols["v"].to_pylist(), cols["h1"].to_numpy()
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(cols["label"].to_pylist(), cols["d"].to_pylist(), strict=True)):
                by.setdefault(key, []).append(i)
            for (label, d), at in by.items():
                here = np.array(at)
                for row, own, block in table.of(label, d, _unit(_vectors([v[i] for i in at], d), d), h1[here] >> 8 & 0xFFFFFFFF):
                    taken = pa.array(here[row])
                    pair = [pa.array(x) for x in (np.minimum(own, block), np.maximum(own, block), own)]
                    columns = [cols["label"].take(taken), cols["d"].take(taken), *pair, *(cols[n].take(taken) for n in ("h1", "h2", "size", "v"))]
                    yield pa.record_batch(columns, names=["label", "d", "s1", "s2", "own", "h1", "h2", "size", "v"])

    return run


def _searched(x: np.ndarray, threshold: float) -> np.ndarray:
    """Which points of a block the graph's search links."""
    links, starts = padded(robust_prune(x)), medoids(x)
    hits = np.zeros((len(x), len(x)), bool)
    for i in range(len(x)):
        hits[i, range_search(x, links, np.union1d(starts, [i]), x[i], threshold - UNSURE)] = True
    np.fill_diagonal(hits, False)
    return hits | hits.T


def _compared(x: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """Which points of two blocks are linked to one of the other block."""
    a, b = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    hits = np.zeros((len(x), len(x)), bool)
    for i in range(0, len(a) if len(b) else 0, 512):
        hits[np.ix_(a[i : i + 512], b)] = x[a[i : i + 512]] @ x[b].T >= threshold - UNSURE
    return hits | hits.T


def _links(group: list[tuple], threshold: float) -> Iterator[tuple]:
    """Counts and a spanning forest of the links within a block, or between two."""
    group = sorted({r[5:7]: r for r in group}.values(), key=lambda r: r[5:7])
    (label, d, s1, s2), n = group[0][:4], len(group)
    if n < 2:
        return
    vectors = _vectors([r[8] for r in group], d)
    x = _unit(vectors, d)
    hits = _searched(x, threshold) if s1 == s2 else _compared(x, np.array([r[4] for r in group], np.int64), threshold)
    for i in np.flatnonzero(hits.any(1)).tolist():
        near = i + 1 + np.flatnonzero(hits[i, i + 1 :])
        unsure = near[x[near] @ x[i] < threshold + UNSURE]
        if len(unsure):
            wrong = unsure[_cosines(vectors, i, unsure) < threshold]
            hits[i, wrong] = hits[wrong, i] = False
    sizes = np.array([r[7] for r in group], np.float64)
    total = np.concatenate([hits[i : i + 512] @ sizes for i in range(0, n, 512)])
    seen = np.zeros(n, bool)
    for i in np.flatnonzero(total).tolist():
        if not seen[i]:  # each of a group is linked to its first, which is the smallest
            seen[i] = True
            todo = [i]
            while todo:
                near = hits[todo.pop()] & ~seen
                seen |= near
                for j in np.flatnonzero(near).tolist():
                    yield (*group[j][5:7], *group[i][5:7], 0)
                    todo.append(j)
        yield (*group[i][5:7], None, None, int(total[i]))


def _cosines(vectors: list[np.ndarray], i: int, near: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the vectors as they are: sums of products in order of components, over the root of the squares."""
    a, b = vectors[i], np.array([vectors[j] for j in near.tolist()])
    dot, aa, bb = ((p.cumsum(1)[:, -1]) for p in (b * a, (a * a)[None], b * b))
    with np.errstate(all="ignore"):
        out = dot / (np.sqrt(aa) * np.sqrt(bb))
    odd = ~np.isfinite(out) | (aa[0] < 1e-290) | (bb < 1e-290)
    if odd.any():  # components so large or small that squares overflow or vanish
        out[odd] = _unit(b[odd], b.shape[1]) @ _unit(a[None], b.shape[1])[0]
    return out


class Linked:
    def __init__(self, rows: DataFrame, points: DataFrame):
        self.rows, self.points = rows, points


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> Linked:
    """rows: id, h1 and h2 by row of vectors; points: h1, h2, size, links, component_id by different vector that has copies or links."""
    spark = vectors.sparkSession
    common.prepare(spark)
    inner = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = common.stored(inner.mapInArrow(_points, _POINTS), "rows")
    points = rows.filter("usable").groupBy("h1", "h2").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("d").alias("d"), F.first("v").alias("v"))
    points = common.stored(points, "points")
    links = reduce(DataFrame.unionAll, [_linked(some, blocks, threshold) for some, blocks in _passes(points, threshold)])
    amounts = links.filter("b1 is null").groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("n").alias("links"))
    edges = links.filter("b1 is not null").select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b"))
    parts = components(edges).select("node.h1", "node.h2", F.struct("component.h1", "component.h2").alias("root"))
    reach = points.select("h1", "h2", "rep").join(parts, ["h1", "h2"])
    least = common.stored(reach.groupBy("root").agg(F.min("rep").alias("component_id")), "least", narrow=True)
    reach = reach.join(least, "root").select("h1", "h2", "component_id")
    told = points.select("h1", "h2", "rep", "size").join(amounts, ["h1", "h2"], "left").join(reach, ["h1", "h2"], "left")
    told = told.filter("size > 1 or links > 0").select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    return Linked(rows.select("id", "h1", "h2"), common.stored(told, "told", narrow=True))


def _linked(points: DataFrame, blocks: Blocks, threshold: float) -> DataFrame:
    """Counts and links (see _links) of the points of some labels."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(blocks)
    dealt = points.select("h1", "h2", "size", "label", "d", "v").mapInArrow(_dealt(shared, ["h1", "h2", "size", "label", "d", "v"]), "label string, d int, s1 long, s2 long, own long, h1 long, h2 long, size long, v binary")
    # Two partitions for each block: pairs of blocks are small in bytes and large in work, and would otherwise be put together.
    count = sum(int(v.sum()) for v in blocks.several.values()) + points.select("label", "d").distinct().count() - len(blocks.several)
    parts = max(1, min(MOST_PARTS, 2 * count))
    grouped = dealt.repartition(parts, "label", "d", "s1", "s2").sortWithinPartitions("label", "d", "s1", "s2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            found = list(_links(group, threshold))
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["a1", "a2", "b1", "b2", "n"])

    return common.stored(grouped.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long, n long"), "links", narrow=True)


def _centres(points: DataFrame) -> DataFrame:
    """label, d, n (points) and c, the centres as bytes, of the labels that are more than one block: one job for all of them, each label's
    sample, at most CENTRE_SAMPLE points with the smallest hashes of a share of them, in one task. c is null where there is no sample."""
    big = points.groupBy("label", "d").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * SHARD)
    big = common.stored(big.withColumn("k", F.least(F.lit(MOST_CENTRES), F.ceil(F.col("n") / SHARD))), "big", narrow=True)
    most = F.least(F.lit(CENTRE_SAMPLE), 16 * F.col("k"))
    share = F.greatest(F.lit(1), F.floor(F.col("n") / (2 * most)))
    sample = points.join(big, ["label", "d"]).filter(F.pmod("h1", share) == 0).select("label", "d", "k", most.alias("most"), "h1", "h2", "v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            label, d, k, most = group[0][:4]
            c = centres_of(_unit(_vectors([r[6] for r in group[:most]], d), d), k)
            yield pa.record_batch([pa.array([label], pa.string()), pa.array([d], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["label", "d", "c"])

    ordered = sample.repartition("label", "d").sortWithinPartitions("label", "d", "h1", "h2")
    made = ordered.mapInArrow(run, "label string, d int, c binary")
    return common.stored(big.select("label", "d", "n").join(made, ["label", "d"], "left"), "centres", narrow=True)


def _passes(points: DataFrame, threshold: float) -> Iterator[tuple[DataFrame, Blocks]]:
    """The points by labels, so that the centres of a pass have at most CENTRE_BYTES (or are one label's), with the blocks of their cells. The
    first pass has all labels of one block. The driver gets a row for each label of several blocks, and the centres of one pass."""
    spark = points.sparkSession
    centres = _centres(points)
    sizes = centres.select("label", "d", F.coalesce(F.length("c"), F.lit(0)).alias("bytes")).collect()
    passes: list[list[tuple[str, int]]] = [[]]
    held = 0
    for r in sorted(sizes, key=lambda r: (r.label, r.d)):
        if held + r.bytes > CENTRE_BYTES and passes[-1]:
            passes.append([])
            held = 0
        passes[-1].append((r.label, r.d))
        held += r.bytes
    keys = [spark.createDataFrame(names, "label string, d int") for names in passes]
    for i, names in enumerate(keys):
        if i:
            some = points.join(names, ["label", "d"])
        else:
            some = points.join(reduce(DataFrame.unionAll, keys[1:]), ["label", "d"], "left_anti") if len(keys) > 1 else points
        rows = centres.join(names, ["label", "d"]).collect() if passes[i] else []
        yield some, _blocks(some, {(r.label, r.d): np.frombuffer(bytes(r.c)).reshape(-1, r.d) if r.c is not None else np.eye(1, r.d) for r in rows}, threshold)


def _blocks(points: DataFrame, centres: dict[tuple[str, int], np.ndarray], threshold: float) -> Blocks:
    """The blocks of the cells of these centres; the driver gets a count by cell."""
    blocks = Blocks(centres, threshold)
    if centres:
        shared = points.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                by: dict[tuple[str, int], list[bytes]] = {}
                for label, d, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (label, d) in shared.value.centres:
                        by.setdefault((label, d), []).append(v)
                for (label, d), raw in by.items():
                    cells = shared.value.cells(label, d, _unit(_vectors(raw, d), d))
                    found[label, d] = found.get((label, d), 0) + np.bincount(cells, minlength=len(shared.value.centres[label, d]))
            rows = [(label, d, c, n) for (label, d), v in found.items() for c, n in enumerate(v.tolist()) if n]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["label", "d", "cell", "n"])

        cells = points.select("label", "d", "v").mapInArrow(run, "label string, d int, cell long, n long")
        for r in cells.groupBy("label", "d", "cell").agg(F.sum("n").alias("n")).collect():
            blocks.several[r.label, r.d][r.cell] = -(-r.n // SHARD) if r.n > 2 * SHARD else 1
    return blocks


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id and kept."""
    x = link(vectors, id_col, **options)
    own = F.col("id")
    joined = x.rows.join(x.points, ["h1", "h2"], "left")
    component = F.when(F.col("component_id").isNull() | (F.col("component_id") == NO_ID), own).otherwise(F.col("component_id"))
    out = joined.select(own.alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, every: int = 100, block: int = 512) -> DataFrame:
    """Recall of links for the rows whose id is divisible by `every`, against all rows by brute force: queries, links, found, recall.

    Rows and queries meet in blocks of one label and dimension; only counts by query are shuffled after that.
    """
    inner = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = inner.mapInArrow(_points, _POINTS).filter("usable").select("id", "label", "d", "v")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def block_of(key: tuple[str, int]) -> pa.RecordBatch:
            some = held.pop(key)
            x = _unit(_vectors([v for _, v in some], key[1]), key[1])
            return pa.record_batch([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([[i for i, _ in some]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["label", "d", "ids", "x"])

        for batch in batches:
            for i, label, d, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((label, d), []).append((i, v))
                if len(held[label, d]) >= block:
                    yield block_of((label, d))
            # Many labels: not all of their beginnings at once.
            while len(held) > 64:
                yield block_of(next(iter(held)))
        for key in list(held):
            yield block_of(key)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, x, asked, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                close = np.frombuffer(q).reshape(-1, d) @ np.frombuffer(x).reshape(-1, d).T >= threshold
                yield pa.record_batch([pa.array(asked, pa.int64()), pa.array(close.sum(1))], names=["id", "n"])

    fields = "label string, d int, ids array<long>, x binary"
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).mapInArrow(pack, fields).select("label", "d", F.col("ids").alias("asked"), F.col("x").alias("q"))
    met = rows.mapInArrow(pack, fields).join(asked, ["label", "d"]).select("d", "x", "asked", "q")
    total = met.mapInArrow(compare, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    both = total.join(result.select(F.col("vec_id").alias("id"), "n_links"), "id")
    return both.agg(F.count("*").alias("queries"), F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found")).withColumn("recall", F.when(F.col("links") > 0, F.col("found") / F.col("links")))
