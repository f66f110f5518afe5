"""Mixing sources to target weights (operator 6).

Sizes count the words of each text. A source's documents are put in an order drawn by hash and cut into blocks; an
epoch is all blocks once. A source takes whole epochs and then the blocks at the front of its order until the target
is met, so what it takes differs from the target by less than a document. The blocks taken are shared out among output
shards by a splitting tree: each node halves its shards and draws how many of each source's blocks go left from the
multivariate hypergeometric distribution, so that the quotas of all leaves add up exactly. Each shard draws a range of
its own of each source's permuted blocks, and its documents are put in an order by a random key. All draws come from the seed and
the node, none from the layout of the data, so reruns agree. amounts() tells the shards and keys of every document; mix() returns
the documents of a shard together and in its order.

Targets and shares are computed in the plan, for any number of sources. The driver holds the tree's numbers only, at most MAX_QUOTAS of them: by shard and
source, or, beyond UNITS sources, by shard and one of so many groups of them. The blocks of a group are permuted together and cut into the shards'
ranges, which splits each shard's quota among the group's sources by the same distribution. Blocks have about BLOCK_DOCS documents, so a source with
a third of all rows is many blocks and many tasks.

Defined results: a null text has size 0 and is taken 0 times; null is a source of its own and the last one; a source
without words gets target 0. Repeated rows (equal id, text and source) are documents of their own that lie side by side: they are
counted, and a cut among them takes so many of them, which differ in nothing that the mix knows (if other columns differ, which of them
go is not defined). An empty table gives an empty result. Columns of docs that clash with names used here are left alone by mix().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonepoint.llm import common
from lonepoint.sources.points import ranked

WEIGHTS, MOST = (5, 2, 1), 3
SEED, BLOCK_DOCS, SHARD_WORDS, MAX_QUOTAS, UNITS = 20240229, 512, 1 << 21, 1 << 20, 1024
#: Rows that a table by source or shard may have to be broadcast; copies of a repeated row that one row of a plan turns into.
SMALL, CHUNK = 10_000, 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, size and others) with sid, its number from 0 in the order of code points, null last, and target: shares of all sizes by weight; a
    target stops at so many times its source's size, and the excess is reshared by weight.

    Resharing ends at one share for each unit of weight that all sources get that aren't full with it. The driver gets three sums a round.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    known = ranked(sources, F.col("source").asc_nulls_last(), name="rank").withColumn("sid", (F.col("rank") - 1).cast("int")).drop("rank")
    known = common.stored(known.withColumn("weight", weight.cast("double")), "sources", narrow=True)
    full = F.lit(float(most)) * F.col("size")
    total, share = None, -1.0
    while True:
        r = known.agg(F.sum("size").alias("all_"), F.sum(F.when(full < F.lit(share) * F.col("weight"), full).otherwise(0.0)).alias("used"), F.sum(F.when(full < F.lit(share) * F.col("weight"), 0.0).otherwise(F.col("weight"))).alias("left")).head()
        total = float(r["all_"] or 0)
        now = (total - r.used) / r.left if r.left else share
        if now <= share:
            return known.withColumn("target", F.least(full, F.lit(max(share, 0.0)) * F.col("weight"))).drop("weight")
        share = now


def splitting_tree(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """How many of each source's blocks each shard gets: shards x sources, the columns adding up to counts."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid, total = (low + high) // 2, int(have.sum())
        left = total * (mid - low) // (high - low)
        got = _draw(np.random.default_rng([seed, low, high]), have, left)
        todo += [(low, mid, got), (mid, high, have - got)]
    return out


def _draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric by its marginals. Above the generator's limit of 10^9, both counts of a marginal are scaled."""
    got, rest = np.zeros_like(have), int(have.sum())
    for i, h in enumerate(have.tolist()):
        rest -= h
        if n <= 0:
            break
        if rest <= 0:
            x = min(h, n)
        else:
            scale = max(1.0, (h + rest) / 9e8)
            x = int(rng.hypergeometric(int(h / scale), max(1, int(rest / scale)), min(int(n / scale), int(h / scale) + int(rest / scale))) * scale)
            x = max(n - rest, min(x, h, n))
        got[i], n = x, n - x
    return got


_SIZES = "k0 long, k1 string, th long, size long, n long"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by row, repeated rows of a batch as one with their number. bytes.split() cuts at the six characters of [\\x20\\x09-\\x0D] and no others."""
    for batch in batches:
        rows: dict[tuple, list[int]] = {}
        for *key, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            if (known := rows.get(k := tuple(key))) is not None:
                known[1] += 1
            else:
                rows[k] = [len(x.split()) if x else 0, 1]
        columns = [list(c) for c in zip(*((*k, *v) for k, v in rows.items()), strict=True)] or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["k0", "k1", "th", "size", "n"])


class Mix:
    """rows: k0 (id), k1 (source), th (hash of the text), size, n (rows that are equal in these), sid (the source's number), block and takes, a list
    of (epoch, shard, t): so many of the n are taken for this shard. totals: sid, source_size, target. shards: their number."""

    def __init__(self, rows: DataFrame, totals: DataFrame, shards: int, seed: int):
        self.rows, self.totals, self.shards, self.seed = rows, totals, shards, seed

    def key(self, shard: Column, epoch: Column) -> Column:
        """The order within a shard."""
        return F.xxhash64(F.lit(self.seed + 2), shard, "k0", "th", epoch)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if it has few rows; else Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= SMALL else df


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shard_words: int = SHARD_WORDS) -> Mix:
    spark = docs.sparkSession
    common.prepare(spark)
    text = common.text_of(docs, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("k0"), F.col(source_col).cast("string").alias("k1"), common.row_hash(text).alias("th"), text.alias("text"))
    sized = common.stored(narrow.mapInArrow(_count, _SIZES), "sizes")
    by_source = sized.groupBy(F.col("k1").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    sources = common.stored(targets(by_source, weights, most), "targets", narrow=True)
    many, total = sources.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()

    # The order within a source: by a hash of the row, cut into blocks of equal ranges of it.
    counts = sources.select(F.col("source").alias("s"), "sid", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_DOCS)).alias("blocks"))
    order = F.xxhash64(F.lit(seed), "k0", "th")
    # 31 bits of the hash, scaled: block = floor(bits * blocks / 2^31).
    block = F.floor(F.shiftrightunsigned(order, 33) * F.col("blocks") / F.lit(float(1 << 31))).cast("long")
    placed = sized.join(_small(counts, many), F.col("k1").eqNullSafe(F.col("s"))).select("k0", "k1", "th", "size", "n", "sid", order.alias("o"), block.alias("block"))
    blocks = placed.groupBy("sid", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    # The running sum over blocks, with a row for each block of up to BLOCK_DOCS documents, in two levels of up to 1024 blocks.
    inner = Window.partitionBy("sid", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("sid").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("g", F.floor(F.col("block") / 1024))
    bases = blocks.groupBy("sid", "g").agg(F.sum("words").alias("all_words")).withColumn("base", F.coalesce(F.sum("all_words").over(outer), F.lit(0))).drop("all_words")
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    first = common.stored(blocks.join(bases, ["sid", "g"]).select("sid", "block", "words", (F.col("inside") + F.col("base")).alias("begin")), "blocks", narrow=True)

    # A source's blocks that each epoch takes, whole or in part.
    cut = F.least(F.col("size").cast("double"), F.col("target") - F.col("epoch") * F.col("size"))
    wanted = sources.withColumn("epoch", F.explode(F.array(*map(F.lit, range(most))))).select("sid", "epoch", cut.alias("cut")).filter("cut > 0")
    unit = F.col("sid") if many <= UNITS else F.pmod("sid", F.lit(UNITS))
    draws = first.filter("words > 0").join(_small(wanted, most * many), "sid").filter("begin < cut").select("sid", unit.alias("unit"), "block", "epoch", "cut")
    have = {r.unit: r.n for r in draws.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    units = sorted(have)
    shards = 1
    while shards * shard_words < total and shards * 2 * max(1, len(units)) <= MAX_QUOTAS:
        shards *= 2
    quota = splitting_tree([have[u] for u in units], shards, seed)
    # Block instances by rank in an order of their own: a random permutation that shards cut into disjoint ranges. A range is listed under
    # the stretches of ranks that it lies in, so that the join finds it by equality.
    ends, ranges, step = quota.cumsum(0), [], {}
    for k, u in enumerate(units):
        step[u] = max(1, have[u] // shards)
        for i in np.flatnonzero(quota[:, k]).tolist():
            low, high = int(ends[i, k] - quota[i, k]), int(ends[i, k])
            ranges += [(u, stretch, i, low, high) for stretch in range(low // step[u], (high - 1) // step[u] + 1)]
    table = spark.createDataFrame(ranges or [(-1, 0, 0, 0, 0)], "unit int, stretch long, shard int, low long, high long")
    steps = spark.createDataFrame(list(step.items()) or [(-1, 1)], "unit int, step long")
    ranked_ = _ranks(draws.withColumn("r", F.xxhash64(F.lit(seed + 1), "sid", "block", "epoch")))
    ranked_ = ranked_.join(F.broadcast(steps), "unit").withColumn("stretch", F.floor(F.col("rank") / F.col("step")))
    drawn = ranked_.join(_small(table, len(ranges)), ["unit", "stretch"]).filter("rank >= low and rank < high")
    # A block's epochs, at most `most` of them.
    drawn = drawn.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "cut"))).alias("cuts"))
    cuts = common.stored(first.join(drawn, ["sid", "block"], "left").select("sid", "block", "begin", "cuts"), "cuts", narrow=True)

    # Rows that are equal share a block, so that one dealing by block serves grouping, running sums and the join.
    same = placed.repartition("sid", "block").groupBy("sid", "block", "o", "k0", "k1", "th", "size").agg(F.sum("n").alias("n"))
    local = Window.partitionBy("sid", "block").orderBy("o", "k0", "th").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(local), F.lit(0)))
    start = F.col("begin") + F.col("before")
    # The c-th of equal rows begins at start + c * size, and is taken where its middle lies before the cut.
    t = lambda cut: F.greatest(F.lit(0), F.least(F.col("n"), F.floor((2 * cut - 2 * start + F.col("size")) / (2 * F.col("size"))).cast("long")))
    takes = F.filter(F.transform(F.coalesce("cuts", F.array()), lambda c: F.struct(c["epoch"].alias("epoch"), c["shard"].alias("shard"), t(c["cut"]).alias("t"))), lambda x: x["t"] > 0)
    none = F.array().cast("array<struct<epoch:int,shard:int,t:bigint>>")
    rows = same.join(cuts, ["sid", "block"]).select("k0", "k1", "th", "size", "n", "sid", "block", F.when(F.col("size") > 0, takes).otherwise(none).alias("takes"))
    totals = sources.select("sid", F.col("size").alias("source_size"), "target")
    return Mix(common.stored(rows, "rows"), _small(totals, many), shards, seed)


def _ranks(instances: DataFrame) -> DataFrame:
    """rank: the place in its unit by r, from 0; first by 1024 ranges of r, then within each, so that no source is one task."""
    x = instances.withColumn("part", F.shiftrightunsigned("r", 54))
    counts = x.groupBy("unit", "part").agg(F.count("*").alias("n"))
    before = counts.select("unit", "part", F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("unit", "part").orderBy("r", "sid", "block", "epoch")) - 1
    return x.withColumn("inside", inside).join(before, ["unit", "part"]).withColumn("rank", F.col("inside") + F.col("before"))


def amounts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, the number of times it is taken, and for each time the
    shard and the key that orders it there."""
    m = plan_mix(docs, **options)
    rows = m.rows.join(m.totals, "sid")
    # A row that is repeated very often is several rows first, dealt to as many tasks.
    many = rows.filter(F.col("n") > CHUNK).withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK)))).repartition("k0", "th", "c")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("n"), (F.col("c") + 1) * CHUNK) - 1))).drop("c")
    few = rows.filter(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = few.unionByName(many).withColumn("own", F.filter("takes", lambda x: x["t"] > F.col("copy")))
    times = F.size("own")
    return each.select(
        F.col("k0").alias("doc_id"), "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"),
        F.transform("own", lambda x: x["shard"]).alias("shards"), F.transform("own", lambda x: m.key(x["shard"], x["epoch"])).alias("order_keys"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: bool = False, **options) -> DataFrame:
    """The mixed rows with the columns of docs, each as often as it is taken; the rows of a shard lie together, in the order of their keys.
    shards adds _lp_shard and _lp_key."""
    m = plan_mix(docs, id_col, source_col, text_col, **options)
    takes = F.transform("takes", lambda x: F.struct(x["shard"].alias("shard"), m.key(x["shard"], x["epoch"]).alias("key"), x["t"].alias("t")))
    some = m.rows.filter(F.size("takes") > 0).select(F.col("k0").alias("_lp_id"), F.col("k1").alias("_lp_source"), F.col("th").alias("_lp_th"), F.col("n").alias("_lp_n"), takes.alias("_lp_takes"))
    keyed = docs.withColumns({"_lp_i": F.col(id_col).cast("long"), "_lp_h": common.row_hash(common.text_of(docs, text_col)), "_lp_s": F.col(source_col).cast("string")})
    on = F.col("_lp_i").eqNullSafe(F.col("_lp_id")) & (F.col("_lp_h") == F.col("_lp_th")) & F.col("_lp_s").eqNullSafe(F.col("_lp_source"))

    def taken(chosen: DataFrame) -> DataFrame:
        return keyed.join(chosen, on).withColumn("_lp_x", F.explode("_lp_takes"))

    out = taken(some).filter(F.col("_lp_x.t") == F.col("_lp_n"))
    # Of at most one repeated row of each source the cut takes some only.
    cut = some.filter(F.exists("_lp_takes", lambda x: x["t"] < F.col("_lp_n")))
    if not cut.isEmpty():
        out = out.unionByName(_first_of(taken(cut).filter(F.col("_lp_x.t") < F.col("_lp_n"))))
    out = out.withColumns({"_lp_shard": F.col("_lp_x.shard"), "_lp_key": F.col("_lp_x.key"), "_lp_piece": F.shiftrightunsigned("_lp_x.key", 60)})
    out = out.select(*docs.columns, "_lp_shard", "_lp_key", "_lp_piece")
    # A shard's rows come together in sixteenths of its order; where one of these is large, as of a repeated row, it is split.
    out = out.hint("rebalance", F.col("_lp_shard"), F.col("_lp_piece")).sortWithinPartitions("_lp_shard", "_lp_key")
    return out.select(*docs.columns, *(["_lp_shard", "_lp_key"] if shards else []))


def _first_of(rows: DataFrame) -> DataFrame:
    """Of the rows taken for one key and source the first _lp_x.t, by numbers dealt to 1024 parts, so that no key is one task."""
    held = common.stored(rows.withColumn("_lp_m", F.monotonically_increasing_id()), "cut")
    key = ["_lp_g", "_lp_s"]
    held = held.withColumns({"_lp_g": F.col("_lp_x.key"), "_lp_p": F.pmod(F.xxhash64("_lp_m"), F.lit(1024))})
    counts = held.groupBy(*key, "_lp_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("_lp_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"{c}2") for c in (*key, "_lp_p")), before.alias("_lp_b"))
    inside = F.row_number().over(Window.partitionBy(*key, "_lp_p").orderBy("_lp_m"))
    on = (F.col("_lp_g") == F.col("_lp_g2")) & F.col("_lp_s").eqNullSafe(F.col("_lp_s2")) & (F.col("_lp_p") == F.col("_lp_p2"))
    return held.withColumn("_lp_r", inside).join(counts, on).filter(F.col("_lp_r") + F.col("_lp_b") <= F.col("_lp_x.t")).select(*rows.columns)
