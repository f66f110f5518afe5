import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lonepoint.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares of all sizes by weight, resharing what is above so many times a source's size, round by round."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(sizes)
    rest, out, free = float(sum(size.values())), {}, list(size)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * size[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * size[s])
            free.remove(s)
        rest -= sum(out[s] for s in over)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_reshare_the_excess(spark, seed):
    rng = random.Random(seed)
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("d", 0), ("é", 3), ("Z", 7)] if not seed else [(f"s{rng.random()}", int(10 ** rng.uniform(0, 5))) for _ in range(40)]
    got = {r.source: (r.sid, r.target) for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    want = targets(sizes)
    assert all(abs(got[s][1] - want[s]) < 1e-6 * max(1, want[s]) for s, _ in sizes) and abs(sum(want.values()) - sum(n for _, n in sizes)) < 1e-6
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1][0])] == sorted(dict(sizes), key=lambda s: (s is None, s or ""))
    assert mixing.targets(spark.createDataFrame([("a", 0)], "source string, size long")).head().target == 0


def test_groups_of_many_sources(frame, monkeypatch):
    """More sources than the tree has columns: targets and amounts are the same, and shards get what the tree gave to the groups."""
    docs = [(i, "w " * (i % 23), f"s{i % 37}") for i in range(700)]
    plain = {(r.doc_id, r.target, r.times) for r in mixing.amounts(frame(docs), shard_words=500).collect()}
    monkeypatch.setattr(mixing, "UNITS", 5)
    got = mixing.amounts(frame(docs), shard_words=500).collect()
    assert {(r.doc_id, r.target, r.times) for r in got} == plain and len({s for r in got for s in r.shards}) > 8


def test_splitting_tree_is_exact():
    q = mixing.splitting_tree([1000, 3, 0, 50_000], 16)
    assert q.sum(0).tolist() == [1000, 3, 0, 50_000] and (q >= 0).all()
    assert np.ptp(q.sum(1)) <= 16
    assert (q == mixing.splitting_tree([1000, 3, 0, 50_000], 16)).all()
    assert mixing.splitting_tree([4 * 10**9, 10**9], 4).sum(0).tolist() == [4 * 10**9, 10**9]


def rows(n=1500):
    rng = random.Random(3)
    return [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)] + [(5000, None, "a"), (None, "x\x0by z\x1cq", "b")]


def test_amounts(frame, spark):
    docs = rows()
    got = mixing.amounts(frame(docs)).collect()
    assert len(got) == len(docs)
    size = {d: len([w for w in (t or "").replace("\x0b", " ").split(" ") if w]) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    per = Counter()
    for d in size:
        per[source[d]] += size[d]
    want = targets(list(per.items()))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == per[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken in [k * r["size"] for k in range(4)]
        taken[source[r.doc_id]] += r.taken
        assert len(r.shards) == len(r.order_keys) == r.times and r.taken == r.times * r["size"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in per)
    again = mixing.amounts(frame(docs).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_returns_what_amounts_says(frame):
    docs = rows(300)
    told = mixing.amounts(frame(docs), shard_words=700).collect()
    mixed = mixing.mix(frame(docs), shards=True, shard_words=700).collect()
    assert Counter((r.doc_id, r._lp_shard, r._lp_key) for r in mixed) == Counter((r.doc_id, s, k) for r in told for s, k in zip(r.shards, r.order_keys, strict=True))
    assert len({r._lp_shard for r in mixed}) > 4
    assert mixing.mix(frame(docs)).columns == frame(docs).columns


def test_the_rows_of_a_task_are_in_the_order_of_their_keys(frame):
    mixed = mixing.mix(frame(rows(300)), shards=True, shard_words=700).withColumn("p", F.spark_partition_id()).collect()
    by = {}
    for r in mixed:
        by.setdefault(r.p, []).append((r._lp_shard, r._lp_key))
    assert all(v == sorted(v) for v in by.values())


def test_repeated_rows_meet_the_target(frame):
    """1,000 rows alike are most of a source: as many of them as the target has room for."""
    docs = [(1, "w " * 10, "z")] * 1000 + [(i, "v " * 10, "y") for i in range(2, 50)] + [(60, None, None), (60, None, None)]
    told = mixing.amounts(frame(docs)).collect()
    assert len(told) == len(docs)
    taken = Counter()
    for r in told:
        taken[r.doc_id] += r.taken
    target = {r.doc_id: r.target for r in told}
    assert abs(taken[1] - target[1]) <= 10 and 0 < target[1] < 10_000 and max(r.times for r in told) <= 3
    mixed = Counter(r.doc_id for r in mixing.mix(frame(docs)).collect())
    assert mixed[1] * 10 == taken[1] and all(mixed[i] * 10 == taken[i] for i in range(2, 50)) and not mixed[60]


def test_rows_repeated_more_often_than_a_chunk(spark):
    docs = spark.range(20_000).selectExpr("if(id < 15000, 7, id) AS doc_id", "'one two' AS text", "'s' AS source")
    told = mixing.amounts(docs)
    assert told.count() == 20_000 and told.filter("doc_id = 7").count() == 15_000
    assert told.agg(F.sum("taken")).head()[0] == 40_000 and told.agg(F.max("times")).head()[0] == 1


def test_the_tree_decides_the_shards(frame, monkeypatch):
    """The blocks that a shard holds of a source are as many as the tree gave it, and another tree gives other shards."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    seen = []
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda counts, shards, seed=1: seen.append(real(counts, shards, seed)) or seen[-1])
    docs = rows(600)
    told = mixing.amounts(frame(docs), shard_words=1500).collect()
    quota = seen[-1]
    per = {}
    m = mixing.plan_mix(frame(docs), shard_words=1500)
    for r in m.rows.collect():
        for x in r.takes:
            per.setdefault((x.shard, r.sid), set()).add((x.epoch, r.block))
    assert quota.shape[0] > 4 and all(len(v) <= quota[k] for k, v in per.items())
    monkeypatch.setattr(mixing, "splitting_tree", lambda counts, shards, seed=1: np.concatenate([np.zeros((shards - 1, len(counts)), np.int64), np.array([counts])]))
    assert {s for r in mixing.amounts(frame(docs), shard_words=1500).collect() for s in r.shards} == {quota.shape[0] - 1}
    assert {s for r in told for s in r.shards} == set(np.flatnonzero(quota.sum(1)).tolist())


def test_sizes_and_targets_against_sql(frame):
    """The iterated resharing in SQL: a source is full once its share is above three times its size; as many rounds as there are sources."""
    docs = rows(200) + [(9000 + i, "w " * n, s) for i, (n, s) in enumerate([(1, "d"), (2, "e"), (900, "f"), (3, "g"), (1, "h")])]
    got = mixing.amounts(frame(docs)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    want = con.execute(TARGETS).fetchall()
    assert len(want) == len(got)
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(want, key=key), sorted(((r.doc_id, r["size"], r.source_size, r.target) for r in got), key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6


TARGETS = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
    SELECT source, sum(size) AS size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), r(round, source, size, w, full_) AS (
    SELECT 0, source, size, w, false FROM s
    UNION ALL
    SELECT round + 1, source, size, w, full_ OR w * ((SELECT sum(size) FROM s) - sum(CASE WHEN full_ THEN 3 * size ELSE 0 END) OVER ()) / greatest(1, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ()) > 3 * size
    FROM r WHERE round < (SELECT count(*) FROM s)
), t AS (
    SELECT source, size, CASE WHEN full_ THEN 3.0 * size ELSE w * ((SELECT sum(size) FROM s) - sum(CASE WHEN full_ THEN 3 * size ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target
    FROM r WHERE round = (SELECT count(*) FROM s)
)
SELECT doc_id, d.size, t.size AS source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def test_empty(frame):
    assert mixing.amounts(frame([])).count() == 0 and mixing.mix(frame([])).count() == 0
    got = mixing.amounts(frame([(1, None, None)])).collect()[0]
    assert got["size"] == got.taken == 0 and got.target == 0
