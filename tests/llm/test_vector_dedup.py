import math
import random

import numpy as np
import pytest

from lonepoint.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int, links int"


def brute(rows):
    def good(v):
        return v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in range(n)]
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = np.float64(np.float32(a)), np.float64(np.float32(b))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
                    near[i].append(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(near[i]), min(known) if known else None))
    return sorted(out, key=repr)


def corpus(seed, n=250, d=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        for _ in range(rng.choice([1, 1, 1, 3, 12])):
            rows.append((len(rows), (v + rng.normal(size=d) * 0.15).astype(np.float32).tolist(), int(i % 3)))
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * d, 1), (9003, [None] + [1.0] * (d - 1), 1), (9004, [math.nan] * d, 1), (9005, [math.inf] + [1.0] * (d - 1), 1)]
    rows += [(9006, rows[0][1], None), (9007, rows[0][1], 0), (None, rows[0][1], 0), (3, rows[3][1], 0), (9008, [1.0, 0.0], 0), (9009, [1e-30, 0.0], 0), (9010, [-0.0] * (d - 1) + [1.0], 2), (9011, [0.0] * (d - 1) + [2.0], 2)]
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1)
    random.Random(0).shuffle(rows)
    got = V.near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA).repartition(3))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr) == brute(rows)


def test_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 120)
    frame = spark.createDataFrame([(*r, 5) for r in corpus(2, 700, 24)], SCHEMA)
    rows = [r for r in corpus(2, 700, 24)]
    got = {r.vec_id: r.n_links for r in V.near_duplicates(frame).collect() if r.vec_id is not None and r.vec_id < 9000}
    want = {d: n for d, n, _ in brute(rows) if d is not None and d < 9000}
    found, total = sum(min(got[d], want[d]) for d in want), sum(want.values())
    assert all(got[d] <= want[d] for d in want) and found >= 0.9 * total


@pytest.mark.parametrize("group", [60, 300, 900])
def test_large_groups_of_near_copies_are_whole(spark, monkeypatch, group):
    """A dense group gets many centres; up to a third of a label, and one that hash blocks split as well."""
    monkeypatch.setattr(V, "SHARD", 60)
    rng = np.random.default_rng(group)
    base = rng.normal(size=24)
    near = 5 * base / np.linalg.norm(base) + rng.normal(size=(group, 24)) * 0.2
    x = np.concatenate([near, rng.normal(size=(2 * group, 24)), rng.normal(size=24) + rng.normal(size=(150, 24)) * 1e-3]).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert want[:group].mean() > 0.9 * group
    frame = spark.createDataFrame([(i, v.tolist(), 1, 5) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in V.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_every_link_has_its_pair_of_blocks():
    """Whichever centres two points share or not, both go to the pair of their own blocks, which is one."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(400, 16)), 3, axis=0) + rng.normal(size=(1200, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = V.Blocks({("a", 16): V.centres_of(x, 40)}, 0.93)
    blocks.several["a", 16][::7] = 3
    own, pairs = np.zeros(len(x), np.int64), [set() for _ in x]
    for row, mine, other in blocks.of("a", 16, x, np.arange(len(x))):
        own[row] = mine
        for i, a, b in zip(row.tolist(), mine.tolist(), other.tolist(), strict=True):
            pairs[i].add((min(a, b), max(a, b)))
    linked = np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()
    assert sum(own[i] != own[j] for i, j in linked) > 100
    for i, j in linked:
        assert (min(own[i], own[j]), max(own[i], own[j])) in pairs[i] & pairs[j]


def test_labels_in_passes_of_their_own(spark, monkeypatch):
    """Centres beyond the bound of a broadcast: every large label in a pass, small ones in the first."""
    monkeypatch.setattr(V, "SHARD", 40)
    monkeypatch.setattr(V, "CENTRE_BYTES", 1)
    rows = [(*r[:2], None if r[2] is None else r[2] if i % 9 else 7) for i, r in enumerate(corpus(5))]
    got = V.near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA).repartition(3))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("shard", [1500, 60])
def test_audit(spark, monkeypatch, shard):
    monkeypatch.setattr(V, "SHARD", shard)
    frame = spark.createDataFrame([(*r, 5) for r in corpus(3)], SCHEMA)
    r = V.audit(frame, V.near_duplicates(frame), every=3, block=40).head()
    assert 0.99 <= r.recall <= 1 and r.queries > 50


def test_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30])
def test_small_graphs_reach_all(n):
    x = np.random.default_rng(n).normal(size=(n, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = V.padded(V.robust_prune(x))
    got = V.range_search(x, links, V.medoids(x), x[0], -1.1)
    assert sorted(got.tolist()) == list(range(n))
