"""Counts, lifecycle and detectors against plain Python over hand-worked and random streams."""

import random

import pytest

from lonepoint.operators import counts, lsh_join, neighbors
from lonepoint.params import LshParams, Params
from lonepoint.streaming import replay

MICRO = [0.0, 10.0, 0.5, 20.0, 10.4, 30.0]


def frame(spark, values):
    rows = [(i + 1, [float(x) for x in (v if isinstance(v, (list, tuple)) else [v])]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, values array<double>").repartition(3)


class Brute:
    """By the definitions, a pair at a time."""

    def __init__(self, values, p):
        self.p, pts = p, [v if isinstance(v, (list, tuple)) else [v] for v in values]
        n = len(pts)
        self.ids = range(1, n + 1)
        self.slide = {i: (i - 1) // p.slide + 1 for i in self.ids}
        self.last = max(self.slide.values(), default=0)
        self.near = {i: [j for j in self.ids if j != i and abs(self.slide[i] - self.slide[j]) < p.n and sum((a - b) ** 2 for a, b in zip(pts[i - 1], pts[j - 1])) ** 0.5 <= p.radius] for i in self.ids}

    def within(self, i, low, high):
        return sum(low <= self.slide[j] <= high for j in self.near[i])

    def batches(self, i):
        return range(self.slide[i], min(self.last, self.slide[i] + self.p.n - 1) + 1)

    def cnt(self, i, b):
        return self.within(i, b - self.p.n + 1, b)

    def pure(self):
        return [i for i in self.ids if all(self.cnt(i, b) < self.p.k for b in self.batches(i))]

    def arrival(self, i):
        return sum(j < i for j in self.near[i])

    def after(self, i):
        return {b: self.within(i, b - self.p.n + 1, b - 1) for b in self.batches(i) if b > self.slide[i]}

    def life(self):
        out = {}
        for i in self.ids:
            all_ = [self.cnt(i, b) for b in self.batches(i)] + [self.arrival(i), *self.after(i).values()]
            out[i] = (max(all_) >= self.p.k, min(all_) < self.p.k)
        return out


def streams():
    rng = random.Random(3)
    yield MICRO, Params(4, 2, 1.0, 1)
    yield [round(rng.gauss(0, 3), 1) for _ in range(137)], Params(30, 10, 0.55, 3)
    yield [round(rng.gauss(0, 1), 1) for _ in range(60)], Params(20, 20, 0.35, 2)
    yield [rng.choice([1.0, 1.0, 5.0]) for _ in range(55)], Params(12, 3, 0.5, 4)
    yield [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(90)], Params(40, 8, 0.9, 2)
    yield [1.0], Params(4, 2, 1.0, 1)
    yield [round(rng.gauss(0, 1), 1) for _ in range(70)], Params(30, 1, 0.25, 3)  # sums by arrays
    yield [round(rng.gauss(0, 3), 1) for _ in range(40)], Params(8, 1, 1.05, 0)


CASES = list(streams())


@pytest.mark.parametrize("case", range(len(CASES)))
def test_against_brute_force(spark, case):
    values, p = CASES[case]
    b, pts, dims = Brute(values, p), frame(spark, values), len(values[0]) if isinstance(values[0], tuple) else 1
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(counts.pure_outliers(pts, p, dims)) == b.pure()
    assert {(r.id, r.batch): r.cnt for r in counts.window_counts(pts, p, dims).collect()} == {(i, x): b.cnt(i, x) for i in b.ids for x in b.batches(i)}
    assert {r.id: r.a for r in counts.arrival_counts(pts, p, dims).collect()} == {i: b.arrival(i) for i in b.ids}
    assert {(r.id, r.batch): r.cnt for r in counts.post_expiry_counts(pts, p, dims).collect()} == {(i, x): c for i in b.ids for x, c in b.after(i).items()}
    assert {r.id: (r.ever_in, r.ever_out) for r in counts.lifecycle(pts, p, dims).collect()} == b.life()
    assert {r.id: (r.preceding, r.succeeding) for r in counts.before_and_after(pts, p, dims).collect()} == {i: (sum(b.slide[j] < b.slide[i] for j in b.near[i]), sum(b.slide[j] >= b.slide[i] for j in b.near[i])) for i in b.ids}
    assert sorted((r.id, r.nbr_id) for r in neighbors.pairs(pts, p, dims).collect()) == [(i, j) for i in b.ids for j in b.near[i]]
    safe = {r.id: r.safe_from for r in counts.safe_inliers(pts, p, dims).collect()}
    want = {i: next((x for x in range(b.slide[i], b.slide[i] + p.n) if b.within(i, b.slide[i], x) >= p.k), None) for i in b.ids}
    assert safe == {i: x for i, x in want.items() if x is not None}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_stateful_detectors(spark, case):
    values, p = CASES[case]
    b = Brute(values, p)
    pts = frame(spark, values).selectExpr("'s' AS stream_id", "id", "values")
    run = lambda d: sorted(r.id for r in replay.replay(pts, d).filter("kind = 'outlier'").collect())
    assert run(replay.Exact(p)) == b.pure()
    assert run(replay.MicroClusters(p, p.window, 0.0, 1)) == b.pure()
    lsh = LshParams(6, 2, 1.5 * p.radius, 4)
    verified = run(replay.MicroClusters(p, p.window, 0.0, 1, lsh))
    assert set(b.pure()) <= set(verified)
    small = replay.MicroClusters(p, 2, 0.2, 1)
    assert run(small) == run(small)
    assert run(replay.BoundedLsh(p, lsh, 10**6, 1)) == sorted(r.id for r in lsh_join.lsh_pure_outliers(frame(spark, values), p, lsh, len(values[0]) if isinstance(values[0], tuple) else 1).collect())


def test_micro_fixture(spark):
    p, pts = Params(4, 2, 1.0, 1), frame(spark, MICRO)
    assert sorted(r.id for r in counts.pure_outliers(pts, p, 1).collect()) == [2, 4, 5, 6]
    assert sorted((r.batch, r.id) for r in counts.window_outliers(pts, p, 1).collect()) == [(1, 1), (1, 2), (2, 2), (2, 4), (3, 3), (3, 4), (3, 5), (3, 6)]
    assert counts.lifecycle_counts(pts, p, 1).head().asDict() == {"only_in": 0, "only_out": 4, "both": 2}
    assert sorted((r.batch, r.residents, r.outliers) for r in counts.outliers_per_window(pts, p, 1).collect()) == [(1, 2, 2), (2, 4, 2), (3, 4, 4)]


def test_distance_equal_to_the_radius_counts(spark):
    assert [r.id for r in counts.pure_outliers(frame(spark, [0.0, 1.0, 2.5]), Params(3, 3, 1.0, 1), 1).collect()] == [3]


def test_hashing_with_verification_only_misses_neighbours(spark):
    values, p = CASES[1]
    exact = set(Brute(values, p).pure())
    pts = frame(spark, values)
    sizes = []
    for tables in (1, 4, 10):
        got = {r.id for r in lsh_join.lsh_pure_outliers(pts, p, LshParams(tables, 3, 1.0, 2), 1, verify=True).collect()}
        assert exact <= got
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True)
    pairs = {(r.id, r.nbr_id) for r in lsh_join.candidates(pts, p, LshParams(4, 3, 1.0, 2), 1, verify=True).collect()}
    b = Brute(values, p)
    assert pairs <= {(i, j) for i in b.ids for j in b.near[i]} and {(j, i) for i, j in pairs} == pairs


@pytest.mark.parametrize("bad", [dict(window=10, slide=3), dict(slide=0), dict(window=0), dict(radius=0.0), dict(radius=float("nan")), dict(k=-1)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Params(**(dict(window=10, slide=5, radius=1.0, k=1) | bad))


def test_bad_hash_width():
    with pytest.raises(ValueError):
        LshParams(1, 1, 0.0, 1)


def test_gaps_are_errors(spark):
    with pytest.raises(Exception, match="id 3 after 1"):
        replay.replay(spark.createDataFrame([("s", 1, [0.0]), ("s", 3, [0.0])], "stream_id string, id long, values array<double>"), replay.Exact(Params(2, 1, 1.0, 1))).collect()
