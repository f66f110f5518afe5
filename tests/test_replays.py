"""The seeded detectors against plain Python that goes by their rules a point at a time: lists, sets and math.dist, no matrices and no index."""

import math
import random

import pytest

from lonepoint.functions.lsh import projections
from lonepoint.params import LshParams, Params
from lonepoint.streaming.detectors import BoundedLsh, MicroClusters
from tests.test_outliers import CASES


def keys(lsh, v):
    return [(t, *(math.floor((sum(a * x for a, x in zip(w, v)) + b) / lsh.width) for w, b in hashes)) for t, hashes in enumerate(projections(lsh, len(v)))]


class Plain:
    """neighbours[i]: the residents that point i has met; those of its own and later slides stay known when they leave."""

    def __init__(self, values, p, seed):
        self.values = {i + 1: tuple(v) if isinstance(v, (list, tuple)) else (v,) for i, v in enumerate(values)}
        self.p, self.rng = p, random.Random(seed)
        self.slide = lambda i: (i - 1) // p.slide + 1
        self.live, self.later, self.earlier, self.inlier, self.was_in = [], {}, {}, {}, set()

    def d(self, i, j):
        # As sums in the order of the dimensions.
        total = 0.0
        for a, b in zip(self.values[i], self.values[j]):
            total += (a - b) ** 2
        return math.sqrt(total)

    def hear(self, i, j):
        if self.slide(j) >= self.slide(i):
            self.later[i] += 1
        else:
            self.earlier[i].add(j)

    def known(self, i):
        return self.later[i] + len(self.earlier[i] & set(self.live))

    def judge(self, i, inlier):
        self.inlier[i] = inlier
        if inlier:
            self.was_in.add(i)

    def pair(self, i, j, both):
        self.hear(i, j)
        if both:
            self.hear(j, i)
            if not self.inlier[j] and self.known(j) >= self.p.k:
                self.judge(j, True)

    def run(self):
        n, out = len(self.values), []
        last = self.slide(n)
        for s in range(1, last + 1):
            old = [i for i in self.live if self.slide(i) == s - self.p.n]
            self.live = [i for i in self.live if i not in old]
            if old:
                self.leave(old)
                out += [i for i in old if i not in self.was_in]
                for i in self.live:
                    if self.free_of_clusters(i) and self.inlier[i] and self.known(i) < self.p.k:
                        self.judge(i, False)
            for i in range((s - 1) * self.p.slide + 1, min(n, s * self.p.slide) + 1):
                self.live.append(i)
                self.later[i], self.earlier[i], self.inlier[i] = 0, set(), None
                self.come(i, None)
        return sorted(out + [i for i in self.live if i not in self.was_in])

    def free_of_clusters(self, i):
        return True


class PlainBuckets(Plain):
    def __init__(self, values, p, lsh, capacity, seed):
        super().__init__(values, p, seed)
        self.lsh, self.capacity, self.tables = lsh, capacity, {}

    def leave(self, old):
        for bucket in self.tables.values():
            bucket[:] = [i for i in bucket if i not in old]

    def come(self, i, again):
        mine = keys(self.lsh, self.values[i])
        for j in sorted({j for key in mine for j in self.tables.get(key, [])}):
            self.pair(i, j, True)
        for key in mine:
            bucket = self.tables.setdefault(key, [])
            while len(bucket) > self.capacity and (safe := [j for j in bucket if self.later[j] >= self.p.k]):
                bucket.remove(self.rng.choice(safe))
            bucket.append(i)
        self.judge(i, self.known(i) >= self.p.k)


class PlainClusters(Plain):
    def __init__(self, values, p, limit, ring, seed, lsh=None):
        super().__init__(values, p, seed)
        self.limit, self.ring, self.lsh = limit, ring, lsh
        self.listed, self.clusters, self.of, self.knows, self.made = [], {}, {}, {}, 0

    def free_of_clusters(self, i):
        return i not in self.of

    def leave(self, old):
        hit = set()
        for i in old:
            if i in self.of:
                hit.add(self.of.pop(i))
            elif i in self.listed:
                self.listed.remove(i)
        again = []
        for c in sorted(hit):
            members = [i for i in self.live if self.of.get(i) == c]
            if len(members) <= self.p.k:
                again += members
                del self.clusters[c]
        for i in again:
            del self.of[i]
        for i in sorted(again):
            self.later[i], self.earlier[i], self.knows[i] = 0, set(), set()
        for i in sorted(again):
            self.come(i, set(again))

    def come(self, i, again):
        r, hears = self.p.radius, lambda j: again is None or j in again
        near = sorted((self.d(i, centre), c) for c, centre in self.clusters.items() if self.d(i, centre) <= 1.5 * r)
        if near and near[0][0] <= r / 2:
            c = near[0][1]
            self.of[i], self.knows[i] = c, set()
            self.judge(i, True)
            for j in self.listed:
                if c in self.knows[j] and hears(j) and self.d(i, j) <= r:
                    self.hear(j, i)
                    if not self.inlier[j] and self.known(j) >= self.p.k:
                        self.judge(j, True)
            return
        left = False
        while len(self.listed) > self.limit and (safe := sorted(j for j in self.listed if self.later[j] >= self.p.k)):
            self.listed.remove(self.rng.choice(safe))
            left = True
        mine = set(keys(self.lsh, self.values[i])) if self.lsh else None
        around = [j for j in self.listed if self.d(i, j) <= 1.5 * r and (mine is None or mine & set(keys(self.lsh, self.values[j])))]
        for j in around:
            if self.d(i, j) <= r:
                self.pair(i, j, hears(j))
        core = [j for j in around if self.d(i, j) <= r / 2]
        ring = [j for j in around if r / 2 < self.d(i, j) <= r / 2 + self.ring * r] if left else []
        if core + ring and len(core + ring) >= self.p.k:
            self.made += 1
            self.clusters[self.made] = i
            for j in [i, *core, *ring]:
                if j in self.listed:
                    self.listed.remove(j)
                self.of[j], self.knows[j] = self.made, set()
                self.judge(j, True)
            for j in around:
                if j not in self.of and self.d(i, j) > r / 2:
                    self.knows[j].add(self.made)
            return
        self.knows[i] = {c for _, c in near}
        for j in self.live:
            if j != i and self.of.get(j) in self.knows[i] and self.d(i, j) <= r:
                self.hear(i, j)
        if self.later[i] < self.p.k or len(self.listed) < self.limit:
            self.listed.append(i)
        self.judge(i, self.known(i) >= self.p.k)


def stepped(detector, values, p):
    """Outliers, and the sums of what happened in the slides."""
    state, out, total = detector.start(), [], {}
    rows = [list(v) if isinstance(v, (list, tuple)) else [v] for v in values]
    import numpy as np

    for at in range(0, len(rows), p.slide):
        part = rows[at : at + p.slide]
        gone, numbers = detector.step(state, list(range(at + 1, at + 1 + len(part))), np.array(part, float))
        out += gone
        for k, v in numbers.items():
            total.setdefault(k, []).append(v)
    return sorted(out + detector.finish(state)), total


def longer():
    rng = random.Random(5)
    yield from CASES
    yield [round(rng.gauss(0, 2), 2) for _ in range(400)], Params(100, 10, 0.3, 4)
    yield [(rng.choice([0, 3, 9]) + rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for _ in range(300)], Params(60, 20, 0.5, 3)


LONGER = list(longer())


@pytest.mark.parametrize("case", range(len(LONGER)))
@pytest.mark.parametrize("limit, ring, seed", [(3, 0.2, 1), (10, 0.5, 2), (10**6, 0.0, 3)])
def test_micro_clusters(case, limit, ring, seed):
    values, p = LONGER[case]
    plain = PlainClusters(values, p, limit, ring, seed)
    got, total = stepped(MicroClusters(p, limit, ring, seed), values, p)
    assert got == plain.run()
    assert sum(total["made"]) == plain.made and total["clusters"][-1] == len(plain.clusters) == sum(total["made"]) - sum(total["dissolved"])
    assert total["clustered"][-1] == len(plain.of) and sum(total["joined"]) + sum(total["listed"]) >= len(values) - sum(total["queries"])


@pytest.mark.parametrize("case", range(len(LONGER)))
def test_clusters_with_hashing(case):
    values, p = LONGER[case]
    lsh = LshParams(4, 2, 1.5 * p.radius, 6)
    assert stepped(MicroClusters(p, p.window, 0.0, 7, lsh), values, p)[0] == PlainClusters(values, p, p.window, 0.0, 7, lsh).run()


@pytest.mark.parametrize("case", range(len(LONGER)))
@pytest.mark.parametrize("capacity", [1, 4, 10**6])
def test_bounded_buckets(case, capacity):
    values, p = LONGER[case]
    lsh = LshParams(5, 2, p.radius, 5)
    assert stepped(BoundedLsh(p, lsh, capacity, 3), values, p)[0] == PlainBuckets(values, p, lsh, capacity, 3).run()
