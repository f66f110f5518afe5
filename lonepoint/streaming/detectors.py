"""Detectors that keep state: pure steps of one slide, shared by batch replay and Structured Streaming.

A detector has start(), step(state, ids, values) for the points of one slide and finish(state). Both return the ids of pure outliers
that leave; step also returns the numbers of the slide. State is plain data that pickles.
"""

from __future__ import annotations

import bisect
import random
from dataclasses import dataclass, field

import numpy as np

from lonepoint.functions.lsh import projections
from lonepoint.params import LshParams, Params

#: Numbers of a slide: residents at its end, outliers among them, clusters, clustered and unclustered points; and what happened in it: clusters made
#: and dissolved, points added to clusters and to the unclustered ones that are searched, points that became safe inliers, range searches.
NUMBERS = ("residents", "outliers", "clusters", "clustered", "unclustered", "made", "dissolved", "joined", "listed", "safe", "queries")


class Exact:
    """Counts neighbours by slide for all residents; one product of new points and residents for each slide."""

    def __init__(self, params: Params):
        self.params = params

    def start(self) -> dict:
        return {"slide": 0, "ids": np.zeros(0, np.int64), "values": None, "born": np.zeros(0, np.int64), "per": np.zeros((0, self.params.n), np.int64), "inlier": np.zeros(0, bool)}

    def step(self, state: dict, ids: list[int], values: np.ndarray) -> tuple[list[int], dict]:
        p = self.params
        state["slide"] += 1
        now = state["slide"]
        stays = state["born"] > now - p.n
        gone = sorted(state["ids"][~stays & ~state["inlier"]].tolist()) if p.k > 0 else []
        old = state["values"][stays] if state["values"] is not None else np.zeros((0, values.shape[1]))
        per = state["per"][stays]
        slot = now % p.n
        per[:, slot] = 0
        everyone = np.concatenate([old, values])
        near = np.sqrt(_squares(values, everyone)) <= p.radius
        near[np.arange(len(values)), len(old) + np.arange(len(values))] = False
        per[:, slot] = near[:, : len(old)].sum(0)
        born = np.concatenate([state["born"][stays], np.full(len(values), now)])
        fresh = np.zeros((len(values), p.n), np.int64)
        for s in range(max(1, now - p.n + 1), now + 1):
            fresh[:, s % p.n] = near[:, born == s].sum(1)
        state["per"] = np.concatenate([per, fresh])
        state["ids"] = np.concatenate([state["ids"][stays], np.array(ids, np.int64)])
        state["values"], state["born"] = everyone, born
        count = state["per"].sum(1)
        state["inlier"] = np.concatenate([state["inlier"][stays], np.zeros(len(values), bool)]) | (count >= p.k)
        return gone, {"residents": len(count), "outliers": int((count < p.k).sum()), "queries": len(values)}

    def finish(self, state: dict) -> list[int]:
        return sorted(state["ids"][~state["inlier"]].tolist())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed over dimensions in order, as the column expressions do."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i][:, None] - b[:, i][None, :]) ** 2
    return out


@dataclass
class Point:
    """A resident: neighbours of its own and later slides as a number, of earlier ones as ascending ids."""

    id: int
    values: np.ndarray
    slide: int
    after: int = 0
    before: list[int] = field(default_factory=list)
    was_in: bool = False
    inlier: bool | None = None
    cluster: int | None = None
    near: set[int] = field(default_factory=set)

    def judge(self, inlier: bool) -> None:
        self.inlier = inlier
        self.was_in |= inlier

    def meet(self, other: Point) -> None:
        if other.slide >= self.slide:
            self.after += 1
        else:
            at = bisect.bisect_left(self.before, other.id)
            if at == len(self.before) or self.before[at] != other.id:
                self.before.insert(at, other.id)

    def count(self, first: int) -> int:
        return self.after + len(self.before) - bisect.bisect_left(self.before, first)


class _Stateful:
    """Shared by the detectors that look at one point after the other."""

    def __init__(self, params: Params, seed: int):
        self.params, self.seed = params, seed

    def start(self) -> dict:
        return {"slide": 0, "points": {}, "slides": [], "matrix": None, "random": random.Random(self.seed).getstate()}

    def distances(self, state: dict, v: np.ndarray, ids: list[int]) -> np.ndarray:
        """From v to residents; their values lie in a matrix, at the id's place in the window."""
        return np.sqrt(_squares(v[None], state["matrix"][np.array(ids, np.int64) % self.params.window]))[0]

    def step(self, state: dict, ids: list[int], values: np.ndarray) -> tuple[list[int], dict]:
        p = self.params
        rng = random.Random()
        rng.setstate(state["random"])
        state["slide"] += 1
        numbers = dict.fromkeys(("made", "dissolved", "joined", "listed", "safe", "queries"), 0)
        if state["matrix"] is None:
            state["matrix"] = np.zeros((p.window, values.shape[1]))
        gone: list[int] = []
        if len(state["slides"]) == p.n:
            expired = [state["points"].pop(i) for i in state["slides"].pop(0)]
            first = state["slides"][0][0] if state["slides"] else ids[0]
            self.expire(state, expired, first, numbers, rng)
            gone = sorted(x.id for x in expired if not x.was_in)
            # Inliers that may have lost neighbours are counted again.
            for x in state["points"].values():
                if x.cluster is None and x.inlier and x.after < p.k and x.count(first) < p.k:
                    x.judge(False)
        state["slides"].append(list(ids))
        first = state["slides"][0][0]
        for i, v in zip(ids, values, strict=True):
            x = state["points"][i] = Point(i, np.asarray(v, float), state["slide"])
            state["matrix"][i % p.window] = x.values
            self.arrive(state, x, first, numbers, rng, None)
        state["random"] = rng.getstate()
        points = state["points"].values()
        clustered = sum(x.cluster is not None for x in points)
        numbers |= {"residents": len(points), "outliers": sum(not x.inlier for x in points), "clusters": len(state.get("clusters", ())), "clustered": clustered, "unclustered": len(points) - clustered}
        return gone, numbers

    def finish(self, state: dict) -> list[int]:
        return sorted(x.id for x in state["points"].values() if not x.was_in)

    def met(self, x: Point, q: Point, first: int, both: bool, numbers: dict) -> None:
        """x and q are neighbours; with both, q hears of it too."""
        self.heard(x, q, numbers)
        if both:
            self.heard(q, x, numbers)
            if not q.inlier and q.count(first) >= self.params.k:
                q.judge(True)


    def heard(self, x: Point, q: Point, numbers: dict) -> None:
        x.meet(q)
        numbers["safe"] += x.after == self.params.k and q.slide >= x.slide


class Buckets:
    """Hash tables over the residents that are indexed."""

    def __init__(self, lsh: LshParams, dims: int):
        draws = projections(lsh, dims)
        self.a = np.array([[a for a, _ in t] for t in draws])
        self.b = np.array([[b for _, b in t] for t in draws])
        self.width = lsh.width

    def keys(self, v: np.ndarray) -> list[tuple]:
        h = np.floor((self.a @ v + self.b) / self.width).astype(np.int64)
        return [(t, *row) for t, row in enumerate(h.tolist())]


class MicroClusters(_Stateful):
    """Points within half the radius of a centre, k + 1 of them or more, are a cluster and inliers without further search.

    Others are searched for within the radius. pd_limit bounds the unclustered points that are searched: beyond it safe inliers leave
    at random, and then points in a ring around the half radius, of `ring` radii, may make up a cluster. With a limit of a window
    or more the result is exact. With lsh, unclustered neighbours are only found if they share a bucket.
    """

    def __init__(self, params: Params, pd_limit: int, ring: float, seed: int, lsh: LshParams | None = None):
        super().__init__(params, seed)
        if pd_limit < 1 or ring < 0:
            raise ValueError("pd_limit must be positive and ring not negative")
        self.pd_limit, self.ring, self.lsh, self.buckets = pd_limit, ring, lsh, None

    def start(self) -> dict:
        return super().start() | {"clusters": {}, "centres": None, "next": 1, "free": {}, "tables": {}}

    def __getstate__(self):
        return self.__dict__ | {"buckets": None}

    # The index of unclustered points

    def _add(self, state: dict, x: Point) -> None:
        state["free"][x.id] = x
        if self.lsh:
            for key in self._keys(x):
                state["tables"].setdefault(key, set()).add(x.id)

    def _remove(self, state: dict, x: Point) -> None:
        if state["free"].pop(x.id, None) is not None and self.lsh:
            for key in self._keys(x):
                members = state["tables"][key]
                members.discard(x.id)
                if not members:
                    del state["tables"][key]

    def _keys(self, x: Point) -> list[tuple]:
        if self.buckets is None:
            self.buckets = Buckets(self.lsh, len(x.values))
        return self.buckets.keys(x.values)

    def _around(self, state: dict, x: Point, radius: float) -> list[tuple[float, Point]]:
        free = state["free"]
        if self.lsh:
            found = sorted({i for key in self._keys(x) for i in state["tables"].get(key, ())})
        else:
            found = list(free)
        if not found:
            return []
        d = self.distances(state, x.values, found)
        near = np.flatnonzero(d <= radius)
        return [(d, free[found[i]]) for i, d in zip(near.tolist(), d[near].tolist(), strict=True)]

    def _near_clusters(self, state: dict, x: Point) -> list[tuple[float, int]]:
        """Distance and number of the clusters whose centre lies within one and a half radii, the nearest first."""
        if not state["clusters"]:
            return []
        if state["centres"] is None:
            state["centres"] = list(state["clusters"]), np.stack([c["centre"] for c in state["clusters"].values()])
        names, values = state["centres"]
        d = np.sqrt(_squares(x.values[None], values))[0]
        near = np.flatnonzero(d <= 1.5 * self.params.radius)
        return sorted(zip(d[near].tolist(), (names[i] for i in near.tolist()), strict=True))

    def _within(self, state: dict, x: Point, ids: list[int]) -> list[Point]:
        """Of these residents those within the radius."""
        return [state["points"][ids[i]] for i in np.flatnonzero(self.distances(state, x.values, ids) <= self.params.radius).tolist()] if ids else []

    def _join(self, state: dict, x: Point, near: list[tuple[float, int]], first: int, numbers: dict, again: set[int] | None) -> bool:
        """x becomes a member of the nearest cluster if its centre is within half the radius; the unclustered points that know the cluster hear of it."""
        if not near or near[0][0] > self.params.radius / 2:
            return False
        c = near[0][1]
        x.cluster, x.near = c, set()
        state["clusters"][c]["members"].add(x.id)
        numbers["joined"] += 1
        x.judge(True)
        for q in self._within(state, x, [i for i, q in state["free"].items() if c in q.near and (again is None or i in again)]):
            self.heard(q, x, numbers)
            if not q.inlier and q.count(first) >= self.params.k:
                q.judge(True)
        return True

    def _make_room(self, state: dict, rng: random.Random) -> bool:
        """Whether safe inliers had to leave the unclustered points that are searched."""
        left = False
        while len(state["free"]) > self.pd_limit:
            safe = [i for i, q in state["free"].items() if q.after >= self.params.k]
            if not safe:
                break
            self._remove(state, state["free"][rng.choice(sorted(safe))])
            left = True
        return left

    def _found(self, state: dict, x: Point, around: list[tuple[float, Point]], members: list[Point], numbers: dict) -> None:
        """x is the centre of a new cluster of these members; those near it know of the cluster."""
        c, state["next"] = state["next"], state["next"] + 1
        numbers["made"] += 1
        numbers["joined"] += 1 + len(members)
        state["clusters"][c] = {"centre": x.values, "members": {x.id, *(q.id for q in members)}}
        state["centres"] = None
        for q in [x, *members]:
            self._remove(state, q)
            q.cluster, q.near = c, set()
            q.judge(True)
        for d, q in around:
            if q.cluster is None and d > self.params.radius / 2:
                q.near.add(c)

    def arrive(self, state: dict, x: Point, first: int, numbers: dict, rng: random.Random, again: set[int] | None) -> None:
        """again: the points of dissolved clusters that come anew with x; only they hear of x, the others know it."""
        p = self.params
        near = self._near_clusters(state, x)
        if self._join(state, x, near, first, numbers, again):
            return
        evicted = self._make_room(state, rng)
        numbers["queries"] += 1
        around = self._around(state, x, 1.5 * p.radius)
        for d, q in around:
            if d <= p.radius:
                self.met(x, q, first, again is None or q.id in again, numbers)
        reach = p.radius / 2 + (self.ring * p.radius if evicted else 0.0)
        members = [q for d, q in around if d <= reach]
        if members and len(members) >= p.k:
            self._found(state, x, around, members, numbers)
            return
        x.near = {c for _, c in near}
        for q in self._within(state, x, [i for c in x.near for i in state["clusters"][c]["members"]]):
            self.heard(x, q, numbers)
        if x.after < p.k or len(state["free"]) < self.pd_limit:
            self._add(state, x)
            numbers["listed"] += 1
        x.judge(x.count(first) >= p.k)

    def expire(self, state: dict, expired: list[Point], first: int, numbers: dict, rng: random.Random) -> None:
        broken = set()
        for x in expired:
            if x.cluster is None:
                self._remove(state, x)
            else:
                state["clusters"][x.cluster]["members"].discard(x.id)
                broken.add(x.cluster)
        again: list[Point] = []
        for c in sorted(broken):
            if len(state["clusters"][c]["members"]) < self.params.k + 1:
                numbers["dissolved"] += 1
                again += [state["points"][i] for i in state["clusters"].pop(c)["members"]]
                state["centres"] = None
        again.sort(key=lambda x: x.id)
        for x in again:
            x.cluster, x.after, x.before, x.near = None, 0, [], set()
        names = {x.id for x in again}
        # Of the points that come anew those still to come are in no index; each pair of them meets when its second comes.
        for x in again:
            self.arrive(state, x, first, numbers, rng, names)


class BoundedLsh(_Stateful):
    """Residents that share a bucket count as neighbours, at whatever distance. A bucket above its capacity loses safe inliers at random."""

    def __init__(self, params: Params, lsh: LshParams, capacity: int, seed: int):
        super().__init__(params, seed)
        self.lsh, self.capacity, self.buckets = lsh, capacity, None

    def __getstate__(self):
        return self.__dict__ | {"buckets": None}

    def start(self) -> dict:
        return super().start() | {"tables": {}}

    def _keys(self, x: Point) -> list[tuple]:
        if self.buckets is None:
            self.buckets = Buckets(self.lsh, len(x.values))
        return self.buckets.keys(x.values)

    def arrive(self, state: dict, x: Point, first: int, numbers: dict, rng: random.Random, again: set[int] | None) -> None:
        keys, tables, points = self._keys(x), state["tables"], state["points"]
        for i in sorted({i for key in keys for i in tables.get(key, ())}):
            self.met(x, points[i], first, True, numbers)
        numbers["queries"] += 1
        for key in keys:
            bucket = tables.setdefault(key, [])
            while len(bucket) > self.capacity:
                safe = [i for i in bucket if points[i].after >= self.params.k]
                if not safe:
                    break
                bucket.remove(rng.choice(safe))
            bucket.append(x.id)
        x.judge(x.count(first) >= self.params.k)

    def expire(self, state: dict, expired: list[Point], first: int, numbers: dict, rng: random.Random) -> None:
        for x in expired:
            for key in self._keys(x):
                bucket = state["tables"].get(key, [])
                if x.id in bucket:
                    bucket.remove(x.id)
                if not bucket:
                    state["tables"].pop(key, None)
