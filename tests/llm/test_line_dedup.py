import random

import numpy as np
import pytest

from lonepoint.llm import line_dedup as L


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randrange(90))) for _ in range(2))
        if rng.random() < 0.5:
            k = rng.randrange(len(a) + 1)
            b = a[:k] + rng.choice(["", "x", "yz"]) + a[k + rng.randrange(3) :]
        assert L.edit_distance(a, b) == plain_distance(a, b)


def test_similar_agrees_with_the_distance():
    rng = random.Random(5)
    for _ in range(600):
        a = " ".join(rng.choice(["ab", "é", "long", "x"]) for _ in range(rng.randrange(1, 14)))
        b = " ".join(w if rng.random() < 0.8 else rng.choice(["yz", "ab", ""]) for w in a.split(" "))
        assert L.similar(a, b) == (plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_simhash_is_the_majority_of_bits():
    rng = random.Random(6)
    lines = [b" ".join(b"w%d" % rng.randrange(50) for _ in range(n)) for n in (1, 2, 3, 0, 254, 255, 256, 1000, 7)]
    got = L.simhash(lines).tolist()
    for line, sim in zip(lines, got, strict=True):
        hashes = [int(L.mix(np.uint64((h >> 24) + 0x9E3779B97F4A7C15) * np.ones(1, np.uint64))[0]) for h in set(L.Words([line]).hash.tolist())]
        assert sim == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("distance", [3, 6])
@pytest.mark.parametrize("lines", [1000, 10**9, 10**11, 10**13])
def test_every_pair_within_the_distance_has_one_table(lines, distance):
    tables = L.Tables(lines, distance)
    rng = random.Random(lines)
    assert len(tables.chosen) < 256 and sum(tables.blocks) == (1 << 64) - 1
    flips = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 1))) for _ in range(2000)], np.uint64)
    owners = np.array([tables.owns(t, flips) for t in range(len(tables.chosen))])
    assert (owners.sum(0) == 1).all()
    for i, t in enumerate(owners.argmax(0).tolist()):
        assert not int(flips[i]) & tables.mask(t)
        assert any(not int(flips[i]) & b for b in tables.blocks[tables.chosen[t][-1] + 1 :])
    assert tables.r > 2 or lines < 10**6 or distance < 6


@pytest.mark.parametrize("matrix", [2, 48])
@pytest.mark.parametrize("lines", [1000, 10**9])
def test_near_hashes_against_brute_force(monkeypatch, matrix, lines):
    monkeypatch.setattr(L, "MATRIX", matrix)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(300)]
    flipped = lambda b: b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(9)))
    x = base + [flipped(rng.choice(base[:60])) for _ in range(400)] + base[:5]
    sims, tables = np.array(x, np.uint64), L.Tables(lines)
    got = np.zeros(len(x), bool)
    for t in range(len(tables.chosen)):
        group = (sims & np.uint64(tables.mask(t))).view(np.int64)
        rows = np.argsort(group, kind="stable")
        got[rows] |= tables.near(t, sims[rows], group[rows])
    assert got.tolist() == [any(i != j and (x[i] ^ x[j]).bit_count() <= 6 for j in range(len(x))) for i in range(len(x))]


def brute(rows, distance=6, least=0.8):
    """By pairs of all different lines, from the definitions."""
    forms = [(d, t, L.normal_lines((t or "").encode())) for d, t in rows]
    unique = sorted({x for *_, f in forms for x in f if x})
    sims = dict(zip(unique, L.simhash(unique).tolist(), strict=True))
    root = {x: x for x in unique}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(unique):
        for b in unique[i + 1 :]:
            if (sims[a] ^ sims[b]).bit_count() <= distance:
                s, t = a.decode(), b.decode()
                if plain_distance(s, t) <= (1 - least) * max(len(s), len(t)) + 1e-9:
                    root[find(b)] = find(a)
    first = {}
    for d, t, f in sorted(forms, key=lambda x: (x[0] is None, x[0] or 0)):
        for pos, x in enumerate(f):
            if x:
                first.setdefault(find(x), (d, t, pos))
    return {(d, t): t and "\n".join(x for pos, (x, form) in enumerate(zip(t.split("\n"), f, strict=True)) if not form or first[find(form)] == (d, t, pos)) for d, t, f in forms}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) * 2 for i in range(30)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    for line in lines[:40]:
        words = line.split()
        for _ in range(3):
            other = list(words)
            other[rng.randrange(len(other))] += rng.choice(["x", "!", ","])
            lines.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n ... \n"), (None, lines[0] + "\nfresh line here"), (103, "long " * 30_000 + "\n" + lines[1]), (7, rows[7][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(frame, monkeypatch, seed):
    if seed == 2:  # every bucket over several blocks
        monkeypatch.setattr(L, "BLOCK_ROWS", 2)
        monkeypatch.setattr(L, "GROUP_ROWS", 8)
        monkeypatch.setattr(L, "SAMPLE", 1)
    rows = corpus(seed)
    docs = frame(rows)
    got = L.dedup_lines(docs)
    assert got.columns == docs.columns
    want = brute(rows)
    out = got.collect()
    assert len(out) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(want[d, t])
    for r in out:
        assert r.text in texts[r.doc_id]
    removed = sum(len(r.text.split("\n")) if r.text else 0 for r in out)
    assert removed < sum(len(t.split("\n")) for _, t in rows if t)


def test_counts_and_empty(frame):
    rows = [(1, "same line\nother one entirely"), (2, "Same, line!\nthird thing now"), (3, "same line")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.deduplicated(frame(rows)).collect()}
    assert got == {1: ("same line\nother one entirely", 2, 0), 2: ("third thing now", 2, 1), 3: ("", 1, 1)}
    assert L.deduplicated(frame([])).count() == 0
