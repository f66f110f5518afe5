import random

import numpy as np
import pytest

from lonepoint.llm import ngram_join as J
from lonepoint.llm.textvec import Words


def grams(text, n=5):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows):
    """doc_id to (class_id, n_links), by all pairs."""
    sets = [grams(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for i, a in enumerate(sets)]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, min(known) if known else None, len(near[i])))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            other = list(text)
            if rng.random() < 0.7:
                other[rng.randrange(len(other))] = "changed%d" % rng.randrange(3)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(other)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (5, rows[5][1]), (903, "é " * 40_000), (904, "é " * 40_001)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(frame, monkeypatch, seed):
    if seed > 1:  # large buckets over several blocks
        monkeypatch.setattr(J, "BLOCK_ROWS", seed)
    rows = corpus(seed)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(frame(rows), recall=0.99999).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_one_of_each_group_stays(frame):
    rows = corpus(4)
    docs = frame(rows)
    got = J.keep_one(docs, recall=0.99999)
    assert got.columns == docs.columns
    want = sorted(d for d, c, n in brute(rows) if d == c and d is not None and n == 0 or d == c and n)
    ids = sorted(r.doc_id for r in got.collect())
    assert sorted(set(want)) == ids


def test_one_of_many_repeated_rows_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, i % 3, {"a": i}) for i in range(900)] + [(2, text, 0, {}), (3, None, 0, {}), (3, None, 1, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, extra map<string,int>").repartition(5)
    got = J.keep_one(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == [(1, text), (3, None), (3, None)]


def test_empty(frame):
    assert J.near_duplicates(frame([])).count() == 0 and J.keep_one(frame([])).count() == 0


def test_bands_meet_the_recall():
    count, rows = J.bands(0.8)
    assert 1 - (1 - 0.8**rows) ** count >= J.RECALL and count * rows <= J.MAX_HASHES


@pytest.mark.parametrize("seed", range(4))
def test_overlaps(seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 50, 30)
    sets = [np.unique(np.concatenate([common[: rng.integers(0, 30)], rng.integers(0, 3000, rng.integers(1, 90))])).astype(np.uint64) for _ in range(40)]
    got = J.overlaps(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_words_are_runs_without_the_six_spaces():
    texts = ["a b\x0bc", "", "é\xa0x  \n", " lead", "\x1cx y"]
    w = Words([t.encode() for t in texts])
    assert np.diff(w.first).tolist() == [3, 0, 1, 1, 2]
    again = Words([b"zz a b c"])
    assert again.hash[1:].tolist() == w.hash[:3].tolist() and len(set(w.hash.tolist())) == 7
