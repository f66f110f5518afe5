import itertools
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from lonepoint.llm import quality as Q


@pytest.mark.parametrize("seed", range(3))
def test_forward_backward_against_all_labellings(seed):
    rng = np.random.default_rng(seed)
    sizes = [3, 0, 5, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary, pairs = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    p, expected = Q.Chains(first).marginals(unary, pairs)
    total = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        if not n:
            continue
        u, weights, good, moves = unary[first[k] : first[k + 1]], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            steps = list(zip(y, y[1:]))
            w = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(pairs[a, b] for a, b in steps))
            weights += w
            good += w * np.array(y)
            for a, b in steps:
                moves[a, b] += w
        assert np.allclose(p[first[k] : first[k + 1]], good / weights)
        total += moves / weights
    assert np.allclose(expected, total)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 500, 1000])
def test_long_chains_against_one_step_after_the_other(n, monkeypatch):
    monkeypatch.setattr(Q, "SEGMENT", 8)
    monkeypatch.setattr(Q, "SEGMENTS", 8)
    rng = np.random.default_rng(n)
    unary, pairs = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
    want, _ = Q.Chains(np.array([0, n])).marginals(unary, pairs)
    got = np.full(n, np.nan)
    for at, p in Q.long_marginals(unary, pairs):
        got[at : at + len(p)] = p
    assert np.allclose(got, want)


def trained():
    rows, labels = corpus(300)
    y = dict((d, q) for d, q, _ in labels)
    lines = [Q.split_lines(t.encode()) for d, t in rows if d in y]
    return Q.Model.fit([Q.line_features(x) for x in lines], [np.array([len(v) for v in x]) for x in lines], np.array([y[d] for d, _ in rows if d in y]))


def test_a_text_scores_alike_by_stretches_and_at_once(monkeypatch):
    model = trained()
    rng = random.Random(1)
    text = "\n".join(rng.choice(["The river walked.", "stone$$$ green%%%", "", "x"]) for _ in range(3000)).encode() + b"\n"
    score, p = model.scores([text])
    monkeypatch.setattr(Q, "LONG", 10)
    monkeypatch.setattr(Q, "STRETCH", 500)
    by, q = model.scores([text])
    assert len(p[0]) == len(q[0]) == 3001 and np.allclose(p[0], q[0], atol=1e-5) and np.allclose(score, by, atol=1e-6)


@pytest.mark.parametrize("text", [b"", b"\n", b"a\nb", b"x" * 1200 + b"\n\n" + b"y\n" * 700 + b"z" * 600])
def test_stretches_are_the_lines(text, monkeypatch):
    monkeypatch.setattr(Q, "STRETCH", 500)
    assert [x for part in Q.stretches(text) for x in part] == text.split(b"\n")


def test_long_lines_add_up(monkeypatch):
    line = b"Some words $$ and numb3rs! " * 400
    whole = Q.line_features([line, b"x"])
    monkeypatch.setattr(Q, "BLOCK", 1000)
    monkeypatch.setattr(Q, "blocks", lambda lines: ((i, [x]) for i, x in enumerate(lines)))
    assert np.allclose(Q.line_features([line, b"x"]), whole, atol=1e-6)


@pytest.mark.parametrize("text", [b"\n" * (16 << 20), b"a\n" * (4 << 20), b"stone " * (2 << 20)])
def test_memory_and_time_are_bounded(text):
    """A process of its own scores the text within 1 GB beside what the libraries take."""
    code = f"""
import resource, sys, time, zlib
sys.path[:0] = {sys.path!r}
from tests.llm import test_quality as t
model = t.trained()
text = {text[:8]!r} * {len(text) // 8} if {len(text)} % 8 == 0 else None
text = text or {text[:6]!r} * {len(text) // 6}
begun, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.scores([text])
print(time.time() - begun, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(Path(__file__).resolve().parents[2])).stdout.split()
    assert float(out[0]) < 240 and float(out[1]) < 1 << 20, out


def corpus(n=700):
    rng = random.Random(8)
    words = ["river", "stone", "the", "of", "walked", "house", "and", "green", "later", "morning"]

    def line(bad):
        w = [rng.choice(words) for _ in range(rng.randrange(4, 14))]
        return " ".join(x + rng.choice(["$$$", "%%%", "###"]) for x in w) if bad else " ".join(w).capitalize() + "."

    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        lines = [line(bad and k > 0) for k in range(rng.randrange(2, 9))]
        rows.append((i, "\n".join(lines)))
        if rng.random() < 0.8:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_edges(frame, spark):
    rows, labels = corpus()
    odd = [(5000, None), (5001, ""), (None, "The river."), (5002, "\n\n\n"), (5003, "stone " * 100_000), (5004, "The river.\n" * 20_000), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (6000, 1, 0), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = Q.score(frame(rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    marked = Q.score(frame(rows[:50]), table, line_marginals=True).collect()
    assert all(len(r.line_good) == len(dict(rows)[r.doc_id].split("\n")) for r in marked)


def test_keep_good(frame, spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(rows)
    kept = Q.keep_good(docs, table)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in Q.score(docs, table).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < len(rows)


def test_without_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.score(frame([(1, "x")]), none).collect()] == [1.0]
    assert Q.score(frame([]), none).count() == 0 and Q.keep_good(frame([]), none).count() == 0
