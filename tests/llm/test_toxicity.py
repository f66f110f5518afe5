import itertools
import random
import time
import zlib

import numpy as np
import pytest

from lonepoint.llm import toxicity as T

BAD = ["moronic", "dreadful", "wretch", "stinker", "rotter", "scumbag"]


def model(extra=()):
    rng = random.Random(1)
    plain = ["river", "stone", "walked", "house", "green", "later", "morning", "those", "when", "wait"]
    return T.trigrams([" ".join(rng.choice([*plain, *BAD, *extra]) for _ in range(4000))])


@pytest.mark.parametrize("token", ["m0r", "st1nk", "rr0ot", "s.c.u", "gre3n", "w@!t"])
def test_viterbi_against_all_paths(token):
    m = T.CharacterModel(model())
    best = None
    for path in itertools.product(*T.lattice(token)):
        text, score = "".join(x for x, _ in path), sum(c for _, c in path)
        a = b = 0
        for c in text:
            z = T._INDEX[c]
            score += m.log[a][b][z]
            a, b = b, z
        score += m.log[a][b][0]
        if best is None or score > best[0] + 1e-12:
            best = (score, text)
    assert T.decode(token, m) == best[1]


@pytest.mark.parametrize("text", ["m0r0nic", "r o t t e r", "w.r.e.t.c.h", "stiiiinker", "$cumb@g", "dre@dfu1", "scum​bag", "rоtter", "st!nker###", "y o u  w r e t c h"])
def test_disguises_are_read(text):
    s = T.Scorer(model(), {w: 5.0 for w in BAD})
    assert s.features("a house " + text + " river")[1] == 5.0
    assert s.features("a house river 12 e-mail 3.5 o'clock www")[1] == 0.0


def test_long_words_set_apart_are_read():
    word = "unausstehlichkeitsbeauftragter"
    s = T.Scorer(model((word,)), {w: 5.0 for w in [*BAD, word]})
    assert len(word) > 20
    for mark in (" ", ".", "-"):
        assert s.features("a house " + mark.join(word) + " river")[1] == 5.0


def whole(token, m):
    """Viterbi with the texts themselves as readings."""
    best = {(0, 0): (0.0, "")}
    for options in T.lattice(token):
        new = {}
        for (a, b), (score, text) in best.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for c in letters:
                    s += m.log[x][y][T._INDEX[c]]
                    x, y = y, T._INDEX[c]
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, text + letters)
        best = new
    return max(((s + m.log[x][y][0], t) for (x, y), (s, t) in best.items()), key=lambda v: v[0])[1]


@pytest.mark.parametrize("seed", range(6))
def test_long_tokens_are_read_whole(seed, monkeypatch):
    monkeypatch.setattr(T, "SETTLE", [3, 16, 50][seed % 3])
    rng = random.Random(seed)
    m = T.CharacterModel(model())
    token = "".join(rng.choice("mor0n1c.*dre@fu!w-st") for _ in range(400))
    assert T.decode(token, m) == whole(token, m)


@pytest.mark.parametrize("long", ["x" * 60 + "m0r0nic" + "x" * 60, "river" * 30 + "." + "m.0.r.0.n.i.c"])
def test_disguises_within_long_tokens(long):
    r = T.Restorer(model())
    assert any("moronic" in w for w in r.restored(long, set(T._WORD.findall(long)), frozenset(["moronic"]), [7]))


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "~", "ab" * 500_000 + "~b", "a" + "*" * 1_000_000 + "a", "a" * 1_000_000 + "@", "a." * 500_000, "é" * 1_000_000, "a!" * 50_000, "*" * 1_000_000, "9" * 1_000_000 + "a", "a b " * 100_000])
def test_time_grows_with_the_token(text):
    s = T.Scorer(model(), {w: 5.0 for w in BAD})
    begun = time.perf_counter()
    s.features(text)
    took = time.perf_counter() - begun
    assert took < 15, took


def test_all_hits_count():
    many = {f"bad{chr(97 + i // 26)}{chr(97 + i % 26)}": 3.0 for i in range(300)}
    s = T.Scorer(model(), many)
    some, more = (s.features(" ".join(list(many)[:n])) for n in (40, 300))
    assert more[0] > some[0] and more[2] > some[2]


def corpus(n=1600):
    rng = random.Random(8)
    words = [a + b for a in ("riv", "sto", "hou", "gre", "lat", "mor", "wal") for b in ("er", "ne", "se", "en", "ing", "ked")]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(frame, spark):
    rows, labels = corpus()
    odd = [(5000, None), (5001, ""), (None, "river"), (5002, "stone " * 200_000), (5003, "a1" * 50_000), (5005, "a b " * 60_000), (5004, "you w r e t c h and r0tter, sc*mbag"), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (6000, 1, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = T.score(frame(rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r.predicted for r in got}
    assert by[5004] == 1 and by[5000] == by[5001] == by[5002] == 0


def test_without_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(frame([(1, "x")]), none).collect()] == [0.0]
    assert T.score(frame([]), none).count() == 0


def test_trigram_counts():
    got = T.trigrams(["ab", "ab a"])
    at = lambda a, b, c: got[(a * T.ALPHABET + b) * T.ALPHABET + c]
    assert at(0, 1, 2) == 2 and at(1, 2, 0) == 2 and at(0, 1, 0) == 1 and np.asarray(got).sum() == len("  ab ") - 2 + len("  ab a ") - 2
