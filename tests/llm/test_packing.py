import random

import numpy as np
import public_tokenizers
import pytest

from lonepoint.llm import bpe, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing_against_a_plain_search(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 101) for _ in range(400)]
    got = packing.best_fit_decreasing(sizes, 100)
    assert sorted(i for b in got for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 100 for b in got)
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= size]
        if fits:
            room[room.index(min(fits))] -= size
        else:
            room.append(100 - size)
    assert sorted(100 - sum(sizes[i] for i in b) for b in got) == sorted(room)


def test_round_trip(frame):
    codec = bpe.Codec(open(PATH, "rb").read(), PATTERN)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "é"]) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows += [(500, "long " * 5000), (501, None), (502, ""), (None, "no id"), (3, rows[3][1])]
    got = [r.asDict() for r in packing.pack(frame(rows), PATH, PATTERN, 50256, parts=4, length=64).collect()]
    pieces = {}
    for m in sorted(got, key=lambda m: (m["part"], m["matrix"])):
        at = np.frombuffer(bytes(m["positions"]), packing.position_kind(64)).reshape(m["n_rows"], 64)
        for row, cu in zip(at, m["cu_seqlens"], strict=True):
            for a, b in zip(cu[:-1], cu[1:], strict=True):
                assert row[a:b].tolist() == list(range(b - a))
        for doc, k, ids in packing.unpack(m):
            pieces.setdefault(doc, []).append((k, ids.tolist()))
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append(codec.encode(text or "") + [50256])
    for doc, texts in want.items():
        parts = sorted(pieces[doc], key=lambda x: x[0])
        assert [k for k, _ in parts] == sorted(k for t in texts for k in range(-(-len(t) // 64)))
        if len(texts) == 1:
            assert [i for _, p in parts for i in p] == texts[0]
        else:
            assert sum(len(p) for _, p in parts) == sum(map(len, texts))
    total = sum(len(t) for ts in want.values() for t in ts)
    assert sum(m["n_tokens"] for m in got) == total and total / 64 / sum(m["n_rows"] for m in got) > 0.85
    assert packing.pack(frame([]), PATH, PATTERN, None).count() == 0


def test_a_row_that_very_many_repeat_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "REPEATED", 100)
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, -5, id) AS doc_id", "if(id % 3 = 0, 'again and again', concat('text ', id)) AS text")
    got = packing.pack(docs, PATH, PATTERN, 50256, parts=8, length=64).select("part", "doc_ids").collect()
    per = {}
    for m in got:
        per[m.part] = per.get(m.part, 0) + sum(d.count(-5) for d in m.doc_ids)
    assert sum(per.values()) == 1000 and max(per.values()) < 250
    assert sum(len(d) for m in got for d in m.doc_ids) == 3000
