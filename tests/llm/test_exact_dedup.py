import hashlib
import random

import pytest

from lonepoint.llm.exact_dedup import PatriciaTrie, exact_dedup


def brute(rows):
    groups = {}
    for doc, text in rows:
        t = text or ""
        groups.setdefault(t.translate({c: None for c in (32, 9, 10, 11, 12, 13)}), []).append((-len(t), doc is None, doc or 0, doc))
    out = []
    for doc, text in rows:
        key = (text or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        keep = min(groups[key])[3]
        out.append((doc, keep, len(groups[key]), doc == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(frame):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab é\n\t") for _ in range(rng.randrange(6)))) for i in range(400)]
    rows += [(1000, None), (None, ""), (None, "zz"), (7, "zz"), (7, "zz"), (1001, "x" * 300_000), (1002, "x" * 300_000 + " ")]
    got = exact_dedup(frame(rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_empty(frame):
    assert exact_dedup(frame([])).count() == 0


@pytest.mark.parametrize("budget", [1 << 40, 5000, 1200])
def test_trie_spills_by_subtree(budget):
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(12))) for _ in range(1500)] + [b"a" * 4000, b"a" * 4001] * 3
    trie, want = PatriciaTrie(budget), {}
    for i, k in enumerate(keys):
        trie.insert(k, [-len(k), i, 1])
        n, first = want.get(k, (0, i))
        want[k] = (n + 1, first)
    got = list(trie.items())
    assert len(got) == len(want)
    assert {k: (v[2], v[1]) for k, v in got} == want
