import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from lonepoint.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), PATTERN)


def test_query_digests(frame, library):
    rows = [(1, "Hello world's <|endoftext|> 123"), (2, None), (3, ""), (None, "ünï\n\n  x"), (4, "same"), (4, "same")]
    got = bpe.transcode(frame(rows), PATH, PATTERN, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded).decode() == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.transcode(frame([]), PATH, PATTERN).count() == 0


def test_decode_column(spark, frame):
    ids = bpe.transcode(frame([(1, "día"), (2, "")]), PATH, PATTERN, ("ids",))
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH, PATTERN).collect()} == {1: "día".encode(), 2: b""}


@pytest.mark.parametrize("seed", range(6))
def test_cuts_change_nothing(codec, library, monkeypatch, seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", "é", "1", " ", "  ", "\n", "'s", "'", "!", " ", "　", "中", "\x1c", "\x85", "word ", "\t"]
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "PART", 20)
    monkeypatch.setattr(bpe, "HUGE", 4)
    assert codec.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 150_000, " " * 150_000 + "x", "ab1 " * 40_000, "=" * 90_000 + "é" * 90_000, "\n" * 70_000], ids=len)
def test_long_texts(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", r"\S+\s*"])
def test_other_patterns_are_not_cut(library, monkeypatch, pattern):
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "PART", 20)
    ranks = open(PATH, "rb").read()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    text = "Ends with marks!!\n\nand 12345 more;\r\n  so  it goes...\n" * 30
    assert bpe.Codec(ranks, pattern).encode(text) == own.encode_ordinary(text)
    assert bpe.SAFE_PATTERN == PATTERN


def test_runs_beyond_the_library(codec):
    text = "x" + " " * 2_000_000 + "y"
    assert codec.decode(codec.encode(text)) == text.encode()
    assert regex.match(PATTERN, " y")
