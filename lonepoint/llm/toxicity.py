"""Toxicity with noisy-channel deobfuscation (operator 8).

Words that may be disguised (letters mixed with digits or symbols, letters set apart, letters repeated, look-alike
letters of other scripts) are read as character lattices: each character offers the letters that it can stand for,
separators may vanish, and a run of one letter may be one or two. Viterbi decoding finds the likeliest path under a
character trigram model with the channel's costs. The words of the restored text and their beginnings (languages that
inflect and compound have many words of one stem), together with the plain ones, are scored by the log odds of their
presence in toxic against other documents, and a logistic regression over these scores gives the probability.

The character model counts trigrams over all documents; the driver gets at most ALPHABET^3 sums. Words that tell toxic
documents weigh in it with LEXICON_SHARE, so that the model knows what disguises tend to hide. Labels come from at most
TRAIN_DOCS labelled rows outside the held-out part, those with the smallest hash of the id, which bounds the lexicon: its entries are in
MIN_DOCS toxic documents of these or more. The regression is fitted to scores by the lexicons of the other half of them. Scoring has no
bounds: tokens of any length are decoded whole, in time that grows with them, and all entries of a text count.

Defined results: null and empty texts have no words and get the score of a text without any; null labels and ids
without a document teach nothing, a repeated label counts once, as toxic if any of its rows is; repeated rows get
repeated results. Without labels of both kinds all scores are 0. Extra columns are ignored. Empty tables give an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common

TRAIN_DOCS, MIN_DOCS, MIN_ODDS, LEXICON_SHARE = 30_000, 4, 1.5, 0.2

# Letters of the character model; whatever else ends a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
ALPHABET = len(LETTERS) + 1
# What characters stand for in disguised words.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "§": "s", "#": "h", "%": "o", "&": "a", "?": "aeiou",
    "*": "aeiourstnl", "^": "a", "¢": "c", "×": "x", "ø": "o",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ο": "o", "ι": "i", "ε": "e", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
}
MARKS = ".,;:!?\"'()"
SEPARATORS = " .-_*~'’·,/\\­"

#: Lengths of the beginnings of words that count as words of their own, marked by a hyphen.
STEMS = (3, 4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.escape("".join(c for c in STANDS_FOR if not c.isalpha()))
#: Runs of letters and symbols, of which those with both are words with something that stands for a letter; possessive, so that no run is read twice.
_RUN = re.compile(rf"(?:[^\W\d_]|[{_SYMBOLS}])++")
_LETTER, _SYMBOL = re.compile(r"[^\W\d_]"), re.compile(rf"[{_SYMBOLS}]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[ .\-_*~'·,/]{1,2}(?:[^\W_]|[@$!|])){2,}(?![^\W_])")
_THRICE = re.compile(r"(\w)\1\1")
_JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[.\-_*~·­​-‍⁠﻿]++[^\W\d_]++)++")
_FOREIGN = re.compile(r"[а-яіѕјα-ω]")
_EDGES = "*#%&$!|+"
_UNSEEN = re.compile("[­​-‏⁠﻿]")
#: Decoded disguises that a worker remembers, and their length at most.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 100

_CLASS = np.zeros(0x250, np.int32)
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _i + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}


def trigrams(texts: Iterable[str]) -> np.ndarray:
    """Counts of letter trigrams by their index in the alphabet, over word boundaries (0)."""
    total = np.zeros(ALPHABET**3, np.int64)
    for text in texts:
        points = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _CLASS[np.where(points < len(_CLASS), points, 0)]
        total += np.bincount(kind[:-2] * (ALPHABET * ALPHABET) + kind[1:-1] * ALPHABET + kind[2:], minlength=ALPHABET**3)
    return total


class CharacterModel:
    """log P(character | the two before), interpolated with the shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        c[:, 0, 0] = 0  # between words there is nothing to predict
        uni = c.sum((0, 1)) + 1
        bi = c.sum(0) + 0.1
        tri = c + 0.01
        p = 0.75 * tri / tri.sum(2, keepdims=True) + 0.2 * (bi / bi.sum(1, keepdims=True))[None] + 0.05 * (uni / uni.sum())
        self.log = np.log(p).tolist()


#: Costs of the channel, as log probabilities: a stand-in for a letter, a sign that stays out, a vanished separator, a letter kept once or twice of a longer run.
STAND_IN, DROPPED, SEPARATOR, ONCE, TWICE = -1.0, -3.0, -0.2, -0.3, -1.0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each stretch of the token what it may be (a string of letters, empty if it vanishes) and the cost."""
    out, i, n = [], 0, len(token)
    while i < n:
        c, j = token[i], i + 1
        while j < n and token[j] == c:
            j += 1
        run = j - i
        options: dict[str, float] = {}

        def add(text: str, cost: float, options=options) -> None:
            options[text] = max(cost, options.get(text, -math.inf))

        stands = STANDS_FOR.get(c, "")
        letters = [(c, 0.0)] if c in _INDEX else []
        letters += [(x, STAND_IN - (math.log(len(stands)) if len(stands) > 2 else 0)) for x in stands]
        for x, cost in letters:
            if run == 1:
                add(x, cost)
            else:
                add(x, cost + (ONCE if run > 2 else 2 * ONCE - 1))
                add(x + x, cost * 2 + (TWICE if run > 2 else 0.0))
        if c in SEPARATORS:
            add("", SEPARATOR * run)
        elif not letters or c in STANDS_FOR and not c.isalpha():
            add("", DROPPED * min(run, 3))
        out.append(list(options.items()))
        i = j
    return out


#: Steps after which the readings that are left are looked through for what they share.
SETTLE = 256


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest reading of the token's lattice, from a word's begin to its end; of equal ones the first found.

    Readings are chains of (the chain before, letters). What all that are left share is settled every so many steps, so a token of
    any length needs little memory beside its own.
    """
    log = model.log
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    settled: list[str] = []
    for step, options in enumerate(lattice(token), 1):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in best.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for c in letters:
                    z = _INDEX[c]
                    s += log[x][y][z]
                    x, y = y, z
                old = new.get((x, y))
                if old is None or s > old[0]:
                    new[x, y] = (s, (chain, letters) if letters else chain)
        best = new
        if step % SETTLE == 0:
            best = _settle(best, settled)
    if not best:
        return ""
    (_, _), (_, chain) = max(best.items(), key=lambda v: v[1][0] + log[v[0][0]][v[0][1]][0])
    return "".join([*settled, *_letters(chain)])


def _letters(chain: tuple | None) -> list[str]:
    out = []
    while chain is not None:
        chain, letters = chain
        out.append(letters)
    return out[::-1]


def _settle(best: dict, settled: list[str]) -> dict:
    """Move what all chains begin with to settled. Scores only count against each other, so they begin anew from 0."""
    chains = {k: _links(chain) for k, (_, chain) in best.items()}
    some = next(iter(chains.values()))
    same = min(map(len, chains.values()))
    while same and any(c[same - 1] is not some[same - 1] for c in chains.values()):
        same -= 1
    settled += [x[1] for x in some[:same]]
    top = max(score for score, _ in best.values())
    out = {}
    rebuilt: dict[int, tuple] = {}
    for k, (score, _) in best.items():
        chain = None
        for link in chains[k][same:]:
            # Links that chains share stay shared.
            chain = rebuilt.setdefault(id(link), (chain, link[1]))
        out[k] = (score - top, chain)
    return out


def _links(chain: tuple | None) -> list[tuple]:
    out = []
    while chain is not None:
        out.append(chain)
        chain = chain[0]
    return out[::-1]


def mixed(text: str) -> Iterator[str]:
    """Runs of letters and of symbols that stand for letters, with both in them."""
    for m in _RUN.finditer(text):
        token = m.group()
        if _SYMBOL.search(token) and _LETTER.search(token):
            yield token


def cut_edges(token: str) -> str:
    """Without runs of three or more of one symbol at its ends."""
    while token and (c := token[0]) in _EDGES and token.startswith(c * 3):
        token = token.lstrip(c)
    while token and (c := token[-1]) in _EDGES and token.endswith(c * 3):
        token = token.rstrip(c)
    return token


class Restorer:
    def __init__(self, counts: np.ndarray):
        self.model, self.seen = CharacterModel(counts), {}

    def read(self, token: str) -> str:
        if len(token) > LONGEST_REMEMBERED:
            return decode(token, self.model)
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            got = self.seen[token] = decode(token, self.model)
        return got

    def restored(self, text: str, words: set[str], known: frozenset[str], lengths: list[int]) -> set[str]:
        """What the disguised words of a lower-case text read; words: the plain ones. Of letters set apart only known words, of these lengths, count."""
        out = set()
        if _UNSEEN.search(text):
            out.update(_WORD.findall(_UNSEEN.sub("", text)))
        # Most tokens are plain words with a mark or two at the ends, which no pattern needs to look at.
        odd = "\n".join(t for t in set(text.split()) if not t.strip(MARKS).isalpha())
        found = {*mixed(odd), *(m.group() for m in _JOINED.finditer(odd))} if odd else set()
        if _THRICE.search(text):
            found.update(w for w in words if _THRICE.search(w))
        if _FOREIGN.search(text):
            found.update(w for w in words if _FOREIGN.search(w))
        for token in found:
            token = cut_edges(token)
            if len(token) > 2 and not token.isdigit() and not (token.isalpha() and token.isascii() and not _THRICE.search(token)):
                out.add(self.read(token))
        for token in {m.group() for m in _APART.finditer(text)}:
            whole = self.read(token)
            # Several words set apart, one after the other, read as one: each stretch of it may be a word.
            out.update(known.intersection(whole[i : i + n] for n in lengths for i in range(len(whole) - n + 1)))
        return out


def entries(words: set[str]) -> set[str]:
    """The words and their beginnings."""
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


class Scorer:
    """lexicon: word to log odds. features(): of the words that a text has, plain and restored."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float]):
        self.restorer, self.lexicon, self.known = Restorer(counts), lexicon, frozenset(lexicon)
        self.lengths = sorted({len(w) for w in lexicon if len(w) > 2 and w[-1] != "-"})
        self.stems = [(n, frozenset(w[:-1] for w in lexicon if len(w) == n + 1 and w[-1] == "-")) for n in STEMS]

    def hits(self, words: set[str]) -> set[str]:
        """The entries of these words that the lexicon has."""
        out = words & self.known
        for n, stems in self.stems:
            if stems:
                out.update([w + "-" for w in {w[:n] for w in words if len(w) > n} & stems])
        return out

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = set(_WORD.findall(low))
        hits = self.hits(words)
        extra = self.hits(self.restorer.restored(low, words, self.known, self.lengths)) - hits if self.known else ()
        odds = sorted((self.lexicon[w] for w in (*hits, *extra)), reverse=True)
        size = math.log1p(len(words))
        return [math.log1p(sum(odds)), odds[0] if odds else 0.0, math.log1p(len(odds)), len(odds) / (1 + size), size, sum(odds) / math.sqrt(1 + len(words))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and coefficients (the last for the constant) by Newton's method."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return mean, dev, w


def probabilities(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, dev, w = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / dev, np.ones(len(x))] @ w, -30, 30)))


def training_rows(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id and y of at most `most` labelled rows that are not held out, by the hash of the id; bounded, so it may be broadcast."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _trigram_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        total += trigrams(x or "" for x in batch.column(0).to_pylist())
    cells = np.flatnonzero(total)
    yield pa.record_batch([pa.array(cells.astype(np.int64)), pa.array(total[cells])], names=["cell", "n"])


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lexicon entries with the number of documents that have them, by label and half; joined within the task as far as memory allows."""

    def dealt(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = zip(*counts.values(), strict=True) if counts else [[]] * 4
        return pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns)], names=["word", *FOLDS])

    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for w in (*entries(set(_WORD.findall((text or "").lower()))), ""):
                counts.setdefault(w, [0] * 4)[2 * half + y] += 1
            if len(counts) > 200_000:
                yield dealt(counts)
                counts = {}
    yield dealt(counts)


#: Columns of counts: other and toxic documents of the first half and of the second.
FOLDS = ("n0a", "n1a", "n0b", "n1b")


def _lexicon(table: DataFrame, folds: tuple[str, ...]) -> dict[str, float]:
    """The entries that tell toxic documents of these halves, with their log odds."""
    n0, n1 = (sum((F.col(f"n{y}{k}") for k in folds[1:]), F.col(f"n{y}{folds[0]}")) for y in (0, 1))
    base = table.filter("word = ''").select(n0.alias("d0"), n1.alias("d1")).collect()
    if not base or not base[0].d0 or not base[0].d1:
        return {}
    odds = F.log((n1 + 0.5) / (base[0].d1 - n1 + 0.5)) - F.log((n0 + 0.5) / (base[0].d0 - n0 + 0.5))
    known = table.filter(F.col("word") != "").select("word", odds.alias("odds"), n1.alias("n1"))
    telling = known.filter((F.col("odds") >= MIN_ODDS) & (F.col("n1") >= MIN_DOCS))
    return {r.word: r.odds for r in telling.collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS):
    """The scorer's parts (trigram counts, lexicon) and the regression, or None for it without labels of both kinds."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text"))
    cells = texts.select("text").mapInArrow(_trigram_rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3, np.int64)
    counts[[r.cell for r in cells]] = [r.n for r in cells]

    sample = common.stored(training_rows(labels, "toxic", most, id_col), "sample", narrow=True)
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int")
    labelled = texts.join(F.broadcast(sample), "doc_id").select("text", "y", half.alias("half"))
    words = labelled.mapInArrow(_word_rows, "word string, " + ", ".join(f"{c} long" for c in FOLDS))
    table = words.groupBy("word").agg(*(F.sum(c).alias(c) for c in FOLDS)).filter((F.col("n1a") + F.col("n1b") >= MIN_DOCS) | (F.col("word") == ""))
    table = common.stored(table, "words", narrow=True)
    lexicon = _lexicon(table, ("a", "b"))
    if not lexicon:
        common.discard(table)
        return counts, {}, None
    # The words that tell toxic documents take part in the character model.
    told = trigrams([" ".join(w for w in sorted(lexicon) if w[-1] != "-" for _ in range(1 + int(4 * lexicon[w])))])
    told[0] = 0
    counts = counts + (told * (LEXICON_SHARE * counts.sum() / max(1, told.sum()))).astype(np.int64)

    rows = []
    for other, k in (("b", 0), ("a", 1)):
        parts = spark.sparkContext.broadcast((counts, _lexicon(table, (other,))))
        rows += _scored(labelled.filter(F.col("half") == k).select("y", "text"), parts, "y int").collect()
    common.discard(table)
    x, y = np.array([r.x for r in rows], float).reshape(len(rows), -1), np.array([r.y for r in rows], float)
    return counts, lexicon, logistic(x, y) if 0 < y.sum() < len(y) else None


_last: tuple = (None, None)  # what the worker's scorer was made of, and the scorer


def _scorer(parts: tuple) -> Scorer:
    global _last
    if _last[0] is not parts:
        _last = (parts, Scorer(*parts))
    return _last[1]


def _scored(df: DataFrame, parts, first: str) -> DataFrame:
    """The first column of df and x, the features of the second."""
    name = first.split()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(parts.value)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[name, "x"])

    return df.mapInArrow(run, f"{first}, x array<double>")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score and predicted."""
    counts, lexicon, model = train(docs, labels, id_col, text_col, most)
    parts = docs.sparkSession.sparkContext.broadcast((counts, lexicon))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text"))
    found = _scored(texts, parts, "doc_id long")
    if model is None:
        p = F.lit(0.0)
    else:
        mean, dev, w = (v.tolist() for v in model)
        z = F.lit(w[-1])
        for i in range(len(mean)):
            z = z + (F.col("x")[i] - mean[i]) / dev[i] * w[i]
        p = 1 / (1 + F.exp(-z))
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
