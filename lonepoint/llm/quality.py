"""Line quality by a linear-chain conditional random field (operator 2).

Each line of a text is good or bad. A line's score is linear in its own features and those of the lines before and
after it; a matrix weighs neighbouring labels. Forward-backward gives each line's probability of being good, and
the mean of these, weighted by the lengths of the lines, gives the document's quality through a logistic regression.

Labels mark documents only. Training starts with each line labelled like its document, and then lets lines of bad
documents be good where the model is sure of it (RELABEL), as long as some line of the document stays bad. It takes
at most TRAIN_DOCS labelled rows outside the held-out part, whole texts, those with the smallest hash of the id, but those that would
take the lines of the sample beyond TRAIN_LINES. Scoring takes every line of every text. A text of very many lines is gone over by
stretches, with the forward messages kept at their edges only, so a line takes some twenty bytes of memory.

Defined results: null and empty texts are one empty line. Null labels teach nothing, a repeated label counts once, as 1
if any of its rows is; without labels of both kinds every score is 1. Repeated rows get repeated results, extra
columns are ignored, empty tables give an empty result. In a line of over a megabyte repeated words are told within each megabyte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonepoint.llm import common
from lonepoint.llm.textvec import BLOCK, Words, blocks
from lonepoint.llm.toxicity import logistic, probabilities, training_rows

TRAIN_DOCS, TRAIN_LINES, RELABEL, ROUNDS, STEPS = 6000, 150_000, 0.9, 3, 120
#: Bytes that a line counts for when texts are put together to blocks; lines from which a text is gone over by stretches; bytes of a
#: stretch; lines of a segment of a chain, and segments whose messages are computed side by side.
LINE_BYTES, LONG, STRETCH, SEGMENT, SEGMENTS = 64, 4096, 1 << 16, 256, 256

#: Classes of bytes: upper-case and lower-case letters, digits, ends of sentences, other marks of plain text, symbols, not ASCII.
_KINDS = np.full(256, 5, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".!?:", b",;'\"()-")):
    _KINDS[list(_set)] = _i
_KINDS[128:] = 6
_KINDS[[0x20, 9, 10, 11, 12, 13]] = 7
#: Steps at which a share counts as more than small, or as large.
HINGES = (0.1, 0.35)
SHARES = 12
FEATURES = 1 + 3 + SHARES * (1 + len(HINGES))


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of FEATURES numbers for each line: the constant, its length, number of words and their mean length, and shares with hinges."""
    out = np.zeros((len(lines), FEATURES), np.float32)
    for at, part in blocks(lines):
        if len(part) == 1 and len(part[0]) > BLOCK:
            out[at] = _finished(sum(_sums([x]) for x in _pieces(part[0])))[0]
        else:
            out[at : at + len(part)] = _finished(_sums(part))
    return out


def _pieces(line: bytes) -> Iterator[bytes]:
    """A long line cut at spaces where there are some, else anywhere."""
    at = 0
    while at < len(line):
        end = at + BLOCK
        if end < len(line):
            end = max(line.rfind(b" ", at + 1, end), 0) or end
        yield line[at:end]
        at = end


def _sums(lines: list[bytes]) -> np.ndarray:
    """Counts by line that add up over parts of it: bytes, words, bytes of words, bytes by kind, and words by what is told of them."""
    w = Words(lines)
    n, m = len(lines), len(w.hash)
    kind = _KINDS[w.data]
    line_of = np.repeat(np.arange(n), np.diff(w.offsets))
    table = np.bincount(line_of * 8 + kind[: len(line_of)], minlength=n * 8).reshape(n, 8)
    table[:, 7] -= 1  # the end of the line
    first, last, width = kind[w.start], kind[np.maximum(w.end - 1, 0)], w.end - w.start
    same1 = np.zeros(m, bool)
    same2 = np.zeros(m, bool)
    same1[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    same2[2:] = (w.hash[2:] == w.hash[:-2]) & (w.doc[2:] == w.doc[:-2])
    before_last = kind[np.maximum(w.end - 2, 0)]
    bang = w.data[np.maximum(w.end - 1, 0)] == ord("!")
    flags = [
        last == 5,  # words that end with a symbol
        (width == 1) & (first == 5),  # symbols alone
        bang & (width > 1),
        (last != 5) & (last < 6) & (last > 2) & (before_last > 2) & (before_last < 6) & (width > 2),  # two marks at the end
        same1,
        same2,
        (width == 1) & (first < 3),
        width > 25,
    ]
    return np.stack([np.diff(w.offsets) - 1, np.diff(w.first), np.bincount(w.doc, width, minlength=n), *table.T, *(np.bincount(w.doc[f], minlength=n) for f in flags)], 1).astype(np.float64)


def _finished(sums: np.ndarray) -> np.ndarray:
    length, words, width, table, told = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3:11], sums[:, 11:]
    size, many = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(table[:, 0] + table[:, 1] + table[:, 6], 1)
    # Upper case, digits, symbols and what isn't ASCII, and then the words.
    shares = [table[:, 0] / letters, table[:, 2] / size, table[:, 5] / size, table[:, 6] / size, *(told / many[:, None]).T]
    base = [np.ones(len(sums)), np.log1p(length) / 8, np.log1p(words) / 6, width / many / 10]
    hinged = [np.maximum(s - h, 0) for h in HINGES for s in shares]
    return np.stack([*base, *shares, *hinged], 1).astype(np.float32)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after in its text (zeros where there is none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts = first[:-1][np.diff(first) > 0]
    ends = first[1:][np.diff(first) > 0] - 1
    before[starts], after[ends] = 0, 0
    return np.concatenate([x, before, after], 1)


class Chains:
    """Lines of many texts for forward-backward: step t goes over the t-th line of all texts that have one, the longest texts first."""

    def __init__(self, first: np.ndarray):
        self.first = first
        counts = np.diff(first)
        self.order = np.argsort(-counts, kind="stable")
        self.starts = first[:-1][self.order]
        sizes = counts[self.order]
        self.active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")

    def marginals(self, unary: np.ndarray, pairs: np.ndarray, clamp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected number of each pair of neighbouring labels. unary: score of good against bad;
        pairs: 2 x 2 scores of label and next label (0 bad, 1 good); clamp: -1 free, else the label."""
        psi = np.zeros((len(unary), 2))
        psi[:, 1] = unary
        if clamp is not None:
            psi[clamp == 1, 0] = -1e9
            psi[clamp == 0, 1] = -1e9
        psi = np.exp(psi - psi.max(1, keepdims=True))
        edge = np.exp(pairs - pairs.max())
        alpha = np.zeros_like(psi)
        now = None
        for t, k in enumerate(self.active):
            rows = self.starts[:k] + t
            now = psi[rows] * (now[:k] @ edge if t else 1.0)
            now /= now.sum(1, keepdims=True)
            alpha[rows] = now
        beta = np.ones_like(psi)
        expected = np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            k = self.active[t]
            rows = self.starts[:k] + t
            message = psi[rows] * beta[rows]
            joint = alpha[rows - 1][:, :, None] * edge * message[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += joint.sum(0)
            back = message @ edge.T
            beta[rows - 1] = back / back.sum(1, keepdims=True)
        both = alpha * beta
        return both[:, 1] / both.sum(1), expected


def long_marginals(unary: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """P(good) of the lines of one chain, by stretches from its end, each with the place of its first line.

    Segments of a stretch are matrices first, all of them side by side; the messages go over these one after the other, and then over the
    lines of all segments side by side.
    """
    edge = np.exp(pairs - pairs.max())
    span, n = SEGMENT * SEGMENTS, len(unary)
    into, messages = np.ones(2), []
    for low in range(0, n, span):
        messages.append(into)
        for m in _segments(_psi(unary[low : low + span]), edge, False):
            into = into @ m
            into = into / into.sum()
    after = np.ones(2)  # the backward message to the last line of the stretch
    for k in range(len(messages) - 1, -1, -1):
        psi = _psi(unary[k * span : (k + 1) * span])
        count = (len(psi) + SEGMENT - 1) // SEGMENT
        starts, ends, now = np.ones((count, 2)), np.ones((count, 2)), messages[k]
        for i, m in enumerate(_segments(psi, edge, False)):
            starts[i] = now
            now = now @ m
            now = now / now.sum()
        for i, m in reversed(list(enumerate(_segments(psi, edge, True)))):
            ends[i] = after
            after = m @ after
            after = after / after.sum()
        padded = np.ones((count * SEGMENT, 2))
        padded[: len(psi)] = psi
        padded = padded.reshape(count, SEGMENT, 2)
        alpha, now = np.empty_like(padded), starts
        for t in range(SEGMENT):
            alpha[:, t] = now * padded[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
            now = alpha[:, t] @ edge
        beta, now = np.empty_like(padded), ends
        size = np.full(count, SEGMENT)
        size[-1] = len(psi) - (count - 1) * SEGMENT
        for t in range(SEGMENT - 1, -1, -1):
            now = np.where((t == size - 1)[:, None], ends, now)
            beta[:, t] = now
            now = (now * padded[:, t]) @ edge.T
            now = now / now.sum(1, keepdims=True)
        both = (alpha * beta).reshape(-1, 2)[: len(psi)]
        yield k * span, both[:, 1] / both.sum(1)


def _psi(unary: np.ndarray) -> np.ndarray:
    psi = np.zeros((len(unary), 2))
    psi[:, 1] = unary
    return np.exp(psi - psi.max(1, keepdims=True))


def _segments(psi: np.ndarray, edge: np.ndarray, back: bool) -> np.ndarray:
    """The matrix of each segment: from the message to its first line to that beyond its last; back: from the backward message to its last line
    to that to the last line before it."""
    count = (len(psi) + SEGMENT - 1) // SEGMENT
    out = np.repeat(np.eye(2)[None], count, 0)
    for t in range(SEGMENT):
        rows = psi[t::SEGMENT]
        k = len(rows)
        step = (out[:k] @ edge) * rows[:, None, :] if back else (out[:k] * rows[:, None, :]) @ edge
        out[:k] = step / step.sum((1, 2), keepdims=True)
    return out


class Field:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray, mean: np.ndarray, dev: np.ndarray):
        self.weights, self.pairs, self.mean, self.dev = weights, pairs, mean, dev

    def unary(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of each line from the features of the lines alone: a line adds to its own, and to those next to it in its text."""
        own, before, after, constant = self.projected(x)
        out = own + constant
        inside = np.ones(len(x), bool)
        inside[first[:-1][np.diff(first) > 0]] = False
        rows = np.flatnonzero(inside)
        out[rows] += before[rows - 1]
        out[rows - 1] += after[rows]
        return out

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """What each line adds to its own score, to the next line's and to the last line's; and what all lines have."""
        scaled = self.weights / self.dev
        by = scaled.reshape(3, -1)
        own, before, after = (x @ by.T).T
        return own, before, after, float(-(self.mean * scaled).sum())

    @classmethod
    def fit(cls, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Field:
        """Maximum conditional likelihood by gradient steps with momentum (Adam); y: a label for each line. x: features with neighbours."""
        mean, dev = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        mean[0], dev[0] = 0, 1
        z = ((x - mean.astype(np.float32)) / dev.astype(np.float32)).astype(np.float32)
        out, chains = cls(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, dev), Chains(first)
        inside = np.ones(len(y), bool)
        inside[first[:-1][np.diff(first) > 0]] = False
        seen = np.zeros((2, 2))
        rows = np.flatnonzero(inside)
        np.add.at(seen, (y[rows - 1], y[rows]), 1)
        theta, n = np.zeros(x.shape[1] + 4), max(1, len(y))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            p, expected = chains.marginals((z @ theta[:-4].astype(np.float32)).astype(np.float64), theta[-4:].reshape(2, 2))
            grad = np.concatenate([(z.T @ (y - p).astype(np.float32)).astype(np.float64), (seen - expected).ravel()]) / n - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        out.weights, out.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        return out

    def good(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """x: features of the lines alone."""
        return Chains(first).marginals(self.unary(x, first), self.pairs)[0]


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def document_features(p: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text: the weighted mean of P(good), its log odds and the share of the length that lies in lines likely bad."""
    which = np.repeat(np.arange(len(first) - 1), np.diff(first))
    weight = lengths + 1.0
    total = np.maximum(np.bincount(which, weight, minlength=len(first) - 1), 1e-9)
    mean = np.bincount(which, weight * p, minlength=len(first) - 1) / total
    bad = np.bincount(which, weight * (p < 0.5), minlength=len(first) - 1) / total
    return _document_rows(mean, bad)


def _document_rows(mean: np.ndarray, bad: np.ndarray) -> np.ndarray:
    clipped = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([mean, np.log(clipped / (1 - clipped)), bad], 1)


def _lined(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All lines, and the place of each text's first."""
    lines, first = [], [0]
    for t in texts:
        lines += split_lines(t)
        first.append(len(lines))
    return lines, np.array(first)


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, those of about STRETCH bytes at a time."""
    at, n = 0, len(text)
    while True:
        cut = n if at + STRETCH >= n else text.rfind(b"\n", at, at + STRETCH)
        if cut < 0:
            cut = text.find(b"\n", at)
            cut = n if cut < 0 else cut
        yield split_lines(text[at:cut])
        if cut >= n:
            return
        at = cut + 1


def text_blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts whose bytes and lines are bounded, with the place of the first. A larger text comes alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        cost = len(t) + LINE_BYTES * (t.count(b"\n") + 1)
        if held and held + cost > BLOCK:
            yield start, texts[start:i]
            start, held = i, 0
        held += cost
    if start < len(texts):
        yield start, texts[start:]


class Model:
    """The field and the regression that turns its marginals into a document's score."""

    def __init__(self, field: Field | None = None, regression=None):
        self.field, self.regression = field, regression

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The score of each text of a block, and P(good) of each of its lines."""
        if self.field is None:
            return np.ones(len(texts)), [np.ones(t.count(b"\n") + 1) for t in texts]
        if len(texts) == 1 and texts[0].count(b"\n") >= LONG:
            return self._long(texts[0])
        lines, first = _lined(texts)
        p = self.field.good(line_features(lines), first)
        lengths = np.fromiter((len(x) for x in lines), float, len(lines))
        return probabilities(document_features(p, lengths, first), self.regression), np.split(p, first[1:-1])

    def _long(self, text: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        unary, lengths, last = [], [], 0.0
        for lines in stretches(text):
            own, before, after, constant = self.field.projected(line_features(lines))
            u = own.astype(np.float64) + constant
            u[1:] += before[:-1]
            u[:-1] += after[1:]
            if unary:
                u[0] += last
                unary[-1][-1] += after[0]
            last = before[-1]
            unary.append(u)
            lengths.append(np.fromiter((len(x) for x in lines), np.int32, len(lines)))
        size, whole = np.concatenate(lengths), np.concatenate(unary)
        del unary, lengths
        p = np.empty(len(size), np.float32)
        total = mean = bad = 0.0
        for at, part in long_marginals(whole, self.field.pairs):
            weight = size[at : at + len(part)] + 1.0
            total, mean, bad = total + weight.sum(), mean + (weight * part).sum(), bad + weight[part < 0.5].sum()
            p[at : at + len(part)] = part
        return probabilities(_document_rows(np.array([mean / total]), np.array([bad / total])), self.regression), [p]

    @classmethod
    def fit(cls, features: list[np.ndarray], lengths: list[np.ndarray], y: np.ndarray) -> Model:
        """features: of the lines of each text."""
        if not len(y) or y.min() == y.max():
            return cls()
        first = np.concatenate([[0], np.cumsum([len(f) for f in features])])
        alone = np.concatenate(features)
        x = with_neighbours(alone, first)
        size = np.concatenate(lengths).astype(float)
        which = np.repeat(np.arange(len(y)), np.diff(first))
        labels = y[which]
        for k in range(ROUNDS):
            field = Field.fit(x, first, labels)
            p = field.good(alone, first)
            if k + 1 < ROUNDS:
                labels = np.where((y[which] == 0) & (p < RELABEL), 0, 1)
                # A bad document keeps its worst lines bad.
                worst = np.full(len(y), 2.0)
                np.minimum.at(worst, which, p)
                labels[(y[which] == 0) & (p <= worst[which])] = 0
        return cls(field, logistic(document_features(p, size, first), y.astype(float)))


def _training(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = split_lines(raw or b"")
            x = line_features(lines)
            n = np.array([len(v) for v in lines], np.int32)
            yield pa.record_batch([pa.array([y], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["y", "x", "n"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Model:
    """The driver gets the features of at most `most` documents with at most most_lines lines together."""
    spark = docs.sparkSession
    common.prepare(spark)
    sample = common.stored(training_rows(labels, "quality", most, id_col), "sample", narrow=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    # Ids should be unique; where they repeat with other texts there may be more rows than `most`.
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = rows.groupBy("h").agg(F.min(lines).alias("lines")).orderBy("h").limit(most).collect()
    chosen, held = [], 0
    for r in sorted(sizes, key=lambda r: r.h):
        if held + r.lines <= most_lines:
            chosen.append((r.h,))
            held += r.lines
    keys = spark.createDataFrame(chosen, "h long")
    got = rows.join(F.broadcast(keys), "h").dropDuplicates(["h"]).select("text", "y").mapInArrow(_training, "y int, x binary, n binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.x)))
    features = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, FEATURES) for r in got]
    return Model.fit(features, [np.frombuffer(bytes(r.n), np.int32) for r in got], np.array([r.y for r in got], np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = (), model: Model | None = None, line_marginals: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted and the columns in keep; with line_marginals also P(good) of each line."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model or train(docs, labels, id_col, text_col))
    inner = docs.select(common.text_of(docs, text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    kinds = dict(inner.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            for at, part in text_blocks(texts):
                s, p = shared.value.scores(part)
                extra = [pa.array([x.tolist() for x in p], pa.list_(pa.float64()))] if line_marginals else []
                own = batch.slice(at, len(part))
                yield pa.record_batch([*own.columns[1:], pa.array(s, pa.float64()), *extra], names=[*own.schema.names[1:], "score", *["line_good"] * line_marginals])

    fields = [f"{c} {kinds[c]}" for c in inner.columns[1:]] + ["score double"] + ["line_good array<double>"] * line_marginals
    out = inner.mapInArrow(run, ", ".join(fields))
    return out.select(
        "doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        *["line_good"] * line_marginals, *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are predicted good, with their columns as they are."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            good = np.concatenate([np.zeros(0), *(shared.value.scores(part)[0] for _, part in text_blocks(texts))]) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
