"""Document quality from a linear-chain conditional random field that labels every line good or bad."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import trimmed
from tessera.llm.line_rules import SEPARATORS, SYMBOLS, split_words

#: Features of one line; a line's emission also sees those of the line before and the line after.
FEATURES = (
    "words", "word_length", "symbols", "doubled_marks", "capitals", "digits", "marks", "separators", "ends_sentence",
    "starts_capital", "repeats_word", "distinct_words", "short_words", "repeats_line", "long_words", "shouted_words",
)
_DOUBLED = ("!!", "??", "!?", "?!")


def line_features(line: str, words: list[str], seen: bool) -> list[float]:
    """Values of FEATURES for a line with words, each of them bounded."""
    n = len(words)
    chars = sum(map(len, words)) or 1
    last = words[-1].rstrip("\"'”’»)]")
    return [
        min(math.log1p(n) / 5, 2.0),
        min(chars / n / 10, 3.0),
        min(sum(map(line.count, SYMBOLS)) / n, 3.0),
        sum(w.endswith(_DOUBLED) for w in words) / n,
        sum(map(str.isupper, line)) / chars,
        sum(map(str.isdigit, line)) / chars,
        min(sum(map(line.count, ".,;:!?")) / n, 3.0),
        sum(w in SEPARATORS for w in words) / n,
        float(last.endswith((".", "!", "?", "…", "。"))),
        float(words[0][0].isupper()),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        float(seen),
        sum(len(w) > 20 for w in words) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
    ]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of a whole text that have words, and the lines' lengths in word characters."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = split_words(line)
        if words:
            rows.append(line_features(line, words, line in seen))
            sizes.append(sum(map(len, words)))
            seen.add(line)
    return np.array(rows, np.float32).reshape(-1, len(FEATURES)), np.array(sizes, np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before, of the line after (0 at the ends), and 1."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    before, after = np.vstack([none, x[:-1]]), np.vstack([x[1:], none])
    return np.hstack([x, before[: len(x)], after[: len(x)], np.ones((len(x), 1), x.dtype)])


@dataclass(frozen=True)
class LineCrf:
    """Two labels, 1 good and 0 bad: emission weights (score of good over bad) and log transition scores."""

    weights: np.ndarray
    transitions: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability that each line is good, by the forward-backward recursions with scaling."""
        n = len(x)
        if not n:
            return np.zeros(0)
        s = np.clip(with_neighbours(x) @ self.weights, -40, 40).tolist()
        (t00, t01), (t10, t11) = np.exp(self.transitions).tolist()
        forward = []
        a0, a1 = 0.5, 0.5 * math.exp(s[0])
        for i in range(n):
            if i:
                e = math.exp(s[i])
                a0, a1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * e
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            forward.append((a0, a1))
        out = [0.0] * n
        b0 = b1 = 1.0
        for i in range(n - 1, -1, -1):
            a0, a1 = forward[i]
            good = a1 * b1
            out[i] = good / (good + a0 * b0)
            e = math.exp(s[i])
            c0, c1 = b0, b1 * e
            b0, b1 = t00 * c0 + t01 * c1, t10 * c0 + t11 * c1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        return np.array(out)

    def score(self, x: np.ndarray, sizes: np.ndarray) -> float:
        """Quality of a document: the lines' marginals weighted by length; 0 without lines."""
        if not len(x):
            return 0.0
        return float(min(1.0, max(0.0, (self.marginals(x) @ sizes) / sizes.sum())))


def fit(docs: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.15, decay: float = 2e-3) -> LineCrf:
    """Fit by gradient ascent (Adam) on the likelihood of line labels, each line bearing its document's label.

    All documents move through the recursions together, a line at a time, longest first.
    """
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
    width = 3 * len(FEATURES) + 1
    if not docs or len({y for _, y in docs}) < 2:
        level = 4.0 if docs and docs[0][1] else -4.0
        weights = np.zeros(width)
        weights[-1] = level if docs else 0.0
        return LineCrf(weights, np.zeros((2, 2)))
    lengths = np.array([len(x) for x, _ in docs])
    label = np.array([y for _, y in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = np.vstack([with_neighbours(x) for x, _ in docs]).astype(np.float64)
    lines_label = np.repeat(label, lengths)
    weigh = np.repeat(1.0 / np.sqrt(lengths), lengths)  # a long document counts for more lines, not for all of them
    steps = [starts[: np.searchsorted(-lengths, -t, side="left")] + t for t in range(lengths[0])]
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        s = np.clip(x @ theta[:width], -40, 40)
        trans = theta[width:].reshape(2, 2)
        tm = np.exp(trans)
        emit = np.stack([np.ones_like(s), np.exp(s)], 1)
        alpha, beta = np.empty((len(x), 2)), np.ones((len(x), 2))
        for t, at in enumerate(steps):
            a = emit[at] * (0.5 if t == 0 else alpha[at - 1] @ tm)
            alpha[at] = a / a.sum(1, keepdims=True)
        for t in range(len(steps) - 1, 0, -1):
            at = steps[t]
            b = (beta[at] * emit[at]) @ tm.T
            beta[at - 1] = b / b.sum(1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        grad = np.zeros_like(theta)
        grad[:width] = x.T @ (weigh * (lines_label - gamma[:, 1]))
        expected, observed = np.zeros((2, 2)), np.zeros((2, 2))
        for t in range(1, len(steps)):
            at = steps[t]
            pair = alpha[at - 1][:, :, None] * tm[None] * (emit[at] * beta[at])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            expected += (pair * weigh[at][:, None, None]).sum(0)
            np.add.at(observed, (lines_label[at - 1], lines_label[at]), weigh[at])
        grad[width:] = (observed - expected).ravel()
        grad = grad / weigh.sum() - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return LineCrf(theta[:width], theta[width:].reshape(2, 2))


def run_of_lines(x: np.ndarray, doc_id: int, lines: int) -> np.ndarray:
    """At most lines lines in a row, from a pseudorandom place anywhere in the document."""
    start = zlib.crc32(f"lines {doc_id}".encode()) % max(1, len(x) - lines + 1)
    return x[start : start + lines]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, lines: int) -> list[tuple[np.ndarray, int]]:
    """Features of a bounded sample: the labelled documents outside the held-out fold with the least hash of doc_id.

    At most sample documents, each with at most lines lines from anywhere in it, reach the driver: numbers, not texts. Of
    rows that repeat a labelled doc_id one is used, the least by its features.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.where("doc_id is not null and quality in (0, 1)").where(fold != 2)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [run_of_lines(text_features(t.as_py() or "")[0], i.as_py(), lines) for t, i in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.record_batch(
                [batch.column(2), pa.array([r.ravel().tolist() for r in rows], pa.list_(pa.float32())), batch.column(1)], names=["doc_id", "x", "quality"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id").mapInArrow(trimmed(features), "doc_id long, x array<float>, quality int")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("one")).select("one.*")  # however often a document is there
    found = [(np.array(r["x"], np.float32).reshape(-1, len(FEATURES)), r["quality"]) for r in rows.toLocalIterator()]
    return sorted(found, key=lambda r: (len(r[0]), r[1], r[0].tobytes()))  # the same order on every run


def line_crf_quality(docs: DataFrame, labels: DataFrame, sample: int = 1500, lines: int = 128, threshold: float = 0.7) -> DataFrame:
    """Score every whole text; one row for each row of the input, in one pass without a shuffle.

    The field is fitted on the driver from a bounded sample of labelled rows (sample documents, lines lines of each)
    outside the held-out fold. Features come from lines of text alone. Null or empty text scores 0; without usable
    labels every text with lines scores 0.5. Repeated rows are scored alike; a null doc_id is in no fold; other columns,
    whatever their names, are left out; an empty table gives no rows.
    Returns doc_id, held_out, score, predicted, n_lines.
    """
    model = fit(training_rows(docs, labels, sample, lines))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, count = [], []
            for text in batch.column(2):
                x, sizes = text_features(text.as_py() or "")
                score.append(model.score(x, sizes))
                count.append(len(x))
            called = [int(s >= threshold) for s in score]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(called, pa.int32()), pa.array(count, pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_lines"],
            )

    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), held.alias("held_out"), "text").mapInArrow(
        trimmed(judge), "doc_id long, held_out boolean, score double, predicted int, n_lines long"
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 1500, lines: int = 128, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more; see line_crf_quality.

    Null or empty texts score 0, so they go; without usable labels nothing reaches the threshold but texts of a field that
    calls all lines good. Repeated rows stay or go together; doc_id may be null; an empty table gives no rows; columns may
    have any names.
    """
    model = fit(training_rows(docs, labels, sample, lines))
    place = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(*text_features(text.as_py() or "")) >= threshold for text in batch.column(place)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(trimmed(judge), docs.schema)
