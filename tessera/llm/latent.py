"""Benchmark decontamination: cosine search in a latent space, probed through rare words, then subsequence and answer checks."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import trimmed
from tessera.llm.partenum import mixed

#: Bytes that separate words, and bytes of marks that do not tell words apart (fixed values).
SPACE = b" \t\n\v\f\r"
MARKS = b".,;:!?\"'()[]"

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes:
    """64-bit hashes of the words of a text, in lower case and without marks, by whole-array arithmetic.

    A word's hash is the polynomial of its bytes in an odd base modulo 2**64, from differences of one running sum, mixed.
    """

    def __init__(self) -> None:
        self.space, self.value = np.zeros(256, bool), np.arange(1, 257, dtype=np.uint64)
        self.space[list(SPACE)] = True
        self.value[[*SPACE, *MARKS]] = 0
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 16)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE, np.uint64)], dtype=np.uint64)

    def of(self, text: str | None, piece: int = 1 << 20) -> np.ndarray:
        """Hashes in order. A very long text goes through in pieces that end between words."""
        raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        found, start = [], 0
        while start < len(raw):
            end = min(len(raw), start + piece)
            while end < len(raw) and not self.space[raw[end]]:
                end += 1
            found.append(self._piece(raw[start:end]))
            start = end
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def _piece(self, raw: np.ndarray) -> np.ndarray:
        gap = self.space[raw]
        edges = np.flatnonzero(np.diff(np.r_[True, gap, True]))
        first, last = edges[::2], edges[1::2]
        value = self.value[raw]
        kept = np.r_[0, np.cumsum(value != 0)]
        self._reach(int(kept[-1]))
        sums = np.r_[np.uint64(0), np.cumsum(value * self.powers[kept[:-1]], dtype=np.uint64)]
        return mixed((sums[last] - sums[first]) * self.inverses[kept[first]])


def passage_sketch(docs: DataFrame, probe: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of features in all documents, and (A' A) probe for A the counts by passage of passage words.

    One pass. Tasks add up their passages' part; rows of the result (features, not documents) are summed by Spark.
    """
    size, rank = probe.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, counts = WordHashes(), np.zeros((size, rank)), np.zeros(size, np.int64)
        held, at, single = [], 0, probe.astype(np.float32)

        def add() -> None:
            a = np.bincount(np.concatenate(held), minlength=at * size).reshape(at, size).astype(np.float32)
            counts[:] += a.sum(axis=0, dtype=np.float64).astype(np.int64)
            total[:] += a.T @ (a @ single)

        for batch in batches:
            for text in (x.as_py() for x in batch.column(0)):
                ids = (hashes.of(text) % np.uint64(size)).astype(np.int64)
                for start in range(0, len(ids), passage * 256):
                    some = ids[start : start + passage * 256]
                    held.append((np.arange(len(some)) // passage + at) * size + some)
                    at += -(-len(some) // passage)
                    if at >= 256:
                        add()
                        held, at = [], 0
        if at:
            add()
        some = np.flatnonzero(counts)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * rank), pa.array(total[some].ravel()))
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some]), rows], names=["feature", "n", "z"])

    parts = docs.select("text").mapInArrow(trimmed(part), "feature int, n long, z array<double>")
    sums = [F.sum(F.get("z", F.lit(i))) for i in range(rank)]
    counts, sketch = np.zeros(size, np.int64), np.zeros((size, rank))
    for row in parts.groupBy("feature").agg(F.sum("n").alias("n"), F.array(*sums).alias("z")).collect():
        counts[row["feature"]], sketch[row["feature"]] = row["n"], row["z"]
    return counts, sketch


def latent_space(docs: DataFrame, size: int, rank: int, passage: int, seed: int) -> np.ndarray:
    """Feature vectors alone; see fitted_space."""
    return fitted_space(docs, size, rank, passage, seed)[0]


def fitted_space(docs: DataFrame, size: int, rank: int, passage: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of features (second), and feature vectors in the latent space of all passages: randomised SVD of their TF-IDF matrix.

    With counts A and IDF weights D the matrix is A D. One pass gives A' A Q for Gaussian Q, and so the sketch
    Z = (D A' A D) P of its Gram matrix for the probe P = D^-1 Q. The Gram matrix is about Z (P' Z)^-1 Z' (Nystrom), whose
    eigenvectors and values are the right singular vectors and squared singular values of A D. Coordinates are divided
    by singular values, so that what all passages have in common does not make all of them alike. Rows carry D.
    """
    probe = np.random.default_rng(seed).standard_normal((size, rank))
    counts, sketch = passage_sketch(docs, probe, passage)
    weight = np.log((counts.sum() + 1.0) / (counts + 1.0))
    weight = np.maximum(np.where(counts > 0, weight, weight.max(initial=0.0)), 1e-3)
    sketch = sketch * weight[:, None]
    core = (probe / weight[:, None]).T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(initial=0.0) * 1e-9, 1e-12)
    if not keep.any():
        return np.zeros((size, rank)), counts
    root = sketch @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    return u / np.maximum(s, s.max() * 1e-6) * weight[:, None], counts


def best_window(ids: np.ndarray, space: np.ndarray, width: int, vectors: np.ndarray) -> tuple[float, int]:
    """The highest cosine of a window of width words with any of the unit vectors, and its start; every window counts."""
    sums = np.cumsum(space[ids], axis=0)
    width = min(width, len(ids))
    views = sums[width - 1 :].copy()
    views[1:] -= sums[:-width]
    norm = np.sqrt(np.maximum(np.einsum("ij,ij->i", views, views), 1e-24))
    close = (views @ vectors.T).max(axis=1) / norm
    start = int(close.argmax())
    return min(1.0, float(close[start])), start


def common_subsequence(item: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: item maps each of its words to the bits of its places."""
    row = 0
    for w in words:
        x = item.get(w)
        if x:
            y = row | x
            row = y & ((y - ((row << 1) | 1)) ^ y)
        # a word that the item lacks leaves the row as it is
    return row.bit_count()


@dataclass
class Item:
    """A benchmark item, ready to be looked for."""

    item_id: int
    length: int
    places: dict[int, int]
    answer: set[int]
    vectors: np.ndarray
    exact: bool  # too short to be told apart from chance: found word for word only


def prepared(items: list[tuple[int, str]], space: np.ndarray, width: int, stride: int, least: int, answers: int) -> list[Item]:
    hashes, out = WordHashes(), []
    heavy = np.linalg.norm(space, axis=1)
    for item_id, text in sorted(items, key=lambda i: (i[0] is None, i[0] or 0, i[1] or "")):
        words = hashes.of(text)
        if not len(words):
            continue
        ids = (words % np.uint64(len(space))).astype(np.int64)
        exact = words.tolist()
        places: dict[int, int] = {}
        for i, w in enumerate(exact):
            places[w] = places.get(w, 0) | 1 << i
        weights: dict[int, float] = {}
        for w, f in zip(exact, ids.tolist(), strict=True):
            weights[w] = float(heavy[f])
        rare = sorted(weights, key=lambda w: (-weights[w], w))[:answers]
        views = [ids[a : a + width] for a in range(0, max(1, len(ids) - width + 1), stride)]
        if len(ids) > width:
            views.append(ids[-width:])
        sums = np.stack([space[v].sum(axis=0) for v in views])
        vectors = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        out.append(Item(item_id, len(words), places, set(rare), vectors.astype(np.float32), len(words) < least))
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 2048,
    rank: int = 64,
    passage: int = 128,
    width: int = 24,
    stride: int = 12,
    cosine: float = 0.25,
    common: float = 0.6,
    answers: int = 8,
    answered: float = 0.5,
    least: int = 8,
    chunk: int = 5000,
    seed: int = 5,
) -> DataFrame:
    """Benchmark items that documents contain, word for word or paraphrased: one row for each document and item.

    1. Passages of all documents make a TF-IDF matrix over hashed words (size features); a distributed randomised SVD
       of it gives a latent space of rank dimensions. Counts and sketch cover every word of every document.
    2. Candidates. The space is searched where an index of items leads: the rarest words of every item, more of them than a
       leak may lack (a share of 1 - common of the item's places), so each stretch of a document that could hold a leak is
       probed, and hardly any other. In a probed stretch every window of width words (of the item's length, if that is
       less) is compared with the item's own windows (one each stride words); the stretch is a candidate from a cosine of
       cosine on. Items are a stated query set, in chunks of at most chunk items, which is what a task holds of them;
       documents are never compared with each other, nor shuffled. The work grows with the words that documents and items
       share, not with documents times items.
    3. A candidate is a leak if some stretch of width words and twice the item's length has both at least answered of the
       answer (the item's answers words of the greatest weight in the latent space) and a longest common subsequence with
       the item's words of at least common of the item. Stretches from every word of the item are tried.
    4. Given are the cosine and place of the best window of the best stretch.

    Items of under least words, and with words, are found word for word. Null or empty texts and items hold nothing; repeated
    rows of documents give repeated results; repeated items are found each; an empty table on either side gives no rows;
    other columns, whatever their names, are left out. A null doc_id is carried as null.
    Returns doc_id, item_id, cosine, common (share of the item), answered (share of its answer), first_word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, common double, answered double, first_word long"
    names = ["item_id", "cosine", "common", "answered", "first_word"]
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    out = docs.sparkSession.createDataFrame([], schema)
    for leaks in _searches(docs, benchmark, size, rank, passage, width, stride, cosine, common, answers, answered, least, chunk, seed):

        def search(batches: Iterator[pa.RecordBatch], leaks=leaks) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                rows, ids = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                    found = leaks(hashes.of(text))
                    rows.extend(found)
                    ids.extend([doc_id] * len(found))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names]
                )

        out = out.unionAll(docs.mapInArrow(trimmed(search), schema))
    return out


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 2048,
    rank: int = 64,
    passage: int = 128,
    width: int = 24,
    stride: int = 12,
    cosine: float = 0.25,
    common: float = 0.6,
    answers: int = 8,
    answered: float = 0.5,
    least: int = 8,
    chunk: int = 5000,
    seed: int = 5,
) -> DataFrame:
    """The rows of docs, with all their columns, in which find_leaks finds nothing; a filter without a shuffle.

    Null or empty texts hold nothing, so they stay, as all rows do where the benchmark is empty; repeated rows stay or go
    together; doc_id is not looked at; an empty table gives no rows; columns may have any names.
    """
    place, left = docs.columns.index("text"), docs
    for leaks in _searches(docs, benchmark, size, rank, passage, width, stride, cosine, common, answers, answered, least, chunk, seed):

        def clean(batches: Iterator[pa.RecordBatch], leaks=leaks) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                free = [not leaks(hashes.of(text.as_py())) for text in batch.column(place)]
                yield batch.filter(pa.array(free, pa.bool_()))

        left = left.mapInArrow(trimmed(clean), docs.schema)
    return left


def _searches(docs, benchmark, size, rank, passage, width, stride, cosine, common, answers, answered, least, chunk, seed):
    """For each chunk of items a function from a text's word hashes to rows (item_id, cosine, common, answered, first_word)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count = items.count()
    if not count:
        return
    space, seen = fitted_space(docs, size, rank, passage, seed)
    space = space.astype(np.float32)
    chunks = -(-count // chunk)
    for number in range(chunks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == number) if chunks > 1 else items
        wanted = prepared([(r["item_id"], r["text"]) for r in some.collect()], space, width, stride, least, answers)
        if wanted:
            yield _searcher(wanted, space, seen, width, cosine, common, answered)


def anchors(item: Item, seen: np.ndarray, common: float, spare: int = 4) -> tuple[list[int], int]:
    """The item's words by which it is looked for, and how many of their places any leak has.

    A leak may lack a share of 1 - common of the item's places, so of the rarest places (by the feature counts seen), spare
    more than it may lack, it has spare at least.
    """
    missing = 0 if item.exact else item.length - math.ceil(common * item.length - 1e-9)
    chosen, held = [], 0
    for w in sorted(item.places, key=lambda w: (seen[w % len(seen)], w)):
        chosen.append(w)
        held += item.places[w].bit_count()
        if held >= missing + spare:
            break
    return chosen, max(1, held - missing)


def _searcher(wanted: list[Item], space: np.ndarray, seen: np.ndarray, width: int, cosine: float, common: float, answered: float):
    length = np.array([i.length for i in wanted])
    reach = np.where([i.exact for i in wanted], length, width + 2 * length)
    keys, need = zip(*(anchors(i, seen, common) for i in wanted), strict=True)
    need = np.array(need)
    vocabulary = np.array(sorted(set().union(*keys)), np.uint64)
    lists: list[list[int]] = [[] for _ in vocabulary]
    where = {w: k for k, w in enumerate(vocabulary.tolist())}
    for number, words in enumerate(keys):
        for w in words:
            lists[where[w]].append(number)
    counts = np.array([len(x) for x in lists])
    firsts, owners = np.cumsum(counts) - counts, np.concatenate([np.array(x) for x in lists])
    shift = np.uint64(44)
    maybe = np.zeros(1 << 20, bool)  # by a word's upper 20 bits, so that few words are searched for
    maybe[(vocabulary >> shift).astype(np.int64)] = True

    def regions(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, low and high: words of the text in which any leak of the item lies whole."""
        at = np.flatnonzero(maybe[(words >> shift).astype(np.int64)])
        if not len(at):
            return
        key = np.minimum(np.searchsorted(vocabulary, words[at]), len(vocabulary) - 1)
        same = vocabulary[key] == words[at]
        at, key = at[same], key[same]
        n = counts[key]
        number = owners[np.repeat(firsts[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        order = np.argsort(number, kind="stable")
        at, number = at[order], number[order]
        last = np.arange(len(at)) + need[number] - 1
        inside = np.minimum(last, len(at) - 1)
        full = (last < len(at)) & (number[inside] == number) & (at[inside] - at < reach[number])
        at, number = at[full], number[full]
        if not len(at):
            return
        apart = np.r_[True, (number[1:] != number[:-1]) | (at[1:] - at[:-1] >= reach[number[1:]])]
        begins = np.flatnonzero(apart)
        ends = np.r_[begins[1:], len(at)] - 1
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            item = int(number[b])
            yield item, max(0, int(at[b] - reach[item]) + 1), min(len(words), int(at[e] + reach[item]))

    def best_stretch(item: Item, words: list[int], size: int) -> tuple[float, float, int] | None:
        """Greatest share of the item in a stretch of size words with enough of the answer, the answer's share, its start."""
        least = 1.0 if item.exact else common
        spots = [i for i, w in enumerate(words) if w in item.places]
        held = [words[i] for i in spots]
        most = common_subsequence(item.places, held) / item.length
        if most < least:
            return None
        found, end = None, 0
        for k, start in enumerate(spots):
            before, end = end, bisect.bisect_left(spots, start + size)
            if end == before:
                continue  # part of the stretch before
            some = held[k:end]
            told = len(item.answer.intersection(some)) / len(item.answer)
            if told < answered or len(some) < least * item.length:
                continue
            share = common_subsequence(item.places, some) / item.length
            if share >= least and (found is None or (share, told) > found[:2]):
                found = (share, told, start)
                if share >= most:
                    break
        return found

    def close(words: np.ndarray, item: Item) -> tuple[float, int]:
        return best_window((words % np.uint64(len(space))).astype(np.int64), space, min(width, item.length), item.vectors)

    def leaks(words: np.ndarray) -> list[tuple]:
        best: dict[int, tuple] = {}
        for number, low, high in regions(words):
            item = wanted[number]
            if close(words[low:high], item)[0] < cosine:
                continue
            found = best_stretch(item, words[low:high].tolist(), int(reach[number]))
            if found and (number not in best or found[:2] > best[number][:2]):
                best[number] = (found[0], found[1], low + found[2])
        rows = []
        for number, (share, told, start) in sorted(best.items()):
            item = wanted[number]
            value, place = close(words[start : start + reach[number]], item)
            rows.append((item.item_id, value, share, told, start + place))
        return rows

    return leaks
