"""Exact set-similarity join by PartEnum signatures: word-shingle sets of documents, linked where their Jaccard is high."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, join_by_key, stage, trimmed, unstage

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit numbers whose output bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words by word; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1 << 17:
            self[word] = found
        return found


def shingle_set(text: bytes | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of words, A-Z lower-cased.

    A text of fewer words is one shingle, a text without words has none.
    """
    tokens = text.lower().split() if text else []
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    if n < words:
        return mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens)) ^ n], np.uint64))
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, n)
    acc = h[: n - words + 1].copy()
    for i in range(1, words):
        acc = (acc ^ (acc >> np.uint64(29))) * _MIX1 + h[i : n - words + 1 + i]
    return np.unique(mixed(acc))


@dataclass(frozen=True)
class Band:
    """Sizes low to high, and how the domain is cut for them: into first parts, each of those into second parts.

    Similar sets of these sizes, or of the band below, differ in at most differ elements, so of the first parts slack + 1
    at least hold no more than spare differing elements. In such a part all but spare of its second parts are the same in
    both sets: the subsets of second - spare second parts are enumerated, and each signs.
    """

    number: int
    low: int
    high: int
    differ: int
    first: int
    second: int
    spare: int
    slack: int

    @property
    def signatures(self) -> int:
        return self.first * math.comb(self.second, self.spare)


class PartEnum:
    """Signatures for Jaccard similarity of at least percent / 100, by two levels of partitions and enumerated subsets.

    Sets are dealt into bands of near-equal size. Two similar sets lie in the same band or in neighbouring ones, so a set
    signs for its own band and, if a partner could lie there, for the next. In a band the Hamming distance of similar sets
    is at most k. With first-level partitions of which one at least has at most spare differing elements (n1 of them where
    n1 * (spare + 1) > k), and second-level partitions in each, every subset of all but spare second-level partitions
    signs. Equal contents give equal signatures, so similar sets share one. How many of both there are is chosen by band:
    the fewest signatures by which unrelated sets seldom meet.

    An empty subset says little, and there slack helps: with slack more first-level partitions than needed, slack + 1 of
    them agree up to spare, and unless more than slack of a set's are thin (fewer than spare + 1 second-level partitions
    hold anything), one that agrees shares a signature that is not empty. Only sets with more thin ones sign empty subsets.
    """

    #: spare and second: the whole part where similar sets must be equal, else subsets of ever more second-level parts
    SHAPES = ((0, 1), (1, 3), (1, 4), (2, 5), (3, 6), (3, 7))

    def __init__(self, percent: int, width: float = 1.25, seed: int = 0, meet: float = 0.002, prefer: float = 1.6):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        self.percent, self.seed, self.meet, self.prefer = percent, seed, meet, prefer
        self.tail = NormalDist().inv_cdf(1 - math.sqrt(meet))  # both sets must have more thin parts to meet in an empty one
        self.width = max(width, 100 / percent)
        self.bands: list[Band] = []

    def band(self, number: int) -> Band:
        while len(self.bands) <= number:
            low = self.bands[-1].high + 1 if self.bands else 1
            high = max(low, int(low * self.width))
            k = 2 * high * (100 - self.percent) // (100 + self.percent)
            least = max(1, -(-low * self.percent // 100))
            self.bands.append(Band(len(self.bands), low, high, k, *self._shape(k, least)))
        return self.bands[number]

    def _shape(self, k: int, least: int) -> tuple[int, int, int, int]:
        """first, second, spare and slack: of the shapes whose empty subsets unrelated sets share with a chance of at most
        meet, the one of fewest signatures; one with subsets to enumerate counts as if it had prefer times fewer. Where
        no shape is, the one that unrelated sets share least."""
        found = []
        for spare, second in self.SHAPES:
            if spare > k:
                continue
            subsets = math.comb(second, spare)
            slack = 0
            while True:
                first = k // (spare + 1) + 1 + slack
                empty = math.exp(-least * (second - spare) / (first * second))
                share = first * subsets * empty**2
                thin = first * min(1.0, subsets * empty)  # about Poisson, so this much slack leaves few sets with more
                need = 0 if share <= self.meet else math.ceil(thin + self.tail * math.sqrt(thin))
                good = need <= slack
                weight = first * subsets / (self.prefer if spare else 1.0)
                found.append((not good, weight if good else share, (first, second, spare, slack)))
                if good or (first + need - slack) * subsets > 3 * (k + 1):
                    break
                slack = need
        return min(found)[2]

    @lru_cache(maxsize=4096)  # noqa: B019  one object for each task
    def _cut(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of all second-level parts in the domain, the enumerated subsets, and a salt for each subset of each first part."""
        band = self.band(number)
        parts = band.first * band.second
        edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
        subsets = np.array(list(itertools.combinations(range(band.second), band.second - band.spare)))
        places = np.arange(band.signatures, dtype=np.uint64).reshape(band.first, len(subsets))
        salt = np.uint64(xxhash.xxh3_64_intdigest(f"{self.seed}:{self.percent}:{number}".encode()))
        return edges, subsets, mixed(places * _STEP + salt)

    def bands_of(self, size: int) -> list[int]:
        number = 0
        while self.band(number).high < size:
            number += 1
        return [number, number + 1] if size * 100 // self.percent >= self.band(number + 1).low else [number]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set of 64-bit hashes."""
        if not len(elements):
            return np.zeros(0, np.uint64)
        if self.seed:  # another cut of the domain
            elements = np.sort(mixed(elements ^ np.uint64(xxhash.xxh3_64_intdigest(str(self.seed).encode()))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(elements ^ _STEP), dtype=np.uint64)])
        out = []
        for number in self.bands_of(len(elements)):
            band = self.band(number)
            edges, subsets, salts = self._cut(number)
            cuts = np.concatenate([[0], np.searchsorted(elements, edges, side="left"), [len(elements)]])
            held = (cuts[1:] > cuts[:-1]).reshape(band.first, band.second)
            parts = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(band.first, band.second)
            signs = mixed(parts[:, subsets].sum(axis=2, dtype=np.uint64) + salts)
            thin = int((held.sum(axis=1) <= band.spare).sum())
            out.append(signs.ravel() if thin > band.slack else signs[held[:, subsets].any(axis=2)])
        return np.concatenate(out)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the counts of elements by hash, at a power of two of bits, four times the set's size or more.

    Two sketches differ in no more bits than the sets in elements, which rules out most pairs without the sets.
    """
    bits = 64
    while bits < 4 * len(elements):
        bits *= 2
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view("<i8")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _binary(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    """Texts one at a time, not all of a batch at once."""
    return (x.as_py() for x in batch.column(column).cast(pa.binary()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as rows, without a Python number for each."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def shingle_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, hi, lo (128-bit hash of the set), sketch: one row for each row of the input."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            size, names, sketches = [], [], []
            for text in _binary(batch, 1):
                elements = shingle_set(text, words, known)
                size.append(len(elements))
                names.append(np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), "<i8"))
                sketches.append(parity_sketch(elements))
            hi, lo = np.array(names, np.int64).reshape(-1, 2).T
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(hi), pa.array(lo), _lists(sketches)],
                names=["doc_id", "n_shingles", "hi", "lo", "sketch"],
            )

    return docs.mapInArrow(trimmed(rows), "doc_id long, n_shingles long, hi long, lo long, sketch array<long>")


def shared_signatures(docs: DataFrame, words: int, scheme: PartEnum, parts: int, spread: int, flush: int = 1 << 18) -> DataFrame:
    """Rows (sig, doc_id, hub) of signatures that two documents or more have: hub is one of them, the same for all.

    Signatures travel packed: a task sends, for each of the parts of the signature range, one binary row rather than
    a row for each signature, and of a signature that many of its documents have only the first, with a mark. The others
    have that first one as their hub and skip the search: they go to groups of their own, dealt out over spread, so that
    a hot signature reaches the search once for each flush of each task, and no group holds all of its documents.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, seen = WordHashes(), PartEnum(scheme.percent, scheme.width, scheme.seed, scheme.meet, scheme.prefer), set()
        signs: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            sig, doc = np.concatenate(signs), np.concatenate(owners)
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            begins = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            hubs = doc[begins[group]]
            fresh = first | (hubs != doc)
            rest = np.zeros(len(sig), np.uint8)
            rest[begins] = np.bincount(group, weights=fresh & ~first, minlength=len(begins)) > 0
            rows = []
            for again in (False, True):
                use = fresh & (first != again)
                s, d, h, r = sig[use], doc[use], hubs[use], rest[use]
                part = (s % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                s, d, h, r, part = s[by], d[by], h[by], r[by], part[by]
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
                ends = [*at[1:], len(part)] if len(part) else []
                for a, b in zip(at, ends, strict=True):
                    sigs, docs_ = s[a:b].tobytes(), d[a:b].tobytes()
                    sub = 1 + xxhash.xxh3_64_intdigest(sigs + docs_) % spread if again else 0
                    rows.append((int(part[a]), sub, sigs, docs_, h[a:b].tobytes() if again else r[a:b].tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "sub", "sig", "doc", "more"])

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _binary(batch, 1), strict=True):
                elements = shingle_set(text, words, known)
                name = xxhash.xxh3_128_intdigest(elements.tobytes())
                if not len(elements) or name in seen:  # an equal set has signed in this task
                    continue
                if len(seen) < 1 << 20:
                    seen.add(name)
                signs.append(own.signatures(elements))
                owners.append(np.full(len(signs[-1]), doc_id, np.int64))
                held += len(signs[-1])
                if held >= flush:
                    yield out()
                    held, signs, owners = 0, [], []
        if held:
            yield out()

    def search(packed: pa.Table) -> pa.Table:
        def whole(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in packed.column(name).to_pylist()])

        sig, doc = whole("sig", "<u8"), whole("doc", "<i8")
        if packed.column("sub")[0].as_py():
            hubs = whole("more", "<i8")
        else:
            marked = whole("more", "u1")
            order = np.lexsort((doc, sig))
            sig, doc, marked = sig[order], doc[order], marked[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            group = np.cumsum(first) - 1
            many = (np.bincount(group) > 1) | (np.bincount(group, weights=marked) > 0)
            use = many[group]
            hubs = doc[np.flatnonzero(first)[group]][use]
            sig, doc = sig[use], doc[use]
        return pa.table({"sig": pa.array(_signed(sig)), "doc_id": pa.array(doc), "hub": pa.array(hubs)})

    packed = docs.mapInArrow(trimmed(sign), "part long, sub long, sig binary, doc binary, more binary")
    return packed.groupBy("part", "sub").applyInArrow(trimmed(search), "sig long, doc_id long, hub long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id and elements of the wanted sets (doc_id, hi, lo)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, sets = [], []
            for doc_id, text, hi, lo in zip(
                batch.column(0).to_pylist(), _binary(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                elements = shingle_set(text, words, known)
                if tuple(np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), "<i8").tolist()) == (hi, lo):
                    ids.append(doc_id)
                    sets.append(_signed(elements))
            yield pa.record_batch([pa.array(ids, pa.int64()), _lists(sets)], names=["doc_id", "elements"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "hi", "lo").mapInArrow(trimmed(rows), "doc_id long, elements array<long>")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose Jaccard reaches percent, staged: told by sizes, then sketches, then the sets themselves."""
    left = nodes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    # a sketch of twice the bits folds to the smaller by the parity of both halves; sizes of near sets differ by less
    fold = (
        "case when size({x}) > size({y}) then"
        " zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q) else {x} end"
    )
    near = near.select("a", "b", "na", "nb", F.expr(fold.format(x="sa", y="sb")).alias("sa"), F.expr(fold.format(x="sb", y="sa")).alias("sb"))
    differ = F.expr("aggregate(zip_with(sa, sb, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)")
    near = near.where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    near = stage(near.select("a", "b", "na", "nb"), "pairs")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    sets = stage(_sets(docs, nodes.select("doc_id", "hi", "lo").join(ids, "doc_id"), words), "sets")
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("xa")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    both = both.select("a", "b", "na", "nb", common.alias("common"))
    links = stage(both.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), "links")
    unstage(near, sets)
    return links


def _as_pairs(rows: DataFrame) -> DataFrame:
    return rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_in_group(n: np.ndarray, c: np.ndarray, sketch: list[np.ndarray], percent: int, side: np.ndarray | None) -> list[np.ndarray]:
    """Places i, j of pairs across classes c that sizes n and sketches do not rule out; across sides alone if side is given.

    Compared in blocks: sets of one sketch length against the later ones that are at most 1 / percent larger.
    """
    order = np.argsort(n, kind="stable")
    n, c = n[order], c[order]
    side = side[order] if side is not None else None
    sketch = [sketch[i] for i in order]
    upto = np.searchsorted(n, n * 100 // percent, side="right")
    found = []
    a = 0
    while a < len(n):
        width = len(sketch[a])
        b = a + 1
        while b < min(len(n), a + 64) and len(sketch[b]) == width:
            b += 1
        last = int(upto[b - 1])
        rows = np.stack(sketch[a:b])
        for at in range(a, last, 512):
            to = min(last, at + 512)
            # a longer sketch folds to the width by the parity of its parts
            cols = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketch[at:to]])
            differ = np.bitwise_count(rows[:, None, :] ^ cols[None]).sum(2, dtype=np.int64)
            sizes = n[a:b, None] + n[None, at:to]
            near = (differ * (100 + percent) <= sizes * (100 - percent)) & (100 * n[a:b, None] >= percent * n[None, at:to])
            near &= (c[a:b, None] != c[None, at:to]) & (np.arange(a, b)[:, None] < np.arange(at, to)[None])
            if side is not None:
                near &= side[a:b, None] != side[None, at:to]
            i, j = np.nonzero(near)
            found.append(np.stack([order[i + a], order[j + at]], 1))
        a = b
    return found


def spanning(pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of pairs of places, as many as connect the classes c that the pairs connect, and no circle among them."""
    _, label = np.unique(c, return_inverse=True)
    first, second = label[pairs[:, 0]], label[pairs[:, 1]]
    joined = np.arange(label.max(initial=-1) + 1)
    chosen = [np.zeros(0, np.int64)]
    while True:
        a, b = joined[first], joined[second]
        live = np.flatnonzero(a != b)
        if not len(live):
            return pairs[np.concatenate(chosen)]
        low, high = np.minimum(a, b)[live], np.maximum(a, b)[live]
        ends, at = np.unique(high, return_index=True)  # each class takes one pair to a lower one, so no circle arises
        chosen.append(live[at])
        to = np.arange(len(joined))
        to[ends] = low[at]
        while (to != to[to]).any():
            to = to[to]
        joined = to[joined]


def _across(rows: DataFrame, nodes: DataFrame, percent: int, forest: bool, block: int = 1024, pack: int = 2048) -> DataFrame:
    """Pairs (a, b) of different classes among the nodes of each signature, rows (sig, node, c, n), that may be similar.

    All such pairs, or with forest only as many as connect the classes: fewer than there are nodes.
    Groups of up to block nodes are compared whole, many in a task. Larger ones are dealt into blocks, and a task
    compares two blocks, so no task holds more than two blocks of one signature.
    """
    total = rows.count()
    packs = max(1, total // pack)
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    small = rows.where("blocks = 1").select(
        "sig", "node", "c", F.lit(0).alias("p"), F.lit(0).alias("q"), F.pmod("sig", F.lit(packs)).alias("key"), F.lit(0).alias("own")
    )
    large = rows.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    large = large.select(
        "sig", "node", "c", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("sig").alias("key"), "own"
    )
    sketched = small.unionByName(large).join(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "sketch"), "node")

    def compare(group: pa.Table) -> pa.Table:
        sig = np.array(group.column("sig"))
        node, c, size, own = (np.array(group.column(x)) for x in ("node", "c", "size", "own"))
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        rows = group.column("sketch").combine_chunks()
        rows = rows if isinstance(rows, pa.Array) else pa.concat_arrays(rows.chunks)
        values, ends = np.array(rows.flatten()).view(np.uint64), np.cumsum(np.array(rows.value_lengths()))
        sketch = [values[b - n : b] for b, n in zip(ends.tolist(), np.array(rows.value_lengths()).tolist(), strict=True)]
        order = np.argsort(sig, kind="stable")
        ends = np.flatnonzero(np.concatenate([sig[order][1:] != sig[order][:-1], [True]])) + 1
        pairs, a = [np.zeros((0, 2), np.int64)], 0
        for b in ends:
            at = order[a:b]
            found = near_in_group(size[at], c[at], [sketch[i] for i in at], percent, own[at] if p != q else None)
            near = np.concatenate([f for f in found if len(f)] or [pairs[0]])
            pairs.append(np.sort(node[at][spanning(near, c[at]) if forest else near], axis=1))
            a = b
        both = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return sketched.groupBy("key", "p", "q").applyInArrow(trimmed(compare), "a long, b long").distinct()


def similar_components(
    docs: DataFrame, words: int = 5, percent: int = 80, part_signatures: int = 1 << 18, few: int = 32, scratch: list | None = None
) -> DataFrame:
    """Classes of documents that chains of links connect; two link if the Jaccard of their shingle sets is percent / 100.

    Equal sets are one node. Documents that share a signature are candidates. First each is compared with the hub of
    its signature, which finds the classes of copies in a number of comparisons linear in the group. Then, where a
    signature's documents still lie in several classes, pairs across classes are compared, so that no link between
    classes is lost: by size and sketch in blocks, and last by the sets. In signatures of more than few documents a first round
    verifies only as many pairs as would connect the classes, which merges most of them; the second round verifies, in
    every signature, each pair that may be similar and still lies across classes.

    Rows of equal doc_id are one node, the set with the least hash standing for it. Rows with a null doc_id link with
    nothing and have component_id null; null or empty texts have no shingles and are alone; an empty table gives no
    rows; other columns are left out. scratch, if given, gets the staged rows that the result still reads.
    Returns doc_id, n_shingles, component_id, one row for each row of the input.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = stage(shingle_rows(docs, words), "shingles")
    known = members.where("doc_id is not null and n_shingles > 0")
    docs = docs.where("doc_id is not null")
    # staged, so that the join below reads both sides as they are and adaptive execution can split a hot set
    reps = stage(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "least")
    node_of = stage(known.select("doc_id", "hi", "lo").join(reps.hint("merge"), ["hi", "lo"]).select("doc_id", "rep").distinct(), "reps")
    unstage(reps)
    nodes = known.groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "n_shingles", "sketch")).alias("s")).select("doc_id", "s.*")
    nodes = stage(nodes.join(node_of.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "nodes")
    scheme = PartEnum(percent)
    total, rows = members.agg(F.sum("n_shingles"), F.count("*")).first()
    share = 2.8 * (100 - percent) / (100 + percent) * 2  # signatures of a set by its size, about
    parts = max(1, math.ceil((total or 0) * share / part_signatures))

    found = stage(shared_signatures(docs, words, scheme, parts, 1 + rows // part_signatures), "shared")
    to = [node_of.select(F.col("doc_id").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("doc_id", "hub")]
    shared = found.join(to[0], "doc_id").join(to[1], "hub").select("sig", F.col("doc_id_rep").alias("node"), F.col("hub_rep").alias("hub"))
    shared = stage(shared.distinct(), "groups")
    unstage(found)
    tested = stage(_as_pairs(shared.select(F.col("node").alias("x"), F.col("hub").alias("y"))), "tested")
    hubs = _linked(tested, docs, nodes, words, percent)
    equal = node_of.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = [hubs]

    def joined() -> DataFrame:
        links = equal
        for more in every:
            links = links.union(more)
        linked = components(links)
        out = stage(linked, "classes")
        unstage(linked)
        return out

    def classed(rows: DataFrame) -> DataFrame:
        """Rows (sig, node) of signatures whose nodes lie in several classes."""
        found = rows.join(classes.select("node", F.col("component").alias("c")), "node", "left")
        found = found.select("sig", "node", F.coalesce("c", "node").alias("c"))
        split = found.groupBy("sig").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n")).where("c1 <> c2")
        found, split = stage(found, "found"), stage(split.select("sig", "n", F.col("n").alias("rows")), "many")
        out = stage(join_by_key(found, split, "sig", found.count(), "rows"), "split")
        unstage(found, split)
        return out

    classes = joined()
    rows = classed(shared.select("sig", "node").union(shared.select("sig", F.col("hub").alias("node"))).distinct())
    unstage(shared)
    for forest in (True, False):
        # a signature of few documents has at most (few - 1) / 2 pairs for each, so it needs no first round
        across = _across(rows.where(F.col("n") > few) if forest else rows, nodes, percent, forest).join(tested, ["a", "b"], "left_anti")
        more = _linked(across, docs, nodes, words, percent)
        every.append(more)
        if not more.isEmpty():
            old = classes, rows
            classes = joined()
            if forest:
                rows = classed(rows.select("sig", "node"))
                unstage(old[1])
            unstage(old[0])
    unstage(rows, tested, nodes, node_of, *every)
    if scratch is not None:
        scratch.extend((members, classes))
    found = members.join(classes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row, with all its columns, of each class of similar_components: that of the least doc_id.

    Of rows with equal doc_id one stays; rows with a null doc_id stay, as they link with nothing; null or empty texts are
    alone, so they stay too. An empty table gives no rows; columns may have any names.
    """
    scratch: list = []
    classes = similar_components(docs, words, percent, scratch=scratch)
    gone = stage(classes.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    repeated = not classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    unstage(*scratch)
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not repeated:
        return left
    known = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return known.unionByName(left.where("doc_id is null"))
