"""Exact removal of repeated byte strings: sparse suffixes, front-coded sorted runs, and LCP loser trees that merge them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, unstage
from tessera.llm.partenum import mixed

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of all strings of one length of a text, from differences of one running sum modulo 2**64."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, raw: np.ndarray, length: int) -> np.ndarray:
        n = len(raw)
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 16)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE, np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)]
        return mixed((sums[length:] - sums[:-length]) * self.inverses[: n - length + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every width values in a row, from running minima of blocks in both directions."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, length: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of length bytes: fingerprint, place, first and last start of the strings they stand for.

    A string's anchor is its gram of least hash, the leftmost of equals: equal strings have theirs at the same offset.
    """
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    prints = rolling.of(raw, gram)
    places = np.arange(len(prints), dtype=np.uint64)
    order = (prints & ~np.uint64((1 << 30) - 1)) | (places & np.uint64((1 << 30) - 1))
    chosen = (sliding_least(order, length - gram + 1) & np.uint64((1 << 30) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    at = chosen[edge]
    # least hashes crowd at the low end of their range, and parts are ranges of fingerprints: so they are mixed again
    return mixed(prints[at] ^ np.uint64(_BASE)), at, edge, np.r_[edge[1:], len(chosen)] - 1


# ---- front-coded runs and their merge


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as the length of the prefix each shares with the one before, and the rest of it."""
    shared, rest, last = [], [], b""
    for s in strings:
        h = common_prefix(last, s, 0)
        shared.append(h)
        rest.append(s[h:])
        last = s
    return shared, rest


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that are known to share known bytes; those are not read again."""
    end = min(len(a), len(b))
    step = 64
    while known < end:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            size = min(len(x), len(y))
            differ = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return known + (size - (differ.bit_length() + 7) // 8 if differ else size)
        known += step
    return end


class LoserTree:
    """Merges sorted front-coded runs. A string waiting in the tree carries the prefix it shares with the last one put
    out; two strings are compared by these lengths first, and by bytes only after them, so no known prefix is read twice.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.at = [0] * self.size
        self.string: list[bytes | None] = [None] * self.size
        self.shared = [0] * self.size
        for r, (_, rest) in enumerate(runs):
            if rest:
                self.string[r] = rest[0]
        self.loser = [0] * self.size
        winner = [*range(self.size)]
        nodes = [-1] * self.size + winner
        for node in range(self.size - 1, 0, -1):
            nodes[node], self.loser[node] = self._play(nodes[2 * node], nodes[2 * node + 1])
        self.top = nodes[1] if self.size > 1 else 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.string[a], self.string[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        h = common_prefix(x, y, p)
        if x[h : h + 1] <= y[h : h + 1]:
            self.shared[b] = h
            return a, b
        self.shared[a] = h
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, place in the run, prefix shared with the string before, string) in order."""
        while self.string[self.top] is not None:
            r = self.top
            current = self.string[r]
            yield r, self.at[r], self.shared[r], current
            self.at[r] += 1
            shared, rest = self.runs[r]
            if self.at[r] < len(rest):
                h = shared[self.at[r]]
                self.string[r], self.shared[r] = current[:h] + rest[self.at[r]], h
            else:
                self.string[r] = None
            node, winner = (r + self.size) // 2, r
            while node:
                winner, self.loser[node] = self._play(winner, self.loser[node])
                node //= 2
            self.top = winner


def _numbers(x: list[int]) -> bytes:
    return np.array(x, "<u4").tobytes()


def _cut(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [blob[a:b] for a, b in zip(ends - lengths, ends, strict=True)]


# ---- the operator


#: What names a document in rows that travel without its text: 64 bits of hash, and 30 more in tag, whose last bit is free.
NAME = ["key", "tag"]


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), text
    tag = F.xxhash64(F.lit(1), *known).bitwiseAND(0x7FFFFFFE).cast("int")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(*known).alias("key"), tag.alias("tag"))


def _raw(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def repeated_anchors(keyed: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Staged rows (key, tag, print, hot) of anchors whose fingerprint stands in the corpus twice or more; hot: over hot times."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            keys, tags, prints = [], [], []
            for text, key, tag in zip(_raw(batch, 0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, _, _, _ = anchors(np.frombuffer(text, np.uint8), length, gram, rolling)
                some, n = np.unique(found, return_counts=True)
                keys.append(np.full(len(some), key, np.int64))
                tags.append((tag | (n > 1)).astype(np.int32))  # the free bit: the text has it twice
                prints.append(some.view(np.int64))
            if keys:
                columns = [pa.array(np.concatenate(c)) for c in (keys, tags, prints)]
                yield pa.record_batch(columns, names=["key", "tag", "print"])

    each = stage(keyed.select("text", "key", "tag").mapInArrow(emit, "key long, tag int, print long"), "anchors")
    often = each.groupBy("print").agg(F.sum(1 + F.col("tag").bitwiseAND(1)).alias("n")).where("n > 1")
    often = often.select("print", (F.col("n") > hot).alias("hot"))
    wanted = each.join(often, "print").select("key", F.col("tag").bitwiseAND(-2).alias("tag"), "print", "hot")
    wanted = stage(wanted, "wanted")
    unstage(each)
    return wanted


def sorted_runs(docs: DataFrame, length: int, gram: int, parts: int, flush: int = 20000) -> DataFrame:
    """Records of the wanted anchors of (text, key, tag, prints, hots): runs by part of the order, and instances by document.

    A record is the fingerprint, the text from the anchor on and, last, the text before it, as far as the strings that
    the anchor stands for reach. A run holds each record of a flush once, with its number of instances. At the anchors
    of hots each string is a row of its own instead (part -2, hi the fingerprint, lo the string's hash).
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        records: dict[bytes, list] = {}
        instances: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(part, None, None, None, hi, lo, key, tag, first) for part, hi, lo, key, tag, first in instances]
            by_part: dict[int, list[bytes]] = {}
            for record in sorted(records):
                by_part.setdefault((int.from_bytes(record[:8], "big") * parts) >> 64, []).append(record)
            for part, strings in by_part.items():
                shared, rest = front_code(strings)
                lefts = [records[s][1] for s in strings]
                counts = [records[s][0] for s in strings]
                sizes = _numbers(shared), _numbers([len(r) for r in rest]), _numbers(lefts), _numbers(counts)
                packed = pa.compress(b"".join(rest), "zstd", asbytes=True)
                rows.append((part, b"".join(sizes), packed, len(strings), None, None, None, None, None))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["part", "numbers", "rest", "n", "hi", "lo", "key", "tag", "first"]
            for a in range(0, len(rows), 4096):
                columns = zip(*rows[a : a + 4096], strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            records.clear()
            instances.clear()

        for batch in batches:
            for text, *columns in zip(_raw(batch, 0), *(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                key, tag, wanted, hots = columns
                raw = np.frombuffer(text, np.uint8)
                prints, at, first, last = anchors(raw, length, gram, rolling)
                signed = prints.view(np.int64)
                if hots:
                    strings = rolling.of(raw, length).view(np.int64)
                    for i in np.flatnonzero(np.isin(signed, np.array(hots, np.int64))).tolist():
                        starts = range(first[i], last[i] + 1)
                        instances.extend((-2, int(signed[i]), s, key, tag, b) for s, b in zip(strings[first[i] : last[i] + 1].tolist(), starts, strict=True))
                        if len(instances) >= flush:
                            yield from out()
                    wanted = set(wanted).difference(hots)
                use = np.flatnonzero(np.isin(signed, np.array(sorted(wanted), np.int64)))
                for p, a, b, e in zip(prints[use].tolist(), at[use].tolist(), first[use].tolist(), last[use].tolist(), strict=True):
                    record = p.to_bytes(8, "big") + (a - b).to_bytes(4, "big") + text[a : e + length] + text[b:a]
                    # the offset of the anchor stands after the fingerprint, so that strings of a record line up
                    known = records.get(record)
                    if known is None:
                        hi, lo = np.frombuffer(xxhash.xxh3_128_digest(record), "<i8").tolist()
                        known = records[record] = [0, a - b, hi, lo]
                    known[0] += 1
                    instances.append((-1, known[2], known[3], key, tag, b))
                if len(instances) >= flush:
                    yield from out()
        if instances:
            yield from out()

    schema = "part long, numbers binary, rest binary, n long, hi long, lo long, key long, tag int, first long"
    return docs.select("text", "key", "tag", "prints", "hots").mapInArrow(make, schema)


def merged_repeats(runs: DataFrame, length: int) -> DataFrame:
    """Of each record (hi, lo) the runs of string starts, relative to its first, whose strings stand elsewhere too."""

    def merge(rows: pa.Table) -> pa.Table:
        coded, lefts, counts = [], [], []
        for numbers, rest, n in zip(*(rows.column(c).to_pylist() for c in ("numbers", "rest", "n")), strict=True):
            shared, sizes, left, count = np.frombuffer(numbers, "<u4").reshape(4, n)
            whole = pa.decompress(rest, int(sizes.sum(dtype=np.int64)), "zstd", asbytes=True)
            coded.append((shared.tolist(), _cut(whole, sizes.astype(np.int64))))
            lefts.append(left.tolist())
            counts.append(count.tolist())
        found: list[tuple] = []
        rolling = Rolling()
        group: list[list] = []  # [record, left, instances] of one fingerprint

        def settle() -> None:
            if len(group) == 1 and group[0][2] < 2:
                return
            texts = [r[len(r) - left :] + r[12 : len(r) - left] for r, left, _ in group]
            if len(group) == 1:
                again = [np.ones(len(texts[0]) - length + 1, bool)]
            else:
                # the strings of all records of the group, told apart by hash: equal ones have equal offsets from the anchor
                hashes = [rolling.of(np.frombuffer(t, np.uint8), length) for t in texts]
                every, place, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                weight = np.repeat([c for _, _, c in group], [len(h) for h in hashes])
                often = np.bincount(place, weights=weight, minlength=len(every)) > 1
                again = np.split(often[place], np.cumsum([len(h) for h in hashes])[:-1])
            for (record, _, _), a in zip(group, again, strict=True):
                if a.any():
                    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(record), "<i8").tolist()
                    edge = np.flatnonzero(np.diff(np.r_[False, a, False]))
                    found.append((hi, lo, edge[::2].tolist(), (edge[1::2] - 1).tolist()))

        for run, at, shared, record in LoserTree(coded):
            if group and shared >= len(record) and len(record) == len(group[-1][0]):
                group[-1][2] += counts[run][at]  # the same record in another run: all of its bytes are shared
                continue
            if group and shared < 8:
                settle()
                group = []
            group.append([record, lefts[run][at], counts[run][at]])
        if group:
            settle()
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = zip(*found, strict=True) if found else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hi", "lo", "froms", "tos"])

    return runs.groupBy("part").applyInArrow(merge, "hi long, lo long, froms array<long>, tos array<long>")


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, part_records: int = 20000, hot: int = 100000, with_text: bool = False) -> DataFrame:
    """Remove each byte that a string of length bytes covers which starts anywhere else, in the same document or another.

    1. Sparse suffixes: of every string of length bytes the gram of least hash is its anchor; equal strings have
       anchors at equal offsets. One text in about (length - gram) / 2 bytes is an anchor, not every byte.
    2. Fingerprints of anchors are counted over the corpus; only those that stand twice or more go on, which settles
       most of the text without moving it.
    3. The texts at those anchors (records) are sorted in each task, front-coded, and sent by range of the order, equal
       ones of a task once; LCP loser trees merge the runs of a range, never reading a known prefix again. Records that
       agree in full are repeats; among records of one fingerprint that differ, strings are told apart one by one.
       A fingerprint that stands over hot times would fill a task with records: there each string of length bytes is a
       row, and rows are counted by fingerprint and string, which Spark does in part before it shuffles.
    4. Each instance of a record takes its record's repeats, and each document the union of them.

    Texts are judged as UTF-8 on the input as it is; null text is empty; matches never cross documents; texts under
    length bytes keep all. Repeated rows repeat each other; doc_id may be null; an empty table gives no rows; other
    columns are left out. Strings are told apart by 64-bit hashes within one fingerprint, documents by 94 bits.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept, the remaining bytes.
    """
    keyed = _keyed(docs)
    wanted = repeated_anchors(keyed, length, gram, hot)
    parts = max(1, -(-wanted.count() // part_records))
    prints = wanted.groupBy(NAME).agg(F.collect_set("print").alias("prints"), F.collect_set(F.when(F.col("hot"), F.col("print"))).alias("hots"))  # of one text: no larger than the text
    made = stage(sorted_runs(keyed.join(prints, NAME), length, gram, parts), "runs")
    unstage(wanted)
    repeats = merged_repeats(made.where("part >= 0").select("part", "numbers", "rest", "n"), length)
    spans = made.where("part = -1").select("hi", "lo", *NAME, "first").distinct().join(repeats, ["hi", "lo"])
    spans = spans.select(*NAME, "first", F.explode(F.arrays_zip("froms", "tos")).alias("s"))
    single = made.where("part = -2").select("hi", "lo", *NAME, "first")
    again = single.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo")
    zero = F.struct(F.lit(0).cast("long").alias("froms"), F.lit(0).cast("long").alias("tos"))
    spans = spans.unionByName(single.join(again, ["hi", "lo"]).select(*NAME, "first").distinct().withColumn("s", zero))
    both = F.struct((F.col("s.froms") + F.col("first")).alias("a"), (F.col("s.tos") + F.col("first")).alias("b"))
    spans = spans.groupBy(NAME).agg(F.collect_list(both).alias("spans"))  # of one text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), _raw(batch, 1), batch.column(2).to_pylist(), strict=True):
                kept, removed, count, upto = [], 0, 0, 0
                last = -1
                for s in sorted(found or [], key=lambda s: s["a"]):
                    a, b = s["a"], s["b"] + length
                    if a > last:
                        kept.append(text[upto:a])
                        count += 1
                        removed += b - a
                        upto = last = b
                    elif b > last:
                        removed += b - last
                        upto = last = b
                left = b"".join([*kept, text[upto:]])
                rows.append((doc_id, len(text), removed, count, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return keyed.join(spans, NAME, "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
