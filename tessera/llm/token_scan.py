"""Token counts from flat token files without an index: a vectorised search for separators, stitched by a prefix scan."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: The folder of the public vocabularies on every executor, where spark.tessera.tokenizers does not name another.
TOKENIZERS = "/opt/tokenizers"
#: Ids of byte_bpe_50k.tiktoken end below this one, so it is free to end documents (fixed value).
SEPARATOR = 50256
#: Pre-tokenisation of that vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(tokenizers: str = TOKENIZERS):
    """Byte-level BPE of the public 50k vocabulary; strings of special tokens are ordinary text to it."""
    import tiktoken

    with open(f"{tokenizers}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


FLAT = "file int, block long, tokens binary, ending array<long>"


def pack_flat(docs: DataFrame, block_tokens: int = 1 << 16, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents as flat token files: each task writes one, in blocks of block_tokens little-endian 16-bit ids.

    A separator follows every document; blocks are cut without regard to documents. ending is a manifest to label
    results with: the doc_ids whose separators the block holds, in order. The scan finds boundaries without it.
    Null text is an empty document. Texts are encoded whole.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizers).encode_ordinary
        block, held, size, ending = 0, [], 0, []

        def out(tokens: np.ndarray, ids: list) -> pa.RecordBatch:
            columns = [pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([tokens.tobytes()], pa.binary())]
            return pa.record_batch([*columns, pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ending"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), SEPARATOR], "<u2")
                while size + len(ids) > block_tokens:
                    part, ids = ids[: block_tokens - size], ids[block_tokens - size :]
                    yield out(np.concatenate([*held, part]), ending)
                    block, held, size, ending = block + 1, [], 0, []
                held.append(ids)
                size += len(ids)
                ending.append(doc_id)
        if size:
            yield out(np.concatenate(held), ending)

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, FLAT)
    return flat.withColumn("file", F.spark_partition_id())


def scan_blocks(flat: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Blocks (file, block, tokens[, ending]) to one row each: how many tokens, and where separators are in it."""
    labels = "ending" in flat.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [np.frombuffer(t.as_py() or b"", dtype) for t in batch.column(2)]
            places = [np.flatnonzero(b == separator) for b in blocks]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(b) for b in blocks], pa.int64()),
                pa.array([p.tolist() for p in places], pa.list_(pa.int64())),
                batch.column(3) if labels else pa.nulls(len(blocks), pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, names=["file", "block", "n_tokens", "places", "ending"])

    columns = ["file", "block", "tokens", *(["ending"] if labels else [])]
    return flat.select(columns).mapInArrow(scan, "file int, block long, n_tokens long, places array<long>, ending array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """Document lengths from scanned blocks: running sums over a file's blocks give every separator its place.

    A document's length is the gap from the separator before, which may lie many blocks back: the running maximum of
    places carries it over. The tokens after a file's last separator are a document without one (separated false).
    Returns file, ordinal, doc_id (null without a manifest), start, n_tokens, separated.
    """
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    blocks = scanned.withColumn("_start", start).withColumn("_end", F.col("_start") + F.col("n_tokens"))
    blocks = blocks.withColumn("_last", F.col("_start") + F.element_at("places", F.when(F.size("places") > 0, -1)))
    blocks = (
        blocks.withColumn("_before", F.coalesce(F.max("_last").over(earlier), F.lit(-1)))
        .withColumn("_ordinal", F.coalesce(F.sum(F.size("places")).over(earlier), F.lit(0)))
        .withColumn("_final", F.lead("block").over(order).isNull())
        .withColumn("_upto", F.coalesce("_last", "_before"))
    )
    ends = blocks.select("file", "_start", "_before", "_ordinal", "places", "ending", F.posexplode("places").alias("_i", "_place"))
    previous = F.when(F.col("_i") == 0, F.col("_before")).otherwise(F.col("_start") + F.element_at("places", F.greatest("_i", F.lit(1))))
    whole = ends.select(
        "file",
        (F.col("_ordinal") + F.col("_i")).alias("ordinal"),
        F.get("ending", F.col("_i")).alias("doc_id"),
        (previous + 1).alias("start"),
        (F.col("_start") + F.col("_place") - previous - 1).alias("n_tokens"),
        F.lit(True).alias("separated"),
    )
    rest = blocks.where("_final and _end - _upto > 1").select(
        "file",
        (F.col("_ordinal") + F.size("places")).alias("ordinal"),
        F.lit(None).cast("long").alias("doc_id"),
        (F.col("_upto") + 1).alias("start"),
        (F.col("_end") - F.col("_upto") - 1).alias("n_tokens"),
        F.lit(False).alias("separated"),
    )
    return whole.unionAll(rest)


def token_counts(docs: DataFrame, block_tokens: int = 1 << 16, tokenizers: str | None = None) -> DataFrame:
    """Tokens of every document, counted by scanning flat files for separators.

    Texts are read and encoded once: packing and scanning run in one stage, and what it found (one row for each block,
    with the places of its separators) is staged and stitched, shuffled by file. A file is one input partition, so no
    file outgrows a task. tokenizers is the folder of the vocabularies on every executor: by default that of the
    session's setting spark.tessera.tokenizers. Null and empty texts have 0 tokens; repeated rows and null doc_ids are
    counted row by row; an empty table gives no rows; other columns are left out.
    Returns doc_id, n_tokens.
    """
    folder = tokenizers or docs.sparkSession.conf.get("spark.tessera.tokenizers", TOKENIZERS)
    scanned = stage(scan_blocks(pack_flat(docs, block_tokens, folder)), "blocks")
    return stitch(scanned).select("doc_id", "n_tokens")
