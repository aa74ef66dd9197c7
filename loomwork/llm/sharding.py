"""Contiguous byte-balanced sharding from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = rows = 0
    for b in batches:
        size += int(np.sum(b.column("size").to_numpy(zero_copy_only=False)))
        rows += b.num_rows
    if rows:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "bytes": pa.array([size], pa.int64()), "n": pa.array([rows], pa.int64())})


def _shard_of(start: np.ndarray, size: np.ndarray, total: int, shards: int) -> np.ndarray:
    """The shard whose equal share of the bytes holds the middle of a row; python ints beyond 2**62 are avoided by floor division by parts."""
    mid = start + size // 2
    cuts = np.array([(total * k + shards - 1) // shards for k in range(1, shards)], dtype=np.int64)
    return np.searchsorted(cuts, mid, side="right").astype(np.int32)


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in id order, into ``shards`` contiguous runs of nearly equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  A row's size is its UTF-8 length plus one (null:
    one).  Rows are range-partitioned on (id, crc, size), without their texts; each partition yields one total, the driver
    turns those into offsets, and a row goes to the shard whose equal share of the byte line holds the row's middle.  So
    a shard's bytes differ from the target by less than the longest row at each end.  ``slot`` counts from 0 in a shard.

    Null ids sort first; repeated rows each keep a slot of their own; an empty table gives an empty result; columns other
    than the two named ones are ignored.  Only one row per partition and per (partition, shard) reaches the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    ranged = cut(base.repartitionByRange("doc_id", "text_crc32", "size").sortWithinPartitions("doc_id", "text_crc32", "size"))
    totals = sorted((r.part, r.bytes, r.n) for r in ranged.mapInArrow(_totals, "part int, bytes long, n long").collect())
    offset: dict[int, tuple[int, int]] = {}
    total = count = 0
    for part, size, n in totals:
        offset[part] = (total, count)
        total, count = total + size, count + n

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, seen = offset.get(part, (0, 0))[0], np.zeros(shards, np.int64)
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            end = at + np.cumsum(size)
            if len(size):
                seen += np.bincount(_shard_of(end - size, size, total, shards), minlength=shards)
                at = int(end[-1])
        yield pa.RecordBatch.from_pydict({"shard": pa.array(np.arange(shards), pa.int32()), "n": pa.array(seen, pa.int64())})

    held = {r.shard: r.n for r in ranged.mapInArrow(counts, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    first = np.concatenate([[0], np.cumsum([held.get(k, 0) for k in range(shards)])]).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = offset.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            end = at + np.cumsum(size)
            shard = _shard_of(end - size, size, total, shards)
            slot = row + np.arange(len(size), dtype=np.int64) - first[shard]
            if len(size):
                at, row = int(end[-1]), row + len(size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = ranged.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
