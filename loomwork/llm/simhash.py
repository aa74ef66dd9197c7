"""SimHash near-duplicates with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_but_one, bound_batches, connected_components, cut, row_hash, without_rows

BITS = 64
#: A bucket of more fingerprints than this is dealt out again under a further family of masks.
BUCKET, LEVELS = 4096, 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included; no words give zero."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    digest, line = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(digest(line, 42), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    return _majority(np.frombuffer(hashes, np.uint8))


def _majority(hashes: np.ndarray, block: int = 16384) -> int:
    """Bits set in more than half of the big-endian 8-byte hashes."""
    rows = hashes.reshape(-1, 8)
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(rows), block):
        count += np.unpackbits(rows[k : k + block], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, row, fp``: the hash and the SimHash of every whole text, the latter as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """2**(radius+1)-1 masks; any two words that differ in at most ``radius`` bits agree under at least one.

    Bit i carries a non-zero vector m(i) of radius+1 bits, and mask v holds the bits with odd <m(i), v>.  At most
    ``radius`` differing bits span less than the whole space, so some v is orthogonal to them all, and its mask omits
    every one.  ``family`` permutes the bits, for independent families of the same guarantee.
    """
    size = (1 << (radius + 1)) - 1
    order = [(i * (1, 5, 27, 45, 13)[family] + 11 * family) % BITS for i in range(BITS)]
    vector = {bit: k % size + 1 for k, bit in enumerate(order)}
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among at most BUCKET distinct fingerprints: each is reached once."""
    out, left = [], fps
    while len(left) > 1:
        left, todo = left[1:], [left[0]]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                got = left[near]
                out += [(int(at), int(x)) for x in got.view(np.int64)]
                todo += list(got)
                left = left[~near]
    return [(int(np.uint64(a).view(np.int64)), b) for a, b in out]


def _bucket_runs(radius: int):
    """Batches sorted by (table, key): links within each run of equal keys, or the members of a run beyond BUCKET."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, at, hot = 0, None, False

        def out(rows: list[tuple[int, int]], members: np.ndarray | None = None, where: int = 0) -> pa.RecordBatch:
            if members is not None:
                return pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.nulls(len(members), pa.int64()), pa.array(np.full(len(members), where, np.int32))], names=["u", "v", "t"])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int32())], names=["u", "v", "t"])

        links: list[tuple[int, int]] = []
        for b in batches:
            t, key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp"))
            if not len(t):
                continue
            fp = fp.view(np.uint64)
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *edge.tolist(), len(t)]
            size = np.diff(bounds)
            runs = np.unique(np.concatenate([[0, len(size) - 1], np.flatnonzero(size > 1)])).tolist()  # lone rows inside a batch link to nothing
            for a, z in ((bounds[k], bounds[k + 1]) for k in runs):
                here = (int(t[a]), int(key[a]))
                if here != at:
                    if n > 1 and not hot:
                        links += _links(np.concatenate(held), radius)
                    held, n, at, hot = [], 0, here, False
                n += z - a
                if hot:
                    yield out([], fp[a:z], here[0])
                    continue
                held.append(fp[a:z])
                if n > BUCKET:
                    yield out([], np.concatenate(held), here[0])
                    held, hot = [], True
            if len(links) > 50_000:
                yield out(links)
                links = []
        if n > 1 and not hot:
            links += _links(np.concatenate(held), radius)
        if links:
            yield out(links)

    return run


def covering_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``u, v`` that connect the distinct fingerprints ``fp`` of ``nodes`` exactly as all links within ``radius`` do.

    Every node enters 2**(radius+1)-1 buckets.  A bucket yields a spanning forest of its verified links, never its pairs.
    One with more than BUCKET members is dealt out again under a further mask family; after four families (five for a
    radius of 4) at most 12 bits are left free, so no bucket can pass 4096 and nothing is capped.
    """
    if radius not in (3, 4):
        raise ValueError("the mask families are proven for a radius of 3 or 4")
    size = (1 << (radius + 1)) - 1
    work, edges = nodes.select("fp", F.lit(0).alias("t")), None
    for level in range(LEVELS + radius - 3):
        mask = F.lit(0).cast("long")
        for k in range(level + 1):  # the digits of t in base ``size`` tell the mask chosen at each level
            family = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, k)])
            mask = mask.bitwiseOR(F.element_at(family, (F.floor(F.col("t") / size ** (level - k)) % size + 1).cast("int")))
        dealt = work.select("fp", F.explode(F.sequence(F.col("t") * size, F.col("t") * size + size - 1)).alias("t"))
        dealt = dealt.select("t", F.col("fp").bitwiseAND(mask).alias("key"), "fp")
        found = cut(dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_runs(radius), "u long, v long, t int"))
        new = found.where("v is not null").select("u", "v")
        edges = new if edges is None else edges.unionByName(new)
        work = found.where("v is null").select(F.col("u").alias("fp"), "t")
        if work.isEmpty():
            return edges
    raise AssertionError("masks of all levels leave at most 12 bits free, so no bucket can be left over")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, row, fp, part, component_id`` per document: ``part`` is one number for each component."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(covering_links(nodes, radius))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    named = linked.join(lowest, "root").select("fp", "root", "component")
    named = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("part"), F.coalesce("component", "low").alias("component_id")))
    return fps.join(named, "fp").select("doc_id", "row", "fp", "part", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document; component_id is the smallest id reachable over links.

    Words are runs of non-space characters after lower-casing A-Z; documents of fewer words than a shingle hash their whole
    word sequence, and those of none (null, empty, blank) have fingerprint zero and link like any other.  Equal
    fingerprints are one node, so a group of copies costs one row in each table.  Repeated rows are returned as often as
    they come; a null id takes part but never names a component unless all ids in it are null.  An empty table gives an
    empty result, and other columns are ignored.
    """
    found = simhash_groups(docs, id_col, text_col, shingle, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: the one with the smallest id (an id before none, then by the hash of the text).

    Rows are told apart by id and text; of rows equal in both, one stays.
    """
    return without_rows(docs, id_col, text_col, all_but_one(simhash_groups(docs, id_col, text_col, shingle, radius)))
