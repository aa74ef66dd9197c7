"""Near-duplicate documents by exact Jaccard similarity of word shingles: SimHash links first, prefix filtering for what those leave apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_but_one, among, bound_batches, connected_components, cut, maybe_in, row_hash, stash, without, without_rows
from .simhash import _LOWER, _majority, covering_links


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one of none has none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(line, 42)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def set_fingerprint(shingles: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes, signed; the empty set gives zero."""
    if not len(shingles):
        return 0
    fp = _majority(shingles.view(np.uint64).astype(">u8").view(np.uint8))
    return fp - (1 << 64) if fp >> 63 else fp


def _prefix(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which it shares one with every set of that similarity, in any order of all shingles."""
    return n + 1 - (-(-n * percent // 100)) if n else 0


#: One different text in so many is counted to learn which shingles are common, and how many of those are told to the workers at most.
COUNTED, COMMON = 4, 500_000


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are common in a fixed share of the different texts, sorted, and their counts: a bounded table.

    The share is the same at every size, so a shingle of a dozen texts is known as common in a large corpus, too.  It only
    decides in which order shingles are looked at; any order gives the same components.
    """
    some = docs.where(F.pmod(row_hash(text_col), F.lit(COUNTED)) == 0).select(F.col(text_col).alias("text")).distinct()
    sets = _sets(some.withColumn("id", F.lit(0)), "id", "text", shingle, None)
    counts = sets.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1")
    got = counts.orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys, seen = got.column("key").to_numpy(), got.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], seen[order].astype(np.int32)


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int | None, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``doc_id, row, node, fp, n, seen, top, keys``: the row's hash, the set's hash, SimHash and size, and the prefix of its shingles (all of them, and no SimHash, without ``percent``).

    Shingles are in the order of their counts in ``common``, the rest first, then of their hashes; ``seen`` and ``top`` are
    the count and the hash of the last one.
    """
    held = None if common is None else docs.sparkSession.sparkContext.broadcast(common)

    def first(s: np.ndarray) -> tuple[np.ndarray, int, int]:
        if percent is None or not len(s):
            return s, 0, 0
        count = np.zeros(len(s), np.int32)
        if held is not None and len(held.value[0]):
            at = np.minimum(np.searchsorted(held.value[0], s), len(held.value[0]) - 1)
            count = np.where(held.value[0][at] == s, held.value[1][at], 0)
        order = np.argsort(count, kind="stable")[: _prefix(len(s), percent)]
        return s[order], int(count[order[-1]]), int(s[order[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            fps = pa.array([0 if percent is None else set_fingerprint(s) for s in sets], pa.int64())
            firsts = [first(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k, *_ in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(k for k, *_ in firsts)])))
            columns = [b.column("doc_id"), b.column("row"), pa.array(node), fps, pa.array([len(s) for s in sets], pa.int32()), pa.array([f[1] for f in firsts], pa.int32()), pa.array([f[2] for f in firsts], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "fp", "n", "seen", "top", "keys"])

    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, fp long, n int, seen int, top long, keys array<bigint>")


#: Differing SimHash bits that the covering tables reach.
RADIUS = 4


def simhash_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``u < v`` of the distinct ``node, fp`` that connect them as all SimHash links within ``radius`` do: no more than one a node."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("fp").alias(fp), F.col("first").alias(name)) for fp, name in (("u", "a"), ("v", "b")))
    between = covering_links(first.select("fp"), radius).join(a, "u").join(b, "v").select("a", "b")
    return cut(same.unionByName(between).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, row, part, component_id`` per document: the hash of its text, one number for each component, and the component's smallest id.

    The SimHash of each set meets others under covering masks, and the pairs found are judged by the similarity of their
    whole sets.  Sets of that similarity can lie further apart than ``RADIUS`` bits, so prefix filtering follows between
    the groups that SimHash leaves apart.

    Two sets with a Jaccard similarity of at least ``percent`` share a shingle among the first n - ceil(percent n) + 1 of
    each, in any one order of all shingles (here: rare ones first), so every such pair meets under a key and none is
    missed.  Pairs go that share too little to reach the similarity, by the places of a common shingle in both orders or by
    the number of common ones in the prefixes; the whole sets of the others are compared.

    Equal sets are one node, texts without a word among them.  First the nodes of a key are compared with one of them,
    unless SimHash has linked them, which joins a group of near copies without its pairs; then only nodes of different
    components meet, and those of the key's own component don't meet each other.  Null ids name a component only if all ids in it are null.
    """
    rows = cut(_sets(docs, id_col, text_col, shingle, percent, common_shingles(docs, text_col, shingle)))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    many = nodes.where("rows > 1").select(F.col("node").alias("m"), F.col("low").alias("l"))
    copies = maybe_in(rows, F.col("node"), many, "m").join(many, (F.col("node") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("l")))
    names = ["node", "fp", "n", "seen", "top", "keys"]
    once = without(rows, "node", many, "m").select(*names).unionByName(copies.select(*names))
    keys = once.select("node", F.col("n").cast("long").alias("n"), "seen", "top", F.posexplode("keys").alias("at", "key"))
    shared = cut(keys.groupBy("key").count().where("count > 1").select("key"))
    before = Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = stash(among(keys, F.col("key"), shared, "key").distinct().withColumn("held", F.count("*").over(before)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def promising(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
        """Pairs of ``node_x, node_y`` whose counted keys let them reach the similarity."""
        near = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
        # up to the key the sets share no more than the keys that others have too, beyond it no more than what is left of either
        fits = (100 + percent) * (F.least("held_x", "held_y") + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) - 1) >= percent * (F.col("n_x") + F.col("n_y"))
        # what the sets share up to the lesser top is counted whole; beyond it, no more than that set's rest can be shared
        first = F.struct("seen_x", "top_x") <= F.struct(F.col("seen_y").alias("seen_x"), F.col("top_y").alias("top_x"))
        rest = F.when(first, F.ceil(F.col("n_x") * percent / 100)).otherwise(F.ceil(F.col("n_y") * percent / 100)) - 1
        lack = (percent * (F.col("n_x") + F.col("n_y")) - (100 + percent) * rest).cast("long")
        pairs = x.join(y, "key").where(on & near & fits).select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v"), lack.alias("lack"))
        pairs = pairs.groupBy("u", "v", "lack").count()
        return stash(pairs.where((100 + percent) * F.col("count") >= F.col("lack")).select("u", "v").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets have the similarity."""
        ids = pairs.select(F.col("u").alias("i")).unionByName(pairs.select(F.col("v").alias("i"))).distinct()
        # one text of each node in a pair: its smallest id may have several texts, so the node is asked for again
        wanted = nodes.join(ids, nodes["node"] == ids["i"], "left_semi").select(F.coalesce("low", F.lit(0).cast("long")).alias("i"))
        sets = _sets(maybe_in(texts, F.coalesce(F.col("doc_id"), F.lit(0)), wanted, "i"), "doc_id", "text", shingle, None)
        sets = cut(sets.join(ids, F.col("node") == F.col("i")).groupBy("node").agg(F.first("keys").alias("keys")))
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("keys").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("keys").alias("b")), "v")
        both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("s"), (F.size("a") + F.size("b")).alias("n"))
        return cut(both.where(100 * F.col("s") >= percent * (F.col("n") - F.col("s"))).select("u", "v"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "key"])

    def in_parts(met: DataFrame, roots: DataFrame) -> DataFrame:
        return met.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")

    # the node whose first shingles are the commonest has the fewest of its own: of near copies, the one that the others come from
    by = F.struct("seen", "n", "node", "top", "at", "held", "part")
    links = verified(simhash_pairs(once.select("node", "fp")))
    met = in_parts(met, connected_components(links))
    pivots = met.groupBy("key").agg(F.max(by).alias("p")).select("key", "p.*")
    links = links.unionByName(verified(promising(side(pivots, "x"), side(met, "y"), F.col("part_x") != F.col("part_y"))))
    roots = connected_components(links)
    met = in_parts(met.drop("part"), roots)
    met = cut(met.join(pivots.select("key", F.col("node").alias("pivot")).join(roots.withColumnRenamed("node", "pivot"), "pivot", "left").select("key", F.coalesce("root", "pivot").alias("own")), "key"))
    asks = met.where("part != own")
    differ = (F.col("part_x") != F.col("part_y")) & ((F.col("part_y") == F.col("own_y")) | (F.col("node_x") < F.col("node_y")))
    more = verified(promising(side(asks, "x"), side(met, "y"), differ))
    roots = connected_components(links.unionByName(more))
    linked = roots.join(nodes, "node").select("node", "root", "low")
    named = linked.join(linked.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "root", "component")
    named = cut(nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("part"), F.coalesce("component", "low").alias("component_id")))
    return rows.select("doc_id", "row", "node").join(named, "node").select("doc_id", "row", "part", "component_id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, component_id`` per document; component_id is the smallest id reachable over pairs of that similarity or more."""
    return similar_groups(docs, id_col, text_col, shingle, percent).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: the one with the smallest id.

    Rows are told apart by id and text, so other texts under a dropped id, or without an id, are judged by themselves.  Of
    rows equal in both, one stays.  An id goes before none, equal ids go by the hash of the text.
    """
    return without_rows(docs, id_col, text_col, all_but_one(similar_groups(docs, id_col, text_col, shingle, percent)))
