"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a plain local master may fall back to a temporary folder."""
    sc = spark.sparkContext
    wanted = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if wanted:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(wanted)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomwork-checkpoint-"))


#: Bytes of an Arrow batch that goes to a Python worker; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """Let the session cut Arrow batches by bytes, unless it does so already: 10,000 rows of long texts would fill a worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1") == "1":
        conf.set(key, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    df.sparkSession.sparkContext._jvm.System.gc()  # as in stash: else the shuffle files of many small steps stay side by side
    return out


def split_bucket(id_col: str, modulus: int):
    """crc32 of the id's decimal text modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rewiring.

    ``edges`` has bigint columns ``u`` and ``v`` with ``u != v``.  Returns ``node, root`` for every node on an edge,
    ``root`` being the smallest node id of its component (the root itself is included).  A round only takes minima per
    node and joins them back: no neighbour list is gathered, nothing reaches the driver but a row count and a checksum.
    The number of edges never rises, and each round is cut at the shared checkpoint folder.
    """
    cur = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = cut(small.where("u != v").distinct())
        mark = cur.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stash(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as compressed Parquet in the same shared folder: for tables that hold texts."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # what lies before is not read again: lets Spark's cleaner drop its shuffle files
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Words of 64 bits in the filter below: 4 MB of bits, whatever the number of keys.
FILTER_WORDS = 1 << 16


def filter_bits(keys: DataFrame, name: str):
    """A bit table of the bigint keys, and the expressions for a key's word and bit in it."""
    word = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(FILTER_WORDS))
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(name)))
    return keys.groupBy(word(F.col(name)).alias("_word")).agg(F.bit_or(one).alias("_bits")), word, bit


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose bigint ``key`` may be among ``keys[name]``: all that are, and a few that are not.

    The keys become a bit table of fixed size, the only thing that is broadcast, so the bound holds for any input; with
    very many keys it lets more through, and callers join on the key anyway.
    """
    bits, word, bit = filter_bits(keys, name)
    there = F.call_function("shiftright", F.col("_bits"), bit(key)).bitwiseAND(F.lit(1).cast("long")) == 1
    return df.join(F.broadcast(bits), word(key) == F.col("_word")).where(there).drop("_word", "_bits")


def among(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose bigint ``key`` is one of ``keys[name]``; others are left where they are, as far as the bit table tells.

    An inner join on distinct keys, since the optimizer would move a semi-join below the bit table and shuffle every row.
    """
    return maybe_in(df, key, keys, name).withColumn("_key", key).join(keys.select(F.col(name).alias("_key")).distinct(), "_key").drop("_key")


def without(df: DataFrame, id_col: str, drop: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose id is not in ``drop[name]`` (bigint, nulls allowed); the texts of most rows don't move.

    A bit table of fixed size lets rows that are surely not in ``drop`` pass as they are; the rest are joined by id.
    """
    drop = cut(drop.select(F.col(name).cast("long").alias("_drop")).distinct())
    hit = drop.where("_drop is not null")
    bits, word, bit = filter_bits(hit, "_drop")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    marked = df.join(F.broadcast(bits), word(key) == F.col("_word"), "left").withColumn("_maybe", F.coalesce(F.call_function("shiftright", F.col("_bits"), bit(key)).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False)) | F.col(id_col).isNull())
    sure = marked.where(~F.col("_maybe")).select(*[F.col(c) for c in df.columns])
    rest = marked.where("_maybe").select(*[F.col(c) for c in df.columns])
    return sure.unionByName(rest.join(drop, rest[id_col].cast("long").eqNullSafe(drop["_drop"]), "left_anti"))


def row_hash(text_col: str) -> Column:
    """What tells rows of one id apart: a hash of the text."""
    return F.xxhash64(F.col(text_col))


def without_rows(df: DataFrame, id_col: str, text_col: str, drop: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id and text are not among ``doc_id, row`` of ``drop``; the texts of most rows don't move.

    A row with ``once`` in ``drop`` is not dropped: of all rows of that id and text, one stays.  Null ids are ids like any
    other.  As in ``without``, a bit table of fixed size lets the rows that are surely not in ``drop`` pass as they are.
    """
    drop = cut(drop.select(F.col("doc_id").cast("long").alias("_doc"), F.col("row").alias("_row"), "once").distinct())
    pair = lambda i, row: F.xxhash64(F.coalesce(i, F.lit(0).cast("long")), i.isNull(), row)
    bits, word, bit = filter_bits(drop.select(pair(F.col("_doc"), F.col("_row")).alias("_pair")), "_pair")
    key = pair(F.col(id_col).cast("long"), row_hash(text_col))
    there = F.call_function("shiftright", F.col("_bits"), bit(key)).bitwiseAND(F.lit(1).cast("long")) == 1
    marked = df.join(F.broadcast(bits), word(key) == F.col("_word"), "left").withColumn("_maybe", F.coalesce(there, F.lit(False)))
    mine = [F.col(c) for c in df.columns]
    sure, rest = marked.where(~F.col("_maybe")).select(*mine), marked.where("_maybe").select(*mine, row_hash(text_col).alias("_mine"))
    rest = rest.join(drop, rest[id_col].cast("long").eqNullSafe(drop["_doc"]) & (rest["_mine"] == drop["_row"]), "left").where("_row is null or once")
    single = rest.where("once").dropDuplicates([id_col, "_mine"])
    return sure.unionByName(rest.where("once is null").select(*mine)).unionByName(single.select(*mine))


def all_but_one(rows: DataFrame) -> DataFrame:
    """``doc_id, row, once`` of what goes when one row of each group stays: ``rows`` has ``doc_id, row, part``, a row for each document.

    The one with the smallest id stays (an id before none, then the smaller hash); ``once`` marks it where it repeats.
    """
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    rows = rows.groupBy("part", "doc_id", "row").agg(F.count("*").alias("n"))
    first = rows.groupBy("part").agg(F.min(order).alias("first"))
    met = rows.join(first, rows["part"].eqNullSafe(first["part"])).select("doc_id", "row", "n", (order == F.col("first")).alias("stays"))
    # compared as structs, a null id equals a null id
    return met.where("not stays or n > 1").select("doc_id", "row", F.when(F.col("stays"), F.lit(True)).otherwise(F.lit(False)).alias("once"))


def inline(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A local relation of literals."""
    value = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)} as t({names})")
