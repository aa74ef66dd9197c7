"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_hash, without_rows

#: Fixed masks of eight tokens; a 0 is ignored.  Together they hit every window of 13 tokens with any two of them
#: replaced, and every window of 9 to 12 with any one replaced (checked exhaustively in the tests).
MASKS = ("11101101", "11100111", "10101111")
SPAN = len(MASKS[0])
WINDOW = 13
#: Up to so many seed rows of the benchmark (40 bytes each) and its items are broadcast; beyond, positions are joined by a shuffle.
BROADCAST_SEEDS = 100_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def allowed(n: Column) -> Column:
    """Replaced tokens that are tolerated in the window of an item of n tokens: 2 of 13, 1 of 9 to 12, else none."""
    return F.when(n >= WINDOW, 2).when(n > SPAN, 1).otherwise(0)


def _seed(words: Column, at: Column, kind: int, offsets: list[int]) -> Column:
    return F.xxhash64(F.lit(kind), *[F.get(words, at + o) for o in offsets])


def _seeds(df: DataFrame, keep: list[str], short: list[int]) -> list[DataFrame]:
    """A row per position and mask with the hash of the tokens that the mask keeps; one table more for whole runs of each length in ``short``.

    The positions come from a generator over (position, mask) numbers and the hash from one expression on the row's word
    array, so the scan, the hashing and a broadcast join stay in one generated loop and no row is shuffled.  The tables
    stay apart up to that join: a union before it would make a row with all words of each position.
    """
    words, n, k = F.col("words"), F.size("words"), F.col("k")
    spans = [(kind, SPAN, [o for o, c in enumerate(m) if c == "1"]) for kind, m in enumerate(MASKS)]
    out = []
    for kinds, span in [(spans, SPAN)] + [([(len(MASKS) + s, s, list(range(s)))], s) for s in short]:
        count = (n - span + 1) * len(kinds)
        numbers = F.when(n >= span, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))  # a filter would cut the words a second time
        rows = df.select(*keep, "words", F.explode(numbers).alias("k"))
        at = F.floor(k / len(kinds)).cast("int") if len(kinds) > 1 else k
        key = _seed(words, at, *kinds[-1][::2])
        for i, (kind, _, offsets) in enumerate(kinds[:-1]):
            key = F.when(k % len(kinds) == i, _seed(words, at, kind, offsets)).otherwise(key)
        out.append(rows.select(*keep, "words", at.alias("at"), F.lit(span).alias("span"), key.alias("key")))
    return out


def _near(words: Column, at: Column, span: Column) -> Column:
    """The tokens from which a window that holds the seed at ``at`` can be read: ``lead`` tokens before it, and those after."""
    lead = F.least(at, WINDOW - span)
    return F.struct(lead.alias("lead"), F.slice(words, at - lead + 1, lead + WINDOW).alias("tokens"))


def _overlap(near: Column, item: Column, item_at: Column, span: Column) -> Column:
    """Most equal tokens in a window of the item that holds the seed and lies on its alignment."""
    n = F.size(item)
    wide = F.least(n, F.lit(WINDOW))
    starts = F.sequence(F.greatest(F.lit(0), item_at + span - wide), F.least(item_at, n - wide))
    same = lambda s: F.size(F.filter(F.sequence(F.lit(0), wide - 1), lambda x: F.coalesce(F.get(item, s + x) == F.get(near["tokens"], near["lead"] - item_at + s + x), F.lit(False))))
    return F.array_max(F.transform(starts, same))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, row, item_id, overlap, window`` for every document that holds a passage of a benchmark item; ``row`` is the hash of its text.

    A passage is a window of 13 tokens of the item (all of it, if shorter) that stands in the document with at most two
    tokens replaced (one for items of 9 to 12 tokens, none below).  The masks find every such window; each hit is
    verified along its alignment and the best overlap of an item counts.

    Items without a token match nothing; documents that are null, empty or without tokens hold nothing.  Documents are
    told apart by id and text: texts that share an id, or have none, are found each for itself.  Repeated rows and items
    give one row per (document, item).  Either table may be empty.  Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    short = sorted(r[0] for r in items.where(F.size("words") <= SPAN).select(F.size("words")).distinct().collect())
    seeds = _seeds(items.where(F.size("words") > SPAN), ["item_id"], [])[0]
    for s in short:
        mine = items.where(F.size("words") == s)
        seeds = seeds.unionByName(mine.select("item_id", "words", F.lit(0).alias("at"), F.lit(s).alias("span"), _seed(F.col("words"), F.lit(0), len(MASKS) + s, list(range(s))).alias("key")))
    seeds = cut(seeds.select("item_id", F.col("at").alias("item_at"), "key").distinct())
    items = items.select("item_id", F.col("words").alias("item")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), tokens(F.col(text_col)).alias("words"))
    found = _seeds(rows, ["doc_id", "row"], short)
    if seeds.count() <= BROADCAST_SEEDS:
        # a hit takes along the few tokens around it, not the document's; verification waits for the second join, since
        # its lambdas in the first one's condition would break up the generated loop
        near = _near(F.col("words"), F.col("at"), F.col("span")).alias("near")
        hits = reduce(DataFrame.unionByName, [f.join(F.broadcast(seeds), "key").select("doc_id", "row", "item_id", "item_at", "span", near) for f in found])
        hits = hits.join(F.broadcast(items), "item_id")
    else:  # only positions travel; the words of the two sides meet again at the alignments that a seed has hit
        met = reduce(DataFrame.unionByName, [f.select("doc_id", "row", "at", "span", "key") for f in found]).join(seeds, "key").select("doc_id", "row", "item_id", "at", "item_at", "span").distinct()
        texts = rows.dropDuplicates(["doc_id", "row"])
        hits = met.join(texts, met["doc_id"].eqNullSafe(texts["doc_id"]) & (met["row"] == texts["row"])).select(met["doc_id"], met["row"], "item_id", "item_at", "span", _near(F.col("words"), F.col("at"), F.col("span")).alias("near"))
        hits = hits.join(items, "item_id")
    checked = hits.select("doc_id", "row", "item_id", _overlap(F.col("near"), F.col("item"), F.col("item_at"), F.col("span")).alias("overlap"), F.size("item").alias("n"))
    passed = checked.where(F.col("overlap") >= F.least("n", F.lit(WINDOW)) - allowed(F.col("n")))
    return passed.groupBy("doc_id", "row", "item_id").agg(F.max("overlap").alias("overlap"), F.least(F.max("n"), F.lit(WINDOW)).alias("window"))


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, contaminated, n_items`` for every row of ``docs``, each judged by its own text."""
    found = contaminated(docs, benchmark, id_col, text_col).groupBy(F.col("doc_id").alias("hit"), F.col("row").alias("hit_row")).agg(F.count("*").alias("n"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit")) & (F.col("row") == F.col("hit_row")), "left")
    return rows.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no passage of the benchmark; ids don't matter, null or repeated."""
    return without_rows(docs, id_col, text_col, contaminated(docs, benchmark, id_col, text_col).select("doc_id", "row", F.lit(False).alias("once")))


#: Brute force in DuckDB: every run of four tokens (any window within the tolerance holds one, by pigeonhole) of the
#: documents meets those of the items, and each alignment is compared token by token.
ORACLE_SQL = r"""
with toks as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
its as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark),
dg as (select doc_id, i, array_to_string(w[i:i+3], ' ') g from toks, unnest(range(1, greatest(len(w) - 2, 1))) u(i)),
ig as (select item_id, i, array_to_string(w[i:i+3], ' ') g from its, unnest(range(1, greatest(len(w) - 2, 1))) u(i) where len(w) >= 4),
al as (select distinct doc_id, item_id, dg.i - ig.i d from dg join ig using (g)),
cmp as (select doc_id, item_id, its.w iw, least(len(its.w), 13) win, list_transform(range(1, len(its.w) + 1), lambda x: case when x + d >= 1 and toks.w[x + d] = its.w[x] then 1 else 0 end) eq from al join toks using (doc_id) join its using (item_id)),
best as (select doc_id, item_id, max(list_max(list_transform(range(1, len(iw) - win + 2), lambda s: list_sum(eq[s:s + win - 1])))) overlap, max(win) win, max(len(iw)) n from cmp group by all),
hit as (select doc_id, count(*) n from best where overlap >= win - case when n >= 13 then 2 when n > 8 then 1 else 0 end group by 1)
select documents.doc_id, hit.n is not null as contaminated, coalesce(hit.n, 0) as n_items from documents left join hit using (doc_id)
"""
