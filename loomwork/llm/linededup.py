"""Near-duplicate lines by a segment-partition edit-distance join, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, cut, maybe_in, stash

#: An index key that more lines share than this is split by further segments of what it leaves open.
CROWD = 32
#: Candidate pairs for each task that verifies some.
PAIRS = 20_000
Steps = tuple[tuple[int, int], ...]
#: Characters whose counts tell most pairs of a key apart: an edit changes two of them by one.
COUNTED = "etaoinshrdlucmfwygpbvkjxqz ,.0123456789#*$%&|<>"
#: Edits within which two lines are near copies, from so many characters of the shorter one on.
STEPS: Steps = ((20, 1), (40, 2), (60, 3))
#: Lines without such a character (blank ones) always stay.
INK = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where an expression inside a lambda would run at each mention."""
    return F.get(F.transform(F.array(value), body), 0)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings in code points, or more than ``threshold`` if it is more.

    What the strings share at either end is cut off by bisection.  The rest is run through a band of 2*threshold+2
    diagonals, whose vertical differences are bits of one integer (Hyyro's banded variant of Myers' algorithm): a column
    costs a few integer operations, and columns after a certain miss cost nothing.
    """
    short = F.least(F.char_length(a), F.char_length(b))
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    bisect = lambda n, same: F.aggregate(F.sequence(F.length(F.bin(n.cast("long"))), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda low, k: F.when((low + power(k) <= n) & same(low + power(k)), low + power(k)).otherwise(low))
    part = lambda s, at, n: F.substring(s, at.cast("int"), n.cast("int"))
    head = bisect(short, lambda n: part(a, F.lit(1), n) == part(b, F.lit(1), n))

    def without_head(h: Column) -> Column:
        rest = lambda s: part(s, h + 1, F.char_length(s))
        return let(F.struct(rest(a).alias("a"), rest(b).alias("b")), without_tail)

    def without_tail(ab: Column) -> Column:
        x, y = ab["a"], ab["b"]
        n = F.least(F.char_length(x), F.char_length(y))
        tail = bisect(n, lambda k: part(x, F.char_length(x) - k + 1, k) == part(y, F.char_length(y) - k + 1, k))
        mid = lambda s, t: part(s, F.lit(1), F.char_length(s) - t)
        return let(tail, lambda t: let(F.struct(mid(x, t).alias("a"), mid(y, t).alias("b")), middle))

    def middle(ab: Column) -> Column:
        la, lb = F.char_length(ab["a"]), F.char_length(ab["b"])
        pad = F.array_repeat(F.lit(""), threshold + 1)  # an end that both share, so that each is longer than the band's half
        chars = F.struct(F.concat(F.split(ab["a"], ""), pad).alias("p"), F.concat(F.split(ab["b"], ""), pad).alias("t"))
        return F.when(F.abs(la - lb) > threshold, threshold + 1).when(F.least(la, lb) == 0, F.greatest(la, lb)).otherwise(let(chars, lambda c: _band(c["p"], c["t"], threshold)))

    return let(head, without_head).cast("int")


def _band(p: Column, t: Column, k: int) -> Column:
    width = 2 * k + 2
    if width > 60:
        raise ValueError("the band must fit an integer: threshold of at most 29")
    every, top = (1 << width) - 1, 1 << (width - 1)
    long = lambda v: F.lit(v).cast("long")
    both, either = lambda x, y: x.bitwiseAND(y), lambda x, y: x.bitwiseOR(y)
    flip = lambda x: x.bitwiseXOR(long(every))
    right = lambda x: F.call_function("shiftright", x, F.lit(1))
    n, m = F.size(p), F.size(t)

    def column(s: Column, i: Column) -> Column:
        ch, hits = F.get(t, i), long(0)
        for b in range(width):
            at = i + (k + 1 - width + b)
            hits = hits + F.when((at >= 0) & (at < n) & F.coalesce(F.get(p, at) == ch, F.lit(False)), long(1 << b)).otherwise(long(0))
        d0 = lambda x: both(either(either((both(x, s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]), x), s["vn"]), long(every))

        def after(d: Column) -> Column:
            return let(F.struct(either(s["vn"], flip(either(d, s["vp"]))).alias("hp"), both(d, s["vp"]).alias("hn"), right(d).alias("d1"), both(d, long(top)).alias("top")), step)

        def step(h: Column) -> Column:
            spot = F.call_function("shiftright", long(top >> 1), F.greatest(i - (n - k), F.lit(0)))
            below = s["dist"] + F.when(h["top"] == 0, 1).otherwise(0)
            level = s["dist"] + F.when(both(h["hp"], spot) != 0, 1).otherwise(0) - F.when(both(h["hn"], spot) != 0, 1).otherwise(0)
            return F.struct(both(either(h["hn"], flip(either(h["d1"], h["hp"]))), long(every)).alias("vp"), both(h["d1"], h["hp"]).alias("vn"), F.when(i < n - k, below).otherwise(level).alias("dist"))

        return F.when(s["dist"] > 2 * k + m - n, s).otherwise(let(hits, lambda x: let(d0(x), after)))

    start = F.struct(long(every ^ ((1 << (width - k - 1)) - 1)).alias("vp"), long(0).alias("vn"), F.lit(k).alias("dist"))
    return F.aggregate(F.sequence(F.lit(0), m - 1), start, column, lambda s: s["dist"])


def _zones(threshold: int) -> tuple[int, int]:
    """Edits that the segments at the left and at the right end allow for: of more edits in both there would be too many in all."""
    left = (threshold - 1) // 2
    return left, threshold - 1 - left


def _end_spots(threshold: int) -> list[tuple[int, int, int]]:
    """``(from the right end, number, shift)`` of the threshold+1 segments; shift 0 is indexed, and all are probed for.

    A zone that holds no more edits than it allows for has a segment that is intact, with as many edits between the end
    and it as its number tells.  Where one edit is allowed, the line that is longer there probes one place further in.
    """
    out = []
    for right, most in enumerate(_zones(threshold)):
        out += [(right, j, t) for j in range(most + 1) for t in (range(j + 1) if most == 1 else range(-j, j + 1))]
    return out


def _edits(n: Column, steps: Steps) -> Column:
    """Edits allowed where the shorter line has n characters; 0 below the first step."""
    out = F.lit(0)
    for least, threshold in steps:
        out = F.when(n >= least, threshold).otherwise(out)
    return out


def _class(n: Column, steps: Steps) -> Column:
    """The least length of n's class: classes are quarters of octaves, cut where a step begins."""
    out = n - n % F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(n.cast("long"))) - 3, F.lit(0)))
    for least, _ in steps:
        out = F.greatest(out, F.when(n >= least, least).otherwise(0))  # mentions itself once, else the code doubles with each step
    return out


def _keyed(rows: DataFrame, steps: Steps) -> DataFrame:
    """``id, base, edits, key, probe, at, size``: the keys of lines ``id, base, text, n``, and the places of their segments.

    A key is the hash of base, length class, segment and what stands there.  A line takes part in its own length class and
    in those of lines shorter by the edits allowed.  A pair meets in the class of the shorter line, which sets the size of
    its segments.

    Classes, then segments, are dealt out as rows, each with one short expression: one expression for all of them is a
    method of more code than Java compiles.
    """
    n, m, most = F.col("n").cast("long"), F.col("n") - F.col("less"), max(k for _, k in steps)
    less = F.when(n - _class(n, steps) >= most, F.lit([0])).otherwise(F.lit(list(range(most + 1))))
    rows = rows.select("id", "base", "text", n.alias("n"), F.explode(less).alias("less")).withColumn("edits", _edits(m, steps))
    rows = rows.where((F.col("edits") > 0) & (F.col("edits") >= F.col("less")) & ((F.col("less") == 0) | (_class(m + 1, steps) == m + 1)))
    spots = F.lit(None)
    for k in sorted({k for _, k in steps}):
        spots = F.when(F.col("edits") == k, F.lit([((right * 64 + j) << 8) + t + 64 for right, j, t in _end_spots(k)])).otherwise(spots)
    rows = rows.select("id", "base", "text", "n", "edits", _class(m, steps).alias("length"), spots.alias("spots"))
    rows = rows.select("id", "base", "text", "n", "edits", "length", F.call_function("div", F.col("length") - F.col("edits") + 1, F.col("edits") + 1).alias("size"), F.explode("spots").alias("spot"))
    t, j, right = F.col("spot") % 256 - 64, F.call_function("shiftright", "spot", F.lit(8)) % 64, F.call_function("shiftright", "spot", F.lit(14))
    rows = rows.withColumn("at", F.when(right == 1, F.col("n") - (j + 1) * F.col("size") - t).otherwise(j * F.col("size") + t))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    key = F.xxhash64("base", "length", 2 * j + right, F.substring("text", (F.col("at") + 1).cast("int"), F.col("size").cast("int")))
    return rows.select("id", "base", F.col("edits").cast("long").alias("edits"), key.alias("key"), (t != 0).alias("probe"), "at", "size")


def _keyed_rests(rows: DataFrame, kinds: list[int]) -> DataFrame:
    """The same of rests ``id, base, edits, text, n``, of any length.

    Where few characters are left, the segments are cut from the left alone, by the length of the longer line.  Rests of
    no more characters than edits are all near one another: they share one key, of size 0.
    """
    n, e, cells = F.col("n").cast("long"), F.col("edits"), []
    for d in range(kinds[-1] + 1):
        cells += [F.when((e >= d) & (n - d >= 2 * e), _class(n - d, ()) * 64), F.when((e >= d) & (n + d > e) & (n + d < 3 * e), (n + d) * 64 + 1)]
    cells = F.array_distinct(F.array(*cells, F.when(n <= e, F.lit(2).cast("long"))))
    rows = rows.select("*", F.explode(cells).alias("cell")).where("cell is not null")
    kind, spots = F.col("cell") % 64, F.array(F.struct(F.lit(0).alias("right"), F.lit(0).alias("j"), F.lit(0).alias("t")))
    spot = lambda right, j, t: F.struct(F.lit(right).alias("right"), F.lit(j).alias("j"), F.lit(t).alias("t"))
    for k in kinds:
        spots = F.when((kind == 0) & (e == k), F.array(*[spot(*x) for x in _end_spots(k)])).when((kind == 1) & (e == k), F.array(*[spot(2, j, t) for j in range(k + 1) for t in range(-j, j + 1)])).otherwise(spots)
    rows = rows.select("id", "base", "edits", "text", n.alias("n"), kind.alias("kind"), F.call_function("shiftright", "cell", F.lit(6)).alias("length"), F.explode(spots).alias("s"))
    size = F.when(F.col("kind") == 0, F.call_function("div", F.col("length") - e + 1, e + 1)).when(F.col("kind") == 1, F.call_function("div", "length", e + 1)).otherwise(0)
    j, t, right = F.col("s.j"), F.col("s.t"), F.col("s.right")
    rows = rows.withColumn("size", size)
    rows = rows.withColumn("at", F.when(right == 1, F.col("n") - (j + 1) * F.col("size") - t).otherwise(j * F.col("size") + t)).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    key = F.xxhash64("base", "kind", "length", right, j, F.substring("text", (F.col("at") + 1).cast("int"), F.col("size").cast("int")))
    return rows.select("id", "base", "edits", key.alias("key"), ((t != 0) | ((F.col("kind") == 1) & (F.col("n") != F.col("length")))).alias("probe"), "at", "size")


def _holds_parts(a: Column, n: Column, b: Column, k: int) -> Column:
    """Whether ``b`` holds all but ``k`` of 2k+2 parts of ``a``, as it does if no more than ``k`` edits lie between."""
    parts = 2 * k + 2
    cut_at = lambda i: F.call_function("div", n * i, F.lit(parts)).cast("int")
    there = [F.contains(b, F.substring(a, cut_at(i) + 1, cut_at(i + 1) - cut_at(i))).cast("int") for i in range(parts)]
    return reduce(Column.__add__, there) >= parts - k


def _near(pairs: DataFrame, texts: DataFrame, steps: Steps) -> DataFrame:
    """``id`` of the later line of each of the pairs ``r, s`` that is near; ``texts`` has ``id, line, n, place``."""
    pairs = cut(pairs)
    x, y = (texts.select(F.col("id").alias(p), F.col("line").alias(f"line_{p}"), F.col("n").alias(f"n_{p}"), F.col("place").alias(f"place_{p}")) for p in "rs")
    edits, apart = _edits(F.least("n_r", "n_s"), steps), F.abs(F.col("n_r") - F.col("n_s"))
    likely, near = F.lit(False), F.lit(False)
    for k in sorted({k for _, k in steps}):
        likely = F.when(edits == k, _holds_parts(F.col("line_r"), F.col("n_r"), F.col("line_s"), k)).otherwise(likely)
        near = F.when(edits == k, banded_distance(F.col("line_r"), F.col("line_s"), k) <= k).otherwise(near)
    # a cheap test lets few other pairs through; those are dealt out evenly, since the distance costs more than its bytes tell
    met = pairs.join(x, "r").join(y, "s").where((apart <= edits) & likely).repartition(pairs.count() // PAIRS + 1)
    return met.where(near).select(F.when(F.col("place_r") > F.col("place_s"), F.col("r")).otherwise(F.col("s")).alias("id")).distinct()


def _meetings(asks: DataFrame, met: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs ``r, s`` of lines that share a key and may be near: each line of ``asks`` with all earlier ones of ``met``, once for each number of edits.

    Both have ``key, id, edits, probe, place``; ``pool`` has ``id, n, counts``.  Lines of a key meet by length, in one cell
    of twice the edits or in the one beside it.  Two lines that share several keys meet under the least of them.
    """
    cell = lambda more: F.floor((F.col("n") + more) / (2 * F.col("edits"))).alias("cell")
    apart = reduce(Column.__add__, [F.abs(F.get("cx", i) - F.get("cy", i)) for i in range(len(COUNTED))])
    mine = met.groupBy("id", "edits").agg(F.collect_set("key").alias("all"), F.collect_set(F.when(~F.col("probe"), F.col("key"))).alias("own"))
    told = cut(mine.join(pool.select("id", "n", "counts"), "id"))
    least = F.array_min(F.array_union(F.array_intersect("ownx", "ally"), F.array_intersect("allx", "owny")))

    def side(rows: DataFrame, line: str, name: str, cells: Column) -> DataFrame:
        named = {"id": line, "place": f"p{name}", "probe": f"b{name}", "n": f"n{name}", "counts": f"c{name}", "all": f"all{name}", "own": f"own{name}"}
        return rows.join(told, ["id", "edits"]).select("key", "edits", *[F.col(c).alias(x) for c, x in named.items()], cells)

    x = side(asks, "r", "x", F.explode(F.array_distinct(F.array(cell(-F.col("edits")), cell(F.col("edits"))))).alias("cell"))
    y = side(met, "s", "y", cell(F.lit(0))).drop("edits")
    may = (F.col("px") > F.col("py")) & ~(F.col("bx") & F.col("by")) & (F.abs(F.col("nx") - F.col("ny")) <= F.col("edits"))
    return x.join(y, ["key", "cell"]).where(may & (apart <= 2 * F.col("edits")) & (least == F.col("key"))).select("r", "s")


def later_lines(lines: DataFrame, steps: Steps) -> DataFrame:
    """``id`` of every line of the line table that is near one whose first occurrence came before.

    Every two lines within the edits share a segment key.  One aggregation tells how many lines have a key, and which two
    if they are two; combined before the shuffle, so a key of a third of all lines costs no more than another.  Only the
    lines of fuller keys are looked up again.  There, each line is first compared with the earliest of its key: one pair a
    line, which settles most of a group of near copies.  Lines still open meet all earlier ones of the key, unless they
    are more than ``CROWD`` (a template): then the lines take part again with what the segment leaves open, cut into
    segments in turn, under a key that the old one is hashed into.  A pair within the threshold also meets there, since
    its edits all lie in the open rest.  So the keys of a crowd narrow down, level by level, to lines that agree in all
    but a few characters.
    """
    place = F.struct("doc", "row", "pos").alias("place")
    long = lines.where(F.col("n") >= steps[0][0])
    rows = long.select("id", F.lit(0).cast("long").alias("base"), F.col("line").alias("text"), "n")
    kinds = sorted({k for _, k in steps})
    keyed, pool, gone, pairs = _keyed(rows, steps), None, None, []
    while True:
        who = F.col("id") * 2 + F.col("probe").cast("long")
        held = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(who).alias("a"), F.max(who).alias("b"), F.min("probe").alias("probe"))
        held = cut(held.where("n > 1 and not probe").drop("probe"))
        a, b = (F.call_function("shiftright", F.col(c), F.lit(1)) for c in "ab")
        pairs.append(held.where("n = 2").select(a.alias("r"), b.alias("s")).where("r <> s"))
        busy = held.where("n > 2").select("key", F.col("n").alias("held"))
        if busy.isEmpty():
            break
        met = cut(maybe_in(keyed, F.col("key"), busy, "key").join(busy, "key").select("key", "held", "id", "base", "edits", "probe", "at", "size"))
        if pool is None:
            counts = F.array(*[(F.char_length("line") - F.char_length(F.replace("line", F.lit(c), F.lit("")))) for c in COUNTED]).alias("counts")
            pool = stash(among(long.select("id", "line", "n", place), F.col("id"), met, "id").select("*", counts))
        met = met.join(pool.select("id", "place"), "id")
        met = cut(met.join(met.groupBy("key").agg(F.min(F.struct("place", "id")).alias("low")).select("key", F.col("low.id").alias("low")), "key"))
        new = _near(met.where("id <> low").select(F.col("low").alias("r"), F.col("id").alias("s")).distinct(), pool, steps)
        gone = cut(new if gone is None else gone.unionByName(new).distinct())
        asks = met.where("id <> low").join(gone, "id", "left_anti")
        few = (F.col("held") <= CROWD) | (F.col("edits") > 1)
        pairs.append(cut(_meetings(asks.where(few), met.where(few), pool)))
        many = met.join(asks.where(~few).select("key").distinct(), "key", "left_semi").select("key", "id", "base", "edits", "at", "size")
        texts = rows.withColumnRenamed("base", "_base") if "edits" not in rows.columns else rows.drop("edits").withColumnRenamed("base", "_base")
        texts = maybe_in(texts, F.col("id"), many.select("id").distinct(), "id")
        rest = F.concat(F.substring("text", F.lit(1), F.col("at").cast("int")), F.substring("text", (F.col("at") + F.col("size") + 1).cast("int"), F.col("n")))
        more = many.join(texts, "id").where(F.col("base") == F.col("_base"))
        rows = stash(more.select("id", F.col("key").alias("base"), "edits", rest.alias("text"), (F.col("n") - F.col("size")).cast("int").alias("n")).distinct())
        if rows.isEmpty():
            break
        keyed = _keyed_rests(rows, kinds)
    pairs = cut(reduce(DataFrame.unionByName, pairs).distinct())
    ids = pairs.select(F.col("r").alias("i")).unionByName(pairs.select(F.col("s").alias("i")))
    found = _near(pairs, maybe_in(long.select("id", "line", "n", place), F.col("id"), ids, "i"), steps)
    return found if gone is None else found.unionByName(gone).distinct()


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct lines with a character that is no white space: ``id, line, n, doc, row, pos``: n its length, the last three its first occurrence."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(INK))
    rows = rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"), F.struct("doc", "row", "pos").alias("at"), "line")
    groups = rows.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("line").alias("line"))
    return stash(groups.select(F.monotonically_increasing_id().alias("id"), "line", F.char_length("line").alias("n"), "at.*"))


def _kept(docs: DataFrame, id_col: str, text_col: str, steps: Steps) -> DataFrame:
    """``__doc, __row, __kept``: the places of the lines that stay, blank ones aside, of every distinct (id, text) that keeps one."""
    lines = line_table(docs, id_col, text_col)
    places = lines.select("id", "doc", "row", "pos")
    stay = places.join(later_lines(lines, steps), "id", "left_anti").groupBy("doc", "row").agg(F.sort_array(F.collect_list("pos")).alias("kept"))
    return cut(stay.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("kept").alias("__kept")))


def _rewritten(docs: DataFrame, id_col: str, text_col: str, steps: Steps) -> DataFrame:
    """``docs`` with all columns and rows, the lines of each text (``__lines``), the places that stay (``__stay``) and the new text (``__text``).

    The texts move once, to meet the places of their lines.
    """
    if any(k < 1 or least < 2 * k for least, k in steps) or list(steps) != sorted(set(steps)):
        raise ValueError("steps must ascend, and lines be twice as long as the edits, so that each segment has a character")
    kept = _kept(docs, id_col, text_col, steps)
    text = F.col(text_col)
    rows = docs.withColumn("__hash", F.xxhash64(text))
    rows = rows.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__row")), "left")
    rows = rows.withColumn("__lines", F.split(text, "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: ~F.get(F.col("__lines"), i).rlike(INK))
    rows = rows.withColumn("__stay", F.when(text.isNotNull(), F.sort_array(F.concat(blank, F.coalesce("__kept", F.array().cast("array<int>"))))))
    new = F.array_join(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)), "\n")
    return rows.withColumn("__text", F.when(F.size("__stay") == F.size("__lines"), text).otherwise(new))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: Steps = STEPS) -> DataFrame:
    """``doc_id, n_lines, n_kept, text`` of every row: the text without lines that came before.

    Lines are what stands between line feeds.  In the order (id, hash of the text, line number), a line of any length goes
    if an equal one came before, or if it lies within some edits of a different line whose first occurrence came before:
    ``steps`` tells how many, by the length of the shorter of the two.  Lines shorter than the first step have to be
    equal; blank ones always stay.  All lines of all documents are compared, whatever their length.

    Rows of one id with different texts stay apart; rows equal in both count once, and all come back with the same lines
    kept.  A null text stays null with no lines; an empty text is one blank line and stays empty; a text that loses every
    line becomes empty.  Null ids come first in the order.  An empty table gives an empty result; other columns are
    ignored.
    """
    done = _rewritten(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", steps)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines"))
    return done.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.when(F.col("text").isNotNull(), F.size("__stay")), F.lit(0)).alias("n_kept"), F.col("__text").alias("text"))


def replace_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: Steps = STEPS) -> DataFrame:
    """``docs`` with its texts without repeated lines, as ``dedup_lines`` has them; all rows and columns stay (``n_chars``, if there, follows the text)."""
    done = _rewritten(docs, id_col, text_col, steps)
    change = {text_col: F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return done.select(*[change[c].alias(c) if c in change else F.col(c) for c in docs.columns])
