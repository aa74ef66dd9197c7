"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, maybe_in

#: Bytes of wrappers that are broadcast at most, those of the hosts with the most pages first; pages of other hosts are joined by a shuffle.
BROADCAST_BYTES = 48_000_000

#: Pages of a host from which its wrapper is inferred, at most: the documented bound of the sample; all pages are extracted.
SAMPLE = 12

# Names from the HTML standard and usual class names.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul iframe svg video audio canvas object template".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg noscript iframe textarea select object canvas video audio".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "button", "option", "optgroup"}
#: An element that opens inside an open one of the listed names, with none of the stops between, closes it first.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
NEVER = frozenset("head title select textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog legend fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation navi breadcrumb breadcrumbs header masthead "
    "topbar footer bottom foot comment comments disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended widget pagination pager copyright toolbar tags".split()
)
MAIN = frozenset(("article", "main"))
NEGATIONS = frozenset("no not without has with".split())
#: Blocks that hold a piece of text, not a region of the page.
LEAVES = frozenset("p li td th h1 h2 h3 h4 h5 h6 pre blockquote dd dt tr ul ol dl table tbody".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_CUT = re.compile(r"[-_:.]+")


def _hints_aside(token: str) -> bool:
    """Whether a class, id or role names something that stands beside the text; "no-sidebar" does not."""
    parts = _CUT.split(token)
    return (parts[0] in ASIDE_WORDS or parts[-1] in ASIDE_WORDS) and not NEGATIONS.intersection(parts)


def _label(name: str, attrs: str) -> str:
    """An element's name, its first class (or id) if that has no digit, and a mark if class, id or role hint that it stands beside the text."""
    if "=" not in attrs:
        return name
    found = [(m[1].lower(), t) for m in _LABEL.finditer(attrs) for t in m[2].strip("\"'").lower().split()]
    kind = next((t for k, t in sorted(found, key=lambda f: f[0] != "class") if k != "role" and not any(c.isdigit() for c in t)), "")
    return name + ("." + kind if kind else "") + ("!" if any(_hints_aside(t) for _, t in found) else "")


def _name(label: str) -> str:
    return label.partition(".")[0].rstrip("!")


def tokens(page: str) -> list[tuple[str, str]]:
    """Block elements as ``("<", label)`` and ``(">", label)``, well nested, and the text between as ``("t", text)``.

    Inline elements leave no token; a line break counts as a space.  Scripts, styles and comments are left out; what the
    page leaves open is closed where the next element ends it, or at the end.
    """
    out: list[tuple[str, str]] = []
    stack: list[str] = []  # labels of the open block elements
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(("t", text))

    def close(n: int) -> None:
        flush()
        while len(stack) > n:
            out.append((">", stack.pop()))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                for k in range(len(stack) - 1, -1, -1):
                    if _name(stack[k]) == name:
                        close(k)
                        break
            continue
        if name in SILENT and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in BLOCKS:
            if name == "br":
                held.append(" ")
            continue
        if name in CLOSES_P and stack and stack[-1] == "p":
            close(len(stack) - 1)
        elif name in ENDS:
            ends, stops = ENDS[name]
            for k in range(len(stack) - 1, -1, -1):
                bare = _name(stack[k])
                if bare in ends:
                    close(k)
                    break
                if bare in stops:
                    break
        flush()
        if name not in VOID:
            label = _label(name, m[3])
            stack.append(label)
            out.append(("<", label))
    close(0)
    return out


#: A node of a folded page: its key, and the texts at each of its text places (one list per place).
Node = tuple[tuple, list[list[str]]]


def _keys(nodes: list[Node]) -> tuple:
    return tuple(n[0] for n in nodes)


def _absorb(into: list[list[str]], group: list[Node]) -> None:
    place = 0
    for _, texts in group:
        for t in texts:
            into[place] += t
            place += 1


def _whole(keys: tuple) -> bool:
    """Whether a run of keys is one or more whole elements."""
    depth = 0
    for k in keys:
        depth += (k[0] == "<") - (k[0] == ">")
        if depth < 0:
            return False
    return depth == 0 and keys[0][0] == "<"


def fold(toks: list[tuple[str, str]], groups: frozenset = frozenset(), siblings: int = 12) -> list[Node]:
    """The page with each run of like elements as one repeated group ``("+", keys)``; so are lone ones of known ``groups``.

    The unit of a group is an element of any size, or several that stand side by side with ``siblings`` nodes in all.
    """
    nodes: list[Node] = []
    begun: list[int] = []  # where the open elements begin
    for kind, value in toks:
        if kind == "t":
            nodes.append((("t",), [[value]]))
            continue
        if kind == "<":
            begun.append(len(nodes))
        nodes.append(((kind, value), []))
        last = len(nodes) - begun.pop() if kind == ">" else 0
        again = kind == ">"
        while again:
            again = False
            for k in sorted({last, *range(1, min(siblings, len(nodes)) + 1)} - {0}):
                if k > len(nodes):
                    continue
                keys = _keys(nodes[-k:])
                if keys[0][0] == ">":
                    continue
                key = ("+", keys)
                if len(nodes) > k and nodes[-k - 1][0] == key:
                    _absorb(nodes[-k - 1][1], nodes[-k:])
                    del nodes[-k:]
                    again = True
                elif keys[0][0] == "<" and _whole(keys) and (key in groups or _keys(nodes[-2 * k : -k]) == keys):
                    texts = [list(t) for n in nodes[-k:] for t in n[1]]
                    if _keys(nodes[-2 * k : -k]) == keys:
                        texts = [list(t) for n in nodes[-2 * k : -k] for t in n[1]]
                        _absorb(texts, nodes[-k:])
                        del nodes[-k:]
                    nodes[-k:] = [(key, texts)]
                    again = True
                if again:
                    last = 1
                    break
    return nodes


class Wrapper:
    """A union-free regular expression: keys in order, each with whether it is optional, and what its text places hold."""

    def __init__(self, keys: list[tuple], optional: list[bool], slots: list[list]):
        self.keys, self.optional, self.slots = keys, optional, slots

    @property
    def groups(self) -> frozenset:
        return frozenset(k for k in self.keys if k[0] == "+")

    @staticmethod
    def of(nodes: list[Node]) -> Wrapper:
        return Wrapper([n[0] for n in nodes], [False] * len(nodes), [[_slot(t) for t in n[1]] for n in nodes])

    def align(self, nodes: list[Node]) -> list[tuple[int | None, int | None]]:
        """Pairs of places in the wrapper and in the page, in order; None on one side of a mismatch."""
        out: list[tuple[int | None, int | None]] = []
        for op, a, b, c, d in SequenceMatcher(None, self.keys, [n[0] for n in nodes], autojunk=False).get_opcodes():
            if op == "equal":
                out += zip(range(a, b), range(c, d), strict=True)
            else:
                out += [(i, None) for i in range(a, b)] + [(None, j) for j in range(c, d)]
        return out

    def generalise(self, nodes: list[Node]) -> Wrapper:
        """The least wrapper that also takes the page: differing texts become slots, what one side lacks becomes optional."""
        keys, optional, slots = [], [], []
        for i, j in self.align(nodes):
            if i is None:
                keys.append(nodes[j][0])
                optional.append(True)
                slots.append([_slot(t) for t in nodes[j][1]])
            else:
                keys.append(self.keys[i])
                optional.append(self.optional[i] or j is None)
                slots.append(self.slots[i] if j is None else [_join(s, _slot(t)) for s, t in zip(self.slots[i], nodes[j][1], strict=True)])
        return Wrapper(keys, optional, slots)


def _slot(texts: list[str]) -> list:
    """The texts that this place held on every page seen, each with its characters in all; the number of pages; all characters."""
    return [{t: len(t) * n for t, n in sorted(Counter(texts).items())}, 1, sum(map(len, texts))]


def _join(a: list, b: list) -> list:
    return [{t: n + b[0][t] for t, n in a[0].items() if t in b[0]}, a[1] + b[1], a[2] + b[2]]


def infer(pages: list[str]) -> Wrapper | None:
    """Align the pages one after another; groups that repeat in any of them are groups in all."""
    toks = [tokens(p) for p in pages if p]
    groups: frozenset = frozenset()
    for t in toks:
        groups |= frozenset(n[0] for n in fold(t, groups) if n[0][0] == "+")
    out = None
    for t in toks:
        nodes = fold(t, groups)
        out = Wrapper.of(nodes) if out is None else out.generalise(nodes)
    return out


def _places(keys: list[tuple]) -> list[list[tuple[str, ...]]]:
    """The open elements around each text place of each key."""
    stack: list[str] = []
    out: list[list[tuple[str, ...]]] = []
    for k in keys:
        here: list[tuple[str, ...]] = []

        def walk(key: tuple, here: list = here) -> None:
            if key[0] == "<":
                stack.append(key[1])
            elif key[0] == ">":
                if key[1] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(key[1]) :]
            elif key[0] == "t":
                here.append(tuple(stack))
            else:
                for x in key[1]:
                    walk(x)

        walk(k)
        out.append(here)
    return out


Path = tuple[str, ...]


def verdicts(wrapper: Wrapper) -> tuple[list[list[frozenset | None]], Path | None, frozenset]:
    """For each text place None or, if it holds main text, the texts there that are template; the main region; the elements beside it.

    What the pages of the host have in common decides.  A text that a place holds on each of three pages or more is part
    of the template, wherever it stands.  The main region is the innermost one with the most other text, summed over the
    pages; ``article`` and ``main`` only count their text double there.  Elements that their name or class puts beside the
    text are left out, unless they hold half of all such text: then the hint is wrong.
    """
    places = _places(wrapper.keys)
    every = [(path, s) for row, slots in zip(places, wrapper.slots, strict=True) for path, s in zip(row, slots, strict=True) if not any(_name(x) in NEVER for x in path)]
    free = lambda s: s[2] - sum(s[0].values())
    # copies of one page tell nothing about the template
    fixed = (lambda s: frozenset(s[0]) if s[1] >= 3 else frozenset()) if any(free(s) > 0 for _, s in every) else lambda s: frozenset()
    size = lambda s: free(s) if fixed(s) else s[2]
    under: dict[Path, int] = {}
    for path, s in every:
        for k in range(len(path) + 1):
            under[path[:k]] = under.get(path[:k], 0) + size(s)
    whole = under.get((), 0)
    aside = frozenset(p for p in under if p and (p[-1][-1] == "!" or _name(p[-1]) in ASIDE) and 2 * under[p] < whole)
    beside = lambda path: any(_name(x) in NEVER for x in path) or any(path[:k] in aside for k in range(1, len(path) + 1))
    mass: dict[Path, int] = {}
    for path, s in every:
        if not beside(path) and size(s) > 0:
            top = path
            while top and _name(top[-1]) in LEAVES:
                top = top[:-1]
            mass[top] = mass.get(top, 0) + size(s) * (2 if any(_name(x) in MAIN for x in top) else 1)
    if not mass:
        return [[None] * len(row) for row in places], None, aside
    best = max(mass, key=lambda p: (mass[p], -len(p), p))
    good = [[fixed(s) if not beside(p) and p[: len(best)] == best else None for p, s in zip(row, slots, strict=True)] for row, slots in zip(places, wrapper.slots, strict=True)]
    return good, best, aside


def dump(wrapper: Wrapper | None) -> str | None:
    return None if wrapper is None else json.dumps([wrapper.keys, wrapper.optional, wrapper.slots])


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


@lru_cache(maxsize=4096)
def load(text: str) -> tuple[Wrapper, tuple, frozenset]:
    keys, optional, slots = json.loads(text)
    w = Wrapper([_tuples(k) for k in keys], optional, slots)
    return w, verdicts(w), w.groups


def extract(page: str | None, wrapper: str | None) -> str:
    """The blocks of main text of a page under its host's wrapper.

    Where the wrapper takes the page's nodes, its verdicts hold; nodes that it lacks are main text if they lie in its main
    region.  A page without that region is of another kind and judged as a wrapper of its own.
    """
    toks = tokens(page or "")
    if not toks:
        return ""
    if wrapper is not None:
        w, (good, best, _), groups = load(wrapper)
        nodes = fold(toks, groups)
        places = _places([n[0] for n in nodes])
        if best is not None and any(p[: len(best)] == best for row in places for p in row):
            out: list[str] = []
            for i, j in w.align(nodes):
                if j is None:
                    continue
                if i is None:
                    inside = [frozenset() if p[: len(best)] == best and not any(_name(x) in NEVER or x[-1] == "!" or _name(x) in ASIDE for x in p[len(best) :]) else None for p in places[j]]
                    out += _ordered(nodes[j], inside)
                else:
                    out += _ordered(nodes[j], good[i])
            return "\n\n".join(out)
    nodes = fold(toks)
    own, _, _ = verdicts(Wrapper.of(nodes))
    return "\n\n".join(t for n, good in zip(nodes, own, strict=True) for t in _ordered(n, good))


def _ordered(node: Node, good: list[frozenset | None]) -> list[str]:
    """The node's wanted texts in page order: place by place within each turn of a group."""
    key, texts = node
    turns = max(map(len, texts), default=0)
    if key[0] == "+" and all(len(t) == turns for t in texts):
        return [t[r] for r in range(turns) for t, g in zip(texts, good, strict=True) if g is not None and t[r] not in g]
    return [x for t, g in zip(texts, good, strict=True) if g is not None for x in t if x not in g]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; the empty string if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``host, pages, wrapper``: one wrapper per host, from its ``sample`` different pages with the least hashes (all, if it has no more).

    Counts per host, combined before the shuffle, tell which hashes are small enough to be looked at, so a host with a
    third of all pages costs no more than another, and no task ever holds more than ``sample`` pages of one host.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).where("html is not null")
    size = cut(rows.groupBy("host").agg(F.count("*").alias("pages")))
    # three times as many as are wanted of a large host, by a second hash
    chance = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    some = rows.select("host", "h").join(size, "host").where(chance * F.col("pages") < 3 * sample + 12).select("host", "h").distinct()
    order = Window.partitionBy("host").orderBy(F.xxhash64("h", F.lit(3)).bitwiseAND(F.lit((1 << 63) - 1)) % (1 << 30), "h")
    chosen = cut(some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select(F.col("host").alias("_host"), F.col("h").alias("_h")))
    # an inner join on distinct keys: the optimizer would move a semi-join below the filter and shuffle every page
    picked = maybe_in(rows, F.col("h"), chosen, "_h").join(chosen, (F.col("host") == F.col("_host")) & (F.col("h") == F.col("_h"))).groupBy("host", "h").agg(F.min("html").alias("html"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        made = infer([t for _, t in sorted(zip(frame["h"], frame["html"], strict=True))])
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [dump(made)]})

    return cut(picked.groupBy("host").applyInPandas(fit, "host string, wrapper string").join(size, "host"))


def _least_broadcast(made: DataFrame, most: int) -> int | None:
    """The least power of two such that the hosts with so many pages or more have ``most`` bytes of wrappers; None if all fit."""
    level = F.floor(F.log2("pages")).cast("int").alias("level")
    sizes = {r.level: r.size for r in made.groupBy(level).agg(F.sum(F.coalesce(F.octet_length("wrapper"), F.lit(0)) + F.octet_length("host") + 64).alias("size")).collect()}  # at most 64 rows
    held = 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            return 1 << (k + 1)
    return None


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole html.

    Blocks stand in page order, joined by two line feeds; in a block character references are decoded and white space
    becomes one space.  A null or empty html gives an empty text.  Pages without a host share one wrapper; repeated rows
    are extracted as often as they come; null ids are kept; an empty table gives an empty result; other columns are
    ignored.
    """
    made = wrappers(pages, url_col, html_col)
    rows = bound_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, w) for h, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    least = _least_broadcast(made, BROADCAST_BYTES)
    made = made.select("host", "wrapper") if least is None else made
    if least is None:
        joined = rows.join(F.broadcast(made), "host", "left")
    else:  # the hosts that could crowd a task are all among those that are broadcast
        large, small = (made.where(c).select("host", "wrapper") for c in (F.col("pages") >= least, F.col("pages") < least))
        first = rows.join(F.broadcast(large), "host", "left")
        rest = first.where("wrapper is null").drop("wrapper").join(small, "host", "left")
        joined = first.where("wrapper is not null").unionByName(rest)
    joined = joined.select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, "page_id long, url string, text string").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
