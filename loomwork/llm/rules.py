"""Quality rules that vote, weighed by expectation-maximisation, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, inline

def _twice(grams: Column, order: Column) -> Column:
    """Places of the windows that occur twice or more, ascending; ``order`` holds all places sorted by hash.

    Windows of equal hashes are neighbours in ``order``, so a place counts if a neighbour has the same full hash.
    """
    same = lambda p, k: F.coalesce(F.get(grams, F.get(order, k)) == F.get(grams, p), F.lit(False))
    return F.sort_array(F.filter(order, lambda p, k: same(p, k - 1) | same(p, k + 1)))


def _covered(places: Column) -> Column:
    """Words under the windows at ``places``: three each, fewer where the next one overlaps."""
    steps = F.transform(places, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(places, k - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules read, from whole texts (null: none), one row per input row, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.array_remove(F.split(text, SPACE_CLASS + "+"), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    w = F.col("words")
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", F.size(w).cast("long").alias("n_words"), grams.alias("grams"),
        (F.char_length("text") - F.regexp_count("text", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[.,;:]")).cast("long").alias("n_stops"), F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>][^\x20\x09-\x0D]*+")).cast("long").alias("n_symbol_words"), F.regexp_count("text", F.lit(r"([#*$%&|<>])\1++")).cast("long").alias("n_symbol_runs"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare_words"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    g = F.col("grams")
    places = F.transform(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda x: x["i"])
    base = base.withColumn("order", F.when(F.size(F.array_distinct(g)) == F.size(g), F.array().cast("array<int>")).otherwise(places))
    base = base.withColumn("twice", _twice(g, F.col("order")))  # columns of their own: inside a lambda an expression would run again for every element
    return base.withColumn("n_repeat_words", _covered(F.col("twice")).cast("long")).drop("grams", "order", "twice")


def votes() -> dict[str, Column]:
    """The rules: 1 votes for good, 0 for bad, -1 abstains.  Several rules look at each kind of junk, each from another side."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")

    def ratio(a: str, b: Column, good: float, bad: float, enough: Column) -> Column:
        return F.when(~enough | (b <= 0), -1).when(F.col(a) < good * b, 1).when(F.col(a) > bad * b, 0).otherwise(-1)

    some = n >= 10
    return {
        "symbols": ratio("n_symbols", chars, 0.01, 0.05, n > 0),
        "symbol_words": ratio("n_symbol_words", n, 0.02, 0.15, some),
        "symbol_runs": ratio("n_symbol_runs", n, 0.01, 0.1, some),
        "bare_words": ratio("n_bare_words", n, 0.02, 0.1, some),
        "letters": F.when(n <= 0, -1).when(F.col("n_letters") > 0.93 * chars, 1).when(F.col("n_letters") < 0.9 * chars, 0).otherwise(-1),
        "capitals": ratio("n_upper", chars, 0.1, 0.3, n > 0),
        "repeats": ratio("n_repeat_words", n, 0.1, 0.45, some),
        "line_repeats": ratio("n_dup_lines", lines, 0.1, 0.3, lines >= 10),
        "word_length": F.when(~some, -1).when((chars >= 3 * n) & (chars <= 9 * n), 1).when((chars < 2 * n) | (chars > 13 * n), 0).otherwise(-1),
        "sentences": F.when(n < 30, -1).when((n <= 60 * F.col("n_stops")) & (n >= 2 * F.col("n_stops")), 1).when(n > 200 * F.col("n_stops"), 0).otherwise(-1),
    }


#: A priori a vote is right at this rate, which counts as much as that share of the documents (and ten more) having cast it.
RIGHT, WEIGHT = 0.8, 0.01


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents and each rule's two accuracies, by expectation-maximisation over vote patterns.

    A vote is right on good documents at one rate and on bad ones at another, both free: a rule that strikes many
    documents which all others pass is learned to be noisy.  Abstaining tells nothing.  All rules start equally good at
    both, so the majority of the votes tells which class is the good one; a weak prior at the same rates keeps a rule that
    never votes from having any.
    """
    if not patterns:
        return 0.5, []
    vote, n = np.array([p for p, _ in patterns]), np.array([k for _, k in patterns], float)
    cast, up, down = (vote >= 0).astype(float), (vote == 1).astype(float), (vote == 0).astype(float)
    weight = 10 + WEIGHT * n.sum()
    share, right = 0.5, np.full((vote.shape[1], 2), RIGHT)
    for _ in range(rounds):
        good = n * _posteriors(vote, share, right)
        bad = n - good
        share = (good.sum() + weight) / (n.sum() + 2 * weight)
        right = np.stack([(up.T @ good + RIGHT * weight) / (cast.T @ good + weight), (down.T @ bad + RIGHT * weight) / (cast.T @ bad + weight)], axis=1)
    return float(share), [(float(a), float(b)) for a, b in right]


def _posteriors(vote: np.ndarray, share: float, right: np.ndarray) -> np.ndarray:
    odds = np.log(share / (1 - share)) + (vote == 1) @ np.log(right[:, 0] / (1 - right[:, 1])) + (vote == 0) @ np.log((1 - right[:, 0]) / right[:, 1])
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def posterior(votes_: tuple[int, ...], share: float, right: list[tuple[float, float]]) -> float:
    """P(good) given the votes that were cast."""
    return float(_posteriors(np.array([votes_]), share, np.array(right).reshape(-1, 2))[0])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior`` per row.

    ``base_failed``: under 50 words, or over half of them repeated.  Otherwise a text is kept at a posterior of at least
    ``threshold``.  Counts of the vote patterns of texts that pass the base (at most 3**10, whatever the input, and some
    dozens in practice) reach the driver, where the accuracies are estimated over all of these; each pattern's posterior
    goes back as a row of a table of that bounded size.  Texts that fail the base are judged by the same accuracies.

    Null and empty texts have no words, so they fail the base; null ids and repeated rows are kept as rows of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    rules = votes()
    pattern = reduce(Column.__add__, [(F.col(f"v_{k}") + 1) * 3**i for i, k in enumerate(rules)])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # only what the verdict needs is kept from the one pass over the texts: numbers
    counted = metrics(docs, id_col, text_col).select("*", *[r.alias(f"v_{k}") for k, r in rules.items()]).withColumn("pattern", pattern).withColumn("base_failed", failed)
    counted = cut(counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "pattern"))
    seen = [(r["pattern"], r["n"]) for r in counted.groupBy("pattern").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n")).collect()]
    known = {p: tuple(p // 3**i % 3 - 1 for i in range(len(rules))) for p, _ in sorted(seen)}
    share, right = fit_votes([(known[p], n) for p, n in sorted(seen) if n])
    chances = [(p, posterior(v, share, right) if right else 0.5) for p, v in known.items()] or [(0, 0.5)]
    table = inline(docs.sparkSession, "pattern, posterior", chances)
    judged = counted.join(F.broadcast(table), "pattern").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
