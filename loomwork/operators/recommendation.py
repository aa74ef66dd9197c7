"""Item-to-item recommendation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.params import HasOutputCol, HasSeed, Param, gt, gt_eq, not_null
from ..core.stage import AlgoOperator


_COLUMNS = 2048  # items that are dense at once
_USERS = 1000  # users that meet all others at once
_RARE = 16  # an item of fewer users is counted by its pairs


def _item_scores(item: int, w: np.ndarray, held: pa.Array, alpha2: float) -> tuple[np.ndarray, np.ndarray]:
    """The other items and their scores, from the weights and the items of the users of an item.

    Of two users that share n > 1 items each shared one gets w * w / (alpha2 + n).  n is a product of the users' 0/1 rows,
    and the sum for an item one of that matrix; items of few of the users go by their cells or pair by pair.
    """
    lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    user = np.repeat(np.arange(len(w)), lengths)
    kinds, at, n = np.unique(held.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    order = np.lexsort((user, at))
    user, start = user[order], np.concatenate([[0], np.cumsum(n)])
    common = np.flatnonzero((n >= _RARE) & (4 * n >= len(w)))
    between = [(k, user[start[k] : start[k + 1]]) for k in np.flatnonzero((n >= _RARE) & (4 * n < len(w)))]
    # pairs a < b of the users of rare items
    pa_, pb_, pc_ = [], [], []
    for c in range(2, _RARE):
        which = np.flatnonzero(n == c)
        if len(which):
            of = user[start[which][:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            pa_.append(of[:, i].ravel()), pb_.append(of[:, j].ravel()), pc_.append(np.repeat(which, len(i)))
    a, b, col = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pa_, pb_, pc_))
    order = np.argsort(a, kind="stable")
    a, b, col = a[order], b[order], col[order]

    def dense(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), len(columns)), np.float32)  # counts below 2^24 are exact
        for k, c in enumerate(columns):
            out[user[start[c] : start[c + 1]], k] = 1
        return out

    cut = [common[k : k + _COLUMNS] for k in range(0, len(common), _COLUMNS)]
    once = dense(cut[0]) if len(cut) == 1 else None
    total = np.zeros(len(kinds))
    for low in range(0, len(w), _USERS):
        rows = slice(low, min(len(w), low + _USERS))
        shared = np.zeros((rows.stop - low, len(w)), np.float32)
        for columns in cut:
            m = dense(columns) if once is None else once
            shared += m[rows] @ m.T
        cells = [(k, np.ix_(u[(u >= low) & (u < rows.stop)] - low, u)) for k, u in between]
        for _, at in cells:
            shared[at] += 1
        mine = slice(*np.searchsorted(a, [low, rows.stop]))
        np.add.at(shared, (a[mine] - low, b[mine]), 1)
        counts = (shared > 1) & (np.arange(len(w))[None] > np.arange(low, rows.stop)[:, None])
        c = np.where(counts, w[rows, None] * w[None] / np.where(counts, alpha2 + shared.astype(float), 1), 0.0)
        for columns in cut:
            m = (dense(columns) if once is None else once).astype(float)
            total[columns] += np.einsum("ij,ij->j", m[rows], c @ m)
        for k, at in cells:
            total[k] += c[at].sum()
        np.add.at(total, col[mine], c[a[mine] - low, b[mine]])
    met = (total > 0) & (kinds != item)  # weights are positive
    return kinds[met], total[met]


class Swing(AlgoOperator, HasOutputCol, HasSeed):
    """Items that pairs of users have in common: the fewer such a pair shares, the more each shared item counts.

    Users with fewer than ``min_user_behavior`` or more than ``max_user_behavior`` distinct items are left out.  An item
    with more than ``max_user_num_per_item`` users is judged by so many of them, drawn by a seeded hash: the bound that
    keeps the pairs of users per item finite.
    """

    user_col = Param("str", "column of user ids (long)", "user", not_null)
    item_col = Param("str", "column of item ids (long)", "item", not_null)
    max_user_num_per_item = Param("int", "users that speak for an item, at most", 1000, gt(0))
    k = Param("int", "similar items per item", 100, gt(0))
    min_user_behavior = Param("int", "least items of a user", 10, gt(0))
    max_user_behavior = Param("int", "most items of a user", 1000, gt(0))
    alpha1 = Param("int", "smoothing of the user weight", 15, gt_eq(0))
    alpha2 = Param("int", "smoothing of the similarity", 0, gt_eq(0))
    beta = Param("float", "decay of the user weight", 0.3, gt_eq(0))

    def scores(self, df: DataFrame) -> DataFrame:
        """``item, other, score`` of all pairs of items with a score."""
        if self.min_user_behavior > self.max_user_behavior:
            raise ValueError("min_user_behavior is above max_user_behavior")
        bad = F.col(self.user_col).isNull() | F.col(self.item_col).isNull()
        guard = F.when(bad, F.raise_error(F.lit("users and items must not be null")).cast("long"))
        rows = df.select(F.coalesce(guard, F.col(self.user_col).cast("long")).alias("u"), F.col(self.item_col).cast("long").alias("i")).distinct()
        users = rows.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n").between(self.min_user_behavior, self.max_user_behavior))
        users = users.select("u", F.pow(F.lit(1.0) / (self.alpha1 + F.col("n")), F.lit(self.beta)).alias("w"))
        rows = rows.join(users, "u")
        rows = rows.persist()
        crowded = not rows.groupBy("i").count().where(F.col("count") > self.max_user_num_per_item).isEmpty()
        kept = rows
        if crowded:
            ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.xxhash64("u", F.lit(self.actual_seed())), "u")))
            kept = ranked.where(F.col("r") <= self.max_user_num_per_item).select("u", "i", "w")
        # All that counts for an item is known where its users are with all their items: no pair of users leaves a task.
        items = rows.groupBy("u").agg(F.collect_set("i").alias("items"))  # at most max_user_behavior
        met = kept.join(items, "u").select("i", "u", "w", "items")
        alpha2 = self.alpha2

        def score(key: tuple, users: pa.Table) -> pa.Table:
            users = users.sort_by("u")
            other, value = _item_scores(int(key[0].as_py()), users.column("w").to_numpy(), users.column("items").combine_chunks(), alpha2)
            return pa.table({"item": pa.array(np.full(len(other), key[0].as_py(), np.int64)), "other": other, "score": value})

        return met.groupBy("i").applyInArrow(score, "item long, other long, score double")

    def top(self, df: DataFrame) -> DataFrame:
        """``item, other, score, rank``: the ``k`` best, ties by the smaller item."""
        return self.scores(df).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= self.k)

    def transform(self, df: DataFrame) -> DataFrame:
        """The item and ``other,score;other,score;...`` in descending order."""
        best = self.top(df).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("b"))
        text = F.array_join(F.transform("b", lambda e: F.concat_ws(",", e["other"].cast("string"), e["score"].cast("string"))), ";")
        return best.select(F.col("item").alias(self.item_col), text.alias(self.output_col))
