import numpy as np

from loomwork.llm import pieces


class Pair:
    """A vocabulary in which 1 and 2 merge to 3, and nothing else does."""

    size, none, rank, pairs = 10, 1 << 30, np.arange(10), {1 * 10 + 2: 3}

    @staticmethod
    def merged(left, right):
        return np.where((left == 1) & (right == 2), 3, -1)


def test_merge_beyond_the_old_bound():
    ids = np.zeros((1 << 22) + 2, np.int64)
    ids[-2:] = 1, 2
    with np.errstate(over="ignore"):
        got = {len(pieces._merge_heap(Pair, ids, key, 1 << 31)) for key in (1, 2, 3, 4, 5, 6)}
    assert got == {len(ids), len(ids) - 1}  # skipped under some keys, merged under others


def slow_agenda(v, ids, key, limit):
    """Merge after merge: of all candidates that are not skipped, the one of least rank, then from the left."""
    parts = [(k, k + 1, int(x)) for k, x in enumerate(ids)]
    while True:
        best = None
        for k in range(len(parts) - 1):
            new = v.pairs.get(parts[k][2] * v.size + parts[k + 1][2], -1)
            bounds = (np.array([x], np.uint64) for x in (key, parts[k][0], parts[k + 1][0], parts[k + 1][1]))
            if new >= 0 and not (limit and pieces._skipped(*bounds, limit)[0]):
                best = min(best or (1 << 60, 0, 0), (int(v.rank[new]), k, new))
        if best is None:
            return [x for *_, x in parts]
        _, k, new = best
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], new)]


def test_dropout_against_a_plain_agenda():
    with open(pieces.MODEL_PATH, "rb") as f:
        v = pieces.vocabulary(f.read())
    rng = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        for key in range(40):
            text = "".join(rng.choice(list("etaoinshr"), rng.integers(2, 90)))
            ids = v.chars[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            for limit in (0, 1 << 29, 1 << 31):
                assert pieces._merge_heap(v, ids, key, limit) == slow_agenda(v, ids, key, limit)


def test_five_million_characters_without_a_space():
    with open(pieces.MODEL_PATH, "rb") as f:
        v = pieces.vocabulary(f.read())
    text = "zq" * 2_500_000
    flat, count = pieces.encode_texts(v, [text], np.array([7]), 0.1, 1)
    assert count[0] == len(flat) and pieces.decode_ids(v, flat.tolist()) == text
