"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .langid import ranges

#: Where the public vocabulary lies here; a parameter of every operator below.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
#: Chunks that are merged side by side at once: few enough that their matrices stay in a core's cache.
_TILE = 8192
#: Chunks of more characters than this are merged one by one with a heap instead of side by side in a matrix.
WIDEST = 64
_U = np.uint64
_ALL = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Vocabulary:
    """Pieces, the rank of every possible merge, and an open-addressing table of mergeable pairs."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.bytes_at = sp.piece_to_id("<0x00>")
        if [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] != list(range(self.bytes_at, self.bytes_at + 256)):
            raise ValueError("the vocabulary needs the 256 byte pieces, in order")
        if any(_SPACE in p[1:] and p.strip(_SPACE) for p in plain):
            raise ValueError("a piece goes on after a space inside it, so that text cannot be cut before spaces")
        scores = np.array([sp.get_score(i) for i in range(n)])
        small = np.int16 if n < 2**15 - 1 else np.int32
        self.none = np.iinfo(small).max
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(small)
        self.chars = np.full(0x110000, -1, small)
        for p, i in plain.items():
            if len(p) == 1 and p != _SPACE:
                self.chars[ord(p)] = i
        self.space = plain[_SPACE]
        self.chars[0x20] = self.space  # a literal U+2581 stays unknown and is spelt in bytes, else it would decode to a space
        found = [(plain[p[:k]] * n + plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        self.size, self.pairs = n, dict(found)
        self.bits = max(12, len(found).bit_length() + 3)
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, small)
        for key, i in found:
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = key, i
        self.raw = [bytes([i - self.bytes_at]) if self.bytes_at <= i < self.bytes_at + 256 else names[i].replace(_SPACE, " ").encode() if names[i] in plain else b"" for i in range(n)]

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pieces, -1 where two pieces make none; ids below 0 stand for no piece."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == key, self.ids[at], self.ids.dtype.type(-1))
        open_ = np.flatnonzero((held != key) & (held >= 0) & (key >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """Whether the keyed hash of a candidate's three bounds, of any size, skips it."""
    return (_mix(_mix(_mix(key + start) + mid) + end) >> _U(32)) < _U(limit)


def _candidates(v: Vocabulary, left, right, key, start, mid, end, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ids and ranks of candidate merges; rank ``none`` for those that make no piece or that the keyed hash skips."""
    ids = v.merged(left, right)
    rank = np.where(ids >= 0, v.rank[ids], v.none)
    if limit:
        there = np.flatnonzero(ids >= 0)
        skipped = _skipped(key[there], start[there].astype(_U), mid[there].astype(_U), end[there].astype(_U), limit)
        rank[there[skipped]] = v.none
    return ids, rank


def _merge_matrix(v: Vocabulary, ids: np.ndarray, count: np.ndarray, key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge chunks side by side: in each round every chunk makes its best merge, by rank and then from the left."""
    n, width = ids.shape
    done_ids, done_count = ids.copy(), count.copy()
    if width < 2:
        return done_ids, done_count
    off = np.minimum(np.arange(width + 2)[None], count[:, None]).astype(np.int8)  # width is at most WIDEST
    cols = np.arange(width, dtype=np.int8)[None]
    keys = np.repeat(key, width - 1)
    new, rank = _candidates(v, ids[:, :-1].ravel(), ids[:, 1:].ravel(), keys, off[:, : width - 1].ravel(), off[:, 1:width].ravel(), off[:, 2 : width + 1].ravel(), limit)
    new, rank = new.reshape(n, -1), rank.reshape(n, -1)
    row, ids, count = np.arange(n), ids.copy(), count.copy()
    while True:
        j = rank.argmin(axis=1)
        live = np.flatnonzero(rank[np.arange(len(row)), j] < v.none)
        if len(live) < 0.6 * len(row):  # those that are done leave; until so many are, they stay and nothing of theirs moves
            done_ids[row], done_count[row] = ids, count
            if not len(live):
                break
            row, ids, count, key, off, new, rank, j = row[live], ids[live], count[live], key[live], off[live], new[live], rank[live], j[live]
            live = np.arange(len(row))
        at = j[live]
        made = new[live, at]
        edge = np.full(len(row), width, np.int8)
        edge[live] = at
        after = cols > edge[:, None]
        np.copyto(ids[:, :-1], ids[:, 1:], where=after[:, :-1])
        np.copyto(off[:, 1:-2], off[:, 2:-1], where=after[:, 1:])
        np.copyto(new[:, :-1], new[:, 1:], where=after[:, : width - 2])
        np.copyto(rank[:, :-1], rank[:, 1:], where=after[:, : width - 2])
        ids[live, -1], rank[live, -1] = -1, v.none
        ids[live, at] = made
        off[live, -2] = off[live, -1]
        count[live] -= 1
        some, k = np.concatenate([live[at > 0], live[at < width - 1]]), np.concatenate([at[at > 0] - 1, at[at < width - 1]])
        new[some, k], rank[some, k] = _candidates(v, ids[some, k], ids[some, k + 1], key[some], off[some, k], off[some, k + 1], off[some, k + 2], limit)
    return done_ids, done_count


def _mix_int(x: int) -> int:
    """The same finaliser of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _merge_heap(v: Vocabulary, ids: np.ndarray, key: int, limit: int) -> list[int]:
    """The same merges of one long chunk, by an agenda: the pairs at first are looked up and hashed all at once, those that merges make one by one."""
    n = len(ids)
    at = np.arange(n, dtype=np.int64)
    made, rank = _candidates(v, ids[:-1], ids[1:], np.full(n - 1, key, _U), at[:-1], at[:-1] + 1, at[:-1] + 2, limit)
    there = np.flatnonzero(rank < v.none)
    agenda = list(zip(rank[there].tolist(), there.tolist(), (there + 1).tolist(), (there + 2).tolist(), made[there].tolist(), strict=True))
    heapq.heapify(agenda)
    push, pop, pairs, size, ranks, mix = heapq.heappush, heapq.heappop, v.pairs, v.size, v.rank.tolist(), _mix_int
    ids, nxt, prev = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
    end, alive = list(range(1, n + 1)), bytearray(b"\x01") * n
    while agenda:
        _, a, b, stop, new = pop(agenda)
        if not (alive[a] and alive[b] and nxt[a] == b and end[b] == stop):
            continue
        after, before = nxt[b], prev[a]
        ids[a], end[a], nxt[a], alive[b] = new, stop, after, 0
        if after >= 0:
            prev[after] = a
        for left, right in ((before, a), (a, after)):
            if left < 0 or right < 0:
                continue
            new = pairs.get(ids[left] * size + ids[right], -1)
            if new >= 0 and not (limit and mix((mix((mix((key + left) & _ALL) + right) & _ALL) + end[right]) & _ALL) >> 32 < limit):
                push(agenda, (ranks[new], left, right, end[right], new))
    return [ids[a] for a in range(n) if alive[a]]


def encode_texts(v: Vocabulary, texts: list[str], keys: np.ndarray, dropout: float, seed: int, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and the number of each text's.

    A text is a space and its characters, cut into chunks before spaces and around characters without a piece, which are
    spelt in byte pieces: no merge crosses such a cut.  A candidate merge is skipped, at probability ``dropout``, by a
    hash of the seed, the text's key, the chunk's number and the candidate's three bounds, so a rerun gives the same.
    """
    limit = int(dropout * 2**32)
    cps = [np.frombuffer((" " + t).encode("utf-32-le", "replace"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    size = np.array([len(c) for c in cps], np.int64)
    cp = np.concatenate(cps) if len(cps) else np.zeros(0, np.uint32)
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    ids = v.chars[cp]
    blank, odd = ids == v.space, ids < 0
    cut = np.ones(len(cp), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (blank[1:] & ~blank[:-1]) | odd[1:] | odd[:-1]
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(cp)))
    of = doc[begin]
    first = np.searchsorted(of, np.arange(len(texts)))
    number = np.arange(len(begin)) - first[of]
    with np.errstate(over="ignore"):
        key = _mix(_mix(keys.astype(np.int64).view(_U) + _U(seed & (2**64 - 1)))[of] + (number + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
    made = np.ones(len(begin), np.int64)
    strange = odd[begin]
    if strange.any():
        c = cp[begin[strange]]
        made[strange] = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low = 1
    for width in (1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, widest):
        found = np.flatnonzero(~strange & (length >= low) & (length <= min(width, widest)))
        low = width + 1
        for rows in (found[k : k + _TILE] for k in range(0, len(found), _TILE)):
            span = np.minimum(begin[rows][:, None] + np.arange(width)[None], len(cp) - 1)
            m = np.where(np.arange(width)[None] < length[rows][:, None], ids[span], ids.dtype.type(-1))
            with np.errstate(over="ignore"):
                m, count = _merge_matrix(v, m, length[rows].copy(), key[rows], limit)
            made[rows] = count
            parts.append((rows, m))
    for k in np.flatnonzero(~strange & (length > widest)):
        with np.errstate(over="ignore"):
            got = _merge_heap(v, ids[begin[k] : begin[k] + length[k]], int(key[k]), limit)
        made[k] = len(got)
        parts.append((np.array([k]), np.array([got], np.int32)))
    place = np.concatenate([[0], np.cumsum(made)])
    flat = np.zeros(place[-1], np.int32)
    for rows, m in parts:
        there = np.arange(m.shape[1])[None] < made[rows][:, None]
        flat[(place[rows][:, None] + np.arange(m.shape[1])[None])[there]] = m[there]
    for k in np.flatnonzero(strange):
        for i, b in enumerate(chr(cp[begin[k]]).encode("utf-8", "replace")) if cp[begin[k]] >= 0x80 else ():
            flat[place[k] + i] = v.bytes_at + b
    plain = strange & (cp[begin] < 0x80)
    flat[place[:-1][plain]] = v.bytes_at + cp[begin[plain]]
    return flat, np.bincount(of, made, minlength=len(texts)).astype(np.int64)


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text of piece ids: pieces end to end, their space mark a space, bytes as they are, less the one space put before."""
    raw = v.raw
    out = b"".join([raw[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def read_model(spark: SparkSession, path: str = MODEL_PATH):
    """The vocabulary's bytes (under a megabyte), read on the driver and broadcast: executors need no such file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 1, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, text, ids`` of every whole text.

    A null text has null ids, an empty one none; repeated rows of one id and text are segmented alike; null ids are keyed
    as 0; an empty table gives an empty result; other columns are ignored.  Texts are worked on 1 MB at a time, a longer
    one alone, and chunks of any length are merged in full.
    """
    model = read_model(docs.sparkSession, model_path)

    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, vocabulary(model.value), dropout, seed, False), "doc_id long, text string, ids array<int>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary, dropout: float, seed: int, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Batches of about 1 MB of text with their ids and, if wanted, what these decode to."""
    for b in batches:
        for a, z in ranges(pc.binary_length(b.column("text")).fill_null(0).to_pylist(), 1_000_000):
            text, ids = b.column("text").slice(a, z - a), b.column("doc_id").slice(a, z - a)
            flat, count = encode_texts(v, [t or "" for t in text.to_pylist()], ids.fill_null(0).to_numpy(zero_copy_only=False), dropout, seed)
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            gone = np.asarray(text.is_null())
            columns = [ids, text.cast(pa.string()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)), mask=pa.array(gone) if gone.any() else None)]
            if decoded:
                columns.append(pa.array([None if gone[k] else decode_ids(v, flat[at[k] : at[k + 1]].tolist()) for k in range(z - a)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "ids", "decoded"][: len(columns)])


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, ids, decoded`` of rows with ``doc_id`` and ``ids``; null ids decode to null."""
    model = read_model(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            col = b.column("ids")
            flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy(zero_copy_only=False)
            texts = [None if not ok else decode_ids(v, flat[at[k] : at[k + 1]].tolist()) for k, ok in enumerate(np.asarray(col.is_valid()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return bound_batches(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 1, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, text, ids, decoded``: encoded and decoded in the same workers, a megabyte of text at a time."""
    model = read_model(docs.sparkSession, model_path)
    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, vocabulary(model.value), dropout, seed, True), "doc_id long, text string, ids array<int>, decoded string")
