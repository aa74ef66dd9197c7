"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .langid import blocks, sample_by

#: Byte classes that are counted in a line.
_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((range(65, 91), (*range(97, 123), *range(0xC2, 0xE0)), range(48, 58), b"#*$%&<>", b"|", b"!?", b".,;:", b" \t\r\x0b\x0c"), 1):
    for _c in _set:
        _CLASS[_c] = _k
CLASSES = 9
FEATURES = CLASSES + 7


def line_features(text: str) -> np.ndarray:
    """A row per line of the text (split at line feeds): what shares of it are of each class, how it repeats, its size."""
    raw = text.encode("utf-8", "replace")
    lines = raw.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.repeat(np.arange(len(lines), dtype=np.int64) * CLASSES, size + 1)[: len(raw)]
    counts = np.bincount(at + _CLASS[np.frombuffer(raw, np.uint8)], minlength=len(lines) * CLASSES).reshape(-1, CLASSES).astype(float)
    counts[:-1, 0] -= 1  # the line feeds
    out = np.zeros((len(lines), FEATURES))
    out[:, :CLASSES] = counts / np.maximum(size, 1)[:, None]
    seen: set[bytes] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n, kinds = len(words), len(set(words))
        out[k, CLASSES:] = (1 - kinds / n if n else 0, line in seen, min(n, 40) / 40, n < 4, min(len(line) / max(n, 1), 20) / 20, line[-1:] in (b".", b"!", b"?", b'"'), not n)
        seen.add(line)
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """The features of each line, of the one before, of the one after, and a constant."""
    edge = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1))])


WIDTH = 3 * FEATURES + 1


@dataclass
class Chain:
    """Weights of state good against bad, and of the four steps from state to state (0 bad, 1 good)."""

    emit: np.ndarray
    step: np.ndarray


def forward_backward(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray, weight: np.ndarray | None = None):
    """P(good) of each line of documents laid end to end, all documents at once; with a ``weight`` for each, also log Z and the weighted sum of expected steps.

    Documents are ordered by length, so that those still running are a prefix at every position.
    """
    order = np.argsort(-sizes, kind="stable")
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    n = sizes[order]
    running = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]) if len(n) else 0)]
    ahead, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t, k in enumerate(running):
        at = start[:k] + t
        score = np.stack([np.zeros(k), emit[at]], axis=1)
        if t:
            before = ahead[at - 1]
            score = score + np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
        ahead[at] = score
    expected = np.zeros((2, 2))
    last = start + n - 1
    log_z = np.logaddexp(ahead[last, 0], ahead[last, 1])
    for t in range(len(running) - 2, -1, -1):
        k = running[t + 1]
        at = start[:k] + t
        after = back[at + 1] + np.stack([np.zeros(k), emit[at + 1]], axis=1)
        back[at] = np.logaddexp(step[:, 0][None] + after[:, :1], step[:, 1][None] + after[:, 1:])
        if weight is not None:
            both = ahead[at][:, :, None] + step[None] + after[:, None, :] - log_z[:k, None, None]
            expected += (np.exp(both) * weight[order[:k], None, None]).sum(axis=0)
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    return good if weight is None else (good, log_z[np.argsort(order)], expected)


def objective(theta: np.ndarray, x: np.ndarray, sizes: np.ndarray, good: np.ndarray, reg: float = 1e-4) -> tuple[float, np.ndarray]:
    """Conditional log-likelihood a line, as a mean over documents, less the penalty; and its gradient.

    Every line carries its document's label.  A document's log-likelihood is divided by its lines, its emissions and
    transitions alike, so a long document weighs as much as a short one.
    """
    weight = 1 / sizes / len(sizes)
    emit, step = x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    p, log_z, expected = forward_backward(emit, sizes, step, weight)
    label, each = np.repeat(good, sizes), np.repeat(weight, sizes)
    stays = np.array([(weight * (sizes - 1) * (1 - good)).sum(), (weight * (sizes - 1) * good).sum()])
    value = (emit * label * each).sum() + stays @ step.diagonal() - (weight * log_z).sum() - reg / 2 * (theta**2).sum()
    return value, np.concatenate([x.T @ ((label - p) * each), (np.diag(stays) - expected).ravel()]) - reg * theta


def train_chain(docs: list[np.ndarray], good: np.ndarray, rounds: int = 250, reg: float = 1e-4, rate: float = 0.15) -> Chain:
    """Maximise the objective (Adam)."""
    if not docs:
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)))
    sizes, x = np.array([len(d) for d in docs]), np.vstack(docs)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for t in range(1, rounds + 1):
        _, grad = objective(theta, x, sizes, good.astype(float), reg)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Chain(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def score_texts(chain: Chain, texts: list[str]) -> np.ndarray:
    """The mean probability of a good line, each line weighing its characters plus one."""
    if not texts:
        return np.zeros(0)
    docs = [line_features(t) for t in texts]
    sizes = np.array([len(d) for d in docs])
    p = forward_backward(np.concatenate([with_neighbours(d) @ chain.emit for d in docs]), sizes, chain.step)
    weight = np.concatenate([[len(x) + 1.0 for x in t.split("\n")] for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_bad: int = 1500, most_good: int = 3000) -> Chain:
    """Train on about ``most_bad`` and ``most_good`` labelled documents, the documented bound of what reaches the driver.

    Good documents vary more (numbers, addresses, licences, lines that recur), so more of them are looked at.

    Labels that are null, or of ids that have no document, teach nothing; of repeated rows each counts.
    """
    marks = sample_by(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("good")).where("_id is not null and good in (0, 1)"), "good", "_id", {0: most_bad, 1: most_good})
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = sorted((r.id, r.good, r.text) for r in rows.join(F.broadcast(marks), F.col("id") == F.col("_id")).select("id", "good", "text").collect())
    return train_chain([with_neighbours(line_features(t)) for *_, t in got], np.array([g for _, g, _ in got]))


def score_quality(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; a null text scores as the empty one, which is one empty line.

    Repeated rows are scored as often as they come, null ids are kept, an empty table gives an empty result, and other
    columns are ignored.  A text is worked on alone or with others of 4 MB in all, whatever its length.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            score = np.concatenate([np.zeros(0), *(score_texts(held.value, texts[a:z]) for a, z in blocks(texts))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
