"""Language identification in two steps: the family, then one-versus-one linear machines inside it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Family of each ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "nb": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "pt": "romance", "it": "romance", "ca": "romance", "ro": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "hi": "indic", "ur": "indic", "bn": "indic",
}
UNKNOWN = "und"
#: Features: trigrams over 64 classes of bytes.
_CLASSES = 64
TABLE = _CLASSES**3


def _class_table() -> np.ndarray:
    """Space and signs: 0; letters, without case: 1-26; bytes of other scripts: 27-63, the case of accented Latin letters folded."""
    out = np.zeros(256, np.uint32)
    for c in range(26):
        out[65 + c] = out[97 + c] = c + 1
    for b in range(0x80, 0x100):
        out[b] = 27 + (b & 0x1F if b < 0xC0 else 32 + b % 5)
    return out


_CLASS = _class_table()


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts and the offset at which each text's begin; a text of n bytes has n of them.

    Each text is read between two spaces, so even one letter gives a trigram; runs of signs count as code 0, which has no weight.
    """
    joined = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)
    c = _CLASS[joined]
    grams = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    return grams, np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    members: list[list[int]]
    pairs: list[tuple[int, int]]
    #: (TABLE, families + pairs): log-likelihoods of the families, then the separating planes of the pairs.
    weights: np.ndarray
    bias: np.ndarray


def _pegasos(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Linear support vector machine by averaged sub-gradient steps; the last column of ``x`` is the constant."""
    rng, w, total = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step, kept = 0, 0
    for r in range(rounds):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1 / (reg * (step + 1 / reg))
            bad = y[at] * (x[at] @ w) < 1
            w *= 1 - rate * reg
            if bad.any():
                w += rate / len(at) * (y[at][bad] @ x[at][bad])
            if r >= rounds // 2:
                total += w
                kept += 1
    return total / max(kept, 1)


#: Plane features are frequencies times this, of the trigrams that occur in the sample most often.
SCALE, PLANE_FEATURES = 50.0, 6000


def train(texts: list[bytes], langs: list[str], families: Mapping[str, str] = FAMILIES) -> Model:
    """Multinomial log-likelihoods per family and a plane for every two languages of one family."""
    names = sorted(set(langs))
    group = sorted({families.get(x, x) for x in names})
    members = [[k for k, x in enumerate(names) if families.get(x, x) == g] for g in group]
    pairs = [(a, b) for m in members for i, a in enumerate(m) for b in m[i + 1 :]]
    weights, bias = np.zeros((TABLE, len(group) + len(pairs)), np.float32), np.zeros(len(group) + len(pairs))
    if not names:
        return Model(names, group, members, pairs, weights, bias)
    grams, at = codes(texts)
    lang = np.array([names.index(x) for x in langs])
    whole = np.zeros((len(names), TABLE))
    for k in range(len(texts)):
        n = at[k + 1] - at[k]
        part = grams[at[k] : at[k + 1] - 2]
        np.add.at(whole[lang[k]], part, 1.0 / max(n, 1))
    whole[:, 0] = 0
    for f, m in enumerate(members):  # languages weigh alike in their family, documents alike in their language
        share = sum(whole[k] / max(whole[k].sum(), 1e-9) for k in m) / len(m)
        weights[:, f] = np.log((share + 1e-7) / (1 + 1e-7 * TABLE))
    weights[:, : len(group)] -= weights[:, : len(group)].mean(axis=1, keepdims=True)
    weights[0] = 0
    top = np.argsort(-whole.sum(axis=0), kind="stable")[:PLANE_FEATURES]
    place = np.full(TABLE, -1)
    place[top] = np.arange(len(top))
    for p, (a, b) in enumerate(pairs, len(group)):
        rows = np.flatnonzero((lang == a) | (lang == b))
        x = np.zeros((len(rows), len(top) + 1), np.float32)
        x[:, -1] = 1
        for i, k in enumerate(rows):
            part = grams[at[k] : at[k + 1] - 2]
            part = place[part[part > 0]]
            x[i, :-1] = np.bincount(part[part >= 0], minlength=len(top)) * (SCALE / max(len(part), 1))
        w = _pegasos(x, np.where(lang[rows] == a, 1.0, -1.0))
        weights[top, p], bias[p] = w[:-1] * SCALE, w[-1]
    return Model(names, group, members, pairs, weights, bias)


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, a longer text alone: what is worked on at once stays small."""
    begin = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def blocks(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    return ranges([len(t) for t in texts], most)


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each text: the family's share times the share of the votes inside it."""
    if not texts:
        return [], np.zeros(0)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    grams, at = codes(texts)
    n_fam, value = len(model.families), np.zeros((len(texts), model.weights.shape[1]))
    for k in range(len(texts)):
        part = grams[at[k] : at[k + 1] - 2]
        part = part[part > 0]
        value[k] = sum(model.weights[part[i : i + 65536]].sum(axis=0, dtype=np.float64) for i in range(0, max(len(part), 1), 65536)) / max(len(part), 1)
    value += model.bias
    fam = value[:, :n_fam]
    share = np.exp(8 * (fam - fam.max(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    votes = np.zeros((len(texts), len(model.languages)))
    won = np.zeros((len(texts), len(model.languages)))
    for p, (a, b) in enumerate(model.pairs, n_fam):
        side = 1 / (1 + np.exp(-np.clip(2 * value[:, p], -30, 30)))
        votes[:, a] += side
        votes[:, b] += 1 - side
        won[:, a] += value[:, p] >= 0
        won[:, b] += value[:, p] < 0
    out, score = [], np.zeros(len(texts))
    for k, f in enumerate(best):
        m = model.members[f]
        lang = max(m, key=lambda x: (won[k, x], votes[k, x], -x))
        inside = votes[k, lang] / (len(m) - 1) if len(m) > 1 else 1.0
        out.append(model.languages[lang])
        score[k] = share[k, f] * inside
    return out, np.clip(score, 0, 1)


def sample_by(df: DataFrame, by: str, id_col: str, most: int | Mapping[int, int]) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (few values), taken by a hash of the id: the same rows at every run."""
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if not counts:
        return df.limit(0)
    wanted = {k: most if isinstance(most, int) else most[k] for k in counts}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, wanted[k] / n))]), F.col(by))
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * sum(wanted.values()))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, families: Mapping[str, str] = FAMILIES) -> Model:
    """Train on about ``per_language`` labelled texts of each language, the documented bound of what reaches the driver."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    got = sorted((r.id is None, r.id, r.text, r.lang) for r in sample_by(rows, "lang", "id", per_language).collect())
    return train([t.encode() for *_, t, _ in got], [x for *_, x in got], families)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; ``und`` with score 0 where the text is null or has no letter.

    The model is broadcast; its size is fixed by the number of languages (1 MB for each family and pair).  Repeated rows
    are scored as often as they come, null ids are kept, an empty table gives an empty result, other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            found = [predict(held.value, texts[a:z]) for a, z in blocks(texts, 1_000_000)]
            langs, score = [x for f in found for x in f[0]], np.concatenate([np.zeros(0), *(f[1] for f in found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lettered"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lettered", "lang_pred", "score"])

    text = F.col(text_col)
    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    out = rows.mapInArrow(run, "doc_id long, lettered boolean, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered") & (F.col("lang_pred") != UNKNOWN), F.col("score")).otherwise(0.0).alias("score"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is told with a score of at least ``min_score``; no row moves."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            found = [predict(held.value, texts[a:z]) for a, z in blocks(texts, 1_000_000)]
            keep = [lang != UNKNOWN and s >= min_score for f in found for lang, s in zip(*f, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return bound_batches(docs).where(F.col(text_col).rlike(r"\p{L}")).mapInArrow(run, docs.schema)
