import random

import corpus_pipeline
import numpy as np
from loomwork.llm import similar, simhash


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_against_brute_force(spark):
    """Every pair at a five-word Jaccard similarity of 0.8 is linked, however many SimHash bits lie between; none below is."""
    rng = random.Random(4)
    texts = ["", None, " "]
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 60, 200, 600]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 6, 9):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(near))
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({top(i) for i in range(len(texts))})


def test_messy(messy, empty):
    kept = similar.keep_one(messy)
    assert kept.columns == messy.columns and 7 not in [r.doc_id for r in kept.collect()]
    assert similar.similar_components(messy).count() == messy.count()
    assert similar.keep_one(empty).count() == 0


def test_simhash_links_first(spark, monkeypatch):
    """The stage's links come from SimHash under covering masks, judged by whole sets; prefix filtering adds the pairs beyond its radius."""
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(30)]
    texts = [" ".join(b) for b in bases] + [" ".join([*b[:150], f"y{k}", *b[151:]]) for k, b in enumerate(bases)]
    sets = [similar.shingle_set(t.encode()) for t in texts]
    fps = [similar.set_fingerprint(s) for s in sets]
    bits = [((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(fps[:30], fps[30:], strict=True)]
    assert min(bits) <= similar.RADIUS < max(bits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []

    def spy(nodes, radius):
        links = simhash.covering_links(nodes, radius)
        met.extend((r.u, r.v) for r in links.collect())
        return links

    monkeypatch.setattr(similar, "covering_links", spy)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert {k for k, b in enumerate(bits) if 0 < b <= similar.RADIUS} == {k for k in range(30) if {(fps[k], fps[k + 30]), (fps[k + 30], fps[k])} & set(met)}


def test_masks_of_the_wider_radius():
    """Every difference of up to four bits is left out by some mask, and five families leave at most 12 bits free."""
    families = [simhash.covering_masks(4, k) for k in range(simhash.LEVELS + 1)]
    rng = random.Random(2)
    for masks in families:
        for _ in range(5000):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & diff for m in masks)
    held = np.zeros(1, np.uint64)
    for masks in families:
        held = np.unique(np.bitwise_or.outer(held, np.array(masks, np.uint64)))
        held = held[np.bitwise_count(held) < 52]
    assert not len(held)
