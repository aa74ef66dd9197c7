import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import linededup, sharding, simhash
from loomwork.llm.common import connected_components


def slow_fingerprint(text):
    words = [w for w in "".join(c if ord(c) not in (9, 10, 11, 12, 13, 32) else " " for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for text in (None, "", " ", "A", "a B", "The cat SAT é\x0bdown", " ".join(rng.choice("abcde") * 2 for _ in range(500))):
        assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_masks_cover():
    """Every difference of up to three bits is left out by some mask of each family, and four levels leave few bits free."""
    rng = random.Random(2)
    families = [simhash.covering_masks(3, k) for k in range(simhash.LEVELS)]
    for masks in families:
        assert len(masks) == 15
        for _ in range(20_000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            assert any(not m & diff for m in masks)
    free = 64 - min((a | b | c | d).bit_count() for a in families[0] for b in families[1] for c in families[2] for d in families[3])
    assert 1 << free <= simhash.BUCKET


def brute_components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    fps = set()
    for _ in range(15):
        at = rng.getrandbits(64)
        for _ in range(30):
            fps.add(at)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                at ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    if bucket < 4096:  # crowded buckets are dealt out again; the last level takes any size
        monkeypatch.setattr(simhash, "LEVELS", 4)
        try:
            edges = simhash.covering_links(nodes)
        except AssertionError:
            pytest.skip("more alike than the small bound allows")
    else:
        edges = simhash.covering_links(nodes)
    got = {r.node: r.root for r in connected_components(edges.select("u", "v")).collect()}
    want = brute_components(fps)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(f)
    for group in groups.values():
        if len(group) == 1:
            assert next(iter(group)) not in got
        else:
            assert {got[f] for f in group} == {min(group)}


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 7), (9, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and got[9] == got[5] == got[7] == 5 and got[201] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_query(messy, empty):
    rows = messy.collect()
    got = simhash.simhash_components(messy).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, f"{slow_fingerprint(r.text):016x}") for r in rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id not in (6, None)}
    assert by[0] == by[1] == by[2] == by[11] == 0 and by[7] == 6
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and 7 not in [r.doc_id for r in kept.collect()]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.4 and s:
            s[min(i, len(s) - 1)] = rng.choice("abé")
        elif what < 0.7:
            s.insert(i, rng.choice("abé"))
        elif s:
            del s[min(i, len(s) - 1)]
    return "".join(s)


def test_banded_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 40)))
        pairs.append((a, changed(rng, a, rng.randrange(0, 6))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 3):
        for r in df.select("a", "b", linededup.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            want = lev(r.a, r.b)
            assert r.d == want if want <= k else r.d > k


def slow_dedup(rows, steps=linededup.STEPS):
    """Texts by (id, text): first occurrences in order of (id, hash, place); a line near an earlier one goes with all its copies."""
    first = {}
    for i, h, x in rows:
        for pos, line in enumerate((x or "").split("\n")) if x is not None else ():
            if line.strip(" \t\n\x0b\x0c\r"):
                at = (i is not None, i or 0, h, pos)
                first[line] = min(first.get(line, at), at)
    order = sorted(first, key=first.get)
    edits = lambda n: max([k for least, k in steps if n >= least], default=0)
    near = lambda a, b, k: k > 0 and abs(len(a) - len(b)) <= k and lev(a, b) <= k
    gone = {b for k, b in enumerate(order) for a in order[:k] if near(a, b, edits(min(len(a), len(b))))}
    out = {}
    for i, h, x in rows:
        if x is None:
            out[i, x] = (0, 0, None)
            continue
        lines = x.split("\n")
        stay = [y for pos, y in enumerate(lines) if not y.strip(" \t\n\x0b\x0c\r") or (first[y] == (i is not None, i or 0, h, pos) and y not in gone)]
        out[i, x] = (len(lines), len(stay), "\n".join(stay))
    return out


def test_line_dedup(spark, messy, empty):
    short = messy.where("length(text) < 3000 or text is null")
    rows = [(r.doc_id, r.h, r.text) for r in short.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    want = slow_dedup(rows)
    got = linededup.dedup_lines(short).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), *map(str, want[i, x])) for i, _, x in rows)
    assert sorted((str(r.doc_id), str(r.n_lines), str(r.n_kept), str(r.text)) for r in got) == expected
    assert linededup.dedup_lines(empty).count() == 0
    new = linededup.replace_texts(messy)
    assert new.columns == messy.columns and new.count() == messy.count()
    with pytest.raises(ValueError):
        linededup.dedup_lines(messy, steps=((5, 3),))


def test_sharding(spark, messy, empty):
    got = sharding.shard_by_bytes(messy).collect()
    assert len(got) == messy.count() and sharding.shard_by_bytes(empty).count() == 0
    import zlib

    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in messy.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in got) == want
    total, at, slots, place = sum(w[3] for w in want), 0, {}, {}
    for w in want:
        mid = at + w[3] // 2
        shard = sum(mid >= -(-total * k // 8) for k in range(1, 8))
        place.setdefault(w, []).append((shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += w[3]
    for w, where in place.items():
        assert sorted(where) == sorted((r.shard, r.slot) for r in got if (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) == w)
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 90).cast("int")).alias("text"))
    sizes = sharding.shard_by_bytes(even).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(sizes) == 8 and max(r.b for r in sizes) - min(r.b for r in sizes) <= 2 * 91 and all(r.n == r.m + 1 for r in sizes)
    assert np.isclose(sum(r.b for r in sizes), even.select(F.sum(F.length("text") + 1)).first()[0])
