import random

import corpus_pipeline
import pytest
from loomwork.llm import linededup, queries

from test_near_copies import changed, lev

GROWING = ((20, 1), (40, 2), (60, 3))


def brute_later(lines, steps):
    """Numbers of the lines that are near one with a smaller number."""
    edits = lambda n: max([k for least, k in steps if n >= least], default=0)
    near = lambda a, b, k: abs(len(a) - len(b)) <= k and 0 < lev(a, b) <= k
    return {j for j in range(len(lines)) for i in range(j) if near(lines[i], lines[j], edits(min(len(lines[i]), len(lines[j]))))}


def later(spark, lines, steps):
    frame = spark.createDataFrame([(i, x, len(x), i, 0, 0) for i, x in enumerate(lines)], "id long, line string, n int, doc long, row long, pos int")
    got = [r.id for r in linededup.later_lines(frame.repartition(3), steps).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_growing(spark):
    rng = random.Random(6)
    lines = set()
    for n in (22, 38, 41, 58, 61, 63, 90):
        for _ in range(3):
            a = "".join(rng.choice("abcdefgh ") for _ in range(n))
            lines |= {changed(rng, a, rng.randrange(0, 5)) for _ in range(10)}
    lines = list(lines)
    rng.shuffle(lines)
    assert later(spark, lines, GROWING) == brute_later(lines, GROWING)


@pytest.mark.parametrize(("steps", "crowd"), [(((4, 1),), 4), (((6, 2),), 12)])
def test_short_alphabet(spark, monkeypatch, steps, crowd):
    """Lines that share most segments, so that crowded keys are cut further down to a few characters."""
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rng = random.Random(steps[0][1])
    lines = set()
    for _ in range(4):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(8, 24)))
        lines |= {changed(rng, a, rng.randrange(0, 4)) for _ in range(8)}
    lines |= {"x" * k + f"Q{k}" + "x" * (16 - k) for k in range(16)}
    lines = [x for x in lines if len(x) >= steps[0][0]]
    rng.shuffle(lines)
    assert later(spark, lines, steps) == brute_later(lines, steps)


def test_numbered_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", 8)
    lines = [f"The order with the number {k * 37 % 1000:03d} has been sent to you." for k in range(60)]
    assert later(spark, lines, ((20, 1),)) == brute_later(lines, ((20, 1),))


def test_query_and_stage(spark, tmp_path):
    long = "the erin at ntreou thnder wh anble of the ring est ner lyst and other words"
    rows = [(1, long, "en", "s", 0), (2, long.replace("lyst", "last"), "en", "s", 0), (3, "short line", "en", "s", 0), (4, "short line\n\nother", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()] == [long, "", "short line", "\nother"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_kept for r in queries.op3_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [1, 0, 1, 2]


def test_query_allows_more_edits_in_longer_lines(spark, tmp_path):
    a = "a line of more than forty characters, for two edits"
    b = "and here is a still longer line of more than sixty characters, for three edits"
    rows = [(1, f"{a}\n{b}"), (2, a.replace("forty", "fourti")), (3, b.replace("still", "stll").replace("sixty", "sixtyes")), (4, a.replace("forty", "fifteen"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_kept for r in queries.op3_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [2, 0, 0, 1]


def test_crowd_of_near_copies(spark, monkeypatch):
    """Copies of one long line with words put in, most of them too far apart: cut into segments level by level, this had not ended after 170 s."""
    monkeypatch.setattr(linededup, "CROWD", 8)
    rng = random.Random(8)
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(14))
    lines = []
    for _ in range(45):
        at = rng.randrange(len(base))
        lines.append(base[:at] + "".join(rng.choice("xyz&") for _ in range(rng.randrange(2, 6))) + base[at:])
    lines += [changed(rng, x, rng.randrange(1, 4)) for x in lines[:15]]
    lines = list(dict.fromkeys(lines))
    rng.shuffle(lines)
    want = brute_later(lines, GROWING)
    assert later(spark, lines, GROWING) == want and 0 < len(want) < len(lines)


def test_keys_compile(spark):
    """No method of the generated code is too long for Java to compile (8000 bytes): as one expression, the keys of up to three edits were."""
    lines = spark.createDataFrame([(1, 0, "some words " * 9, 99)], "id long, base long, text string, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = linededup._keyed(lines, GROWING).selectExpr("sum(key)", "max(at)")._jdf.queryExecution().executedPlan()
        parts = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and 0 < max(sizes) < 8000


def test_pairs_meet_under_one_key(spark):
    """Lines of a template share several keys; each pair is made once."""
    rng = random.Random(3)
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(14))
    lines = list(dict.fromkeys(changed(rng, base, rng.randrange(1, 3)) for _ in range(40)))
    frame = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "id long, line string, n int")
    keyed = linededup._keyed(frame.selectExpr("id", "0L as base", "line as text", "n"), GROWING).join(frame.selectExpr("id", "id as place"), "id")
    pool = frame.selectExpr("id", "n", f"array_repeat(0, {len(linededup.COUNTED)}) as counts")
    got = [(r.r, r.s, r.edits) for r in linededup._meetings(keyed, keyed, pool).selectExpr("r", "s", "3 as edits").collect()]
    assert len(got) == len(set(got)) > 0
    near = {(j, i) for j in range(len(lines)) for i in range(j) if lev(lines[i], lines[j]) <= 3}
    assert near <= {(r, s) for r, s, _ in got}
