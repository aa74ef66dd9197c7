import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import crf, decontam, langid, licenses, pieces, rules, wrappers

rng = random.Random(9)
EN = "the and of to in that is was for with thing other when have from".split()
DE = "der die das und ist nicht eine mit für auf sich wird keiten über schaft".split()
FR = "le la les des est une que dans pour elle tion leur être avec çois".split()
ES = "el los las que una por con para ción mente ñar está como del sus".split()


def prose(words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def bad(words, n):
    w = rng.choice(words)
    return " ".join([w] * n)


# Quality.


def slow_marginals(emit, step):
    """P(good) at each line by summing over all labellings."""
    n = len(emit)
    total, good = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = math.exp(sum(e for e, v in zip(emit, y, strict=True) if v) + sum(step[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward():
    r = np.random.default_rng(0)
    step = r.normal(size=(2, 2))
    sizes = np.array([1, 5, 3, 7, 3])
    emit = r.normal(size=sizes.sum())
    got = crf.forward_backward(emit, sizes, step)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for a, z in zip(at[:-1], at[1:], strict=True):
        assert np.allclose(got[a:z], slow_marginals(emit[a:z], step))


def test_gradient():
    """The training step follows the stated likelihood: its gradient is that of finite differences, and log Z is the sum over all labellings."""
    r = np.random.default_rng(1)
    sizes, good = np.array([2, 5, 1, 4]), np.array([1.0, 0.0, 1.0, 0.0])
    x, theta = r.normal(size=(sizes.sum(), crf.WIDTH)), r.normal(size=crf.WIDTH + 4) * 0.3
    value, grad = crf.objective(theta, x, sizes, good)
    for k in (0, 7, crf.WIDTH - 1, *range(crf.WIDTH, crf.WIDTH + 4)):
        h = np.zeros_like(theta)
        h[k] = 1e-5
        assert abs((crf.objective(theta + h, x, sizes, good)[0] - crf.objective(theta - h, x, sizes, good)[0]) / 2e-5 - grad[k]) < 1e-6
    emit, step, at, want = x @ theta[: crf.WIDTH], theta[crf.WIDTH :].reshape(2, 2), 0, 0.0
    for n, y in zip(sizes, good.astype(int), strict=True):
        path = lambda z, e: sum(a for a, b in zip(e, z, strict=True) if b) + sum(step[a][b] for a, b in zip(z, z[1:], strict=False))
        e = emit[at : at + n]
        every = math.log(sum(math.exp(path([c >> i & 1 for i in range(n)], e)) for c in range(1 << n)))
        want, at = want + (path([y] * n, e) - every) / n / len(sizes), at + n
    assert abs(value + 1e-4 / 2 * (theta**2).sum() - want) < 1e-9


def test_quality(spark, messy, empty):
    docs = [(k, "\n".join((prose if k % 3 else bad)(EN, 15) for _ in range(6))) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)] + [(None, 1, 0), (999, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    chain = crf.fit_quality(frame, labels)
    got = {r.doc_id: r for r in crf.score_quality(frame, chain).collect()}
    assert all(got[k].predicted == int(k % 3 > 0) for k in range(200, 300)) and all(0 <= r.score <= 1 for r in got.values())
    odd = crf.score_quality(messy, chain).collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd)
    assert crf.score_quality(empty, chain).count() == 0
    blank = crf.fit_quality(empty, labels.limit(0))
    assert crf.score_quality(messy, blank).count() == messy.count()


# Language.


def test_language(spark, messy, empty):
    rows = [(k, "\n".join(prose(w, 30) for _ in range(3)), x) for k, (x, w) in enumerate((("en", EN), ("de", DE), ("fr", FR), ("es", ES)) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id < 160"))
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    got = langid.identify(docs.where("doc_id >= 160"), model).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(messy, model).collect()}
    assert len(langid.identify(messy, model).collect()) == messy.count()
    assert [odd[k].lang_pred for k in (0, 1, 2, 4, 11)] == ["und"] * 5 and odd[0].score == 0.0 and odd[3].lang_pred != "und"
    assert langid.identify(empty, model).count() == 0
    none = langid.fit_languages(empty)
    assert {r.lang_pred for r in langid.identify(messy, none).collect()} == {"und"}
    kept = langid.keep_identified(messy, model, min_score=0.0)
    assert kept.columns == messy.columns and kept.where("text is null").count() == 0 and kept.count() == len([r for r in messy.collect() if r.text and re.search(r"[^\W\d_]", r.text)])


# Pieces.


def test_pieces_against_library():
    import sentencepiece

    with open(pieces.MODEL_PATH, "rb") as f:
        v = pieces.vocabulary(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = [prose(w, 40) for w in (EN, DE, FR, ES)] + ["", " ", "  a  b ", "\n\n\tx", "日本 ☃ Ünï\U0001f600 <s> </s> <unk>", "a" * 300, " " * 100, "aaa bbb" * 60]
    flat, count = pieces.encode_texts(v, texts, np.arange(len(texts)), 0.0, 1)
    at = np.concatenate([[0], np.cumsum(count)])
    for k, x in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == sp.encode(x)
    texts.append("▁ a▁b \x00")
    flat, count = pieces.encode_texts(v, texts, np.arange(len(texts)), 0.3, 1)
    again = pieces.encode_texts(v, texts, np.arange(len(texts)), 0.3, 1)
    heap = pieces.encode_texts(v, texts, np.arange(len(texts)), 0.3, 1, widest=1)
    assert np.array_equal(flat, again[0]) and np.array_equal(flat, heap[0]) and np.array_equal(count, heap[1])
    other = pieces.encode_texts(v, texts, np.arange(len(texts)), 0.3, 2)
    assert not np.array_equal(flat, other[0])
    for ids, n in ((flat, count), other):
        at = np.concatenate([[0], np.cumsum(n)])
        assert [pieces.decode_ids(v, ids[at[k] : at[k + 1]].tolist()) for k in range(len(texts))] == texts
    one, n = pieces.encode_texts(v, ["the other thing"] * 200, np.arange(200), 0.2, 1)
    at = np.concatenate([[0], np.cumsum(n)])
    assert len({tuple(one[at[k] : at[k + 1]]) for k in range(200)}) > 5


def test_pieces_on_frames(messy, empty):
    got = pieces.round_trip(messy).collect()
    assert len(got) == messy.count() and all(r.decoded == r.text for r in got)
    assert all((r.ids is None) == (r.text is None) for r in got)
    again = {(r.doc_id, r.decoded) for r in pieces.decode(pieces.encode(messy)).collect()}
    assert again == {(r.doc_id, r.text) for r in got} and pieces.round_trip(empty).count() == 0


# Benchmark passages.


def slow_hits(docs, items):
    cut = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    out = set()
    for d, text in docs:
        w = cut(text)
        for i, item in items:
            v = cut(item)
            if not v:
                continue
            wide, may = min(len(v), 13), 2 if len(v) >= 13 else 1 if len(v) > 8 else 0
            for shift in range(-len(v), len(w)):
                eq = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                if any(sum(eq[s : s + wide]) >= wide - may for s in range(len(v) - wide + 1)):
                    out.add((d, i))
                    break
    return out


def test_masks_find_all():
    from itertools import combinations

    for window, missing in ((13, 2), (9, 1), (10, 1), (11, 1), (12, 1)):
        spots = [{s + k for k, c in enumerate(m) if c == "1"} for m in decontam.MASKS for s in range(window - decontam.SPAN + 1)]
        assert all(any(not spot & set(gone) for spot in spots) for gone in combinations(range(window), missing))


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontamination(spark, messy, empty, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", most)
    words = [a + b for a in "abcdefgh" for b in EN]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate((1, 4, 7, 8, 9, 12, 13, 20, 40))] + [(50, ""), (51, None), (52, "  !! ")]
    docs = []
    for k in range(60):
        body = text(60)
        item = rng.choice(items[1:9])[1].split()
        for i in rng.sample(range(len(item)), min(len(item), rng.randrange(0, 4))):
            item[i] = rng.choice(words)
        at = rng.randrange(60)
        docs.append((k, ", ".join([*body[:at], *item, *body[at:]]).upper()))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert got == slow_hits(docs, items) and len(got) > 10
    marked = decontam.mark(messy, bench).collect()
    assert len(marked) == messy.count() and not any(r.contaminated for r in marked)
    assert decontam.mark(empty, bench).count() == 0 and decontam.mark(frame, bench.limit(0)).where("contaminated").count() == 0
    kept = decontam.drop_contaminated(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontam.drop_contaminated(messy, bench).count() == messy.count()


# Rules.


def slow_metrics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, messy, empty):
    rows = [(k, " ".join(rng.choice(EN[:3]) for _ in range(rng.randrange(0, 40)))) for k in range(60)] + [(k, "\n".join((prose(EN, 14) if k % 4 else "A%%% B### c$$$ d&&&") for _ in range(9))) for k in range(60, 140)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(messy.select("doc_id", "text"))
    want = Counter((i, *slow_metrics(x)) for i, x in ((r.doc_id, r.text) for r in frame.collect()))
    got = rules.judge(frame).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) and 0 <= r.posterior <= 1
    assert rules.judge(messy).count() == messy.count() and rules.judge(empty).count() == 0


def slow_votes(patterns):
    """The same estimate document by document, in plain loops."""
    docs = [p for p, n in patterns for _ in range(n)]
    weight = 10 + rules.WEIGHT * len(docs)
    share, right = 0.5, [[rules.RIGHT, rules.RIGHT] for _ in docs[0]]

    def chance(p):
        good, bad = share, 1 - share
        for v, (a, b) in zip(p, right, strict=True):
            good *= 1 if v < 0 else a if v else 1 - a
            bad *= 1 if v < 0 else 1 - b if v else b
        return good / (good + bad)

    for _ in range(300):
        good = [chance(p) for p in docs]
        new = []
        for k in range(len(right)):
            cast = [(p[k], g) for p, g in zip(docs, good, strict=True) if p[k] >= 0]
            new.append([(sum(g for v, g in cast if v) + rules.RIGHT * weight) / (sum(g for _, g in cast) + weight), (sum(1 - g for v, g in cast if not v) + rules.RIGHT * weight) / (sum(1 - g for _, g in cast) + weight)])
        share, right = (sum(good) + weight) / (len(docs) + 2 * weight), new
    return {p: chance(p) for p in set(docs)}


def test_votes():
    """Two junk kinds that several rules strike are bad; a source that trips one rule alone is not, however large."""
    patterns = [((1, 1, 1, 1, 1), 100), ((0, 0, 0, 1, 1), 8), ((0, 0, -1, 0, 1), 7), ((1, 1, 1, 1, 0), 40), ((-1, -1, -1, -1, -1), 3), ((1, -1, 0, 1, 1), 1)]
    share, right = rules.fit_votes(patterns)
    slow = slow_votes(patterns)
    assert all(abs(rules.posterior(p, share, right) - slow[p]) < 1e-6 for p, _ in patterns)
    assert [p for p, _ in patterns if rules.posterior(p, share, right) < 0.5] == [(0, 0, 0, 1, 1), (0, 0, -1, 0, 1)]
    assert rules.fit_votes([]) == (0.5, [])


def test_verdict_is_not_all_must_pass(spark):
    junk = [(k, " ".join(w + "%%%" for w in prose(EN, 80).split())) for k in range(20)]
    fine = [(k, "\n".join(prose(EN, 12 + k % 7) for _ in range(9))) for k in range(20, 200)]
    upper = [(k, x.upper()) for k, x in fine[:60]]
    rows = junk + fine[60:] + upper
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[k].kept for k, _ in junk) and all(got[k].kept for k, _ in fine + upper if not got[k].base_failed)
    assert sum(not got[k].base_failed for k, _ in upper) > 30


# Licences.


def test_licences(spark, messy, empty):
    apache, mit, gpl = (t for n, t in licenses.TEMPLATES if n in ("Apache-2.0", "MIT", "GPL-3.0") and ("Licensed under the A" in t and "(" not in t or "Released" in t or "This work" in t))
    files = [
        (1, "repo/LICENSE", f"{apache}\n"), (2, "repo/src/a.py", "x = 1"), (3, "repo/src/b.py", f"# {mit}\nx = 2"), (4, "repo/lib/COPYING.txt", gpl), (5, "repo/lib/deep/er/c.py", "y"),
        (6, "other/d.py", None), (7, "top.py", ""), (8, None, mit), (9, "repo/lib/COPYING.md", gpl), (10, "repo/src/LICENSE-not/e.py", "z"), (11, "repo/LICENSE.old/f.py", f"{prose(EN, 30)}\n{gpl.upper()}"),
    ]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(frame, path=F.col("path")).collect()}
    assert got == {
        1: ("Apache-2.0", "notice"), 2: ("Apache-2.0", "inherited"), 3: ("MIT", "notice"), 4: ("GPL-3.0", "notice"), 5: ("GPL-3.0", "inherited"), 6: (None, "none"),
        7: (None, "none"), 8: ("MIT", "notice"), 9: ("GPL-3.0", "notice"), 10: ("Apache-2.0", "inherited"), 11: ("GPL-3.0", "notice"),
    }
    twice = licenses.scan(frame.unionByName(frame), path=F.col("path")).collect()
    assert len(twice) == 2 * len(files) and {r.n_notices for r in twice} == {0, 1}
    odd = licenses.scan(messy, path=F.col("source")).collect()
    assert len(odd) == messy.count() and {r.origin for r in odd} == {"none"} and licenses.scan(empty).count() == 0


def test_anchors():
    weight = {t: 1.0 + k % 5 for k, t in enumerate(licenses.VOCABULARY)}
    vectors = licenses.template_weights(weight)
    held = set(licenses.anchors(vectors))
    for v in vectors:
        assert math.sqrt(sum(x * x for t, x in v.items() if t not in held)) < licenses.THRESHOLD


# Pages.

SITE = '<!DOCTYPE html><html><head><title>T{k}</title><script>if (a < b) "</p>"</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a><li>News {k}</ul></nav><div class="ad big">Buy {k}</div>{main}<aside>Other</aside><section id=comments><article>No {k}</article></section><form><p>Mail</p></form><footer>&copy; {k}</footer>'


def test_extraction():
    body = "<main><h1>Head&nbsp;{k}</h1><p>One <b>bold</b>\n text &amp; more &lt;x&gt; {k}<p>Two<br>lines {k}<ul><li>a{k}<li>b{k}</ul>{more}</main>"
    pages = [SITE.replace("{main}", body).replace("{more}", "<p>Extra {k}</p>" * (k % 3)).replace("{k}", str(k)) for k in range(8)]
    w = wrappers.dump(wrappers.infer(pages[:5]))
    for k, page in enumerate(pages):
        want = "\n\n".join([f"Head {k}", f"One bold text & more <x> {k}", f"Two lines {k}", f"a{k}", f"b{k}", *[f"Extra {k}"] * (k % 3)])
        assert wrappers.extract(page, w) == want == wrappers.extract(page, None)
    plain = [SITE.replace("{main}", "<div><p>Fixed line</p><div id=text><p>" + prose(EN, 40) + "</p><p>" + prose(EN, 30) + "</p></div></div>").replace("{k}", str(k)) for k in range(6)]
    w = wrappers.dump(wrappers.infer(plain))
    got = wrappers.extract(plain[3], w)
    assert got.count("\n\n") == 1 and "Fixed" not in got and "Buy" not in got and "No 3" not in got
    assert wrappers.extract(None, w) == wrappers.extract("", w) == "" and wrappers.extract("just text", None) == "just text"
    assert wrappers.extract("<p>a<p>b<div><", None)


def test_wrapper_decides():
    """What the pages of a host have in common tells more than a page alone: the template inside the article, and where the text lies."""
    share = "<article><h1>Head {k}</h1><p>{text}</p><p>Share this article with your friends and read our other news</p></article>"
    pages = [SITE.replace("{main}", share).replace("{text}", prose(EN, 25)).replace("{k}", str(k)) for k in range(5)]
    w = wrappers.dump(wrappers.infer(pages))
    assert "Share this" in wrappers.extract(pages[2], None) and "Share this" not in wrappers.extract(pages[2], w) and "Head 2" in wrappers.extract(pages[2], w)
    divs = "<html><body><div class=story><p>{text}</p></div><div class=more><p>{other}</p></div></body></html>"
    pages = [divs.replace("{text}", prose(EN, 60)).replace("{other}", prose(EN, 8)) for _ in range(5)] + [divs.replace("{text}", "A short one.").replace("{other}", prose(DE, 20))]
    w = wrappers.dump(wrappers.infer(pages[:5]))
    assert wrappers.extract(pages[5], w) == "A short one." != wrappers.extract(pages[5], None)
    other = "<html><body><table><tr><td>Quite another page of the host</table></body></html>"
    assert wrappers.extract(other, w) == "Quite another page of the host"


def test_hints():
    """Classes are weak hints: whole names, and not for what holds most of the text."""
    text = prose(EN, 30)
    for name in ("single no-sidebar", "with-sidebar", "sidebar", "has-footer"):
        assert wrappers.extract(f'<body class="{name}"><div><p>{text}</p></div><div class="sidebar">Other</div></body>', None) == text
    same = [f"<p>{text}</p><p>{text}</p>"] * 4
    assert wrappers.extract(same[0], wrappers.dump(wrappers.infer(same))) == f"{text}\n\n{text}"


def test_large_units():
    """A repeated element of many nodes is one group."""
    card = "<section>" + "".join(f"<h3>h{{k}}{i}</h3><div><p>t{{k}}{i}</p></div><blockquote>q</blockquote>" for i in range(9)) + "</section>"
    page = "<body>" + "".join(card.replace("{k}", str(k)) for k in range(5)) + "</body>"
    assert sum(n[0][0] == "+" for n in wrappers.fold(wrappers.tokens(page))) == 1


def test_wrapper_inference():
    w = wrappers.infer(["<ul><li>a<li>b</ul><p>x", "<ul><li>c</ul><h2>n</h2><p>x", "<ul><li>d<li>e<li>f</ul><p>x"])
    assert ("+", (("<", "li"), ("t",), (">", "li"))) in w.keys
    assert [o for k, o in zip(w.keys, w.optional, strict=True) if k in (("<", "h2"), (">", "h2"))] == [True, True]
    assert any(s[0] == {"x": 3} for slots in w.slots for s in slots)


@pytest.mark.parametrize("most", [48_000_000, 400])
def test_pages(spark, monkeypatch, most):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", most)
    rows = [(k, f"https://{'big' if k % 2 else 'h' + str(k % 6)}.example.org/{k}", SITE.replace("{main}", "<article><p>Text {k}</p></article>").replace("{k}", str(k))) for k in range(60)]
    rows += [(60, None, rows[0][2]), (61, "nonsense", None), (62, "http://x.org", ""), (None, "http://x.org", "<p>alone"), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, wrapper string, host string")
    got = wrappers.main_text(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[k] == f"Text {k}" for k in range(60)) and by[60] == "Text 0" and by[61] == by[62] == "" and by[None] == "alone"
    assert wrappers.main_text(frame.limit(0)).count() == 0
