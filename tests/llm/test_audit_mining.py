"""The filter audit, hard negatives and Lempel-Ziv fingerprints, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sievegrid.llm import op11_filter_audit, op12_hard_negatives, op13_lempel_ziv

# Columns that clash with names used inside, and more.
DOCS = "doc_id long, text string, lang string, k string, words int, id long, fails int"


def fails(rows):
    def one(i, text):
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        return "".join(
            f for f, x in zip(
                "ABCDE", (
                    len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                    bool(re.search("[#$%&*|]", text)), any(i is not None and j is not None and j < i and (t or "") == text for j, t, *_ in rows),
                ), strict=True,
            ) if x
        )

    return [one(i, t) for i, t, *_ in rows]


def audited(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing, out, share = fails(rows), {}, Counter()
    parts = {lang or "" for _, _, lang, *_ in rows}
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            gone = [i for i in left if f in failing[i]]
            left = [i for i in left if f not in failing[i]]
            for p in parts:
                mine = lambda ids, p=p: [i for i in ids if (rows[i][2] or "") == p]
                here, all_ = mine(gone), [i for i in mine(range(len(rows))) if f in failing[i]]
                share[p, f] += len(here)
                out[p, order, step] = (len(mine(left)), len(here), len(all_) - len(here), sum(failing[i] == f for i in all_), sum(rows[i][0] in good for i in here), sum(rows[i][0] in toxic for i in here))
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(11)
    some = ["low", "Upper", "CAPS", "a#b", "10%", "x", "é", "schön", "\x1c", "\x85nel"]
    texts = [" ".join(rng.choice(some[: rng.choice([3, 10])] + [f"w{j}" for j in range(rng.choice([1, 400]))]) for _ in range(rng.choice([0, 5, 199, 200, 201, 500]))) for _ in range(60)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "A" * 4000, "word " * 30_000, " ".join(f"w{i}" for i in range(40_000)), " ".join(["a", "b"] * 100), " ".join(f"v{i // 2}" for i in range(400))]
    rows = [(i * 3, t, rng.choice(["en", "de", None, ""]), "k", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i % 4], "en", "k", 1, 2, 3) for i in range(25)] + rows[:6] + [(3, "another text of an id", "en", "k", 1, 2, 3), (None, texts[0], "fr", "", 0, 0, 0), (None, texts[0], "fr", "", 0, 0, 0), (None, "x", None, "", 0, 0, 0), (-5, texts[1], "en", "", 0, 0, 0)]
    labels = [(i * 3, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(50)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (-5, 1, 1)]
    got = op11_filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == audited(rows, labels)
    empty = op11_filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.columns == got.columns and empty.count() == 0


def test_audit_texts_move_once_without_python(spark):
    frame = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    plan = op11_filter_audit.word_counts(op11_filter_audit._classes(frame, "doc_id", "text", "lang"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


VECTORS = "vec_id long, embedding array<double>, label int, id long, v string, cell int"


def mined(rows, anchors, positives=5, negatives=10):
    known = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or len(v) != 8 or any(x is None or not math.isfinite(x) or abs(x) > 1e5 for x in v):
            continue
        x = [math.floor(256 * c) for c in v]
        known[i] = min(known.get(i, (label, x)), (label, x))
    dot = lambda a, b: sum(p * q for p, q in zip(known[a][1], known[b][1], strict=True))
    out = []
    for a in sorted(set(anchors) & set(known)):
        ranked = sorted((-dot(a, b), b) for b in known if b != a)
        for s, p in [(-s, b) for s, b in ranked if known[b][0] == known[a][0]][:positives]:
            hard = [(b, -t) for t, b in ranked if known[b][0] != known[a][0] and 30 * s <= -100 * t <= 90 * s][:negatives]
            out += [(a, p, r, b, s, t) for r, (b, t) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,leaf,cells", [(4096, 64, 1024), (40, 5, 16), (64, 1, 3)])
def test_hard_negatives(spark, monkeypatch, block, leaf, cells):
    for name, v in (("ROWS", block), ("LEAF", leaf), ("CELLS", cells), ("QUERIES", 7)):
        monkeypatch.setattr(op12_hard_negatives, name, v)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((6, 8)) * 2
    rows = [(i, (centres[i % 6] + rng.standard_normal(8) * 0.4).tolist(), int(rng.integers(0, 4)) if i % 3 else 0, 1, "x", 2) for i in range(500)]
    rows += [(1000 + i, rows[7][1], i % 2, 1, "x", 2) for i in range(60)] + rows[:5]  # ties, and rows that repeat
    rows += [(7, rows[9][1], 3, 0, "", 0), (2000, None, 1, 0, "", 0), (2100, [1.0] * 8, None, 0, "", 0), (2200, [float("nan")] + [1.0] * 7, 1, 0, "", 0), (2300, [None] + [1.0] * 7, 1, 0, "", 0), (2400, [float("inf")] + [1.0] * 7, 1, 0, "", 0)]
    rows += [(None, [1.0] * 8, 1, 0, "", 0), (2500, [1.0, 2.0], 1, 0, "", 0), (2600, [0.0] * 8, 1, 0, "", 0), (2700, [1e300] * 8, 1, 0, "", 0), (2800, [], 1, 0, "", 0), (2900, [9e4] * 8, 2, 0, "", 0), (-100, rows[50][1], 77, 0, "", 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    anchors = [r[0] for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = op12_hard_negatives.hard_negatives(frame, frame.where("vec_id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == mined(rows, anchors)
    assert op12_hard_negatives.hard_negatives(frame.limit(0), frame.limit(0)).count() == 0


def test_hard_negative_trees_prune(spark):
    """Bounds leave most of clustered rows out, beneath the k-th best and outside the window."""
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.standard_normal((32, 16)) * 400, 128, axis=0) + rng.standard_normal((4096, 16)) * 10).astype(np.int64)
    label, ids = np.repeat(np.arange(32), 128), np.arange(4096)
    order, nodes = op12_hard_negatives.ball_tree(label, x)
    x, label, ids = x[order], label[order], ids[order]
    none = np.full(40, op12_hard_negatives.LEAST)
    at = np.arange(0, 4096, 103)[:40]
    ask = {"v": x[at], "id": ids[at], "label": label[at], "low": none, "high": -none, "floor": none}
    q, row, score, made = op12_hard_negatives.search(ask, ids, label, x, nodes, 5, True)
    assert made < 0.1 * 40 * 4096 and len(q) == 200
    own = np.bincount(q, weights=score, minlength=40)
    high = (own / 5 * 0.5).astype(np.int64)
    q, row, score, made = op12_hard_negatives.search(ask | {"high": high}, ids, label, x, nodes, 10, False)
    assert made < 0.3 * 40 * 4096
    for i in range(40):
        all_ = sorted((-s, j) for s, j in zip((x @ x[at[i]]).tolist(), ids.tolist(), strict=True) if s <= high[i] and label[ids == j][0] != label[at[i]])[:10]
        assert [(-s, ids[r]) for s, r in zip(score[q == i], row[q == i], strict=True)] == all_


TEXTS = "doc_id long, text string, id long, range int, copy int"


def plain_phrases(text):
    known, start = set(), 0
    for i in range(1, len(text) + 1):
        if text[start:i] not in known:
            known.add(text[start:i])
            start = i
    return known


def test_phrases():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 50, 3000, 70_000):
        a, b = ("".join(rng.choice("abé\U0001f600 ") for _ in range(n)) for _ in range(2))
        kept = n - n // 4
        parse = op13_lempel_ziv.Parse()
        parse.read(a[:kept])
        own, other = parse.branches(a[kept:], b[kept:], kept)
        for text, ends in ((a, own), (a[:kept] + b[kept:], other)):
            phrases = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            assert set(phrases) == plain_phrases(text) and len(set(phrases)) == len(phrases)
            h = op13_lempel_ziv.phrase_hashes(text, ends)
            assert len(set(h.tolist())) == len(phrases)
            again = "zz" + "".join(reversed(phrases))  # a phrase has its hash wherever it stands
            at = np.cumsum([2, *(len(p) for p in reversed(phrases))]).tolist()
            assert op13_lempel_ziv.phrase_hashes(again, at).tolist()[1:] == h.tolist()[::-1]


def test_likeness_follows_shared_phrases():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    base = [rng.choice(words) for _ in range(3000)]
    for share in (1.0, 0.9, 0.5, 0.0):
        a, b = " ".join(base), " ".join(base[: int(3000 * share)] + [rng.choice(words)[::-1] for _ in range(3000 - int(3000 * share))])
        x, y = plain_phrases(a), plain_phrases(b)
        assert abs(op13_lempel_ziv.likeness(op13_lempel_ziv.fingerprint(a), op13_lempel_ziv.fingerprint(b)) - len(x & y) / len(x | y)) < 0.15


@pytest.mark.parametrize("sample,ranges", [(20_000, 4), (5, 1), (30, 50)])
def test_fingerprints(spark, monkeypatch, sample, ranges):
    monkeypatch.setattr(op13_lempel_ziv, "SAMPLE", sample)
    monkeypatch.setattr(op13_lempel_ziv, "RANGES", ranges)
    rng = random.Random(sample)
    texts = ["".join(rng.choice("ab c\U0001f600é") for _ in range(rng.choice([0, 1, 3, 4, 40, 900]))) for _ in range(80)] + [None, "", "x" * 50_000, None]
    rows = [(rng.randint(-50, 500) if i % 9 else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(77, texts[i % 3], 1, 2, 3) for i in range(8)] + [(600, "the last", 1, 2, 3)]
    want, m = Counter(), op13_lempel_ziv
    keyed = spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string").selectExpr("xxhash64(t)").collect()
    order = sorted((r[0], h[0], r[1] or "") for r, h in zip(rows, keyed, strict=True) if r[0] is not None)
    for i, (d, _, x) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        edited = x[: len(x) - len(x) // 4] + after[: len(x) // 4]
        a, b, c = map(m.fingerprint, (x, edited, after))
        want[d, len(x), hashlib.sha256(edited.encode()).hexdigest(), m.written(a), m.written(b), m.likeness(a, b), m.likeness(a, c)] += 1
    for d, x, *_ in rows:
        if d is None:
            f = m.fingerprint(x or "")
            want[d, len(x or ""), hashlib.sha256((x or "").encode()).hexdigest(), m.written(f), m.written(f), 1.0, None] += 1
    frame = spark.createDataFrame(rows, TEXTS)
    assert Counter(map(tuple, m.fingerprint_with_neighbours(frame).collect())) == want
    one = m.fingerprint_with_neighbours(spark.createDataFrame([(4, "abcdabcd", 1, 2, 3)], TEXTS)).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in one] == [(4, 8, 1.0)]
    assert m.fingerprint_with_neighbours(spark.createDataFrame([], TEXTS)).count() == 0
