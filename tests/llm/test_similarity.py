"""Near duplicates of vectors, texts and lines, and nearest neighbours, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sievegrid.llm import op01_embedding_neardup, op02_ngram_join, op03_line_dedup, op10_ann
from sievegrid.llm.components import components


def unions(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    want = unions({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n != 7}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id string, v int"


def brute_vectors(rows, threshold):
    links = []
    for i, (a, x, la, *_) in enumerate(rows):
        for b, y, lb, *_ in rows[:i]:
            if la is None or la != lb or any(v is None or len(v) != 8 or any(c is None or not np.isfinite(c) for c in v) or not any(v) for v in (x, y)):
                continue
            p, q = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= threshold:
                links.append((b, a))
    return links


@pytest.mark.parametrize("tile", [1024, 16])
def test_vector_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(op01_embedding_neardup, "TILE", tile)
    monkeypatch.setattr(op01_embedding_neardup, "LEAF", 24)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((160, 8))
    near = x[:40] + 0.05 * rng.standard_normal((40, 8))
    hot = x[0] + 0.1 * rng.standard_normal((60, 8))
    rows = [(i, [float(c) for c in v], int(i % 2), "k", 0) for i, v in enumerate([*x, *near, *hot])]
    rows += [(1000 + i, rows[3][1], 1, "k", 0) for i in range(30)] + [(2000, None, 1, "", 0), (2001, [0.0] * 8, 1, "", 0), (2002, [float("nan")] + [1.0] * 7, 1, "", 0), (2003, rows[3][1], None, "", 0), (2004, [None] + [1.0] * 7, 1, "", 0), (2005, [1.0, 2.0], 1, "", 0), (2006, [2 * c for c in rows[3][1]], 1, "", 0)]
    links = brute_vectors(rows, 0.98)
    want = unions([r[0] for r in rows], links)
    n = {r[0]: sum(r[0] in e for e in links) for r in rows}
    got = op01_embedding_neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert op01_embedding_neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("wide,frequent", [(128, 48), (3, 2), (1, 10**9)])
def test_ngram_components(spark, monkeypatch, wide, frequent):
    monkeypatch.setattr(op02_ngram_join, "WIDE", wide)
    monkeypatch.setattr(op02_ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(op02_ngram_join, "SEEN", 1)
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randint(0, 4000)
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        base = [word() for _ in range(rng.choice([3, 20, 120]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    base = [word() for _ in range(150)]
    rows += [" ".join(base[: 75 + k] + [word()] + base[76 + k :]) for k in range(12)]
    rows += [" ".join([word() for _ in range(100)] + passage) for _ in range(15)] + [" ".join(passage)] * 6 + [" ".join(passage[i:] + [word() for _ in range(i)]) for i in range(0, 24, 2)]
    rows += [None, "", " \n ", "One two\tThree", "one TWO three", "one two three four", "É a b", "é a b"] + rows[:5]
    docs = [(i * 3, x, "z", 9) for i, x in enumerate(rows)]
    sets = {i: shingle_set(x) for i, x, *_ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = unions(list(sets), links)
    got = op02_ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string, k string, n int")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert op02_ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_sets_of_slices():
    texts = [None, "", " \n ", "A  b\tc\nd\x0be\x0cf\rg ", "a\x85b c\u3000d", "x\x1cy \x1fz", "\u00c9 \u00e9 B", "a b c d", "a b c d e", "a b c d e a b c d e a b", "w" * 70_000 + " q"] * 3
    for at in (0, 5, 17):
        got = op02_ngram_join.shingle_sets(pa.array(texts).slice(at), 5)
        assert [len(x) for x in got] == [len(shingle_set(x)) for x in texts[at:]]
        assert all((x == op02_ngram_join.shingles(y, 5)).all() for x, y in zip(got, texts[at:], strict=True))


def test_ngrams_frequent_in_the_table_but_in_no_batch(spark, monkeypatch):
    """They come last in the order: rows that share little else are neither multiplied nor copied to tiles."""
    monkeypatch.setattr(op02_ngram_join, "WIDE", 8)
    monkeypatch.setattr(op02_ngram_join, "FREQUENT", 8)
    rows, materialize = {}, op02_ngram_join.materialize

    def counted(df, tag):
        out = materialize(df, tag)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(op02_ngram_join, "materialize", counted)
    phrases = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(8)]
    docs = [(i, " ".join([f"w{i}x{j}" for j in range(40)] + phrases)) for i in range(24)] + [(24, " ".join([f"w3x{j}" for j in range(40)] + [*phrases, "more"]))]
    # Two rows a batch.
    got = op02_ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(12)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 3 if i == 24 else i for i, _ in docs}
    assert rows["ngram-wide"] == 0 and rows["ngram-open"] == 0 and rows["ngram-wanted"] == 2


def test_ngram_rows_that_repeat_ids(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    schema = "doc_id long, text string, k int, n_shingles int"
    rows = [(1, word("b", 60)), (1, word("a", 60)), (2, word("b", 60) + " x"), (3, word("a", 60) + " y")]
    got = op02_ngram_join.ngram_components(spark.createDataFrame([(*r, 0, 0) for r in rows], schema)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    # Rows without an id link others, and name nothing.
    c = [f"c{i}" for i in range(64)]
    chain = [(7, " ".join(c)), (None, " ".join([*c, "p", "q", "r", "s"])), (9, " ".join([*c, "p", "q", "r", "s", *(f"t{i}" for i in range(14))])), (None, word("d", 40)), (None, word("d", 40)), (4, None), (4, " ")]
    sets = [shingle_set(x) for _, x in chain]
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    long = " ".join(f"l{i}" for i in range(60_000))
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows + chain + [(20, long), (21, long + " more")]], schema)
    got = op02_ngram_join.ngram_components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (7, 7), (-1, 7), (9, 7), (-1, -1), (-1, -1), (4, 4), (4, 4), (20, 20), (21, 20)])
    left = op02_ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:2]) for r in left.collect()) == sorted([(1, "b0"), (1, "a0"), (7, "c0"), (-1, "d0"), (4, ""), (4, " "), (20, "l0")])
    assert op02_ngram_join.drop_near_copies(docs.limit(0)).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_one_edit():
    rng = random.Random(4)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
        assert op03_line_dedup.within_one_edit(a, b) == (edit(a, b) <= 1)


def brute_lines(docs, least):
    places = [(d, i, s) for d, x in docs if d is not None for i, l in enumerate((x or "").split("\n")) if len(s := l.strip(" \t\r")) >= least]
    places.sort(key=lambda p: p[:2])
    return {(d, i) for n, (d, i, s) in enumerate(places) if any((d2, i2) < (d, i) and abs(len(s2) - len(s)) <= 1 and edit(s, s2) <= 1 for d2, i2, s2 in places[:n])}


def test_line_dedup(spark):
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 12))).strip()
    pool = [line() for _ in range(30)] + ["x" * 5000, "x" * 4999, "aaaa bbbb", "aaaa bbb", "aaa bbbb"]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            s = rng.choice(pool)
            if s and rng.random() < 0.5:
                i = rng.randrange(len(s))
                s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "z" + s[i:], s[:i] + "q" + s[i + 1 :]])
            lines.append(rng.choice(["", " ", "\t"]) + s)
        docs.append((rng.randint(0, 999) * 100 + d, "\n".join(lines)))
    docs += [(-1, None), (-2, ""), (None, "aaaa bbbb\naaaa bbbb"), (-3, "\n\n")]
    df = spark.createDataFrame([(d, x, "u", 1) for d, x in docs], "doc_id long, text string, line string, no int")
    gone = brute_lines(docs, 5)
    out = op03_line_dedup.dedup_lines(df, 5)
    assert out.columns == ["doc_id", "text", "line", "no", "n_lines", "n_dropped"]
    for r in out.collect():
        x = dict(docs)[r["doc_id"]]
        want = x if not x or r["doc_id"] is None else "\n".join(l for i, l in enumerate(x.split("\n")) if (r["doc_id"], i) not in gone)
        assert r["text"] == want and r["n_dropped"] == sum(d == r["doc_id"] for d, _ in gone)
    assert op03_line_dedup.dedup_lines(df.limit(0), 5).count() == 0


def test_short_lines_are_dropped_when_equal(spark):
    import corpus_pipeline

    docs = [(1, "}\n\na line of more than twenty signs\nabcd"), (2, "\n } \nabce\na line of more than twenty sign\nabcd"), (3, "\t}\r"), (4, "\n")]
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: docs[0][1], 2: "\nabce", 4: "\n"}
    assert {r["doc_id"]: r["n_dropped"] for r in op03_line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_lines_of_rows_that_repeat_ids(spark):
    long = "\n".join(f"row {i} of a very long document" for i in range(30_000))
    docs = [(1, "}\nthe first line of it all", 0), (1, "unlike it\nanother line, of another text", 0), (2, "}\nTHE first line of it all\nthe first line of it al", 0), (3, "}\n12", 0), (3, "}\n12", 0), (4, "}\n13", 0), (5, long, 0), (6, long + "\nend", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __line int")
    got = op03_line_dedup.dedup_lines(df, exact=1).select("doc_id", "text").collect()
    # Rows of one id and text keep alike what the earliest place has; 12 and 13 are too short to be near.
    small = sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] < 5)
    assert small == sorted([(1, docs[0][1]), (1, docs[1][1]), (2, "THE first line of it all"), (3, "12"), (3, "12"), (4, "13")])
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[6] == "end" and len(text[5]) < len(long) and text[5].startswith("row 0 of")


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16))
    x[300:500] = x[0] + 0.2 * rng.standard_normal((200, 16))
    x[600:640] = x[50]
    rows = [(i, [float(c) for c in v], 0, "", 1) for i, v in enumerate(x)] + [(5000, None, 0, "", 1), (5050, [0.0] * 16, 0, "", 1), (5100, [float("inf")] * 16, 0, "", 1), (7, [float(c) for c in x[7]], 0, "", 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = op10_ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    u = np.array([v for _, v, *_ in rows[:900]], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(900), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[m[1]] - m[2]) < 1e-12 for m in mine)
        hit += len({m[1] for m in mine} & set(best))
    assert hit >= 0.9 * 5 * 18 and {r["query_id"] for r in got} == set(range(0, 900, 50))
    assert op10_ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert op10_ann.nearest(df.where("vec_id in (0, 1, 2)"), df.where("vec_id = 0")).count() == 2


def test_vectors_of_doubles_and_odd_ids(spark):
    x = np.random.default_rng(8).standard_normal((30, 8))
    near = x[:10] * (1 + 1e-11 * np.arange(10)[:, None]) + 1e-10
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate([*x, *near])] + [(None, [float(c) for c in x[0]], 1), (3, [float(c) for c in x[5]], 1), (50, [1e200] * 8, 1), (51, [1e-200] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cosine = lambda a, b: float(np.dot(u := np.array(a) / np.abs(a).max(), w := np.array(b) / np.abs(b).max()) / np.linalg.norm(u) / np.linalg.norm(w))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in op10_ann.nearest(df, df.where("vec_id in (0, 50)"), 3).collect()}
    assert len(got) == 6 and got[50, 51] == pytest.approx(1, abs=1e-15) and got[0, 30] == pytest.approx(cosine(rows[0][1], rows[30][1]), abs=1e-15)
    links = op01_embedding_neardup.near_duplicates(df).collect()
    assert len(links) == len(rows) and sum(r["vec_id"] is None and r["n_links"] == 0 for r in links) == 1
    own = {r["vec_id"]: r for r in links if r["vec_id"] not in (None, 3)}
    assert own[30]["component_id"] == 0 and own[30]["n_links"] == 1 and own[51]["component_id"] == 50 and own[35]["component_id"] == 3


def test_ann_queries_never_pass_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(op10_ann, "ROWS", 40)
    monkeypatch.setattr(op10_ann, "QUERIES", 8)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<float>")
    found = op10_ann.nearest(df, df)
    assert found.count() == 1500 and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan
