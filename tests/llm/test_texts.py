"""Personal data, toxicity, chats, and the pipeline."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievegrid.llm import op05_pii, op06_toxicity, op09_chat

FORMS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for k, form in enumerate(FORMS):
        for m in form.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_forms():
    rng = random.Random(1)
    for al in ("a1.@-b+ %", "0123456789.-+() ", "1.25@", "0 1-2+(9).@a"):
        for _ in range(4000):
            x = "".join(rng.choice(al) for _ in range(rng.randint(0, 45)))
            assert op05_pii.base_spans(x) == brute(x), x
    for x in ("1" * 100_000, "a" * 100_000, "a@" * 50_000, "1." * 50_000):
        assert op05_pii.spans_of(x, {"p"})


def test_credentials_teach_their_context(spark):
    """A fifth of the credentials are seeds; the others, and what else stands where they stand, are found by context."""
    hexa = lambda i: f"{zlib.crc32(str(i).encode()):08x}" * 5
    rows = [(i, f'some words {i} and token = "{hexa(i)}" more') for i in range(60)]
    rows += [(150, 'TOKEN="K9-unseen-7x7"'), (151, f"a digest {hexa(99)} alone"), (152, "the token of year 2024x7 is"), (153, 'token = "none"'), (154, None)]
    rows += [(200 + i, f"build {hexa(500 + i)[:12]} of commit {hexa(700 + i)[:9]}z") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seeds = [i for i in range(60) if op05_pii.seeded(hexa(i))]
    assert 2 <= len(seeds) <= 20
    patterns = op05_pii.bootstrap(docs)
    assert 'token="' in patterns
    got = {r["doc_id"]: r["spans"] for r in op05_pii.extract(docs, patterns).collect()}
    for i, x in rows[:60]:
        at = x.index('"') + 1
        assert f"id:{at}:{at + 40}" in got[i]
    assert got[150] == "id:7:20" and not any(v for k, v in got.items() if k > 150)
    # Without a seed there is nothing to learn from.
    assert op05_pii.bootstrap(spark.createDataFrame([r for r in rows if r[0] not in seeds], docs.schema)) == []


def test_graph_scoring_equals_a_naive_version(spark, monkeypatch):
    """Turns of scoring over plain dictionaries."""
    rng = random.Random(15)
    rows = []
    for i in range(160):
        before = rng.choice(["case ref", "case no", "mail me at", "room", "see"])
        what = rng.choice([f"u{i % 23}@x.org", f"AB{i % 31:04d}77", f"10.0.0.{i % 9}"])
        rows.append((i, f"{before} {what} end {rng.choice(['case', 'room', 'see'])} it"))
    got = op05_pii.bootstrap(spark.createDataFrame(rows, "doc_id long, text string"))
    edges, seeds, total = Counter(), set(), Counter()
    join = lambda units: re.sub(r" (?=[^\w\s])", "", " ".join(units))
    for _, x in rows:
        base = op05_pii.base_spans(x)
        for s, e, seed in [(s, e, True) for s, _, e in base] + [(s, e, False) for s, e in op05_pii.others(x, base)]:
            units = re.findall(r"\w+|[^\w\s]", x[:s].lower())[-3:]
            for k in range(1, len(units) + 1):
                if re.search(r"\w", join(units[-k:])):
                    edges[join(units[-k:]), x[s:e].lower()] += 1
            seeds |= {x[s:e].lower()} if seed else set()
        units = re.findall(r"\w+|[^\w\s]", x.lower())
        for i in range(len(units)):
            total.update(join(units[i - k + 1 : i + 1]) for k in (1, 2, 3) if i >= k - 1)
    some = {p for p, n in Counter(p for p, _ in edges).items() if n >= op05_pii.SUPPORT}
    edges = {k: n for k, n in edges.items() if k[0] in some}
    belief = {i: float(i in seeds) for _, i in edges}
    for _ in range(op05_pii.TURNS):
        good = {}
        for p in some:
            own = [(i, n) for (q, i), n in edges.items() if q == p]
            n = sum(m for _, m in own)
            purity = sum(m * belief[i] for i, m in own) / n
            if purity >= op05_pii.PURITY and n / total[p] >= op05_pii.SHARE and sum(belief[i] >= 0.5 for i, _ in own) >= op05_pii.SUPPORT:
                good[p] = purity
        for i in belief:
            doubt = sum(math.log1p(-0.9 * good.get(p, 0.0)) for p, j in edges if j == i)
            belief[i] = 1.0 if i in seeds else 1 - math.exp(doubt)
    assert got == sorted(good)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"some words here {rng} contact: user{i}@mail.org and more") for i, rng in enumerate("abcdefgh")]
    rows += [(20, "please contact: badge-77412x today"), (21, "the value badge-77412x stays"), (22, "number code-99231z here"), (30, None), (31, ""), (None, "é contact: a.b@c.de")]
    rows += [(40 + i, "the contact of words and contact: nobody") for i in range(3)]
    docs = spark.createDataFrame([(i, x, "t", "u") for i, x in rows], "doc_id long, text string, spans string, base string")
    patterns = op05_pii.bootstrap(docs)
    assert "contact:" in patterns and "number" not in patterns and "value" not in patterns
    got = {r["doc_id"]: r for r in op05_pii.extract(docs, patterns).collect()}
    assert got[20]["spans"] == "id:16:28" and got[20]["base"] == "" and got[22]["spans"] == ""
    assert got[None]["spans"] == got[None]["base"] == "email:11:19" and got[30]["spans"] == "" and len(got) == len(rows)
    assert {r["doc_id"]: r["text"] for r in op05_pii.mask(docs, patterns).collect()}[20] == "please contact: <ID> today"
    assert op05_pii.bootstrap(docs.limit(0)) == [] and op05_pii.extract(docs.limit(0), []).count() == 0
    # Repeated rows count each time: all words double, and so do the patterns' occurrences and instances.
    assert op05_pii.bootstrap(docs.union(docs)) == patterns


def test_patterns_beyond_one_part_are_kept(spark, monkeypatch):
    rows = [(i, f"some {x} contact: user{i}@mail.org ends {x} mailto: own{i}@mail.org", "u") for i, x in enumerate("abcdefgh")]
    rows += [(20, "our contact: badge-77412x today mailto: room-5512y", "u"), (21, None, "u"), (22, "no badge-77412x", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = op05_pii.bootstrap(docs)
    told = {r["doc_id"]: r["spans"] for r in op05_pii.extract(docs, want).collect()}
    assert {"contact:", "mailto:"} <= set(want) and told[20] == "id:13:25,id:40:50"
    monkeypatch.setattr(op05_pii, "PATTERNS", 1)
    monkeypatch.setattr(op05_pii, "ACCEPTED", 1)
    assert op05_pii.bootstrap(docs) == want
    assert {r["doc_id"]: r["spans"] for r in op05_pii.extract(docs, want).collect()} == told
    out = op05_pii.mask(docs, want)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()}[20] == "our contact: <ID> today mailto: <ID>"


def test_masks_cover_overlaps():
    assert op05_pii.masked("ab 12 cd", [(3, 1, 5), (4, 2, 6)]) == "ab <IP>cd"


def model():
    words = "stupid idiot clown the and house green loser total words trash please letter bottle".split() * 50
    grams = Counter()
    for w in words:
        w = op06_toxicity.START * 2 + w + op06_toxicity.END
        grams.update(w[i : i + 3] for i in range(len(w) - 2))
    return dict(grams)


def test_channel_restores_disguises():
    m = op06_toxicity.CharModel(model())
    for seen, meant in (("stup1d", "stupid"), ("$tup!d", "stupid"), ("1d10t", "idiot"), ("cl0wn", "clown"), ("loooser", "loser"), ("tr@sh", "trash"), ("s.t.u.p.i.d", "stupid"), ("letter", "letter")):
        assert op06_toxicity.restore(seen, m) == meant
    assert "=stupid" in op06_toxicity.Reader(model()).features("you s t u p i d thing")


def naive_decode(units, model, gaps):
    """The likeliest reading among all, each priced as a whole."""
    start, narrow = op06_toxicity.START, min(map(len, units[1::2]), default=1) if gaps else 1
    found = []

    def go(i, a, b, cost, text):
        if i == len(units):
            found.append((cost + (model.cost(a, b, op06_toxicity.END) if b != start else 0.0), text))
            return
        ch, gap = units[i], gaps and i % 2 == 1
        if not gap:
            for x, price in [(ch, 0.0)] + [(x, op06_toxicity.SWAP) for x in op06_toxicity.LOOKS.get(ch, "")]:
                go(i + 1, b, x, cost + price + model.cost(a, b, x), text + x)
            if i and ch == units[i - 1] and ch.isalpha():
                go(i + 1, a, b, cost + op06_toxicity.STRETCH, text)
        if gap or not ch.isalnum():
            go(i + 1, a, b, cost + op06_toxicity.DROP * (1 + min(8, len(ch) - narrow) if gap else 1), text)
            if b != start:
                go(i + 1, start, start, cost + model.cost(a, b, op06_toxicity.END), text + " ")

    go(0, start, start, 0.0, "")
    best = min(c for c, _ in found)
    return best, {t.strip(" ") for c, t in found if c < best + 1e-9}


def test_decoding_is_the_likeliest_reading():
    rng, m = random.Random(12), op06_toxicity.CharModel(model())
    for _ in range(150):
        units = [rng.choice("stupidclown10!$.-") for _ in range(rng.randint(1, 7))]
        assert op06_toxicity.decode(units, m, False) in naive_decode(units, m, False)[1]
        units = [rng.choice("idotwe1!0") if i % 2 == 0 else rng.choice([" ", ".", "  ", "    "]) for i in range(2 * rng.randint(2, 4) + 1)]
        assert op06_toxicity.decode(units, m, True) in naive_decode(units, m, True)[1]
    word = "s.t.u.p.1.d" * 12
    assert op06_toxicity.restore(word, m) == op06_toxicity.decode(list(word), m, False)


def test_features_equal_naive_ones():
    read = op06_toxicity.Reader(model())
    for text in ("The stupid, house! x", "a bb ccc dddd eeeeee fffffffff", "don't re-read it's", ""):
        want = set()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for x in op06_toxicity.restore(w, read.model).split(" ") if re.search(r"(.)\1\1", w) else [w]:
                want |= {"=" + x} | {x[:k] for k in range(3, 7) if k <= len(x)}
        if "'" not in text and "-" not in text:
            assert read.features(text) == want
    some = {"=stupid", "hou"}
    assert op06_toxicity.Reader(model(), some).features("The stupid house") == some and op06_toxicity.Reader(model(), some).features("the the") == set()


def test_learning_equals_a_naive_count(spark, monkeypatch):
    monkeypatch.setattr(op06_toxicity, "SAMPLE", 120)
    rng = random.Random(14)
    words = ["w" + c + d for c in "abcdef" for d in "ghij"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) + (" zyx" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(0, "aaa zyx")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, 0)], "doc_id long, toxic int")
    grams, weights, _ = op06_toxicity.learn(docs, marks)
    at = {r["doc_id"]: r["at"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 6) as at").collect()}
    own = sorted((i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5), key=at.get)[:120]
    text = {i: x for i, x, _ in rows} | {0: min(rows[0][1], "aaa zyx")}
    toxic = {i: t for i, _, t in rows}
    read = op06_toxicity.Reader(grams).features
    n1, n0 = Counter(), Counter()
    for i in own:
        (n1 if toxic[i] else n0).update(read(text[i]))
    a, b = sum(toxic[i] for i in own), sum(1 - toxic[i] for i in own)
    odds = {f: math.log((n + 0.5) / (a + 1)) - math.log((n0[f] + 0.5) / (b + 1)) for f, n in n1.items() if n >= op06_toxicity.SUPPORT}
    assert set(weights) == {f for f, x in odds.items() if x >= op06_toxicity.ODDS} and "=zyx" in weights


def test_features_are_counted_where_they_are_read(spark, monkeypatch):
    """No row of features is exploded: they are places, and a task gives a count of each at most."""
    rng, seen = random.Random(15), {}
    words = ["w" + c + d for c in "abcdef" for d in "ghij"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(8)) + (" zyx" if i % 2 else ""), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")

    def write(df, tag, write=op06_toxicity.materialize):
        seen[tag] = write(df, tag)
        return seen[tag]

    def select(counts, n1, n0, select=op06_toxicity.select_features):
        found = seen["toxic-features"].collect()
        want = Counter((f, r["toxic"]) for r in found for f in r["f"])
        seen["counts"] = {r["feature"]: (r["n1"], r["n0"]) for r in counts.collect()} == {f: (want[f, 1], want[f, 0]) for f, _ in want}
        seen["plan"] = counts._jdf.queryExecution().executedPlan().toString()
        return select(counts, n1, n0)

    monkeypatch.setattr(op06_toxicity, "materialize", write)
    monkeypatch.setattr(op06_toxicity, "select_features", select)
    weights = op06_toxicity.learn(docs, marks)[1]
    assert seen["toxic-features"].schema["f"].dataType.simpleString() == "array<int>"
    assert seen["counts"] and "Generate" not in seen["plan"] and "=zyx" in weights


def test_words_with_all_features_are_bounded():
    read = op06_toxicity.Reader(model())
    for i in range(40):
        read.features(" ".join(f"w{chr(97 + i % 26)}{'abcdefghij'[i // 26]}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(2000)))
    assert len(read.memo) <= 32_000


def test_workers_trim_before_and_after(monkeypatch):
    from sievegrid.llm import common

    seen = []
    monkeypatch.setattr(common, "trim", lambda: seen.append("trim"))
    assert list(common.lean(lambda batches: (seen.append(b) or 2 * b for b in batches))(iter([1, 2]))) == [2, 4] and seen == ["trim", 1, 2, "trim"]


def test_spacing_is_decoded_with_the_signs():
    grams = Counter(model())
    for w in ["you", "are"] * 50:
        w = op06_toxicity.START * 2 + w + op06_toxicity.END
        grams.update(w[i : i + 3] for i in range(len(w) - 2))
    read = op06_toxicity.Reader(dict(grams)).features
    for seen in ("so i d ! o t here", "1 d 1 0 t", "i  d  i  o  t", "i\td\ti\to\tt", "i . d . i . o . t!", "y o u i d i o t", '"i d i o t" she'):
        assert "=idiot" in read(seen), seen
    assert "=stupid" in read("$ t u p 1 d") and "=you" in read("y o u i d i o t") and "=stupid" in read("s.t.u.p.i.d")
    assert "=1" not in read("1 2 3 4")


def test_long_tokens_are_read():
    read = op06_toxicity.Reader(model()).features
    for sign in ("/", ".", "_", "-", ",", "+"):
        assert {"=idiot", "=clown", "=house"} <= read(sign.join(["house"] * 12 + ["idiot", "green", "clown"])), sign
    assert "=loser" in read("l" + "o" * 90 + "ser") and {"idiot", "clown"} <= read("house" * 14 + "idiotclown")
    assert "傻瓜" in read("这是一个很长的句子" * 9 + "傻瓜") and "傻瓜" in read("你是傻瓜。再见")


def test_trigrams_of_long_words_are_counted(spark):
    docs = spark.createDataFrame([("a" + "bc" * 60 + "xyz",), ("the/end-of/time",)], "text string")
    got = {r["gram"]: r["n"] for r in op06_toxicity.trigrams(docs).collect()}
    assert got["xyz"] == got["im" + "e"] == 1 and got["bcb"] == 59 and got["yz" + op06_toxicity.END] == 1


def test_rare_features_and_trigrams_stay(spark):
    counts = spark.range(210_000).selectExpr("concat('w', id) as feature", "10L as n1", "1000L as n0").unionByName(spark.createDataFrame([("rare", 4, 0)], "feature string, n1 long, n0 long"))
    assert op06_toxicity.select_features(counts, 1000, 100_000) == ["rare"]
    assert len(op06_toxicity.select_features(counts.where("n1 = 10").selectExpr("feature", "n1", "0L as n0"), 1000, 100_000)) == 210_000
    letters = [chr(0x4E00 + i) for i in range(700)]
    docs = spark.range(700).selectExpr("id").rdd.map(lambda r: (" ".join("".join((letters[r[0]], letters[j], letters[(r[0] * 31 + j) % 700])) for j in range(450)),)).toDF("text string")
    assert sum(g[0] not in "\x02" and g[2] != "\x03" for g in op06_toxicity.char_model(docs)) == 700 * 450


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    calm, bad = "the and house green total words please letter bottle".split(), ["stupid", "idiot", "clown", "loser", "trash"]
    disguise = lambda w: w.replace("i", "1").replace("o", "0").replace("a", "@")
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(30)]
        if toxic := i % 4 == 0:
            w = rng.choice(bad)
            words.insert(rng.randrange(30), disguise(w) if rng.random() < 0.3 else w)
        rows.append((i, " ".join(words), "en", "x", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "x", 1), (1001, "", "en", "x", 1), (None, "the stupid house", "en", "x", 1), (1002, "a" * 300_000, "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long")
    marks = spark.createDataFrame(labels + [(5000, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = op06_toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    clash = docs.withColumnRenamed("lang", "held_out").withColumnRenamed("source", "predicted")
    assert sorted(map(repr, op06_toxicity.score_toxicity(clash, marks).collect())) == sorted(map(repr, got)) and op06_toxicity.drop_toxic(clash, marks).columns == clash.columns
    kept = {r["doc_id"] for r in op06_toxicity.drop_toxic(docs, marks).collect()}
    assert {1000, 1001, 1002} <= kept and None not in kept
    assert op06_toxicity.score_toxicity(docs.limit(0), marks).count() == 0
    assert {r["predicted"] for r in op06_toxicity.score_toxicity(docs, marks.limit(0)).collect()} == {0}


TURNS = "conv_id long, turn long, role string, text string, formatted string, c int"


def test_chats_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "%3C %25 % <s>", "[NEXT] ", " [NEXT] ", "", "<<SYS>> x <</SYS>>", "[ROLE a] [/ROLE]", "a\nb", "%%3C", "[", "<", " ", "\\", "x </s> ", None]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]%", None]), rng.choice(odd), "f", 1) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "x", "", 1), (None, None, "user", "y", "", 1), (99, 1, "assistant", "same", "", 1), (99, 1, "assistant", "same", "", 1), (98, 1, "assistant", "z" * 200_000, "", 1)]
    want = {}
    for c, t, r, x, *_ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = op09_chat.read_back(op09_chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()
    assert len(out) == len(want)
    for r in out:
        turns = [(a, x) for _, a, x in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for a, x in turns if a == "assistant")
    assert op09_chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", ["op3_line_dedup", "op9_chat_format"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from sievegrid.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(oracle_sql()[name]).select(*cols).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


@needs_tables
def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = ("email", "ip", "card", "phone")
    for r in op05_pii.op5_pii_bootstrap(spark, SF).collect():
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in spans) for i in range(4)]


@needs_tables
def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from sievegrid.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "test")
        if name != "packing":
            assert tuple(out.columns) == pipeline.COLUMNS
            held = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
            assert all(n == (len(t) if t is not None else None) for t, n in held.values())
            seen[name] = {d: t for d, (t, _) in held.items()}
        docs = out
    assert all(texts[d] == t for d, t in seen["toxicity"].items())
    assert seen["near_duplicates"].items() <= seen["line_dedup"].items()
    assert all(not op05_pii.base_spans(t or "") for t in seen["personal_data"].values())
    assert {r["doc_id"] for r in docs.collect()} == set(seen["personal_data"])


def near(a, b):
    """Whether lines are within one edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_line_dedup(rows):
    places = sorted((d, no, x) for d, x in {(d, x) for d, x in rows if d is not None} for no in range(len((x or "").split("\n"))))
    line = lambda p: (p[2] or "").split("\n")[p[1]].strip(" \t\r")
    gone, seen = set(), []
    for p in places:
        s = line(p)
        if s and any((d, no) < p[:2] and (s == t or (len(s) >= 20 and len(t) >= 20 and near(s, t))) for d, no, t in seen):
            gone.add(p)
        if s:
            seen.append((*p[:2], s))
    out = []
    for d, x in rows:
        kept = x if not x else "\n".join(y for no, y in enumerate(x.split("\n")) if (d, no, x) not in gone)
        if x is None or kept == x or kept.strip(" "):
            out.append((d, kept))
    return out


def brute_near_duplicates(rows):
    def shingles(x):
        w = re.findall("[^\x20\x09-\x0d]+", (x or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(x) for _, x in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    kept = {}
    for i, (d, x) in enumerate(rows):
        if not sets[i]:
            kept[-1 - i] = (d, x)
        elif group[i] not in kept or (d is None, d) < (kept[group[i]][0] is None, kept[group[i]][0]):
            kept[group[i]] = (d, x)
    return list(kept.values())


def test_pipeline_equals_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    from sievegrid.llm import op07_packing
    from sievegrid.llm.common import written

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        lines = [passage(rng.randint(6, 14)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            lines[0] += " stupid idiot clown"
        rows.append((i, "\n".join(lines)))
    base = passage(60)
    rows += [(100 + i, base.replace(" ", "\n" if i else " ", i)) for i in range(6)] + [(7, passage(30)), (200, rows[1][1]), (201, rows[2][1] + "\n}\n}"), (202, "}\nonly mine " + passage(8)), (203, rows[3][1].replace("a", "q", 1))]
    rows += [(300, "write to joe@mail.example.org or 10.1.2.3 and +1 (555) 010-2345, card 4111 1111 1111 1111"), (301, None), (302, ""), (303, "\n\n"), (304, " ".join(f"v{i}" for i in range(30_000)))]
    rows += [(None, passage(12)), (None, None), (400, "twice the same row " + "x y z"), (400, "twice the same row " + "x y z"), (5, passage(20))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, g int, tid int"
    spark.createDataFrame([(d, x, "en", "s", len(x) if x else 0, "k", 1, 2) for d, x in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")

    first = pipeline.toxicity(spark, docs, str(tmp_path))
    scored = op06_toxicity.score_toxicity(docs.selectExpr("struct(doc_id, text) as pair", "doc_id", "text"), marks)
    toxic = {r["doc_id"] for r in scored.collect() if r["predicted"]}
    assert len(toxic) >= 12 and kept(first) == sorted(((d, x) for d, x in rows if d not in toxic), key=key)
    second = pipeline.line_dedup(spark, first, str(tmp_path))
    assert kept(second) == sorted(brute_line_dedup(kept(first)), key=key)
    third = pipeline.near_duplicates(spark, second, str(tmp_path))
    assert kept(third) == sorted(brute_near_duplicates(kept(second)), key=key)
    fourth = pipeline.personal_data(spark, third, str(tmp_path))
    assert kept(fourth) == sorted(((d, x and op05_pii.masked(x, brute(x))) for d, x in kept(third)), key=key)
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((d, p) for d, x in kept(fourth) for p in range(-(-(len(lib.encode(x or "", add_special_tokens=False).ids) + 1) // op07_packing.CAPACITY)))
    before = written()
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in got) == want and written() > before
    assert pipeline.packing(spark, fourth.limit(0), "").count() == 0 and all(f(spark, docs.limit(0), str(tmp_path)).count() == 0 for _, f in pipeline.STAGES[:4])


@needs_tables
def test_unseeded_credentials_are_found(spark):
    """Recall and precision on credentials that were not seeds, on given tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns, texts = op05_pii.bootstrap(docs), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    added = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in op05_pii.extract(docs, patterns).collect() for x in r["spans"].split(",") if x.startswith("id:")}
    want = {(d, s, e) for d, x in texts.items() for s, e in op05_pii.others(x, op05_pii.base_spans(x)) if op05_pii._CREDENTIAL.fullmatch(x, s, e)}
    unseen = lambda rows: {(d, s, e) for d, s, e in rows if not op05_pii.seeded(texts[d][s:e])}
    found, hidden = unseen(added), unseen(want)
    assert len(hidden) > 0.5 * len(want) and len(found & hidden) >= 0.9 * len(hidden) and len(found & hidden) >= 0.9 * len(found)
