"""Byte-level BPE, token counts, and packing against the libraries themselves."""

import base64
import hashlib
import os
import random
import struct
import zlib
from collections import defaultdict

import pytest

P = pytest.importorskip("public_tokenizers")
from sievegrid.llm import op04_bpe, op07_packing, op08_token_counts  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "   ", "a", "\n\n x\t y ", "é漢字 1二３ don't we'll", "\x1c\x1d a\x85b c", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y", "a" * 5000, " " * 5000, "ﬁ İ ẞ", "😀👍🏽 ok", "'s's 't"]


def texts(n, seed):
    rng, al = random.Random(seed), [*"ab'sdtLl  \n\t\x1c\x85é漢 1二.,-_\rİ", "<|endoftext|>", " the"]
    return ODD + ["".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def long_texts():
    """Tens of thousands of characters, mixed, without white space, and of one pre-token."""
    rng = random.Random(12)
    return [" ".join(rng.choice(["the", "étude", "漢字", "x1", "don't", "\n"]) for _ in range(12_000)), "".join(rng.choice("abc1é-") for _ in range(30_000)), "z" * 20_000]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "k", 1) for i, x in rows], "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="module")
def rank_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_rank_library(rank_library):
    c = op04_bpe.codec(RANKS, P.PATTERN)
    for x in texts(3000, 1):
        ids = c.encode_batch([x])[0]
        assert ids == struct.pack(f"<{len(ids) // 4}I", *rank_library.encode_ordinary(x)), x
        assert c.decode(ids) == x.encode()


def test_whole_tokens_win_over_merges():
    # "ab" is a token, but no merge leads to "abc" through it: the whole pre-token still takes its own id.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    assert op04_bpe.Codec(ranks, P.PATTERN).encode_batch(["abc abcd"])[0] == struct.pack("<6I", 256, 32, 97, 98, 99, 100)


def test_encode_and_decode_frames(spark, rank_library):
    rows = [*enumerate(texts(50, 2)), (7, "again"), (7, "again"), (None, "x"), (99, None), *enumerate(long_texts(), 200)]
    out = op04_bpe.decode(op04_bpe.encode(frame(spark, rows), RANKS, P.PATTERN), RANKS, P.PATTERN)
    got = sorted((repr(r["doc_id"]), r["n_tokens"], bytes(r["decoded"])) for r in out.collect())
    assert got == sorted((repr(i), len(rank_library.encode_ordinary(x or "")), (x or "").encode()) for i, x in rows)
    assert op04_bpe.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_counts_equal_the_library(spark, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    lib = op08_token_counts.library(path)
    rows = [*enumerate(texts(300, 3)), (7, "again"), (7, "again"), (None, "x y"), (999, None), *enumerate(long_texts(), 2000)]
    want = sorted((repr(i), len((x or "").encode()), n := len(lib.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in rows)
    for common in (100_000, 3):  # with 3, nearly all goes through the join
        monkeypatch.setattr(op08_token_counts, "COMMON", common)
        got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op08_token_counts.token_counts(frame(spark, rows), path, P.PATTERN).collect())
        assert got == want
    assert op08_token_counts.token_counts(frame(spark, []), path, P.PATTERN).count() == 0


def check_packing(rows, want, capacity):
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_words_that_go_to_the_model_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), op07_packing.WordIds(path), random.Random(5)
    rows = ["It's HE'LL 'Sx x''t 12.5% a_b--c $$$ </w> don't," + "".join(map(chr, range(128))), "\u0130 \u212a \u00c9a x\u0301 \u4e00 " + "x ".join(map(chr, range(128, 600))) + " " + "".join(map(chr, range(192, 256))), *own.strings, *(x.upper() + "x" for x in own.strings)]
    rows += ["".join(rng.choice("abIZ'stlLdmre.,<>|/w09 \x00\x7f\u00e9\u00df\u00c5\u00d7\u00b2\u4e00") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    asked = []
    own.library = type("Counting", (), {"encode": lambda self, x, **k: (asked.extend(x.split()), library.encode(x, **k))[1]})()
    for x, ids in zip(rows, own.encode_batch(rows), strict=True):
        want = library.encode(x, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), x
    assert own.direct and "\u4e00" in "".join(asked) and not any(op07_packing._PLAIN.fullmatch(x) and x.isalpha() for x in asked)


def test_plain_texts_are_cut_together_and_each_pre_token_goes_to_the_model_once(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), op07_packing.WordIds(path), random.Random(6)
    monkeypatch.setattr(op07_packing, "_AT_ONCE", 500, raising=False)
    kinds = "'stlmdrev x", "aB'sTlL re.,<>|/09 \t\n\r\x0b\x0c\u00c9\u00df\u00de", "It's  HE'LL 1,234.5"
    plain = [*("".join(rng.choice(k) for _ in range(rng.randint(0, 90))) for k in kinds for _ in range(700)), "", " \n", None, "'", "x'", "'r", "'re", "'S'", "a'll'd''m"]
    other = ["<|startoftext|> a", "a <|ENDOFTEXT|>", "x\u00a0'y\x85z", "\u201cit's\u201d \u4e00", "a\x1cb x\u0301", "\u00aa\u00d7\u00b2 \u0130"]
    asked, tokenize = [], own.model.tokenize
    own.model = type("Counting", (), {"tokenize": lambda self, x: (asked.append(x), tokenize(x))[1]})()
    by_word, own._words = own._words, None
    for rows in (plain, [x for i, p in enumerate(plain) for x in (p, *other[i % 50 : i % 50 + 1])]):
        for x, ids in zip(rows, own.encode_batch(rows), strict=True):
            want = library.encode(x or "", add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(want)}I", *want), x
        assert len(asked) == len(set(asked)) > 500
        own._words = by_word


def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [*enumerate(texts(200, 4)), (900, None), (901, "word " * 9000), (902, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(4096)))]
    want = {}
    for i, x in rows:
        ids = [*lib.encode(x or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[i, p // 4096] = p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    out = op07_packing.pack_documents(frame(spark, rows), path)
    n = check_packing(out.collect(), want, 4096)
    assert n == -(-sum(v[1] for v in want.values()) // 4096)
    assert op07_packing.pack_documents(frame(spark, []), path).count() == 0


def test_packing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(op07_packing, "BLOCK", 60)
    rng = random.Random(6)
    sizes = [rng.choice([100, 37, 64, 91, 5]) if i % 9 else 100 for i in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    rows = op07_packing.pack(df, 100).collect()
    assert sorted(r["uid"] for r in rows) == list(range(500))
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += sizes[r["uid"]]
    assert max(fill.values()) <= 100
    greedy = op07_packing.best_fit(sorted(range(500), key=lambda i: -sizes[i]), sizes, 100)
    assert len(fill) <= 1.03 * len(greedy) + 1


def test_every_run_breeds_and_migrates(spark, monkeypatch):
    monkeypatch.setattr(op07_packing, "BLOCK", 100)
    rng = random.Random(8)
    easy = [rng.randint(1, 40) for _ in range(300)]
    report = []
    op07_packing.pack(spark.createDataFrame(list(enumerate(easy)), "uid long, length long"), 100, report=report).collect()
    assert {r["epoch"] for r in report} == {0, 1} and all(r["least_born"] >= op07_packing.POPULATION for r in report)
    assert all(r["came"] == (r["islands"] if r["epoch"] else 0) for r in report)


def triples():
    """Sizes that fill 40 bins of 1,000 exactly, which best fit decreasing misses."""
    rng, sizes = random.Random(9), []
    for _ in range(40):
        a = rng.randint(380, 490)
        b = rng.randint(251, 1000 - a - 251)
        sizes += [a, b, 1000 - a - b]
    return sizes


def test_packing_a_table_beats_best_fit(spark, monkeypatch):
    monkeypatch.setattr(op07_packing, "EPOCHS", 6)
    sizes = triples()
    greedy = len(op07_packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000))
    report = []
    rows = op07_packing.pack(spark.createDataFrame(list(enumerate(sizes)), "uid long, length long"), 1000, report=report).collect()
    assert sorted(r["uid"] for r in rows) == list(range(len(sizes))) and len({r["sequence_id"] for r in rows}) < greedy
    assert all(r["least_born"] >= op07_packing.POPULATION for r in report) and max(r["came"] for r in report) > 0


def test_evolution_beats_best_fit():
    sizes = triples()
    greedy = len(op07_packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000))
    elites, born = [], []
    for _ in range(6):
        elites = [op07_packing.evolve(sizes, 1000, seed, elites, born) for seed in (1, 2)]
    assert greedy > 40 and min(map(len, elites)) < greedy and sum(born) > 12


def test_crossover_keeps_every_item_once():
    rng = random.Random(7)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    one, other = (op07_packing.best_fit(rng.sample(range(200), 200), sizes, 100) for _ in range(2))
    for _ in range(20):
        child = op07_packing.crossover(one, other, sizes, 100, rng)
        assert sorted(i for g in child for i in g) == list(range(200)) and all(sum(sizes[i] for i in g) <= 100 for g in child)
        one, other = other, child
    assert len(op07_packing.evolve(sizes, 100, 1, [])) <= len(op07_packing.best_fit(sorted(range(200), key=lambda i: -sizes[i]), sizes, 100))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_bpe_query(spark, rank_library):
    sf = "/root/testdata/sf0.001"
    texts_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op04_bpe.op4_bpe_roundtrip(spark, sf).collect():
        ids = rank_library.encode_ordinary(texts_of[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts_of[r["doc_id"]] or "").encode()).hexdigest()


def test_packing_rows_that_share_ids_or_have_none(spark):
    path = P.path("word_bpe_49k.json")
    rows = [(5, "one two"), (5, "one two"), (5, "three"), (None, "four"), (None, None), (6, "five " * 5000)]
    got = op07_packing.pack_documents(frame(spark, rows), path).collect()
    pieces = sorted((repr(r["doc_id"]), r["piece"], r["length"]) for r in got)
    assert [p[:2] for p in pieces] == [("5", 0)] * 3 + [("6", 0), ("6", 1), ("None", 0), ("None", 0)]
    places = sorted((r["sequence_id"], r["offset"], r["offset"] + r["length"]) for r in got)
    assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(places, places[1:], strict=False)) and all(p[2] <= 4096 for p in places)


def test_workers_forget_when_idle(monkeypatch):
    import time

    from sievegrid.llm import common

    monkeypatch.setattr(common, "IDLE", 0.1)
    made = []
    make = lambda: made.append(1) or len(made)
    assert [common.held("t", 1, make), common.held("t", 1, make), common.held("t", 2, make), common.held("t", 1, make)] == [1, 1, 2, 3]
    time.sleep(0.5)
    assert not common._HELD and common.held("t", 1, make) == 4
    time.sleep(0.5)
