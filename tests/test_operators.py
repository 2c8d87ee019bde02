"""Operators whose semantics SQL doesn't give plainly, against small hand-written cases."""

import json
import math
import random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import diffs, parsing, views
from sievegrid.operators import candidates as cand
from sievegrid.operators import dense, fusion, lexical, metrics, runs, select, stats, worklist
from sievegrid.sources import readers, writers
from sievegrid.streaming.incremental import process_new


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_truncate_skips_what_does_not_fit(spark):
    text = "\n".join(["context", "+" + "a" * 30, "-b", "@@ 1", "--- a/x", "+c"])

    def brute(budget):
        if budget <= 0 or len(text) <= budget:
            return text
        lines = text.split("\n")
        rank = lambda x: 2 if x.startswith(("--- ", "+++ ")) else 3 if x.startswith("@@") else 4 if x[:1] in ("+", "-") else 5
        room, kept = budget, []
        for _, i in sorted((rank(x), i) for i, x in enumerate(lines)):
            if len(lines[i]) + 1 <= room:
                room -= len(lines[i]) + 1
                kept.append(i)
        return "\n".join(lines[i] for i in kept)

    for budget in (0, 8, 14, 20, 30, 45, 200):
        got = one(spark, text, lambda c, b=budget: diffs.truncate_by_priority(c, b))
        assert got == brute(budget) and (budget <= 0 or len(got) <= budget)


def test_lines_break_like_splitlines(spark):
    for text in ("a\nb\r\nc\rd", "a\x0bb\x0cc\x1cd\x85e f\n", "", "\n\n", "x"):
        assert one(spark, text, diffs.lines) == (text.splitlines() or []) or (text == "" and one(spark, text, diffs.lines) == [])


def test_time_blend_golden(spark):
    rows = [("q", 1, 6.5046587, 1, -1), ("q", 2, 5.0, 9, -8), ("q", 3, 4.9, 8, -9), ("q", 4, 4.8, 7, -7), ("q", 5, 4.134649, 0, -2)]
    got = {r["doc_id"]: r["new_score"] for r in lexical.time_rank_score(spark.createDataFrame(rows, "query_id string, doc_id int, score double, early int, late int")).collect()}
    assert got[1] == pytest.approx(0.85) and got[5] == pytest.approx(0.5 / 5 + 0.3 + 0.2 / 2)


def test_rrf_bounds_and_ties(spark):
    a = spark.createDataFrame([("q", i, float(-i), i) for i in range(1, 6)], "query_id string, doc_id int, score double, rank int")
    b = spark.createDataFrame([("q", i, float(-i), 6 - i) for i in range(1, 6)] + [("q", 9, 0.0, 6)], "query_id string, doc_id int, score double, rank int")
    got = fusion.rrf(a, b).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 7)) and all(0 < r["score"] <= 2 / 61 for r in got)
    assert got[-1]["doc_id"] == 9 and got[0]["doc_id"] == 1


def test_quantiles_by_index(spark):
    rng = random.Random(1)
    for n in (1, 19, 20, 37, 400):
        xs = [round(rng.random() * 100, 3) for _ in range(n)]
        r = stats.exclusive_p95(spark.createDataFrame([(1, x) for x in xs], "g int, v double"), "v", ["g"]).first()
        want = quantiles(xs, n=20)[18] if n >= 20 else max(xs)
        assert r["p95"] == pytest.approx(want, abs=1e-6)
        d = stats.floor_percentiles(spark.createDataFrame([(1, x) for x in xs], "g int, v double"), "v", ["g"]).first()
        assert d["p90"] == sorted(xs)[min(n - 1, int(n * 90 // 100))]


def test_mcnemar_is_exact(spark):
    for b, c in ((0, 0), (1, 0), (3, 9), (40, 61)):
        rows = [(i, 1, 0) for i in range(b)] + [(1000 + i, 0, 1) for i in range(c)] + [(9000, 1, 1)]
        df = spark.createDataFrame(rows, "query_id int, x int, y int")
        got = stats.mcnemar(df.select("query_id", F.col("x").alias("hit")), df.select("query_id", F.col("y").alias("hit"))).first()
        n, k = b + c, min(b, c)
        assert got["p_value"] == pytest.approx(1 if not n else min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), abs=1e-8)


def test_bootstrap_is_repeatable(spark):
    hits = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "query_id int, hit int")
    a, b = (stats.bootstrap_ci(hits, 300).first() for _ in range(2))
    assert a == b and a["low"] < a["mean"] < a["high"]


def test_metrics_without_hits(spark):
    ranking = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "query_id string, doc_id int, rank int")
    truth = spark.createDataFrame([("a", 2), ("b", 7), ("c", 1)], "query_id string, doc_id int")
    r = metrics.metric_table({"m": ranking}, truth, "full").first()
    assert (r["n"], r["r_at_1"], r["r_at_3"], r["mrr"]) == (3, 0.0, pytest.approx(1 / 3, abs=1e-6), pytest.approx(1 / 6, abs=1e-6))
    with pytest.raises(ValueError):
        metrics.denominator({"m": ranking}, truth, "half")


def test_resolve_positions_and_prefixes(spark):
    pool = spark.createDataFrame([("q", 1, "abc1"), ("q", 2, "abd2")], "query_id string, position int, doc_id string")
    asked = spark.createDataFrame([(1, "q", "1"), (2, "q", "#2"), (3, "q", "9"), (4, "q", "ab"), (5, "q", "ABC"), (6, "q", "abd2"), (7, "q", "zz")], "ask_id int, query_id string, part string")
    got = {r["ask_id"]: r["doc_id"] for r in cand.resolve(asked, pool).collect()}
    assert got == {1: "abc1", 2: "abd2", 3: None, 4: None, 5: "abc1", 6: "abd2", 7: None}


def test_selector_errors_are_records(spark):
    def build():
        def pick(row):
            if row["query_id"] == "bad":
                raise ValueError("no")
            return {"best_doc_id": row["candidates"][0]}

        return pick

    items = spark.createDataFrame([("ok", ["d1"]), ("bad", ["d2"])], "query_id string, candidates array<string>")
    got = {r["query_id"]: (r["best_doc_id"], r["error"]) for r in select.run_selector(items, build).collect()}
    assert got == {"ok": ("d1", None), "bad": (None, "ValueError: no")}


def test_reviewed_and_reranked(spark):
    main = spark.createDataFrame([("a", "d1", 5, 1, ["d1"]), ("b", "d2", 5, 1, ["d2"])], "query_id string, best_doc_id string, tokens_in int, tokens_out int, inspected array<string>")
    critic = spark.createDataFrame([("a", "d3", 2, 1, ["d3", "d1"])], main.schema)
    got = {r["query_id"]: r for r in select.reviewed(main, critic).collect()}
    assert got["a"]["best_doc_id"] == "d3" and got["a"]["overrode"] and got["a"]["inspected"] == ["d1", "d3"] and got["b"]["best_doc_id"] == "d2" and not got["b"]["overrode"]
    order = spark.createDataFrame([("a", ["d9", "d1"]), ("b", [])], "query_id string, ranking array<string>")
    assert {r["query_id"]: r["best_doc_id"] for r in select.reranked(main, order).collect()} == {"a": "d9", "b": "d2"}


def test_encoder_is_deterministic(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "doc_id int, text string")
    got = {r["doc_id"]: r["embedding"] for r in dense.encode_texts(rows, lambda: dense.seeded_encoder(8), prefix="q: ").collect()}
    assert got[1] == got[3] != got[2] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)


def test_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_text('cve,cve_description,owner,repo,fix_commit_ids\nC-1,"a ""b"",\nc",o,r,x1| x2 |x1|\nC-2,d,o,r,\n,d,o,r,x\n')
    got = readers.queries(spark, str(tmp_path / "q.csv")).collect()
    assert len(got) == 2 and got[1]["fix_commit_ids"] == [] and got[0]["fix_commit_ids"] == ["x1", "x2", "x1"] and got[0]["query_key"] == "o@@r::C-1" and got[0]["description"] == 'a "b",\nc'
    path = tmp_path / "o@@r" / "bm25_time" / "result"
    path.mkdir(parents=True)
    (path / "C-1.json").write_text(json.dumps({"d2": {"score": 1.5, "new_score": 0.5}, "d1": {"score": 2.5}}))
    rows = readers.score_files(spark, str(path)).orderBy("position").collect()
    assert [(r["repo_key"], r["query_id"], r["doc_id"], r["score"]) for r in rows] == [("o@@r", "C-1", "d2", 0.5), ("o@@r", "C-1", "d1", float("-inf"))]
    (tmp_path / "c.json").write_text(json.dumps([{"commit_id": "a", "author": "", "author_email": "e"}, {"commit_id": "a", "author": "z"}, {"commit_id": " "}, {"commit_id": "b", "diff": None}]))
    assert [(r["commit_id"], r["author"], r["diff"]) for r in readers.commits(spark, str(tmp_path / "c.json")).orderBy("commit_id").collect()] == [("a", "e", ""), ("b", "", "")]
    (tmp_path / "one.jsonl").write_text('{"cve_id":"a","hit":true}\nnot json\n\n{"cve_id":"b"}\n')
    (tmp_path / "two.jsonl").write_text('{"cve_id":"a","hit":false}\n{"hit":true}\n')
    got = {r["cve_id"]: r["hit"] for r in readers.jsonl_tolerant(spark, [str(tmp_path / "one.jsonl"), str(tmp_path / "two.jsonl")], "cve_id").collect()}
    assert got == {"a": False, "b": None}
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "one.jsonl")).collect()
    (tmp_path / "keys").write_text("# c\n\na\nb\na\n")
    assert sorted(r["key"] for r in readers.key_list(spark, str(tmp_path / "keys")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "p"))
        readers.pairs(spark, str(tmp_path / "p"))
    assert readers.method_spec("m:a,b") == ("m", ["a", "b"])


def test_resume_and_stream(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "cve_id string")
    out = str(tmp_path / "out")
    assert writers.remaining(items, out, "cve_id").count() == 3
    writers.append_records(spark.createDataFrame([("a", None), ("b", "timeout")], "cve_id string, error string"), out, "1")
    assert sorted(r[0] for r in writers.remaining(items, out, "cve_id").collect()) == ["b", "c"]
    assert [r[0] for r in writers.remaining(items, out, "cve_id", redo_errors=False).collect()] == ["c"]
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text(json.dumps({"cve_id": f"s{i}"}) + "\n")
        process_new(spark, str(source), "cve_id string", lambda b: b.withColumn("n", F.length("cve_id")), str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert sorted(r["cve_id"] for r in spark.read.json(str(tmp_path / "sink")).collect()) == ["s0", "s1"]


def test_parsing(spark):
    assert one(spark, "x Answer: see [4] or 7", lambda c: parsing.answer_number(parsing.after_marker(c, "Answer:"))) == 4
    assert one(spark, "[2] > [1] > [2]", parsing.listwise) == [2, 1] and one(spark, "[2] > 1", parsing.listwise_valid) is False
    assert one(spark, "o@@r@@abc", parsing.last_segment) == "abc" and one(spark, "Maybe", parsing.tri_state) is None and one(spark, "x", parsing.number_or_zero) == 0.0
    assert one(spark, "Maximum context length exceeded", runs.context_overflow) is True


def test_file_tags_golden(spark):
    golden = {
        "setup.py": "config", "docs/x.py": "doc", "a/doc/x.c": "doc", "documentation/a.c": "doc", "x/documentation/a.c": "source", "pkg/a_test.go": "test", "a_test.rs": "source", "tests/a.bin": "test", "a/testing/x": "test",
        "spec/a.rb": "source", "a.spec.ts": "test", "lib/README": "doc", "CMakeLists.txt": "doc", "Makefile": "config", "MAKEFILE": "other", "a/b.YML": "config", "x.json": "other", "package.json": "config", "a.tsx": "source", "q.sql": "source", "page.html": "other", "noext": "other",
    }
    rows = spark.createDataFrame(list(golden.items()), "path string, want string")
    got = rows.select("path", "want", diffs.file_tag(F.col("path"), F.lit(False)).alias("tag"), diffs.file_tag(F.col("path"), F.lit(True)).alias("binary")).collect()
    assert {r["path"]: r["tag"] for r in got} == golden and {r["binary"] for r in got} == {"fixture"}


def changed_file(path, n, extra=()):
    return "\n".join([f"diff --git a/{path} b/{path}", "index 1..2", f"--- a/{path}", f"+++ b/{path}", "@@ -1 +1 @@", " same", *(f"+line {i}" for i in range(n)), *extra])


def test_files_are_read_once_and_ranked_only_where_asked(spark):
    assert str(diffs.lines(F.col("x"))).count("split(") == 1
    from sievegrid.plans.suite import SUITE

    for name in ("classify_files", "file_tag_counts", "render_file", "compress_block", "candidate_manifest"):
        plan = SUITE[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert diffs.WORD not in plan, name
    files = diffs.tagged(diffs.file_changes(F.lit("diff --git a/x b/x.py\n+a\ndiff --git a/t b/tests/t.py\n-b")))
    assert [(f["path"], f["tag"]) for f in spark.range(1).select(files.alias("f")).first()["f"]] == [("x.py", "source"), ("tests/t.py", "test")]


def test_commit_views_golden(spark):
    diff = "\n".join([
        "not yet a file", changed_file("src/net_filter.c", 501), changed_file("docs/a.md", 1), "diff --git a/x.bin b/x.bin\nBinary files a/x.bin and b/x.bin differ", "diff --git a/o.c b/n.c\nold mode 100644\nnew mode 100755\nsimilarity index 90%\nrename from o.c\nrename to n.c\nGIT binary patch\n+++x\n---x",
        *(changed_file(f"f{i}.py", 1) for i in range(49)),
    ])
    df = spark.createDataFrame([(diff, "the filter fails in filter_net and net_filter")], "diff string, words string")
    row = df.select(diffs.by_priority(diffs.classified(diffs.file_changes(F.col("diff")), F.col("words"))).alias("f"))
    row = row.select("f", diffs.file_manifest(F.col("f")).alias("manifest"), diffs.render_commit(F.lit(" fix\n"), F.col("f"), 900).alias("view"), F.transform("f", lambda f: diffs.render_file(f, 400)).alias("single"), F.transform("f", lambda f: diffs.compress_block(f["raw"], 10_000)).alias("small")).first()
    by_path = {f["path"]: f for f in row["f"]}
    assert len(by_path) == 53 and row["f"][0]["path"] == "src/net_filter.c" and by_path["src/net_filter.c"]["priority"] == 100 + 20 - 10 + 15
    assert by_path["n.c"]["adds"] == by_path["n.c"]["dels"] == 0 and not by_path["n.c"]["is_binary"] and by_path["x.bin"]["is_binary"]
    small = dict(zip([f["path"] for f in row["f"]], row["small"], strict=True))
    assert small["n.c"].split("\n") == ["diff --git a/o.c b/n.c", "old mode 100644", "new mode 100755", "similarity index 90%", "rename from o.c", "rename to n.c"]
    lines = row["manifest"].split("\n")
    assert lines[0] == "[Files changed: 53 — 51 source, 1 doc, 1 fixture; showing top-50 by relevance]" and len(lines) == 52
    assert lines[1] == f"  {'src/net_filter.c':<60}  {'source':<8}  +501/-0" and lines[-1].startswith("  [+ 3 more files not shown — typically")
    view = row["view"].split("\n")
    assert view[0] == "MSG: fix" and "[Diff content, budget 900 chars]" in view and "--- src/net_filter.c ---" in view and "... [middle truncated] ..." in view
    assert view[-1].startswith("[Files truncated — call read_file_diff to inspect: src/net_filter.c, ") and view[-1].endswith(" (+47 more)]") and "[Binary files skipped: 1 (no content shown)]" in view
    single = dict(zip([f["path"] for f in row["f"]], row["single"], strict=True))
    assert single["x.bin"] == "--- x.bin ---\n[Binary file, no diff content. adds=0 dels=0]" and single["docs/a.md"] == "--- docs/a.md ---\n" + changed_file("docs/a.md", 1)
    assert single["src/net_filter.c"].endswith(f"[... src/net_filter.c: original {len(by_path['src/net_filter.c']['raw'])} chars, compressed to fit budget]")
    empty = spark.createDataFrame([(None,), ("",), ("no file",)], "diff string").select(diffs.file_changes(F.col("diff")).alias("f")).collect()
    assert [r["f"] for r in empty] == [[], [], []]


def test_commit_text_golden(spark):
    text = lambda m, d, n: spark.createDataFrame([(m, d)], "m string, d string").select(diffs.commit_text(F.col("m"), F.col("d"), n)).first()[0]
    assert text("fix", "+a", 0) == "Commit message:\nfix\n\nDiff:\n+a" and text("fix", None, 10) == "Commit message:\nfix\n\nDiff:"
    assert text("m", " c\n+a\n@@ 1\n--- a/x", 14) == "Commit message:\nm\n\nDiff:\n--- a/x\n@@ 1"


def test_path_match_golden(spark):
    files = spark.createDataFrame([(1, 1, "src/my_utils.py"), (1, 2, "src/File.py"), (1, 3, "a/b.c")], "doc_id int, position int, path string")
    asked = spark.createDataFrame([(1, 1, "utils.py"), (2, 1, "file.py"), (3, 1, "A/B.c"), (4, 1, "a/b.c"), (5, 1, "zzz"), (6, 1, "other/File.py")], "ask_id int, doc_id int, asked string")
    got = {r["ask_id"]: (r["path"], r["tier"]) for r in cand.match_path(asked, files).collect()}
    assert got == {1: ("src/my_utils.py", 3), 3: ("a/b.c", 2), 4: ("a/b.c", 1), 6: ("src/File.py", 3)}


def test_asked_paths_never_meet_all_files(spark):
    files = spark.createDataFrame([(1, i + 1, f"src/{'A' if i % 2 else 'b'}/File{i % 3}.py") for i in range(60)] + [(2, 1, "x")], "doc_id long, position int, path string")
    asked = spark.createDataFrame([(1, 1, "src/A/File0.py"), (2, 1, "SRC/b/file1.py"), (3, 1, "le2.py"), (4, 1, "dir/"), (5, 2, "File0.py"), (6, 3, "x"), (7, 1, "le2.py")], "ask_id long, doc_id long, asked string")
    found = cand.match_path(asked, files)
    assert {r["ask_id"]: (r["path"], r["tier"]) for r in found.collect()} == {1: ("src/A/File0.py", 1), 2: ("src/b/File1.py", 2), 3: ("src/b/File2.py", 3), 4: ("src/b/File0.py", 3), 7: ("src/b/File2.py", 3)}
    assert "EndsWith" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_manifest_ranks_of_five_places(spark):
    rows = spark.createDataFrame([("q", 12345, "c", "m", None)], "query_id string, rank int, doc_id string, message string, files array<struct<tag:string>>")
    assert "  #12345  c  [" in cand.manifest(rows).first()["manifest"]
    assert "  #1234  c  [" in cand.manifest(rows, places=4).first()["manifest"]


def test_review_pool_golden(spark):
    ranking = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 8)], "query_id string, doc_id string, rank int")
    pick = spark.createDataFrame([("q", "d4")], "query_id string, doc_id string")
    seen = spark.createDataFrame([("q", "d7", 1), ("q", "d2", 2), ("q", "zz", 3)], "query_id string, doc_id string, at int")
    pool = lambda p, s, n: [r["doc_id"] for r in cand.review_pool(ranking, p, s, n).orderBy("new_rank").collect()]
    assert pool(pick, seen.limit(0), 0) == ["d4"] and pool(pick, seen, 0) == ["d4", "d7"] and pool(pick.limit(0), seen, 0) == ["d7"]
    assert pool(pick, seen, 1) == ["d4", "d7"] and pool(pick, seen, 2) == ["d2", "d4", "d7"] and pool(pick.limit(0), seen.limit(0), 2) == ["d1", "d2", "d3"]


def test_compose_golden(spark):
    df = spark.createDataFrame([("b", ["a", "b"], ["c", "a", "d"]), (None, ["a"], ["c", "a"]), ("", None, ["c"])], "best string, seen array<string>, r array<string>")
    got = df.select(cand.compose(F.col("best"), F.col("seen"), F.col("r"), 3).alias("x"), cand.compose(F.col("best"), F.col("seen"), None, None).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == [(["b", "a", "c"], ["b", "a"]), (["a", "c"], ["a"]), (["c"], [])]


def test_traces_stops_and_errors_golden(spark):
    calls = spark.createDataFrame([("i", 1, "read", "a"), ("i", 2, "submit", "b"), ("i", 3, "read", "c")], "item string, turn int, tool string, doc_id string")
    r = select.replay(calls).first()
    assert (r["inspected"], r["answer"], r["n_calls"]) == (["a", "b"], "b", 2)
    told = {"litellm.ContextWindowExceededError: x": True, "Maximum Context Length is 1": True, "context length": False, None: False}
    got = spark.createDataFrame([(k,) for k in told], "e string").select("e", runs.context_overflow(F.col("e")).alias("x")).collect()
    assert {r["e"]: r["x"] for r in got} == told
    assert [one(spark, x, parsing.tri_state) for x in ("True", "False", "true", "1", "yes")] == [True, False, None, None, None]


def test_show_text_golden(spark):
    whole = "commit a\nAuthor: A <a@b>\nDate:   now\n\n    says diff --git a/x b/x\n\ndiff --git a/f b/f\n+Author: Z"
    got = lambda t: [one(spark, t, f) for f in (parsing.show_author, parsing.show_date, parsing.show_diff)]
    assert got(whole) == ["A <a@b>", "now", "diff --git a/f b/f\n+Author: Z"]
    assert got("commit a\nAuthor: A\n\n    merge") == ["A", "", ""] and got("diff --git a/f b/f\n+Author: Z") == ["", "", "diff --git a/f b/f\n+Author: Z"]


def test_seeded_vectors_are_exact():
    import hashlib

    import numpy as np

    for text in ("", "abc", "é"):
        v = np.random.default_rng(int(hashlib.md5(text.encode()).hexdigest(), 16) % (2**32)).standard_normal(16).astype(np.float32)
        assert (dense.seeded_vector(text, 16) == v / np.linalg.norm(v)).all()


def test_dense_leaves_out_bad_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [1.0], "a"), (4, [None, 1.0], "a"), (5, [0.5, 0.5], "a"), (6, [1.0, 1.0], "b"), (7, [1.0, 1.0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>, repo string")
    asked = docs.where("doc_id in (1, 2)").withColumnRenamed("doc_id", "query_id")
    assert [r["doc_id"] for r in dense.dense_topk(docs, asked, 5).orderBy("rank").collect()] == [6, 7, 5]
    assert [r["doc_id"] for r in dense.dense_topk(docs, asked, 5, by="repo").collect()] == [5]


def test_bm25_in_parts_and_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Über w{i % 3} w{i % 5} common", "ab"[i % 2]) for i in range(40)] + [(90, None, "a"), (91, "", "b"), (92, "w1", None)], "doc_id long, text string, repo string")
    asked = spark.createDataFrame([(i, f"w{i} über common", "ab"[i % 2]) for i in range(5)] + [(9, "nothing", "a"), (10, None, "a")], "query_id long, text string, repo string")
    rows = lambda by: sorted(map(tuple, lexical.bm25(docs, asked, 7, by=by).collect()))
    whole, grouped = rows(None), rows("repo")
    assert len(whole) == 35 and {r[0] for r in grouped} == set(range(5))
    alone = [sorted(map(tuple, lexical.bm25(docs.where(F.col("repo") == g), asked.where(F.col("repo") == g), 7).collect())) for g in "ab"]
    assert grouped == sorted(alone[0] + alone[1])
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    monkeypatch.setattr(lexical, "GRID", 9)
    assert rows(None) == whole and rows("repo") == grouped


def test_work_lists(spark):
    items = spark.createDataFrame([(f"k{i}",) for i in range(30)], "k string")
    done = spark.createDataFrame([("k1", None), ("k2", "failed")], "k string, error string")
    with pytest.raises(ValueError):
        worklist.chosen(items, "k", first=1, sample=1)
    sample = sorted(r["k"] for r in worklist.chosen(items, "k", sample=9, seed=4).collect())
    assert len(sample) == 9 and sample == sorted(r["k"] for r in worklist.chosen(items.orderBy(F.desc("k")), "k", sample=9, seed=4).collect())
    left = {r["k"] for r in worklist.remaining_of(items, done, "k", sample=9, seed=4).collect()}
    assert left == set(sample) - {"k1"}
    with pytest.raises(FileNotFoundError):
        worklist.require(items, done, "k")
    assert worklist.progress(items.limit(0), done, "k").first()["percent"] == 100.0


def test_method_files_and_records(spark, tmp_path):
    for name in ("b.jsonl", "a.jsonl", "c.txt"):
        (tmp_path / name).write_text('{"input": {"cve": "q", "commit_id": "%s", "label": 1}, "output": {"answer": true, "confidence": 3}}\n\nbad\n' % name[0])
    name, paths = readers.method_files(spark, f" Pairs :{tmp_path}/*.jsonl,{tmp_path}/c.txt", ("pairs",))
    assert name == "pairs" and [p.rsplit("/", 1)[1] for p in paths] == ["a.jsonl", "b.jsonl", "c.txt"]
    assert sorted(r["doc_id"] for r in readers.per_pair(spark, paths).collect()) == ["a", "b", "c"]
    with pytest.raises(FileNotFoundError):
        readers.method_files(spark, f"m:{tmp_path}/*.none")
    with pytest.raises(ValueError):
        readers.method_files(spark, "m:x", ("pairs",))
    rows = spark.createDataFrame([("q", 3, None)], "cve_id string, iterations_used int, error string")
    assert readers.result_of(readers.result_json(rows)).select("cve_id", "iterations_used", "error").collect() == rows.collect()


def test_errors_shown_golden(spark):
    df = spark.createDataFrame([("#3",), ("12",), ("abc",)], "a string")
    got = [r[0] for r in df.select(views.not_found(F.col("a"), F.lit(10))).collect()]
    assert got[0] == "[Error] Could not interpret '#3'. To read rank 3, pass the SHA from list_candidates."
    assert got[1].startswith("[Error] '12' looks like a rank number, but 10 candidates available and 12 is out of range.") and got[2].startswith("[Error] commit_id 'abc' not found in the Top-10 candidate list.")
    assert one(spark, "0123456789abcdef", views.after_submission).startswith("[Error] You have already submitted your answer (0123456789ab). The task")


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, "a " * (1 + i * 37 % 50) + "b " * (i % 7)) for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "b a"), (3, "zz")], "query_id long, text string")
    whole = sorted(map(tuple, lexical.bm25(docs, items, None).where("rank <= 5").collect()))
    spark.conf.unset(name)
    for run in (lambda: lexical.bm25(docs, items, 5), lambda: lexical.containing(docs, items), lambda: dense.encode_texts(docs, lambda: dense.seeded_encoder(4))):
        run()
        assert spark.conf.get(name) == "2000"
        spark.conf.unset(name)
    monkeypatch.setattr(lexical, "GRID", 60)
    assert sorted(map(tuple, lexical.bm25(docs, items, 5).collect())) == whole
