"""Stores, indexes and encode jobs that outlive a call; shards, records, reviews, and asks that models make."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import diffs, parsing
from sievegrid.operators import candidates as cand
from sievegrid.operators import dense, index, lexical, metrics, runs, select
from sievegrid.sources import readers, store, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def split_repo(root, name, *files):
    folder = root / f"split_{name}"
    folder.mkdir(parents=True)
    for i, rows in enumerate(files):
        (folder / f"{i}.json").write_text(rows if isinstance(rows, str) else json.dumps(rows))


def test_forks_keep_their_own_commits(spark, tmp_path):
    split_repo(tmp_path, "o@@a", [{"commit_id": "c1", "diff": "first"}, {"commit_id": "c1", "diff": "again"}, {"commit_id": " c2 ", "author": "", "author_email": "x@y"}], "not json", [{"commit_id": "c1", "diff": "third"}, {"commit_id": " "}])
    split_repo(tmp_path, "p@@a", [{"commit_id": "c1", "diff": "fork"}])
    split_repo(tmp_path, "12", [{"commit_id": "c9", "diff": "z"}])
    rows = readers.commits(spark, str(tmp_path / "split_*" / "*.json"))
    assert sorted((r["repo_key"], r["commit_id"], r["diff"]) for r in rows.collect()) == [("12", "c9", "z"), ("o@@a", "c1", "first"), ("o@@a", "c2", ""), ("p@@a", "c1", "fork")]
    path = str(tmp_path / "store")
    store.write_commits(rows, path)
    ids = spark.createDataFrame([("o@@a", "c1"), ("p@@a", "c1"), ("p@@a", "c2"), ("12", "c1"), (None, "c1"), ("o@@a", None), ("o@@a", "c1")], "repo_key string, commit_id string")
    found = store.content_of(store.commit_store(spark, path), ids)
    assert sorted((r["repo_key"], r["commit_id"], r["diff"]) for r in found.collect()) == [("o@@a", "c1", "first"), ("p@@a", "c1", "fork")]
    # A repository that is written again replaces itself, and no other.
    store.write_commits(rows.where("repo_key = 'o@@a' and commit_id = 'c2'"), path)
    assert sorted((r["repo_key"], r["commit_id"]) for r in store.commit_store(spark, path).collect()) == [("12", "c9"), ("o@@a", "c2"), ("p@@a", "c1")]


def test_content_reads_the_asked_repositories_only(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("commit_id"), F.repeat(F.lit("m"), 30).alias("commit_msg"), F.repeat(F.lit("d"), 300).alias("diff"), F.lit("").alias("datetime"), F.lit("").alias("author"), F.lit(None).cast("timestamp").alias("ts"), F.concat(F.lit("r"), F.col("id") % 20).alias("repo_key"))
    store.write_commits(rows, path)
    ids = rows.where("repo_key = 'r3'").select("repo_key", "commit_id")
    ids.write.parquet(str(tmp_path / "ids"))
    found = store.content_of(store.commit_store(spark, path), spark.read.parquet(str(tmp_path / "ids")))
    assert "dynamicpruning" in plan(found).lower() and found.count() == 200


def test_pair_table_labels_and_gaps(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_commits(spark.createDataFrame([("c1", "m", "d", "", "", None, "o@@r")], store.COMMITS), path)
    items = spark.createDataFrame([("q", None, "o", "r", ["c1"])], "query_id string, description string, owner string, repo string, fix_commit_ids array<string>")
    ranks = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2), ("q", "c3", 3)], "query_id string, doc_id string, rank int")
    got = store.pair_table(items, ranks, store.commit_store(spark, path), 2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("q", "", "o/r", "c1", "m", "d", 1, 1), ("q", "", "o/r", "c2", "", "", 0, 2)]


DOCS = "doc_id long, repo_key string, text string"


def test_index_counts_terms_where_texts_are_read(spark, tmp_path, monkeypatch):
    plans, write = {}, index.write_by_repo
    monkeypatch.setattr(index, "write_by_repo", lambda rows, path, *a: (plans.update({path.rsplit("/", 1)[1]: plan(rows)}), write(rows, path, *a)))
    path = str(tmp_path / "index")
    index.add(spark.createDataFrame([(1, "a", "x y X  y x z"), (2, "a", ""), (3, "a", None), (4, "b", "z")], DOCS), path, "one")
    # Postings move once, to be written; before, tokenised texts moved too.
    assert "Exchange" not in plans["postings"]
    got = spark.read.parquet(f"{path}/postings")
    assert sorted((r["repo_key"], r["doc_id"], r["term"], r["tf"], r["size"]) for r in got.collect()) == [("a", 1, "x", 3, 6), ("a", 1, "y", 2, 6), ("a", 1, "z", 1, 6), ("b", 4, "z", 1, 1)]


def test_index_equals_bm25_and_reads_no_text(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, rng.choice(["a", "b", "c@@d"]), " ".join(rng.choices(words, k=rng.choice([0, 3, 30])))) for i in range(300)] + [(900, "a", None), (901, None, "w1"), (902, "", "w1")]
    docs, path = spark.createDataFrame(rows, DOCS), str(tmp_path / "index")
    asked = spark.createDataFrame([(i, rng.choice(["a", "b", "c@@d", "none", None]), " ".join(rng.choices(words, k=5)) if i else None) for i in range(25)], "query_id long, repo_key string, text string")
    want = {(r["query_id"], r["doc_id"]): (round(r["score"], 5), r["rank"]) for r in lexical.bm25(docs.where("repo_key <> ''"), asked, 10, by="repo_key").collect()}
    index.add(docs.where("doc_id < 100"), path, "1")
    index.add(docs.where("doc_id % 3 = 0"), path, "2")
    # A run that is lost before its last table counts for nothing, and is done again.
    index.add(docs, path, "3")
    for folder in (tmp_path / "index" / "docs").glob("repo_key=*/batch=3"):
        for f in folder.iterdir():
            f.unlink()
        folder.rmdir()
    few = index.search(spark, path, asked, 10, doc_kind="bigint").collect()
    assert {r["doc_id"] for r in few} <= {i for i, *_ in rows if i < 100 or i % 3 == 0}
    index.add(docs, path, "3")
    index.add(docs, path, "4")  # nothing is left to add
    found = index.search(spark, path, asked, 10, doc_kind="bigint")
    assert {(r["query_id"], r["doc_id"]): (round(r["score"], 5), r["rank"]) for r in found.collect()} == want and want
    assert all("/index/" in f for f in found.inputFiles()) and "text" not in spark.read.parquet(path + "/postings").columns


def test_lost_encode_runs_redo_only_what_is_missing(spark, tmp_path):
    commits = spark.createDataFrame([(f"r{i % 4}", f"c{i}", "m", f"diff {i}") for i in range(40)], "repo_key string, commit_id string, commit_msg string, diff string")
    path, seen = str(tmp_path / "v"), spark.sparkContext.accumulator(0)

    def build():
        def model(texts):
            seen.add(len(texts))
            if any("diff 3\n" in t + "\n" for t in texts):
                raise RuntimeError("lost")
            return dense.digest_encoder(texts)

        return model

    with pytest.raises(Exception, match="lost"):
        dense.encode_repositories(commits.orderBy("repo_key"), path, build, 0, 1)
    done = {r["repo_key"] for r in spark.read.parquet(path).select("repo_key").distinct().collect()} if (tmp_path / "v").exists() else set()
    assert "r3" not in done

    def sound():
        def model(texts):
            seen.add(len(texts))
            return dense.digest_encoder(texts)

        return model

    before = seen.value
    jobs = dense.encode_repositories(commits, path, sound, 0, 15)
    assert seen.value - before == 10 * (4 - len(done)) and jobs == -(-(4 - len(done)) // 2)
    rows = spark.read.schema("id string, embedding array<float>, repo_key string").parquet(path).collect()
    assert len(rows) == 40 and {r["id"] for r in rows} == {f"r{i % 4}@@c{i}" for i in range(40)}
    v = next(r["embedding"] for r in rows if r["id"] == "r1@@c5")
    assert v == dense.digest_encoder(["Commit message:\nm\n\nDiff:\ndiff 5"])[0].tolist()
    assert dense.encode_repositories(commits, path, sound, 0) == 0


def test_token_budgets_and_order(spark):
    def build():
        def tokenize(texts):
            return [[len(w) for w in t.split()] for t in texts]

        def embed(batch):
            longest = max(map(len, batch))
            assert len(batch) <= 4 and len(batch) * longest <= 40 or len(batch) == 1
            return np.array([[len(t), sum(t), len(batch)] for t in batch], float)

        return tokenize, embed

    rng = random.Random(1)
    texts = [" ".join("x" * rng.randint(1, 5) for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None, "y " * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["embedding"] for r in dense.encode_in_budget(rows, build, prefix="q ", most=20, batch=4, batch_tokens=40).collect()}
    for i, t in enumerate(texts):
        cut = [len(w) for w in ("q " + (t or "")).split()][:20]
        assert got[i][:2] == [len(cut), sum(cut)]
    assert max(v[2] for v in got.values()) > 1


def test_queries_without_a_truth_stay(spark, tmp_path):
    (tmp_path / "q.csv").write_text("cve,cve_description,owner,repo,fix_commit_ids\nA,d,o,r,\nB,d,o,r, x | y||x \n,d,o,r,x\nC,d,o,,x\nD,d,o,r,z\n")
    rows = {r["cve_id"]: r["fix_commit_ids"] for r in readers.queries(spark, str(tmp_path / "q.csv")).collect()}
    assert rows == {"A": [], "B": ["x", "y", "x"], "D": ["z"]}
    assert readers.queries(spark, str(tmp_path / "q.csv"), 2).count() == 2 and readers.queries(spark, str(tmp_path / "q.csv"), 3, limit_first=True).count() == 2
    raw = {r["cve_id"]: r["fix_commit_ids"] for r in readers.queries(spark, str(tmp_path / "q.csv"), trimmed=False).collect()}
    assert raw["B"] == [" x ", " y", "x "]


def test_method_shards_in_order(spark, tmp_path):
    line = lambda **x: json.dumps(x) + "\n"
    (tmp_path / "a.jsonl").write_text(line(cve_id="q1", best_commit_id="d1", commits_inspected=["d1", "d2"]) + "bad\n" + line(cve_id="q2", best_commit_id=None, commits_inspected=[]))
    (tmp_path / "b c+.jsonl").write_text(line(cve_id="q1", best_commit_id="d9", commits_inspected=["d3"]) + line(best_commit_id="x") + line(cve_id="q1", best_commit_id="d8", commits_inspected=["d3"]))
    ranks = lambda spec, *a: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in readers.load_method(spark, spec, *a)[1].collect())
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b c+.jsonl")
    assert ranks(f"Selection:{a},{b}") == [("q1", 1, "d8"), ("q1", 2, "d3")]
    assert ranks(f"selection:{b},{a}") == ranks(f"selection:{b}, {tmp_path}/a*.jsonl") == [("q1", 1, "d1"), ("q1", 2, "d2")]
    first = spark.createDataFrame([("q1", "d7", 1), ("q1", "d8", 2), ("q2", "d5", 1)], "query_id string, doc_id string, rank int")
    assert ranks(f"selection:{a},{b}", first) == [("q1", 1, "d8"), ("q1", 2, "d3"), ("q1", 3, "d7"), ("q2", 1, "d5")]
    assert ranks(f"single:{a}") == [("q1", 1, "d1")]
    pair = lambda c, y, n: line(input={"cve": "q", "commit_id": c, "label": 0}, output={"answer": y, "confidence": n})
    (tmp_path / "p1.jsonl").write_text(pair("x", True, 5) + pair("y", False, 9) + "{\n")
    (tmp_path / "p2.jsonl").write_text(pair("z", True, 5) + pair("w", True, 8))
    assert [d for _, _, d in ranks(f"pairs:{tmp_path}/p2.jsonl,{tmp_path}/p1.jsonl")] == ["w", "z", "x", "y"]
    assert [d for _, _, d in ranks(f"pairs:{tmp_path}/p*.jsonl")] == ["w", "x", "z", "y"]
    with pytest.raises(ValueError):
        readers.load_method(spark, f"other:{a}")
    with pytest.raises(FileNotFoundError):
        readers.load_method(spark, f"pairs:{tmp_path}/none*.jsonl")


def test_asks_that_models_make(spark):
    pool = spark.createDataFrame([("q", 1, "abc1"), ("q", 2, "abd2"), ("q", 3, "ABCDEF9"), ("q", 4, "abcdef"), ("q", 5, "abcdef99")], "query_id string, position int, doc_id string")
    asked = {1: "# 2", 2: "##2", 3: "#99999999999", 4: "#", 5: "", 6: None, 7: " 3 ", 8: "0", 9: "1234", 10: "abcdef", 11: "ABD", 12: "#99999999999999999999999", 13: "abcdef9"}
    rows = spark.createDataFrame([(k, "q", v) for k, v in asked.items()], "ask_id int, query_id string, part string")
    got = {r["ask_id"]: r["doc_id"] for r in cand.resolve(rows, pool).collect()}
    assert got == {1: "abd2", 2: "abd2", 3: None, 4: None, 5: None, 6: None, 7: "ABCDEF9", 8: None, 9: None, 10: "abcdef", 11: "abd2", 12: None, 13: None}
    asked = {1: "abcdef", 2: "ABCDEF9", 3: "abd2 ", 4: "ABD2EE", 5: "ab", 6: "", 7: None, 8: "abcdef99f", 9: "zz"}
    rows = spark.createDataFrame([(k, "q", v) for k, v in asked.items()], "ask_id int, query_id string, part string")
    got = {r["ask_id"]: r["doc_id"] for r in cand.resolve_either(rows, pool.drop("position")).collect()}
    # 8 begins with three ids of the pool.
    assert got == {1: "abcdef", 2: "ABCDEF9", 3: "abd2", 4: "abd2", 5: None, 6: None, 7: None, 8: None, 9: None}
    assert "CartesianProduct" not in plan(cand.resolve(rows, pool)) and "NestedLoop" not in plan(cand.resolve_either(rows, pool.drop("position")))


def test_answers_of_both_grammars(spark):
    texts = ["[12345678901] > [2]", "candidate 1234", "5 or [3]", "[#7]", "[99999999999999999999]", "a12", "none", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: tuple(r[1:]) for r in rows.select("i", parsing.listwise(F.col("t")), parsing.answer_in_turns(F.col("t")), parsing.answer_of_pool(F.col("t")), parsing.answer_number(F.col("t"))).collect()}
    assert got == {
        0: ([12345678901, 2], 12345678901, 12345678901, None), 1: ([], 1234, 1234, None), 2: ([3], 5, 3, 3), 3: ([], 7, 7, 7),
        4: ([], None, None, None), 5: ([], 12, None, None), 6: ([], None, None, None), 7: (None, None, None, None),
    }


def test_reviews(spark):
    call = lambda *tools: [(i, t, {"a": "b"}) for i, t in enumerate(tools, 1)]
    main = [(q, p, "why", e, "submit", 3, ["d1"], call("read", "submit"), 10, 1, 0.5) for q, p, e in (("over", "d1", None), ("same", "d1", ""), ("blank", "d1", None), ("none", None, None), ("failed", "d1", "x"), ("small", "d1", None), ("alone", "d1", None))]
    critic = [(q, p, "since", None, "max", 2, ["d2", "d1"], call("list"), 5, 1, 0.25) for q, p in (("over", "d2"), ("same", "d1"), ("blank", ""), ("none", "d2"), ("failed", "d2"), ("small", "d2"))]
    pools = spark.createDataFrame([(q, f"d{i}") for q in ("over", "same", "blank", "none", "failed", "alone") for i in (1, 2)] + [("small", "d1")], "query_id string, doc_id string")
    ranking = spark.createDataFrame([(m[0], f"d{i}", i) for m in main for i in (1, 2, 3)], "query_id string, doc_id string, rank int")
    truth = spark.createDataFrame([(m[0], d) for m in main for d in ("d2", "d3")], "query_id string, doc_id string")
    got = {r["query_id"]: r for r in select.with_review(spark.createDataFrame(main, select.PASS), spark.createDataFrame(critic, select.PASS), pools, ranking, truth, 100).collect()}
    assert {q: r["outcome"] for q, r in got.items()} == {"over": "overridden", "same": "confirmed", "blank": "confirmed", "none": "alone", "failed": "alone", "small": "alone", "alone": "alone"}
    r = got["over"]
    assert (r["best_doc_id"], r["reasoning"], r["stopped_reason"], r["iterations"], r["inspected"], r["hit"], r["first_rank"], r["truth_rank"], r["tokens_in"], r["cost"]) == ("d2", "[critic override] since", "critic_override:max", 5, ["d1", "d2"], True, 2, 2, 15, 0.75)
    assert [(c["turn"], c["tool"]) for c in r["calls"]] == [(1, "read"), (2, "submit"), (3, "critic.list")]
    assert got["blank"]["reasoning"] == "[critic confirmed] why" and got["blank"]["hit"] is False and got["none"]["best_doc_id"] is None and got["failed"]["iterations"] == 3 and len(got["small"]["calls"]) == 2
    few = "query_id string, best_doc_id string, tokens_in int, tokens_out int, inspected array<string>"
    out = {r["query_id"]: r for r in select.reviewed(spark.createDataFrame([("a", None, 1, 1, None), ("b", "d1", 1, 1, None)], few), spark.createDataFrame([("a", "d2", 1, 1, ["d2"]), ("b", "d2", 1, 1, ["d2"])], few)).collect()}
    assert out["a"]["best_doc_id"] is None and not out["a"]["overrode"] and out["b"]["best_doc_id"] == "d2" and out["b"]["inspected"] == ["d2"]


def test_last_rows_count(spark):
    rows = spark.createDataFrame([("a", 1, 5, None), ("a", 2, 1, "x"), ("a", 1, 9, "y"), (None, 1, 1, "z")], "k string, f int, l int, v string")
    assert [tuple(r) for r in runs.last_of(rows, "k", ["f", "l"]).collect()] == [("a", 2, 1, "x")]
    assert "Window" not in plan(runs.last_of(rows, "k", ["f", "l"]))


def test_diffs_take_time_linear_in_files(spark):
    def commit(n):
        return "".join(f"diff --git a/src/f{i}.py b/src/f{i}.py\n--- a\n+++ b\n@@ -1 +1 @@\n" + "+line\n" * 16 for i in range(n))

    def seconds(n):
        df = spark.createDataFrame([(1, commit(n))], "doc_id int, diff string").cache()
        df.count()
        view = df.select(diffs.by_priority(diffs.classified(diffs.file_changes(F.col("diff")), F.lit("some line text"))).alias("f")).select(diffs.render_commit(F.lit("m"), F.col("f")))
        view.collect()
        began = time.time()
        assert diffs.parse_diff(df).count() == n and view.count() == 1
        return time.time() - began

    seconds(10)
    assert seconds(4000) < 5 * max(1.0, seconds(1000))


def test_pieces_of_diffs_between_odd_breaks(spark):
    text = "junk\x0bdiff --git a/x b/x\r\n+a\r\rdiff --git a/y b/y -b\n\n"
    got = diffs.parse_diff(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x diff --git a b")], "doc_id int, diff string")).orderBy("block").collect()
    assert [(r["path"], r["adds"], r["dels"], r["raw"]) for r in got] == [("x", 1, 0, "diff --git a/x b/x\n+a\n"), ("y", 0, 1, "diff --git a/y b/y\n-b\n")]


def test_readers_of_single_files(spark, tmp_path):
    """S3, S15 to S17, S19, S22, S23, K4, K8, K9, P3."""
    rows = spark.createDataFrame([(1, "C", "o1", "r1", "p2"), (0, "C", "o0", "r0", "p1"), (2, "C", "o2", "r2", "p2")], "position int, cve string, owner string, repo string, patch string")
    assert tuple(readers.queries_by_row(rows).first()) == ("C", "o0", "r0", ["p1", "p2"])
    assert [r["position"] for r in readers.repo_queries(rows.withColumn("owner", F.lit(" o ")).withColumn("repo", F.lit("r")), "o", "r").collect()] == [0]
    (tmp_path / "d.csv").write_text("cve,reserve_time,publish_time\nA,2020-01-02,bad\nA,2021-01-02,2021-02-03\n")
    assert [str(r["publish_ts"]) for r in readers.dates(spark, str(tmp_path / "d.csv")).collect()] == ["2021-02-03 00:00:00"]
    (tmp_path / "r.csv").write_text('cve_id,markdown,error\nA,"x\ny",\nA,z,e\n')
    assert [tuple(r) for r in readers.reports(spark, str(tmp_path / "r.csv")).collect()] == [("A", "z", "e")]
    assert [tuple(r) for r in readers.descriptions(spark.createDataFrame([("A", " x "), ("A", " y ")], "cve string, cve_description string").coalesce(1)).collect()] == [("A", "y")]
    pairs = spark.createDataFrame([("A", "d", "o/r", "c", "m", "x", 1, 1)], "cve string, desc string, repo string, commit_id string, commit_message string, diff string, label int, rank int")
    writers.write_pairs(pairs, str(tmp_path / "p"), readers.PAIR)
    assert readers.pairs(spark, str(tmp_path / "p")).collect() == pairs.collect()
    writers.write_csv(spark.createDataFrame([('a "q",\nb', 1)], "x string, y int"), str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "csv"), "x string, y int").collect()] == [('a "q",\nb', 1)]
    keys = spark.createDataFrame([("r1",), ("r2",)], "repo_key string")
    assert [r[0] for r in writers.pending_partitions(keys, keys.limit(1).union(keys.limit(1))).collect()] == ["r2"]
    (tmp_path / "s.csv").write_text("cve,cve_description,owner,repo,fix_commit_ids\n A ,d,o,r,\nA,d,o,r,x\n")
    assert [r[0] for r in readers.sample_ids(spark, str(tmp_path / "s.csv")).collect()] == ["A"]


def test_backbones_without_tables(spark, tmp_path):
    bm = spark.createDataFrame([(1, 5, 1)], "query_id long, doc_id long, rank int")
    assert dense.backbone_ranking(spark, str(tmp_path), "none", bm).count() == 0
    vectors = spark.createDataFrame([(5, [1.0, 0.0], "r"), (6, [0.0, 1.0], "r")], "doc_id long, embedding array<float>, repo_key string")
    asked = spark.createDataFrame([(1, [0.0, 1.0], "r"), (2, [0.0, 1.0], "absent")], "query_id long, embedding array<float>, repo_key string")
    store.write_by_repo(vectors, f"{tmp_path}/b/corpus", ("doc_id",))
    store.write_by_repo(asked, f"{tmp_path}/b/queries", ("query_id",))
    got = dense.backbone_ranking(spark, str(tmp_path), "b", bm.union(spark.createDataFrame([(2, 5, 1)], bm.schema)), 1).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["source"]) for r in got] == [(1, 5, "rrf-b"), (1, 6, "rrf-b")]


def test_baseline_and_summary(spark, tmp_path):
    best = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 1)], "query_id string, best_rank int")
    assert tuple(metrics.rank1_baseline(best).first()) == (4, 3, 2, 0.5)
    ranking = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x")], "query_id string, doc_id string")
    assert [r[0] for r in metrics.recoverable(ranking, ranking.where("doc_id = 'y'")).collect()] == ["b"]
    writers.write_summary(metrics.rank1_baseline(best), str(tmp_path / "s"), run="one")
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0]) == {"run": "one", "metrics": {"n": 4, "recoverable": 3, "right_at_1": 2, "accuracy": 0.5}}
