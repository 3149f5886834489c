"""Interval joins, guards, the result sink, heads of ordered datasets, the column report, versions of vectors."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ranges, report, retrieval, strict
from feedloom.sources import head, results

# ---- interval join


def test_interval_join_against_all_pairs_without_nested_loops(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 2, None]), rng.randrange(-20, 20), rng.randrange(0, 12), k) for k in range(60)] + [(1, None, 3, 90), (2, 5, -3, 91)]
    right = [(rng.choice([1, 2, 3, None]), rng.choice([None, rng.randrange(-25, 35)]), k) for k in range(80)]
    a = spark.createDataFrame(left, "k long, lo long, span long, i long").withColumn("hi", F.col("lo") + F.col("span"))
    b = spark.createDataFrame(right, "k long, at long, j long")
    want = sorted((i, j) for k, lo, span, i in left for q, at, j in right if None not in (k, lo, at) and k == q and lo <= at <= lo + span)
    for width in (1, 5, 100):
        got = ranges.interval_join(a, b, ["k"], "lo", "hi", "at", width)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = ranges.interval_join(a.union(a.where("i = 3")), b, ["k"], "lo", "hi", "at", 4, how="left").collect()
    assert {r["i"] for r in kept} == {x[3] for x in left} and sum(r["i"] == 3 for r in kept) == 2 * max(1, sum(i == 3 for i, _ in want))
    assert sorted((r["i"], r["j"]) for r in kept if r["j"] is not None and r["i"] != 3) == [x for x in want if x[0] != 3]
    with pytest.raises(ValueError):
        ranges.interval_join(a, b, ["k"], "lo", "hi", "at", 0)
    with pytest.raises(ValueError, match="both sides"):
        ranges.interval_join(a, b.withColumn("i", F.lit(1)), ["k"], "lo", "hi", "at", 2)
    assert ranges.interval_join(a.limit(0), b, ["k"], "lo", "hi", "at", 2).count() == 0


# ---- guards

def test_only_and_watched_rows(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "i long, p double")
    assert strict.only(rows.where("i = 1"), {"share": F.col("p") <= 1}).count() == 1
    for i in (2, 3):
        with pytest.raises(Exception, match="guard share fails"):
            strict.only(rows.where(F.col("i") == i), {"share": F.col("p") <= 1}).collect()
    watched = strict.Watched(rows, {"above": F.col("p") > 1, "missing": F.col("p").isNull(), "below": F.col("p") < 0})
    spark.sparkContext.setJobGroup("watched", "")
    assert watched.rows.agg(F.sum("i")).first()[0] == 6
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched"))
    with pytest.raises(ValueError, match=r"above \(1 rows\), missing \(1 rows\)"):
        watched.verify()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched")) == jobs
    fine = strict.Watched(rows.where("i = 1"), {"above": F.col("p") > 1})
    fine.rows.count()
    fine.verify()


def test_retrieval_metrics_stop_at_bad_input(spark):
    answers = [(1, 10, 1), (1, 20, 2), (2, 30, 1), (2, 40, 2)]
    targets = [(1, 10), (1, 50), (2, 40), (3, 60)]

    def run(a=answers, t=targets, ks=(2, 1), longest=2):
        return strict.retrieval_metrics(spark.createDataFrame(a, "q long, item_id long, rank int"), spark.createDataFrame(t, "q long, item_id long"), ["q"], list(ks), longest).collect()

    got = {(r["q"], r["k"]): (r["recall"], r["hitrate"]) for r in run()}
    assert got == {(1, 1): (0.5, 1.0), (1, 2): (0.5, 1.0), (2, 1): (0.0, 0.0), (2, 2): (1.0, 1.0), (3, 1): (0.0, 0.0), (3, 2): (0.0, 0.0)}
    for ks in ((), (1, 1), (0,), (3,)):
        with pytest.raises(ValueError):
            run(ks=ks)
    for bad, said in ((dict(t=[*targets, (1, 10)]), "target repeats"), (dict(a=[*answers, (1, 10, 3)], longest=3), "repeats in an answer"), (dict(a=[*answers, (1, 70, 2)], longest=3), "repeats in an answer"), (dict(a=[*answers, (2, 70, 4)], longest=4), "from 1"), (dict(a=[*answers, (1, 70, 3)]), "from 1"), (dict(a=[*answers, (9, 70, 1)]), "to no request")):
        with pytest.raises(Exception, match=said):
            run(**bad)


def test_log_q_and_alignment_stop_the_query(spark):
    q = spark.createDataFrame([(1, -0.5), (2, -1.5)], "item long, log_q double")
    rows = spark.createDataFrame([(1,), (2,), (1,)], "item long")
    assert sorted(r["log_q"] for r in strict.log_q_of(rows, q, "item", 1, 2).collect()) == [-1.5, -0.5, -0.5]
    with pytest.raises(Exception, match="no support for item 3"):
        strict.log_q_of(spark.createDataFrame([(3,)], "item long"), q, "item").collect()
    with pytest.raises(Exception, match="outside the catalog: item 1"):
        strict.log_q_of(rows, q, "item", 2, 5).collect()
    samples, features = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string"), spark.createDataFrame([(2, 0.2), (1, 0.1)], "id long, f double")
    assert sorted(map(tuple, strict.same_rows(samples, features, "id").collect())) == [(1, "a", 0.1), (2, "b", 0.2)]
    for s, f in ((samples, features.limit(1)), (samples.limit(1), features), (samples, features.union(features.limit(1))), (samples.union(samples.limit(1)), features)):
        with pytest.raises(Exception, match="not the same rows"):
            strict.same_rows(s, f, "id").collect()


# ---- sink

def test_sink_refuses_less_and_survives_failures(spark, tmp_path):
    path, kind = str(tmp_path / "result"), "seed long, model string, auc double"
    full = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.6), (1, "b", 0.7)], kind)
    with pytest.raises(FileNotFoundError):
        results.read_result(spark, path, full.schema)
    results.write_result(full, path, ["model", "seed"], {"baseline": "a"})
    same = lambda df: sorted(map(tuple, results.read_result(spark, path, full.schema).collect())) == sorted(map(tuple, df.collect()))
    assert same(full)
    wider = full.union(spark.createDataFrame([(3, "b", 0.1)], kind))
    results.write_result(wider, path, ["model", "seed"], {"baseline": "a"})
    assert same(wider)
    with pytest.raises(results.Refused, match="lose.*'seed': 3"):
        results.write_result(full, path, ["model", "seed"], {"baseline": "a"})
    with pytest.raises(results.Refused, match="another meaning"):
        results.write_result(wider, path, ["model", "seed"], {"baseline": "b"})
    failing = wider.withColumn("auc", F.when(F.col("seed") == 2, F.raise_error(F.lit("task fails")).cast("double")).otherwise(F.col("auc")))
    with pytest.raises(Exception, match="task fails"):
        results.write_result(failing, path, ["model", "seed"], {"baseline": "a"})
    assert same(wider) and len(list((tmp_path / "result" / "versions").iterdir())) == 1
    results.write_result(full, path, ["model", "seed"], {"baseline": "b"}, force=True)
    assert same(full) and [p.name for p in (tmp_path / "result").iterdir() if p.name.startswith(".current-") and not p.name.endswith(".crc")] == []


# ---- head

def test_head_reads_only_files_that_can_hold_it(spark, tmp_path):
    path = str(tmp_path / "ordered")
    rows = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000)
    rows.repartitionByRange(10, "x").write.parquet(path)
    got = head.first_n(spark, path, ["x"], 150)
    assert [r["x"] for r in got.collect()] == list(range(150))
    assert len(got.inputFiles()) <= 3 < len(spark.read.parquet(path).inputFiles())
    assert head.first_n(spark, path, ["x"], 0).count() == 0 and head.first_n(spark, path, ["x"], 5000).count() == 1000
    other = str(tmp_path / "nulls")
    spark.createDataFrame([(k, None if k % 50 == 0 else k) for k in range(400)], "id long, x long").repartition(4, "id").write.parquet(other)
    sparse = [r["x"] for r in head.first_n(spark, other, ["x"], 12).collect()]
    assert sparse == [None] * 8 + [1, 2, 3, 4]
    text = str(tmp_path / "text")
    spark.createDataFrame([(f"{k:03d}",) for k in range(90)], "s string").repartition(3).write.parquet(text)
    assert [r["s"] for r in head.first_n(spark, text, ["s"], 2).collect()] == ["000", "001"]
    with pytest.raises(ValueError):
        head.first_n(spark, path, ["x"], -1)


def test_files_of_head_by_bounds():
    files = [("a", 10, 0, 9, 0, True), ("b", 10, 5, 30, 0, True), ("c", 10, 31, 40, 0, True), ("d", 10, 35, 50, 1, True), ("e", 10, None, None, 0, False)]
    assert head.files_of_head(files, 10) == ["a", "b", "d", "e"]
    assert head.files_of_head(files, 21) == ["a", "b", "c", "d", "e"]
    assert head.files_of_head(files, 10**6) == ["a", "b", "c", "d", "e"]


# ---- report

def test_report_is_one_scan_and_its_sketches_are_near(spark):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 700).cast("int").alias("k"), F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("v"), (F.sqrt("id").cast("int") % 9))).alias("s"), F.array("id").alias("list"), F.lit(None).cast("double").alias("none"), (F.col("id") % 2 == 0).alias("flag"))
    made = report.report(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 or plan.count("Range") == plan.count("Range (0")
    got = {r["column"]: r for r in made.collect()}
    assert got["k"]["rows"] == 20_000 and abs(got["k"]["distinct"] - 700) < 0.08 * 700 and (got["k"]["least"], got["k"]["greatest"]) == ("0", "699")
    low, mid, high = map(float, got["id"]["quartiles"].split(", "))
    assert max(abs(low - 5000), abs(mid - 10000), abs(high - 15000)) <= 20
    assert got["s"]["null_rate"] == 0.25 and got["none"]["null_rate"] == 1.0 and got["none"]["mean"] is None and got["list"]["distinct"] is None
    assert len(got["s"]["frequent"].split(", ")) == 3 and got["flag"]["distinct"] == 2
    lines = report.as_markdown(made, "t|x").splitlines()
    assert lines[4].startswith("| none |") and lines[5].startswith("| s |") and len(lines) == 4 + 6
    empty = {r["column"]: r for r in report.report(rows.limit(0)).collect()}
    assert empty["id"]["rows"] == 0 and empty["id"]["null_rate"] is None


# ---- versions of vectors

def test_top_k_meets_only_the_own_version(spark):
    rng = random.Random(3)
    items = [(i, d, [rng.gauss(0, 1) for _ in range(4)] if i != 7 else None) for d in (1, 2) for i in range(30)]
    queries = [(q, 1 + q % 2, [rng.gauss(0, 1) for _ in range(4)]) for q in range(6)] + [(6, 1, None), (7, 9, [0.0] * 4)]
    a, b = spark.createDataFrame(queries, "query_id long, day int, q array<double>"), spark.createDataFrame(items, "item_id long, day int, v array<double>")
    got = sorted(map(tuple, retrieval.exact_top_k(a, b, 5, version="day").select("query_id", "item_id", "score", "rank").collect()))
    want = []
    for q, day, x in queries[:6]:
        scored = sorted(((-round(sum(s * t for s, t in zip(x, v, strict=True)), 6), i) for i, d, v in items if d == day and v is not None))[:5]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(scored, 1)]
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in sorted(want)]
    assert all(abs(x[2] - y[2]) < 1e-5 for x, y in zip(got, sorted(want), strict=True))
    assert {tuple(r)[1] for r in retrieval.exact_top_k(a.where("query_id = 0"), b.where("day = 1"), 3).select("query_id", "item_id").collect()} != set()
    with pytest.raises(Exception, match="differ in length"):
        retrieval.exact_top_k(a.where("query_id = 0"), b.where("item_id < 3").withColumn("v", F.when(F.col("item_id") == 0, F.array(F.lit(1.0))).otherwise(F.col("v"))), 3).collect()


def test_ranking_bundle_stops_at_unsound_predictions(spark):
    rows = [(1, 0.1, 0), (1, 0.9, 1), (2, 0.5, 1), (2, 0.5, 0), (3, 0.2, 0)]
    kind = "u long, p double, y int"
    got = {(r["metric"], r["bucket"]): r["value"] for r in strict.evaluate_ranking(spark.createDataFrame(rows, kind), "u", buckets=2).collect()}
    assert got["n", None] == 5 and got["auc", None] == 5.5 / 6 and got["gauc", None] == 0.75 and (got["gauc_users", None], got["gauc_skipped", None]) == (2, 1)
    assert abs(got["pcoc", None] - 0.44 / 0.4) < 1e-12 and got["calibration_n", 0] + got["calibration_n", 1] == 5
    for bad, said in (((1, 0.5, 2), "label"), ((1, 1.5, 1), "score"), ((1, float("nan"), 1), "score"), ((1, None, 1), "score"), ((None, 0.5, 1), "user"), ((1, 0.5, None), "label")):
        with pytest.raises(Exception, match=f"guard {said} fails"):
            strict.evaluate_ranking(spark.createDataFrame([*rows, bad], kind), "u").collect()
