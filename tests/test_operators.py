"""Hand-computed cases, and twins that must differ when a rule is relaxed."""

import math
import re

import pytest
from pyspark.sql import functions as F

from feedloom.operators import encoding, history, metrics, order, retrieval, samples, windows


def test_ranking_at_by_hand(spark):
    """Targets {10,20,30} and {40} against [10,99,20,98] and [97,96,95,94]."""
    hits = spark.createDataFrame([(1, 1, 3, 1), (1, 1, 3, 3), (1, 1, 3, None), (2, 1, 1, None)], "req int, user int, n_targets int, rank int")
    rows = {r["req"]: r for r in metrics.ranking_at(hits, ["req", "user"], [4]).collect()}
    assert rows[1]["recall"] == pytest.approx(2 / 3) and rows[2]["recall"] == 0
    assert rows[1]["ndcg"] == pytest.approx(1.5 / (1 + 1 / math.log2(3) + 0.5))
    assert rows[1]["hitrate"] == 1 and rows[2]["hitrate"] == 0


def test_auc_by_hand(spark):
    p = spark.createDataFrame([("a", 0.9, 1), ("a", 0.4, 1), ("a", 0.5, 0), ("a", 0.1, 0), ("b", 0.5, 1), ("b", 0.5, 0), ("c", 0.2, 1)], "u string, p double, y int")
    got = {r["u"]: r["auc"] for r in metrics.auc(p, ["u"]).collect()}
    assert got == {"a": 0.75, "b": 0.5, "c": None}
    g = metrics.gauc(p, "u").first()
    assert g["gauc"] == pytest.approx((0.75 * 4 + 0.5 * 2) / 6) and g["used"] == 2 and g["skipped"] == 1


def test_cosine_by_hand(spark):
    pairs = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 1), (3, 3)], "user_id int, video_id int")
    got = {(r["i"], r["j"]): r["sim"] for r in retrieval.item_cosine(pairs, 10).collect()}
    assert got[(0, 1)] == pytest.approx(2 / math.sqrt(6), abs=1e-9) and (0, 3) not in got and (0, 0) not in got


def test_history_is_strict(spark):
    pos = spark.createDataFrame([(1, 10, 5), (1, 20, 6), (1, 20, 7), (2, 10, 1)], "user_id int, time_ms long, video_id int")
    asked = spark.createDataFrame([(1, 20), (1, 21), (1, 10), (3, 5)], "user_id int, time_ms long")
    got = {(r[0], r[1]): r["hist"] for r in history.strict_history(asked, pos, n=2).collect()}
    assert got == {(1, 20): [5], (1, 21): [7, 6], (1, 10): [], (3, 5): []}
    relaxed = {(r[0], r[1]): r["hist"] for r in history.last_n(pos, "user_id", "time_ms", "video_id", 2).collect()}
    assert relaxed[(1, 20)] != got[(1, 20)]


def test_windows_never_see_the_target_day(spark):
    log = spark.createDataFrame([(1, 5, 20220430, 1, "warmup"), (1, 6, 20220501, 0, "train")], "user_id int, video_id int, date int, is_click int, split string")
    r = windows.rolling(log, ["user_id"], "video_id", ["is_click"], ["is_click"], [1, 3], windows.priors(log, ["is_click"]), "u")
    rows = {x["date"]: x for x in r.collect()}
    assert rows[20220501]["u_imp_1d"] == 1 and rows[20220501]["u_is_click_1d"] == 1
    assert rows[20220502]["u_imp_1d"] == 1 and rows[20220502]["u_is_click_1d"] == 0 and rows[20220502]["u_imp_3d"] == 2
    assert 20220430 not in rows and rows[20220504]["u_is_click_rate_1d"] is None and rows[20220504]["u_imp_1d"] == 0


def test_padding_prefers_scored_items(spark):
    cat = spark.createDataFrame([(i, 9) for i in range(1, 8)], "video_id int, train_freq int")
    scores = spark.createDataFrame([(1, 6, 0.5), (1, 2, 0.5), (1, 99, 0.9)], "m int, video_id int, score double")
    moments = spark.createDataFrame([(1,), (2,)], "m int")
    got = retrieval.padded_top_k(scores, moments, cat, ["m"], 4).orderBy("m", "rank").collect()
    assert [(r["m"], r["video_id"]) for r in got] == [(1, 2), (1, 6), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_vocabulary_and_tags(spark):
    v = encoding.vocabulary(spark.createDataFrame([(7, 2), (3, 2), (9, 5)], "id int, n int"))
    assert {r["id"]: r["index"] for r in v.collect()} == {9: 2, 3: 3, 7: 4}
    t = spark.createDataFrame([(" a,b ,,a",), (None,)], "tag string")
    assert [r[0] for r in t.select(encoding.tags("tag", True)).collect()] == [["a", "b", "a"], []]
    assert [r[0] for r in t.select(encoding.tags("tag", False)).collect()] == [[" a", "b ", "a"], []]


def test_constant_column_standardizes_to_zero(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "k int, x int")
    out = encoding.apply_standard(df, encoding.fit_standard(df, ["x"]), ["x"]).collect()
    assert all(abs(r["x"]) < 1e-9 for r in out)


def test_calibration_and_pcoc(spark):
    p = spark.createDataFrame([(0.25, 1), (0.25, 0), (0.25, 0), (0.25, 0)], "p double, y int")
    assert p.agg(metrics.pcoc()).first()[0] == 1.0
    assert p.select((F.col("p") * 2).alias("p"), "y").agg(metrics.pcoc()).first()[0] == 2.0
    assert [tuple(r) for r in metrics.calibration(p, 2).collect()] == [(0, 4, 0.25, 0.25)] or len(metrics.calibration(p, 2).collect()) == 1


def test_hybrid_slots_and_fallback(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "event_id int, user_id int")
    pool = spark.createDataFrame([(7, 500), (7, 501)], "user_id int, video_id int")
    got = {(r["event_id"], r["slot"]): r for r in retrieval.hybrid_negatives(rows, pool, "event_id", 5, 0.4, 0, 99).collect()}
    assert set(got) == {(e, s) for e in (1, 2) for s in range(5)}
    assert {got[1, s]["kind"] for s in (3, 4)} == {"exposure"} and {got[2, s]["kind"] for s in (3, 4)} == {"fallback"}
    assert all(got[1, s]["negative"] in (500, 501) for s in (3, 4)) and all(0 <= got[e, s]["negative"] <= 99 for e in (1, 2) for s in range(3))
    for share in (0.0, 1.0):
        with pytest.raises(ValueError):
            retrieval.hybrid_negatives(rows, pool, "event_id", 5, share, 0, 99)


def test_prediction_checks_by_hand(spark):
    p = spark.createDataFrame([(0.5, 1), (float("nan"), 0), (None, 2), (1.5, None), (-0.1, 0)], "p double, y int")
    assert {r["check"]: r["violations"] for r in metrics.prediction_checks(p).collect()} == {"label": 2, "missing_score": 2, "score_range": 2}
    assert {r["violations"] for r in metrics.prediction_checks(p.where("false")).collect()} == {0}


def test_coverage_and_lift(spark):
    rows, ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int"), spark.createDataFrame([(1,), (9,)], "v int")
    assert tuple(encoding.coverage(rows, ids, "v").first()) == (4, 2, 0.5)
    cat = spark.range(100)
    at = spark.createDataFrame([(10, 0.0), (10, 1.0)], "k int, recall double")
    assert tuple(metrics.lift_over_chance(at, cat).first()) == (10, 0.5, 0.1, 5.0)


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_sums_before_are_those_of_one_window(spark, slices):
    rows = spark.range(3000).selectExpr("id % 3 AS g", "IF(id = 7, NULL, (id * 7919) % 3001) AS k", "CAST(id % 5 AS INT) AS v")
    got = order.sums_before(rows, [F.col("k")], {"s": F.col("v"), "n": F.lit(1)}, ["g"], slices).toPandas().sort_values(["g", "k"], na_position="first")
    for _, one in got.groupby("g"):
        assert one["s"].tolist() == [0, *one["v"].cumsum()[:-1]] and one["n"].tolist() == list(range(1000))
    ids = order.numbered(rows, [-F.col("v"), F.col("k")], "i", 2).toPandas().sort_values("i")
    assert ids["i"].tolist() == list(range(2, 3002)) and ids["v"].is_monotonic_decreasing
    assert order.sums_before(rows.limit(0), [F.col("k")], {"s": F.col("v")}, ["g"], slices).count() == 0


def test_assembly_keeps_every_sample_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, k string")
    part = spark.createDataFrame([("a", 5.0), ("a", 5.0), (None, 9.0)], "k string, x double")
    got = samples.assemble(rows, [(part, ["k"], {"x": F.lit(-1.0)})]).orderBy("id").collect()
    assert [(r["id"], r["x"]) for r in got] == [(1, 5.0), (2, -1.0), (3, -1.0), (4, 5.0)]
    z = samples.standardised(spark.createDataFrame([(True, 1.0, 7.0), (True, 3.0, 7.0), (False, 9.0, 1.0)], "t boolean, a double, b double"), F.col("t"), {"a": F.col("a"), "b": F.col("b")}).collect()
    assert [(r["a"], r["b"]) for r in z] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


@pytest.mark.parametrize("descending", [False, True])
def test_padding_takes_what_is_lacking(spark, descending):
    cat = spark.createDataFrame([(i, 1) for i in range(1, 9)], "video_id int, train_freq int")
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 8, 0.9), (1, 99, 5.0), (2, 3, 0.0), *[(3, i, 1.0) for i in range(1, 7)]], "m int, video_id int, score double")
    moments = spark.createDataFrame([(1,), (2,), (2,), (3,)], "m int")
    got = {}
    for r in retrieval.padded_top_k(scores, moments, cat, ["m"], 4, descending=descending).orderBy("m", "rank").collect():
        got.setdefault(r["m"], []).append((r["video_id"], r["padded"], r["n_padded"]))
    pads = [8, 7, 6, 5] if descending else [1, 2, 3, 4]
    fill = [7, 6] if descending else [2, 3]
    assert got[1] == [(8, 0, 2), (1, 0, 2), *[(i, 1, 2) for i in fill]]
    assert got[2] == [(i, 1, 4) for i in pads] and got[3] == [(i, 0, 0) for i in (1, 2, 3, 4)]
    assert retrieval.padded_top_k(scores, moments.limit(0), cat, ["m"], 4).count() == 0


def _counted(df, acc):
    """``df`` through a task that counts the rows that it hands on."""

    def scan(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    return df.mapInArrow(scan, df.schema)


def test_an_order_reads_its_rows_once(spark):
    acc = spark.sparkContext.accumulator(0)
    got = order.numbered(_counted(spark.range(5000), acc), [F.col("id")], "n").collect()
    assert acc.value == 5000 and all(r["n"] == r["id"] + 1 for r in got)


def test_neighbours_shuffle_no_pairs(spark):
    acc = spark.sparkContext.accumulator(0)
    pairs = _counted(spark.range(600).select((F.col("id") % 40).alias("user_id"), (F.col("id") * 7 % 90).alias("video_id")).distinct(), acc)
    sims = retrieval.item_cosine(pairs, 5)
    assert sims.count() == 450 and acc.value == 360  # read once
    assert not re.search(r"hashpartitioning\(i#\d+L?, j#|hashpartitioning\(j#", sims._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("asked", [True, False])
def test_windows_copy_no_day_to_those_that_see_it(spark, asked):
    rows = [(1, 10, 20240101, 1), (1, 10, 20240102, 0), (1, 11, 20240102, 1), (1, None, 20240105, 1), (2, 10, 20240101, None)]
    log = spark.createDataFrame(rows, "u long, v long, date int, y int").withColumn("split", F.lit("warmup"))
    need = spark.createDataFrame([(1, 20240103), (1, 20240110), (2, 20240101), (2, 20240109), (2, 20240102)], "u long, date int")
    out = windows.rolling(log, ["u"], "v", ["y"], [], [1, 7], windows.priors(log, ["y"]), "p", need=need if asked else None)
    got = {(r["u"], r["date"]): (r["p_imp_1d"], r["p_y_7d"], r["p_imp_7d"], r["p_active_days_7d"], r["p_distinct_7d"]) for r in out.collect()}
    some = {(1, 20240103): (2, 2, 3, 2, 2), (1, 20240110): (0, 1, 1, 1, 0), (2, 20240102): (1, 0, 1, 1, 1)}
    assert got == some if asked else (some.items() <= got.items() and len(got) == 18)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
