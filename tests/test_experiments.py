"""Samplers by name, names of runs, configuration guards, ledgers."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import experiments, samplers


def test_strategies_share_a_layout_and_full_batches_are_all_others(spark):
    rows = spark.createDataFrame([(k, k % 3, 10 + k % 4, k // 5) for k in range(12)], "k long, user_id long, item long, batch long")
    pool = spark.createDataFrame([(0, 50), (0, 51), (1, 60)], "user_id long, video_id long")
    for name in samplers.STRATEGIES:
        got = samplers.negatives(name, rows, "k", "item", 4, 100, 109, pool=pool)
        assert got.columns == ["k", "slot", "negative"]
        found = got.collect()
        if name == "inbatch_full_logq":
            want = sorted((a, j, 10 + b % 4) for a in range(12) for j, b in enumerate(x for x in range(12) if x // 5 == a // 5 and x != a))
            assert sorted(map(tuple, found)) == want
        else:
            assert sorted((r["k"], r["slot"]) for r in found) == [(k, s) for k in range(12) for s in range(4)]
    shown = samplers.negatives("exposure", rows, "k", "item", 4, 100, 109, pool=pool).join(rows, "k").collect()
    assert {r["negative"] for r in shown if r["user_id"] == 0} <= {50, 51} and {r["negative"] for r in shown if r["user_id"] == 1} == {60} and all(100 <= r["negative"] <= 109 for r in shown if r["user_id"] == 2)
    with pytest.raises(ValueError, match="no such strategy"):
        samplers.negatives("other", rows, "k", "item", 4, 100, 109)
    with pytest.raises(ValueError, match="pool"):
        samplers.negatives("hybrid", rows, "k", "item", 4, 100, 109)


def test_log_q_comes_off_only_where_the_strategy_says(spark):
    scores, q = spark.createDataFrame([(1, 2.0), (2, 3.0)], "item long, score double"), spark.createDataFrame([(1, -1.0), (2, -2.0)], "item long, log_q double")
    assert [r["score"] for r in samplers.with_log_q(scores, "inbatch", q, "item", 0.5).collect()] == [2.0, 3.0]
    assert sorted(r["score"] for r in samplers.with_log_q(scores, "inbatch_logq", q, "item", 0.5).collect()) == [2.5, 4.0]
    with pytest.raises(Exception, match="no support for item 2"):
        samplers.with_log_q(scores, "inbatch_full_logq", q.where("item = 1"), "item", 0.5).collect()
    assert abs(scores.select(samplers.normalised("score", 8)).first()[0] - 2 / 2.0794415416798357) < 1e-12
    with pytest.raises(ValueError):
        samplers.normalised("score", 1)


def test_names_tasks_and_guards():
    assert experiments.artifact_name("random", "id_only", "main", 42) == "random_id_only_main_seed42"
    assert experiments.artifact_name("random", "id_only", "main", 42, negatives=16, smoke_steps=5) == "random_id_only_main_seed42_neg16_smoke5"
    assert experiments.task_columns(["click", "long_view"], ["is_click", "long_view", "is_like"]) == ["is_click", "long_view"]
    for asked, columns in ((["view"], ["is_click"]), (["click"], ["click", "is_click"])):
        with pytest.raises(ValueError, match="task"):
            experiments.task_columns(asked, columns)
    fine = dict(protocol="A", main=5, aux=1, train=["train"], evaluated="test", data={"a": 1}, other={"a": 1})
    experiments.check_catalogs(**fine)
    for change, said in (({"protocol": "B"}, "protocol"), ({"aux": 5}, "threshold"), ({"aux": 0}, "threshold"), ({"evaluated": "train"}, "trained on"), ({"other": {"a": 2}}, "'a'")):
        with pytest.raises(ValueError, match=said):
            experiments.check_catalogs(**fine | change)


def test_banned_sources_and_ledger(spark):
    files = spark.createDataFrame([("/x/statistic/log_1.csv",), ("/x/video_statistic_2.csv",), ("/x/log.csv",)], "path string")
    assert {r["check"]: r["violations"] for r in experiments.banned_sources(files, ["statistic", "random"]).collect()} == {"statistic": 1, "random": 0}
    said = spark.createDataFrame([("a", "auc", "up"), ("b", "auc", "down"), ("c", "auc", "none"), ("d", "auc", "up"), ("e", "auc", "up")], "model string, metric string, expected string")
    got = spark.createDataFrame([("a", "auc", 0.4, 0.1), ("b", "auc", 0.4, 0.1), ("c", "auc", 0.1, 0.1), ("d", "auc", 0.4, None)], "model string, metric string, mean_delta double, std_delta double")
    found = {r["model"]: (r["clear"], r["outcome"]) for r in experiments.ledger(said, got).collect()}
    assert found == {"a": (True, "hit"), "b": (True, "miss"), "c": (False, "hit"), "d": (False, "miss"), "e": (False, "open")}
    assert experiments.ledger(said, got).where(F.col("outcome") == "open").count() == 1


def test_forbidden_columns_go_and_cold_pairs_get_defaults(spark):
    from feedloom.operators import encoding, ingest, windows

    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert ingest.drop_present(rows, ["b", "missing"]).columns == ["a", "c"]
    cold = spark.createDataFrame([(1, None, None, None), (2, 4, 0.5, 1)], "user_id long, p_imp_7d long, p_is_click_smooth_7d double, p_has_history int")
    got = [tuple(r) for r in windows.pair_defaults(cold, {"is_click": 0.25}, "p", ["is_click"]).orderBy("user_id").collect()]
    assert got == [(1, 0, 0.25, 0), (2, 4, 0.5, 1)]
    assert [encoding.classify(c) for c in ("u_imp_7d", "u_is_click_rate_7d", "u_is_click_smooth_7d", "u_trend", "u_has_history")] == ["count", "naive", "smooth", "trend", "flag"]
