"""Multi-task ranking: gradients against differences, masks, learning; sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import metrics, multitask, rerank
from feedloom.plans import extensions
from feedloom.sources import tables
from tests.conftest import SF


@pytest.mark.parametrize("allowed", [multitask.single(2), multitask.mmoe(2, 3), multitask.cgc(2, 1)])
def test_gradient_is_that_of_differences(allowed):
    rng = np.random.default_rng(0)
    net = multitask.Mixture(4, allowed, 3, seed=1)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, (9, 2)).astype(float)
    y[0, 1] = np.nan
    _, g = net.gradient(x, y)
    for i in rng.choice(net.size, 25, replace=False):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        d = (multitask.Mixture(4, allowed, 3, flat=up).gradient(x, y)[0] - multitask.Mixture(4, allowed, 3, flat=down).gradient(x, y)[0]) / 2e-6
        assert g[i] == pytest.approx(d, abs=1e-5)


@pytest.mark.parametrize("net", [multitask.Stacked(4, 2, 2, 1, 2, 3), multitask.Stacked(4, 3, 1, 2, 3, 3), multitask.Selective(4, 2, 5, 3)])
def test_gradient_of_other_models_is_that_of_differences(net):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, (9, len(net.w["bias"]))).astype(float)
    y[0, 1] = np.nan
    _, g = net.gradient(x, y)
    step = np.eye(net.size) * 1e-6
    for i in rng.choice(net.size, 60, replace=False):
        d = (net.at(net.flat + step[i]).gradient(x, y)[0] - net.at(net.flat - step[i]).gradient(x, y)[0]) / 2e-6
        assert g[i] == pytest.approx(d, abs=1e-5)


def test_one_level_is_the_single_layer_model():
    allowed = multitask.cgc(2, 1)
    one, x = multitask.Mixture(3, allowed, 4), np.random.default_rng(3).normal(size=(6, 3))
    level = multitask.Stacked(3, 2, 1, 1, 1, 4)
    level.w["expert_0"][:], level.w["offset_0"][:] = one.w["expert"].transpose(1, 0, 2), one.w["offset"]
    level.w["gate_0"][:], level.w["tower"][:], level.w["bias"][:] = one.w["gate"].transpose(1, 0, 2), one.w["tower"], one.w["bias"]
    assert np.allclose(one.forward(x)[-1], level.forward(x)[-1])


def test_weights_are_counted_by_kind():
    net = multitask.Stacked(4, 2, 1, 1, 2, 3)
    assert net.parameters() == {"expert": 3 * 4 * 3 + 3 * 3 * 3, "offset": 18, "gate": 3 * 4 * 3 + 2 * 3 * 3, "tower": 6, "bias": 2}
    assert sum(net.parameters().values()) == net.size
    assert multitask.comparable({"a": net, "b": multitask.Selective(4, 2, 60)}, "a") == {"a": True, "b": False}


def test_own_experts_of_a_level_do_not_reach_other_tasks():
    net = multitask.Stacked(3, 2, 1, 1, 1, 4)
    x = np.random.default_rng(1).normal(size=(50, 3))
    before = net.forward(x)[-1].copy()
    net.w["expert_0"][2] += 1.0  # the second task's own
    moved = np.abs(net.forward(x)[-1] - before).max(0)
    assert moved[0] == 0 and moved[1] > 0


def test_an_expert_moves_only_tasks_that_may_use_it():
    net = multitask.Mixture(3, multitask.cgc(2, 1), 4)
    x = np.random.default_rng(1).normal(size=(50, 3))
    before = net.forward(x)[-1].copy()
    net.w["expert"][:, 2] += 1.0  # the second task's own
    moved = np.abs(net.forward(x)[-1] - before).max(0)
    assert moved[0] == 0 and moved[1] > 0


def test_learns_and_ignores_nulls(spark):
    rows = spark.range(2000).select("id", (F.rand(1) * 2 - 1).alias("a"), (F.rand(2) * 2 - 1).alias("b")).selectExpr("id", "a", "b", "1.0 AS one", "CAST(a > 0 AS INT) AS y1", "IF(id % 10 = 0, NULL, CAST(a + b > 0 AS INT)) AS y2")
    net, losses = multitask.fit(rows, ["a", "b", "one"], ["y1", "y2"], multitask.mmoe(2, 3), steps=25)
    assert losses[-1] < 0.6 * losses[0]
    p = multitask.predict(rows, net, ["a", "b", "one"], ["y1", "y2"], ["id"]).where("task = 'y1'").join(rows.select("id", F.col("y1").alias("y")), "id")
    assert metrics.auc(p, ["task"]).first()["auc"] > 0.95
    empty, none = multitask.fit(rows.where("false"), ["a"], ["y1"], multitask.single(1), steps=2)
    assert none == [] and multitask.predict(rows.where("false"), empty, ["a"], ["y1"], ["id"]).count() == 0


def test_query_trains_at_least_the_default_steps(spark, monkeypatch):
    fit, seen = multitask.fit, []

    def noted(rows, features, labels, allowed, steps=20, **more):
        seen.append(steps)
        return fit(rows, features, labels, allowed, steps=1, **more)

    monkeypatch.setattr(multitask, "fit", noted)
    extensions.multitask_auc(spark, SF)
    assert len(seen) == 5 and min(seen) >= 20  # single, MMoE, CGC, PLE, selective


def test_diverse_by_hand(spark):
    scored = spark.createDataFrame([(1, 10, "a", 3.0), (1, 11, "a", 2.0), (1, 12, "a", 1.0), (1, 13, "b", 0.5), (1, 14, None, 0.5)], "q int, video_id int, author string, score double")
    got = [(r["video_id"], r["rank"]) for r in rerank.diverse(scored, ["q"], "author", 2, 10).orderBy("rank").collect()]
    assert got == [(10, 1), (11, 2), (13, 3), (14, 4)]


def test_csv_files_join_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,v\n1,2\n")
    (tmp_path / "b.csv").write_text("v,w\n5,6\n")
    got = {tuple(r) for r in tables.read_csv_files(spark, f"{tmp_path}/*.csv").select("u", "v", "w").collect()}
    assert got == {(1, 2, None), (None, 5, 6)}
    with pytest.raises(Exception):
        tables.read_csv_files(spark, f"{tmp_path}/*.none")


def test_manifest_and_runs(spark, tmp_path):
    for name, text in (("x", "1"), ("y", "2")):
        (tmp_path / f"{name}.bin").write_text(text)
    old = spark.createDataFrame(tables.manifest(spark, f"{tmp_path}/*.bin").collect())
    (tmp_path / "y.bin").write_text("3")
    (tmp_path / "z.bin").write_text("4")
    got = {r["path"][-5]: r["status"] for r in tables.compare_manifests(old, tables.manifest(spark, f"{tmp_path}/*.bin")).collect()}
    assert got == {"x": "same", "y": "changed", "z": "added"}
    for run in ("t_neg5", "t_smoke", "t"):
        (tmp_path / f"{run}.json").write_text(json.dumps({"protocol": "aux" if run == "t" else "main", "recall": 0.5}))
    assert {(r["run"], r["n_neg"]) for r in tables.load_runs(spark, f"{tmp_path}/*.json").collect()} == {("t_neg5", 5), ("t", None)}
    assert tables.load_runs(spark, f"{tmp_path}/*.json", "aux").count() == 1
    assert tables.write_table(spark.range(7), f"{tmp_path}/out") == 7


def test_passes_of_few_rows_sum_to_the_whole(monkeypatch, spark):
    rows = spark.range(500).selectExpr("id % 7 / 7.0 AS a", "1.0 AS one", "CAST(id % 3 = 0 AS INT) AS y").repartition(1)
    whole = multitask.fit(rows, ["a", "one"], ["y"], multitask.single(1), steps=3)[0].flat
    monkeypatch.setattr(multitask, "FEW", 64)
    assert np.allclose(multitask.fit(rows, ["a", "one"], ["y"], multitask.single(1), steps=3)[0].flat, whole)


def test_query_deals_its_rows_evenly(spark, monkeypatch):
    seen = []

    def noted(rows, *more):
        seen.extend(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect())
        raise InterruptedError

    monkeypatch.setattr(multitask, "fit", noted)
    with pytest.raises(InterruptedError):
        extensions.multitask_auc(spark, SF)
    assert len(seen) > 1 and max(seen) < 2 * sum(seen) / len(seen)


def test_passes_in_single_precision_sum_to_the_gradient(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id % 7 / 7.0 AS a", "1.0 AS one", "CAST(id % 3 = 0 AS INT) AS y").repartition(2)
    seen = []
    monkeypatch.setattr(multitask, "descend", lambda packed, net, gradient, *more: seen.append([gradient(net, b) for b in packed.toArrow().to_batches()]) or (net, []))
    net = multitask.fit(rows, ["a", "one"], ["y"], multitask.mmoe(1, 3))[0]
    made = rows.toPandas()
    loss, flat, _ = net.slopes(made[["a", "one"]].to_numpy(float), made[["y"]].to_numpy(float))
    assert np.isclose(sum(x for x, _ in seen[0]), loss, rtol=1e-5) and np.allclose(sum(g for _, g in seen[0]), flat, rtol=1e-4, atol=1e-2) and seen[0][0][1].dtype == np.float64
