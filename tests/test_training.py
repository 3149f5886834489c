"""Exact selection, encoder, seeded epochs, vector sums, saved weights, training over embedded channels."""

import collections
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import epochs, multitask, order, ranking, selection, spec
from feedloom.operators.stage import Stage
from feedloom.operators.vectors import vector_sum
from feedloom.sources import weights

# ---- exact order statistics


def test_medians_are_exact_whatever_the_values(spark):
    rng = np.random.default_rng(1)
    columns = {
        "even": rng.normal(size=400).tolist(), "odd": [*rng.integers(-5, 6, 399).tolist(), None], "skew": np.exp(rng.normal(0, 30, 400)).tolist(),
        "huge": [1.7e308, -1.7e308, 0.0, 5e-324] * 100, "same": [2.0] * 400, "none": [None] * 400, "odd_values": [float("nan"), float("inf"), 1.0, 2.0] * 100, "ties": [1.0] * 200 + [3.0] * 200,
    }
    rows = [tuple(None if x is None else float(x) for x in r) for r in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = selection.medians(df, list(columns), bins=8)
    for c, values in columns.items():
        known = [x for x in values if x is not None and np.isfinite(x)]
        assert got[c] == (statistics.median(known) if known else None), c
    assert selection.medians(df.limit(0), ["even"]) == {"even": None} and selection.medians(df, []) == {}
    ranks = selection.at_ranks(df, {"odd": [0, 10, 398, 399]}, bins=3)
    ordered = sorted(x for x in columns["odd"] if x is not None)
    assert ranks == {("odd", r): float(ordered[r]) for r in (0, 10, 398)}


def test_encoder_counts_known_rows_only_for_numbers_and_samples_for_counts(spark):
    rows = spark.createDataFrame([(1, 0, 10.0, "b", 0.5, 1), (2, 8, None, "a", None, None), (3, None, 20.0, None, 0.1, None), (4, 2, 50.0, "a", 0.2, 1)], "id long, n long, size double, kind string, rate double, flag int").withColumn("one", F.lit("x"))
    kinds = {"n": "count", "size": "numeric", "kind": "category", "rate": "smooth", "flag": "zero", "one": "category"}
    made = spec.fit(rows, kinds, {"rate": 0.3})
    logs = np.log1p([10.0, 20.0, 50.0])
    assert made.dropped == ["one"] and made.numbers["size_fill"] == 20.0
    assert np.allclose([made.numbers["size_mean"], made.numbers["size_std"]], [logs.mean(), logs.std(ddof=1)])
    out = {r["id"]: r for r in spec.apply(spec.with_cold_row(rows, "id"), made, "id").collect()}
    counts = np.log1p([0.0, 8.0, 0.0, 2.0])
    assert np.isclose(out[2]["n"], (counts[1] - counts.mean()) / counts.std(ddof=1)) and np.isclose(out[2]["size"], (np.log1p(20.0) - logs.mean()) / logs.std(ddof=1))
    assert (out[0]["kind"], out[1]["kind"], out[2]["kind"], out[3]["kind"]) == (0, 2, 1, 0)
    assert (out[0]["rate"], out[0]["flag"], out[0]["n"]) == (0.3, 0.0, out[3]["n"]) and out[0]["size"] == out[2]["size"]
    samples = spark.createDataFrame([(8,), (8,), (None,), (8,)], "n long")
    weighed = np.log1p([8.0, 8.0, 0.0, 8.0])
    assert np.isclose(spec.fit(rows, kinds, {"rate": 0.3}, samples).numbers["n_mean"], weighed.mean())
    constant = spec.fit(rows.withColumn("n", F.lit(3)), {"n": "count"})
    assert constant.numbers["n_std"] == 1.0
    assert spec.apply(rows.drop("rate"), made, "id").columns == ["id", "n", "size", "kind", "flag"]


# ---- epochs

@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 101, 1000])
def test_every_row_has_one_place_in_every_epoch(spark, n):
    rows = spark.range(n)
    seen = set()
    for seed, epoch in ((1, 1), (1, 2), (2, 1)):
        got = [r[0] for r in rows.select(epochs.permuted(F.col("id"), n, seed, epoch).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert got == [r[0] for r in rows.repartition(3).select("id", epochs.permuted(F.col("id"), n, seed, epoch).alias("p")).orderBy("id").select("p").collect()]
        seen.add(tuple(got))
    assert len(seen) == 3 or n <= 10


def test_places_look_random_and_batches_are_whole(spark):
    n, size = 4000, 256
    got = epochs.batched(spark.range(n), "id", n, size, 7, 3).collect()
    places = np.array([r["place"] for r in got])
    assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.05 and np.mean(np.diff(places) == 1) < 0.01
    sizes = collections.Counter(r["batch"] for r in got)
    assert sorted(sizes) == list(range(epochs.steps(n, size))) and [sizes[k] for k in sorted(sizes)] == [size] * (n // size) + [n % size]
    spread = [r["id"] for r in got if r["batch"] == 0]
    assert abs(np.mean(spread) - n / 2) < 4 * n / np.sqrt(12 * size)
    with pytest.raises(ValueError):
        epochs.batched(spark.range(3), "id", 3, 0, 1, 1)
    with pytest.raises(Exception, match="outside the epoch"):
        spark.range(5).select(epochs.permuted(F.col("id"), 4, 1, 1)).collect()
    assert spark.range(1).select(epochs.permuted(F.lit(None).cast("long"), 4, 1, 1)).first()[0] is None


# ---- sums of vectors, weights

def test_vector_sums(spark):
    x = np.random.default_rng(2).normal(size=(50, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(9)
    for parts in (1, 9, 100):
        assert np.allclose(vector_sum(df, parts), x.sum(0))
    assert vector_sum(df.limit(0), 4) is None


def test_weights_come_back_bit_for_bit_and_in_parts(spark, tmp_path):
    arrays = {"a": np.arange(10.0).reshape(2, 5), "b": np.array([-0.0, np.nan, 1e-310]), "empty": np.zeros((0, 3)), "one": np.array(3.5)}
    table = weights.as_table(spark, arrays, run=4)
    path = str(tmp_path / "w")
    weights.save(table, path)
    got = weights.to_arrays(weights.load(spark, path))
    assert set(got) == set(arrays) and all(got[k].shape == x.shape and got[k].tobytes() == x.astype(float).tobytes() for k, x in arrays.items())
    assert weights.differences(table, weights.load(spark, path)).count() == 0
    only = weights.load(spark, path, ["a"])
    assert "PartitionFilters" in (p := only._jdf.queryExecution().toString()) and "name" in p.split("PartitionFilters")[1][:80] and set(weights.to_arrays(only)) == {"a"}
    with pytest.raises(Exception, match="already exists"):
        weights.save(table, path)
    other = weights.as_table(spark, arrays | {"b": np.array([0.0, np.nan, 1e-310])}, run=4)
    assert {tuple(r) for r in weights.differences(table, other).collect()} == {("first", "b", 0), ("second", "b", 0)}
    damaged = table.withColumn("values", F.when((F.col("name") == "a") & (F.col("position") == 4), F.transform("values", lambda v: v + 1)).otherwise(F.col("values")))
    with pytest.raises(ValueError, match="digest"):
        weights.to_arrays(damaged)
    with pytest.raises(ValueError, match="missing"):
        weights.to_arrays(table.where("NOT (name = 'a' AND position = 4)"))


# ---- nets and embeddings

NETS = [multitask.Mixture(6, multitask.mmoe(2, 3), 4), multitask.Mixture(6, multitask.single(2), 4), multitask.Mixture(6, multitask.cgc(2, 2), 4), multitask.Stacked(6, 2, width=4), multitask.Selective(6, 2, 5, 3)]


@pytest.mark.parametrize("net", NETS, ids=["mmoe", "single", "cgc", "ple", "selective"])
def test_slopes_of_the_input(net):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5, 6)), rng.integers(0, 2, (5, 2)).astype(float)
    y[0, 0] = np.nan
    dx, eps = net.slopes(x, y)[2], 1e-6
    for i, j in ((0, 0), (2, 3), (4, 5)):
        up, down = x.copy(), x.copy()
        up[i, j] += eps
        down[i, j] -= eps
        assert np.isclose(dx[i, j], (net.slopes(up, y)[0] - net.slopes(down, y)[0]) / (2 * eps), atol=1e-6)


def _small(spark):
    layout = ranking.Layout([ranking.Embedded("hist", "item", 3), ranking.Embedded("item", "item", 3), ranking.Embedded("user", "user", 2), ranking.Dense("dense", ("x0", "known"))])
    rows = [(0, [2, 3, 3, 0], 2, 2, 0.5, 1.0, 1.0, 0.0), (1, [], 3, 3, -1.0, 1.0, 0.0, 1.0), (2, None, None, 2, 0.1, 0.0, 1.0, 1.0), (3, [1, 2], 4, 3, 0.7, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "number long, hist array<int>, item int, user int, x0 double, known double, a double, b double")
    look = layout.lookups({"hist": ranking.listed(F.col("hist")), "item": F.col("item"), "user": F.col("user")}, masked=(0, 1))
    packed = df.select("number", look.alias("look"), F.array("x0", "known").alias("x"), F.array("a", "b").alias("y"))
    ids = spark.createDataFrame([("item", i) for i in (2, 3, 4)] + [("user", 2), ("user", 3)], "table string, id long")
    return layout, packed, ranking.fresh_tables(ids, layout.widths, 1, scale=0.5)


def test_embedded_input_is_the_masked_mean_and_holes_are_unknown(spark):
    layout, rows, tables = _small(spark)
    w = {(r["table"], r["id"]): np.array(r["w"]) for r in tables.collect()}
    assert not w["item", 0].any() and w["item", 1].any() and layout.fingerprint() == [("hist", 3), ("item", 3), ("user", 2), ("dense", 2)]
    e = {r["number"]: np.array(r["e"]) for r in ranking.embedded_input(rows, tables, layout).collect()}
    assert np.allclose(e[0][:3], (w["item", 2] + 2 * w["item", 3]) / 3) and not e[1][:3].any() and not e[2][:3].any()
    assert np.allclose(e[3][:3], w["item", 2]) and np.allclose(e[2][3:6], w["item", 1]) and np.allclose(e[1][6:], w["user", 3])
    with pytest.raises(Exception, match="no vector for user 3"):
        ranking.embedded_input(rows, tables.where("NOT (table = 'user' AND id = 3)"), layout).collect()
    with pytest.raises(ValueError, match="differ in width"):
        ranking.Layout([ranking.Embedded("a", "t", 2), ranking.Embedded("b", "t", 3)])
    normal = ranking.fresh_tables(spark.range(2, 3000).select(F.lit("item").alias("table"), "id"), {"item": 4}, 5, 1.0)
    all_w = np.array([r["w"] for r in normal.where("id > 0").collect()])
    assert abs(all_w.mean()) < 0.05 and abs(all_w.std() - 1) < 0.05


@pytest.mark.parametrize("k", range(5))
def test_slopes_of_tables_and_layers_against_differences(spark, k):
    layout, rows, tables = _small(spark)
    net = (multitask.Mixture(layout.size, multitask.mmoe(2, 3), 4), multitask.Mixture(layout.size, multitask.single(2), 4), multitask.Mixture(layout.size, multitask.cgc(2, 2), 4), multitask.Stacked(layout.size, 2, width=4), multitask.Selective(layout.size, 2, 5, 3))[k]
    stage, eps = Stage(spark), 1e-5
    n, loss, flat, by_id = ranking.slopes(rows, tables, net, layout, stage)
    got = {(r["table"], r["id"]): r["g"] for r in by_id.collect()}
    assert n == 4 and ("item", 0) not in got and len(got["user", 2]) == 2
    at = {r["number"]: r for r in ranking.embedded_input(rows, tables, layout).collect()}
    w = {(r["table"], r["id"]): np.array(r["w"]) for r in tables.collect()}

    def total(key, i, step):
        """Loss with one number of one vector moved, from the lookups themselves."""
        x = []
        for r in sorted(at.values(), key=lambda r: r["number"]):
            e = np.array(r["e"])
            for l in r["look"]:
                if (l["table"], l["id"]) == key:
                    e[l["off"] + i] += step * l["share"]
            x.append(np.concatenate([e, r["x"]]))
        return net.slopes(np.array(x), np.array([r["y"] for r in sorted(at.values(), key=lambda r: r["number"])]))[0]

    assert np.isclose(loss, total(("item", 2), 0, 0.0))
    for key in (("item", 2), ("item", 1), ("user", 3)):
        for i in range(len(w[key])):
            assert np.isclose(got[key][i], (total(key, i, eps) - total(key, i, -eps)) / (2 * eps), atol=1e-5)
    assert len(flat) == net.size


def test_training_learns_is_repeatable_and_leaves_what_it_never_saw(spark):
    rng = np.random.default_rng(6)
    items = rng.integers(2, 12, 300)
    rows = spark.createDataFrame([(k, int(i), float(i % 2), float(rng.random() < 0.5)) for k, i in enumerate(items)], "number long, item int, a double, b double")
    layout = ranking.Layout([ranking.Embedded("item", "item", 4), ranking.Dense("one", ("one", "known"))])
    packed = rows.select("number", layout.lookups({"item": F.col("item")}).alias("look"), F.array(F.lit(1.0), F.lit(1.0)).alias("x"), F.array("a", "b").alias("y"))
    tables = ranking.fresh_tables(spark.range(2, 14).select(F.lit("item").alias("table"), "id"), layout.widths, 1, 0.3)
    net = multitask.Mixture(layout.size, multitask.mmoe(2, 2), 4)
    made = ranking.train(packed, tables, net, layout, 300, 100, epochs=3, rate=0.2)
    assert len(made.losses) == 9 and made.losses[-1] < made.losses[0] - 0.05
    p = ranking.predict(packed.join(rows.select("number", "a"), "number"), made, layout, ["a", "b"], ["number", "a"])
    right = p.where("task = 'a'").select(F.avg(((F.col("p") > 0.5) == (F.col("a") == 1)).cast("double"))).first()[0]
    assert right > 0.95
    first, last = ({r["id"]: r["w"] for r in t.collect()} for t in (tables, made.tables))
    assert last[12] == first[12] and last[0] == [0.0] * 4 and last[5] != first[5]
    again = ranking.train(packed.repartition(2), tables, net, layout, 300, 100, epochs=3, rate=0.2)
    assert np.allclose(again.net.flat, made.net.flat, atol=1e-9)
    hidden = ranking.with_id_dropout(packed, layout, "item", 0.3, "known", 1, 1).collect()
    dropped = [r for r in hidden if r["look"][0]["id"] == 1]
    assert 0.15 < len(dropped) / 300 < 0.45 and all(r["x"][1] == 0.0 for r in dropped) and all(r["x"] == [1.0, 1.0] for r in hidden if r["look"][0]["id"] != 1)
    with pytest.raises(ValueError):
        ranking.with_id_dropout(packed, layout, "item", 1.0, None, 1, 1)
    with pytest.raises(ValueError, match="has no rows"):
        ranking.train(packed.where("number < 0"), tables, net, layout, 300, 100)
    bad = packed.withColumn("x", F.array(F.lit(float("inf")), F.lit(1.0)))
    with pytest.raises(Exception, match="not finite"):
        ranking.train(bad, tables, net, layout, 300, 300)


def test_a_large_batch_is_dealt_to_many_parts_and_read_alone(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ranking, "DEALT", 50)
    rows = spark.range(1000).select(F.col("id").alias("number"))
    got = ranking.dealt(rows, 1000, 500, 1, 1)
    parts = got.groupBy(F.spark_partition_id().alias("p"), "batch").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) <= 300 and sum(r["count"] for r in parts) == 1000
    read = Stage(spark).write(got, "epoch", by="batch").where("batch = 1")
    assert read.count() == 500 and all("batch=1" in f for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert [r["n"] for r in ranking.dealt(rows, 1000, 3, 1, 1).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [3] * 333 + [1]


def test_slopes_are_summed_by_id_within_a_task(spark, monkeypatch):
    layout, rows, tables = _small(spark)
    net, stage = multitask.Mixture(layout.size, multitask.single(2), 4), Stage(spark)
    want = {(r["table"], r["id"]): r["g"] for r in ranking.slopes(rows, tables, net, layout, stage)[3].collect()}
    sums = ranking._Sums(layout)
    monkeypatch.setattr(ranking, "HELD", 2)
    filled = ranking.embedded_input(rows, tables, layout).select("look", "e", "x", "y").toArrow().combine_chunks()
    for b in filled.to_batches(max_chunksize=1) * 3:
        dx = net.slopes(ranking._inputs(b), ranking._matrix(b.column("y"), b.num_rows))[2]
        sums.add(b.column("look"), dx)
    got = [(t, i, g) for b in sums.give() for t, i, g in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {(t, i) for t, i, _ in got} == set(want) and len(got) == len(want) and sums.size == 0
    assert all(np.allclose(g, 3 * np.array(want[t, i])) for t, i, g in got)


def test_slices_of_an_order_count_bounds_at_most_the_key(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(-3, 40)] + [(None, 1)], "a long, b int")
    for n in (1, 2, 7, 12):
        bounds = [(3 * i, 1) for i in range(n)]
        got = rows.select("a", "b", order._slice(rows, [F.col("a")], [(x,) for x, _ in bounds]).alias("one"), order._slice(rows, [F.col("a"), F.col("b")], bounds).alias("two")).collect()
        for r in got:
            assert r["one"] == (0 if r["a"] is None else sum(x <= r["a"] for x, _ in bounds))
            assert r["two"] == (0 if r["a"] is None else sum(x <= (r["a"], r["b"]) for x in bounds))
    with_null = order._slice(rows, [F.col("a")], [(None,), (5,)])
    assert rows.select(with_null.alias("s")).distinct().count() == 2


def _learnable(spark, n=600):
    rng = np.random.default_rng(6)
    items = rng.integers(2, 12, n)
    rows = spark.createDataFrame([(k, int(i), [int(i), int(j)], float(i % 2), float(rng.random() < 0.5)) for k, (i, j) in enumerate(zip(items, rng.integers(2, 12, n), strict=True))], "number long, item int, hist array<int>, a double, b double")
    layout = ranking.Layout([ranking.Embedded("hist", "item", 4), ranking.Embedded("item", "item", 4), ranking.Dense("one", ("one", "known"))])
    look = layout.lookups({"hist": ranking.listed(F.col("hist")), "item": F.col("item")})
    packed = rows.select("number", look.alias("look"), F.array(F.lit(1.0), F.lit(1.0)).alias("x"), F.array("a", "b").alias("y"))
    tables = ranking.fresh_tables(spark.range(2, 14).select(F.lit("item").alias("table"), "id"), layout.widths, 1, 0.3)
    return layout, packed, tables, {"mmoe": multitask.Mixture(layout.size, multitask.mmoe(2, 2), 4), "ple": multitask.Stacked(layout.size, 2, width=4)}


def test_one_part_takes_the_steps_of_plain_training_for_every_model(spark):
    layout, packed, tables, nets = _learnable(spark)
    made = ranking.train_by_parts(packed, tables, nets, layout, 600, 100, 2, 42, 0.05, ("item", 0.2, "known"))
    vectors = {r["id"]: np.array(r["s"]).reshape(3, 2, 4) for r in made.tables.collect()}
    for j, (name, net) in enumerate(nets.items()):
        plain = ranking.train(packed, tables, net, layout, 600, 100, 2, 42, 0.05, ("item", 0.2, "known"))
        assert np.allclose(made.nets[name].flat, plain.net.flat, atol=1e-6)
        for r in plain.tables.collect():
            assert np.allclose(vectors[r["id"]][:, j], [r["w"], r["m"], r["v"]], atol=1e-6)
        p = {tuple(r["y"]): r["p"] for r in ranking.predict(packed.where("number < 2"), plain, layout, ["a", "b"], ["number", "y"]).where("task = 'a'").collect()}
        got = ranking.predict_models(packed.where("number < 2"), made, layout, ["a", "b"]).where(F.col("model") == name)
        assert sorted(r["p"] for r in got.where("task = 'a'").collect()) == pytest.approx(sorted(p.values()), abs=1e-6)


def test_many_parts_train_every_batch_and_learn(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STEPS", 2)
    layout, packed, tables, nets = _learnable(spark, 2000)
    made = ranking.train_by_parts(packed, tables, nets, layout, 2000, 50, 2, rate=0.1)
    assert len(made.losses) == 8 and all(made.losses[-1][name] < made.losses[0][name] - 0.1 for name in nets)
    p = ranking.predict_models(packed, made, layout, ["a", "b"])
    assert p.count() == 2000 * 4
    right = {r["model"]: r["right"] for r in p.where("task = 'a'").groupBy("model").agg(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")).alias("right")).collect()}
    assert set(right) == set(nets) and min(right.values()) > 0.95
    first, last = {r["id"]: r["w"] for r in tables.collect()}, {r["id"]: r["s"] for r in made.tables.collect()}
    assert last[12][:4] == first[12] and not any(last[0]) and last[5][:4] != first[5]
    again = ranking.train_by_parts(packed.repartition(3), tables, nets, layout, 2000, 50, 2, rate=0.1)
    assert all(np.allclose(again.nets[k].flat, made.nets[k].flat, atol=1e-9) for k in nets)
    with pytest.raises(ValueError, match="don't run from 0"):
        ranking.train_by_parts(packed.where("number <> 7"), tables, nets, layout, 2000, 50)
    with pytest.raises(Exception, match="no vector for item 3"):
        ranking.train_by_parts(packed, tables.where("id <> 3"), nets, layout, 2000, 50)
    with pytest.raises(Exception, match="not finite"):
        ranking.train_by_parts(packed.withColumn("x", F.array(F.lit(float("inf")), F.lit(1.0))), tables, nets, layout, 2000, 50)


def test_query_takes_a_step_for_each_batch_of_the_reference(spark, monkeypatch):
    from feedloom.plans import ranking as plans

    seen = []

    def noted(rows, tables, nets, layout, n, size, epochs=1, *more):
        seen.append((n, size, epochs, len(nets), rows.count(), rows._jdf.queryExecution().executedPlan().toString()))
        raise InterruptedError

    monkeypatch.setattr(ranking, "train_by_parts", noted)
    with pytest.raises(InterruptedError):
        plans.ranking_embedded_auc(spark, "/root/testdata/sf0.001")
    n, size, epochs, nets, rows, plan = seen[0]
    assert size == 2048 and epochs == 1 and nets == 5 and n == rows > 0
    assert plan.count("SortMergeJoin") >= 3  # user, item and pair features are arrays, whose size Spark takes too low to broadcast
