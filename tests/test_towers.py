"""Two towers: gradients against differences, losses and vectors against plain code, learning, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import retrieval, towers

SCHEMA = "row_id long, video_id long, hist array<long>, a double"


def naive_loss(net, dense, history, ids, side, log_q):
    total = 0.0
    w, unit = net.w, lambda z: z / (np.linalg.norm(z) + 1e-9)
    for x, h, c, s, q in zip(dense, history, ids, side, log_q, strict=True):
        real = [w["embedding"][i] for i in h if i]
        u = unit(np.maximum(np.r_[x, np.mean(real, 0) if real else np.zeros(w["embedding"].shape[1])] @ w["user_in"], 0) @ w["user_out"])
        scores = []
        for k, (i, f) in enumerate(zip(c, s, strict=True)):
            if k and i == c[0] and (f == s[0]).all():
                continue
            v = unit(np.maximum(np.r_[w["embedding"][i], f] @ w["item_in"], 0) @ w["item_out"])
            scores.append(float(u @ v) / net.temperature - q[k])
        total += np.log(np.exp(scores).sum()) - scores[0]
    return total


@pytest.mark.parametrize("side", [0, 2])
def test_loss_and_gradient(side):
    rng = np.random.default_rng(0)
    net = towers.Towers(3, side, rows=12, width=4, hidden=6, out=5, temperature=0.7)
    dense, history = rng.normal(size=(7, 3)), [rng.integers(0, 12, n) for n in (0, 1, 3, 5, 2, 0, 4)]
    ids, log_q = rng.integers(1, 12, (7, 5)), rng.normal(size=(7, 5))
    ids[0, 2] = ids[0, 0]
    given = (dense, history, ids, rng.normal(size=(7, 5, side)), log_q)
    loss, g = net.gradient(*given)
    assert loss == pytest.approx(naive_loss(net, *given), rel=1e-6)
    step = np.eye(net.size) * 1e-6
    for i in rng.choice(net.size, 80, replace=False):
        d = (net.at(net.flat + step[i]).gradient(*given)[0] - net.at(net.flat - step[i]).gradient(*given)[0]) / 2e-6
        assert g[i] == pytest.approx(d, abs=2e-5)


def test_learns_what_follows_a_history(spark):
    """The target is always the item after the one in the history, so it must rank high for each history."""
    n = 12
    rows = spark.range(600).select(F.col("id").alias("row_id"), ((F.col("id") + 1) % n).alias("video_id"), F.array(F.col("id") % n).alias("hist"), F.lit(None).cast("double").alias("a"))
    items = spark.range(n).select(F.col("id").alias("video_id"), F.lit(0.0).alias("log_q"))
    negatives = retrieval.random_negatives(rows, "row_id", 4, 0, n - 1)
    start = towers.Towers(1, rows=512, seed=3)
    net, losses = towers.fit(rows, negatives, items, start, ["a"], [], steps=60)
    assert losses[-1] < 0.6 * losses[0]
    asked = rows.where(f"row_id < {n}")
    top = retrieval.exact_top_k(towers.user_vectors(asked, net, ["a"]), towers.item_vectors(items, net, []), 3)
    found = top.join(asked, top.query_id == asked.row_id).where("item_id = video_id").count()
    assert found >= 0.75 * n


def test_edges(spark):
    items = spark.createDataFrame([(1, 0.0), (2, None)], "video_id long, log_q double")
    rows = spark.createDataFrame([(1, 1, None, None), (2, 99, [1], 1.0), (3, 2, [], 2.0), (4, None, [7, None], 1.0)], SCHEMA)
    negatives = spark.createDataFrame([(i, 0, 3 - (i % 2 or 2)) for i in (1, 2, 3, 4)], "row_id long, slot int, negative long")
    net, losses = towers.fit(rows, negatives, items, towers.Towers(1, rows=8), ["a"], [], steps=2)
    assert len(losses) == 2 and np.isfinite(net.flat).all()  # rows 2 and 4 have unknown targets
    got = towers.user_vectors(rows, net, ["a"]).collect()
    assert len(got) == 4 and all(np.isfinite(r["q"]).all() for r in got)
    same, none = towers.fit(rows.limit(0), negatives, items, net, ["a"], [], steps=2)
    assert none == [] and np.array_equal(same.flat, net.flat)
    assert towers.user_vectors(rows.limit(0), net, ["a"]).count() == 0 and towers.item_vectors(items.limit(0), net, []).count() == 0


def test_history_means_by_rows_are_those_of_a_loop():
    history = [np.array([3, 0, 3, 1]), np.zeros(0, int), np.array([0, 0]), np.array([2])]
    net = towers.Towers(1, rows=5)
    whose, real, share = towers._members(history)
    got = towers._rows_summed(whose, net.w["embedding"][real] * share[:, None], len(history))
    want = [net.w["embedding"][h[h > 0]].mean(0) if (h > 0).any() else np.zeros(8) for h in history]
    assert np.allclose(got, want) and net.users(np.ones((4, 1)), history)[2].shape == (4, 8)
