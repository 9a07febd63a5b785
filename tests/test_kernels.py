"""Identities of the dense helpers, and of the distributed paths against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import kernels as K
from panelcast.operators import evaluate, features, linear, online, protocol, retrieval


def panel_of(spark, x):
    rows = [(f"s{i}", t, float(v)) for i, s in enumerate(x.T) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "series_id string, t long, value double")


def test_rls_is_batch_ridge():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 16)), rng.normal(size=30)
    inv, w = np.eye(16), np.zeros(16)
    for a, b in zip(x, y, strict=True):
        inv, w = K.rls_step(inv, w, a, b)
    np.testing.assert_allclose(w, np.linalg.solve(np.eye(16) + x.T @ x, x.T @ y), atol=1e-9)
    np.testing.assert_allclose(inv, np.linalg.inv(np.eye(16) + x.T @ x), atol=1e-9)


def test_gram_schmidt_is_orthonormal():
    q = K.orthonormal(np.random.default_rng(1).normal(size=(20, 6)))
    np.testing.assert_allclose(q.T @ q, np.eye(6), atol=1e-10)


def test_features_equal_helper(spark):
    x = np.random.default_rng(0).normal(size=(40, 2))
    got = features.feature_rows(panel_of(spark, x), 8, 6).orderBy("series_id", "t").toPandas()
    for i in range(2):
        want = K.window_features(x[:, i], 8, 6, bins=7)
        mine = np.array([[np.nan if v is None else v for v in r] for r in got[got.series_id == f"s{i}"].phi][7:], dtype=float)
        assert mine.shape == want.shape == (33, len(features.feature_names(8)))
        np.testing.assert_allclose(mine, want, atol=1e-9)
    whole = got[got.t >= 7].reset_index(drop=True)
    blocks = features.feature_blocks(panel_of(spark, x), 8, 6, chunk=11).orderBy("series_id", "t").toPandas()
    np.testing.assert_allclose(np.array(blocks.phi.tolist()), np.array([list(r) for r in whole.phi], dtype=float), atol=1e-9)
    assert blocks[["series_id", "t", "value"]].equals(whole[["series_id", "t", "value"]])


def test_slice_equals_full_build(spark):
    p = panel_of(spark, np.random.default_rng(0).normal(size=(40, 3)))
    full = features.feature_rows(p, 8, 6).where("t >= 10 AND t < 30").orderBy("series_id", "t").collect()
    part = features.feature_slice(p, 10, 20, 8, 6).orderBy("series_id", "t").collect()
    assert len(full) == len(part) == 60
    for a, b in zip(full, part, strict=True):
        if a["t"] >= 11:
            np.testing.assert_allclose(a["phi"][0:4] + a["phi"][5:], b["phi"][0:4] + b["phi"][5:], atol=1e-12)


def test_static_head_is_dense_ridge(spark):
    x = np.random.default_rng(1).normal(size=(300, 2))
    f = features.feature_rows(panel_of(spark, x), 8, 6)
    model = linear.fit_ridge(f, 240, 3, 8, 1e-2).where("r = 3").orderBy("series_id").collect()
    for i, m in enumerate(model):
        phi = K.window_features(x[:, i], 8, 6, bins=7)[:230]
        a, b = phi.T @ phi, phi.T @ x[10:240, i]
        np.testing.assert_allclose(m["w"], K.relative_ridge(a, b, 1e-2)[0], atol=1e-7)


def test_online_forms_agree_and_do_not_look_ahead(spark):
    x = np.random.default_rng(2).normal(size=(120, 2)).cumsum(0) / 5
    make = lambda p: p.withColumn("phi", F.array(F.lit(1.0), F.col("value")))
    p = make(panel_of(spark, x))
    model = linear.fit_ridge(p, 60, 2, 1)
    whole = online.online_forecast(p, model, 70, 120).orderBy("series_id", "r", "t").toPandas()
    parts = online.online_by_chunk(p, 60, 1e-3, 2, 1, 70, 120, 20).orderBy("series_id", "r", "t").toPandas()
    np.testing.assert_allclose(whole.yhat, parts.yhat, atol=1e-8)
    state = online.online_state(p, model, 70, 95)
    rest = online.online_forecast(p, state, 95, 120).orderBy("series_id", "r", "t").toPandas()
    np.testing.assert_allclose(whole[whole.t >= 95].yhat, rest.yhat, atol=1e-9)
    x2 = x.copy()
    x2[100:] += 7
    other = online.online_forecast(make(panel_of(spark, x2)), model, 70, 120).orderBy("series_id", "r", "t").toPandas()
    np.testing.assert_allclose(whole[whole.t < 100].yhat, other[other.t < 100].yhat, atol=0)
    assert len(whole) == 2 * sum(120 - r - 70 for r in (1, 2))


def test_oscillators_by_chunk(spark):
    p = panel_of(spark, np.random.default_rng(3).normal(size=(50, 2)))
    bank = [(0.9, 0.4, 1.0), (0.6, 2.0, 0.3)]
    a = features.oscillators(p, bank).orderBy("series_id", "t").toPandas()
    b = features.oscillators_by_chunk(p, bank, 7).orderBy("series_id", "t").toPandas()
    np.testing.assert_allclose(np.array(a.context.tolist()), np.array(b.context.tolist()), atol=1e-10)


def test_linear_recurrence_of_several_inputs(spark):
    rng = np.random.default_rng(7)
    x, b = rng.normal(size=(40, 4)), rng.normal(size=(6, 4))
    modes = [(0.95, float(a)) for a in rng.uniform(0, 6, 6)]
    rows = spark.createDataFrame([("s", t, v.tolist()) for t, v in enumerate(x)], "series_id string, t long, x array<double>")
    lam = np.array([r * np.exp(1j * a) for r, a in modes])
    want = np.array([sum((lam ** (t - k) * (b @ x[k]) for k in range(t + 1)), np.zeros(6)).real for t in range(40)])
    for chunk in (None, 9):
        got = features.linear_recurrence(rows, modes, b.tolist(), chunk).orderBy("t").toPandas()
        np.testing.assert_allclose(np.array(got.out.tolist()), want, atol=1e-9)


def test_sums_of_many_batches_of_one_key(spark):
    rng = np.random.default_rng(8)
    phi, y = rng.normal(size=(3000, 3)), rng.normal(size=(3000, 2))
    y[rng.random(3000) < 0.1, 0] = np.nan
    rows = spark.createDataFrame([("s", p.tolist(), [None if np.isnan(v) else float(v) for v in q]) for p, q in zip(phi, y, strict=True)], "series_id string, phi array<double>, y array<double>").repartition(40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # 1,500 batches
    try:
        got = {r["r"]: r for r in linear.gram(rows, 2).collect()}
        parts = spark.range(0, 3000, 1, 1200).selectExpr("'k' AS k", "array(CAST(id AS double), 1.0D) AS a", "1L AS n")
        total = linear.added(parts, ("k",), ("a",), ("n",)).first()
        none = linear.added(parts, (), ("a",)).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in (1, 2):
        ok = ~np.isnan(y[:, r - 1])
        np.testing.assert_allclose(np.array(got[r]["a"]).reshape(3, 3), phi[ok].T @ phi[ok], atol=1e-8)
        np.testing.assert_allclose(got[r]["b"], phi[ok].T @ y[ok, r - 1], atol=1e-8)
        assert got[r]["n"] == ok.sum()
    assert (total["a"], total["n"]) == ([2999 * 1500.0, 3000.0], 3000) and none["a"] == total["a"]


def test_subspace_steps_follow_the_definition(spark):
    rng = np.random.default_rng(9)
    x, y, m = rng.normal(size=(60, 5)), rng.normal(size=(60, 5)), (rng.random(60) < 0.7).astype(float)
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(x, y, m, strict=True)], "x array<double>, y array<double>, mask double")
    u, v = (K.orthonormal(rng.normal(size=(5, 2))) for _ in range(2))
    xm, ym = x * m[:, None], y * m[:, None]
    for step, cu, cv in ((retrieval.gha_step, xm.T @ xm @ u, ym.T @ ym @ v), (retrieval.svd_gha_step, xm.T @ ym @ v, ym.T @ xm @ u)):
        got = step(rows, u, v, 0.3)
        for new, old, c in ((got[0], u, cu / m.sum()), (got[1], v, cv / m.sum())):
            q, r = np.linalg.qr(old + 0.3 * (c - old @ (old.T @ c)))
            np.testing.assert_allclose(new, q * np.sign(np.diag(r)), atol=1e-9)


def test_borders_and_bootstrap_edge(spark):
    assert protocol.fraction_borders(14400) == [("train", 0, 2880), ("val", 2880, 3600), ("test", 3600, 14400)]
    assert protocol.calendar_borders(720, 96)[1] == ("val", 2784, 3600)
    chunks = spark.createDataFrame([(i, 1, float(i + 1), 1.0, 2) for i in range(4)], "chunk_id long, r int, sq double, ab double, n long")
    r = evaluate.bootstrap(chunks, 4, nboot=10).first()
    assert r["degenerate"] and r["mse_se"] == 0


def test_retrieval_slices_equal_whole(spark):
    rng = np.random.default_rng(4)
    q = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(4)], "id long, x array<double>")
    bank = [(rng.normal(size=12).tolist(), rng.normal(size=12).tolist()) for _ in range(5)]
    b = spark.createDataFrame(bank, "key array<double>, value array<double>")
    a = {r["id"]: r["out"] for r in retrieval.refine(q, b, 0.1, 1).collect()}
    c = {r["id"]: r["out"] for r in retrieval._by_slices(q, b, 0.1, 2).collect()}
    k, v = (np.array([x[i] for x in bank]) for i in (0, 1))
    for r in q.collect():
        np.testing.assert_allclose(a[r["id"]], K.softmax_step(np.array([r["x"]]), k, v, 0.1)[0], atol=1e-12)
        np.testing.assert_allclose(a[r["id"]], c[r["id"]], atol=1e-12)


def test_subspace_tracking_finds_the_leading_directions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [3, 2, 1.5] @ K.orthonormal(rng.normal(size=(12, 3))).T + 0.05 * rng.normal(size=(200, 12))
    rows = spark.createDataFrame([(r.tolist(), r.tolist(), 1.0) for r in x], "x array<double>, y array<double>, mask double").cache()
    u = K.orthonormal(rng.normal(size=(12, 3)))
    v = u.copy()
    for _ in range(10):
        u, v = retrieval.gha_step(rows, u, v, 0.2)
    lead = np.linalg.svd(x, full_matrices=False)[2][:3]
    assert np.linalg.svd(lead @ u)[1].min() > 0.99


def test_shape_is_enforced(spark):
    from panelcast.operators import protocol

    p = panel_of(spark, np.zeros((5, 2)))
    assert protocol.of_shape(p, 2, 5) is p
    with pytest.raises(ValueError, match="expected 2 series of 6 steps, found 2 of 5 with 10 rows"):
        protocol.of_shape(p, 2, 6)
