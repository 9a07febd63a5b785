"""The full-width workload and the streaming forms against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import kernels as K
from panelcast.operators import evaluate, features, linear, online
from panelcast.streaming.online import error_sums, online_stream, running_score
from panelcast.streaming.panels import windowed_panel
from panelcast.streaming.runs import read_stream, run_appended, run_partials

L, CADENCE, BINS, LAM = 12, 6, 4, 1e-3
BANK = [(0.9, 0.4, 1.0), (0.6, 2.0, 0.3)]


@pytest.fixture(scope="module")
def series():
    return np.random.default_rng(3).normal(size=(160, 2)).cumsum(0) / 4


def panel_of(spark, x):
    return spark.createDataFrame([(f"s{i}", t, float(v)) for i, s in enumerate(x.T) for t, v in enumerate(s)], "series_id string, t long, value double")


def expected(x, horizon, train, first, online_, bank):
    """{(series, t, r): forecast}: dense ridge on all rows that are due, solved anew at every origin."""
    out = {}
    for i, s in enumerate(x.T):
        phi = np.full((len(s), 6 + L + BINS + 2 + 2 * len(bank or ())), np.nan)
        context = np.zeros((len(s), 0))
        if bank:
            h = np.array([[sum(b * (r * np.exp(1j * a)) ** (t - k) * s[k] for k in range(t + 1)) for r, a, b in bank] for t in range(len(s))])
            context = np.concatenate([h.real, h.imag], axis=1)
        for t in range(L - 1, len(s)):
            w = s[t - L + 1 : t + 1]
            mag = np.abs([np.sum(w * np.exp(-2j * np.pi * k * np.arange(L) / L)) for k in range(1, BINS + 1)])
            angle = 2 * np.pi * (t % CADENCE) / CADENCE
            phi[t] = [w.mean(), w.std(), w.min(), w.max(), np.abs(np.diff(w)).mean(), w[-1] - w[-2], *w, *(mag / (mag.sum() + 1e-9)), np.sin(angle), np.cos(angle), *context[t]]
        for r in range(1, horizon + 1):
            p = phi[L - 1 : train - r]
            a, b = p.T @ p, p.T @ s[L - 1 + r : train]
            a = a + LAM * np.trace(a) / len(a) * np.eye(len(a))
            for t in range(first, len(s)):
                if online_:
                    a, b = a + np.outer(phi[t - r], phi[t - r]), b + phi[t - r] * s[t]
                if t + r < len(s):
                    out[f"s{i}", t, r] = phi[t] @ np.linalg.solve(a, b)
    return out


def as_dict(df):
    return {(r["series_id"], r["t"], r["r"]): r["yhat"] for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-6)


@pytest.mark.parametrize("bank", [None, BANK], ids=["plain", "context"])
@pytest.mark.parametrize("update", [False, True], ids=["static", "online"])
def test_sweep_is_dense_ridge(spark, series, update, bank):
    got = online.sweep(panel_of(spark, series), 100, 110, 160, 2, L, CADENCE, BINS, LAM, update, bank)
    close(as_dict(got), expected(series, 2, 100, 110, update, bank))


def test_chunked_path_is_the_sweep(spark, series):
    p = panel_of(spark, series)
    f = features.feature_blocks(p, L, CADENCE, BINS, chunk=37)
    sums = linear.gram(linear.train_pairs(f, 100, 2, L), 2)
    model = linear.solve_relative(sums, LAM)
    whole = {(r["series_id"], r["r"]): r for r in online.fit_series(p, 100, 2, L, CADENCE, BINS, LAM).collect()}
    for r in model.collect():
        np.testing.assert_allclose(r["w"], whole[r["series_id"], r["r"]]["w"], atol=1e-7)
        np.testing.assert_allclose(r["a_inv"], whole[r["series_id"], r["r"]]["a_inv"], rtol=1e-5, atol=1e-6)
    assert len(whole) == 4
    close(as_dict(linear.forecast(f, model, 110, 160, chunk=20)), expected(series, 2, 100, 110, False, None))
    want = expected(series, 2, 100, 110, True, None)
    close(as_dict(online.online_forecast(f, model, 110, 160)), want)
    close(as_dict(online.online_by_chunk(f, 100, LAM, 2, L, 110, 160, 15)), want)
    close(as_dict(online.online_by_chunk(f, 100, LAM, 2, L, 110, 160, 3, fan=2)), want)


def arriving(spark, rows, path, cuts):
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(path)


def test_stream_is_the_batch_pass(spark, series, tmp_path):
    rows = panel_of(spark, series).withColumn("phi", F.array(F.lit(1.0), F.col("value")))
    path = f"file://{tmp_path}/rows"
    arriving(spark, rows, path, [0, 3, 50, 51, 160])
    rows.where("t < 40").coalesce(1).write.mode("append").parquet(path)  # late rows change nothing
    make = lambda: online_stream(read_stream(spark, path, rows.schema, 1), 3, 2, 0.5, 60)
    got = run_appended(make(), "stream").toPandas()
    score = running_score(run_partials(make(), error_sums, "score")).first()
    want = {}
    for i, s in enumerate(series.T):
        phi = np.column_stack([np.ones(160), s])
        made, _, _ = K.online_pass(s, phi, np.arange(1, 4), np.zeros((3, 2)), np.tile(np.eye(2) / 0.5, (3, 1, 1)), 0, 160)
        want |= {(f"s{i}", t, r): (made[t, r - 1], made[t, r - 1] - s[t + r]) for t in range(60, 160) for r in (1, 2, 3) if t + r < 160}
    have = {(a, b, c): (d, e) for a, b, c, d, e in got[["series_id", "t", "r", "yhat", "err"]].itertuples(index=False)}
    assert have.keys() == want.keys()
    np.testing.assert_allclose([have[k] for k in want], list(want.values()), atol=1e-8)
    err = np.array([e for _, e in want.values()])
    np.testing.assert_allclose([score["mse"], score["mae"], score["n"]], [(err**2).mean(), abs(err).mean(), len(err)])


def test_windows_close_behind_the_watermark(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    schema = "series_id string, at timestamp_ntz, amount double"
    for batch in ([("a", "10:05", 1.0), ("a", "10:50", 2.0), ("b", "10:10", 5.0)], [("a", "13:30", 4.0)], [("a", "13:35", 0.0)], [("a", "10:20", 9.0), ("a", "13:40", 1.0)], [("b", "17:00", 1.0)]):
        rows = spark.createDataFrame([(s, f"2024-01-01 {t}:00", v) for s, t, v in batch], "series_id string, at string, amount double")
        rows.withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    out = run_appended(windowed_panel(read_stream(spark, path, schema, 1), "1 hour", "1 hour"), "windows")
    got = {(r["series_id"], r["h"]): r["value"] for r in out.select("series_id", F.hour("at").alias("h"), "value").collect()}
    assert got == {("a", 10): 3.0, ("b", 10): 5.0, ("a", 13): 5.0}  # 10:20 came after its window had closed; 17:00 is still open


def test_signals_run_freely(spark):
    rng = np.random.default_rng(11)
    u = rng.normal(size=(60, 3)) / 3
    rows = spark.createDataFrame([("s", t, v.tolist()) for t, v in enumerate(u)], "series_id string, t long, u array<double>")

    def lifted(past):
        phi = np.concatenate([[1.0], past[-1], past[-3]])
        return np.concatenate([phi, [phi[i] * phi[j] for i in range(len(phi)) for j in range(i, len(phi))]])

    emb = features.delay_signals(rows, 1, 2).withColumn("phi", features.quadratic_lift(F.col("phi"))).orderBy("t").collect()
    assert [r["t"] for r in emb] == list(range(2, 60))
    for r in emb:
        np.testing.assert_allclose(r["phi"], lifted(u[: r["t"] + 1]), atol=1e-12)
    w = rng.normal(size=(len(emb[0]["phi"]), 3)) / 20
    past = list(u[:50])
    for _ in range(4):
        past.append(lifted(past) @ w)
    got = online.free_run_signals(rows, w.ravel().tolist(), 1, 2, 50, 4).orderBy("t").collect()
    np.testing.assert_allclose([r["yhat"] for r in got], past[50:], atol=1e-12)


def test_short_series_are_not_lost(spark, series):
    """Null weights and forecasts for a series that ends before its fit; one that ends early forecasts as far as it goes."""
    cut = panel_of(spark, series).where("series_id <> 's0' OR t < 60").where("series_id <> 's1' OR t < 130")
    w = {r["series_id"]: r["w"] for r in online.fit_series(cut, 100, 2, L, CADENCE, BINS, LAM).where("r = 1").collect()}
    assert w["s0"] is None and w["s1"] is not None
    got = online.sweep(cut, 100, 110, 160, 2, L, CADENCE, BINS, LAM).collect()
    short = [r for r in got if r["series_id"] == "s0"]
    assert len(short) == sum(160 - 110 - r for r in (1, 2)) and all(r["yhat"] is None for r in short)
    assert max(r["t"] for r in got if r["series_id"] == "s1") == 129 and all(r["yhat"] is not None for r in got if r["series_id"] == "s1")
    with pytest.raises(ValueError, match="no window"):
        online.sweep(cut, L, 110, 160, 2, L, CADENCE, BINS, LAM).collect()


@pytest.mark.parametrize("update", [False, True])
def test_scores_are_those_of_the_forecasts(spark, series, update):
    p = panel_of(spark, series)
    want = {r["r"]: r for r in evaluate.step_scores(evaluate.errors(online.sweep(p, 100, 110, 160, 5, L, CADENCE, BINS, LAM, update), p)).collect()}
    got = {r["r"]: r for r in online.sweep_scores(p, 100, 110, 160, 5, L, CADENCE, BINS, LAM, update).collect()}
    assert got.keys() == want.keys()
    for r in got:
        assert got[r]["n"] == want[r]["n"] and got[r]["mse"] == pytest.approx(want[r]["mse"]) and got[r]["mae"] == pytest.approx(want[r]["mae"])


@pytest.mark.parametrize("first,steps,horizon", [(100, 300, 24), (112, 260, 7), (130, 131, 10), (110, 118, 24)])
def test_steps_ahead_share_a_pass(monkeypatch, first, steps, horizon):
    """Up to 24 steps ahead of a wide model come from one pass, with no pass of their own, and are dense ridge solved anew at every origin."""
    x, train, lookback = np.random.default_rng(5).normal(size=steps).cumsum() / 4, 100, 28
    monkeypatch.setattr(K, "SEGMENT", 50)
    monkeypatch.setattr(K, "online_pass", None)
    ahead, got = online._swept(x, train, first, steps, horizon, lookback, CADENCE, BINS, LAM, True, None)
    phi = K.window_features(x, lookback, CADENCE, 0, BINS)
    assert list(ahead) == list(range(1, horizon + 1)) and phi.shape[1] >= K.WIDE and got.shape == (steps - first - 1 if steps == len(x) else steps - first, horizon)
    at = lambda t: phi[t - lookback + 1]
    for r in ahead:
        known = list(range(lookback - 1, train - r))
        a = np.array([at(t) for t in known]).T @ np.array([at(t) for t in known])
        a += LAM * np.trace(a) / len(a) * np.eye(len(a))
        b = sum(at(t) * x[t + r] for t in known)
        for k, t in enumerate(range(first, first + len(got))):
            a, b = a + np.outer(at(t - r), at(t - r)), b + at(t - r) * x[t]
            if k % 13 == 0 or k > len(got) - 3:
                assert got[k, r - 1] == pytest.approx(at(t) @ np.linalg.solve(a, b), abs=1e-7)


@pytest.mark.parametrize("quiet,near", [(0, True), (60, False)])
def test_near_ridges_share_their_products(monkeypatch, quiet, near):
    """Every step ahead as by its own pass, without eigenvectors where the ridges are near each other; where a series wakes up at the train end they are not."""
    lookback, train, first, steps = 28, 100 if quiet else 400, 431, 700
    x = np.random.default_rng(8).normal(size=steps).cumsum() / 4
    x[:quiet] *= 1e-3
    phi = K.window_features(x, lookback, CADENCE, 0, BINS)
    ridge = np.cumsum((phi[: train - lookback] ** 2).sum(1))[train - lookback - np.arange(1, 25)]
    assert (K.near_ridges(ridge)[1] is not None) == near
    w, inv = online._fits(x, phi, train, range(1, 25), lookback, LAM)
    want = K.online_pass(x[lookback - 1 :], phi, np.arange(1, 25), w, inv, first - lookback + 1, steps - lookback)[0]
    monkeypatch.setattr(K, "online_pass", None)
    if near:
        monkeypatch.setattr(np.linalg, "eigh", None)
    ahead, got = online._swept(x, train, first, steps, 24, lookback, CADENCE, BINS, LAM, True, None)
    np.testing.assert_allclose(got, want, atol=1e-7)


def test_near_ridges_in_every_direction():
    """The sum of products is the inverse under each ridge, whatever the eigenvalue; ridges too far apart get none."""
    for apart in (1.0, 1.06, 1.5, 2.0):
        ridge = np.geomspace(0.4, 0.4 * apart, 24)
        mid, terms = K.near_ridges(ridge)
        scale = np.concatenate([[0.0], np.geomspace(1e-6, 1e6, 200)])
        q = mid / (scale + mid)
        np.testing.assert_allclose(sum(np.multiply.outer(q ** (k + 1), c) for k, c in enumerate(terms)), 1 / (scale[:, None] + ridge), rtol=2e-9)
    assert K.near_ridges(np.array([0.01, 1.0]))[1] is None


def test_steps_ahead_beyond_the_shared_pass(spark):
    """26 steps ahead: 24 in one pass, two by their own, all as the forms by chunk make them."""
    x = np.random.default_rng(6).normal(size=(230, 1)).cumsum(0) / 4
    p = panel_of(spark, x)
    f = features.feature_blocks(p, 24, CADENCE, BINS, chunk=60)
    model = linear.solve_relative(linear.gram(linear.train_pairs(f, 120, 26, 24), 26), LAM)
    close(as_dict(online.sweep(p, 120, 140, 230, 26, 24, CADENCE, BINS, LAM)), as_dict(online.online_forecast(f, model, 140, 230)))


def test_features_hold_little_beside_them():
    """Window features are those of every window by itself, and no second matrix of all windows is made on the way."""
    import tracemalloc

    x, lookback, bins = np.random.default_rng(7).normal(size=3000), 96, 8
    tracemalloc.start()
    got = K.window_features(x, lookback, CADENCE, 5, bins)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * got.nbytes
    for t in (0, 1, 127, 128, 2000, len(got) - 1):
        w, angle = x[t : t + lookback], 2 * np.pi * ((5 + lookback - 1 + t) % CADENCE) / CADENCE
        mag = np.abs(np.fft.fft(w)[1 : bins + 1])
        want = [w.mean(), w.std(), w.min(), w.max(), np.abs(np.diff(w)).mean(), w[-1] - w[-2], *w, *(mag / (mag.sum() + 1e-9)), np.sin(angle), np.cos(angle)]
        np.testing.assert_allclose(got[t], want, atol=1e-12)


def test_sweeps_take_arrow_tables(spark, series):
    """No pandas object a row on the way in or out, rows in any order, and a null value makes no forecast up."""
    p = panel_of(spark, series)
    plan = online.sweep(p, 100, 110, 160, 2, L, CADENCE, BINS, LAM)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    got = online.sweep(p.orderBy(F.desc("t")).withColumn("value", F.when(F.col("t") < 155, F.col("value"))), 100, 110, 160, 2, L, CADENCE, BINS, LAM, False)
    assert {r["t"] for r in got.where("yhat IS NULL").collect()} == set(range(155, 159))
    close({k: v for k, v in as_dict(got).items() if k[1] < 155}, {k: v for k, v in expected(series, 2, 100, 110, False, None).items() if k[1] < 155})
