"""Streams in event time against the batch forms: shuffled, late and repeated rows, empty windows, restarts."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import kernels
from panelcast.operators import features as X
from panelcast.operators import online as O
from panelcast.operators import retrieval as H
from panelcast.sources.storage import shared_path
from panelcast.streaming import runs, series

SCHEMA = "series_id string, at timestamp, amount double"


class Source:
    """A folder that rows (series, milliseconds, amount) arrive in, a file a call, and the stream over it."""

    def __init__(self, spark):
        self.spark, self.path, self.out = spark, shared_path(spark, "source"), shared_path(spark, "out")

    def arrive(self, rows):
        df = self.spark.createDataFrame(rows, "series_id string, ms long, amount double")
        df.select("series_id", F.timestamp_millis("ms").alias("at"), "amount").coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return runs.read_stream(self.spark, self.path, SCHEMA, 1)

    def run(self, stream):
        return runs.append(stream, "out", self.out)


def walks(n, names="ab"):
    return {k: np.round(np.cumsum(np.random.default_rng(i).normal(size=n)), 4) for i, k in enumerate(names)}


@pytest.mark.parametrize("horizon,lookback,bins,bank", [(2, 12, 3, ()), (1, 96, 8, ()), (2, 12, 3, ((0.9, 0.3, 1.0), (0.5, 1.1, 0.5)))])
def test_forecasts_from_disordered_rows(spark, horizon, lookback, bins, bank):
    """Shuffled and repeated values, one far too late, in five files, the query stopped twice: what the batch sweep gives, up to the watermark."""
    n, tr, te, rng = 260, 150, 170, random.Random(1)
    x = walks(n)
    rows = sorted(((k, 1000 * t + 500, float(v)) for k in x for t, v in enumerate(x[k])), key=lambda r: r[1] + rng.uniform(0, 8000))
    rows = sorted(rows + rows[::9], key=lambda r: r[1] + rng.uniform(0, 4000))
    src, late, out = Source(spark), 0, None
    for k in range(5):
        src.arrive(rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5] + ([("a", 500, 99.0)] if k == 3 else []))
        if k in (0, 2, 4):
            grid = series.Grid(0, 1000, "16 seconds", "one", None)
            out, query = src.run(series.forecast_steps(src.stream(), grid, tr, te, horizon, lookback, 7, bins, bank=bank))
            late += runs.late_rows(query)
    assert late == 1
    got = {(r["series_id"], r["t"], r["r"]): (r["yhat"], r["err"]) for r in out.collect()}
    panel = spark.createDataFrame([(k, t, float(v)) for k in x for t, v in enumerate(x[k])], "series_id string, t long, value double")
    want = {(r["series_id"], r["t"], r["r"]): r["yhat"] for r in O.sweep(panel, tr, te, n - 16, horizon, lookback, 7, bins, bank=list(bank) or None).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k]) < 1e-6 and abs(got[k][1] - want[k] + x[k[0]][k[1] + k[2]]) < 1e-6 for k in got)


def test_empty_windows_are_zeros_and_sums_add_up(spark):
    src = Source(spark)
    src.arrive([("a", 100, 1.5), ("b", 2500, 2.0), ("a", 900, 0.25)])
    src.arrive([("a", 5200, 4.0), ("b", 5100, -1.0), ("b", 5900, 3.0), ("c", 5000, None), ("a", 5300, -4.0)])
    src.arrive([("b", 9000, 1.0)])
    out, query = src.run(series.dense_steps(src.stream(), series.Grid(0, 1000, "1 seconds")))
    got = {k: [r["value"] for r in sorted(out.where(F.col("series_id") == k).collect(), key=lambda r: r["t"])] for k in "abc"}
    assert got == {"a": [1.75, 0, 0, 0, 0, 0, 0, 0, 0], "b": [0, 0, 2, 0, 0, 2, 0, 0, 0], "c": []}
    assert runs.late_rows(query) == 0


def test_held_values_start_at_the_first_row(spark):
    src = Source(spark)
    src.arrive([("a", 3000, 7.0), ("a", 6000, 8.0), ("a", 6001, 9.0), ("z", 12000, 0.0)])
    out, _ = src.run(series.dense_steps(src.stream(), series.Grid(0, 1000, "1 seconds", "one", None, "first")))
    assert sorted((r["t"], r["value"]) for r in out.where("series_id = 'a'").collect()) == [(3, 7), (4, 7), (5, 7), (6, 8), (7, 8), (8, 8), (9, 8), (10, 8), (11, 8)]


@pytest.mark.parametrize("forget", [None, 6])
def test_idle_series_sleep_and_wake(spark, forget):
    """A silent series gives nothing while it sleeps; on waking the gap is filled, unless it was forgotten and starts anew."""
    src, grid = Source(spark), series.Grid(0, 1000, "1 seconds", since="first", idle=3, forget=forget)
    outs = []
    for k in range(5):
        src.arrive([("clock", 5000 * (k + 1), 1.0), *([("a", 1200, 2.0)] if k == 0 else [("a", 22300, 5.0)] if k == 4 else [])])
        outs.append({(r["t"], r["value"]) for r in src.run(series.dense_steps(src.stream(), grid))[0].where("series_id = 'a'").collect()})
    assert outs[1] == outs[2] == outs[3]
    gap = {(t, 0.0) for t in range(2, 22)}
    assert outs[3] - {(t, 0.0) for t in range(2, 5)} == {(1, 2.0)}
    assert outs[4] - gap - {(23, 0.0), (24, 0.0)} == {(1, 2.0), (22, 5.0)}
    assert (gap <= outs[4]) == (forget is None)


def test_oscillators_of_a_stream_are_those_of_the_panel(spark):
    x, bank, src = walks(120), [(0.5, 0.3, 1.0), (0.99, 1.1, 0.5)], Source(spark)
    rows = [(k, 1000 * t, float(v)) for k in x for t, v in enumerate(x[k])]
    for part in (rows[::2], rows[1::2], [("a", 200_000, 0.0)]):
        src.arrive(part)
        out, _ = src.run(series.oscillator_steps(src.stream(), series.Grid(0, 1000, "300 seconds" if part is not rows[::2] else "300 seconds"), bank))
    assert out.count() == 0  # nothing can be closed yet
    src.arrive([("a", 600_000, 0.0)])
    out, _ = src.run(series.oscillator_steps(src.stream(), series.Grid(0, 1000, "300 seconds"), bank))
    panel = spark.createDataFrame([(k, t, float(v)) for k in x for t, v in enumerate(x[k])], "series_id string, t long, value double")
    for chunk in (None, 50):
        want = {(r["series_id"], r["t"]): r["context"] for r in X.oscillators(panel, bank, chunk).collect()}
        got = {(r["series_id"], r["t"]): r["context"] for r in out.where("t < 120").collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_blocked_recurrence():
    rng = np.random.default_rng(0)
    lam = np.array([0.5 * np.exp(0.3j), 0.999 * np.exp(1.1j), 0.9])
    for n in (0, 1, 31, 32, 33, 1025, 4000):
        x, h, want = rng.normal(size=(n, 3)), np.array([1 + 2j, 0.5, 0]), []
        start = h
        for v in x:
            h = lam * h + v
            want.append(h)
        assert np.allclose(kernels.recurred(x, lam, start), np.array(want).reshape(n, 3))


@pytest.mark.parametrize("svd", [False, True])
def test_subspace_versions_are_batch_steps(spark, svd):
    """Micro-batches are steps, each once, also over restarts and when a batch is run again."""
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=5).tolist(), rng.normal(size=5).tolist(), float(i % 4 > 0)) for i in range(60)]
    schema = "id long, x array<double>, y array<double>, mask double"
    u, v = (np.linalg.qr(rng.normal(size=(5, 2)))[0] for _ in range(2))
    start = spark.createDataFrame([(i, u[i].tolist(), v[i].tolist()) for i in range(5)], "i int, u array<double>, v array<double>")
    path, folder, made = shared_path(spark, "rows"), shared_path(spark, "bases"), []

    def step(bases, batch):
        made.append(1)
        return H.next_bases(bases, batch, 0.3, svd)

    for k in range(3):
        part = spark.createDataFrame(data[20 * k : 20 * k + 20], schema)
        part.write.mode("append").parquet(path)
        out = runs.run_versions(runs.read_stream(spark, path, schema), start, step, "bases", folder)
        u, v = (H.svd_gha_step if svd else H.gha_step)(part, u, v, 0.3)
        if k == 1:  # progress is lost after the version was stored: the batch is run again under its number and changes nothing
            hadoop, fs = spark._jvm.org.apache.hadoop.fs, None
            p = hadoop.Path(f"{folder}-progress/commits/1")
            fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(p, False)
    assert len(made) == 3 and {r["version"] for r in out.select("version").distinct().collect()} == {0, 1, 2, 3}
    got = sorted((r["i"], r["u"], r["v"]) for r in runs.latest(out).collect())
    assert np.allclose([r[1] for r in got], u) and np.allclose([r[2] for r in got], v)


def test_stream_over_one_file_with_odd_name(spark):
    folder = shared_path(spark, "odd") + "[x]" + uuid.uuid4().hex
    spark.range(3).coalesce(1).write.parquet(f"{folder}/raw")
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(f"{folder}/raw")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(f"{folder}/a*b.parquet"))
    fs.mkdirs(hadoop.Path(f"{folder}/axb.parquet"))
    assert runs.is_file(spark, f"{folder}/a*b.parquet") and not runs.is_file(spark, f"{folder}/raw")
