"""The forms for very long series and very many rows: counted quantiles, sums kept as a table, transforms in chunks, scans; each against NumPy or a refit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import kernels
from panelcast.operators import linear, maintained, quantiles, retrieval, spectra
from panelcast.sources import panels, storage
from panelcast.sources.storage import shared_path
from panelcast.streaming import runs


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "tiny", "huge", "one"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(4)
    x = {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(0, 5, size=3000).astype(float),
        "wide": np.exp(rng.normal(size=3000) * 60),
        "tiny": rng.integers(1, 9, size=500) * 5e-324,
        "huge": np.array([-1.7e308, 1.7e308, 1.0, 2.0, 3.0] * 50),
        "one": np.array([7.0]),
    }[kind]
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan"))], "k int, v double")
    for q in (0.0, 0.37, 0.5, 0.995, 1.0):
        got = quantiles.exact_quantiles(df, "v", q, bins=7, small=5).collect()
        s = np.sort(x)
        at = int(np.floor(q * (len(x) - 1)))
        part = q * (len(x) - 1) - at
        want = s[at] + (s[min(at + 1, len(s) - 1)] - s[at]) * part if part > 0 else s[at]
        assert [r["quantile"] for r in got] == [pytest.approx(want, rel=1e-12, abs=0)]
    if kind != "one":
        got = {r["k"]: r["quantile"] for r in quantiles.exact_quantiles(df, "v", 0.9, ("k",), bins=4, small=3).collect()}
        want = {r["k"]: r["p"] for r in df.where("NOT isnan(v)").groupBy("k").agg(F.percentile("v", 0.9).alias("p")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, "v", 0.5).collect() == []


def panel_of(spark, x):
    return spark.createDataFrame([(f"s{i}", t, float(v)) for i, c in enumerate(x.T) for t, v in enumerate(c)], "series_id string, t long, value double")


@pytest.mark.parametrize("n", [40, 600, 599, 601, 1250])
def test_periodogram_in_chunks(spark, n):
    """Short enough for one task; factors; primes, by the chirp; about 50 values a task."""
    x = np.random.default_rng(n).normal(size=(n, 2)).cumsum(0)
    got = spectra.periodogram(panel_of(spark, x), 50).orderBy("series_id", "k").toPandas()
    for i in range(2):
        want = np.abs(np.fft.rfft(x[:, i] - x[:, i].mean())) ** 2
        mine = got[got.series_id == f"s{i}"]
        assert mine.k.tolist() == list(range(n // 2 + 1))
        np.testing.assert_allclose(mine.power, want, rtol=1e-6, atol=1e-6 * want.max())


def test_transform_tasks_hold_few_values(spark):
    """No task of the long form gets more than ``most`` values of a series."""
    assert spectra.factors(1250, 50) == (25, 50) and spectra.factors(601, 50) is None
    with pytest.raises(ValueError, match="tasks that hold"):
        spectra.fourier(panel_of(spark, np.zeros((601, 1))).selectExpr("series_id", "t", "value AS re", "0D AS im"), 601, 30)


@pytest.mark.parametrize("lags,chunk", [(5, 10), (12, 7), (30, 4096), (80, 20)])
def test_autocorrelation_with_halo(spark, lags, chunk):
    x = np.random.default_rng(6).normal(size=(75, 2)).cumsum(0)
    got = {(r["series_id"], r["lag"]): r["acf"] for r in spectra.autocorrelation(panel_of(spark, x), lags, chunk).collect()}
    for i in range(2):
        c = x[:, i] - x[:, i].mean()
        for k in range(lags + 1):
            assert got[f"s{i}", k] == pytest.approx((c[: max(0, 75 - k)] @ c[k:] if k < 75 else 0.0) / (c @ c), abs=1e-9)


@pytest.mark.parametrize("n,fan", [(1, 4), (4, 4), (5, 4), (23, 3), (64, 2)])
def test_prefix_sums(spark, n, fan):
    x = np.random.default_rng(7).normal(size=(2, n, 3))
    rows = spark.createDataFrame([(f"s{i}", t, x[i, t].tolist(), [float(t)]) for i in range(2) for t in range(n)], "series_id string, chunk long, a array<double>, b array<double>").repartition(5)
    got = {(r["series_id"], r["chunk"]): (r["a"], r["b"]) for r in linear.prefix_sums(rows, ("series_id",), "chunk", ("a", "b"), n, fan).collect()}
    assert len(got) == 2 * n
    for i in range(2):
        for t in range(n):
            np.testing.assert_allclose(got[f"s{i}", t][0], x[i, :t].sum(0), atol=1e-12)
            assert got[f"s{i}", t][1] == [float(sum(range(t)))]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5])
def test_gram_with_missing_targets(spark, share):
    """Few missing rows go as rows, many as sums: the same per-step sums as row by row."""
    rng = np.random.default_rng(8)
    phi, y = rng.normal(size=(200, 4)), rng.normal(size=(200, 3))
    y[rng.random(size=y.shape) < share] = np.nan
    rows = spark.createDataFrame([("a", phi[i].tolist(), [None if np.isnan(v) else float(v) for v in y[i]]) for i in range(200)], "series_id string, phi array<double>, y array<double>").repartition(3)
    for r in linear.gram(rows, 3).collect():
        has = ~np.isnan(y[:, r["r"] - 1])
        assert r["n"] == has.sum()
        np.testing.assert_allclose(np.reshape(r["a"], (4, 4)), phi[has].T @ phi[has], atol=1e-10)
        np.testing.assert_allclose(r["b"], phi[has].T @ y[has, r["r"] - 1], atol=1e-10)


def test_sum_table_follows_its_rows(spark):
    """Append, run again, retract, compact, run again after compaction: always the sums of the rows that are there."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(90, 4)), rng.normal(size=(90, 4))
    rows = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), 1.0) for i in range(90)], "id long, x array<double>, y array<double>, mask double")
    sums = maintained.SumTable(spark, shared_path(spark, "table"), ("block_id",), ("a", "b"), ("m",))
    part = lambda lo, hi: linear.block_sums(rows.where((F.col("id") >= lo) & (F.col("id") < hi)), 2)

    def holds(*spans):
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        got = {r["block_id"]: r for r in sums.current().collect()}
        for k in range(2):
            p, q = x[at, 2 * k : 2 * k + 2], y[at, 2 * k : 2 * k + 2]
            np.testing.assert_allclose(got[k]["a"], (p.T @ p).ravel(), atol=1e-10)
            np.testing.assert_allclose(got[k]["b"], (p.T @ q).ravel(), atol=1e-10)
            assert got[k]["m"] == pytest.approx(len(at))

    sums.record(part(0, 30), "1")
    sums.record(part(30, 60), "2")
    sums.record(part(30, 60), "2")
    holds((0, 60))
    sums.compact()
    holds((0, 60))
    sums.record(part(0, 30), "1")  # taken in already
    sums.record(part(60, 90), "3")
    holds((0, 90))
    sums.record(part(10, 20), "gone", retract=True)
    holds((0, 10), (20, 90))
    sums.compact()
    sums.record(part(60, 90), "3")
    sums.record(part(10, 20), "gone", retract=True)
    holds((0, 10), (20, 90))
    assert sums.generation() == 2


@pytest.mark.parametrize("beta,error,least", [(30.0, 1e-3, 0.3), (30.0, 1e-12, 0.1), (0.1, 1e-9, 0.0)])
def test_pruned_retrieval_keeps_its_error(spark, beta, error, least):
    """Clustered keys: the share of blocks left out, and the distance from the whole softmax, which the stated error bounds."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(12, 6))
    keys = np.repeat(centres, 20, 0) + rng.normal(size=(240, 6)) * 0.05
    values = rng.normal(size=(240, 3))
    x = centres[rng.integers(0, 12, size=40)] + rng.normal(size=(40, 6)) * 0.05
    bank = spark.createDataFrame([(k.tolist(), v.tolist()) for k, v in zip(keys, values, strict=True)], "key array<double>, value array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    ball = retrieval.BallBank(bank, 24)
    left_out = 1 - ball.needed(queries, beta, error).count() / (40 * len(ball.blocks))
    assert left_out >= least
    got = np.array([r["out"] for r in ball.refine(queries, beta, error, rows=13).orderBy("id").collect()])
    s = beta * x @ keys.T
    w = np.exp(s - s.max(1, keepdims=True))
    want = w / w.sum(1, keepdims=True) @ values
    spread = max(np.linalg.norm(a - b) for a in values for b in values)
    assert np.linalg.norm(got - want, axis=1).max() <= error * spread + 1e-12


def test_kept_tables_follow_their_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    make = lambda: spark.read.parquet(str(tmp_path / "t.parquet"))
    assert storage.kept(spark, str(tmp_path), "t", make).count() == 3
    first = storage.kept(spark, str(tmp_path), "t", make)
    assert storage.kept(spark, str(tmp_path), "t", make) is first
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert storage.kept(spark, str(tmp_path), "t", make).count() == 5


def test_tall_columns_are_orthonormalised(spark):
    """Nearly dependent columns too: orthonormal to the last digits, and the same spans in order as column by column."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 6))
    v[:, 3] = v[:, 2] + 1e-5 * v[:, 3]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "row long, v array<double>").repartition(4)
    q = np.array([r["v"] for r in retrieval.gram_schmidt(rows, 6).orderBy("row").collect()])
    np.testing.assert_allclose(q.T @ q, np.eye(6), atol=1e-10)
    np.testing.assert_allclose(q, kernels.orthonormal(v), atol=1e-5)
    with pytest.raises(ValueError, match="depend"):
        retrieval.gram_schmidt(rows.selectExpr("row", "transform(v, (x, i) -> IF(i = 1, v[0], x)) AS v"), 6)


def test_sums_of_a_stream(spark):
    """Micro-batches over two runs, one of them run again after its progress was lost, and a compaction in between."""
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 4))
    schema = "id long, x array<double>, y array<double>, mask double"
    path, folder = shared_path(spark, "rows"), shared_path(spark, "sums")
    table = maintained.SumTable(spark, f"{folder}-table", ("block_id",), ("a", "b"), ("m",))
    for k in range(3):
        spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), 1.0) for i in range(20 * k, 20 * k + 20)], schema).write.mode("append").parquet(path)
        out = runs.run_sums(runs.read_stream(spark, path, schema), lambda b: linear.block_sums(b, 2), table, "sums", folder)
        if k == 1:
            table.compact()
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}-progress/commits/1")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    for r in out.collect():
        p = x[:, 2 * r["block_id"] : 2 * r["block_id"] + 2]
        np.testing.assert_allclose(r["a"], (p.T @ p).ravel(), atol=1e-10)
        assert r["m"] == pytest.approx(60)


def test_retrieval_copies_blocks_of_counted_bytes(spark):
    """Small slices are met inside a task: they don't make more copies travel. Equal rows of the bank travel as one, and count as many."""
    rng = np.random.default_rng(11)
    bank = [(v := rng.normal(size=3).tolist(), v) for _ in range(30)] * 4
    x = rng.normal(size=(50, 3))
    b = spark.createDataFrame(bank, "key array<double>, value array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    spread, parts = retrieval._blocks(q, b)
    assert (spread.count(), parts.count()) == (50, 30)
    k = np.array([v for v, _ in bank])
    for got in (retrieval._by_slices(q, b, 0.7, 2), retrieval.BallBank(b, 5).refine(q, 0.7, 1e-13, rows=3)):
        np.testing.assert_allclose([r["out"] for r in got.orderBy("id").collect()], kernels.softmax_step(x, k, k, 0.7), atol=1e-12)


def test_a_large_bank_goes_to_no_driver(spark):
    """A step over more than ``BANK_BYTES`` is dealt into blocks, and two steps count the queries once."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40_000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    plan = retrieval.refine(v.where("id < 3"), v.selectExpr("x AS key", "x AS value"), 0.5, 2)._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroupsInPandas") >= 2


def test_softmax_holds_a_tile():
    """The working matrix of a batch of queries is a tile, not queries x keys (320 MB here, several times over)."""
    import tracemalloc

    rng = np.random.default_rng(13)
    x, k = rng.normal(size=(2000, 4)), rng.normal(size=(20_000, 4))
    tracemalloc.start()
    got = kernels.softmax_step(x, k, k, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    w = np.exp(0.5 * x[:5] @ k.T)
    np.testing.assert_allclose(got[:5], w / w.sum(1, keepdims=True) @ k, atol=1e-12)


def test_dense_panels_are_not_joined_with_their_grid(spark):
    """Empty steps are made where the sums are: no join carries a row a series and step. Gaps, a series without a step or an id, and one step."""
    at = lambda day: f"2020-01-{day:02d} 12:00:00"
    rows = [("a", at(3), 1.0), ("a", at(3), 2.0), ("a", at(6), 4.0), ("b", at(1), 1.5), ("b", at(9), 2.5), ("c", None, 7.0), ("d", at(5), None), (None, at(4), 3.0)]
    facts = spark.createDataFrame(rows, "series_id string, at string, amount double")
    got = panels.dense_panel(facts)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and "Join LeftOuter" not in got._jdf.queryExecution().toString()
    want = {(s, t): 0.0 for s in ("a", "b", "c", "d", None) for t in range(9)} | {("a", 2): 3.0, ("a", 5): 4.0, ("b", 0): 1.5, ("b", 8): 2.5}
    held = [((r["series_id"], r["t"]), r["value"]) for r in got.collect()]
    assert len(held) == len(want) and dict(held) == want
    one = panels.dense_panel(facts.where("series_id = 'a' AND amount = 4"))
    assert [tuple(r) for r in one.collect()] == [("a", 0, 4.0)]
    assert panels.dense_panel(facts.limit(0)).count() == 0


def test_blocks_of_a_pruned_bank_make_no_object_a_row():
    """Queries and keys of a block stay Arrow buffers: what is made beside them is the result and a tile, and slices and chunks are read right."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(14)
    x, k = rng.normal(size=(30_000, 4)), rng.normal(size=(500, 4))
    lists = lambda a: pa.chunked_array([retrieval._arrays(a[:7]), retrieval._arrays(np.concatenate([a[:3], a[7:]])).slice(3)])
    q = pa.table({"id": np.arange(len(x)), "x": lists(x)})
    b = pa.table({"key": lists(k), "value": lists(2 * k), "copies": np.ones(len(k), dtype="int64")})
    tracemalloc.start()
    got = retrieval._table_softmax(0.5)(q, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(retrieval._matrix(got["v"]) / got["z"].to_numpy()[:, None], kernels.softmax_step(x, k, 2 * k, 0.5), atol=1e-12)
    assert peak < 8 << 20  # an array object a query alone takes 3 MB, a list of its numbers 5 MB more
    assert len(retrieval._table_softmax(0.5)(q.slice(0, 0), b)) == 0 == len(retrieval._table_softmax(0.5)(q, b.slice(0, 0)))
