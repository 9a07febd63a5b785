"""Queries over models, online learning, evaluation, leaderboard and vectors (groups D to H), each with its DuckDB SQL.

Solves are compared on two features, [1, x[t]], where Cramer's rule is the oracle; the code path is that of any number of features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.jobs import sql as S
from panelcast.jobs.panel_jobs import cuts, rounded, sales, scaled
from panelcast.operators import evaluate as V
from panelcast.operators import features as X
from panelcast.operators import leaderboard as G
from panelcast.operators import linear as L
from panelcast.operators import maintained as M
from panelcast.operators import online as O
from panelcast.operators import protocol as B
from panelcast.operators import retrieval as H
from panelcast.operators import spectra as P
from panelcast.sources import files
from panelcast.sources.storage import kept, shared_path, stored, table

HORIZON, LAM = 3, 1e-3
TOWARDS = [[2.0, 0.5], [-0.25, 1.0]]  # G of a finalised block


def two(spark, d):
    """The scaled panel with phi = [1, x[t]], and its cuts."""
    z, c = scaled(spark, d)
    return z.withColumn("phi", F.array(F.lit(1.0), F.col("value"))), c


def fitted(spark, d):
    rows, c = two(spark, d)
    return rows, c, L.fit_ridge(rows, c[0], HORIZON, 1, LAM)


def static_errors(spark, d):
    rows, (_, te, n), model = fitted(spark, d)
    return V.errors(L.forecast(rows, model, te, n), rows), (te, n)


def online_errors(spark, d):
    rows, (_, te, n), model = fitted(spark, d)
    return V.errors(O.online_forecast(rows, model, te, n), rows), (te, n)


def persist_errors(spark, d):
    z, (_, te, n) = scaled(spark, d)
    return V.errors(V.persistence(z, te, n), z), (te, n)


def chunks_of(spark, d):
    errs, (te, n) = persist_errors(spark, d)
    return V.error_chunks(errs, te, 100), n - 1 - te


def wide(df: DataFrame, column: str, *names: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.round(F.get(column, i), 6).alias(n) for i, n in enumerate(names)])


def d10(spark, d):
    rows, c = two(spark, d)
    g = L.gram(L.train_pairs(rows, c[0], HORIZON, 1), HORIZON)
    return g.select("series_id", "r", "n", *[F.round(F.get("a", i), 4).alias(x) for i, x in ((0, "a11"), (1, "a12"), (3, "a22"))], *[F.round(F.get("b", i), 4).alias(x) for i, x in ((0, "b1"), (1, "b2"))])


def d10_kept(spark, d):
    """Train rows that arrive in three parts, every seventh day taken out again, compaction in between, and a solve of what is left."""
    rows, c = two(spark, d)
    pairs = stored(L.train_pairs(rows, c[0], HORIZON, 1), "pairs")
    part = F.col("t") * 3 / c[0]
    sums, of = M.SumTable(spark, shared_path(spark, "sum-table")), lambda p: L.gram(p, HORIZON)
    for k in range(3):
        sums.record(of(pairs.where((part >= k) & (part < k + 1))), f"part-{k}")
        if k == 1:
            sums.compact()
    sums.record(of(pairs.where("t % 7 = 3")), "sevenths", retract=True)
    sums.record(of(pairs.where(part < 1)), "part-0")  # it is in the table already
    return wide(L.solve_relative(sums.current(), LAM).drop("a_inv"), "w", "w0", "w1")


def d1_kept(spark, d):
    """Vectors in two parts, a quarter of them taken out again."""
    v = vectors(spark, d)
    sums = M.SumTable(spark, shared_path(spark, "sum-table"), ("block_id",), ("a", "b"), ("m",))
    for k in range(2):
        sums.record(L.block_sums(v.where(F.col("id") % 2 == k), 2), str(k))
    sums.record(L.block_sums(v.where("id % 4 = 1"), 2), "quarter", retract=True)
    sums.compact()
    return wide(L.solve_blocks(L.finalise(sums.current(), 2), 2), "w", "w0", "w1", "w2", "w3")


def d12(spark, d):
    rows, c = two(spark, d)
    pairs = L.train_pairs(rows, c[0], HORIZON, 1).withColumn("y", F.transform("y", lambda v: F.when(F.col("t") % 7 != 3, v)))
    return wide(L.fit_mean_ridge(pairs, HORIZON, 1e-2), "w", "w0", "w1")


def d13(spark, d):
    rows, c = two(spark, d)
    y = X.targets(rows, 2).where((F.col("t") < c[0] - 2)).select("phi", "y")
    return wide(L.fit_shared(y, 1e-3), "w", "w00", "w01", "w10", "w11")


def e3(spark, d):
    rows, _ = two(spark, d)
    return O.delayed_pairs(rows, HORIZON).select("series_id", "t", "r", F.round(F.get("phi_then", 1), 6).alias("x_then"), F.round("observed", 6).alias("observed"))


def e4(spark, d):
    """Half of the test steps, the state stored and read again, and the rest: the same forecasts as in one go."""
    rows, (_, te, n), model = fitted(spark, d)
    mid = te + (n - te) // 2
    state = stored(O.online_state(rows, model, te, mid), "state")
    first = O.online_forecast(rows, model, te, n).where(F.col("t") < mid)
    return rounded(first.unionByName(O.online_forecast(rows, state, mid, n)), "yhat")


def e4_chunks(spark, d):
    rows, (tr, te, n) = two(spark, d)
    return rounded(O.online_by_chunk(rows, tr, LAM, HORIZON, 1, te, n, 300, 4), "yhat")


def e5(spark, d):
    out = None
    for name, make in (("static", static_errors), ("rls", online_errors)):
        one = V.total_score(make(spark, d)[0]).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mse", "mae", digits=5)


def e9(spark, d):
    rows, (_, te, n), model = fitted(spark, d)
    return rounded(O.free_run(rows, model.where("r = 1").select("series_id", "w"), 0, te, 5), "yhat")


def f2_map(spark, d):
    errs, _ = static_errors(spark, d)
    row = V.result_rows(errs, "sales", HORIZON, "static")
    return row.select("dataset", "pred_len", "model", F.explode("by_step").alias("step", "m")).select("dataset", "pred_len", "model", "step", *[F.round(F.get("m", i), 5).alias(x) for i, x in ((0, "mse"), (1, "mae"))], F.get("m", 2).alias("n"))


def f4(spark, d):
    chunks, n = chunks_of(spark, d)
    got = V.bootstrap(chunks, -(-n // 100))
    return rounded(got, *[c for c in got.columns if c[:2] == "ms" or c[:2] == "ma"], digits=5)


def f5(spark, d):
    errs, _ = persist_errors(spark, d)
    runs = errs.groupBy("series_id").agg(F.avg(F.col("err") * F.col("err")).alias("v")).withColumn("task", F.substring("series_id", -1, 1))
    return rounded(V.seed_summary(runs, "task", "v"), "mean", "std", digits=5)


def f6(spark, d):
    z, (_, te, n) = scaled(spark, d)
    pairs = V.persistence(z, te, n).select("series_id", (F.col("t") + 1).alias("t"), "yhat").join(z, ["series_id", "t"])
    return rounded(V.nmse(pairs, "series_id"), "nmse", digits=5)


def f7(spark, d):
    errs, _ = persist_errors(spark, d)
    sigma = scaled(spark, d)[0].agg(F.stddev_pop("value").alias("sigma"))
    return rounded(V.first_crossing(errs, sigma, 0.01, 2.0), "horizon")


def f8(spark, d):
    p = sales(spark, d)
    tr, te, n = cuts(p)
    out = None
    for kind, x in (("raw", B.zscore(p, tr)), ("clipped", B.zscore(B.clip_spikes(p, tr, 1.0), tr))):
        one = V.total_score(V.errors(V.persistence(x, te, n), x)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mse", "mae", digits=5)


def f9(spark, d):
    return rounded(V.outlier_energy(stored(persist_errors(spark, d)[0], "errors")), "energy", "points", digits=5)


def f12(spark, d):
    m = persist_errors(spark, d)[0].select(F.round(F.abs("err"), 9).alias("m"))
    return B.histogram(m, "m", 0.0, 5.0, 50)


def our_rows(spark, d):
    """Result rows of three simple forecasts: as they are, halved as corrected rows, and as untested rows of a later file. Each kind is written as files of its own
    (the middle one wrapped) and read back; ``file`` is where a row was read from."""
    made = kept(spark, d, "results", lambda: _our_rows(spark, d))
    base = shared_path(spark, "results")
    for name in "abc":
        files.write_results(made.where(F.col("file") == name).drop("file"), f"{base}/{name}", wrapped=name == "b")
    return files.read_results(spark, [f"{base}/a", f"{base}/c"], f"{base}/b").withColumn("file", files.folder_of(F.col("origin"))).drop("origin", "by_step")


def _our_rows(spark, d):
    z, (_, te, n) = scaled(spark, d)
    p = V.errors(V.persistence(z, te, n, 2), z)
    s = V.errors(V.seasonal(z, te, n, 7, 2), z)
    zero = V.errors(V.persistence(z, te, n, 2).withColumn("yhat", F.lit(0.0)), z)
    each = p.withColumn("model", F.lit("persistence")).unionByName(s.withColumn("model", F.lit("seasonal"))).unionByName(zero.withColumn("model", F.lit("mean")))
    sums = each.groupBy(F.col("r").alias("pred_len"), "model").agg(F.avg(F.col("err") ** 2).alias("mse"), F.avg(F.abs("err")).alias("mae"), F.count("*").alias("n"))
    out = None
    for factor, clip, counted, file in ((1.0, 0.0, True, "a"), (0.5, 3.0, True, "b"), (3.0, 0.0, False, "c")):
        one = sums.select(F.lit("sales").alias("dataset"), "pred_len", "model", (F.col("mse") * factor).alias("mse"), (F.col("mae") * factor).alias("mae"), (F.col("n") if counted else F.lit(None).cast("long")).alias("n"), F.lit(clip).alias("clip_spikes"), F.lit(file).alias("file"))
        out = one if out is None else out.unionByName(one)
    return out


def cells(spark, d):
    """Cells to hold our rows against: other seasonal forecasts on all test origins (batch) and on the later half (dsof), and one of a second dataset."""

    def make():
        z, (_, te, n) = scaled(spark, d)
        out = z.where(F.col("t") >= te).agg(F.round(F.avg(F.col("value") ** 2), 5).alias("mse")).select(F.lit("stock").alias("dataset"), F.lit("Mean").alias("method"), F.lit(1).alias("h"), F.lit("batch").alias("mode"), "mse")
        for name, cadence in S.CADENCES.items():
            errs = V.errors(V.seasonal(z, te, n, cadence, 2), z)
            for mode, first in (("batch", te), ("dsof", te + (n - te) // 2)):
                one = errs.where(F.col("t") >= first).groupBy(F.col("r").alias("h")).agg(F.round(F.avg(F.col("err") ** 2), 5).alias("mse"))
                out = out.unionByName(one.select(F.lit("sales").alias("dataset"), F.lit(name).alias("method"), "h", F.lit(mode).alias("mode"), "mse"))
        return out

    return kept(spark, d, "cells", make)


def pairs(spark, d):
    return G.against_published(G.latest_rows(our_rows(spark, d)).where(~G.corrected()), cells(spark, d))


def with_se(rows):
    return rows.where("n IS NOT NULL").withColumn("mse_se", F.col("mse") / 10).withColumn("mse_p5", F.col("mse") * 0.9).withColumn("mse_p95", F.col("mse") * 1.2)


def a7(spark, d):
    rows = our_rows(spark, d)
    path, other = shared_path(spark, "json-rows"), shared_path(spark, "json-wrapped")
    files.write_results(rows.where("clip_spikes = 0").drop("file"), path)
    files.write_results(rows.where("clip_spikes > 0").drop("file"), other, wrapped=True)
    back = files.read_results(spark, path, other)
    return rounded(back.select("dataset", "pred_len", "model", "mse", "mae", F.coalesce("n", F.lit(0)).alias("n"), "clip_spikes"), "mse", "mae", digits=5)


def a9(spark, d):
    nested = cells(spark, d).groupBy("dataset", "method", "h").pivot("mode", ["batch", "dsof"]).agg(F.first("mse"))
    one = nested.groupBy("dataset", "method").agg(F.map_from_entries(F.collect_list(F.struct(F.col("h").cast("string"), F.struct("batch", "dsof")))).alias("hs"))
    top = one.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("method", "hs"))).alias("m")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", "m")))).alias("json"))
    present = our_rows(spark, d).select("dataset").distinct()
    return files.flatten_published(top).join(present, "dataset", "left_semi")


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    cut = lambda a: F.transform(F.slice("embedding", a, S.DIMS), lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("id"), cut(1).alias("x"), cut(S.DIMS + 1).alias("y"), F.when(F.col("vec_id") % 5 != 0, 1.0).otherwise(0.0).alias("mask"))


def blocks(spark, d, g=None):
    return L.finalise(L.block_sums(vectors(spark, d), 2), 2, g=g)


def d9(spark, d):
    """A block of 1 x 1 for every dimension, of the vectors' means and second moments, and a correction of rank 1."""
    each = vectors(spark, d).select("id", F.posexplode(F.arrays_zip("x", "y")).alias("block_id", "v")).select("block_id", "v.x", "v.y")
    m = each.groupBy("block_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("x") * F.col("y")).alias("xy"))
    rows = m.select("block_id", *[F.array(v).alias(n) for n, v in (("a_inv", 1 / (F.col("xx") + 0.02)), ("w", F.col("xy")), ("u", F.col("x")), ("v", F.col("y")), ("p", F.col("xx")), ("q", F.col("x") + F.col("y")))])
    return wide(L.woodbury_correction(rows, 1, 1), "w", "w")


def pruned(spark, d, beta):
    """The same by blocks of near keys, of which a query leaves out those that can't matter; vectors arrive as a stream in two parts."""
    from panelcast.streaming.runs import read_stream, run_partials

    v = vectors(spark, d).select("id", "x")
    bank = H.BallBank(v.select(F.col("x").alias("key"), F.col("x").alias("value")), 64)
    path, folder, out = shared_path(spark, "vectors"), shared_path(spark, "retrieved"), None
    for k in range(2):
        v.where(F.col("id") % 2 == k).write.mode("append").parquet(path)
        out = run_partials(read_stream(spark, path, v.schema), lambda batch: bank.refine(batch, beta, 1e-14), "retrieved", folder)
    return rounded(out.select("id", F.posexplode("out").alias("i", "v")), "v", digits=5)


def retrieve(spark, d, steps, block_rows=None):
    """Every vector against a bank of all of them."""
    v = vectors(spark, d)
    bank = v.select(F.col("x").alias("key"), F.col("x").alias("value"))
    got = H.refine(v, bank, 2.0, steps) if block_rows is None else H._by_slices(v.select("id", "x"), bank, 2.0, block_rows)
    return rounded(got.select("id", F.posexplode("out").alias("i", "v")), "v")


def e6(spark, d, svd=False):
    """One step from two unit vectors: equal entries, and entries of alternating sign."""
    import numpy as np

    u = np.full((S.DIMS, 1), S.DIMS**-0.5)
    v = u * np.array([[(-1.0) ** i] for i in range(S.DIMS)])
    got = (H.svd_gha_step if svd else H.gha_step)(vectors(spark, d), u, v, 0.5)
    return rounded(spark.createDataFrame([(i, float(got[0][i, 0]), float(got[1][i, 0])) for i in range(S.DIMS)], "i int, u double, v double"), "u", "v")


def e8(spark, d):
    rows = vectors(spark, d).select(F.col("id").alias("row"), F.col("x").alias("v"))
    return rounded(H.gram_schmidt(rows, S.DIMS).select("row", F.posexplode("v").alias("i", "q")), "q", digits=5)


def e1(spark, d):
    """One update of as many readouts as y has entries, sharing an inverse, gamma 0.5, from [1, x] of each vector; the identity and zero weights before. Per
    feature: the inverse's diagonal and its part in the first column, and the readouts' weights summed and of the last one."""
    import numpy as np
    import pandas as pd

    from panelcast.functions import kernels

    def run(batches):
        for g in batches:
            for name, x, y in zip(g["id"], g["x"], g["y"], strict=True):
                inv, w = kernels.rls_step(np.eye(len(x) + 1), np.zeros((len(x) + 1, len(y))), np.array([1.0, *x]), np.array(y), 0.5)
                yield pd.DataFrame({"id": name, "i": range(len(w)), "diagonal": inv.diagonal(), "first": inv[:, 0], "total": w.sum(1), "last": w[:, -1]})

    return rounded(vectors(spark, d).mapInPandas(run, "id long, i int, diagonal double, first double, total double, last double"), "diagonal", "first", "total", "last")


_score = "round(avg(err * err), 5) AS mse, round(avg(abs(err)), 5) AS mae, count(*) AS n"
_soft = lambda src, dst, beta=2.0: f"""{dst}s AS (SELECT r.id, {beta}::DOUBLE * list_dot_product(r.x, k.x) AS s, k.x AS val FROM {src} r, vec k),
{dst}e AS (SELECT id, val, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM {dst}s),
{dst} AS (SELECT id, [{", ".join(f"sum(e * val[{i + 1}]) / sum(e)" for i in range(S.DIMS))}] AS x FROM {dst}e GROUP BY id)"""  # noqa: E731
_entries = "SELECT id, (i - 1)::INTEGER AS i, round(x[i], 6) AS v FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM {})"
_sum = lambda column, by: f"[{', '.join(f'sum(mask * {column}[{i + 1}] * {by})' for i in range(S.DIMS))}]"


def _orthonormal(n: int) -> str:
    """Column after column of lists v0: scaled to length 1, and taken off all later ones; ends with v<n>."""
    out = []
    for j in range(1, n + 1):
        out.append(f"d{j} AS MATERIALIZED (SELECT sqrt(sum(v[{j}] * v[{j}])) AS len, [{', '.join(f'sum(v[{j}] * v[{k}])' for k in range(1, n + 1))}] AS s FROM v{j - 1})")
        out.append(f"v{j} AS MATERIALIZED (SELECT id, list_transform(v, lambda e, k: CASE WHEN k < {j} THEN e WHEN k = {j} THEN e / len ELSE e - v[{j}] * s[k] / (len * len) END) AS v FROM v{j - 1}, d{j})")
    return ", ".join(out)


def _gha(of_x: str, of_y: str) -> str:
    """One step from u (equal entries) and v (alternating signs): pulled along sums of x times ``of_x`` and of y times ``of_y``."""
    step = lambda a, e: f"{e} + 0.5::DOUBLE * (a.{a} - {e} * sum(a.{a} * {e}) OVER ())"
    return f"""p AS (SELECT *, list_sum(x) / sqrt({S.DIMS}) AS xu, list_sum(list_transform(y, lambda e, k: e * (-1) ** (k - 1))) / sqrt({S.DIMS}) AS yv,
       list_sum(y) / sqrt({S.DIMS}) AS yu, list_sum(list_transform(x, lambda e, k: e * (-1) ** (k - 1))) / sqrt({S.DIMS}) AS xv FROM vec),
g AS (SELECT {_sum('x', of_x)} AS a, {_sum('y', of_y)} AS b, sum(mask) AS n FROM p),
s AS (SELECT unnest(range({S.DIMS})) AS i, unnest(a) / n AS pu, unnest(b) / n AS pv FROM g),
a AS (SELECT *, 1 / sqrt({S.DIMS}) AS eu, (-1) ** i / sqrt({S.DIMS}) AS ev FROM s),
c AS (SELECT i, {step('pu', 'eu')} AS u, {step('pv', 'ev')} AS v FROM a)
SELECT i::INTEGER AS i, round(u / sqrt(sum(u * u) OVER ()), 6) AS u, round(v / sqrt(sum(v * v) OVER ()), 6) AS v FROM c"""


_chunks = f"""{S.PERSIST},
chunk AS (SELECT row_number() OVER (ORDER BY r, c) - 1 AS chunk_id, * FROM (
  SELECT r, (t - te) // 100 AS c, sum(err * err) AS sq, sum(abs(err)) AS ab, count(*) AS n FROM forecast, cut GROUP BY 1, 2))"""

_boot = f"""{_chunks},
k AS (SELECT count(*) AS k FROM chunk),
reps AS (SELECT unnest(range(0, 200)) AS rep),
draw AS (SELECT rep, unnest(range(0, (k + 3) // 4)) AS draw, k FROM reps, k),
picked AS (SELECT rep, ('0x' || substr(md5('0|' || rep || '|' || draw), 1, 8))::BIGINT % (k - 3) + o AS chunk_id FROM draw, (SELECT unnest([0, 1, 2, 3]) AS o)),
stat AS (SELECT rep, sum(sq) / sum(n) AS mse, sum(ab) / sum(n) AS mae FROM picked JOIN chunk USING (chunk_id) GROUP BY rep)"""

_model2 = "SELECT b::INTEGER AS block_id, {} FROM two"


JOBS = {
    "d1_block_sums": (
        lambda s, d: L.block_sums(vectors(s, d), 2).select("block_id", F.col("m"), *[F.round(F.get("a", i), 5).alias(f"a{i}") for i in range(4)], *[F.round(F.get("b", i), 5).alias(f"b{i}") for i in range(4)]),
        f"WITH {S.VECTORS} SELECT b::INTEGER AS block_id, m, " + ", ".join(f"round(max({c}) FILTER (WHERE i = {i // 2 + 1} AND j = {i % 2 + 1}), 5) AS {n}{i}" for c, n in (("a", "a"), ("c", "b")) for i in range(4)) + " FROM raw, mass GROUP BY b, m",
    ),
    "d2_finalise": (lambda s, d: blocks(s, d, TOWARDS).select("block_id", *[F.round(F.get(c, i), 6).alias(f"{c}{i}") for c in "ab" for i in range(4)]), f"WITH {S.VECTORS} " + _model2.format("round(p, 6) AS a0, round(q, 6) AS a1, round(q, 6) AS a2, round(s, 6) AS a3, round(c11 + 0.01, 6) AS b0, round(c12 + 0.005, 6) AS b1, round(c21 - 0.0025, 6) AS b2, round(c22, 6) AS b3")),
    "d3_regularise": (lambda s, d: L.regularise(blocks(s, d), 2, 0.1, 0.2, TOWARDS).select("block_id", *[F.round(F.get(c, i), 6).alias(f"{c}{i}") for c in "ab" for i in range(4)]), f"WITH {S.VECTORS} " + _model2.format("round(p + 0.3, 6) AS a0, round(q, 6) AS a1, round(q, 6) AS a2, round(s + 0.3, 6) AS a3, round(c11 + 0.2, 6) AS b0, round(c12 + 0.05, 6) AS b1, round(c21 - 0.025, 6) AS b2, round(c22 + 0.1, 6) AS b3")),
    "d4_positive_definite": (lambda s, d: L.positive_definite(blocks(s, d), 2), f"WITH {S.VECTORS} " + _model2.format("(p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * q) > 1e-6 AS is_pd")),
    "d5_condition": (lambda s, d: rounded(L.condition_numbers(blocks(s, d), 2), "condition"), f"WITH {S.VECTORS} " + _model2.format("round(((p + s) / 2 + sqrt((p - s) * (p - s) / 4 + q * q)) / ((p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * q) + 1e-12::DOUBLE), 6) AS condition")),
    "d6_block_solve": (lambda s, d: wide(L.solve_blocks(blocks(s, d), 2), "w", "w0", "w1", "w2", "w3"), f"WITH {S.VECTORS} " + _model2.format("round((c11 * s - c21 * q) / (p * s - q * q), 6) AS w0, round((c12 * s - c22 * q) / (p * s - q * q), 6) AS w1, round((p * c21 - q * c11) / (p * s - q * q), 6) AS w2, round((p * c22 - q * c12) / (p * s - q * q), 6) AS w3")),
    "d7_backward": (lambda s, d: wide(L.backward_projection(vectors(s, d), 2, 0.01, 0.01), "w", "w0", "w1", "w2", "w3"), f"WITH {S.VECTORS} " + _model2.format("round((d11 * ys - d21 * yq) / (yp * ys - yq * yq), 6) AS w0, round((d12 * ys - d22 * yq) / (yp * ys - yq * yq), 6) AS w1, round((yp * d21 - yq * d11) / (yp * ys - yq * yq), 6) AS w2, round((yp * d22 - yq * d12) / (yp * ys - yq * yq), 6) AS w3")),
    "d8_apply_blocks": (
        lambda s, d: wide(L.apply_blocks(vectors(s, d), L.solve_blocks(blocks(s, d), 2), 2), "out", "o1", "o2"),
        f"WITH {S.VECTORS}, w AS (SELECT b, (c11 * s - c21 * q) / (p * s - q * q) AS w0, (c12 * s - c22 * q) / (p * s - q * q) AS w1, (p * c21 - q * c11) / (p * s - q * q) AS w2, (p * c22 - q * c12) / (p * s - q * q) AS w3 FROM two) SELECT id, b::INTEGER AS block_id, round(x[2 * b + 1] * w0 + x[2 * b + 2] * w2, 6) AS o1, round(x[2 * b + 1] * w1 + x[2 * b + 2] * w3, 6) AS o2 FROM vec, w",
    ),
    "d9_woodbury": (
        d9,
        f"""WITH {S.VECTORS}, e AS (SELECT unnest(range({S.DIMS})) AS id, unnest(x) AS x, unnest(y) AS y FROM vec),
m AS (SELECT id, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy FROM e GROUP BY id),
b AS (SELECT id, 1 / (xx + 0.02::DOUBLE) AS a, xy AS w, x AS u, y AS v, xx AS p, x + y AS q FROM m),
c AS (SELECT 1 + sum(v * a * u) AS c, sum(v * a * p) AS cp FROM b)
SELECT id::INTEGER AS block_id, round(w - a * u / c * v * w + (a * p - a * u / c * cp) * q, 6) AS w FROM b, c""",
    ),
    "d10_gram": (d10, f"WITH {S.FIT} SELECT series_id, r::INTEGER AS r, n::BIGINT AS n, round(n, 4) AS a11, round(sx, 4) AS a12, round(sxx, 4) AS a22, round(sy, 4) AS b1, round(sxy, 4) AS b2 FROM sums"),
    "d11_ridge": (lambda s, d: wide(fitted(s, d)[2].drop("a_inv"), "w", "w0", "w1"), f"WITH {S.FIT} SELECT series_id, r::INTEGER AS r, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM model"),
    "d10_maintained_sums": (d10_kept, f"WITH {S.FIT.replace('WHERE t + r < tr', 'WHERE t + r < tr AND t % 7 <> 3')} SELECT series_id, r::INTEGER AS r, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM model"),
    "d1_maintained_sums": (d1_kept, f"WITH {S.VECTORS.replace('FROM embeddings', 'FROM embeddings WHERE vec_id % 4 <> 1')} SELECT b::INTEGER AS block_id, round((c11 * s - c21 * q) / (p * s - q * q), 6) AS w0, round((c12 * s - c22 * q) / (p * s - q * q), 6) AS w1, round((p * c21 - q * c11) / (p * s - q * q), 6) AS w2, round((p * c22 - q * c12) / (p * s - q * q), 6) AS w3 FROM two"),
    "d12_mean_ridge": (
        d12,
        f"""WITH {S.FIT}, k AS (SELECT series_id, r, avg(x) AS x, avg(x * x) + 0.01 AS xx, avg(y) AS y, avg(x * y) AS xy FROM pairs, cut WHERE t + r < tr AND t % 7 <> 3 GROUP BY ALL)
SELECT series_id, r::INTEGER AS r, round((y * xx - xy * x) / (1.01 * xx - x * x), 6) AS w0, round((1.01 * xy - x * y) / (1.01 * xx - x * x), 6) AS w1 FROM k""",
    ),
    "d13_shared_ridge": (
        d13,
        f"""WITH {S.FIT}, k AS (SELECT count(*)::DOUBLE AS n, sum(a.x) AS sx, sum(a.x * a.x) AS sxx, sum(a.y) AS y1, sum(a.x * a.y) AS xy1, sum(b.y) AS y2, sum(a.x * b.y) AS xy2
FROM pairs a JOIN pairs b ON a.series_id = b.series_id AND a.t = b.t AND a.r = 1 AND b.r = 2, cut WHERE a.t < tr - 2),
g AS (SELECT *, n + 1e-3::DOUBLE * (n + sxx) / 2 AS a, sxx + 1e-3::DOUBLE * (n + sxx) / 2 AS c FROM k)
SELECT round((y1 * c - xy1 * sx) / (a * c - sx * sx), 6) AS w00, round((y2 * c - xy2 * sx) / (a * c - sx * sx), 6) AS w01, round((a * xy1 - sx * y1) / (a * c - sx * sx), 6) AS w10, round((a * xy2 - sx * y2) / (a * c - sx * sx), 6) AS w11 FROM g""",
    ),
    "d14_static_forecast": (lambda s, d: rounded(L.forecast((x := fitted(s, d))[0], x[2], x[1][1], x[1][2]), "yhat"), f"WITH {S.STATIC} SELECT series_id, t, r::INTEGER AS r, round(yhat, 6) AS yhat FROM forecast"),
    "e1_rls_update": (
        e1,
        f"""WITH {S.VECTORS}, k AS (SELECT id, list_prepend(1.0::DOUBLE, x) AS p, list_sum(y) AS total, y[{S.DIMS}] AS last, 1 + 0.5::DOUBLE * (1 + list_dot_product(x, x)) AS g FROM vec),
e AS (SELECT *, unnest(p) AS v, unnest(range({S.DIMS + 1})) AS i FROM k)
SELECT id, i::INTEGER AS i, round(1 - 0.5::DOUBLE * v * v / g, 6) AS diagonal, round(CASE WHEN i = 0 THEN 1 ELSE 0 END - 0.5::DOUBLE * v / g, 6) AS first, round(v * total / g, 6) AS total, round(v * last / g, 6) AS last FROM e""",
    ),
    "e2_online_forecast": (lambda s, d: rounded(O.online_forecast((x := fitted(s, d))[0], x[2], x[1][1], x[1][2]), "yhat"), f"WITH {S.ONLINE} SELECT series_id, t, r::INTEGER AS r, round(yhat, 6) AS yhat FROM forecast"),
    "e3_delayed_pairs": (e3, f"WITH {S.FIT} SELECT series_id, t + r AS t, r::INTEGER AS r, round(x, 6) AS x_then, round(y, 6) AS observed FROM pairs"),
    "e4_resumed_forecast": (e4, f"WITH {S.ONLINE} SELECT series_id, t, r::INTEGER AS r, round(yhat, 6) AS yhat FROM forecast"),
    "e4_forecast_by_chunk": (e4_chunks, f"WITH {S.ONLINE} SELECT series_id, t, r::INTEGER AS r, round(yhat, 6) AS yhat FROM forecast"),
    "e5_model_variants": (e5, f"WITH {S.STATIC} SELECT 'static' AS model, {_score} FROM forecast UNION ALL SELECT * FROM (WITH {S.ONLINE} SELECT 'rls' AS model, {_score} FROM forecast)"),
    "e6_gha_step": (e6, f"WITH {S.VECTORS}, {_gha('xu', 'yv')}"),
    "e7_svd_gha_step": (lambda s, d: e6(s, d, True), f"WITH {S.VECTORS}, {_gha('yv', 'xu')}"),
    "e8_gram_schmidt": (
        e8,
        f"WITH {S.VECTORS}, v0 AS (SELECT id, x AS v FROM vec), {_orthonormal(S.DIMS)} SELECT id AS row, (i - 1)::INTEGER AS i, round(v[i], 5) AS q FROM (SELECT id, v, unnest(range(1, {S.DIMS + 1})) AS i FROM v{S.DIMS})",
    ),
    "e9_free_run": (
        e9,
        f"""WITH RECURSIVE {S.FIT}, run AS (
  SELECT m.series_id, te AS t, w0 + w1 * z.value AS yhat, w0, w1 FROM model m JOIN z USING (series_id), cut WHERE r = 1 AND z.t = te - 1
  UNION ALL SELECT series_id, run.t + 1, w0 + w1 * yhat, w0, w1 FROM run, cut WHERE run.t + 1 < te + 5)
SELECT series_id, t, round(yhat, 6) AS yhat FROM run""",
    ),
    "f1_total_score": (lambda s, d: rounded(V.total_score(online_errors(s, d)[0]), "mse", "mae", digits=5), f"WITH {S.ONLINE} SELECT {_score} FROM forecast"),
    "f2_step_scores": (lambda s, d: rounded(V.step_scores(static_errors(s, d)[0]), "mse", "mae", digits=5), f"WITH {S.STATIC} SELECT r::INTEGER AS r, {_score} FROM forecast GROUP BY r"),
    "f2_by_step_map": (f2_map, f"WITH {S.STATIC} SELECT 'sales' AS dataset, 3 AS pred_len, 'static' AS model, r::VARCHAR AS step, round(avg(err * err), 5) AS mse, round(avg(abs(err)), 5) AS mae, count(*)::DOUBLE AS n FROM forecast GROUP BY r"),
    "f3_error_chunks": (lambda s, d: rounded(chunks_of(s, d)[0], "sq", "ab", digits=5), f"WITH {_chunks} SELECT chunk_id, r::INTEGER AS r, round(sq, 5) AS sq, round(ab, 5) AS ab, n FROM chunk"),
    "f4_bootstrap": (
        f4,
        f"WITH {_boot} SELECT (SELECT round(sum(sq) / sum(n), 5) FROM chunk) AS mse, (SELECT round(sum(ab) / sum(n), 5) FROM chunk) AS mae, " + ", ".join(f"round(stddev_samp({m}), 5) AS {m}_se, round(quantile_cont({m}, 0.05::DOUBLE), 5) AS {m}_p5, round(quantile_cont({m}, 0.95::DOUBLE), 5) AS {m}_p95" for m in ("mse", "mae")) + ", 200 AS nboot, 4 AS block, (SELECT k FROM k)::INTEGER AS nchunks, (SELECT k <= 4 FROM k) AS degenerate FROM stat",
    ),
    "f5_seed_summary": (f5, f"WITH {S.PERSIST}, v AS (SELECT series_id, avg(err * err) AS v FROM forecast GROUP BY 1) SELECT right(series_id, 1) AS task, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, count(v) AS n FROM v GROUP BY 1"),
    "f6_nmse": (f6, f"WITH {S.PERSIST} SELECT series_id, round(avg(err * err) / greatest(var_pop(yhat - err), 1e-12), 5) AS nmse FROM forecast GROUP BY 1"),
    "f7_first_crossing": (f7, f"WITH {S.PERSIST}, p AS (SELECT t, sqrt(avg(err * err)) AS rmse FROM forecast GROUP BY t), g AS (SELECT stddev_pop(value) AS sigma FROM z) SELECT min(t) FILTER (WHERE rmse > sigma) AS step, round(min(t) FILTER (WHERE rmse > sigma) * 0.01::DOUBLE * 2, 6) AS horizon FROM p, g"),
    "f8_persistence_floor": (
        f8,
        f"""WITH {S.PERSIST}, cp AS (SELECT series_id, t, sign(value) * least(abs(value), CASE WHEN top < 1e-9 THEN 'infinity'::DOUBLE ELSE top END) AS value FROM panel JOIN stats USING (series_id)),
cs AS (SELECT series_id, avg(value) FILTER (WHERE t < tr) AS mean, stddev_pop(value) FILTER (WHERE t < tr) AS std FROM cp, cut GROUP BY 1),
cz AS (SELECT series_id, t, (value - mean) / CASE WHEN std < 1e-9 THEN 1 ELSE std END AS value FROM cp JOIN cs USING (series_id)),
cf AS (SELECT a.value - b.value AS err FROM cz a JOIN cz b ON b.series_id = a.series_id AND b.t = a.t + 1, cut WHERE a.t >= te)
SELECT 'raw' AS kind, {_score} FROM forecast UNION ALL SELECT 'clipped', {_score} FROM cf""",
    ),
    "f9_outlier_energy": (f9, f"WITH {S.PERSIST}, q AS (SELECT quantile_cont(err * err, 0.995::DOUBLE) AS cut99 FROM forecast) SELECT round(sum(CASE WHEN err * err > cut99 THEN err * err ELSE 0 END) / sum(err * err), 5) AS energy, round(count(*) FILTER (WHERE err * err > cut99) / count(*)::DOUBLE, 5) AS points FROM forecast, q"),
    "f10_autocorrelation": (lambda s, d: rounded(P.autocorrelation(scaled(s, d)[0], 21, 400), "acf", digits=5), f"WITH {S.Z}, x AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS x FROM z), k AS (SELECT unnest(range(0, 22)) AS lag), s AS (SELECT a.series_id, lag, sum(a.x * b.x) AS s FROM x a CROSS JOIN k JOIN x b ON b.series_id = a.series_id AND b.t = a.t + lag GROUP BY ALL) SELECT s.series_id, s.lag::INTEGER AS lag, round(s.s / o.s, 5) AS acf FROM s JOIN s o ON o.series_id = s.series_id AND o.lag = 0"),
    "f11_periodogram": (lambda s, d: rounded(P.periodogram(scaled(s, d)[0], 400), "power", digits=3), f"WITH {S.Z}, {S.BORDERS.replace('size', 'whole').replace('cut', 'ends')}, x AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS x FROM z), wide AS (SELECT t, list(x ORDER BY series_id) AS xs, list(series_id ORDER BY series_id) AS ids FROM x GROUP BY t), k AS (SELECT unnest(range(0, n // 2 + 1)) AS k, n FROM ends), w AS (SELECT t, xs, ids, k, cos(2 * pi() * (k * t % n) / n) AS c, sin(2 * pi() * (k * t % n) / n) AS s FROM wide, k), e AS (SELECT k, unnest(ids) AS series_id, unnest(xs) AS x, c, s FROM w) SELECT series_id, k::BIGINT AS k, round(power(sum(x * c), 2) + power(sum(x * s), 2), 3) AS power FROM e GROUP BY series_id, k"),
    "f12_error_histogram": (f12, f"WITH {S.PERSIST} SELECT CASE WHEN m >= 5 THEN 51 ELSE floor(m / 5::DOUBLE * 50) + 1 END::BIGINT AS bin, count(*) AS n FROM (SELECT round(abs(err), 9) AS m FROM forecast) GROUP BY 1"),
    "a7_a8_result_files": (a7, f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, round(mse, 5) AS mse, round(mae, 5) AS mae, coalesce(n, 0) AS n, clip_spikes FROM result"),
    "a9_a10_published_cells": (a9, f"WITH {S.ROWS} SELECT dataset, method, h, mode, mse FROM cells WHERE dataset IN (SELECT dataset FROM result)"),
    "g1_latest_rows": (lambda s, d: rounded(G.latest_rows(our_rows(s, d)), "mse", "mae", digits=5), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, round(mse, 5) AS mse, round(mae, 5) AS mae, n, clip_spikes, file FROM ours"),
    "g2_untested_rows": (lambda s, d: G.untested(our_rows(s, d)).select("pred_len", "model", "file"), f"WITH {S.ROWS} SELECT pred_len::INTEGER AS pred_len, model, file FROM result WHERE n IS NULL"),
    "g3_against_published": (lambda s, d: rounded(pairs(s, d).select("dataset", "pred_len", "model", "method", "mode", "mse", "published"), "mse", digits=5), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, method, mode, round(mse, 5) AS mse, published FROM against"),
    "g4_best_published": (lambda s, d: G.best_published(cells(s, d).join(our_rows(s, d).select("dataset").distinct(), "dataset", "left_semi")), f"WITH {S.ROWS} SELECT dataset, h, method, mode, mse FROM (SELECT *, row_number() OVER (PARTITION BY dataset, h ORDER BY mse, method, mode) AS k FROM cells WHERE dataset = 'sales') WHERE k = 1"),
    "g5_beats": (lambda s, d: G.beats(pairs(s, d)), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, count(*) FILTER (WHERE mse < published AND abs(mse - published) >= 1e-9) AS beaten, count(*) FILTER (WHERE abs(mse - published) < 1e-9) AS tied, count(*) AS total FROM against GROUP BY ALL"),
    "g6_ranks": (lambda s, d: rounded(G.rank_summary(G.ranked(G.latest_rows(our_rows(s, d)).where(~G.corrected()), cells(s, d))), "mean_rank"), f"WITH {S.ROWS}, k AS (SELECT pred_len, model, count(*) FILTER (WHERE published < mse) + 1 AS rank FROM against GROUP BY ALL) SELECT model, round(avg(rank), 6) AS mean_rank, count(*) FILTER (WHERE rank = 1) AS n_first, count(*) FILTER (WHERE rank = 2) AS n_second, count(*) AS n FROM k GROUP BY model"),
    "g7_corrected_rows": (lambda s, d: G.latest_rows(our_rows(s, d)).select("pred_len", "model", G.corrected().alias("corrected")), f"WITH {S.ROWS} SELECT pred_len::INTEGER AS pred_len, model, clip_spikes > 0 AS corrected FROM ours"),
    "g8_best_model": (lambda s, d: rounded(G.best_model(G.latest_rows(our_rows(s, d)).where(~G.corrected()), ["seasonal", "persistence", "mean"]), "mse", digits=5), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, min_by(model, mse) AS model, round(min(mse), 5) AS mse FROM ours WHERE clip_spikes = 0 GROUP BY 1, 2"),
    "g9_relative_difference": (lambda s, d: rounded(G.relative_difference(pairs(s, d)), "batch", "dsof", digits=4), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, method, round(max((mse - published) / published * 100) FILTER (WHERE mode = 'batch'), 4) AS batch, round(max((mse - published) / published * 100) FILTER (WHERE mode = 'dsof'), 4) AS dsof FROM against GROUP BY ALL"),
    "g10_model_delta": (lambda s, d: rounded(G.model_delta(with_se(our_rows(s, d)).where(~G.corrected()), "persistence", "mean"), "delta", "delta_se", digits=4), f"WITH {S.ROWS}, k AS (SELECT * FROM result WHERE n IS NOT NULL AND clip_spikes = 0) SELECT a.dataset, a.pred_len::INTEGER AS pred_len, round((b.mse - a.mse) / a.mse * 100, 4) AS delta, round(sqrt(a.mse * a.mse + b.mse * b.mse) / 10 / a.mse * 100, 4) AS delta_se FROM k a JOIN k b USING (dataset, pred_len) WHERE a.model = 'persistence' AND b.model = 'mean'"),
    "g11_damping": (lambda s, d: rounded(G.damping(our_rows(s, d).where("n IS NOT NULL")), "raw", "clipped", "ratio", digits=5), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, round(max(mse) FILTER (WHERE clip_spikes = 0), 5) AS raw, round(max(mse) FILTER (WHERE clip_spikes > 0), 5) AS clipped, round(max(mse) FILTER (WHERE clip_spikes = 0) / max(mse) FILTER (WHERE clip_spikes > 0), 5) AS ratio FROM result WHERE n IS NOT NULL GROUP BY ALL"),
    "g12_horizon_sweep": (lambda s, d: rounded(G.horizon_sweep((r := with_se(our_rows(s, d)).where(~G.corrected())), G.against_published(r, cells(s, d)), r), "mse", "mse_p5", "mse_p95", digits=5), f"WITH {S.ROWS}, k AS (SELECT * FROM result WHERE n IS NOT NULL AND clip_spikes = 0), c AS (SELECT k.pred_len, k.model, count(*) FILTER (WHERE k.mse < c.mse) AS beaten FROM k JOIN cells c ON c.dataset = k.dataset AND c.h = k.pred_len GROUP BY ALL) SELECT dataset, k.pred_len::INTEGER AS pred_len, k.model, round(mse, 5) AS mse, beaten, round(mse * 0.9, 5) AS mse_p5, round(mse * 1.2, 5) AS mse_p95 FROM k LEFT JOIN c USING (pred_len, model)"),
    "g13_whiskers": (lambda s, d: rounded(G.whiskers((r := with_se(our_rows(s, d))).drop("mse_p5", "mse_p95"), r), "down", "up", digits=5), f"WITH {S.ROWS} SELECT dataset, pred_len::INTEGER AS pred_len, model, clip_spikes AS clip, round(mse - mse * 0.9, 5) AS down, round(mse * 1.2 - mse, 5) AS up FROM result WHERE n IS NOT NULL"),
    "g14_mode_pairs": (lambda s, d: G.mode_pairs(cells(s, d).join(our_rows(s, d).select("dataset").distinct(), "dataset", "left_semi")), f"WITH {S.ROWS} SELECT dataset, h, method, max(mse) FILTER (WHERE mode = 'batch') AS batch, max(mse) FILTER (WHERE mode = 'dsof') AS dsof FROM cells WHERE dataset = 'sales' GROUP BY ALL"),
    "h1_softmax_retrieval": (lambda s, d: retrieve(s, d, 1), f"WITH {S.VECTORS}, {_soft('vec', 'r1')} {_entries.format('r1')}"),
    "h1_retrieval_by_slices": (lambda s, d: retrieve(s, d, 1, 200), f"WITH {S.VECTORS}, {_soft('vec', 'r1')} {_entries.format('r1')}"),
    "h1_stream_pruned": (lambda s, d: pruned(s, d, 40.0), f"WITH {S.VECTORS}, {_soft('vec', 'r1', 40.0)} {_entries.format('r1').replace('6)', '5)')}"),
    "h2_refinement": (lambda s, d: retrieve(s, d, 2), f"WITH {S.VECTORS}, {_soft('vec', 'r1')}, {_soft('r1', 'r2')} {_entries.format('r2')}"),
}
