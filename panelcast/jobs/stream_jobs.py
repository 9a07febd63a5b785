"""Queries over streams: each runs over all that its source holds and ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.jobs import sql as S
from panelcast.jobs.model_jobs import JOBS as MODELS
from panelcast.jobs.model_jobs import HORIZON, two, vectors, wide
from panelcast.jobs.panel_jobs import BANK, CADENCE, _flat, _osc, cuts, rounded
from panelcast.operators import linear as L
from panelcast.operators import maintained as M
from panelcast.operators import retrieval as H
from panelcast.sources.storage import shared_path, table
from panelcast.streaming import series
from panelcast.streaming.online import error_sums, online_stream, running_score
from panelcast.streaming.panels import windowed_panel
from panelcast.streaming.runs import latest, read_stream, run_appended, run_partials, run_sums, run_versions

LAM, PARTS = 1.0, 2
HOUR, DELAY = 3_600_000, "2 hours"


def facts(spark, d):
    """The events as a stream of (series_id, at, amount)."""
    events = read_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    return events.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("amount"))


def x2(spark, d):
    """Hourly sums per event type; hours within two hours of the last event are still open."""
    return run_appended(windowed_panel(facts(spark, d), "1 hour", DELAY), "hours").withColumn("at", F.unix_timestamp("at"))


def hours(spark, d):
    """Steps of an hour from the first event's, and the protocol's cuts over them: parameters that a stream must be given."""
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    low, high = table(spark, d, "events").agg(F.min(hour), F.max(hour)).first()  # one row
    n = (high - low) // HOUR + 1
    return series.Grid(low, HOUR, DELAY), (int(n * 0.2), int(n * 0.2) + int(n * 0.05), n)


def x2_dense(spark, d):
    return run_appended(series.dense_steps(facts(spark, d), hours(spark, d)[0]), "dense")


def c10(spark, d):
    got = run_appended(series.oscillator_steps(facts(spark, d), hours(spark, d)[0], BANK), "oscillators")
    return got.select("series_id", "t", F.posexplode("context").alias("i", "v")).withColumn("v", F.round("v", 5))


def x2_e2(spark, d):
    """From events to forecasts and their errors in one chain; phi is [1, x[t]]."""
    grid, (tr, te, _) = hours(spark, d)
    got = series.forecast_steps(facts(spark, d), grid, tr, te, HORIZON, 1, CADENCE, lam=1e-3, plain=True)
    return rounded(run_appended(got, "forecasts"), "yhat", "err", digits=5)


def e2_full(spark, d):
    """The same at full width: 112 features, a day ahead's first step. No SQL solves it; tests hold it against the batch sweep."""
    grid, (tr, te, _) = hours(spark, d)
    return rounded(run_appended(series.forecast_steps(facts(spark, d), grid, tr, te, 1, 96, 24), "forecasts"), "yhat", "err")


def _arriving(spark, d, run):
    """``run(stream, te, folder)`` over the scaled panel with phi = [1, x[t]], which arrives in ``PARTS`` parts in order of time: after each, the query goes on where it stopped."""
    rows, (_, te, n) = two(spark, d)
    path, folder, out = shared_path(spark, "arriving"), shared_path(spark, "arrived"), None
    rows = rows.select("series_id", "t", "value", "phi")
    for k in range(PARTS):
        rows.where((F.col("t") >= n * k // PARTS) & (F.col("t") < n * (k + 1) // PARTS)).write.mode("append").parquet(path)
        out = run(read_stream(spark, path, rows.schema), te, folder)
    return out


def e2(spark, d):
    return rounded(_arriving(spark, d, lambda rows, te, folder: run_appended(online_stream(rows, HORIZON, 2, LAM, te), "forecasts", folder)), "yhat", "err")


def f1(spark, d):
    return rounded(running_score(_arriving(spark, d, lambda rows, te, folder: run_partials(online_stream(rows, HORIZON, 2, LAM, te), error_sums, "scores", folder))), "mse", "mae", digits=5)


STEPS = 3


def e6(spark, d, svd=False):
    """Vectors arrive in ``STEPS`` parts; each is a step of the two bases, from equal entries and entries of alternating sign."""
    v = vectors(spark, d)
    start = spark.range(S.DIMS).select(F.col("id").cast("int").alias("i"), F.array(F.lit(S.DIMS**-0.5)).alias("u"), F.array(F.lit(S.DIMS**-0.5) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).alias("v"))
    path, folder, out = shared_path(spark, "vectors"), shared_path(spark, "bases"), None
    for k in range(STEPS):
        v.where(F.col("id") % STEPS == k).write.mode("append").parquet(path)
        out = run_versions(read_stream(spark, path, v.schema), start, lambda bases, batch: H.next_bases(bases, batch, 0.5, svd), "bases", folder)
    return rounded(latest(out).select("i", F.get("u", 0).alias("u"), F.get("v", 0).alias("v")), "u", "v")


def d1(spark, d):
    """Block sums of vectors that arrive in ``STEPS`` parts, compacted on the way, and the weights they give."""
    v = vectors(spark, d)
    path, folder, out = shared_path(spark, "vectors"), shared_path(spark, "summed"), None
    sums = M.SumTable(spark, f"{folder}-table", ("block_id",), ("a", "b"), ("m",))
    for k in range(STEPS):
        v.where(F.col("id") % STEPS == k).write.mode("append").parquet(path)
        out = run_sums(read_stream(spark, path, v.schema), lambda batch: L.block_sums(batch, 2), sums, "summed", folder)
        if k == 1:
            sums.compact()
    return wide(L.solve_blocks(L.finalise(out, 2), 2), "w", "w0", "w1", "w2", "w3")


def _gha_steps(of_x: str, of_y: str) -> str:
    """The steps one after the other: bases b0, b1, ... as lists."""
    out = [f"b0 AS (SELECT list_transform(range({S.DIMS}), lambda i: 1 / sqrt({S.DIMS})) AS u, list_transform(range({S.DIMS}), lambda i: (-1) ** i / sqrt({S.DIMS})) AS v)"]
    total = lambda c, by: f"[{', '.join(f'sum(mask * {c}[{i + 1}] * {by})' for i in range(S.DIMS))}]"
    moved = lambda p, e: f"{e} + 0.5::DOUBLE * ({p} - {e} * sum({p} * {e}) OVER ())"
    for k in range(STEPS):
        out.append(f"p{k} AS (SELECT x, y, mask, list_dot_product(x, u) AS xu, list_dot_product(y, u) AS yu, list_dot_product(x, v) AS xv, list_dot_product(y, v) AS yv FROM vec, b{k} WHERE id % {STEPS} = {k})")
        out.append(f"g{k} AS (SELECT {total('x', of_x)} AS a, {total('y', of_y)} AS b, greatest(sum(mask), 1) AS n FROM p{k})")
        out.append(f"s{k} AS (SELECT unnest(range({S.DIMS})) AS i, unnest(a) / n AS pu, unnest(b) / n AS pv, unnest(u) AS eu, unnest(v) AS ev FROM g{k}, b{k})")
        out.append(f"m{k} AS (SELECT i, {moved('pu', 'eu')} AS u, {moved('pv', 'ev')} AS v FROM s{k})")
        out.append(f"b{k + 1} AS (SELECT list(u / len_u ORDER BY i) AS u, list(v / len_v ORDER BY i) AS v FROM (SELECT *, sqrt(sum(u * u) OVER ()) AS len_u, sqrt(sum(v * v) OVER ()) AS len_v FROM m{k}))")
    return f"WITH {S.VECTORS}, {', '.join(out)} SELECT (i - 1)::INTEGER AS i, round(u[i], 6) AS u, round(v[i], 6) AS v FROM (SELECT u, v, unnest(range(1, {S.DIMS + 1})) AS i FROM b{STEPS})"


_stream = f"""WITH {S.Z}, {S.PAIRS},
seen AS (
  SELECT series_id, t + r AS t, r, count(*) OVER w + {LAM} AS a11, sum(x) OVER w AS a12, sum(x * x) OVER w + {LAM} AS a22, sum(y) OVER w AS b1, sum(x * y) OVER w AS b2
  FROM pairs WINDOW w AS (PARTITION BY series_id, r ORDER BY t ROWS UNBOUNDED PRECEDING)),
forecast AS (
  SELECT series_id, t, r, y, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) + (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) * x AS yhat
  FROM pairs JOIN seen USING (series_id, t, r), cut WHERE t >= te)"""

JOBS = {
    "x2_stream_panel": (x2, """SELECT event_type AS series_id, epoch(date_trunc('hour', ts))::BIGINT AS at, round(sum(value), 4) AS value FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2"""),
    "x2_stream_dense": (x2_dense, f"WITH {S.CLOSED} SELECT series_id, t, value FROM closed"),
    "x2_stream_forecast": (x2_e2, f"WITH {S.ONLINE.replace(S.Z, S.CLOSED)} SELECT series_id, t, r::INTEGER AS r, round(yhat, 5) AS yhat, round(err, 5) AS err FROM forecast"),
    "e2_stream_sweep": (e2_full, None),
    "c10_stream_oscillators": (c10, f"WITH {S.CLOSED}, {_osc} {_flat('osc', 'c', 5)}"),
    "d1_stream_sums": (d1, MODELS["d6_block_solve"][1]),
    "e6_stream_steps": (e6, _gha_steps("xu", "yv")),
    "e7_stream_steps": (lambda s, d: e6(s, d, True), _gha_steps("yv", "xu")),
    "e2_stream_forecast": (e2, f"{_stream} SELECT series_id, t, r::INTEGER AS r, round(yhat, 6) AS yhat, round(yhat - y, 6) AS err FROM forecast"),
    "f1_stream_score": (f1, f"{_stream} SELECT round(avg((yhat - y) * (yhat - y)), 5) AS mse, round(avg(abs(yhat - y)), 5) AS mae, count(*) AS n FROM forecast"),
}
