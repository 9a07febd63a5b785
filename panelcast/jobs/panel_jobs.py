"""Queries over sources, splits, scaling and features (groups A, B, C and X), each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.jobs import sql as S
from panelcast.operators import features as X
from panelcast.operators import protocol as B
from panelcast.sources import files, panels
from panelcast.sources.storage import kept, shared_path

LOOKBACK, CADENCE = 7, 7
BANK = [(0.5, 0.3, 1.0), (0.8, 1.1, 0.5)]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sales(spark: SparkSession, d: str) -> DataFrame:
    """The daily panel per nation, built once a session."""
    return kept(spark, d, "sales", lambda: panels.nation_daily(spark, d))


def cuts(panel: DataFrame) -> tuple[int, int, int]:
    """Train end, test start and number of steps."""
    n = panels.steps(panel)
    b = B.fraction_borders(n)
    return b[0][2], b[2][1], n


def scaled(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int, int]]:
    p = sales(spark, d)
    c = cuts(p)
    return B.zscore(p, c[0]), c


def a1(spark, d):
    hourly = panels.event_hourly(spark, d)
    names = sorted(r[0] for r in hourly.select("series_id").distinct().collect())
    wide = files.to_wide(hourly, names).withColumn("at", F.format_string("row %d", "t"))
    path = shared_path(spark, "wide-csv")
    wide.orderBy("t").select("at", *names).coalesce(1).write.csv(path, header=True)
    return files.to_long(files.read_timed_csv(spark, path, names))


def a2(spark, d):
    hourly = panels.event_hourly(spark, d)
    names = sorted(r[0] for r in hourly.select("series_id").distinct().collect())
    path = shared_path(spark, "mixed-csv")
    files.to_wide(hourly, names).withColumn("note", F.lit("x")).orderBy("t").select("note", *names).coalesce(1).write.csv(path, header=True)
    return files.to_long(files.read_numeric_csv(spark, path))


def a3(spark, d):
    hourly = panels.event_hourly(spark, d)
    names = sorted(r[0] for r in hourly.select("series_id").distinct().collect())
    path = shared_path(spark, "text-gz")
    files.to_wide(hourly, names).orderBy("t").select(F.concat_ws(",", *[F.col(n).cast("string") for n in names]).alias("value")).coalesce(1).write.option("compression", "gzip").text(path)
    return files.read_delimited(spark, path)


def a4(spark, d):
    hourly = panels.event_hourly(spark, d)
    names = sorted(r[0] for r in hourly.select("series_id").distinct().collect())
    return files.to_long(files.to_wide(hourly, names))


def a5(spark, d):
    p = sales(spark, d)
    return B.trim(p, 100).withColumn("part", F.lit("head")).unionByName(B.trim(p, 50, tail=True).withColumn("part", F.lit("tail")))


def b1(spark, d):
    p = sales(spark, d)
    return B.with_phase(p, B.fraction_borders(panels.steps(p)))


def c4_rows(spark, d, fill=None):
    return X.lag_vector(scaled(spark, d)[0], LOOKBACK, fill)


NAMES = X.feature_names(LOOKBACK, 3)


def named_phi(rows: DataFrame) -> DataFrame:
    """phi as named columns. Spectra of constant windows are rounding noise over 1e-9, so values are compared to 4 digits."""
    return rows.select("series_id", "t", *[F.round(F.get("phi", i), 4).alias(n) for i, n in enumerate(NAMES)])


def c8(spark, d):
    z, _ = scaled(spark, d)
    return named_phi(X.feature_slice(z, 100, 50, LOOKBACK, CADENCE, 3))


def flat_phi(rows: DataFrame) -> DataFrame:
    """One row an entry."""
    return rows.select("series_id", "t", F.posexplode("phi").alias("i", "v")).withColumn("v", F.round("v", 6))


def c9(spark, d):
    hourly = panels.event_hourly(spark, d)
    holes = hourly.withColumn("value", F.when((F.col("t") >= 5) & (F.col("t") != 9), F.col("value")))
    return B.fill_leading(holes)


def c10(spark, d, chunk=None):
    z, _ = scaled(spark, d)
    got = X.oscillators(z, BANK) if chunk is None else X.oscillators_by_chunk(z, BANK, chunk)
    return got.select("series_id", "t", F.posexplode("context").alias("i", "v")).withColumn("v", F.round("v", 6))


def c12(spark, d):
    z, _ = scaled(spark, d)
    base = z.withColumn("phi", F.array(F.lit(1.0), F.col("value")))
    return flat_phi(X.with_context(base, X.oscillators(z, BANK)))


#: Modes (radius, angle) and their input weights, one row a mode.
MODES, INPUTS = [(0.5, 0.3), (0.8, 1.1), (0.7, 2.0)], [[1.0, 0.5], [-0.25, 1.0], [0.3, 0.3]]


def c11(spark, d, chunk=None):
    """Inputs: the value and the phase's cosine."""
    z, _ = scaled(spark, d)
    x = z.select("series_id", "t", F.array("value", X.phase(F.col("t"), CADENCE)[1]).alias("x"))
    out = X.linear_recurrence(x, MODES, INPUTS, chunk)
    return out.select("series_id", "t", F.posexplode("out").alias("i", "v")).withColumn("v", F.round("v", 6))


def c15(spark, d):
    z, _ = scaled(spark, d)
    return flat_phi(X.delay_embedding(z, 2, 2))


def c16(spark, d):
    z, _ = scaled(spark, d)
    e = X.delay_embedding(z, 1)
    return flat_phi(e.withColumn("phi", X.quadratic_lift(F.col("phi"))))


def c17(spark, d):
    z, _ = scaled(spark, d)
    return flat_phi(X.lag_vector(z, 5).withColumn("phi", X.padded(F.col("lags"), 4)))


def c18(spark, d):
    z, _ = scaled(spark, d)
    rows = X.lag_vector(z, 6).withColumn("v", X.padded(F.col("lags"), 4)).select("series_id", "t", "v")
    return X.to_blocks(rows, "v", 4).select("series_id", "t", "block_id", F.posexplode("v").alias("i", "v")).withColumn("v", F.round("v", 6))


def x3(spark, d):
    z, _ = scaled(spark, d)
    return rounded(panels.with_halo(z, 100, LOOKBACK), "value")


_phases = "list_filter([CASE WHEN t < tr THEN 'train' END, CASE WHEN t >= tr AND t < te THEN 'val' END, CASE WHEN t >= te THEN 'test' END], lambda x: x IS NOT NULL)"
_month = "CASE WHEN t < 120 THEN 'train' END, CASE WHEN t >= 113 AND t < 150 THEN 'val' END, CASE WHEN t >= 143 AND t < 600 THEN 'test' END"
_lags7 = "[" + ", ".join(f"lag(value, {k}) OVER w" for k in range(6, 0, -1)) + ", value]"
_stat = """avg(value) OVER k AS mean, stddev_pop(value) OVER k AS std, min(value) OVER k AS min, max(value) OVER k AS max"""
_wins = "WINDOW w AS (PARTITION BY series_id ORDER BY t), k AS (PARTITION BY series_id ORDER BY t ROWS 6 PRECEDING), k5 AS (PARTITION BY series_id ORDER BY t ROWS 5 PRECEDING)"


def _dft(k: int) -> str:
    part = lambda f: " + ".join(f"{f(2 * math.pi * k * j / 7)!r}::DOUBLE * coalesce(l[{j + 1}], 0)" for j in range(7))
    return f"sqrt(({part(math.cos)}) * ({part(math.cos)}) + ({part(math.sin)}) * ({part(math.sin)}))"


def _spec(bins: int) -> str:
    mags = [f"m{k}" for k in range(1, bins + 1)]
    return f"""st AS (SELECT series_id, t, value, value - lag(value) OVER w AS trend, {_stat}, {_lags7} AS l FROM z {_wins}),
sd AS (SELECT *, avg(abs(trend)) OVER k5 AS avgdiff FROM st {_wins}),
sp AS (SELECT *, {", ".join(f"{_dft(k)} AS m{k}" for k in range(1, bins + 1))} FROM sd),
phi AS (SELECT series_id, t, value, list_concat([mean, std, min, max, avgdiff, trend], list_concat(l, [{", ".join(f"{m} / ({' + '.join(mags)} + 1e-9::DOUBLE)" for m in mags)},
  sin(2 * pi() / 7 * (t % 7)), cos(2 * pi() / 7 * (t % 7))])) AS phi FROM sp)"""


def _flat(source: str, column: str = "phi", digits: int = 6) -> str:
    return f"SELECT series_id, t, (i - 1)::INTEGER AS i, round({column}[i], {digits}) AS v FROM (SELECT series_id, t, {column}, unnest(range(1, len({column}) + 1)) AS i FROM {source})"


_named = "SELECT series_id, t, " + ", ".join(f"round(phi[{i + 1}], 4) AS {n}" for i, n in enumerate(NAMES)) + " FROM phi"


#: Past inputs, newest first, as far as 0.8 to that power matters in the digits compared.
_past = "WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS 149 PRECEDING)"


def _sum(column: str, r: float, angle: float, f: str) -> str:
    return f"list_sum(list_transform({column}, lambda v, k: power({r}::DOUBLE, k - 1) * {f}({angle}::DOUBLE * (k - 1)) * v))"


_osc = f"""back AS (SELECT series_id, t, value, list_reverse(list(value) OVER w) AS l FROM z {_past}),
osc AS (SELECT series_id, t, value, [{", ".join(f"{b}::DOUBLE * {_sum('l', r, a, f)}" for f in ("cos", "sin") for r, a, b in BANK)}] AS c FROM back)"""
_rec = f"""back AS (SELECT series_id, t, list_reverse(list(value) OVER w) AS l, list_reverse(list(cos(2 * pi() / 7 * (t % 7))) OVER w) AS m FROM z {_past}),
rec AS (SELECT series_id, t, [{", ".join(f"{b[0]}::DOUBLE * {_sum('l', r, a, 'cos')} + {b[1]}::DOUBLE * {_sum('m', r, a, 'cos')}" for (r, a), b in zip(MODES, INPUTS, strict=True))}] AS c FROM back)"""


JOBS = {
    "x1_dense_panel": (panels.nation_daily, f"WITH {S.PANEL} SELECT series_id, t, value FROM panel"),
    "x1_supplier_weekly": (
        panels.supplier_weekly,
        """WITH f AS (SELECT l_suppkey::VARCHAR AS series_id, date_trunc('week', l_shipdate) AS stamp, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem GROUP BY 1, 2),
w AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS stamp FROM (SELECT min(stamp)::TIMESTAMP AS lo, max(stamp)::TIMESTAMP AS hi FROM f))
SELECT s.series_id, (date_diff('day', lo, w.stamp) // 7)::BIGINT AS t, coalesce(f.value, 0.0)::DOUBLE AS value
FROM (SELECT DISTINCT series_id FROM f) s CROSS JOIN w LEFT JOIN f ON f.series_id = s.series_id AND f.stamp = w.stamp""",
    ),
    "a1_timed_csv": (a1, f"WITH {S.HOURLY} SELECT series_id, t, value FROM hourly"),
    "a2_numeric_csv": (a2, f"WITH {S.HOURLY} SELECT series_id, t, value FROM hourly"),
    "a3_delimited_gzip": (a3, f"WITH {S.HOURLY} SELECT printf('c%03d', dense_rank() OVER (ORDER BY series_id) - 1) AS series_id, t, value FROM hourly"),
    "a4_wide_and_long": (a4, f"WITH {S.HOURLY} SELECT series_id, t, value FROM hourly"),
    "a5_trim": (a5, f"WITH {S.PANEL}, {S.BORDERS} SELECT series_id, t, value, 'head' AS part FROM panel WHERE t < 100 UNION ALL SELECT series_id, t - (n - 50), value, 'tail' FROM panel, cut WHERE t >= n - 50"),
    "a6_shape": (lambda s, d: B.shape_report(panels.nation_daily(s, d), 25, 2499), f"WITH {S.PANEL} SELECT count(DISTINCT series_id) AS n_series, max(t) + 1 AS n_steps, count(*) AS n_rows, count(DISTINCT series_id) = 25 AND max(t) + 1 = 2499 AND count(*) = 25 * 2499 AS matches FROM panel"),
    "b1_fraction_split": (b1, f"WITH {S.PANEL}, {S.BORDERS} SELECT series_id, t, value, unnest({_phases}) AS phase FROM panel, cut"),
    "b2_calendar_split": (lambda s, d: B.with_phase(panels.nation_daily(s, d), B.calendar_borders(30, 7)), f"WITH {S.PANEL} SELECT series_id, t, value, unnest(list_filter([{_month}], lambda x: x IS NOT NULL)) AS phase FROM panel"),
    "b3_phase_counts": (lambda s, d: B.phase_counts(panels.nation_daily(s, d), B.calendar_borders(30, 7)), f"WITH {S.PANEL}, p AS (SELECT t, unnest(list_filter([{_month}], lambda x: x IS NOT NULL)) AS phase FROM panel) SELECT phase, count(DISTINCT t) AS n_steps FROM p GROUP BY phase"),
    "b4_train_stats": (
        lambda s, d: rounded(B.train_stats(p := sales(s, d), cuts(p)[0]).select("series_id", "mean", "std", "train_max_abs"), "mean", "std", "train_max_abs", digits=4),
        f"WITH {S.Z} SELECT series_id, round(mean, 4) AS mean, round(CASE WHEN raw_std < 1e-9 THEN 1.0 ELSE raw_std END, 4) AS std, round(top, 4) AS train_max_abs FROM stats",
    ),
    "b5_zscore": (lambda s, d: rounded(scaled(s, d)[0], "value"), f"WITH {S.Z} SELECT series_id, t, round(value, 6) AS value FROM z"),
    "b6_zscore_eps": (lambda s, d: rounded(B.zscore(p := sales(s, d), cuts(p)[0], 1e-8), "value"), f"WITH {S.Z} SELECT series_id, t, round((value - mean) / (raw_std + 1e-8::DOUBLE), 6) AS value FROM panel JOIN stats USING (series_id)"),
    "b7_clip_spikes": (lambda s, d: rounded(B.clip_spikes(p := sales(s, d), cuts(p)[0], 1.0), "value", digits=4), f"WITH {S.Z} SELECT series_id, t, round(sign(value) * least(abs(value), CASE WHEN top < 1e-9 THEN 'infinity'::DOUBLE ELSE top END), 4) AS value FROM panel JOIN stats USING (series_id)"),
    "b8_clip_report": (lambda s, d: B.clip_report(p := sales(s, d), cuts(p)[0], 1.0), f"WITH {S.Z} SELECT count(*) FILTER (WHERE abs(value) > top) AS n_points, count(DISTINCT series_id) FILTER (WHERE abs(value) > top) AS n_series FROM panel JOIN stats USING (series_id) WHERE top >= 1e-9"),
    "b9_burn_split": (lambda s, d: B.burn_split(panels.nation_daily(s, d), 200, 100), f"WITH {S.PANEL} SELECT series_id, t, value, CASE WHEN t < 200 THEN 'train' ELSE 'test' END AS part FROM panel WHERE t < 200 OR t >= 300"),
    "b10_range_conflict": (
        lambda s, d: rounded(B.range_conflict(*((x := scaled(s, d))[0], x[1][0], x[1][1])), "train_max", "train_max_abs", "train_p99_abs", "test_max_abs"),
        f"WITH {S.Z} SELECT series_id, round(max(value) FILTER (WHERE t < tr), 6) AS train_max, round(max(abs(value)) FILTER (WHERE t < tr), 6) AS train_max_abs, round(quantile_cont(abs(value), 0.99::DOUBLE) FILTER (WHERE t < tr), 6) AS train_p99_abs, round(max(abs(value)) FILTER (WHERE t >= te), 6) AS test_max_abs FROM z, cut GROUP BY series_id",
    ),
    "b10_histogram": (
        lambda s, d: B.histogram((x := scaled(s, d))[0].where(F.col("t") >= x[1][1]).withColumn("m", F.round(F.abs("value"), 9)), "m", 0.0, 12.0, 120),
        f"WITH {S.Z} SELECT CASE WHEN m >= 12 THEN 121 ELSE floor(m / 12::DOUBLE * 120) + 1 END::BIGINT AS bin, count(*) AS n FROM (SELECT round(abs(value), 9) AS m FROM z, cut WHERE t >= te) GROUP BY 1",
    ),
    "c1_c3_window_stats": (
        lambda s, d: rounded(X.window_stats(scaled(s, d)[0], LOOKBACK), "value", "mean", "std", "min", "max", "avgdiff", "trend"),
        f"WITH {S.Z}, {_spec(3)} SELECT series_id, t, round(value, 6) AS value, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(avgdiff, 6) AS avgdiff, round(trend, 6) AS trend FROM sd",
    ),
    "c4_lag_vector": (lambda s, d: c4_rows(s, d).select("series_id", "t", F.posexplode("lags").alias("i", "v")).withColumn("v", F.round("v", 6)), f"WITH {S.Z}, {_spec(3)} {_flat('sd', 'l')}"),
    "c5_spectrum": (
        lambda s, d: X.spectrum(scaled(s, d)[0], LOOKBACK).select("series_id", "t", F.posexplode("bins").alias("i", "v")).withColumn("v", F.round("v", 4)),
        f"WITH {S.Z}, {_spec(6)}, b AS (SELECT series_id, t, phi[14:19] AS phi FROM phi) {_flat('b', digits=4)}",
    ),
    "c6_phase": (
        lambda s, d: rounded(sales(s, d).select("series_id", "t", *[c.alias(n) for c, n in zip(X.phase(F.col("t"), CADENCE), ("s", "c"), strict=True)]), "s", "c"),
        f"WITH {S.PANEL} SELECT series_id, t, round(sin(2 * pi() / 7 * (t % 7)), 6) AS s, round(cos(2 * pi() / 7 * (t % 7)), 6) AS c FROM panel",
    ),
    "c7_features": (lambda s, d: named_phi(X.feature_rows(scaled(s, d)[0], LOOKBACK, CADENCE, 3)), f"WITH {S.Z}, {_spec(3)} {_named}"),
    "c8_feature_slice": (c8, f"WITH {S.Z}, {_spec(3)} {_named} WHERE t >= 100 AND t < 150"),
    "c9_fill_leading": (c9, f"WITH {S.HOURLY} SELECT series_id, t, CASE WHEN t < 5 THEN max(value) FILTER (WHERE t = 5) OVER (PARTITION BY series_id) WHEN t = 9 THEN NULL ELSE value END AS value FROM hourly"),
    "c10_oscillators": (c10, f"WITH {S.Z}, {_osc} {_flat('osc', 'c')}"),
    "c10_oscillators_by_chunk": (lambda s, d: c10(s, d, 300), f"WITH {S.Z}, {_osc} {_flat('osc', 'c')}"),
    "c11_linear_recurrence": (c11, f"WITH {S.Z}, {_rec} {_flat('rec', 'c')}"),
    "c11_oscillators_by_chunk": (lambda s, d: c11(s, d, 300), f"WITH {S.Z}, {_rec} {_flat('rec', 'c')}"),
    "c12_with_context": (c12, f"WITH {S.Z}, {_osc}, q AS (SELECT series_id, t, list_concat([1.0::DOUBLE, value], c) AS phi FROM osc) {_flat('q')}"),
    "c13_targets": (lambda s, d: X.targets(scaled(s, d)[0], 3).select("series_id", "t", F.posexplode("y").alias("i", "v")).withColumn("v", F.round("v", 6)), f"WITH {S.Z}, y AS (SELECT series_id, t, [lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w] AS y FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)) {_flat('y', 'y')}"),
    "c14_by_horizon": (lambda s, d: rounded(X.by_horizon(scaled(s, d)[0], 3), "value", "target"), f"WITH {S.Z}, {S.PAIRS} SELECT series_id, t, round(x, 6) AS value, r, round(y, 6) AS target FROM pairs"),
    "c15_delay_embedding": (c15, f"WITH {S.Z}, e AS (SELECT series_id, t, CASE WHEN t < 4 THEN [0.0::DOUBLE, 0, 0, 0] ELSE [1.0::DOUBLE, value, lag(value, 2) OVER w, lag(value, 4) OVER w] END AS phi FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)) {_flat('e')}"),
    "c16_quadratic_lift": (c16, f"WITH {S.Z}, e AS (SELECT series_id, t, value AS a, lag(value) OVER w AS b FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)), q AS (SELECT series_id, t, CASE WHEN t < 1 THEN [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0] ELSE [1.0::DOUBLE, a, b, 1, a, b, a * a, a * b, b * b] END AS phi FROM e) {_flat('q')}"),
    "c17_padded": (c17, f"WITH {S.Z}, q AS (SELECT series_id, t, [" + ", ".join(f"coalesce(lag(value, {k}) OVER w, 0)" for k in (4, 3, 2, 1, 0)) + f", 0, 0, 0] AS phi FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)) {_flat('q')}"),
    "c18_blocks": (c18, f"WITH {S.Z}, q AS (SELECT series_id, t, [" + ", ".join(f"coalesce(lag(value, {k}) OVER w, 0)" for k in (5, 4, 3, 2, 1, 0)) + ", 0, 0] AS phi FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, ((i - 1) // 4)::INTEGER AS block_id, ((i - 1) % 4)::INTEGER AS i, round(phi[i], 6) AS v FROM (SELECT series_id, t, phi, unnest(range(1, 9)) AS i FROM q)"),
    "x3_time_chunks": (x3, f"WITH {S.Z} SELECT series_id, (t // 100)::BIGINT AS chunk, t, round(value, 6) AS value, false AS halo FROM z UNION ALL SELECT series_id, (t // 100 + 1)::BIGINT, t, round(value, 6), true FROM z WHERE t % 100 >= 94"),
}
