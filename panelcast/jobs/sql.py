"""DuckDB building blocks of the oracle queries: common table expressions that end without a comma."""

PANEL = """fact AS (
  SELECT n_name AS series_id, date_trunc('day', l_shipdate) AS stamp, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
span AS (SELECT min(stamp)::TIMESTAMP AS lo, max(stamp)::TIMESTAMP AS hi FROM fact),
days AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS stamp FROM span),
panel AS (
  SELECT s.series_id, date_diff('day', lo, days.stamp)::BIGINT AS t, coalesce(f.value, 0.0)::DOUBLE AS value
  FROM (SELECT DISTINCT series_id FROM fact) s CROSS JOIN days LEFT JOIN fact f ON f.series_id = s.series_id AND f.stamp = days.stamp)"""

HOURLY = """efact AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS stamp, round(sum(value), 4) AS value FROM events GROUP BY 1, 2),
espan AS (SELECT min(stamp)::TIMESTAMP AS lo, max(stamp)::TIMESTAMP AS hi FROM efact),
hours AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS stamp FROM espan),
hourly AS (
  SELECT s.series_id, date_diff('hour', lo, hours.stamp)::BIGINT AS t, coalesce(f.value, 0.0)::DOUBLE AS value, hours.stamp
  FROM (SELECT DISTINCT series_id FROM efact) s CROSS JOIN hours LEFT JOIN efact f ON f.series_id = s.series_id AND f.stamp = hours.stamp)"""

#: The hourly panel as far as a stream has closed it whose rows may be two hours late: all but the last two hours.
CLOSED = f"""{HOURLY},
closed AS (SELECT h.* FROM hourly h, espan WHERE stamp + INTERVAL 2 HOUR <= hi),
size AS (SELECT max(t) + 1 AS n FROM hourly),
cut AS (SELECT n, floor(n * 0.2::DOUBLE)::BIGINT AS tr, floor(n * 0.2::DOUBLE)::BIGINT + floor(n * 0.05::DOUBLE)::BIGINT AS te FROM size),
z AS (SELECT series_id, t, value FROM closed)"""

BORDERS = """size AS (SELECT max(t) + 1 AS n FROM panel),
cut AS (SELECT n, floor(n * 0.2::DOUBLE)::BIGINT AS tr, floor(n * 0.2::DOUBLE)::BIGINT + floor(n * 0.05::DOUBLE)::BIGINT AS te FROM size)"""

STATS = """stats AS (
  SELECT series_id, avg(value) FILTER (WHERE t < tr) AS mean, stddev_pop(value) FILTER (WHERE t < tr) AS raw_std,
         max(abs(value)) FILTER (WHERE t < tr) AS top FROM panel, cut GROUP BY series_id),
z AS (
  SELECT series_id, t, (value - mean) / CASE WHEN raw_std < 1e-9 THEN 1.0 ELSE raw_std END AS value
  FROM panel JOIN stats USING (series_id))"""

Z = f"{PANEL},\n{BORDERS},\n{STATS}"

#: Values 1..3 steps ahead, as windows.
PAIRS = """ahead AS (
  SELECT series_id, t, value AS x, [lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w] AS ys
  FROM z WINDOW w AS (PARTITION BY series_id ORDER BY t)),
pairs AS (SELECT * FROM (SELECT series_id, t, unnest([1, 2, 3]) AS r, x, unnest(ys) AS y FROM ahead) WHERE y IS NOT NULL)"""

#: Ridge of z[t + r] on [1, z[t]] over the train origins, r = 1..3, relative penalty 1e-3, by Cramer's rule.
FIT = f"""{Z},
{PAIRS},
sums AS (
  SELECT series_id, r, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy
  FROM pairs, cut WHERE t + r < tr GROUP BY ALL),
reg AS (SELECT *, n + 1e-3::DOUBLE * (n + sxx) / 2 AS a11, sx AS a12, sxx + 1e-3::DOUBLE * (n + sxx) / 2 AS a22 FROM sums),
model AS (
  SELECT *, (sy * a22 - sxy * a12) / (a11 * a22 - a12 * a12) AS w0, (a11 * sxy - a12 * sy) / (a11 * a22 - a12 * a12) AS w1 FROM reg)"""

STATIC = f"""{FIT},
forecast AS (
  SELECT p.series_id, p.t, p.r, w0 + w1 * p.x AS yhat, w0 + w1 * p.x - p.y AS err
  FROM pairs p JOIN model USING (series_id, r), cut WHERE p.t >= te)"""

#: The same ridge with the rows seen so far from the test start on: a row's window ends at the pair whose target is its own step. No joins.
ONLINE = f"""{Z},
{PAIRS},
used AS (
  SELECT series_id, t, r, x, y, te, CASE WHEN t + r < tr THEN 1.0::DOUBLE ELSE 0 END AS k, CASE WHEN t + r < tr OR t + r >= te THEN 1.0::DOUBLE ELSE 0 END AS m
  FROM pairs, cut),
seen AS (
  SELECT series_id, t, r, x, y, te, 1e-3::DOUBLE * sum(k + k * x * x) OVER (PARTITION BY series_id, r) / 2 AS pen, sum(m) OVER w AS n,
         sum(m * x) OVER w AS sx, sum(m * x * x) OVER w AS sxx, sum(m * y) OVER w AS b1, sum(m * x * y) OVER w AS b2
  FROM used WINDOW w AS (PARTITION BY series_id, r ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND r PRECEDING)),
solved AS (
  SELECT series_id, t, r, x, y, (b1 * (sxx + pen) - b2 * sx) / ((n + pen) * (sxx + pen) - sx * sx) AS w0,
         ((n + pen) * b2 - sx * b1) / ((n + pen) * (sxx + pen) - sx * sx) AS w1 FROM seen WHERE t >= te),
forecast AS (SELECT series_id, t, r, w0 + w1 * x AS yhat, w0 + w1 * x - y AS err FROM solved)"""

PERSIST = f"""{Z},
forecast AS (
  SELECT a.series_id, a.t, 1 AS r, a.value AS yhat, a.value - b.value AS err
  FROM z a JOIN z b ON b.series_id = a.series_id AND b.t = a.t + 1, cut WHERE a.t >= te)"""

#: Result rows of three simple forecasts on the panel, and cells to hold them against: seasonal forecasts one and two steps ahead by
#: cadences other than ours, scored over all test origins (batch) and over the later half (dsof), and one of a second dataset.
CADENCES = {"Monthly": 30, "Yearly": 364}

ROWS = f"""{Z},
near AS (
  SELECT series_id, t, value AS x, lead(value, 1) OVER k AS y1, lead(value, 2) OVER k AS y2, lag(value, 6) OVER k AS s1, lag(value, 5) OVER k AS s2
  FROM z WINDOW k AS (PARTITION BY series_id ORDER BY t)),
due AS (
  SELECT 1 AS r, x, y1 AS y, s1 AS s FROM near, cut WHERE t >= te AND y1 IS NOT NULL
  UNION ALL SELECT 2, x, y2, s2 FROM near, cut WHERE t >= te AND y2 IS NOT NULL),
each AS (
  SELECT r, 'persistence' AS model, x - y AS err FROM due UNION ALL SELECT r, 'seasonal', s - y FROM due
  UNION ALL SELECT r, 'mean', -y FROM due),
result AS (
  SELECT 'sales' AS dataset, r AS pred_len, model, avg(err * err) AS mse, avg(abs(err)) AS mae, count(*) AS n,
         0.0::DOUBLE AS clip_spikes, 'a' AS file FROM each GROUP BY r, model
  UNION ALL SELECT 'sales', r, model, avg(err * err) / 2, avg(abs(err)) / 2, count(*), 3.0, 'b' FROM each GROUP BY r, model
  UNION ALL SELECT 'sales', r, model, avg(err * err) * 3, avg(abs(err)) * 3, NULL, 0.0, 'c' FROM each GROUP BY r, model),
ours AS (
  SELECT dataset, pred_len, model, mse, mae, n, clip_spikes, file FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, pred_len, model, clip_spikes ORDER BY (n IS NOT NULL) DESC, file DESC) AS k FROM result)
  WHERE k = 1),
past AS (
  SELECT t, {", ".join(f"lag(value, {c - h}) OVER k - lead(value, {h}) OVER k AS {m}{h}" for m, c in CADENCES.items() for h in (1, 2))}
  FROM z WINDOW k AS (PARTITION BY series_id ORDER BY t)),
scored AS ({" UNION ALL ".join(f"SELECT '{m}' AS method, {h} AS h, t, {m}{h} AS err FROM past, cut WHERE t >= te AND t + {h} < n" for m in CADENCES for h in (1, 2))}),
cells AS (
  SELECT 'sales' AS dataset, method, h, 'batch' AS mode, round(avg(err * err), 5) AS mse FROM scored GROUP BY method, h
  UNION ALL SELECT 'sales', method, h, 'dsof', round(avg(err * err), 5) FROM scored, cut WHERE t >= te + (n - te) // 2 GROUP BY method, h
  UNION ALL SELECT 'stock', 'Mean', 1, 'batch', round(avg(value * value), 5) FROM z, cut WHERE t >= te),
against AS (
  SELECT o.*, c.method, c.mode, c.mse AS published FROM ours o JOIN cells c ON c.dataset = o.dataset AND c.h = o.pred_len WHERE o.clip_spikes = 0)"""

#: Vectors: x the first half of an embedding (32 dimensions), y its second half, mask 0 for every fifth.
DIMS = 32

VECTORS = """vec AS (
  SELECT vec_id AS id, embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y,
         CASE WHEN vec_id % 5 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM embeddings),
ij AS (SELECT b, i, j FROM (SELECT unnest(range(0, 16)) AS b) CROSS JOIN (SELECT unnest([1, 2]) AS i) CROSS JOIN (SELECT unnest([1, 2]) AS j)),
mass AS (SELECT sum(mask) AS m FROM vec),
raw AS (
  SELECT b, i, j, sum(mask * x[2 * b + i] * x[2 * b + j]) AS a, sum(mask * x[2 * b + i] * y[2 * b + j]) AS c,
         sum(mask * y[2 * b + i] * y[2 * b + j]) AS ya, sum(mask * y[2 * b + i] * x[2 * b + j]) AS yc FROM vec CROSS JOIN ij GROUP BY ALL),
fin AS (
  SELECT b, i, j, a / m + CASE WHEN i = j THEN 0.02 ELSE 0 END AS a, c / m + CASE WHEN i = j THEN 0.01 ELSE 0 END AS c,
         ya / m + CASE WHEN i = j THEN 0.02 ELSE 0 END AS ya, yc / m + CASE WHEN i = j THEN 0.01 ELSE 0 END AS yc FROM raw, mass),
two AS (
  SELECT b, max(a) FILTER (WHERE i = 1 AND j = 1) AS p, max(a) FILTER (WHERE i = 1 AND j = 2) AS q, max(a) FILTER (WHERE i = 2 AND j = 2) AS s,
         max(c) FILTER (WHERE i = 1 AND j = 1) AS c11, max(c) FILTER (WHERE i = 1 AND j = 2) AS c12,
         max(c) FILTER (WHERE i = 2 AND j = 1) AS c21, max(c) FILTER (WHERE i = 2 AND j = 2) AS c22,
         max(ya) FILTER (WHERE i = 1 AND j = 1) AS yp, max(ya) FILTER (WHERE i = 1 AND j = 2) AS yq, max(ya) FILTER (WHERE i = 2 AND j = 2) AS ys,
         max(yc) FILTER (WHERE i = 1 AND j = 1) AS d11, max(yc) FILTER (WHERE i = 1 AND j = 2) AS d12,
         max(yc) FILTER (WHERE i = 2 AND j = 1) AS d21, max(yc) FILTER (WHERE i = 2 AND j = 2) AS d22 FROM fin GROUP BY b)"""
