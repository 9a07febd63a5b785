"""Normal equations, ridge solves and their application.

``features`` tables are (series_id, t, value, phi). Gram sums are made in Arrow batches by NumPy, added up within a task, and
merged across tasks in two steps, so a long series is summed in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import kernels
from panelcast.sources.storage import stored

SALTS = 32
HELD_BYTES = 1 << 27


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def added(parts: DataFrame, keys: tuple[str, ...], arrays: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the element-wise sums of equally long arrays and the sums of numbers.

    Rows are added up as they stream by, in ``SALTS`` parts of each key first and then in one, so a task holds one sum at a time
    and no key's rows meet in one task unsummed, however many there are.
    """
    import pandas as pd

    def adding(by: list[str]):
        names = [*by, *arrays, *numbers]

        def run(batches):
            import numpy as np

            at, total = None, None
            for g in batches:
                done = []
                for row in zip(*(g[c].tolist() for c in names), strict=True):
                    key = row[: len(by)]
                    now = [np.asarray(v, dtype=float) if i < len(arrays) else v for i, v in enumerate(row[len(by) :])]
                    if total is not None and key == at:
                        total = [x + y for x, y in zip(total, now, strict=True)]
                        continue
                    if total is not None:
                        done.append((*at, *total))
                    at, total = key, now
                if done:
                    yield pd.DataFrame(done, columns=names)
            if total is not None:
                yield pd.DataFrame([(*at, *total)], columns=names)

        return run

    salted = parts.select(*keys, *arrays, *numbers, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    for by in ([*keys, "_salt"], list(keys)):
        dealt = salted.repartition(*by).sortWithinPartitions(*by) if by else salted.repartition(1)
        head = ", ".join(f"{c} {salted.schema[c].dataType.simpleString()}" for c in (*by, *arrays, *numbers))
        salted = dealt.mapInPandas(adding(by), head)
    return salted


def prefix_sums(parts: DataFrame, keys: tuple[str, ...], at: str, arrays: tuple[str, ...], n: int, fan: int = 16) -> DataFrame:
    """Each row's arrays replaced by their element-wise sums over the key's rows before it, in the order of ``at`` (0 to n - 1).

    Rows are summed in runs of ``fan``, the runs' totals in turn, and so on; then what lies before a run is added to its rows. A task streams over one run
    and holds one sum, so neither all rows of a key nor a chain of n steps meet in one task.
    """
    import pandas as pd

    run = F.floor(F.col(at) / fan).cast("long")
    rows = parts.select(*keys, F.col(at).cast("long").alias("_at"), run.alias("_run"), *arrays)
    by = [*keys, "_run"]
    names = [*by, "_at", *arrays]

    def summing(batches):
        import numpy as np

        key, total = None, None
        for g in batches:
            out = []
            for row in zip(*(g[c].tolist() for c in names), strict=True):
                now = [np.asarray(v, dtype=float) for v in row[len(by) + 1 :]]
                if row[: len(by)] != key:
                    if key is not None:
                        out.append((*key, None, *total))
                    key, total = row[: len(by)], [v * 0 for v in now]
                out.append((*row[: len(by) + 1], *total))
                total = [x + y for x, y in zip(total, now, strict=True)]
            if out:
                yield pd.DataFrame(out, columns=names).astype({"_at": "Int64"})
        if key is not None:
            yield pd.DataFrame([(*key, None, *total)], columns=names).astype({"_at": "Int64"})

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    within = rows.repartition(*by).sortWithinPartitions(*by, "_at").mapInPandas(summing, head)
    if n <= fan:
        return within.where("_at IS NOT NULL").select(*keys, F.col("_at").alias(at), *arrays)
    within = stored(within, "runs")  # read twice: the rows and the runs' totals
    before = prefix_sums(within.where("_at IS NULL"), keys, "_run", arrays, -(-n // fan), fan).select(*by, *[F.col(a).alias(f"_before_{a}") for a in arrays])
    plus = [F.zip_with(a, f"_before_{a}", lambda x, y: x + y).alias(a) for a in arrays]
    return within.where("_at IS NOT NULL").join(before, by).select(*keys, F.col("_at").alias(at), *plus)


def train_pairs(features: DataFrame, train_end: int, horizon: int, lookback: int) -> DataFrame:
    """Features of the train origins with their targets; a target past the train end is null."""
    from panelcast.operators.features import targets

    rows = targets(features, horizon)
    y = F.transform("y", lambda v, i: F.when(F.col("t") + i + 1 < train_end, v))
    return rows.where((F.col("t") >= lookback - 1) & (F.col("t") < train_end - 1)).withColumn("y", y)


def _gram_parts(pairs: DataFrame, horizon: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, kind, a, b, n) as tasks leave them. Kind 0: phi phi' over all rows, phi y and the rows a step, over rows with a target. What a step lacks of the first: kind -1, the
    rows themselves (phi and which steps miss it) where a task has at most ``horizon`` of them, as the last rows of a series are; else kind r, a sum a step."""
    import pandas as pd

    names = list(keys)

    def run(batches):
        import numpy as np

        held: dict = {}

        def out():
            rows = []
            for key, (whole, b, n, few, lost) in held.items():
                rows.append((*key, 0, whole.ravel(), b.ravel(), n))
                rows += [(*key, -1, p, m.astype(float), []) for p, m in few]
                rows += [(*key, r + 1, a.ravel(), [], []) for r, a in lost.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*names, "kind", "a", "b", "n"])

        for batch in batches:
            for key, g in batch.groupby(names, sort=False):
                phi = np.array(g["phi"].tolist(), dtype=float)
                y = np.array(g["y"].tolist(), dtype=float)
                missing = np.isnan(y)
                f = phi.shape[1]
                if key not in held:
                    held[key] = [np.zeros((f, f)), np.zeros((horizon, f)), np.zeros(horizon), [], {}]
                sums = held[key]
                sums[0] += phi.T @ phi
                sums[1] += np.where(missing, 0.0, y).T @ phi
                sums[2] += (~missing).sum(0)
                part = missing.any(1)
                sums[3] += list(zip(phi[part], missing[part], strict=True))
                if len(sums[3]) > horizon or sums[4] and sums[3]:
                    p, m = (np.array(x) for x in zip(*sums[3], strict=True))
                    sums[3] = []
                    for r in np.flatnonzero(m.any(0)):
                        sums[4][r] = sums[4].get(r, 0.0) + p[m[:, r]].T @ p[m[:, r]]
                if len(held) * (horizon + 1) * f * f * 8 > HELD_BYTES:
                    yield out()
        if held:
            yield out()

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*names).schema)
    return pairs.select(*names, "phi", "y").mapInPandas(run, f"{head}, kind int, a array<double>, b array<double>, n array<double>")


def whole_sums(pairs: DataFrame, horizon: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, a, b, n): phi phi' over all rows, and over the rows with a target phi y (a row a step) and how many there are."""
    return added(_gram_parts(pairs, horizon, keys).where("kind = 0"), keys, ("a", "b", "n"))


def gram(pairs: DataFrame, horizon: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, r, a, b, n): per step r the sums phi phi' (row-major), phi y and the rows, over rows whose target is not null.

    One sum phi phi' a key leaves the tasks and is merged; what a step lacks of it is taken off where the key's sums end up.
    """
    import pandas as pd

    names = list(keys)

    def expanded(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        whole = g[g["kind"] == 0].iloc[0]
        b = np.array(whole["b"]).reshape(horizon, -1)
        f, few = b.shape[1], g[g["kind"] == -1]
        p, m = np.array(few["a"].tolist()).reshape(-1, f), np.array(few["b"].tolist()).reshape(-1, horizon) > 0
        lost = dict(zip(g["kind"], g["a"], strict=True))
        rows = []
        for r in range(1, horizon + 1):
            a = np.array(whole["a"]).reshape(f, f) - p[m[:, r - 1]].T @ p[m[:, r - 1]] - (np.array(lost[r]).reshape(f, f) if r in lost else 0.0)
            rows.append((*(whole[k] for k in names), r, a.ravel(), b[r - 1], int(round(whole["n"][r - 1]))))
        return pd.DataFrame(rows, columns=[*names, "r", "a", "b", "n"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*names).schema)
    parts = stored(_gram_parts(pairs, horizon, keys), "sums")  # read twice: rows to add, rows to take off
    sums = added(parts.where("kind >= 0"), (*names, "kind"), ("a", "b", "n")).unionByName(parts.where("kind < 0"))
    return sums.groupBy(*names).applyInPandas(expanded, f"{head}, r int, a array<double>, b array<double>, n long").where("n > 0")


def solve_relative(sums: DataFrame, lam: float, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, r, w, a_inv): ridge with lam times the mean diagonal added."""
    import pandas as pd

    def run(batches):
        import numpy as np

        for g in batches:
            got = [kernels.relative_ridge(np.array(a).reshape(len(b), len(b)), np.array(b), lam) for a, b in zip(g["a"], g["b"], strict=True)]
            yield pd.DataFrame({**{k: g[k] for k in keys}, "r": g["r"], "w": [w for w, _ in got], "a_inv": [i.ravel() for _, i in got]})

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema)
    return sums.mapInPandas(run, f"{head}, r int, w array<double>, a_inv array<double>")


def fit_ridge(features: DataFrame, train_end: int, horizon: int, lookback: int, lam: float = 1e-3) -> DataFrame:
    return solve_relative(gram(train_pairs(features, train_end, horizon, lookback), horizon), lam)


def fit_mean_ridge(pairs: DataFrame, horizon: int, lam: float = 1e-3, gamma: float = 0.0) -> DataFrame:
    """Mean-normalised sums over the rows that have a target, and an absolute penalty lam + gamma."""
    import pandas as pd

    def run(batches):
        import numpy as np

        for g in batches:
            w = [np.linalg.solve(np.array(a).reshape(len(b), len(b)) / n + (lam + gamma) * np.eye(len(b)), np.array(b) / n) for a, b, n in zip(g["a"], g["b"], g["n"], strict=True)]
            yield pd.DataFrame({"series_id": g["series_id"], "r": g["r"], "w": w})

    return gram(pairs, horizon).mapInPandas(run, "series_id string, r int, w array<double>")


def forecast(features: DataFrame, model: DataFrame, first: int, steps: int, chunk: int = 4096) -> DataFrame:
    """(series_id, t, r, yhat) from origins ``first`` to the last whose target lies before ``steps``.

    One matrix product per series and ``chunk`` origins with the weights of all r: neither phi nor the weights are copied for each other's rows.
    """
    import pandas as pd

    n_chunks = max(1, -(-(steps - first) // chunk))
    origins = features.where((F.col("t") >= first) & (F.col("t") < steps - 1)).select("series_id", F.floor((F.col("t") - first) / chunk).cast("long").alias("chunk"), "t", "phi")
    heads = model.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<long>")).alias("chunk"), "r", "w")

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(g) or not len(m):
            return pd.DataFrame({"series_id": pd.Series([], dtype=object), "t": pd.Series([], dtype="int64"), "r": pd.Series([], dtype="int32"), "yhat": pd.Series([], dtype="float64")})
        t, r = g["t"].to_numpy(), m["r"].to_numpy()
        yhat = np.array(g["phi"].tolist(), dtype=float) @ np.array(m["w"].tolist(), dtype=float).T
        i, j = np.nonzero(t[:, None] + r[None, :] < steps)
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "t": t[i], "r": r[j], "yhat": yhat[i, j]})

    return origins.groupBy("series_id", "chunk").cogroup(heads.groupBy("series_id", "chunk")).applyInPandas(run, "series_id string, t long, r int, yhat double")


def block_sums(rows: DataFrame, block: int) -> DataFrame:
    """Of (id, x, y, mask): per block of ``block`` dimensions the sums A = m x x', B = m x y' (row-major) and M = m."""
    import pandas as pd

    def run(batches):
        import numpy as np

        total = None
        for g in batches:
            x, y = (np.array(g[c].tolist(), dtype=float).reshape(len(g), -1, block) for c in ("x", "y"))
            m = g["mask"].to_numpy(dtype=float)
            now = [np.einsum("n,nki,nkj->kij", m, x, x), np.einsum("n,nki,nkj->kij", m, x, y), m.sum()]
            total = now if total is None else [p + q for p, q in zip(total, now, strict=True)]
        if total is not None:
            a, b, m = total
            yield pd.DataFrame({"block_id": range(len(a)), "a": [v.ravel() for v in a], "b": [v.ravel() for v in b], "m": m})

    parts = rows.select("x", "y", "mask").mapInPandas(run, "block_id int, a array<double>, b array<double>, m double")
    return added(parts, ("block_id",), ("a", "b"), ("m",))


def finalise(sums: DataFrame, block: int, gamma: float = 0.01, lam: float = 0.01, g: list[list[float]] | None = None) -> DataFrame:
    """A / max(M, 1) + (gamma + lam) I and B / max(M, 1) + gamma G, with G the identity unless given."""
    m = F.greatest("m", F.lit(1.0))
    diagonal = lambda i: F.when(i % (block + 1) == 0, 1.0).otherwise(0.0)
    towards = F.lit([float(v) for row in g for v in row]) if g else None
    aim = lambda i: diagonal(i) if towards is None else F.get(towards, i)
    return sums.select("block_id", "m", F.transform("a", lambda v, i: v / m + (gamma + lam) * diagonal(i)).alias("a"), F.transform("b", lambda v, i: v / m + gamma * aim(i)).alias("b"))


def regularise(blocks: DataFrame, block: int, gamma: float, lam: float, g: list[list[float]] | None = None) -> DataFrame:
    """The same for matrices that are averages already."""
    return finalise(blocks.withColumn("m", F.lit(1.0)), block, gamma, lam, g)


def _per_block(blocks: DataFrame, block: int, f, field: str) -> DataFrame:
    import pandas as pd

    name = field.split()[0]

    def run(batches):
        import numpy as np

        for g in batches:
            yield pd.DataFrame({"block_id": g["block_id"], name: [f(*(np.array(v).reshape(block, block) for v in row)) for row in zip(g["a"], g["b"], strict=True)]})

    return blocks.select("block_id", "a", "b").mapInPandas(run, f"block_id int, {field}")


def positive_definite(blocks: DataFrame, block: int, tol: float = 1e-6) -> DataFrame:
    import numpy as np

    return _per_block(blocks, block, lambda a, b: bool(np.linalg.eigvalsh(a).min() > tol), "is_pd boolean")


def condition_numbers(blocks: DataFrame, block: int) -> DataFrame:
    import numpy as np

    def f(a, b):
        s = np.linalg.svd(a, compute_uv=False)
        return float(s.max() / (s.min() + 1e-12))

    return _per_block(blocks, block, f, "condition double")


def solve_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """w = A^-1 B per block by Cholesky."""
    import numpy as np

    def f(a, b):
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b)).ravel()

    return _per_block(blocks, block, f, "w array<double>")


def backward_projection(rows: DataFrame, block: int, gamma: float, lam: float) -> DataFrame:
    """Masked ridge from y back to x per block."""
    swapped = rows.select(F.col("y").alias("x"), F.col("x").alias("y"), "mask")
    return solve_blocks(finalise(block_sums(swapped, block), block, gamma, lam), block)


def apply_blocks(rows: DataFrame, weights: DataFrame, block: int) -> DataFrame:
    """(id, block_id, out): each row's block times the block's weights, which are broadcast: one row a block of a vector's dimensions, whatever the rows."""
    cut = F.transform(F.sequence(F.lit(0), (F.size("x") / block).cast("int") - 1), lambda k: F.slice("x", k * block + 1, F.lit(block)))
    each = rows.select("id", F.posexplode(cut).alias("block_id", "x")).join(F.broadcast(weights.select("block_id", "w")), "block_id")
    column = lambda j: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.get("w", i * block + j))
    return each.select("id", "block_id", F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda j: dot("x", column(j))).alias("out"))


def woodbury_correction(blocks: DataFrame, block: int, rank: int) -> DataFrame:
    """Low-rank correction across blocks of (block_id, a_inv, w, u, v, p, q), matrices row-major: w - Z C^-1 V'w + (Z_P - Z C_P) Q'.

    Pass 1 sums the rank x rank terms over blocks; the core (one row of 2 rank^2 numbers) then goes to every task.
    """
    import pandas as pd

    def parts(g):
        import numpy as np

        a, w = (np.array(g[c].tolist(), dtype=float).reshape(-1, block, block) for c in ("a_inv", "w"))
        u, v, p, q = (np.array(g[c].tolist(), dtype=float).reshape(-1, block, rank) for c in ("u", "v", "p", "q"))
        return a @ u, a @ p, w, v, q

    def first(batches):
        import numpy as np

        for g in batches:
            z, zp, _, v, _ = parts(g)
            yield pd.DataFrame({"c": [np.einsum("nbi,nbj->ij", v, z).ravel()], "cp": [np.einsum("nbi,nbj->ij", v, zp).ravel()]})

    got = added(blocks.mapInPandas(first, "c array<double>, cp array<double>"), (), ("c", "cp")).first()
    core = (got["c"], got["cp"]) if got else ([0.0] * rank**2, [0.0] * rank**2)

    def second(batches):
        import numpy as np

        c, cp = np.eye(rank) + np.array(core[0]).reshape(rank, rank), np.array(core[1]).reshape(rank, rank)
        for g in batches:
            z, zp, w, v, q = parts(g)
            turned = np.swapaxes(v, 1, 2) @ w
            out = w - z @ np.linalg.solve(c, np.swapaxes(turned, 0, 1).reshape(rank, -1)).reshape(rank, len(g), block).swapaxes(0, 1) + (zp - z @ np.linalg.solve(c, cp)) @ np.swapaxes(q, 1, 2)
            yield pd.DataFrame({"block_id": g["block_id"], "w": list(out.reshape(len(g), -1))})

    return blocks.mapInPandas(second, "block_id int, w array<double>")


def fit_shared(rows: DataFrame, lam: float = 1e-6) -> DataFrame:
    """One row (w): multi-output ridge of (phi, y) over the whole table, relative penalty; w is F x m row-major."""
    import pandas as pd

    def run(batches):
        import numpy as np

        a = b = None
        for g in batches:
            x, y = (np.array(g[c].tolist(), dtype=float) for c in ("phi", "y"))
            a, b = (x.T @ x, x.T @ y) if a is None else (a + x.T @ x, b + x.T @ y)
        if a is not None:
            yield pd.DataFrame({"a": [a.ravel()], "b": [b.ravel()]})

    sums = added(rows.select("phi", "y").mapInPandas(run, "a array<double>, b array<double>"), (), ("a", "b"))

    def solve(batches):
        import numpy as np

        for g in batches:
            out = []
            for a, b in zip(g["a"], g["b"], strict=True):
                f = int(round(len(a) ** 0.5))
                out.append(kernels.relative_ridge(np.array(a).reshape(f, f), np.array(b).reshape(f, -1), lam)[0].ravel())
            yield pd.DataFrame({"w": out})

    return sums.mapInPandas(solve, "w array<double>")
