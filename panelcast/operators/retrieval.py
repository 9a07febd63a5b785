"""Softmax retrieval over stored vectors, and streaming subspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import kernels

BANK_BYTES = 1 << 23
BLOCK_BYTES = 1 << 24
MET = 256  # queries that are copied to all blocks they need at a time


def refine(queries: DataFrame, bank: DataFrame, beta: float = 0.1, steps: int = 1) -> DataFrame:
    """(id, out): ``steps`` times softmax(beta r K') V over bank (key, value).

    A bank of few counted bytes goes to every task and all steps run inside the batch; a larger one is met in blocks of rows,
    whose maxima and sums merge exactly (log-sum-exp), one grouping a step.
    """
    import pandas as pd

    if (bank.agg(F.sum(F.size("key") + F.size("value"))).first()[0] or 0) * 8 > BANK_BYTES:
        n = queries.count()
        for _ in range(steps):
            queries = _by_slices(queries, bank, beta, n=n).withColumnRenamed("out", "x")
        return queries.withColumnRenamed("x", "out")
    import numpy as np

    held = bank.select("key", "value").collect()  # at most BANK_BYTES
    spread = queries.sparkSession.sparkContext.broadcast((np.array([r["key"] for r in held], dtype=float), np.array([r["value"] for r in held], dtype=float)))

    def run(batches):
        keys, values = spread.value
        for g in batches:
            r = np.array(g["x"].tolist(), dtype=float)
            for _ in range(steps):
                r = kernels.softmax_step(r, keys, values, beta)
            yield pd.DataFrame({"id": g["id"], "out": list(r)})

    return queries.select("id", "x").mapInPandas(run, "id long, out array<double>")


def _by_slices(queries: DataFrame, bank: DataFrame, beta: float, rows: int = 1024, n: int | None = None) -> DataFrame:
    """One step over a bank of any size: blocks of queries meet blocks of the bank, and each query leaves a maximum, a sum and a weighted vector a block. Inside a task ``rows`` keys are met at a time."""
    spread, parts = _blocks(queries, bank, n)
    return _merged(spread.groupBy("q", "s").cogroup(parts.groupBy("q", "s")).applyInPandas(_block_softmax(beta, rows), PARTIAL))


def _blocks(queries: DataFrame, bank: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (id, x, q, s) and the bank (key, value, copies, s, q), dealt into blocks of about ``BLOCK_BYTES``: a block of queries is copied once a block of the bank, and the other way round, so rows of both travel and not pairs of rows. Equal rows of the bank travel as one."""
    rows = _block_rows(bank)
    n_queries, n_bank = (max(1, -(-k // rows)) for k in (queries.count() if n is None else n, bank.count()))
    deal = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    spread = queries.select("id", "x", deal(n_queries, "id").cast("long").alias("q")).select("id", "x", "q", numbers(n_bank).alias("s"))
    different = bank.groupBy("key", "value").agg(F.count("*").alias("copies"))
    return spread, different.select("key", "value", "copies", deal(n_bank, "key", "value").cast("long").alias("s")).select("key", "value", "copies", "s", numbers(n_queries).alias("q"))


def _block_rows(bank: DataFrame) -> int:
    first = bank.first()
    return max(1, BLOCK_BYTES // (8 * max(1, len(first["key"]) + len(first["value"])) if first else 1))


PARTIAL = "id long, m double, z double, v array<double>"


def _block_softmax(beta: float, rows: int = 1024):
    """The maximum, the sum and the weighted vector that a block of the bank (key, value, copies) adds for each query (id, x) of a block."""
    import numpy as np
    import pandas as pd

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "m": pd.Series([], dtype=float), "z": pd.Series([], dtype=float), "v": pd.Series([], dtype=object)})
        x, keys, values = (np.array(c.tolist(), dtype=float) for c in (q["x"], b["key"], b["value"]))
        m, z, v = kernels.softmax_sums(x, keys, values, beta, b["copies"].to_numpy(dtype=float), rows)
        return pd.DataFrame({"id": q["id"], "m": m, "z": z, "v": list(v)})

    return run


def _matrix(column):
    """An Arrow column of equally long arrays as a matrix, without an object a row."""
    import pyarrow as pa

    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _arrays(matrix):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype="int32")), pa.array(matrix.ravel()))


def _table_softmax(beta: float, rows: int = 1024):
    """``_block_softmax`` on Arrow tables: a block of both sides is held once, with no object a row."""
    import pyarrow as pa

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not len(q) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "m": pa.array([], pa.float64()), "z": pa.array([], pa.float64()), "v": pa.array([], pa.list_(pa.float64()))})
        m, z, v = kernels.softmax_sums(_matrix(q["x"]), _matrix(b["key"]), _matrix(b["value"]), beta, b["copies"].to_numpy().astype(float), rows)
        return pa.table({"id": q["id"], "m": m, "z": z, "v": _arrays(v)})

    return run


def _merged(got: DataFrame) -> DataFrame:
    """(id, out) from ``PARTIAL`` rows, exactly (log-sum-exp)."""
    all_ = got.groupBy("id").agg(F.collect_list(F.struct("m", "z", "v")).alias("p"))  # one entry a block of the bank
    top = F.array_max(F.transform("p", lambda x: x["m"]))
    z = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["z"] * F.exp(x["m"] - F.col("top")))
    v = F.aggregate("p", F.transform(F.get("p", 0)["v"], lambda x: F.lit(0.0)), lambda a, x: F.zip_with(a, x["v"], lambda i, j: i + j * F.exp(x["m"] - F.col("top"))))
    return all_.withColumn("top", top).select("id", v.alias("v"), z.alias("z")).select("id", F.transform("v", lambda x: x / F.col("z")).alias("out"))


class BallBank:
    """A bank (key, value) dealt into blocks of near keys, each with its centre and radius, so that a query can leave out blocks that can't matter.

    With centre c, radius h and n keys, a block's weight for a query r lies between n exp(beta r.c) (the mean of exponentials is no less than
    the exponential of the mean) and n exp(beta (r.c + |r| h)). Blocks are left out, least bound first, while the bounds of those left out add up to at most ``error``
    of what all weigh at least: so they hold at most that share of the weights, and the result moves by no more than ``error`` times the spread of the values.
    """

    def __init__(self, bank: DataFrame, blocks: int = 256):
        """``blocks`` centres are keys of the bank (those of least hash); their number times the dimensions is what tasks are sent."""
        import numpy as np
        import pandas as pd

        from panelcast.operators.linear import added
        from panelcast.sources.storage import stored

        pivots = np.array([r["key"] for r in bank.select("key").distinct().orderBy(F.xxhash64("key")).limit(blocks).collect()], dtype=float)
        spread = bank.sparkSession.sparkContext.broadcast(pivots)

        def nearest(batches):
            p = spread.value
            for g in batches:
                k = np.array(g["key"].tolist(), dtype=float)
                yield g.assign(block=((p * p).sum(1)[None, :] - 2 * k @ p.T).argmin(1).astype("int32"))

        vector = "array<double>"
        different = bank.groupBy("key", "value").agg(F.count("*").alias("copies"))  # equal rows travel as one
        self.rows = stored(different.mapInPandas(nearest, f"key {vector}, value {vector}, copies long, block int"), "bank")
        weighed = self.rows.select("block", F.transform("key", lambda x: x * F.col("copies")).alias("key"), F.col("copies").alias("n"), F.lit(1).cast("long").alias("different"))
        sums = added(weighed, ("block",), ("key",), ("n", "different"))
        centres = sums.select("block", "n", "different", F.transform("key", lambda x: x / F.col("n")).alias("centre"))
        off = F.sqrt(F.aggregate(F.zip_with("key", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        radii = self.rows.join(F.broadcast(centres), "block").groupBy("block").agg(F.max(off).alias("radius"))  # ``blocks`` rows
        self.blocks: pd.DataFrame = centres.join(radii, "block").toPandas()

    def needed(self, queries: DataFrame, beta: float, error: float) -> DataFrame:
        """(id, x, block) for the blocks that each query has to meet."""
        import numpy as np

        sent = queries.sparkSession.sparkContext.broadcast((self.blocks["block"].to_numpy(), self.blocks["n"].to_numpy(dtype=float), np.array(self.blocks["centre"].tolist()), self.blocks["radius"].to_numpy()))

        def run(batches):
            import pandas as pd

            block, n, centre, radius = sent.value
            for g in (b.iloc[i : i + MET] for b in batches for i in range(0, len(b), MET)):
                x = np.array(g["x"].tolist(), dtype=float)
                low = beta * x @ centre.T + np.log(n)
                # A hair more than the radius, for the rounding of the sums above.
                high = low + abs(beta) * np.linalg.norm(x, axis=1)[:, None] * radius * (1 + 1e-9)
                top = high.max(1, keepdims=True)
                least, most = np.exp(low - top).sum(1), np.exp(high - top)
                order = np.argsort(most, axis=1)
                out = np.cumsum(np.take_along_axis(most, order, 1), axis=1) <= error * least[:, None]
                keep = np.ones_like(out)
                np.put_along_axis(keep, order, ~out, 1)
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"id": g["id"].to_numpy()[i], "x": g["x"].to_numpy()[i], "block": block[j]})

        return queries.select("id", "x").mapInPandas(run, "id long, x array<double>, block int")

    def refine(self, queries: DataFrame, beta: float, error: float = 1e-9, rows: int | None = None) -> DataFrame:
        """(id, out): one step of ``refine``, with blocks left out as far as ``error`` allows. Blocks and the queries that need them meet in parts of about ``rows`` rows each (``BLOCK_BYTES`` unless given)."""
        rows = rows or _block_rows(self.rows)
        met = self.needed(queries, beta, error)
        sizes = self.rows.sparkSession.createDataFrame(self.blocks[["block", "different"]]).select(F.col("block").cast("int"), F.ceil(F.col("different") / rows).cast("int").alias("parts"))
        n_queries = max(1, -(-queries.count() // rows))
        deal = lambda n, *columns: F.pmod(F.xxhash64(*columns), n).cast("int")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        sent = met.join(F.broadcast(sizes), "block").select("id", "x", "block", deal(F.lit(n_queries), "id").alias("q"), numbers(F.col("parts")).alias("part"))  # sizes: a row a block
        kept = self.rows.join(F.broadcast(sizes), "block").select("key", "value", "copies", "block", deal(F.col("parts"), "key", "value").alias("part"), numbers(F.lit(n_queries)).alias("q"))
        by = ["block", "part", "q"]
        return _merged(sent.groupBy(*by).cogroup(kept.groupBy(*by)).applyInArrow(_table_softmax(beta), PARTIAL))


def stepped(u, pull, lr: float):
    """The basis moved along ``pull`` less the part of it that lies in the basis already, and orthonormalised."""
    return kernels.orthonormal(u + lr * (pull - u @ (u.T @ pull)))


def gha_step(rows: DataFrame, u, v, lr: float):
    """One masked Oja step of the x and y subspaces (dims x rank) over (x, y, mask): sums of x (x'u) come from the tasks, the small update and re-orthonormalising are the driver's."""
    gx, gy, n = _cross(rows, lambda x, y: (x.T @ (x @ u), y.T @ (y @ v)), u.shape, v.shape)
    return stepped(u, gx / max(n, 1.0), lr), stepped(v, gy / max(n, 1.0), lr)


def svd_gha_step(rows: DataFrame, p, q, lr: float):
    """One masked step of the cross-covariance's singular subspaces."""
    gx, gy, n = _cross(rows, lambda x, y: (x.T @ (y @ q), y.T @ (x @ p)), p.shape, q.shape)
    return stepped(p, gx / max(n, 1.0), lr), stepped(q, gy / max(n, 1.0), lr)


def next_bases(bases: DataFrame, rows: DataFrame, lr: float, svd: bool = False) -> DataFrame:
    """One step of both bases as a table (i, u ARRAY, v ARRAY), a row a dimension, over a micro-batch of (x, y, mask). Bases are small: a row a dimension of a vector, whatever the rows."""
    import numpy as np

    held = sorted((r["i"], r["u"], r["v"]) for r in bases.collect())
    u, v = (np.array([r[k] for r in held], dtype=float) for k in (1, 2))
    got = (svd_gha_step if svd else gha_step)(rows, u, v, lr)
    return bases.sparkSession.createDataFrame([(i, *(g[k].tolist() for g in got)) for k, (i, _, _) in enumerate(held)], "i int, u array<double>, v array<double>").coalesce(1)


def _cross(rows: DataFrame, f, sx, sy):
    import numpy as np
    import pandas as pd

    from panelcast.operators.linear import added

    def run(batches):
        total = None
        for g in batches:
            m = g["mask"].to_numpy(dtype=float)
            x, y = (np.array(g[c].tolist(), dtype=float) * m[:, None] for c in ("x", "y"))
            now = [*f(x, y), float(m.sum())]
            total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
        if total is not None:
            yield pd.DataFrame({"a": [total[0].ravel()], "b": [total[1].ravel()], "n": [total[2]]})

    r = added(rows.select("x", "y", "mask").mapInPandas(run, "a array<double>, b array<double>, n double"), (), ("a", "b"), ("n",)).first()
    if r is None:
        return np.zeros(sx), np.zeros(sy), 0.0
    return np.array(r["a"]).reshape(sx), np.array(r["b"]).reshape(sy), r["n"]


def gram_schmidt(columns: DataFrame, rank: int) -> DataFrame:
    """Orthonormalise the columns of a tall table (row, v ARRAY), whatever its rows: two passes.

    With the sums V'V = R'R (Cholesky), V R^-1 is what Gram-Schmidt makes of V; the second pass removes what rounding has left, as
    does going over each column twice. rank^2 numbers leave a task. Columns that depend on each other are an error.
    """
    import numpy as np
    import pandas as pd

    from panelcast.operators.linear import added

    def products(batches):
        for g in batches:
            v = np.array(g["v"].tolist(), dtype=float)
            yield pd.DataFrame({"g": [(v.T @ v).ravel()]})

    now = columns.select("row", "v")
    for _ in range(2):
        sums = added(now.select("v").mapInPandas(products, "g array<double>"), (), ("g",)).first()
        if sums is None:
            return now
        try:
            turned = np.linalg.inv(np.linalg.cholesky(np.array(sums["g"]).reshape(rank, rank)).T)
        except np.linalg.LinAlgError as e:
            raise ValueError("the columns depend on each other") from e

        def turn(batches, turned=turned):
            for g in batches:
                yield g.assign(v=list(np.array(g["v"].tolist(), dtype=float) @ turned))

        now = now.mapInPandas(turn, now.schema)
    return now
