"""Source divergence audit: how far apart the term distributions of the sources of a language are, and by which terms.

A language keeps the terms that stand in at least ``MIN_DOCS`` of its documents. Each (lang, source) group, and each language as a whole, gives every kept
term a smoothed share in billionths; two shares p and q differ by floor((p - q)^2 / (p + q)), and the divergence of two groups is the sum over all kept terms.

That sum is split in two, both exact in whole numbers. Heavy terms, which stand in many of a language's groups, are put in dense NumPy tiles (groups by
terms), and blocks of groups are held against each other. Rare terms start from the sum that two groups would have if neither held one; then each group's
own rare terms (by their distinct counts) correct its sums, and the short posting lists of the terms that several groups hold correct the pairs.

Only group and term sums leave the tasks, so a hot source or term is one row a task. A tile has at most about ``TILE`` terms and ``BLOCK`` groups a side, a posting list at
most ``LONGEST_POSTING`` groups (longer ones are heavy), whatever the corpus; pairs of groups are the result itself. Tables of groups and languages are joined, not broadcast by force.

Null text, lang and source are ''; a text without terms still makes its group occur; a language without kept terms has divergences of 0 and no term rows; long texts count whole;
repeated rows are documents of their own; values that tie are ranked by the UTF-8 bytes of the item; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import table, written

MIN_DOCS, TOP = 10, 10
TILE, BLOCK, LONGEST_POSTING, HELD_PAIRS, HELD_TERMS = 1024, 128, 256, 1 << 20, 1 << 19
#: What separates terms, byte by byte: all of ASCII but letters. Capitals become small letters; bytes beyond ASCII stay.
BYTES = bytes(ord(chr(i).lower()) if chr(i).isalpha() and i < 128 else 32 if i < 128 else i for i in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; one row with a null term stands for every group that occurs.

    A task counts the terms of what it meets and passes them on when it holds ``HELD_TERMS`` or more.
    """

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        held: dict = {}

        def out():
            for (lang, source), (n, d) in held.items():
                for at, terms in enumerate([[None]] + [list(n)[i : i + HELD_TERMS] for i in range(0, len(n), HELD_TERMS)]):
                    size = len(terms)
                    counts = [[c[t] for t in terms] if at else [0] for c in (n, d)]
                    term = pa.array(terms, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * size, pa.string()), "source": pa.array([source] * size, pa.string()), "term": term, "n": pa.array(counts[0], pa.int64()), "docs": pa.array(counts[1], pa.int64())})
            held.clear()

        for b in batches:
            lang, source = (b.column(i).to_pylist() for i in (0, 1))
            for k, text in zip(zip(lang, source, strict=True), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if k not in held:
                    held[k] = Counter(), Counter()
                words = text.translate(BYTES).split()
                held[k][0].update(words)
                held[k][1].update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from out()
        yield from out()

    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).alias("text"))
    counted = said.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(n: str, total: str, kept: str) -> Column:
    """p = 1 + floor(10^9 (n + 2) / (N + 2 V)), exact: three digits of the long division at a time stay within 64 bits."""
    whole = f"({total} + 2 * {kept})"
    step = f"struct(1000 * a.d + (1000 * a.r) div {whole} AS d, (1000 * a.r) % {whole} AS r)"
    start = f"struct(({n} + 2) div {whole} AS d, ({n} + 2) % {whole} AS r)"
    return F.expr(f"1 + aggregate(array(1, 2, 3), {start}, (a, k) -> {step}).d")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


class Counts:
    """The stored tables of one audit: groups (lang, source, g, total, kept), kept (lang, term, n, groups, heavy, lang_total) and held, the groups' counts of kept terms."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = written(term_counts(docs), "term-counts")
        found = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("groups")).where(F.col("docs") >= min_docs)
        found = written(found.drop("docs"), "kept-terms")
        occurring = counts.where("term IS NULL").select("lang", "source")
        sizes = occurring.groupBy("lang").agg(F.count("*").alias("n_groups"))
        langs = sizes.join(found.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left").fillna(0)
        langs = written(langs, "languages")
        # A dense term costs (groups)^2 / 2 cheap steps, a posting list (its groups)^2 / 2 dear ones.
        heavy = F.col("groups") > F.least(F.greatest(F.col("n_groups") / 4, F.lit(1)), F.lit(LONGEST_POSTING))
        kept = found.join(langs, "lang").withColumn("heavy", heavy)
        held = counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"])
        totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        numbered = Window.partitionBy("lang").orderBy("source")  # the sources of a language, which the result pairs
        groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", "kept", "n_groups", (F.row_number().over(numbered) - 1).alias("g"), F.coalesce("total", F.lit(0)).alias("total"))
        self.groups = written(groups, "groups")
        self.langs = written(langs.join(kept.groupBy("lang").agg(F.count_if("heavy").alias("n_heavy")), "lang", "left").fillna(0), "language-sizes")
        self.held = written(held.join(self.groups.select("lang", "source", "g", "total"), ["lang", "source"]), "held-terms")


def term_part(c: Counts, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, the ``top`` that add most; tasks pass on their own ``top`` of a group."""
    rows = c.held.select("lang", "source", F.col("term").alias("item"), smoothed("n", "total", "kept").alias("p"), smoothed("lang_n", "lang_total", "kept").alias("q")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "item", apart("p", "q").alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


PAIRS = "lang string, a int, b int, value long"


def _shares(n, total: int, kept: int):
    """``smoothed`` of an array of counts."""
    import numpy as np

    whole = total + 2 * kept
    d, r = np.divmod(np.asarray(n, dtype=np.int64) + 2, whole)
    for _ in range(3):
        q, r = np.divmod(r * 1000, whole)
        d = d * 1000 + q
    return d + 1


def _apart(p, q):
    return (p - q) ** 2 // (p + q)


def _pairs(lang, a, b, value):
    import pandas as pd

    return pd.DataFrame({"lang": pd.Series([lang] * len(a), dtype=object), "a": a, "b": b, "value": value})


def _blocks(n_groups: str) -> str:
    return f"cast((({n_groups}) + {BLOCK - 1}) div {BLOCK} AS int)"


def _dealt(rows: DataFrame, tile: Column) -> DataFrame:
    """A copy of each row of a group for every pair of group blocks with its own, lower block first."""
    block = F.expr(f"g div {BLOCK}").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.expr(_blocks("n_groups")) - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y")))
    return rows.withColumn("tile", tile).withColumn("_b", F.explode(pairs)).select("*", "_b.x", "_b.y").drop("_b")


def heavy_sums(c: Counts) -> DataFrame:
    """(lang, a, b, value), a < b: the sums over heavy terms, one row a tile of terms."""
    import pandas as pd

    n_tiles = F.expr(f"cast((n_heavy + {TILE - 1}) div {TILE} AS int)")
    langs = c.langs.where("n_heavy > 0").select("lang", n_tiles.alias("n_tiles"))
    rows = c.held.where("heavy").join(langs, "lang").select("lang", "term", "g", "n", "n_groups", "n_tiles")
    rows = _dealt(rows, F.expr("pmod(xxhash64(term), n_tiles)").cast("int")).select("lang", "tile", "x", "y", "term", "g", "n")
    groups = c.groups.join(langs, "lang").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    groups = _dealt(groups, F.col("_t")).select("lang", "tile", "x", "y", "g", "total", "kept")

    def run(held: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(held) or not len(of):
            return _pairs("", np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=int))
        of = of.sort_values("g").reset_index(drop=True)
        column, names = pd.factorize(held["term"])
        n = np.zeros((len(of), len(names)), dtype=np.int64)
        n[np.searchsorted(of["g"].to_numpy(), held["g"].to_numpy()), column] = held["n"].to_numpy()
        p = np.stack([_shares(row, int(t), int(k)) for row, t, k in zip(n, of["total"], of["kept"], strict=True)])
        g, (x, y) = of["g"].to_numpy(), of[["x", "y"]].iloc[0]
        left, right = (np.flatnonzero(g // BLOCK == z) for z in (x, y))
        out = [(i, right[g[right] > g[i]]) for i in left]
        out = [(i, j, _apart(p[i], p[j]).sum(1)) for i, j in out if len(j)]
        if not out:
            return _pairs("", np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=int))
        return _pairs(of["lang"].iloc[0], np.concatenate([np.full(len(j), g[i]) for i, j, _ in out]), np.concatenate([g[j] for _, j, _ in out]), np.concatenate([v for _, _, v in out]))

    keys = ["lang", "tile", "x", "y"]
    return rows.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInPandas(run, PAIRS)


def rare_sums(c: Counts) -> DataFrame:
    """(lang, a, b, value), a < b, for every pair of groups: the sums over rare terms as if no two groups shared one. Per group only how many rare terms it has of each count is needed."""
    import pandas as pd

    per = c.held.where("NOT heavy").groupBy("lang", "g", "n", "n_groups").agg(F.count("*").alias("times"))
    zero = F.lit(0)
    per = _dealt(per, zero).select("lang", "x", "y", "g", "n", "times")
    groups = _dealt(c.groups.join(c.langs.select("lang", "n_heavy"), "lang"), zero).select("lang", "x", "y", "g", "total", "kept", (F.col("kept") - F.col("n_heavy")).alias("rare"))

    def run(counts: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        of = of.sort_values("g")
        g, (x, y), kept, rare = of["g"].to_numpy(), of[["x", "y"]].iloc[0], int(of["kept"].iloc[0]), int(of["rare"].iloc[0])
        if kept == 0:
            base = np.ones(len(g), dtype=np.int64)
        else:
            base = np.array([_shares(0, int(t), kept) for t in of["total"]], dtype=np.int64)
        # own[i, j]: what group i's rare terms add to its sum with j, over two groups without any.
        none = _apart(base[:, None], base[None, :])
        own, place = np.zeros((len(g), len(g)), dtype=np.int64), {int(v): i for i, v in enumerate(g)}
        for name, part in counts.groupby("g"):
            i = place[int(name)]
            p = _shares(part["n"].to_numpy(), int(of["total"].iloc[i]), kept)
            for n, times in zip(p, part["times"], strict=True):
                own[i] += times * (_apart(n, base) - none[i])
        whole = rare * none + own + own.T
        i, j = np.nonzero((g[:, None] < g[None, :]) & (g[:, None] // BLOCK == x) & (g[None, :] // BLOCK == y))
        return _pairs(of["lang"].iloc[0], g[i], g[j], whole[i, j])

    keys = ["lang", "x", "y"]
    return per.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInPandas(run, PAIRS)


def shared_rare(c: Counts) -> DataFrame:
    """(lang, a, b, value), a < b: what the posting lists of rare terms that several groups hold change in ``rare_sums``; a task adds up what it meets."""
    import pandas as pd

    one = F.struct("g", "n", "total")
    lists = c.held.where("NOT heavy AND groups > 1").groupBy("lang", "term").agg(F.first("kept").alias("kept"), F.sort_array(F.collect_list(one)).alias("p"))  # LONGEST_POSTING groups at most

    def run(batches):
        import numpy as np

        held: dict = {}

        def out():
            rows = [(lang, a, b, v) for (lang, a, b), v in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "a", "b", "value"])

        for batch in batches:
            for lang, kept, p in zip(batch["lang"], batch["kept"], batch["p"], strict=True):
                g = np.array([e["g"] for e in p])
                base = np.array([int(_shares(0, e["total"], kept)) for e in p], dtype=np.int64)
                full = np.array([int(_shares(e["n"], e["total"], kept)) for e in p], dtype=np.int64)
                i, j = np.triu_indices(len(g), 1)
                change = _apart(full[i], full[j]) - _apart(full[i], base[j]) - _apart(base[i], full[j]) + _apart(base[i], base[j])
                for a, b, v in zip(g[i].tolist(), g[j].tolist(), change.tolist(), strict=True):
                    held[lang, a, b] = held.get((lang, a, b), 0) + v
                if len(held) > HELD_PAIRS:
                    yield out()
        if held:
            yield out()

    return lists.mapInPandas(run, PAIRS)


def pair_part(c: Counts) -> DataFrame:
    """(lang, source, item, value, rank): the divergence of every group from every other source of its language."""
    sums = heavy_sums(c).unionByName(rare_sums(c)).unionByName(shared_rare(c)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = written(sums, "pairs")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda g, as_: c.groups.select("lang", F.col("g").alias(g), F.col("source").alias(as_))
    named = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    c = Counts(docs, min_docs)
    parts = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in (("pair", pair_part(c)), ("term", term_part(c, top)))]
    return parts[0].unionByName(parts[1])


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '@UPPER@', '@LOWER@'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM used GROUP BY ALL HAVING sum(docs) >= 10),
size AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, k.n AS lang_n
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM dense GROUP BY ALL),
p AS (
  SELECT d.lang, d.source, d.term, d.n, (1 + 1000000000::HUGEINT * (d.n + 2) // (t.total + 2 * s.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (d.lang_n + 2) // (s.total + 2 * s.v))::BIGINT AS q
  FROM dense d JOIN totals t ON t.lang = d.lang AND t.source = d.source JOIN size s ON s.lang = d.lang),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
        FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 10
""".replace("@UPPER@", string.ascii_uppercase).replace("@LOWER@", string.ascii_lowercase)
