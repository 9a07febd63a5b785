"""Line dedup by winnowing over line hashes.

A document is its sequence of lines with a word, each trimmed and hashed. A line is deleted if it lies in a later copy of a run: a stretch of
``window`` lines or more, or one line of ``long_words`` words or more, that also stands at an earlier place, in order of id and line. A document
of fewer lines than a window is one window. What is deleted in one stretch must have ``min_words`` words, else it stays.

1. Winnowing: in every window the least hash (the last of equal ones) is a fingerprint, so both copies of a run have the same ones; long
   lines are fingerprints of their own. Fingerprints that stand at one place only leave here.
2. Positions of the others are joined by their extension: the match is extended both ways over the windows in which the line is the
   fingerprint. The windows of a run follow one another, so their union is the whole run.
3. Each extension's first place stays; at every later place its lines are deleted.

A hot line costs one row per map task and extension in the search for first places; the joins back
are ordinary equi-joins that adaptive execution can split, and no group is gathered. Null and empty texts have no lines and are returned empty;
texts of any length are one row each; of equal lines at one place (rows equal in id and text, which count as one row and are treated alike) none is later; a null id
sorts first; an empty table gives an empty result; further columns, whatever their names, are ignored by ``dedup_lines`` and kept by ``drop_repeated``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import per_text, table, written

WINDOW = 3
MIN_WORDS = 5
LONG_WORDS = 10
BROADCAST_ROWS = 400_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def winnowed(hashes: list[int], window: int) -> dict[int, list[tuple[int, int]]]:
    """Fingerprint -> the windows (first line, line after the last) whose least hash it is, the last of equal ones; one window if there are fewer lines."""
    n, out = len(hashes), {}
    for a in range(max(1, n - window + 1) if n else 0):
        z = min(n, a + window)
        out.setdefault(min(range(a, z), key=lambda i: (hashes[i], -i)), []).append((a, z))
    return out


def fingerprints(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, key, hash, at, spans): a fingerprint, its place among the lines and its extensions, each with its first and last line and a hash of all its lines."""

    def make():
        import hashlib

        def number(raw: bytes) -> int:
            return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)

        def run(batch):
            out = []
            for text in batch:
                kept = [s for x in text.split("\n") if (s := x.strip(SPACES))]
                h = [number(s.encode("utf-8", "surrogatepass")) for s in kept]
                spans = winnowed(h, window)
                for i, s in enumerate(kept):
                    if s.count(" ") + 1 >= long_words or len(WORD.findall(s)) >= long_words:
                        spans.setdefault(i, []).append((i, i + 1))
                row = []
                for i, found in spans.items():
                    each = {(a, z): number(b"".join(v.to_bytes(8, "little", signed=True) for v in h[a:z])) if z > a + 1 else h[a] for a, z in found}
                    row.append({"hash": h[i], "at": i, "spans": [{"a": a, "b": z - 1, "run": v} for (a, z), v in each.items()]})
                out.append(row)
            return {"f": out}

        return run

    found = per_text(docs, make, "f array<struct<hash:bigint,at:int,spans:array<struct<a:int,b:int,run:bigint>>>>", ("key",))
    return found.select("doc_id", "key", F.explode("f").alias("f")).select("doc_id", "key", "f.*")


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(key, runs): per document the stretches of lines, first and last, that also stand at an earlier place."""
    prints = written(fingerprints(docs, window, long_words), "fingerprints")
    # Tables that are joined back are written first: both sides of the join are then dealt by it, at every size, and a hot line can be split.
    shared = written(prints.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared-lines")
    spans = prints.join(shared.hint("merge"), "hash", "left_semi").select("doc_id", "key", F.explode("spans").alias("s")).select("doc_id", "key", "s.*")
    spans = written(spans, "extensions")
    place = F.struct("doc_id", "key", "a")
    first = spans.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "first")
    later = spans.join(written(first, "first-places").hint("merge"), "run").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("runs"))  # at most twice as many as a document's lines


def cut_text(text: str, runs: list[tuple[int, int]], min_words: int, most: float | None = None) -> tuple[str, int, int]:
    """The text without the runs of enough words, its lines with a word, and how many of them went. Where more than a share ``most`` of its words would go, none do."""
    rows = text.split("\n")
    place = [i for i, x in enumerate(rows) if x.strip(SPACES)]
    n_words = [len(WORD.findall(rows[i])) for i in place] if runs else []
    gone: set[int] = set()
    for a, b in runs:
        gone.update(range(a, b + 1))
    drop: set[int] = set()
    run: list[int] = []
    for i in [*sorted(gone), None]:
        if run and (i is None or i != run[-1] + 1):
            if sum(n_words[k] for k in run) >= min_words:
                drop.update(run)
            run = []
        if i is not None:
            run.append(i)
    if most is not None and sum(n_words[k] for k in drop) > most * sum(n_words):
        drop = set()
    lost = {place[k] for k in drop}
    return "\n".join(x for i, x in enumerate(rows) if i not in lost), len(place), len(drop)


def dedup_lines(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """Per document: doc_id, text (what is left), n_lines, n_removed."""
    return _cut(docs.select("doc_id", "text"), window, min_words, long_words, None).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_removed")


def _cut(docs: DataFrame, window: int, min_words: int, long_words: int, most: float | None) -> DataFrame:
    """doc_id (long), text, n_lines, n_removed and ``rest``, all columns of ``docs``. Only texts with runs are shuffled to them."""
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("key"), F.struct("*").alias("rest"))
    runs = written(repeated_runs(docs.select(doc_id, text, F.xxhash64(F.col("doc_id").cast("long"), text).alias("key")), window, long_words), "runs")
    keys = runs.select("key")
    keys = F.broadcast(keys) if runs.count() <= BROADCAST_ROWS else keys.hint("merge")  # 8 bytes each

    def lined():
        def run(batch):
            return {"n_lines": [sum(1 for x in t.split("\n") if x.strip(SPACES)) for t in batch]}

        return run

    def cut():
        def run(batch):
            got = [cut_text(t, [(r["a"], r["b"]) for r in j], min_words, most) for t, j in zip(*batch, strict=True)]
            return {"cut": [g[0] for g in got], "n_lines": [g[1] for g in got], "n_removed": [g[2] for g in got]}

        return run

    plain = lambda df, *more: df.select(F.col("rest.doc_id").cast("long").alias("doc_id"), F.coalesce("rest.text", F.lit("")).alias("text"), "rest", *more)
    changed = per_text(plain(rows.join(keys, "key", "left_semi").join(runs, "key"), "runs"), cut, "cut string, n_lines long, n_removed long", ("rest",), ("text", "runs"))
    whole = per_text(plain(rows.join(keys, "key", "left_anti")), lined, "n_lines long", ("rest",))
    whole = whole.select("doc_id", F.col("rest.text").alias("text"), "n_lines", F.lit(0).cast("long").alias("n_removed"), "rest")
    return changed.select("doc_id", F.col("cut").alias("text"), "n_lines", "n_removed", "rest").unionByName(whole)


def drop_repeated(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, most: float | None = None) -> DataFrame:
    """``docs`` with all its columns; the text has lost its later repeated runs (a null one stays null), and n_chars, where there is one, is its length.

    With ``most``, a document that would lose more than this share of its words is a copy as a whole and keeps its text, for
    near-dedup to decide about."""
    cut = _cut(docs, window, min_words, long_words, most)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return cut.select(*[(made[c] if c in made else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
r AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS p, count(*) OVER (PARTITION BY rid) AS n_lines,
             trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS h,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM r WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
e AS (SELECT x.rid, x.p, x.n, x.n_lines, y.rid AS other, y.n_lines AS other_lines, x.p - y.p AS distance FROM l x JOIN l y ON x.h = y.h
      AND (y.doc_id < x.doc_id OR (y.rid = x.rid AND y.p < x.p))),
m AS (SELECT *, p - row_number() OVER (PARTITION BY rid, other, distance ORDER BY p) AS island FROM e),
k AS (SELECT *, count(*) OVER (PARTITION BY rid, other, distance, island) AS lines FROM m),
g AS (SELECT DISTINCT rid, p FROM k
      WHERE lines >= 3 OR n >= 10 OR (lines = n_lines AND n_lines = other_lines)),
s AS (SELECT l.rid, l.p, l.i, l.n, l.p - row_number() OVER (PARTITION BY l.rid ORDER BY l.p) AS island FROM g JOIN l USING (rid, p)),
gone AS (SELECT rid, i FROM (SELECT *, sum(n) OVER (PARTITION BY rid, island) AS total FROM s) WHERE total >= 5),
kept AS (SELECT r.rid, string_agg(r.line, chr(10) ORDER BY r.i) AS text FROM r ANTI JOIN gone USING (rid, i) GROUP BY r.rid)
SELECT d.doc_id, coalesce(kept.text, '') AS text,
       (SELECT count(*) FROM l WHERE l.rid = d.rid) AS n_lines, (SELECT count(*) FROM gone WHERE gone.rid = d.rid) AS n_removed
FROM d LEFT JOIN kept USING (rid)
"""
