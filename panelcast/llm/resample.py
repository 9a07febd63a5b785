"""Importance resampling towards a target distribution over hashed n-grams, DataFrame functions only.

Features are all runs of 1 to ``LONGEST`` consecutive words; a feature's bucket is its crc32 modulo ``BUCKETS``. A bucket's gain is the
scaled log ratio of its share among the target's features to its share among the corpus's, both with one feature added a bucket. A
document's weight is the sum of its features' gains; Gumbel noise from a hash of its id turns weights into a draw without replacement
(the highest scores are drawn). Ranks come from a range-partitioned sort: a row's place in its partition after the rows of all partitions before.

The bucket arrays are made once and stored, about as large as the texts. Both passes over them add up within tasks: bucket counts to
``BUCKETS`` rows a task, weights to one row a document, so no bucket or document is gathered, however hot or long. The gain table
has at most ``BUCKETS`` rows, which is the bound of what is broadcast.

Null and empty texts have no features and weight 0; every feature of a long text counts; repeated rows are scored each; scores that tie are drawn
by smaller id (null first), then larger weight and feature count, and rows equal in all of these in any order; an empty corpus gives an empty
result, an empty target gains that say so; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import table, written

LONGEST, BUCKETS = 3, 10_000
SHARE, MIN_WORDS, SEED = (5, 100), 20, 42
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, with A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def bucketed(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Replace ``text`` by n_words and ``buckets``, one entry a feature."""
    said = ["x", *(f"w[i + {k}]" for k in range(1, longest))]
    bucket = "cast(pmod(crc32(cast({} AS binary)), {}) AS int)"
    runs = [f"IF(size(w) < {n}, array(), transform(slice(w, 1, size(w) - {n - 1}), (x, i) -> {bucket.format(f'concat_ws(" ", {", ".join(said[:n])})', buckets)}))" for n in range(1, longest + 1)]
    split = rows.withColumn("_w", words(F.col("text"))).drop("text")
    return split.select(*[c for c in split.columns if c != "_w"], F.size("_w").alias("n_words"), F.expr(f"transform(array(_w), w -> concat({', '.join(runs)}))[0]").alias("buckets"))


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket of the corpus, from two tables of bucket counts."""
    s, t = (c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in (corpus, target))  # two numbers
    both = corpus.select("bucket", F.col("n").alias("s")).join(F.broadcast(target.select("bucket", F.col("n").alias("t"))), "bucket", "left")
    real = lambda c: c.cast("double")
    ratio = real(F.coalesce("t", F.lit(0)) + 1) * real(F.lit(s + buckets)) / (real(F.col("s") + 1) * real(F.lit(t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs`` (doc_id, text) against the texts of ``target``."""
    plain = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = written(bucketed(plain, longest, buckets), "buckets")
    counts = [written(bucket_counts(x), "bucket-counts") for x in (rows, bucketed(target.select("text"), longest, buckets))]
    each = rows.select("row", "doc_id", "n_words", F.size("buckets").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    of = each.join(F.broadcast(gains(*counts, buckets)), "bucket", "left").groupBy("row")
    out = of.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.max("n_features").cast("long").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank``, from 1 in the order given: rows are dealt by ranges and sorted, and a row's place follows all earlier partitions (one row of the offsets a partition)."""
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, local = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.select(*rows.columns, (F.col("_start") + local + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``weighed`` with the rank of each row drawn, null for the others: of the N rows with at least ``min_words`` words the floor(share * N) highest scores."""
    rows = written(weighed(docs, target, longest, buckets, seed), "weighed")
    eligible = F.col("n_words") >= min_words
    n = rows.where(eligible).count() * share[0] // share[1]
    order = F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("weight"), F.desc("n_features")
    drawn = ranked(rows.where(eligible), *order).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(rows.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum is taken bit by bit, once a distinct feature.
OP13_SQL = r"""
WITH raw AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
said AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '@UPPER@', '@LOWER@'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
feature AS (
  SELECT side, rid, unnest(w) AS f FROM said
  UNION ALL SELECT side, rid, w[i] || ' ' || w[i + 1] FROM (SELECT side, rid, w, unnest(range(1, len(w))) AS i FROM said)
  UNION ALL SELECT side, rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT side, rid, w, unnest(range(1, len(w) - 1)) AS i FROM said)),
used AS (SELECT side, rid, f, count(*) AS n FROM feature GROUP BY ALL),
spelt AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM used)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 4 * length(h)),
           lambda k: (('0x' || h[2 * (k // 8) + 1:2 * (k // 8) + 2])::BIGINT >> (k % 8)) & 1)),
         lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 10000 AS bucket FROM spelt),
bucketed AS (SELECT side, rid, bucket, n FROM used JOIN hashed USING (f)),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM bucketed GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((c.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g
  FROM counts c, total),
summed AS (SELECT rid, sum(n * g)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 0 GROUP BY rid),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (3 * len(w) - least(len(w), 1) - least(len(w), 2))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM said LEFT JOIN summed USING (rid) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight DESC, n_features DESC) AS k,
         count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM placed
""".replace("@UPPER@", string.ascii_uppercase).replace("@LOWER@", string.ascii_lowercase)
