"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame functions only.

A test item is found in a document that holds at least ``threshold`` of its distinct five-word shingles, however long
the document is. The MinHash value of a shingle is its 64-bit key. Items are partitioned by size (powers of two of their shingle
counts). An item's sketch is its ``k`` least MinHash values, where ``k`` is one more than the shingles that an item of the
partition's upper size may miss: a document that passes must hold one of them, so the search loses nothing. A document's sketch is all
its MinHash values up to the largest one in any item's sketch; the two meet on equal values, and
each candidate pair is then verified by exact shingle containment. Sketches of a fixed number of values would not do for documents: a
short item's Jaccard similarity with a long document is far below what bands can find.

Words are maximal runs of letters and digits of the lower-cased text. Items and documents of under
five words have no shingle and match nothing, as do null texts; of long texts every shingle counts. Of an item's equal
shingles one counts; a document may hold several items, each is a row. Rows equal in id and text count once;
null ids stay null; an empty table on either side gives an empty result; further columns are ignored.
The sketches and the candidates' keys are broadcast only where their counted rows lie under
``BROADCAST_ROWS`` (16 bytes each), else both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table, written

WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_shingles(rows: DataFrame, n: int = WORDS) -> DataFrame:
    """Replace ``text`` by ``shingles``, the 64-bit keys of all its n-word windows."""
    mixed = "x" + "".join(f" ^ shiftleft(h[i + {k}], {k}) ^ shiftrightunsigned(h[i + {k}], {64 - k})" for k in range(1, n))
    hashed = rows.withColumn("_h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    return hashed.withColumn("shingles", F.expr(f"transform(array(_h), h -> IF(size(h) < {n}, array(), transform(slice(h, 1, size(h) - {n - 1}), (x, i) -> {mixed})))[0]")).drop("_h")


def keyed(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """The id, the text and a key that stands for both."""
    plain = rows.select(F.col(id_col).alias(id_col), F.coalesce("text", F.lit("")).alias("text"))
    return plain.withColumn(name, F.xxhash64(F.col(id_col), F.col("text")))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_key, shingle): the least MinHash values of every item, as many as its size partition needs."""
    sized = items.where(F.size("shingles") > 0).withColumn("partition", F.floor(F.log2(F.size("shingles"))))
    upper = F.pow(F.lit(2), F.col("partition") + 1) - 1
    k = (F.floor(upper * (1 - threshold) + 1e-9) + 1).cast("int")
    return sized.select("item_key", F.explode(F.slice(F.sort_array("shingles"), F.lit(1), k)).alias("shingle"))


def bounded(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its counted rows are few; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_key, doc_id, item_id, n_shingles (of the item), n_shared, containment of each pair at or over the threshold."""
    items = written(with_shingles(keyed(benchmark, "item_id", "item_key").distinct()).withColumn("shingles", F.array_distinct("shingles")), "items")
    rows = keyed(docs, "doc_id", "doc_key")
    sketch = written(sketches(items, threshold), "sketches")
    largest = F.lit(sketch.agg(F.max("shingle")).first()[0]).cast("long")
    low = F.filter("shingles", lambda s: s <= largest)
    probe = with_shingles(rows.drop("doc_id")).select("doc_key", F.explode_outer(low).alias("shingle"))  # outer: else Spark filters on the array first and so computes it twice
    found = written(probe.join(bounded(sketch), "shingle").select("doc_key", "item_key").distinct(), "candidates")
    chosen = rows.join(bounded(written(found.select("doc_key").distinct(), "keys")), "doc_key", "left_semi").distinct()
    pairs = with_shingles(chosen).join(found, "doc_key").join(items.withColumnRenamed("shingles", "_item"), "item_key")
    counted = pairs.select("doc_key", "doc_id", "item_id", F.size("_item").cast("long").alias("n_shingles"), F.size(F.array_intersect("_item", "shingles")).cast("long").alias("n_shared"))
    return counted.where(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold) - 1e-9).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    hit = written(contained_items(docs, benchmark, threshold).select("doc_key").distinct(), "contaminated")
    key = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bounded(hit), key == hit["doc_key"], "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


OP7_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id AS id, coalesce(text, '') AS text FROM documents),
b AS (SELECT DISTINCT item_id AS id, coalesce(text, '') AS text FROM benchmark),
dw AS (SELECT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
bw AS (SELECT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM b),
ds AS (SELECT DISTINCT id, text, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT id, text, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT id, text, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT id, text, w, unnest(range(1, len(w) - 3)) AS i FROM bw WHERE len(w) >= 5)),
n AS (SELECT id, text, count(*) AS n FROM bs GROUP BY ALL),
m AS (SELECT ds.id AS doc_id, ds.text AS doc_text, bs.id AS item_id, bs.text AS item_text, count(*) AS k
      FROM ds JOIN bs ON ds.s = bs.s GROUP BY ALL)
SELECT doc_id, item_id, n.n::BIGINT AS n_shingles, k::BIGINT AS n_shared, k / n.n AS containment
FROM m JOIN n ON m.item_id IS NOT DISTINCT FROM n.id AND m.item_text = n.text
WHERE 5 * k >= 4 * n.n
"""
