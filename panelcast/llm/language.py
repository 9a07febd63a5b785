"""Language identification by prediction by partial matching: one variable-order byte context tree a language, whose frozen statistics give every text an exact code length.

A byte is coded in the longest context of up to ``ORDER`` bytes that the language's tree holds: with probability c / (n + d) if the context has the byte (c of its n
occurrences, d different bytes in all), else by an escape into the next shorter context; below the empty context all 256 bytes are alike. The language
of the shortest code is the answer. Code lengths are whole numbers of 2^-20 bits, so sums are the same in any order and in any batch.

Learning counts all windows of ``ORDER`` + 1 bytes of all labelled training texts in parallel (text starts are padded with zero bytes); the counts of
shorter contexts are their sums. Of L languages each keeps the strings of each length that make up ``L * SHARE`` or more of its bytes, so at most 1 / ``SHARE`` strings
of one length are kept in all, whatever the corpus and the number of languages: that is the bound of the model that goes to every task, and what a
context loses by it becomes escape probability.

Rows are held out where crc32(doc_id) mod 4 is 2 (a null id never); they and rows without a language or text teach nothing. A null text, or one without a
letter, is ``und`` with score 0, as is every text if nothing was learned; long texts are coded whole; of equal code lengths the first language in order wins; a
text given twice is coded and taught twice; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table, written

ORDER, SHARE = 5, 2e-6
HELD_WINDOWS = 1 << 21
BATCH_BYTES = 1 << 22
UNIT = 1 << 20
UNKNOWN = "und"


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def windows(texts: list[bytes], order: int = ORDER):
    """The window of every byte of every text, as a number whose last byte is the byte itself, and where each text starts."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    pad = bytes(order)
    buffer = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    codes = np.zeros(max(0, len(buffer) - order), dtype=np.uint64)
    for k in range(order + 1):
        codes |= buffer[k : k + len(codes)].astype(np.uint64) << np.uint64(8 * (order - k))
    # Windows that end in the padding between texts belong to none.
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    mine = np.ones(len(codes), dtype=bool)
    for k in range(order):
        at = starts[1:] - order + k
        mine[at] = False
    return codes[mine], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def byte_windows(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, window, n) over the texts of (lang, text); a task adds up what it meets and holds ``HELD_WINDOWS`` numbers a language before it passes them on."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        held: dict[str, list] = {}

        def merged(lang):
            keys, n = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, weights=n).astype(np.int64)

        def out(lang, keys, n):
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "window": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                at = 0
                while at < len(texts):
                    some, size = [], 0
                    while at < len(texts) and (not some or size + len(texts[at]) <= BATCH_BYTES):
                        some.append(texts[at])
                        size += len(texts[at])
                        at += 1
                    label, keys = pd.factorize(windows(some, order)[0])
                    held.setdefault(lang, []).append((keys, np.bincount(label, minlength=len(keys))))
                if sum(len(k) for k, _ in held[lang]) > HELD_WINDOWS:
                    keys, n = merged(lang)
                    if len(keys) > HELD_WINDOWS // 2:
                        yield out(lang, keys, n)
                    else:
                        held[lang] = [(keys, n)]
        for lang in list(held):
            yield out(lang, *merged(lang))

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, window long, n long")
    return counted.groupBy("lang", "window").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, order: int = ORDER, share: float = SHARE) -> DataFrame:
    """The frozen trees, a row a kept string: (lang, order, context, symbol, c, n, d) with the string's count c, and all occurrences n and distinct bytes d of its context."""
    seen = written(byte_windows(rows.where("lang IS NOT NULL AND text IS NOT NULL"), order), "byte-windows")
    totals = seen.groupBy("lang").agg(F.sum("n").alias("_total"))
    least = written(totals.withColumn("_langs", F.lit(totals.count())), "language-bytes")  # a row a language
    cut = F.expr(f"explode(transform(sequence(0, {order}), k -> struct(k AS order, window & (shiftleft(1L, 8 * (k + 1)) - 1) AS s)))").alias("e")
    strings = seen.select("lang", "n", cut).groupBy("lang", "e.order", "e.s").agg(F.sum("n").alias("c"))
    strings = written(strings.select("lang", "order", F.shiftright("s", 8).alias("context"), F.expr("cast(s & 255 AS int)").alias("symbol"), "c"), "byte-strings")
    contexts = strings.groupBy("lang", "order", "context").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    frequent = strings.join(least, "lang").where(F.col("c") >= F.col("_langs") * F.lit(share) * F.col("_total")).select("lang", "order", "context", "symbol", "c")
    return frequent.join(contexts, ["lang", "order", "context"])


class Trees:
    """The trees as sorted arrays: per language and order the kept contexts and strings with their costs in 2^-20 bits."""

    def __init__(self, rows, order: int = ORDER):
        """rows: a pandas table of ``learn``."""
        import numpy as np

        self.order, self.langs, self.at = order, sorted(rows["lang"].unique()), {}
        for lang in self.langs:
            for k in range(order + 1):
                g = rows[(rows["lang"] == lang) & (rows["order"] == k)]
                context, symbol, c, n, d = (g[x].to_numpy() for x in ("context", "symbol", "c", "n", "d"))
                key = (context.astype(np.uint64) << np.uint64(8)) | symbol.astype(np.uint64)
                by = np.argsort(key)
                key, c, n, d, context = key[by], c[by], n[by], d[by], context.astype(np.uint64)[by]
                cost = np.rint(-np.log2(c / (n + d)) * UNIT).astype(np.int64)
                head, first = np.unique(context, return_index=True)
                kept = np.add.reduceat(c, first) if len(first) else c
                escape = np.rint(-np.log2((n[first] - kept + d[first]) / (n[first] + d[first])) * UNIT).astype(np.int64)
                self.at[lang, k] = key, cost, head, escape

    def costs(self, window):
        """Code lengths (windows, languages) of the last byte of each window."""
        import numpy as np

        out = np.zeros((len(window), len(self.langs)), dtype=np.int64)
        for j, lang in enumerate(self.langs):
            left = np.arange(len(window))
            for k in range(self.order, -1, -1):
                key, cost, head, escape = self.at[lang, k]
                if not len(key) or not len(left):
                    continue
                w = window[left] & np.uint64((1 << 8 * (k + 1)) - 1)
                at = np.minimum(np.searchsorted(key, w), len(key) - 1)
                hit = key[at] == w
                out[left[hit], j] += cost[at[hit]]
                left, w = left[~hit], w[~hit] >> np.uint64(8)
                at = np.minimum(np.searchsorted(head, w), len(head) - 1)
                out[left, j] += np.where(head[at] == w, escape[at], 0)
            out[left, j] += 8 * UNIT
        return out

    def lengths(self, texts: list[bytes]):
        """Code lengths (texts, languages) of whole texts."""
        import numpy as np
        import pandas as pd

        codes, starts = windows(texts, self.order)
        label, distinct = pd.factorize(codes)
        cost = self.costs(distinct)
        upto = np.zeros((len(codes) + 1, len(self.langs)), dtype=np.int64)
        for j in range(len(self.langs)):
            np.cumsum(cost[label, j], out=upto[1:, j])
        return upto[starts[1:]] - upto[starts[:-1]]


def code_lengths(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id, text) and ``bits``, the code length of the text in each of ``trees.langs``; null for a null text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # at most 1 / SHARE strings of each length
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            bits, at = [], 0
            while at < len(texts):
                some, size = [], 0
                while at < len(texts) and (not some or size + len(texts[at] or b"") <= BATCH_BYTES):
                    some.append(texts[at] or b"")
                    size += len(some[-1])
                    at += 1
                bits.append(t.lengths(some) / UNIT)
            rows = np.concatenate(bits) if bits else np.zeros((0, len(t.langs)))
            out = [None if x is None else v for x, v in zip(texts, rows.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({c: b.column(b.schema.get_field_index(c)) for c in keep} | {"bits": pa.array(out, pa.list_(pa.float64()))})

    return docs.select(*keep, "text").mapInArrow(run, f"{head}, bits array<double>")


def identify(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and bits (a map language -> code length) of every row; the score is the chance of the answer if all languages are as likely before."""
    trees = Trees(model.toPandas())  # at most 1 / SHARE strings of each length
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    coded = code_lengths(rows, trees, ("doc_id", "has_letter"))
    names = F.array(*[F.lit(x) for x in trees.langs]).cast("array<string>")
    known = F.col("has_letter") & F.lit(bool(trees.langs))
    least = F.array_min("bits")
    chance = 1 / F.aggregate("bits", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), least - x))
    best = F.get(names, F.array_position("bits", least).cast("int") - 1)
    return coded.select("doc_id", F.when(known, best).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, chance).otherwise(F.lit(0.0)).alias("score"), F.map_from_arrays(names, "bits").alias("bits"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~is_held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
