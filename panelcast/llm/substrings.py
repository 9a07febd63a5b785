"""Suffix-array dedup by bucket-pointer refinement: bytes covered by a ``length``-byte string that also
starts elsewhere are removed.

Buckets of byte strings are 64-bit identifiers. One-byte buckets are refined by pairing a place's identifier with
that of a later offset, each result reused for the next: 1, 2, 4, ... ``q`` and on to ``length`` bytes. Sorting
is Spark's: places meet by identifier in a shuffle. To keep the places few, every string is represented by
the least ``q``-byte identifier in it, which depends on its bytes alone; neighbouring strings with the same one
form a run. Refinement then goes over runs, not places:

1. q-byte buckets: runs whose bucket no other place shares (most) hold no repeat and leave.
2. Whole-run buckets: runs equal in all their bytes repeat each other wholly. They go on as one.
3. Blocks of ``BLOCK`` places, counted from the least q bytes: a block whose common bytes (``length`` less a
   block) nothing shares holds no repeat; blocks equal in all their bytes repeat each other wholly.
4. What is left, the blocks where a repeat begins or ends, is refined to buckets of ``length`` bytes, place by place.

Every step is a grouping by fixed-size keys with partial sums and an equi-join back, so a group of any
size is never gathered. Texts longer than ``SEGMENT`` are cut into overlapping segments, which
changes the runs but not the result; a run whose least q bytes may stand twice is refined place by place. Null and short texts lose nothing; repeated rows repeat each other; a null id stays null;
an empty table gives an empty result; further columns are ignored.

``length`` bytes may be more than a short passage has, so ``shared_passages`` counts for each document, without removing them, the
passages of words that it shares: buckets of ``GRAM`` words are refined as above from those of one word, and every stretch of ``PASSAGE``
words is represented by its least bucket. Any stretch that repeats is counted (but one that repeats only within the words it shares a least
bucket with, as in a text of one word over and over), and nothing that shares less than ``GRAM`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table, texts, written
from panelcast.llm.neardup import hasher

LENGTH = 400
Q = 128
BLOCK = 8
SEGMENT = 1 << 20
PASSAGE, GRAM = 50, 32
BROADCAST_ROWS = 400_000


def refined(a, b):
    """The bucket of a string from those of its first part and of a later offset."""
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def buckets(raw, q: int, length: int):
    """Identifiers of the q-byte and of the length-byte string at every place of ``raw`` (uint8)."""
    import numpy as np

    ids, size, at_q = refined(raw.astype(np.uint64) + np.uint64(1), raw.astype(np.uint64)), 1, None
    while size < length:
        step = min(size, length - size, q - size if size < q else length)
        ids = refined(ids[:-step], ids[step:])
        size += step
        if size == q:
            at_q = ids
    return at_q, ids


def sliding_min(x, width: int):
    import numpy as np

    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def runs_of(parts: list, q: int, length: int):
    """Of byte strings (uint8 arrays of ``length`` bytes or more): part, first and last place, bucket of the least
    q bytes, bucket of the whole run, and whether the run may repeat itself (its least q bytes occur twice)."""
    import numpy as np

    width = length - q + 1
    sizes = np.array([len(p) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at_q, ids = buckets(np.concatenate(parts), q, length)
    least = sliding_min(at_q, width)
    valid = np.zeros(len(ids) + 1, dtype=bool)
    for o, n in zip(offsets, sizes, strict=True):
        valid[o : o + n - length + 1] = True
    cut = np.ones(len(ids), dtype=bool)
    cut[1:] = least[1:] != least[:-1]
    cut[offsets] = True
    lo = np.flatnonzero(cut & valid[:-1])
    end = np.concatenate([np.flatnonzero(cut)[1:], [len(ids)]])[np.searchsorted(np.flatnonzero(cut), lo)]
    part = np.searchsorted(offsets, lo, side="right") - 1
    hi = np.minimum(end, (offsets + sizes - length + 1)[part]) - 1
    if (long := hi - lo >= width).any():  # periodic bytes: pieces of at most ``width`` places
        more = [(a, b) for a0, b0 in zip(lo[long], hi[long], strict=True) for a in range(a0, b0 + 1, width) for b in [min(b0, a + width - 1)]]
        lo = np.concatenate([lo[~long], [a for a, _ in more]]).astype(np.int64)
        hi = np.concatenate([hi[~long], [b for _, b in more]]).astype(np.int64)
        part = np.searchsorted(offsets, lo, side="right") - 1
    bucket = least[lo]
    view = np.lib.stride_tricks.sliding_window_view(at_q, width)
    twice = np.zeros(len(lo), dtype=bool)
    for k in range(0, len(lo), 4096):
        s = slice(k, k + 4096)
        first, last = view[lo[s]] == bucket[s, None], view[hi[s]] == bucket[s, None]
        twice[s] = (first.sum(1) > 1) | (last.sum(1) > 1) | (first.argmax(1) + lo[s] != last.argmax(1) + hi[s])
    whole = refined(ids[lo], ids[hi]) + (hi - lo).astype(np.uint64)
    return part, lo - offsets[part], hi - offsets[part], bucket.view(np.int64), whole.view(np.int64), twice


def _filled(strings: Iterator[tuple], least: int, most: int, overlap: int) -> Iterator[tuple[list, list]]:
    """Gather (key, bytes) into lists of about ``most`` bytes; longer strings are cut with an overlap. Keys gain the segment's start."""
    import numpy as np

    keys, parts, total = [], [], 0
    for key, raw in strings:
        for a in range(0, max(1, len(raw) - overlap), most):
            piece = raw[a : a + most + overlap]
            if len(piece) >= least:
                keys.append((key, a))
                parts.append(np.frombuffer(piece, dtype=np.uint8))
                total += len(piece)
            if total >= most:
                yield keys, parts
                keys, parts, total = [], [], 0
    if parts:
        yield keys, parts


def all_runs(rows: DataFrame, q: int, length: int, segment: int) -> DataFrame:
    """(key, lo, hi, bucket, whole, twice) of every run of every text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            strings = ((k, t.encode("utf-8", "surrogatepass")) for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True) if 4 * len(t) >= length)
            for keys, parts in _filled(strings, length, segment, length - 1):
                part, lo, hi, bucket, whole, twice = runs_of(parts, q, length)
                key, start = (np.array([k[i] for k in keys], dtype=np.int64)[part] for i in (0, 1))
                yield pa.RecordBatch.from_pydict({"key": key, "lo": lo + start, "hi": hi + start, "bucket": bucket, "whole": whole, "twice": twice})

    return rows.select("key", "text").mapInArrow(run, "key long, lo long, hi long, bucket long, whole long, twice boolean")


def blocks(rows: DataFrame, q: int, length: int, segment: int, block: int) -> DataFrame:
    """(key, lo, hi, bucket, block, core, whole, settled) of every block of the runs listed in ``runs``: ``core`` stands for
    the bytes common to all places of the block, ``whole`` for all its bytes (null if the run has only a part of its places).

    A run whose least q bytes may occur twice has no fixed place to count from: it and all of its bucket are one block without ``whole``.
    """
    width = length - q + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            cuts = ((r | {"key": k}, raw[r["lo"] : r["hi"] + length]) for k, t, rs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True) for raw in [t.encode("utf-8", "surrogatepass")] for r in rs)
            for keys, parts in _filled(cuts, length, segment, length - 1):
                sizes = np.array([len(p) for p in parts])
                offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                raw = np.concatenate(parts)
                at_q, ids = buckets(raw, q, length)
                _, cores = buckets(raw, q, length - block + 1)
                of = lambda name, kind, keys=keys: np.array([k[0][name] for k in keys], dtype=kind)
                bucket, fixed = of("bucket", np.int64), ~of("loose", bool)
                view = np.lib.stride_tricks.sliding_window_view(at_q, width)
                first = np.zeros(len(parts), dtype=np.int64)
                for i in range(0, len(parts), 4096):
                    first[i : i + 4096] = (view[offsets[i : i + 4096]] == bucket.view(np.uint64)[i : i + 4096, None]).argmax(1)
                shift = np.where(fixed, width - 1 - first, 0)  # the run's first place, counted from the earliest that could hold the least q bytes
                n = sizes - length + 1
                a, z = np.where(fixed, shift // block, 0), np.where(fixed, (shift + n - 1) // block, 0)
                part = np.repeat(np.arange(len(parts)), z - a + 1)
                k = np.arange(len(part)) - np.repeat(np.cumsum(z - a + 1) - (z - a + 1), z - a + 1) + a[part]
                start = k * block - shift[part]  # of the block, from the run's first place; may lie before it
                lo = np.where(fixed[part], np.maximum(start, 0), 0)
                hi = np.where(fixed[part], np.minimum(start + block, n[part]) - 1, n[part] - 1)
                full = fixed[part] & (start >= 0) & (start + block <= n[part])
                core = np.where(fixed[part], cores[np.where(fixed[part], offsets[part] + start + block - 1, 0)].view(np.int64), 0)
                at = offsets[part] + np.where(full, start, 0)
                whole = refined(ids[at], ids[at + np.where(full, block - 1, 0)]).view(np.int64)
                base = (of("lo", np.int64) + np.array([s for _, s in keys], dtype=np.int64))[part]
                yield pa.RecordBatch.from_pydict({"key": of("key", np.int64)[part], "lo": base + lo, "hi": base + hi, "bucket": bucket[part], "block": k, "core": core, "whole": pa.array(whole, mask=~full), "settled": of("settled", bool)[part]})

    return rows.select("key", "text", "runs").mapInArrow(run, "key long, lo long, hi long, bucket long, block long, core long, whole long, settled boolean")


def places(rows: DataFrame, q: int, length: int, segment: int) -> DataFrame:
    """(key, at, bucket, string, settled) of every place in the runs listed in ``runs`` of each row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            cuts = ((r | {"key": k}, raw[r["lo"] : r["hi"] + length]) for k, t, rs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True) for raw in [t.encode("utf-8", "surrogatepass")] for r in rs)
            for keys, parts in _filled(cuts, length, segment, length - 1):
                _, ids = buckets(np.concatenate(parts), q, length)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
                n = np.array([len(p) - length + 1 for p in parts])
                part = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                col = lambda f, kind, keys=keys, part=part: np.array([f(k) for k in keys], dtype=kind)[part]
                yield pa.RecordBatch.from_pydict({"key": col(lambda k: k[0]["key"], np.int64), "at": at + col(lambda k: k[0]["lo"] + k[1], np.int64), "bucket": col(lambda k: k[0]["bucket"], np.int64), "string": ids[offsets[part] + at].view(np.int64), "settled": col(lambda k: k[0]["settled"], bool)})

    return rows.select("key", "text", "runs").mapInArrow(run, "key long, at long, bucket long, string long, settled boolean")


def _only(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``key``; the keys (8 bytes each) are broadcast only if their counted rows are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge"), "key", how)


def _with_runs(rows: DataFrame, open_: DataFrame, *fields: str) -> DataFrame:
    """The texts that have open stretches, with these as an array."""
    todo = written(open_.groupBy("key").agg(F.collect_set(F.struct(*fields)).alias("runs")), "open")
    return _only(rows, todo.select("key"), "left_semi").join(todo, "key")


def _judged(rows: DataFrame, group: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Split rows that share ``group`` by ``whole``: the settled (key, lo, hi), and what is still open: rows that no other equals, and one of each set of equal ones."""
    alike = rows.where("whole IS NOT NULL").groupBy(*group, "whole").agg(F.count("*").alias("_n"), F.min(F.struct("key", "lo")).alias("_first")).where("_n > 1")
    joined = rows.join(written(alike, f"{name}-alike"), [*group, "whole"], "left")
    twice = F.col("_n").isNotNull()
    marked = written(joined.select(*rows.columns, twice.alias("_twice"), F.coalesce(F.struct("key", "lo") == F.col("_first"), F.lit(False)).alias("_stands")), name)
    open_ = marked.where("NOT _twice OR _stands").withColumn("settled", F.col("settled") | F.col("_twice"))
    return marked.where("_twice AND NOT settled").select("key", "lo", "hi"), open_.drop("_twice", "_stands")


def repeated_places(rows: DataFrame, q: int = Q, length: int = LENGTH, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(key, lo, hi): stretches of places whose string starts elsewhere too."""
    stretch = ("key", "lo", "hi")
    found = written(all_runs(rows, q, length, segment), "runs")
    shared = found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"), F.max("twice").alias("loose"))
    # Tables that are joined back are written first: both sides of the join are then dealt by it, and a hot key can be split.
    shared = written(shared.where("n > 1 OR loose").select("bucket", F.expr("a = b AND NOT loose").alias("alike"), "loose"), "shared")
    kept = written(found.join(shared, "bucket").withColumn("settled", F.lit(False)), "shared-runs")
    out = kept.where("alike").select(*stretch)
    settled, open_ = _judged(kept.where("NOT alike").drop("alike", "twice"), ["bucket"], "judged-runs")
    out = out.unionByName(settled)

    cut = written(blocks(_with_runs(rows, open_, "lo", "hi", "bucket", "loose", "settled"), q, length, segment, block), "blocks")
    group = ["bucket", "block", "core"]
    cores = cut.groupBy(*group).agg(F.count("*").alias("n"), F.count("whole").alias("w"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    # A part of a run's places, without ``whole``, may repeat itself only where its bucket is loose (core 0).
    cores = written(cores.where("n > 1 OR core = 0").select(*group, F.expr("n > 1 AND w = n AND a = b").alias("alike")), "cores")
    kept = written(cut.join(cores, group), "shared-blocks")
    out = out.unionByName(kept.where("alike AND NOT settled").select(*stretch))
    settled, open_ = _judged(kept.where("NOT alike").drop("alike"), group, "judged-blocks")
    out = out.unionByName(settled)

    at = written(places(_with_runs(rows, open_, "lo", "hi", "bucket", "settled"), q, length, segment), "places")
    twice = written(at.groupBy("bucket", "string").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "string"), "twice")
    single = at.where("NOT settled").join(twice, ["bucket", "string"]).select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return out.unionByName(single)


def merged(packed, length: int):
    """Maximal removed byte ranges (starts, ends) from stretches of repeated places, each packed as first place * 2^20 + places after it."""
    import numpy as np

    packed = np.sort(packed)
    lo = packed >> 20
    end = np.maximum.accumulate(lo + (packed & (1 << 20) - 1) + length)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]]))
    return lo[new], end[np.concatenate([new[1:] - 1, [len(lo) - 1]])]


def shared_passages(rows: DataFrame, passage: int = PASSAGE, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """(key, n_passages) of the texts that share any: their runs of stretches with one least bucket that another run has as well."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, width = hasher(), passage - gram + 1

        def found(keys, parts):
            sizes = np.array([len(p) for p in parts])
            offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, size = np.concatenate(parts), 1
            while size < gram:
                step = min(size, gram - size)
                ids = refined(ids[:-step], ids[step:])
                size += step
            least = sliding_min(ids, width)
            cut = np.ones(len(least), dtype=bool)
            cut[1:] = least[1:] != least[:-1]
            cut[offsets] = True
            edge = np.zeros(len(least) + 1, dtype=np.int64)
            edge[offsets] += 1
            np.add.at(edge, offsets + sizes - passage + 1, -1)
            at = np.flatnonzero(cut & (np.cumsum(edge[:-1]) > 0))
            key = np.array(keys, dtype=np.int64)[np.searchsorted(offsets, at, side="right") - 1]
            return pa.RecordBatch.from_pydict({"key": key, "bucket": least[at].view(np.int64)})

        keys, parts, total = [], [], 0
        for b in batches:
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(t) >= 2 * passage - 1 and len(h := words(t)) >= passage:
                    keys.append(k)
                    parts.append(h)
                    total += len(h)
                    if total >= segment:
                        yield found(keys, parts)
                        keys, parts, total = [], [], 0
        if parts:
            yield found(keys, parts)

    prints = written(rows.select("key", "text").mapInArrow(run, "key long, bucket long"), "passages")
    twice = written(prints.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared-passages")
    return prints.join(twice, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("n_passages"))


def _deduped(rows: DataFrame, q: int, length: int, segment: int, block: int) -> DataFrame:
    packed = F.shiftleft("lo", 20) + (F.col("hi") - F.col("lo"))  # a stretch is shorter than a segment
    spans = written(repeated_places(rows, q, length, segment, block).groupBy("key").agg(F.collect_set(packed).alias("runs")), "spans")
    keys = spans.select("key")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            kept, cuts = [], []
            for text, r in zip(b.column("text"), b.column("runs"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                starts, ends = (x.tolist() for x in merged(r.values.to_numpy(), length))
                kept.append(b"".join(raw[i:j] for i, j in zip([0, *ends], [*starts, len(raw)], strict=True)))
                cuts.append([{"start": i, "end": j} for i, j in zip(starts, ends, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "key": b.column("key"), "n_bytes": b.column("n_bytes"), "kept": pa.array(kept, pa.binary()), "spans": pa.array(cuts, kind)})

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    joined = _only(rows, keys, "left_semi").join(spans, "key").select("doc_id", "key", n_bytes, "text", "runs")
    changed = joined.mapInArrow(run, "doc_id long, key long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    whole = _only(rows, keys, "left_anti").select("doc_id", "key", n_bytes, F.encode("text", "UTF-8").alias("kept"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"))
    return changed.unionByName(whole)


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def dedup_substrings(docs: DataFrame, q: int = Q, length: int = LENGTH, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_bytes, kept (bytes), spans (removed byte ranges, ends exclusive)."""
    return _deduped(_keyed(docs), q, length, segment, block).drop("key")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(table(spark, sf_dir, "documents"))
    out = _deduped(rows, Q, LENGTH, SEGMENT, BLOCK)
    digest = out.select("doc_id", "key", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    passages = written(shared_passages(rows), "passage-counts")
    digest = digest.join(F.broadcast(passages) if passages.count() <= BROADCAST_ROWS else passages.hint("merge"), "key", "left")
    return digest.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))
