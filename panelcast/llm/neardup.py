"""MinHash near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text; a shingle is
five of them (a text of one to four words is one shingle of all of them). A shingle weighs its count in the text times its
inverse document frequency, taken over ``2**20`` hashed features of all documents, as Spark's own HashingTF and IDF do: log(N / df) / log(N),
smoothed to run from 1 (one document) to ``FLOOR`` (all documents), so that what a group of very many copies shares still
outweighs the few words that one of them has changed.

1. Equal texts are one node. ICWS gives each node 48 samples; 4 together are a band key. Two texts of weighted
   Jaccard similarity 0.8 share one of the 12 bands with probability 0.998, at 0.85 with 0.9998.
2. The nodes of a bucket, with their shingles, meet in one task. Each pair whose samples agree enough (four standard errors below the
   threshold) is verified there by its exact weighted Jaccard similarity, in the first band that it shares, unless verified links
   have joined it already; the node nearest to the bucket's most common samples goes first, so that copies of one text join at once. Only links leave the
   task, so what leaves is no more than its rows.
3. Classes are the connected components of the verified links.

A bucket of more than ``BLOCK`` nodes, or ``GROUP_BYTES`` of shingles, is dealt into parts: each meets itself, then the first nodes of all parts, and then the
nodes outside the bucket's largest class, in parts too, meet every part. So no pair is left out and no task holds more than two parts. Texts of any
length are hashed in segments of a MB. Of equal similarities any pair may go first, as classes don't depend on it. Texts without
words are near-duplicates of equal texts only, null texts of empty ones; repeated rows share a class; null ids stay null;
an empty table gives an empty result; further columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import table, texts, written
from panelcast.llm.components import components

WORDS = 5
THRESHOLD = 0.8
FEATURES = 1 << 20
SLICE = 1 << 10
FLOOR = 0.7
BANDS, ROWS = 12, 4
BLOCK = 1000
GROUP_BYTES = 1 << 25
HUBS = 64
BROADCAST_ROWS = 400_000
SEGMENT = 1 << 20


def mixed(x):
    """A 64-bit finaliser over an array (it is changed in place)."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hasher():
    """text -> 64-bit hashes of its words, vectorised: differences of a prefix sum of byte times power, shifted back by the inverse power."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
    is_word = np.zeros(256, dtype=bool)
    is_word[128:] = True
    is_word[[*range(48, 58), *range(97, 123)]] = True

    def up_to(n: int):
        if len(powers[0]) < n:
            for i, b in enumerate((base, inverse)):
                steps = np.full(max(n, 1 << 16), np.uint64(b), dtype=np.uint64)
                steps[0] = 1
                powers[i] = np.cumprod(steps)
        return powers

    def part(raw):
        word = np.zeros(len(raw) + 2, dtype=np.int8)
        word[1:-1] = is_word[raw]
        edge = np.flatnonzero(np.diff(word))
        lo, hi = edge[::2], edge[1::2]
        up, down = up_to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mixed((total[hi] - total[lo]) * down[lo])

    def words(text: str):
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
        out, a = [], 0
        while a < len(raw):  # long texts by segments that end between words
            b = min(len(raw), a + SEGMENT)
            while b < len(raw) and is_word[raw[b]]:
                b += 1
            out.append(part(raw[a:b]))
            a = b
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    return words


def shingled(h, n: int = WORDS):
    """Distinct shingles of word hashes, and their counts."""
    import numpy as np

    if not len(h):
        return h, np.empty(0, dtype=np.int64)
    n = min(n, len(h))
    s = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        s = mixed(s + h[k : len(h) - n + 1 + k])
    return np.unique(s, return_counts=True)


def idf(df, n_docs: int):
    """Weight of features from the documents that hold them."""
    import numpy as np

    n = max(n_docs, 2)
    return (FLOOR + (1 - FLOOR) * np.log(n / np.clip(df, 1, n)) / np.log(n)).astype(np.float32)


def document_frequencies(rows: DataFrame, features: int = FEATURES):
    """(documents per feature, documents). A task counts all features in one array and sends it in slices; slices are summed as they stream in. The result has ``features`` numbers, whatever the input."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        words, seen, n = hasher(), np.zeros(features, dtype=np.uint32), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                s, _ = shingled(words(t))
                seen[np.unique(s & np.uint64(features - 1))] += 1
                n += 1
        if n:
            step = min(SLICE, features)
            for i in range(0, features, step):
                if seen[i : i + step].any():
                    yield pa.RecordBatch.from_pydict({"slice": [i // step], "n": [0], "counts": [seen[i : i + step].tobytes()]})
            yield pa.RecordBatch.from_pydict({"slice": [-1], "n": [n], "counts": [b""]})

    def add(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for i, n, c in zip(*(b.column(x).to_pylist() for x in ("slice", "n", "counts")), strict=True):
                m, a = total.get(i, (0, 0))
                total[i] = (m + n, a + np.frombuffer(c, dtype=np.uint32).astype(np.int64))
        for i, (n, a) in total.items():
            yield pa.RecordBatch.from_pydict({"slice": [i], "n": [n], "counts": [np.asarray(a, dtype=np.int64).tobytes()]})

    schema = "slice long, n long, counts binary"
    parts = rows.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
    df, n_docs = np.zeros(features, dtype=np.int64), 0
    step = min(SLICE, features)
    for r in parts.collect():
        if r["slice"] < 0:
            n_docs += r["n"]
        else:
            df[r["slice"] * step : (r["slice"] + 1) * step] += np.frombuffer(r["counts"], dtype=np.int64)
    return df, n_docs


def sampler(k: int):
    """(shingles, weights) -> k ICWS samples (64-bit). Gamma(2, 1) draws come from quantile tables indexed by hash bits."""
    import numpy as np

    x = np.concatenate([np.geomspace(1e-6, 0.1, 20_000), np.linspace(0.1, 30, 200_000)[1:]])
    r_of = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)
    c_of = np.log(r_of)
    seeds = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def run(shingles, weights):
        best, at, step = np.full(k, np.inf, dtype=np.float32), np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=np.int64)
        cols = np.arange(k)
        for i in range(0, len(shingles), 2048):
            s = shingles[i : i + 2048]
            u = mixed(s[:, None] ^ seeds)
            r = r_of[u & np.uint64(0xFFFF)]
            beta = ((u >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
            t = np.floor(np.log(weights[i : i + 2048])[:, None] / r + beta)
            a = c_of[(u >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + np.float32(1))
            j = a.argmin(axis=0)
            least = a[j, cols]
            new = least < best
            best[new], at[new], step[new] = least[new], s[j][new], t[j, cols][new]
        return mixed(at ^ (step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ seeds)

    return run


def signatures(rows: DataFrame, weight_of, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """(doc_id, node, samples, buckets, keys, n): a text's node, its samples (32 bits each), its band keys (none without words; twice, as an array and as bytes) and its number of different shingles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, sample, weights = hasher(), sampler(bands * per), weight_of.value
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for b in batches:
            sig, keys, size = [], [], []
            for t in b.column("text").to_pylist():
                s, n = shingled(words(t))
                size.append(len(s))
                if not len(s):
                    sig.append(b"")
                    keys.append([])
                    continue
                got = sample(s, n.astype(np.float32) * weights[s & np.uint64(len(weights) - 1)])
                sig.append(got.astype(np.uint32).tobytes())
                key = salt.copy()
                for c in got.reshape(bands, per).T:
                    key = mixed(key * np.uint64(3) + c)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "node": b.column("node"), "samples": pa.array(sig, pa.binary()), "buckets": pa.array(keys, pa.list_(pa.int64())), "keys": pa.array([np.asarray(key).tobytes() for key in keys], pa.binary()), "n": pa.array(size, pa.int64())})

    return rows.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, samples binary, buckets array<long>, keys binary, n long")


def _groups(batches, columns):
    """Arrow batches of rows sorted by the first column -> one list of arrays per value of it; a group may span batches."""
    import numpy as np

    held = None
    for b in batches:
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        edges = [0, *cut]
        for a, e in zip(edges, edges[1:], strict=False):
            yield [x[a:e] for x in now]
        held = [x[edges[-1] :] for x in now]
    if held is not None and len(held[0]):
        yield held


def similarity(a, b, weights) -> float:
    """Exact weighted Jaccard similarity of two (shingles, counts)."""
    import numpy as np

    (s, n), (t, m) = a, b
    mask = np.uint64(len(weights) - 1)
    total = (n * weights[s & mask]).sum(dtype=np.float64) + (m * weights[t & mask]).sum(dtype=np.float64)
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    both = (np.minimum(n[i], m[j]) * weights[s[i] & mask]).sum(dtype=np.float64)
    return float(both / (total - both)) if total else 0.0


def shingle_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles, counts) of the listed nodes, each once: 64-bit keys and 32-bit counts."""
    near = rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes.hint("merge"), "node", "left_semi")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = hasher()
        for b in batches:
            got = [shingled(words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "shingles": pa.array([s.tobytes() for s, _ in got], pa.binary()), "counts": pa.array([n.astype(np.uint32).tobytes() for _, n in got], pa.binary())})

    return near.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node long, shingles binary, counts binary")


def joined(label, side, samples, same_band, sets, least: float, threshold: float):
    """(links, first): pairs (i, j) of rows that exact similarity joins into classes, and the row nearest to the most common samples.

    ``label``: classes known before. ``side``: rows of 1 meet rows of 2, rows of 0 each other. ``same_band(i)``: the rows whose pair with i belongs
    here. ``sets``: (shingles, weights) of each row.
    """
    import numpy as np

    n = len(label)
    common = np.empty(samples.shape[1], dtype=samples.dtype)
    for c in range(samples.shape[1]):
        values, times = np.unique(samples[:, c], return_counts=True)
        common[c] = values[times.argmax()]
    order = np.argsort(-(samples == common).sum(1), kind="stable")
    lengths = np.array([len(s) for s, _ in sets])
    ends = np.cumsum(lengths)
    _, place = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets])
    total = np.add.reduceat(weight, ends - lengths)
    dense, root, links = np.zeros(place.max() + 1), label.copy(), []
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    for i in order[side[order] < 2]:
        due = (root != root[i]) & same_band(i) & ((side == 2) if side[i] == 1 else (side == 0) & (rank > rank[i]))
        due[due] = (samples[due] == samples[i]).mean(1) >= least
        at = np.flatnonzero(due)
        if not len(at):
            continue
        mine = slice(ends[i] - lengths[i], ends[i])
        dense[place[mine]] = weight[mine]
        starts = np.concatenate([[0], np.cumsum(lengths[at])[:-1]])
        entry = np.arange(lengths[at].sum()) + np.repeat(ends[at] - lengths[at] - starts, lengths[at])
        both = np.add.reduceat(np.minimum(dense[place[entry]], weight[entry]), starts)
        dense[place[mine]] = 0.0
        for j in at[both / (total[i] + total[at] - both) >= threshold - 1e-9]:
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links, int(order[0])


def found_links(tasks: DataFrame, data: DataFrame, k: int, weight_of, least: float, threshold: float) -> DataFrame:
    """(group, a, b): links that the pairs of each task (group, band, node, label, side) add; a row with a = b names the group's first node."""
    columns = ("group", "band", "node", "label", "side", "samples", "keys", "shingles", "counts")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights = weight_of.value
        mask = np.uint64(len(weights) - 1)
        for group, band, node, label, side, samples, keys, shingles, counts in _groups(batches, columns):
            if len(node) < 2:
                continue
            keys = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(len(node), -1)
            here = int(band[0])
            # A pair belongs to the first band that it shares.
            same_band = lambda i, keys=keys, here=here, node=node: (keys[:, here] == keys[i, here]) & ~(keys[:, :here] == keys[i, :here]).any(1) & (node != node[i])
            sets = []
            for s, c in zip(shingles, counts, strict=True):
                s = np.frombuffer(s, dtype=np.uint64)
                sets.append((s, np.frombuffer(c, dtype=np.uint32) * weights[s & mask].astype(np.float64)))
            links, first = joined(label, side, np.frombuffer(b"".join(samples), dtype=np.uint32).reshape(len(node), k), same_band, sets, least, threshold)
            i, j = np.array([*links, (first, first)]).T
            yield pa.RecordBatch.from_pydict({"group": group[i], "a": node[i], "b": node[j]})

    rows = tasks.join(data, "node").select(*columns)
    return rows.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "group long, a long, b long")


def linked(nodes: DataFrame, rows: DataFrame, k: int, weight_of, least: float, threshold: float, block: int) -> DataFrame | None:
    """(node, label) of the classes: components of the verified links among nodes that share a bucket."""
    member = nodes.select("node", "n", F.posexplode("buckets").alias("band", "bucket"))
    sizes = written(member.groupBy("bucket").agg(F.count("*").alias("nodes"), F.sum("n").alias("total")).where("nodes > 1"), "sizes")  # a table, so that the join can split a hot bucket
    dealt = F.greatest(F.when(F.col("nodes") > block, F.ceil(F.col("nodes") / (block / 2))).otherwise(1), F.ceil(F.col("total") * 12 / GROUP_BYTES))
    member = member.join(sizes, "bucket").select("bucket", "band", "node", dealt.alias("parts"), F.pmod(F.xxhash64("node", "bucket"), dealt).alias("part"))
    member = written(member.withColumn("group", F.xxhash64("bucket", "part")), "members")
    keys = nodes.join(shingle_sets(rows, written(member.select("node").distinct(), "needed")), "node")
    data = written(keys.select("node", "samples", "keys", "shingles", "counts"), "shingles")
    task = lambda df: found_links(df, data, k, weight_of, least, threshold)

    got = written(task(member.select("group", "band", "node", F.col("node").alias("label"), F.lit(0).alias("side"))), "links")
    links = got.where("a <> b").select("a", "b")
    split = member.where("parts > 1")
    if split.head(1):
        hubs = split.select("bucket", "group").distinct().join(got.where("a = b").select("group", F.col("a").alias("node")), "group").select("bucket", "node").distinct()
        few = hubs.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("node"))).where(f"at <= {HUBS}").drop("at")
        where = split.select("bucket", "band", "group").distinct()
        links = written(links.union(_meeting(split, few.join(where, "bucket"), _labels(links), task)), "links")
        own = written(split.join(_labels(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "own")
        largest = own.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"))
        largest = written(largest.where("m.n < n").select("bucket", F.col("m.label").alias("most"), F.ceil((F.col("n") - F.col("m.n")) * 2 / block).alias("minors")), "largest")
        minor = own.join(largest, "bucket").where("label <> most").select("bucket", "node", "minors", F.pmod(F.xxhash64("bucket", "node"), F.col("minors")).alias("minor"))
        minor = minor.join(where, "bucket").select("bucket", "band", "node", F.xxhash64("group", "minor").alias("group"))
        every = split.join(largest, "bucket").withColumn("minor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)))
        every = every.select("bucket", "band", "node", F.xxhash64("group", "minor").alias("group"))
        links = links.union(written(_meeting(every, minor, own.select("node", "label").distinct(), task), "links"))
    return components(links) if links.head(1) else None


def _labels(links: DataFrame) -> DataFrame:
    return written(components(links), "labels")


def _meeting(rows: DataFrame, others: DataFrame, labels: DataFrame, task) -> DataFrame:
    """Links (a, b) between ``others`` and ``rows`` of the same group (both: group, band, node)."""
    sides = [df.select("group", "band", "node", F.lit(side).alias("side")) for df, side in ((others, 1), (rows, 2))]
    known = sides[0].union(sides[1]).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return task(known.select("group", "band", "node", "label", "side")).where("a <> b").select("a", "b")


def classes(rows: DataFrame, threshold: float = THRESHOLD, features: int = FEATURES, bands: int = BANDS, per: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, node, label) of every row of (doc_id, node, text): rows of one label are one class."""
    df, n_docs = document_frequencies(rows, features)
    weight_of = rows.sparkSession.sparkContext.broadcast(idf(df, n_docs))  # ``features`` numbers
    k = bands * per
    signed = written(signatures(rows, weight_of, bands, per), "signatures")
    nodes = written(signed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("samples", "buckets", "keys", "n")]), "nodes")
    least = max(0.0, threshold - 4 * (threshold * (1 - threshold) / k) ** 0.5)
    labels = linked(nodes, rows, k, weight_of, least, threshold, block)
    found = signed.select("doc_id", "node")
    found = found.withColumn("label", F.col("node")) if labels is None else found.join(labels, "node", "left")
    return found.select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class) and class_size."""
    found = written(classes(texts(docs).withColumn("node", F.xxhash64("text")), **options), "classes")
    by = written(found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")  # a table, so that the join can split a hot class
    return found.join(by, "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns: one of each class, that of the least id (of equal ids, the least text hash; of rows equal in both, any)."""
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = written(classes(texts(docs).withColumn("node", F.xxhash64("text")), **options), "classes")
    rows = found.groupBy("label", "doc_id", "node").agg(F.count("*").alias("n"))
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "node", "n")).alias("f")).select(F.xxhash64("f.doc_id", "f.node").alias("_key"), "f.n")
    first = written(first, "kept")
    small = first.count() <= BROADCAST_ROWS
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), node).alias("_key"))  # one struct: no column's name can clash
    pick = lambda keys: keyed.join(F.broadcast(keys) if small else keys.hint("merge"), "_key", "left_semi")
    once = pick(first.where("n = 1").select("_key"))
    again = pick(first.where("n > 1").select("_key")).dropDuplicates(["_key"])  # rows of one id and text
    return once.unionByName(again).select("_row.*")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
