"""Best-fit packing by bin completion over the histogram of piece lengths.

A document is its token ids and a closing id 0; only those longer than a sequence are cut, the first
piece being the shorter. How pieces share sequences depends on lengths alone, so the driver plans over the counts of
at most ``size`` lengths, however many documents there are: a best-fit-decreasing plan is the first incumbent, and
branch and bound fills the bin of the largest piece left with undominated fillings of any number of pieces, fullest first: each as often
as the counts allow, then once. It prunes where the waste so far and the lower bound of the rest can't beat the incumbent, and ends at
the bound. A dive down to a whole plan takes a node a length at most; beyond that the search looks at ``nodes``
nodes, and at ``steps`` partial fillings a node, and then keeps its incumbent. With both None it is exact. Executors then place
every piece: its rank among those of its length selects the filling, and with it the sequence and the place.

A null or empty text is one piece of length 1 (the closing id); a null id stays null; repeated rows
are packed each; pieces of one length are ranked by id, piece and checksum, equal ones in any order; a text of any length is cut into
as many pieces as it needs; an empty table gives an empty result; further columns are ignored. Token ids are
those of the ``byte_bpe_50k`` vocabulary; its own added tokens in texts are their ids, as its tokenizer has it.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import per_text, table, texts, written

SIZE = 2048
NODES = 2000
STEPS = 400


def tokenizer_files() -> tuple[str, str, str]:
    """Ranks of the vocabulary, its word pattern, and the tokenizer's own file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def encoder(ranks_path: str, pattern: str, tokenizer_path: str):
    """text -> ids, without special tokens of its own. The ranks are the same vocabulary as the tokenizer's and give the same ids, several times faster."""
    import base64

    import numpy as np
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer_path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks={k: v for k, v in ranks.items() if v not in added.values()}, special_tokens=added)
    return lambda text: enc.encode_to_numpy(text, allowed_special="all").astype("<u4")


def pieces(docs: DataFrame, size: int = SIZE, with_ids: bool = False, files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if wanted) of every piece."""
    files = files or tokenizer_files()

    def make():
        import numpy as np

        encode = encoder(*files)

        def run(batch):
            out = []
            for text in batch:
                ids = np.append(encode(text), np.uint32(0)).astype("<u4")
                cut = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                out.append([(i, a, b - a, zlib.crc32(raw := ids[a:b].tobytes()), raw if with_ids else None) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])
            return {"p": [[dict(zip(("piece", "start", "length", "ids_crc32", "ids"), x, strict=True)) for x in row] for row in out]}

        return run

    cut = per_text(texts(docs), make, "p array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>")
    out = cut.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")
    return out if with_ids else out.drop("ids")


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces that can't share with the larger ones."""
    total = sum(x * n for x, n in counts.items())
    best = -(-total // size)
    if not counts:
        return 0
    lengths = sorted(counts, reverse=True)
    for k in [x for x in lengths if 2 * x <= size][:1] + [x for x in lengths if 2 * x <= size][-1:]:
        big = sum(n for x, n in counts.items() if x > size - k)
        mid = sum(n for x, n in counts.items() if size / 2 < x <= size - k)
        room = mid * size - sum(x * n for x, n in counts.items() if size / 2 < x <= size - k)
        small = sum(x * n for x, n in counts.items() if k <= x <= size / 2)
        best = max(best, big + mid + max(0, -(-(small - room) // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over counts: (lengths, how many sequences are filled so). Equal sequences are one entry."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, number]
    for x in sorted(counts, reverse=True):
        n = counts[x]
        for room in sorted(r for r in open_ if r >= x):
            each = room // x
            left = []
            for lengths, m in open_.pop(room):
                full = min(m, n // each)
                rest = n - full * each if full < m and n - full * each < each else 0
                parts = [(lengths + (x,) * each, full, room - each * x), (lengths + (x,) * rest, int(rest > 0), room - rest * x), (lengths, m - full - int(rest > 0), room)]
                n -= full * each + rest
                left += [p for p in parts if p[1] > 0]
            for lengths, m, r in left:
                open_.setdefault(r, []).append([lengths, m])
            if not n:
                break
        if n:
            each = size // x
            for k, m in ((each, n // each), (n % each, 1)):
                if k and m:
                    open_.setdefault(size - k * x, []).append([(x,) * k, m])
    return [(tuple(lengths), m) for groups in open_.values() for lengths, m in groups]


def dominated(fill: tuple[int, ...], left: dict[int, int], up: list[int], slack: int) -> bool:
    """Whether one unused piece can take the place of one or two of the filling's, being no smaller: the other filling leaves less behind."""
    import bisect

    small = sorted(set(fill))
    pairs = {a + b for i, a in enumerate(fill) for b in fill[i + 1 :]}
    for total, least in [(e, e + 1) for e in small] + [(e, e) for e in pairs]:
        for s in up[bisect.bisect_left(up, least) : bisect.bisect_right(up, total + slack)]:
            if left[s] > fill.count(s):
                return True
    return False


def fillings(left: dict[int, int], room: int, steps: int | None = STEPS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with any number of the pieces ``left``, fullest first; of the first ``steps`` partial ones looked at, larger pieces first."""
    import bisect

    up = sorted(x for x in left if x <= room)
    found: set[tuple[int, ...]] = set()

    def extend(fill: tuple[int, ...], used: int, most: int) -> bool:
        """Whether the search goes on."""
        nonlocal steps
        if steps is not None:
            steps -= 1
        fits = False
        for i in range(bisect.bisect_right(up, min(most, room - used)) - 1, -1, -1):
            x = up[i]
            if left[x] > fill.count(x):
                fits = True
                if not extend((*fill, x), used + x, x):
                    return False
        if not fits and (least := next((x for x in up if left[x] > fill.count(x)), room)) + used <= room and least > most:
            return True  # a larger piece still fits: that filling is found with it placed first
        if not fits:
            if not dominated(fill, left, up, room - used):
                found.add(fill)
            if used == room and steps is not None and len(found) >= 8:
                return False  # as good as can be
        return steps is None or steps > 0

    extend((), 0, room)
    return sorted(found, key=lambda f: (-sum(f), len(f))) or [()]


def plan(counts: dict[int, int], size: int = SIZE, nodes: int | None = NODES, steps: int | None = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, covering ``counts`` (length -> pieces) exactly."""
    counts = {x: n for x, n in counts.items() if n > 0}
    if not counts:
        return []
    incumbent = best_fit(counts, size)
    best, bound = sum(m for _, m in incumbent), lower_bound(counts, size)

    def branches(left: dict[int, int]) -> Iterator[tuple]:
        top = max(left)
        patterns = [(top, *f) for f in fillings(left | {top: left[top] - 1}, size - top, steps)]
        most = [min(left[x] // p.count(x) for x in set(p)) for p in patterns]
        for p, m in [*zip(patterns, most, strict=True), *((p, 1) for p, m in zip(patterns, most, strict=True) if m > 1)]:
            child = {x: n - m * p.count(x) for x, n in left.items()}
            yield p, m, {x: n for x, n in child.items() if n}

    limit = math.inf if nodes is None else nodes + len(counts)
    stack, path, used = [branches(counts)], [], 0
    while stack and best > bound and limit > 0:
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            used -= path.pop()[1] if path else 0
            continue
        pattern, m, left = branch
        limit -= 1
        if used + m + lower_bound(left, size) >= best:  # the waste of a better packing is already spent
            continue
        path.append((pattern, m))
        used += m
        if left:
            stack.append(branches(left))
        else:
            incumbent, best = list(path), used
            used -= path.pop()[1]
    return incumbent


def layout(filled: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """(length, first rank, first sequence, pieces of this length a sequence, their offsets): where each rank of a length goes."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, m in filled:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, o in offsets.items():
            rows.append((x, rank.get(x, 0), sequence, len(o), o))
            rank[x] = rank.get(x, 0) + m * len(o)
        sequence += m
    return sorted(rows)


def place(cut: DataFrame, rows: list[tuple], n_pieces: int) -> DataFrame:
    """Add sequence_id and offset to every piece.

    Ranks are taken in buckets of each length, which number with the pieces, so that a length of very many pieces is no single partition.
    """
    buckets = max(8, math.ceil(n_pieces / 2_000_000))
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_in", rank).join(starts, ["length", "_bucket"]).withColumn("_rank", (F.col("_start") + F.col("_in")).cast("long"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key = np.array([x * 2**44 + r for x, r, _, _, _ in rows], dtype=np.int64)
        first, seq, each = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
        at = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(rows) else each
        offsets = np.array([o for r in rows for o in r[4]], dtype=np.int64)
        for b in batches:
            length, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(key, length * 2**44 + r, side="right") - 1
            k = r - first[i]
            cols = {c: b.column(b.schema.get_field_index(c)) for c in kept}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(seq[i] + k // each[i]), "offset": pa.array(offsets[at[i] + k % each[i]])})

    return ranked.select(*kept, "_rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SIZE, nodes: int | None = NODES, steps: int | None = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut = written(pieces(docs, size), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    return place(cut, layout(plan(counts, size, nodes, steps)), sum(counts.values()))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
