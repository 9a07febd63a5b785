"""Toxicity scores: a learned lexicon, Levenshtein automata intersected with its trie for misspelt terms, and
context windows that tell quotation from abuse.

Learning uses labelled rows only where crc32(doc_id) mod 4 is not 2. A word becomes a term if nearly all the documents that hold it are toxic
and it follows several different words there (copies of one toxic text do not make terms of its other words). Each word of a text
is looked up in the trie of terms by running its Levenshtein automaton along the trie's edges: one edit for terms of 5 letters or
more, two from 9; words that clean labelled documents hold are no misspellings. Every hit is weighed by its window: inside
quotation marks or near a word of reporting it counts as quoted. A ridge-penalised logistic curve over the hits, fitted on at
most ``FIT_ROWS`` labelled rows (those of least hash), gives the score; counts for the lexicon are over all of them.

Null and empty texts have no hits and get the score of a text without any; a text of any length is scored whole, with one row of features; of two terms
equally near to a word the first in order counts; a null id is never held out and never learned from; an id with several labels is toxic if one says so;
repeated rows are scored each; without labels nothing is a term and all scores are low; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import per_text, table, texts, written

WORD = r"[^\W\d_]+"
MIN_TERM, MAX_TERM = 3, 40
PRECISION, MIN_CONTEXTS, DOCUMENT_SHARE = 0.9, 3, 0.005
BROADCAST_ROWS = 400_000
FIT_ROWS = 20_000
NEAR = 5
THRESHOLD = 0.3
# Words of reporting in four languages, and quotation marks.
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word term phrase sagte sagt nannte wort zitat schrieb dit disait mot terme citation dijo dice palabra cita llamó".split())
QUOTES = "\"“”„«»‘’`"
FEATURES = ("plain", "quoted", "near_plain", "near_quoted", "density")
PRIOR = (-4.0, 3.0, 0.5, 2.0, 0.3, 1.0)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Trie:
    """Terms by letters; ``matches`` runs a word's Levenshtein automaton along the edges."""

    def __init__(self, terms):
        self.root: dict = {}
        self.terms = set(terms)
        self.pieces = self._pieces()
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def _pieces(self) -> dict[int, list[tuple[int, int, set[str]]]]:
        """Word length -> slices of a word and the strings one of which must stand in one of them.

        A term of k edits is cut into k + 1 pieces, one of which the edits leave whole: the first at its place, the last at its
        distance from the end, or a middle one with an edit on either side.
        """
        found: dict[int, dict[tuple[int, int], set[str]]] = {}
        for t in self.terms:
            k, n = allowed(t), len(t)
            for m in range(n - k, n + k + 1):
                for i in range(k + 1):
                    a, b = n * i // (k + 1), n * (i + 1) // (k + 1)
                    for d in (0,) if i == 0 else (m - n,) if i == k else (d for d in (-1, 0, 1) if abs(m - n - d) <= 1):
                        if 0 <= a + d and b + d <= m:
                            found.setdefault(m, {}).setdefault((a + d, b + d), set()).add(t[a:b])
        return {m: [(a, b, strings) for (a, b), strings in slices.items()] for m, slices in found.items()}

    def near(self, word: str) -> str | None:
        """A term within its allowed edits of the word (the fewest edits, then the first in order), or None.

        The automaton's states are bit sets, one for each number of edits: bit i says that i letters of the word are read.
        """
        m = len(word)
        if m < 4 or not any(word[a:b] in strings for a, b, strings in self.pieces.get(m, ())):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, full = 1 << m, (1 << m + 1) - 1
        best = None
        stack = [(self.root, 1, 3, 7)]
        while stack:
            node, s0, s1, s2 = stack.pop()
            for c, child in node.items():
                if c == "":
                    edits = 0 if s0 & end else 1 if s1 & end else 2
                    if (s2 & end) and edits <= allowed(child) and (best is None or (edits, child) < best):
                        best = (edits, child)
                    continue
                b = masks.get(c, 0)
                t0 = (s0 & b) << 1
                t1 = ((s1 & b) << 1 | s0 | s0 << 1 | t0 << 1) & full
                t2 = ((s2 & b) << 1 | s1 | s1 << 1 | t1 << 1) & full
                if t1 or t2 and m >= 7:  # two edits are for long terms only
                    stack.append((child, t0, t1, t2))
        return best[1] if best else None


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _toxic_words(toxic: DataFrame) -> DataFrame:
    """(word, n_toxic, n_contexts): toxic documents that hold a word, and how many different words it follows at its first place in them."""

    def make():
        find = re.compile(WORD).findall

        def run(batch):
            out = []
            for text in batch:
                seen: dict[str, str] = {}
                last = ""
                for w in find(text.lower()):
                    if MIN_TERM <= len(w) <= MAX_TERM and w not in seen:
                        seen[w] = last
                    last = w
                out.append([{"w": w, "c": c} for w, c in seen.items()])
            return {"words": out}

        return run

    each = per_text(toxic, make, "words array<struct<w:string,c:string>>").select(F.explode("words").alias("x"))
    pairs = each.groupBy(F.col("x.w").alias("word"), F.xxhash64("x.c").alias("c")).agg(F.count("*").alias("n"))
    return pairs.groupBy("word").agg(F.sum("n").alias("n_toxic"), F.count("*").alias("n_contexts"))


def _per_task_words(texts_: DataFrame, start, schema: str) -> DataFrame:
    """``start()`` gives a task's (see, end): see(distinct words of a text), end() -> columns of its few output rows."""

    def run(batches):
        import pyarrow as pa

        find = re.compile(WORD).findall
        see, end = start()
        for b in batches:
            for t in b.column("text").to_pylist():
                see(set(find(t.lower())))
        yield pa.RecordBatch.from_pydict(end())

    return texts_.select("text").mapInArrow(run, schema)


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[list[str], set[str]]:
    """Terms and the clean words within their edits, which are no misspellings.

    Words of toxic documents are counted first. Terms stand in a ``DOCUMENT_SHARE`` of them, so they number at most a document's mean distinct words over
    that share, however many documents there are, so they can go to every task, which counts them in clean documents.
    """
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = written(own, "labels")
    n_toxic = own.where("toxic = 1").count()
    few = own.count() <= BROADCAST_ROWS  # 12 bytes each; beyond that both sides are shuffled
    of = lambda ids: docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")
    frequent = _toxic_words(of(own.where("toxic = 1").select("doc_id"))).where((F.col("n_contexts") >= MIN_CONTEXTS) & (F.col("n_toxic") >= DOCUMENT_SHARE * n_toxic))
    toxic = {r["word"]: r["n_toxic"] for r in frequent.select("word", "n_toxic").collect()}
    clean_docs = of(own.where("toxic <> 1").select("doc_id"))
    held = spark.sparkContext.broadcast(frozenset(toxic))

    def counting():
        from collections import Counter

        n: Counter = Counter()
        words = held.value
        return (lambda seen: n.update(seen & words)), (lambda: {"word": list(n), "n": list(n.values())})

    counts = _per_task_words(clean_docs, counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect() if toxic else []
    clean = {r["word"]: r["n"] for r in counts}
    good = [w for w, n in toxic.items() if n >= PRECISION * (n + clean.get(w, 0))]
    terms = sorted(good)
    if not terms:
        return [], set()

    def nearing():
        trie, met, near = Trie(terms), set(), set()

        def see(words):
            new = words - met
            if len(met) > 1_000_000:
                met.clear()
            met.update(new)
            near.update(w for w in new if w not in trie.terms and trie.near(w))

        return see, lambda: {"word": sorted(near)}

    found = _per_task_words(clean_docs, nearing, "word string").distinct()
    return terms, {r["word"] for r in found.collect()}  # at most the words within two edits of the terms


def hit_counts(text: str, words: list[str], spans, kinds: dict[int, bool]) -> list[float]:
    """plain, quoted, near_plain, near_quoted: hits by kind (exact or near) and by what their window says."""
    out = [0.0, 0.0, 0.0, 0.0]
    for i, near in kinds.items():
        a, b = max(0, i - NEAR), min(len(words), i + NEAR + 1)
        start, stop = spans[i]
        before, after = text[spans[a][0] : start], text[stop : spans[b - 1][1] + 1]
        quoted = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
        quoted = quoted or any(w in REPORTING for w in words[a:b])
        out[2 * near + quoted] += 1
    return out


def hits(docs: DataFrame, terms: list[str], clean: set[str]) -> DataFrame:
    """doc_id and the features of every text: the hits of each kind (log of one plus the count) and their share of the words."""

    def make():
        import math

        trie = Trie(terms)
        finditer, find = re.compile(WORD).finditer, re.compile(WORD).findall
        known: dict[str, int] = {}
        other: set[str] = set()

        def kind(w: str) -> int:
            """0: no term, 1: a term, 2: near one."""
            if w in trie.terms:
                return 1
            return 2 if w not in clean and trie.near(w) else 0

        def run(batch):
            rows = []
            for text in batch:
                low = text.lower()
                words = find(low)
                kinds = {}
                if len(other) > 1_000_000:
                    other.clear()
                for w in set(words) - other if terms else ():
                    k = known.get(w) or kind(w)
                    if k:
                        kinds[w] = known[w] = k
                    else:
                        other.add(w)
                if not kinds:
                    rows.append((0.0,) * 5)
                    continue
                spans = [m.span() for m in finditer(low)]
                got = hit_counts(low, words, spans, {i: kinds[w] == 2 for i, w in enumerate(words) if w in kinds})
                rows.append((*(math.log1p(x) for x in got), math.log1p(100 * sum(got) / len(words))))
            return {f: list(c) for f, c in zip(FEATURES, zip(*rows, strict=True), strict=True)} if rows else {f: [] for f in FEATURES}

        return run

    return per_text(docs, make, ", ".join(f"{f} double" for f in FEATURES))


def fit(rows: list[tuple], penalty: float = 1.0, steps: int = 50) -> list[float]:
    """Weights (intercept first) of a logistic curve by Newton steps; the penalty pulls towards ``PRIOR``. rows: features, then the label."""
    import numpy as np

    prior = np.array(PRIOR)
    w = prior.copy()
    if not rows:
        return w.tolist()
    data = np.array(rows, dtype=float)
    x, y = np.column_stack([np.ones(len(data)), data[:, :-1]]), data[:, -1]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return w.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the features of every row of ``docs``."""
    rows = texts(docs)
    terms, clean = learn_lexicon(rows, labels)
    found = written(hits(rows, terms, clean), "hits")
    train = found.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("_toxic")).where("_toxic IS NOT NULL"), "doc_id").where(~is_held_out(F.col("doc_id")))
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(*FEATURES, "_toxic").collect()  # at most fit_rows
    w = fit([tuple(r) for r in sample])
    z = F.lit(w[0])
    for f, v in zip(FEATURES, w[1:], strict=True):
        z = z + F.col(f) * F.lit(v)
    score = 1 / (1 + F.exp(-z))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
