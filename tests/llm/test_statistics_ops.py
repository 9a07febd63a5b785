"""Source divergence, language identification and importance resampling against plain Python on small fixtures, against their SQL, and on held-out rows."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same  # noqa: E402
from panelcast.llm import divergence, language, registry, resample  # noqa: E402

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_source_audit", "op13_resample"])
def test_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


# Source divergence


def plain_audit(rows, min_docs):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, w) for x, s, w in rows if x == lang]
        docs = collections.Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        of = {s: collections.Counter() for s, _ in mine}
        for s, w in mine:
            of[s].update(t for t in w if t in set(kept))
        whole = sum(of.values(), collections.Counter())
        p = lambda n, t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept))  # noqa: E731, B023
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in of:
            pairs = [(-sum(far(p(of[s], t), p(of[o], t)) for t in kept), o) for o in of if o != s]
            terms = [(-far(p(of[s], t), p(whole, t)), t) for t in kept if of[s][t] and p(of[s], t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("tile,block,longest", [(4096, 128, 256), (3, 4, 256), (3, 4, 2)])
def test_audit_splits_add_up(spark, monkeypatch, tile, block, longest):
    """Heavy and rare terms, several tiles and blocks of groups: the same whole numbers as in one go."""
    for name, v in (("TILE", tile), ("BLOCK", block), ("LONGEST_POSTING", longest)):
        monkeypatch.setattr(divergence, name, v)
    rng = random.Random(3)
    common, rare = [f"c{chr(97 + i)}" for i in range(6)], [f"r{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = []
    for k in range(150):
        s = rng.randrange(11)
        mine = [r for i, r in enumerate(rare) if i % 11 in (s, (s + 3) % 11)]
        rows.append((" ".join(rng.choices(common, k=rng.randint(0, 12)) + rng.choices(mine, k=rng.randint(0, 8))), rng.choice(["x", "x", None]), f"s{s}"))
    rows += [(None, "y", "only"), ("Ää ÄÄ ää", "y", None), ("one", "z", "a"), ("two", "z", "b")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 3)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, 3)


def test_shares_are_exact(spark):
    n, total, kept = [0, 1, 7, 10**14], 3 * 10**15 + 7, 10**9
    got = spark.createDataFrame([(x, total, kept) for x in n], "n long, total long, kept long").select(divergence.smoothed("n", "total", "kept").alias("p")).collect()
    want = [1 + 10**9 * (x + 2) // (total + 2 * kept) for x in n]
    assert [r["p"] for r in got] == want == divergence._shares(n, total, kept).tolist()


# Language identification


def plain_bits(train, text, order):
    """Code length of a text, with the trees of ``train`` whole, byte by byte from the definition."""
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        padded = bytes(order) + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, bytes(order) + text
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            at = seen.get(padded[i - k : i])
            if at is None:
                continue
            n, d = sum(at.values()), len(at)
            if padded[i] in at:
                bits -= math.log2(at[padded[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_from_the_definition(spark):
    train = [("a", "the cat sat on the mat"), ("a", "a cat"), ("b", "le chat était là"), ("b", ""), ("a", None), (None, "zzz")]
    model = language.learn(spark.createDataFrame(train, "lang string, text string"), share=0.0)
    texts = ["the cat", "là-bas", "", "zzz\x00", "été " * 50, "the cat", None]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        text = texts[r["doc_id"]]
        if text is None:
            assert r["bits"] is None and r["lang_pred"] == "und" and r["score"] == 0
            continue
        for lang in "ab":
            want = plain_bits([t.encode() for x, t in train if x == lang and t is not None], text.encode(), language.ORDER)
            assert r["bits"][lang] == pytest.approx(want, abs=1e-4)
        assert r["lang_pred"] == (min("ab", key=lambda x: r["bits"][x]) if text else "und")


def test_pruned_trees_stay_distributions(spark):
    """The mass of strings that a tree doesn't keep goes into the escapes: what is kept and the escape add up to one."""
    text = "".join(random.Random(1).choices("abc ", k=3000))
    model = language.learn(spark.createDataFrame([("a", text)], "lang string, text string"), share=0.01).toPandas()
    assert (model.groupby("order").size() <= 100).all()
    for _, g in model.groupby(["order", "context"]):
        n, d, kept = g["n"].iloc[0], g["d"].iloc[0], g["c"].sum()
        assert kept <= n and len(g) <= d and (n - kept + d) / (n + d) + kept / (n + d) == pytest.approx(1)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) >= 20").collect()
    assert len(got) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = language.is_held_out(docs["doc_id"])
    other = docs.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 4 = 2 THEN concat('qqq', text) ELSE text END AS text", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 4 = 2 THEN 'qq' ELSE lang END AS lang")
    a, b = (sorted(map(tuple, language.learn(d.where(~held)).collect())) for d in (docs, other))
    assert a == b


# Importance resampling


def test_resample_from_the_definition(spark):
    rng = random.Random(5)
    said = [" ".join(rng.choices(["Alpha", "beta", "éa", "X9", "delta", "eps"], k=rng.randint(0, 40))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(said)] + [(None, "beta " * 25), (7, said[7]), (200, None), (201, "a--b_c\n9")]
    target = [("alpha beta",), ("delta éa x9 x9",), (None,)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string"), (1, 3)).collect()

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = (collections.Counter(b for x in rows for b in features(x)[1]) for rows in ([x for _, x in docs], [x for (x,) in target]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000))))
    want = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        want.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = [(*r, k + 1) for k, r in enumerate(eligible[: len(eligible) // 3])]
    rest = [(*r, None) for r in eligible[len(eligible) // 3 :]] + [(*r, None) for r in want if r[1] < 20]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got), key=repr) == sorted(drawn + rest, key=repr)


def test_ranks_go_on_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 7 AS long) AS v")
    got = resample.ranked(rows, rows["v"].desc(), rows["id"].asc()).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))


@pytest.mark.parametrize("module,banned", [(resample, ("udf", "InPandas", "InArrow", ".rdd", "collect()"))])
def test_native(module, banned):
    source = Path(module.__file__).read_text()
    assert not [b for b in banned if b in source]
