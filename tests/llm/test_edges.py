"""Every text operator and pipeline stage on odd tables: nulls, empty and very long texts, ties, repeated rows, no rows, and columns whose names clash."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from panelcast.llm import chat, decontaminate, divergence, language, lines, neardup, packing, quality, resample, secrets, sharding, substrings, toxicity  # noqa: E402
from panelcast.llm.common import texts  # noqa: E402

CLASH = "node label bucket key _key rest _rest _row _null runs cut shingles doc_key item_key spans hits score shard virtual_slot piece length _text".split()
SIX = "one two three four five six"


def long_text(n=5_000_000):
    """About 5 MB in lines, none of which repeats."""
    rng, out, size = random.Random(4), [], 0
    while size < n:
        line = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(9)) + " the of and"
        out.append(line)
        size += len(line) + 1
    return "\n".join(out)


LONG = long_text()
ROWS = [(1, None), (2, ""), (None, SIX), (3, SIX), (3, SIX), (4, " \n\n "), (5, LONG)]


def with_clashes(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"{i} AS `{c}`" if i % 2 else f"'{c}' AS `{c}`" for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(spark, request):
    df = with_clashes(spark, ROWS if request.param == "odd" else [], "doc_id long, text string").selectExpr("*", "length(text) AS n_chars").cache()
    df.rows = ROWS if request.param == "odd" else []
    yield df
    df.unpersist()


def test_quality(docs):
    got = quality.judge(docs).collect()
    assert len(got) == len(docs.rows)
    assert {r["doc_id"] for r in got if r["kept"]} == ({5} if docs.rows else set())
    assert all(r["n_words"] == 0 and r["base_failed"] for r in got if r["doc_id"] in (1, 2, 4))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [(r["doc_id"], len(r["text"])) for r in kept.collect()] == ([(5, len(LONG))] if docs.rows else [])


def test_lines(docs):
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()), key=repr)
    want = [(1, "", 0, 0), (2, "", 0, 0), (None, SIX, 1, 0), (3, "", 1, 1), (3, "", 1, 1), (4, " \n\n ", 0, 0), (5, LONG, LONG.count("\n") + 1, 0)]
    assert got == sorted(want if docs.rows else [], key=repr)  # the null id sorts first, so its line stays
    out = lines.drop_repeated(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = sorted(((r["doc_id"], r["text"], r["n_chars"], r["node"]) for r in out.collect()), key=repr)
    assert kept == sorted([(1, None, None, "node"), *((d, t, len(t), "node") for d, t, _, _ in want[1:])] if docs.rows else [], key=repr)


def test_near_duplicates(docs):
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (2, 1, 2), (None, 3, 3), (3, 3, 3), (3, 3, 3), (4, 4, 1), (5, 5, 1)] if docs.rows else [], key=repr)
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] for r in one.collect()), key=repr) == sorted([1, None, 4, 5] if docs.rows else [], key=repr)


def test_substrings(docs):
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["kept"]), r["spans"]) for r in substrings.dedup_substrings(docs).collect()), key=repr)
    assert got == sorted([(d, len(t or ""), len(t or ""), []) for d, t in docs.rows], key=repr)
    assert substrings.shared_passages(substrings._keyed(docs)).count() == 0


@pytest.mark.parametrize("items", ["odd", "empty"])
def test_decontamination(spark, docs, items):
    deep = " ".join(LONG.split()[400_000:400_040])
    rows = [(1, SIX), (1, SIX), (2, None), (None, "a b"), (3, ""), (4, deep)] if items == "odd" else []
    bench = with_clashes(spark, rows, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contained_items(docs, bench).collect()), key=repr)
    assert got == sorted([(None, 1, 1.0), (3, 1, 1.0), (5, 4, 1.0)] if docs.rows and rows else [], key=repr)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted([1, 2, 4] if rows and docs.rows else [d for d, _ in docs.rows], key=repr)


def test_sharding(docs):
    got = sharding.shard_documents(docs, 3, 16).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted([(d, len(t or "") + 8) for d, t in docs.rows], key=repr)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert sorted((r["doc_id"] for r in got if r["piece"] == 0), key=repr) == sorted((d for d, _ in docs.rows), key=repr)
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == ([1, 1] if docs.rows else [])
    long = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 5)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False)) and all(n == 2048 for _, n in long[1:])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and sum(n for _, n in v) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False))


@pytest.mark.parametrize("labelled", ["odd", "empty"])
def test_toxicity(spark, docs, labelled):
    rows = [(1, 0, 1), (None, 0, 1), (3, 1, None), (3, 1, 0), (3, 1, 0), (5, 1, 0)] if labelled == "odd" else []
    got = toxicity.score_toxicity(docs, with_clashes(spark, rows, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs.rows) and all(0 <= r["score"] < 0.3 and r["predicted"] == 0 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_secrets(spark, docs):
    assert sorted(((r["doc_id"], list(r["spans"])) for r in secrets.find_secrets(docs).collect()), key=repr) == sorted([(d, []) for d, _ in docs.rows], key=repr)
    deep = with_clashes(spark, [(1, LONG + " token=abcdef0123"), (1, "password: hunter22"), (1, "password: hunter22")], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in secrets.find_secrets(deep).collect()) == [1, 1, 1]


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_chat(spark, rows):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")] if rows == "odd" else []
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["trained"]) for r in chat.read_back(chat.expand(with_clashes(spark, turns, "conv_id long, turn long, role string, text string"))).collect()}
    want = {
        1: ([("user", LONG), ("assistant", "<|im_end|>"), ("assistant", "<|im_end|>")], "<|im_end|>" * 2),
        2: ([("", "")], ""),
        None: ([("assistant", "")], ""),
        3: ([("assistant", "a"), ("assistant", "b")], "ab"),
    }
    assert got == (want if turns else {})


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline(spark, tmp_path, kind):
    good = [(d, t) for d, t in [*ROWS, (6, LONG[:3000]), (6, LONG[:3000]), (7, LONG[3001:9000]), (8, LONG[:2990] + " more")]] if kind == "odd" else []
    sf = f"file://{tmp_path}"
    with_clashes(spark, good, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    with_clashes(spark, [(1, SIX)] if good else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}
    if good:
        assert {r["doc_id"] for r in now.collect()} == {5, 6, 7}  # most lines of 6 to 8 stand in 5 first, so they stay whole; of 6, 6 and 8 near-dedup keeps one
    else:
        assert not packed


def brute_kind(word, terms, clean):
    if word in terms:
        return 1
    if word in clean or len(word) < 4:
        return 0

    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, d in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
            p = q
        return p[-1]

    return 2 if any(abs(len(word) - len(t)) <= 2 and edits(word, t) <= toxicity.allowed(t) for t in terms) else 0


def test_hits_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    terms, clean = ["idiot", "disgusting", "trash", "worthless", "loser", "oaf"], {"losers"}
    rows = [(r["doc_id"], (r["text"] or "") + extra) for r, extra in zip(docs.orderBy("doc_id").collect(), [" such an idoit", ' he said "trash" then', " disgustng worthles people", " losers oafs", ""] * 1000)]
    got = {r["doc_id"]: [r[f] for f in toxicity.FEATURES[:4]] for r in toxicity.hits(texts(spark.createDataFrame(rows, "doc_id long, text string")), terms, clean).collect()}
    for d, text in rows:
        low = text.lower()
        spans = [m.span() for m in re.finditer(toxicity.WORD, low)]
        words = [low[a:b] for a, b in spans]
        want = [0, 0, 0, 0]
        for i, w in enumerate(words):
            if k := brute_kind(w, terms, clean):
                a, b = max(0, i - toxicity.NEAR), min(len(words), i + toxicity.NEAR + 1)
                before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
                quoted = set(before) & set(toxicity.QUOTES) and set(after) & set(toxicity.QUOTES) or set(words[a:b]) & toxicity.REPORTING
                want[2 * (k == 2) + bool(quoted)] += 1
        assert [round(2.718281828459045**x - 1) for x in got[d]] == want, (d, text[-80:])


def test_divergence(docs):
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs.selectExpr("*", "IF(doc_id = 5, 'a', NULL) AS lang", "string(doc_id % 2) AS source"), 2).collect())
    if not docs.rows:
        assert got == []
        return
    assert {g[:4] for g in got if g[2] == "pair"} == {("", a, "pair", b) for a in ("", "0", "1") for b in ("", "0", "1") if a != b}
    assert {g[3] for g in got if g[2] == "term"} <= set(SIX.split())  # the long text's terms stand in one document


@pytest.mark.parametrize("taught", ["odd", "none"])
def test_language(docs, taught):
    model = language.learn(docs.selectExpr("text", "IF(doc_id = 5, 'a', IF(doc_id = 3, 'b', NULL)) AS lang").where("true" if taught == "odd" else "false"))
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in language.identify(docs, model).collect()), key=repr)
    known = dict(docs.rows) and taught == "odd"
    want = [(1, "und"), (2, "und"), (4, "und"), *((x, "b" if known else "und") for x in (None, 3, 3)), (5, "a" if known else "und")]
    assert got == sorted(want if docs.rows else [], key=repr)


@pytest.mark.parametrize("items", ["odd", "empty"])
def test_resampling(spark, docs, items):
    target = with_clashes(spark, [(1, SIX), (2, None), (3, "")] if items == "odd" else [], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_features"], r["rank"]) for r in resample.resample(docs, target, (1, 1)).collect()), key=repr)
    n = len(LONG.split())
    assert got == sorted([(1, 0, 0, None), (2, 0, 0, None), (4, 0, 0, None), (None, 6, 15, None), (3, 6, 15, None), (3, 6, 15, None), (5, n, 3 * n - 3, 1)] if docs.rows else [], key=repr)
