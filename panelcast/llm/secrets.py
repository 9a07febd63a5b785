"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions only at the hits, then
validation of embedded checksums.

Kinds, in this order: ``assign``, ``access`` and ``hex`` are the base; ``github`` and ``npm`` tokens count if the
CRC-32 in their last six base-62 digits agrees, ``iban`` if its remainder modulo 97 is 1. Runs of hex digits have
no keyword, so one fixed pattern finds them. Places are code points, ends exclusive. Each text is
scanned whole, as bytes, in the task that reads it: nothing is shuffled. Null and empty texts have
no spans; spans that start together are ordered by kind; a null id stays null; repeated rows are scanned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import per_text, table, texts

KINDS = ("assign", "access", "hex", "github", "npm", "iban")
# Keyword -> kind. Keywords are matched in lower case.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "iban": "iban"}
ANCHORED = {
    "assign": re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "iban": re.compile(rb"iban[\x20:=]{1,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])", re.I),
}
HEX = re.compile(rb"[0-9a-f]{24,}")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_agrees(token: bytes) -> bool:
    """The last six base-62 digits are the CRC-32 of what stands between the prefix and them."""
    body, check, n = token[4:-6], token[-6:], 0
    for c in check:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body)


def mod97_agrees(iban: bytes) -> bool:
    x = iban.replace(b" ", b"").upper()
    return 15 <= len(x) <= 34 and int("".join(str(int(chr(c), 36)) for c in x[4:] + x[:4])) % 97 == 1


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind == "iban":
        return mod97_agrees(m[1])
    return crc_agrees(m[0])


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: str, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of one text, by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # matches of one kind don't overlap, those that fail included
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in words.iter(raw.lower().decode("latin-1")))
    for at, kind in hits:
        if at >= done[kind] and (m := ANCHORED[kind].match(raw, at)):
            done[kind] = m.end()
            if _valid(kind, m):
                found.append((m.start(), m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    if not found:
        return found
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    if len(raw) != len(text):  # bytes to code points, one pass
        places, at, points = {}, 0, 0
        for p in sorted({p for s, e, _ in found for p in (s, e)}):
            points += len(raw[at:p].decode("utf-8", "surrogatepass"))
            at, places[p] = p, points
        found = [(places[s], places[e], k) for s, e, k in found]
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and spans, an array of ``kind:start:end``."""

    def make():
        words = automaton()
        return lambda batch: {"spans": [[f"{k}:{s}:{e}" for s, e, k in scan(t, words)] for t in batch]}

    return per_text(texts(docs), make, "spans array<string>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda x: F.substring_index(x, ":", 1)
    count = lambda k: F.size(F.filter("spans", lambda x: kind(x) == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: kind(x).isin(*KINDS[:3]))
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )
