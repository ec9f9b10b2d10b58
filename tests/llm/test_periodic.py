"""Periodic runs against the definition, and the query against its contract read word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.llm import QUERIES, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, length=6, periods=4):
    """Every maximal stretch of every lag whose smallest period is that lag."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                part = words[start : i + q]
                if len(part) >= max(length, periods * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((start, len(part), q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def repetitive(rng):
    words = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 90))]
    n = len(words)
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("length, periods", [(6, 4), (2, 3), (30, 3), (100, 4), (6, 5)])
def test_runs_equal_the_definition(length, periods):
    rng = random.Random(length + periods)
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randint(0, 6))]
        held, offsets = b"", [0]
        for words in texts:
            held += rng.choice([b"", b" "]) + b" ".join(w.encode() for w in words) + rng.choice([b"", b"\n"])
            offsets.append(len(held))
        _, _, first, ids = periodic.words(np.frombuffer(held, np.uint8), np.array(offsets))
        got = list(zip(*[x.tolist() for x in periodic.find_runs(ids, first, length, periods)]))
        assert got == [(k, *r) for k, words in enumerate(texts) for r in brute(words, length, periods)]


def test_one_word_repeated_a_hundred_thousand_times_is_near_linear():
    words = b"x " * 100_000 + b"a b " * 50_000 + b" ".join(b"%d" % (i % 4096) for i in range(40_000))
    _, _, first, ids = periodic.words(np.frombuffer(words, np.uint8), np.array([0, len(words)]))
    got = list(zip(*[x.tolist() for x in periodic.find_runs(ids, first)]))
    assert got == [(0, 0, 100_000, 1), (0, 100_000, 100_000, 2), (0, 200_000, 40_000, 4096)]


def test_irregular_rows(spark, documents, nothing):
    docs = documents.withColumns({"runs": F.lit("clash"), "found": F.lit(1), "row": F.lit(2)}).unionByName(
        documents.limit(1).withColumns({"text": F.lit("a\tb " * 7 + "ü ü ü ü ü ü ü"), "runs": F.lit("x"), "found": F.lit(1), "row": F.lit(2)}))
    got = periodic.runs(docs)
    assert set(docs.columns) <= set(got.columns) and got.count() == docs.count()
    for r in got.collect():
        words = WORD.findall(r["text"] or "")
        if len(words) < 2000:
            want = brute(words)
            assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(words) and r["collapsed"] == collapse(words, want)
    assert periodic.runs(nothing).count() == 0
    none = spark.createDataFrame([(None,), ("",), ("a",)], "text string")
    assert [(r["n_words"], r["runs"], r["collapsed"]) for r in periodic.runs(none).collect()] == [(0, [], ""), (0, [], ""), (1, [], "a")]


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapse(words, runs))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    checked = [r for r in rows if len(r["text"] or "") < 12_000]
    assert len(checked) > 100 and sum(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in checked) > 5
    for r in checked:
        assert got[r["doc_id"]] == contract(r["doc_id"], r["text"])
