"""Operators over documents against brute force in plain Python, on texts with every irregularity."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from creatorlake.llm import decontaminate, language_id, packing, quality, resharding, secret_scans, simhash, suffixes
from creatorlake.llm.common import components, slices
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (100, 200), (300, 301), (301, 301)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {**{i: 0 for i in [*range(1, 41), 100, 200]}, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = np.zeros(64, int)
    for x in shingles:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        votes += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(fps, radius):
    nodes = sorted(set(fps))
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in nodes:
        for y in nodes:
            if bin(x ^ y).count("1") <= radius:
                a, b = sorted((top(x), top(y)))
                root[b] = a
    return {x: top(x) for x in nodes}


def test_simhash(documents, nothing):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in documents.collect()]
    root = groups([f for _, f in rows], 3)
    least = {}
    for i, f in rows:
        least.setdefault(root[f], [])
        least[root[f]] += [i] if i is not None else []
    want = collections.Counter((i, f, min(least[root[f]], default=None)) for i, f in rows)
    got = simhash.near_duplicates(documents, words=3, radius=3).collect()
    assert collections.Counter((r[0], r[1] % (1 << 64), r[2]) for r in got) == want
    kept = simhash.keep_one(documents, words=3, radius=3)
    assert kept.columns == documents.columns
    assert sorted(root[fingerprint(r["text"])] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.near_duplicates(nothing, 3, 3).count() == 0


@pytest.mark.parametrize("tile", [4096, 8])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ (1 << int(rng.integers(60))) ^ (1 << int(rng.integers(60))) for _ in range(150)}
    fps |= {int(x) for x in rng.integers(1 << 62, size=100)} | {0, 1, (1 << 62) - 1}
    found = components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fingerprint long"), 3, tile))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {x: y for x, y in groups(fps, 3).items() if x != y}


def test_language_id(documents, nothing):
    model = language_id.fit(documents)
    got = language_id.predict(documents, model)
    assert set(documents.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == documents.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    right = [r["lang_pred"] == r["lang"] for r in rows if r["text"] and len(r["text"]) > 100 and r["lang"]]
    assert np.mean(right) > 0.98
    assert language_id.predict(nothing, model).count() == 0
    unlearnt = language_id.predict(documents, language_id.fit(nothing))
    assert {r[0] for r in unlearnt.select("lang_pred").distinct().collect()} == {"und"}


@pytest.mark.parametrize("limit", [10, 100, 997, 10_000])
def test_cuts_inside_texts_change_no_code_length(limit):
    rng = np.random.default_rng(0)
    sizes = (0, 5, 1000, 7, 50_000, 1, 3000)
    data = np.frombuffer(b"".join(b"   " + bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in sizes), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([n + 3 for n in sizes])])
    grams = rng.integers(97, 103, (4, 4000))
    model = language_id.build(["a", "b"], np.array([0, 1] * 2000), (grams[0] << 24) | (grams[1] << 16) | (grams[2] << 8) | grams[3],
                              rng.integers(1, 9, 4000))
    bits, longest = np.zeros((len(sizes), 2)), 0
    for first, last, at in slices(offsets, language_id.ORDER, limit):
        bits[first:last] += language_id.code_lengths(model, data[at[0] : at[-1]], at - at[0])
        longest = max(longest, at[-1] - at[0])
    assert np.allclose(bits, language_id.code_lengths(model, data, offsets)) and longest <= limit + language_id.ORDER


def test_code_lengths_are_exact():
    """Against the definition, byte by byte: longest context first, escapes to shorter ones."""
    texts = [("aa", b"abracadabra abra"), ("bb", b"bananas and bandanas")]
    grams = collections.Counter()
    for lang, t in texts:
        s = b"   " + t
        grams.update((lang, s[i : i + 4]) for i in range(len(s) - 3))
    lang = np.array([["aa", "bb"].index(k[0]) for k in grams])
    model = language_id.build(["aa", "bb"], lang, np.array([int.from_bytes(k[1], "big") for k in grams]), np.array(list(grams.values())))

    def prob(name, context, symbol):
        seen = collections.Counter()
        for (g, gram), n in grams.items():
            if g == name and gram[3 - len(context) : 3] == context:
                seen[gram[3:]] += n
        shorter = prob(name, context[1:], symbol) if context else 1 / 256
        if not seen:
            return shorter
        total = sum(seen.values()) + len(seen)
        return seen[symbol] / total if symbol in seen else len(seen) / total * shorter

    for text in (b"abandon", b"zebra", b"a", b""):
        s = b"   " + text
        bits = language_id.code_lengths(model, np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0]
        want = [-sum(np.log2(prob(g, s[i - 3 : i], s[i : i + 1])) for i in range(3, len(s))) for g in ("aa", "bb")]
        assert bits == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_decontamination(spark, documents, nothing, monkeypatch):
    rows = documents.collect()
    long = next(r["text"] for r in rows if r["doc_id"] == 91)
    bench = [(1, long[40:400]), (2, "no id here"), (3, None), (4, "?"), (None, rows[5]["text"]), (5, "ab"), (5, "Ab"), (6, "word word word"),
             (7, " ".join(WORD.findall(long)[3:6])), (8, " ".join(WORD.findall(long)[30:33]))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall(lowered(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = collections.Counter()
    for r in rows:
        w, hit, items = WORD.findall(lowered(r["text"])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want[(r["doc_id"], len(w), len(hit), tuple(sorted(x for x in items if x is not None)))] += 1
    for limit, block in ((decontaminate.BROADCAST_WINDOWS, decontaminate.BLOCK), (0, decontaminate.BLOCK), (decontaminate.BROADCAST_WINDOWS, 7), (0, 3)):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        found = decontaminate.contamination(documents, benchmark).collect()
        got = collections.Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(sorted(r["items"]))) for r in found)
        assert got == want
    clean = decontaminate.clean(documents, benchmark)
    assert clean.columns == documents.columns
    assert clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert decontaminate.clean(documents, benchmark.limit(0)).count() == len(rows)


def secret_spans(text):
    rules = [("assign", r"(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")), 1, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return [(rules[k][0], s, e) for s, k, e in sorted(found)]


def test_secrets(spark, documents, nothing):
    many = " ".join("0123456789abcdef%x secret=%s" % (k, "é" if k % 3 else "z" * 12) for k in range(700))
    extra = [(4, many), (1, "é😀 token='" + "x" * 11 + "' secret=" + "y" * 12 + " AKIAAKIA" + "Z" * 9), (2, "passwd:a token: secret: 'abcdefghijklmn'"), (3, "f" * 15 + " " + "0a" * 9 + "g")]
    docs = documents.select("doc_id", "text", F.lit("clash").alias("spans")).union(
        spark.createDataFrame([(*r, "clash") for r in extra], "doc_id long, text string, spans string"))
    path = secret_scans.new_ledger_path(spark)
    ledger = secret_scans.update_ledger(docs, path, first=True)
    found = secret_scans.find(docs, ledger)
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [(secret_scans.RULES[s["kind"]][0], s["start"], s["end"]) for s in r["spans"]] == secret_spans(r["text"])
    # A second pass scans only what is new.
    before = ledger.count()
    again = spark.createDataFrame([(9, "password=newnewnewnew1"), (10, extra[2][1])], "doc_id long, text string")
    assert secret_scans.update_ledger(again, path).count() == before + 1
    for r in secret_scans.redact(found).collect():
        assert not r["spans"] or "[secret]" in r["text"]
        assert secret_spans(r["text"]) == [] or r["doc_id"] == 2
    empty = secret_scans.update_ledger(nothing, secret_scans.new_ledger_path(spark), first=True)
    assert empty.count() == 0 and secret_scans.find(nothing, empty).count() == 0


def test_packing(documents, nothing):
    from tokenizers import Tokenizer

    docs = documents.collect()
    ids = {}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for r in docs:
        ids.setdefault(r["doc_id"], []).append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    tokenized = packing.tokens(documents, TOKENIZER, keep_ids=True)
    planned = packing.plan(tokenized.drop("ids"), group_documents=40)
    pieces, held = planned.collect(), {r[0]: np.frombuffer(r[1], "<u4") for r in packing.materialise(tokenized, planned).collect()}
    total, filled = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        total[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
        piece = held[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
        assert zlib.crc32(piece.astype("<u4").tobytes()) == p["ids_crc32"]
        assert any(x[p["start"] : p["start"] + p["length"]] == piece.tolist() and len(x) == p["doc_tokens"] for x in ids[p["doc_id"]])
    assert total == {k: sum(map(len, v)) for k, v in ids.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.plan(packing.tokens(nothing, TOKENIZER)).count() == 0


@pytest.mark.parametrize("text", ["", "Große STRASSE, it's we'll 12 3!!", "İı Σς ΑΣ é <|endoftext|>x", "a\x1cb  c\x85d e　x", "don’t — “quote”"])
def test_encoder_is_exact(text):
    encoder = packing.Encoder(TOKENIZER)
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 200).tolist()
    bins, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((i for i, x in enumerate(bins) if x + sizes[k] <= 100), len(bins))
        bins += [0] * (b == len(bins))
        want[k] = (b, bins[b])
        bins[b] += sizes[k]
    assert packing.first_fit_decreasing(sizes, 100) == [want[k] for k in range(len(sizes))]
    assert packing.first_fit_decreasing([], 100) == []


def test_resharding(spark, documents, nothing, tmp_path):
    rows = resharding.sized(documents, 3)
    planned = resharding.reshard(rows, [1.0] * 5)
    got = planned.collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    biggest = max(r["size"] for r in got)
    others = [v for k, v in held.items() if v < biggest]
    # Level to within the size from which documents are placed one by one, twice: above and below.
    assert len(others) == 4 and max(others) - min(others) < 2 * sum(held.values()) / 5 / resharding.GRAIN
    path = str(tmp_path / "shards")
    docs = documents.select("doc_id", "text")
    touched = resharding.rewrite(docs, planned, path)
    back = spark.read.parquet(path)
    assert sorted(touched) == sorted({x for r in got if r["old_shard"] != r["shard"] for x in (r["old_shard"], r["shard"])} & set(held))
    assert back.count() == sum(len(slots[k]) for k in touched)
    empty = resharding.reshard(resharding.sized(nothing, 3), [1.0] * 5)
    assert empty.count() == 0 and resharding.rewrite(nothing.select("doc_id", "text"), empty, str(tmp_path / "none")) == []


def test_rewriting_back_and_forth(spark, documents, tmp_path, monkeypatch):
    """Text ids; many stretches a shard; more shards, then fewer, then a plan that moves nothing: files always hold the plan."""
    monkeypatch.setattr(resharding, "BUCKET_ROWS", 7)
    docs = documents.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text")
    want = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    path = str(tmp_path / "shards")
    total = sum(len((t or "").encode()) + 16 for (_, t), n in want.items() for _ in range(n))

    def planned_and_written(source, shards):
        planned = resharding.stage(resharding.reshard(source, [1.0] * shards), "plan")
        files = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard=*/*.parquet")}
        texts = docs if not files else resharding.layout(spark, path)
        touched = resharding.rewrite(texts.select("doc_id", "text"), planned, path)
        kept = {p for p in files if int(p.parent.name[6:]) not in touched and p.parent.exists()}
        assert all(p.exists() and p.stat().st_mtime_ns == files[p] for p in kept)
        rows = resharding.layout(spark, path).collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == want
        assert collections.Counter((r["doc_id"], r["shard"], r["slot"], zlib.crc32((r["text"] or "").encode())) for r in rows) == \
            collections.Counter((r["doc_id"], r["shard"], r["slot"], r["text_crc32"]) for r in planned.collect())
        return touched, planned

    def from_layout():
        return resharding.sized(resharding.layout(spark, path))

    planned_and_written(resharding.sized(docs, 3), 5)
    again, planned = planned_and_written(from_layout(), 5)
    moved = planned.where("old_shard <> shard").agg({"size": "sum"}).first()[0] or 0
    assert moved < 2 * 5 * total / 5 / resharding.GRAIN
    planned_and_written(from_layout(), 2)
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {"shard=0", "shard=1"}


def test_min_cost_flow_moves_least():
    flow = resharding.min_cost_flow([50, 10, 30], [20, 30, 25, 15], lambda i, j: 0 if i == j else 1)
    assert sum(x for (i, j), x in flow.items() if i != j) == 30 + 5
    assert [round(sum(x for (i, _), x in flow.items() if i == k)) for k in range(3)] == [50, 10, 30]
    far = resharding.min_cost_flow([10, 10], [10, 10], lambda i, j: [[1, 2], [1, 5]][i][j])
    assert far == {(0, 1): 10, (1, 0): 10}


def test_repeated_passages(documents, nothing):
    rows = documents.collect()
    seen, words = collections.Counter(), {}
    for k, r in enumerate(rows):
        words[k] = WORD.findall(lowered(r["text"]))
        seen.update(tuple(words[k][i : i + 50]) for i in range(len(words[k]) - 49))
    want = collections.Counter()
    for k, r in enumerate(rows):
        spans = []
        for i in range(len(words[k]) - 49):
            if seen[tuple(words[k][i : i + 50])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        if spans:
            want[(r["doc_id"], len(words[k]), str(spans))] += 1
    got = suffixes.repeated_passages(documents).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], str([list(s) for s in r["spans"]])) for r in got) == want
    for r in got:
        inside = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert {i for s in r["removable"] for i in range(s["start"], s["end"])} <= inside
    assert not next(r for r in got if r["doc_id"] == 90)["removable"] and next(r for r in got if r["doc_id"] == 91)["removable"]
    assert suffixes.repeated_passages(nothing).count() == 0


def test_quality(spark, documents, nothing):
    bad = spark.createDataFrame([(1000 + k, "buy!! %$# | " * (k + 3)) for k in range(40)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(bad)
    labels = docs.where("text <> ''").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("label"))
    model = quality.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, label int")))
    rows = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == 0 for r in rows if (r["doc_id"] or 0) >= 1000]) > 0.95
    assert np.mean([r["predicted"] == 1 for r in rows if r["text"] and (r["doc_id"] or 0) < 90]) > 0.9
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


def test_every_labelled_row_teaches(spark):
    """More rows than one cell, and than the former sample of 8000; the share that passes is that labelled 1, counted over all."""
    docs = spark.range(8300).selectExpr("id AS doc_id", "concat_ws(' ', if(id % 3 = 0, 'buy!! %$#', 'a calm sentence'), id * 7919, 'and more') AS text")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("label"))
    model = quality.fit(docs, labels)
    assert model.taught == 8300
    passed = quality.score(docs, model).groupBy(F.col("doc_id") % 3 == 0).agg(F.sum("predicted").alias("n")).collect()
    assert {r[0]: r[1] for r in passed} == {True: 0, False: labels.where("label = 1").count()}


def test_order_statistics_are_exact(spark):
    held = [3.5, -1.0, 3.5, 3.5, 0.0, 1e-9, 2e-9, 1e6, -1e6, 3.5]
    values = spark.createDataFrame([(v,) for v in held], "v double")
    assert [quality.order_statistic(values, k, 3) for k in range(len(held))] == sorted(held)


def test_stretches_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["It's  a\x0btest,\tisn't it?\x0c", "a\n\nb c-d 12x3 \x1b é'll", "", "  ", "the same the same words over and over again, over"] * 2:
        assert encoder(text) == encoder.encode(text).tobytes()


def test_words_of_any_script_are_encoded_once():
    encoder, seen = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    whole = encoder.encode
    encoder.encode = lambda text: (seen.append(text), whole(text))[1]
    for k in range(20):
        text = f"“quote” — don’t {k}x Слово слово <|endoftext|>y"
        assert encoder(text) == whole(text).tobytes()
    assert sorted(seen) == sorted({"“quote”", "—", "don’t", "Слово", "слово", "<|endoftext|>y"})


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_columns_give_the_ids_of_whole_texts(monkeypatch, kind):
    monkeypatch.setattr(packing, "CHUNK", 64)
    parts = ["a", "It's", "H\u0331", "E\u0301", "\u0301", "ΑΣ", "İ", "ß", "ÿ", "Å", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\x00",
             "'s", "’s", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", "12", "٣", "的", "\u1100\u1161", "😀", "...", "-"]
    rng = np.random.default_rng(7)
    texts = [None, "", " "] + ["".join(rng.choice(parts, n)) for n in rng.integers(0, 25, 300)] + ["x " * 100, None]
    encoder = packing.Encoder(TOKENIZER)
    want = [encoder.encode(t or "").tobytes() for t in texts]
    assert list(encoder.column(pa.array(texts, kind))) == want
    assert list(encoder.column(pa.array([None, "\n"], kind))) == [b"", b""] and list(encoder.column(pa.array([], kind))) == []


def test_many_new_words_are_encoded_in_parts(monkeypatch):
    """What a worker holds while it learns, and keeps from Arrow afterwards, is bounded whatever a text holds."""
    words = [f"w{k:05d}" for k in range(50_000)]
    encoder, asked, released = packing.Encoder(TOKENIZER), [], []
    merges, pool = encoder.merges, pa.default_memory_pool()

    class Asked:
        def encode_batch_fast(self, texts, **how):
            asked.append(max(len(t.split()) for t in texts))
            return merges.encode_batch_fast(texts, **how)

    class Pool:
        def release_unused(self):
            released.append(1)
            pool.release_unused()

    encoder.merges = Asked()
    monkeypatch.setattr(packing.pa, "default_memory_pool", Pool)
    text = " ".join(f"{w[0]}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k, w in enumerate(words))
    assert encoder(text) == encoder.encode(text).tobytes()
    assert sum(asked) == 50_000 and max(asked) <= 1 << 14 and released


def test_ranking_orders_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    label = (x @ [2.0, -1.0, 0.0] + 0.1 * rng.normal(size=400) > 0).astype(int)
    w = quality.rank(x, label)
    assert w[0] > 0 > w[1] and abs(w[2]) < w[0] / 5


def test_digests_of_nothing(spark, sf_dir):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
