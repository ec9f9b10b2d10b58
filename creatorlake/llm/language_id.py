"""Language ID by prediction by partial matching: exact code lengths under frozen context statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import slices, utf8

ORDER = 3
PAD = " " * ORDER
#: Documents learnt from per language: the bound of the fit. They are those with the smallest hashed ids.
DOCS_PER_LANGUAGE = 400


def _fold() -> np.ndarray:
    """Bytes as contexts see them: one letter case, one digit, one white space."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[48:58] = 48
    to[[9, 10, 11, 12, 13]] = 32
    return to


@dataclass
class Model:
    """``rows`` maps three symbols to the longest context with statistics, ``bits`` a context, a symbol and
    a language to the length of the symbol's code there, escapes to shorter contexts included."""

    languages: list[str]
    symbols: np.ndarray
    rows: np.ndarray
    bits: np.ndarray


def ngram_counts(docs: DataFrame) -> DataFrame:
    """Counts of every 4 folded bytes (a context of three and its symbol) per language: (lang, gram, n)."""
    fold = _fold()

    def count(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, last, at in slices(offsets, ORDER):
                for lang in sorted(set(langs[first:last])):
                    grams = []
                    for row in np.flatnonzero(langs[first:last] == lang):
                        s = fold[data[at[row] : at[row + 1]]].astype(np.int64)
                        grams.append((s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:])
                    gram, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram, "n": n})

    texts = docs.select("lang", F.concat(F.lit(PAD), F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Code lengths from counts. A context codes a symbol it has seen with n / (total + kinds) and escapes
    with kinds / (total + kinds) to the context one symbol shorter; below the empty one all bytes are alike."""
    parts = np.stack([(gram >> s) & 255 for s in (24, 16, 8, 0)])
    used = np.unique(parts)
    symbols = np.zeros(256, np.int64)
    symbols[used] = np.arange(1, len(used) + 1)
    m, width = len(used) + 1, len(languages)
    a, b, c, s = symbols[parts]
    where, blocks, first = np.zeros(m**ORDER, np.int32), [], 0
    prob, below = np.full((1, m, width), 1 / 256, np.float32), np.zeros(1, np.int64)
    for length, context in enumerate((np.zeros_like(a), c, b * m + c, (a * m + b) * m + c)):
        seen, row = np.unique(context, return_inverse=True)
        counts = np.zeros((len(seen), m, width), np.float32)
        np.add.at(counts, (row, s, lang), n.astype(np.float32))
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True, dtype=np.float32)
        prob = prob[np.searchsorted(below, seen % m ** max(0, length - 1))]
        prob *= np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
        counts /= np.maximum(total + kinds, 1)
        np.copyto(prob, counts, where=counts > 0)
        where.reshape(-1, m**length)[:, seen] = first + np.arange(len(seen), dtype=np.int32)
        blocks.append(-np.log2(prob))
        first, below = first + len(seen), seen
    return Model(languages, symbols, where, np.concatenate(blocks).reshape(-1, width))


def fit(docs: DataFrame, doc_id: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from the whole texts of ``docs_per_language`` documents of each non-null ``lang``. An id that several rows of
    a language share teaches the least of their texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(doc_id).isNotNull())
    chosen = known.join(F.broadcast(_chosen(known, doc_id, docs_per_language)), [doc_id, "lang"])
    found = ngram_counts(chosen.groupBy(doc_id, "lang").agg(F.min("text").alias("text"))).toPandas()
    languages = sorted(set(found["lang"]))
    if not languages:
        return Model([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    lang = np.searchsorted(languages, found["lang"])
    return build(languages, lang, found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def _chosen(known: DataFrame, doc_id: str, per_language: int) -> DataFrame:
    """The ids with the smallest hashes of each language, as many as the bound. Only ids below a share of all hashes leave
    their task: some four times the bound. Where repeated ids leave too few, the share grows."""
    share = F.xxhash64(doc_id) / float(1 << 64) + 0.5
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    wanted, found, times = dict(counts), [], 4
    while wanted:
        below = F.create_map(*[F.lit(x) for lang, n in wanted.items() for x in (lang, min(1.0, times * per_language / n))])
        rows = known.where(share < F.try_element_at(below, F.col("lang")))
        got: dict = {}
        for lang, one, _ in sorted(rows.select("lang", doc_id, share).distinct().collect(), key=lambda r: (r[2], str(r[1]))):
            got.setdefault(lang, []).append(one)
        for lang in [k for k, n in wanted.items() if len(got.get(k, [])) >= per_language or times * per_language >= n]:
            found += [(one, lang) for one in got.get(lang, [])[:per_language]]
            del wanted[lang]
        times *= 8
    return known.sparkSession.createDataFrame(found, known.select(doc_id, "lang").schema)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row under each language; every row begins with ORDER pad bytes, which cost nothing."""
    s = model.symbols[data].astype(np.int32)
    m = round(len(model.rows) ** (1 / ORDER))
    context = (s[:-3] * m + s[1:-2]) * m + s[2:-1]
    at = model.rows[context].astype(np.int64) * m + s[3:]
    out = np.empty((len(offsets) - 1, len(model.languages)))
    for k in range(len(model.languages)):
        bits = np.concatenate([np.zeros(ORDER, np.float32), model.bits[at, k]])
        for j in range(ORDER):
            bits[offsets[:-1] + j] = 0
        out[:, k] = np.add.reduceat(bits, offsets[:-1], dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``, which replace columns of those names.

    The prediction is the language with the shortest code, ties by name; ``score`` is its share of
    2^-bits. Texts that are null or have no letter are ``und`` with score 0 and null bits, and so is
    everything if nothing was learnt. Repeated rows stay repeated. Rows keep their place: no shuffle."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.symbols, model.rows, model.bits))
    fold = _fold()

    @F.arrow_udf("struct<lang_pred: string, score: double, bits: double>")
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*held.value)
        names = pa.array(model.languages)
        for column in columns:
            data, offsets = utf8(column)
            bits = np.zeros((len(column), len(model.languages)))
            # Each cut begins with the bytes before it, which cost nothing there.
            for first, last, at in slices(offsets, ORDER):
                bits[first:last] += code_lengths(model, fold[data[at[0] : at[-1]]], at - at[0])
            least = bits.min(1)
            score, rate = 1 / np.exp2(least[:, None] - bits).sum(1), least / np.maximum(np.diff(offsets) - ORDER, 1)
            cells = [names.take(pa.array(bits.argmin(1))), pa.array(score), pa.array(rate)]
            yield pa.StructArray.from_arrays(cells, ["lang_pred", "score", "bits"])

    padded = F.concat(F.lit(PAD), F.coalesce("text", F.lit("")))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "bits_per_byte")]
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)])
    found = docs.select(row.alias("row"), letter.alias("lettered"), label(padded).alias("found"))
    found = found.select("row", F.when(F.col("lettered"), F.col("found")).otherwise(unknown).alias("found"))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "found.lang_pred", "found.score",
                        F.col("found.bits").alias("bits_per_byte"))
