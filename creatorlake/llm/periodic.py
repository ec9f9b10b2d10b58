"""Periodic runs of words by seeds on diagonals: equal word stretches a lag apart, extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import chunks, mixed, utf8, word_spans

#: Least length of a run in words, and in periods.
LENGTH, PERIODS = 6, 4
#: Bytes of texts whose words are held at once, one text at least.
CHUNK = 1 << 19
RUN = "struct<start: long, length: long, period: long>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are no white space: start, end, each text's first word, and a number per distinct word."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    starts, ends, first = word_spans(solid, offsets)
    held = pa.BinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(data[solid])])
    return starts, ends, first, held.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _overlap(low: int, length: int, periods: int) -> int:
    """Words that a run has in common with itself one period on, at least, over periods from ``low`` up to 2 * ``low``."""
    turn = length // periods
    return min(max(length, periods * q) - q for q in {low, 2 * low - 1, *(x for x in (turn, turn + 1) if low <= x < 2 * low)})


def _seeds(ids: np.ndarray, first: np.ndarray, length: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of equal word stretches, each with the next place of its text that has the same stretch.

    Lags from 2^j up to 2^(j+1) share an index of stretches as long as the overlap that their runs are sure to have.
    With three periods or more that is no less than the longest lag of the class, so inside a run the next
    equal stretch lies one smallest period on, and no run is missed although each place has one partner only.
    Stretches are named by doubling: a name of 2k words mixes two of k, any length mixes two that overlap."""
    counts = np.diff(first)
    place = np.arange(len(ids))
    row, end = np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts)

    def pair(names: np.ndarray, by: int) -> np.ndarray:
        out = names.copy()
        out[:-by] = mixed(names[:-by] * np.uint64(0xBF58476D1CE4E5B9) + names[by:])
        return out

    power, size = mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), 1
    at, lags, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while max(length, periods * low) <= counts.max(initial=0):
        overlap = _overlap(low, length, periods)
        while 2 * size <= overlap:
            power, size = pair(power, size), 2 * size
        name = pair(power, overlap - size) if overlap > size else power
        held = place[(place + overlap <= end) & np.repeat(counts >= max(length, periods * low), counts)]
        order = held[np.argsort(name[held], kind="stable")]
        lag = np.diff(order)
        ok = (name[order[1:]] == name[order[:-1]]) & (lag >= low) & (lag < 2 * low)
        at.append(order[:-1][ok])
        lags.append(lag[ok])
        low *= 2
    return np.concatenate(at), np.concatenate(lags)


def _same(ids: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """How many words from ``at`` on (or back, for step -1) equal those ``lag`` later, before ``stop``."""
    seen, size = 0, 64
    while True:
        size = min(size, (stop - at) * step - seen)
        if size <= 0:
            return seen
        a = at + step * seen
        part = slice(a, a + size) if step > 0 else slice(a - size + 1, a + 1)
        equal = ids[part] == ids[part.start + lag : part.stop + lag]
        if not equal.all():
            return seen + int(np.argmin(equal if step > 0 else equal[::-1]))
        seen, size = seen + size, size * 2


def find_runs(ids: np.ndarray, first: np.ndarray, length: int = LENGTH, periods: int = PERIODS) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all maximal runs, by text, start and period; starts count from the text's
    first word. Seeds are extended by comparing the words themselves, so equal names alone make no run."""
    at, lags = _seeds(ids, first, length, periods)
    order = np.lexsort((at, lags))
    at, lags = at[order], lags[order]
    # A seed one word after another of its lag lies on the same stretch of the diagonal.
    new = np.ones(len(at), bool)
    new[1:] = (lags[1:] != lags[:-1]) | (at[1:] != at[:-1] + 1)
    covered: dict[int, int] = {}
    out = []
    for i, q in zip(at[new].tolist(), lags[new].tolist()):
        if i < covered.get(q, 0):
            continue
        text = int(np.searchsorted(first, i, "right")) - 1
        low, high = int(first[text]), int(first[text + 1])
        right = _same(ids, i, q, high - q, 1)
        left = _same(ids, i - 1, q, low - 1, -1) if right else 0
        covered[q] = i + max(right, 1)
        if left + right + q >= max(length, periods * q):
            out.append((text, i - left - low, left + right + q, q))
    out.sort(key=lambda r: (r[0], r[1], r[3]))
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    held = data.tobytes()
    return b" ".join([held[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])


def runs(docs: DataFrame, text: Column | str = "text", length: int = LENGTH, periods: int = PERIODS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period in words, by start, then period) and ``collapsed``, the
    text's words without repeats, joined by one space; these replace columns of those names.

    A run is a stretch of words with smallest period q, at least ``length`` words and ``periods`` (three or more)
    periods long, that no neighbouring word extends. A word goes if any run holds it after that run's first
    period. Null and empty texts have no words, no runs and an empty ``collapsed``. Each row is read by itself: nothing
    is shuffled, equal rows come out equal. Work is a sort of a text's words per doubling of the period."""
    if periods < 3 or length < 2:
        raise ValueError("a run needs three periods and two words at least")

    @F.arrow_udf(f"struct<n_words: long, runs: array<{RUN}>, collapsed: string>")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, offsets = utf8(column)
            n_words, counts, found, texts = [], [], [], []
            for a, b in chunks(offsets, CHUNK):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first, ids = words(part, at)
                text_, start, size, period = find_runs(ids, first, length, periods)
                n_words.append(np.diff(first))
                counts.append(np.bincount(text_, minlength=b - a))
                found.append(np.stack([start, size, period]))
                # A word is dropped where more repeats have begun than ended.
                begun = np.zeros(len(ids) + 1, np.int64)
                np.add.at(begun, first[text_] + start + period, 1)
                np.add.at(begun, first[text_] + start + size, -1)
                keep = np.cumsum(begun[:-1]) == 0
                texts += [_collapsed(part[at[k] : at[k + 1]], starts[first[k] : first[k + 1]] - at[k], ends[first[k] : first[k + 1]] - at[k],
                                     keep[first[k] : first[k + 1]]) for k in range(b - a)]
            cells = np.concatenate([np.zeros((3, 0), np.int64), *found], 1)
            ends_ = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
            held = pa.StructArray.from_arrays([pa.array(c) for c in cells], ["start", "length", "period"])
            yield pa.StructArray.from_arrays([
                pa.array(np.concatenate([np.zeros(0, np.int64), *n_words]), pa.int64()), pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), held),
                pa.array(texts, pa.binary()).view(pa.string())], ["n_words", "runs", "collapsed"])

    column = F.col(text) if isinstance(text, str) else text
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]) if kept else F.lit(0)
    found = docs.select(row.alias("row"), of(column.cast("string")).alias("found"))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "found.n_words", "found.runs", "found.collapsed")


def best(found: Column | str = "runs") -> Column:
    """The run with the greatest length over period, ties by start, then period; null if there is none."""
    def better(x, y):
        more, same = y["length"] * x["period"], x["length"] * y["period"]
        wins = (more > same) | ((more == same) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["period"] < x["period"]))))
        return x.isNull() | F.coalesce(wins, F.lit(False))

    return F.aggregate(found, F.lit(None).cast(RUN), lambda x, y: F.when(better(x, y), y).otherwise(x))
