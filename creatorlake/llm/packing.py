"""Packing of token pieces into sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creatorlake.session import stage

LENGTH = 2048
END = 1
#: Documents packed together on average: enough to fill sequences, few enough for one task.
GROUP_DOCUMENTS = 8192
#: Distinct words whose ids a task remembers, and the most characters of one.
CACHE_WORDS, CACHE_CHARACTERS = 400_000, 64
#: Bytes of text encoded at once (a longer text is alone).
CHUNK = 1 << 22
#: New words encoded at once: the tokenizer describes each id at length.
LEARN_WORDS = 1 << 14
#: Not ASCII (or one of the separators \x1c to \x1f, on which libraries differ), not a Latin-1 letter, or what may begin a
#: special token. In stretches between blanks that hold none, lower case and composed forms are one character for one, and
#: words split as below. Other stretches are encoded whole, as they stand.
NOT_PLAIN = "[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ÿ]|<\\|"
#: How this vocabulary cuts lower-case stretches into words, stated for those characters (fixed values).
WORD = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
WORD_END = "</w>"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes. Merges never cross words, and neither words nor composed characters
    nor special tokens cross blanks, so a text's ids are those of its words one after another, and a word met before need
    not be encoded again. Arrow cuts a column's texts into stretches between blanks, distinct stretches into words, and puts
    the ids together; Python sees distinct words alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges with nothing before them, for words cut and in lower case already, parted by blanks.
        self.merges = Tokenizer(self.tokenizer.model)
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), by_byte])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> list[bytes]:
        return [ids for k in range(0, len(words), LEARN_WORDS) for ids in self.learn_together(words[k : k + LEARN_WORDS])]

    def learn_together(self, words: list[str]) -> list[bytes]:
        """Encode words as one text; the ids that end a word tell them apart."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        held = ids.tobytes()
        if len(stop) == len(words):
            return [held[a:b] for a, b in zip([0, *stop], stop)]
        return [self.encode(w).tobytes() for w in words]

    def __call__(self, text: str) -> bytes:
        return next(self.column(pa.array([text], pa.string())))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column; a null has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        chunk = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // CHUNK
        stops = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
        for a, b in zip(stops, stops[1:]):
            held = self.chunk(texts.slice(a, b - a))
            pa.default_memory_pool().release_unused()
            yield from (ids.as_py() for ids in held)

    def chunk(self, texts: pa.Array) -> pa.Array:
        texts = pc.if_else(pc.match_substring_regex(texts, NOT_PLAIN), texts, pc.utf8_lower(texts))
        texts = pc.ascii_split_whitespace(texts)
        stretches = texts.values.dictionary_encode()
        cut = stretches.dictionary
        cut = pc.if_else(pc.match_substring_regex(cut, NOT_PLAIN), cut, pc.replace_substring_regex(pc.utf8_lower(cut), WORD, r"\1 "))
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(cut))
        words = cut.values.dictionary_encode()
        ids = pa.array(self.look_up(words.dictionary), pa.large_binary())
        return joined(joined(ids.take(words.indices), cut.offsets).take(stretches.indices), texts.offsets)

    def look_up(self, distinct: pa.Array) -> list[bytes]:
        """The ids of distinct words, and of stretches encoded whole."""
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        found = [self.known.get(w) for w in words]
        new = [k for k, ids in enumerate(found) if ids is None]
        whole = pc.match_substring_regex(distinct, NOT_PLAIN).to_numpy(zero_copy_only=False)
        plain = [k for k in new if not whole[k]]
        for k, ids in zip(plain, self.learn([words[k] for k in plain])):
            found[k] = ids
        for k in new:
            if whole[k]:
                found[k] = self.encode(words[k]).tobytes()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self.known.update((words[k], found[k]) for k in new if len(words[k]) <= CACHE_CHARACTERS)
        return found


def joined(values: pa.Array, offsets: pa.Array) -> pa.Array:
    """One binary value for the values between two offsets each."""
    _, places, held = values.buffers()
    places = np.frombuffer(places, np.int64)[values.offset :] if len(values) else np.zeros(1, np.int64)
    stops = places[offsets.to_numpy()]
    return pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops), held or pa.py_buffer(b"")])


def tokens(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, doc_tokens (ids of the text, then id 1), crcs (of each piece of
    ``length`` ids and of the rest) and, on request, ids. A null text is an empty one."""

    @F.arrow_udf("struct<doc_tokens: long, crcs: array<long>, ids: binary>")
    def encoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tokenizer_path)
        end = END.to_bytes(4, "little")
        for column in columns:
            count, crcs, ids = [], [], []
            for text_ids in encoder.column(column):
                held = text_ids + end
                count.append(len(held) // 4)
                crcs.append([zlib.crc32(held[k : k + 4 * length]) for k in range(0, len(held), 4 * length)])
                ids.append(held if keep_ids else None)
            yield pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                                              pa.array(ids, pa.binary())], ["doc_tokens", "crcs", "ids"])
        # Spark keeps the worker for later stages, which need the memory themselves.
        encoder = column = None
        pa.default_memory_pool().release_unused()

    found = docs.select("doc_id", encoded(F.col("text")).alias("found"))
    return found.select("doc_id", "found.doc_tokens", "found.crcs", *(["found.ids"] if keep_ids else []))


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, largest first, each into the first bin that has room.

    A tournament tree holds the most room below each node; the leftmost bin with room is found from the root."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        node, size = 1, sizes[k]
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        placed[k] = (node - leaves, capacity - room[node])
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return placed


def plan(tokenized: DataFrame, length: int = LENGTH, group_documents: int = GROUP_DOCUMENTS, seed: int = 0) -> DataFrame:
    """Pieces with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut into pieces of ``length`` ids, each a sequence of its own, and a rest; the rests of a
    random group of documents share sequences. Groups come from a hash of the row and of its number
    among equal rows, so they stay even whatever repeats; each is packed by one task from a few numbers a
    document. The group count follows the row count. An empty table gives no rows."""
    rows = tokenized.groupBy("doc_id", "doc_tokens", "crcs").agg(F.count("*").alias("copies"))
    rows = stage(rows, "tokenized")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    groups = max(1, round(total / group_documents))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "crcs", "copy", F.lit(seed)), F.lit(groups)))
    narrow = rows.select("group", "doc_id", "doc_tokens", "crcs", "copy")

    def pack(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([(k, "ascending") for k in ("doc_id", "doc_tokens", "copy")])
        count = frame["doc_tokens"].to_numpy()
        rest, whole = count % length, count // length
        some = np.flatnonzero(rest)
        placed = first_fit_decreasing(rest[some].tolist(), length)
        place = np.zeros((len(count), 2), np.int64)
        place[some] = np.array(placed, np.int64).reshape(-1, 2)
        used = 1 + max((b for b, _ in placed), default=-1)
        for name, values in (("bin", place[:, 0]), ("at", place[:, 1]), ("first_whole", used + np.cumsum(whole) - whole)):
            frame = frame.append_column(name, pa.array(values))
        return frame

    schema = "group long, doc_id long, doc_tokens long, crcs array<long>, copy long, bin long, at long, first_whole long"
    packed = narrow.groupBy("group").applyInArrow(pack, schema)
    pieces = packed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * length
    size = F.least(F.lit(length), F.col("doc_tokens") - start)
    bin_ = F.when(size == length, F.col("first_whole") + F.col("piece")).otherwise(F.col("bin"))
    return pieces.select("doc_id", start.alias("start"), size.alias("length"), "ids_crc32", "doc_tokens",
                         (bin_ * groups + F.col("group")).alias("sequence_id"),
                         F.when(size == length, F.lit(0).cast("long")).otherwise(F.col("at")).alias("offset"))


def materialise(tokenized: DataFrame, planned: DataFrame, length: int = LENGTH) -> DataFrame:
    """The ids of every sequence: (sequence_id, ids as an array), from ``tokens(..., keep_ids=True)`` and the plan.
    Equal pieces of equal ids are interchangeable, and are paired by number."""
    cut = tokenized.select("doc_id", "ids", F.posexplode("crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * length
    cut = cut.select("doc_id", start.alias("start"), "ids_crc32",
                     F.substring("ids", (start * 4 + 1).cast("int"), F.lit(4 * length)).alias("ids"))
    same = Window.partitionBy("doc_id", "start", "ids_crc32")
    cut = cut.withColumn("number", F.row_number().over(same.orderBy("ids")))
    planned = planned.withColumn("number", F.row_number().over(same.orderBy("sequence_id", "offset")))
    keys = [cut[k].eqNullSafe(planned[k]) for k in ("doc_id", "start", "ids_crc32", "number")]
    joined = planned.join(cut, keys[0] & keys[1] & keys[2] & keys[3]).select("sequence_id", "offset", "ids")
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", whole.alias("ids"))
