"""Token ids as a compact binary table: a static range asymmetric numeral system.

The format is a folder of two Parquet tables. ``table`` has (token, freq): one frequency table for all blocks,
its sum 2^20, every occurring token at least 1. ``blocks`` has a row per block of whole documents, about 2^18 ids:

    part, block   place in the order of all ids: parts by number, blocks by number
    first, n      ids of the part before the block, ids of the block
    docs          (id, n) of its documents in order
    lanes         number of interleaved coder states; id i belongs to lane i mod lanes
    payload       little-endian: 64-bit states of all lanes, then the 32-bit words in the order of reading
    marks         checkpoints (step, words read before it, states): decoding can start at any of them
    crc           crc32 of the block's ids as little-endian unsigned 32-bit integers

Blocks are independent of each other, checkpoints are places inside them where further workers can start, and
checksums are checked on reading. Parquet's own commit makes a repeated task harmless.

A state x lies in [2^31, 2^63). To encode a token of frequency f from c on, x loses its low word if
x >= f * 2^43, then becomes (x div f) * 2^20 + x mod f + c; decoding does the reverse. Lanes are numpy arrays.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, new_folder, short_batches
from .common import give_back

BITS, LOW = 20, np.uint64(1 << 31)
BLOCK, LANES, MARK = 1 << 18, 1024, 128
END = 2
# Words whose ids a worker remembers (some 40 bytes each), and other pieces; then it starts anew.
REMEMBERED, REMEMBERED_ODD = 1_500_000, 50_000

# Blanks next to other blanks, and blanks between two other characters.
TOUCHING, BETWEEN = re.compile(r" (?:(?=\s)|(?<=\s ))"), re.compile(r"(?<=\S) (?=\S)")
# The same in the library's own dialect: a blank next to a blank or at an end.
TOUCHES = r"^ | $| [\s\x0B\x1C-\x1F\x{85}\p{Z}]|[\s\x0B\x1C-\x1F\x{85}\p{Z}] "
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
# A piece that is one usual word and marks behind it: two words of byte-level BPE.
WORD_AND_MARKS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
# Bytes of text whose pieces are looked up together.
TOGETHER = 3 << 20
# Usual characters, and how byte-level BPE parts them into words (fixed: the public pattern for these characters).
USUAL = re.compile(r"[\n -~À-ÖØ-öø-ɏ]*")
WORD_OF_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"
)
CODEC = "zstd"

MASK, WORD, SHIFT = np.uint64((1 << BITS) - 1), np.uint64(0xFFFFFFFF), np.uint64(BITS)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^20, at least 1 for every token that occurs."""
    occurs = counts > 0
    kinds = int(occurs.sum())
    if kinds > 1 << BITS:
        raise ValueError(f"{kinds} kinds of tokens, at most {1 << BITS}")
    freq = np.zeros(len(counts), np.int64)
    if kinds:
        share = counts[occurs].astype(np.float64) / counts.sum()
        freq[occurs] = 1 + np.floor(share * ((1 << BITS) - kinds)).astype(np.int64)
        freq[counts.argmax()] += (1 << BITS) - freq.sum()
    return freq


class Coder:
    """Codes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.token = np.repeat(np.arange(len(freq)), freq)

    def encode(self, ids: np.ndarray) -> tuple[int, bytes, list[tuple[int, int, bytes]]]:
        """(lanes, payload, checkpoints)."""
        lanes = int(np.clip(len(ids) // 256, 1, LANES))
        x = np.full(lanes, LOW)
        chunks, marks, written = [], [], 0
        for step in range(-(-len(ids) // lanes) - 1, -1, -1):
            token = ids[step * lanes : (step + 1) * lanes]
            f, c, y = self.freq[token], self.cum[token], x[: len(token)]
            over = y >= f << np.uint64(43)
            words = (y[over] & WORD).astype("<u4")
            chunks.append(words)
            written += len(words)
            y = np.where(over, y >> np.uint64(32), y)
            q = y // f
            x[: len(token)] = (q << SHIFT) + (y - q * f) + c
            if step and step % MARK == 0:
                marks.append((step, written, x.astype("<u8").tobytes()))
        payload = x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(chunks))
        # Words read before a checkpoint: all but those written up to it.
        return lanes, payload, [(s, written - w, states) for s, w, states in reversed(marks)]

    def decode(self, n: int, lanes: int, payload: bytes, marks=(), begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin..end of a block of n, from the last checkpoint before ``begin`` on."""
        end = n if end is None else min(end, n)
        words = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.uint64)
        x, step, at = np.frombuffer(payload, "<u8", lanes).astype(np.uint64), 0, 0
        for mark_step, mark_at, states in marks:
            if mark_step * lanes <= begin:
                step, at, x = mark_step, mark_at, np.frombuffer(states, "<u8").astype(np.uint64)
        first, out = step * lanes, []
        while step * lanes < end:
            live = min(lanes, n - step * lanes)
            y = x[:live]
            slot = y & MASK
            token = self.token[slot.astype(np.int64)]
            out.append(token)
            y = self.freq[token] * (y >> SHIFT) + slot - self.cum[token]
            low = np.flatnonzero(y < LOW)
            y[low] = (y[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
            x[:live] = y
            step += 1
        got = np.concatenate(out) if out else np.empty(0, np.int64)
        return got[begin - first : end - first]


class Words(dict):
    """Ids of a word, by the library's model when it is first asked for."""

    def __init__(self, tokenize, symbols: dict[int, str]):
        super().__init__()
        self.tokenize, self.symbols = tokenize, symbols

    def __missing__(self, word: str) -> bytes:
        found = [t.id for t in self.tokenize(word.translate(self.symbols))]
        self[word] = ids = struct.pack(f"<{len(found)}I", *found)
        return ids


class Pieces(dict):
    """Ids of a piece of text with ``lead`` before it; unusual pieces go to the library as they are."""

    def __init__(self, words: Words, whole, lead: str):
        super().__init__()
        self.words, self.whole, self.lead = words, whole, lead

    def __missing__(self, piece: str) -> bytes:
        text = self.lead + piece
        if USUAL.fullmatch(text):
            words = self.words
            ids = b"".join([words[w] for w in WORD_OF_PIECE.findall(text)])
        else:
            ids = self.whole(text)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, as little-endian 32-bit integers.

    Byte-level BPE reads a text word by word, and no word of it reaches over a single blank between two other
    characters into the word before. Such files get the pieces between these blanks, and each worker remembers
    the ids of recent pieces and words; texts that hold the string of an added token, and other kinds of files,
    go in whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_piece = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout")
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if self.by_piece:
            split = self.library.pre_tokenizer.pre_tokenize_str
            # How the library writes each usual character's bytes.
            usual = (chr(c) for c in range(0x250) if USUAL.fullmatch(chr(c)))
            self.words = Words(self.library.model.tokenize, {ord(c): "".join(w for w, _ in split(c)) for c in usual})
            self.first, self.rest = Pieces(self.words, self.whole, ""), Pieces(self.words, self.whole, " ")
            self.between = self.library.encode("\n", add_special_tokens=False).ids
            # Remembered words (after a blank) and their ids, as arrays: no objects of their own.
            self.names, self.codes = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def codes_of(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces, each after a blank; those without blanks inside are asked for in one text.

        There each has a line of its own, as no word reaches over a line's end.
        """
        odd = pc.or_(pc.match_substring_regex(pieces, BLANK), pc.equal(pieces, ""))
        plain = pieces.filter(pc.invert(odd))
        if len(self.between) == 1 and len(plain):
            # The fast form of the call works out no positions.
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n ")[0].as_py()
            ids = np.array(self.library.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.between[0]), len(ids))
            if len(ends) == len(plain):
                kept = ids[ids != self.between[0]]
                offsets = np.concatenate([[0], 4 * (ends - np.arange(len(ends)))]).astype(np.int64)
                found = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes())])
                rest = pa.array([self.rest[p] for p in pieces.filter(odd).to_pylist()], pa.large_binary())
                place = np.empty(len(pieces), np.int64)
                mask = odd.to_numpy(zero_copy_only=False)
                place[~mask], place[mask] = np.arange(len(plain)), len(plain) + np.arange(len(rest))
                return pa.concat_arrays([found, rest]).take(pa.array(place))
        return pa.array([self.rest[p] for p in pieces.to_pylist()], pa.large_binary())

    def looked_up(self, kinds: pa.Array) -> pa.Array:
        """Ids of different pieces, each after a blank: of their words and marks, or of the piece as a whole."""
        split = pc.extract_regex(kinds, pattern=WORD_AND_MARKS)
        usual = split.is_valid()
        split, others = split.filter(usual), kinds.filter(pc.invert(usual))
        words, marks = split.field("word").dictionary_encode(), split.field("marks").dictionary_encode()
        codes = [self.remembered(words.dictionary), pa.array([self.words[m] for m in marks.dictionary.to_pylist()], pa.large_binary())]
        # Word and marks next to each other are one entry.
        pairs = np.stack([words.indices.to_numpy().astype(np.int64), len(codes[0]) + marks.indices.to_numpy()], axis=1).ravel()
        laid = pa.concat_arrays(codes).take(pa.array(pairs, pa.int64()))
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[::2].copy() if len(laid) else np.zeros(1, np.int64)
        whole = pa.Array.from_buffers(pa.large_binary(), len(split), [None, pa.py_buffer(ends), laid.buffers()[2]])
        mask = usual.to_numpy(zero_copy_only=False)
        place = np.empty(len(kinds), np.int64)
        place[mask], place[~mask] = np.arange(len(split)), len(split) + np.arange(len(others))
        return pa.concat_arrays([whole, self.codes_of(others)]).take(pa.array(place))

    def remembered(self, words: pa.Array) -> pa.Array:
        """Ids of different usual words after a blank, remembered or asked for."""
        # The words of one piece are the table to look into, not all that are remembered: far fewer.
        held = pc.index_in(self.names, value_set=words)
        known = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
        place = np.full(len(words), -1, np.int64)
        place[held.drop_null().to_numpy()] = known
        missing = place < 0
        if not missing.any():
            return self.codes.take(pa.array(place))
        new = words.filter(pa.array(missing))
        ask, symbols, ids, ends = self.words.tokenize, self.words.symbols, [], [0]
        lead = " ".translate(symbols)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new), " ")[0].as_py()
        for word in text.split(" "):
            ids += [t.id for t in ask(lead + (word if word.isascii() else word.translate(symbols)))]
            ends.append(len(ids))
        offsets = 4 * np.array(ends, np.int64)
        asked = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(np.array(ids, "<u4").tobytes())])
        place[missing] = len(self.names) + np.arange(len(new))
        names, codes = pa.concat_arrays([self.names, new]), pa.concat_arrays([self.codes, asked])
        found = codes.take(pa.array(place))
        # Beyond the bound, what this piece of the work needed is what is kept.
        self.names, self.codes = (names, codes) if len(names) <= REMEMBERED else (words, found)
        return found

    def encode_all(self, texts: pa.Array, tail: bytes) -> tuple[bytes, np.ndarray]:
        """(ids of all texts with ``tail`` after each, where each text's bytes end)."""
        if not len(texts):
            return b"", np.zeros(0, np.int64)
        if not self.by_piece:
            found = [self.encode(t) + tail for t in texts.to_pylist()]
            return b"".join(found), np.cumsum([len(x) for x in found])
        odd = pc.match_substring_regex(texts, TOUCHES)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        plain = ~odd.to_numpy(zero_copy_only=False)
        for held in (self.rest, self.words, self.first):
            if len(held) > REMEMBERED_ODD:
                held.clear()
        # Every kind of piece is looked up once; Arrow lays the ids out in the order of the pieces.
        lists = pc.split_pattern(pc.if_else(pa.array(plain), texts, ""), " ")
        starts, ends = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        pieces = lists.flatten()
        kinds = pieces.dictionary_encode()
        known = self.looked_up(kinds.dictionary)
        # A text's first piece has no blank before it; an odd text is one entry.
        first = [
            self.first[p] if ok else self.encode(t.as_py())
            for p, ok, t in zip(pieces.take(pa.array(starts)).to_pylist(), plain.tolist(), texts, strict=True)
        ]
        which = kinds.indices.to_numpy().astype(np.int64)
        which[starts] = len(known) + np.arange(len(texts))
        which = np.insert(which, ends, len(known) + len(first))
        laid = pa.concat_arrays([known, pa.array([*first, tail], pa.large_binary())]).take(pa.array(which))
        offsets = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)
        return laid.buffers()[2].to_pybytes(), offsets[ends + np.arange(1, len(texts) + 1)]

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(a in text for a in self.added):
            return self.whole(text)
        if TOUCHING.search(text) or text[:1] == " " or text[-1:] == " ":
            parts = BETWEEN.split(text)
        else:
            parts = text.split(" ")
        for held in (self.rest, self.words, self.first):
            if len(held) > REMEMBERED_ODD:
                held.clear()
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))


def encoder(tokenizer_file: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    state = sys.modules.setdefault("herdwatch_worker_state", types.ModuleType("herdwatch_worker_state"))
    if not hasattr(state, "encoders"):
        state.encoders = {}
    if tokenizer_file not in state.encoders:
        state.encoders[tokenizer_file] = Encoder(tokenizer_file)
    return state.encoders[tokenizer_file]


def tokenized(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """Rows (id, n, ids): ids with the end id, compressed."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        codec, texts_to_ids = pa.Codec(CODEC, 1), encoder(tokenizer_file).encode_all
        for batch in batches:
            column = batch.column(1)
            ends, start = np.cumsum(pc.binary_length(column).to_numpy()), 0
            while start < len(column):
                base = ends[start - 1] if start else 0
                size = max(1, int(np.searchsorted(ends, base + TOGETHER, "right")) - start)
                data, stops = texts_to_ids(column.slice(start, size), tail)
                begins = np.concatenate([[0], stops[:-1]])
                view = memoryview(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, size), pa.array((stops - begins) // 4, pa.int64()),
                        pa.array([codec.compress(view[a:b], asbytes=True) for a, b in zip(begins, stops, strict=True)], pa.binary()),
                    ],
                    names=["id", "n", "ids"],
                )
                start += size
                # What a piece of the work has freed is not kept for the next one.
                del data, begins, stops, view
                give_back()

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n long, ids binary")


def unpacked(codec: pa.Codec, ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(codec.decompress(ids, 4 * n, asbytes=True), "<u4").astype(np.int64)


def token_counts(tokens: DataFrame) -> DataFrame:
    """Rows (token, n): a sum per task, then over tasks."""

    def run(batches):
        codec, total = pa.Codec(CODEC), np.zeros(1, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = np.bincount(unpacked(codec, ids, n))
                if len(count) > len(total):
                    total = np.pad(total, (0, len(count) - len(total)))
                total[: len(count)] += count
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end: int = END
) -> None:
    """Encodes every text, appends ``end``, and writes the format to ``path`` in ascending order of ids.

    A null text is an empty one (the end id alone). Rows with a null id come first; rows that repeat an id follow
    each other, shorter ones first, equal ones in any order. An empty table writes no block. Other columns
    are not looked at. ``tokenizer_file`` must be readable on the executors.
    """
    spark = docs.sparkSession
    short_batches(spark)
    tokens = materialize(tokenized(docs, tokenizer_file, id_col, text_col, end))
    # One row per kind of token, at most the vocabulary.
    counted = token_counts(tokens).toPandas()
    freq = np.zeros(int(counted["token"].max()) + 1 if len(counted) else 1, np.int64)
    freq[counted["token"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    freq = frequencies(freq)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(t), int(freq[t])) for t in used], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    kind = dict(tokens.dtypes)["id"]
    schema = (
        f"part int, block int, first long, n long, docs array<struct<id:{kind},n:long>>, lanes int, payload binary, "
        "marks array<struct<step:int,at:long,states:binary>>, crc long"
    )

    def run(batches):
        coder, codec = Coder(shared.value), pa.Codec(CODEC)
        part, block, first, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def done():
            ids = np.concatenate(held)
            lanes, payload, marks = coder.encode(ids)
            row = {
                "part": part, "block": block, "first": first, "n": len(ids), "docs": [{"id": i, "n": len(x)} for i, x in zip(names, held, strict=True)],
                "lanes": lanes, "payload": payload, "marks": [{"step": s, "at": a, "states": b} for s, a, b in marks],
                "crc": zlib.crc32(ids.astype("<u4").tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for i, n, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "ids")), strict=True):
                held.append(unpacked(codec, ids, n))
                names.append(i)
                size += n
                if size >= BLOCK:
                    yield done()
                    first, block, held, names, size = first + size, block + 1, [], [], 0
        if held:
            yield done()
        give_back()

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    ordered = tokens.repartitionByRange("id").sortWithinPartitions("id", "n", "ids")
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows (id_col, start, n_tokens, ids_crc32[, ids]) per document, decoded from the files.

    start counts the ids of all documents before, end ids included. A block whose checksum differs raises.
    """
    short_batches(spark)
    table = spark.read.parquet(f"{path}/table").toPandas()
    freq = np.zeros(int(table["token"].max()) + 1 if len(table) else 1, np.int64)
    freq[table["token"].to_numpy(np.int64)] = table["freq"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = dict(blocks.select(F.col("docs")[0]["id"].alias("id")).dtypes)["id"]

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                marks = [(m["step"], m["at"], m["states"]) for m in row["marks"].as_py()]
                ids = coder.decode(row["n"].as_py(), row["lanes"].as_py(), row["payload"].as_buffer().to_pybytes(), marks)
                data = ids.astype("<u4").tobytes()
                if zlib.crc32(data) != row["crc"].as_py():
                    raise ValueError(f"block {row['block']} of part {row['part']}: checksum differs")
                sizes = np.array(row["docs"].values.field("n").to_pylist(), np.int64)
                ends = np.cumsum(sizes)
                data = [data[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out = [
                    row["docs"].values.field("id"), pa.array(np.full(len(sizes), row["part"].as_py()), pa.int32()),
                    pa.array(row["first"].as_py() + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in data], pa.int64()),
                ]
                names = ["id", "part", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids))
                    out, names = [*out, lists], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id {kind}, part int, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = blocks.mapInArrow(run, schema)
    # Ids before each part: one row per part.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    out = docs.join(F.broadcast(parts), F.col("part") == F.col("_p"))
    return out.select(
        F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def round_trip(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes the texts' ids to a new folder below the shared one and reads them back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, id_col, text_col, end)
    return read_tokens(docs.sparkSession, path, id_col)
