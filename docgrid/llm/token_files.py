"""Operator 7: token ids in Simple-8b files.

Texts are encoded by the tokenizers library as it stands (special tokens' strings in a text give their ids), an end id is
appended, and the ids are written in ascending doc_id order, then read back. Whether texts may be encoded word by word is read from
the tokenizer's file (`by_word`): if neither its normaliser nor its pre-splitting looks across ASCII white space, words of printable ASCII and of the
letters À-ÿ are cut into the pieces that its pattern makes of them, for all of a chunk at once, and each distinct piece of a worker is encoded once; so is
each other word as a whole, by the library. With any other file whole texts go through the library.

A file is a table in the shared folder. A row is a chunk of neighbouring documents: their ids, their lengths, and `data`, the
token ids as a Simple-8b stream. A stream is cut into blocks of BLOCK ids; its head has each block's first word, so that
any block can be decoded by itself and all words of a block at once. In a 64-bit word the top 4 bits select how many ids
of how many bits fill the other 60 (SELECTORS). Selector 0 is the escape: the next word is one raw 64-bit value, for values
of more than 60 bits. Spark's writer commits the rows, so a lost executor leaves no half-written file.

Rows are dealt to ranges of (doc_id, hash of text): a task holds a chunk at a time, and order is kept by range and chunk
number. Null doc_ids come first; equal ids are ordered by a hash of the text, equal rows are interchangeable. Null and empty
texts have the end id alone. An empty table gives an empty file. Extra columns are dropped.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrid.llm.common import BROADCAST_KEYS, importable, materialise, sliced, table
from docgrid.llm.words import NON_SPACE, Words

U = np.uint64
END_ID = 1
BLOCK = 1 << 16
#: Bytes of text in a chunk: the more, the fewer words are looked up twice.
CHUNK_BYTES = 2 << 20
CACHE_WORDS = 1_000_000
#: Selector: (ids in a word, bits of each). 0 is the escape.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
_MAGIC = b"S8B1"


# ---- Simple-8b

def _bits(v: np.ndarray) -> np.ndarray:
    if len(v) and v.max() < 1 << 53:
        return np.frexp(v.astype(float))[1].astype(np.uint8)  # these are exact as floats
    n = np.zeros(len(v), np.uint8)
    for b in (32, 16, 8, 4, 2, 1):
        big = v >= U(1) << U(b)
        n[big] += b
        v = np.where(big, v >> U(b), v)
    return n + (v > 0)


def encode_block(values: np.ndarray) -> np.ndarray:
    """Words of a block of unsigned values: each word takes as many as fit."""
    n = len(values)
    padded = np.concatenate([values.astype(U), np.zeros(60, U)])
    widest = {1: _bits(padded)}  # by window: the most bits of the values from here on
    for k in (1, 2, 4, 8, 16):
        m = widest[k].copy()
        m[:-k] = np.maximum(m[:-k], widest[k][k:])
        widest[2 * k] = m
    choice = np.zeros(n, np.uint8)
    for s, (count, bits) in reversed(SELECTORS.items()):
        k = 1 << (count.bit_length() - 1)
        m = widest[k][:n] if k == count else np.maximum(widest[k][:n], widest[k][count - k : count - k + n])
        choice[m <= bits] = s
    step = np.array([1, *(c for c, _ in SELECTORS.values())])[choice].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at, np.int64)
    chosen = choice[at]
    place = np.arange(len(at)) + np.cumsum(chosen == 0) - (chosen == 0)
    words = np.zeros(len(at) + int((chosen == 0).sum()), U)
    for s in np.unique(chosen):
        here = chosen == s
        if s == 0:
            words[place[here] + 1] = padded[at[here]]
            continue
        count, bits = SELECTORS[int(s)]
        w = np.full(int(here.sum()), U(int(s)) << U(60))
        for k in range(count):
            w |= padded[at[here] + k] << U(k * bits)
        words[place[here]] = w
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of a block's words."""
    selector = (words >> U(60)).astype(np.int64)
    if (selector == 0).any():  # a raw value after an escape is no word; its own top bits may be anything
        raw, i = np.zeros(len(words), bool), 0
        for i in np.flatnonzero(selector == 0):
            if not raw[i]:
                raw[i + 1] = True
        words_at = np.flatnonzero(~raw)
    else:
        words_at = np.arange(len(words))
    selector = selector[words_at]
    counts = np.array([1, *(c for c, _ in SELECTORS.values())])[selector]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), U)
    for s in np.unique(selector):
        here = selector == s
        if s == 0:
            out[first[here]] = words[words_at[here] + 1]
            continue
        count, bits = SELECTORS[int(s)]
        w, mask = words[words_at[here]], (U(1) << U(bits)) - U(1)
        for k in range(count):
            out[first[here] + k] = w >> U(k * bits) & mask
    return out[:n]


def write_stream(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Head (magic, block size, number of values, first word of each block and the end), then the words."""
    blocks = [encode_block(values[i : i + block]) for i in range(0, len(values), block)]
    ends = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = np.array([block, len(values)], "<u8").tobytes()
    return _MAGIC + head + ends.tobytes() + (np.concatenate(blocks).astype("<u8").tobytes() if blocks else b"")


def read_stream(data: bytes, only: int | None = None) -> np.ndarray:
    """All values of a stream, or those of one block."""
    if data[:4] != _MAGIC:
        raise ValueError("not a Simple-8b stream")
    block, n = (int(x) for x in np.frombuffer(data, "<u8", 2, 4))
    count = -(-n // block)
    ends = np.frombuffer(data, "<u8", count + 1, 20).astype(np.int64)
    words = np.frombuffer(data, "<u8", offset=20 + 8 * (count + 1)).astype(U)
    wanted = range(count) if only is None else [only]
    out = [decode_block(words[ends[i] : ends[i + 1]], min(block, n - i * block)) for i in wanted]
    return np.concatenate(out) if out else np.zeros(0, U)


# ---- tokenizing

_loaded: dict = {}
#: What a byte is: white space, of a letter, a digit, another character of plain words, or of a word that is not plain. Plain words are of printable
#: ASCII and the letters À-ÿ (0xC3 and a byte from 0x80): they are normalised by lower-casing each character alone.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x21:0x7F] = OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
_KIND[0x30:0x3A] = DIGIT
_KIND[~NON_SPACE] = SPACE
_KINDS, _LOWER = _KIND.tobytes(), bytes(range(256)).lower()
#: The characters that stand for bytes in the vocabulary.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_CHARS = "".join(chr(b) if b in _SHOWN else chr(0x100 + sum(c not in _SHOWN for c in range(b))) for b in range(256))
#: The parts of a tokenizer's file for which texts can be taken word by word, and `Pieces` cuts plain words.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def by_word(spec: dict) -> bool:
    """Does this tokenizer give a text the ids of its words, one after the other? Its added tokens must be plain strings without white space."""
    added = spec.get("added_tokens") or []
    plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in added)
    return plain and all(spec.get(k) == v for k, v in BY_WORD.items())


def _values(strings: pa.Array) -> list[bytes]:
    """to_pylist, some times as fast."""
    _, at, data = strings.buffers()
    raw, at = data.to_pybytes() if data else b"", np.frombuffer(at, np.int32, len(strings) + 1, 4 * strings.offset).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Pieces:
    """place: the distinct piece that each piece is, in order; known: the distinct ones (of words that are not plain a space and the word); doc: first piece of each text, and their number."""

    def __init__(self, texts: pa.Array, special: re.Pattern | None):
        w = Words(texts, NON_SPACE, lower=False, hashed=False)
        buf, size = w.buf, len(w.buf)
        raw = buf.tobytes()
        kind, low = np.frombuffer(raw.translate(_KINDS), np.uint8), np.frombuffer(bytearray(raw.translate(_LOWER) + b"\0\0"), np.uint8)
        two = np.flatnonzero(buf == 0xC3) + 1
        second = buf[two]
        low[two[(second < 0x9F) & (second != 0x97)]] += 0x20
        # words with any other character, × and ÷ included, or with a special token's string are taken whole
        whole = np.zeros(len(w.start), bool)
        odd = np.concatenate([np.flatnonzero(kind == ODD), two[(second == 0x97) | (second == 0xB7)]])
        whole[np.searchsorted(w.start, odd, "right") - 1] = True
        for m in special.finditer(raw) if special else ():  # one that reaches into the next text does no harm
            whole[np.searchsorted(w.end, m.start(), "right") : np.searchsorted(w.start, m.end())] = True
        plain, some = kind != SPACE, whole.any()
        in_whole = np.zeros(size + 1, np.int8)
        if some:
            in_whole[w.start[whole]] += 1
            in_whole[w.end[whole]] -= 1
            np.cumsum(in_whole, out=in_whole)
        in_whole = in_whole[:size].view(bool)
        plain &= ~in_whole
        first = np.zeros(size + 2, bool)
        first[w.start] = True
        begin = first[:size] | (kind == DIGIT)
        begin[1:] |= kind[1:] != kind[:-1]
        # 's 't 'm 'd 're 've 'll: an apostrophe by itself, and the letters after it
        letter = np.append(kind == LETTER, [False, False]) & ~first
        q = np.flatnonzero((buf == 0x27) & begin)
        q = q[letter[q + 1]]
        a, b = low[q + 1], np.where(letter[np.minimum(q + 2, size)], low[q + 2], 0) if len(q) else q
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        both = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        begin[q[one | both] + 1] = False
        after = np.concatenate([q[one] + 2, q[both] + 3])
        begin[after[letter[np.minimum(after, size)]]] = True
        begin &= plain
        at = np.flatnonzero(begin)
        ends = np.cumsum(plain, dtype=np.int32) if size else np.zeros(1, np.int32)
        pieces = self._distinct(np.append(ends[at] - 1, ends[-1]), low[:size][plain])
        self.known, self.place = _values(pieces.dictionary), pieces.indices.to_numpy()
        if some:
            words = self._distinct(np.append(0, np.cumsum((w.end - w.start)[whole])), buf[in_whole])
            begin[w.start[whole]] = True
            at = np.flatnonzero(begin)
            of_word, place = in_whole[at], np.empty(len(at), np.int32)
            place[~of_word], place[of_word] = self.place, words.indices.to_numpy() + len(self.known)
            self.known += [b" " + x for x in _values(words.dictionary)]
            self.place = place
        self.doc = np.searchsorted(at, w.at)

    @staticmethod
    def _distinct(offsets: np.ndarray, data: np.ndarray) -> pa.DictionaryArray:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()


class Encoder:
    """The tokenizer of a file's bytes, and a worker's ids by piece."""

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec)
        parsed = json.loads(spec)
        self.by_word = by_word(parsed)
        added = [re.escape(t["content"].encode()) for t in parsed.get("added_tokens") or []]
        self.special = re.compile(b"|".join(added)) if added else None
        self.pieces: dict[bytes, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        known, tokenize = self.pieces, self.library.model.tokenize
        own = list(map(known.get, pieces))
        new = [x for x, v in zip(pieces, own, strict=True) if v is None]
        if not new:
            return own
        words = [x for x in new if x[0] == 0x20]
        known.update(zip(words, self.ids([x[1:].decode("utf-8") for x in words]), strict=True))
        plain = [x for x in new if x[0] != 0x20] if words else new
        found, ends = array("I"), [0]  # no list of each: thousands of them wake the garbage collector
        for x in plain:
            found.extend([t.id for t in tokenize(charmap_decode(x, "strict", _CHARS)[0])])
            ends.append(4 * len(found))
        flat = np.array(found, "<u4").tobytes()
        known.update(zip(plain, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
        fresh = map(known.__getitem__, new)
        return [next(fresh) if v is None else v for v in own]


def encoder(spec: bytes) -> Encoder:
    """One per process and file."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = Encoder(spec)
    return _loaded[key]


def token_ids(texts: pa.Array, spec: bytes, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with its end id, and how many each has."""
    e = encoder(spec)
    if not e.by_word:
        end = np.array([end_id], "<u4").tobytes()
        whole = [x + end for x in e.ids([t or "" for t in texts.to_pylist()])]
        return np.frombuffer(b"".join(whole), "<u4"), np.array([len(x) // 4 for x in whole], np.int64)
    p = Pieces(texts, e.special)
    # pieces in order, and an end after each text
    ids = [*e.piece_ids(p.known), np.array([end_id], "<u4").tobytes()]
    at = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    own = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(b"".join(ids))])
    found = own.take(pa.array(np.insert(p.place, p.doc[1:], len(own) - 1)))
    _, at, flat = found.buffers()
    at = np.frombuffer(at, np.int64, len(found) + 1) // 4
    sums = at[np.concatenate([[0], np.cumsum(np.diff(p.doc) + 1)])]
    return np.frombuffer(flat, "<u4", int(at[-1])) if at[-1] else np.zeros(0, "<u4"), np.diff(sums)


FILE = "part bigint, chunk bigint, ids array<bigint>, lengths array<bigint>, data binary"


def write_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", spec: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the file, and return it as a table of chunks in order of (part, chunk)."""
    spark = docs.sparkSession
    with open(spec or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("tie"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie")

    def run(batches):
        part = TaskContext.get().partitionId()
        for chunk, batch in enumerate(sliced(batches, "text", CHUNK_BYTES)):
            ids, lengths = token_ids(batch.column(1), sent.value, end_id)
            columns = [pa.array([part], pa.int64()), pa.array([chunk], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([write_stream(ids)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FILE.split(", ")])

    importable(spark)
    return materialise(ordered.mapInArrow(run, FILE), "token-file", "zstd")


READ = "part bigint, chunk bigint, id bigint, offset bigint, ids binary"


def read_ids(file: DataFrame) -> DataFrame:
    """One row per document: where its ids begin in all of the file, and the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, chunk, doc_ids, lengths, data = (batch.column(c)[i] for c in range(5))
                lengths = lengths.values.to_numpy()
                n, ends = len(lengths), np.cumsum(lengths)
                flat = read_stream(memoryview(data.as_buffer())).astype("<u4")
                ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, 4 * ends)), pa.py_buffer(flat)])
                columns = [pa.repeat(part, n), pa.repeat(chunk, n), doc_ids.values, pa.array(ends - lengths), ids.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in READ.split(", ")])

    importable(file.sparkSession)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    chunks = file.select("part", "chunk", size.alias("n"))
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_part = chunks.withColumn("before_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)))
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before_part", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "before_part")
    starts = materialise(in_part.join(parts, "part").select("part", "chunk", (F.col("before_chunk") + F.col("before_part")).alias("before")), "starts")
    # a row per chunk of some MB: ids are shuffled only where even these are too many to send
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_KEYS else starts
    return file.mapInArrow(run, READ).join(starts, ["part", "chunk"]).select("id", (F.col("before") + F.col("offset")).alias("start"), "ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every text of documents, and read them back."""
    back = read_ids(write_ids(table(spark, sf_dir, "documents")))
    return back.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
