"""Operator 9: scoring with an interpolated modified Kneser-Ney model, counted in Spark.

Tokens are words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, then one end token per text; the first words of an n-gram
may reach the start of the text, which is one token more. The model has order 3 (or 2):

    p(w | u v) = max(c(uvw) - D3(c(uvw)), 0) / c(uv) + g(uv) p(w | v),    p(w | v) if uv was never seen
    p(w | v)   = max(a(vw) - D2(a(vw)), 0) / a(v) + g(v) p(w),            p(w) if v was never seen
    p(w)       = max(n(w) - D1(n(w)), 0) / n + g / (V + 1)

a(vw) is the number of distinct words before vw, or c(vw) where v is the start, before which nothing stands; with order 2 it is c(vw).
n(w) is the number of distinct words before w. The D are the three discounts of modified Kneser-Ney, from counts of counts at each level; g hand on what
they take. V is the number of distinct training tokens, and one more stands for all unseen words.

1. Texts become parts of a few million tokens, stored: local vocabulary (64-bit word hashes) and tokens as places in it.
2. Each part sends its distinct trigrams (sorted hashes of `key_bits`, with training counts) in slices by hash range.
   A task merges one range over all parts into sorted hash arrays of keys and counts, in a file that it maps into memory; from the mapped arrays it
   looks up every part's slice, and sends the counts back in the same order. The merged arrays are stored as well: they are the model.
   Ranges of a hash are even whatever the words are: a word that makes up a third of the text does not gather in one task. Their number follows the bytes of text.
3. The part that a trigram is credited to adds it to the statistics of its two bigrams; bigrams are merged and sent
   back likewise, and then add to the statistics of their words, which are merged last.
4. Each part then has all it needs to score its texts.
Parts are stored in buckets, so that what is sent back is joined to them where they are. Nothing but sums goes to the driver.

Null texts count as empty: the end token alone. A null doc_id is trained on. Repeated rows are texts
like others; an empty table gives no rows. Very long texts are parts of their own. Extra columns are dropped.
With nothing to train on, the model is uniform over the unseen word: every token has log10 1/(V + 1) = 0.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.common import CHUNK_BYTES, importable, materialise, shared_dir, sliced, table
from docgrid.llm.words import NON_SPACE, Words, mix

U = np.uint64
ORDER = 3
PART_TOKENS = 3 << 19
#: Bytes of text for each hash range.
RANGE_BYTES = 16 << 20
START, END = U(0x5DEECE66D5DEECE6), U(0xB5026F5AA96619E9)
_C = U(0x9FB21C651E98DF25)
LEAST = 0.05


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(a: np.ndarray, width: int) -> bytes:
    """Unsigned integers that fit into so many bytes: byte planes, compressed. Only the low planes are noise."""
    wide = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + len(a).to_bytes(8, "little") + _ZSTD.compress(np.ascontiguousarray(wide[:, :width].T), asbytes=True)


def widen(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_ZSTD.decompress(data[9:], width * n, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def width_of(top: int) -> int:
    return max(1, -(-int(top).bit_length() // 8))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and steps."""
    step = np.diff(keys, prepend=keys[:1])
    return (int(keys[0]) if len(keys) else 0).to_bytes(8, "little") + squeeze(step, width_of(step.max(initial=0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(widen(data[8:]), dtype=U) + U(int.from_bytes(data[:8], "little"))


def pack_counts(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return squeeze(n, width_of(n.max(initial=0)))


def unpack_counts(data: bytes) -> np.ndarray:
    return widen(data).astype(np.int64)


def key_bits(size: int) -> int:
    """Bits of an n-gram's hash for so many bytes of text: so many that of a few million n-grams about one shares its key with another, and 63 at most."""
    return min(63, max(40, 19 + int(size).bit_length()))


def slices(keys: np.ndarray, shards: int, bits: int) -> list[tuple[int, int]]:
    """Where each shard's range of sorted keys begins and ends."""
    edges = [(s << bits) // shards for s in range(1, shards)]
    return list(pairwise([0, *np.searchsorted(keys, np.array(edges, U)).tolist(), len(keys)]))


# ---- parts

PARTS = "part bigint, ids array<bigint>, held array<boolean>, lengths array<bigint>, vocabulary binary, tokens binary"


def parts(docs: DataFrame, text: str, doc_id: str, held: Column, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Texts as tokens, in rows of bounded size. The local vocabulary is ordered by count, so that common words have small places."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), held.alias("held"), F.col(text).alias("text"))

    def run(batches):
        made, kept, size = 0, [], 0

        def part():
            nonlocal made
            hashes = np.concatenate([h for _, _, h, _ in kept])
            words, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            made += 1
            key = TaskContext.get().partitionId() << 24 | made
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key], pa.int64()),
                    pa.array([[i for ids, *_ in kept for i in ids]], pa.list_(pa.int64())),
                    pa.array([[h for _, hs, *_ in kept for h in hs]], pa.list_(pa.bool_())),
                    pa.array([np.concatenate([n for *_, n in kept])], pa.list_(pa.int64())),
                    pa.array([words[order].tobytes()], pa.binary()),
                    pa.array([squeeze(rank[place], 4)], pa.binary()),
                ],
                names=[f.split()[0] for f in PARTS.split(", ")],
            )

        for batch in sliced(batches, "text", CHUNK_BYTES):
            w = Words(batch.column(2), NON_SPACE, lower=True)
            n = w.counts()
            with_end = np.insert(w.hash, w.doc[1:], END)
            kept.append((batch.column(0).to_pylist(), batch.column(1).to_pylist(), with_end, n + 1))
            size += len(with_end)
            if size >= part_tokens:
                yield part()
                kept, size = [], 0
        if kept:
            yield part()

    importable(docs.sparkSession)
    return rows.mapInArrow(run, PARTS)


class Part:
    """A part's tokens: word and word before (places in the vocabulary; the last place is the start), and their n-grams."""

    def __init__(self, row: dict, bits: int):
        self.shift = U(64 - bits)
        self.ids, self.held, self.lengths = row["ids"], np.array(row["held"], bool), np.array(row["lengths"], np.int64)
        self.words = np.append(np.frombuffer(row["vocabulary"], "<u8"), START)
        self.word = widen(row["tokens"]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.before = np.concatenate([[0], self.word[:-1]])
        self.before[self.first] = len(self.words) - 1
        self.train = np.repeat(~self.held, self.lengths)
        later = np.ones(len(self.word), bool)
        later[self.first] = False
        self.later = np.flatnonzero(later)  # tokens with two before them, the start counted

    def bigrams(self):
        """Sorted distinct keys, the key's place for each token, and training counts."""
        h = mix(self.words[self.before] * _C + self.words[self.word]) >> self.shift
        keys, place = np.unique(h, return_inverse=True)
        return keys, place, np.bincount(place[self.train], minlength=len(keys))

    def trigrams(self):
        """As bigrams, with a place for each of `later`."""
        at = self.later
        h = mix((self.words[self.before[at - 1]] * _C + self.words[self.before[at]]) * _C + self.words[self.word[at]]) >> self.shift
        keys, place = np.unique(h, return_inverse=True)
        return keys, place, np.bincount(place[self.train[at]], minlength=len(keys))

    def word_keys(self):
        """Sorted keys of the vocabulary and the start, and the order that sorts them."""
        keys = mix(self.words.copy()) >> self.shift
        order = np.argsort(keys, kind="stable")
        return keys[order], order


def one(t: pa.Table, column: str) -> list:
    return t.column(column).to_pylist()


# ---- exchange: what all parts know about a key, summed and sent back

SENT = "shard int, part bigint, keys binary, counts array<binary>"
BACK = "kind string, part bigint, shard int, own binary, keys binary, counts array<binary>, sums array<bigint>"


def sent_rows(part: int, keys: np.ndarray, counts: list[np.ndarray], shards: int, bits: int):
    for s, (a, b) in enumerate(slices(keys, shards, bits)):
        if b > a:
            yield s, part, pack_keys(keys[a:b]), [pack_counts(c[a:b]) for c in counts]


def sent_batch(rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "part", "keys", "counts"])


class Mapped:
    """Sorted keys and their counts in a file that is mapped into memory: only the pages that are looked at are read."""

    def __init__(self, keys: np.ndarray, counts: list[np.ndarray]):
        self.file = tempfile.NamedTemporaryFile()  # gone with the task; the stored copy is the model's row
        counts = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in counts]
        at = [0]
        for x in (keys, *counts):
            at.append(at[-1] + self.file.write(np.ascontiguousarray(x).data))
        self.file.flush()
        self.keys = np.memmap(self.file.name, U, "r", 0, len(keys))
        self.counts = [np.memmap(self.file.name, c.dtype, "r", begin, len(keys)) for c, begin in zip(counts, at[1:], strict=False)]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The counts of keys that are all there."""
        at = np.searchsorted(self.keys, keys)
        return [c[at] for c in self.counts]


def merge(sent: DataFrame, kind: str, of: int) -> DataFrame:
    """For each shard and part the sums over all parts, in the part's order; `own` marks keys credited to the part.
    sums: keys with a first sum above 0, its total, the total of the sums in column `of`, and how many of these are 1, 2, 3, 4."""

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        owners, lists = one(t, "part"), [unpack_keys(k) for k in one(t, "keys")]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        every = every[first]
        packed, sums, seen = one(t, "counts"), [], None
        for i in range(len(packed[0])):
            column = np.concatenate([unpack_counts(c[i]) for c in packed])[order]
            seen = column > 0 if seen is None else seen
            sums.append(np.add.reduceat(column, first))
        # the first part with a training count owns the key
        owner = np.minimum.reduceat(np.where(seen, np.arange(len(order)), len(order)), first)
        own = np.zeros(len(order) + 1, bool)
        own[np.append(order, len(order))[owner]] = True
        held = sums[0] > 0
        totals = [int(held.sum()), int(sums[0].sum()), int(sums[of].sum()), *(int((sums[of] == k).sum()) for k in (1, 2, 3, 4))]
        shard = t.column("shard")[0].as_py()
        rows = [("sums", None, shard, None, None, None, totals), ("model", None, shard, None, pack_keys(every[held]), [pack_counts(s[held]) for s in sums], None)]
        model = Mapped(every, sums)
        del every, sums, held, order, first, seen, owner, packed
        begin = 0
        for part, keys in zip(owners, lists, strict=True):
            rows.append((kind, part, shard, np.packbits(own[begin : begin + len(keys)]).tobytes(), None, [pack_counts(c) for c in model.find(keys)], None))
            begin += len(keys)
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=[f.split()[0] for f in BACK.split(", ")])

    return materialise(sent.groupBy("shard").applyInArrow(work, BACK), kind, "zstd")


class Totals(NamedTuple):
    """Of a level: n-grams seen, their occurrences, the sum of the counts that discounts are from, and how many of these are 1, 2, 3, 4."""

    kinds: int
    tokens: int
    counted: int
    ones: int
    twos: int
    threes: int
    fours: int


def totals(back: DataFrame) -> Totals:
    """Sums over the shards."""
    r = back.where("kind = 'sums'").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(7))).first()
    return Totals(*(int(x or 0) for x in r))


def received(t: pa.Table, kind: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A part's slices put together: own (none if it was not sent), and the sums."""
    rows = sorted((r for r in t.select(["kind", "shard", "own", "counts"]).to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
    counts = [[unpack_counts(c) for c in r["counts"]] for r in rows]
    own = [np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(c[0])).astype(bool) for r, c in zip(rows, counts, strict=True) if r["own"] is not None]
    return np.concatenate(own) if own else np.zeros(0, bool), [np.concatenate([c[i] for c in counts]) for i in range(len(counts[0]))]


# ---- the model

def discounts(n: Sequence[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more, from the counts of counts 1 to 4. Held within LEAST and the count less LEAST, so that no word gets no probability; all 1/2 where no count is 1."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, LEAST), k - LEAST) for k, x in enumerate(d, 1))])


class Levels(NamedTuple):
    """Totals of words, bigrams and (order 3) trigrams."""

    words: Totals
    bigrams: Totals
    trigrams: Totals | None

    def unigram(self, n_w: np.ndarray) -> np.ndarray:
        d, t = discounts(self.words[3:]), self.words
        pairs = self.bigrams.kinds
        more = max(t.kinds - t.ones - t.twos, 0)
        handed = (d[1] * t.ones + d[2] * t.twos + d[3] * more) / pairs if pairs else 1.0
        return (n_w - d[np.minimum(n_w, 3)]) / max(pairs, 1) + handed / (max(t.kinds, 0) + 1)


def interpolated(count: np.ndarray, context: np.ndarray, followers: Sequence[np.ndarray], low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """One level over the next lower one. followers: how many different words follow the context once, twice, more often."""
    high = (count - d[np.minimum(count, 3)] + (d[1] * followers[0] + d[2] * followers[1] + d[3] * followers[2]) * low) / np.maximum(context, 1)
    return np.where(context > 0, high, low)


SCORES = "id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def by_class(at: np.ndarray, count: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each place occurs with a count of 1, of 2, and above."""
    return [np.bincount(at[m], minlength=n) for m in (count == 1, count == 2, count >= 3)]


def owned(place: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each n-gram credited to the part, a token that ends it."""
    example = np.zeros(len(own), np.int64)
    example[place] = at
    return example[own]


def bigram_counts(p: Part, right: pa.Table | None, order: int):
    """Keys of a part's bigrams, and what the part adds: occurrences, a, and the trigrams that begin with the bigram by their count."""
    keys, place, n = p.bigrams()
    if order < 3:
        return keys, [n, n]
    a, size = np.zeros(len(keys), np.int64), len(keys)
    follow = [a, a, a]
    if len(p.later):
        own, (c,) = received(right, "trigram")
        at = owned(p.trigrams()[1], p.later, own)
        a = np.bincount(place[at], minlength=size)
        follow = by_class(place[at - 1], c[own], size)
    starts = place[p.first]
    a[starts] = n[starts]  # before the start stands nothing: occurrences
    return keys, [n, a, *follow]


def word_counts(p: Part, right: pa.Table) -> list[np.ndarray]:
    """What a part adds for each word: occurrences, the bigrams that begin with it by their count, their sum, and the words before it."""
    _, place, _ = p.bigrams()
    own, columns = received(right, "bigram")
    at, a, n = owned(place, np.arange(len(place)), own), columns[1][own], len(p.words)
    v, w = p.before[at], p.word[at]
    occurs = np.bincount(p.word[p.train], minlength=n)
    occurs[-1] = int((~p.held).sum())
    return [occurs, *by_class(v, a, n), np.bincount(v, weights=a, minlength=n).astype(np.int64), np.bincount(w, minlength=n)]


def token_scores(p: Part, right: pa.Table, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """For each token its training count and log10 probability."""
    _, place, _ = p.bigrams()
    _, two = received(right, "bigram")
    _, order = p.word_keys()
    words = [np.empty_like(order) for _ in range(6)]
    for to, x in zip(words, received(right, "word")[1], strict=True):
        to[order] = x
    c, *follow, a, n_w = words
    v, w = p.before, p.word
    low = levels.unigram(n_w[w])
    low = interpolated(two[1][place], a[v], [x[v] for x in follow], low, discounts(levels.bigrams[3:]))
    if levels.trigrams and len(p.later):
        at = p.later
        _, (three,) = received(right, "trigram")
        context = place[at - 1]
        low[at] = interpolated(three[p.trigrams()[1]], two[0][context], [x[context] for x in two[2:]], low[at], discounts(levels.trigrams[3:]))
    return c[w], np.log10(low)


def score(docs: DataFrame, held: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, part_tokens: int = PART_TOKENS, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """(scores of every text, the stored model: sorted hash arrays of each level by range, number of training tokens). `held` is true for texts not to learn from."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards, bits = max(8, -(-int(size) // range_bytes)), key_bits(size)
    name = f"docgrid_parts_{uuid.uuid4().hex}"
    stored = parts(docs, text, doc_id, held, part_tokens)
    stored.write.bucketBy(shards, "part").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    stored = spark.table(name)

    def send(level):
        """Rows of a part to all ranges; level gives sorted keys and counts."""

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    keys, counts = level(Part(row, bits))
                    yield sent_batch(list(sent_rows(row["part"], keys, counts, shards, bits)))

        return stored.mapInArrow(run, SENT)

    def answer(back: DataFrame, level):
        """As send, with what was sent back to the part."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.Table.from_batches([sent_batch([])])
            row = left.to_pylist()[0]
            keys, counts = level(Part(row, bits), right)
            return pa.Table.from_batches([sent_batch(list(sent_rows(row["part"], keys, counts, shards, bits)))])

        mine = back.where(F.col("part").isNotNull()).select("kind", "part", "shard", "own", "counts")
        return stored.groupBy("part").cogroup(mine.groupBy("part")).applyInArrow(run, SENT)

    def three(p: Part):
        keys, _, n = p.trigrams()
        return keys, [n]

    def one_word(p: Part, right: pa.Table):
        keys, at = p.word_keys()
        return keys, [x[at] for x in word_counts(p, right)]

    trigrams = merge(send(three), "trigram", 0) if order == 3 else None
    pairs = answer(trigrams, lambda p, right: bigram_counts(p, right, 3)) if order == 3 else send(lambda p: bigram_counts(p, None, 2))
    bigrams = merge(pairs, "bigram", 1)
    words = merge(answer(bigrams, one_word), "word", 5)
    back = bigrams.unionByName(words) if trigrams is None else trigrams.unionByName(bigrams).unionByName(words)
    # the start is counted among the words, once per training text, but is no token
    train_docs = stored.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n = totals(words)
    n = n._replace(kinds=n.kinds - (1 if train_docs else 0), tokens=n.tokens - train_docs)
    levels, train_tokens, vocabulary = Levels(n, totals(bigrams), totals(trigrams) if trigrams else None), n.tokens, n.kinds

    def send_scores(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCORES.split(", ")]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        p = Part(left.to_pylist()[0], bits)
        c, logs = token_scores(p, right, levels)
        base = np.log10((c + 1) / (train_tokens + vocabulary + 1))
        return pa.table(
            [pa.array(p.ids, pa.int64()), pa.array(p.held), pa.array(p.lengths), *(pa.array(np.add.reduceat(x, p.first)) for x in ((c > 0).astype(np.int64), base, logs))],
            names=names,
        )

    mine = back.where(F.col("part").isNotNull()).select("kind", "part", "shard", F.lit(None).cast("binary").alias("own"), "counts")
    scored = stored.groupBy("part").cogroup(mine.groupBy("part")).applyInArrow(send_scores, SCORES)
    level = {"trigram": trigrams, "bigram": bigrams, "word": words}
    model = reduce(DataFrame.unionByName, (x.where("kind = 'model'").select(F.lit(k).alias("level"), "shard", "keys", "counts") for k, x in level.items() if x is not None))
    return scored, model, train_tokens


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text of documents."""
    scored, _, train_tokens = score(table(spark, sf_dir, "documents"), held_out())
    return scored.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )
