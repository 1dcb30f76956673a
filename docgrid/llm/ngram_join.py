"""Operator 8: n-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Two documents are linked if the Jaccard similarity of their sets of word shingles (5 words) is 0.8 or more.
Words are `[^\\x20\\x09-\\x0D]+`, as written. A text of fewer words, but not none, has one shingle. Null texts and
texts without words have no shingles: they are linked to nothing and are a class of their own.

1. Each text gives a hash of its shingle set and `bands` hashes of `rows` MinHashes each. Bands and rows are
   chosen so that a pair at the threshold meets in a band with probability `recall` or more.
2. Texts with the same set become one node (copies are counted, never paired).
3. A bucket (band hash) with several nodes has its least node as hub. (node, hub) rows are made distinct:
   near copies meet in many bands but mostly under one hub. Two nodes of a bucket share its hub, so all pairs of
   the banding lie within hub groups.
4. Hub groups are verified in blocks of bounded size: a group of any size is cut into blocks, and a task
   compares two blocks by products of sparse 0/1 matrices, so counts of common shingles are exact. A task gives one row per
   node (its links, and the least node it is connected to), not one per pair; a pair that lies
   in several groups is counted in the group of its least common hub. Tasks are dealt by (hub, block, block), over partitions whose number follows the work. The comparisons within one group of near
   copies grow with the square of its distinct texts, spread over tasks; the rows that leave them do not.
5. Classes are connected components, by rounds of least labels with pointer jumping in tables.

class_id is the least doc_id of the class (null only if all its ids are null). n_links counts the other documents that
a document is linked to, copies included. Repeated rows are documents like others. Ties do not arise: nodes
have distinct 64-bit set hashes (two different sets collide with probability 2^-64).
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.common import BROADCAST_KEYS, free_name, importable, map_text, materialise, row_key, table, without_rows
from docgrid.llm.words import NON_SPACE, Words, mix, ngram_hash

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 160
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 19
CELLS = 1 << 21
#: Shingles that a partition of the verification reads, about; and the most partitions, beyond which they grow.
WORK_SHINGLES, MAX_PARTITIONS = 1 << 18, 1 << 16


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance meetings, that reach the recall within so many hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, NON_SPACE, lower=False)
    out = []
    for a, b in zip(w.doc[:-1], w.doc[1:], strict=True):
        h = w.hash[a:b]
        out.append(np.unique(ngram_hash(h, size if b - a >= size else max(int(b - a), 1))))
    return out


def signatures(docs: DataFrame, bands: int, rows: int, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """id, a, b (row key), n_shingles, node (hash of the set, null if empty), band_hashes."""
    key = row_key(text, doc_id)
    narrow = docs.select(key["id"].cast("long").alias("id"), key["a"].alias("a"), key["b"].alias("b"), F.col(text).alias("text"))
    rng = np.random.Generator(np.random.PCG64(8))
    factor = rng.integers(0, 2**63, bands * rows, dtype=U) * U(2) + U(1)
    shift = rng.integers(0, 2**64, bands * rows, dtype=U, endpoint=False)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(3), size)
        counts = np.array([len(s) for s in sets])
        nodes, hashes = [None] * len(sets), [None] * len(sets)
        full = np.flatnonzero(counts)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
            least = np.empty((len(full), bands * rows), U)
            for k in range(bands * rows):
                least[:, k] = np.minimum.reduceat(flat * factor[k] + shift[k], first)
            band = np.zeros((len(full), bands), U) + np.arange(bands, dtype=U)
            for r in range(rows):
                band = band * U(0x9FB21C651E98DF25) + least.reshape(len(full), bands, rows)[:, :, r]
            band = mix(band).view(np.int64)
            whole = mix(np.add.reduceat(mix(flat.copy()), first) + counts[full].astype(U)).view(np.int64)
            for i, n, h in zip(full, whole.tolist(), band.tolist(), strict=True):
                nodes[i], hashes[i] = n, h
        return pa.RecordBatch.from_arrays(
            [*part.columns[:3], pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
            names=["id", "a", "b", "n_shingles", "node", "band_hashes"],
        )

    return map_text(narrow, "text", make, "id bigint, a bigint, b bigint, n_shingles bigint, node bigint, band_hashes array<bigint>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    total = np.zeros((n, n), np.float64)
    wide = max(1, CELLS // n)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + wide, wide))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            m = np.zeros((n, wide), np.float32)
            m[owner[a:b], column[a:b] - k * wide] = 1
            total += m @ m.T
    return total


def verify_block(hub: int, side: np.ndarray, nodes: np.ndarray, copies: np.ndarray, hubs: list, sets: list[np.ndarray], threshold: float):
    """Links of the nodes of one task: (links to count, least node each is joined with). side: block 0 or 1 of each node; pairs of two blocks, or of one if there is one."""
    t = Fraction(threshold).limit_denominator(1000)
    size = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets)
    linked = common * (t.denominator + t.numerator) >= t.numerator * (size[:, None] + size[None, :])
    linked &= side[:, None] != side[None, :] if side.any() else ~np.eye(len(nodes), dtype=bool)
    root = np.arange(len(nodes))
    while True:  # least labels within the task; nodes are sorted
        new = np.minimum(root, np.where(linked, root[None, :], len(nodes)).min(axis=1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    earlier = [[h for h in hs if h < hub] for hs in hubs]
    if any(earlier):
        at = {h: i for i, h in enumerate(sorted({h for hs in earlier for h in hs}))}
        m = np.zeros((len(nodes), len(at)), np.float32)
        for i, hs in enumerate(earlier):
            m[i, [at[h] for h in hs]] = 1
        counted = linked & (m @ m.T == 0)
    else:
        counted = linked
    return (counted * copies[None, :]).sum(axis=1).astype(np.int64), nodes[root]


def verify(groups: DataFrame, threshold: float, size: int, partitions: int) -> DataFrame:
    """groups(hub, i, j, block, node, copies, hubs, text) to (node, links, root), one task per (hub, i, j)."""

    def work(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        t = t.combine_chunks().sort_by("node")
        nodes = t.column("node").to_numpy()
        keep = np.concatenate([[True], nodes[1:] != nodes[:-1]])  # repeated rows of one document
        t, nodes = t.filter(pa.array(keep)), nodes[keep]
        side = (t.column("block").to_numpy() == j).astype(np.int8) if i != j else np.zeros(len(nodes), np.int8)
        links, root = np.zeros(len(nodes), np.int64), nodes
        if len(nodes) > 1 and (i == j or 0 < side.sum() < len(side)):
            sets = shingle_sets(t.column("text").combine_chunks(), size)
            links, root = verify_block(t.column("hub")[0].as_py(), side, nodes, t.column("copies").to_numpy(), t.column("hubs").to_pylist(), sets, threshold)
        some = (links > 0) | (root != nodes)
        return pa.table({"node": nodes[some], "links": links[some], "root": root[some]})

    importable(groups.sparkSession)
    # else the blocks of one group would stay where the join by hub put them all
    return groups.repartition(partitions, "hub", "i", "j").groupBy("hub", "i", "j").applyInArrow(work, "node bigint, links bigint, root bigint")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) of every node in edges(node, root): label is the least node of its connected component."""
    edges = materialise(edges.where("node <> root").distinct(), "edges")
    both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges.select(F.col("root").alias("u"), F.col("node").alias("v")))
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = materialise(seen.join(jump, "low").select("node", F.least("low", "further").alias("new"), F.col("label").alias("old")), name)
        changed = new.where("new <> old").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, max_hashes: int = MAX_HASHES, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per document: id, a, b (row key), class_id, n_links, and the key of the class's first document (first)."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    signed = materialise(signatures(docs, bands, rows, text, doc_id, size), "signatures")
    with_set = signed.where("node is not null")
    nodes = materialise(
        with_set.groupBy("node").agg(F.min(F.struct("id", "a", "b")).alias("first"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("band_hashes").alias("band_hashes")),
        "nodes",
    )
    banded = nodes.select("node", F.explode("band_hashes").alias("band"))  # copies have equal bands
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("hub_band"), "hub")
    hubs = materialise(hubs, "hubs")  # a plain table on this side lets a hot band be split at run time
    members = materialise(banded.join(hubs, banded["band"] == hubs["hub_band"]).select("hub", "node").distinct(), "members")

    sizes = members.join(nodes.select("node", "n_shingles"), "node").groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    sizes = materialise(sizes.select(F.col("hub").alias("group_hub"), "s", blocks.alias("blocks")), "sizes")
    work = sizes.agg(F.sum(F.col("s") * F.col("blocks"))).first()[0] or 0
    cut = sizes.where("blocks > 1").select("group_hub", "blocks")  # one in about a thousand members at most
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_KEYS else cut
    # ids, not texts, learn how their hubs are cut: no text is dealt by hub alone
    placed = members.join(cut, F.col("hub") == F.col("group_hub"), "left").select("node", F.struct("hub", F.coalesce("blocks", F.lit(1)).alias("blocks")).alias("group"))
    own = placed.groupBy("node").agg(F.collect_list("group").alias("groups"))  # as many as bands at most
    key = row_key(text, doc_id)
    first = nodes.select("node", "copies", "first")
    chosen = own.join(first, "node")
    body = docs.select(key["id"].cast("long").alias("id"), key["a"].alias("a"), key["b"].alias("b"), F.col(text).alias("text"))
    on = body["id"].eqNullSafe(chosen["first"]["id"]) & (body["a"] == chosen["first"]["a"]) & (body["b"] == chosen["first"]["b"])
    texts = body.join(chosen.hint("shuffle_hash"), on).select("node", "copies", F.transform("groups", lambda g: g["hub"]).alias("hubs"), F.explode("groups").alias("group"), "text")
    placed = texts.select("group.*", "node", "copies", "hubs", "text").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "hubs", "text"
    )
    found = materialise(verify(tasks, threshold, size, min(MAX_PARTITIONS, math.ceil(work / WORK_SHINGLES) or 1)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select("node", "root"))
    classed = nodes.join(labels, "node", "left").join(links, "node", "left")
    classed = classed.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "copies", "first", "least_id")
    least = classed.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("first").alias("first"))
    final = classed.drop("first").join(least, "label").select(F.col("node").alias("of"), "class_id", "first", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    keyed = signed.select("id", "a", "b", "node").join(final, F.col("node") == F.col("of"), "left")
    return keyed.select(
        "id", "a", "b", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", F.struct("id", "a", "b")).alias("first")
    )


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without near duplicates: of each class the one with the least (doc_id, hashes of the text), null ids first. Of repeated rows one stays."""
    found = materialise(ngram_join(docs, text, doc_id, **options), "classes")
    mine = F.struct("id", "a", "b")
    kept = without_rows(docs, found.where(~mine.eqNullSafe(F.col("first"))).select("id", "a", "b"))
    again = materialise(found.groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "a", "b"), "repeated")
    if not again.limit(1).count():
        return kept
    single = without_rows(kept, again)
    k = free_name(docs, "row_key")
    rows = kept.withColumn(k, row_key(text, doc_id))
    on = rows[k]["id"].cast("long").eqNullSafe(again["id"]) & rows[k]["a"].eqNullSafe(again["a"]) & rows[k]["b"].eqNullSafe(again["b"])
    whole = F.struct(*docs.columns)
    one = rows.join(again, on, "left_semi").groupBy(k).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionByName(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: one row per document."""
    return ngram_join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")
