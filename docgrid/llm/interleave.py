"""Operator 5: sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order. The k-th of a source's n rows has the fractional rank
(k - 1/2) / n. All rows are sorted by fractional rank and the order is cut into shards of equal row counts, so
each run of rows, and so each shard, holds every source in its share of the whole (give or take a row).

Law: `rows` (row counts of shards differ by one at most).

Neither order is found by a window over a source or over all rows. Both are ranked in two steps: rows are dealt to
buckets by the order key, buckets are counted (partial sums before the shuffle) and their counts summed up in
order; then rows are ranked within their bucket. A source has one bucket per `bucket_rows` of its rows, so a
source with a third of all rows has many; a task sorts a few thousand rows.

Null sources are a stratum of their own. Null text counts as no bytes. Ties and repeated rows: the seeded key is a hash of
doc_id and text; rows with equal keys are ordered by id, size and checksum, and rows equal in these are interchangeable.
An empty table gives no rows. Extra columns are dropped unless named in `keep`; a name that is in use here gets `_kept` behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrid.llm.common import materialise, table

SHARDS = 40
SEED = 17
OVERHEAD = 16
BUCKET_ROWS = 4096
LAW = "rows"
_OWN = {"doc_id", "size", "text_crc32", "source_name", "shard", "slot", "rank_in_source", "seeded_key", "n_source", "fraction", "bucket", "place", "before", "source_of", "n_all", "slice", "position", "s", "b", "n", "one"}


def _starts(counts: DataFrame, of: list[str], rank: str, n: str, name: str) -> DataFrame:
    """Rows before each bucket: running sums of a table that has one row per bucket."""
    w = Window.partitionBy(*of).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)))


def _unit(key: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return (F.shiftrightunsigned(key, 11).cast("double") * F.lit(2.0**-53)).cast("double")


def interleave(rows: DataFrame, source: str, order: list[str], shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add shard (0 to shards - 1), slot (0 on, without gaps) and rank_in_source. `rows` is read several times: give a stored table. `order` says which rows are the same."""
    keyed = rows.withColumn("seeded_key", F.xxhash64(F.lit(seed), *order))
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n_source"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_source") / bucket_rows)).cast("long")
    # the table of sources is small or, where there are very many, joined by a shuffle as Spark decides
    sized = keyed.join(sizes.withColumnRenamed(source, "source_of"), F.col(source).eqNullSafe(F.col("source_of")))
    dealt = sized.withColumn("bucket", F.least(n_buckets - 1, F.floor(_unit(F.col("seeded_key")) * n_buckets)).cast("long"))
    counts = dealt.groupBy("source_of", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = _starts(counts, ["source_of"], "bucket", "n", "before").select(F.col("source_of").alias("s"), F.col("bucket").alias("b"), "before")
    w = Window.partitionBy("source_of", "bucket").orderBy(F.shiftrightunsigned("seeded_key", 11), *order)
    placed = dealt.withColumn("place", F.row_number().over(w))
    ranked = placed.join(starts, F.col("source_of").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("rank_in_source", F.col("before") + F.col("place"))
    ranked = ranked.withColumn("fraction", (2 * F.col("rank_in_source") - 1) / (2 * F.col("n_source")))
    ranked = materialise(ranked.select(*rows.columns, "seeded_key", "rank_in_source", "n_source", "fraction"), "ranked")

    total = ranked.groupBy().agg(F.count(F.lit(1)).alias("n_all"))
    shares = ranked.crossJoin(F.broadcast(total))  # one row
    shares = shares.withColumn("slice", F.floor(F.col("fraction") * F.greatest(F.lit(1), F.ceil(F.col("n_all") / bucket_rows))).cast("long"))
    per_slice = shares.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = _starts(per_slice.withColumn("one", F.lit(1)), ["one"], "slice", "n", "before").select(F.col("slice").alias("b"), "before")
    w = Window.partitionBy("slice").orderBy("fraction", "seeded_key", source, *order)
    at = shares.withColumn("place", F.row_number().over(w)).join(before, F.col("slice") == F.col("b")).withColumn("position", F.col("before") + F.col("place") - 1)
    # shard s holds positions from ceil(s * n / shards) on
    shard = F.floor(F.col("position") * shards / F.col("n_all")).cast("int")
    first = F.floor((shard.cast("long") * F.col("n_all") + shards - 1) / shards).cast("long")
    return at.select(*rows.columns, shard.alias("shard"), (F.col("position") - first).cast("long").alias("slot"), F.col("rank_in_source").cast("long"))


def shard_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: tuple[str, ...] = (), shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size in bytes, checksum, and where the row goes; with `keep` any other columns, as the text itself."""
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.col(source).alias("source_name"),
        *(F.col(c).alias(f"{c}_kept" if c.lower() in _OWN else c) for c in keep),
    )
    return interleave(materialise(rows, "rows"), "source_name", ["doc_id", "size", "text_crc32"], shards, seed)


def op5_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source_name", "rank_in_source"
    )
