"""Sharding by proportional stratified interleaving.

Rows of each source get a rank in a seeded shuffle; the fractional rank (rank + 1/2) / rows of the source puts all
sources on one scale, on which every stretch has the mixture of the whole; the scale is cut into shards whose row
counts differ by one at most (law ``rows``). Both rankings run over buckets (see ``ordering``), so neither a hot source
nor the whole table meets in one task, and only ids and sizes move: no text is shuffled.

Defined results: a null text has size 1 and CRC 0; null sources form one stratum; rows with the same id or none are told
apart by source, size and CRC, which also go into the seeded key, so that they are mixed like others; rows equal in all
of these are interchangeable; a very long text counts by its size and is not moved; an empty table gives no rows; with
fewer rows than shards some shards are empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import needs, small_lookup, stored, text_of
from .ordering import BUCKET_ROWS, SPAN, running, seeded

SEED = "shard-1"


def shard(docs: DataFrame, shards: int = 8, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, rank (in its source), source_rows, fraction, place, shard, slot."""
    raw = text_of().cast("binary")
    d = needs(docs, doc_id="bigint", source="string", text="string").select(
        "doc_id",
        "source",
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_stratum"),
        (F.octet_length(text_of()) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).withColumn("_key", seeded(seed, "doc_id", "size", "text_crc32"))
    d = stored(d, "shard_rows")  # ids, sizes and checksums: the texts are read once
    strata = d.groupBy("_stratum").agg(F.count("*").alias("source_rows"))
    d = small_lookup(d, strata, "_stratum", "_key", "strata")
    total = d.sparkSession.range(1).crossJoin(strata.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("total"))).select("total")
    # the shuffled order within a source, over buckets of a few thousand rows
    share = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.lit(BUCKET_ROWS)))
    d = d.withColumn("_bucket", F.least(F.floor(F.col("_key") / F.lit(float(SPAN)) * share), share - 1).cast("bigint")).withColumn("_one", F.lit(1).cast("bigint"))
    ties = ["doc_id", "size", "text_crc32"]
    d = running(d, ["_stratum"], "_bucket", ["_key", *ties], "_one", "rank").drop("_bucket")
    d = stored(d, "shard_ranks")
    d = d.withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("source_rows") * 2))
    # the same on the scale of all sources
    d = d.join(F.broadcast(total))  # one row
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(BUCKET_ROWS)))
    d = d.withColumn("_bucket", F.least(F.floor(F.col("fraction") * parts), parts - 1).cast("bigint"))
    d = running(d, [], "_bucket", ["fraction", "_stratum", "_key", *ties], "_one", "place")
    d = d.withColumn("shard", F.expr(f"place * {shards} div total").cast("int"))
    return d.select("doc_id", "source", "size", "text_crc32", "rank", "source_rows", "fraction", "place", "shard", (F.col("place") - F.expr(f"(shard * total + {shards} - 1) div {shards}")).alias("slot"))
