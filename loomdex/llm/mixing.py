"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

The words that the mix takes are shared over the sources by weight; no source gives more than ``most`` times its size,
and what it cannot give is shared again by weight over the others (water filling). Each document gets the exponential
key -ln(u) / quality from a seeded u; within a source the documents in order of their keys are a weighted sample without
replacement. Whole epochs of the source come first; the rest of its target is the front of that order, to the document
whose end is nearest to the target.

The order within a source is a running sum over buckets (see ``ordering``), so a source with a third of all rows is
spread over many tasks; only ids and sizes move. The sources' own table has one row per source.

Defined results: a null or empty text has size 0 and is never taken; null sources are one source, after all others;
rows with the same id or none are told apart by source and text, whose hash also goes into the seeded key; rows equal
in all of these share out what the mix takes of them; a very long text counts by its size, and only ``apply_mix`` moves
it; an empty table gives no rows; a source of size 0 has target 0. Reruns give the same rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, needs, small_lookup, stored, text_of
from .ordering import BUCKET_ROWS, SPAN, running, seeded

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST = 2.0


def quality(size: str = "size", marks: str = "_marks", chars: str = "_chars"):
    """Weight of a document from 1/8 to 1: texts full of marks and digits are drawn later. Eighths, so that it is exact."""
    return (F.lit(8) - F.least(F.lit(7), F.floor(F.col(marks) * 32 / F.greatest(F.col(chars), F.lit(1))))) / F.lit(8.0)


def below(key: str = "key", eighths: str = "_eighths", rows: str = "_rows"):
    """Share of a source's documents whose key is expected to be smaller.

    A key of quality q exceeds t with probability exp(-q t), so the shares of the eight qualities give the distribution of
    the source. It grows with the key, also as rounded, and is even over (0, 1) whatever the qualities are.
    """
    parts = [F.get(eighths, F.lit(k - 1)) * (F.lit(1.0) - F.exp(F.col(key) * F.lit(-k / 8))) for k in range(1, 9)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / F.col(rows)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Sources by code point, null last, weigh ``weights`` in turn.

    Water filling in closed form: in order of size to weight, the first k sources stay at their limit and the others
    share the rest by weight; k is the least that leaves nobody above. The rows are sources, not documents.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_weight", turn).withColumn("_limit", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), "source")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_total", F.sum("source_size").over(everything) * F.lit(total_share))
        .withColumn("_used", F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_left"))
        .withColumn("_open", F.col("_limit") > F.col("_level") * F.col("_weight"))
        .withColumn("_final", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return s.select("source", "source_size", F.coalesce(F.least(F.col("_limit"), F.col("_final") * F.col("_weight")), F.col("_limit")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, key, epochs, copies, taken and check, a hash of the text."""
    d = needs(docs, doc_id="bigint", source="string", text="string").select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"),
        F.regexp_count(text_of(), F.lit(r"[!-@\[-`{-~]")).cast("bigint").alias("_marks"),
        F.length(text_of()).cast("bigint").alias("_chars"),
        F.md5(text_of()).alias("check"),
    )
    d = d.select("doc_id", "source", "check", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_group"), "size", quality().alias("_quality"))
    # u from a hash; the key is exponential with the quality as its rate
    u = (seeded(seed, "doc_id", "check") + 1) / F.lit(float(SPAN))
    d = stored(d.withColumn("_u", u).withColumn("key", -F.log(F.col("_u")) / F.col("_quality")).drop("_u"), "mix_rows")
    eighths = F.array(*[F.count(F.when(F.col("_quality") == k / 8, 1)) for k in range(1, 9)])
    sizes = d.groupBy("_group").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_rows"), eighths.alias("_eighths"))
    targets = source_targets(sizes.select("source", "source_size"), weights, total_share, most)
    targets = targets.withColumn("_group", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).drop("source")
    targets = sizes.select("_group", "_rows", "_eighths").join(targets, "_group")
    d = small_lookup(d, targets, "_group", "key", "targets")
    share = F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(BUCKET_ROWS)))
    d = d.withColumn("_bucket", F.least(F.floor(below() * share), share - 1).cast("bigint"))
    d = running(d, ["_group"], "_bucket", ["key", "doc_id", "size"], "size", "_before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    d = d.withColumn("epochs", whole).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # in: its middle is before the end of the rest, so the cut is the document end nearest to the target
    chosen = (F.col("size") > 0) & (F.col("_before") + F.col("size") / F.lit(2.0) < F.col("_rest"))
    d = d.withColumn("copies", (F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0)) + F.when(chosen, F.lit(1)).otherwise(F.lit(0))).cast("bigint"))
    return d.select("doc_id", "source", "size", "source_size", "target", "key", "epochs", "copies", (F.col("copies") * F.col("size")).alias("taken"), "check")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with all their columns.

    Rows are known by id, source and hash of the text. Where rows repeat all three, what the mix takes of them is shared
    out evenly over them, the first ones one more.
    """
    check, copies, copy, place = (free_name(docs, n) for n in ("_check", "_copies", "_copy", "_place"))
    taken = mix(docs, **options).groupBy("doc_id", "source", "check").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = stored(taken.select(*[F.col(c).alias(f"_mix_{c}") for c in taken.columns]), "mix_taken")
    named = docs.withColumn(check, F.md5(text_of()))
    same = named["doc_id"].cast("bigint").eqNullSafe(taken["_mix_doc_id"]) & named["source"].cast("string").eqNullSafe(taken["_mix_source"]) & (named[check] == taken["_mix_check"])
    out = named.join(taken, same)
    if taken.where("_mix_rows > 1").isEmpty():
        out = out.withColumn(copies, F.col("_mix_copies"))
    else:
        each = Window.partitionBy("_mix_doc_id", "_mix_source", "_mix_check").orderBy("_mix_rows")
        out = out.withColumn(place, F.row_number().over(each)).withColumn(copies, F.expr(f"_mix_copies div _mix_rows + if({place} <= _mix_copies % _mix_rows, 1, 0)")).where(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*[named[f"`{c}`"] for c in docs.columns])
