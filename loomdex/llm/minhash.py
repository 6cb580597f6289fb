"""MinHash fingerprints of whole texts.

A fingerprint holds, for 128 permutations x -> a * x + b modulo 2^64 (a odd) of the hashed shingles of five lower-cased
words, 16 bits of the least image, mixed; the share of equal places estimates the Jaccard likeness with a standard
error of at most 0.045. Equal texts have equal fingerprints. The permutations run in numpy over blocks of texts.

``near_pairs`` cuts fingerprints into bands, joins equal bands in Spark and verifies the Jaccard likeness on the shingle
sets. ``edited_neighbours`` compares each text with an edited form of itself and with the next document.

Defined results: a null text is empty; a text without words has the fingerprint of the empty set, all ones, and is
like another empty one; fewer than five words are one shingle; rows that repeat a doc_id follow each other by text;
null ids come last; with a single document the next one is itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import needs, salted_lookup, stored, text_of
from .ngram_join import _sets
from .textarrays import mix, shingles, stream, words

PERMUTATIONS = 128
BANDS = 32
_A = stream(1001, PERMUTATIONS) | np.uint64(1)
_B = stream(2002, PERMUTATIONS)
_EMPTY = np.full(PERMUTATIONS, 0xFFFF, np.uint16)
#: Texts signed at a time.
ROWS = 256


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of 16-bit values for each text."""
    out = np.empty((len(texts), PERMUTATIONS), np.uint16)
    with np.errstate(over="ignore"):
        for lo, hi, counts, hashes in words(texts):
            many, every = shingles(counts, hashes)
            full = many > 0
            starts = (np.cumsum(many) - many)[full]
            least = np.empty((len(starts), PERMUTATIONS), np.uint64)
            if len(starts):
                image = np.empty_like(every)
                for k in range(PERMUTATIONS):
                    np.multiply(every, _A[k], out=image)
                    image += _B[k]
                    least[:, k] = np.minimum.reduceat(image, starts)
            block = out[lo:hi]
            block[~full] = _EMPTY
            block[full] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _hex(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, 512 hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [_hex(r) for lo in range(0, batch.num_rows, ROWS) for r in signatures(batch.column(1).slice(lo, ROWS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "fingerprint"])

    return needs(docs, doc_id="bigint", text="string").select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def _by_descending_id(docs: DataFrame) -> DataFrame:
    """Partitions of consecutive ids, each in descending order and ending with the row that follows it.

    The cuts are ids of the table, so the first row of a partition is known before anything moves; it is also sent to
    the partition before it, as ``ghost``. Each text moves once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(f"{k / parts!r}D" for k in range(1, parts + 1))
    ids = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {20 * parts})"), F.max("doc_id")).first()
    cuts = sorted({*(ids[0] or []), *([ids[1]] if ids[1] is not None else [])})  # as many as partitions at most
    n, step = max(1, len(cuts)), max(1, int(len(cuts) ** 0.5))
    if cuts:
        numbers = lambda c: F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>")  # noqa: E731  one literal, however many
        every, coarse = numbers(cuts), numbers(cuts[step - 1 :: step])
        docs = docs.withColumn("_c", F.size(F.filter(coarse, lambda c: c < F.col("doc_id"))) * step)
        docs = docs.withColumn("_bucket", F.greatest(F.lit(0), F.col("_c") + F.size(F.filter(F.slice(every, F.col("_c") + 1, F.lit(step)), lambda c: c < F.col("doc_id")))))
        docs = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_bucket")))
        first = F.get(every, F.col("_bucket")).eqNullSafe(F.col("doc_id"))
        place = lambda at, ghost: F.struct(at.cast("int").alias("at"), F.lit(ghost).alias("ghost"))
        docs = docs.withColumn("_to", F.explode(F.when(first, F.array(place(F.col("_bucket"), False), place((F.col("_bucket") + 1) % n, True))).otherwise(F.array(place(F.col("_bucket"), False)))))
    else:
        docs = docs.withColumn("_to", F.struct(F.lit(0).alias("at"), F.lit(False).alias("ghost")))
    docs = docs.select("doc_id", "text", F.col("_to.at").alias("_at"), F.col("_to.ghost").alias("ghost"))
    return docs.repartitionById(n, F.col("_at")).sortWithinPartitions("ghost", F.col("doc_id").desc_nulls_last(), "text").select("doc_id", "text", "ghost")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in descending order of doc_id; after the last comes the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, signature) and last the row that follows them."""
        own, after = rows[:-1], rows[1:]
        changed = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for (_, t, _), (_, u, _) in zip(own, after, strict=True)]
        new = signatures(pa.array(changed, pa.large_string()))
        sig = np.stack([s for *_, s in rows])
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, *_ in own], pa.int64()), pa.array([len(t) for _, t, _ in own], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
            pa.array([_hex(s) for s in sig[:-1]], pa.string()), pa.array([_hex(s) for s in new], pa.string()),
            pa.array((sig[:-1] == new).mean(axis=1), pa.float64()), pa.array((sig[:-1] == sig[1:]).mean(axis=1), pa.float64()),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ghosts = part.column(2).to_pylist()
                own = ghosts.index(True) + 1 if True in ghosts else len(ghosts)
                part = part.slice(0, own)
                rows = held + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), signatures(part.column(1)), strict=True))
                head = head or rows[0]
                if len(rows) > 1:
                    yield emit(rows)
                if own < len(ghosts) or True in ghosts:
                    return
                held = rows[-1:]
        if held:  # no row follows: the first of all does
            yield emit([*held, head])

    d = needs(docs, doc_id="bigint", text="string").select("doc_id", text_of().alias("text"))
    return _by_descending_id(d).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(docs: DataFrame, threshold: float = 0.75, bands: int = BANDS, block: int = 512) -> DataFrame:
    """Verified pairs (a, b, jaccard), a < b: of texts with different sets, and of copies.

    Texts with the same set of shingles are one class, named by its least id, and each other member makes a pair with
    that one. All classes that share a band of their fingerprints are compared and those at ``threshold`` make a pair; a
    band of many is dealt out as pairs of blocks of about ``block`` classes, so the work grows with the square of
    a band, in many tasks. A pair at 0.75 misses all of 32 bands once in 200,000 times.
    """
    width = PERMUTATIONS // bands * 4

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                cls = [ids.view(np.int64) for _, _, ids, _, _ in _sets(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(cls)), pa.array([_hex(r) for r in signatures(part.column(1))], pa.string())], ["doc_id", "cls", "fingerprint"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ids, _, found in _sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["cls", "toks"])

    texts = needs(docs, doc_id="bigint", text="string").select("doc_id", text_of().alias("text")).where("doc_id is not null")
    prints = stored(texts.mapInArrow(signed, "doc_id bigint, cls bigint, fingerprint string"), "fingerprints")
    reps = stored(prints.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("fingerprint").alias("fingerprint")), "classes")
    cut = reps.select("cls", F.posexplode(F.array(*[F.substring("fingerprint", k * width + 1, width) for k in range(bands)])).alias("band", "value"))
    many = cut.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int")).drop("n")
    dealt = cut.join(many, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    left = dealt.select("band", "value", F.col("cls").alias("x"), F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("hi"))
    right = dealt.select("band", "value", F.col("cls").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"))
    met = left.join(right, ["band", "value", "lo", "hi"]).where("lo < hi or x < y")
    pairs = stored(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "band_pairs")
    seen = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    toks = stored(texts.select("text").mapInArrow(sets, "cls bigint, toks array<bigint>").join(seen, "cls", "left_semi").dropDuplicates(["cls"]), "band_sets").join(reps.select("cls", "rep"), "cls")
    side = lambda c, n: toks.select(F.col("cls").alias(c), F.col("toks").alias(f"_t{n}"), F.col("rep").alias(f"_r{n}"))
    jaccard = F.size(F.array_intersect("_ta", "_tb")) / F.size(F.array_union("_ta", "_tb"))
    near = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b"), jaccard.alias("jaccard")).where((F.col("jaccard") >= threshold) & (F.col("a") < F.col("b")))
    copies = salted_lookup(prints.select("doc_id", "cls").distinct(), reps.select("cls", "rep"), "cls", "doc_id").where("rep < doc_id")
    return near.union(copies.select("rep", "doc_id", F.lit(1.0)))
