"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.docstream import spread

#: ASCII white space, the only separators of words in every operator here.
SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table through Spark, whatever store the path names; a file of one or two splits is dealt out."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark.sparkContext, "_loomdex_dir"):
        spark.sparkContext._loomdex_dir = tempfile.mkdtemp(prefix="loomdex-")
    return spark.sparkContext._loomdex_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The files survive the loss of any executor. They are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomdex-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def salted_lookup(facts: DataFrame, dims: DataFrame, key: str, spread: str, salts: int = 32) -> DataFrame:
    """Left join of ``facts`` to ``dims`` (one row per key) where one key may hold a third of all facts.

    Every key of ``dims`` is copied ``salts`` times and the facts of a key are dealt over the copies by the hash of
    ``spread``, so that no task gets more than that share of a hot key. Rows with a null key match nothing.
    """
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    right = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def small_lookup(facts: DataFrame, dims: DataFrame, key: str, spread: str, label: str, most: int = 100_000) -> DataFrame:
    """Inner join of ``facts`` to a table with a row for every key of theirs, such as one of sources.

    The table is written and counted: up to ``most`` rows it is sent to all executors, and beyond that the join is
    salted. A key with a third of all facts stays dealt out either way.
    """
    dims = stored(dims, label)
    if dims.count() <= most:
        return facts.join(F.broadcast(dims), key)
    return salted_lookup(facts, dims, key, spread)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def needs(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; extra columns of any name are left behind."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """An empty frame of the schema."""
    return spark.createDataFrame([], schema)


def keep_by_id(docs: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``chosen``; every column stays as it is. Null keys match null keys.

    A document id is the join key of the texts, so the texts move once and a hot source or group plays no part.
    """
    ids = chosen.select(F.col(key).alias("_kept_id"))
    return docs.join(ids, docs[key].eqNullSafe(ids["_kept_id"]), "left_semi")
