"""TF-IDF weights. A ranker is two functions of columns, so another one can take their place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def tf_weight(tf: Column, float32: bool = False) -> Column:
    """ln(1 + tf)."""
    w = F.log1p(tf.cast("double"))
    return w.cast("float") if float32 else w


def idf_weight(n: Column, df: Column, float32: bool = False) -> Column:
    """ln(1 + n / df)."""
    ratio = n.cast("double") / df.cast("double")
    if float32:
        return F.log(F.lit(1.0) + ratio.cast("float").cast("double")).cast("float")
    return F.log(F.lit(1.0) + ratio)


@dataclass(frozen=True)
class Ranker:
    """Weights of a posting and of a term."""

    tf: Callable[[Column], Column] = tf_weight
    idf: Callable[[Column, Column], Column] = idf_weight


TFIDF = Ranker()
TFIDF_FLOAT32 = Ranker(lambda tf: tf_weight(tf, True), lambda n, df: idf_weight(n, df, True))
