"""Hard-negative mining over embeddings by branch and bound in ball trees.

Rows are dealt by hash over partitions of bounded size and each partition builds one ball tree for every label. A node
knows its rows' centre and radius, so the inner product of an anchor with any of its rows lies between the product with
the centre minus and plus the anchor's length times the radius. A search goes best bound first and drops nodes whose
upper bound is under the window or strictly beneath the current k-th score, and nodes whose lower bound is above the
window; it is exact, as scores are integers that doubles hold, or Python's where they do not. Anchors meet the
partitions in blocks; a first round finds each anchor's positives, a second one the negatives of every positive, and
what partitions found is merged by a ranking of a few rows each.

Components become floor(256 x). Of an anchor (vec_id divisible by 100) the positives are the first ``positives`` other
rows of its label; the negatives of a positive are the first ``negatives`` rows of other labels whose score is from 30
to 90 percent of the positive's. Higher scores come first, ties by vec_id, missing ones last.

Defined results: rows without a label or a vector, or with a component that is null or not finite, take no part, nor do
rows whose scaled component leaves the doubles; vectors of different lengths do not meet, an empty vector scores 0;
scores beyond BIGINT count as its ends; repeated rows are rows of their own, so a repeated anchor repeats its results and
each copy is another row to it; a row without an id can be found but is no anchor; a positive of negative score has no
negatives; an empty table gives no rows. Only the three columns are read; extra columns may have any name.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import needs, stored

POSITIVES, NEGATIVES = 5, 10
#: Rows of a partition at most on average, rows from which a partition is worth a core, and anchors of a block.
PART_ROWS, LEAST_ROWS, BLOCK = 1 << 15, 1 << 11, 1 << 12
LEAF = 64
#: Products of this size are exact in doubles.
EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Forest(NamedTuple):
    """Ball trees over rows in the order of ``rows``. A node holds rows[lo:hi]; children are -1 at leaves; roots by label."""

    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    roots: np.ndarray
    root_label: np.ndarray


def plant(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Forest:
    """One tree for each label: nodes are halved at the median of their widest component."""
    order = np.argsort(labels, kind="stable")
    found, starts = np.unique(labels[order], return_index=True)
    todo = [(lo, hi, -1, 0) for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True)]
    nodes: list[tuple] = []
    children: list[list[int]] = []
    for lo, hi, parent, side in todo:  # grows while it is read: breadth first
        own = x[order[lo:hi]]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        at = len(nodes)
        nodes.append((centre, radius, lo, hi))
        children.append([-1, -1])
        if parent >= 0:
            children[parent][side] = at
        if hi - lo > leaf and radius > 0:
            widest = int(np.argmax(own.max(0) - own.min(0)))
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, widest], mid)]
            todo += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
    column = lambda k, kind: np.array([n[k] for n in nodes], kind)
    return Forest(order, column(0, float).reshape(len(nodes), x.shape[1]), column(1, float), column(2, np.int64), column(3, np.int64), np.array(children, np.int64).reshape(-1, 2), np.arange(len(found)), found)


class Rows(NamedTuple):
    """Rows of one partition with vectors of one length."""

    id: np.ndarray
    no_id: np.ndarray
    row: np.ndarray
    label: np.ndarray
    x: np.ndarray


def _best(score: np.ndarray, at: np.ndarray, rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rows.row[at], rows.id[at], rows.no_id[at], -score))[:k]
    return score[order], at[order]


def search(rows: Rows, forest: Forest, q: np.ndarray, roots: np.ndarray, k: int, skip: int, low: float = -np.inf, high: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places): the first k rows below ``roots`` whose score is within the window, without the row ``skip``."""
    length = float(np.sqrt(q @ q))
    score, at, kth = np.zeros(0), np.zeros(0, np.int64), -np.inf
    nodes = roots

    def bounded(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, reach = forest.centre[nodes] @ q, length * forest.radius[nodes]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        stays = (middle + reach + slack >= max(low, kth)) & (middle - reach - slack <= high)
        return nodes[stays], np.minimum(middle + reach + slack, high)[stays]

    nodes, upper = bounded(nodes)
    while len(nodes):
        # the better half of what is open, at least 16 nodes
        take = np.argsort(-upper, kind="stable")[: max(16, len(nodes) // 2)]
        rest = np.ones(len(nodes), bool)
        rest[take] = False
        now, left = nodes[take], nodes[rest]
        leaf = forest.child[now, 0] < 0
        if leaf.any():
            lo, n = forest.lo[now[leaf]], (forest.hi - forest.lo)[now[leaf]]
            place = forest.rows[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            s = rows.x[place] @ q
            fits = (s >= max(low, kth)) & (s <= high) & (rows.row[place] != skip)
            score, at = _best(np.concatenate([score, s[fits]]), np.concatenate([at, place[fits]]), rows, k)
            kth = score[-1] if len(score) == k else kth
        nodes, upper = bounded(np.concatenate([left, forest.child[now[~leaf]].ravel()]))
    return score, at


def _plain(rows: Rows, q: np.ndarray, among: np.ndarray, k: int, skip: int, low: int | None, high: int | None) -> tuple[list[int], np.ndarray]:
    """``search`` in Python's integers, for products that doubles do not hold."""
    place = np.flatnonzero(among & (rows.row != skip))
    whole = [int(c) for c in q]
    exact = [max(_LOW, min(_HIGH, sum(a * int(b) for a, b in zip(whole, rows.x[p], strict=True)))) for p in place]
    keyed = sorted((-s, bool(rows.no_id[p]), int(rows.id[p]), int(rows.row[p]), int(p)) for s, p in zip(exact, place, strict=True) if (low is None or s >= low) and (high is None or s <= high))[:k]
    return [-x[0] for x in keyed], np.array([x[-1] for x in keyed], np.int64)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    values = pa.chunked_array(column).combine_chunks().flatten().to_numpy(zero_copy_only=False) if size else np.zeros(0)
    return np.floor(256 * values.astype(float)).reshape(-1, size) if size else np.zeros((len(column), 0))


def _by_size(table: pa.Table, vector: str) -> dict[int, np.ndarray]:
    size = np.array(pc.list_value_length(table.column(vector)).to_numpy(), np.int64)
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


_FOUND = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, id bigint, row bigint, score bigint"


def _finder(k: int, same: bool, low_percent: int = 0, high_percent: int = 0):
    """Of the anchors and rows of one pair of block and partition: the first k rows of each anchor (and positive)."""

    def find(anchors: pa.Table, others: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(8)]
        asked, there = _by_size(anchors, "q"), _by_size(others, "v")
        for size in asked.keys() & there.keys():
            a, o = anchors.take(asked[size]), others.take(there[size])
            ids = o.column("vec_id")
            rows = Rows(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), o.column("row").to_numpy(), o.column("label").to_numpy(), _matrix(o.column("v"), size))
            q = _matrix(a.column("q"), size)
            exact = size == 0 or float(np.abs(q).max()) * float(np.abs(rows.x).max()) * size < EXACT
            forest = plant(rows.x, rows.label) if exact else None
            wanted = [a.column("positives").to_pylist(), *(a.column(c).to_pylist() for c in ("asker", "asker_id", "asker_label"))]
            for vector, positives, row, anchor_id, label in zip(q, *wanted, strict=True):
                for p in [None] if same else positives:
                    low, high = (None, None) if same else (-(-low_percent * p["score"] // 100), high_percent * p["score"] // 100)
                    if not same and low > high:
                        continue
                    if exact:
                        mine = forest.roots[(forest.root_label == label) == same]
                        score, at = search(rows, forest, vector, mine, k, row, -np.inf if low is None else low, np.inf if high is None else high)
                    else:
                        score, at = _plain(rows, vector, (rows.label == label) == same, k, row, low, high)
                    n = len(at)
                    place, positive, theirs = (0, None, None) if same else (p["place"], p["id"], p["score"])
                    for column, values in zip(out, ([row] * n, [anchor_id] * n, [place] * n, [positive] * n, [theirs] * n, [None if rows.no_id[x] else int(rows.id[x]) for x in at], rows.row[at].tolist(), [int(s) for s in score]), strict=True):
                        column.extend(values)
        types = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in _FOUND.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return find


def prepared(df: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part; every seventh vec_id has the next label."""
    d = needs(df, vec_id="bigint", label="bigint", embedding="array<double>")
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) * 256 < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, ((F.col("label").cast("decimal(20,0)") + 1) % 10).cast("bigint")).otherwise(F.col("label"))
    return d.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), F.col("embedding").alias("v"))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key in the order of scores, numbered from 1 in ``place``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)


def mine(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = 30, high_percent: int = 90, every: int = 100, part_rows: int = PART_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding)."""
    rows = stored(prepared(df), "vectors")  # numbered once
    n = rows.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // part_rows), min(cores, n // LEAST_ROWS))
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // block))
    dealt = lambda of, n, seed: F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(n)).cast("int")
    there = rows.withColumn("part", dealt("row", parts, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("block", dealt("row", blocks, 2)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # names and columns of their own: both sides of the cogroup come from one table
    asked = asked.select("part", "block", F.col("row").alias("asker"), F.col("vec_id").alias("asker_id"), F.col("label").alias("asker_label"), F.col("v").alias("q"))
    met = lambda a, find: a.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInArrow(find, _FOUND)
    none = F.lit(None).cast("array<struct<place:int,id:bigint,score:bigint>>")
    near = _first(met(asked.withColumn("positives", none), _finder(positives, True)), ["anchor"], positives)
    near = stored(near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("_n").alias("place"), "id", "score")).alias("positives")), "positives")
    second = asked.join(near, asked["asker"] == near["anchor"]).drop("anchor")
    far = _first(met(second, _finder(negatives, False, low_percent, high_percent)), ["anchor", "place"], negatives)
    return far.select("anchor_id", "positive_id", F.col("_n").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
