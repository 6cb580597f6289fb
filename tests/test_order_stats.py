import random

import pytest
from pyspark.sql import functions as F

from loomdex.functions.order_stats import percentiles
from loomdex.operators.ranges import placed

PS = (0, 1, 50, 90, 95, 99, 100)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_every_rank(spark, kind):
    rng = random.Random(2)
    for values in ([], [7], [3, 3, 3], [rng.randrange(-50, 50) for _ in range(999)], [rng.randrange(-(1 << 60), 1 << 60) for _ in range(400)], [5] * 700 + list(range(300))):
        values = [float(v) if kind == "double" else v for v in values]
        r = percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}").repartition(5), "v", PS).first()
        s = sorted(values)
        assert r["n"] == len(s) and (r["min"], r["max"]) == ((s[0], s[-1]) if s else (None, None))
        for p in PS:
            at = p * len(s) // 100
            assert r[f"p{p}"] == (s[at] if at < len(s) else None)


def test_no_window_over_all_values(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("v"))
    plan = placed(rows, ["v"], below=F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    wide = [x for x in plan.splitlines() if x.strip().startswith(("+- Window", "Window", ":- Window", ":  +- Window")) and "_range" not in x]
    assert not wide
    got = placed(rows, ["v"], below=F.lit(1)).collect()
    assert [r["below"] for r in sorted(got)] == list(range(10_000))
