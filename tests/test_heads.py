import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import gaps, index
from loomdex.streaming import heads

SCHEMA = "docid bigint, text_id string, tokens array<string>"


def test_gaps_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    docs = [(d, str(d), [f"w{min(int(rng.paretovariate(0.8)), 12)}" for _ in range(rng.randint(0, 6))]) for d in range(1, 90)]
    go = lambda: heads.start_gaps(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    for k, (lo, hi) in enumerate([(0, 30), (30, 31), (31, 89)]):
        spark.createDataFrame(docs[lo:hi], SCHEMA).repartition(2).write.parquet(f"{tmp_path}/in/{k}")
        go()
        if k == 1:  # the last batch once more, as after a failure before its commit
            commits = tmp_path / "cp" / "commits"
            last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
            for p in (commits / str(last), commits / f".{last}.crc"):
                p.unlink(missing_ok=True)
            go()
    want = gaps.dgaps(index.postings(spark.createDataFrame(docs, SCHEMA)))
    got = heads.read_gaps(spark, f"{tmp_path}/out")
    rows = lambda df: sorted(map(tuple, df.select("term", "docid", "tf", "dgap").collect()))
    assert rows(got) == rows(want)
    assert got.groupBy("term").agg(F.max("place").alias("a"), F.count("*").alias("b")).where("a <> b").isEmpty()
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
    spark.createDataFrame([(5, "late", ["w1"])], SCHEMA).write.parquet(f"{tmp_path}/in/9")
    with pytest.raises(Exception, match="docids must increase"):
        go()
