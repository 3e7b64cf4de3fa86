import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import selection
from pagemill.operators.running import ranked, running
from pagemill.session import interrupt, interruptible


def test_totals_as_by_hand(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.randint(0, 9)) for k in range(400)]
    wanted, held = {}, {}
    for g, k, n in rows:
        held[g] = held.get(g, 0) + n
        wanted[k] = held[g]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(7)
    assert {r["k"]: r["t"] for r in running(df, ["g"], [F.asc("k")], {"t": F.col("n")}).collect()} == wanted
    assert {r["k"]: r["rank"] for r in ranked(df, [], [F.desc("k")]).collect()} == {k: 400 - k for k in range(400)}
    assert ranked(df.limit(0), ["g"], [F.asc("k")]).count() == 0


def test_once_keeps_the_first_by_place(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "a"), (1, "other"), (None, "c"), (3, None)]
    spark.createDataFrame(rows, "key long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = selection.once(spark.read.parquet(str(tmp_path / "t")), "key").select("key", "text").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a"), (2, "b"), (3, None)]


def test_tagged_jobs_end(spark):
    failed = []

    def work():
        with interruptible(spark, "stop-me"):
            try:
                spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(30) or x, "long")("id")).collect()
            except Exception as e:  # noqa: BLE001
                failed.append(str(e))

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(40):
        time.sleep(0.5)
        if thread.is_alive() and spark.sparkContext.statusTracker().getActiveJobsIds():
            interrupt(spark, "stop-me")
    thread.join(30)
    assert not thread.is_alive() and len(failed) == 1


@pytest.mark.parametrize("k", [1, 3])
def test_best_of_file_as_sorted(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice(["f", "f", "g", None]), float(rng.randint(0, 5)), i) for i in range(60)]
    df = spark.createDataFrame(rows, "source_order long, file_name string, score double, position long")
    whole = {r["source_order"]: r["file_rank"] for r in selection.best_of_file(df).collect()}
    by_file = {}
    for row in sorted(rows, key=lambda r: (-r[2], r[3])):
        by_file.setdefault(row[1], []).append(row[0])
    assert whole == {o: n for orders in by_file.values() for n, o in enumerate(orders, 1)}
    assert {r["source_order"]: r["file_rank"] for r in selection.best_of_file(df, k).collect()} == {o: n for o, n in whole.items() if n <= k}
