"""Keyed state over streams."""

import time

from pyspark.sql import functions as F

from fieldloom.streaming import incremental as I


def test_value_counts_close_idle_values(spark, tmp_path):
    """Values that come back after their state was dropped, nulls, and a restart between all batches."""
    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    want: dict = {}
    # else a stream of available files would wait for time-outs for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for batch in ([("a", 1)] * 5 + [("b", None)], [("a", 1), (None, 2)], [("b", None)] * 3 + [(None, None)]):
        for x in batch:
            want[x] = want.get(x, 0) + 1
        spark.createDataFrame([(*x, "given") for x in batch], "x string, y int, n string").coalesce(1).write.mode("append").parquet(src)
        rows = I.value_counts(I.stream_of(spark, src, "x string, y int, n string"), ["x", "y"], idle_ms=1)
        q = rows.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")).start()
        q.awaitTermination()
        time.sleep(0.1)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r.x, r.y): r.n for r in I.total_counts(spark.read.parquet(sink), ["x", "y"]).collect()}
    assert got == want
