from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SMALL
from skillgrid.streaming import monthly


def test_windows_over_a_stream_equal_those_over_the_table(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = monthly.counts(monthly.read_events(spark, str(tmp_path / "in"), table), "1 day", "3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = monthly.counts(table, "1 day")
    got, want = spark.table("windows"), whole
    key = ["start", "event_type", "n"]
    assert got.select(*key).exceptAll(want.select(*key)).isEmpty() and want.select(*key).exceptAll(got.select(*key)).isEmpty()
    assert got.agg(F.sum("n")).first()[0] == table.count()
