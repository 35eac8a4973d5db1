"""Incremental collection over files that arrive between runs."""

from cartulary.streaming import collect
from pyspark.sql import functions as F


def test_a_second_run_reads_what_is_new_and_merges(spark, tmp_path):
    source, target = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    schema = "k long, at long, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x"), (None, 1, "n")], schema).write.parquet(source)
    latest = lambda: {tuple(r) for r in collect.collect_latest(collect.read_stream(spark, source), ["k"], F.struct("at", "v"), target).collect()}
    assert latest() == {(1, 3, "c"), (2, 1, "x"), (None, 1, "n")}
    spark.createDataFrame([(1, 2, "late"), (2, 5, "y"), (3, 1, "z")], schema).write.mode("append").parquet(source)
    want = {(1, 3, "c"), (2, 5, "y"), (3, 1, "z"), (None, 1, "n")}
    assert latest() == want
    assert latest() == want  # nothing new


def test_windows_of_an_out_of_order_stream(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    rows = [("2024-01-02 00:00:00", "a"), ("2024-01-01 23:59:59", "a"), ("2024-01-01 00:00:00", "b")]
    spark.createDataFrame(rows, "t string, e string").selectExpr("cast(t as timestamp_ntz) t", "e").repartition(3).write.parquet(source)
    got = collect.window_counts(collect.read_stream(spark, source, 1), "t", ["e"], str(tmp_path / "out"))
    assert sorted((str(r.start)[:10], r.e, r.n) for r in got.collect()) == [("2024-01-01", "a", 1), ("2024-01-01", "b", 1), ("2024-01-02", "a", 1)]
