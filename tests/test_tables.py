"""Reading the given tables."""

from pyspark.sql import functions as F

from logweave.sources.tables import read_table, text_lines


def test_one_row_group_over_many_splits_is_spread(spark, tmp_path):
    """Only one split of such a file yields rows."""
    spark.range(5000).select(F.col("id").alias("event_id"), F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_table(spark, str(tmp_path), "events")
        held = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(held) == 5000 and max(held) < 1000
        assert got.select("event_id").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_table_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert text_lines(spark, str(tmp_path)).collect() == []
