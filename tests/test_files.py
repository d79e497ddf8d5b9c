"""Text and CSV sources over several files."""

from logweave.plans import all_queries
from logweave.sources.files import read_csv_table
from logweave.sources.logformat import read_text_log


def test_header_on_the_second_row_of_every_file(spark, tmp_path):
    for name, rows in (("a", ['1,"x, y"', "2,z"]), ("b", ["3,w"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["a title", "Id,Some Text", *rows]) + "\n")
    got = read_csv_table(spark, str(tmp_path), header_row=2)
    assert got.columns == ["Id", "Some Text"]
    assert sorted(map(tuple, got.collect())) == [("1", "x, y"), ("2", "z"), ("3", "w")]


def test_line_ids_follow_file_order(spark, tmp_path):
    """The larger file is read first, but its lines come last."""
    (tmp_path / "a.log").write_text("a0\na1\n")
    (tmp_path / "b.log").write_text("".join(f"b{i}\n" for i in range(5000)))
    got = [r.value for r in read_text_log(spark, str(tmp_path)).orderBy("raw_line_id").collect()]
    assert got == ["a0", "a1", *[f"b{i}" for i in range(5000)]]
    ids = sorted(r.raw_line_id for r in read_text_log(spark, str(tmp_path)).collect())
    assert ids == list(range(5002))


def test_first_rows_without_quoting(spark, tmp_path):
    """Quotes are text, and rows come in order of file and line."""
    (tmp_path / "a.csv").write_text('Id,"Text\n1,"x\n2,y"\n')
    (tmp_path / "b.csv").write_text('Id,"Text\n3,z\n4,w\n')
    got = read_csv_table(spark, str(tmp_path), quoting=False, n_rows=3)
    assert got.columns == ["Id", '"Text'] and sorted(map(tuple, got.collect())) == [("1", '"x'), ("2", 'y"'), ("3", "z")]
    assert read_csv_table(spark, str(tmp_path), quoting=False).count() == 4


def test_first_rows_of_parts_cut_by_size(spark, tmp_path):
    """Every part has its header, however the ranges are cut, and parts come in order of their number."""
    events = spark.range(6000).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "id % 97 AS user_id",
                                          "CASE WHEN id % 2 = 0 THEN 'error' ELSE 'view' END AS event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    small = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "6000"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = all_queries()[0]["csv_first_rows"](spark, str(tmp_path))
        assert got.columns == ["LineId", "EventTemplate"]
        assert sorted(int(r.LineId) for r in got.collect()) == list(range(2000))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
