"""Sources: CSV files by kind, feather files, streams over files and folders."""

import os

import pytest
from pyspark.sql import functions as F

from tablier.sources import loader, sinks
from tablier.streaming.scoring import file_stream, run_to_table


def test_only_files_with_spanning_records_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,t\n1,"two\nlines, ""quoted"""\n2,x\n'.encode())
    (tmp_path / "b.csv").write_bytes('id,t\n3,"one ""line"""\n'.encode())
    (tmp_path / "c.csv").write_bytes("id,t\n4,Québec\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes("id,t\n5,a � that is there\n".encode())
    kinds = {k: sorted(os.path.basename(f) for f in v) for k, v in loader.csv_file_kinds(spark, str(tmp_path)).items()}
    assert kinds == {(True, False): ["a.csv"], (False, False): ["b.csv", "d.csv"], (False, True): ["c.csv"]}
    rows, encoding = loader.read_csv_text(spark, str(tmp_path))
    assert encoding == "latin1"
    assert {r.id: r.t for r in rows.collect()} == {
        "1": 'two\nlines, "quoted"', "2": "x", "3": 'one "line"', "4": "Québec", "5": "a � that is there"
    }


def test_a_flat_csv_file_is_split_over_tasks(spark, tmp_path):
    path = str(tmp_path / "flat.csv")
    with open(path, "w") as f:
        f.write("id,t\n" + "".join(f"{i},some text {i}\n" for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows, _ = loader.read_csv_text(spark, path)
        assert rows.select(F.spark_partition_id()).distinct().count() > 2 and rows.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_feather_files_are_bounded_and_written_again_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FEATHER_BATCHES", 2)
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x")).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        folder = str(tmp_path / "parts")
        first = sorted(tuple(r) for r in sinks.write_feather_parts(df, folder).collect())
        assert len(first) >= 9 and all(n <= 100 for _, n in first) and sum(n for _, n in first) == 1000
        again = sorted(tuple(r) for r in sinks.write_feather_parts(df, folder).collect())
        assert again == first and loader.read_feather(spark, folder).count() == 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    back = loader.read_feather(spark, folder)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="No feather files"):
        loader.read_feather(spark, str(tmp_path))


def test_streams_over_a_file_and_over_a_folder_of_parts(spark, tmp_path):
    df = spark.range(100).select("id")
    df.repartition(4).write.parquet(str(tmp_path / "rows.parquet"))
    assert run_to_table(file_stream(spark, str(tmp_path), df.schema, "rows.parquet")).count() == 100
    single = next(p for p in os.listdir(tmp_path / "rows.parquet") if p.endswith(".parquet"))
    assert 0 < run_to_table(file_stream(spark, str(tmp_path / "rows.parquet"), df.schema, single)).count() < 100


def test_unknown_and_absent_datasets(spark, tmp_path):
    with pytest.raises(ValueError, match=r"Unsupported dataset format '.txt'. Supported formats: .csv, .feather, .parquet."):
        loader.load_dataset(spark, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError, match="does not exist"):
        loader.load_dataset(spark, str(tmp_path / "x.parquet"))
