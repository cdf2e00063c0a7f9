"""CSV rejects and encodings, versioned publishing."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import csv as csv_source, sinks


def _folder(**files):
    path = tempfile.mkdtemp(prefix="tessera-csv-")
    for name, data in files.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
    return path


def test_rows_with_too_many_fields_are_counted(spark):
    path = _folder(**{"a.csv": b'a,b\n1,2\n3,4,5\n6\n"7,7",8\n"9,9",1,\n\n10,"x ""q"", y"\n'})
    read = csv_source.load_csv(spark, path)
    assert read.rejected_rows == 2 and sorted(read.rejected_sample) == ['"9,9",1,', "3,4,5"]
    assert sorted((r.a, r.b) for r in read.df.collect()) == [("1", "2"), ("10", 'x "q", y'), ("6", None), ("7,7", "8")] or \
        sorted((r.a, str(r.b)) for r in read.df.collect()) == [("1", "2"), ("10", 'x "q", y'), ("6", "None"), ("7,7", "8")]
    with pytest.raises(csv_source.LoaderError, match="2 rows"):
        csv_source.load_csv(spark, path, strict=True)


def test_surplus_in_a_row_that_spans_lines(spark):
    path = _folder(**{"a.csv": b'a,b\n1,"two\nlines"\n3,"four\nlines",5\n'})
    read = csv_source.load_csv(spark, path)
    assert read.rejected_rows == 1 and [tuple(r) for r in read.df.collect()] == [(1, "two\nlines")]


def test_encoding_is_decided_for_each_file(spark):
    path = _folder(**{"latin [1].csv": "n,t\n1,café\n".encode("latin-1"), "utf 8.csv": "n,t\n2,café\n".encode()})
    read = csv_source.load_csv(spark, path)
    assert read.encoding == "mixed" and sorted(map(tuple, read.df.collect())) == [(1, "café"), (2, "café")]
    assert csv_source.load_csv(spark, os.path.join(path, "utf 8.csv")).encoding == "UTF-8"


def test_a_failing_table_keeps_its_last_version(spark):
    target = sinks.Target(path=tempfile.mkdtemp(prefix="tessera-pub-"))
    df = spark.range(10).withColumn("V", F.col("id") * 2)
    assert all(r.ok for r in sinks.publish({"raw_data": df, "cleaned_data": df}, target).collect() if r.error is None)
    broken = df.withColumn("V", F.raise_error(F.lit("no")).cast("long"))
    status = {r.table: r.ok for r in sinks.publish({"raw_data": df.limit(3), "cleaned_data": broken, "predictions": df.limit(0)}, target).collect()}
    assert status["raw_data"] and not status["cleaned_data"] and not status["predictions"]
    assert sinks.read_published(spark, target, "raw_data").count() == 3
    assert sinks.read_published(spark, target, "cleaned_data").count() == 10
    assert sinks.read_published(spark, target, "predictions") is None
    sinks.publish({"raw_data": df.limit(4)}, target, if_exists="append")
    assert sinks.read_published(spark, target, "raw_data").count() == 7
    assert not [r for r in sinks.publish({"raw_data": df}, target, if_exists="fail").collect() if r.table == "raw_data"][0].ok


def test_a_run_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x * 1.5
    raw = spark.range(50).select("id", counted(F.col("id").cast("double")).alias("Value"))
    target = sinks.Target(path=tempfile.mkdtemp(prefix="tessera-pub-"))
    status = {r.table: r.ok for r in sinks.publish_run(target, raw=raw).collect()}
    assert seen.value == 50
    assert status["column_statistics"] and status["correlation_matrix"] and status["pipeline_metadata"]
    assert {r.column_name for r in sinks.read_published(spark, target, "column_statistics").collect()} == {"id", "Value"}


def test_save_to_catalog_append_and_fail(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS tessera_test")
    target, df = sinks.Target(database="tessera_test"), spark.range(3).withColumn("V", F.lit(1))
    try:
        assert sinks.save_dataframe(df, "Saved", target) and sinks.save_dataframe(df, "Saved", target, "append")
        assert spark.table("tessera_test.saved").count() == 6 and spark.table("tessera_test.saved").columns == ["id", "v"]
        with pytest.raises(Exception):
            sinks.save_dataframe(df, "Saved", target, "fail")
    finally:
        spark.sql("DROP DATABASE tessera_test CASCADE")
